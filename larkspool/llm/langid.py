"""Language identification by interpolated Kneser-Ney character models.

One model per language, all in shared sorted hash arrays: for each order the
hashes of the n-grams of any language in ascending order, and beside each the log
probability in every language. The language with the lowest cross-entropy per
character is chosen. From texts kept out of the counts come the temperature of
the score and each language's rejection bound on the cross-entropy.

The models are fitted on the driver to a bounded sample: per language at most
`per_lang` rows, those with the smallest hash of their id.

Defined cases: null texts and texts without a letter are `und` with score 0;
ties go to the language that sorts first; without any labelled row all texts are
`und`; repeated rows are treated one by one; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .textops import RollingHash, batch_slices, characters, code_point_keys, extended, fold, narrow, text_chunks

ORDER = 4
PER_LANG = 300
#: Share of a language's texts whose cross-entropy may lie over its bound.
REJECTED = 0.01


class SortedHash:
    """Sorted hashes with an index on their leading bits; position or -1."""

    def __init__(self, keys: np.ndarray):
        self.keys = keys
        self.bits = max(1, int(len(keys)).bit_length())
        first = np.searchsorted(keys, np.arange(1 << self.bits, dtype=np.uint64) << np.uint64(64 - self.bits))
        self.first = np.append(first, len(keys))
        self.most = int(np.diff(self.first).max()) if len(keys) else 0

    def find(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), -1, np.int64)
        at = self.first[(x >> np.uint64(64 - self.bits)).astype(np.int64)]
        for _ in range(self.most):
            ok = at < len(self.keys)
            hit = np.zeros(len(x), bool)
            hit[ok] = self.keys[at[ok]] == x[ok]
            out[hit] = at[hit]
            at = at + 1
        return out


def prepared(text: str | None) -> str:
    return f" {(text or '').lower()} "


def _grams(texts: list[str], order: int):
    """For k = 1..order: hashes at each position, and where they lie in a text."""
    codes, offs = characters(texts)
    roll = RollingHash(codes, code_point_keys())
    room = np.repeat(offs[1:], np.diff(offs)) - np.arange(len(codes))
    return [np.append(roll.grams(k), np.zeros(k - 1, np.uint64)) for k in range(1, order + 1)], room, offs


def kneser_ney(texts: list[str], order: int, vocabulary: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Per order: (n-gram hashes, probabilities, context hashes, back-off weights)."""
    grams, room, _ = _grams(texts, order)
    levels = []
    for k in range(1, order + 1):
        where = np.flatnonzero(room >= k)
        keys, at, counts = np.unique(grams[k - 1][where], return_index=True, return_counts=True)
        levels.append([keys, where[at], counts.astype(float)])
    for k in range(1, order):  # lower orders count the distinct preceding characters
        suffix = grams[k - 1][levels[k][1] + 1]
        seen, n = np.unique(suffix, return_counts=True)
        counts = np.zeros(len(levels[k - 1][0]))
        counts[np.searchsorted(levels[k - 1][0], seen)] = n
        levels[k - 1][2] = counts
    out = []
    for k in range(1, order + 1):
        keys, at, counts = levels[k - 1]
        n1, n2 = (counts == 1).sum(), (counts == 2).sum()
        discount = n1 / (n1 + 2 * n2) if n1 and n2 else 0.5
        context = grams[k - 2][at] if k > 1 else np.zeros(len(at), np.uint64)
        ctx, inv = np.unique(context, return_inverse=True)
        total = np.bincount(inv, weights=counts, minlength=len(ctx))
        kinds = np.bincount(inv, weights=counts > 0, minlength=len(ctx))
        total = np.maximum(total, 1e-12)
        back = np.where(kinds > 0, discount * kinds / total, 1.0)
        if k == 1:
            lower = np.full(len(keys), 1 / vocabulary)
        else:
            lower_keys, lower_p = out[k - 2][0], out[k - 2][1]
            lower = lower_p[np.searchsorted(lower_keys, grams[k - 2][at + 1])]
        p = np.where(counts > 0, np.maximum(counts - discount, 0) / total[inv], 0) + back[inv] * lower
        out.append((keys, p, ctx, back))
    return out


class Model:
    """The merged arrays of all languages; entropy() and predict()."""

    def __init__(self, by_lang: dict[str, list[str]], order: int = ORDER):
        self.langs, self.order = sorted(by_lang), order
        alphabet = set().union(*(set(t) for ts in by_lang.values() for t in ts)) if by_lang else set()
        self.vocabulary = len(alphabet) + 1
        single = [kneser_ney(by_lang[x], order, self.vocabulary) for x in self.langs]
        self.grams, self.logp, self.ctx, self.back = [], [], [], []
        for k in range(order):
            ctx = np.unique(np.concatenate([m[k][2] for m in single])) if single else np.zeros(0, np.uint64)
            back = np.zeros((len(ctx), len(single)))
            for j, m in enumerate(single):
                back[np.searchsorted(ctx, m[k][2]), j] = np.log(m[k][3])
            self.ctx.append(SortedHash(ctx))
            self.back.append(back)
            keys = np.unique(np.concatenate([m[k][0] for m in single])) if single else np.zeros(0, np.uint64)
            logp = np.full((len(keys), len(single)), np.nan)
            for j, m in enumerate(single):
                logp[np.searchsorted(keys, m[k][0]), j] = np.log(m[k][1])
            self.grams.append(SortedHash(keys))
            self.logp.append(logp)
        self._fill([t for ts in by_lang.values() for t in ts])
        self.temperature, self.bounds = 1.0, np.full(len(self.langs), np.inf)

    def _fill(self, texts: list[str]) -> None:
        """n-grams one language lacks get its backed-off value."""
        grams, room, _ = _grams(texts, self.order)
        for k in range(self.order):
            where = np.flatnonzero(room > k)
            keys, at = np.unique(grams[k][where], return_index=True)
            at = where[at]
            row = self.grams[k].find(keys)
            if k == 0:
                lower = np.full(self.logp[0].shape, -np.log(self.vocabulary))
                own = np.broadcast_to(self.back[0][0] if len(self.back[0]) else 0, lower.shape)
            else:
                lower = self.logp[k - 1][self.grams[k - 1].find(grams[k - 1][at + 1])]
                c = self.ctx[k].find(grams[k - 1][at])
                own = np.where(c[:, None] >= 0, self.back[k][c], 0.0)
            have = self.logp[k][row]
            self.logp[k][row] = np.where(np.isnan(have), own + lower, have)

    def entropy(self, texts: list[str]) -> np.ndarray:
        """Cross-entropy per character: a row per text, a column per language."""
        grams, room, offs = _grams(texts, self.order)
        n = len(room)
        total = np.zeros((n, len(self.langs)), np.float32)
        # the n-gram of order k+1 that ends at position e starts at e-k
        end = np.arange(n)
        since = end - np.repeat(offs[:-1], np.diff(offs))
        level = np.minimum(since, self.order - 1)
        for k in range(self.order - 1, -1, -1):
            e = end[level[end] >= k] if k == self.order - 1 else end[(level[end] >= k)]
            if not len(e):
                continue
            row = self.grams[k].find(grams[k][e - k])
            hit = row >= 0
            total[e[hit]] += self.logp[k][row[hit]]
            miss = e[~hit]
            if k:
                c = self.ctx[k].find(grams[k - 1][miss - k])
                total[miss[c >= 0]] += self.back[k][c[c >= 0]]
            else:
                total[miss] += (self.back[0][0] if len(self.back[0]) else 0) - np.log(self.vocabulary)
            done = np.zeros(n, bool)
            done[e[hit]] = True
            end = end[~done[end]]
        sums = np.add.reduceat(total, offs[:-1], axis=0, dtype=np.float64)
        return -sums / np.diff(offs)[:, None]

    def calibrate(self, held: list[tuple[str, str]], rejected: float = REJECTED) -> None:
        """Temperature that best explains held-back texts; bounds on the
        cross-entropy that all but a share of a language's texts keep."""
        if not held or not self.langs:
            return
        h = self.entropy([t for t, _ in held])
        y = np.array([self.langs.index(x) for _, x in held])

        def loss(t):
            z = -h * t
            z -= z.max(axis=1, keepdims=True)
            return -(z[np.arange(len(y)), y] - np.log(np.exp(z).sum(axis=1))).mean()

        self.temperature = min((float(x) for x in np.geomspace(0.5, 64, 40)), key=loss)
        for j in range(len(self.langs)):
            if (y == j).any():
                self.bounds[j] = np.quantile(h[y == j, j], 1 - rejected)

    def predict(self, texts: list[str | None]):
        """(language, score, accepted) for each text."""
        out: list[tuple[str, float, bool]] = [("und", 0.0, False)] * len(texts)
        have = [i for i, t in enumerate(texts) if self.langs and t and any(map(str.isalpha, t))]
        low = [prepared(texts[i]) for i in have]
        for i, j in text_chunks(low):
            h = self.entropy(low[i:j])
            best = h.argmin(axis=1)
            z = np.exp(-(h - h.min(axis=1, keepdims=True)) * self.temperature)
            for d in range(j - i):
                b = int(best[d])
                out[have[i + d]] = (self.langs[b], float(1 / z[d].sum()), bool(h[d, b] <= self.bounds[b]))
        return out


def train(labelled: DataFrame, per_lang: int = PER_LANG, order: int = ORDER) -> Model:
    """labelled: doc_id, text, lang. A fifth of the sample only calibrates."""
    rows = narrow(labelled, "doc_id", "text", "lang").where("lang is not null and text is not null")
    # ids alone are drawn, so texts aren't shuffled; first split by hash, as a language may hold most rows
    ids = rows.groupBy("doc_id").agg(F.min("lang").alias("_lang")).withColumn("_h", F.xxhash64("doc_id")).withColumn("_s", F.pmod("_h", F.lit(64)))
    part = F.row_number().over(Window.partitionBy("_lang", "_s").orderBy("_h", "doc_id"))
    ids = ids.withColumn("_n", part).where(F.col("_n") <= per_lang)
    ids = ids.withColumn("_m", F.row_number().over(Window.partitionBy("_lang").orderBy("_h", "doc_id"))).where(F.col("_m") <= per_lang)
    picked = rows.join(F.broadcast(ids.select("doc_id", "_lang", "_m")), "doc_id").where("lang = _lang")  # per_lang ids a language
    got = picked.groupBy("doc_id", "lang", "_m").agg(F.min("text").alias("text")).orderBy("lang", "_m").collect()
    fit: dict[str, list[str]] = {}
    held: list[tuple[str, str]] = []
    for r in got:
        if r["_m"] % 5 == 0:
            held.append((prepared(r["text"]), r["lang"]))
        else:
            fit.setdefault(r["lang"], []).append(prepared(r["text"]))
    model = Model(fit, order)
    model.calibrate([x for x in held if x[1] in fit])
    return model


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """docs with lang_pred, score and accepted (these replace such columns)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the sample
    docs = docs.drop("lang_pred", "score", "accepted")
    at = docs.columns.index("text")

    def run(batches):
        for batch in (part for whole in batches for part in batch_slices(whole, at)):
            cols = list(zip(*shared.value.predict(batch.column(at).to_pylist()), strict=True)) or [[]] * 3
            new = [pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.float64(), pa.bool_()), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *new], [*batch.schema.names, "lang_pred", "score", "accepted"])

    return docs.mapInArrow(run, extended(docs, lang_pred="string", score="double", accepted="boolean"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = narrow(spark.read.parquet(f"{sf_dir}/documents.parquet"), "doc_id", "text", "lang")
    model = train(docs.where(fold(4) != 2))
    out = identify(narrow(docs, "doc_id", "text"), model)
    return out.select("doc_id", (fold(4) == 2).alias("held_out"), "lang_pred", "score", "accepted")
