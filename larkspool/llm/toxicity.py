"""Toxicity: a linear classifier over character n-grams, naive Bayes scaled.

Whether a hashed character n-gram occurs in a text is a feature; its value is the
log-count ratio of the n-gram between the classes, and each text's vector is
brought to unit length; n-grams whose occurrence doesn't differ significantly
between the classes count as nothing. Logistic regression over these features is fitted on the
driver to a bounded sample: per class at most `per_class` labelled rows, those
with the smallest hash of their id. The driver gets the sample's counts, one for
each n-gram and class, and then of each row only the n-grams that count for
something. The classes' true shares, counted over all labelled rows, set the intercept.

Defined cases: a null text is the empty text and gets a score like any other; a
row whose label is null is not learnt from; if a class has no labelled row, every
score is the share of label 1 (0.5 without any label); repeated rows are scored
one by one; columns of the input other than those named are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .textops import RollingHash, batch_slices, characters, code_point_keys, extended, fold, lean, narrow, stored, text_chunks

ORDERS = (4, 5)
BITS = 18
PER_CLASS = 1500
PENALTY = 1e-2
#: Least likelihood-ratio statistic of an n-gram against the classes (p < 1e-4).
EVIDENCE = 16.0
STEPS = 80
THRESHOLD = 0.7
#: Brings unit-length vectors to the scale at which STEPS of Adam settle.
SCALE = 10.0


def features(texts: list[str], orders: tuple[int, ...] = ORDERS, bits: int = BITS):
    """For each text the sorted hashed n-grams that occur in it, lower-cased and
    with a space at either end."""
    mark = np.zeros(1 << bits, bool)
    low = [f" {(t or '').lower()} " for t in texts]
    for i, j in text_chunks(low):
        codes, offs = characters(low[i:j])
        roll = RollingHash(codes, code_point_keys())
        grams = [(roll.grams(q) >> np.uint64(64 - bits)).astype(np.int64) for q in orders]
        for d in range(j - i):
            mark[:] = False
            for q, g in zip(orders, grams, strict=True):
                mark[g[offs[d] : max(offs[d], offs[d + 1] - q + 1)]] = True
            yield np.flatnonzero(mark)


class Model:
    """weights over features and their squared log-count ratios, and intercept."""

    def __init__(self, weights, squares, intercept, orders, bits):
        self.weights, self.squares, self.intercept, self.orders, self.bits = weights, squares, intercept, orders, bits

    def score(self, texts: list[str]) -> np.ndarray:
        out = np.full(len(texts), self.intercept)
        for d, f in enumerate(features(texts, self.orders, self.bits)):
            if len(f):
                out[d] += SCALE * self.weights[f].sum() / (np.sqrt(self.squares[f].sum()) + 1e-9)
        return 1 / (1 + np.exp(-np.clip(out, -30, 30)))


def evidence(a: np.ndarray, b: np.ndarray, n1: float, n0: float) -> np.ndarray:
    """The likelihood-ratio statistic of features in a of n1 texts and b of n0."""

    def term(x):
        return x * np.log(np.maximum(x, 1e-12))

    n = np.float64(n1 + n0)
    return 2 * (term(a) + term(b) + term(n1 - a) + term(n0 - b) - term(a + b) - term(n - a - b) - term(n1) - term(n0) + term(n))


def tally(rows, labels, bits: int = BITS) -> np.ndarray:
    """For either label, how many of its rows have each feature."""
    seen = np.zeros((2, 1 << bits), np.int64)
    for f, label in zip(rows, labels, strict=True):  # an n-gram is once in a row
        seen[label, f] += 1
    return seen


def ratios(seen: np.ndarray, n1: float, n0: float) -> np.ndarray:
    """The log-count ratios of features by their tally in n1 rows of label 1 and n0
    of label 0; 0 without evidence."""
    neg, pos = seen + 1.0
    ratio = np.log(pos / pos.sum()) - np.log(neg / neg.sum())
    ratio[evidence(pos - 1, neg - 1, n1, n0) < EVIDENCE] = 0
    return ratio


def constant(share: float, orders=ORDERS, bits=BITS) -> Model:
    """Of a sample without both classes."""
    p = min(max(share, 1e-6), 1 - 1e-6)
    return Model(np.zeros(1 << bits), np.zeros(1 << bits), float(np.log(p / (1 - p))), orders, bits)


def fit(rows: list[np.ndarray], labels: np.ndarray, ratio: np.ndarray, share: float, orders=ORDERS, bits=BITS, penalty=PENALTY, steps=STEPS) -> Model:
    """rows: features() of the sample, of both classes, that have a ratio; share: of
    label 1 among all labelled rows."""
    y = labels.astype(float)
    size = 1 << bits
    idx, doc = np.concatenate(rows), np.repeat(np.arange(len(rows)), [len(f) for f in rows])
    norm = np.sqrt(np.bincount(doc, weights=ratio[idx] ** 2, minlength=len(rows))) + 1e-9
    x = SCALE * ratio[idx] / norm[doc]
    v, b = np.zeros(size), 0.0
    m, s, mb, sb = np.zeros(size), np.zeros(size), 0.0, 0.0
    for k in range(1, steps + 1):
        z = np.bincount(doc, weights=x * v[idx], minlength=len(rows)) + b
        g = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - y
        gv = np.bincount(idx, weights=x * g[doc], minlength=size) / len(y) + penalty * v / 10
        m, s = 0.9 * m + 0.1 * gv, 0.99 * s + 0.01 * gv * gv
        mb, sb = 0.9 * mb + 0.1 * g.mean(), 0.99 * sb + 0.01 * g.mean() ** 2
        step = 0.05 * np.sqrt(1 - 0.99**k) / (1 - 0.9**k)
        v -= step * m / (np.sqrt(s) + 1e-8)
        b -= step * mb / (np.sqrt(sb) + 1e-8)
    here, p = y.mean(), min(max(share, 1e-6), 1 - 1e-6)
    shift = np.log(p / (1 - p)) - np.log(here / (1 - here))
    return Model(v * ratio, ratio**2, float(b + shift), orders, bits)


def train(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, orders=ORDERS, bits=BITS) -> Model:
    """docs: doc_id, text; labels: doc_id, toxic. Where an id has several labels
    the larger counts; where it has several texts, one of them is learnt from.
    The sample is drawn from the ids alone, so texts aren't shuffled."""
    labels = narrow(labels, "doc_id", "toxic").where(F.col("toxic").isin(0, 1)).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    labels = labels.join(docs.select("doc_id"), "doc_id", "left_semi")
    counts = {r[0]: r[1] for r in labels.groupBy("toxic").count().collect()}
    share = counts.get(1, 0) / max(1, sum(counts.values())) if counts else 0.5
    if len(counts) < 2:
        return constant(share, orders, bits)

    def run(batches):
        for batch in (part for whole in batches for part in batch_slices(whole, 2)):
            rows = [x.astype(np.int32).tobytes() for x in features(batch.column(2).to_pylist(), orders, bits)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1).cast(pa.int32()), pa.array(rows, pa.binary())], ["doc_id", "toxic", "f"])

    def grams(batch):
        return [np.frombuffer(x.as_buffer(), np.int32) for x in batch.column("f")]

    def count(batches):
        seen = np.zeros((2, 1 << bits), np.int64)
        for batch in batches:
            seen += tally(grams(batch), batch.column("toxic").to_pylist(), bits)
        at = np.flatnonzero(seen.any(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (at, *seen[:, at])], ["gram", "n0", "n1"])

    zero, one = (labels.where(F.col("toxic") == x).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class) for x in (0, 1))
    picked = narrow(docs, "doc_id", "text").join(F.broadcast(zero.unionByName(one)), "doc_id").select("doc_id", "toxic", "text")  # 2 * per_class ids
    schema = extended(picked.select("doc_id"), toxic="int", f="binary")
    sample = stored(picked.mapInArrow(lean(run, "powers", "code points"), schema).groupBy("doc_id", "toxic").agg(F.min("f").alias("f")))
    sums = sample.mapInArrow(count, "gram long, n0 long, n1 long").groupBy("gram").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")).toArrow()  # bounded: 2**bits rows
    seen = np.zeros((2, 1 << bits), np.int64)
    seen[:, sums["gram"].to_numpy()] = sums["n0"].to_numpy(), sums["n1"].to_numpy()
    n0, n1 = (min(counts[x], per_class) for x in (0, 1))
    ratio = ratios(seen, n1, n0)
    telling = ratio != 0

    def prune(batches):
        for batch in batches:
            rows = [x[telling[x]].tobytes() for x in grams(batch)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(rows, pa.binary())], ["doc_id", "toxic", "f"])

    got = sample.mapInArrow(prune, schema).collect()
    got.sort(key=lambda r: (r["toxic"], r["doc_id"]))
    return fit([np.frombuffer(r["f"], np.int32) for r in got], np.array([r["toxic"] for r in got]), ratio, share, orders, bits)


def score(docs: DataFrame, model: Model, name: str = "score") -> DataFrame:
    """docs with the score; it replaces a column of that name."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded: two arrays of 2**bits
    docs = docs.drop(name)
    at = docs.columns.index("text")

    def run(batches):
        for batch in (part for whole in batches for part in batch_slices(whole, at)):
            s = shared.value.score(batch.column(at).to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(s, pa.float64())], [*batch.schema.names, name])

    schema = extended(docs, **{name: "double"})
    return docs.mapInArrow(lean(run, "powers", "code points"), schema)


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = narrow(spark.read.parquet(f"{sf_dir}/documents.parquet"), "doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(fold(3) != 1)
    out = score(docs, train(docs, labels))
    return out.select("doc_id", (fold(3) == 1).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
