"""Document fingerprints by consistent weighted sampling.

Terms are the words of a text (A-Z lower-cased), weighted by their counts. For
each of K samples a term of weight w draws, from its own hash, r and c from
Gamma(2, 1) and b uniform: t = floor(ln w / r + b), ln y = r (t - b), and the
term with the least ln c - ln y - r is sampled together with its t. Two texts
share a sample with a probability equal to their generalised Jaccard similarity,
sum of minima over sum of maxima of the weights. A sample is kept as 16 bits.

Defined cases: a null text is the empty text; texts without a word have the
fingerprint of zeros, which equals itself; documents are in ascending order of
doc_id (null first), then of text; a sole document is its own next; other
columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .textops import LOWER, RollingHash, batch_slices, chunks, mix, narrow, stored, word_spans

SAMPLES = 64
#: (term, weight) pairs whose samples are drawn at a time.
DRAWN = 1024


def _uniform(x: np.ndarray, bits: int) -> np.ndarray:
    """The leading bits as a number inside (0, 1)."""
    return ((x >> np.uint64(64 - bits)).astype(np.float32) + np.float32(0.5)) * np.float32(2.0**-bits)


def _seeds(samples: int) -> np.ndarray:
    return mix(np.arange(1, samples + 1, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F))


def draw(terms: np.ndarray, weights: np.ndarray, samples: int) -> tuple[np.ndarray, np.ndarray]:
    """For each (term, weight): ln a and t in each sample."""
    base = mix(terms[:, None] ^ _seeds(samples)[None, :])
    more = mix(base + np.uint64(1))
    r = -np.log(_uniform(base, 24) * _uniform(base << np.uint64(24), 24))
    c = -np.log(_uniform(more, 24) * _uniform(more << np.uint64(24), 24))
    b = _uniform(base << np.uint64(48), 16)
    t = np.floor(np.log(weights.astype(np.float32))[:, None] / r + b)
    return np.log(c) - r * (t - b) - r, t


def fingerprints(texts: list[bytes], samples: int = SAMPLES) -> np.ndarray:
    """A row of 16-bit samples for each UTF-8 text."""
    out = np.zeros((len(texts), samples), np.uint16)
    sizes = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
    seeds, column = _seeds(samples), np.arange(samples)
    for i, j in chunks(sizes):
        buf = LOWER[np.frombuffer(b"".join(texts[i:j]), np.uint8)]
        starts, ends, first = word_spans(buf, sizes[i : j + 1] - sizes[i])
        if not len(starts):
            continue
        words = RollingHash(buf).span(starts, ends)
        vocabulary, word = np.unique(words, return_inverse=True)
        doc = np.repeat(np.arange(j - i), np.diff(first))
        pair, weight = np.unique(doc * len(vocabulary) + word, return_counts=True)
        doc, term = pair // len(vocabulary), pair % len(vocabulary)
        most = int(weight.max()) + 1
        kinds, kind = np.unique(term * most + weight, return_inverse=True)
        ln_a = np.empty((len(kinds), samples), np.float32)
        steps = np.empty((len(kinds), samples), np.float32)
        for s in range(0, len(kinds), DRAWN):
            some = kinds[s : s + DRAWN]
            ln_a[s : s + DRAWN], steps[s : s + DRAWN] = draw(vocabulary[some // most], some % most, samples)
        bounds = np.searchsorted(doc, np.arange(j - i + 1))
        for d in np.unique(doc).tolist():
            own = kind[bounds[d] : bounds[d + 1]]
            best = own[ln_a[own].argmin(axis=0)]
            t = steps[best, column].astype(np.int64).astype(np.uint64)
            out[i + d] = mix(vocabulary[kinds[best] // most] ^ seeds ^ mix(t * np.uint64(0xE7037ED1A0B428DB))) >> np.uint64(48)
    return out


def hexed(row: np.ndarray) -> str:
    return row.astype(">u2").tobytes().hex()


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    return float((a == b).mean())


def edited(text: str, following: str) -> str:
    """The last quarter of the code points replaced by the next text's first."""
    n = len(text) // 4
    return text[: len(text) - n] + following[:n]


RESULT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
_NAMES = [x.split()[0] for x in RESULT.split(", ")]
_TYPES = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]


def compared(ids: list, texts: list[str], samples: int) -> list[tuple]:
    """Result rows for all of the texts but the last."""
    new = [edited(a, b) for a, b in zip(texts, texts[1:], strict=False)]
    raw = [t.encode() for t in new]
    # a text beside its edited text, so that what they share is drawn once
    both = fingerprints([x for pair in zip((t.encode() for t in texts), [*raw, b""], strict=True) for x in pair], samples)
    fp, fe = both[::2], both[1::2]
    return [
        (ids[i], len(texts[i]), hashlib.sha256(raw[i]).hexdigest(), hexed(fp[i]), hexed(fe[i]), likeness(fp[i], fe[i]), likeness(fp[i], fp[i + 1]))
        for i in range(len(new))
    ]


def against_next(docs: DataFrame, samples: int = SAMPLES) -> DataFrame:
    """Fingerprints of every text and of its edited text, and their likeness.

    The table is dealt out by ranges of doc_id, so a document's next one lies in
    the same partition, except for a partition's last document: the last and the
    first of each partition are kept aside with their texts and joined after.
    """
    rows = narrow(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    ordered = rows.repartitionByRange(F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")

    def run(batches):
        part, carry, seen = TaskContext.get().partitionId(), [], False

        def emit(rows, edge=None, text=None, doc=None):
            cols = [[r[i] for r in rows] for i in range(len(_NAMES))] if edge is None else [[doc]] + [[None]] * (len(_NAMES) - 1)
            n = len(cols[0])
            arrays = [pa.array(c, t) for c, t in zip(cols, _TYPES, strict=True)]
            extra = [pa.array([edge] * n, pa.string()), pa.array([part] * n, pa.int32()), pa.array([text] * n, pa.string())]
            return pa.RecordBatch.from_arrays([*arrays, *extra], [*_NAMES, "edge", "part", "edge_text"])

        for batch in (part for whole in batches for part in batch_slices(whole, 1)):
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            if ids and not seen:
                seen = True
                yield emit(None, "first", texts[0], ids[0])
            start = 0
            while start < len(ids):
                size, stop = 0, start
                while stop < len(ids) and size < 1 << 20:
                    size += len(texts[stop])
                    stop += 1
                carry += zip(ids[start:stop], texts[start:stop], strict=True)
                if len(carry) > 1:
                    yield emit(compared([c[0] for c in carry], [c[1] for c in carry], samples))
                carry = carry[-1:]
                start = stop
        if carry:
            yield emit(None, "last", carry[0][1], carry[0][0])

    found = stored(ordered.mapInArrow(run, RESULT + ", edge string, part int, edge_text string"))
    lasts = found.where("edge = 'last'").select("part", "doc_id", F.col("edge_text").alias("text"))
    firsts = found.where("edge = 'first'").select(F.col("part").alias("next_part"), F.col("edge_text").alias("following"))
    parts = found.where("edge = 'last'").select("part")  # one row for each partition
    after = F.lead("part").over(Window.orderBy("part"))
    order = parts.select("part", F.coalesce(after, F.min("part").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("next_part"))
    edges = lasts.join(order, "part").join(firsts, "next_part").select("doc_id", "text", "following")

    def finish(batches):
        for batch in batches:
            out = []
            for doc, text, following in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                out += compared([doc, None], [text, following], samples)
            cols = [[r[i] for r in out] for i in range(len(_NAMES))]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, _TYPES, strict=True)], _NAMES)

    return found.where("edge is null").select(*_NAMES).unionByName(edges.mapInArrow(finish, RESULT))


def op6_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return against_next(spark.read.parquet(f"{sf_dir}/documents.parquet"))
