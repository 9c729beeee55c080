"""Benchmark decontamination by template windows.

A text becomes a template: numbers, names and units of measure are replaced by
typed placeholders, other words are lower-cased and stripped of punctuation. A
name is a capitalised word that does not begin a sentence; a unit is a known unit
word after a number. Windows of `window` template words of the benchmark (an item
with fewer words is one window) are hash-joined with the documents' windows. A
document holds an item if, along one alignment (words may come in or go), the windows found cover at least
`similarity` of the item's words and the slots agree: within the alignment each value of
a slot in the item stands for one value in the document and the other way round,
so numbers or names may differ, but must be replaced consistently.

The benchmark is the query set: its windows go to the documents in blocks of at
most `block_windows` windows, so what is broadcast has a bound at any size.

Defined cases: null or empty texts, and texts without a word, hold nothing and
are held by nothing; an item's windows that consist of placeholders only count
only beside one that does not; repeated rows and repeated items are reported one
by one; an empty benchmark finds nothing; other columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .textops import LOWER, RollingHash, chunks, column_bytes, hash_bytes, isin_sorted, lean, mix, narrow, word_spans

WINDOW = 5
SIMILARITY = 0.8
BLOCK_WINDOWS = 1_000_000

UNITS = "mm cm m km in ft yd mi mg g kg t lb oz ml l s sec second seconds min minute minutes h hour hours day days week weeks month months year years % percent usd eur dollars dollar cents euro euros metre metres meter meters mile miles gram grams litre litres degrees celsius watt watts volt volts hz mb gb kb".split()

NUM, NAME, UNIT = np.uint64(11), np.uint64(12), np.uint64(13)
_WORD = np.zeros(256, bool)
_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), ord("%"), *range(128, 256)]] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_STOP = np.zeros(256, bool)
_STOP[[ord(c) for c in ".!?:"]] = True
_UNIT_KEYS = np.sort(np.array([hash_bytes(u.encode()) for u in UNITS], np.uint64))


#: How capitalised words are read: STRICT takes them for names inside a sentence
#: only; OPEN at its beginning, too, and a run of names or numbers is one slot;
#: PLAIN knows no names, so case doesn't matter.
READINGS = STRICT, OPEN, PLAIN = range(3)


def templates(buf: np.ndarray, offs: np.ndarray, reading: int = STRICT):
    """(template hash, surface hash, first) of the words of each document: the
    first is NUM, NAME, UNIT or the word's own hash, the second always the
    word's own; document d has the words first[d]:first[d+1]. Words without a
    letter, digit or % are left out."""
    keep = _WORD[buf]
    starts, ends, _ = word_spans(buf, offs)
    kept = np.concatenate([[0], np.cumsum(keep)])
    solid = kept[ends] > kept[starts]
    last = buf[ends - 1] if len(ends) else np.zeros(0, np.uint8)
    stop = _STOP[last]
    # a new line before a word begins a sentence, too
    lines = np.concatenate([[0], np.cumsum(buf == 0x0A)])
    begin = np.ones(len(starts), bool)
    if len(starts):
        begin[1:] = stop[:-1] | (lines[starts[1:]] > lines[ends[:-1]])
        begin[np.isin(starts, offs)] = True
        before = np.searchsorted(starts, offs[:-1])
        begin[before[before < len(starts)]] = True
    starts, ends, begin = starts[solid], ends[solid], begin[solid]
    first = np.searchsorted(starts, offs)
    clean = buf[keep]
    s, e = kept[starts], kept[ends]
    surface = RollingHash(LOWER[clean]).span(s, e) if len(clean) else np.zeros(0, np.uint64)
    if not len(surface):
        return surface, surface, first
    head, nxt = clean[s], np.append(clean, 0)[s + 1]
    digits = np.concatenate([[0], np.cumsum(_DIGIT[clean])])
    number = _DIGIT[head] & (digits[e] - digits[s] >= (e - s + 1) // 2)
    upper = (head >= 65) & (head <= 90) | (head == 0xC3) & (nxt >= 0x80) & (nxt <= 0x9E) & (nxt != 0x97)
    name = upper & ~begin if reading == STRICT else upper & (reading == OPEN)
    after = np.append(False, number[:-1])
    after[first[:-1][first[:-1] < len(after)]] = False
    unit = after & isin_sorted(surface, _UNIT_KEYS)[1]
    out = surface.copy()
    out[name], out[number], out[unit] = NAME, NUM, UNIT
    return _joined(out, surface, first, begin) if reading == OPEN else (out, surface, first)


def _joined(out: np.ndarray, surface: np.ndarray, first: np.ndarray, begin: np.ndarray):
    """Each run of names or of numbers within a sentence as one word."""
    more = np.append(False, (out[1:] == out[:-1]) & ((out[1:] == NAME) | (out[1:] == NUM))) & ~begin
    head = np.flatnonzero(~more)
    nth = np.arange(len(out)) - head[np.cumsum(~more) - 1]
    value = np.where(nth > 0, mix(surface + nth.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), surface)
    return out[head], np.add.reduceat(value, head), np.searchsorted(head, first)


def window_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """A hash of each run of n words."""
    m = len(words) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    h = np.zeros(m, np.uint64)
    for i in range(n):
        h = mix(h * np.uint64(0x9E3779B97F4A7C15) + words[i : i + m])
    return h


class Index:
    """The windows of a block of items, by hash."""

    def __init__(self, items: list[tuple[int, str]], window: int, reading: int = STRICT):
        self.window, self.reading = window, reading
        self.ids, self.words, self.surface = [], [], []
        short: dict[int, list] = defaultdict(list)
        hashes, where = [], []
        for item, text in items:
            buf = np.frombuffer((text or "").encode(), np.uint8)
            words, surface, _ = templates(buf, np.array([0, len(buf)]), reading)
            if not len(words):
                continue
            k = len(self.ids)
            self.ids.append(item)
            self.words.append(words)
            self.surface.append(surface)
            n = min(window, len(words))
            h = window_hashes(words, n)
            if n < window:
                short[n].append((h[0], k, 0))
            else:
                hashes.append(h)
                where += [(k, p) for p in range(len(h))]
        self.tables = {}
        if hashes:
            self.tables[window] = self._table(np.concatenate(hashes), where)
        for n, rows in short.items():
            self.tables[n] = self._table(np.array([r[0] for r in rows], np.uint64), [r[1:] for r in rows])

    @staticmethod
    def _table(hashes: np.ndarray, where: list) -> tuple:
        order = np.argsort(hashes, kind="stable")
        keys, start = np.unique(hashes[order], return_index=True)
        return keys, np.append(start, len(order)), np.array(where, np.int64)[order]

    def hits(self, words: np.ndarray, surface: np.ndarray, first: np.ndarray, similarity: float):
        """(document, place of the item in ids, words covered, words) of the items held."""
        votes: dict[tuple[int, int], dict[int, set]] = defaultdict(lambda: defaultdict(set))
        for n, (keys, start, where) in self.tables.items():
            h = window_hashes(words, n)
            at, found = isin_sorted(h, keys)
            pos = np.flatnonzero(found)
            doc = np.searchsorted(first, pos, "right") - 1
            inside = pos + n <= first[doc + 1]  # no window crosses documents
            for p, d, a in zip(pos[inside].tolist(), doc[inside].tolist(), at[pos[inside]].tolist(), strict=True):
                for k, q in where[start[a] : start[a + 1]].tolist():
                    votes[d, k][p - q].add(q)
        out = []
        for (d, k), shifts in sorted(votes.items()):
            total = len(self.words[k])
            least, n = similarity * total, min(self.window, total)
            if len({q + j for qs in shifts.values() for q in qs for j in range(n)}) < least:
                continue
            m = max((self._held(k, [(shift + q, q) for q in qs], n, least, surface) for shift, qs in shifts.items()), default=0)
            slack = int((1 - similarity) * total) + 1
            for shift in [] if m or len(shifts) < 2 else sorted(shifts):  # the occurrence's first shift, words come in or go after it
                near = [(x + q, q) for x in shifts if abs(x - shift) <= slack for q in shifts[x]]
                m = max(m, self._held(k, _chain(near), n, least, surface))
            if m:
                out.append((d, k, m, total))
        return out

    def _held(self, k: int, pairs: list, n: int, least: float, surface: np.ndarray) -> int:
        """How many words the windows (place in the text, place in the item)
        cover, if that is enough and the slots agree; else 0."""
        covered = {q + j: p + j for p, q in pairs for j in range(n)}
        return len(covered) if len(covered) >= least and self._consistent(k, covered, surface) else 0

    def _consistent(self, k: int, covered: dict, surface: np.ndarray) -> bool:
        """Whether the slots map one to one, and some word is no slot."""
        there, back, plain = {}, {}, False
        for i in sorted(covered):
            kind = self.words[k][i]
            if kind not in (NUM, NAME, UNIT):
                plain = True
                continue
            a, b = (kind, self.surface[k][i]), surface[covered[i]]
            if there.setdefault(a, b) != b or back.setdefault((kind, b), a) != a:
                return False
        return plain


def _chain(pairs: list) -> list:
    """The longest chain of pairs that ascends in both places."""
    tops, last, before = [], [], {}
    for p, q in sorted(pairs, key=lambda x: (x[1], -x[0])):
        i = bisect_left(tops, p)
        before[p, q] = last[i - 1] if i else None
        tops[i : i + 1], last[i : i + 1] = [p], [(p, q)]
    out, at = [], last[-1] if last else None
    while at:
        out.append(at)
        at = before[at]
    return out[::-1]


def contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, similarity: float = SIMILARITY, block_windows: int = BLOCK_WINDOWS) -> DataFrame:
    """doc_id, item_id, covered, words, and t, the text's xxhash64: one row per
    document and item it holds."""
    spark = docs.sparkSession
    schema = "doc_id long, item_id long, covered int, words int, t long"
    rows = docs.select(docs["doc_id"], docs["text"], F.xxhash64(docs["text"]).alias("t"))

    def search(items):
        shared = spark.sparkContext.broadcast([Index(items, window, r) for r in READINGS])  # at most block_windows windows each

        def run(batches):
            for batch in batches:
                ids, hashes = batch.column(0).to_pylist(), batch.column(2).to_pylist()
                buf, offs = column_bytes(batch.column(1))
                out = []
                for i, j in chunks(offs):
                    held = {}
                    for index in shared.value:
                        words, surface, first = templates(buf[offs[i] : offs[j]], offs[i : j + 1] - offs[i], index.reading)
                        for d, n, m, total in index.hits(words, surface, first, similarity):
                            held.setdefault((d, n), (m, total))
                    out += [(ids[i + d], index.ids[n], m, total, hashes[i + d]) for (d, n), (m, total) in sorted(held.items())]
                cols = list(zip(*out, strict=True)) or [[]] * 5
                types = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], ["doc_id", "item_id", "covered", "words", "t"])

        return rows.mapInArrow(lean(run, "powers"), schema)

    out, block, size = None, [], 0
    for r in narrow(benchmark, "item_id", "text").toLocalIterator():
        block.append((r["item_id"], r["text"]))
        size += len((r["text"] or "").split())
        if size >= block_windows:
            part = search(block)
            out, block, size = (part if out is None else out.unionByName(part)), [], 0
    if block:
        part = search(block)
        out = part if out is None else out.unionByName(part)
    return out if out is not None else spark.createDataFrame([], schema)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """docs without those that hold an item of the benchmark; all columns stay. A
    row is known by its id and text together, so other texts of an id stay."""
    found = contaminated(docs, benchmark, **options).select(F.col("doc_id").alias("_held"), F.col("t").alias("_t")).distinct()
    return docs.join(found, docs["doc_id"].eqNullSafe(F.col("_held")) & (F.xxhash64(docs["text"]) == F.col("_t")), "left_anti")


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet")).drop("t")
