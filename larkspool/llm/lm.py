"""Language-model scores from a weighted backoff automaton.

The model: n-gram counts of the training rows. Known words have
(c - D) / N, one outcome for all unknown words has D V / N, with D from the
counts of counts; an n-gram that occurs k times after a context that occurs m
times has (k + mu p) / (m + mu), p its probability with a context shorter by one
word, and mu fixed for each order. An n-gram that doesn't occur has the rest,
mu / (m + mu) times p.

The automaton: each n-gram of up to order - 1 words that occurs is a state, and
so is the empty context. A state has an arc for each word seen after it, weighted
with the log-probability, to the state of the longest context that results; it
has one failure arc, weighted log mu / (m + mu), to the state of its context
without the first word. A text is traversed once, left to right: while the state
has no arc for the word, the failure arc is followed and its weight added; then
the word's arc is. The state is carried on from word to word. Arcs and states lie
in hash tables. Texts of a block are walked side by side; a long text is walked
in stretches, each of which reads the order - 1 words before it first, which
brings it to the state that a walk from the start would have.

The automaton has no size bound, so it isn't broadcast. Documents are dealt into
blocks; each block asks for the counts of its own n-grams only, which are exactly
the states and arcs that its traversals can reach, and builds that part of the
automaton. Counts are summed in hash ranges and go back to the blocks that asked.
A block's n-grams go out in `SLICES` rows (more only once there are more hash
ranges than that), an empty slice in none, so there are never more rows than
n-grams. n-grams are told apart by so many hash bits that one which doesn't
occur is taken for another with a chance of 2**-SAFE_BITS at any size of the
table.

Defined cases: a null text is empty and consists of its end alone; an empty table
gives no rows; without any training row all words are unknown (the one outcome,
probability 1); repeated rows count and are scored one by one; a null id counts
as the empty text where ids are hashed; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .textops import LOWER, RollingHash, blocks_for, chunks, column_bytes, fold, mix, narrow, text_bytes, word_spans

ORDER = 3
#: The weight of the shorter context, by order from two words on.
MU = (200.0, 5.0)
BLOCK_BYTES = 6 << 20
#: Text bytes whose n-grams are summed in one hash range.
BUCKET_BYTES = 24 << 20
SLICES = 64
SAFE_BITS = 20
#: Tokens that one walk scores.
STRETCH = 256
SUMS = ("tokens", "kinds", "ones", "twos")
#: Made once: there is a blob for each block, slice and order.
_PRESS, _OPEN = zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()
END = np.uint64(0x5851F42D4C957F2D)
START = np.uint64(0x14057B7EF767814F)


def tokens(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words and of one end for each document; first indexes."""
    words, counts = [], []
    for i, j in chunks(offs):
        part = LOWER[buf[offs[i] : offs[j]]]
        s, e, first = word_spans(part, offs[i : j + 1] - offs[i])
        words.append(RollingHash(part).span(s, e) if len(s) else np.zeros(0, np.uint64))
        counts.append(np.diff(first))
    n = np.concatenate(counts) if counts else np.zeros(0, np.int64)
    first = np.concatenate([[0], np.cumsum(n + 1)])
    out = np.full(first[-1], END, np.uint64)
    is_word = np.ones(len(out), bool)
    is_word[first[1:] - 1] = False
    if words:
        out[is_word] = np.concatenate(words)
    return out, first


def shifted(x: np.ndarray, first: np.ndarray, fill) -> np.ndarray:
    """x one place later within each document, fill at its start."""
    out = np.empty_like(x)
    out[1:] = x[:-1]
    out[first[:-1]] = fill
    return out


def grams(words: np.ndarray, first: np.ndarray, order: int) -> list[np.ndarray]:
    """Hashes of the n-grams of order 1..order that end at each token."""
    out, start = [words], np.array([START])
    for _ in range(1, order):
        before = shifted(out[-1], first, start[0])
        out.append(mix(before * np.uint64(0x9E3779B97F4A7C15) + words))
        start = mix(start * np.uint64(0x9E3779B97F4A7C15) + START)  # the gram of starts alone
    return out


def packed(keys: np.ndarray) -> bytes:
    """Sorted hashes, compressed, as differences of so few bytes as hold the largest,
    byte by byte: the width leads, then the first."""
    if not len(keys):
        return b""
    d = np.diff(keys)
    width = (int(d.max()).bit_length() + 7) // 8 if len(d) else 0
    planes = np.ascontiguousarray(d.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T)
    return _PRESS.compress(bytes([width]) + keys[:1].astype("<u8").tobytes() + planes.tobytes())


def unpacked(data: bytes) -> np.ndarray:
    if not data:
        return np.zeros(0, np.uint64)
    data = _OPEN.decompress(data)
    width = data[0]
    n = (len(data) - 9) // width if width else 0
    d = np.zeros((n + 1, 8), np.uint8)
    d[0] = np.frombuffer(data[1:9], np.uint8)
    d[1:, :width] = np.frombuffer(data[9:], np.uint8).reshape(width, n).T
    return np.cumsum(d.view("<u8").ravel(), dtype=np.uint64)


def _small(x: np.ndarray) -> bytes:
    """Counts, compressed, in the narrowest type that holds them; its width leads."""
    kind = next(t for t in (np.uint8, np.uint16, np.uint32, np.uint64) if not len(x) or x.max() <= np.iinfo(t).max)
    return _PRESS.compress(bytes([np.dtype(kind).itemsize]) + x.astype(kind).tobytes())


def _counts(data: bytes) -> np.ndarray:
    data = _OPEN.decompress(data)
    return np.frombuffer(data[1:], {1: np.uint8, 2: np.uint16, 4: np.uint32, 8: np.uint64}[data[0]]).astype(np.int64)


def slice_bounds(keys: np.ndarray, slices: int, bits: int) -> np.ndarray:
    """Where each of equal ranges of hashes of so many bits begins in the sorted keys."""
    edges = np.array([(i << bits) // slices for i in range(1, slices)], np.uint64)
    return np.concatenate([[0], np.searchsorted(keys, edges), [len(keys)]])


class Table:
    """Distinct hashes in an open-addressed table; find() gives places or -1."""

    def __init__(self, keys: np.ndarray):
        self.keys = keys
        self.mask = np.uint64((1 << max(1, int(2 * len(keys)).bit_length())) - 1)
        self.slots = np.full(int(self.mask) + 1, -1, np.int32)
        rest, slot = np.arange(len(keys), dtype=np.int32), (keys & self.mask).astype(np.int64)
        while len(rest):
            free = self.slots[slot] < 0
            self.slots[slot[free]] = rest[free]
            left = self.slots[slot] != rest
            rest, slot = rest[left], (slot[left] + 1) & int(self.mask)

    def find(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), -1, np.int64)
        rest, slot = np.arange(len(x)), (x & self.mask).astype(np.int64)
        while len(rest):
            at = self.slots[slot]
            hit = (at >= 0) & (self.keys[at] == x[rest])
            out[rest[hit]] = at[hit]
            on = (at >= 0) & ~hit
            rest, slot = rest[on], (slot[on] + 1) & int(self.mask)
        return out


def arc_key(context: np.ndarray, word: np.ndarray) -> np.ndarray:
    """The hash of the n-gram that is the context and the word after it."""
    return mix(context * np.uint64(0x9E3779B97F4A7C15) + word)


class Automaton:
    """The states and arcs of the n-grams that occur in a block's texts.

    State 0 is the empty context; start is that of a text's begin. By state:
    hash, back (the failure arc's weight) and fail (its target). By arc: weight and
    goal. n, v, n1, n2: training tokens, kinds, kinds that occur once and twice.
    """

    def __init__(self, found: list[np.ndarray], totals: list[np.ndarray], first: np.ndarray, ends: int, sums: tuple[int, int, int, int], mu: tuple[float, ...], ranks: list[tuple[int, np.ndarray]] | None = None):
        """found: by order, the hash of the n-gram that ends at each token; totals:
        how often it occurs in the training rows; ends: of those rows. ranks: by
        order, how many different hashes there are, and the rank of each token's."""
        order = len(found)
        ranks = ranks or [(len(u), inv) for u, inv in (np.unique(g, return_inverse=True) for g in found)]
        n, v, n1, n2 = sums
        d = n1 / (n1 + 2 * n2) if n1 and n2 else 0.5
        self.unknown = float(np.log10(d * v / n)) if n else 0.0
        hashes, backs, fails = [np.zeros(1, np.uint64)], [np.zeros(1)], [np.zeros(1, np.int64)]
        keys, weights, goals = [], [], []
        begin, states, start = np.array([START]), 1, 0
        shorter = None  # by token: probability and state of the n-gram of the order before
        for k, (gram, total) in enumerate(zip(found, totals, strict=True), 1):
            if k == 1:
                p = (total - d) / max(n, 1)
            else:
                m = shifted(totals[k - 2], first, ends)
                p = (total + mu[k - 2] * shorter[0]) / (m + mu[k - 2])
            kinds, rank = ranks[k - 1]
            at = np.empty(kinds, np.int64)
            at[rank] = np.arange(len(gram))  # any token of the kind: all that follows depends on the n-gram alone
            seen = total[at] > 0
            at = at[seen]
            if k < order:  # states, that of a text's begin first
                own = np.concatenate([begin, gram[at]])
                own_mu = mu[k - 1]
                hashes.append(own)
                backs.append(np.log10(own_mu / (np.concatenate([[ends], total[at]]) + own_mu)))
                fails.append(np.concatenate([[start], shorter[1][at] if k > 1 else np.zeros(len(at), np.int64)]))
                start = states
                place = np.where(seen, states + np.cumsum(seen), 0)[rank]
                states += len(own)
                begin = mix(begin * np.uint64(0x9E3779B97F4A7C15) + START)
            else:
                place = shorter[1] if k > 1 else np.zeros(len(gram), np.int64)
            keys.append(gram[at])
            weights.append(np.log10(p[at]))
            goals.append(place[at])
            shorter = (p, place)
        self.start, self.order = start, order
        self.hash, self.back, self.fail = np.concatenate(hashes), np.concatenate(backs), np.concatenate(fails)
        self.arcs, self.weight, self.goal = Table(np.concatenate(keys)), np.concatenate(weights), np.concatenate(goals)

    def step(self, state: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The states after the words, and the log10 weights of the arcs taken."""
        state, total, rest = state.copy(), np.zeros(len(state)), np.arange(len(state))
        while len(rest):
            s, w = state[rest], word[rest]
            arc = self.arcs.find(np.where(s > 0, arc_key(self.hash[s], w), w))
            hit = arc >= 0
            total[rest[hit]] += self.weight[arc[hit]]
            state[rest[hit]] = self.goal[arc[hit]]
            last = ~hit & (s == 0)
            total[rest[last]] += self.unknown
            miss = rest[~hit & (s > 0)]
            total[miss] += self.back[state[miss]]
            state[miss] = self.fail[state[miss]]
            rest = miss
        return state, total

    def walk(self, words: np.ndarray, first: np.ndarray) -> np.ndarray:
        """The log10 weight of each document's path."""
        n = np.diff(first)
        pieces = -(-n // STRETCH)
        doc = np.repeat(np.arange(len(n)), pieces)
        a = (np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)) * STRETCH
        b = np.minimum(a + STRETCH, n[doc])
        at = np.maximum(a - (self.order - 1), 0)  # the words before a stretch bring it to its state
        order = np.argsort(at - b, kind="stable")  # the longest first
        doc, a, b, at = doc[order], a[order] + first[doc[order]], b[order] + first[doc[order]], at[order] + first[doc[order]]
        state = np.where(at == first[doc], self.start, 0)
        sums = np.zeros(len(doc))
        while len(at):
            live = int(np.searchsorted(at - b, 0))
            if not live:
                break
            now, weight = self.step(state[:live], words[at[:live]])
            state[:live] = now
            sums[:live] += np.where(at[:live] >= a[:live], weight, 0.0)
            at[:live] += 1
        return np.bincount(doc, weights=sums, minlength=len(n))


def score(docs: DataFrame, training: Column, order: int = ORDER, mu: tuple[float, ...] = MU, block_bytes: int = BLOCK_BYTES, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """doc_id, training, n_tokens, n_known, train_tokens, base_score, score of
    every row; learnt from the rows where training holds."""
    total = text_bytes(docs)
    blocks, buckets = blocks_for(total, block_bytes), blocks_for(total, bucket_bytes)
    slices = max(SLICES, buckets)
    bits = min(64, int(total * order).bit_length() + SAFE_BITS)  # a token has a byte at least
    block = F.pmod(F.xxhash64(docs["doc_id"], docs["text"]), F.lit(blocks))
    dealt = docs.select(docs["doc_id"], docs["text"], F.coalesce(training, F.lit(False)).alias("training"), block.alias("block"))

    def kinds(g: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The distinct keys of n-grams, the key of each and the slices' bounds."""
        keys, inv = np.unique(g >> np.uint64(64 - bits), return_inverse=True)
        return keys, inv, slice_bounds(keys, slices, bits)

    def ask(table: pa.Table) -> pa.Table:
        buf, offs = column_bytes(table.column("text"))
        words, first = tokens(buf, offs)
        train = np.repeat(table.column("training").to_numpy(), np.diff(first))
        own, rows = table.column("block")[0].as_py(), [([], []) for _ in range(slices)]
        for g in grams(words, first, order):
            keys, inv, edge = kinds(g)
            counts = np.bincount(inv, weights=train, minlength=len(keys)).astype(np.int64)
            for s, (k, c) in enumerate(rows):
                k.append(packed(keys[edge[s] : edge[s + 1]]))
                c.append(_small(counts[edge[s] : edge[s + 1]]))
        rows = [(own, s * buckets // slices, s, k, c) for s, (k, c) in enumerate(rows) if any(k)]
        types = (pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.binary()), pa.list_(pa.binary()))
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], ["block", "bucket", "slice", "keys", "counts"])

    def answer(table: pa.Table) -> pa.Table:
        own = table.column("slice").to_numpy()
        out: list = [None] * len(own)
        for s in np.unique(own).tolist():
            rows = np.flatnonzero(own == s)
            keys, counts = (table.column(c).take(pa.array(rows)).to_pylist() for c in ("keys", "counts"))
            back: list[list] = [[] for _ in rows]
            for k in range(order):
                parts = [unpacked(x[k]) for x in keys]
                _, inv = np.unique(np.concatenate(parts), return_inverse=True)
                tot = np.bincount(inv, weights=np.concatenate([_counts(x[k]) for x in counts])).astype(np.int64)
                at = 0
                for held, p in zip(back, parts, strict=True):
                    held.append(_small(tot[inv[at : at + len(p)]]))
                    at += len(p)
            for r, held in zip(rows.tolist(), back, strict=True):
                out[r] = held
        return pa.table({"block": table.column("block"), "slice": table.column("slice"), "totals": pa.array(out, pa.list_(pa.binary()))})

    def share(table: pa.Table) -> pa.Table:
        """A bucket's share of N, V and the counts of counts."""
        keys, counts = (np.concatenate([f(x[0]) for x in table.column(c).to_pylist()]) for c, f in (("keys", unpacked), ("counts", _counts)))
        _, inv = np.unique(keys, return_inverse=True)
        tot = np.bincount(inv, weights=counts).astype(np.int64)
        return pa.table({c: [int(x)] for c, x in zip(SUMS, (tot.sum(), (tot > 0).sum(), (tot == 1).sum(), (tot == 2).sum()), strict=True)})

    def traverse(docs: pa.Table, back: pa.Table) -> pa.Table:
        buf, offs = column_bytes(docs.column("text"))
        words, first = tokens(buf, offs)
        where, blobs = back.column("slice").to_numpy(), back.column("totals").to_pylist()
        found, totals, ranks, ends = grams(words, first, order), [], [], 0
        for k, g in enumerate(found):
            whole, inv = np.unique(g, return_inverse=True)
            keys = whole >> np.uint64(64 - bits)
            new = np.append(True, keys[1:] != keys[:-1])
            keys = keys[new]
            edge = slice_bounds(keys, slices, bits)
            tot = np.zeros(len(keys), np.int64)
            for s, blob in zip(where.tolist(), blobs, strict=True):
                tot[edge[s] : edge[s + 1]] = _counts(blob[k])
            if k == 0:
                ends = int(tot[np.searchsorted(keys, END >> np.uint64(64 - bits))])
            totals.append(tot[np.cumsum(new) - 1][inv])
            ranks.append((len(whole), inv))
        sums = tuple(back.column(c)[0].as_py() for c in SUMS)
        c, n = totals[0], np.diff(first)
        own = Automaton(found, totals, first, ends, sums, mu, ranks).walk(words, first)
        base = np.add.reduceat(np.log10((c + 1) / (sums[0] + sums[1] + 1)), first[:-1])
        cols = {"doc_id": docs.column("doc_id"), "training": docs.column("training"), "n_tokens": n, "n_known": np.add.reduceat((c > 0).astype(np.int64), first[:-1])}
        return pa.table(cols | {"train_tokens": np.full(len(n), sums[0]), "base_score": base, "score": own})

    asked = dealt.groupBy("block").applyInArrow(ask, "block long, bucket long, slice int, keys array<binary>, counts array<binary>")
    shares = asked.groupBy("bucket").applyInArrow(share, ", ".join(f"{c} long" for c in SUMS))
    sums = F.broadcast(shares.agg(*(F.sum(c).alias(c) for c in SUMS)))  # one row
    back = asked.groupBy("bucket").applyInArrow(answer, "block long, slice int, totals array<binary>").crossJoin(sums)
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, training boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return dealt.groupBy("block").cogroup(back.groupBy("block")).applyInArrow(traverse, schema)


def op1_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = narrow(spark.read.parquet(f"{sf_dir}/documents.parquet"), "doc_id", "text")
    out = score(docs, fold(7) != 2)
    return out.select("doc_id", (~F.col("training")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
