"""Packing documents into token sequences of a fixed capacity.

pieces() gives each document's token pieces. best_fit_packing() (exact-complement
hashing) places all pieces of the table: the lengths' histogram has at most
`capacity` rows whatever the table's size, so the plan is made from it on the
driver, and each piece finds its place from its rank within its length.
packed_sequences() (best-fit-decreasing, segment tree) packs blocks of documents and
returns the id matrices' rows; write_matrices() writes them as whole matrices.

Defined cases: a null or empty text is the end id alone; repeated rows are packed
one by one; a null id stays null; an empty table gives no rows; other columns of
the input are ignored.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .textops import blocks_for, chunks, column_bytes, lean, narrow, stored, text_bytes
from .tokens import default_path, ids_for

CAPACITY = 1024
END_ID = 2
#: Text bytes that are packed into matrices together.
BLOCK_BYTES = 8 << 20

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def cut(total: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces; only the first may be short."""
    k = -(-total // capacity)
    head = total - (k - 1) * capacity
    return [(0, head)] + [(head + i * capacity, capacity) for i in range(k - 1)]


def _documents(batch: pa.RecordBatch, path: str, end_id: int) -> Iterator[tuple[int | None, np.ndarray]]:
    ids = batch.column(0).to_pylist()
    buf, offs = column_bytes(batch.column(1))
    coder = ids_for(path)
    for i, j in chunks(offs):
        flat, bounds = coder.encode(buf[offs[i] : offs[j]], offs[i : j + 1] - offs[i])
        for d in range(i, j):
            yield ids[d], np.append(flat[bounds[d - i] : bounds[d - i + 1]], np.uint32(end_id)).astype("<u4")


def pieces(docs: DataFrame, capacity: int = CAPACITY, path: str | None = None, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32 (and ids, as
    little-endian unsigned 32-bit)."""
    path = path or default_path()

    def run(batches):
        for batch in batches:
            out: list[tuple] = []
            for doc, ids in _documents(batch, path, end_id):
                data = ids.tobytes()
                for p, (s, n) in enumerate(cut(len(ids), capacity)):
                    part = data[4 * s : 4 * (s + n)]
                    out.append((doc, p, s, n, zlib.crc32(part), part))
            cols = list(zip(*out, strict=True)) if out else [[]] * 6
            arrays = [pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True)]
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"]
            n = 6 if with_ids else 5
            yield pa.RecordBatch.from_arrays(arrays[:n], names[:n])

    return narrow(docs, "doc_id", "text").mapInArrow(lean(run, "powers", "ids"), PIECES + (", ids binary" if with_ids else ""))


class Histogram:
    """Lengths with their availability; take() consumes whole combinations."""

    def __init__(self, counts: dict[int, int], capacity: int):
        self.capacity = capacity
        self.left = np.zeros(capacity + 1, np.int64)
        for length, n in counts.items():
            self.left[length] += n
        self.plan: list[tuple[tuple[int, ...], int]] = []
        self.used = 0

    def take(self, combo: tuple[int, ...]) -> int:
        """Consume the combination as often as its members are there."""
        need: dict[int, int] = defaultdict(int)
        for x in combo:
            need[x] += 1
        times = min(int(self.left[x]) // k for x, k in need.items())
        if times:
            for x, k in need.items():
                self.left[x] -= times * k
            self.plan.append((combo, times))
            self.used += times
        return times

    def fill(self, a: int, fills: Callable[[int], np.ndarray]) -> None:
        """Consume what fills the gap beside length a, which is the longest."""
        if not self.left[a]:
            return
        for members in fills(self.capacity - a).tolist():
            if members[0] <= a and all(self.left[x] for x in members):
                self.take((a, *members))
                if not self.left[a]:
                    return


#: Lengths whose exact fills are consumed, and judged, together.
STRIDE = 16


class SumIndex:
    """Sums of one, two and three available lengths, and the members they have.

    Pairs lie in one array sorted by their sum, with the place of each sum. A
    triple's sum is found as that of its shortest member and of a pair. Members
    that are used up are left out when a sum is looked up."""

    def __init__(self, left: np.ndarray, capacity: int):
        self.left = left
        have = np.flatnonzero(left[:capacity])
        x, y = (m.ravel() for m in np.meshgrid(have, have, indexing="ij"))
        ok = (x >= y) & (x + y < capacity)
        x, y = x[ok], y[ok]
        order = np.lexsort((x, x + y))  # within a sum the most even pair comes first
        self.longer, sums = x[order], (x + y)[order]
        self.at = np.searchsorted(sums, np.arange(capacity + 2))

    def single(self, total: int) -> np.ndarray:
        return np.array([[total]] if self.left[total] else np.zeros((0, 1)), np.int64)

    def pairs(self, total: int) -> np.ndarray:
        x = self.longer[self.at[total] : self.at[total + 1]]
        x = x[(self.left[x] > 0) & (self.left[total - x] > 0)]
        return np.stack([x, total - x], axis=1)

    def triples(self, total: int) -> np.ndarray:
        """The most even first: by the shortest member, longest first."""
        out = []
        for z in np.flatnonzero(self.left[: total // 3 + 1])[::-1].tolist():
            two = self.pairs(total - z)
            two = two[two[:, 1] >= z]
            out.append(np.append(two, np.full((len(two), 1), z), axis=1))
        return np.concatenate(out) if out else np.zeros((0, 3), np.int64)


def exact_complement_plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    """(lengths of a sequence, how many such sequences) that use up all counts.

    The gap beside each length is looked up in an index of the sums of one, two
    and three lengths, and combinations that fill it exactly are consumed as often
    as the availability counts allow, longest length first, the most even
    combination first, so that short lengths last. A single complement is always
    right. Pairs and triples can use up lengths that the rest would need to fill
    its gaps: those of STRIDE neighbouring lengths are consumed and then given
    back if best fit of what is left would make the whole larger. The residuals
    go to best fit: longest first into the fullest sequence that holds it.
    """
    h = Histogram(counts, capacity)
    h.take((capacity,))
    index = SumIndex(h.left, capacity)
    for a in range(capacity - 1, (capacity - 1) // 2, -1):
        for (x,) in index.single(capacity - a).tolist():
            h.take((a, x))
    least = h.used + _sequences(h.left, capacity)
    for fills in (index.pairs, index.triples):
        for top in range(capacity - 1, 0, -STRIDE):
            kept, done, used = h.left.copy(), len(h.plan), h.used
            for a in range(top, max(top - STRIDE, 0), -1):
                h.fill(a, fills)
            if h.used == used:
                continue
            now = h.used + _sequences(h.left, capacity)
            if now <= least:
                least = now
            else:
                h.left[:], h.used = kept, used
                del h.plan[done:]
    return h.plan + _best_fit(h.left, capacity)


def _sequences(left: np.ndarray, capacity: int) -> int:
    return sum(n for _, n in _best_fit(left, capacity))


def _best_fit(left: np.ndarray, capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Best fit, longest first; sequences with like contents are held as one."""
    open_: dict[int, dict[tuple[int, ...], int]] = defaultdict(dict)  # by room left: contents and how many
    for a in range(capacity, 0, -1):
        n = int(left[a])
        while n:
            room = next((r for r in range(a, capacity) if open_.get(r)), capacity)
            if room == capacity:  # open as many as are needed for what is left of this length
                per = capacity // a
                for size, k in ((per, n // per), (n % per, 1)):
                    if size and k:
                        held = (a,) * size
                        open_[capacity - a * size][held] = open_[capacity - a * size].get(held, 0) + k
                break
            held, k = open_[room].popitem()
            use = min(k, n)
            if k > use:
                open_[room][held] = k - use
            more = (*held, a)
            open_[room - a][more] = open_[room - a].get(more, 0) + use
            n -= use
    return [(held, k) for sets in open_.values() for held, k in sets.items()]


def place_table(plan: list[tuple[tuple[int, ...], int]]) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """By length: from which rank on, the first sequence, the offset there."""
    used: dict[int, int] = defaultdict(int)
    rows: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
    base = 0
    for combo, times in plan:
        offset = 0
        for length in combo:
            rows[length].append((used[length], base, offset))
            used[length] += times
            offset += length
        base += times
    return {k: tuple(np.array(c, np.int64) for c in zip(*v, strict=True)) for k, v in rows.items()}


def ranked(parts: DataFrame, rows_per_group: int = 5000) -> DataFrame:
    """parts plus rank: 0, 1, ... within each length. A length may hold most of
    the rows, so it is split by a hash; the splits' counts give their offsets."""
    groups = max(1, -(-parts.count() // rows_per_group))
    salted = parts.withColumn("_salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(groups)))
    counts = salted.groupBy("length", "_salt").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy("length").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1))
    offsets = counts.select("length", "_salt", F.coalesce(before, F.lit(0)).alias("_before"))
    within = F.row_number().over(Window.partitionBy("length", "_salt").orderBy("doc_id", "piece", "ids_crc32"))
    return salted.withColumn("_within", within).join(offsets, ["length", "_salt"]).withColumn("rank", F.col("_before") + F.col("_within") - 1).drop("_salt", "_before", "_within")


def best_fit_packing(docs: DataFrame, capacity: int = CAPACITY, path: str | None = None, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """pieces() plus sequence_id and offset, in nearly as few sequences as can be."""
    parts = stored(pieces(docs, capacity, path, end_id, with_ids))
    counts = {r[0]: r[1] for r in parts.groupBy("length").count().collect()}  # at most `capacity` rows
    table = place_table(exact_complement_plan(counts, capacity))

    def run(batches):
        for batch in batches:
            lengths, ranks = (batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in ("length", "rank"))
            seq, off = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
            for length in np.unique(lengths).tolist():
                own = lengths == length
                first, base, offset = table[length]
                k = np.searchsorted(first, ranks[own], "right") - 1
                seq[own], off[own] = base[k] + ranks[own] - first[k], offset[k]
            arrays = [batch.column(i) for i in range(batch.num_columns) if batch.schema.names[i] != "rank"]
            names = [x for x in batch.schema.names if x != "rank"]
            yield pa.RecordBatch.from_arrays([*arrays, pa.array(seq), pa.array(off)], [*names, "sequence_id", "offset"])

    cols = ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids
    schema = PIECES + (", ids binary" if with_ids else "") + ", sequence_id long, offset long"
    return ranked(parts).select(*cols, "rank").mapInArrow(run, schema)


class CapacityTree:
    """A segment tree over the room left in open sequences: finds the least room
    of at least n in a walk from leaf to leaf."""

    def __init__(self, capacity: int):
        self.size = 1 << capacity.bit_length()
        self.any = [0] * (2 * self.size)
        self.bins: list[list[int]] = [[] for _ in range(capacity + 1)]

    def push(self, room: int, seq: int) -> None:
        self.bins[room].append(seq)
        self._add(room, 1)

    def pop(self, room: int) -> int:
        self._add(room, -1)
        return self.bins[room].pop()

    def _add(self, room: int, n: int) -> None:
        i = room + self.size
        while i:
            self.any[i] += n
            i >>= 1

    def least(self, n: int) -> int | None:
        i = n + self.size
        while not self.any[i]:
            while i & 1:  # a right child: climb
                i >>= 1
            if not i:
                return None
            i += 1
            if i & (i - 1) == 0:  # beyond the last leaf of this level
                return None
        while i < self.size:
            i *= 2
            if not self.any[i]:
                i += 1
        return i - self.size


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> list[list[int]]:
    """The indexes of the lengths in each sequence."""
    tree, out = CapacityTree(capacity), []
    for i in np.argsort(-lengths, kind="stable").tolist():
        n = int(lengths[i])
        room = tree.least(n)
        if room is None:
            out.append([i])
            seq, room = len(out) - 1, capacity
        else:
            seq = tree.pop(room)
            out[seq].append(i)
        tree.push(room - n, seq)
    return out


SEQUENCES = "sequence_id long, n_tokens int, doc_ids array<long>, pieces array<int>, cu_seqlens array<int>, input_ids binary, position_ids binary"


def packed_sequences(docs: DataFrame, capacity: int = CAPACITY, path: str | None = None, end_id: int = END_ID, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Packed rows: ids padded to capacity with end_id (little-endian unsigned
    32-bit), the cumulative segment lengths, and positions that start anew with
    each segment. Documents are dealt by a hash into blocks of about block_bytes of
    text, and each block is packed on its own, in the order of ids and texts, so
    rows and sequence ids depend on the documents alone. A block's last sequences
    may have room left."""
    path = path or default_path()
    blocks = blocks_for(text_bytes(docs), block_bytes)
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"], F.xxhash64(docs["doc_id"], docs["text"]).alias("h"))

    def run(table: pa.Table) -> pa.Table:
        block = table.column("block")[0].as_py()
        table = table.sort_by([("h", "ascending"), ("doc_id", "ascending")]).select(["doc_id", "text"])
        parts = [(doc, p, ids[s : s + n]) for batch in table.combine_chunks().to_batches() for doc, ids in _documents(batch, path, end_id) for p, (s, n) in enumerate(cut(len(ids), capacity))]
        docs_, nums, ids = zip(*parts, strict=True)
        lengths = np.array([len(x) for x in ids])
        rows = []
        for k, members in enumerate(best_fit_decreasing(lengths, capacity)):
            cu = np.concatenate([[0], np.cumsum(lengths[members])]).astype(np.int32)
            row, pos = np.full(capacity, end_id, "<u4"), np.zeros(capacity, "<u4")
            for s, i in zip(cu, members, strict=False):
                row[s : s + lengths[i]], pos[s : s + lengths[i]] = ids[i], np.arange(lengths[i])
            rows.append(((block << 32) + k, int(cu[-1]), [docs_[i] for i in members], [nums[i] for i in members], cu.tolist(), row.tobytes(), pos.tobytes()))
        types = (pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.binary(), pa.binary())
        names = [x.split()[0] for x in SEQUENCES.split(", ")]
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

    return rows.withColumn("block", F.pmod("h", F.lit(blocks))).groupBy("block").applyInArrow(run, SEQUENCES)


MATRICES = "block long, n_sequences int, capacity int, input_ids binary, position_ids binary, cu_seqlens binary, rows binary"


def write_matrices(docs: DataFrame, out: str, capacity: int = CAPACITY, rows: int = 4096, **options) -> None:
    """Binary matrices in the folder out, up to `rows` sequences each: input_ids and
    position_ids (n_sequences x capacity, little-endian unsigned 32-bit, row by
    row), cu_seqlens (all rows' cumulative segment lengths, little-endian int32,
    end to end) and rows (where each row's begin in it, int64)."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("sequence_id")
        cu = table.column("cu_seqlens").to_pylist()
        first = np.cumsum([0] + [len(x) for x in cu]).astype("<i8")
        ids, pos = (b"".join(table.column(c).to_pylist()) for c in ("input_ids", "position_ids"))
        one = (table.column("block")[0].as_py(), len(cu), capacity, ids, pos, np.concatenate(cu).astype("<i4").tobytes(), first.tobytes())
        types = (pa.int64(), pa.int32(), pa.int32(), *[pa.binary()] * 4)
        return pa.Table.from_arrays([pa.array([x], t) for x, t in zip(one, types, strict=True)], [x.split()[0] for x in MATRICES.split(", ")])

    made = packed_sequences(docs, capacity, **options).withColumn("block", F.floor(F.col("sequence_id") / rows))
    made.groupBy("block").applyInArrow(run, MATRICES).write.option("compression", "zstd").parquet(out)


def write_sequences(docs: DataFrame, out: str, **options) -> None:
    """The packed rows with both matrices as Parquet in the folder out."""
    packed_sequences(docs, **options).write.option("compression", "zstd").parquet(out)


def op3_token_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = packed_sequences(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.withColumns({"ids_crc32": F.crc32("input_ids"), "positions_crc32": F.crc32("position_ids")})


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_fit_packing(spark.read.parquet(f"{sf_dir}/documents.parquet"))
