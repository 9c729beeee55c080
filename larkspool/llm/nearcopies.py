"""Near-duplicates by SimHash tables, confirmed by exact Jaccard similarity.

A text is the set of its lower-cased runs of `words` words (a shorter text is one
run). A set's fingerprint has 128 bits, in four parts of 32; each part has the 31
covering masks of radius 4 (simhash.masks), 124 tables in all. Two sets that differ
in at most 19 bits differ in at most 4 bits of some part, so they share a bucket
for sure. Sets with a Jaccard similarity of 0.8, the least that counts, differ in
19.4 bits on average, and the masks catch most pairs beyond the radius, too: 0.99
of those at 0.8 by calculation, more above. Pairs that share a bucket and differ
in at most `CUT` bits are compared whole: a link is an exact similarity of at least
`percent`.

Equal sets are one node. A pair is made in the first table in which its sets meet, so
once. A bucket's close pairs are all tried, unless there are more than `dense` of
them a set. In such a bucket all sets are tried with a few hubs, the same in every
bucket; then those pairs that are still apart are tried in two rounds: a spanning forest
of each bucket's pairs that agree in `LIKELY` of 256 minima (8 bits of each), and all
that are apart after that and agree in `AGREE`. Roots and sketches are joined to
sets, not to their bucket rows; the second round has only rows in such a pair. A pair at a similarity of 0.8 agrees
in 205 on average; one in ten thousand of those has fewer than AGREE and is lost. A
bucket over `part_rows` is dealt by pairs of parts.

Defined cases: texts without a word are one set; null ids count as the largest; rows
are known by id and text together; an empty table gives no rows; all columns stay.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .simhash import components, keep_rows, majority, masks, signed
from .textops import LOWER, RollingHash, chunks, column_bytes, lean, lean_groups, mix, narrow, spread_lookup, stored, word_spans

WORDS = 5
PERCENT = 80
#: Bits of 128 by which candidates differ at most: three deviations over the mean at 0.8.
CUT = 32
#: Buckets of up to so many sets are compared side by side.
SMALL = 48
#: Close pairs a set, on average, from which on a bucket is dense.
DENSE = 4
HUBS = 2
#: Minima in the sketch of a set in a dense bucket, and how many a pair must share.
MINIMA = 256
AGREE = 180
#: A pair that shares so many is tried first.
LIKELY = 204
PART_ROWS = 8_000
#: Names (8 bytes each) that are broadcast at most.
BROADCAST = 500_000
#: Rows of buckets compared in one task, about.
TASK_ROWS = 60_000
#: Text bytes handled at a time: a shingle takes several numbers of eight bytes.
SLICE = 1 << 19
#: Pairs whose sketches are compared at a time.
PAIRS = 1 << 16

#: Each table's half of the fingerprint and mask.
TABLES = [(part // 2, m << 32 * (part % 2)) for part in range(4) for m in masks(4, 3000 + part, 32)]

_MUL = np.uint64(0x9E3779B97F4A7C15)


def shingles(buf: np.ndarray, offs: np.ndarray, words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingle hashes of each document, ascending, and offsets."""
    buf = LOWER[buf]
    starts, ends, first = word_spans(buf, offs)
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(len(offs), np.int64)
    own = RollingHash(buf).span(starts, ends)
    n = np.diff(first)
    count = np.where(n == 0, 0, np.maximum(n - words + 1, 1))
    doc = np.repeat(np.arange(len(n)), count)
    head = np.repeat(first[:-1], count) + (np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count))
    h = np.zeros(len(doc), np.uint64)
    for i in range(words):
        at = head + i
        inside = at < first[doc + 1]
        h[inside] = mix(h[inside] * _MUL + own[at[inside]])
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    new = np.append(True, (h[1:] != h[:-1]) | (doc[1:] != doc[:-1]))
    return h[new], np.searchsorted(doc[new], np.arange(len(offs)))


def _names(h: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """A hash of each set; zero for an empty one."""
    sums = np.append(np.zeros(1, np.uint64), np.cumsum(mix(h), dtype=np.uint64))
    n = np.diff(offs).astype(np.uint64)
    return np.where(n > 0, mix((sums[offs[1:]] - sums[offs[:-1]]) + n * _MUL), np.uint64(0)).view(np.int64)


def _sets(col: pa.Array, words: int):
    """(hashes, offsets) for slices of a text column."""
    buf, offs = column_bytes(col)
    for i, j in chunks(offs, SLICE):
        yield shingles(buf[offs[i] : offs[j]], offs[i : j + 1] - offs[i], words)


def named(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """doc_id, the text's hash t, and the name s and fingerprint f1, f2 of its set,
    for every row."""

    def run(batches):
        for batch in batches:
            out = [[], [], []]
            for h, offs in _sets(batch.column(2), words):
                for c, x in zip(out, (_names(h, offs), majority(h, offs).view(np.int64), majority(mix(h + _MUL), offs).view(np.int64)), strict=True):
                    c.append(x)
            cols = [pa.array(np.concatenate(c) if c else np.zeros(0, np.int64)) for c in out]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *cols], ["doc_id", "t", "s", "f1", "f2"])

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.xxhash64(docs["text"]).alias("t"), docs["text"]).mapInArrow(lean(run, "powers"), "doc_id long, t long, s long, f1 long, f2 long")


def buckets(kinds: DataFrame) -> DataFrame:
    """kinds (s, f1, f2, ...) with k, the bucket, and i, the table, for each table."""
    rows = [F.struct(F.lit(i).alias("i"), F.lit(w).alias("w"), F.lit(signed(m)).alias("m")) for i, (w, m) in enumerate(TABLES)]
    half = F.when(F.col("e.w") == 0, F.col("f1")).otherwise(F.col("f2"))
    return kinds.withColumn("e", F.explode(F.array(*rows))).withColumn("k", F.xxhash64("e.i", half.bitwiseAND(F.col("e.m")))).withColumn("i", F.col("e.i")).drop("e")


def _close(f1, f2, a, b) -> np.ndarray:
    return np.bitwise_count(f1[a] ^ f1[b]).astype(np.int16) + np.bitwise_count(f2[a] ^ f2[b]) <= CUT


def _meet(f1, f2, a, b) -> np.ndarray:
    """The first table in which the rows a and b share a bucket."""
    halves = f1[a] ^ f1[b], f2[a] ^ f2[b]
    out, left = np.full(len(a), len(TABLES)), np.arange(len(a))
    for i, (w, m) in enumerate(TABLES):
        hit = halves[w][left] & np.uint64(m) == 0
        out[left[hit]] = i
        left = left[~hit]
    return out


def minima(h: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """A row of MINIMA bytes for each set: bits of the least of its hashes under as
    many hash functions (zeros for an empty set)."""
    out = np.zeros((len(offs) - 1, MINIMA), np.uint8)
    some = np.flatnonzero(np.diff(offs))
    for k in range(MINIMA if len(some) else 0):
        out[some, k] = mix(np.minimum.reduceat(mix(h + np.uint64((k + 1) * int(_MUL) % (1 << 64))), offs[some])) & np.uint64(255)
    return out


def _shared(z: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """In how many places the sketches of rows a and b agree."""
    out = [(z[a[i : i + PAIRS]] == z[b[i : i + PAIRS]]).sum(axis=1) for i in range(0, len(a), PAIRS)]
    return np.concatenate(out) if out else np.zeros(0, np.int64)


def _bucketed(table: pa.Table):
    """Columns in the order of the buckets, first row and size of each."""
    k, s, f1, f2 = (table.column(c).to_numpy() for c in ("k", "s", "f1", "f2"))
    order = np.lexsort((s, k))
    k, s, f1, f2 = k[order], s[order], f1[order].view(np.uint64), f2[order].view(np.uint64)
    first = np.flatnonzero(np.append(True, k[1:] != k[:-1])) if len(k) else np.zeros(0, np.int64)
    return order, s, f1, f2, first, np.diff(np.append(first, len(k)))


def _edges(pairs: list[tuple[np.ndarray, np.ndarray]], s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    a, b = (np.concatenate([s[p[i]] for p in pairs]) if pairs else np.zeros(0, np.int64) for i in (0, 1))
    return np.minimum(a, b), np.maximum(a, b)


def _first_pairs(dense: int, rows: int):
    """The close pairs of a bucket as (a, b, 0), each in its first table. One that has more than `dense` a set,
    or over `rows` sets, gives its key as (k, size, 1), and in the first table of
    each part the pairs with a few hubs, so a set is in a bounded number of those."""

    def run(table: pa.Table) -> pa.Table:
        order, s, f1, f2, first, size = _bucketed(table)
        keys, tables = (table.column(c).to_numpy()[order] for c in "ki")
        rank, own = np.arange(len(s)) - np.repeat(first, size), np.repeat(size, size)
        out, left = [], []
        live = np.flatnonzero((own > 1) & (own <= SMALL))
        for lag in range(1, SMALL):
            live = live[rank[live] + lag < own[live]]
            if not len(live):
                break
            a = live[_close(f1, f2, live, live + lag)]
            out.append((a, a + lag))
        begin = np.arange(len(s)) - rank
        if out:  # the pairs of small buckets that are dense are given back
            a, b = (np.concatenate([x[i] for x in out]) for i in (0, 1))
            many = np.bincount(begin[a], minlength=len(s)) > dense * own
            out = [(a[~many[begin[a]]], b[~many[begin[a]]])]
            left = np.flatnonzero(many).tolist()
        for at, n in zip(first[size > SMALL].tolist(), size[size > SMALL].tolist(), strict=True):
            pairs = _all_pairs(f1, f2, np.arange(at, at + n), np.arange(n), dense * n) if n <= rows else None
            if pairs is None:
                left.append(at)
            else:
                out += pairs
        if out:
            a, b = (np.concatenate([x[i] for x in out]) for i in (0, 1))
            here = _meet(f1, f2, a, b) == tables[a]
            out = [(a[here], b[here])]
        for at in left:
            n = int(own[at])
            every = np.arange(at, at + n)
            for k in range(0 if tables[at] % 31 else HUBS):
                hub = np.full(n, at + int(mix(s[every].view(np.uint64) + np.uint64(k) * _MUL).argmin()))
                ok = _close(f1, f2, every, hub) & (every != hub)
                out.append((every[ok], hub[ok]))
        a, b = _edges(out, s)
        left = np.array(left, np.int64)
        return pa.table({"a": np.append(a, keys[left]), "b": np.append(b, own[left]), "left": np.append(np.zeros(len(a), np.int32), np.ones(len(left), np.int32))})

    return run


def _all_pairs(f1, f2, rows, root, most=None):
    """Close pairs of rows whose roots differ (rows in the order of root), or None
    if they are more than `most`."""
    out, held = [], 0
    after = np.searchsorted(root, root, "right")
    for i in range(0, len(rows), 64):  # some rows against all those of later roots
        top, rest = rows[i : i + 64], rows[int(after[i]) :]
        if not len(rest):
            break
        near = np.bitwise_count(f1[top][:, None] ^ f1[rest]).astype(np.int16) + np.bitwise_count(f2[top][:, None] ^ f2[rest]) <= CUT
        x, y = np.nonzero(near)
        ok = root[i + x] < root[int(after[i]) + y]
        out.append((top[x][ok], rest[y][ok]))
        held += int(ok.sum())
        if most is not None and held > most:
            return None
    return out


def _forest(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """Places of pairs (a, b) of 0..n-1 that span the components of all the pairs."""
    label, live, kept = np.arange(n), np.arange(len(a)), [np.zeros(0, np.int64)]
    while True:
        x, y = label[a[live]], label[b[live]]
        live, x, y = (c[x != y] for c in (live, x, y))
        if not len(live):
            return np.concatenate(kept)
        high, at = np.unique(np.maximum(x, y), return_index=True)  # a label goes to a lower one
        kept.append(live[at])
        label[high] = np.minimum(x, y)[at]
        while (label != label[label]).any():
            label = label[label]


def _apart(table: pa.Table):
    """Names, keys and tables of the rows; and for each bucket its first row and
    size, its roots as numbers, and the close pairs whose roots differ and whose
    sketches agree in AGREE places, each in its first table: rows a, b, places."""
    order, s, f1, f2, first, size = _bucketed(table)
    keys, root, tables = (table.column(c).to_numpy()[order] for c in ("k", "root", "i"))
    z = np.frombuffer(b"".join(table.column("z").to_pylist()), np.uint8).reshape(-1, MINIMA)[order]

    def found():
        for at, n in zip(first.tolist(), size.tolist(), strict=True):
            own = root[at : at + n]
            rows = at + np.argsort(own, kind="stable")
            out = [(np.zeros(0, np.int64),) * 3]
            for a, b in _all_pairs(f1, f2, rows, root[rows]):
                here = np.flatnonzero(_meet(f1, f2, a, b) == tables[a])
                same = _shared(z, a[here], b[here])
                here, same = here[same >= AGREE], same[same >= AGREE]
                out.append((a[here], b[here], same))
            yield at, n, np.unique(own, return_inverse=True)[1], *(np.concatenate(c) for c in zip(*out, strict=True))

    return s, keys, tables, found()


def _likely_pairs(table: pa.Table) -> pa.Table:
    """A spanning forest of each bucket's pairs that agree in LIKELY places, as (a, b,
    -1); and the rows in any pair that agrees in AGREE, as (set, key, table)."""
    s, keys, tables, buckets_ = _apart(table)
    out, busy = [], np.zeros(len(s), bool)
    for at, n, label, a, b, same in buckets_:
        busy[a] = busy[b] = True
        likely = np.flatnonzero(same >= LIKELY)
        a, b = a[likely], b[likely]
        some = _forest(label[a - at], label[b - at], n)  # sets of one root are joined already
        out.append((a[some], b[some]))
    a, b = _edges(out, s)
    return pa.table({"a": np.append(a, s[busy]), "b": np.append(b, keys[busy]), "i": np.append(np.full(len(a), -1), tables[busy]).astype(np.int32)})


def _agreeing_pairs(table: pa.Table) -> pa.Table:
    """All pairs that are apart and agree in AGREE places."""
    s, _, _, buckets_ = _apart(table)
    a, b = _edges([(a, b) for _, _, _, a, b, _ in buckets_], s)
    return pa.table({"a": a, "b": b})


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets are similar."""
    left = sets.select(F.col("s").alias("a"), F.col("h").alias("x"))
    right = sets.select(F.col("s").alias("b"), F.col("h").alias("y"))
    both = F.size(F.array_intersect("x", "y"))
    return pairs.join(left, "a").join(right, "b").where(100 * both >= percent * (F.size("x") + F.size("y") - both)).select("a", "b")


def _few(names: DataFrame) -> DataFrame:
    """names (one long), broadcast if they are few enough (BROADCAST rows), else not."""
    return F.broadcast(names) if names.limit(BROADCAST + 1).count() <= BROADCAST else names


def links(docs: DataFrame, kinds: DataFrame, words: int = WORDS, percent: int = PERCENT, dense: int = DENSE, part_rows: int = PART_ROWS) -> DataFrame:
    """Edges (a, b) of set names that span the similar pairs. kinds: s, f1, f2."""

    def run(batches):
        for batch in batches:
            for h, offs in _sets(batch.column(0), words):
                yield pa.RecordBatch.from_arrays([pa.array(_names(h, offs)), pa.ListArray.from_arrays(pa.array(offs.astype(np.int32)), pa.array(h.view(np.int64)))], ["s", "h"])

    def sketched(batches):
        for batch in batches:
            h = batch.column(1)
            offs = h.offsets.to_numpy() - h.offsets[0].as_py()
            z = minima(h.flatten().to_numpy().view(np.uint64), offs)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([r.tobytes() for r in z], pa.binary())], ["s", "z"])

    def sets_of(names: DataFrame) -> DataFrame:
        wanted = _few(stored(names.distinct()))
        return stored(narrow(docs, "text").mapInArrow(lean(run, "powers"), "s long, h array<long>").join(wanted, "s", "left_semi").groupBy("s").agg(F.first("h").alias("h")))

    def rooted(rows: DataFrame, edges: DataFrame) -> DataFrame:
        roots = components(edges).select(F.col("node").alias("s"), "root")
        return rows.join(roots, "s", "left").withColumn("root", F.coalesce("root", "s"))

    total = kinds.count() * 4 * 31
    group = F.pmod("k", F.lit(max(1, -(-total // TASK_ROWS))))
    first = buckets(kinds).select("k", "s", "f1", "f2", "i", group.alias("g")).groupBy("g").applyInArrow(lean_groups(_first_pairs(dense, part_rows)), "a long, b long, left int")
    first = stored(first.distinct())
    pairs = first.where("left = 0").select("a", "b")
    found = stored(confirmed(pairs, sets_of(pairs.select(F.explode(F.array("a", "b")).alias("s"))), percent))
    large = first.where("left = 1").select(F.col("a").alias("k"))
    if large.limit(1).count() == 0:
        return found
    every = stored(buckets(rooted(kinds, found)).join(_few(large), "k", "left_semi").select("k", "s", "f1", "f2", "root", "i"))
    # a bucket that is one component by now has no more links to find
    mixed = every.groupBy("k").agg(F.count("*").alias("n"), F.min("root").alias("lo"), F.max("root").alias("hi")).where(F.col("lo") < F.col("hi"))
    parts = F.ceil(F.col("n") * 2 / part_rows).cast("int")
    mixed = stored(mixed.select("k", F.when(F.col("n") > part_rows, parts).otherwise(1).alias("parts"), "n"))
    asked = mixed.agg(F.sum(F.col("n") * F.col("parts"))).first()[0]
    if not asked:
        return found
    rows = spread_lookup(every, mixed.drop("n"), ["k"], F.col("s")).withColumn("part", F.pmod(F.xxhash64("s"), F.col("parts")).cast("int"))
    # a row for each set, with its buckets (one a table at most)
    own = stored(rows.groupBy("s").agg(*(F.first(c).alias(c) for c in ("f1", "f2", "root")), F.collect_list(F.struct("k", "i", "part", "parts")).alias("e")))
    sets = sets_of(own.select("s"))
    own = stored(own.join(sets.mapInArrow(lean(sketched), "s long, z binary"), "s"))
    others = F.flatten(F.transform("e", lambda e: F.transform(F.sequence(F.lit(0), e["parts"] - 1), lambda o: F.struct(F.xxhash64(e["k"], F.least(e["part"], o), F.greatest(e["part"], o)).alias("k"), e["i"].alias("i")))))
    rows = own.select("s", "f1", "f2", "z", "root", F.explode(others).alias("e")).select("s", "f1", "f2", "z", "root", "e.k", "e.i")
    task = F.pmod("k", F.lit(max(1, -(-asked // TASK_ROWS))))
    likely = stored(rows.withColumn("g", task).groupBy("g").applyInArrow(lean_groups(_likely_pairs), "a long, b long, i int"))
    pairs = stored(likely.where("i < 0").select("a", "b").distinct())
    found = stored(found.unionByName(confirmed(pairs, sets, percent)))
    # only rows that are in a pair of the kind have more to find, in the same buckets
    busy = likely.where("i >= 0").select(F.col("a").alias("s"), F.col("b").alias("k"), "i")
    if busy.limit(1).count() == 0:
        return found
    rows = busy.join(rooted(own.drop("e", "root"), found), "s")
    more = rows.withColumn("g", task).groupBy("g").applyInArrow(lean_groups(_agreeing_pairs), "a long, b long")
    return stored(found.unionByName(confirmed(stored(more.distinct()), sets, percent)))


def one_of_each(docs: DataFrame, words: int = WORDS, percent: int = PERCENT, **options) -> DataFrame:
    """docs with one row of each component of similar texts: the one of the least
    doc_id (rows without an id count as the largest)."""
    rows = stored(named(docs, words))
    kinds = stored(rows.groupBy("s").agg(F.first("f1").alias("f1"), F.first("f2").alias("f2"), F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "t")).alias("m")))
    roots = components(links(docs, kinds.select("s", "f1", "f2"), words, percent, **options))
    kinds = kinds.join(roots.select(F.col("node").alias("s"), "root"), "s", "left")
    first = kinds.groupBy(F.coalesce("root", "s").alias("root")).agg(F.min("m").alias("m"))
    return keep_rows(docs, first.select("m.doc_id", "m.t"), rows)
