"""SimHash near-duplicates by covering locality-sensitive hashing.

A fingerprint's bit is 1 where over half of the text's shingle hashes have it.
For a radius r each bit position gets a random vector of r+1 bits; for each of
the 2**(r+1) - 1 nonzero vectors v, the mask of v holds the positions whose
vector has an odd product with v. Any r positions' vectors have a common nonzero
annihilator, so a pair within r bits agrees on some mask: no such pair is lost.

Fingerprints are made distinct first. Each table's bucket is then one masked
value. A bucket larger than `bucket_rows` is split again by a second family of
masks over the same bits (a pair within r agrees on one of those, too). A bucket
that is still larger is dense: it is cut by a hash into parts, and each pair of
parts is compared in a task of its own, so no bucket is held by one task and no
pair is left out. In a bucket the links' spanning forest is kept (star edges), never all
pairs; components follow from label propagation with pointer jumping.

Defined cases: a text without words (null, empty, white space) has fingerprint
zero and links like any other; equal texts have equal fingerprints; repeated
rows and ids stay rows of their own; an empty table gives no rows; components
are named by the smallest doc_id in them (null only if all ids are null); other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .textops import LOWER, chunks, column_bytes, narrow, spread_lookup, stored, word_spans

WORDS = 4
RADIUS = 4
BUCKET_ROWS = 20_000
#: Shingles hashed at a time.
SHINGLES = 1 << 17
SEED = 42


def simhashes(buf: np.ndarray, offs: np.ndarray, words: int = WORDS) -> np.ndarray:
    """The fingerprint of each document of the buffer."""
    buf = LOWER[buf]
    starts, ends, first = word_spans(buf, offs)
    out = np.zeros(len(offs) - 1, np.uint64)
    if not len(starts):
        return out
    # the words joined by single spaces
    lens = ends - starts
    to = np.concatenate([[0], np.cumsum(lens + 1)])
    flat = np.full(to[-1], 0x20, np.uint8)
    flat[np.repeat(to[:-1], lens) + (np.arange(lens.sum()) - np.repeat(np.cumsum(lens) - lens, lens))] = buf[np.repeat(starts, lens) + (np.arange(lens.sum()) - np.repeat(np.cumsum(lens) - lens, lens))]
    data = flat.tobytes()
    n = np.diff(first)
    upto = np.concatenate([[0], np.cumsum(np.where(n == 0, 0, np.maximum(n - words + 1, 1)))])
    digest = xxhash.xxh64_intdigest

    def hashes(at: np.ndarray) -> np.ndarray:
        doc = np.searchsorted(upto, at, "right") - 1
        head = first[doc] + at - upto[doc]
        tail = np.minimum(head + words, first[doc + 1])
        return np.array([digest(data[s:e], SEED) for s, e in zip(to[head].tolist(), (to[tail] - 1).tolist(), strict=True)], np.uint64)

    return majority(hashes, upto)


def majority(hashes: np.ndarray | Callable[[np.ndarray], np.ndarray], upto: np.ndarray) -> np.ndarray:
    """For each document the bits set in over half of its hashes: those at
    upto[d]:upto[d+1], given whole or by place. A text may have any number of them,
    so they are taken a stretch at a time."""
    count = np.diff(upto)
    ones = np.zeros((len(count), 64), np.int64)
    for low in range(0, int(upto[-1]), SHINGLES):
        at = np.arange(low, min(low + SHINGLES, int(upto[-1])))
        doc = np.searchsorted(upto, at, "right") - 1
        h = hashes(at) if callable(hashes) else hashes[at]
        bits = np.unpackbits(h.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        new = np.flatnonzero(np.append(True, doc[1:] != doc[:-1]))
        ones[doc[new]] += np.add.reduceat(bits, new, axis=0, dtype=np.int64)
    return np.packbits(2 * ones > count[:, None], axis=1).view(">u8").ravel().astype(np.uint64)


def masks(radius: int, seed: int, bits: int = 64) -> list[int]:
    """The covering masks of a radius."""
    vectors = np.random.default_rng(seed).integers(0, 1 << (radius + 1), bits)
    return [sum(1 << i for i in range(bits) if bin(int(vectors[i]) & v).count("1") & 1) for v in range(1, 1 << (radius + 1))]


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprint_rows(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """doc_id and fp (the 64 bits as a signed long) of every row."""

    def run(batches):
        for batch in batches:
            buf, offs = column_bytes(batch.column(1))
            fps = [simhashes(buf[offs[i] : offs[j]], offs[i : j + 1] - offs[i], words) for i, j in chunks(offs)]
            fp = np.concatenate(fps) if fps else np.zeros(0, np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(fp.view(np.int64))], ["doc_id", "fp"])

    return narrow(docs, "doc_id", "text").mapInArrow(run, "doc_id long, fp long")


def _forest(fps: np.ndarray, radius: int) -> tuple[list, list]:
    """Star edges (node, root) of the components that links within the radius
    make: breadth first, each reached node against those not reached yet."""
    rest, nodes, roots = np.sort(fps), [], []
    while len(rest) > 1:
        root, queue, rest = rest[0], [rest[0]], rest[1:]
        while queue and len(rest):
            near = np.bitwise_count(rest ^ queue.pop()) <= radius
            if near.any():
                found, rest = rest[near].tolist(), rest[~near]
                queue += [np.uint64(x) for x in found]
                nodes += found
                roots += [root] * len(found)
    return nodes, roots


def links(fps: DataFrame, radius: int = RADIUS, bucket_rows: int = BUCKET_ROWS, depth: int = 0, key: tuple[str, ...] = ()) -> DataFrame:
    """Edges (a, b) of fingerprints that span the links within the radius.

    fps: distinct fp at depth 0; below, with the column that names a bucket."""
    name = f"k{depth}"
    tables = F.explode(F.array(*(F.struct(F.lit(i).alias("t"), F.col("fp").bitwiseAND(F.lit(signed(m))).alias("m")) for i, m in enumerate(masks(radius, 1000 + depth)))))
    dealt = fps.select("fp", *key, tables.alias("e")).select("fp", F.xxhash64(*key, "e.t", "e.m").alias(name))
    counted = stored(dealt.groupBy(name).agg(F.count("*").alias("n")).where("n > 1"))
    total, most = counted.where(F.col("n") <= bucket_rows).agg(F.sum("n")).first()[0] or 0, counted.agg(F.max("n")).first()[0] or 0
    rows = dealt.join(counted, name)

    def run(table: pa.Table) -> pa.Table:
        bucket, fp = table.column(0).to_numpy(), table.column(1).to_numpy().view(np.uint64)
        order = np.lexsort((fp, bucket))
        bucket, fp = bucket[order], fp[order]
        first = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1]))
        size = np.diff(np.append(first, len(bucket)))
        two = first[size == 2]  # most buckets
        two = two[np.bitwise_count(fp[two] ^ fp[two + 1]) <= radius]
        a, b = [fp[two + 1]], [fp[two]]
        for s, n in zip(first[size > 2].tolist(), size[size > 2].tolist(), strict=True):
            nodes, roots = _forest(np.unique(fp[s : s + n]), radius)
            a.append(np.array(nodes, np.uint64))
            b.append(np.array(roots, np.uint64))
        return pa.table({"a": np.concatenate(a).view(np.int64), "b": np.concatenate(b).view(np.int64)})

    if depth and most > bucket_rows:
        parts = F.when(F.col("n") > bucket_rows, F.ceil(F.col("n") * 2 / bucket_rows)).otherwise(1).cast("int")
        total, most = counted.agg(F.sum(F.col("n") * parts)).first()[0], 0
        rows = rows.withColumn("parts", parts).withColumn("part", F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int"))
        rows = rows.select("fp", name, "part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other"))
        pair = F.xxhash64(name, F.least("part", "other"), F.greatest("part", "other"))
        rows = rows.select("fp", pair.alias(name), F.lit(1).alias("n"))
    group = F.pmod(F.col(name), F.lit(max(1, -(-total // 20000))))
    out = rows.where(F.col("n") <= bucket_rows).select(name, "fp", group.alias("g")).groupBy("g").applyInArrow(lambda t: run(t.select([name, "fp"])), "a long, b long")
    if most > bucket_rows:
        big = rows.where(F.col("n") > bucket_rows).select("fp", name)
        out = out.unionByName(links(big, radius, bucket_rows, depth + 1, (name,)))
    return out


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node that has an edge (a, b), root the least of its
    component (also the root itself): alternating large and small stars."""
    edges = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    edges, before = stored(edges), None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges = stored(small.unionByName(low.select("a", F.col("m").alias("b"))).where("a <> b").distinct())
        now = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first())
        if now == before:
            break
        before = now
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def near_duplicates(docs: DataFrame, words: int = WORDS, radius: int = RADIUS, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """doc_id, fingerprint, component_id of every row."""
    rows = stored(fingerprint_rows(docs, words))
    kinds = rows.groupBy("fp").agg(F.min("doc_id").alias("least"))
    roots = components(links(kinds.select("fp"), radius, bucket_rows))
    kinds = kinds.join(roots.select(F.col("node").alias("fp"), "root"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = kinds.groupBy("root").agg(F.min("least").alias("component_id"))
    # a component may have any share of the fingerprints, a fingerprint any share of the rows
    named = stored(spread_lookup(kinds.select("fp", "root"), least, ["root"], F.col("fp")).select("fp", "component_id"))
    out = spread_lookup(rows, named, ["fp"], F.col("doc_id"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_rows(docs: DataFrame, keep: DataFrame, rows: DataFrame) -> DataFrame:
    """The rows of docs whose id and text are in keep (doc_id, t: the text's
    xxhash64), one of each. A row is known by its id and text together, so other
    texts under the same id, or under no id, are other rows. rows: doc_id and t of
    all of docs."""
    keep = keep.select(F.col("doc_id").alias("_keep"), F.col("t").alias("_t"))
    kept = docs.join(keep, docs["doc_id"].eqNullSafe(F.col("_keep")) & (F.xxhash64(docs["text"]) == F.col("_t")), "left_semi")
    repeated = rows.groupBy("doc_id", "t").count().where("count > 1").limit(1).count()
    return kept.dropDuplicates(["doc_id", "text"]) if repeated else kept


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
