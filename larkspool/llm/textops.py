"""Vectorised byte-level text helpers shared by the training-data operators.

Everything works on one contiguous UTF-8 buffer plus document offsets (the
layout of an Arrow string column), so no per-word Python objects are made.
"""

from __future__ import annotations

import atexit
import ctypes
import inspect
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Text bytes handled at a time inside a Python worker.
CHUNK_BYTES = 2 << 20

WHITE = np.zeros(256, bool)
WHITE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_MUL = np.uint64(0x9E3779B97F4A7C15)
_BASE = 0xD1342543DE82EF95
_INV = pow(_BASE, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift and multiply), elementwise."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: What a worker keeps from task to task, by name: dicts and lists.
CACHES: dict[str, dict | list] = {}


def give_back() -> None:
    """Return the memory that this process has freed to the system, where the C
    library can: else it stays with the worker for as long as that is reused."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def drop_caches(keeps: tuple[str, ...]) -> None:
    for name, held in CACHES.items():
        if name not in keeps:
            held.clear()


def lean(run, *keeps: str):
    """run, a function from batches to batches, for a reused worker: what other
    operators keep there (CACHES without `keeps`) is dropped before the first batch,
    and freed memory is given back after the last."""

    def lean_run(batches):
        drop_caches(keeps)
        yield from run(batches)
        give_back()

    return lean_run


def lean_groups(run):
    """run, a function from the tables of a group to one, that gives freed memory back."""

    def lean_run(*tables: pa.Table) -> pa.Table:
        out = run(*tables)
        give_back()
        return out

    if len(inspect.signature(run).parameters) == 1:  # Spark tells by the signature whether a key is wanted
        return lambda table: lean_run(table)
    return lambda left, right: lean_run(left, right)


#: A fixed pseudo-random 64-bit value per byte.
BYTE_KEYS = mix(np.arange(1, 257, dtype=np.uint64) * _MUL)

_powers: dict[str, np.ndarray] = {}
CACHES["powers"] = _powers


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash base and of its inverse modulo 2**64, at least n."""
    if len(_powers.get("p", ())) < n:
        n = max(n, CHUNK_BYTES + 4096)
        for name, base in (("p", _BASE), ("i", _INV)):
            one = np.full(n, base, np.uint64)
            one[0] = 1
            _powers[name] = np.cumprod(one)
    return _powers["p"], _powers["i"]


class RollingHash:
    """Prefix sums over a buffer; span(s, e) hashes buf[s:e] in O(1) each."""

    def __init__(self, buf: np.ndarray, keys: np.ndarray = BYTE_KEYS):
        pw, self.inv = powers(len(buf) + 1)
        self.sums = np.zeros(len(buf) + 1, np.uint64)
        np.cumsum(keys[buf] * pw[: len(buf)], out=self.sums[1:])

    def span(self, s: np.ndarray, e: np.ndarray) -> np.ndarray:
        h = (self.sums[e] - self.sums[s]) * self.inv[s]
        return mix(h + (e - s).astype(np.uint64) * _MUL)

    def grams(self, q: int) -> np.ndarray:
        """Hashes of all windows of q bytes."""
        n = len(self.sums) - q
        if n <= 0:
            return np.zeros(0, np.uint64)
        return mix((self.sums[q:] - self.sums[:n]) * self.inv[:n])


def hash_bytes(data: bytes) -> int:
    """The span hash of one byte string."""
    buf = np.frombuffer(data, np.uint8)
    return int(RollingHash(buf).span(np.array([0]), np.array([len(buf)]))[0])


def column_bytes(col: pa.ChunkedArray | pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(buffer, offsets) of a string or binary column; null counts as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks() if col.num_chunks != 1 else col.chunk(0)
    if isinstance(col, pa.ChunkedArray):
        col = pa.concat_arrays(col.chunks) if col.num_chunks else pa.array([], pa.string())
    if col.null_count:
        col = col.fill_null("" if pa.types.is_string(col.type) or pa.types.is_large_string(col.type) else b"")
    large = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    n = len(col)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, off, data = col.buffers()
    offs = np.frombuffer(off, np.int64 if large else np.int32)[col.offset : col.offset + n + 1].astype(np.int64)
    buf = np.frombuffer(data, np.uint8)[offs[0] : offs[-1]] if data is not None else np.zeros(0, np.uint8)
    return buf, offs - offs[0]


def chunks(offs: np.ndarray, limit: int = CHUNK_BYTES):
    """Ranges (i, j) of whole documents of about limit bytes, at least one each."""
    i, n = 0, len(offs) - 1
    while i < n:
        j = int(np.searchsorted(offs, offs[i] + limit, "right")) - 1
        j = min(max(j, i + 1), n)
        yield i, j
        i = j


def batch_slices(batch: pa.RecordBatch, at: int, limit: int = CHUNK_BYTES):
    """The batch in slices of about limit bytes of the text column at that index,
    so that Python strings are made for few rows at a time."""
    _, offs = column_bytes(batch.column(at))
    for i, j in chunks(offs, limit):
        yield batch.slice(i, j - i)


def word_spans(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words ([^\\x20\\x09-\\x0D]+, never across documents): starts, ends and
    the index of the first word of each document (len(offs) entries)."""
    n = len(buf)
    solid = ~WHITE[buf]
    first = np.zeros(n + 1, bool)
    first[offs] = True
    prev = np.zeros(n, bool)
    prev[1:] = solid[:-1]
    starts = np.flatnonzero(solid & (~prev | first[:n]))
    nxt = np.zeros(n, bool)
    nxt[:-1] = solid[1:]
    ends = np.flatnonzero(solid & (~nxt | first[1:])) + 1
    return starts, ends, np.searchsorted(starts, offs)


def isin_sorted(x: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(position in the sorted table, found) for each x."""
    if not len(table):
        return np.zeros(len(x), np.int64), np.zeros(len(x), bool)
    at = np.minimum(np.searchsorted(table, x), len(table) - 1)
    return at, table[at] == x


def id_text(col: str = "doc_id") -> Column:
    """The id as text; null counts as the empty text."""
    return F.coalesce(F.col(col).cast("string"), F.lit(""))


def fold(modulus: int, col: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo modulus."""
    return F.crc32(F.encode(id_text(col), "UTF-8")) % F.lit(modulus)


def narrow(docs: DataFrame, *cols: str) -> DataFrame:
    """Only the named columns, so that extra columns never clash."""
    return docs.select(*(docs[c] for c in cols))


def blocks_for(total_bytes: int, block_bytes: int) -> int:
    """How many blocks of about block_bytes hold total_bytes."""
    return max(1, -(-int(total_bytes or 0) // block_bytes))


def text_bytes(docs: DataFrame) -> int:
    """Total UTF-8 bytes of the text column (one narrow aggregate)."""
    return int(docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0)


_written: list = []


def _forget() -> None:
    for spark, path in _written:
        try:
            fs_path = spark._jvm.org.apache.hadoop.fs.Path(path)
            fs_path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(fs_path, True)
        except Exception:  # the session may have ended before
            pass


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Where that is unset, a folder of our own
    serves a local master only; on a cluster that is an error."""
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top and not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that the whole cluster sees")
    return (top or "/tmp/checkpoints").rstrip("/")


def spread_lookup(rows: DataFrame, table: DataFrame, keys: list[str], salt: Column, how: str = "inner", parts: int = 512) -> DataFrame:
    """rows joined with table, which has one row for each key. A key may have any
    share of the rows: they are salted, the pairs of key and salt that occur meet
    the table first (so many for a key at most), and then the rows meet the pairs."""
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64(salt), F.lit(parts)).cast("int"))
    pairs = salted.select(*keys, "_salt").distinct().join(table, keys, "inner" if how == "left_semi" else how)
    return salted.join(pairs, [*keys, "_salt"], how).drop("_salt")


def stored(df: DataFrame) -> DataFrame:
    """df written as Parquet to the folder of spark.checkpoint.dir and read back.

    This cuts the lineage and survives lost executors, since the files are in
    the folder that the cluster shares. The files go when the driver exits.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/larkspool-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    if not _written:
        atexit.register(_forget)
    _written.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def exclusive_prefix(df: DataFrame, key: str, value: str, out: str, group: int = 4096) -> DataFrame:
    """(key, out): for each distinct whole-number key >= 0 the sum of value over
    all smaller keys. Keys are summed in groups first, so that the only window
    without a partition key has one row for each group."""
    per = df.groupBy(key).agg(F.sum(value).alias("_v")).withColumn("_g", F.floor(F.col(key) / group).cast("long"))
    tops = per.groupBy("_g").agg(F.sum("_v").alias("_t"))
    before = F.coalesce(F.sum("_t").over(Window.orderBy("_g").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    tops = tops.select("_g", before.alias("_b"))
    within = F.coalesce(F.sum("_v").over(Window.partitionBy("_g").orderBy(key).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return per.join(tops, "_g").select(key, (F.col("_b") + within).cast("long").alias(out))


_code_keys: list[np.ndarray] = []
CACHES["code points"] = _code_keys


def code_point_keys() -> np.ndarray:
    """A pseudo-random 64-bit value per Unicode code point."""
    if not _code_keys:
        _code_keys.append(mix(np.arange(1, 0x110001, dtype=np.uint64) * _MUL))
    return _code_keys[0]


def characters(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the texts laid end to end, and offsets."""
    offs = np.concatenate([[0], np.cumsum([len(t) for t in texts], dtype=np.int64)]).astype(np.int64)
    return np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32), offs


def text_chunks(texts: list[str], limit: int = CHUNK_BYTES // 2):
    """Ranges of whole texts of about limit characters."""
    yield from chunks(np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64), limit)


def extended(docs: DataFrame, **more: str) -> T.StructType:
    """The schema of docs with columns added at its end."""
    return T.StructType(list(docs.schema.fields) + [T.StructField(k, T._parse_datatype_string(v)) for k, v in more.items()])
