"""Exact substring dedup: a suffix array by bucket-pointer refinement.

Every byte covered by a string of `length` bytes that also starts somewhere else
(in any document, the same one included) is removed.

Spread over tasks, the first buckets are those of a q-gram: of each window of
`length` bytes the q-gram with the least hash is its anchor. Equal windows have
equal anchors in equal places, so only windows with one anchor q-gram need be
compared. Neighbouring windows with one anchor in common make a segment; only
q-gram hash, segment hash and place of a segment are shuffled (about one row for
each length/2 bytes of text). Then:

1. q-grams that occur once are dropped.
2. A segment whose content occurs twice is a repeat as a whole.
3. Of q-grams with several different segments, some of which occur once, the
   segments' bytes (one copy of each content) are brought together in buckets of
   bounded size, and a suffix array of each bucket is refined up to `length`
   bytes: 8-byte buckets first, then buckets are sorted by the bucket pointers of
   later offsets, and the refined pointers serve the next, deeper pass. Windows
   in one bucket in the end are equal.

A q-gram with more than `hot_segments` different segments isn't given to one
task. Its initial buckets are those of the whole windows instead, q being
`length`, so that nothing is left to refine: windows are counted by 128 bits of
hashes, with a map-side combine.

Segments are told apart by 128 bits of hashes, windows in step 3 by their bytes.
Where many rows share a q-gram, a segment or a window, they are salted before they
are joined. A text longer than a chunk is gone through in overlapping pieces.

Defined cases: a null text is empty; texts shorter than `length` lose nothing;
repeated rows are repeats of each other, so lose all bytes if long enough; an
empty table gives no rows; other columns pass through, except those named like
an output column (kept, n_bytes, n_removed, n_spans, spans), which are replaced.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .textops import RollingHash, blocks_for, chunks, column_bytes, extended, lean, lean_groups, mix, narrow, spread_lookup, stored, text_bytes

LENGTH = 200
GRAM = 24
BLOCK_BYTES = 8 << 20
#: Bytes of segments whose suffixes are sorted together.
BUCKET_BYTES = 2 << 20
#: Text bytes handled at a time: a window takes some twenty numbers of eight bytes.
SLICE = 1 << 19
HOT_SEGMENTS = 20_000
_POS = np.uint64((1 << 28) - 1)


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """The least of each w neighbours, by doubling."""
    have, out = 1, x
    while have * 2 <= w:
        out = np.minimum(out[:-have], out[have:])
        have *= 2
    return np.minimum(out[: len(x) - w + 1], out[w - have : w - have + len(x) - w + 1]) if have < w else out


def segments(buf: np.ndarray, offs: np.ndarray, length: int, gram: int):
    """(document, q-gram hash, segment hash, first window, windows) of every
    segment; places count from the document's start."""
    n = len(buf)
    empty = np.zeros(0, np.int64)
    if n < length:
        return empty, empty.astype(np.uint64), empty.astype(np.uint64), empty, empty
    roll = RollingHash(buf)
    grams = roll.grams(gram)
    packed = (grams & ~_POS) | np.arange(len(grams), dtype=np.uint64)
    anchor = (sliding_min(packed, length - gram + 1) & _POS).astype(np.int64)
    end = np.repeat(offs[1:], np.diff(offs))
    start = np.flatnonzero(np.arange(len(anchor)) + length <= end[: len(anchor)])
    if not len(start):
        return empty, empty.astype(np.uint64), empty.astype(np.uint64), empty, empty
    own = anchor[start]
    new = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
    low, high = start[new], start[np.append(new[1:], len(start)) - 1]
    at = own[new]
    content = mix(roll.span(low, high + length) ^ mix((at - low).astype(np.uint64)))
    doc = np.searchsorted(offs, low, "right") - 1
    return doc, grams[at], content, low - offs[doc], high - low + 1


def all_segments(buf: np.ndarray, offs: np.ndarray, length: int, gram: int):
    """segments() of a chunk of documents; one document longer than a chunk is
    gone through in pieces that overlap by all of a window but a byte."""
    if len(offs) > 2 or len(buf) <= 2 * SLICE:
        yield segments(buf, offs, length, gram)
        return
    for a in range(0, len(buf), SLICE):
        part = buf[a : a + SLICE + length - 1]
        doc, g, s, low, n = segments(part, np.array([0, len(part)]), length, gram)
        yield doc, g, s, low + a, n


def refine(text: np.ndarray, starts: np.ndarray, length: int) -> np.ndarray:
    """Whether the string of `length` bytes at each start is at another start,
    too: bucket-pointer refinement of the text's suffixes to that depth."""
    n = len(text)
    depth = min(8, length)
    padded = np.append(text, np.zeros(8, np.uint8))
    code = np.zeros(n, np.uint64)
    for j in range(depth):
        code = (code << np.uint64(8)) | padded[j : j + n]
    order = np.argsort(code, kind="stable").astype(np.int32)
    code = code[order]
    first = np.append(True, code[1:] != code[:-1])
    del code, padded
    at = np.flatnonzero(first).astype(np.int32)
    pointer = np.zeros(n + length, np.int32)  # a bucket's pointer is the place of its first suffix
    pointer[order] = at[np.cumsum(first, dtype=np.int32) - 1]
    size = np.diff(np.append(at, n))
    active = order[np.repeat(size > 1, size)]
    del order, first
    while depth < length:
        step = min(depth, length - depth)
        if depth + step == length:  # only whole strings matter in the last pass
            wanted = np.zeros(n, bool)
            wanted[starts] = True
            active = active[wanted[active]]
        if not len(active):
            break
        active = active[np.argsort(pointer[active].astype(np.int64) * (n + 1) + pointer[active + step])]
        old, later = pointer[active], pointer[active + step]
        bucket = np.append(True, old[1:] != old[:-1])
        first = bucket | np.append(True, later[1:] != later[:-1])
        at = np.flatnonzero(first)
        size = np.diff(np.append(at, len(active)))
        base = np.flatnonzero(bucket)[np.cumsum(bucket)[at] - 1]
        pointer[active] = np.repeat(old[at] + at - base, size)
        active = active[np.repeat(size > 1, size)]
        depth += step
    many = np.zeros(n, bool)
    many[active] = True
    if length <= 8:  # no pass of its own: count the wanted starts only
        _, inv, count = np.unique(pointer[starts], return_inverse=True, return_counts=True)
        return count[inv] > 1
    return many[starts]


def runs(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of True."""
    edge = np.flatnonzero(np.diff(np.concatenate([[False], flags, [False]]).astype(np.int8)))
    return edge[::2], edge[1::2]


def merged(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The union of intervals as maximal runs in ascending order."""
    order = np.argsort(start, kind="stable")
    start, top = start[order], np.maximum.accumulate(end[order])
    new = np.append(True, start[1:] > top[:-1])
    return start[new], top[np.append(np.flatnonzero(new)[1:], len(start)) - 1]


def repeated_spans(keyed: DataFrame, blocks: int, length: int, gram: int, hot_segments: int) -> DataFrame:
    """key, start, end of the repeated strings of keyed (block, key, text, ...)."""

    def scan(batches):
        for batch in batches:
            keys = batch.column(0).to_numpy()
            buf, offs = column_bytes(batch.column(1))
            for i, j in chunks(offs, SLICE):
                for doc, g, s, low, n in all_segments(buf[offs[i] : offs[j]], offs[i : j + 1] - offs[i], length, gram):
                    cols = [g.view(np.int64), s.view(np.int64), keys[i + doc], low.astype(np.int32), n.astype(np.int32)]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["gram", "content", "key", "low", "n"])

    found = narrow(keyed, "key", "text").mapInArrow(lean(scan, "powers"), "gram long, content long, key long, low int, n int")
    # stored, so that the join's shuffle is its own and a hot q-gram's rows can be split
    again = stored(found.groupBy("gram").agg(F.count("*").alias("c")).where("c > 1").select("gram"))
    found = stored(found.join(again, "gram", "left_semi"))
    kinds = found.groupBy("gram", "content").agg(F.count("*").alias("copies"), F.min(F.struct("key", "low", "n")).alias("one"))
    open_ = kinds.groupBy("gram").agg(F.count("*").alias("kinds"), F.min("copies").alias("least")).where("kinds > 1 and least = 1").drop("least")
    asked = spread_lookup(kinds, open_, ["gram"], F.col("content")).select("gram", "copies", "one.key", "one.low", "one.n", "kinds")
    asked = stored(asked.withColumn("block", F.pmod("key", F.lit(blocks))))
    total, most = asked.agg(F.sum(F.col("n") + length), F.max("kinds")).first()

    def cut(docs: pa.Table, ask: pa.Table) -> pa.Table:
        keys = docs.column("key").to_numpy()
        buf, offs = column_bytes(docs.column("text"))
        order = np.argsort(keys, kind="stable")
        row = order[np.searchsorted(keys, ask.column("key").to_numpy(), sorter=order)] if ask.num_rows else np.zeros(0, int)
        s = offs[row] + ask.column("low").to_numpy()
        e = s + ask.column("n").to_numpy() + length - 1
        data = buf.tobytes()
        cols = {c: ask.column(c) for c in ("gram", "copies", "key", "low", "kinds")}
        return pa.table(cols | {"bytes": pa.array([data[a:b] for a, b in zip(s.tolist(), e.tolist(), strict=True)], pa.binary())})

    pieces = keyed.groupBy("block").cogroup(asked.groupBy("block")).applyInArrow(lean_groups(cut), "gram long, copies long, key long, low int, kinds long, bytes binary")

    def sort_bucket(table: pa.Table) -> pa.Table:
        """Some q-grams at a time: windows of different ones are never equal."""
        table = table.sort_by("gram").combine_chunks()
        own = table.column("gram").to_numpy()
        edge = np.append(np.flatnonzero(np.append(True, own[1:] != own[:-1])), len(own))
        _, offs = column_bytes(table.column("bytes"))
        ranges = [(int(edge[i]), int(edge[j])) for i, j in chunks(offs[edge], SLICE)]
        return pa.concat_tables([sort_grams(table.slice(i, j - i)) for i, j in ranges])

    def sort_grams(table: pa.Table) -> pa.Table:
        text, offs = column_bytes(table.column("bytes"))
        ends = np.repeat(offs[1:], np.diff(offs))
        starts = np.flatnonzero(np.arange(len(text)) + length <= ends)
        flags = np.zeros(len(text), bool)
        flags[starts] = refine(text, starts, length)
        keys, lows, copies = (table.column(c).to_numpy() for c in ("key", "low", "copies"))
        a, b = runs(flags)
        # a run may go on from one segment's windows into the next's only if length is 1
        seg = np.searchsorted(offs, a, "right") - 1
        once = copies[seg] == 1
        a, b, seg = a[once], b[once], seg[once]
        low = lows[seg] + a - offs[seg]
        return pa.table({"key": keys[seg], "start": low.astype(np.int64), "end": (low + b - a + length - 1).astype(np.int64)})

    spans = "key long, start long, end long"
    bucket = F.pmod("gram", F.lit(blocks_for(total, BUCKET_BYTES)))
    sorted_ = pieces.where(F.col("kinds") <= hot_segments).withColumn("bucket", bucket).groupBy("bucket").applyInArrow(lean_groups(sort_bucket), spans)
    if (most or 0) > hot_segments:

        def explode(batches):
            for batch in batches:
                _, copies, keys, lows = (batch.column(i).to_numpy() for i in range(4))
                buf, offs = column_bytes(batch.column(4))
                for i, j in chunks(offs, SLICE):
                    part, o = buf[offs[i] : offs[j]], offs[i : j + 1] - offs[i]
                    at = np.flatnonzero(np.arange(len(part)) + length <= np.repeat(o[1:], np.diff(o)))
                    seg = np.searchsorted(o, at, "right") - 1
                    roll = RollingHash(part)
                    h = roll.span(at, at + length)
                    half = mix(roll.span(at, at + length // 2) ^ h)  # other bits of the same window
                    cols = [copies[i + seg], keys[i + seg], (lows[i + seg] + at - o[seg]).astype(np.int64), h.view(np.int64), half.view(np.int64)]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["copies", "key", "start", "window", "half"])

        # the q-gram is made as long as the window: such a bucket has no later offset to be refined by
        hot = pieces.where(F.col("kinds") > hot_segments).select("gram", "copies", "key", "low", "bytes")
        windows = hot.mapInArrow(lean(explode, "powers"), "copies long, key long, start long, window long, half long")
        twice = windows.groupBy("window", "half").agg(F.count("*").alias("c")).where("c > 1").select("window", "half")
        repeats = spread_lookup(windows.where("copies = 1"), twice, ["window", "half"], F.col("key"), "left_semi")
        sorted_ = sorted_.unionByName(repeats.select("key", "start", (F.col("start") + length).alias("end")))
    whole = kinds.where("copies > 1").select("gram", "content")
    low = F.col("low").cast("long")
    whole = spread_lookup(found, whole, ["gram", "content"], F.col("key"), "left_semi").select("key", low.alias("start"), (low + F.col("n") + (length - 1)).alias("end"))
    return whole.unionByName(sorted_)


def remove_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, hot_segments: int = HOT_SEGMENTS, as_text: bool = False) -> DataFrame:
    """docs plus kept (bytes that stay), n_bytes, n_removed, n_spans, and spans
    (start and end of each maximal removed run). as_text: kept is text; what a cut
    leaves of a character is dropped."""
    gram = min(gram, length)
    docs = docs.drop("kept", "n_bytes", "n_removed", "n_spans", "spans")
    blocks = blocks_for(text_bytes(docs), BLOCK_BYTES)
    # rows with the same id and text are alike in all that follows
    key = F.xxhash64(docs["doc_id"], F.coalesce(docs["text"], F.lit("")))
    payload = docs.columns
    keyed = docs.select(key.alias("key"), F.col("text"), F.struct(*(docs[c] for c in payload if c != "text")).alias("rest"))
    keyed = keyed.withColumn("block", F.pmod("key", F.lit(blocks)))
    spans = repeated_spans(keyed, blocks, length, gram, hot_segments).withColumn("block", F.pmod("key", F.lit(blocks)))

    def apply(docs: pa.Table, spans: pa.Table) -> pa.Table:
        buf, offs = column_bytes(docs.column("text"))
        keys = docs.column("key").to_numpy()
        own = spans.column("key").to_numpy()
        order = np.argsort(own, kind="stable")
        own, start, end = own[order], spans.column("start").to_numpy()[order], spans.column("end").to_numpy()[order]
        left, right = np.searchsorted(own, keys, "left"), np.searchsorted(own, keys, "right")
        kept, removed, lists = [], [], []
        for d in range(len(keys)):
            data = buf[offs[d] : offs[d + 1]]
            if left[d] == right[d]:
                kept.append(data.tobytes())
                removed.append(0)
                lists.append([])
                continue
            a, b = merged(start[left[d] : right[d]], end[left[d] : right[d]])
            cuts = np.concatenate([[0], np.stack([a, b], 1).ravel(), [len(data)]]).reshape(-1, 2)
            kept.append(b"".join(data[i:j].tobytes() for i, j in cuts.tolist()))
            removed.append(int((b - a).sum()))
            lists.append([{"start": i, "end": j} for i, j in zip(a.tolist(), b.tolist(), strict=True)])
        return pa.table({"rest": docs.column("rest"), "text": docs.column("text"), "kept": pa.array([b.decode("utf-8", "ignore") for b in kept], pa.string()) if as_text else pa.array(kept, pa.binary()), "n_bytes": np.diff(offs), "n_removed": pa.array(removed, pa.int64()), "spans": pa.array(lists, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))})

    schema = extended(keyed.select("rest", "text"), kept="string" if as_text else "binary", n_bytes="long", n_removed="long", spans="array<struct<start: long, end: long>>")
    out = keyed.groupBy("block").cogroup(spans.groupBy("block")).applyInArrow(lean_groups(apply), schema)
    cols = [F.col("text") if c == "text" else F.col("rest")[c].alias(c) for c in payload]
    return out.select(*cols, "kept", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), "spans")


def without_repeats(docs: DataFrame, **options) -> DataFrame:
    """docs with the repeats cut out of text (n_chars, if there, counts anew). A
    character that a cut leaves in part is dropped; a null text stays null."""
    out = remove_repeats(docs, as_text=True, **options)
    out = out.withColumn("text", F.when(F.col("text").isNotNull(), F.col("kept")))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeats(narrow(spark.read.parquet(f"{sf_dir}/documents.parquet"), "doc_id", "text"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
