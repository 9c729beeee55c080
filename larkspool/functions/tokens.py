"""Codec and token arrays as Columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspool.schema import col, number

# The token id space.
LEVEL = 4096
TEXT_VOCAB = 4096
AUDIO_VOCAB = 3 * LEVEL
SPECIALS = ["bos", "eos", "pad", "text_start", "text_end", "audio_start", "audio_end", "plain_tts", "clone_tts", "frag_start", "frag_end"]
CONTROLS = ["rate_0", "rate_1", "rate_2", "rate_3", "rate_4", "rate_any", "loud_0", "loud_1", "loud_2", "loud_any"]
VOCAB = 16448
ID = {name: TEXT_VOCAB + AUDIO_VOCAB + i for i, name in enumerate(SPECIALS + CONTROLS)}
#: The codebook level of each of a frame's seven slots.
SLOT_LEVELS = [0, 1, 1, 2, 2, 2, 2]
FRAME = len(SLOT_LEVELS)
HOP = 2048


def ints(*values: int) -> Column:
    return F.array(*(F.lit(v) for v in values)).cast("array<int>")


def slot_level(i: Column) -> Column:
    return F.element_at(ints(*SLOT_LEVELS), (i % FRAME + 1).cast("int"))


def flatten_codes(l0: Column | str, l1: Column | str, l2: Column | str) -> Column:
    """Three codebook levels (1 : 2 : 4 long) as seven codes a frame, each level
    in its own id range; null if the lengths don't fit."""
    a, b, c = col(l0), col(l1), col(l2)
    n = F.size(a)

    def frame(t):
        x, y, z = (lambda k: F.get(a, t + k)), (lambda k: F.get(b, 2 * t + k) + LEVEL), (lambda k: F.get(c, 4 * t + k) + 2 * LEVEL)
        return F.array(x(0), y(0), y(1), z(0), z(1), z(2), z(3))

    fits = (F.size(b) == 2 * n) & (F.size(c) == 4 * n)
    frames = F.when(n > 0, F.flatten(F.transform(F.sequence(F.lit(0), n - 1), frame))).otherwise(F.array().cast("array<int>"))
    return F.when(fits, frames)


def unflatten_codes(flat: Column | str) -> Column:
    """struct(l0, l1, l2) of whole frames, codes clamped to a level; null without
    a whole frame."""
    x = col(flat)
    n = F.floor(F.size(x) / FRAME).cast("int")

    def level(slots, number_):
        def at(t):
            return F.array(*(F.greatest(F.lit(0), F.least(F.lit(LEVEL - 1), F.get(x, t * FRAME + s) - number_ * LEVEL)) for s in slots))

        return F.flatten(F.transform(F.sequence(F.lit(0), n - 1), at))

    by_level = [[s for s, v in enumerate(SLOT_LEVELS) if v == k] for k in range(3)]
    return F.when(n > 0, F.struct(*(level(s, k).alias(f"l{k}") for k, s in enumerate(by_level))))


def slots_to_levels(flat: Column | str) -> Column:
    """Ids with a range per slot as ids with a range per level; a broken frame at
    the end is left out."""
    whole = F.slice(col(flat), 1, (F.size(col(flat)) - F.size(col(flat)) % FRAME).cast("int"))
    return F.transform(whole, lambda x, i: x - (i % FRAME) * LEVEL + slot_level(i) * LEVEL)


def frames_of(samples: Column | str) -> Column:
    return F.ceil(col(samples) / HOP)


def audio_to_lm(codes: Column | str) -> Column:
    return F.transform(col(codes), lambda x: x + TEXT_VOCAB)


def lm_to_audio(ids: Column | str) -> Column:
    return F.transform(col(ids), lambda x: x - TEXT_VOCAB)


def is_audio(i: Column) -> Column:
    return i.between(TEXT_VOCAB, TEXT_VOCAB + AUDIO_VOCAB - 1)


def audio_codes(ids: Column | str) -> Column:
    """The audio codes among generated ids."""
    return lm_to_audio(F.filter(col(ids), is_audio))


def rate_token(bucket: Column | str) -> Column:
    return F.coalesce(F.lit(ID["rate_0"]) + col(bucket), F.lit(ID["rate_any"])).cast("int")


def loud_token(bucket: Column | str) -> Column:
    return F.coalesce(F.lit(ID["loud_0"]) + col(bucket), F.lit(ID["loud_any"])).cast("int")


def bucket_of(value: Column | str, edges: list[float] | Column) -> Column:
    """How many edges are not above the value."""
    e = edges if isinstance(edges, Column) else F.array(*(F.lit(float(x)) for x in edges))
    v = col(value)
    return F.when(v.isNotNull(), F.size(F.filter(e, lambda x: x <= v)))


def loud_bucket(lufs: Column | str, edges: list[float] | Column) -> Column:
    return bucket_of(number(lufs), edges)


def build_prompt(text_ids: Column | str, rate: Column, loud: Column, ref_codes: Column | None = None, fragments: Column | None = None) -> Column:
    """bos, task, controls, fragment marks, text, then audio_start and the codes
    of the reference clip if there is one. rate and loud are token ids."""
    task = "plain_tts" if ref_codes is None else "clone_tts"
    head = F.array(F.lit(ID["bos"]), F.lit(ID[task]), rate.cast("int"), loud.cast("int"))
    marks = [] if fragments is None else [fragments]
    ref = [] if ref_codes is None else [audio_to_lm(ref_codes)]
    return F.concat(head, *marks, ints(ID["text_start"]), col(text_ids), ints(ID["text_end"], ID["audio_start"]), *ref)


def training_sequence(prompt: Column, codes: Column | str) -> Column:
    return F.concat(prompt, audio_to_lm(codes), ints(ID["audio_end"], ID["eos"]))


def truncated_reference(codes: Column | str, frames: int = 117) -> Column:
    return F.slice(col(codes), 1, frames * FRAME)


def fragment_tokens(start: Column | str, end: Column | str) -> Column:
    def one(flag, name):
        return F.when(F.coalesce(col(flag), F.lit(False)), ints(ID[name])).otherwise(F.array().cast("array<int>"))

    return F.concat(one(start, "frag_start"), one(end, "frag_end"))


def collated(ids: Column | str, label_start: Column | str, width: Column | str) -> Column:
    """struct(input_ids, labels, attention_mask) padded on the right to width;
    labels are -100 before label_start and on the padding."""
    x, pad = col(ids), col(width) - F.size(col(ids))
    labels = F.concat(F.transform(x, lambda v, i: F.when(i < col(label_start), F.lit(-100)).otherwise(v)), F.array_repeat(F.lit(-100), pad))
    mask = F.concat(F.array_repeat(F.lit(1), F.size(x)), F.array_repeat(F.lit(0), pad))
    return F.struct(F.concat(x, F.array_repeat(F.lit(ID["pad"]), pad)).alias("input_ids"), labels.alias("labels"), mask.alias("attention_mask"))


def packed_problem(ids: Column | str) -> Column:
    """What is wrong with a packed sequence, or null."""
    x = col(ids)
    n = F.size(x)
    return (
        F.when(F.element_at(x, 1) != ID["bos"], "no bos")
        .when(~F.element_at(x, 2).isin(ID["plain_tts"], ID["clone_tts"]), "no task")
        .when((F.get(x, n - 2) != ID["audio_end"]) | (F.get(x, n - 1) != ID["eos"]), "bad end")
        .when(F.size(F.filter(x, is_audio)) % FRAME != 0, "broken frame")
    )


def vocabulary(spark: SparkSession) -> DataFrame:
    """name, first_id, last_id of the parts of the id space, and of each token with
    a name; the row "padded" ends the space that embeddings are padded to."""
    parts = [("text", 0, TEXT_VOCAB - 1), ("audio", TEXT_VOCAB, TEXT_VOCAB + AUDIO_VOCAB - 1)]
    rows = parts + [(name, i, i) for name, i in ID.items()] + [("padded", max(ID.values()) + 1, VOCAB - 1)]
    return spark.createDataFrame(rows, "name string, first_id int, last_id int")
