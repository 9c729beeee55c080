"""Text functions as Columns. Only Unicode composition and case folding, which
Spark lacks, run in an Arrow UDF, and only over rows that can need them."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from larkspool.schema import col, known

# The characters that cleaning maps.
INVISIBLE = "​‎‏﻿­"
SPACES = "   "
QUOTES = "“”„«»"
APOSTROPHES = "‘’‚‛′´`ʼ"
DASHES = "‐‑‒–—―−"

#: White space as Python's str methods see it.
WHITE = r"(?U)[\s\x1c-\x1f\x85]+"
WORD = r"[\p{L}\p{N}_]"
MAYBE_LOOP = r"(?iuU)(?<!" + WORD + ")(" + WORD + r"+)(?:\s+\1(?!" + WORD + r")){2}"
LETTERS = r"[\p{L}\p{Nl}\p{No}]+"


def _nfc(x: pd.Series) -> pd.Series:
    return x.map(lambda t: unicodedata.normalize("NFC", t), na_action="ignore")


def _folded(x: pd.Series) -> pd.Series:
    return x.map(lambda t: unicodedata.normalize("NFC", t).casefold(), na_action="ignore")


def sparse(fn, c: Column, needs: Column) -> Column:
    """fn over the rows that need it; the others pass the worker as null."""
    return F.coalesce(F.pandas_udf(fn, "string")(F.when(needs, c)), c)


def nfc(c: Column | str) -> Column:
    """Unicode composition; text below U+0300 is composed already."""
    return sparse(_nfc, col(c), col(c).rlike(r"[\x{0300}-\x{10FFFF}]"))


def collapse(c: Column) -> Column:
    """Runs of white space as one space, none at the ends."""
    return F.trim(F.regexp_replace(c, WHITE, " "))


def clean_text(c: Column | str) -> Column:
    """Lossless cleaning: composition, invisible characters, quotes,
    apostrophes, dashes, ellipses, white space. The order is part of the result:
    doubled apostrophes turn into a quote before curly ones become plain."""
    t = F.translate(nfc(F.coalesce(col(c), F.lit(""))), INVISIBLE, "")
    t = F.translate(t, SPACES, " " * len(SPACES))
    t = F.regexp_replace(t, "''+", '"')
    plain = '"' * len(QUOTES) + "'" * len(APOSTROPHES) + "-" * len(DASHES)
    t = F.translate(t, QUOTES + APOSTROPHES + DASHES, plain)
    return collapse(F.replace(t, F.lit("…"), F.lit("...")))


def fragment_start(c: Column | str) -> Column:
    """Begins with a lower-case letter, past quotes and brackets."""
    return col(c).rlike("^[\"'(]*(?U)(?=\\p{L})\\p{Lower}")


def fragment_end(c: Column | str) -> Column:
    """Doesn't end with . ! or ?, past quotes and brackets."""
    return col(c).rlike("[^.!?\"')][\"')]*$") & ~col(c).rlike("[.!?][\"')]*$")


def word_count(c: Column | str) -> Column:
    """Runs of letters."""
    return F.regexp_count(col(c), F.lit(LETTERS))


def has_digits(c: Column | str) -> Column:
    return col(c).rlike(r"\p{Nd}")


def _loops(x: pd.Series) -> pd.Series:
    def one(t: str) -> bool:
        tokens = t.lower().split(" ")
        for a, b, c in zip(tokens, tokens[1:], tokens[2:], strict=False):
            if b and a.endswith(b) and c.startswith(b) and _ENDS.search(a)[0] == b == _BEGINS.match(c)[0]:
                return True
        return False

    return x.map(one, na_action="ignore")


_ENDS, _BEGINS = re.compile(r"\w*$"), re.compile(r"\w*")


def asr_loop(c: Column | str) -> Column:
    """One word three times in a row, whatever its case: the last word of one
    token, all of the next, the first word of the one after. Java's back-reference
    finds the few rows to look at (it also takes ı for i); those are looked at token
    by token in an Arrow UDF."""
    t = col(c)
    return F.coalesce(F.pandas_udf(_loops, "boolean")(F.when(t.rlike(MAYBE_LOOP), collapse(t))), F.lit(False))


def char_rate(text: Column | str, duration: Column | str) -> Column:
    """Characters a second; null without text or duration."""
    return F.when((F.length(col(text)) > 0) & (col(duration) > 0), F.length(col(text)) / col(duration))


def plain_text(c: Column | str) -> Column:
    """For error rates: composed, case-folded, without punctuation."""
    t = col(c)
    # below U+0300 lower() folds all but these
    t = sparse(_folded, t, t.rlike(r"[\x{00B5}\x{00DF}\x{0130}\x{0149}\x{017F}\x{01F0}\x{0300}-\x{10FFFF}]"))
    return collapse(F.regexp_replace(F.lower(t), r"\p{P}", ""))


def error_rate(hypothesis: Column | str, reference: Column | str) -> Column:
    """Character error rate of two texts; null for an empty reference."""
    both = F.array(F.struct(plain_text(hypothesis).alias("h"), plain_text(reference).alias("r")))
    # bound once; equal texts are common and the distance is quadratic
    distance = F.transform(both, lambda p: F.when(F.length(p["r"]) > 0, F.when(p["h"] == p["r"], F.lit(0)).otherwise(F.levenshtein(p["h"], p["r"])) / F.length(p["r"])))
    return F.get(distance, 0)


def parse_clip_id(c: Column | str) -> Column:
    """source-<hex>-<start ms>-<end ms> as a struct, or null."""
    pattern = r"^(source-[0-9a-f]+)-(\d{10})-(\d{10})$"
    part = [F.regexp_extract(col(c), pattern, i) for i in (1, 2, 3)]
    return F.when(part[0] != "", F.struct(part[0].alias("source"), part[1].cast("long").alias("start_ms"), part[2].cast("long").alias("end_ms")))


def recording_of(src: Column | str, clip_id: Column | str) -> Column:
    """The recording key, or the id without its last two dashed parts."""
    i = col(clip_id).cast("string")
    return F.coalesce(known(src), F.when(i.rlike("-.*-"), F.regexp_replace(i, r"-[^-]*-[^-]*$", "")).otherwise(i))


def synthetic_id(tag: str, shard: Column | str, row: Column | str) -> Column:
    return F.format_string(f"{tag}-s%04dr%06d", col(shard).cast("int"), col(row).cast("int"))


def hash_order(seed: int, *cols: Column | str) -> Column:
    """A random order that depends on seed and key alone."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *(col(c).cast("string") for c in cols)))


def hash_uniform(seed: int, *cols: Column | str) -> Column:
    """A number in [0, 1) that depends on seed and key alone."""
    return F.conv(F.substring(hash_order(seed, *cols), 1, 8), 16, 10).cast("double") / F.lit(float(1 << 32))
