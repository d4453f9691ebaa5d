"""Column expressions on text and media times. White space is the explicit class below on every engine."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as one class, the same in Java and RE2 regular expressions.
WS = r"[ \t\n\r\f\x0b\x{a0}\x{85}]"
#: Tokens of the hashing embedding and of the claim check (fixed values).
TOKEN = r"[A-Za-zÀ-ÖØ-öø-ÿ0-9_./:@#-]+"


def strip(c: Column) -> Column:
    return F.regexp_replace(c, f"^{WS}+|{WS}+$", "")


def collapse(c: Column) -> Column:
    """Runs of white space as one space, none at the ends."""
    return strip(F.regexp_replace(c, f"{WS}+", " "))


def non_empty(c: Column) -> Column:
    """The stripped text, NULL if nothing is left."""
    return F.nullif(strip(c), F.lit(""))


def truncated(c: Column, most: int) -> Column:
    """The collapsed text, cut to `most` characters with `...` at the end where it is longer."""
    whole = collapse(c)
    return F.when(F.length(whole) <= most, whole).otherwise(F.concat(F.regexp_replace(F.substring(whole, 1, most - 3), " +$", ""), F.lit("...")))


def tokens(c: Column) -> Column:
    """Lower-case tokens in order."""
    return F.transform(F.regexp_extract_all(c, F.lit(TOKEN), F.lit(0)), F.lower)


def claim_tokens(c: Column) -> Column:
    """Distinct tokens of more than two characters, sorted."""
    return F.array_sort(F.array_distinct(F.filter(tokens(c), lambda t: F.length(t) > 2)))


def slug(c: Column) -> Column:
    """Lower-case ASCII letters and digits joined by hyphens: characters are decomposed, what isn't ASCII then is
    dropped. NULL where nothing is left."""
    plain = F.lower(F.when(c.rlike(r"[^\x00-\x7f]"), _ascii(c)).otherwise(c))
    return F.nullif(F.regexp_replace(F.regexp_replace(plain, "[^a-z0-9]+", "-"), "^-+|-+$", ""), F.lit(""))


def _ascii(c: Column) -> Column:
    """Compatibility decomposition, for which Spark has no function."""

    @F.pandas_udf("string")
    def plain(texts: pd.Series) -> pd.Series:
        return texts.map(lambda x: None if x is None else unicodedata.normalize("NFKD", x).encode("ascii", "ignore").decode())

    return plain(c)


def clock(seconds: Column) -> Column:
    """HH:MM:SS of a time in seconds, rounded half to even, not below zero."""
    whole = F.greatest(F.lit(0), F.rint(seconds).cast("bigint"))
    return F.format_string("%02d:%02d:%02d", F.expr("0") + F.floor(whole / 3600), F.floor((whole % 3600) / 60), whole % 60)


def seconds_of_clock(c: Column) -> Column:
    """Seconds of [HH:]MM:SS; NULL for anything else."""
    parts = F.split(c, ":")
    return F.when(
        c.rlike(r"^(\d+:)?\d+:\d\d$"),
        F.aggregate(parts, F.lit(0).cast("bigint"), lambda total, part: total * 60 + part.cast("bigint")),
    )


def chat_turns(text: Column) -> Column:
    """Turns of a chat export, array<struct<role, content>>: text after `user:` or `assistant:` up to the next."""
    marked = F.regexp_replace(text, r"(^|\s)(user|assistant): ", "$1\u0001$2: ")
    parts = F.filter(F.split(marked, "\u0001"), lambda p: p.rlike("^(user|assistant): "))
    return F.transform(parts, lambda p: F.struct(F.regexp_extract(p, "^(user|assistant): ", 1).alias("role"), strip(F.regexp_replace(p, "^(user|assistant): ", "")).alias("content")))
