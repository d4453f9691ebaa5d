"""Change detection, upserts and replacement of parts of a table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def upsert(old: DataFrame, new: DataFrame, *, key: str, keep: list[str], fill: list[str] = ()) -> DataFrame:
    """`old` with the rows of `new` merged in by key: columns of `keep` stay as they are where the row
    existed, columns of `fill` take the new value unless it is NULL, all others take the new value.

    Both sides have the columns of `old`; keys are unique per side and not NULL.
    """
    a, b = old.alias("a"), new.alias("b")
    there, comes = F.col(f"a.{key}").isNotNull(), F.col(f"b.{key}").isNotNull()

    def column(c: str) -> Column:
        was, now = F.col(f"a.`{c}`"), F.col(f"b.`{c}`")
        if c in keep:
            return F.when(there, was).otherwise(now)
        if c in fill:
            return F.coalesce(now, was)
        return F.when(comes, now).otherwise(was)

    return a.join(b, F.col(f"a.{key}") == F.col(f"b.{key}"), "full_outer").select(*[column(c).alias(c) for c in old.columns])


def changes(old: DataFrame, new: DataFrame, *, key: str, value: str) -> DataFrame:
    """key, change: rows added, removed or modified between two states (key, value); NULLs compare equal."""
    a = old.select(F.col(key).alias("k"), F.struct(F.col(value).alias("v")).alias("was"))
    b = new.select(F.col(key).alias("k"), F.struct(F.col(value).alias("v")).alias("now"))
    both = a.join(b, "k", "full_outer")
    change = F.when(F.col("was").isNull(), "added").when(F.col("now").isNull(), "removed").when(~F.col("was.v").eqNullSafe(F.col("now.v")), "modified")
    return both.select(F.col("k").alias(key), change.alias("change")).where("change IS NOT NULL")


def row_marks(*columns: str) -> tuple[Column, Column]:
    """Two numbers of 64 bits from the SHA-256 of a row, NULLs told from empty texts."""
    parts = [F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("-")) for c in columns]
    digest = F.sha2(F.concat_ws("\u0001", *parts), 256)
    first, second = (F.conv(F.substring(digest, at, 16), 16, 10).cast("decimal(28,0)") for at in (1, 17))
    return first, second


def signatures(df: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """key, rows, mark: a signature of each key's set of rows. Sums of row hashes need no order and combine
    before the shuffle, so the rows of a key are never gathered; two sums of 64-bit hashes tell billions apart."""
    sums = [F.sum(mark).cast("string") for mark in row_marks(*columns)]
    return df.groupBy(key).agg(F.count("*").alias("rows"), F.concat_ws("-", *sums).alias("mark"))


def update_columns(old: DataFrame, updates: DataFrame, *, keys: list[str], columns: list[str]) -> DataFrame:
    """`old` with `columns` replaced (also by NULL) where `updates` has the keys, all else untouched."""
    marked = updates.select(*keys, *[F.col(c).alias(f"__{c}") for c in columns], F.lit(True).alias("__hit"))
    joined = old.join(marked, keys, "left")
    return joined.select(*[F.when(F.col("__hit"), F.col(f"__{c}")).otherwise(F.col(c)).alias(c) if c in columns else F.col(c) for c in old.columns])


def replace_partitions(df: DataFrame, path: str, *, by: str) -> None:
    """Writes df over the partitions of its keys and leaves all other partitions as they are."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)


def append(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)
