"""Running maxima per key that spread a hot key over its buckets.

A plain window over one key sorts all its rows in one task. Here the rows are sorted per (key, bucket) and
what earlier buckets contribute is carried over from one summary row per bucket.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def running_max(
    df: DataFrame, keys: Sequence[str], bucket: str, order: Sequence[str], value: str, out: str, *, inclusive: bool = False
) -> DataFrame:
    """Adds `out`: the maximum of `value` over the earlier rows of the same keys (and the row itself, if
    inclusive). `bucket` must not fall along `order`. NULL values don't count; NULL where there is none."""
    rows = Window.partitionBy(*keys, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    buckets = Window.partitionBy(*keys).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    carry = (
        df.groupBy(*keys, bucket)
        .agg(F.max(value).alias("__top"))
        .withColumn("__carry", F.max("__top").over(buckets))
        .select(*keys, bucket, "__carry")
    )
    return (
        df.withColumn("__local", F.max(value).over(rows))
        .join(carry, [*keys, bucket])
        .withColumn(out, F.greatest("__local", "__carry"))
        .drop("__local", "__carry")
    )


def row_numbers(df: DataFrame, keys: Sequence[str], bucket: str, order: Sequence[str], out: str) -> DataFrame:
    """Adds `out`: the place, from 1, of each row among the rows of its keys in the order (bucket, *order), as the
    place in its bucket plus the rows of the buckets before. Keys and bucket must not be NULL."""
    before = Window.partitionBy(*keys).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    counts = df.groupBy(*keys, bucket).agg(F.count("*").alias("__n")).withColumn("__before", F.coalesce(F.sum("__n").over(before), F.lit(0)))
    place = F.row_number().over(Window.partitionBy(*keys, bucket).orderBy(*order))
    return df.withColumn("__place", place).join(counts.select(*keys, bucket, "__before"), [*keys, bucket]).withColumn(out, F.col("__place") + F.col("__before")).drop("__place", "__before")
