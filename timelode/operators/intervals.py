"""Overlapping and gapped intervals: continuous periods and the holes between them.

Every step is a window over (entity, time bucket) plus a carry over per-bucket summaries, so an entity
that holds a third of all rows is spread over its buckets and no task sorts a whole entity.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from timelode.operators.scan import running_max
from timelode.session import checkpointed

#: Width of a time bucket. Wide enough that summaries stay a small fraction of the rows.
BUCKET_MS = 3_600_000


def continuous_periods(
    df: DataFrame, keys: Sequence[str], start_ms: Column, end_ms: Column, *, bucket_ms: int = BUCKET_MS
) -> DataFrame:
    """One row per continuous covered period of each entity.

    Columns: the keys, start_ms, end_ms, pieces (distinct start times merged), gap_before_start_ms (the
    end of the period before it; NULL for an entity's first). Touching intervals belong to one period.

    Rows with a NULL key, start or end cover nothing, nor do rows that don't end after their start; ties
    and repeated rows change nothing; an empty input gives no row; other columns are ignored.
    """
    named = [F.col(f"`{k}`").alias(f"__k{i}") for i, k in enumerate(keys)]
    ks = [f"__k{i}" for i in range(len(keys))]
    # The distinct spans are read four times below; kept, the table behind them is read once.
    spans = checkpointed(
        df.select(*named, start_ms.alias("__start"), end_ms.alias("__end"))
        .where("__end > __start")
        .dropna(subset=ks)
        .groupBy(*ks, "__start")  # combined before the shuffle: ties and repeats shrink here
        .agg(F.max("__end").alias("__end"))
        .withColumn("__bucket", F.floor(F.col("__start") / bucket_ms))
    )
    flagged = running_max(spans, ks, "__bucket", ["__start"], "__end", "__reach").withColumn(
        "__opens", F.when(F.col("__reach").isNull() | (F.col("__start") > F.col("__reach")), F.col("__start"))
    )
    # An island's label is the start of the row that opened it: the last opening so far.
    labelled = running_max(flagged, ks, "__bucket", ["__start"], "__opens", "__before").withColumn("__island", F.coalesce("__opens", "__before"))
    return (
        labelled.groupBy(*ks, "__island")
        .agg(
            F.max("__end").alias("end_ms"),
            F.count(F.lit(1)).alias("pieces"),
            F.max(F.when(F.col("__opens").isNotNull(), F.col("__reach"))).alias("gap_before_start_ms"),
        )
        .select(
            *[F.col(k).alias(name) for k, name in zip(ks, keys, strict=True)],
            F.col("__island").alias("start_ms"),
            "end_ms",
            "pieces",
            "gap_before_start_ms",
        )
    )


def gaps_between(periods: DataFrame, *, at_least_ms: int = 1, below_ms: int | None = None) -> DataFrame:
    """The holes between the periods of `continuous_periods`: the keys, gap_start_ms, gap_end_ms."""
    keys = [c for c in periods.columns if c not in ("start_ms", "end_ms", "pieces", "gap_before_start_ms")]
    length = F.col("start_ms") - F.col("gap_before_start_ms")
    out = periods.where(length >= at_least_ms)
    if below_ms is not None:
        out = out.where(length < below_ms)
    return out.select(*keys, F.col("gap_before_start_ms").alias("gap_start_ms"), F.col("start_ms").alias("gap_end_ms"))
