"""Nearest interval on a timeline without a tolerance, and the first interval that contains a time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from timelode.operators.scan import running_max

BIN_MS = 60_000
BUCKET_MS = 3_600_000


def binned(df: DataFrame, low: str, high: str, bin_ms: int = BIN_MS) -> DataFrame:
    """Each row once per bin that [low, high] meets, as `__bin`; rows with high < low in none."""
    return df.where(F.col(high) >= F.col(low)).withColumn("__bin", F.explode(F.sequence(F.floor(F.col(low) / bin_ms), F.floor(F.col(high) / bin_ms))))


def containing(probes: DataFrame, spans: DataFrame, *, key: str, time: str, bin_ms: int = BIN_MS) -> DataFrame:
    """Pairs of probes (key, time, ..) and spans (key, s, e, ..) of the same key with s <= time <= e: an
    equi join on (key, bin) with the bounds as a residual, so a hot key is spread over its bins."""
    left = probes.withColumn("__bin", F.floor(F.col(time) / bin_ms))
    return left.join(binned(spans, "s", "e", bin_ms), [key, "__bin"]).where(F.col(time).between(F.col("s"), F.col("e"))).drop("__bin")


def nearest_span(probes: DataFrame, spans: DataFrame, *, key: str, probe_id: str, time: str, span_id: str) -> DataFrame:
    """probe_id, span_id, distance_ms: for each probe the span (s, e, bigint ms) of its key with the smallest
    (distance, start, id); the distance is 0 within [s, e], else that to the nearer end.

    Spans that contain the probe come from a binned join; otherwise the nearest is the last end before the
    probe or the first start after it, found by running maxima over time buckets. Probes and spans with a
    NULL key, id or time are left out, spans that end before they start too; probes of a key without spans
    give no row; repeated rows count once.
    """
    p = probes.select(F.col(f"`{key}`").alias("key"), F.col(f"`{probe_id}`").alias("pid"), F.col(f"`{time}`").alias("t")).dropna().distinct()
    s = spans.select(F.col(f"`{key}`").alias("key"), F.col(f"`{span_id}`").alias("sid"), "s", "e").dropna().where("e >= s").distinct()
    inside = containing(p, s, key="key", time="t").groupBy("key", "pid", "t").agg(F.min(F.struct(F.lit(0).cast("bigint").alias("d"), "s", "sid")).alias("best"))

    # Of spans that end at one time the one with the smallest (start, id) counts; of those that start at
    # one time the smallest id. Sign flips turn the first start after a probe into a running maximum.
    ends = s.groupBy("key", F.col("e").alias("at")).agg(F.min(F.struct("s", "sid")).alias("span"))
    starts = s.groupBy("key", (-F.col("s")).alias("at")).agg(F.min(F.struct("s", "sid")).alias("span"))

    def last_before(marks: DataFrame, sign: int) -> DataFrame:
        both = marks.select("key", "at", F.struct("at", "span").alias("mark"), F.lit(None).cast("string").alias("pid")).unionByName(
            p.select("key", (sign * F.col("t")).alias("at"), F.lit(None).cast(marks.select(F.struct("at", "span")).schema[0].dataType).alias("mark"), "pid")
        )
        both = both.withColumn("bucket", F.floor(F.col("at") / BUCKET_MS)).withColumn("late", F.col("pid").isNotNull())
        return running_max(both, ["key"], "bucket", ["at", "late"], "mark", "near").where("late AND near IS NOT NULL").select(
            "key", "pid", (sign * F.col("at")).alias("t"), F.struct((F.col("at") - F.col("near.at")).alias("d"), "near.span.s", "near.span.sid").alias("best")
        )

    every = inside.unionByName(last_before(ends, 1)).unionByName(last_before(starts, -1))
    return every.groupBy("key", "pid", "t").agg(F.min("best").alias("best")).select(F.col("pid").alias(probe_id), F.col("best.sid").alias(span_id), F.col("best.d").alias("distance_ms"))


def top_within(df: DataFrame, keys: list[str], order: list[Column], n: int, out: str = "place") -> DataFrame:
    """The first n rows of each key with their place; the rank is limited before its shuffle."""
    return df.withColumn(out, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col(out) <= n)


def nearest_points(probes: DataFrame, points: DataFrame, *, key: str, probe_id: str, time: str, point_id: str, n: int) -> DataFrame:
    """probe_id, time, place, point_id, distance_ms: for each probe the first n points (t, bigint ms) of its key, by
    distance, then time, then id, however far they are.

    On either side of a probe n of them can count, so every time with points carries the first n ids of itself
    and of the n - 1 times before it; across time buckets these come from one summary row per bucket. Probes and
    points with a NULL key, id or time are left out; probes of a key without points give no row; repeated rows
    count once.
    """
    p = probes.select(F.col(f"`{key}`").alias("key"), F.col(f"`{probe_id}`").alias("pid"), F.col(f"`{time}`").alias("at")).dropna().distinct()
    s = points.select(F.col(f"`{key}`").alias("key"), F.col(f"`{point_id}`").alias("sid"), "t").dropna().distinct()
    marks = top_within(s, ["key", "t"], [F.col("sid")], n).groupBy("key", "t").agg(F.array_sort(F.collect_list("sid")).alias("ids"))

    def side(sign: int) -> DataFrame:
        own = marks.select("key", (sign * F.col("t")).alias("t"), "ids").withColumn("bucket", F.floor(F.col("t") / BUCKET_MS))
        near = Window.partitionBy("key", "bucket").orderBy("t").rowsBetween(1 - n, 0)
        own = own.withColumn("lately", F.collect_list(F.struct("t", "ids")).over(near))
        before = Window.partitionBy("key").orderBy("bucket").rowsBetween(-n, -1)
        carry = own.groupBy("key", "bucket").agg(F.max_by("lately", "t").alias("lately")).withColumn("carry", F.flatten(F.collect_list("lately").over(before)))
        own = own.join(carry.select("key", "bucket", "carry"), ["key", "bucket"]).withColumn("lately", F.concat("carry", "lately"))
        kind = own.select(F.struct("t", "lately")).schema[0].dataType
        both = own.select("key", "bucket", "t", F.struct("t", "lately").alias("mark"), F.lit(None).cast("string").alias("pid")).unionByName(
            p.select("key", F.floor(sign * F.col("at") / BUCKET_MS).alias("bucket"), (sign * F.col("at")).alias("t"), F.lit(None).cast(kind).alias("mark"), F.col("pid").cast("string"))
        )
        found = running_max(both.withColumn("late", F.col("pid").isNotNull()), ["key"], "bucket", ["t", "late"], "mark", "last").where("late AND last IS NOT NULL")
        each = found.select("key", "pid", (sign * F.col("t")).alias("at"), F.explode(F.slice(F.reverse("last.lately"), 1, n)).alias("m"))
        return each.select("key", "pid", "at", (sign * F.col("m.t")).alias("t"), F.explode("m.ids").alias("sid"))

    pairs = side(1).unionByName(side(-1)).distinct().withColumn("d", F.abs(F.col("t") - F.col("at")))
    best = top_within(pairs, ["key", "pid", "at"], [F.col("d"), F.col("t"), F.col("sid")], n)
    return best.select(F.col("pid").alias(probe_id), F.col("at").alias(time), F.col("place").cast("bigint").alias("place"), F.col("sid").alias(point_id), F.col("d").alias("distance_ms"))
