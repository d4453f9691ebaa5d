"""Matching records by nearest time: an interval index over the right side, probed by the left side.

Each right-side time owns the stretch of the timeline in which it is the nearest one: bounded by the
midpoints to its neighbours and by the tolerance. A left row falls into at most one stretch of an entity,
so the join needs no ranking and no pair beyond its results. Stretches are indexed by (entity, time bin).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from timelode.sources.tables import media_ms, records

#: Width of a bin of the index, in ms. At least twice any sensible tolerance.
BIN_MS = 60_000


def nearest_stretches(
    right: DataFrame, keys: Sequence[str], time_ms: Column, row_id: Column, *, tolerance_ms: int, bin_ms: int = BIN_MS
) -> DataFrame:
    """One row per distinct (entity, time): __k0.., __t, match_id (the smallest id at that time) and the
    stretch `__low < 2 * left time <= __high` (doubled, so that midpoints are whole numbers). Each row is
    repeated for every bin its stretch meets (`__bin`).

    Neighbours further away than twice the tolerance can't shorten a stretch, so a window over one bin
    with copies from the nearest margin of its neighbour bins sees all that matter: an entity that holds a
    third of all rows is spread over its bins.
    """
    ks = [f"__k{i}" for i in range(len(keys))]
    reach = 2 * tolerance_ms
    times = (
        right.select(*[F.col(f"`{k}`").alias(a) for k, a in zip(keys, ks, strict=True)], time_ms.alias("__t"), row_id.alias("match_id"))
        .dropna(subset=[*ks, "__t", "match_id"])
        .groupBy(*ks, "__t")
        .agg(F.min("match_id").alias("match_id"))
    )
    home = F.floor(F.col("__t") / bin_ms)
    seen = times.withColumn("__home", home).withColumn(
        "__bin", F.explode(F.sequence(F.floor((F.col("__t") - reach) / bin_ms), F.floor((F.col("__t") + reach) / bin_ms)))
    )
    order = Window.partitionBy(*ks, "__bin").orderBy("__t")
    t2 = 2 * F.col("__t")
    low = F.greatest(t2 - 2 * tolerance_ms - 1, F.col("__t") + F.lag("__t").over(order))
    high = F.least(t2 + 2 * tolerance_ms, F.col("__t") + F.lead("__t").over(order))
    own = seen.select(*ks, "__t", "match_id", "__home", "__bin", low.alias("__low"), high.alias("__high")).where("__bin = __home")
    first, last = F.floor((F.col("__low") + 1) / (2 * bin_ms)), F.floor(F.col("__high") / (2 * bin_ms))
    return own.drop("__home", "__bin").withColumn("__bin", F.explode(F.sequence(first, last)))


def match_nearest(
    left: DataFrame,
    right: DataFrame,
    *,
    keys: Sequence[str],
    left_id: str,
    left_ms: Column,
    right_id: str,
    right_ms: Column,
    tolerance_ms: int,
    bin_ms: int = BIN_MS,
) -> DataFrame:
    """left_id, match_id, distance_ms: for each left row the right row of the same keys that is nearest in
    time, at most `tolerance_ms` away. Of equally near ones the earlier counts; at one time the smaller id.

    Left rows with a NULL key, id or time, or with nothing near enough, give no row; equal left rows
    count once; right rows with a NULL key, id or time match nothing; an empty side gives no row. Further
    columns of either side are ignored, so their names can't clash.
    """
    if bin_ms < 2 * tolerance_ms:
        raise ValueError("a bin must be at least twice the tolerance wide")
    ks = [f"__k{i}" for i in range(len(keys))]
    probes = (
        left.select(
            *[F.col(f"`{k}`").alias(a) for k, a in zip(keys, ks, strict=True)],
            F.col(f"`{left_id}`").alias("__left_id"),
            left_ms.alias("__left_t"),
        )
        .dropna()
        .distinct()
        .withColumn("__bin", F.floor(F.col("__left_t") / bin_ms))
    )
    index = nearest_stretches(right, keys, right_ms, F.col(f"`{right_id}`"), tolerance_ms=tolerance_ms, bin_ms=bin_ms)
    within = (2 * F.col("__left_t") > F.col("__low")) & (2 * F.col("__left_t") <= F.col("__high"))
    return (
        probes.join(index, [*ks, "__bin"])
        .where(within)
        .select(F.col("__left_id").alias("left_id"), "match_id", F.abs(F.col("__left_t") - F.col("__t")).alias("distance_ms"))
    )


FRAME_TOLERANCE_MS, SEGMENT_TOLERANCE_MS = 1_500, 2_500


def _matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    blocks = records(spark, sf_dir, "code_blocks", "id", "video_id", "timestamp_seconds")
    frames = records(spark, sf_dir, "frames", "id", "video_id", "timestamp_seconds")
    segments = records(spark, sf_dir, "transcript_segments", "id", "video_id", "start_seconds")
    out = []
    for relation, right, at, tolerance in (
        ("frame", frames, "timestamp_seconds", FRAME_TOLERANCE_MS),
        ("segment", segments, "start_seconds", SEGMENT_TOLERANCE_MS),
    ):
        found = match_nearest(
            blocks, right, keys=["video_id"], left_id="id", left_ms=media_ms("timestamp_seconds"),
            right_id="id", right_ms=media_ms(at), tolerance_ms=tolerance,
        )
        out.append(found.select(F.lit(relation).alias("relation"), F.col("left_id").alias("code_block_id"), "match_id", "distance_ms"))
    return out[0].unionByName(out[1])


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each code block with a time, the nearest frame and the nearest segment of its video."""
    return _matches(spark, sf_dir).select("relation", "code_block_id", "match_id").distinct()


def p5_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far the matches are, by relation and tenth of a second."""
    tenth = F.floor(F.col("distance_ms") / 100).alias("tenth")
    return _matches(spark, sf_dir).groupBy("relation", tenth).agg(F.countDistinct("code_block_id").alias("code_blocks"))


QUERIES = {"p5_found": p5_found, "p5_distances": p5_distances}

_MATCHES = f"""
WITH blocks AS (SELECT DISTINCT id, video_id, CAST(round(timestamp_seconds * 1000) AS BIGINT) AS t FROM code_blocks WHERE timestamp_seconds IS NOT NULL),
rights AS (
  SELECT DISTINCT 'frame' AS relation, id, video_id, CAST(round(timestamp_seconds * 1000) AS BIGINT) AS t, {FRAME_TOLERANCE_MS} AS tol FROM frames
  UNION SELECT 'segment', id, video_id, CAST(round(start_seconds * 1000) AS BIGINT), {SEGMENT_TOLERANCE_MS} FROM transcript_segments),
ranked AS (
  SELECT relation, b.id AS code_block_id, r.id AS match_id, abs(b.t - r.t) AS distance_ms,
    row_number() OVER (PARTITION BY relation, b.id, b.t ORDER BY abs(b.t - r.t), r.t, r.id) AS rn
  FROM blocks b JOIN rights r ON r.video_id = b.video_id AND abs(b.t - r.t) <= r.tol)
"""
SQL = {
    "p5_found": _MATCHES + "SELECT DISTINCT relation, code_block_id, match_id FROM ranked WHERE rn = 1",
    "p5_distances": _MATCHES
    + "SELECT relation, distance_ms // 100 AS tenth, count(DISTINCT code_block_id) AS code_blocks FROM ranked WHERE rn = 1 GROUP BY ALL",
}
