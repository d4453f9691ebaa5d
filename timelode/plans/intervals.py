"""Queries of the interval operator over both tracks of the media timeline."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from timelode.operators.intervals import continuous_periods, gaps_between
from timelode.sources.tables import media_ms, table

TRACKS = ("transcript_segments", "chunks")
GAP_AT_LEAST_MS, GAP_BELOW_MS = 2_000, 900_000


def periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    tracks = [
        table(spark, sf_dir, t).select(F.lit(t).alias("track"), "video_id", "start_seconds", "end_seconds") for t in TRACKS
    ]
    return continuous_periods(
        tracks[0].unionByName(tracks[1]), ["track", "video_id"], media_ms("start_seconds"), media_ms("end_seconds")
    )


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Holes of 2 s to 15 min between the covered periods of each video and track."""
    return gaps_between(periods(spark, sf_dir), at_least_ms=GAP_AT_LEAST_MS, below_ms=GAP_BELOW_MS)


def p3_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All continuous covered periods of each video and track."""
    return periods(spark, sf_dir).select("track", "video_id", "start_ms", "end_ms")


QUERIES = {"p3_found": p3_found, "p3_periods": p3_periods}

_SPANS = """
WITH raw AS (
  SELECT 'transcript_segments' AS track, video_id, start_seconds, end_seconds FROM transcript_segments
  UNION ALL SELECT 'chunks', video_id, start_seconds, end_seconds FROM chunks),
spans AS (
  SELECT DISTINCT track, video_id, CAST(round(start_seconds * 1000) AS BIGINT) AS s, CAST(round(end_seconds * 1000) AS BIGINT) AS e FROM raw),
seen AS (
  SELECT *, max(e) OVER (PARTITION BY track, video_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach
  FROM spans WHERE e > s)
"""

SQL = {
    "p3_found": _SPANS
    + f"""SELECT track, video_id, reach AS gap_start_ms, s AS gap_end_ms FROM seen
WHERE s - reach >= {GAP_AT_LEAST_MS} AND s - reach < {GAP_BELOW_MS}""",
    "p3_periods": _SPANS
    + """, islands AS (
  SELECT *, sum(CASE WHEN reach IS NULL OR s > reach THEN 1 ELSE 0 END) OVER (PARTITION BY track, video_id ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS island FROM seen)
SELECT track, video_id, min(s) AS start_ms, max(e) AS end_ms FROM islands GROUP BY track, video_id, island""",
}
