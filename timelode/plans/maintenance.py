"""Queries on the state of the knowledge base: counts, changes, signatures, merges."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from timelode.functions.text import clock, seconds_of_clock, slug
from timelode.operators.maintenance import changes, signatures, update_columns, upsert
from timelode.plans import timeline as tl
from timelode.sources.tables import table

#: Rows of the segments that came in before this instant are the earlier state.
CUT = "2025-08-01 00:00:00"
VIDEO = ("filename", "title", "duration_seconds", "file_hash", "path", "created_at", "file_fingerprint")


def _counted(spark: SparkSession, d: str) -> list[DataFrame]:
    out = []
    for name in ("transcript_segments", "frames", "code_blocks", "chunks"):
        out.append(table(spark, d, name).select("video_id", "id").distinct().groupBy("video_id").agg(F.count("*").alias(name)))
    return out


def video_status(spark: SparkSession, d: str) -> DataFrame:
    """Rows per registered video in each table, 0 where there are none."""
    rows = tl._videos(spark, d).select(F.col("id").alias("video_id")).distinct()
    for counts in _counted(spark, d):
        rows = rows.join(counts, "video_id", "left")
    return rows.select("video_id", *[F.coalesce(c, F.lit(0)).alias(c) for c in rows.columns[1:]])


def unregistered_videos(spark: SparkSession, d: str) -> DataFrame:
    """Videos that other tables mention but that were never registered (an anti join)."""
    named = None
    for counts in _counted(spark, d):
        part = counts.select("video_id")
        named = part if named is None else named.union(part)
    return named.distinct().join(tl._videos(spark, d).select(F.col("id").alias("video_id")), "video_id", "left_anti")


def videos_merged(spark: SparkSession, d: str) -> DataFrame:
    """Registered videos merged with a new scan of those of known duration: title and creation time stay."""
    videos = tl._videos(spark, d, *VIDEO)
    scan = videos.where("duration_seconds IS NOT NULL").withColumns({"title": F.lit(None).cast("string"), "created_at": F.lit("now"), "file_hash": F.sha2("file_hash", 256)})
    known = videos.where("file_fingerprint IS NOT NULL")
    return upsert(known, scan, key="id", keep=["title", "created_at"], fill=["file_fingerprint"])


def file_changes(spark: SparkSession, d: str) -> DataFrame:
    """Files added, removed or modified between a scan with fingerprints and one with durations."""
    videos = tl._videos(spark, d, "title", "duration_seconds", "file_hash", "path", "file_fingerprint")
    old = videos.where("file_fingerprint IS NOT NULL").select("path", F.col("file_hash").alias("value"))
    new = videos.where("duration_seconds IS NOT NULL").select("path", F.when(F.col("title").isNull(), F.sha2("file_hash", 256)).otherwise(F.col("file_hash")).alias("value"))
    return changes(old, new, key="path", value="value")


def _segment_signatures(rows: DataFrame) -> DataFrame:
    distinct = rows.select("id", "video_id", F.round(F.col("start_seconds") * 1000).cast("bigint").alias("s"), "text").distinct()
    return signatures(distinct, "video_id", ["id", "s", "text"])


def transcript_signatures(spark: SparkSession, d: str) -> DataFrame:
    """A signature of each video's transcript."""
    return _segment_signatures(table(spark, d, "transcript_segments"))


def stale_videos(spark: SparkSession, d: str) -> DataFrame:
    """What must be computed again: videos whose transcript differs from the earlier state, or is new."""
    rows = table(spark, d, "transcript_segments")
    before = _segment_signatures(rows.where(F.col("ingested_at") < F.lit(CUT).cast("timestamp_ntz"))).withColumnsRenamed({"rows": "old_rows", "mark": "old_mark"})
    now = _segment_signatures(rows)
    action = F.when(F.col("old_mark").isNull(), "new").when((F.col("mark") == F.col("old_mark")) & (F.col("rows") == F.col("old_rows")), "skip").otherwise("changed")
    return now.join(before, "video_id", "left").select("video_id", action.alias("action"))


def ingest_actions(spark: SparkSession, d: str) -> DataFrame:
    """What to do with each scanned file: skip, refresh the fingerprint, or ingest."""
    videos = tl._videos(spark, d, "duration_seconds", "file_hash", "file_fingerprint")
    known = videos.where("duration_seconds IS NOT NULL").select("id", F.col("file_fingerprint").alias("was"), F.col("file_hash").alias("hash"))
    scan = videos.select("id", F.coalesce("file_fingerprint", F.lit("?")).alias("now"), "file_hash")
    action = F.when(F.col("was") == F.col("now"), "skip").when(F.col("hash") == F.col("file_hash"), "refresh").otherwise("ingest")
    return scan.join(known, "id", "left").select("id", action.alias("action"))


def frames_updated(spark: SparkSession, d: str) -> DataFrame:
    """Frames with screen text and confidence rewritten where the confidence is low, all else untouched."""
    frames = tl._frames(spark, d, "ocr_text", "ocr_confidence", "contains_code").select("id", "video_id", "ocr_text", "ocr_confidence", "contains_code").distinct()
    low = frames.where("ocr_confidence < 0.5").select("id", "video_id", F.lit("").alias("ocr_text"), F.lit(None).cast("double").alias("ocr_confidence"))
    return update_columns(frames, low, keys=["id", "video_id"], columns=["ocr_text", "ocr_confidence"])


def title_slugs(spark: SparkSession, d: str) -> DataFrame:
    """Slugs of the videos' titles and how many videos share each."""
    rows = tl._videos(spark, d, "title", "filename").select("id", slug(F.coalesce("title", "filename")).alias("slug")).distinct()
    return rows.groupBy("slug").agg(F.count("*").alias("videos"), F.min("id").alias("first_id"))


def segment_clocks(spark: SparkSession, d: str) -> DataFrame:
    """Start times as clock texts and back, as counts per text."""
    rows = tl._segments(spark, d).select("id", clock(F.col("s") / 1000).alias("clock")).distinct()
    return rows.groupBy("clock").agg(F.count("*").alias("segments"), F.max(seconds_of_clock(F.col("clock"))).alias("seconds"))


QUERIES = {
    f.__name__: f
    for f in (
        video_status, unregistered_videos, videos_merged, file_changes, transcript_signatures, stale_videos, ingest_actions,
        frames_updated, title_slugs, segment_clocks,
    )
}

_N = "(SELECT video_id, count(DISTINCT id) AS n FROM {0} GROUP BY 1)"
_HASH = "sha256('=' || id || chr(1) || coalesce('=' || CAST(s AS VARCHAR), '-') || chr(1) || coalesce('=' || text, '-'))"
_MARK = " || '-' || ".join(f"CAST(sum(CAST('0x' || substr({_HASH}, {at}, 16) AS UBIGINT)) AS VARCHAR)" for at in (1, 17))
_VI = "v AS (SELECT DISTINCT id, filename, title, duration_seconds, file_hash, path, created_at, file_fingerprint FROM videos)"


def _sig(name: str, where: str = "true") -> str:
    return f"{name} AS (SELECT video_id, count(*) AS rows, {_MARK} AS mark FROM (SELECT DISTINCT id, video_id, CAST(round(start_seconds * 1000) AS BIGINT) AS s, text FROM transcript_segments WHERE {where}) GROUP BY 1)"


_SLUG = "nullif(regexp_replace(regexp_replace(lower(regexp_replace(strip_accents(coalesce(title, filename)), '[^\\x00-\\x7f]', '', 'g')), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), '')"

SQL = {
    "video_status": f"WITH {_VI} SELECT v.id AS video_id, coalesce(a.n, 0) AS transcript_segments, coalesce(b.n, 0) AS frames, coalesce(c.n, 0) AS code_blocks, coalesce(e.n, 0) AS chunks FROM (SELECT DISTINCT id FROM v) v LEFT JOIN {_N.format('transcript_segments')} a ON a.video_id = v.id LEFT JOIN {_N.format('frames')} b ON b.video_id = v.id LEFT JOIN {_N.format('code_blocks')} c ON c.video_id = v.id LEFT JOIN {_N.format('chunks')} e ON e.video_id = v.id",
    "unregistered_videos": "SELECT video_id FROM transcript_segments UNION SELECT video_id FROM frames UNION SELECT video_id FROM code_blocks UNION SELECT video_id FROM chunks EXCEPT SELECT id FROM videos",
    "videos_merged": f"""WITH {_VI}, o AS (SELECT * FROM v WHERE file_fingerprint IS NOT NULL), n AS (SELECT * REPLACE (NULL AS title, 'now' AS created_at, sha256(file_hash) AS file_hash) FROM v WHERE duration_seconds IS NOT NULL)
SELECT coalesce(n.id, o.id) AS id, CASE WHEN n.id IS NOT NULL THEN n.filename ELSE o.filename END AS filename, CASE WHEN o.id IS NOT NULL THEN o.title ELSE n.title END AS title, CASE WHEN n.id IS NOT NULL THEN n.duration_seconds ELSE o.duration_seconds END AS duration_seconds,
CASE WHEN n.id IS NOT NULL THEN n.file_hash ELSE o.file_hash END AS file_hash, CASE WHEN n.id IS NOT NULL THEN n.path ELSE o.path END AS path, CASE WHEN o.id IS NOT NULL THEN o.created_at ELSE n.created_at END AS created_at, coalesce(n.file_fingerprint, o.file_fingerprint) AS file_fingerprint FROM o FULL OUTER JOIN n ON o.id = n.id""",
    "file_changes": f"""WITH {_VI}, o AS (SELECT path, file_hash AS h FROM v WHERE file_fingerprint IS NOT NULL), n AS (SELECT path, CASE WHEN title IS NULL THEN sha256(file_hash) ELSE file_hash END AS h FROM v WHERE duration_seconds IS NOT NULL)
SELECT coalesce(o.path, n.path) AS path, CASE WHEN o.path IS NULL THEN 'added' WHEN n.path IS NULL THEN 'removed' ELSE 'modified' END AS change FROM o FULL OUTER JOIN n ON o.path = n.path WHERE o.path IS NULL OR n.path IS NULL OR o.h IS DISTINCT FROM n.h""",
    "transcript_signatures": f"WITH {_sig('g')} SELECT * FROM g",
    "stale_videos": f"WITH {_sig('b', f'''ingested_at < TIMESTAMP '{CUT}' ''')}, {_sig('n')} SELECT n.video_id, CASE WHEN b.mark IS NULL THEN 'new' WHEN n.mark = b.mark AND n.rows = b.rows THEN 'skip' ELSE 'changed' END AS action FROM n LEFT JOIN b ON b.video_id = n.video_id",
    "ingest_actions": f"WITH {_VI} SELECT s.id, CASE WHEN k.file_fingerprint = coalesce(s.file_fingerprint, '?') THEN 'skip' WHEN k.file_hash = s.file_hash THEN 'refresh' ELSE 'ingest' END AS action FROM v s LEFT JOIN (SELECT * FROM v WHERE duration_seconds IS NOT NULL) k ON k.id = s.id",
    "frames_updated": "SELECT DISTINCT id, video_id, CASE WHEN ocr_confidence < 0.5 THEN '' ELSE ocr_text END AS ocr_text, CASE WHEN ocr_confidence < 0.5 THEN NULL ELSE ocr_confidence END AS ocr_confidence, contains_code FROM frames",
    "title_slugs": f"WITH {_VI}, s AS (SELECT DISTINCT id, {_SLUG} AS slug FROM v) SELECT slug, count(*) AS videos, min(id) AS first_id FROM s GROUP BY slug",
    "segment_clocks": f"WITH {tl.SEGMENTS}, r AS (SELECT DISTINCT id, greatest(0, CAST(CASE WHEN s % 1000 = 500 THEN 2 * ((s // 1000 + 1) // 2) ELSE (s + 500) // 1000 END AS BIGINT)) AS x FROM seg) SELECT printf('%02d:%02d:%02d', x // 3600, (x % 3600) // 60, x % 60) AS clock, count(*) AS segments, max(x) AS seconds FROM r GROUP BY 1",
}
