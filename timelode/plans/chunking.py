"""Chunks built from segments, frames and code: windows of every video, filled, labelled and numbered."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from timelode.functions.text import non_empty, truncated
from timelode.operators.nearest import containing
from timelode.operators.scan import row_numbers, running_max
from timelode.plans import timeline as tl
from timelode.plans.enrich import MARGIN_MS, NOTHING, SUMMARY_CHARS, TOPIC_CHARS, join_unique, source_type, sql_collapse, sql_strip, sql_truncated

HOUR_MS = 3_600_000
_KEY = ["video_id", "start_ms", "first_id"]


def _members(spark: SparkSession, d: str, windows: DataFrame) -> DataFrame:
    """Each segment with the window of its video's transcript that it belongs to."""
    opening = windows.select("video_id", F.col("first_id").alias("id"), F.lit(True).alias("opens"))
    rows = tl._segments(spark, d, "text", "confidence").dropna(subset=["video_id", "id", "s", "e"]).dropDuplicates(["video_id", "id"]).withColumn("e", F.greatest("s", "e"))
    rows = rows.join(opening, ["video_id", "id"], "left").withColumn("bucket", F.floor(F.col("s") / HOUR_MS))
    rows = rows.withColumn("first", F.when(F.col("opens"), F.struct("s", "e", "id")))
    held = running_max(rows, ["video_id"], "bucket", ["s", "e", "id"], "first", "window", inclusive=True)
    return held.select("video_id", F.col("window.s").alias("start_ms"), F.col("window.id").alias("first_id"), "s", "e", "id", "text", "confidence")


def build_chunks(spark: SparkSession, d: str) -> DataFrame:
    """The chunks of every video: transcript windows, or event windows where it has no segments, each with the
    distinct texts said and shown in it, its code, labels and mean confidence (in millionths); windows without
    any text or code are dropped, the rest is numbered per video by (start, end)."""
    spoken = tl.transcript_windows(spark, d).select(*_KEY, "end_ms")
    quiet = tl.unheard_windows(spark, d).select("video_id", "start_ms", F.lit("").alias("first_id"), "end_ms")
    windows = spoken.unionByName(quiet)
    spans = windows.select(*_KEY, (F.col("start_ms") - MARGIN_MS).alias("s"), (F.col("end_ms") + MARGIN_MS).alias("e"))
    said = _members(spark, d, spoken)
    shown = tl._frames(spark, d, "ocr_text", "ocr_confidence").where("ocr_text IS NOT NULL AND t IS NOT NULL").select("video_id", "id", "t", "ocr_text", "ocr_confidence").distinct()
    shown = containing(shown, spans, key="video_id", time="t")
    coded = tl._blocks(spark, d, "language", "code", "confidence").where("t IS NOT NULL").select("video_id", "id", "t", "language", "code", "confidence").distinct()
    coded = containing(coded, spans, key="video_id", time="t")

    transcript = join_unique(said, _KEY, "text", ["s", "e", "id"], "transcript")
    screen = join_unique(shown, _KEY, "ocr_text", ["t", "id"], "ocr_text")
    blocks = coded.groupBy(*_KEY).agg(F.array_sort(F.collect_list(F.struct("t", "id", "language", "code"))).alias("blocks"))
    known = [rows.select(*_KEY, F.round(F.col(c) * 1000).cast("bigint").alias("c")) for rows, c in ((said, "confidence"), (shown, "ocr_confidence"), (coded, "confidence"))]
    means = known[0].unionByName(known[1]).unionByName(known[2]).groupBy(*_KEY).agg(F.sum("c").alias("total"), F.count("c").alias("known"))
    means = means.select(*_KEY, F.expr("total * 1000 div nullif(known, 0)").alias("confidence_ppm"))

    rows = windows
    for part in (transcript, screen, blocks, means):
        rows = rows.join(part, _KEY, "left")
    rows = rows.withColumns({c: F.coalesce(c, F.lit("")) for c in ("transcript", "ocr_text")})
    rows = rows.where("transcript <> '' OR ocr_text <> '' OR blocks IS NOT NULL")
    code = F.array_join(F.transform("blocks", lambda b: b["code"]), "\n")
    text = F.coalesce(F.nullif(F.col("transcript"), F.lit("")), F.nullif(F.col("ocr_text"), F.lit("")), code)
    language = F.nullif(F.nullif(F.col("blocks")[0]["language"], F.lit("")), F.lit("other"))
    prefix = F.when(F.col("blocks").isNull(), F.lit("")).otherwise(F.coalesce(F.concat(F.lit("Codice "), language, F.lit(": ")), F.lit("Codice: ")))
    rows = rows.withColumn("summary", F.coalesce(F.nullif(truncated(text, SUMMARY_CHARS), F.lit("")), F.lit(NOTHING)))
    rows = rows.withColumn("topic", truncated(F.concat(prefix, "summary"), TOPIC_CHARS)).withColumn("bucket", F.floor(F.col("start_ms") / HOUR_MS))
    rows = row_numbers(rows, ["video_id"], "bucket", ["start_ms", "end_ms", "first_id"], "ordinal")
    return rows.select(
        F.format_string("%s_chunk_%04d", "video_id", "ordinal").alias("id"), "video_id", "start_ms", "end_ms",
        source_type(F.col("transcript") != "", F.col("ocr_text") != "", F.col("blocks").isNotNull()).alias("source_type"),
        "topic", "summary", "transcript", "ocr_text", F.when(F.col("blocks").isNull(), 0).otherwise(F.size("blocks")).cast("bigint").alias("code_blocks"), "confidence_ppm",
    )


def built_chunks(spark: SparkSession, d: str) -> DataFrame:
    """The chunks built anew, their long texts as hashes."""
    rows = build_chunks(spark, d)
    return rows.select("id", "video_id", "start_ms", "end_ms", "source_type", "topic", "summary", F.sha2("transcript", 256).alias("transcript_hash"), F.sha2("ocr_text", 256).alias("ocr_hash"), "code_blocks", "confidence_ppm")


QUERIES = {"built_chunks": built_chunks}


def _unique(rows: str, text: str, order: str) -> str:
    return f"""SELECT v, ws, wid, string_agg(f[{order.count(',') + 2}], chr(10) || chr(10) ORDER BY f) AS txt FROM (
  SELECT v, ws, wid, {sql_collapse(text)} AS norm, min(({order}, {sql_strip(text)})) AS f FROM {rows} GROUP BY ALL) WHERE norm <> '' GROUP BY ALL"""


SQL = {
    "built_chunks": f"""WITH RECURSIVE {tl.SEGMENTS}, {tl.FRAMES}, {tl.BLOCKS}, {tl.VIDEOS}, src AS (SELECT DISTINCT video_id AS v, id, s, e FROM seg WHERE s IS NOT NULL AND e IS NOT NULL), {tl._sessions_sql('src')}, {tl._EVENTS},
said AS (SELECT p.v, p.ws, p.wid, o.s, o.e, o.id, g.text, g.confidence FROM (SELECT s.v, s.n, w.ws, w.wid FROM sweep s JOIN win w USING (v, w)) p JOIN ordered o USING (v, n)
  JOIN (SELECT DISTINCT video_id, id, text, confidence FROM seg) g ON g.video_id = o.v AND g.id = o.id),
wn AS (SELECT v, ws, wid, we FROM win UNION ALL SELECT v, start_ms, '', end_ms FROM events WHERE v NOT IN (SELECT v FROM src)),
shown AS (SELECT v, ws, wid, f.id, f.t, f.ocr_text, f.ocr_confidence FROM wn JOIN (SELECT DISTINCT video_id, id, t, ocr_text, ocr_confidence FROM fr WHERE ocr_text IS NOT NULL) f ON f.video_id = v AND f.t BETWEEN ws - {MARGIN_MS} AND we + {MARGIN_MS}),
coded AS (SELECT v, ws, wid, b.id, b.t, b.language, b.code, b.confidence FROM wn JOIN (SELECT DISTINCT video_id, id, t, language, code, confidence FROM bl) b ON b.video_id = v AND b.t BETWEEN ws - {MARGIN_MS} AND we + {MARGIN_MS}),
tr AS ({_unique('said', 'text', 's, e, id')}), oc AS ({_unique('shown', 'ocr_text', 't, id')}),
cd AS (SELECT v, ws, wid, count(*) AS n, string_agg(code, chr(10) ORDER BY t, id) AS txt, arg_min((language, 1), (t, id)) AS lang FROM coded GROUP BY ALL),
cf AS (SELECT v, ws, wid, CAST(sum(c) AS BIGINT) * 1000 // nullif(count(c), 0) AS ppm FROM (
  SELECT v, ws, wid, CAST(round(confidence * 1000) AS BIGINT) AS c FROM said UNION ALL SELECT v, ws, wid, CAST(round(ocr_confidence * 1000) AS BIGINT) FROM shown
  UNION ALL SELECT v, ws, wid, CAST(round(confidence * 1000) AS BIGINT) FROM coded) GROUP BY ALL),
j AS (SELECT wn.*, coalesce(tr.txt, '') AS transcript, coalesce(oc.txt, '') AS ocr_text, cd.txt AS code, coalesce(cd.n, 0) AS code_blocks, cd.lang[1] AS lang, ppm
  FROM wn LEFT JOIN tr USING (v, ws, wid) LEFT JOIN oc USING (v, ws, wid) LEFT JOIN cd USING (v, ws, wid) LEFT JOIN cf USING (v, ws, wid)),
k AS (SELECT *, coalesce(nullif(transcript, ''), nullif(ocr_text, ''), code) AS body FROM j WHERE transcript <> '' OR ocr_text <> '' OR code_blocks > 0),
m AS (SELECT *, coalesce(nullif({sql_truncated('body', SUMMARY_CHARS)}, ''), '{NOTHING}') AS summary, row_number() OVER (PARTITION BY v ORDER BY ws, we, wid) AS n FROM k),
z AS (SELECT *, CASE WHEN code_blocks = 0 THEN '' WHEN coalesce(lang, '') IN ('other', '') THEN 'Codice: ' ELSE 'Codice ' || lang || ': ' END || summary AS tp FROM m)
SELECT printf('%s_chunk_%04d', v, n) AS id, v AS video_id, ws AS start_ms, we AS end_ms,
  concat_ws('_', CASE WHEN transcript <> '' THEN 'transcript' END, CASE WHEN ocr_text <> '' THEN 'ocr' END, CASE WHEN code_blocks > 0 THEN 'code' END) AS source_type,
  {sql_truncated('tp', TOPIC_CHARS)} AS topic, summary, sha256(transcript) AS transcript_hash, sha256(ocr_text) AS ocr_hash, code_blocks, ppm AS confidence_ppm FROM z""",
}
