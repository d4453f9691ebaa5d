"""Queries that fill chunks: interval joins with frames and code, ordered distinct texts, labels, records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from timelode.functions.text import WS, collapse, non_empty, strip, truncated
from timelode.operators.nearest import containing
from timelode.operators.scan import row_numbers
from timelode.plans import timeline as tl

MARGIN_MS, SUMMARY_CHARS, TOPIC_CHARS = 5_000, 220, 80
NOTHING = "Chunk senza testo leggibile."


def _spans(spark: SparkSession, d: str) -> DataFrame:
    rows = tl._chunks(spark, d).where("s IS NOT NULL AND e IS NOT NULL")
    return rows.select("video_id", F.col("id").alias("chunk_id"), (F.col("s") - MARGIN_MS).alias("s"), (F.col("e") + MARGIN_MS).alias("e"))


def _frames_in(spark: SparkSession, d: str) -> DataFrame:
    seen = tl._frames(spark, d, "ocr_text", "ocr_confidence").where("ocr_text IS NOT NULL AND t IS NOT NULL")
    return containing(seen.select("video_id", "id", "t", "ocr_text", "ocr_confidence"), _spans(spark, d), key="video_id", time="t")


def _blocks_in(spark: SparkSession, d: str) -> DataFrame:
    blocks = tl._blocks(spark, d, "language", "code", "confidence").where("t IS NOT NULL")
    return containing(blocks.select("video_id", "id", "t", "language", "code", "confidence"), _spans(spark, d), key="video_id", time="t")


def chunk_contents(spark: SparkSession, d: str) -> DataFrame:
    """Per chunk how many frames with text and code blocks lie within it and its margin. Each side is
    aggregated before they meet, so there is no product of frames and code."""
    frames = _frames_in(spark, d).groupBy("chunk_id").agg(F.countDistinct("id").alias("frames"), F.min("t").alias("first_frame_ms"))
    blocks = _blocks_in(spark, d).groupBy("chunk_id").agg(F.countDistinct("id").alias("blocks"), F.countDistinct("language").alias("languages"))
    ids = _spans(spark, d).select("chunk_id").distinct()
    joined = ids.join(frames, "chunk_id", "left").join(blocks, "chunk_id", "left")
    return joined.select("chunk_id", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("frames", "blocks", "languages")], "first_frame_ms")


def join_unique(df: DataFrame, keys: list[str], text: str, order: list[str], out: str) -> DataFrame:
    """Per key the distinct texts (compared with white space collapsed, the first kept as it stands, blank
    ones skipped) in order, joined by an empty line. Repeats are dropped before texts are gathered."""
    rows = df.withColumn("__norm", collapse(F.col(text))).where("__norm <> ''")
    first = rows.groupBy(*keys, "__norm").agg(F.min(F.struct(*order, strip(F.col(text)).alias("__text"))).alias("__first"))
    return first.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list("__first")), lambda x: x["__text"]), "\n\n").alias(out))


def chunk_screen_text(spark: SparkSession, d: str) -> DataFrame:
    """The distinct screen texts of each chunk in order of time."""
    return join_unique(_frames_in(spark, d), ["chunk_id"], "ocr_text", ["t", "id"], "screen_text")


def chunk_confidence(spark: SparkSession, d: str) -> DataFrame:
    """Per chunk the mean, in millionths, over all known confidences of its segments, frames and code blocks."""
    spans = tl._chunks(spark, d).where("s IS NOT NULL").select("video_id", F.col("id").alias("chunk_id"), "s", "e")
    spoken = tl._segments(spark, d, "confidence").where("s IS NOT NULL").select("video_id", "id", F.col("s").alias("t"), "confidence")
    said = containing(spoken, spans, key="video_id", time="t").select("chunk_id", F.lit("s").alias("k"), "id", "confidence")
    seen = _frames_in(spark, d).select("chunk_id", F.lit("f").alias("k"), "id", F.col("ocr_confidence").alias("confidence"))
    coded = _blocks_in(spark, d).select("chunk_id", F.lit("c").alias("k"), "id", "confidence")
    every = said.unionByName(seen).unionByName(coded).distinct()
    total = F.sum(F.round(F.col("confidence") * 1000).cast("bigint"))  # whole thousandths: the same sum in any order
    means = every.groupBy("chunk_id").agg(total.alias("total"), F.count("confidence").alias("known"))
    return means.select("chunk_id", F.expr("total * 1000 div nullif(known, 0)").alias("confidence_ppm"), "known")


def source_type(transcript: Column, screen: Column, code: Column) -> Column:
    """Which of the three a chunk has, joined by underscores; `empty` for none."""
    parts = F.concat_ws("_", F.when(transcript, "transcript"), F.when(screen, "ocr"), F.when(code, "code"))
    return F.coalesce(F.nullif(parts, F.lit("")), F.lit("empty"))


def chunk_labels(spark: SparkSession, d: str) -> DataFrame:
    """Type, summary and topic of each chunk from what it holds."""
    first = _blocks_in(spark, d).groupBy("chunk_id").agg(F.min(F.struct("t", "id", "language", "code")).alias("b"))
    rows = tl._chunks(spark, d, "transcript", "ocr_text").withColumnRenamed("id", "chunk_id").join(first, "chunk_id", "left")
    text = F.coalesce(non_empty(F.col("transcript")), non_empty(F.col("ocr_text")), non_empty(F.col("b.code")))
    summary = F.coalesce(F.nullif(truncated(text, SUMMARY_CHARS), F.lit("")), F.lit(NOTHING))
    language = F.nullif(F.nullif(F.col("b.language"), F.lit("")), F.lit("other"))
    prefix = F.coalesce(F.concat(F.lit("Codice "), language, F.lit(": ")), F.lit("Codice: "))
    return (
        rows.withColumn("summary_text", summary)
        .select(
            "chunk_id",
            source_type(non_empty(F.col("transcript")).isNotNull(), non_empty(F.col("ocr_text")).isNotNull(), F.col("b").isNotNull()).alias("source_type"),
            F.col("summary_text").alias("summary"),
            truncated(F.concat(F.when(F.col("b").isNotNull(), prefix).otherwise(F.lit("")), F.col("summary_text")), TOPIC_CHARS).alias("topic"),
        )
        .distinct()
    )


def record_texts(spark: SparkSession, d: str) -> DataFrame:
    """record_id, chunk_id, video_id, embedding_type, text: chunks unpivoted into one record per kind of text, the
    code of the blocks within them and all texts together among them, blank ones dropped."""
    blocks = _blocks_in(spark, d).select("chunk_id", "t", "id", "code").where(non_empty(F.col("code")).isNotNull()).distinct()
    code = blocks.groupBy("chunk_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("t", "id", "code"))), lambda x: x["code"]), "\n\n").alias("code"))
    rows = tl._chunks(spark, d, "topic", "summary", "transcript", "ocr_text").select(F.col("id").alias("chunk_id"), "video_id", "summary", "transcript", F.col("ocr_text").alias("ocr"), "topic")
    rows = rows.join(code, "chunk_id", "left")
    combined = F.concat_ws("\n\n", *[F.when(non_empty(F.col(c)).isNotNull(), F.col(c)) for c in ("topic", "summary", "transcript", "ocr", "code")])
    long = rows.withColumn("combined", combined).unpivot(["chunk_id", "video_id"], ["transcript", "ocr", "code", "summary", "combined"], "embedding_type", "text")
    kept = long.withColumn("text", non_empty(F.col("text"))).where("text IS NOT NULL").distinct()
    return kept.select(F.concat_ws("_", "chunk_id", "embedding_type").alias("record_id"), "chunk_id", "video_id", "embedding_type", "text")


def chunk_records(spark: SparkSession, d: str) -> DataFrame:
    """The records of all chunks with their text's hash and length."""
    return record_texts(spark, d).select("record_id", "chunk_id", "embedding_type", F.sha2("text", 256).alias("text_hash"), F.length("text").cast("bigint").alias("chars"))


def all_chunks(spark: SparkSession, d: str) -> DataFrame:
    """The windows of a video in order, then one chunk without length per code block, each kind numbered per video:
    windows by (start, id), code by (time, id) with unknown times first. Rows without a video are left out."""
    at = F.coalesce("t", F.lit(0))
    blocks = tl._blocks(spark, d).select("video_id", F.concat("id", F.lit("_chunk")).alias("chunk_id"), at.alias("start_ms"), at.alias("end_ms"), F.lit("code").alias("kind"), F.coalesce("t", F.lit(-1)).alias("at"))
    windows = tl._chunks(spark, d).select("video_id", F.col("id").alias("chunk_id"), F.col("s").alias("start_ms"), F.col("e").alias("end_ms"), F.lit("window").alias("kind"), F.coalesce("s", F.lit(-1)).alias("at"))
    rows = windows.distinct().unionByName(blocks.distinct()).where("video_id IS NOT NULL").withColumn("bucket", F.floor(F.col("at") / 3_600_000))
    return row_numbers(rows, ["video_id", "kind"], "bucket", ["at", "chunk_id"], "ordinal").select("video_id", "chunk_id", "start_ms", "end_ms", "kind", "ordinal")


QUERIES = {f.__name__: f for f in (chunk_contents, chunk_screen_text, chunk_confidence, chunk_labels, chunk_records, all_chunks)}

_WS = WS
_IN = f"""{tl.FRAMES}, {tl.BLOCKS}, {tl.CHUNKS}, {tl.SEGMENTS},
sp AS (SELECT DISTINCT video_id, id AS chunk_id, s - {MARGIN_MS} AS s, e + {MARGIN_MS} AS e FROM ch WHERE s IS NOT NULL AND e IS NOT NULL),
fi AS (SELECT DISTINCT chunk_id, id, t, ocr_text, ocr_confidence FROM fr JOIN sp USING (video_id) WHERE ocr_text IS NOT NULL AND t BETWEEN s AND e),
bi AS (SELECT DISTINCT chunk_id, id, t, language, code, confidence FROM bl JOIN sp USING (video_id) WHERE t BETWEEN s AND e)"""


def sql_strip(c: str) -> str:
    return f"regexp_replace({c}, '^{_WS}+|{_WS}+$', '', 'g')"


def sql_collapse(c: str) -> str:
    return sql_strip(f"regexp_replace({c}, '{_WS}+', ' ', 'g')")


def sql_truncated(c: str, most: int) -> str:
    whole = sql_collapse(c)
    return f"CASE WHEN length({whole}) <= {most} THEN {whole} ELSE regexp_replace(substr({whole}, 1, {most - 3}), ' +$', '') || '...' END"


def sql_non_empty(c: str) -> str:
    return f"nullif({sql_strip(c)}, '')"


def _part(c: str) -> str:
    return f"CASE WHEN {sql_non_empty(c)} IS NOT NULL THEN {c} END"


RECORDS = f"""{_IN}, cd AS (SELECT chunk_id, string_agg(code, chr(10) || chr(10) ORDER BY t, id) AS code FROM (SELECT DISTINCT chunk_id, t, id, code FROM bi WHERE {sql_non_empty('code')} IS NOT NULL) GROUP BY 1),
cc AS (SELECT DISTINCT ch.id, ch.video_id, topic, summary, transcript, ocr_text, code FROM ch LEFT JOIN cd ON cd.chunk_id = ch.id),
lo AS (SELECT id, video_id, 'transcript' AS embedding_type, transcript AS text FROM cc UNION SELECT id, video_id, 'ocr', ocr_text FROM cc UNION SELECT id, video_id, 'summary', summary FROM cc UNION SELECT id, video_id, 'code', code FROM cc
  UNION SELECT id, video_id, 'combined', concat_ws(chr(10) || chr(10), {', '.join(_part(c) for c in ('topic', 'summary', 'transcript', 'ocr_text', 'code'))}) FROM cc),
rec AS (SELECT DISTINCT id || '_' || embedding_type AS record_id, id AS chunk_id, video_id, embedding_type, {sql_non_empty('text')} AS text FROM lo WHERE {sql_non_empty('text')} IS NOT NULL)"""

SQL = {
    "chunk_contents": f"""WITH {_IN} SELECT sp.chunk_id, coalesce(max(f.n), 0) AS frames, coalesce(max(b.n), 0) AS blocks, coalesce(max(b.l), 0) AS languages, max(f.m) AS first_frame_ms
FROM (SELECT DISTINCT chunk_id FROM sp) sp LEFT JOIN (SELECT chunk_id, count(DISTINCT id) AS n, min(t) AS m FROM fi GROUP BY 1) f USING (chunk_id)
LEFT JOIN (SELECT chunk_id, count(DISTINCT id) AS n, count(DISTINCT language) AS l FROM bi GROUP BY 1) b USING (chunk_id) GROUP BY sp.chunk_id""",
    "chunk_screen_text": f"""WITH {_IN}, n AS (SELECT chunk_id, {sql_collapse('ocr_text')} AS norm, min((t, id, {sql_strip('ocr_text')})) AS f FROM fi GROUP BY 1, 2)
SELECT chunk_id, string_agg(f[3], chr(10) || chr(10) ORDER BY f) AS screen_text FROM n WHERE norm <> '' GROUP BY chunk_id""",
    "chunk_confidence": f"""WITH {_IN}, a AS (
  SELECT ch.id AS chunk_id, 's' AS k, seg.id, confidence FROM seg JOIN ch ON seg.video_id = ch.video_id AND seg.s BETWEEN ch.s AND ch.e
  UNION SELECT chunk_id, 'f', id, ocr_confidence FROM fi UNION SELECT chunk_id, 'c', id, confidence FROM bi)
SELECT chunk_id, CAST(sum(CAST(round(confidence * 1000) AS BIGINT)) AS BIGINT) * 1000 // nullif(count(confidence), 0) AS confidence_ppm, count(confidence) AS known FROM a GROUP BY chunk_id""",
    "chunk_labels": f"""WITH {_IN}, b AS (SELECT chunk_id, arg_min((t, id, language, code), (t, id)) AS b FROM bi GROUP BY 1),
r AS (SELECT ch.*, b.b IS NOT NULL AS coded, b.b[3] AS lang, coalesce({sql_non_empty('transcript')}, {sql_non_empty('ocr_text')}, {sql_non_empty('b.b[4]')}) AS body FROM ch LEFT JOIN b ON b.chunk_id = ch.id),
q AS (SELECT *, coalesce(nullif({sql_truncated('body', SUMMARY_CHARS)}, ''), '{NOTHING}') AS sm FROM r),
z AS (SELECT *, CASE WHEN coded AND coalesce(lang, '') IN ('other', '') THEN 'Codice: ' WHEN coded THEN 'Codice ' || lang || ': ' ELSE '' END || sm AS tp FROM q)
SELECT DISTINCT id AS chunk_id, coalesce(nullif(concat_ws('_', CASE WHEN {sql_non_empty('transcript')} IS NOT NULL THEN 'transcript' END, CASE WHEN {sql_non_empty('ocr_text')} IS NOT NULL THEN 'ocr' END, CASE WHEN coded THEN 'code' END), ''), 'empty') AS source_type,
sm AS summary, {sql_truncated('tp', TOPIC_CHARS)} AS topic FROM z""",
    "chunk_records": f"WITH {RECORDS} SELECT record_id, chunk_id, embedding_type, sha256(text) AS text_hash, length(text) AS chars FROM rec",
    "all_chunks": f"""WITH {tl.CHUNKS}, {tl.BLOCKS}, a AS (SELECT DISTINCT video_id, id AS chunk_id, s AS start_ms, e AS end_ms, 'window' AS kind, coalesce(s, -1) AS pos FROM ch
  UNION ALL SELECT DISTINCT video_id, id || '_chunk', coalesce(t, 0), coalesce(t, 0), 'code', coalesce(t, -1) FROM bl)
SELECT video_id, chunk_id, start_ms, end_ms, kind, row_number() OVER (PARTITION BY video_id, kind ORDER BY pos, chunk_id) AS ordinal FROM a WHERE video_id IS NOT NULL""",
}
