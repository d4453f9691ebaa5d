"""Queries on the media timeline: windows, candidates for frames, sweeps, lookups by time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from timelode.operators.chains import distinct_frames, event_windows, sessions, spaced
from timelode.operators.nearest import binned, containing, nearest_points, nearest_span, top_within
from timelode.operators.scan import running_max
from timelode.sources.tables import media_ms, records

# Bounds of windows, pause, margin; distance of the grid, least gap, most frames, reach of a match;
# words that mark a moment worth a frame; bits and brightness by which two near-duplicates differ at most.
MIN_WINDOW_MS, MAX_WINDOW_MS, PAUSE_MS, MARGIN_MS = 90_000, 480_000, 8_000, 5_000
GRID_MS, GAP_MS, MAX_FRAMES, MATCH_MS = 8_000, 2_000, 2_000, 100
KEYWORDS = (
    "codice", "comando", "terminale", "funzione", "classe", "file",
    "configurazione", "errore", "copiamo", "incolliamo", "eseguiamo",
)
HASH_MOST, BRIGHTNESS_MOST = 4, 10


# Readers of one row per record: the key, the times in ms and only the further columns that are named, since the
# distinct that drops repeated records would carry every column it is given through its shuffle.
def _segments(spark: SparkSession, d: str, *more: str) -> DataFrame:
    rows = records(spark, d, "transcript_segments", "id", "video_id", "start_seconds", "end_seconds", *more)
    return rows.withColumn("s", media_ms("start_seconds")).withColumn("e", media_ms("end_seconds"))


def _frames(spark: SparkSession, d: str, *more: str) -> DataFrame:
    return records(spark, d, "frames", "id", "video_id", "timestamp_seconds", *more).withColumn("t", media_ms("timestamp_seconds"))


def _blocks(spark: SparkSession, d: str, *more: str) -> DataFrame:
    return records(spark, d, "code_blocks", "id", "video_id", "timestamp_seconds", *more).withColumn("t", media_ms("timestamp_seconds"))


def _chunks(spark: SparkSession, d: str, *more: str) -> DataFrame:
    rows = records(spark, d, "chunks", "id", "video_id", "start_seconds", "end_seconds", *more)
    return rows.withColumn("s", media_ms("start_seconds")).withColumn("e", media_ms("end_seconds"))


def _videos(spark: SparkSession, d: str, *more: str) -> DataFrame:
    return records(spark, d, "videos", "id", *more)


def transcript_windows(spark: SparkSession, d: str) -> DataFrame:
    """Greedy windows of each video's transcript, bounded by duration and pauses."""
    return sessions(
        _segments(spark, d), key="video_id", row_id="id", start="s", end="e", min_ms=MIN_WINDOW_MS, max_ms=MAX_WINDOW_MS, pause_ms=PAUSE_MS
    ).select("video_id", "start_ms", "first_id", "end_ms", F.col("rows").alias("segments"))


def _events(spark: SparkSession, d: str) -> DataFrame:
    frames = _frames(spark, d, "ocr_text").where("ocr_text IS NOT NULL").select("video_id", "t")
    return frames.unionByName(_blocks(spark, d).select("video_id", "t")).dropna().distinct()


def event_sessions(spark: SparkSession, d: str) -> DataFrame:
    """Windows over the distinct times of screen text and code: no pause ends them, each starts the margin
    early, the last of a video has the least duration, all are clipped to the video."""
    found = event_windows(_events(spark, d), key="video_id", time="t", min_ms=MIN_WINDOW_MS, max_ms=MAX_WINDOW_MS, margin_ms=MARGIN_MS)
    lengths = _videos(spark, d, "duration_seconds").select(F.col("id").alias("video_id"), media_ms("duration_seconds").alias("duration_ms")).distinct()
    return found.join(lengths, "video_id", "left").select(
        "video_id", "start_ms", F.least("end_ms", F.coalesce("duration_ms", "end_ms")).alias("end_ms"), F.col("rows").alias("events")
    )


def media_windows(spark: SparkSession, d: str) -> DataFrame:
    """The windows of every video: of its transcript, or where it has no segments, of its events."""
    spoken = transcript_windows(spark, d).select("video_id", "start_ms", "end_ms", F.lit("transcript").alias("source"), F.col("segments").alias("rows"))
    return spoken.unionByName(unheard_windows(spark, d).select("video_id", "start_ms", "end_ms", F.lit("events").alias("source"), F.col("events").alias("rows")))


def unheard_windows(spark: SparkSession, d: str) -> DataFrame:
    """The event windows of the videos without segments."""
    heard = _segments(spark, d).dropna(subset=["video_id", "id", "s", "e"]).select("video_id").distinct()
    return event_sessions(spark, d).join(heard, "video_id", "left_anti")


def _grid(spark: SparkSession, d: str) -> DataFrame:
    lengths = _videos(spark, d, "duration_seconds").select(F.col("id").alias("video_id"), media_ms("duration_seconds").alias("duration_ms")).where("duration_ms > 0").distinct()
    return lengths.select("video_id", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("duration_ms") - 1, F.lit(GRID_MS).cast("bigint"))).alias("t"))


def interval_grid(spark: SparkSession, d: str) -> DataFrame:
    """The regular times at which frames are wanted, below each video's duration."""
    return _grid(spark, d)


def _has_keyword(text: Column) -> Column:
    return F.lower(text).rlike("|".join(KEYWORDS))


def keyword_midpoints(spark: SparkSession, d: str) -> DataFrame:
    """The middle of each segment whose text has one of the keywords."""
    return _segments(spark, d, "text").where(_has_keyword(F.col("text"))).select("video_id", "id", F.expr("(s + e) div 2").alias("t")).dropna()


def _candidates(spark: SparkSession, d: str) -> DataFrame:
    grid = _grid(spark, d).withColumn("priority", F.lit(0))
    scene = _frames(spark, d, "contains_code").where("contains_code").select("video_id", "t").dropna().withColumn("priority", F.lit(1))
    words = keyword_midpoints(spark, d).select("video_id", "t").withColumn("priority", F.lit(2))
    return grid.unionByName(scene).unionByName(words)


def frame_candidates(spark: SparkSession, d: str) -> DataFrame:
    """Grid, scene and keyword times merged by minimum gap and priority."""
    return spaced(_candidates(spark, d), key="video_id", time="t", priority="priority", gap_ms=GAP_MS)


def frames_selected(spark: SparkSession, d: str) -> DataFrame:
    """The candidates of each video, the most important first where there are more than the cap."""
    kept = top_within(frame_candidates(spark, d), ["video_id"], [F.desc("priority"), F.col("t")], MAX_FRAMES)
    return kept.select("video_id", "t", "priority")


def hash_distance(a: Column, b: Column) -> Column:
    """Differing bits of two spatial hashes of 16 hexadecimal digits."""
    return F.bit_count(F.conv(F.substring(a, 1, 16), 16, -10).cast("bigint").bitwiseXOR(F.conv(F.substring(b, 1, 16), 16, -10).cast("bigint")))


def frame_hash_steps(spark: SparkSession, d: str) -> DataFrame:
    """For each frame of a video but the first by how many bits its picture hash differs from the one before."""
    rows = _frames(spark, d, "perceptual_hash").where("perceptual_hash IS NOT NULL AND t IS NOT NULL AND video_id IS NOT NULL")
    rows = rows.withColumn("bucket", F.floor(F.col("t") / 3_600_000)).withColumn("me", F.struct("t", "id", "perceptual_hash"))
    pairs = running_max(rows, ["video_id"], "bucket", ["t", "id"], "me", "before").where("before IS NOT NULL")
    return pairs.select("id", hash_distance(F.col("before.perceptual_hash"), F.col("perceptual_hash")).cast("bigint").alias("bits"))


def frame_sweep(spark: SparkSession, d: str) -> DataFrame:
    """Frames left after near-duplicates of the last kept frame are dropped. Frames taken for the regular grid
    always stay; so do frames without a usable picture hash, as nothing shows them to be near-duplicates (they
    are compared with none)."""
    frames = _frames(spark, d, "perceptual_hash").where("video_id IS NOT NULL AND t IS NOT NULL")
    usable = F.coalesce(F.col("perceptual_hash").rlike("^[0-9a-fA-F]{16,}$"), F.lit(False))
    grid = frame_candidates(spark, d).where("priority = 0").select("video_id", (F.col("t") - MATCH_MS).alias("s"), (F.col("t") + MATCH_MS).alias("e"))
    on_grid = containing(frames.select("video_id", "id", "t"), grid, key="video_id", time="t").select("video_id", "id", F.lit(True).alias("pinned")).distinct()
    rows = frames.where(usable).join(on_grid, ["video_id", "id"], "left").select(
        "video_id", "id", "t", "pinned", F.conv(F.substring("perceptual_hash", 1, 16), 16, -10).cast("bigint").alias("hash"),
        F.when(F.length("perceptual_hash") >= 18, F.conv(F.substring("perceptual_hash", 17, 2), 16, 10).cast("int")).alias("brightness"),
    )
    kept = distinct_frames(
        rows, key="video_id", row_id="id", time="t", hash_="hash", brightness="brightness", pinned="pinned", most_bits=HASH_MOST, most_brightness=BRIGHTNESS_MOST
    )
    return kept.select("video_id", "id", "t").unionByName(frames.where(~usable).select("video_id", "id", "t").distinct())


def match_frames(spark: SparkSession, d: str) -> DataFrame:
    """For each wanted time of the grid the extracted frame nearest to it within the match window, the
    earlier of two."""
    wanted = _grid(spark, d).withColumnRenamed("t", "want")
    spans = _frames(spark, d).where("t IS NOT NULL").select("video_id", "id", "t", (F.col("t") - MATCH_MS).alias("s"), (F.col("t") + MATCH_MS).alias("e"))
    pairs = containing(wanted, spans, key="video_id", time="want")
    best = pairs.groupBy("video_id", "want").agg(F.min(F.struct(F.abs(F.col("t") - F.col("want")).alias("d"), "t", "id")).alias("m"))
    return best.select("video_id", "want", F.col("m.id").alias("frame_id"), F.col("m.t").alias("t"))


def _probes(spark: SparkSession, d: str) -> DataFrame:
    return _blocks(spark, d).select("video_id", F.col("id").alias("block_id"), "t").dropna()


def inspect_segment(spark: SparkSession, d: str) -> DataFrame:
    """For each code block's time the transcript segment that holds it or lies nearest."""
    spans = _segments(spark, d).select("video_id", F.col("id").alias("segment_id"), "s", "e")
    return nearest_span(_probes(spark, d), spans, key="video_id", probe_id="block_id", time="t", span_id="segment_id")


def inspect_chunk(spark: SparkSession, d: str) -> DataFrame:
    """For each code block's time the chunk that holds it or lies nearest."""
    spans = _chunks(spark, d).select("video_id", F.col("id").alias("chunk_id"), "s", "e")
    return nearest_span(_probes(spark, d), spans, key="video_id", probe_id="block_id", time="t", span_id="chunk_id")


def inspect_frame(spark: SparkSession, d: str) -> DataFrame:
    """For each code block's time the nearest frame: a span without length."""
    spans = _frames(spark, d).select("video_id", F.col("id").alias("frame_id"), F.col("t").alias("s"), F.col("t").alias("e"))
    return nearest_span(_probes(spark, d), spans, key="video_id", probe_id="block_id", time="t", span_id="frame_id")


def inspect_code(spark: SparkSession, d: str) -> DataFrame:
    """For each chunk the three code blocks of its video nearest to its start, however far."""
    probes = _chunks(spark, d).select("video_id", F.col("id").alias("chunk_id"), F.col("s").alias("at"))
    best = nearest_points(probes, _blocks(spark, d), key="video_id", probe_id="chunk_id", time="at", point_id="id", n=3)
    return best.select("chunk_id", "place", F.col("id").alias("block_id"), "distance_ms")


def block_chunk(spark: SparkSession, d: str) -> DataFrame:
    """For each code block with a time the first chunk, by id, that contains it; NULL where none does."""
    spans = _chunks(spark, d).select("video_id", F.col("id").alias("chunk_id"), "s", "e")
    first = containing(_probes(spark, d), spans, key="video_id", time="t").groupBy("block_id").agg(F.min("chunk_id").alias("chunk_id"))
    return _probes(spark, d).select("block_id").distinct().join(first, "block_id", "left")


def blocks_in_sources(spark: SparkSession, d: str) -> DataFrame:
    """Code blocks that lie within a chunk whose text mentions a script, each once (a semi join)."""
    sources = _chunks(spark, d, "transcript").where("lower(coalesce(transcript, '')) LIKE '%script%'").select("video_id", "s", "e")
    blocks = _probes(spark, d).withColumn("bin", F.floor(F.col("t") / 60_000))
    index = binned(sources, "s", "e").withColumnsRenamed({"__bin": "bin", "video_id": "v"})
    inside = (F.col("video_id") == F.col("v")) & (blocks["bin"] == index["bin"]) & F.col("t").between(F.col("s"), F.col("e"))
    return blocks.join(index, inside, "left_semi").select("block_id", "video_id", "t")


QUERIES = {
    f.__name__: f
    for f in (
        transcript_windows, event_sessions, media_windows, interval_grid, keyword_midpoints, frame_candidates, frames_selected, frame_hash_steps,
        frame_sweep, match_frames, inspect_segment, inspect_chunk, inspect_frame, inspect_code, block_chunk, blocks_in_sources,
    )
}


def _ms(c: str) -> str:
    return f"CAST(round({c} * 1000) AS BIGINT)"


SEGMENTS = f"seg AS (SELECT DISTINCT id, video_id, {_ms('start_seconds')} AS s, {_ms('end_seconds')} AS e, text, confidence FROM transcript_segments)"
FRAMES = f"fr AS (SELECT DISTINCT id, video_id, {_ms('timestamp_seconds')} AS t, perceptual_hash, ocr_text, ocr_confidence, contains_code FROM frames)"
BLOCKS = f"bl AS (SELECT DISTINCT id, video_id, {_ms('timestamp_seconds')} AS t, language, code, source, confidence, verified FROM code_blocks)"
CHUNKS = f"ch AS (SELECT DISTINCT id, video_id, {_ms('start_seconds')} AS s, {_ms('end_seconds')} AS e, topic, summary, transcript, ocr_text FROM chunks)"
VIDEOS = f"vi AS (SELECT DISTINCT id, filename, title, {_ms('duration_seconds')} AS duration_ms, file_hash, path, created_at, file_fingerprint FROM videos)"
GRID = f"grid AS (SELECT id AS video_id, CAST(unnest(generate_series(0, duration_ms - 1, {GRID_MS})) AS BIGINT) AS t FROM (SELECT DISTINCT id, duration_ms FROM vi WHERE duration_ms > 0))"


def _sessions_sql(source: str) -> str:
    """Recursive sweep over `source`(v, id, s, e)."""
    return f"""ordered AS (SELECT v, id, s, greatest(s, e) AS e, row_number() OVER (PARTITION BY v ORDER BY s, greatest(s, e), id) AS n FROM {source}),
sweep AS (
  SELECT v, n, s AS ws, id AS wid, e AS we, 1 AS w FROM ordered WHERE n = 1
  UNION ALL
  SELECT o.v, o.n,
    CASE WHEN p.we - p.ws >= {MIN_WINDOW_MS} AND (o.e - p.ws > {MAX_WINDOW_MS} OR o.s - p.we >= {PAUSE_MS}) THEN o.s ELSE p.ws END,
    CASE WHEN p.we - p.ws >= {MIN_WINDOW_MS} AND (o.e - p.ws > {MAX_WINDOW_MS} OR o.s - p.we >= {PAUSE_MS}) THEN o.id ELSE p.wid END,
    o.e,
    CASE WHEN p.we - p.ws >= {MIN_WINDOW_MS} AND (o.e - p.ws > {MAX_WINDOW_MS} OR o.s - p.we >= {PAUSE_MS}) THEN p.w + 1 ELSE p.w END
  FROM sweep p JOIN ordered o ON o.v = p.v AND o.n = p.n + 1),
win AS (SELECT v, w, min(ws) AS ws, min(wid) AS wid, arg_max(we, n) AS we, count(*) AS c FROM sweep GROUP BY v, w)"""


def _nearest_sql(spans: str, ctes: str, out: str) -> str:
    return f"""WITH {BLOCKS}, {ctes}, p AS (SELECT DISTINCT id AS block_id, video_id, t FROM bl WHERE t IS NOT NULL), sp AS ({spans}),
r AS (SELECT block_id, sid, CASE WHEN t BETWEEN s AND e THEN 0 ELSE least(abs(t - s), abs(t - e)) END AS distance_ms, s FROM p JOIN sp USING (video_id) WHERE e >= s)
SELECT block_id, arg_min(sid, (distance_ms, s, sid)) AS {out}, min(distance_ms) AS distance_ms FROM r GROUP BY block_id"""


_CANDIDATES = f"""{VIDEOS}, {FRAMES}, {SEGMENTS}, {GRID},
cand AS (
  SELECT video_id AS v, t, 0 AS p FROM grid
  UNION SELECT video_id, t, 1 FROM fr WHERE contains_code AND t IS NOT NULL
  UNION SELECT video_id, (s + e) // 2, 2 FROM seg WHERE regexp_matches(lower(text), '{"|".join(KEYWORDS)}') AND s + e IS NOT NULL),
o AS (SELECT v, t, p, row_number() OVER (PARTITION BY v ORDER BY t, p) AS n FROM cand),
sweep AS (
  SELECT v, n, t, p, n AS k FROM o WHERE n = 1
  UNION ALL
  SELECT o.v, o.n, CASE WHEN o.t - s.t < {GAP_MS} AND o.p <= s.p THEN s.t ELSE o.t END, CASE WHEN o.t - s.t < {GAP_MS} AND o.p <= s.p THEN s.p ELSE o.p END,
    CASE WHEN o.t - s.t < {GAP_MS} THEN s.k ELSE o.n END
  FROM sweep s JOIN o ON o.v = s.v AND o.n = s.n + 1),
kept AS (SELECT v AS video_id, arg_max(t, n) AS t, arg_max(p, n) AS priority FROM sweep GROUP BY v, k)"""

_DIFFERS = f"""(o.pinned OR bit_count(xor(CAST('0x' || substr(o.h, 1, 16) AS UBIGINT), CAST('0x' || substr(s.h, 1, 16) AS UBIGINT))) > {HASH_MOST}
  OR (length(o.h) >= 18 AND length(s.h) >= 18 AND abs(CAST('0x' || substr(o.h, 17, 2) AS BIGINT) - CAST('0x' || substr(s.h, 17, 2) AS BIGINT)) > {BRIGHTNESS_MOST}))"""

_EVENTS = f"""happened AS (
  SELECT v, t, row_number() OVER (PARTITION BY v ORDER BY t) AS n FROM (
    SELECT video_id AS v, t FROM fr WHERE ocr_text IS NOT NULL AND t IS NOT NULL UNION SELECT video_id, t FROM bl WHERE t IS NOT NULL)),
walk AS (
  SELECT v, n, t, greatest(0, t - {MARGIN_MS}) AS ws, 1 AS w FROM happened WHERE n = 1
  UNION ALL
  SELECT h.v, h.n, h.t, CASE WHEN h.t - p.ws > {MAX_WINDOW_MS} AND p.t - p.ws >= {MIN_WINDOW_MS} THEN greatest(0, h.t - {MARGIN_MS}) ELSE p.ws END,
    CASE WHEN h.t - p.ws > {MAX_WINDOW_MS} AND p.t - p.ws >= {MIN_WINDOW_MS} THEN p.w + 1 ELSE p.w END
  FROM walk p JOIN happened h ON h.v = p.v AND h.n = p.n + 1),
spans AS (SELECT v, w, min(ws) AS ws, max(t) AS last, count(*) AS c, w = max(w) OVER (PARTITION BY v) AS final FROM walk GROUP BY v, w),
events AS (
  SELECT v, ws AS start_ms, least(greatest(last + {MARGIN_MS}, CASE WHEN final THEN ws + {MIN_WINDOW_MS} ELSE ws END), coalesce(duration_ms, 1::BIGINT << 60)) AS end_ms, c AS events
  FROM spans LEFT JOIN (SELECT DISTINCT id, duration_ms FROM vi) d ON d.id = v)"""

SQL = {
    "transcript_windows": f"WITH RECURSIVE {SEGMENTS}, src AS (SELECT video_id AS v, id, s, e FROM seg), {_sessions_sql('src')} SELECT v AS video_id, ws AS start_ms, wid AS first_id, we AS end_ms, c AS segments FROM win",
    "event_sessions": f"WITH RECURSIVE {FRAMES}, {BLOCKS}, {VIDEOS}, {_EVENTS} SELECT v AS video_id, start_ms, end_ms, events FROM events",
    "media_windows": f"""WITH RECURSIVE {SEGMENTS}, {FRAMES}, {BLOCKS}, {VIDEOS}, src AS (SELECT video_id AS v, id, s, e FROM seg), {_sessions_sql('src')}, {_EVENTS}
SELECT v AS video_id, ws AS start_ms, we AS end_ms, 'transcript' AS source, c AS rows FROM win
UNION ALL SELECT v, start_ms, end_ms, 'events', events FROM events WHERE v NOT IN (SELECT video_id FROM seg WHERE s IS NOT NULL AND e IS NOT NULL)""",
    "interval_grid": f"WITH {VIDEOS}, {GRID} SELECT * FROM grid",
    "keyword_midpoints": f"WITH {SEGMENTS} SELECT video_id, id, (s + e) // 2 AS t FROM seg WHERE regexp_matches(lower(text), '{'|'.join(KEYWORDS)}')",
    "frame_candidates": f"WITH RECURSIVE {_CANDIDATES} SELECT * FROM kept",
    "frames_selected": f"WITH RECURSIVE {_CANDIDATES} SELECT video_id, t, priority FROM (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY priority DESC, t) AS r FROM kept) WHERE r <= {MAX_FRAMES}",
    "frame_hash_steps": f"WITH {FRAMES}, st AS (SELECT id, perceptual_hash AS h, lag(perceptual_hash) OVER (PARTITION BY video_id ORDER BY t, id) AS b FROM fr WHERE perceptual_hash IS NOT NULL AND t IS NOT NULL) SELECT id, CAST(bit_count(xor(CAST('0x' || substr(h, 1, 16) AS UBIGINT), CAST('0x' || substr(b, 1, 16) AS UBIGINT))) AS BIGINT) AS bits FROM st WHERE b IS NOT NULL",
    "frame_sweep": f"""WITH RECURSIVE {_CANDIDATES}, pictures AS (
  SELECT video_id AS v, id, t, perceptual_hash AS h, row_number() OVER (PARTITION BY video_id ORDER BY t, id) AS n,
    EXISTS (SELECT 1 FROM kept WHERE kept.video_id = u.video_id AND kept.priority = 0 AND kept.t BETWEEN u.t - {MATCH_MS} AND u.t + {MATCH_MS}) AS pinned
  FROM (SELECT DISTINCT id, video_id, t, perceptual_hash FROM fr WHERE regexp_matches(perceptual_hash, '^[0-9a-fA-F]{{16,}}$') AND t IS NOT NULL) u),
pick AS (
  SELECT v, n, id, t, h, true AS kept FROM pictures WHERE n = 1
  UNION ALL
  SELECT o.v, o.n, o.id, o.t, CASE WHEN {_DIFFERS} THEN o.h ELSE s.h END, {_DIFFERS} FROM pick s JOIN pictures o ON o.v = s.v AND o.n = s.n + 1)
SELECT v AS video_id, id, t FROM pick WHERE kept
UNION ALL SELECT DISTINCT video_id, id, t FROM fr WHERE t IS NOT NULL AND NOT coalesce(regexp_matches(perceptual_hash, '^[0-9a-fA-F]{{16,}}$'), false)""",
    "match_frames": f"WITH {VIDEOS}, {FRAMES}, {GRID} SELECT g.video_id, g.t AS want, arg_min(f.id, (abs(f.t - g.t), f.t, f.id)) AS frame_id, arg_min(f.t, (abs(f.t - g.t), f.t, f.id)) AS t FROM grid g JOIN fr f ON f.video_id = g.video_id AND abs(f.t - g.t) <= {MATCH_MS} GROUP BY g.video_id, g.t",
    "inspect_segment": _nearest_sql("SELECT video_id, id AS sid, s, e FROM seg", SEGMENTS, "segment_id"),
    "inspect_chunk": _nearest_sql("SELECT video_id, id AS sid, s, e FROM ch", CHUNKS, "chunk_id"),
    "inspect_frame": _nearest_sql("SELECT video_id, id AS sid, t AS s, t AS e FROM fr", FRAMES, "frame_id"),
    "inspect_code": f"WITH {CHUNKS}, {BLOCKS}, r AS (SELECT ch.id AS chunk_id, bl.id AS block_id, abs(bl.t - ch.s) AS distance_ms, row_number() OVER (PARTITION BY ch.id, ch.s ORDER BY abs(bl.t - ch.s), bl.t, bl.id) AS place FROM (SELECT DISTINCT id, video_id, s FROM ch) ch JOIN bl ON bl.video_id = ch.video_id WHERE bl.t IS NOT NULL AND ch.s IS NOT NULL) SELECT chunk_id, place, block_id, distance_ms FROM r WHERE place <= 3",
    "block_chunk": f"WITH {BLOCKS}, {CHUNKS} SELECT bl.id AS block_id, min(ch.id) AS chunk_id FROM bl LEFT JOIN ch ON ch.video_id = bl.video_id AND bl.t BETWEEN ch.s AND ch.e WHERE bl.t IS NOT NULL GROUP BY bl.id",
    "blocks_in_sources": f"WITH {BLOCKS}, {CHUNKS} SELECT DISTINCT id AS block_id, video_id, t FROM bl WHERE EXISTS (SELECT 1 FROM ch WHERE ch.video_id = bl.video_id AND bl.t BETWEEN s AND e AND lower(coalesce(transcript, '')) LIKE '%script%')",
}
