"""Queries on vectors and chat: search, union of indexes, filters, embeddings, history."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from timelode.functions.text import TOKEN, chat_turns, truncated
from timelode.functions.vectors import DIMENSIONS, embed_blake2b, embed_sha, embed_sha_dense
from timelode.operators.chat import FROM_SOURCES, NO_SOURCES, answers
from timelode.operators.nearest import top_within
from timelode.operators.retrieval import cosine, search
from timelode.plans import timeline as tl
from timelode.plans.documents import sections
from timelode.plans.enrich import RECORDS, record_texts, sql_truncated
from timelode.session import checkpointed
from timelode.sources.tables import records, table

SECTION_K, CHAT_K, HISTORY = 12, 8, 8
#: Searches ask for every row whose id is divisible by this.
ASK_EVERY = 50
ASK_CHARS = 200
LOW_MS, HIGH_MS = 300_000, 900_000


def _index(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("row_id"), F.col("label").alias("dedup_key"), F.col("embedding").alias("vec"))


def _questions(spark: SparkSession, d: str) -> DataFrame:
    """What is asked, by every document whose id is divisible by ASK_EVERY: a chat asks with its last turns, any other
    document with its beginning. Chats ask both indexes, mirrored threads the records, the rest the documents;
    exported sections and transcripts ask within their video."""
    docs = table(spark, d, "documents").where("text IS NOT NULL").where(F.col("doc_id") % ASK_EVERY == 0)
    last = F.slice("turns", F.greatest(F.size("turns") - (HISTORY - 1), F.lit(1)), HISTORY)
    spoken = F.array_join(F.transform(last, lambda t: F.concat(t["role"], F.lit(": "), t["content"])), "\n")
    rows = docs.withColumn("turns", F.when(F.col("source") == "chat_answers", chat_turns(F.col("text"))))
    return rows.select(
        F.col("doc_id").alias("query_id"),
        F.when(F.size("turns") > 0, spoken).otherwise(F.concat(F.lit("user: "), truncated(F.col("text"), ASK_CHARS))).alias("question"),
        F.when(F.col("source") == "chat_answers", "hybrid").when(F.col("source") == "forum_mirrors", "raw").otherwise("docs").alias("mode"),
        F.when(F.col("source").isin("section_exports", "workshop_transcripts"), F.col("video_id")).alias("scope"),
    )


def _documented(spark: SparkSession, d: str) -> DataFrame:
    """The index of the documentation: the sections of the exports."""
    docs = table(spark, d, "documents").where("source = 'section_exports'").select("doc_id", "video_id")
    rows = sections(spark, d, "source = 'section_exports'").join(docs, "doc_id")
    return rows.select(F.concat_ws("_", F.col("doc_id").cast("string"), F.col("section_no").cast("string")).alias("row_id"), F.col("video_id").alias("scope"), F.array_join("lines", "\n").alias("text"))


def _answer_sources(spark: SparkSession, d: str) -> DataFrame:
    """query_id, place, index, record_id, score, text of the sources of every question."""
    questions = _questions(spark, d)
    asked = checkpointed(questions.withColumn("vec", embed_sha_dense(F.col("question"))))
    documented = _documented(spark, d).withColumn("dedup_key", F.col("row_id"))
    recorded = record_texts(spark, d).select(F.col("record_id").alias("row_id"), F.col("chunk_id").alias("dedup_key"), F.col("video_id").alias("scope"), "text")
    # Without any documentation, questions to it go to the records.
    modes = {"docs": ["docs", "hybrid"], "raw": ["raw", "hybrid", *(["docs"] if documented.isEmpty() else [])]}
    found = []
    for name, index in (("docs", documented), ("raw", recorded)):
        filled = checkpointed(index.where("trim(text) <> ''").withColumn("vec", embed_sha_dense(F.col("text"))))
        hits = search(asked.where(F.col("mode").isin(modes[name])), filled, k=CHAT_K, once_per_key=False, scope="scope")
        texts = filled.select("row_id", "text")
        found.append(hits.drop("place").join(texts, "row_id").withColumn("index", F.lit(name)))
    order = [F.desc("score"), F.col("index"), F.col("row_id")]
    best = top_within(found[0].unionByName(found[1]), ["query_id", "index", "dedup_key"], order, 1, "first")
    placed = top_within(best, ["query_id"], order, CHAT_K)
    return placed.select("query_id", F.col("place").cast("bigint").alias("place"), "index", F.col("row_id").alias("record_id"), "score", "text")


def ask_sources(spark: SparkSession, d: str) -> DataFrame:
    """The sources that answer each question: filtered, searched, freed of repeats, ranked."""
    return _answer_sources(spark, d).drop("text")


def ask(spark: SparkSession, d: str) -> DataFrame:
    """From question to cited answer, as hash and number of its lines."""
    questions = _questions(spark, d).select(F.col("query_id").alias("question_id"))
    told = answers(questions, _answer_sources(spark, d).withColumnRenamed("query_id", "question_id"))
    return told.select(F.col("question_id").alias("query_id"), F.size(F.split("answer", "\n")).cast("bigint").alias("lines"), F.sha2("answer", 256).alias("hash"))


def _asked(spark: SparkSession, d: str) -> DataFrame:
    return _index(spark, d).where(F.col("row_id") % ASK_EVERY == 0).select(F.col("row_id").alias("query_id"), "vec")


def retrieve(spark: SparkSession, d: str) -> DataFrame:
    """For each query the best row of each key, the first twelve."""
    return search(_asked(spark, d), _index(spark, d), k=SECTION_K, once_per_key=True)


def search_indexes(spark: SparkSession, d: str) -> DataFrame:
    """Two indexes, each giving its first rows before repeats of a key are dropped; united and ranked again."""
    index = _index(spark, d)
    parts = []
    for name, rest in (("docs", 0), ("raw", 1)):
        hits = search(_asked(spark, d), index.where(F.col("dedup_key") % 2 == rest), k=CHAT_K, once_per_key=False)
        parts.append(hits.select("query_id", "row_id", "dedup_key", "score", F.lit(name).alias("source")))
    order = [F.desc("score"), F.col("source"), F.col("row_id")]
    united = parts[0].unionByName(parts[1])
    first = united.withColumn("r", F.row_number().over(Window.partitionBy("query_id", "source", "dedup_key").orderBy(*order))).where("r = 1")
    placed = first.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy(*order)).cast("bigint")).where(F.col("place") <= CHAT_K)
    return placed.select("query_id", "source", "row_id", "dedup_key", "score", "place")


def filtered_records(spark: SparkSession, d: str) -> DataFrame:
    """Embedding records of chunks of MP4 videos that overlap the asked time range."""
    wanted = tl._videos(spark, d, "filename").where("lower(filename) LIKE '%.mp4'").select(F.col("id").alias("video_id")).distinct()
    lo, hi = F.coalesce("s", F.lit(0)), F.coalesce("e", "s", F.lit(0))
    spans = tl._chunks(spark, d).where((hi >= LOW_MS) & (lo <= HIGH_MS) & (F.col("s").isNotNull() | F.col("e").isNotNull()))
    spans = spans.select(F.col("id").alias("chunk_id"), "video_id").distinct().join(wanted, "video_id", "left_semi")
    rows = records(spark, d, "embedding_records", "id", "chunk_id", "embedding_type")
    return rows.join(spans.select("chunk_id"), "chunk_id", "left_semi").select(F.col("id").alias("record_id"), "chunk_id", "embedding_type")


def record_siblings(spark: SparkSession, d: str) -> DataFrame:
    """Cosine of each record with the combined record of its own chunk."""
    rows = records(spark, d, "embedding_records", "id", "chunk_id", "embedding_type", "vector").where("vector IS NOT NULL")
    whole = rows.where("embedding_type = 'combined'").select("chunk_id", F.col("vector").alias("whole"))
    pairs = rows.where("embedding_type <> 'combined'").join(whole, "chunk_id")
    return pairs.select(F.col("id").alias("record_id"), F.round(cosine(F.col("vector"), F.col("whole")), 5).alias("cosine"))


def index_dimensions(spark: SparkSession, d: str) -> DataFrame:
    """Records by stated and actual vector length and how many are unusable."""
    rows = records(spark, d, "embedding_records", "id", "embedding_type", "dimensions", "vector")
    zero = ~F.exists("vector", lambda x: x != 0)
    return rows.groupBy("embedding_type", "dimensions").agg(
        F.count("*").alias("records"), F.count_if(F.col("vector").isNull()).alias("missing"), F.count_if(zero).alias("zero"), F.max(F.size("vector")).cast("bigint").alias("longest")
    )


def stale_records(spark: SparkSession, d: str) -> DataFrame:
    """Records whose stored hash isn't that of their text."""
    rows = records(spark, d, "embedding_records", "id", "text", "text_hash")
    return rows.where("NOT text_hash <=> sha2(text, 256)").select("id")


def embed_documents_sha(spark: SparkSession, d: str) -> DataFrame:
    """Signed token buckets of all documents by built-in hashing, as their number and squared length."""
    buckets = embed_sha(table(spark, d, "documents").where("text IS NOT NULL"), "doc_id", "text")
    return buckets.groupBy("doc_id").agg(F.count("*").alias("buckets"), F.sum(F.col("weight") * F.col("weight")).alias("squared"), F.sum(F.col("weight") * F.col("bucket")).alias("moment"))


def embed_documents(spark: SparkSession, d: str) -> DataFrame:
    """The exact hashing embedding of all documents."""
    return table(spark, d, "documents").where("text IS NOT NULL").select("doc_id", embed_blake2b(F.col("text")).alias("vector"))


def chat_history(spark: SparkSession, d: str) -> DataFrame:
    """For each chat document its last turns as `role: content` lines, and how many turns it has."""
    turns = table(spark, d, "documents").where("source = 'chat_answers' AND text IS NOT NULL").select("doc_id", chat_turns(F.col("text")).alias("turns"))
    kept = turns.where("size(turns) > 0").withColumn("last", F.slice("turns", F.greatest(F.size("turns") - (HISTORY - 1), F.lit(1)), HISTORY))
    line = F.array_join(F.transform("last", lambda t: F.concat(t["role"], F.lit(": "), t["content"])), "\n")
    return kept.select("doc_id", F.size("turns").cast("bigint").alias("turns"), F.sha2(line, 256).alias("query_hash"))


QUERIES = {
    f.__name__: f
    for f in (retrieve, search_indexes, ask_sources, ask, filtered_records, record_siblings, index_dimensions, stale_records, embed_documents_sha, embed_documents, chat_history)
}

_SCORED = f"""e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
s AS (SELECT q.vec_id AS query_id, e.vec_id AS row_id, CAST(e.label AS BIGINT) AS dedup_key, round(list_cosine_similarity(q.v, e.v), 6) AS score FROM e q JOIN e ON true WHERE q.vec_id % {ASK_EVERY} = 0)"""
_REC = "er AS (SELECT DISTINCT id, chunk_id, embedding_type, text, text_hash, vector, dimensions FROM embedding_records)"
_TURNS = r"""t AS (SELECT doc_id, list_filter(string_split(regexp_replace(text, '(^|\s)(user|assistant): ', '\1' || chr(1) || '\2: ', 'g'), chr(1)), lambda p: regexp_matches(p, '^(user|assistant): ')) AS p FROM documents WHERE source = 'chat_answers' AND text IS NOT NULL)"""

_ASK = f"""{RECORDS}, {_TURNS},
qs AS (SELECT d.doc_id AS query_id, CASE WHEN len(p) > 0 THEN array_to_string(list_transform(list_slice(p, greatest(len(p) - {HISTORY - 1}, 1), len(p)),
    lambda x: regexp_extract(x, '^(user|assistant): ', 1) || ': ' || regexp_replace(regexp_replace(x, '^(user|assistant): ', ''), '^[ \\t\\n\\r\\f\\x0b\\x{{a0}}\\x{{85}}]+|[ \\t\\n\\r\\f\\x0b\\x{{a0}}\\x{{85}}]+$', '', 'g')), chr(10))
    ELSE 'user: ' || {sql_truncated('d.text', ASK_CHARS)} END AS question,
  CASE WHEN source = 'chat_answers' THEN 'hybrid' WHEN source = 'forum_mirrors' THEN 'raw' ELSE 'docs' END AS mode,
  CASE WHEN source IN ('section_exports', 'workshop_transcripts') THEN video_id END AS scope FROM documents d LEFT JOIN t ON t.doc_id = d.doc_id WHERE d.text IS NOT NULL AND d.doc_id % {ASK_EVERY} = 0),
dl AS (SELECT doc_id, video_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM documents WHERE source = 'section_exports' AND text IS NOT NULL),
dn AS (SELECT *, sum(CAST(starts_with(line, '## ') AS INT)) OVER (PARTITION BY doc_id ORDER BY n) AS sn FROM dl),
ds AS (SELECT doc_id || '_' || sn AS row_id, video_id AS scope, string_agg(CASE WHEN starts_with(line, '## ') THEN substr(line, 4) ELSE line END, chr(10) ORDER BY n) AS text FROM dn WHERE sn > 0 GROUP BY doc_id, video_id, sn),
ix AS (SELECT 'docs' AS name, row_id, row_id AS dedup_key, scope, text FROM ds UNION ALL SELECT 'raw', record_id, chunk_id, video_id, text FROM rec),
iy AS (SELECT * FROM ix WHERE trim(text) <> ''),
tw AS (SELECT 'q' AS side, CAST(query_id AS VARCHAR) AS k, lower(unnest(regexp_extract_all(question, '{TOKEN}'))) AS token FROM qs UNION ALL SELECT name, row_id, lower(unnest(regexp_extract_all(text, '{TOKEN}'))) FROM iy),
tb AS (SELECT side, k, CAST('0x' || substr(sha256(token), 1, 8) AS BIGINT) % {DIMENSIONS} AS bucket, CAST(sum(CASE WHEN CAST('0x' || substr(sha256(token), 9, 2) AS BIGINT) % 2 = 1 THEN 1 ELSE -1 END) AS DOUBLE) AS w FROM tw GROUP BY ALL),
tn AS (SELECT side, k, sqrt(sum(w * w)) AS norm FROM tb GROUP BY ALL),
td AS (SELECT a.k AS q, b.side AS name, b.k AS row_id, sum(a.w * b.w) AS dot FROM tb a JOIN tb b ON a.bucket = b.bucket WHERE a.side = 'q' AND b.side <> 'q' GROUP BY ALL),
sc AS (SELECT qs.query_id, td.name, td.row_id, dedup_key, text, round(dot / (na.norm * nb.norm), 6) AS score FROM td JOIN qs ON CAST(qs.query_id AS VARCHAR) = q JOIN iy ON iy.name = td.name AND iy.row_id = td.row_id
  JOIN tn na ON na.side = 'q' AND na.k = q JOIN tn nb ON nb.side = td.name AND nb.k = td.row_id
  WHERE (qs.scope IS NULL OR qs.scope = iy.scope) AND (mode = 'hybrid' OR mode = td.name OR (mode = 'docs' AND NOT EXISTS (SELECT 1 FROM ds)))),
s8 AS (SELECT *, row_number() OVER (PARTITION BY query_id, name ORDER BY score DESC, row_id) AS n FROM sc WHERE score > 0),
s1 AS (SELECT *, row_number() OVER (PARTITION BY query_id, name, dedup_key ORDER BY score DESC, row_id) AS f FROM s8 WHERE n <= {CHAT_K}),
sp2 AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, name, row_id) AS place, name, row_id, score, text FROM s1 WHERE f = 1)"""

SQL = {
    "ask_sources": f'WITH {_ASK} SELECT query_id, place, name AS "index", row_id AS record_id, score FROM sp2 WHERE place <= {CHAT_K}',
    "ask": f"""WITH {_ASK}, al AS (SELECT query_id, string_agg('- ' || {sql_truncated('text', 300)} || ' [' || place || ']', chr(10) ORDER BY place) AS body FROM sp2 WHERE place <= 4 GROUP BY query_id),
an AS (SELECT qs.query_id, coalesce('{FROM_SOURCES}' || chr(10) || body, '{NO_SOURCES}') AS answer FROM qs LEFT JOIN al USING (query_id)) SELECT query_id, len(string_split(answer, chr(10))) AS lines, sha256(answer) AS hash FROM an""",
    "retrieve": f"WITH {_SCORED}, b AS (SELECT *, row_number() OVER (PARTITION BY query_id, dedup_key ORDER BY score DESC, row_id) AS r FROM s WHERE score > 0), p AS (SELECT query_id, row_id, dedup_key, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, row_id) AS place FROM b WHERE r = 1) SELECT * FROM p WHERE place <= {SECTION_K}",
    "search_indexes": f"""WITH {_SCORED}, a AS (SELECT *, CASE WHEN dedup_key % 2 = 0 THEN 'docs' ELSE 'raw' END AS source FROM s WHERE score > 0),
k AS (SELECT *, row_number() OVER (PARTITION BY query_id, source ORDER BY score DESC, row_id) AS n FROM a),
f AS (SELECT *, row_number() OVER (PARTITION BY query_id, source, dedup_key ORDER BY score DESC, source, row_id) AS r FROM k WHERE n <= {CHAT_K}),
p AS (SELECT query_id, source, row_id, dedup_key, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, source, row_id) AS place FROM f WHERE r = 1) SELECT * FROM p WHERE place <= {CHAT_K}""",
    "filtered_records": f"WITH {_REC}, {tl.CHUNKS}, {tl.VIDEOS} SELECT DISTINCT er.id AS record_id, er.chunk_id, embedding_type FROM er WHERE chunk_id IN (SELECT ch.id FROM ch WHERE (s IS NOT NULL OR e IS NOT NULL) AND coalesce(e, s, 0) >= {LOW_MS} AND coalesce(s, 0) <= {HIGH_MS} AND video_id IN (SELECT id FROM vi WHERE lower(filename) LIKE '%.mp4'))",
    "record_siblings": f"WITH {_REC} SELECT a.id AS record_id, CASE WHEN len(a.vector) = len(b.vector) THEN round(CASE WHEN list_dot_product(a.vector, a.vector) * list_dot_product(b.vector, b.vector) = 0 THEN 0 ELSE list_dot_product(a.vector, b.vector) / (sqrt(list_dot_product(a.vector, a.vector)) * sqrt(list_dot_product(b.vector, b.vector))) END, 5) END AS cosine FROM er a JOIN er b ON a.chunk_id = b.chunk_id AND b.embedding_type = 'combined' WHERE a.embedding_type <> 'combined' AND a.vector IS NOT NULL AND b.vector IS NOT NULL",
    "index_dimensions": f"WITH {_REC} SELECT embedding_type, dimensions, count(*) AS records, count(*) FILTER (vector IS NULL) AS missing, count(*) FILTER (len(list_filter(vector, lambda x: x <> 0)) = 0) AS zero, max(len(vector)) AS longest FROM er GROUP BY ALL",
    "stale_records": f"WITH {_REC} SELECT DISTINCT id FROM er WHERE text_hash IS DISTINCT FROM sha256(text)",
    "embed_documents_sha": f"""WITH w AS (SELECT doc_id, lower(unnest(regexp_extract_all(text, '{TOKEN}'))) AS token FROM documents WHERE text IS NOT NULL),
c AS (SELECT doc_id, token, count(*) AS n, sha256(token) AS h FROM w GROUP BY ALL),
b AS (SELECT doc_id, CAST('0x' || substr(h, 1, 8) AS BIGINT) % {DIMENSIONS} AS bucket, CAST(sum(CASE WHEN CAST('0x' || substr(h, 9, 2) AS BIGINT) % 2 = 1 THEN n ELSE -n END) AS BIGINT) AS weight FROM c GROUP BY ALL)
SELECT doc_id, count(*) AS buckets, CAST(sum(weight * weight) AS BIGINT) AS squared, CAST(sum(weight * bucket) AS BIGINT) AS moment FROM b WHERE weight <> 0 GROUP BY doc_id""",
    "chat_history": f"""WITH {_TURNS}, l AS (SELECT doc_id, len(p) AS turns, list_slice(p, greatest(len(p) - {HISTORY - 1}, 1), len(p)) AS q FROM t WHERE len(p) > 0)
SELECT doc_id, turns, sha256(array_to_string(list_transform(q, lambda x: regexp_extract(x, '^(user|assistant): ', 1) || ': ' || regexp_replace(regexp_replace(x, '^(user|assistant): ', ''), '^[ \\t\\n\\r\\f\\x0b\\x{{a0}}\\x{{85}}]+|[ \\t\\n\\r\\f\\x0b\\x{{a0}}\\x{{85}}]+$', '', 'g')), chr(10))) AS query_hash FROM l""",
}
