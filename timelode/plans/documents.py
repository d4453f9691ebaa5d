"""Queries on documents and sections: keyword sections, outlines, citations, Markdown structure."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from timelode.functions.text import TOKEN, WS, claim_tokens, clock, non_empty, strip, truncated
from timelode.operators.nearest import top_within
from timelode.plans import timeline as tl
from timelode.plans.enrich import sql_non_empty, sql_strip, sql_truncated
from timelode.sources.tables import table

# Sections in their order, each with the words that speak for it (fixed values).
SECTIONS = (
    ("Introduzione", ("introduzione", "panoramica", "overview", "obiettivo", "contesto", "architettura")),
    ("Installazione", ("install", "setup", "dipenden", "requisit", "venv", "pip", "npm", "package")),
    ("Configurazione ambiente", ("config", "database", "env", "variabil", "yaml", "settings", "porta", "token")),
    ("Creazione del primo progetto", ("progetto", "init", "crea", "nuovo", "primo", "workspace")),
    ("Funzionalita principali", ("funzion", "feature", "comando", "workflow", "uso", "dashboard", "servizio")),
    ("Debug e troubleshooting", ("debug", "errore", "error", "warning", "exception", "problema", "fix", "troubleshoot")),
    ("Deployment", ("deploy", "release", "produzione", "docker", "build", "server", "hosting", "cloud")),
    ("Appendici", ("appendice", "riferiment", "allegat", "codice", "codebase", "extra")),
)
DEFAULT_SECTION, CODE_SECTION = "Funzionalita principali", "Appendici"
# Chunks named per section, numbered sources per video, least share of common words, length of an
# excerpt; headings that a section must have, those that make claims, and how lines begin that claim nothing.
TOP_CHUNKS, MOST_SOURCES, LEAST_OVERLAP, EXCERPT = 5, 6, 0.12, 320
REQUIRED = (
    "Obiettivo", "Fonti utilizzate", "Spiegazione dettagliata", "Procedura passo-passo", "Codice esaminato",
    "Spiegazione del codice", "Risultato atteso", "Errori comuni", "Riferimenti",
)
NARRATIVE = ("Spiegazione dettagliata", "Procedura passo-passo", "Errori comuni")
PLACEHOLDERS = ("Da completare", "Le fonti recuperate non contengono", "Nessun errore specifico", "Nessuna fonte")
#: A line that opens or closes code, and one that opens a section, each with the line end before it.
FENCE, HEADING = r"(^|\n)[ \t]*```[^\n]*", r"(^|\n)## "


def best_section(text: Column) -> Column:
    """The section with the most of its words in the text, the first of equals; the default for none."""
    scores = F.array(*[
        F.struct(F.size(F.filter(F.array(*map(F.lit, words)), lambda w: F.contains(text, w))).alias("n"), F.lit(-i).alias("o"), F.lit(title).alias("title"))
        for i, (title, words) in enumerate(SECTIONS)
    ])
    best = F.array_max(scores)
    return F.when(best["n"] > 0, best["title"]).otherwise(F.lit(DEFAULT_SECTION))


def chunk_sections(spark: SparkSession, d: str) -> DataFrame:
    """The section of each chunk."""
    text = F.lower(F.concat_ws(" ", *[F.nullif(F.col(c), F.lit("")) for c in ("topic", "summary", "transcript", "ocr_text")]))
    return tl._chunks(spark, d, "topic", "summary", "transcript", "ocr_text").select(F.col("id").alias("chunk_id"), "video_id", "s", best_section(text).alias("section")).distinct()


def block_sections(spark: SparkSession, d: str) -> DataFrame:
    """Code blocks per section: that of the first chunk that contains them, else the appendix."""
    home = tl.block_chunk(spark, d).join(chunk_sections(spark, d).select("chunk_id", "section"), "chunk_id", "left")
    return home.select("block_id", F.coalesce("section", F.lit(CODE_SECTION)).alias("section")).groupBy("section").agg(F.countDistinct("block_id").alias("blocks"))


def section_tops(spark: SparkSession, d: str) -> DataFrame:
    """The first chunks of each section and how many more there are."""
    rows = chunk_sections(spark, d).where("s IS NOT NULL")
    sizes = rows.groupBy("section").agg(F.count("*").alias("n"))
    first = top_within(rows, ["section"], [F.col("s"), F.col("chunk_id")], TOP_CHUNKS)
    return first.join(F.broadcast(sizes), "section").select("section", F.col("place").cast("bigint").alias("place"), "chunk_id", F.greatest(F.col("n") - TOP_CHUNKS, F.lit(0)).alias("more"))


def outline(spark: SparkSession, d: str) -> DataFrame:
    """One Markdown block per section, in order: its heading and its first chunks with their excerpts."""
    first = section_tops(spark, d).join(tl._chunks(spark, d, "summary").select(F.col("id").alias("chunk_id"), "summary").distinct(), "chunk_id")
    line = F.concat(F.lit("- "), F.col("chunk_id"), F.lit(": "), F.coalesce(truncated(F.col("summary"), 80), F.lit("?")))
    lines = first.groupBy("section").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", line.alias("line")))), lambda x: x["line"]), "\n").alias("body"))
    return lines.select("section", F.concat(F.lit("## "), F.col("section"), F.lit("\n\n"), F.col("body")).alias("markdown"))


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").where("text IS NOT NULL").select("doc_id", "video_id", "text")


def _citations(spark: SparkSession, d: str) -> DataFrame:
    lines = _docs(spark, d).select("doc_id", "video_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    ranks = F.transform(F.regexp_extract_all("line", F.lit(r"\[(\d{1,3})\]"), F.lit(1)), lambda x: x.cast("bigint"))
    return lines.select("doc_id", "video_id", "line_no", "line", F.explode(F.array_distinct(ranks)).alias("rank"))


def _sources(spark: SparkSession, d: str) -> DataFrame:
    """The first chunks of each video as its documents' numbered sources."""
    texts = tl._chunks(spark, d, "summary", "transcript").select("video_id", F.col("id").alias("chunk_id"), "s", "e", F.concat_ws(" ", "summary", "transcript").alias("source")).distinct()
    return top_within(texts, ["video_id"], [F.col("chunk_id")], MOST_SOURCES, "rank").withColumn("rank", F.col("rank").cast("bigint"))


def _backing(spark: SparkSession, d: str) -> DataFrame:
    """The words of each numbered source."""
    return _sources(spark, d).select("video_id", "rank", claim_tokens(F.col("source")).alias("backing"))


def citations(spark: SparkSession, d: str) -> DataFrame:
    """How often each document cites each rank."""
    return _citations(spark, d).groupBy("doc_id", "rank").agg(F.count("*").alias("lines"))


def unknown_citations(spark: SparkSession, d: str) -> DataFrame:
    """Cited ranks that no source has (an anti join)."""
    cited = _citations(spark, d).select("doc_id", "video_id", "rank").distinct()
    return cited.join(_sources(spark, d).select("video_id", "rank"), ["video_id", "rank"], "left_anti").select("doc_id", "rank")


def _overlap(cited: DataFrame) -> DataFrame:
    rows = cited.withColumn("shared", F.size(F.array_intersect("words", "backing")).cast("bigint")).withColumn("said", F.size("words").cast("bigint"))
    return rows.where((F.col("said") > 0) & (F.size("backing") > 0) & (F.col("shared") < LEAST_OVERLAP * F.col("said")))


def weak_claims(spark: SparkSession, d: str) -> DataFrame:
    """Lines that share too few words with a source they cite."""
    said = _citations(spark, d).select("doc_id", "video_id", "line_no", "rank", claim_tokens(F.col("line")).alias("words"))
    weak = _overlap(said.join(_backing(spark, d), ["video_id", "rank"]))
    return weak.select("doc_id", F.col("line_no").cast("bigint").alias("line_no"), "rank", "said", "shared")


def told(docs: DataFrame, headings: tuple[str, ...] | None) -> DataFrame:
    """doc_id, video_id, heading, line of the lines that claim something: under second-level headings (the named
    ones, or any), outside of code, neither headings nor placeholders, without list marks."""
    parts = F.split("text", FENCE)
    spoken = F.array_join(F.transform(F.sequence(F.lit(0), F.floor((F.size("parts") - 1) / 2)), lambda i: F.element_at("parts", (2 * i + 1).cast("int"))), "\n")
    docs = docs.where(F.col("text").contains("## ")).select("doc_id", "video_id", parts.alias("parts")).select("doc_id", "video_id", F.split(spoken, r"(^|\n)[ \t]*## ").alias("sections"))
    sections = docs.select("doc_id", "video_id", F.posexplode(F.transform(F.slice("sections", 2, 1_000_000), lambda x: F.split(x, "\n"))).alias("section_no", "lines"))
    named = sections.withColumn("heading", F.regexp_replace(F.col("lines")[0], r"[ \t\r]+$", ""))
    named = named.where(F.col("heading").isin(*headings)) if headings else named
    lines = named.select("doc_id", "video_id", "section_no", "heading", F.posexplode(F.transform(F.slice("lines", 2, 1_000_000), strip)).alias("line_no", "line"))
    empty = F.col("line").startswith("#") | F.array_contains(F.transform(F.array(*map(F.lit, PLACEHOLDERS)), lambda p: F.startswith(F.col("line"), p)), True)
    claim = F.regexp_replace(F.regexp_replace("line", "^[- ]+", ""), r"^[0-9. ]+", "")
    return lines.where((F.col("line") != "") & ~empty).withColumn("line", claim).where("line <> ''")


def narrative_claims(spark: SparkSession, d: str) -> DataFrame:
    """Claims under any heading (`told` takes the NARRATIVE ones too): those that cite nothing, and those that share
    too few words with a source they cite, counted per document and issue."""
    ranks = F.array_distinct(F.transform(F.regexp_extract_all("line", F.lit(r"\[(\d{1,3})\]"), F.lit(1)), lambda x: x.cast("bigint")))
    claims = told(_docs(spark, d), None).withColumn("ranks", ranks)
    bare = claims.where("size(ranks) = 0").select("doc_id", F.lit("uncited").alias("issue"))
    cited = claims.select("doc_id", "video_id", F.explode("ranks").alias("rank"), claim_tokens(F.col("line")).alias("words"))
    weak = _overlap(cited.join(_backing(spark, d), ["video_id", "rank"])).select("doc_id", F.lit("low_overlap").alias("issue"))
    return bare.unionByName(weak).groupBy("doc_id", "issue").agg(F.count("*").alias("claims"))


def sections(spark: SparkSession, d: str, where: str = "true") -> DataFrame:
    """doc_id, section_no, lines of each second-level section, its title first: cut out of the text, no shuffle."""
    docs = table(spark, d, "documents").where("text IS NOT NULL").where(where).select("doc_id", F.split("text", HEADING).alias("parts"))
    return docs.select("doc_id", F.posexplode("parts").alias("section_no", "part")).where("section_no > 0").select("doc_id", F.col("section_no").cast("bigint").alias("section_no"), F.split("part", "\n").alias("lines"))


def _filled(lines: Column) -> Column:
    return F.exists(F.slice(lines, 2, 1_000_000), lambda x: x.rlike(r"[^ \t\r]") & ~x.rlike(r"^[ \t]*<!--"))


def markdown_sections(spark: SparkSession, d: str) -> DataFrame:
    """Sections under second-level headings with their title, lines and whether they hold any text."""
    rows = sections(spark, d)
    return rows.select("doc_id", "section_no", non_empty(F.col("lines")[0]).alias("title"), (F.size("lines") - 1).cast("bigint").alias("lines"), _filled(F.col("lines")).alias("has_text"))


def heading_issues(spark: SparkSession, d: str) -> DataFrame:
    """Exported sections by required heading that they lack or leave empty (the last section of a name counts)."""
    docs = table(spark, d, "documents").where("source = 'section_exports' AND text IS NOT NULL").select("doc_id", F.split("text", HEADING).alias("parts"))
    sections = F.transform(F.slice("parts", 2, 1_000_000), lambda p: F.struct(strip(F.split(p, "\n")[0]).alias("title"), _filled(F.split(p, "\n")).alias("filled")))
    wanted = docs.select("doc_id", sections.alias("sections")).withColumn("heading", F.explode(F.array(*map(F.lit, REQUIRED))))
    same = F.filter("sections", lambda x: x["title"] == F.col("heading"))
    issue = F.when(F.size(same) == 0, "missing").when(~F.element_at(same, -1)["filled"], "empty")
    return wanted.select("heading", issue.alias("issue")).where("issue IS NOT NULL").groupBy("heading", "issue").agg(F.count("*").alias("documents"))


def source_mentions(spark: SparkSession, d: str) -> DataFrame:
    """For each exported section and numbered source of its video whether the text names the video's file and the
    source's time range, counted per document."""
    names = tl._videos(spark, d, "filename").select(F.col("id").alias("video_id"), "filename").distinct()
    span = F.concat(clock(F.coalesce(F.col("s"), F.lit(0)) / 1000), F.lit("-"), clock(F.col("e") / 1000))
    span = F.when(F.col("e").isNull(), F.when(F.col("s").isNotNull(), F.concat(F.lit("@"), clock(F.col("s") / 1000)))).otherwise(span)
    sources = _sources(spark, d).join(names, "video_id", "left").groupBy("video_id").agg(F.collect_list(F.struct(span.alias("span"), "filename")).alias("sources"))  # MOST_SOURCES at most
    docs = table(spark, d, "documents").where("source = 'section_exports' AND text IS NOT NULL").select("doc_id", "video_id", "text")
    rows = docs.join(sources, "video_id")

    def absent(field: str) -> Column:
        return F.size(F.filter("sources", lambda x: x[field].isNotNull() & (x[field] != "") & ~F.contains(F.col("text"), x[field]))).cast("bigint")

    return rows.select("doc_id", F.size("sources").cast("bigint").alias("sources"), absent("filename").alias("unnamed"), absent("span").alias("untimed"))


def _fenced(spark: SparkSession, d: str) -> DataFrame:
    """doc_id, fence_no, code of all closed fences with at least one line: every second part between fences."""
    docs = _docs(spark, d).where(F.col("text").contains("```")).select("doc_id", F.split("text", FENCE).alias("parts"))
    parts = docs.select("doc_id", F.size("parts").alias("n"), F.posexplode("parts").alias("at", "part")).where("at % 2 = 1 AND at < n - 1 AND part <> ''")
    return parts.select("doc_id", ((F.col("at") + 1) / 2).cast("bigint").alias("fence_no"), F.substr("part", F.lit(2)).alias("code"))


def code_fences(spark: SparkSession, d: str) -> DataFrame:
    """The code between fences, as hash and lines; a fence left open gives none."""
    return _fenced(spark, d).select("doc_id", "fence_no", F.sha2("code", 256).alias("hash"), F.size(F.split("code", "\n")).cast("bigint").alias("lines"))


def repeated_fences(spark: SparkSession, d: str) -> DataFrame:
    """Code that one document has between several fences, but for blanks at the ends of lines and around it."""
    bare = strip(F.array_join(F.transform(F.split(strip(F.col("code")), "\n"), lambda x: F.regexp_replace(x, f"{WS}+$", "")), "\n"))
    rows = _fenced(spark, d).select("doc_id", bare.alias("code")).where("code <> ''")
    return rows.groupBy("doc_id", F.sha2("code", 256).alias("hash")).agg(F.count("*").alias("times")).where("times > 1")


def structure_issues(spark: SparkSession, d: str) -> DataFrame:
    """Documents with an odd number of fences or without exactly one first-level heading."""
    fences = F.regexp_count("text", F.lit("```"))
    heads = F.size(F.filter(F.split("text", "\n"), lambda x: x.startswith("# ")))
    rows = _docs(spark, d).select("doc_id", (fences % 2 != 0).alias("open_fence"), heads.cast("bigint").alias("first_level"))
    return rows.where("open_fence OR first_level <> 1")


def issue_counts(spark: SparkSession, d: str) -> DataFrame:
    """Issues by kind and severity over all documents."""
    structure = structure_issues(spark, d)
    parts = [
        structure.where("open_fence").select(F.lit("markdown").alias("kind"), F.lit("error").alias("severity"), "doc_id"),
        structure.where("first_level <> 1").select(F.lit("heading").alias("kind"), F.lit("error").alias("severity"), "doc_id"),
        unknown_citations(spark, d).select(F.lit("sources").alias("kind"), F.lit("error").alias("severity"), "doc_id"),
        weak_claims(spark, d).select(F.lit("overlap").alias("kind"), F.lit("warning").alias("severity"), "doc_id"),
        repeated_fences(spark, d).select(F.lit("duplicate_code").alias("kind"), F.lit("warning").alias("severity"), "doc_id"),
    ]
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part)
    return every.groupBy("kind", "severity").agg(F.count("*").alias("issues"), F.countDistinct("doc_id").alias("documents"))


def excerpts(spark: SparkSession, d: str) -> DataFrame:
    """The start of each document in one line, as hash and size."""
    rows = _docs(spark, d).select("doc_id", truncated(F.col("text"), EXCERPT).alias("excerpt"))
    return rows.select("doc_id", F.sha2("excerpt", 256).alias("hash"), F.length("excerpt").cast("bigint").alias("chars"))


QUERIES = {
    f.__name__: f
    for f in (
        chunk_sections, block_sections, section_tops, outline, citations, unknown_citations, weak_claims, narrative_claims, source_mentions,
        markdown_sections, heading_issues, code_fences, repeated_fences, structure_issues, issue_counts, excerpts,
    )
}

_SCORES = ", ".join("({0}, {1}, '{2}')".format(" + ".join(f"CAST(contains(t, '{w}') AS INT)" for w in words), -i, title) for i, (title, words) in enumerate(SECTIONS))
_CS = f"""{tl.CHUNKS}, ct AS (SELECT DISTINCT id, video_id, s, lower(concat_ws(' ', nullif(topic, ''), nullif(summary, ''), nullif(transcript, ''), nullif(ocr_text, ''))) AS t FROM ch),
cs AS (SELECT id AS chunk_id, video_id, s, list_max([{_SCORES}]) AS m FROM ct), sec AS (SELECT chunk_id, video_id, s, CASE WHEN m[1] > 0 THEN m[3] ELSE '{DEFAULT_SECTION}' END AS section FROM cs)"""
_TOPS = f"""tops AS (SELECT section, row_number() OVER (PARTITION BY section ORDER BY s, chunk_id) AS place, chunk_id, greatest(count(*) OVER (PARTITION BY section) - {TOP_CHUNKS}, 0) AS more FROM sec WHERE s IS NOT NULL)"""
_LN = """raw AS (SELECT doc_id, video_id, string_split(text, chr(10)) AS ls FROM documents WHERE text IS NOT NULL),
ln AS (SELECT doc_id, video_id, unnest(ls) AS line, generate_subscripts(ls, 1) - 1 AS line_no FROM raw)"""
_CIT = f"""{_LN}, ci AS (SELECT DISTINCT doc_id, video_id, line_no, line, CAST(unnest(regexp_extract_all(line, '\\[(\\d{{1,3}})\\]', 1)) AS BIGINT) AS rank FROM ln),
so AS (SELECT video_id, chunk_id, s, e, source, rank FROM (SELECT video_id, id AS chunk_id, s, e, concat_ws(' ', summary, transcript) AS source, row_number() OVER (PARTITION BY video_id ORDER BY id) AS rank FROM (SELECT DISTINCT video_id, id, s, e, summary, transcript FROM ch)) WHERE rank <= {MOST_SOURCES})"""
_RUN = f"""{_LN}, ru AS (SELECT *, sum(CAST(starts_with(line, '## ') AS INT)) OVER w AS section_no, sum(CAST(regexp_matches(line, '^[ \\t]*```') AS INT)) OVER w AS fences FROM ln WINDOW w AS (PARTITION BY doc_id ORDER BY line_no ROWS UNBOUNDED PRECEDING))"""
_FENCE = f"""{_RUN}, ft AS (SELECT doc_id, max(fences) AS total FROM ru GROUP BY 1),
fe AS (SELECT doc_id, CAST((fences + 1) / 2 AS BIGINT) AS fence_no, sha256(string_agg(line, chr(10) ORDER BY line_no)) AS hash, count(*) AS lines FROM ru JOIN ft USING (doc_id) WHERE fences % 2 = 1 AND fences < total AND NOT regexp_matches(line, '^[ \\t]*```') GROUP BY doc_id, fences)"""


_SAME = f"""bare AS (SELECT doc_id, {sql_strip("array_to_string(list_transform(string_split(" + sql_strip('code') + ", chr(10)), lambda l: regexp_replace(l, '" + WS + "+$', '')), chr(10))")} AS code FROM (
  SELECT doc_id, string_agg(line, chr(10) ORDER BY line_no) AS code FROM ru JOIN ft USING (doc_id) WHERE fences % 2 = 1 AND fences < total AND NOT regexp_matches(line, '^[ \\t]*```') GROUP BY doc_id, fences)),
same AS (SELECT doc_id, sha256(code) AS hash, count(*) AS times FROM bare WHERE code <> '' GROUP BY ALL HAVING count(*) > 1)"""


def _clock(ms: str) -> str:
    """HH:MM:SS of a time in ms, rounded half to even, not below zero."""
    x = f"greatest(0, CAST(CASE WHEN {ms} % 1000 = 500 THEN 2 * (({ms} // 1000 + 1) // 2) ELSE ({ms} + 500) // 1000 END AS BIGINT))"
    return f"CASE WHEN {ms} IS NOT NULL THEN printf('%02d:%02d:%02d', {x} // 3600, ({x} % 3600) // 60, {x} % 60) END"


def _tok(c: str) -> str:
    return f"list_distinct(list_filter(list_transform(regexp_extract_all({c}, '{TOKEN}'), lambda x: lower(x)), lambda x: length(x) > 2))"


_WEAK = f"""wk AS (SELECT doc_id, line_no, rank, len({_tok('line')}) AS said, len({_tok('source')}) AS backed, len(list_intersect({_tok('line')}, {_tok('source')})) AS shared FROM ci JOIN so USING (video_id, rank)),
we AS (SELECT doc_id, line_no, rank, said, shared FROM wk WHERE said > 0 AND backed > 0 AND shared < CAST({LEAST_OVERLAP} AS DOUBLE) * said)"""
_UNK = "un AS (SELECT DISTINCT doc_id, rank FROM ci WHERE NOT EXISTS (SELECT 1 FROM so WHERE so.video_id = ci.video_id AND so.rank = ci.rank))"
_STR = """st AS (SELECT doc_id, ((length(text) - length(replace(text, '```', ''))) // 3) % 2 <> 0 AS open_fence, len(list_filter(string_split(text, chr(10)), lambda x: starts_with(x, '# '))) AS first_level FROM documents WHERE text IS NOT NULL)"""

SQL = {
    "chunk_sections": f"WITH {_CS} SELECT * FROM sec",
    "block_sections": f"WITH {_CS}, {tl.BLOCKS}, h AS (SELECT bl.id AS block_id, min(ch.id) AS chunk_id FROM bl LEFT JOIN ch ON ch.video_id = bl.video_id AND bl.t BETWEEN ch.s AND ch.e WHERE bl.t IS NOT NULL GROUP BY 1) SELECT coalesce(section, '{CODE_SECTION}') AS section, count(DISTINCT block_id) AS blocks FROM h LEFT JOIN sec USING (chunk_id) GROUP BY 1",
    "section_tops": f"WITH {_CS}, {_TOPS} SELECT * FROM tops WHERE place <= {TOP_CHUNKS}",
    "outline": f"WITH {_CS}, {_TOPS}, l AS (SELECT section, place, '- ' || tops.chunk_id || ': ' || coalesce({sql_truncated('summary', 80)}, '?') AS line FROM tops JOIN (SELECT DISTINCT id, summary FROM ch) c ON c.id = tops.chunk_id WHERE place <= {TOP_CHUNKS}) SELECT section, '## ' || section || chr(10) || chr(10) || string_agg(line, chr(10) ORDER BY place) AS markdown FROM l GROUP BY section",
    "citations": f"WITH {tl.CHUNKS}, {_CIT} SELECT doc_id, rank, count(*) AS lines FROM ci GROUP BY ALL",
    "unknown_citations": f"WITH {tl.CHUNKS}, {_CIT}, {_UNK} SELECT * FROM un",
    "weak_claims": f"WITH {tl.CHUNKS}, {_CIT}, {_WEAK} SELECT * FROM we",
    "markdown_sections": f"WITH {_RUN} SELECT doc_id, CAST(section_no AS BIGINT) AS section_no, max(CASE WHEN starts_with(line, '## ') THEN {sql_non_empty('substr(line, 4)')} END) AS title, count(*) - 1 AS lines, max(regexp_matches(line, '[^ \\t\\r]') AND NOT starts_with(line, '## ') AND NOT regexp_matches(line, '^[ \\t]*<!--')) AS has_text FROM ru WHERE section_no > 0 GROUP BY doc_id, section_no",
    "code_fences": f"WITH {_FENCE} SELECT * FROM fe",
    "repeated_fences": f"WITH {_FENCE}, {_SAME} SELECT doc_id, hash, times FROM same",
    "narrative_claims": f"""WITH {tl.CHUNKS}, {_CIT}, {_RUN.replace(_LN + ', ', '')},
hd AS (SELECT *, CASE WHEN fences % 2 = 0 AND NOT regexp_matches(line, '^[ \\t]*```') THEN {sql_strip('line')} END AS st FROM ru),
hn AS (SELECT *, sum(CAST(starts_with(st, '## ') AS INT)) OVER (PARTITION BY doc_id ORDER BY line_no ROWS UNBOUNDED PRECEDING) AS hno FROM hd),
hg AS (SELECT *, max(CASE WHEN starts_with(st, '## ') THEN substr(st, 4) END) OVER (PARTITION BY doc_id, hno) AS heading FROM hn WHERE hno > 0),
tl AS (SELECT doc_id, video_id, heading, line_no, regexp_replace(regexp_replace(st, '^[- ]+', ''), '^[0-9. ]+', '') AS line FROM hg
  WHERE st IS NOT NULL AND st <> '' AND NOT starts_with(st, '#') AND NOT ({' OR '.join(f"starts_with(st, '{x}')" for x in PLACEHOLDERS)})),
tc AS (SELECT *, list_distinct(regexp_extract_all(line, '\\[(\\d{{1,3}})\\]', 1)) AS ranks FROM tl WHERE line <> ''),
tr AS (SELECT doc_id, video_id, heading, line, CAST(unnest(ranks) AS BIGINT) AS rank FROM tc),
nc AS (SELECT doc_id, 'uncited' AS issue FROM tc WHERE len(ranks) = 0
  UNION ALL SELECT doc_id, 'low_overlap' FROM tr JOIN so USING (video_id, rank) WHERE len({_tok('line')}) > 0 AND len({_tok('source')}) > 0 AND len(list_intersect({_tok('line')}, {_tok('source')})) < CAST({LEAST_OVERLAP} AS DOUBLE) * len({_tok('line')}))
SELECT doc_id, issue, count(*) AS claims FROM nc GROUP BY ALL""",
    "heading_issues": f"""WITH {_RUN}, se AS (SELECT doc_id, section_no, max(CASE WHEN starts_with(line, '## ') THEN {sql_strip('substr(line, 4)')} END) AS title,
  max(regexp_matches(line, '[^ \\t\\r]') AND NOT starts_with(line, '## ') AND NOT regexp_matches(line, '^[ \\t]*<!--')) AS filled FROM ru WHERE section_no > 0 GROUP BY doc_id, section_no),
w AS (SELECT doc_id, h.heading FROM documents, (SELECT unnest([{', '.join(f"'{x}'" for x in REQUIRED)}]) AS heading) h WHERE source = 'section_exports' AND text IS NOT NULL),
r AS (SELECT w.doc_id, w.heading, arg_max(filled, section_no) AS filled FROM w LEFT JOIN se ON se.doc_id = w.doc_id AND se.title = w.heading GROUP BY ALL)
SELECT heading, CASE WHEN filled IS NULL THEN 'missing' ELSE 'empty' END AS issue, count(*) AS documents FROM r WHERE filled IS NULL OR NOT filled GROUP BY ALL""",
    "source_mentions": f"""WITH {tl.CHUNKS}, {tl.VIDEOS}, {_CIT},
n AS (SELECT so.video_id, so.s, so.e, v.filename, {_clock('so.s')} AS cs, {_clock('so.e')} AS ce FROM so LEFT JOIN (SELECT DISTINCT id, filename FROM vi) v ON v.id = so.video_id),
p AS (SELECT *, CASE WHEN e IS NULL THEN CASE WHEN s IS NOT NULL THEN '@' || cs END ELSE coalesce(cs, '00:00:00') || '-' || ce END AS span FROM n)
SELECT doc_id, count(*) AS sources, count(*) FILTER (filename <> '' AND NOT contains(text, filename)) AS unnamed, count(*) FILTER (span <> '' AND NOT contains(text, span)) AS untimed
FROM documents d JOIN p USING (video_id) WHERE d.source = 'section_exports' AND text IS NOT NULL GROUP BY doc_id""",
    "structure_issues": f"WITH {_STR} SELECT * FROM st WHERE open_fence OR first_level <> 1",
    "issue_counts": f"""WITH {tl.CHUNKS}, {_CIT}, {_UNK}, {_WEAK}, {_STR},
{_FENCE.replace(_LN + ', ', '')}, {_SAME}, i AS (
SELECT 'markdown' AS kind, 'error' AS severity, doc_id FROM st WHERE open_fence UNION ALL SELECT 'heading', 'error', doc_id FROM st WHERE first_level <> 1
UNION ALL SELECT 'sources', 'error', doc_id FROM un UNION ALL SELECT 'overlap', 'warning', doc_id FROM we
UNION ALL SELECT 'duplicate_code', 'warning', doc_id FROM same)
SELECT kind, severity, count(*) AS issues, count(DISTINCT doc_id) AS documents FROM i GROUP BY ALL""",
    "excerpts": f"WITH x AS (SELECT doc_id, {sql_truncated('text', EXCERPT)} AS e FROM documents WHERE text IS NOT NULL) SELECT doc_id, sha256(e) AS hash, length(e) AS chars FROM x",
}
