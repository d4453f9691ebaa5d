"""Queries on code: normal forms, kinds, groups of equal blocks, flags of frames, line blocks, symbols."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from timelode.functions import code_rules as cr
from timelode.operators.scan import row_numbers
from timelode.plans import timeline as tl
from timelode.sources.tables import table

LINES = 80
NOT_CODE = ("plain_text", "ui_label")


def code_normal(spark: SparkSession, d: str) -> DataFrame:
    """The mild normal form of each code block, as its hash and size."""
    rows = tl._blocks(spark, d, "code").select("id", cr.normal_code(F.col("code")).alias("normal")).distinct()
    return rows.select("id", F.sha2("normal", 256).alias("normalized_hash"), F.length("normal").cast("bigint").alias("chars"))


def code_kinds(spark: SparkSession, d: str) -> DataFrame:
    """Kind and language of each code block by the ordered rules."""
    rows = tl._blocks(spark, d, "code").select("id", cr.normal_code(F.col("code")).alias("normal")).where("normal <> ''").distinct()
    return rows.select("id", cr.code_kind(F.col("normal")).alias("k")).select("id", "k.content_type", "k.language")


def _screen_code(spark: SparkSession, d: str) -> DataFrame:
    """Frames whose screen text is code-like, with its kind, stripped of prompts if it is a command."""
    rows = tl._frames(spark, d, "ocr_text", "ocr_confidence").select("video_id", "id", "t", "ocr_confidence", cr.normal_code(F.col("ocr_text")).alias("normal")).where("normal <> ''")
    rows = rows.withColumn("k", cr.code_kind(F.col("normal"))).select("*", "k.content_type", "k.language").where(~F.col("content_type").isin(*NOT_CODE))
    code = F.when(F.col("content_type") == "terminal_command", cr.normal_code(cr.without_prompts(F.col("normal")))).otherwise(F.col("normal"))
    return rows.withColumn("hash", F.sha2(code, 256))


def screen_code_groups(spark: SparkSession, d: str) -> DataFrame:
    """Equal code seen in several frames of a video as one group with its times, first frame and best confidence,
    numbered per video by (first time, hash, kind, language). Frames without a video or time are left out."""
    groups = (
        _screen_code(spark, d).where("video_id IS NOT NULL AND t IS NOT NULL")
        .groupBy("video_id", "content_type", "language", "hash")
        .agg(F.countDistinct("id").alias("frames"), F.min("t").alias("first_ms"), F.max("t").alias("last_ms"), F.max("ocr_confidence").alias("confidence"), F.min(F.struct("t", "id")).alias("seen"))
    )
    groups = groups.withColumn("bucket", F.floor(F.col("first_ms") / 3_600_000)).withColumn("first_frame", F.col("seen.id")).drop("seen")
    groups = row_numbers(groups, ["video_id"], "bucket", ["first_ms", "hash", "content_type", "language"], "ordinal").drop("bucket")
    return groups.withColumn("last_ms", F.when(F.col("frames") > 1, F.col("last_ms"))).withColumn(
        "needs_review", F.coalesce(F.col("confidence") < cr.MIN_CONFIDENCE, F.lit(False))
    )


def frame_code_flags(spark: SparkSession, d: str) -> DataFrame:
    """For every frame whether code was found on it now and whether the stored flag differs."""
    found = _screen_code(spark, d).select("id").distinct().withColumn("now", F.lit(True))
    frames = tl._frames(spark, d, "contains_code").select("id", "contains_code").distinct()
    now = F.coalesce("now", F.lit(False))
    return frames.join(found, "id", "left").select("id", now.alias("contains_code_now"), (now != F.coalesce("contains_code", F.lit(False))).alias("changed"))


def code_classes(spark: SparkSession, d: str) -> DataFrame:
    """How far each code block can be trusted, counted per video and class."""
    c = F.col("confidence")
    kind = F.when(F.col("verified"), "verified").when(c >= 0.9, "high_confidence").when(c >= 0.8, "ocr_extracted").otherwise("needs_review")
    return tl._blocks(spark, d, "verified", "confidence").select("id", "video_id", kind.alias("class")).distinct().groupBy("video_id", "class").agg(F.count("*").alias("blocks"))


def analysis_gaps(spark: SparkSession, d: str) -> DataFrame:
    """Code blocks without an analysis and analyses without a block, from a full outer join."""
    blocks = tl._blocks(spark, d).select(F.col("id").alias("code_block_id")).distinct().withColumn("has_block", F.lit(True))
    analyses = table(spark, d, "code_analyses").select("code_block_id").distinct().withColumn("has_analysis", F.lit(True))
    both = blocks.join(analyses, "code_block_id", "full_outer").where("has_block IS NULL OR has_analysis IS NULL")
    return both.select("code_block_id", F.coalesce("has_block", F.lit(False)).alias("has_block"), F.coalesce("has_analysis", F.lit(False)).alias("has_analysis"))


def stale_hashes(spark: SparkSession, d: str) -> DataFrame:
    """Analyses whose stored hash isn't that of their stored normal form."""
    rows = table(spark, d, "code_analyses").select("code_block_id", "normalized_hash", F.sha2("normalized_code", 256).alias("expected"))
    return rows.where("NOT normalized_hash <=> expected")


def _read(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """What parsers say of each text as JSON, Python and YAML: an error, or empty where it is valid."""
    import ast
    import json

    try:
        import yaml
    except ImportError:  # texts in YAML aren't judged then
        yaml = None

    def json_error(text: str) -> str:
        try:
            json.loads(text)
        except (ValueError, RecursionError) as e:
            return str(e) or "invalid"
        return ""

    def python_error(text: str) -> str:
        try:
            ast.parse(text)
        except (SyntaxError, ValueError, RecursionError, MemoryError) as e:
            return str(e) or "invalid"
        return ""

    def yaml_error(text: str) -> str | None:
        if yaml is None:
            return None
        try:
            loaded = yaml.safe_load(text)
        except (yaml.YAMLError, ValueError, RecursionError) as e:
            return str(e) or "invalid"
        return "" if isinstance(loaded, (dict, list)) else "only a scalar"

    for part in parts:
        text = part["normal"]
        yield part.assign(json=text.map(json_error), python=text.map(python_error), yaml=text.map(yaml_error))


def code_reviews(spark: SparkSession, d: str) -> DataFrame:
    """Each code block's kind, what its parser says, whether it counts as verified, and the reasons to look at it
    again: low confidence, invalid, not verified. Kinds without a parser are verified by rule or not at all."""
    rows = tl._blocks(spark, d, "code", "confidence").select("id", "confidence", cr.normal_code(F.col("code")).alias("normal")).where("normal <> ''").distinct()
    read = rows.mapInPandas(_read, "id string, confidence double, normal string, json string, python string, yaml string")
    read = read.withColumn("k", cr.code_kind(F.col("normal"), F.col("python") == "")).select("id", "confidence", "k.*", "json", "python", "yaml")
    error = F.when(F.col("language") == "json", F.col("json")).when(F.col("language") == "yaml", F.col("yaml")).when(F.col("language") == "python", F.col("python"))
    status = F.when(error == "", "valid").when(error.isNotNull(), "invalid").otherwise("not_applicable")
    ruled = F.col("content_type").isin("terminal_command", "file_path", "error_message")
    judged = read.select("id", "content_type", "language", "confidence", status.alias("validation"), F.nullif(error, F.lit("")).alias("error"), (F.coalesce(error == "", F.lit(False)) | ruled).alias("verified"))
    reasons = F.filter(
        F.array(
            F.when(F.col("confidence") < cr.MIN_CONFIDENCE, F.lit("confidence")),
            F.when(F.col("validation") == "invalid", F.lit("validation")),
            F.when(~F.col("verified"), F.lit("unverified")),
        ),
        lambda x: x.isNotNull(),
    )
    return judged.select("id", "content_type", "language", "validation", "error", "verified", F.when(F.col("content_type").isin(*NOT_CODE), F.array().cast("array<string>")).otherwise(reasons).alias("reasons"))


def line_blocks(spark: SparkSession, d: str) -> DataFrame:
    """Documents cut into blocks of 80 lines, blocks without text skipped, with their line range."""
    docs = table(spark, d, "documents").where("text IS NOT NULL").select("doc_id", F.split("text", "\n").alias("lines"))
    starts = F.transform(F.sequence(F.lit(0), F.floor((F.size("lines") - 1) / LINES)), lambda i: i * LINES + 1)
    blocks = docs.select("doc_id", "lines", F.explode(starts).alias("first"))
    part = F.slice("lines", F.col("first").cast("int"), LINES)
    rows = blocks.select("doc_id", F.col("first").cast("bigint").alias("first_line"), part.alias("part")).where(F.exists("part", lambda x: x.rlike(r"[^ \t\r]")))
    return rows.select("doc_id", "first_line", (F.col("first_line") + F.size("part") - 1).alias("last_line"), F.sha2(F.array_join("part", "\n"), 256).alias("hash"))


def python_symbols(spark: SparkSession, d: str) -> DataFrame:
    """Top-level functions and classes of the Python code blocks with their line ranges; none where the
    code doesn't parse."""
    rows = tl._blocks(spark, d, "language", "code").where("lower(language) = 'python'").select("id", "code").distinct()
    return rows.mapInPandas(_symbols, "id string, name string, first_line bigint, last_line bigint")


def _symbols(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    import ast

    kinds = (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)
    for part in parts:
        found = []
        for block, code in part.itertuples(index=False):
            try:
                body = ast.parse(code).body
            except (SyntaxError, ValueError, RecursionError):
                continue
            found += [(block, n.name, n.lineno, n.end_lineno) for n in body if isinstance(n, kinds)]
        yield pd.DataFrame(found, columns=["id", "name", "first_line", "last_line"])


QUERIES = {
    f.__name__: f
    for f in (code_normal, code_kinds, screen_code_groups, frame_code_flags, code_classes, code_reviews, analysis_gaps, stale_hashes, line_blocks, python_symbols)
}


def _q(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


_EDGE = _q(cr._EDGE)


def sql_normal(c: str) -> str:
    text = f"regexp_replace(regexp_replace({c}, '\\r\\n', chr(10), 'g'), '\\r', chr(10), 'g')"
    rows = f"list_transform(string_split({text}, chr(10)), lambda l: CASE WHEN regexp_full_match(l, '[ \\t]*') THEN '' ELSE l END)"
    indent = f"list_min(list_transform(list_filter({rows}, lambda l: l <> ''), lambda l: length(l) - length(regexp_replace(l, '^[ \\t]+', ''))))"
    body = f"array_to_string(list_transform({rows}, lambda l: substr(l, coalesce({indent}, 0) + 1)), chr(10))"
    body = f"regexp_replace({body}, {_EDGE}, '', 'g')"
    body = f"regexp_replace({body}, '(?m)[ \\t\\r\\f\\x0b]+$', '', 'g')"
    return f"regexp_replace({body}, '\\n{{3,}}', chr(10) || chr(10), 'g')"


def sql_bare(c: str) -> str:
    line = f"regexp_replace(regexp_replace(l, {_q(cr.PROMPT)}, ''), '[ \\t]+$', '')"
    return f"regexp_replace(array_to_string(list_transform(string_split({c}, chr(10)), lambda l: {line}), chr(10)), {_EDGE}, '', 'g')"


def _said(c: str) -> str:
    return f"list_filter(list_transform(string_split({c}, chr(10)), lambda l: regexp_replace(l, {_EDGE}, '', 'g')), lambda l: l <> '')"


def _all(items: str, test: str) -> str:
    return f"(len({items}) > 0 AND len(list_filter({items}, lambda l: NOT ({test}))) = 0)"


def sql_kind(c: str) -> str:
    said = _said(c)
    commands = ", ".join(_q(x) for x in cr.SHELL_COMMANDS)
    command = f"((bare <> regexp_replace({c}, {_EDGE}, '', 'g') AND bare <> '') OR {_all(_said('bare'), f'lower(regexp_extract(l, {_q(chr(94) + chr(92) + 'S+')})) IN ({commands}) OR starts_with(l, {_q('./')}) OR starts_with(l, {_q('../')})')})"
    has = lambda p: f"regexp_matches({c}, {_q(p)})"
    pairs = f"len(list_filter({said}, lambda l: regexp_matches(l, {_q(cr.KEY_VALUE)})))"
    script = f"({has(cr.SCRIPT)} OR {has(cr.SCRIPT_END)})"
    rules = [
        (command, "terminal_command/bash"),
        (f"(starts_with({c}, '{{') AND ends_with({c}, '}}')) OR (starts_with({c}, '[') AND ends_with({c}, ']'))", "configuration/json"),
        (has(cr.HTML), "source_code/html"),
        (has(cr.DOCKER), "configuration/dockerfile"),
        (has(cr.CSS), "source_code/css"),
        (has(cr.SQL), "source_code/sql"),
        (has(cr.PYTHON), "source_code/python"),
        (f"{script} AND {has(cr.TYPED)}", "source_code/typescript"),
        (script, "source_code/javascript"),
        (f"len({said}) >= 2 AND ({pairs} >= 2 OR ({pairs} >= 1 AND len(list_filter({said}, lambda l: starts_with(l, '- '))) > 0))", "configuration/yaml"),
        (has(cr.ERROR), "error_message/other"),
        (_all(said, f"regexp_matches(l, {_q(cr.FILE_PATH)})"), "file_path/other"),
        (f"len(list_filter(regexp_split_to_array({c}, '[ \\t\\n]+'), lambda w: w <> '')) <= 5 AND NOT contains({c}, chr(10)) AND NOT regexp_matches({c}, '[{{}}\\[\\]();=$`]')", "ui_label/other"),
    ]
    return "CASE " + " ".join(f"WHEN {test} THEN {_q(kind)}" for test, kind in rules) + " ELSE 'plain_text/other' END"


_KINDS = f"""n AS (SELECT DISTINCT id, {sql_normal('code')} AS c FROM bl), b AS (SELECT *, {sql_bare('c')} AS bare FROM n WHERE c <> '')"""
_SCREEN = f"""{tl.FRAMES}, n AS (SELECT DISTINCT video_id, id, t, ocr_confidence, {sql_normal('ocr_text')} AS c FROM fr), b AS (SELECT *, {sql_bare('c')} AS bare FROM n WHERE c <> ''),
k AS (SELECT *, {sql_kind('c')} AS kind FROM b),
sc AS (SELECT *, split_part(kind, '/', 1) AS content_type, split_part(kind, '/', 2) AS language, sha256(CASE WHEN kind = 'terminal_command/bash' THEN {sql_normal('bare')} ELSE c END) AS hash FROM k WHERE kind NOT IN ('plain_text/other', 'ui_label/other'))"""

SQL = {
    "code_normal": f"WITH {tl.BLOCKS} SELECT DISTINCT id, sha256({sql_normal('code')}) AS normalized_hash, length({sql_normal('code')}) AS chars FROM bl",
    "code_kinds": f"WITH {tl.BLOCKS}, {_KINDS}, k AS (SELECT id, {sql_kind('c')} AS kind FROM b) SELECT id, split_part(kind, '/', 1) AS content_type, split_part(kind, '/', 2) AS language FROM k",
    "screen_code_groups": f"WITH {_SCREEN} SELECT video_id, content_type, language, hash, count(DISTINCT id) AS frames, min(t) AS first_ms, CASE WHEN count(DISTINCT id) > 1 THEN max(t) END AS last_ms, max(ocr_confidence) AS confidence, coalesce(max(ocr_confidence) < {cr.MIN_CONFIDENCE}, false) AS needs_review, arg_min(id, (t, id)) AS first_frame, row_number() OVER (PARTITION BY video_id ORDER BY min(t), hash, content_type, language) AS ordinal FROM sc WHERE video_id IS NOT NULL AND t IS NOT NULL GROUP BY video_id, content_type, language, hash",
    "frame_code_flags": f"WITH {_SCREEN} SELECT DISTINCT fr.id, s.id IS NOT NULL AS contains_code_now, (s.id IS NOT NULL) <> coalesce(fr.contains_code, false) AS changed FROM fr LEFT JOIN (SELECT DISTINCT id FROM sc) s ON s.id = fr.id",
    "code_classes": f"WITH {tl.BLOCKS}, c AS (SELECT DISTINCT id, video_id, CASE WHEN verified THEN 'verified' WHEN confidence >= 0.9 THEN 'high_confidence' WHEN confidence >= 0.8 THEN 'ocr_extracted' ELSE 'needs_review' END AS class FROM bl) SELECT video_id, class, count(*) AS blocks FROM c GROUP BY ALL",
    "analysis_gaps": f"WITH {tl.BLOCKS} SELECT coalesce(b.id, a.code_block_id) AS code_block_id, b.id IS NOT NULL AS has_block, a.code_block_id IS NOT NULL AS has_analysis FROM (SELECT DISTINCT id FROM bl) b FULL OUTER JOIN (SELECT DISTINCT code_block_id FROM code_analyses) a ON a.code_block_id = b.id WHERE b.id IS NULL OR a.code_block_id IS NULL",
    "stale_hashes": "SELECT code_block_id, normalized_hash, sha256(normalized_code) AS expected FROM code_analyses WHERE normalized_hash IS DISTINCT FROM sha256(normalized_code)",
    "line_blocks": f"""WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents WHERE text IS NOT NULL),
b AS (SELECT doc_id, lines, unnest(generate_series(1, len(lines), {LINES})) AS f FROM l), p AS (SELECT doc_id, f AS first_line, list_slice(lines, f, f + {LINES - 1}) AS part FROM b)
SELECT doc_id, first_line, first_line + len(part) - 1 AS last_line, sha256(array_to_string(part, chr(10))) AS hash FROM p WHERE len(list_filter(part, lambda x: regexp_matches(x, '[^ \\t\\r]'))) > 0""",
}
