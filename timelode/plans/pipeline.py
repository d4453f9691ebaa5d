"""The batch pipeline: chunks from media, labels' records from chunks, an index from records, pages and reports.

Every stage writes one table below the output folder and reads the tables that earlier stages wrote. A stage whose
inputs haven't changed since it last wrote is skipped; one that fails is reported, and so are those that need it.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from timelode.functions.markdown import to_html
from timelode.functions.vectors import embed_blake2b
from timelode.operators.maintenance import row_marks
from timelode.plans import chunking, code, documents, enrich, maintenance
from timelode.plans import timeline as tl
from timelode.sources.tables import exists, table

Tables = str | tuple[str, ...]


@dataclass(frozen=True)
class Stage:
    """What is written, from which tables (given ones or those of earlier stages), and how."""

    inputs: tuple[str, ...]
    query: Callable[[SparkSession, Tables], DataFrame]


def _chunks(spark: SparkSession, d: Tables) -> DataFrame:
    built = chunking.build_chunks(spark, d)
    return built.select("*", (F.col("start_ms") / 1000).alias("start_seconds"), (F.col("end_ms") / 1000).alias("end_seconds"))


def _index(spark: SparkSession, d: Tables) -> DataFrame:
    return table(spark, d, "records").withColumn("vector", embed_blake2b(F.col("text")))


STAGES = {
    "chunks": Stage(("transcript_segments", "frames", "code_blocks", "videos"), _chunks),
    "records": Stage(("chunks", "code_blocks"), enrich.record_texts),
    "index": Stage(("records",), _index),
    "screen_code": Stage(("frames",), code.screen_code_groups),
    "sections": Stage(("chunks",), documents.chunk_sections),
    "outline": Stage(("chunks",), documents.outline),
    "pages": Stage(("documents",), lambda spark, d: document_pages(spark, d)),
    "review": Stage(("documents", "chunks"), documents.issue_counts),
    "status": Stage(("videos", "transcript_segments", "frames", "code_blocks", "chunks"), maintenance.video_status),
}


def _signature(spark: SparkSession, d: Tables, names: tuple[str, ...]) -> str:
    """What the rows of the tables are, whatever their order: counts and sums of row hashes."""
    marks = []
    for name in names:
        rows = table(spark, d, name)
        packed = rows.select(F.to_json(F.struct(*[F.col(f"`{c}`") for c in rows.columns]), {"ignoreNullFields": "false"}).alias("row"))
        first, second = row_marks("row")
        marks.append("-".join(str(x) for x in packed.agg(F.count("*"), F.sum(first), F.sum(second)).first()))
    return " ".join(marks)


def run(spark: SparkSession, sf_dir: str, out: str, stages: dict[str, Stage] = STAGES) -> DataFrame:
    """Writes each stage's table below `out` and returns stage, status, rows, detail: `written`, `skipped` (inputs and
    output as before), `failed` with the reason, or `blocked` by a failed stage. What was written stays whole."""
    done: list[tuple[str, str, int | None, str | None]] = []
    places: Tables = (out, sf_dir)
    for name, stage in stages.items():
        path, broken = f"{out}/{name}.parquet", {s for s, status, *_ in done if status in ("failed", "blocked")}
        if waits := sorted(broken & set(stage.inputs)):
            done.append((name, "blocked", None, ", ".join(waits)))
            continue
        try:
            signature = _signature(spark, places, tuple(n for n in stage.inputs if n != name))
            noted = f"{out}/_signatures/{name}"
            if exists(spark, path) and exists(spark, noted) and spark.read.text(noted).first()[0] == signature:
                done.append((name, "skipped", spark.read.parquet(path).count(), None))
                continue
            stage.query(spark, sf_dir if name in stage.inputs else places).write.mode("overwrite").parquet(path)
            spark.createDataFrame([(signature,)], "value string").coalesce(1).write.mode("overwrite").text(noted)
            done.append((name, "written", spark.read.parquet(path).count(), None))
        except Exception as e:  # noqa: BLE001  a stage's failure is its status
            done.append((name, "failed", None, str(e).splitlines()[0][:200] if str(e) else type(e).__name__))
    return spark.createDataFrame(done, "stage string, status string, rows bigint, detail string")


def chunk_index(spark: SparkSession, d: str) -> DataFrame:
    """The search index over all chunk records: exact hashing embeddings of their texts."""
    rows = tl._chunks(spark, d, "topic", "summary", "transcript", "ocr_text").select("id", "video_id", F.concat_ws("\n\n", "topic", "summary", "transcript", "ocr_text").alias("text")).distinct()
    return rows.where("text <> ''").select(F.concat("id", F.lit("_combined")).alias("record_id"), "video_id", embed_blake2b(F.col("text")).alias("vector"))


def document_pages(spark: SparkSession, d: str) -> DataFrame:
    """All exported sections as HTML."""
    rows = table(spark, d, "documents").where("source = 'section_exports'")
    return rows.select("doc_id", to_html(F.col("text")).alias("html"))


def code_validity(spark: SparkSession, d: str) -> DataFrame:
    """Whether each JSON or Python code block parses; other languages aren't judged."""
    rows = tl._blocks(spark, d, "language", "code").select("id", F.lower("language").alias("language"), "code").where("language IN ('json', 'python')").distinct()
    json = rows.where("language = 'json'").select("id", "language", F.expr("try_parse_json(code) IS NOT NULL").alias("valid"))
    python = rows.where("language = 'python'").mapInPandas(_parses, "id string, language string, valid boolean")
    return json.unionByName(python)


def _parses(parts):
    import ast

    for part in parts:
        valid = []
        for text in part["code"]:
            try:
                ast.parse(text)
                valid.append(True)
            except (SyntaxError, ValueError, RecursionError):
                valid.append(False)
        yield part[["id", "language"]].assign(valid=valid)


QUERIES = {f.__name__: f for f in (chunk_index, document_pages, code_validity)}
SQL: dict[str, str] = {}  # blake2b, HTML and parsers have no SQL counterpart; tests hold them against cases
