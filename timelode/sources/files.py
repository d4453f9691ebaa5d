"""Scans of file trees and manifests, and text sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def scan_files(
    spark: SparkSession, root: str, *, suffixes: list[str] | None = None, max_mb: float | None = None, skip_folders: list[str] = (), content: bool = False
) -> DataFrame:
    """path, bytes, modified (and sha256 with `content`): the files below a folder whose lower-case suffix is
    one of `suffixes`, not larger than `max_mb` and in none of the named folders. Only listings are read
    unless the content is wanted; an empty folder gives no row."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    named = files.select(F.col("path"), F.col("length").alias("bytes"), F.col("modificationTime").alias("modified"), *([F.col("content")] if content else []))
    if suffixes is not None:
        named = named.where(F.lower(F.regexp_extract("path", r"(\.[^./]+)$", 1)).isin([s.lower() for s in suffixes]))
    if max_mb is not None:
        named = named.where(F.col("bytes") <= int(max_mb * 2**20))
    for folder in skip_folders:
        named = named.where(~F.contains("path", F.lit(f"/{folder}/")))
    return named.withColumn("sha256", F.sha2("content", 256)).drop("content") if content else named


def fingerprint(files: DataFrame) -> DataFrame:
    """A cheap fingerprint of each scanned file, from its size and time of change."""
    mark = F.concat(F.lit("size="), F.col("bytes").cast("string"), F.lit(";mtime_us="), F.unix_micros("modified").cast("string"))
    return files.withColumn("fingerprint", mark)


def read_manifests(spark: SparkSession, path: str, schema: StructType | str) -> tuple[DataFrame, DataFrame]:
    """(good, broken): JSON documents that fit the schema, and the text of those that don't."""
    kind = schema if isinstance(schema, StructType) else StructType.fromDDL(schema)
    wide = StructType([*kind.fields]).add("_corrupt_record", "string")
    raw = spark.read.option("wholetext", True).text(path).select(F.from_json("value", wide, {"mode": "PERMISSIVE"}).alias("d"))
    good = raw.where("d IS NOT NULL AND d._corrupt_record IS NULL").select("d.*").drop("_corrupt_record")
    return good, raw.where("d._corrupt_record IS NOT NULL").select(F.col("d._corrupt_record").alias("text"))


def read_texts(spark: SparkSession, path: str, glob: str) -> DataFrame:
    """path, text: whole text files that match a pattern."""
    rows = spark.read.option("wholetext", True).option("pathGlobFilter", glob).option("recursiveFileLookup", True).text(path)
    return rows.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def write_texts(df: DataFrame, path: str, *, name: str, text: str) -> None:
    """One folder of text per name; the committer makes each write whole or absent."""
    df.select(F.col(name).alias("name"), F.col(text).alias("value")).write.mode("overwrite").partitionBy("name").text(path)
