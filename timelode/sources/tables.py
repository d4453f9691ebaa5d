"""Readers of the domain tables, one row per record."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str | tuple[str, ...], name: str) -> DataFrame:
    """A table of a folder, or of the first of several folders that has it."""
    folders = (sf_dir,) if isinstance(sf_dir, str) else sf_dir
    for folder in folders[:-1]:
        if exists(spark, f"{folder}/{name}.parquet"):
            return spark.read.parquet(f"{folder}/{name}.parquet")
    return spark.read.parquet(f"{folders[-1]}/{name}.parquet")


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path is there, on any file system that Spark reads."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


def records(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """The named columns of a table whose `id` repeats: the repeats differ at most in the ingest time,
    so the distinct projection (pre-aggregated before its shuffle) has one row per record."""
    return table(spark, sf_dir, name).select(*columns).distinct()


def media_ms(seconds: Column | str) -> Column:
    """Media seconds as whole milliseconds; NULL for NULL, NaN, infinite or out-of-range values."""
    c = F.col(seconds) if isinstance(seconds, str) else seconds
    return F.round(c * 1000).try_cast("bigint")
