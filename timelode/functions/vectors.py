"""Feature-hashing embeddings of text: the exact one in Arrow batches, and one of built-in functions."""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from timelode.functions.text import TOKEN

DIMENSIONS = 256


def embed_blake2b(text: Column, dimensions: int = DIMENSIONS) -> Column:
    """array<double>: tokens hashed to signed buckets by blake2b, of unit length, 8 decimals. NULL for NULL."""
    pattern = re.compile(TOKEN)

    @F.pandas_udf("array<double>")
    def embed(texts: pd.Series) -> pd.Series:
        cache: dict[str, tuple[int, float]] = {}

        def place(token: str) -> tuple[int, float]:
            if token not in cache:
                digest = hashlib.blake2b(token.encode("utf-8", "surrogatepass"), digest_size=8).digest()
                cache[token] = int.from_bytes(digest[:4], "big") % dimensions, 1.0 if digest[4] & 1 else -1.0
            return cache[token]

        def one(text: str | None):
            if text is None:
                return None
            vector = np.zeros(dimensions)
            for token in pattern.findall(text):
                bucket, sign = place(token.lower())
                vector[bucket] += sign
            norm = np.sqrt((vector**2).sum())
            return np.round(vector / norm, 8) if norm else vector

        return texts.map(one)

    return embed(text)


def embed_sha(df: DataFrame, row_id: str, text: str, dimensions: int = DIMENSIONS) -> DataFrame:
    """row_id, bucket, weight: the same idea with SHA-256 in built-in functions, one row per bucket that
    isn't empty, before scaling. Texts without tokens give no row. The tokens of a text are combined before
    the one shuffle."""
    words = df.select(F.col(row_id), F.explode(F.regexp_extract_all(F.col(text), F.lit(TOKEN), F.lit(0))).alias("token"))
    words = words.select(row_id, F.sha2(F.lower("token"), 256).alias("digest"))
    bucket = F.pmod(F.conv(F.substring("digest", 1, 8), 16, 10).cast("bigint"), F.lit(dimensions))
    sign = F.when(F.substring("digest", 10, 1).isin(*"13579bdf"), F.lit(1)).otherwise(F.lit(-1)).cast("bigint")
    return words.select(row_id, bucket.alias("bucket"), sign.alias("sign")).groupBy(row_id, "bucket").agg(F.sum("sign").alias("weight")).where("weight <> 0")


def embed_sha_dense(text: Column, dimensions: int = DIMENSIONS) -> Column:
    """array<double>: the weights of `embed_sha` as one vector before scaling. NULL for NULL."""
    pattern = re.compile(TOKEN)

    @F.pandas_udf("array<double>")
    def embed(texts: pd.Series) -> pd.Series:
        cache: dict[str, tuple[int, float]] = {}

        def place(token: str) -> tuple[int, float]:
            if token not in cache:
                digest = hashlib.sha256(token.encode("utf-8", "surrogatepass")).digest()
                cache[token] = int.from_bytes(digest[:4], "big") % dimensions, 1.0 if digest[4] & 1 else -1.0
            return cache[token]

        def one(text: str | None):
            if text is None:
                return None
            found = [place(t.lower()) for t in pattern.findall(text)]
            return np.bincount([b for b, _ in found], [w for _, w in found], minlength=dimensions) if found else np.zeros(dimensions)

        return texts.map(one)

    return embed(text)
