"""Sizes of texts in tokens of a public tokenizer, whose vocabulary file is a parameter."""

from __future__ import annotations

import base64
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: how byte-level BPE of this family splits a text into words.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@lru_cache(4)
def encoding(path: str):
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("timelode", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})


def _count(path: str):
    def count(batches):
        encode = encoding(path).encode_ordinary
        for batch in batches:
            sizes = pa.array([len(encode(t)) for t in batch.column(0).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], sizes], [*batch.schema.names[1:], "tokens"])

    return count


def token_sizes(documents: DataFrame, text: str, keep: dict[str, str], vocabulary: str = VOCABULARY) -> DataFrame:
    """The columns named in `keep` ({column: type}) and `tokens bigint`, the size of `text`; a NULL text
    and one of invalid UTF-16 halves count like their valid part, an empty one has 0 tokens."""
    kept = [F.col(f"`{c}`").cast(t).alias(c) for c, t in keep.items()]
    rows = documents.select(F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("__text"), *kept)
    return rows.mapInArrow(_count(vocabulary), ", ".join(f"`{c}` {t}" for c, t in keep.items()) + ", tokens bigint")
