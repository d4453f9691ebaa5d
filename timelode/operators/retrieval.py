"""Cosine search of stated queries against a whole index, in blocks.

Index rows are spread over parts and queries over blocks; each (part, block) is one matrix product in one
task, which keeps the first rows per query. What is shuffled afterwards is a few rows per query and part.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PART_ROWS, BLOCK_QUERIES = 50_000, 2_048


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two numeric arrays in double precision; 0 if either is all zero, NULL if lengths differ."""
    a, b = a.cast("array<double>"), b.cast("array<double>")

    def dot(x: Column, y: Column) -> Column:
        return F.aggregate(F.zip_with(x, y, lambda u, v: u * v), F.lit(0.0), lambda total, v: total + v)

    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(F.size(a) == F.size(b), F.when(norms == 0, F.lit(0.0)).otherwise(dot(a, b) / F.nullif(norms, F.lit(0.0))))


def _rows(table: pa.Table, column: str) -> np.ndarray:
    if not len(table):
        return np.zeros((0, 1))
    flat = table.column(column).combine_chunks().flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(table), -1)


def _unit(x: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, norm, out=np.zeros_like(x), where=norm > 0)


def _best(k: int, once: bool, schema: pa.Schema):
    def best(queries: pa.Table, index: pa.Table) -> pa.Table:
        if not len(queries) or not len(index):
            return schema.empty_table()
        scores = np.round(_unit(_rows(queries, "vec")) @ _unit(_rows(index, "vec")).T, 6)
        _, order_of = np.unique(np.asarray(index.column("row_id")), return_inverse=True)
        _, number = np.unique(np.asarray(index.column("dedup_key")), return_inverse=True)
        asked, inside = np.asarray(queries.column("scope")), np.asarray(index.column("scope"))
        rows, cols = [], []
        for i, row in enumerate(scores):
            if asked[i] is not None:  # the filter comes before the ranking
                row = np.where(inside == asked[i], row, 0.0)
            # Below the k-th best score nothing is sorted; ids break ties, so all that tie with it stay.
            if once:
                top = np.full(number.max() + 1, -np.inf)
                np.maximum.at(top, number, row)
            else:
                top = row
            least = np.partition(top, -k)[-k] if len(top) > k else -np.inf
            some = np.nonzero((row >= least) & (row > 0))[0]
            some = some[np.lexsort((order_of[some], -row[some]))]
            if once:
                _, first = np.unique(number[some], return_index=True)
                some = some[np.sort(first)]
            rows.append(np.full(min(k, len(some)), i))
            cols.append(some[:k])
        at, of = np.concatenate(rows), np.concatenate(cols)
        picked = index.select(["row_id", "dedup_key"]).take(pa.array(of))
        return pa.Table.from_arrays([queries.column("query_id").take(pa.array(at)), *picked.columns, pa.array(scores[at, of])], schema=schema)

    return best


def search(queries: DataFrame, index: DataFrame, *, k: int, once_per_key: bool, scope: str | None = None) -> DataFrame:
    """query_id, row_id, dedup_key, score, place: for each query (query_id, vec) the first k rows of the index
    (row_id, dedup_key, vec) by cosine (6 decimals) downwards, then id; only positive ones; with `once_per_key`
    only the best row of each key counts. Ids and keys are bigint or string.

    With `scope`, a string column of both sides, a query sees only the rows of its scope, one with a NULL scope
    all rows. Rows with a NULL or NULL-holding vector, id or key are left out, as are vectors whose length differs
    from the queries' (the most frequent one); zero vectors match nothing; an empty side gives no row.
    """
    ok = "vec IS NOT NULL AND NOT exists(vec, x -> x IS NULL OR isnan(x)) AND size(vec) > 0"
    limits = F.col(scope).cast("string") if scope else F.lit(None).cast("string")
    q = queries.select("query_id", F.col("vec").cast("array<double>").alias("vec"), limits.alias("scope")).where(ok).where("query_id IS NOT NULL")
    x = index.select("row_id", "dedup_key", F.col("vec").cast("array<double>").alias("vec"), limits.alias("scope")).where(ok).dropna(subset=["row_id", "dedup_key"])
    kinds = dict(q.dtypes) | dict(x.dtypes)
    names = ("query_id", "row_id", "dedup_key")
    arrow = {"string": pa.string(), "bigint": pa.int64(), "int": pa.int32()}
    schema = pa.schema([*((c, arrow[kinds[c]]) for c in names), ("score", pa.float64())])
    sizes = q.agg(F.count("*").alias("n"), F.mode(F.size("vec"), deterministic=True).alias("dims")).first()
    parts = max(1, -(-x.count() // PART_ROWS))
    blocks = max(1, -(-sizes["n"] // BLOCK_QUERIES))
    fits = F.size("vec") == F.lit(sizes["dims"] or 0)

    def every(n: int) -> Column:
        return F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(n - 1).cast("bigint")))

    left = q.where(fits).select(F.pmod(F.xxhash64("query_id"), F.lit(blocks)).alias("block"), every(parts).alias("part"), "query_id", "vec", "scope")
    right = x.where(fits).select(every(blocks).alias("block"), F.pmod(F.xxhash64("row_id"), F.lit(parts)).alias("part"), "row_id", "dedup_key", "vec", "scope")
    pairs = left.groupBy("part", "block").cogroup(right.groupBy("part", "block"))
    found = pairs.applyInArrow(_best(k, once_per_key, schema), ", ".join(f"{c} {kinds[c]}" for c in names) + ", score double")
    order = [F.desc("score"), F.col("row_id")]
    if once_per_key:
        first = Window.partitionBy("query_id", "dedup_key").orderBy(*order)
        found = found.withColumn("r", F.row_number().over(first)).where("r = 1").drop("r")
    ranked = found.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy(*order)))
    return ranked.where(F.col("place") <= k).withColumn("place", F.col("place").cast("bigint"))
