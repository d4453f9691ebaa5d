"""Most similar vectors for every vector of a collection.

A forest of random-projection trees is fitted on a bounded sample. Every vector is indexed in its own leaf
of each tree and looks for partners in the leaves that a shared priority queue yields first; candidates
are found there on one-byte-per-number codes and reranked exactly in double precision. Each code carries its
distance from its vector, so only candidates that can't be among the first k are left out; where too many
remain, the block is searched with the vectors themselves.

Exact copies of a vector are searched once and expanded afterwards, so a vector that a third of all
records share makes neither a large leaf nor a pair per two copies.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from timelode.llm.forest import Forest, fit_forest, search_leaves
from timelode.session import checkpointed
from timelode.sources.tables import table


@dataclass(frozen=True)
class Search:
    """Parameters of the approximate search. Defaults were measured on 111,000 vectors: recall 0.99.

    fit_sample bounds the vectors that the planes are fitted on, max_depth the size of the forest
    (trees * 2^max_depth planes). A leaf of more than `block` vectors is scored in several tasks. A vector
    with more than `candidates` possible partners in a block searches that block exactly.
    """

    trees: int = 6
    visits: int = 24
    leaf: int = 400
    block: int = 2048
    fit_sample: int = 32_768
    max_depth: int = 13
    candidates: int = 12


def usable_vector(vector: Column, dims: int) -> Column:
    """`dims` numbers, none NULL or not finite, not all zero."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vector.isNotNull() & (F.size(vector) == dims) & ~bad & F.exists(vector, lambda x: x != 0)


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten() if len(column) else pa.array([], pa.float64())
    return flat.to_numpy(zero_copy_only=False).reshape(-1, dims)


def _unit(vectors: np.ndarray) -> np.ndarray:
    scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return scaled / np.linalg.norm(scaled, axis=1, keepdims=True)


def _binary(rows: np.ndarray) -> pa.Array:
    n, width = rows.shape
    offsets = np.arange(0, n * width + 1, width, dtype=np.int32)
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(rows))])


def _bytes(column: pa.ChunkedArray, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.int8).reshape(-1, width)


def _count_leaves(forest: Forest, dims: int):
    def count(batches):
        total = np.zeros(forest.trees * forest.leaves, np.int64)
        for batch in batches:
            unit = _unit(_matrix(batch.column(0), dims)).astype(np.float32)
            for i in range(0, len(unit), 1024):
                leaf, own = search_leaves(forest, unit[i : i + 1024], forest.trees)
                total += np.bincount(leaf[own], minlength=len(total))
        some = np.nonzero(total)[0]
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(total[some])], ["leaf", "n"])

    return count


#: Of single-precision scores and of cosines to 6 decimals, for each of a pair's two vectors.
ROUNDING = 2e-6
_VISITS = "leaf int, block int, k1 bigint, k2 bigint, grp bigint, code binary, error float, indexed boolean"


def _visit_leaves(forest: Forest, dims: int, visits: int, blocks: np.ndarray):
    """One row for each vector and block of each leaf it visits; `indexed` in the one that holds it."""

    def visit(batches):
        for batch in batches:
            k1, k2, grp = (batch.column(i) for i in range(3))
            vectors = _matrix(batch.column(3), dims)
            for i in range(0, len(vectors), 1024):
                unit = _unit(vectors[i : i + 1024])
                code = np.rint(unit * (127 / np.abs(unit).max(axis=1, keepdims=True))).astype(np.int8)
                error = np.linalg.norm(unit - code / np.linalg.norm(code.astype(np.float64), axis=1, keepdims=True), axis=1)
                leaf, own = search_leaves(forest, unit.astype(np.float32), visits)
                width = leaf.shape[1]
                row = np.repeat(np.arange(len(unit)), width)
                leaf, own = leaf.ravel(), own.ravel()
                n = blocks[leaf]
                at = np.repeat(np.arange(len(leaf)), n)
                block = np.arange(len(at)) - np.repeat(np.cumsum(n) - n, n)
                row = row[at]
                home = np.asarray(k1.slice(i, 1024))[row].view(np.uint64) % n[at].astype(np.uint64) == block.astype(np.uint64)
                take = pa.array(row + i)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(leaf[at].astype(np.int32)),
                        pa.array(block.astype(np.int32)),
                        k1.take(take),
                        k2.take(take),
                        grp.take(take),
                        _binary(code[row]),
                        pa.array((error + ROUNDING).astype(np.float32)[row]),
                        pa.array(own[at] & home),
                    ],
                    ["leaf", "block", "k1", "k2", "grp", "code", "error", "indexed"],
                )

    return visit


# A pair and the bounds of its cosine, or (role 1) a vector that searches a block exactly and (role 2) one held there.
_HITS = "leaf int, block int, role int, q1 bigint, q2 bigint, c1 bigint, c2 bigint, low float, high float"
_HITS_ARROW = pa.schema(
    [("leaf", pa.int32()), ("block", pa.int32()), ("role", pa.int32())]
    + [(c, pa.int64()) for c in ("q1", "q2", "c1", "c2")] + [("low", pa.float32()), ("high", pa.float32())]
)


def _first_places(q: np.ndarray, n: int) -> np.ndarray:
    """Of rows sorted by q, which are among the first n of theirs."""
    return np.arange(len(q)) - np.searchsorted(q, q) < n


def _score_block(dims: int, least: float, k: int, most: int):
    def score(block: pa.Table) -> pa.Table:
        k1, k2 = (block.column(c).to_numpy() for c in ("k1", "k2"))
        grp = block.column("grp").fill_null(0).to_numpy()  # 0: copies in several groups, apart from none
        code = _bytes(block.column("code"), dims).astype(np.float32)
        code /= np.linalg.norm(code, axis=1, keepdims=True)
        error = block.column("error").to_numpy()
        held = np.nonzero(block.column("indexed").to_numpy(zero_copy_only=False))[0]
        if not len(held):
            return _HITS_ARROW.empty_table()
        parts, crowded = [], []
        for i in range(0, len(code), 2048):
            near = code[i : i + 2048] @ code[held].T
            q, c = np.nonzero(near + error[i : i + 2048, None] + error[held][None] >= least)
            value = near[q, c]
            q, c = q + i, held[c]
            other = (k1[q] != k1[c]) | (k2[q] != k2[c])
            apart = (grp[q] != grp[c]) | (grp[q] == 0)
            q, c, value = (x[other & apart] for x in (q, c, value))
            low = value - error[q] - error[c]
            order = np.lexsort((-low, q))
            q, c, value, low = q[order], c[order], value[order], low[order]
            # The k-th lower bound is one for every record of a vector in one group; for one in several groups k
            # partners may all lie in the group that a record leaves out, so nothing is left out by rank.
            bound = np.full(len(code), -np.inf, np.float32)
            kth = _first_places(q, k) & ~_first_places(q, k - 1)
            bound[q[kth]] = low[kth]
            bound[grp == 0] = -np.inf
            high = value + error[q] + error[c]
            keep = high >= bound[q]
            q, c, low, high = (x[keep] for x in (q, c, low, high))
            many = np.bincount(q, minlength=len(code)) > most
            crowded.append(np.nonzero(many)[0])
            low = np.where(grp[q] == 0, -np.inf, low)
            parts.append(tuple(x[~many[q]] for x in (q, c, low, high)))
        q, c, low, high = (np.concatenate(x) for x in zip(*parts, strict=True))
        search = np.concatenate(crowded)
        stay = held if len(search) else held[:0]
        at = np.concatenate([q, search, stay])
        none = np.zeros(len(search) + len(stay), np.int64)
        role = np.repeat([0, 1, 2], [len(q), len(search), len(stay)]).astype(np.int32)
        leaf, number = (np.full(len(at), block.column(x)[0].as_py(), np.int32) for x in ("leaf", "block"))
        bounds = (np.concatenate([x, none]).astype(np.float32) for x in (low, high))
        columns = (leaf, number, role, k1[at], k2[at], np.concatenate([k1[c], none]), np.concatenate([k2[c], none]), *bounds)
        return pa.Table.from_arrays([pa.array(x) for x in columns], schema=_HITS_ARROW)

    return score


_PAIRS = "q1 bigint, q2 bigint, c1 bigint, c2 bigint"
_PAIRS_ARROW = pa.schema([(c, pa.int64()) for c in ("q1", "q2", "c1", "c2")])


def _search_exactly(dims: int, least: float, k: int):
    """For each searching vector of a block the held ones that its records may have among their first k. Of a held
    vector two records stand for all: the first one by id and the first one of another group."""

    def search(block: pa.Table) -> pa.Table:
        k1, k2, role = (block.column(c).to_numpy() for c in ("k1", "k2", "role"))
        grp = block.column("grp").fill_null(0).to_numpy()
        unit = _unit(_matrix(block.column("vec"), dims))
        asks, held = np.nonzero(role == 1)[0], np.nonzero(role == 2)[0]
        stand = [(x["id"], x["g"], h) for h in held for x in block.column("stand")[int(h)].as_py()]
        stand.sort()  # the place is the rank by id
        if not len(asks) or not stand:
            return _PAIRS_ARROW.empty_table()
        group, of = np.array([x[1] for x in stand]), np.array([x[2] for x in stand])
        far = np.int64(2**62)
        qs, cs = [], []
        for i in range(0, len(asks), 512):
            rows = asks[i : i + 512]
            near = np.round(unit[rows] @ unit[held].T, 6)[:, np.searchsorted(held, of)]
            out = (near < least) | ((k1[rows][:, None] == k1[of]) & (k2[rows][:, None] == k2[of])) | (grp[rows][:, None] == group)
            place = np.where(out, far, np.rint((1 - near) * 1e6).astype(np.int64) * len(stand) + np.arange(len(stand)))
            n = min(k, len(stand))
            first = np.argpartition(place, n - 1, axis=1)[:, :n]
            for r, row in enumerate(rows):
                if grp[row]:
                    found = first[r]
                else:
                    order = np.argsort(place[r], kind="stable")
                    own = group[order]
                    by_group = np.argsort(own, kind="stable")
                    few = np.zeros(len(order), bool)
                    few[by_group] = _first_places(own[by_group], k)
                    found = order[few][: 2 * k]
                found = found[place[r][found] < far]
                qs.append(np.full(len(found), row))
                cs.append(of[found])
        q, c = np.concatenate(qs), np.concatenate(cs)
        return pa.Table.from_arrays([pa.array(x) for x in (k1[q], k2[q], k1[c], k2[c])], schema=_PAIRS_ARROW)

    return search


def _exact_cosine(dims: int):
    def cosine(batches):
        for batch in batches:
            a, b = (_unit(_matrix(batch.column(i), dims)) for i in (4, 5))
            value = np.round(np.einsum("nd,nd->n", a, b), 6)
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(value)], ["a1", "a2", "b1", "b2", "cosine"])

    return cosine


def most_similar(
    df: DataFrame, *, row_id: str, group: str, vector: str, dims: int, k: int = 5, min_cosine: float = 0.85, search: Search = Search()
) -> DataFrame:
    """row_id, neighbour_id, cosine: for each usable record the first `k` by cosine (rounded to 6 decimals)
    downwards, then by smaller id, of the usable records of other groups with at least `min_cosine`.

    A record is usable if its id and group are not NULL and its vector has `dims` finite numbers that are
    not all zero; repeated rows count once; ties in cosine go to the smaller id; an empty table or one
    without similar vectors gives no row; other columns are ignored.
    """
    spark = df.sparkSession
    v = F.col(f"`{vector}`").cast("array<double>")
    rows = df.where(usable_vector(v, dims)).select(
        F.col(f"`{row_id}`").cast("string").alias("id"), F.col(f"`{group}`").cast("string").alias("grp"), v.alias("vec")
    )
    rows = rows.where("id IS NOT NULL AND grp IS NOT NULL").withColumns(
        {"k1": F.xxhash64("vec"), "k2": F.xxhash64(F.lit(1), "vec")}
    )
    copies = checkpointed(
        rows.select("k1", "k2", "vec", _group_hash("grp").alias("g"))
        .groupBy("k1", "k2", "vec")
        .agg(F.min("g").alias("g0"), F.max("g").alias("g1"))
        .select("k1", "k2", F.when(F.col("g0") == F.col("g1"), F.col("g0")).alias("grp"), "vec")
    )
    n = copies.count()
    depth = max(0, min(search.max_depth, int(np.ceil(np.log2(max(1, n) / search.leaf)))))
    share = min(1.0, 1.05 * search.fit_sample / max(1, n))
    picked = copies.where(F.pmod(F.xxhash64(F.lit(2), "k1"), F.lit(1_000_000)) < int(share * 1_000_000) + 1)
    sample = picked.orderBy("k1", "k2").limit(search.fit_sample).select("vec").toArrow()  # the same whatever the partitions
    points = _unit(_matrix(sample.column(0), dims)).astype(np.float32) if len(sample) else np.zeros((0, dims), np.float32)
    forest = fit_forest(points, trees=search.trees, depth=depth)

    counts = copies.select("vec").mapInArrow(_count_leaves(forest, dims), "leaf int, n bigint").groupBy("leaf").agg(F.sum("n").alias("n"))
    blocks = np.ones(forest.trees * forest.leaves, np.int64)
    for leaf, size in counts.where(F.col("n") > search.block).collect():  # at most trees * 2^max_depth rows
        blocks[leaf] = -(-size // search.block)

    visits = copies.mapInArrow(_visit_leaves(forest, dims, min(search.visits, forest.trees * forest.leaves), blocks), _VISITS)
    hits = checkpointed(visits.groupBy("leaf", "block").applyInArrow(_score_block(dims, min_cosine, k, search.candidates), _HITS))
    best = Window.partitionBy("q1", "q2").orderBy(F.desc("low"), "c1", "c2")
    nearest = (
        hits.where("role = 0")
        .groupBy("q1", "q2", "c1", "c2")
        .agg(F.max("low").alias("low"), F.max("high").alias("high"))
        .withColumn("place", F.row_number().over(best))
        .withColumn("bound", F.max(F.when(F.col("place") == k, F.col("low"))).over(Window.partitionBy("q1", "q2")))
        .where("bound IS NULL OR high >= bound")
        .select("q1", "q2", "c1", "c2")
    )

    # A record leaves out one group only, so of the records that share a vector, or that lie near one, the
    # first k of each group and of those the first 2 k hold everybody's first k.
    members = rows.select("id", "grp", "k1", "k2").distinct()
    firsts = _first_records(members, ["k1", "k2"], ["id"], k).select(
        F.col("k1").alias("c1"), F.col("k2").alias("c2"), F.col("id").alias("nid"), F.col("grp").alias("ngrp")
    )
    if not hits.where("role > 0").isEmpty():
        hashed = firsts.select(F.col("c1").alias("k1"), F.col("c2").alias("k2"), F.struct(F.col("nid").alias("id"), _group_hash("ngrp").alias("g")).alias("x"))
        lists = hashed.groupBy("k1", "k2").agg(F.array_sort(F.collect_list("x")).alias("x"))
        stand = lists.select("k1", "k2", F.concat(F.slice("x", 1, 1), F.slice(F.filter("x", lambda y: y["g"] != F.col("x")[0]["g"]), 1, 1)).alias("stand"))
        asks = hits.where("role > 0").select("leaf", "block", "role", F.col("q1").alias("k1"), F.col("q2").alias("k2"))
        asks = asks.join(copies, ["k1", "k2"]).join(stand, ["k1", "k2"])
        nearest = nearest.unionByName(asks.groupBy("leaf", "block").applyInArrow(_search_exactly(dims, min_cosine, k), _PAIRS))
    q, c = F.struct(F.col("q1").alias("k1"), F.col("q2").alias("k2")), F.struct(F.col("c1").alias("k1"), F.col("c2").alias("k2"))
    pairs = nearest.select(F.least(q, c).alias("a"), F.greatest(q, c).alias("b")).select(
        F.col("a.k1").alias("a1"), F.col("a.k2").alias("a2"), F.col("b.k1").alias("b1"), F.col("b.k2").alias("b2")
    )
    vectors = copies.select("k1", "k2", "vec")
    reranked = (
        pairs.distinct()
        .join(vectors.select(F.col("k1").alias("a1"), F.col("k2").alias("a2"), F.col("vec").alias("va")), ["a1", "a2"])
        .join(vectors.select(F.col("k1").alias("b1"), F.col("k2").alias("b2"), F.col("vec").alias("vb")), ["b1", "b2"])
        .select("a1", "a2", "b1", "b2", "va", "vb")
        .mapInArrow(_exact_cosine(dims), "a1 bigint, a2 bigint, b1 bigint, b2 bigint, cosine double")
        .where(F.col("cosine") >= min_cosine)
    )
    both = reranked.select(
        F.explode(
            F.array(
                F.struct(F.col("a1").alias("q1"), F.col("a2").alias("q2"), F.col("b1").alias("c1"), F.col("b2").alias("c2"), "cosine"),
                F.struct(F.col("b1").alias("q1"), F.col("b2").alias("q2"), F.col("a1").alias("c1"), F.col("a2").alias("c2"), "cosine"),
            )
        ).alias("x")
    ).select("x.*")
    shared = copies.where("grp IS NULL").select(
        F.col("k1").alias("q1"), F.col("k2").alias("q2"), F.col("k1").alias("c1"), F.col("k2").alias("c2"), F.lit(1.0).alias("cosine")
    )

    around = _first_records(
        both.unionByName(shared).join(firsts, ["c1", "c2"]).withColumnsRenamed({"nid": "id", "ngrp": "grp"}).withColumn("far", -F.col("cosine")),
        ["q1", "q2"], ["far", "id"], k,
    )
    lists = around.groupBy(F.col("q1").alias("k1"), F.col("q2").alias("k2")).agg(F.array_sort(F.collect_list(F.struct("far", "id", "grp"))).alias("near"))
    return (
        members.join(lists, ["k1", "k2"])
        .select(
            F.col("id").alias("row_id"),
            F.explode(F.slice(F.filter("near", lambda x: x["grp"] != F.col("grp")), 1, k)).alias("x"),
        )
        .select("row_id", F.col("x.id").alias("neighbour_id"), (-F.col("x.far")).alias("cosine"))
    )


def _group_hash(name: str) -> Column:
    return F.pmod(F.xxhash64(name), F.lit(2**62)) + 1


def _first_records(df: DataFrame, keys: list[str], order: list[str], k: int) -> DataFrame:
    """Of each key's rows the first k of each group and of those the first 2 k. Both ranks are limited
    before their shuffles, so no task receives all rows of a hot key."""
    per_group = Window.partitionBy(*keys, "grp").orderBy(*order)
    overall = Window.partitionBy(*keys).orderBy(*order)
    return (
        df.withColumn("__r", F.row_number().over(per_group)).where(F.col("__r") <= k)
        .withColumn("__r", F.row_number().over(overall)).where(F.col("__r") <= 2 * k)
        .drop("__r")
    )


DIMS, NEIGHBOURS, MIN_COSINE = 128, 5, 0.85


def _neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = table(spark, sf_dir, "embedding_records")
    return most_similar(records, row_id="id", group="chunk_id", vector="vector", dims=DIMS, k=NEIGHBOURS, min_cosine=MIN_COSINE)


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of embedding records of which at least one is among the other's five nearest."""
    pair = F.array_sort(F.array("row_id", "neighbour_id"))
    return _neighbours(spark, sf_dir).select(pair[0].alias("record_a"), pair[1].alias("record_b")).distinct()


def p1_degrees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each embedding record that has neighbours, how many and how near the first one is."""
    return _neighbours(spark, sf_dir).groupBy("row_id").agg(F.count("*").alias("neighbours"), F.max("cosine").alias("nearest"))


QUERIES = {"p1_found": p1_found, "p1_degrees": p1_degrees}

_BRUTE = f"""
WITH usable AS (
  SELECT DISTINCT id, chunk_id, vector FROM embedding_records
  WHERE len(vector) = {DIMS} AND len(list_filter(vector, lambda x: x <> 0)) > 0),
ranked AS (
  SELECT a.id AS row_id, b.id AS neighbour_id, round(list_cosine_similarity(a.vector, b.vector), 6) AS cosine,
    row_number() OVER (PARTITION BY a.id ORDER BY round(list_cosine_similarity(a.vector, b.vector), 6) DESC, b.id) AS rn
  FROM usable a JOIN usable b ON a.chunk_id <> b.chunk_id AND round(list_cosine_similarity(a.vector, b.vector), 6) >= {MIN_COSINE})
"""
SQL = {
    "p1_found": _BRUTE
    + f"SELECT DISTINCT least(row_id, neighbour_id) AS record_a, greatest(row_id, neighbour_id) AS record_b FROM ranked WHERE rn <= {NEIGHBOURS}",
    "p1_degrees": _BRUTE
    + f"SELECT row_id, count(*) AS neighbours, max(cosine) AS nearest FROM ranked WHERE rn <= {NEIGHBOURS} GROUP BY row_id",
}
