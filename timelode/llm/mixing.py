"""Mixing sources to target weights by balanced sampling (the cube method).

Each source gets a weight: how often each of its documents is used on average. The whole part is used
outright; for the fraction, a sample is drawn in which each document has that probability and whose
number of documents and of tokens are as expected: a flight moves the probabilities within the null-space
of these two constraints until all but two are 0 or 1. Flights run in blocks; what blocks leave over flies
again, until one block per source is left to land.
"""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from timelode.llm.tokens import VOCABULARY, token_sizes
from timelode.session import checkpointed
from timelode.sources.tables import table

#: Documents per block of a flight, and the most sources whose weights the driver computes.
BLOCK = 4096
MAX_SOURCES = 100_000
_CONSTRAINTS = 2
#: The largest documents of a block, which are settled first.
_HEAVY = 256
_NEAR = 1e-9


def _settle(p: np.ndarray, sizes: np.ndarray, unit: int, rng: random.Random) -> None:
    """Moves one unit to 0 or 1 while all others give way a little, along the null-space direction of the
    constraints that is weighted by how freely each can move."""
    for _ in range(100):
        if not _NEAR < p[unit] < 1 - _NEAR:
            return
        others = np.nonzero((p > _NEAR) & (p < 1 - _NEAR))[0]
        others = others[others != unit]
        if len(others) < 4:
            return
        scale = sizes[others].mean()
        a = np.stack([np.ones(len(others)), sizes[others] / scale])
        free = p[others] * (1 - p[others])
        m = (a * free) @ a.T
        if np.linalg.cond(m) > 1e10:
            return
        u = np.concatenate([[1.0], -free * (a.T @ np.linalg.solve(m, [1.0, sizes[unit] / scale]))])
        _step(p, np.concatenate([[unit], others]), u, rng)


def _step(p: np.ndarray, units: np.ndarray, u: np.ndarray, rng: random.Random) -> None:
    """As far as possible along u or against it, with the odds that keep every probability on average."""
    units, u = units[u != 0], u[u != 0]
    x = p[units]
    up = (np.where(u > 0, 1 - x, x) / np.abs(u)).min()
    down = (np.where(u > 0, x, 1 - x) / np.abs(u)).min()
    x = x + (up if rng.random() * (up + down) < down else -down) * u
    p[units] = np.where(x < _NEAR, 0.0, np.where(x > 1 - _NEAR, 1.0, x))


def fly(probabilities: list[float], sizes: list[int], rng: random.Random, land: bool) -> list[float]:
    """Moves probabilities to 0 or 1 keeping their sum and the expected total size; at most two stay
    between unless `land`, which settles those keeping the sum alone, then none."""
    p, size = np.array(probabilities, float), np.array(sizes, float)
    order = np.argsort(-size, kind="stable")
    for unit in order[:_HEAVY]:  # what is left to land must be small
        _settle(p, size, unit, rng)
    hold: list[int] = []
    for unit in (int(i) for i in order if _NEAR < p[i] < 1 - _NEAR):
        hold.append(unit)
        if len(hold) > _CONSTRAINTS:
            a, b, c = (sizes[i] for i in hold)
            u = np.array([c - b, a - c, b - a], float)  # orthogonal to (1, 1, 1) and to the sizes
            _step(p, np.array(hold), u if u.any() else np.array([1.0, -1.0, 0.0]), rng)
            hold = [i for i in hold if 0 < p[i] < 1]
    if land:
        if len(hold) == 2:
            _step(p, np.array(hold), np.array([1.0, -1.0]), rng)
            hold = [i for i in hold if 0 < p[i] < 1]
        for i in hold:
            p[i] = 1.0 if rng.random() < p[i] else 0.0
    return p.tolist()


_UNITS = "source string, doc_id bigint, tokens bigint, weight double, p double"


def _fly_block(round_: int, land: bool):
    def run(block: pa.Table) -> pa.Table:
        block = block.sort_by([("doc_id", "ascending"), ("tokens", "ascending")])
        source, ids = block.column("source")[0].as_py(), block.column("doc_id").to_pylist()
        rng = random.Random(f"{round_} {source} {ids[0]} {len(ids)}")
        p = fly(block.column("p").to_pylist(), block.column("tokens").to_pylist(), rng, land)
        cols = [block.column(c) for c in ("source", "doc_id", "tokens", "weight")]
        return pa.Table.from_arrays([*cols, pa.array(p, pa.float64())], ["source", "doc_id", "tokens", "weight", "p"])

    return run


def source_weights(totals: dict[str, int], targets: dict[str, tuple[float, int]], total: int | None = None) -> dict[str, float]:
    """Average uses per document of each source that has both tokens and a target.

    Without `total` the largest total is taken at which every such source reaches its share within its
    repeats; with a larger one, sources at their cap stay short.
    """
    there = {s: (share, cap) for s, (share, cap) in targets.items() if share > 0 and cap > 0 and totals.get(s, 0) > 0}
    whole = sum(share for share, _ in there.values())
    if not there:
        return {}
    reach = min(cap * totals[s] * whole / share for s, (share, cap) in there.items())
    budget = reach if total is None else total
    return {s: min(float(cap), budget * share / whole / totals[s]) for s, (share, cap) in there.items()}


def mix(items: DataFrame, targets: DataFrame, total: int | None = None) -> DataFrame:
    """source, doc_id, tokens, uses: the documents of the mix and how often each is used.

    Items (source, doc_id, tokens) with a NULL or no size, a NULL id, or a source without a target
    (NULL included) are not used; of a source named twice in `targets` the smallest share and cap count;
    repeated items are items of their own; sources without items stay out and the other shares are taken
    of the rest; an empty side gives no row. A source of any size is spread over blocks of BLOCK items.
    """
    spark = items.sparkSession
    rows = targets.select("source", "target_share", "max_repeats").dropna().groupBy("source").agg(F.min("target_share"), F.min("max_repeats")).limit(MAX_SOURCES + 1).collect()
    if len(rows) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    wanted = {r[0]: (float(r[1]), int(r[2])) for r in rows}
    usable = items.select("source", "doc_id", "tokens").dropna().where("tokens > 0")
    named = F.broadcast(spark.createDataFrame([(s,) for s in sorted(wanted)], "source string"))  # at most MAX_SOURCES rows
    sums = usable.join(named, "source", "left_semi").groupBy("source").agg(F.sum("tokens").alias("t"), F.count("*").alias("n")).collect()
    weights = source_weights({r["source"]: r["t"] for r in sums}, wanted, total)
    counts = {r["source"]: r["n"] for r in sums if r["source"] in weights}
    if not weights:
        return spark.createDataFrame([], "source string, doc_id bigint, tokens bigint, uses bigint")
    listed = spark.createDataFrame(sorted((s, w, counts[s]) for s, w in weights.items()), "source string, weight double, n bigint")
    units = usable.join(F.broadcast(listed), "source").withColumn("p", F.col("weight") - F.floor("weight"))

    sure = units.where((F.col("p") <= _NEAR) | (F.col("p") >= 1 - _NEAR)).select("source", "doc_id", "tokens", "weight", F.round("p").alias("p"))
    flying, done = units.where((F.col("p") > _NEAR) & (F.col("p") < 1 - _NEAR)), [sure]
    round_, most = 0, max(counts.values())
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    while True:
        blocks = -(-most // BLOCK)
        n_blocks = F.ceil(F.col("n") / F.lit(BLOCK * (BLOCK // _CONSTRAINTS) ** round_))
        block = F.pmod(F.xxhash64(F.lit(round_), "doc_id", "tokens"), F.greatest(n_blocks, F.lit(1)))
        # Few bytes but much to compute: stated partitions aren't merged into a few tasks.
        spread = flying.select("source", "doc_id", "tokens", "weight", "p", block.alias("block")).repartition(parts, "source", "block")
        flown = checkpointed(spread.groupBy("source", "block").applyInArrow(_fly_block(round_, blocks == 1), _UNITS))
        done.append(flown.where("p = 0 OR p = 1"))
        if blocks == 1:
            break
        flying = flown.where("p > 0 AND p < 1").join(F.broadcast(listed.select("source", "n")), "source")
        round_, most = round_ + 1, _CONSTRAINTS * blocks
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    uses = (F.floor("weight") + F.when(F.col("weight") - F.floor("weight") >= 1 - _NEAR, F.lit(1)).when(F.col("weight") - F.floor("weight") <= _NEAR, F.lit(0)).otherwise(F.col("p"))).cast("bigint")
    return out.select("source", "doc_id", "tokens", uses.alias("uses")).where("uses > 0")


def _items(spark: SparkSession, sf_dir: str, vocabulary: str = VOCABULARY) -> DataFrame:
    return checkpointed(token_sizes(table(spark, sf_dir, "documents"), "text", {"source": "string", "doc_id": "bigint"}, vocabulary))


def p7_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents of the mix with their sizes and uses."""
    return mix(_items(spark, sf_dir), table(spark, sf_dir, "mix_targets"))


def p7_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target and actual share of each source of the targets."""
    items, targets = _items(spark, sf_dir), table(spark, sf_dir, "mix_targets")
    used = (
        mix(items, targets)
        .groupBy("source")
        .agg(F.count("*").alias("documents"), F.sum("uses").alias("uses"), F.max("uses").alias("most_uses"), F.sum(F.col("uses") * F.col("tokens")).alias("tokens"))
    )
    total = used.agg(F.sum("tokens").alias("total"))  # one row
    return (
        targets.join(used, "source", "left")
        .crossJoin(F.broadcast(total))
        .select(
            "source", "target_share", "max_repeats",
            *[F.coalesce(c, F.lit(0)).alias(c) for c in ("documents", "uses", "most_uses", "tokens")],
            F.round(F.coalesce("tokens", F.lit(0)) / F.col("total"), 6).alias("actual_share"),
        )
    )


QUERIES = {"p7_mix": p7_mix, "p7_shares": p7_shares}
SQL: dict[str, str] = {}  # balanced sampling isn't expressible in SQL; tests/llm hold it against its constraints
