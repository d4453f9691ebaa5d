"""Filling fixed-capacity containers with items.

Planning works on the histogram of lengths: best fit decreasing places counts of equal items into groups
of equal bins. The histogram has at most `capacity` rows whatever the data's size. Items then take their
planned slots by their rank within their length.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from timelode.llm.tokens import VOCABULARY, token_sizes
from timelode.session import checkpointed
from timelode.sources.tables import table

#: The plan is made on the driver from at most this many rows: the capacities of all containers together.
MAX_CAPACITIES = 2_000_000
MAX_CONTAINERS = 1_000
#: Parts over which the items of one length are spread to be ranked.
PARTS = 64


def plan_bins(counts: dict[int, int], capacity: int) -> tuple[list[tuple[int, int, int, int]], int]:
    """Best fit decreasing over counts. Rows (length, first rank, first bin, items per bin) - the items of
    a length from that rank on go, so many to a bin, into that bin and the following ones - and the number of bins."""
    plan, bins = [], 0
    groups: dict[int, list[tuple[int, int]]] = {}  # free space -> [(first bin, bins)]
    spaces: list[int] = []

    def put(space: int, first: int, n: int) -> None:
        if space > 0 and n > 0:
            if space not in groups:
                groups[space] = []
                insort(spaces, space)
            groups[space].append((first, n))

    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        while left:
            at = bisect_left(spaces, length)
            if at < len(spaces):
                space = spaces[at]
                first, n = groups[space].pop()
                if not groups[space]:
                    del groups[space], spaces[at]
            else:
                space, first, n = capacity, bins, -(-left // (capacity // length))
                bins += n
            per = space // length
            used = min(n, left // per)
            if used:
                plan.append((length, rank, first, per))
                put(space - per * length, first, used)
                rank, left, first, n = rank + used * per, left - used * per, first + used, n - used
            if n and 0 < left < per:
                plan.append((length, rank, first, left))
                put(space - left * length, first, 1)
                rank, left, first, n = rank + left, 0, first + 1, n - 1
            put(space, first, n)
    return plan, bins


def _take_slots(plans: dict[str, dict[int, np.ndarray]]):
    """Bins by (container, length, rank)."""

    def take(batches):
        for batch in batches:
            names, lengths = batch.column(0).to_pylist(), batch.column(3).to_numpy()
            ranks = batch.column(4).to_numpy()
            bins = np.empty(len(ranks), np.int64)
            name_codes, uniques = pa.array(names).dictionary_encode(), []
            uniques = name_codes.dictionary.to_pylist()
            codes = name_codes.indices.to_numpy()
            order = np.lexsort((lengths, codes))
            edges = np.nonzero(np.diff(codes[order], prepend=-1) | np.diff(lengths[order], prepend=-1))[0]
            for a, b in zip(edges, [*edges[1:], len(order)], strict=True):
                rows = order[a:b]
                first_rank, first_bin, per = plans[uniques[codes[rows[0]]]][int(lengths[rows[0]])]
                at = np.searchsorted(first_rank, ranks[rows], "right") - 1
                bins[rows] = first_bin[at] + (ranks[rows] - first_rank[at]) // per[at]
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(bins)], ["container", "doc_id", "piece", "tokens", "bin"])

    return take


def pack(items: DataFrame, capacities: DataFrame) -> DataFrame:
    """container, doc_id, piece, tokens, bin: every item (doc_id, tokens) in a bin of every container.

    An item longer than the capacity is cut into full bins (pieces 0, 1, ..) and a rest; no other is split.
    Items with a NULL id, a NULL size or no tokens take no room and are left out, as are containers with a
    NULL name or capacity below 1; of a container named twice the smallest capacity counts; equal rows are items of
    their own; an empty side gives no row.
    """
    rows = capacities.select("container", "capacity_tokens").dropna().where("capacity_tokens >= 1").groupBy("container").agg(F.min("capacity_tokens")).limit(MAX_CONTAINERS + 1).collect()
    sizes = {r[0]: int(r[1]) for r in rows}
    if len(sizes) > MAX_CONTAINERS or sum(sizes.values()) > MAX_CAPACITIES:
        raise ValueError(f"more than {MAX_CONTAINERS} containers or {MAX_CAPACITIES} tokens of capacity aren't planned on the driver")
    spark = items.sparkSession
    schema = "container string, doc_id bigint, piece bigint, tokens bigint, bin bigint"
    if not sizes:
        return spark.createDataFrame([], schema)
    kinds = F.array(*[F.struct(F.lit(n).alias("container"), F.lit(c).cast("bigint").alias("capacity")) for n, c in sorted(sizes.items())])
    pieces = (
        items.dropna(subset=["doc_id", "tokens"]).where("tokens > 0")
        .select("doc_id", F.col("tokens").alias("size"), F.explode(kinds).alias("k"))
        .select("k.container", "k.capacity", "doc_id", "size")
        .withColumn("full", F.expr("size div capacity"))
        .withColumn("rest", F.col("size") % F.col("capacity"))
    )
    whole = pieces.where("full > 0").select("container", "doc_id", F.posexplode(F.expr("array_repeat(capacity, cast(full as int))")).alias("piece", "tokens"))
    rest = pieces.where("rest > 0").select("container", "doc_id", F.col("full").alias("piece"), F.col("rest").alias("tokens"))
    all_pieces = whole.select("container", "doc_id", F.col("piece").cast("bigint").alias("piece"), "tokens").unionByName(rest)

    histogram = all_pieces.groupBy("container", "tokens").agg(F.count("*").alias("n")).collect()  # at most `capacity` rows each
    plans: dict[str, dict[int, np.ndarray]] = {}
    for name, capacity in sizes.items():
        plan, _ = plan_bins({r["tokens"]: r["n"] for r in histogram if r["container"] == name}, capacity)
        rows = np.array(plan, np.int64).reshape(-1, 4)
        rows = rows[np.argsort(rows[:, 0], kind="stable")]
        edges = np.nonzero(np.diff(rows[:, 0], prepend=-1))[0]
        plans[name] = {int(part[0, 0]): part[:, 1:].T.copy() for part in np.split(rows, edges[1:])} if len(rows) else {}

    # Ranks within a length, by parts so that no task ranks all items of a frequent length.
    salted = all_pieces.withColumn("part", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(PARTS)))
    before = Window.partitionBy("container", "tokens").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = salted.groupBy("container", "tokens", "part").agg(F.count("*").alias("n")).withColumn("offset", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    place = Window.partitionBy("container", "tokens", "part").orderBy("doc_id", "piece")
    ranked = salted.withColumn("place", F.row_number().over(place) - 1).join(offsets, ["container", "tokens", "part"]).withColumn("place", F.col("place") + F.col("offset"))
    ranked = ranked.select("container", "doc_id", "piece", "tokens", F.col("place").cast("bigint").alias("rank"))
    return ranked.mapInArrow(_take_slots(plans), schema)


def _packed(spark: SparkSession, sf_dir: str, vocabulary: str = VOCABULARY) -> DataFrame:
    items = token_sizes(table(spark, sf_dir, "documents"), "text", {"doc_id": "bigint"}, vocabulary)
    return pack(checkpointed(items), table(spark, sf_dir, "pack_capacities"))


def p6_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document, or piece of a document longer than the container, with its bin."""
    return _packed(spark, sf_dir)


def p6_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per container: bins, tokens and the share of the bins' room that is used."""
    per_bin = _packed(spark, sf_dir).groupBy("container", "bin").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("pieces"))
    return (
        per_bin.join(F.broadcast(table(spark, sf_dir, "pack_capacities").dropna().distinct()), "container")
        .groupBy("container", "capacity_tokens")
        .agg(F.count("*").alias("bins"), F.sum("tokens").alias("tokens"), F.sum("pieces").alias("pieces"), F.max("tokens").alias("fullest"))
        .withColumn("filled", F.round(F.col("tokens") / (F.col("bins") * F.col("capacity_tokens")), 6))
    )


QUERIES = {"p6_pack": p6_pack, "p6_fill": p6_fill}
SQL: dict[str, str] = {}  # token counts aren't expressible in SQL; tests/llm hold the packing against its rules
