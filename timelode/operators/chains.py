"""Greedy sweeps over a timeline: sessions, minimum gaps, near-duplicate suppression.

In each of them the state after a row is one earlier row (the one that opened the session, the last one
kept), so the sweep follows a chain: every row knows the next row of the chain if it is on it. That link
is computed for all rows in parallel, per (key, time bucket), from the rows of this and the next bucket.
What remains is to follow the chain: its hops from bucket to bucket are composed over blocks of buckets,
and of blocks of blocks, then followed from the top down, and at last inside the buckets from the entries
that are reached. A key that holds a third of all rows is spread over its buckets at every step.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from timelode.operators.scan import running_max
from timelode.session import checkpointed

BUCKET_MS = 3_600_000
#: Rows of later buckets that a link may need beyond the next bucket.
BEYOND = 2
#: Buckets to a block, and blocks to a block of blocks.
FAN = 64
#: Rows that are worked on together, but never less than a group.
TOGETHER = 100_000

#: A link takes the columns of the sorted rows, the positions of the rows to link and, for each of those, where
#: its group ends. It returns the position of the next row of each one's chain (the end: none) and payload columns.
Link = Callable[[dict[str, np.ndarray], np.ndarray, np.ndarray], tuple[np.ndarray, dict[str, np.ndarray]]]


def _advance(start: np.ndarray, stop: np.ndarray, going: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray:
    """For each row the first position from `start` on at which `going` ends, at most `stop`: all rows step at once."""
    j = start.copy()
    live = np.nonzero(j < stop)[0]
    while len(live):
        live = live[going(live, j[live])]
        j[live] += 1
        live = live[j[live] < stop[live]]
    return j


def _whole_groups(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables that end where a group ends, each with the first position of every group."""
    waiting: list[pa.RecordBatch] = []

    def cut() -> tuple[pa.Table, np.ndarray]:
        t = pa.Table.from_batches(waiting).combine_chunks()
        new = np.zeros(t.num_rows, bool)
        new[:1] = True
        for c in names:
            col = t[c].combine_chunks() if t[c].num_chunks != 1 else t[c].chunk(0)
            new[1:] |= pc.not_equal(col[1:], col[:-1]).to_numpy(zero_copy_only=False)
        return t, np.nonzero(new)[0]

    size = 0
    for batch in batches:
        if batch.num_rows:
            waiting.append(batch)
            size += batch.num_rows
        if size >= TOGETHER:
            t, starts = cut()
            if len(starts) > 1:
                yield t.slice(0, starts[-1]).combine_chunks(), starts[:-1]
                t = t.slice(starts[-1])
            waiting, size = t.combine_chunks().to_batches(), t.num_rows
    if waiting:
        yield cut()


def _numbers(t: pa.Table, names: list[str]) -> dict[str, np.ndarray]:
    return {c: t[c].to_numpy() for c in names if pa.types.is_integer(t.schema.field(c).type) or pa.types.is_boolean(t.schema.field(c).type)}


def _settled(to: np.ndarray) -> np.ndarray:
    """Where each pointer leads in the end; ends point to themselves."""
    while len(to):
        further = to[to]
        if (further == to).all():
            break
        to = further
    return to


def chain_members(
    df: DataFrame, *, key: str, time: str, tie: list[str], columns: list[str], link: Link, payload: str, bucket_ms: int = BUCKET_MS,
    signature: list[str] | None = None, differ: Callable[[str, str], Column] | None = None, fixed: str | None = None,
) -> DataFrame:
    """The rows on the chain that starts at each key's first row: key, time, tie columns and the payload.

    `time` is a bigint, the order is (time, *tie) and must be unique per key. A link may reach
    `bucket_ms` ahead and, beyond that, to the first BEYOND rows. Where a chain goes on at the first later row that
    is `fixed` or whose `signature` columns `differ`, however far, a link that finds none near by is looked up
    among the signatures of later buckets. Rows with a NULL key or time are left out.
    """
    kinds = dict(df.dtypes)
    names = [key, time, *tie]
    rows = df.select(*names, *[c for c in columns if c not in names]).dropna(subset=[key, time])
    rows = checkpointed(rows.withColumn("__bucket", F.floor(F.col(time) / bucket_ms)))
    order = [time, *tie]
    far = signature or []

    near = rows.withColumn("__home", F.explode(F.array(F.col("__bucket"), F.col("__bucket") - 1)))
    local = near if far else near.unionByName(_beyond(rows, key, order))

    def typed(cols: list[str], prefix: str = "") -> str:
        return ", ".join(f"{prefix}{c} {kinds[c]}" for c in cols)

    def links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, starts in _whole_groups(batches, [key, "__home"]):
            n = t.num_rows
            group = np.zeros(n, np.int64)
            group[starts[1:]] = 1
            group = np.cumsum(group)
            stop = np.append(starts[1:], n)[group]
            own = t["__bucket"].to_numpy() == t["__home"].to_numpy()  # the first rows of each group
            at = np.nonzero(own)[0]
            own_stop = (starts + np.bincount(group[at], minlength=len(starts)))[group]
            ahead, values = link(_numbers(t, t.column_names), at, stop[at])
            inside = ahead < own_stop[at]
            to = np.arange(n)
            to[at[inside]] = ahead[inside]
            last = _settled(to)[at]  # the last row of the chain in this bucket
            out = np.full(n, n)
            out[at] = ahead
            leave = out[last]
            gone = pa.array(leave, pa.int64(), mask=leave >= stop[at])
            arrays = [t[key].take(pa.array(at)), t["__home"].take(pa.array(at))]
            arrays += [t[c].take(pa.array(at)) for c in order]
            arrays.append(pa.array(np.where(inside, ahead - starts[group[at]], -1), pa.int64()))
            arrays += [t[c].take(gone) for c in order]
            arrays += [pa.array(v) for v in values.values()]
            arrays += [t[c].take(pa.array(last)) for c in far]
            named = [key, "__home", *order, "__next", *[f"exit_{c}" for c in order], *values, *[f"last_{c}" for c in far]]
            yield from pa.table(arrays, names=named).combine_chunks().to_batches()

    # Few bytes but much to compute: a stated number of partitions keeps them from being merged into a few tasks.
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    schema = ", ".join(x for x in (typed([key]), "__home bigint", typed(order), "__next bigint", typed(order, "exit_"), payload, typed(far, "last_")) if x)
    linked = checkpointed(local.repartition(parts, key, "__home").sortWithinPartitions(key, "__home", "__bucket", *order).mapInArrow(links, schema))

    ahead = linked
    if far:
        found = _first_different(linked, rows, key, order, far, differ, fixed)
        ahead = linked.join(found, [key, "__home", *[f"last_{c}" for c in far]], "left").select(
            key, "__home", *order, *[F.coalesce(f"exit_{c}", f"far_{c}").alias(f"exit_{c}") for c in order]
        )
    reached = _reached(ahead, key, order, kinds, bucket_ms)

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, starts in _whole_groups(batches, [key, "__home"]):
            entry = t["__entry"].to_numpy()
            place = np.nonzero(~entry)[0]  # an entry's mark stands behind its row
            number = np.cumsum(~entry) - 1
            first = number[starts]
            group = np.searchsorted(first, np.arange(len(place)), "right") - 1
            ahead = t["__next"].to_numpy(zero_copy_only=False)[place].astype(np.int64)
            to = np.where(ahead >= 0, ahead + first[group], -1)
            on = np.zeros(len(place), bool)
            here = np.unique(number[entry])
            while len(here):
                on[here] = True
                here = to[here]
                here = np.unique(here[here >= 0])
                here = here[~on[here]]
            keep = pa.array(place[on])
            yield from t.select(kept).take(keep).combine_chunks().to_batches()

    extra = [x.split()[0] for x in payload.split(",") if x.strip()]
    kept = [key, *order, *extra]
    marks = linked.select(key, "__home", *order, "__next", *extra, F.lit(False).alias("__entry")).unionByName(
        reached.withColumn("__entry", F.lit(True)), allowMissingColumns=True
    )
    marks = marks.withColumn("__next", F.coalesce("__next", F.lit(-1)))
    ordered = marks.repartition(parts, key, "__home").sortWithinPartitions(key, "__home", *order, "__entry")
    return ordered.mapInArrow(walk, ", ".join(x for x in (typed([key, *order]), payload) if x))


def _beyond(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The first BEYOND rows after the next bucket, for each bucket as `__home`."""
    first = Window.partitionBy(key, "__bucket").orderBy(*order)
    packed = F.struct(*[c for c in rows.columns if c != key])
    heads = (
        rows.withColumn("__n", F.row_number().over(first)).where(F.col("__n") <= BEYOND)
        .groupBy(key, "__bucket").agg(F.array_sort(F.collect_list(F.struct(*order, packed.alias("row")))).alias("heads"))
    )
    later = Window.partitionBy(key).orderBy("__bucket").rowsBetween(1, BEYOND + 1)
    return (
        heads.withColumn("later", F.flatten(F.collect_list("heads").over(later)))
        .withColumn("later", F.slice(F.filter("later", lambda h: h["row"]["__bucket"] > F.col("__bucket") + 1), 1, BEYOND))
        .select(key, F.col("__bucket").alias("__home"), F.explode("later").alias("h"))
        .select(key, "__home", "h.row.*")
    )


def _first_different(linked: DataFrame, rows: DataFrame, key: str, order: list[str], signature: list[str], differ, fixed: str | None) -> DataFrame:
    """key, __home, last_* (a signature), far_* (a place): for the chains that neither leave their bucket nor end
    near by, the first row beyond the next bucket that is fixed or differs.

    Each step looks at blocks FAN times as long as the one before, by their parts: a part says where each of its
    signatures stands first. So an unchanging stretch of any length takes a number of steps like its logarithm.
    """
    last = [f"last_{c}" for c in signature]
    open_ = linked.where(f"exit_{order[0]} IS NULL").select(key, F.col("__home").alias("b"), F.col("__home").alias("home"), *last).distinct()
    free = F.col(fixed) if fixed else F.lit(False)
    part = rows.select(key, F.col("__bucket").alias("b"), *signature, free.alias("any"), F.struct(*order).alias("place"))
    ends = part.agg(F.min("b"), F.max("b")).first()
    found, span = None, (ends[1] - ends[0]) if ends[0] is not None else 0
    while True:
        part = part.groupBy(key, "b", *signature, "any").agg(F.min("place").alias("place"))
        # The parts after the next one, up to the end of the next block of FAN parts.
        block = F.floor(F.col("b") / FAN)
        wide = open_.withColumn("p", F.explode(F.sequence(F.col("b") + 2, (block + 2) * FAN - 1)))
        there = part.withColumnRenamed("b", "p")
        hit = wide.join(there, [key, "p"]).where(F.col("any") | differ("last_", "")).groupBy(key, "home", *last).agg(F.min("place").alias("place"))
        hit = checkpointed(hit)
        found = hit if found is None else found.unionByName(hit)
        if span <= FAN:
            break
        open_ = open_.join(hit, [key, "home", *last], "left_anti").withColumn("b", block)
        part = part.withColumn("b", F.floor(F.col("b") / FAN))
        span = span // FAN + 1
    return found.select(key, F.col("home").alias("__home"), *last, *[F.col(f"place.{c}").alias(f"far_{c}") for c in order])


def _reached(linked: DataFrame, key: str, order: list[str], kinds: dict[str, str], bucket_ms: int) -> DataFrame:
    """key, __home, order columns: the rows at which the chain of each key enters a bucket."""
    exits = [f"exit_{c}" for c in order]
    start = linked.groupBy(key).agg(F.min(F.struct(*order)).alias("at")).select(key, *[F.col(f"at.{c}").alias(c) for c in order])
    start = start.withColumn("__home", F.floor(F.col(order[0]) / bucket_ms))
    # An entry knows the earliest bucket that a chain comes from: is it needed in a block's view from outside?
    entered = linked.where(f"{exits[0]} IS NOT NULL").groupBy(key, *exits).agg(F.min("__home").alias("__from")).withColumnsRenamed(dict(zip(exits, order, strict=True)))
    entries = entered.unionByName(start.select(key, *order, F.lit(-(1 << 62)).alias("__from"))).groupBy(key, *order).agg(F.min("__from").alias("__from"))
    hops = checkpointed(linked.select(key, "__home", *order, *exits).join(entries, [key, *order]))

    ends = hops.agg(F.min("__home"), F.max("__home")).first()
    base, span = (ends[0], ends[1] - ends[0]) if ends[0] is not None else (0, 0)
    levels = 1
    while span >= FAN**levels:
        levels += 1
    place = ", ".join(f"{c} {kinds[c]}" for c in order)
    there = ", ".join(f"exit_{c} {kinds[c]}" for c in order)

    def places(pdf: pd.DataFrame, prefix: str = "") -> list[tuple]:
        return list(zip(*(pdf[prefix + c].tolist() for c in order), strict=True))

    def compose(pdf: pd.DataFrame) -> pd.DataFrame:
        here, to = places(pdf), places(pdf, "exit_")
        at = {p: i for i, p in enumerate(here)}
        end = _settled(np.array([at.get(p, i) for i, p in enumerate(to)], np.int64))
        keep = pdf["__outside"].to_numpy(bool)
        out = pdf[[key, "__home", *order]].copy()
        for c in order:
            out[f"exit_{c}"] = pdf[f"exit_{c}"].to_numpy(object)[end]
        return out.assign(__from=pdf["__from"])[keep]

    def visit(pdf: pd.DataFrame) -> pd.DataFrame:
        entered = pdf["__entered"].to_numpy(bool)
        known = pdf[~entered]
        here, to = places(known), places(known, "exit_")
        at, seen = {p: i for i, p in enumerate(here)}, set()
        for p in places(pdf[entered]):
            i = at.get(p)
            while i is not None and i not in seen:
                seen.add(i)
                i = at.get(to[i])
        return known.iloc[sorted(seen)][[key, "__home", *order]]

    def block(k: int) -> Column:
        return F.floor((F.col("__home") - base) / FAN**k)

    # A missing exit must equal no place; pandas would turn bigint columns with gaps into floats, so they are filled.
    hops = hops.select(key, "__home", *order, *[F.coalesce(e, _never(kinds[c])).alias(e) for c, e in zip(order, exits, strict=True)], "__from")
    tables = [hops]
    for k in range(1, levels):
        lower = tables[-1].withColumn("__block", block(k)).withColumn("__outside", F.floor((F.col("__from") - base) / FAN**k) < F.col("__block"))
        tables.append(checkpointed(lower.groupBy(key, "__block").applyInPandas(lambda pdf: compose(pdf), f"{key} {kinds[key]}, __home bigint, {place}, {there}, __from bigint")))
    reached = start
    for k in range(levels, 0, -1):
        lower = tables[k - 1].select(key, "__home", *order, *exits, F.lit(False).alias("__entered"))
        marks = reached.select(key, "__home", *order, *[_never(kinds[c]).alias(e) for c, e in zip(order, exits, strict=True)], F.lit(True).alias("__entered"))
        both = lower.unionByName(marks).withColumn("__block", block(k))
        reached = both.groupBy(key, "__block").applyInPandas(lambda pdf: visit(pdf), f"{key} {kinds[key]}, __home bigint, {place}")
    return reached


def _never(kind: str) -> Column:
    """A value that no time, and so no place, has."""
    return (F.lit("") if kind == "string" else F.lit(-(1 << 62) if kind == "bigint" else -(1 << 30))).cast(kind)


def sessions(
    df: DataFrame, *, key: str, row_id: str, start: str, end: str, min_ms: int, max_ms: int, pause_ms: int, bucket_ms: int = BUCKET_MS
) -> DataFrame:
    """key, start_ms, first_id, end_ms, rows: greedy sessions of rows in the order (start, end, id). One ends
    before a row once it lasts at least `min_ms` and the row would take it beyond `max_ms` or comes at
    least `pause_ms` after the row before it; `end_ms` is the end of its last row.

    `start` and `end` are bigint columns in ms. Rows with a NULL key, id, start or end are left out; a row
    that ends before its start ends there; repeated ids count once; an empty table gives no row; other
    columns are ignored.
    """
    rows = df.select(
        F.col(f"`{key}`").alias("key"), F.col(f"`{row_id}`").alias("id"), F.col(f"`{start}`").alias("s"),
        F.greatest(F.col(f"`{end}`"), F.col(f"`{start}`")).alias("e"),
    ).where(F.col(f"`{end}`").isNotNull()).dropna().dropDuplicates(["key", "id"])

    def link(c: dict[str, np.ndarray], at: np.ndarray, stop: np.ndarray):
        s, e = c["s"], c["e"]
        begin = s[at]

        def going(i: np.ndarray, j: np.ndarray) -> np.ndarray:
            before = e[j - 1]
            return (before - begin[i] < min_ms) | ((e[j] - begin[i] <= max_ms) & (s[j] - before < pause_ms))

        ahead = _advance(at + 1, stop, going)
        return ahead, {"end_ms": e[ahead - 1], "rows": ahead - at}

    found = chain_members(rows, key="key", time="s", tie=["e", "id"], columns=[], link=link, payload="end_ms bigint, rows bigint", bucket_ms=max(bucket_ms, 2 * max_ms))
    return found.select(F.col("key").alias(key), F.col("s").alias("start_ms"), F.col("id").alias("first_id"), "end_ms", "rows")


def event_windows(df: DataFrame, *, key: str, time: str, min_ms: int, max_ms: int, margin_ms: int, bucket_ms: int = BUCKET_MS) -> DataFrame:
    """key, start_ms, end_ms, rows: greedy windows of the distinct times, each from `margin_ms` before its first
    one (not below 0). One ends before a time more than `max_ms` after that start once the time before lies at
    least `min_ms` after it. Windows end `margin_ms` after their last time, a key's last one after `min_ms` at least.

    `time` is a bigint column in ms, not below 0. Rows with a NULL key or time are left out; an empty table
    gives no row; other columns are ignored.
    """
    rows = df.select(F.col(f"`{key}`").alias("key"), F.col(f"`{time}`").alias("t")).dropna().distinct()

    def link(c: dict[str, np.ndarray], at: np.ndarray, stop: np.ndarray):
        t = c["t"]
        begin = np.maximum(0, t[at] - margin_ms)
        ahead = _advance(at + 1, stop, lambda i, j: (t[j] - begin[i] <= max_ms) | (t[j - 1] - begin[i] < min_ms))
        end = np.maximum(t[ahead - 1] + margin_ms, begin + np.where(ahead == stop, min_ms, 0))
        return ahead, {"start_ms": begin, "end_ms": end, "rows": ahead - at}

    found = chain_members(
        rows, key="key", time="t", tie=[], columns=[], link=link, payload="start_ms bigint, end_ms bigint, rows bigint", bucket_ms=max(bucket_ms, 2 * max_ms)
    )
    return found.select(F.col("key").alias(key), "start_ms", "end_ms", "rows")


def spaced(df: DataFrame, *, key: str, time: str, priority: str, gap_ms: int, bucket_ms: int = BUCKET_MS) -> DataFrame:
    """key, time, priority: the rows that a chronological sweep keeps at least `gap_ms` apart. A row nearer
    than that to the last kept one is dropped, unless its priority is higher: then it takes its place.

    `time` is a bigint column in ms, `priority` an int. Rows with a NULL value are left out; equal rows
    count once; at one time the lower priority comes first, so the higher takes its place.
    """
    rows = df.select(F.col(f"`{key}`").alias("key"), F.col(f"`{time}`").alias("t"), F.col(f"`{priority}`").cast("int").alias("p")).dropna().distinct()

    def link(c: dict[str, np.ndarray], at: np.ndarray, stop: np.ndarray):
        t, p = c["t"], c["p"]
        ahead = _advance(at + 1, stop, lambda i, j: (t[j] - t[at[i]] < gap_ms) & (p[j] <= p[at[i]]))
        follows = np.minimum(ahead, len(t) - 1)
        return ahead, {"replaced": (ahead < stop) & (t[follows] - t[at] < gap_ms)}

    found = chain_members(rows, key="key", time="t", tie=["p"], columns=[], link=link, payload="replaced boolean", bucket_ms=max(bucket_ms, 2 * gap_ms))
    return found.where("NOT replaced").select(F.col("key").alias(key), F.col("t").alias(time), F.col("p").alias(priority))


def distinct_frames(
    df: DataFrame, *, key: str, row_id: str, time: str, hash_: str, brightness: str, pinned: str, most_bits: int, most_brightness: int, bucket_ms: int = BUCKET_MS
) -> DataFrame:
    """key, time, row_id: the rows kept by a sweep in the order (time, id) that drops a row, unless it is pinned,
    if at most `most_bits` bits of its hash and at most `most_brightness` of its brightness differ from the last
    kept row. An unchanging stretch may have any length.

    `time` and the hash are bigint columns, `brightness` an int; where one of two rows has no brightness, the
    hash alone counts. Rows with a NULL key, id, time or hash are left out; repeated ids count once; NULL in
    `pinned` is false; an empty table gives no row; other columns are ignored.
    """
    rows = df.select(
        F.col(f"`{key}`").alias("key"), F.col(f"`{row_id}`").alias("id"), F.col(f"`{time}`").alias("t"), F.col(f"`{hash_}`").alias("h"),
        F.coalesce(F.col(f"`{brightness}`").cast("int"), F.lit(-1)).alias("light"), F.coalesce(F.col(f"`{pinned}`"), F.lit(False)).alias("fixed"),
    ).dropna().dropDuplicates(["key", "id"])
    # A row that isn't pinned and looks just like the one before it is never kept and never changes what is.
    rows = rows.withColumn("bucket", F.floor(F.col("t") / bucket_ms)).withColumn("me", F.struct("t", "id", "h", "light"))
    rows = running_max(rows, ["key"], "bucket", ["t", "id"], "me", "prior")
    rows = rows.where("fixed OR prior IS NULL OR prior.h <> h OR prior.light <> light").select("key", "id", "t", "h", "light", "fixed")

    def link(c: dict[str, np.ndarray], at: np.ndarray, stop: np.ndarray):
        h, light, fixed = c["h"].astype(np.uint64), c["light"].astype(np.int64), c["fixed"].astype(bool)

        def going(i: np.ndarray, j: np.ndarray) -> np.ndarray:
            a, b = light[at[i]], light[j]
            far = (a >= 0) & (b >= 0) & (np.abs(a - b) > most_brightness)
            return ~fixed[j] & ~far & (np.bitwise_count(h[at[i]] ^ h[j]) <= most_bits)

        return _advance(at + 1, stop, going), {}

    def differ(a: str, b: str) -> Column:
        lights = (F.col(f"{a}light") >= 0) & (F.col(f"{b}light") >= 0) & (F.abs(F.col(f"{a}light") - F.col(f"{b}light")) > most_brightness)
        return lights | (F.bit_count(F.col(f"{a}h").bitwiseXOR(F.col(f"{b}h"))) > most_bits)

    found = chain_members(
        rows, key="key", time="t", tie=["id"], columns=["h", "light", "fixed"], link=link, payload="", bucket_ms=bucket_ms, signature=["h", "light"], differ=differ, fixed="fixed"
    )
    return found.select(F.col("key").alias(key), F.col("t").alias(time), F.col("id").alias(row_id))
