import random
from collections import defaultdict

from hypothesis import given, settings
from hypothesis import strategies as st

import pytest

from timelode.llm import packing
from timelode.llm.packing import pack, plan_bins

ITEMS, SIZES = "doc_id bigint, tokens bigint, bin int, container string", "container string, capacity_tokens int, doc_id int"


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.integers(1, 40), st.integers(1, 200), max_size=30))
def test_plan_places_every_item_and_overfills_no_bin(counts):
    plan, bins = plan_bins(counts, 40)
    room, placed = defaultdict(int), defaultdict(list)
    for length, first, start, per in plan:
        placed[length].append((first, start, per))
    for length, n in counts.items():
        rows = sorted(placed[length])
        for i, (first, start, per) in enumerate(rows):
            end = rows[i + 1][0] if i + 1 < len(rows) else n
            for rank in range(first, end):
                room[start + (rank - first) // per] += length
        assert rows[0][0] == 0
    assert set(room) == set(range(bins)) and all(0 < r <= 40 for r in room.values())
    total = sum(k * n for k, n in counts.items())
    assert bins <= 2 * -(-total // 40) + 1


def run(spark, items, sizes):
    df = pack(spark.createDataFrame([(*i, 1, "x") for i in items], ITEMS), spark.createDataFrame([(*s, 1) for s in sizes], SIZES))
    return [tuple(r) for r in df.collect()]


def test_too_many_containers_or_capacities_are_refused(spark):
    with pytest.raises(ValueError):
        run(spark, [(1, 5)], [("s", packing.MAX_CAPACITIES + 1)])
    with pytest.raises(ValueError):
        run(spark, [(1, 5)], [(f"s{i}", 10) for i in range(packing.MAX_CONTAINERS + 1)])


def test_all_items_once_and_only_long_ones_split(spark):
    rng = random.Random(1)
    items = [(i, rng.choice([3, 3, 3, 7, 20, 64, 65, 200])) for i in range(700)] + [(9000, None), (None, 4), (9001, 0)]
    rows = run(spark, items, [("s", 64), ("l", 128), ("n", None), ("z", 0)])
    for name, capacity in (("s", 64), ("l", 128)):
        per_bin, per_doc = defaultdict(int), defaultdict(list)
        for c, doc, piece, tokens, b in rows:
            if c == name:
                per_bin[b] += tokens
                per_doc[doc].append((piece, tokens))
        assert max(per_bin.values()) <= capacity
        assert {d: sum(t for _, t in p) for d, p in per_doc.items()} == {d: t for d, t in items if d is not None and t}
        assert all(len(p) == -(-sum(t for _, t in p) // capacity) for p in per_doc.values())
        pieces = [t for p in per_doc.values() for _, t in p]  # none above half a bin shares one with another or with a half
        halves = sum(2 * t > capacity for t in pieces) + -(-sum(2 * t == capacity for t in pieces) // 2)
        assert len(per_bin) <= max(halves, -(-sum(per_bin.values()) // capacity)) + 1
    assert {r[0] for r in rows} == {"s", "l"}


def test_empty_sides(spark):
    assert run(spark, [], [("s", 64)]) == [] and run(spark, [(1, 5)], []) == []
