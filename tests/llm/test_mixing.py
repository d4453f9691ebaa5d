import random

import numpy as np

from timelode.llm import mixing
from timelode.llm.mixing import fly, mix, source_weights

ITEMS, TARGETS = "source string, doc_id bigint, tokens bigint, weight int, p string", "source string, target_share double, max_repeats int, n int"


def test_flight_keeps_count_and_size():
    rng = random.Random(1)
    sizes = [rng.randrange(1, 5000) for _ in range(800)]
    p = [0.3] * 800
    q = fly(p, sizes, random.Random(2), land=False)
    assert sum(0 < x < 1 for x in q) <= 2
    assert abs(sum(q) - sum(p)) < 1e-6 and abs(np.dot(q, sizes) - np.dot(p, sizes)) < 1e-3
    assert set(fly(p, sizes, random.Random(2), land=True)) == {0.0, 1.0}


def test_flight_keeps_probabilities_on_average():
    sizes = [1, 2, 3, 5, 8, 13, 21, 34]
    mean = np.mean([fly([0.25] * 8, sizes, random.Random(s), land=True) for s in range(3000)], axis=0)
    assert np.abs(mean - 0.25).max() < 0.04


def test_weights():
    got = source_weights({"a": 100, "b": 1000}, {"a": (0.5, 2), "b": (0.4, 3), "c": (0.1, 1)})
    assert got["a"] == 2 and abs(got["b"] * 1000 / (2 * 100) - 0.8) < 1e-9 and "c" not in got
    assert source_weights({}, {"a": (1.0, 1)}) == {}
    assert source_weights({"a": 10, "b": 10}, {"a": (0.5, 1), "b": (0.5, 9)}, total=100) == {"a": 1.0, "b": 5.0}


def run(spark, items, targets):
    rows = mix(spark.createDataFrame([(*i, 1, "x") for i in items], ITEMS), spark.createDataFrame([(*t, 1) for t in targets], TARGETS)).collect()
    return [tuple(r) for r in rows]


def test_shares_over_several_rounds_of_blocks(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK", 64)
    rng = random.Random(3)
    items = [("big", i, rng.randrange(1, 300)) for i in range(5000)] + [("small", 10_000 + i, rng.randrange(1, 300)) for i in range(300)] + [("none", 1, 9), (None, 2, 9), ("big", None, 5), ("big", 3, None), ("big", 4, 0)]
    rows = run(spark, items, [("big", 0.6, 1), ("small", 0.3, 4), ("missing", 0.1, 2), ("null", None, 1)])
    used = {s: sum(t * u for k, _, t, u in rows if k == s) for s in ("big", "small")}
    assert abs(used["big"] / sum(used.values()) - 2 / 3) < 0.005
    assert {u for k, _, _, u in rows if k == "small"} == {4} and {u for k, _, _, u in rows if k == "big"} == {1}
    assert len({r[1] for r in rows}) == len(rows) and {r[0] for r in rows} == {"big", "small"}


def test_empty_sides(spark):
    assert run(spark, [], [("a", 1.0, 1)]) == [] and run(spark, [("a", 1, 5)], []) == []
