import random

from pyspark.sql import functions as F

from timelode.llm.nearest_time import match_nearest


def run(spark, left, right, tol, **kw):
    a = spark.createDataFrame(left, "v string, i string, t bigint, match_id string")
    b = spark.createDataFrame(right, "v string, i string, t bigint, left_id string")
    found = match_nearest(a, b, keys=["v"], left_id="i", left_ms=F.col("t"), right_id="i", right_ms=F.col("t"), tolerance_ms=tol, **kw)
    return {tuple(r) for r in found.collect()}


def brute(left, right, tol):
    out = set()
    for v, i, t, _ in left:
        near = [(abs(t - s), s, j) for w, j, s, _ in right if t is not None and i and w == v and j and s is not None and abs(t - s) <= tol]
        if near:
            d, _, j = min(near)
            out.add((i, j, d))
    return out


def test_random_times_with_ties_and_hot_keys(spark):
    rng = random.Random(1)
    left = [(rng.choice("aaab"), f"l{n}", rng.randrange(30_000), "x") for n in range(400)]
    right = [(rng.choice("aaac"), f"r{n}", rng.randrange(0, 30_000, 7), "x") for n in range(900)]
    right += right[:30] + [("a", "z", 5000, "x"), ("a", "y", 5000, "x"), (None, "q", 5, "x"), ("a", None, 5, "x"), ("a", "n", None, "x")]
    left += [("a", "edge", 0, "x"), ("a", None, 3, "x"), ("a", "none", None, "x")]
    for tol in (3, 40, 250):
        assert run(spark, left, right, tol, bin_ms=500) == brute(left, right, tol)


def test_equally_near_takes_the_earlier_then_the_smaller_id(spark):
    right = [("v", "late", 20, "x"), ("v", "early", 10, "x"), ("v", "b", 40, "x"), ("v", "a", 40, "x")]
    assert run(spark, [("v", "p", 15, "x"), ("v", "q", 41, "x"), ("v", "far", 60, "x")], right, 10) == {("p", "early", 5), ("q", "a", 1)}


def test_empty_sides(spark):
    assert run(spark, [], [("v", "a", 1, "x")], 5) == set() and run(spark, [("v", "a", 1, "x")], [], 5) == set()
