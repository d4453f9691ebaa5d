import random

from pyspark.sql import functions as F

from timelode.operators.intervals import continuous_periods, gaps_between

SCHEMA = "track string, start_ms bigint, end_ms bigint, `a b` int"


def brute(rows):
    out = []
    for key in {r[0] for r in rows if r[0] is not None}:
        spans = sorted((s, e) for k, s, e, _ in rows if k == key and s is not None and e is not None and e > s)
        for s, e in spans:
            if out and out[-1][0] == key and s <= out[-1][2]:
                out[-1][2] = max(out[-1][2], e)
            else:
                out.append([key, s, e])
    return {tuple(x) for x in out}


def run(spark, rows, **kw):
    df = spark.createDataFrame(rows, SCHEMA)
    return continuous_periods(df, ["track"], F.col("start_ms"), F.col("end_ms"), **kw)


def test_random_rows_over_many_buckets_match_brute_force(spark):
    rng = random.Random(3)
    rows = []
    for _ in range(1500):
        s = rng.randrange(0, 60_000)
        rows.append((rng.choice("abccccccc"), s, s + rng.choice([-5, 0, 1, 20, 50, 4000]), 1))
    rows += rows[:200] + [(None, 1, 2, 1), ("a", None, 5, 1), ("a", 5, None, 1)]
    got = {tuple(r) for r in run(spark, rows, bucket_ms=500).select("track", "start_ms", "end_ms").collect()}
    assert got == brute(rows)


def test_touching_and_nested_intervals_are_one_period(spark):
    rows = [("v", 0, 10, 1), ("v", 10, 20, 1), ("v", 2, 4, 1), ("v", 25, 30, 1), ("v", 25, 25, 1)]
    got = sorted(tuple(r) for r in run(spark, rows).select("start_ms", "end_ms", "gap_before_start_ms").collect())
    assert got == [(0, 20, None), (25, 30, 20)]


def test_gaps_respect_both_limits(spark):
    rows = [("v", 0, 10, 1), ("v", 12, 20, 1), ("v", 25, 30, 1), ("v", 100, 101, 1)]
    periods = run(spark, rows)
    assert sorted(tuple(r) for r in gaps_between(periods, at_least_ms=5, below_ms=70).collect()) == [("v", 20, 25)]
    assert gaps_between(periods).count() == 3


def test_empty_table(spark):
    assert run(spark, []).collect() == []
