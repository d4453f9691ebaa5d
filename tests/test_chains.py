import random

import pytest
from pyspark.sql import functions as F

from timelode.operators import chains
from timelode.operators.chains import distinct_frames, sessions, spaced


def brute_sessions(rows, low, high, pause):
    out = []
    for key in {r[0] for r in rows}:
        cur = None
        for s, e, i in sorted((s, max(s, e), i) for k, i, s, e in set(rows) if k == key):
            if cur and not (cur[3] - cur[1] >= low and (e - cur[1] > high or s - cur[3] >= pause)):
                cur[3], cur[4] = e, cur[4] + 1
                continue
            if cur:
                out.append(tuple(cur))
            cur = [key, s, i, e, 1]
        if cur:
            out.append(tuple(cur))
    return set(out)


def run_sessions(spark, rows, low, high, pause, **kw):
    df = spark.createDataFrame(rows, "v string, i string, s bigint, e bigint")
    got = sessions(df, key="v", row_id="i", start="s", end="e", min_ms=low, max_ms=high, pause_ms=pause, **kw)
    return {(r["v"], r["start_ms"], r["first_id"], r["end_ms"], r["rows"]) for r in got.collect()}


def test_known_windows(spark):
    rows = [("demo", "a", 0, 20_000), ("demo", "b", 20_000, 70_000), ("demo", "c", 210_000, 240_000)]
    got = run_sessions(spark, rows, 30_000, 120_000, 8_000)
    assert {(r[1], r[3]) for r in got} == {(0, 70_000), (210_000, 240_000)}


@pytest.mark.parametrize("seed", [1, 2])
def test_sessions_across_buckets_match_brute_force(spark, seed):
    rng, rows, t = random.Random(seed), [], 0
    for n in range(900):
        t += rng.choice([0, 100, 300, 900, 2500])
        rows.append((rng.choice(["hot", "hot", "x"]), f"{n:04d}", t, t + rng.choice([-50, 0, 200, 700, 5000])))
    rows += rows[:50]
    assert run_sessions(spark, rows, 2000, 9000, 800, bucket_ms=18_000) == brute_sessions(rows, 2000, 9000, 800)


def test_sessions_leave_out_nulls_and_take_empty_tables(spark):
    assert run_sessions(spark, [], 1, 2, 3) == set()
    assert run_sessions(spark, [("v", "a", None, 3), (None, "b", 1, 2), ("v", "c", 5, 9)], 1, 20, 3) == {("v", 5, "c", 9, 1)}


def brute_spaced(rows, gap):
    out = []
    for key in {r[0] for r in rows}:
        kept = []
        for t, p in sorted({(t, p) for k, t, p in rows if k == key}):
            if kept and t - kept[-1][0] < gap:
                if p > kept[-1][1]:
                    kept[-1] = (t, p)
                continue
            kept.append((t, p))
        out += [(key, *k) for k in kept]
    return set(out)


def run_spaced(spark, rows, gap, **kw):
    df = spark.createDataFrame(rows, "v string, t bigint, p int")
    return {tuple(r) for r in spaced(df, key="v", time="t", priority="p", gap_ms=gap, **kw).collect()}


def test_known_candidates(spark):
    grid = [("v", t, 0) for t in (0, 8000, 16000)]
    assert {r[1] for r in run_spaced(spark, [*grid, ("v", 8300, 1)], 2000)} == {0, 8300, 16000}
    assert {(r[1], r[2]) for r in run_spaced(spark, [("v", 0, 0), ("v", 8000, 1), ("v", 8500, 2)], 2000)} == {(0, 0), (8500, 2)}


def test_spaced_across_buckets_matches_brute_force(spark):
    rng = random.Random(5)
    rows = [(rng.choice(["a", "b"]), rng.randrange(200_000), rng.randrange(3)) for _ in range(1200)]
    assert run_spaced(spark, rows, 700, bucket_ms=5_000) == brute_spaced(rows, 700)


def brute_distinct(rows):
    kept = set()
    for key in {r[0] for r in rows}:
        last = None
        for _, i, _, h, light, fixed in sorted((r for r in set(rows) if r[0] == key), key=lambda r: (r[2], r[1])):
            if last is not None and not fixed and ((h ^ last[0]) % (1 << 64)).bit_count() <= 4 and (light is None or last[1] is None or abs(light - last[1]) <= 10):
                continue
            kept.add(i)
            last = (h, light)
    return kept


def run_distinct(spark, rows, **kw):
    df = spark.createDataFrame(rows, "v string, i string, t bigint, h bigint, light int, fixed boolean")
    got = distinct_frames(df, key="v", row_id="i", time="t", hash_="h", brightness="light", pinned="fixed", most_bits=4, most_brightness=10, **kw)
    return {r["i"] for r in got.select(F.col("i")).collect()}


def noisy(rng, n, step, odds):
    base, rows = 0x0F0F0F0F0F0F0F0F, []
    for i in range(n):
        if rng.random() < odds:
            base ^= 0xFF << rng.randrange(0, 48)
        rows.append(("v" if i % 7 else "w", f"{i:04d}", i * step, base ^ (1 << rng.randrange(8)), rng.choice([None, 100, 104, 109]), i % 211 == 0 if odds else None))
    return rows


@pytest.mark.parametrize("seed,step,odds", [(6, 40_000, 0.2), (7, 400_000, 0.02), (8, 400_000, 0.003), (9, 1_000_000, 0.0)])
def test_distinct_frames_match_brute_force_however_still_the_picture(spark, seed, step, odds):
    rows = noisy(random.Random(seed), 500, step, odds)
    assert run_distinct(spark, rows) == brute_distinct(rows)
    assert run_distinct(spark, rows + rows[:40], bucket_ms=2 * step) == brute_distinct(rows)


def test_a_still_picture_of_many_hours_hides_nothing_after_it(spark):
    rows = [("v", f"a{i:02d}", i * 600_000, 7 ^ (i % 2), 90, False) for i in range(24)]
    rows += [("v", f"b{i}", (24 + 40 * i) * 600_000, -1 << (8 * i), 90, False) for i in range(6)]
    assert run_distinct(spark, rows) == {"a00", *[f"b{i}" for i in range(6)]} == brute_distinct(rows)
    assert run_distinct(spark, []) == set()


def test_chains_over_blocks_of_blocks_of_buckets(spark, monkeypatch):
    """Small blocks, so that hops are composed over several levels."""
    monkeypatch.setattr(chains, "FAN", 3)
    monkeypatch.setattr(chains, "TOGETHER", 50)
    rng, rows, t = random.Random(4), [], 0
    for n in range(700):
        t += rng.choice([0, 100, 300, 900, 2500, 40_000])
        rows.append((rng.choice(["hot", "hot", "x"]), f"{n:04d}", t, t + rng.choice([-50, 0, 200, 700, 5000])))
    assert run_sessions(spark, rows, 2000, 9000, 800, bucket_ms=18_000) == brute_sessions(rows, 2000, 9000, 800)
    frames = noisy(random.Random(5), 300, 60_000, 0.01)
    assert run_distinct(spark, frames, bucket_ms=120_000) == brute_distinct(frames)
