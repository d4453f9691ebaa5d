import random

from timelode.operators.nearest import nearest_points, nearest_span


def test_nearest_span_matches_brute_force(spark):
    rng = random.Random(2)
    spans = [(rng.choice("ab"), f"s{n:03d}", s, s + rng.choice([0, 500, 90_000, -1])) for n in range(150) for s in [rng.randrange(20_000_000)]]
    spans += [*spans[:10], (None, "x", 1, 2), ("a", None, 1, 2), ("a", "y", None, 2)]
    probes = [(rng.choice("abc"), f"p{n:03d}", rng.randrange(20_000_000)) for n in range(300)] + [("a", "q", None)]
    got = nearest_span(
        spark.createDataFrame(probes, "v string, pid string, t bigint"), spark.createDataFrame(spans, "v string, sid string, s bigint, e bigint"),
        key="v", probe_id="pid", time="t", span_id="sid",
    )
    expected = {}
    for v, pid, t in probes:
        options = [(0 if s <= t <= e else min(abs(t - s), abs(t - e)), s, sid) for w, sid, s, e in spans if t is not None and w == v and sid and s is not None and e >= s]
        if options:
            d, _, sid = min(options)
            expected[pid] = (sid, d)
    assert {r["pid"]: (r["sid"], r["distance_ms"]) for r in got.collect()} == expected


def test_nearest_points_match_brute_force_however_far(spark):
    rng = random.Random(3)
    points = [(rng.choice("aab"), f"s{n:03d}", rng.choice([rng.randrange(90_000_000), 5_000_000])) for n in range(120)]
    points += [*points[:10], (None, "x", 1), ("a", None, 1), ("a", "y", None), ("e", "only", 7)]
    probes = [(rng.choice("abce"), f"p{n:03d}", rng.choice([rng.randrange(99_000_000), 5_000_000])) for n in range(200)] + [("a", "q", None)]
    got = nearest_points(
        spark.createDataFrame(probes, "v string, pid string, at bigint"), spark.createDataFrame(points, "v string, sid string, t bigint"),
        key="v", probe_id="pid", time="at", point_id="sid", n=3,
    )
    expected = set()
    for v, pid, at in probes:
        near = sorted({(abs(t - at), t, sid) for w, sid, t in points if at is not None and w == v and sid and t is not None})[:3]
        expected |= {(pid, at, k, sid, d) for k, (d, _, sid) in enumerate(near, 1)}
    assert {(r["pid"], r["at"], r["place"], r["sid"], r["distance_ms"]) for r in got.collect()} == expected
