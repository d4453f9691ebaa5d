"""Event windows against the rule row by row, and the choice between the two kinds of window."""

import numpy as np

from timelode.operators.chains import event_windows
from timelode.plans import timeline


def swept(times, least, most, margin):
    found, start, end, n = [], max(0, times[0] - margin), times[0], 1
    for t in times[1:]:
        if t - start > most and end - start >= least:
            found.append((start, max(end + margin, start), n))
            start, n = max(0, t - margin), 0
        end, n = t, n + 1
    return found + [(start, max(end + margin, start + least), n)]


def test_event_windows_follow_the_sweep_across_buckets(spark):
    rng = np.random.default_rng(1)
    times = {f"v{i}": sorted({int(t) for t in np.cumsum(rng.exponential(scale, 150))}) for i, scale in enumerate((5_000, 30_000, 200_000, 3_000_000))}
    times["one"] = [2_000]
    df = spark.createDataFrame([(v, t) for v, ts in times.items() for t in ts], "v string, t bigint")
    got = event_windows(df, key="v", time="t", min_ms=90_000, max_ms=480_000, margin_ms=5_000)
    assert {tuple(r) for r in got.collect()} == {(v, *w) for v, ts in times.items() for w in swept(ts, 90_000, 480_000, 5_000)}


def test_videos_without_segments_have_event_windows(spark, tmp_path):
    def write(name, rows, schema):
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")

    write("videos", [("a", 1000.0), ("b", 1000.0), ("c", 60.0)], "id string, duration_seconds double")
    write("transcript_segments", [("s", "a", 1.0, 4.0)], "id string, video_id string, start_seconds double, end_seconds double")
    write("frames", [("f1", "a", 50.0, "x"), ("f2", "b", 10.0, "x"), ("f3", "b", 200.0, "x"), ("f4", "b", 900.0, None)], "id string, video_id string, timestamp_seconds double, ocr_text string")
    write("code_blocks", [("k", "c", 20.0)], "id string, video_id string, timestamp_seconds double")
    d = str(tmp_path)
    assert {tuple(r) for r in timeline.media_windows(spark, d).collect()} == {
        ("a", 1_000, 4_000, "transcript", 1), ("b", 5_000, 205_000, "events", 2), ("c", 15_000, 60_000, "events", 1),
    }
    assert ("b", 5_000, 205_000, 2) in {tuple(r) for r in timeline.event_sessions(spark, d).collect()}
