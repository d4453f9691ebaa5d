from datetime import datetime, timedelta

from timelode.streaming.timeline import activity, bounded_sessions, once_each, pause_sessions

T0 = datetime(2025, 1, 1)


def feed(spark, tmp_path, rows, schema, make, name):
    """Runs the stream over one file per batch of rows and returns what it has put out."""
    source = str(tmp_path / "in")
    write = lambda batch: spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(source)
    write(rows[0])
    stream = spark.readStream.schema(schema).parquet(source)
    query = make(stream).writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start()
    query.processAllAvailable()
    for batch in rows[1:]:
        write(batch)
        query.processAllAvailable()
    query.stop()
    return [tuple(r) for r in spark.table(name).collect()]


def at(seconds):
    return T0 + timedelta(seconds=seconds)


def test_windows_and_sessions_drop_what_comes_too_late(spark, tmp_path):
    rows = [[("a", at(1)), ("a", at(2)), ("b", at(3))], [("a", at(100))], [("a", at(4))], [("a", at(300))]]
    got = feed(spark, tmp_path / "w", rows, "k string, ts timestamp", lambda s: activity(s, time="ts", kind="k", late="10 seconds", width="60 seconds"), "w1")
    assert ("a", 2) in {(r[1], r[2]) for r in got} and ("b", 1) in {(r[1], r[2]) for r in got}
    got = feed(spark, tmp_path / "p", rows, "k string, ts timestamp", lambda s: pause_sessions(s, key="k", time="ts", late="10 seconds", pause="8 seconds"), "p1")
    assert {(r[0], r[3]) for r in got} >= {("a", 2), ("b", 1)}


def test_repeats_count_once(spark, tmp_path):
    rows = [[("x", at(1)), ("x", at(1))], [("x", at(2)), ("y", at(3))]]
    got = feed(spark, tmp_path, rows, "id string, ts timestamp", lambda s: once_each(s, row_id="id", time="ts", late="1 hour"), "d1")
    assert sorted(r[0] for r in got) == ["x", "y"]


def test_bounded_sessions_follow_the_batch_rule(spark, tmp_path):
    rows = [[("v", at(0), at(20)), ("v", at(210), at(240))], [("v", at(20), at(70))], [("v", at(900), at(905))], [("v", at(2000), at(2001))], [("v", at(5000), at(5001))]]
    make = lambda s: bounded_sessions(s, key="k", time="ts", end="te", late="400 seconds", min_ms=30_000, max_ms=120_000, pause_ms=8_000)
    got = feed(spark, tmp_path, rows, "k string, ts timestamp, te timestamp", make, "s1")
    base = int(T0.timestamp() * 1000)
    assert {((r[1] - base) // 1000, (r[2] - base) // 1000, r[3]) for r in got} >= {(0, 70, 2), (210, 240, 1)}
