from timelode.operators.maintenance import append, changes, replace_partitions, signatures, update_columns, upsert


def test_upsert_keeps_and_fills(spark):
    old = spark.createDataFrame([(1, "t1", "f1", "h1"), (2, "t2", "f2", "h2")], "id int, title string, print string, hash string")
    new = spark.createDataFrame([(2, None, None, None), (3, "t3", "f3", "h3")], "id int, title string, print string, hash string")
    got = {tuple(r) for r in upsert(old, new, key="id", keep=["title"], fill=["print"]).collect()}
    assert got == {(1, "t1", "f1", "h1"), (2, "t2", "f2", None), (3, "t3", "f3", "h3")}


def test_changes_compare_nulls_as_equal(spark):
    old = spark.createDataFrame([("a", "1"), ("b", None), ("c", "1"), ("e", None)], "p string, h string")
    new = spark.createDataFrame([("a", "2"), ("b", None), ("d", "1"), ("e", "1")], "p string, h string")
    assert {tuple(r) for r in changes(old, new, key="p", value="h").collect()} == {("a", "modified"), ("c", "removed"), ("d", "added"), ("e", "modified")}


def test_signatures_ignore_order_and_see_nulls(spark):
    rows = [("v", "1", None), ("v", "2", "x"), ("w", "1", "")]
    one = {r["k"]: r["mark"] for r in signatures(spark.createDataFrame(rows, "k string, a string, b string"), "k", ["a", "b"]).collect()}
    two = {r["k"]: r["mark"] for r in signatures(spark.createDataFrame([*rows[1::-1], ("w", "1", None)], "k string, a string, b string"), "k", ["a", "b"]).collect()}
    assert one["v"] == two["v"] and one["w"] != two["w"]


def test_update_columns_can_write_null(spark):
    old = spark.createDataFrame([(1, "a", "z"), (2, "b", "z")], "id int, t string, o string")
    new = spark.createDataFrame([(2, None)], "id int, t string")
    assert {tuple(r) for r in update_columns(old, new, keys=["id"], columns=["t"]).collect()} == {(1, "a", "z"), (2, None, "z")}


def test_replace_touches_only_its_partitions(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = lambda *r: spark.createDataFrame(list(r), "id int, v string")
    replace_partitions(rows((1, "a"), (2, "b")), path, by="v")
    replace_partitions(rows((3, "b")), path, by="v")
    assert {tuple(r) for r in spark.read.parquet(path).select("id", "v").collect()} == {(1, "a"), (3, "b")}
    append(rows((4, "c")), str(tmp_path / "u"))
    append(rows((5, "c")), str(tmp_path / "u"))
    assert spark.read.parquet(str(tmp_path / "u")).count() == 2
