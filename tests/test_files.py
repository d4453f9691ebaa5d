from timelode.sources.files import fingerprint, read_manifests, read_texts, scan_files, write_texts


def test_scan_reads_listings_and_hashes(spark, tmp_path):
    (tmp_path / "src").mkdir()
    (tmp_path / "node_modules").mkdir()
    (tmp_path / "src" / "app.PY").write_text("x = 1")
    (tmp_path / "src" / "b.txt").write_text("no")
    (tmp_path / "node_modules" / "c.py").write_text("no")
    rows = scan_files(spark, str(tmp_path), suffixes=[".py"], max_mb=1, skip_folders=["node_modules"], content=True).collect()
    assert [r["path"].rsplit("/", 1)[1] for r in rows] == ["app.PY"] and len(rows[0]["sha256"]) == 64
    assert fingerprint(scan_files(spark, str(tmp_path))).where("fingerprint LIKE 'size=%'").count() == 3


def test_broken_manifests_are_set_aside(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"id": "v", "n": 2}')
    (tmp_path / "b.json").write_text('{"id": ')
    good, broken = read_manifests(spark, str(tmp_path), "id string, n bigint")
    assert [tuple(r) for r in good.collect()] == [("v", 2)] and broken.count() == 1


def test_texts_there_and_back(spark, tmp_path):
    df = spark.createDataFrame([("a", "# One"), ("b", "# Two")], "n string, t string")
    write_texts(df, str(tmp_path / "out"), name="n", text="t")
    assert {r["text"].strip() for r in read_texts(spark, str(tmp_path / "out"), "*.txt").collect()} == {"# One", "# Two"}
