import hashlib

from pyspark.sql import functions as F

from timelode.functions.markdown import to_html, wrapped
from timelode.functions.media import frame_times, probe_fields, screen_reading, screen_text, speech_confidence
from timelode.operators.chat import FROM_SOURCES, NO_SOURCES, answers, last_turns, listed_sessions, numbered, save_sessions, snapshots
from timelode.plans import code, pipeline


def one(spark, value, kind, expression):
    return spark.createDataFrame([(value,)], f"c {kind}").select(expression(F.col("c"))).first()[0]


def test_probe(spark):
    text = '{"streams": [{"codec_type": "audio"}, {"codec_type": "video", "codec_name": "h264", "width": 1280, "height": 720}], "format": {"duration": "600.5", "format_name": "mov"}}'
    assert tuple(one(spark, text, "string", probe_fields)) == (600.5, "mov", "h264", 1280, 720)
    assert tuple(one(spark, '{"streams": []}', "string", probe_fields))[2] is None


def test_logs_and_recognisers(spark):
    assert one(spark, "x pts_time:1.5 y\npts_time:20 z", "string", frame_times) == [1.5, 20.0]
    assert one(spark, 0.0, "double", speech_confidence) == 1.0 and one(spark, None, "double", speech_confidence) is None
    boxes = "array<struct<text:string,score:double>>"
    assert tuple(one(spark, [("a", 0.5), ("b", 1.0)], boxes, screen_reading)) == ("a\nb", 0.75)
    assert tuple(one(spark, [], boxes, screen_reading)) == ("", 1.0)
    assert one(spark, "t", "string", lambda c: screen_text(c, F.lit(0.2))) == ""


def test_markdown(spark):
    got = one(spark, "# A & B\n\n- x\n- y\n\npara\nmore\n```\n<b>\n```", "string", to_html)
    assert got == "<h1>A &amp; B</h1>\n<ul>\n<li>x</li>\n<li>y</li>\n</ul>\n<p>para</p>\n<p>more</p>\n<pre><code>&lt;b&gt;</code></pre>"
    assert one(spark, "```py\n```\n- a\n```\nx  \n\n```\n####### t #\n```\nopen", "string", to_html) == (
        "<pre><code></code></pre>\n<ul>\n<li>a</li>\n</ul>\n<pre><code>x\n</code></pre>\n<h6># t #</h6>\n<pre><code>open</code></pre>"
    )
    assert one(spark, "", "string", to_html) == "" and one(spark, None, "string", to_html) is None
    assert one(spark, "abcde\n\nf", "string", lambda c: wrapped(c, 2)) == ["ab", "cd", "e", "", "f"]


def test_chat(spark):
    rows = [("s", f"m{i}", "user", f"c{i}", f"2025-01-0{i}") for i in range(1, 6)] + [("t", "x", "assistant", "hi", "2025-01-01")]
    messages = spark.createDataFrame(rows, "session_id string, id string, role string, content string, created_at string")
    got = {r["session_id"]: r["history"] for r in last_turns(messages, 2).collect()}
    assert got == {"s": "user: c4\nuser: c5", "t": "assistant: hi"}
    kind = "id string, title string, default_source string, created_at string, updated_at string"
    old = spark.createDataFrame([("s", "T", "docs", "1", "1")], kind)
    new = spark.createDataFrame([("s", None, "raw", "2", "2"), ("u", "U", "docs", "3", "3")], kind)
    saved = save_sessions(old, new)
    assert [tuple(r) for r in listed_sessions(saved).collect()] == [("u", "U", "docs", "3", "3"), ("s", "T", "raw", "1", "2")]
    docs = {r["session_id"]: r["document"] for r in snapshots(saved, messages).collect()}
    assert docs["s"].count('"role"') == 5 and '"messages":[]' in docs["u"]
    sources = spark.createDataFrame([(1, 2, "b  b"), (1, 1, "a"), (1, 9, "z")], "question_id bigint, place bigint, text string")
    told = {r[0]: r[1] for r in answers(spark.createDataFrame([(1,), (2,)], "question_id bigint"), sources).collect()}
    assert told == {1: f"{FROM_SOURCES}\n- a [1]\n- b b [2]", 2: NO_SOURCES}
    ids = [r["new_id"] for r in numbered(messages.where("session_id = 's'"), "session_id", ["created_at"], "seg", 0).orderBy("ordinal").collect()]
    assert ids[0] == "s_seg_0000" and ids[-1] == "s_seg_0004"


def test_pipeline_writes_and_skips_and_reports(spark, tmp_path):
    d, out = "/root/testdata/sf0.001", str(tmp_path)
    some = {n: pipeline.STAGES[n] for n in ("chunks", "records", "index", "sections", "outline", "status")}
    first = {r["stage"]: r for r in pipeline.run(spark, d, out, some).collect()}
    assert {r["status"] for r in first.values()} == {"written"}, first
    built = {r["id"] for r in spark.read.parquet(f"{out}/chunks.parquet").collect()}
    records = spark.read.parquet(f"{out}/records.parquet")
    assert {r["chunk_id"] for r in records.select("chunk_id").distinct().collect()} == built  # records of the chunks just built
    assert first["index"]["rows"] == first["records"]["rows"] == records.count()
    again = {r["stage"]: r for r in pipeline.run(spark, d, out, some).collect()}
    assert {r["status"] for r in again.values()} == {"skipped"} and {n: r["rows"] for n, r in again.items()} == {n: r["rows"] for n, r in first.items()}

    def broken(spark, d):
        raise ValueError("no space")

    some["records"] = pipeline.Stage(("chunks",), broken)
    last = {r["stage"]: (r["status"], r["detail"]) for r in pipeline.run(spark, d, out, some).collect()}
    assert last["records"] == ("failed", "no space") and last["index"] == ("blocked", "records") and last["outline"] == ("skipped", None)


def test_pages_validity_symbols_and_index(spark, tmp_path):
    blocks = [("p1", "v", 1.0, "Python", "import os\n\nclass A:\n    def f(self):\n        pass\n\n\nasync def g():\n    return 1"), ("p2", "v", 2.0, "python", "def f("), ("j1", "v", 3.0, "json", '{"a": 1}'), ("j2", "v", 3.0, "json", "{"), ("x", "v", None, None, None)]
    spark.createDataFrame(blocks, "id string, video_id string, timestamp_seconds double, language string, code string").write.parquet(f"{tmp_path}/code_blocks.parquet")
    docs = [(1, "# T\n\n- a\n", "section_exports"), (2, "x", "forum_mirrors"), (3, None, "section_exports")]
    spark.createDataFrame(docs, "doc_id bigint, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    chunks = [("c1", "v", 0.0, 1.0, "Hallo", None, "hallo du", "")]
    spark.createDataFrame(chunks, "id string, video_id string, start_seconds double, end_seconds double, topic string, summary string, transcript string, ocr_text string").write.parquet(f"{tmp_path}/chunks.parquet")
    d = str(tmp_path)
    assert {(r["doc_id"], r["html"]) for r in pipeline.document_pages(spark, d).collect()} == {(1, "<h1>T</h1>\n<ul>\n<li>a</li>\n</ul>"), (3, None)}
    assert {(r["id"], r["valid"]) for r in pipeline.code_validity(spark, d).collect()} == {("p1", True), ("p2", False), ("j1", True), ("j2", False)}
    assert {tuple(r) for r in code.python_symbols(spark, d).collect()} == {("p1", "A", 3, 5), ("p1", "g", 8, 9)}
    (row,) = pipeline.chunk_index(spark, d).collect()
    places = {}
    for word, times in (("hallo", 2), ("du", 1)):
        h = hashlib.blake2b(word.encode(), digest_size=8).digest()
        at = int.from_bytes(h[:4], "big") % 256
        places[at] = places.get(at, 0) + (times if h[4] & 1 else -times)
    norm = sum(x * x for x in places.values()) ** 0.5
    assert row["record_id"] == "c1_combined" and {i: x for i, x in enumerate(row["vector"]) if x} == {i: round(x / norm, 8) for i, x in places.items()}
