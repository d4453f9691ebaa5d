"""Rules on documents, code and chats against small cases."""

import pytest

from timelode.operators.retrieval import search
from timelode.operators.scan import row_numbers
from timelode.plans import code, documents, enrich, retrieval

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, video_id string"
CHUNKS = "id string, video_id string, start_seconds double, end_seconds double, topic string, summary string, transcript string, ocr_text string, metadata_json string"
BLOCKS = "id string, video_id string, chunk_id string, timestamp_seconds double, language string, code string, source string, confidence double, verified boolean"


@pytest.fixture
def tables(spark, tmp_path):
    def write(**named):
        for name, (rows, schema) in named.items():
            spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
        return str(tmp_path)

    return write


def doc(i, text, source="section_exports", video="v"):
    return (i, text, None, source, None if text is None else len(text), video)


SECTION = """# Title

## Obiettivo

<!-- nothing -->

## Spiegazione dettagliata

- Si avvia il server locale [1]
2. Nothing backs this line at all
Da completare
### sub
```
code line [9]
## no heading
```
Bananas apples cherries plums [1]

## Obiettivo
Now there is text.
"""


def test_headings_and_claims(spark, tables):
    d = tables(
        documents=([doc(1, SECTION), doc(2, ""), doc(3, None), doc(4, "## Riferimenti", "forum_mirrors")], DOCS),
        chunks=([("c1", "v", 0.0, 60.0, None, "Si avvia il server locale", None, None, None)], CHUNKS),
    )
    issues = {(r["heading"], r["issue"]): r["documents"] for r in documents.heading_issues(spark, d).collect()}
    assert issues["Obiettivo", "missing"] == 1 and ("Obiettivo", "empty") not in issues  # the last one of a name counts
    assert issues["Spiegazione dettagliata", "missing"] == 1 and issues["Riferimenti", "missing"] == 2 and len(issues) == 9
    lines = documents.told(documents._docs(spark, d), documents.NARRATIVE).select("line").collect()
    assert {r[0] for r in lines} == {"Si avvia il server locale [1]", "Nothing backs this line at all", "Bananas apples cherries plums [1]"}
    assert {tuple(r) for r in documents.narrative_claims(spark, d).collect()} == {(1, "uncited", 3), (1, "low_overlap", 1)}


def test_fences(spark, tables):
    text = "```py\na  \n\nb\n``` more\n  ```\na\n\nb\n```\n```\n```\n```\n\n```\n```\nopen"
    d = tables(documents=([doc(1, text), doc(2, "no fence"), doc(3, "```")], DOCS))
    assert {(r["doc_id"], r["fence_no"], r["lines"]) for r in documents.code_fences(spark, d).collect()} == {(1, 1, 3), (1, 2, 3), (1, 4, 1)}
    assert [(r["doc_id"], r["times"]) for r in documents.repeated_fences(spark, d).collect()] == [(1, 2)]


def test_sources_must_be_named_and_timed(spark, tables):
    d = tables(
        documents=([doc(1, "Demo.mp4 00:00:10-00:00:40 and 00:01:00-00:01:30"), doc(2, "nothing"), doc(3, "x", video="w")], DOCS),
        chunks=([("c1", "v", 10.0, 40.0, None, "a", None, None, None), ("c2", "v", 60.0, 90.4, None, "b", None, None, None), ("c3", "v", 60.0, None, None, "b", None, None, None)], CHUNKS),
        videos=([("v", "Demo.mp4")], "id string, filename string"),
    )
    assert {tuple(r) for r in documents.source_mentions(spark, d).collect()} == {(1, 3, 0, 1), (2, 3, 3, 3)}


def test_code_reviews(spark, tables):
    cases = {
        "j1": ('{"a": [1, 2]}', 0.9, "configuration", "json", "valid", True, []),
        "j2": ('{"a": 1,}', 0.9, "configuration", "json", "invalid", False, ["validation", "unverified"]),
        "p1": ("def f():\n    return 1", 0.5, "source_code", "python", "valid", True, ["confidence"]),
        "p2": ("def f(:\n    return 1", None, "source_code", "python", "invalid", False, ["validation", "unverified"]),
        "p3": ("x = 1\ny = (x)", 0.9, "source_code", "python", "valid", True, []),
        "t1": ("$ npm run dev", 0.9, "terminal_command", "bash", "not_applicable", True, []),
        "h1": ("<p>hello</p>", 0.9, "source_code", "html", "not_applicable", False, ["unverified"]),
        "u1": ("Save as", 0.1, "ui_label", "other", "not_applicable", False, []),
        "e1": ("  ", 0.9, None, None, None, None, None),
        "n1": (None, 0.9, None, None, None, None, None),
    }
    pytest.importorskip("yaml")
    cases["y1"] = ("name: a\nport: 1", 0.95, "configuration", "yaml", "valid", True, [])
    cases["y2"] = ("name: a\n  port: [1", 0.95, "configuration", "yaml", "invalid", False, ["validation", "unverified"])
    d = tables(code_blocks=([(i, "v", None, 1.0, None, c[0], None, c[1], False) for i, c in cases.items()], BLOCKS))
    got = {r["id"]: (r["content_type"], r["language"], r["validation"], r["verified"], r["reasons"]) for r in code.code_reviews(spark, d).collect()}
    assert got == {i: c[2:] for i, c in cases.items() if c[2] is not None}


def test_records_hold_code_and_chunks_are_numbered(spark, tables):
    d = tables(
        chunks=([("c2", "v", 50.0, 60.0, "T", " S ", None, "", "{}"), ("c1", "v", 0.0, 10.0, None, None, None, None, "{}"), ("c3", "v", 7300.0, 7301.0, "T", None, "tr", None, "{}")], CHUNKS),
        code_blocks=([("b2", "v", None, 52.0, "py", "x = 1", None, 0.9, True), ("b1", "v", None, 51.0, "", "y", None, 0.9, True), ("b3", "v", None, None, "py", " ", None, 0.9, True)], BLOCKS),
        frames=([], "id string, video_id string, timestamp_seconds double, ocr_text string, ocr_confidence double"),
    )
    texts = {r["record_id"]: r["text"] for r in enrich.record_texts(spark, d).collect()}
    assert texts == {"c2_summary": "S", "c2_code": "y\n\nx = 1", "c2_combined": "T\n\n S \n\ny\n\nx = 1", "c3_transcript": "tr", "c3_combined": "T\n\ntr"}
    numbers = {r["chunk_id"]: r["ordinal"] for r in enrich.all_chunks(spark, d).collect()}
    assert numbers == {"c1": 1, "c2": 2, "c3": 3, "b3_chunk": 1, "b1_chunk": 2, "b2_chunk": 3}
    topics = {r["chunk_id"]: r["topic"] for r in enrich.chunk_labels(spark, d).collect()}
    assert topics["c2"] == "Codice: y" and topics["c3"] == "tr"


def test_row_numbers_cross_buckets(spark):
    df = spark.createDataFrame([("k", b, i) for b in (5, -2, 7) for i in range(3)], "k string, b bigint, i bigint")
    got = [(r["b"], r["i"], r["n"]) for r in row_numbers(df, ["k"], "b", ["i"], "n").orderBy("n").collect()]
    assert got == [(b, i, 3 * p + i + 1) for p, b in enumerate((-2, 5, 7)) for i in range(3)]


def test_search_within_a_scope_matches_brute_force(spark):
    import random

    rng = random.Random(4)
    index = [(f"r{i:03d}", f"k{i % 40}", rng.choice("ab"), [float(rng.randrange(-2, 3)) for _ in range(4)]) for i in range(300)]
    queries = [(i, rng.choice(["a", "b", "z", None]), [float(rng.randrange(-2, 3)) for _ in range(4)]) for i in range(30)]
    left = spark.createDataFrame([*queries, (99, None, None)], "query_id bigint, scope string, vec array<double>")
    right = spark.createDataFrame([*index, ("x", "k", "a", None), (None, "k", "a", [1.0, 0.0, 0.0, 0.0]), ("y", "k", "a", [1.0])], "row_id string, dedup_key string, scope string, vec array<double>")

    def cosine(a, b):
        n = (sum(x * x for x in a) * sum(x * x for x in b)) ** 0.5
        return round(sum(x * y for x, y in zip(a, b, strict=True)) / n, 6) if n else 0.0

    for once in (False, True):
        expected = set()
        for q, scope, v in queries:
            ranked, seen = sorted((-cosine(v, w), r, k) for r, k, s, w in index if scope in (None, s) and cosine(v, w) > 0), set()
            ranked = [x for x in ranked if not once or not (x[2] in seen or seen.add(x[2]))]
            expected |= {(q, r, -c, p) for p, (c, r, _) in enumerate(ranked[:5], 1)}
        got = search(left, right, k=5, once_per_key=once, scope="scope")
        assert {(r["query_id"], r["row_id"], r["score"], r["place"]) for r in got.collect()} == expected


def test_questions_fall_back_to_records_without_documentation(spark, tables):
    d = tables(
        documents=([doc(50, "user: how does the server start\nassistant: so\nuser: the server", "chat_answers"), doc(100, "server start", "code_notes"), doc(150, "unrelated zebra", "code_notes")], DOCS),
        chunks=([("c1", "v", 0.0, 60.0, "server", "the server start", "start the server", None, None)], CHUNKS),
        code_blocks=([], BLOCKS),
        frames=([], "id string, video_id string, timestamp_seconds double, ocr_text string, ocr_confidence double"),
    )
    got = {(r["query_id"], r["index"]) for r in retrieval.ask_sources(spark, d).collect()}
    assert got >= {(50, "raw"), (100, "raw")} and all(i == "raw" for _, i in got)
    assert {r["query_id"] for r in retrieval.ask(spark, d).collect()} == {50, 100, 150}
