import numpy as np
from pyspark.sql import functions as F

from timelode.functions.vectors import embed_blake2b
from timelode.operators import retrieval


def test_search_in_several_blocks_and_parts_matches_brute_force(spark, monkeypatch):
    monkeypatch.setattr(retrieval, "PART_ROWS", 70)
    monkeypatch.setattr(retrieval, "BLOCK_QUERIES", 8)
    rng = np.random.default_rng(1)
    x = rng.standard_normal((300, 6)).round(2)
    index = [(i, i % 17, v.tolist()) for i, v in enumerate(x)] + [(900, 1, None), (901, 2, [1.0]), (902, 3, [0.0] * 6)]
    asked = [(i, x[i].tolist()) for i in range(0, 300, 10)]
    got = retrieval.search(
        spark.createDataFrame(asked, "query_id bigint, vec array<double>"), spark.createDataFrame(index, "row_id bigint, dedup_key bigint, vec array<double>"),
        k=5, once_per_key=True,
    )
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    expected = set()
    for q, _ in asked:
        seen, place = set(), 0
        for score, i in sorted((-round(float(s), 6), i) for i, s in enumerate(u @ u[q])):
            if score < 0 and i % 17 not in seen and place < 5:
                seen.add(i % 17)
                place += 1
                expected.add((q, i, place))
    assert {(r["query_id"], r["row_id"], r["place"]) for r in got.collect()} == expected


def test_search_of_nothing(spark):
    q = spark.createDataFrame([], "query_id bigint, vec array<double>")
    x = spark.createDataFrame([(1, 1, [1.0])], "row_id bigint, dedup_key bigint, vec array<double>")
    assert retrieval.search(q, x, k=3, once_per_key=False).count() == 0


def test_cosine_of_odd_vectors(spark):
    rows = [([1.0, 0.0], [2.0, 0.0]), ([0.0, 0.0], [1.0, 1.0]), ([1.0], [1.0, 2.0]), (None, [1.0])]
    df = spark.createDataFrame(rows, "a array<double>, b array<double>")
    assert [r[0] for r in df.select(retrieval.cosine(F.col("a"), F.col("b"))).collect()] == [1.0, 0.0, None, None]


def test_embedding_is_of_unit_length_and_empty_for_no_tokens(spark):
    df = spark.createDataFrame([("npm run dev",), ("¿?",), (None,), ("x " * 30_000,)], "t string")
    got = [r[0] for r in df.select(embed_blake2b(F.col("t"))).collect()]
    assert abs(sum(v * v for v in got[0]) - 1) < 1e-6 and not any(got[1]) and got[2] is None and max(map(abs, got[3])) == 1.0
