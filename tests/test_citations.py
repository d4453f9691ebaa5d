"""Citations of every source that the reference numbers, the sixth as well."""

from timelode.plans import documents


def test_the_sixth_source_is_known_and_checked(spark, tmp_path):
    chunks = [(f"c{i}", "v", float(i), i + 1.0, f"summary{i} docker compose deploy server", None) for i in range(1, 8)]
    spark.createDataFrame(chunks, "id string, video_id string, start_seconds double, end_seconds double, summary string, transcript string").write.parquet(f"{tmp_path}/chunks.parquet")
    text = "# Title\ndocker compose deploy server [6]\nbananas apples cherries plums [6]\nno such source [7]\ndocker compose [1]"
    spark.createDataFrame([(1, "v", text)], "doc_id bigint, video_id string, text string").write.parquet(f"{tmp_path}/documents.parquet")

    d = str(tmp_path)
    assert {tuple(r) for r in documents.unknown_citations(spark, d).collect()} == {(1, 7)}
    assert {(r["doc_id"], r["line_no"], r["rank"]) for r in documents.weak_claims(spark, d).collect()} == {(1, 2, 6)}
    assert {tuple(r) for r in documents.issue_counts(spark, d).collect()} == {("sources", "error", 1, 1), ("overlap", "warning", 1, 1)}
