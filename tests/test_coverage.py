"""Coverage of documents by whole passages."""

from tessella.plans.relational_queries import QUERIES


def test_passages_are_read_to_their_end(spark, tmp_path):
    """A document that holds only the end of a passage is no missing one."""
    head = " ".join(f"lead{i:02d}" for i in range(12))
    spark.createDataFrame([(1, f"{head} zebra quartz")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(1, "a zebra on quartz"), (2, "nothing of it"), (3, f"{head} zebra"), (4, "quartz")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    found = QUERIES["d13_passage_coverage"](spark, str(tmp_path)).collect()
    assert [tuple(r) for r in found] == [(1, 2, 1, 2 + 13 + 1)]
