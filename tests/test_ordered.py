"""Order-dependent operators on groups larger than a batch."""

from tessella.operators import ordered
from tessella.plans.relational_queries import QUERIES


def test_packed_in_batches(spark):
    """A group goes on over the end of a batch; neither pandas groups nor texts are moved."""
    lengths = [(7 * i) % 40 for i in range(300)]
    rows = [(g, i, None if n == 0 else "x" * n) for g in (1, None, 2) for i, n in enumerate(lengths)]
    expected, chunk, held = {}, 0, 0
    for i, n in enumerate(lengths):
        if held and held + n > 100:
            chunk, held = chunk + 1, 0
        expected[i] = chunk
        held += n
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, "16")
    try:
        found = ordered.packed(spark.createDataFrame(rows, "g long, pos int, text string").repartition(5), "g", 100)
        got = {(r["g"], r["pos"]): r["chunk"] for r in found.collect()}
    finally:
        spark.conf.set(name, before)
    assert got == {(g, i): c for g in (1, None, 2) for i, c in expected.items()}
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapGroups" not in plan and found.columns == ["g", "pos", "chunk"]


def test_prior_turns_are_counted_not_gathered(spark, sf_dir):
    plan = QUERIES["f02_prior_turns"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "collect_list" not in plan
