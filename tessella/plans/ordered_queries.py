"""Queries over order-dependent operators and the event stream; SQL where there is one."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import ordered
from ..streaming import events
from .inputs import given, table

QUERIES, SQL = {}, {}
c = F.col


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


@query("f15_packed_turns", """WITH RECURSIVE t AS (SELECT conv_id, turn, length(text) AS n, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS r FROM conversations),
w(conv_id, turn, r, chunk, held) AS (SELECT conv_id, turn, r, 0, n FROM t WHERE r = 1 UNION ALL
SELECT t.conv_id, t.turn, t.r, CASE WHEN w.held > 0 AND w.held + t.n > 1500 THEN w.chunk + 1 ELSE w.chunk END, CASE WHEN w.held > 0 AND w.held + t.n > 1500 THEN t.n ELSE w.held + t.n END FROM t JOIN w ON t.conv_id = w.conv_id AND t.r = w.r + 1)
SELECT conv_id, turn, CAST(chunk AS INT) AS chunk FROM w""")
def packed_turns(spark, sf_dir):
    items = table(spark, sf_dir, "conversations").select("conv_id", c("turn").alias("pos"), "text")
    return ordered.packed(items, "conv_id", 1500).select("conv_id", c("pos").alias("turn"), "chunk")


@query("i55_fuzzy_titles")
def fuzzy_titles(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select("p_brand", c("p_partkey").alias("pos"), c("p_name").alias("title"))
    return ordered.fuzzy_distinct(rows, "p_brand")


def _versions(spark, sf_dir):
    """Every line that ends in e is another one in the new version."""
    return table(spark, sf_dir, "documents").select(c("doc_id").alias("id"), c("text").alias("old"), F.regexp_replace("text", r"e(\n|$)", "e!$1").alias("new"))


@query("e22_version_diff")
def version_diff(spark, sf_dir):
    return ordered.line_diff(_versions(spark, sf_dir))


@query("e22_line_changes", r"""WITH v AS (SELECT doc_id AS id, text AS old, regexp_replace(text, 'e(\n|$)', 'e!\1', 'g') AS new FROM documents),
m AS (SELECT id, line, sum(s) AS n FROM (SELECT id, unnest(string_split(new, chr(10))) AS line, 1 AS s FROM v UNION ALL SELECT id, unnest(string_split(old, chr(10))), -1 FROM v) x GROUP BY ALL HAVING sum(s) <> 0)
SELECT id, CAST(sum(greatest(n, 0)) AS BIGINT) AS added, CAST(sum(greatest(-n, 0)) AS BIGINT) AS removed FROM m GROUP BY id""")
def line_changes(spark, sf_dir):
    return ordered.line_changes(_versions(spark, sf_dir))


@query("k06_charts", """SELECT doc_id AS id, CAST(length(text) AS INT) AS start, 'FLOW_DATA' AS kind, doc_id % 2 = 0 AS valid FROM documents""")
def charts(spark, sf_dir):
    tail = F.when(c("doc_id") % 2 == 0, '[FLOW_DATA:{"a":[1,"]}",{"b":2}]}] end').otherwise("[FLOW_DATA:{'a':1}] end")
    found = ordered.chart_scan(table(spark, sf_dir, "documents").select(c("doc_id").alias("id"), F.concat("text", tail).alias("content")))
    return found.select("id", "start", "kind", "valid")


@query("k08_repaired_json", """SELECT event_id, '[{"k": ' || CAST(json_extract_string(props, '$.k') AS STRING) || '}]' AS json FROM events""")
def repaired(spark, sf_dir):
    cut = F.concat(F.lit("```json\n["), F.col("props"), F.lit(', {"k": 1'), F.lit("\n```"))
    return table(spark, sf_dir, "events").select("event_id", ordered.repair_json(cut).alias("json"))


@query("k10_blob_round_trip", "SELECT vec_id, CAST(len(embedding) AS INT) AS n, TRUE AS same FROM embeddings")
def blob_round_trip(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select("vec_id", F.size("embedding").alias("n"), (ordered.blob_round_trip(c("embedding")) == c("embedding")).alias("same"))


@query("s01_event_stream", "SELECT user_id AS project, event_type AS stage, count(*) AS n, max(event_id) AS last_id FROM events GROUP BY ALL")
def event_stream(spark, sf_dir):
    """The events table read as a stream to its end, its running counts as of then."""
    import uuid

    name = f"stage_counts_{uuid.uuid4().hex}"
    running = events.stage_counts(events.stream(spark, f"{sf_dir}/events.parquet"))
    job = running.writeStream.outputMode("complete").format("memory").queryName(name).trigger(availableNow=True).start()
    try:
        job.awaitTermination()
    finally:
        job.stop()
    return spark.table(name)


@query("x01_all_chapter_rules_on_notes", "SELECT 'word_count' AS check_id, count(*) AS n FROM orders")
def rules_on_notes(spark, sf_dir):
    from ..operators import rules

    return rules.findings(given(spark, sf_dir, "note").select("id", c("note").alias("content"), c("title"), F.lit(300).alias("target_words"))).groupBy("check_id").agg(F.count("*").alias("n"))
