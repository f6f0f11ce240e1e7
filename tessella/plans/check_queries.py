"""Queries over single checks of chapters and projects, and over small lists that the application shows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import coverage, lifecycle, ordered, projects, retrieval, rules, state
from . import document_queries as docs
from .inputs import cte, given, table
from .relational_queries import _MATRIX, _matrix
from .rule_queries import SQL as RULE_SQL
from .rule_queries import trailing_sql

QUERIES, SQL = {}, {}
c = F.col


def query(name: str, sql: str):
    def add(f):
        QUERIES[name], SQL[name] = f, sql
        return f

    return add


# --- checks of projects, one by one ----------------------------------------------------------------------------------
def _check(name: str, check: str, sql: str) -> None:
    def run(spark, sf_dir):
        return projects.project_findings(*docs._project(spark, sf_dir), (check,)).select("project_id", "message")

    QUERIES[name], SQL[name] = run, sql


_BASE = f"WITH {docs._PROJECT}"
_check("q26_project_template_residue", "project_template_residue", f"{_BASE} SELECT DISTINCT project_id, '模板残留：TODO' AS message FROM leaf WHERE contains(content, 'TODO')")
_check("q28_project_substantial", "project_substantial_response", f"{_BASE}, {docs._RESPONSE} SELECT DISTINCT project_id, '缺少实质性响应：' || title AS message FROM rigid WHERE (project_id, id) NOT IN (SELECT (project_id, id) FROM near)")
_check("q30_project_mandatory", "project_mandatory", f"{_BASE}, {docs._MISSING} SELECT DISTINCT project_id, '「' || title || '」缺少必备要素：' || missing AS message FROM lack")
_check(
    "q31_project_length_balance", "project_length_balance",
    f"""{_BASE}, s AS (SELECT *, length(content) AS n FROM leaf WHERE trim(coalesce(content, '')) <> ''), t AS (SELECT project_id, sum(n) AS total, count(*) AS k FROM s GROUP BY project_id)
SELECT DISTINCT project_id, '章节「' || title || '」约占全文 ' || CAST(CAST(round_even(n / CAST(total AS DOUBLE) * 100, 0) AS INT) AS STRING) || '%（' || CAST(n AS STRING) || ' 字），篇幅分布失衡' AS message FROM s JOIN t USING (project_id) WHERE k >= 2 AND n / CAST(total AS DOUBLE) > 0.4""",
)


@query("q29_project_title_keywords", f"{_BASE}, kw AS (SELECT DISTINCT o_custkey AS project_id, 'L' || CAST(l_orderkey AS STRING) AS id, lower(split_part(p_type, ' ', 1)) AS k FROM lineitem JOIN part ON l_partkey = p_partkey JOIN orders ON o_orderkey = l_orderkey) SELECT leaf.project_id, leaf.id FROM leaf JOIN kw ON kw.id = leaf.id GROUP BY ALL HAVING count(*) FILTER (contains(replace(replace(leaf.title, ' ', ''), '-', ''), k)) = 0")
def project_title_keywords(spark, sf_dir):
    leaves, asked = docs._project(spark, sf_dir)
    return projects.title_keywords(leaves, asked).select("project_id", "id")


@query("q18_cross_chapter_message", f"SELECT conv_id, turn, '与前序章节内容重复偏高（约 ' || CAST(CAST(floor(ratio * 100 + 0.0000001) AS INT) AS STRING) || '%）' AS message FROM ({docs.SQL['l15_cross_chapter_overlap']}) x")
def cross_chapter_message(spark, sf_dir):
    found = projects.overlap(docs._turns(spark, sf_dir, ("project_id",)), keep="[^A-Za-z]")
    share = F.floor(c("ratio") * 100 + F.lit(0.0000001)).cast("int").cast("string")
    return found.select(c("project_id").alias("conv_id"), c("ord").alias("turn"), F.concat(F.lit("与前序章节内容重复偏高（约 "), share, F.lit("%）")).alias("message"))


@query("i65_template_residues", f"SELECT id, count(*) AS n, md5(string_agg(message, '|' ORDER BY message)) AS digest FROM ({RULE_SQL['q04_template_residue']}) x GROUP BY id")
def template_residues(spark, sf_dir):
    each = given(spark, sf_dir, "chapter").select("id", F.explode(rules.residues(c("content"))).alias("m"))
    return each.groupBy("id").agg(F.count("*").alias("n"), F.md5(F.array_join(F.array_sort(F.collect_list("m")), "|")).alias("digest"))


@query("h07_blind_bid_violations", f"{RULE_SQL['q05_blind_bid']}")
def blind_bid_violations(spark, sf_dir):
    return given(spark, sf_dir, "chapter").select("id", F.explode(rules.blind_bid_residues(c("content"), F.lit(True))).alias("message"))


@query("q37_blind_bid_residues", f"SELECT id, message FROM ({RULE_SQL['q05_blind_bid']}) x WHERE id IN (SELECT doc_id FROM documents WHERE doc_id % 9 <> 0)")
def blind_bid_residues(spark, sf_dir):
    """Chapters of blind bids alone, here those that give no overview, are judged."""
    return given(spark, sf_dir, "chapter").select("id", F.explode(rules.blind_bid_residues(c("content"), c("title") != "工程概况")).alias("message"))


@query("d11_chapter_scope", RULE_SQL["q01_chapter_scope"])
def chapter_scope(spark, sf_dir):
    chapters = given(spark, sf_dir, "chapter").withColumn("other_titles", F.array(F.lit("服务范围"), F.lit("")))
    return rules.findings(chapters, "chapter", ("chapter_scope",)).select("id", "message")


@query("x04_chapter_checks", f"SELECT id, count(*) AS n FROM (SELECT id, message FROM ({RULE_SQL['q08_truncation']}) a UNION ALL SELECT id, message FROM ({RULE_SQL['q13_markdown_table']}) b UNION ALL SELECT id, message FROM ({RULE_SQL['q15_ai_cliche']}) d) x GROUP BY id")
def chapter_checks(spark, sf_dir):
    return rules.findings(given(spark, sf_dir, "chapter"), "chapter", ("truncation", "markdown_table", "ai_cliche")).groupBy("id").agg(F.count("*").alias("n"))


# --- matrix ----------------------------------------------------------------------------------------------------------
@query("y01_row_status", f"{_MATRIX} SELECT status, count(*) AS n FROM matrix GROUP BY status")
def row_status(spark, sf_dir):
    return _matrix(spark, sf_dir).groupBy("status").agg(F.count("*").alias("n"))


@query("q27_scoring_coverage", """WITH d AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\\s,;:()\\[\\]\\-_/]', '', 'g') AS t FROM documents), r AS (SELECT DISTINCT p_type AS title, lower(split_part(p_type, ' ', 3)) AS k FROM part)
SELECT title AS id, count(*) FILTER (s = 2) AS covered, count(*) FILTER (s = 1) AS partial, count(*) FILTER (s = 0) AS missing FROM (SELECT title, CASE WHEN contains(t, replace(title, ' ', '')) OR n >= 2 THEN 2 WHEN n = 1 THEN 1 ELSE 0 END AS s FROM
(SELECT title, t, len(list_filter(list_distinct(list_prepend(replace(title, ' ', ''), list_prepend(k, string_split(title, ' ')))), lambda w: length(w) >= 2 AND contains(t, w))) AS n FROM d, r) x) y GROUP BY title""")
def scoring_coverage(spark, sf_dir):
    asked = table(spark, sf_dir, "part").select(c("p_type").alias("id"), c("p_type").alias("title"), F.lower(F.substring_index("p_type", " ", -1)).alias("keyword"), F.lit("pending").alias("status")).distinct()
    return coverage.coverage_counts(asked, table(spark, sf_dir, "documents")).select("id", "covered", "partial", "missing")


# --- small lists -------------------------------------------------------------------------------------------------------
@query("y07_enabled_folders", "SELECT c_custkey AS project_id, coalesce(string_agg(DISTINCT o_orderpriority, '|' ORDER BY o_orderpriority), '') AS folders FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_orderstatus = 'F' GROUP BY c_custkey")
def enabled_folders(spark, sf_dir):
    bridge = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(c("o_custkey").alias("project_id"), c("o_orderpriority").alias("folder"))
    found = lifecycle.folders_of(bridge, table(spark, sf_dir, "customer").select(c("c_custkey").alias("project_id")))
    return found.select("project_id", F.array_join("folders", "|").alias("folders"))


@query("y09_deleted_items", "SELECT (SELECT count(*) FROM part WHERE p_partkey NOT IN (SELECT s_suppkey * 3 FROM supplier)) AS kept, count(*) FILTER (s_suppkey * 3 IN (SELECT p_partkey FROM part)) AS found, count(*) FILTER (s_suppkey * 3 NOT IN (SELECT p_partkey FROM part)) AS unknown FROM supplier")
def deleted_items(spark, sf_dir):
    left, told = lifecycle.without_items(table(spark, sf_dir, "part").select(c("p_partkey").alias("id")), table(spark, sf_dir, "supplier").select((c("s_suppkey") * 3).alias("id")))
    return left.agg(F.count("*").alias("kept")).crossJoin(told.agg(F.count_if("found").alias("found"), F.count_if(~c("found")).alias("unknown")))  # one row each


@query("y10_folder_states", """SELECT coalesce(a.c_custkey, b.o_custkey) AS folder, CASE WHEN b.o_custkey IS NOT NULL THEN 'ready' ELSE c_mktsegment END AS status, CASE WHEN b.o_custkey IS NULL THEN 'e' END AS error, coalesce(b.n, a.c_nationkey) AS item_count
FROM customer a FULL JOIN (SELECT o_custkey, CASE WHEN o_custkey % 2 = 0 THEN count(*) END AS n FROM orders GROUP BY o_custkey) b ON a.c_custkey = b.o_custkey""")
def folder_states(spark, sf_dir):
    states = table(spark, sf_dir, "customer").select(c("c_custkey").alias("folder"), c("c_mktsegment").alias("status"), F.lit("e").alias("error"), c("c_nationkey").cast("long").alias("item_count"))
    patch = table(spark, sf_dir, "orders").groupBy(c("o_custkey").alias("folder")).agg(F.count("*").alias("k")).select("folder", F.lit("ready").alias("status"), F.lit(None).cast("string").alias("error"), F.when(c("folder") % 2 == 0, c("k")).alias("item_count"))
    return lifecycle.folder_states(states, patch)


@query("y27_confirmed_fields", f"{cte('section')} SELECT id, CASE key_points WHEN 0 THEN 'old' WHEN 1 THEN 'budget|old' WHEN 2 THEN 'budget|duration|old' ELSE 'old' END AS fields FROM section")
def confirmed_fields(spark, sf_dir):
    touched = F.when(c("key_points") == 1, F.array(F.lit("budget"), F.lit("colour"))).when(c("key_points") == 2, F.array(F.lit("duration"), F.lit("budget"), F.lit("old")))
    found = lifecycle.confirmed_fields(F.array(F.lit("old")), touched, ["budget", "duration", "place"])
    return given(spark, sf_dir, "section").select("id", F.array_join(found, "|").alias("fields"))


@query("m03_superseded", "SELECT p_partkey AS code, CASE WHEN o.l_partkey IS NOT NULL THEN 'superseded' ELSE p_brand END AS status, o.by_code FROM part LEFT JOIN (SELECT l_partkey, max(l_suppkey) AS by_code FROM lineitem WHERE l_returnflag = 'R' GROUP BY l_partkey) o ON l_partkey = p_partkey")
def superseded(spark, sf_dir):
    standards = table(spark, sf_dir, "part").select(c("p_partkey").alias("code"), c("p_brand").alias("status"), F.lit(None).cast(table(spark, sf_dir, "lineitem").schema["l_suppkey"].dataType).alias("by_code"))
    patch = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").groupBy(c("l_partkey").alias("code")).agg(F.max("l_suppkey").alias("by_code")).select("code", F.lit("superseded").alias("status"), "by_code")
    return state.upsert(standards, patch, "code", ["status", "by_code"])[0]


@query("k09_vector_blobs", "SELECT vec_id, CAST(4 + 4 * len(embedding) AS INT) AS bytes FROM embeddings")
def vector_blobs(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select("vec_id", F.octet_length(ordered.to_blob(c("embedding"))).alias("bytes"))


@query("g01_hybrid_indices", docs.SQL["g03_hybrid_items"].replace("SELECT query_id, id, score, CAST(rank AS INT) AS rank FROM (SELECT *", "SELECT query_id, id, CAST(rank AS INT) AS rank FROM (SELECT *"))
def hybrid_indices(spark, sf_dir):
    return docs.hybrid_items(spark, sf_dir).select("query_id", "id", "rank")


@query("g02_hybrid_texts", f"SELECT l.query_id, l.rank, md5(text) AS digest FROM ({docs.SQL['l02_lexical_items']}) l JOIN documents ON id = doc_id WHERE l.rank <= 3")
def hybrid_texts(spark, sf_dir):
    best = retrieval.hybrid(retrieval.lexical_items(docs._items(spark, sf_dir), docs._queries(spark, sf_dir).where("folder IS NOT NULL")), None, 3)
    # three rows a passage go to the texts
    return F.broadcast(best).join(table(spark, sf_dir, "documents").select(c("doc_id").alias("id"), "text"), "id").select("query_id", "rank", F.md5("text").alias("digest"))


_TAIL = """content || CASE CAST(length(title) + kind AS INT) % 6 WHEN 0 THEN chr(10) || '| a |' WHEN 1 THEN chr(10) || '| a | b |' || chr(10) || '|---|---|' WHEN 2 THEN chr(10) || '| a | b |' || chr(10) || '|---|---|' || chr(10) || '| 1 | 2 |  ' WHEN 3 THEN chr(10) || '--- | ---' || chr(10) || '| 1 | 2 |' WHEN 4 THEN chr(10) || '|---|' ELSE '' END"""


@query("i72_trailing_table", f"{cte('chapter')} SELECT id, message FROM (SELECT id, {trailing_sql('t')} AS message FROM (SELECT id, {_TAIL} AS t FROM chapter) x) y WHERE message IS NOT NULL")
def trailing_table(spark, sf_dir):
    k = (F.length("title") + c("kind")) % 6
    forms = ["\n| a |", "\n| a | b |\n|---|---|", "\n| a | b |\n|---|---|\n| 1 | 2 |  ", "\n--- | ---\n| 1 | 2 |", "\n|---|"]
    tail = F.lit("")
    for i, form in enumerate(forms):
        tail = F.when(k == i, form).otherwise(tail)
    return given(spark, sf_dir, "chapter").select("id", rules.trailing_table(F.concat("content", tail)).alias("message")).where("message IS NOT NULL")
