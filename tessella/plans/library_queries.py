"""Queries over the library's sources, sinks and small scans, each with SQL written on its own."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import ordered, rules, state
from ..operators.stored import new_path
from ..sources import sinks
from ..sources import text as sources
from .inputs import cte, given, table

QUERIES, SQL = {}, {}
c = F.col


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


# --- folders of text ---------------------------------------------------------------------------------------------------
@query("a02_keyword_lines", "SELECT doc_id AS id, 'a、b、' || source AS keywords, md5(regexp_replace(text, '^\\s+|\\s+$', '', 'g')) AS body FROM documents")
def keyword_lines(spark, sf_dir):
    """Each document with two lines of keywords before it."""
    text = F.concat(F.lit("关键词：a，b、 a\n## 适用章节: "), "source", F.lit("；\n"), "text")
    return table(spark, sf_dir, "documents").select(c("doc_id").alias("id"), sources.split_meta(text).alias("m")).select("id", "m.keywords", F.md5("m.body").alias("body"))


_FILE = "SELECT doc_id, source, regexp_replace(text, '\\n', chr(10) || ' ' || chr(10), 'g') AS text FROM documents"


@query("a01_folder_chunks", f"""WITH f AS ({_FILE}), p AS (SELECT source AS folder, doc_id, unnest(range(len(ps))) AS pos, unnest(ps) AS p FROM (SELECT *, regexp_split_to_array(text, '\\n\\s*\\n') AS ps FROM f) x)
SELECT folder, CAST(doc_id AS VARCHAR) AS source, CAST(pos AS INT) AS pos, '' AS keywords, md5(regexp_replace(p, '^\\s+|\\s+$', '', 'g')) AS text FROM p WHERE length(regexp_replace(p, '^\\s+|\\s+$', '', 'g')) >= 20""")
def folder_chunks(spark, sf_dir):
    """Documents as files whose lines are paragraphs."""
    files = table(spark, sf_dir, "documents").select(c("source").alias("folder"), c("doc_id").cast("string").alias("source"), F.regexp_replace("text", "\n", "\n \n").alias("text"))
    return sources.chunks(files).select("folder", "source", "pos", "keywords", F.md5("text").alias("text"))


@query("a03_folder_texts", "SELECT 'b' || CAST(doc_id // 50 AS VARCHAR) AS name, md5(string_agg(text, chr(10) ORDER BY doc_id)) AS digest FROM documents GROUP BY doc_id // 50")
def folder_texts(spark, sf_dir):
    """All documents as files, each of a block of fifty, read whole."""
    block = F.concat(F.lit("b"), F.floor(c("doc_id") / 50).cast("string")).alias("name")
    blocks = table(spark, sf_dir, "documents").groupBy(block).agg(F.sort_array(F.collect_list(F.struct("doc_id", "text"))).alias("xs"))
    folder = new_path(spark, "texts")
    blocks.select("name", F.array_join(c("xs")["text"], "\n").alias("text")).write.partitionBy("name").option("lineSep", "\x00").text(folder)
    read = sources.text_files(spark, folder)
    return read.select(F.regexp_extract("source", "name=([^/]+)/", 1).alias("name"), F.md5(F.regexp_replace("text", "\x00$", "")).alias("digest"))


@query("a17_templates", "SELECT 't' || CAST(n_nationkey AS VARCHAR) AS source, n_name AS name, CAST(n_regionkey AS VARCHAR) AS kind, 'body ' || n_name || chr(10) || '# not: meta?' AS text FROM nation WHERE FALSE UNION ALL SELECT 't' || CAST(n_nationkey AS VARCHAR), n_name, CAST(n_regionkey AS VARCHAR), 'body ' || n_name FROM nation")
def templates(spark, sf_dir):
    text = F.concat(F.lit("# name: "), "n_name", F.lit("\n# kind: "), c("n_regionkey").cast("string"), F.lit("\n\nbody "), "n_name", F.lit("\n"))
    found = sources.templates(table(spark, sf_dir, "nation").select(F.concat(F.lit("t"), c("n_nationkey").cast("string")).alias("source"), text.alias("text")))
    return found.select("source", c("meta")["name"].alias("name"), c("meta")["kind"].alias("kind"), "text")


# --- uploads -----------------------------------------------------------------------------------------------------------
@query("a13_uploaded_table", "SELECT CAST(p_partkey AS VARCHAR) AS code, p_name || ', \"' || p_type || '\"' AS title, CASE WHEN p_size % 3 = 0 THEN '' ELSE p_brand END AS category FROM part")
def uploaded_table(spark, sf_dir):
    """Parts as a CSV file with quotes, commas and empty cells, read again."""
    path = f"{new_path(spark, 'upload')}.csv"
    rows = table(spark, sf_dir, "part").select(c("p_partkey").alias("code"), F.concat("p_name", F.lit(', "'), "p_type", F.lit('"')).alias("title"), F.when(c("p_size") % 3 != 0, c("p_brand")).alias("category"))
    rows.write.option("header", True).option("escape", '"').csv(path)
    found = sources.uploaded_table(spark, path)
    return found.select("code", "title", "category")


@query("a14_imported_standards", """SELECT CASE WHEN p_size % 5 = 0 THEN '' ELSE 'GB' || CAST(50000 + p_partkey AS VARCHAR) END AS code, p_name AS title, CASE WHEN p_size % 3 = 0 THEN '国标' ELSE p_brand END AS category, 'active' AS status, p_type AS domains, p_size % 5 = 0 AS faulty FROM part""")
def imported_standards(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    rows = p.select(F.when(c("p_size") % 5 == 0, F.lit(" ")).otherwise(F.concat(F.lit("gb "), (c("p_partkey") + 50000).cast("string"), F.lit("-2010"))).alias("编号"), c("p_name").alias("标题"), F.when(c("p_size") % 3 != 0, c("p_brand")).otherwise(" ").alias("类别"), F.lit("").alias("状态"), F.concat("p_type", F.lit("；；"), "p_type").alias("适用领域"))
    return sources.import_standards(rows).select("code", "title", "category", "status", F.array_join("domains", "|").alias("domains"), F.col("error").isNotNull().alias("faulty"))


# --- sinks -------------------------------------------------------------------------------------------------------------
@query("b05_markdown_reports", """SELECT l_orderkey AS id, md5(string_agg('- ' || CASE l_returnflag WHEN 'A' THEN '✗' WHEN 'N' THEN '!' ELSE '·' END || ' [' || l_linestatus || '] m' || CAST(l_partkey AS VARCHAR), chr(10)
  ORDER BY CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END, 'k' || CAST(l_linenumber AS VARCHAR), 'm' || CAST(l_partkey AS VARCHAR), l_linestatus)) AS report FROM lineitem GROUP BY l_orderkey""")
def markdown_reports(spark, sf_dir):
    severity = F.when(c("l_returnflag") == "A", "block").when(c("l_returnflag") == "N", "warn").otherwise("info")
    found = table(spark, sf_dir, "lineitem").select(c("l_orderkey").alias("id"), severity.alias("severity"), c("l_linestatus").alias("category"), F.concat(F.lit("k"), c("l_linenumber").cast("string")).alias("check_id"), F.concat(F.lit("m"), c("l_partkey").cast("string")).alias("message"))
    return sinks.markdown_report(found).select("id", F.md5("report").alias("report"))


@query("b03_exports", "SELECT doc_id, md5(text) AS digest, (SELECT count(*) FROM nation) AS n FROM documents")
def exports(spark, sf_dir):
    """Two datasets as JSON lines, read again."""
    folder = new_path(spark, "export")
    sinks.export({"documents": table(spark, sf_dir, "documents").select("doc_id", "text"), "nations": table(spark, sf_dir, "nation")}, folder)
    n = spark.read.json(f"{folder}/nations").agg(F.count("*").alias("n"))
    return spark.read.schema("doc_id long, text string").json(f"{folder}/documents").select("doc_id", F.md5("text").alias("digest")).crossJoin(F.broadcast(n))  # one row


@query("a23_appended_files", "SELECT DISTINCT regexp_replace(text, '\\s*\\n\\s*', ' ', 'g') AS value FROM documents WHERE source <> (SELECT min(source) FROM documents) AND regexp_replace(text, '\\s*\\n\\s*', ' ', 'g') NOT IN (SELECT regexp_replace(text, '\\s*\\n\\s*', ' ', 'g') FROM documents WHERE source = (SELECT min(source) FROM documents))")
def appended_files(spark, sf_dir):
    """Documents of other sources than the first, appended twice: what that one does not hold, once."""
    docs = table(spark, sf_dir, "documents")
    first = docs.agg(F.min("source").alias("first"))
    marked = docs.crossJoin(F.broadcast(first))  # one row
    path = new_path(spark, "appended")
    known = marked.where("source = first").select("text")
    sinks.append_files(marked.where("source <> first").select("text"), known, path)
    added = spark.read.text(path)
    sinks.append_files(marked.where("source <> first").select("text"), known.union(added.select("value")), path)
    return spark.read.text(path)


# --- states and scans --------------------------------------------------------------------------------------------------
@query("m05_active_standards", "SELECT p_partkey AS code, CASE WHEN p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'A') THEN 'active' ELSE 'withdrawn' END AS status FROM part")
def active_standards(spark, sf_dir):
    standards = table(spark, sf_dir, "part").select(c("p_partkey").alias("code"), F.lit("withdrawn").alias("status"))
    patch = table(spark, sf_dir, "lineitem").where("l_returnflag = 'A'").select(c("l_partkey").alias("code")).distinct().join(standards, "code", "left_semi").withColumn("status", F.lit("active"))
    return state.upsert(standards, patch, "code", ["status"])[0]



def _charts(spark, sf_dir):
    tail = F.when(c("doc_id") % 3 == 0, '[GANTT_DATA:{"t":[1,2]}]').when(c("doc_id") % 3 == 1, "[ORG_DATA: {bad}]").otherwise("[FLOW_DATA:[1")
    return ordered.chart_scan(table(spark, sf_dir, "documents").select(c("doc_id").alias("id"), F.concat("text", tail).alias("content")))


@query("q06_broken_charts", "SELECT doc_id AS id, 'ORG_DATA' AS kind FROM documents WHERE doc_id % 3 = 1")
def broken_charts(spark, sf_dir):
    return _charts(spark, sf_dir).where("NOT valid").select("id", "kind")


@query("y38_chart_previews", """SELECT doc_id AS id, 'GANTT_DATA' AS kind, '{"t":[1,2]}' AS json FROM documents WHERE doc_id % 3 = 0""")
def chart_previews(spark, sf_dir):
    return _charts(spark, sf_dir).where("valid").select("id", "kind", "json")


@query("y40_cut_arrays", """SELECT event_id, '[{"k": ' || CAST(json_extract_string(props, '$.k') AS VARCHAR) || '}, {"k": ' || CAST(json_extract_string(props, '$.k') AS VARCHAR) || '}]' AS json FROM events""")
def cut_arrays(spark, sf_dir):
    """Arrays that end within their third element."""
    cut = F.concat(F.lit("["), "props", F.lit(", "), "props", F.lit(', {"k": "unfin'))
    return table(spark, sf_dir, "events").select("event_id", ordered.repair_json(cut).alias("json"))


@query("q16_codes_by_status", f"""{cte("note")}, n AS (SELECT DISTINCT id, 'GBT' || CAST(50000 + id % 300 AS VARCHAR) AS core FROM note UNION SELECT DISTINCT id, 'DL' || CAST(id % 700 AS VARCHAR) || '.' FROM note WHERE id % 700 >= 10),
r AS (SELECT 'GBT' || CAST(50000 + p_partkey AS VARCHAR) AS core, CASE WHEN p_size < 10 THEN 'withdrawn' WHEN p_size < 20 THEN 'superseded' WHEN p_size < 30 THEN 'draft' ELSE 'active' END AS status FROM part)
SELECT coalesce(status, 'unknown') AS status, count(*) AS n FROM n LEFT JOIN r USING (core) WHERE coalesce(status, 'unknown') IN ('withdrawn', 'superseded', 'unknown') GROUP BY 1""")
def codes_by_status(spark, sf_dir):
    registry = given(spark, sf_dir, "standard").select(tx.standard_core(c("raw_code")).alias("core"), "status")
    found = rules.currency(given(spark, sf_dir, "note").select("id", c("note").alias("content")), registry)
    return found.groupBy("status").agg(F.count("*").alias("n"))
