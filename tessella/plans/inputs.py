"""Stand-ins for the entities of the application, made from the driver's tables. Every statement is valid both in
Spark SQL and in DuckDB, so that queries and their oracles start from the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

_TITLES = ["工程概况", "质量目标", "施工方案", "项目特点", "组织机构", "服务范围", "安全目标措施", "设备安装调试", "项目总结"]
_CASE = "CASE CAST({k} % 9 AS INT) " + " ".join(f"WHEN {i} THEN '{t}'" for i, t in enumerate(_TITLES)) + " END"

INPUTS = {
    # sections with a title: a part each
    "section": f"""SELECT p_partkey AS id, {_CASE.format(k="p_partkey")} AS title, p_name AS name, p_brand AS folder, p_type AS kind,
        p_size * 50 AS target_words, CAST(p_size % 7 AS INT) AS key_points, p_retailprice / 400 AS score, p_size % 11 = 0 AS followup FROM part""",
    # requirements: a part each
    "requirement": """SELECT CAST(p_partkey AS STRING) AS id, p_name AS title, p_brand || '，' || lower(p_type) || '/' || p_name AS keyword,
        CASE WHEN p_size % 3 = 0 THEN p_name || '|' || p_type ELSE p_name END AS elements, CAST(p_size AS DOUBLE) AS score,
        CASE WHEN p_size > 40 THEN 1 ELSE 0 END AS is_risk,
        CASE WHEN p_size % 10 = 0 THEN 'ignored' WHEN p_size % 2 = 0 THEN 'confirmed' ELSE 'pending' END AS status FROM part""",
    # chapters: a document each, with passages that rules look for
    "chapter": f"""SELECT *, CASE kind WHEN 7 THEN '# 概述' || chr(10) WHEN 8 THEN title || '：' || chr(10) || chr(10) ELSE '' END || text || CASE kind WHEN 0 THEN chr(10) || chr(10) || '工期为90天，XXX公司负责'
        WHEN 1 THEN chr(10) || '综上所述，施工采用全方位闭环管理，我们将赋能。' WHEN 2 THEN '[GANTT_DATA:{{"tasks":[1' WHEN 3 THEN '本公司联系人：张三' WHEN 4 THEN '  x　y）'
        WHEN 5 THEN chr(10) || '| a | b |' || chr(10) || '|---|---|' || chr(10) || '| 1 |' WHEN 6 THEN chr(10) || '# 服务范围' || chr(10) || 'end，'
        WHEN 9 THEN chr(10) || chr(10) || '本工程采用甲，一' || chr(10) || chr(10) || '本工程采用甲，二' || chr(10) || chr(10) || '本工程采用甲，三'
        WHEN 10 THEN chr(10) || chr(10) || '针对现场条件，一' || chr(10) || chr(10) || '甲乙丙丁' || chr(10) || chr(10) || '针对现场条件，二' || chr(10) || chr(10) || '戊' || chr(10) || chr(10) || '针对现场条件，三'
        WHEN 11 THEN chr(10) || '本节论述施工方案与质量及进度的关系；' || chr(10) || '质量' ELSE '' END AS content FROM
        (SELECT doc_id AS id, {_CASE.format(k="doc_id")} AS title, 40 AS duration_days, 300 AS target_words, CAST(doc_id % 12 AS INT) AS kind, text FROM documents) x""",
    # lines of documents
    "chunk": "SELECT doc_id AS id, source AS folder, text, n_chars FROM documents",
    # standards: a part each, some under a code that needs normalising
    "standard": """SELECT 'GB/T ' || CAST(50000 + p_partkey AS STRING) || CASE WHEN p_size % 2 = 0 THEN '—2010' ELSE '' END AS raw_code, p_name AS title,
        p_brand AS domain, p_type AS category,
        CASE WHEN p_size < 10 THEN 'withdrawn' WHEN p_size < 20 THEN 'superseded' WHEN p_size < 30 THEN 'draft' ELSE 'active' END AS status FROM part""",
    # a tree of three levels: regions, nations, customers
    "node": """SELECT 'R' || CAST(r_regionkey AS STRING) AS id, CAST(NULL AS STRING) AS parent_id, 5 - r_regionkey AS sort_order, r_name AS title FROM region
        UNION ALL SELECT 'N' || CAST(n_nationkey AS STRING), 'R' || CAST(n_regionkey AS STRING), CAST(n_nationkey % 3 AS INT), n_name FROM nation
        UNION ALL SELECT 'C' || CAST(c_custkey AS STRING), 'N' || CAST(c_nationkey AS STRING), CAST(c_custkey % 7 AS INT), c_name FROM customer""",
    # progress events
    "event": "SELECT event_id, ts, user_id AS project, event_type AS stage, value, props FROM events",
    # requirements with notes in the application's language
    "note": """SELECT o_orderkey AS id, '第' || CAST(o_orderkey % 12 + 1 AS STRING) || '天 工期' || CAST(o_orderkey % 400 AS STRING) || '个日历天，合同' || CAST(o_orderkey % 90 + 10 AS STRING)
        || '.5万元，押金' || CAST(o_orderkey % 9000 + 1000 AS STRING) || '元；执行GB/T ' || CAST(50000 + o_orderkey % 300 AS STRING) || '-2006、gb/t' || CAST(50000 + o_orderkey % 300 AS STRING)
        || '、DL ' || CAST(o_orderkey % 700 AS STRING) || '.' AS note, o_orderpriority AS title, o_totalprice AS amount FROM orders""",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def given(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A stand-in as a DataFrame."""
    statement = INPUTS[name].replace("{", "{{").replace("}", "}}")
    used = {t: table(spark, sf_dir, t) for t in TABLES if f"FROM {t}" in statement}
    for t in used:
        statement = statement.replace(f"FROM {t}", f"FROM {{{t}}}")
    return spark.sql(statement, **used)


def cte(*names: str) -> str:
    """The stand-ins as the beginning of a DuckDB statement."""
    return "WITH " + ", ".join(f"{n} AS ({INPUTS[n]})" for n in names)
