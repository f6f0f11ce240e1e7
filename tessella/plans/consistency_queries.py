"""Queries over checks of projects, each with SQL written on its own."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import consistency, notices, ordered, rules
from . import relational_queries as relational
from . import rule_queries
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


# projects: an order each; its text says days, staff, money and persons by the numbers of the order
_PROJECTS = """p AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE 30 + o_orderkey % 50 END AS days, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE 100000 + (o_orderkey % 90) * 10000 END AS budget,
  o_orderkey % 170 AS d1, o_orderkey % 60 AS d2, o_orderkey % 300 AS n1, o_orderkey % 40 + 1 AS staff, o_orderkey % 3 = 0 AS near, (o_orderkey % 2000 + 1) AS wan, o_orderkey % 5 AS k FROM orders)"""
_TEXT = """'计划D+' || CAST(d1 AS STRING) || '、D + ' || CAST(d2 AS STRING) || '验收，工期' || CAST(n1 AS STRING) || '天；' || CASE WHEN near THEN '项目组' ELSE '远处的项目组之外另有许多许多许多许多许多许多许多许多' END || '配备' || CAST(staff AS STRING) || '人，现场' || '另外再说一些与此完全没有关系的很长很长的话语' || CAST(staff + 1 AS STRING) || '位，合计'
  || CAST(wan AS STRING) || '.5万元。' || CASE k WHEN 1 THEN chr(10) || '团队成员简历' || chr(10) || '张甲乙，担任经理' || chr(10) || '组织架构' || chr(10) || '李丙丁负责质量' WHEN 2 THEN '【待补充' WHEN 3 THEN '我公司一定能中标' ELSE '' END"""


def _projects(spark, sf_dir):
    made = spark.sql(f"WITH {_PROJECTS.replace('FROM orders', 'FROM {orders}')} SELECT id AS project_id, days AS duration_days, CAST(budget AS DOUBLE) AS budget, {_TEXT} AS text FROM p", orders=table(spark, sf_dir, "orders"))
    return made


_COMMAS = "CASE WHEN {x} >= 1000000 THEN CAST(CAST({x} AS BIGINT) // 1000000 AS VARCHAR) || ',' || lpad(CAST(CAST({x} AS BIGINT) // 1000 % 1000 AS VARCHAR), 3, '0') || ',' || lpad(CAST(CAST({x} AS BIGINT) % 1000 AS VARCHAR), 3, '0') WHEN {x} >= 1000 THEN CAST(CAST({x} AS BIGINT) // 1000 AS VARCHAR) || ',' || lpad(CAST(CAST({x} AS BIGINT) % 1000 AS VARCHAR), 3, '0') ELSE CAST(CAST({x} AS BIGINT) AS VARCHAR) END"
_COST = "CAST(staff * 750 * days AS BIGINT)"
_LEVELS = f"""{_PROJECTS}, d AS (SELECT DISTINCT id, days, unnest([d1, d2]) AS d FROM p WHERE days IS NOT NULL),
f AS (SELECT id, 'fail' AS level, 'D+' || CAST(d AS VARCHAR) || ' 明显超出总工期 ' || CAST(days AS VARCHAR) || ' 天（超 ' || CAST(d - days AS VARCHAR) || ' 天）' AS message FROM d WHERE d > 2 * days
UNION ALL SELECT id, 'warn', 'D+' || CAST(d AS VARCHAR) || ' 超出总工期 ' || CAST(days AS VARCHAR) || ' 天，若属评审配合节点请人工复核' FROM d WHERE d > days AND d <= 2 * days
UNION ALL SELECT id, 'pass', 'D+N 节点均在 ' || CAST(days AS VARCHAR) || ' 天工期内' FROM p WHERE greatest(d1, d2) <= days
UNION ALL SELECT id, 'warn', '正文工期数字 ' || CAST(n1 AS VARCHAR) || ' 天与全局 ' || CAST(days AS VARCHAR) || ' 天偏差过大' FROM p WHERE n1 > 2 * days
UNION ALL SELECT id, CASE WHEN {_COST} > budget * 1.5 THEN 'fail' ELSE 'pass' END, '团队成本估算 ' || {_COMMAS.format(x=_COST)} || ' 元（' || CAST(staff AS VARCHAR) || ' 人×50%×' || CAST(days AS VARCHAR) || ' 天×1500 元/人·天），合同预算 ' || {_COMMAS.format(x="budget")} || ' 元' FROM p WHERE near AND days IS NOT NULL AND budget IS NOT NULL
UNION ALL SELECT id, 'fail', '正文金额 [' || CAST(wan * 10000 + 5000 AS VARCHAR) || '.0] 元大幅超出预算（10 倍以上）' FROM p WHERE wan * 10000 + 5000 > budget * 10
UNION ALL SELECT id, 'warn', '简历章节有、组织架构未出现的人名：张甲乙' FROM p WHERE k = 1)"""


@query("d28_project_consistency", f"WITH {_LEVELS} SELECT id AS project_id, level, message FROM f")
def cross_consistency(spark, sf_dir):
    return consistency.cross_consistency(_projects(spark, sf_dir))


@query("q33_cross_findings", f"WITH {_LEVELS} SELECT id AS project_id, 'project_cross_consistency' AS check_id, 'fact_consistency' AS category, CASE level WHEN 'fail' THEN 'block' ELSE 'warn' END AS severity, message FROM f WHERE level <> 'pass'")
def cross_findings(spark, sf_dir):
    return consistency.cross_findings(_projects(spark, sf_dir))


# grounds: line items of an order
_ITEMS = "i AS (SELECT l_orderkey AS project_id, l_linenumber AS seq, CASE WHEN l_partkey % 6 = 0 THEN NULL WHEN l_partkey % 6 = 1 THEN ' 暗标 ' ELSE l_linestatus END AS label, CASE WHEN l_partkey % 10 = 0 THEN '未提供' || repeat('长', CAST(l_quantity AS INT) * 2) ELSE l_comment_ END AS description, l_partkey FROM (SELECT *, l_returnflag || ' flag' AS l_comment_ FROM lineitem) x)"


@query("d29_grounds_for_exclusion", f"""WITH {_PROJECTS}, {_ITEMS}, t AS (SELECT i.*, coalesce(trim(label), '废标项') AS name, trim(coalesce(description, '')) AS said, l_partkey % 6 = 1 OR l_partkey % 10 = 0 AS technical FROM i),
n AS (SELECT *, bool_or(technical) OVER (PARTITION BY project_id) AS any_, row_number() OVER (PARTITION BY project_id ORDER BY seq, name, said) AS nth FROM t),
r AS (SELECT n.*, CASE k WHEN 2 THEN '疑似模板/占位残留，对照废标条款' WHEN 3 THEN '疑似承诺性身份表述，暗标/废标风险' END AS risk, CASE WHEN length(said) > 80 THEN substring(said, 1, 77) || '…' ELSE said END AS short FROM n LEFT JOIN p ON p.id = n.project_id WHERE technical OR NOT any_ AND nth <= 8)
SELECT project_id, seq, 'project_disqualification' AS check_id, 'disqualification_risk' AS category, CASE WHEN technical AND risk IS NOT NULL THEN 'block' WHEN technical THEN 'warn' ELSE 'info' END AS severity,
  CASE WHEN technical AND risk IS NOT NULL THEN '废标条款「' || name || '」存在正文风险：' || risk ELSE '请人工核对废标条款#' || CAST(seq AS VARCHAR) || '「' || name || '」：' || short END AS message, CASE WHEN technical AND risk IS NOT NULL THEN short ELSE said END AS evidence FROM r""")
def disqualification(spark, sf_dir):
    items = spark.sql(f"WITH {_ITEMS.replace('FROM lineitem', 'FROM {items}')} SELECT project_id, seq, label, description FROM i", items=table(spark, sf_dir, "lineitem"))
    return consistency.disqualification(_projects(spark, sf_dir), items)


@query("q34_disqualification_counts", f"""WITH {_PROJECTS}, {_ITEMS}, t AS (SELECT project_id, l_partkey % 6 = 1 OR l_partkey % 10 = 0 AS technical FROM i), n AS (SELECT project_id, count(*) FILTER (technical) AS m, count(*) AS n FROM t GROUP BY 1)
SELECT severity, CAST(sum(x) AS BIGINT) AS n FROM (SELECT CASE WHEN m = 0 THEN 'info' WHEN k IN (2, 3) THEN 'block' ELSE 'warn' END AS severity, CASE WHEN m = 0 THEN least(n, 8) ELSE m END AS x FROM n LEFT JOIN p ON p.id = project_id) y GROUP BY severity""")
def disqualification_counts(spark, sf_dir):
    return disqualification(spark, sf_dir).groupBy("severity").agg(F.count("*").alias("n"))


@query("d06_matrix_issues", f"""{relational._MATRIX}, lack AS (SELECT r.id, title, keyword, is_risk_name, list_filter(string_split(elements, '|'), lambda e: NOT contains(replace(coalesce(joined, ''), ' ', ''), replace(e, ' ', ''))) AS missing, coalesce(n_matched, 0) AS n_matched FROM (SELECT *, CASE WHEN is_risk = 1 THEN '刚性风险项' ELSE '评分项' END AS is_risk_name FROM requirement) r LEFT JOIN agg USING (id) WHERE r.status <> 'ignored'),
bound AS (SELECT DISTINCT l.id AS leaf_id, l.title AS leaf_title, trim(coalesce(l.content, '')) <> '' AS written, k.* FROM leaf l, LATERAL (SELECT unnest(l.ids) AS rid) u, lack k WHERE u.rid = k.id)
SELECT leaf_id, id AS requirement_id, is_risk_name || '「' || title || '」评分覆盖不足：缺少必备要素 ' || array_to_string(missing, ', ') AS issue FROM bound WHERE written AND len(missing) > 0
UNION ALL SELECT DISTINCT leaf_id, NULL, '评分覆盖：章节「' || leaf_title || '」正文为空，无法覆盖已绑定评分项' FROM bound WHERE NOT written""")
def matrix_issues(spark, sf_dir):
    """In these tables a written leaf whose requirement matches nowhere lacks its elements, too."""
    return consistency.matrix_issues(given(spark, sf_dir, "requirement"), relational._leaves(spark, sf_dir))


# items of a supplier's documents: line items, pages by month
_PAGED = "i AS (SELECT l_suppkey AS doc, CASE WHEN l_suppkey % 4 = 0 THEN 1 ELSE CAST(l_orderkey % 50 AS INT) + 1 END AS page, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey % 50, l_orderkey, l_linenumber, l_partkey) AS pos, l_returnflag || repeat('x', CAST(l_quantity AS INT) * 20) || ' ' AS text FROM lineitem)"


@query("f17_extraction_chunks", f"""WITH RECURSIVE {_PAGED}, s AS (SELECT *, CASE WHEN min(page) OVER (PARTITION BY doc) = max(page) OVER (PARTITION BY doc) THEN 0 ELSE (page - 1) // 15 END AS step, length(trim(text)) AS n FROM i),
d AS (SELECT *, dense_rank() OVER (PARTITION BY doc ORDER BY step) - 1 AS part, row_number() OVER (PARTITION BY doc, step ORDER BY pos) AS r FROM s),
w AS (SELECT doc, part, r, pos, 0 AS chunk, n AS held FROM d WHERE r = 1 UNION ALL SELECT d.doc, d.part, d.r, d.pos, CASE WHEN w.held > 0 AND w.held + d.n > 18000 THEN w.chunk + 1 ELSE w.chunk END, CASE WHEN w.held > 0 AND w.held + d.n > 18000 THEN d.n ELSE w.held + d.n END FROM w JOIN d ON d.doc = w.doc AND d.part = w.part AND d.r = w.r + 1)
SELECT doc, pos, CAST(part AS INT) AS part, CAST(chunk AS INT) AS chunk FROM w""")
def extraction_chunks(spark, sf_dir):
    items = spark.sql(f"WITH {_PAGED.replace('FROM lineitem', 'FROM {items}')} SELECT * FROM i", items=table(spark, sf_dir, "lineitem"))
    return ordered.extraction_chunks(items, "doc")


# --- notices -----------------------------------------------------------------------------------------------------------
# projects: customers; their notices say other values for some fields, some of which were confirmed by hand
_NOTICES = """n AS (SELECT c_custkey AS id, c_name AS name, CASE WHEN c_custkey % 2 = 0 THEN 'L' || CAST(c_nationkey AS STRING) END AS location, CASE WHEN c_custkey % 3 = 0 THEN 30 END AS duration_days, CASE WHEN c_custkey % 4 = 0 THEN c_custkey * 1000.5 END AS budget, CASE WHEN c_custkey % 5 = 0 THEN 50 END AS pages,
  CASE WHEN c_custkey % 7 = 0 THEN '' ELSE 'new ' || c_name END AS n_name, 'M' || CAST(c_custkey AS STRING) AS n_location, CASE c_custkey % 3 WHEN 0 THEN '约定' WHEN 1 THEN '工期' || CAST(c_custkey % 400 AS STRING) || '个日历天' END AS n_duration,
  CASE c_custkey % 3 WHEN 0 THEN 'x' WHEN 1 THEN CAST(c_custkey * 10 AS STRING) END AS n_budget, CASE c_custkey % 4 WHEN 1 THEN '5' WHEN 2 THEN '99' WHEN 3 THEN '9999' END AS n_pages, c_custkey % 6 = 0 AS kept FROM customer)"""


def _tendered(spark, sf_dir):
    n = spark.sql(f"WITH {_NOTICES.replace('FROM customer', 'FROM {customer}')} SELECT * FROM n", customer=table(spark, sf_dir, "customer"))
    said = {"project_name": "n_name", "location": "n_location", "duration_text": "n_duration", "budget_yuan": "n_budget", "target_pages": "n_pages"}
    notice = F.create_map(*(x for k, v in said.items() for x in (F.lit(k), c(v))))
    none = [F.lit(None).cast("string").alias(f) for f in ("voltage_level", "capacity", "project_type", "contract_mode", "engineering_domain", "extra_notes")]
    confirmed = F.when(c("kept"), F.array(F.lit("name"), F.lit("duration_days"), F.lit("target_pages")))
    return n.select("id", "name", "location", "duration_days", c("budget").cast("double").alias("budget_yuan"), c("pages").alias("target_pages"), notice.alias("notice"), confirmed.alias("confirmed"), *none)


@query("m09_applied_notices", f"""WITH {_NOTICES} SELECT id, CASE WHEN kept OR n_name = '' THEN name ELSE n_name END AS name, n_location AS location, CASE WHEN NOT kept AND id % 3 = 1 THEN CAST(id % 400 AS INT) ELSE duration_days END AS duration_days,
CASE WHEN id % 3 = 1 THEN CAST(id * 10 AS DOUBLE) ELSE CAST(budget AS DOUBLE) END AS budget_yuan, CASE WHEN kept THEN pages ELSE coalesce(CASE id % 4 WHEN 1 THEN 10 WHEN 2 THEN 99 WHEN 3 THEN 1200 END, pages) END AS target_pages FROM n""")
def applied_notices(spark, sf_dir):
    return notices.applied(_tendered(spark, sf_dir)).select("id", "name", "location", "duration_days", "budget_yuan", "target_pages")


@query("m10_synced_notices", f"""WITH {_NOTICES} SELECT id, name AS project_name, location, '电力工程' AS bid_domain, CASE WHEN duration_days IS NOT NULL THEN CAST(duration_days AS VARCHAR) || '个日历天' ELSE n_duration END AS duration_text, coalesce(CAST(pages AS VARCHAR), n_pages) AS target_pages,
CASE WHEN budget IS NULL THEN n_budget ELSE regexp_replace(regexp_replace(printf('%.4f', CAST(budget AS DOUBLE)), '0+$', ''), '\\.$', '') END AS budget_yuan, CASE WHEN budget IS NOT NULL THEN regexp_replace(regexp_replace(printf('%.4f', CAST(budget AS DOUBLE) / 10000), '0+$', ''), '\\.$', '') END AS budget_wan, 19 AS n FROM n""")
def synced_notices(spark, sf_dir):
    n = notices.synced(_tendered(spark, sf_dir))
    return n.select("id", *(c("notice")[k].alias(k) for k in ("project_name", "location", "bid_domain", "duration_text", "target_pages", "budget_yuan", "budget_wan")), F.size("notice").alias("n"))


@query("y28_notices", f"WITH {_NOTICES} SELECT id, n_name AS project_name, 19 AS n, CAST((n_duration IS NOT NULL) AS INT) + CAST((n_budget IS NOT NULL) AS INT) + CAST((n_pages IS NOT NULL) AS INT) + 2 AS said FROM n")
def normal_notices(spark, sf_dir):
    made = _tendered(spark, sf_dir).select("id", notices.notice(F.map_concat("notice", F.create_map(F.lit("other"), F.lit("x")))).alias("n"))
    return made.select("id", c("n")["project_name"].alias("project_name"), F.size("n").alias("n"), F.size(F.filter(F.map_values("n"), lambda v: v.isNotNull())).alias("said"))


# grounds: an order's line items as JSON objects
_RAW = "r AS (SELECT l_orderkey AS id, l_linenumber AS n, l_partkey AS p, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS k FROM lineitem)"


@query("k11_grounds", f"""WITH {_RAW}, g AS (SELECT id, CASE WHEN p % 4 = 0 THEN k ELSE 10 - n END AS seq, k, CASE p % 3 WHEN 0 THEN '废标项' ELSE 'l' || CAST(p AS VARCHAR) END AS label, CASE p % 5 WHEN 1 THEN 's' ELSE 'd' END || CAST(p AS VARCHAR) AS description, CASE WHEN p % 5 IN (1, 2) THEN 's' ELSE 'd' END || CAST(p AS VARCHAR) AS source FROM r WHERE p % 5 > 0)
SELECT id, string_agg(CAST(seq AS VARCHAR) || ':' || label || ':' || description || ':' || source, '|' ORDER BY seq, k) AS grounds FROM g GROUP BY id UNION ALL SELECT id, '' FROM r GROUP BY id HAVING max(p % 5) = 0""")
def normal_grounds(spark, sf_dir):
    r = spark.sql(f"WITH {_RAW.replace('FROM lineitem', 'FROM {items}')} SELECT * FROM r", items=table(spark, sf_dir, "lineitem"))
    p, key = c("p").cast("string"), c("p") % 5
    item = F.struct(
        F.when(c("p") % 4 == 0, F.lit("no")).otherwise((10 - c("n")).cast("string")).alias("seq"), F.when(c("p") % 3 == 1, F.concat(F.lit(" l"), p)).alias("item_label"), F.when(c("p") % 3 == 2, F.concat(F.lit("l"), p)).alias("category"),
        F.when(key.isin(2, 3, 4), F.concat(F.lit(" d"), p, F.lit(" "))).alias("description"), F.when(key.isin(1, 2), F.concat(F.lit("s"), p)).otherwise(" ").alias("source_text"),
    )
    raw = r.groupBy("id").agg(F.to_json(F.transform(F.array_sort(F.collect_list(F.struct("k", item.alias("x")))), lambda y: y["x"])).alias("raw"))
    g = notices.grounds(c("raw"))
    return raw.select("id", F.array_join(F.transform(g, lambda x: F.concat_ws(":", x["seq"].cast("string"), x["item_label"], x["description"], x["source_text"])), "|").alias("grounds"))


_FOUND = {"q08_truncation": "truncation", "q13_markdown_table": "markdown_table", "q15_ai_cliche": "ai_cliche"}
_CHECKED = " UNION ALL ".join(f"SELECT id, message, '{k}' AS rule, '{rules.rules_of('chapter')[k].severity}' AS severity FROM ({rule_queries.SQL[q]}) x{n}" for n, (q, k) in enumerate(_FOUND.items()))


@query("y30_hard_checks", f"SELECT id, coalesce(string_agg(message, '|' ORDER BY rule, message) FILTER (severity = 'block'), '') AS errors, coalesce(string_agg(message, '|' ORDER BY rule, message) FILTER (severity <> 'block'), '') AS notes FROM ({_CHECKED}) f GROUP BY id")
def hard_checks(spark, sf_dir):
    found = notices.hard_checks(given(spark, sf_dir, "chapter"), "chapter", tuple(_FOUND.values()))
    return found.select("id", F.array_join("errors", "|").alias("errors"), F.array_join("notes", "|").alias("notes"))
