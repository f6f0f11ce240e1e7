"""Queries over changes of state, each with SQL of its own."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import lifecycle
from .inputs import cte, given, table

QUERIES, SQL = {}, {}
c = F.col


def query(name: str, sql: str):
    def add(f):
        QUERIES[name], SQL[name] = f, sql
        return f

    return add


_PROJECT = "project AS (SELECT c_custkey AS id, CASE CAST(c_custkey % 5 AS INT) WHEN 0 THEN 'generating' WHEN 1 THEN 'parsing' WHEN 2 THEN NULL ELSE 'confirming' END AS status, CAST(c_custkey % 2 AS INT) AS pause_requested, CAST(NULL AS STRING) AS parse_error FROM customer)"
_LEAF = "leaf AS (SELECT o_orderkey AS id, o_custkey AS project_id, CASE WHEN o_orderpriority = '5-LOW' THEN 0 ELSE 1 END AS is_leaf, CASE WHEN o_orderstatus = 'O' THEN 'generating' ELSE 'green' END AS review_status, CASE WHEN o_orderpriority = '2-HIGH' THEN '[]' END AS review_errors FROM orders)"


def _made(spark, sf_dir, named: str, source: str):
    """The stand-in of a CTE `name AS (SELECT ...)` over one table."""
    statement = named.split(" AS (", 1)[1][:-1]
    return spark.sql(statement.replace(f"FROM {source}", f"FROM {{{source}}}"), **{source: table(spark, sf_dir, source)})


def _projects(spark, sf_dir):
    return _made(spark, sf_dir, _PROJECT, "customer")


def _leaves(spark, sf_dir):
    return _made(spark, sf_dir, _LEAF, "orders")


@query("c12_claim_generation", f"WITH {_PROJECT}, w AS (SELECT DISTINCT o_custkey AS id FROM orders WHERE o_orderpriority = '1-URGENT') SELECT id, CASE WHEN w.id IS NOT NULL THEN 'generating' ELSE status END AS status, CASE WHEN w.id IS NOT NULL THEN coalesce(status <> 'generating', TRUE) END AS won FROM project LEFT JOIN w USING (id)")
def claim(spark, sf_dir):
    wanted = table(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'").select(c("o_custkey").alias("id"))
    return lifecycle.claimed(_projects(spark, sf_dir).select("id", "status"), wanted)


@query("m15_recovered_generations", f"""WITH {_PROJECT}, {_LEAF} SELECT 'project' AS kind, id, CASE WHEN status = 'generating' THEN 'outline_locked' ELSE status END AS status, CAST(CASE WHEN status = 'generating' THEN 0 ELSE pause_requested END AS STRING) AS extra FROM project
UNION ALL SELECT 'leaf', id, CASE WHEN stuck THEN 'red' ELSE review_status END, CASE WHEN stuck THEN '["生成在服务重启前中断，请重新生成"]' ELSE review_errors END FROM (SELECT leaf.*, is_leaf = 1 AND review_status = 'generating' AND project_id IN (SELECT id FROM project WHERE status = 'generating') AS stuck FROM leaf) x""")
def recovered_generations(spark, sf_dir):
    projects, leaves = lifecycle.recovered_generations(_projects(spark, sf_dir), _leaves(spark, sf_dir))
    return projects.select(F.lit("project").alias("kind"), "id", "status", c("pause_requested").cast("string").alias("extra")).union(leaves.select(F.lit("leaf"), "id", "review_status", "review_errors"))


@query("m16_recovered_parsing", f"WITH {_PROJECT} SELECT id, CASE WHEN status = 'parsing' THEN 'confirming' ELSE status END AS status, CASE WHEN status = 'parsing' THEN '解析在服务重启前中断，请重新上传招标文件' END AS parse_error FROM project")
def recovered_parsing(spark, sf_dir):
    return lifecycle.recovered_parsing(_projects(spark, sf_dir)).select("id", "status", "parse_error")


@query("m17_marked_red", f"WITH {_LEAF} SELECT id, CASE WHEN h THEN 'red' ELSE review_status END AS review_status, h AS changed FROM (SELECT *, id % 3 = 0 AND is_leaf = 1 AND review_status = 'generating' AS h FROM leaf) x")
def marked_red(spark, sf_dir):
    return lifecycle.marked_red(_leaves(spark, sf_dir), c("id") % 3 == 0, "失败").select("id", "review_status", "changed")


@query("y55_failure_events", f"WITH {_LEAF} SELECT project_id, id AS chapter_id, 'error' AS stage, '失败' AS message FROM leaf WHERE id % 3 = 0 AND is_leaf = 1 AND review_status = 'generating'")
def failure_events(spark, sf_dir):
    return lifecycle.failure_events(_leaves(spark, sf_dir), c("id") % 3 == 0, "失败")


@query("m14_cascade_delete", """WITH gone AS (SELECT c_custkey AS id FROM customer WHERE c_mktsegment = 'BUILDING'), o AS (SELECT * FROM orders WHERE o_custkey NOT IN (SELECT id FROM gone))
SELECT 'customer' AS name, count(*) AS n FROM customer WHERE c_custkey NOT IN (SELECT id FROM gone) UNION ALL SELECT 'orders', count(*) FROM o
UNION ALL SELECT 'lineitem', count(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT id FROM gone)) UNION ALL SELECT 'region', count(*) FROM region""")
def cascade_delete(spark, sf_dir):
    tables = {n: table(spark, sf_dir, n) for n in ("customer", "orders", "lineitem", "region")}
    gone = tables["customer"].where("c_mktsegment = 'BUILDING'").select("c_custkey")
    left = lifecycle.cascaded(tables, {"orders": ("o_custkey", "customer", "c_custkey"), "lineitem": ("l_orderkey", "orders", "o_orderkey")}, "customer", gone, "c_custkey")
    counts = [df.agg(F.count("*").alias("n")).select(F.lit(n).alias("name"), "n") for n, df in left.items()]
    return counts[0].union(counts[1]).union(counts[2]).union(counts[3])


_LOCK = """leaf AS (SELECT o_custkey AS project_id, o_orderkey AS id FROM orders), bound AS (SELECT DISTINCT o_custkey AS project_id, CAST(l_partkey AS STRING) AS id FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE l_returnflag <> 'R' OR l_partkey % 4 = 0),
req AS (SELECT DISTINCT o_custkey AS project_id, CAST(p_partkey AS STRING) AS id, CASE WHEN p_size > 40 THEN 1 ELSE 0 END AS is_risk FROM orders JOIN lineitem ON o_orderkey = l_orderkey JOIN part ON l_partkey = p_partkey)"""


@query("m18_lock_outline", f"WITH {_LOCK}, b AS (SELECT project_id, count(*) AS n FROM req WHERE is_risk = 1 AND (project_id, id) NOT IN (SELECT (project_id, id) FROM bound) GROUP BY project_id) SELECT p.project_id, coalesce(n, 0) = 0 AS locked, coalesce(n, 0) AS blocking FROM (SELECT DISTINCT project_id FROM leaf) p LEFT JOIN b USING (project_id)")
def lock_outline(spark, sf_dir):
    orders, items, part = (table(spark, sf_dir, n) for n in ("orders", "lineitem", "part"))
    ids = items.where("l_returnflag <> 'R' OR l_partkey % 4 = 0").groupBy("l_orderkey").agg(F.to_json(F.collect_list(c("l_partkey").cast("string"))).alias("requirement_ids"))
    leaves = orders.join(ids, c("o_orderkey") == c("l_orderkey"), "left").select(c("o_custkey").alias("project_id"), c("o_orderkey").alias("id"), "requirement_ids")
    req = orders.join(items, c("o_orderkey") == c("l_orderkey")).join(part, c("l_partkey") == c("p_partkey")).select(c("o_custkey").alias("project_id"), c("p_partkey").cast("string").alias("id"), F.when(c("p_size") > 40, 1).otherwise(0).alias("is_risk")).distinct()
    return lifecycle.locked_outlines(leaves, req)


@query("m28_enabled_folders", """WITH b AS (SELECT DISTINCT o_custkey AS project_id, o_orderpriority AS folder FROM orders WHERE o_orderstatus = 'F'), a AS (SELECT o_custkey AS project_id, o_orderpriority AS folder FROM orders WHERE o_orderstatus = 'O'), r AS (SELECT o_custkey AS project_id, o_orderpriority AS folder FROM orders WHERE o_orderstatus = 'P')
SELECT project_id, folder FROM (SELECT * FROM b UNION SELECT * FROM a) x WHERE (project_id, folder) NOT IN (SELECT (project_id, folder) FROM r)""")
def enabled_folders(spark, sf_dir):
    pairs = lambda s: table(spark, sf_dir, "orders").where(c("o_orderstatus") == s).select(c("o_custkey").alias("project_id"), c("o_orderpriority").alias("folder"))
    return lifecycle.enabled(pairs("F").distinct(), pairs("O"), pairs("P"))


_TREE = "t AS (SELECT DISTINCT 'S' || CAST(l_suppkey AS STRING) AS parent_id, 'S' || CAST(l_suppkey AS STRING) || '.' || CASE WHEN l_quantity > 45 THEN 'x' ELSE '' END || CAST(CAST(l_quantity AS INT) AS STRING) AS id FROM lineitem WHERE l_quantity <= 20 OR l_quantity > 45)"


@query("y20_next_child", f"WITH {_TREE}, p AS (SELECT DISTINCT parent_id FROM t) SELECT parent_id, CAST((SELECT min(n) FROM range(1, 60) r(n) WHERE parent_id || '.' || CAST(n AS STRING) NOT IN (SELECT id FROM t)) AS INT) AS next FROM p")
def next_child(spark, sf_dir):
    q = c("l_quantity").cast("int").cast("string")
    parent = F.concat(F.lit("S"), c("l_suppkey").cast("string"))
    nodes = table(spark, sf_dir, "lineitem").where("l_quantity <= 20 OR l_quantity > 45").select(parent.alias("parent_id"), F.concat(parent, F.lit("."), F.when(c("l_quantity") > 45, "x").otherwise(""), q).alias("id")).distinct()
    return lifecycle.next_children(nodes)


@query("y21_under_branch", "SELECT o_orderkey AS id, regexp_matches(CAST(o_custkey AS STRING) || '.' || CAST(o_orderkey AS STRING), '^(1|1\\..*)$') AS one, regexp_matches(CAST(o_custkey AS STRING), '^(7|7\\..*)$') AS same FROM orders")
def under_branch(spark, sf_dir):
    cust = c("o_custkey").cast("string")
    return table(spark, sf_dir, "orders").select(c("o_orderkey").alias("id"), lifecycle.under_branch(F.concat(cust, F.lit("."), c("o_orderkey").cast("string")), F.lit("1")).alias("one"), lifecycle.under_branch(cust, F.lit("7")).alias("same"))


@query("j08_parse_progress", "SELECT event_id, CAST(CASE event_type WHEN 'view' THEN 15 + floor(70 * least(event_id % 13, 11) / CAST(11 AS DOUBLE)) WHEN 'click' THEN 90 WHEN 'signup' THEN 5 ELSE 0 END AS INT) AS percent FROM events")
def parse_progress(spark, sf_dir):
    stage = F.when(c("event_type") == "view", "extracting").when(c("event_type") == "click", "saving").when(c("event_type") == "signup", "reading").otherwise("?")
    return table(spark, sf_dir, "events").select("event_id", lifecycle.parse_percent(stage, c("event_id") % 13, F.lit(11)).alias("percent"))


_PACK = [(5, "R5", ["anodized", "施工"]), (1, "R1", ["安装", "red"]), (2, "R2", ["方案", ""]), (3, "R3", ["blue", "工程"]), (4, "R4", ["STEEL", "目标"]), (6, "R6", ["a"])]


@query("d27_standard_clauses", f"""{cte("section")}, k AS (SELECT * FROM (VALUES (5, 'R5', ['anodized', '施工']), (1, 'R1', ['安装', 'red']), (2, 'R2', ['方案']), (3, 'R3', ['blue', '工程']), (4, 'R4', ['STEEL', '目标']), (6, 'R6', ['a'])) v(pos, rule, ws)),
h AS (SELECT id, pos, rule, row_number() OVER (PARTITION BY id ORDER BY pos) AS r FROM section, k WHERE len(list_filter(ws, lambda w: contains(title || ' ' || name || ' ' || kind, w))) > 0) SELECT id, pos, rule FROM h WHERE r <= 4""")
def standard_clauses(spark, sf_dir):
    pack = spark.createDataFrame(_PACK, "pos int, rule string, keywords array<string>")
    return lifecycle.matched_rules(given(spark, sf_dir, "section").select("id", "title", c("name").alias("brief"), c("kind").alias("boundary")), pack)


@query("f13_version_list", "SELECT user_id AS chapter_id, event_id AS version_id, CAST(r AS INT) AS nth, substring(trim(coalesce(props, '')), 1, 120) AS preview FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) x WHERE r <= 20")
def version_list(spark, sf_dir):
    return lifecycle.versions(table(spark, sf_dir, "events").select(c("user_id").alias("chapter_id"), c("event_id").alias("version_id"), c("ts").alias("at"), c("props").alias("content")))


@query("m13_restored_versions", """WITH ch AS (SELECT c_custkey AS id, c_name AS content FROM customer), s AS (SELECT o_orderkey AS version_id, o_custkey AS id, o_orderpriority AS content FROM orders), w AS (SELECT o_custkey AS id, max(o_orderkey) AS version_id FROM orders GROUP BY o_custkey UNION ALL SELECT c_custkey, 0 FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)),
f AS (SELECT w.id, s.content FROM w JOIN s ON s.id = w.id AND s.version_id = w.version_id) SELECT ch.id, coalesce(f.content, ch.content) AS content, CASE WHEN f.id IS NOT NULL THEN ch.content END AS before FROM ch LEFT JOIN f USING (id)""")
def restored_versions(spark, sf_dir):
    orders, customer = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    wanted = orders.groupBy(c("o_custkey").alias("id")).agg(F.max("o_orderkey").alias("version_id"))
    wanted = wanted.union(customer.join(orders, c("c_custkey") == c("o_custkey"), "left_anti").select("c_custkey", F.lit(0).cast("long")))
    snapshots = orders.select(c("o_orderkey").alias("version_id"), c("o_custkey").alias("chapter_id"), c("o_orderpriority").alias("content"))
    after, saved = lifecycle.restored(customer.select(c("c_custkey").alias("id"), c("c_name").alias("content")), snapshots, wanted)
    return after.join(saved.select(c("chapter_id").alias("id"), c("content").alias("before")), "id", "left")
