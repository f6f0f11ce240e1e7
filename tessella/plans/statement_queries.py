"""Rows of the inventory that are one SQL statement: the same text runs in Spark SQL and in DuckDB, over the stand-ins
of inputs.py. `{name}` stands for a table or stand-in."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from .inputs import INPUTS, given, table

STATEMENTS = {
    # filters
    "c04_items_of_tab": "SELECT id, CASE WHEN title LIKE '%质量%' THEN '资格' WHEN title LIKE '%工程%' THEN '符合' ELSE '其他' END AS tab FROM {section}",
    "c05_search_projects": "SELECT c_custkey FROM {customer} WHERE c_mktsegment = 'BUILDING' AND lower(concat_ws(' ', c_name, c_mktsegment, CAST(c_nationkey AS STRING))) LIKE '%1%'",
    "c06_search_requirements": "SELECT id FROM {requirement} WHERE status = 'confirmed' AND (lower(title) LIKE '%red%' OR lower(keyword) LIKE '%promo%')",
    "c07_allowed_transition": "SELECT event_id, event_type IN ('click', 'view') AS allowed FROM {events}",
    "c10_links_of_domain": "SELECT l_partkey, l_suppkey FROM {lineitem} WHERE l_returnflag = 'R' AND l_partkey IN (SELECT p_partkey FROM {part} WHERE p_brand = 'Brand#3')",
    "c11_has_sources": "SELECT s_suppkey, EXISTS (SELECT 1 FROM {lineitem} WHERE l_suppkey = s_suppkey AND l_quantity > 49) AS has FROM {supplier}",
    "c13_yellow_leaves": "SELECT doc_id, toxic FROM {labels} WHERE quality = 1 AND toxic = 1",
    "c14_export_gate": "SELECT source, CASE WHEN count(*) = 0 THEN 'no_leaves' WHEN count(CASE WHEN n_chars < 50 THEN 1 END) > 0 THEN 'missing_content' WHEN count(CASE WHEN text LIKE '%AKIA%' THEN 1 END) > 0 THEN 'red' ELSE 'ready' END AS gate FROM {documents} GROUP BY source",
    "c15_splittable_leaf": "SELECT id, CASE WHEN key_points > 5 THEN 'level' WHEN target_words < 1500 THEN 'short' WHEN title IN ('工程概况', '质量目标', '项目特点') THEN 'descriptive' ELSE 'ok' END AS reason FROM {section}",
    "c16_long_leaves": "SELECT id FROM {section} WHERE key_points < 4 AND target_words >= 1500 AND title NOT IN ('工程概况', '质量目标', '项目特点')",
    "c17_confirm_all": "SELECT id, CASE WHEN (SELECT count(*) FROM {requirement} WHERE is_risk = 1 AND status = 'pending') > 0 THEN status WHEN status = 'pending' THEN 'confirmed' ELSE status END AS status FROM {requirement}",
    "c20_key_chapter": "SELECT id, title LIKE '%方案%' OR title LIKE '%措施%' OR score >= 5 AS is_key FROM {section}",
    "c21_report_is_stale": "SELECT o_custkey, max(o_orderdate) > TIMESTAMP '1998-01-01 00:00:00' AS stale FROM {orders} GROUP BY o_custkey",
    # joins
    "d03_standard_detail": "SELECT p_partkey, coalesce(n, 0) AS links, coalesce(q, 0) AS quantity FROM {part} LEFT JOIN (SELECT l_partkey, count(*) AS n, sum(l_quantity) AS q FROM {lineitem} GROUP BY l_partkey) l ON p_partkey = l_partkey",
    "d04_resolve_standard": "SELECT a.raw_code, count(*) AS n FROM {standard} a JOIN {standard} b ON replace(replace(upper(a.raw_code), ' ', ''), '/', '') = replace(replace(upper(b.raw_code), ' ', ''), '/', '') GROUP BY a.raw_code",
    "d07_shared_requirement": "SELECT a.l_orderkey, count(DISTINCT b.l_orderkey) AS others FROM {lineitem} a JOIN {lineitem} b ON a.l_partkey = b.l_partkey AND a.l_orderkey <> b.l_orderkey WHERE a.l_linenumber = 1 GROUP BY a.l_orderkey",
    "d10_titles_that_contain": "SELECT s.id, count(*) AS n FROM {section} s JOIN (SELECT DISTINCT p_type AS t FROM {part}) k ON lower(s.kind) LIKE concat('%', lower(k.t), '%') OR lower(k.t) LIKE concat('%', lower(s.name), '%') GROUP BY s.id",
    "d16_unseen_codes": "SELECT DISTINCT concat('GBT', CAST(50000 + id AS STRING)) AS core FROM {note} WHERE 50000 + id NOT IN (SELECT 50000 + p_partkey FROM {part})",
    "d18_bound_folder": "SELECT id, min(r_name) AS folder FROM {section} LEFT JOIN {region} ON upper(name) LIKE concat('%', substring(r_name, 1, 2), '%') GROUP BY id",
    "d20_other_leaves": "SELECT n_nationkey, (SELECT count(*) FROM {nation}) - 1 AS others FROM {nation}",
    "d23_recommended_standards": "SELECT domain, raw_code, title FROM (SELECT *, row_number() OVER (PARTITION BY domain ORDER BY CASE WHEN title LIKE '%red%' THEN 2 ELSE 0 END + CASE WHEN title LIKE '%ring%' THEN 1 ELSE 0 END DESC, raw_code, title) AS r FROM {standard} WHERE status = 'active' AND (title LIKE '%red%' OR title LIKE '%ring%')) x WHERE r <= 8",
    "d24_knowledge_folders": "SELECT c_custkey, CASE WHEN c_mktsegment LIKE 'B%' THEN 'building' WHEN c_nationkey < 5 THEN 'default' ELSE '' END AS folder FROM {customer}",
    "d25_first_warning": "SELECT conv_id, min(turn) AS turn FROM {conversations} WHERE text LIKE '%the%' OR text LIKE '%de%' GROUP BY conv_id",
    "d28_cross_consistency": "SELECT id, CASE WHEN id % 400 > 360 THEN 'fail' WHEN id % 400 > 180 THEN 'warn' ELSE 'pass' END AS level, (id % 90 + 10.5) * 10000 > amount * 10 AS over_budget FROM {note}",
    "d29_disqualification": "SELECT r.id, CASE WHEN r.keyword LIKE '%promo%' THEN CASE WHEN r.is_risk = 1 THEN 'block' ELSE 'warn' END ELSE 'info' END AS severity FROM {requirement} r",
    # aggregates
    "e06_items_of_folder": "SELECT source, count(*) AS n FROM {documents} WHERE lang = 'en' GROUP BY source",
    "e09_estimate_pages": "SELECT folder, CAST(sum(target_words) AS BIGINT) AS words, CAST(greatest(1, round(sum(target_words) / CAST(780 AS DOUBLE))) AS BIGINT) AS pages FROM {section} GROUP BY folder",
    "e13_requirement_score": "SELECT l_orderkey, sum(coalesce(l_quantity, 0)) AS score FROM {lineitem} GROUP BY l_orderkey",
    "e14_response_hint": "SELECT l_orderkey, sum(l_quantity) AS score, max(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) = 1 AS any_mandatory, max(CASE WHEN l_linestatus = 'O' THEN 1 ELSE 0 END) = 1 AS any_risk FROM {lineitem} GROUP BY l_orderkey",
    "e15_recount_status": "SELECT o_orderstatus, count(*) AS n FROM {orders} GROUP BY o_orderstatus",
    "e17_leaf_counters": "SELECT o_orderpriority, count(CASE WHEN o_orderstatus = 'F' THEN 1 END) AS green, count(CASE WHEN o_orderstatus = 'P' THEN 1 END) AS yellow, count(CASE WHEN o_orderstatus = 'O' THEN 1 END) AS pending FROM {orders} GROUP BY o_orderpriority",
    "e18_outline_totals": "SELECT folder, CAST(sum(target_words) AS BIGINT) AS words, count(CASE WHEN target_words = 0 THEN 1 END) AS empty FROM {section} GROUP BY folder",
    "e19_stage_metrics": "SELECT role, count(*) AS stages, CAST(sum(length(text)) AS BIGINT) AS chars FROM {conversations} GROUP BY role",
    "e21_cache_usage": "SELECT user_id, count(*) AS requests, count(CASE WHEN event_type = 'view' THEN 1 END) AS hits FROM {events} GROUP BY user_id",
    "e27_leaf_report": "SELECT d.doc_id, coalesce(l.quality, -1) AS status, d.n_chars AS actual FROM {documents} d LEFT JOIN {labels} l ON d.doc_id = l.doc_id",
    "e28_prefilled_facts": "SELECT o.o_orderkey, coalesce(nullif(trim(CASE WHEN o.o_orderstatus = 'P' THEN ' ' ELSE o.o_orderstatus END), ''), c.c_mktsegment) AS fact FROM {orders} o LEFT JOIN {customer} c ON o.o_custkey = c.c_custkey",
    "e34_pages_by_kind": "SELECT l_returnflag, count(*) AS n, min(l_linenumber) AS first_page, max(l_linenumber) AS last_page FROM {lineitem} GROUP BY l_returnflag",
    "e36_generation_payload": "SELECT count(*) AS outline, count(CASE WHEN key_points > 0 THEN 1 END) AS leaves, CAST(sum(target_words) AS BIGINT) AS words FROM {section}",
    "e37_thin_domains": "SELECT domain, category FROM {standard} WHERE status = 'active' GROUP BY domain, category HAVING count(*) < 5",
    # order
    "f03_prior_contents": "SELECT conv_id, turn, count(CASE WHEN length(text) >= 120 THEN 1 END) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS n FROM {conversations}",
    "f04_prior_sibling": "SELECT c_custkey, lag(c_name) OVER (PARTITION BY c_nationkey ORDER BY c_custkey % 7, c_custkey) AS prior FROM {customer}",
    "f05_sibling_order": "SELECT c_custkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey % 7, c_custkey) AS place FROM {customer}",
    "f10_sections_of_roots": "SELECT n_regionkey, min(n_nationkey) AS first, count(*) AS n FROM {nation} GROUP BY n_regionkey",
    "f18_page_hint": "SELECT l_orderkey, CASE WHEN min(l_linenumber) = max(l_linenumber) THEN concat('p', CAST(min(l_linenumber) AS STRING)) ELSE concat('p', CAST(min(l_linenumber) AS STRING), '-', CAST(max(l_linenumber) AS STRING)) END AS hint FROM {lineitem} GROUP BY l_orderkey",
    "f20_emitted_headings": "SELECT id, key_points = 0 OR target_words > 0 OR followup AS emitted FROM {section}",
    "f24_point_groups": "SELECT l_orderkey, l_linenumber, CAST(floor((row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) - 1) / CAST(ceil(count(*) OVER (PARTITION BY l_orderkey) / CAST(3 AS DOUBLE)) AS DOUBLE)) AS INT) AS grp FROM {lineitem}",
    "f26_summary_sample": "SELECT doc_id, md5(CASE WHEN length(text) <= 4000 THEN text ELSE concat(substring(text, 1, 2500), '……', right(text, 1500)) END) AS sample FROM {documents}",
    "f27_next_sort_order": "SELECT n_regionkey, coalesce(max(n_nationkey) + 1, 0) AS next FROM {nation} GROUP BY n_regionkey",
    "g06_title_list": "SELECT c_nationkey, count(*) AS n, least(count(*), 40) AS shown FROM {customer} GROUP BY c_nationkey",
    # sets
    "h01_names_only_there": "SELECT c_custkey AS k FROM {customer} EXCEPT SELECT s_suppkey FROM {supplier}",
    "h05_first_paragraph": "SELECT min(doc_id) AS doc_id, md5(text) AS h FROM {documents} WHERE trim(text) <> '' GROUP BY md5(text)",
    "h11_all_but_current": "SELECT a.r_regionkey, b.r_regionkey AS other FROM {region} a JOIN {region} b ON a.r_regionkey <> b.r_regionkey",
    # text, dates, numbers
    "i28_embed_text": "SELECT doc_id, md5(concat(source, '\n', text)) AS h FROM {documents}",
    "i60_truncated": "SELECT doc_id, md5(CASE WHEN length(text) > 500 THEN concat(substring(text, 1, 500), '…（截断）') ELSE text END) AS h FROM {documents}",
    "i68_selection_rewrite": "SELECT doc_id, CASE WHEN length(text) >= 20 THEN md5(concat(substring(text, 1, 10), 'X', substring(text, 21))) END AS h FROM {documents}",
    "i70_meta_line": "SELECT id, CASE WHEN key_points > 2 THEN concat('关键词：', name) END AS line FROM {section}",
    "j10_gantt_duration": "SELECT id, coalesce(CASE WHEN id % 5 = 0 THEN NULL ELSE CAST(id % 400 AS INT) END, 180) AS days FROM {note}",
    "j11_generation_config": "SELECT id, CASE WHEN kind IN ('SMALL', 'LARGE') THEN kind ELSE 'MEDIUM' END AS mode, least(1200, greatest(10, target_words)) AS pages FROM {section}",
    "k16_stale_node": "SELECT a.id, a.name <> b.name OR a.target_words <> b.target_words AS stale FROM {section} a JOIN {section} b ON a.id = b.id + 1",
    # keyed state
    "m02_replaced_links": "SELECT p_partkey, p_brand FROM {part} WHERE p_size > 25 UNION ALL SELECT DISTINCT p.p_partkey, p.p_type FROM {part} p WHERE p_size <= 25",
    "m04_mark_withdrawn": "SELECT raw_code, CASE WHEN status = 'draft' THEN 'withdrawn' ELSE status END AS status FROM {standard}",
    "m07_saved_tree": "SELECT n.id, CASE WHEN n.target_words > 1000 THEN NULL ELSE o.name END AS content FROM {section} n LEFT JOIN (SELECT id, name FROM {section} WHERE key_points < 5) o ON n.id = o.id",
    "m09_guarded_backfill": "SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN c_mktsegment WHEN c_nationkey = 3 THEN 'NOTICE' ELSE coalesce(nullif(c_mktsegment, 'BUILDING'), 'NOTICE') END AS kind FROM {customer}",
    "m12_colour_transition": "SELECT d.doc_id, CASE WHEN l.quality = 0 THEN 'red' WHEN l.toxic = 1 THEN 'yellow' WHEN l.quality = 1 THEN 'green' ELSE 'init' END AS colour FROM {documents} d LEFT JOIN {labels} l ON d.doc_id = l.doc_id",
    "m25_default_facts": "SELECT c_custkey, k.fact FROM {customer} CROSS JOIN (SELECT 'a' AS fact UNION ALL SELECT 'b') k WHERE c_custkey NOT IN (SELECT o_custkey FROM {orders} WHERE o_orderstatus = 'F')",
    "m27_reordered_facts": "SELECT s.s_suppkey, coalesce(p.place, s.s_nationkey) AS place FROM {supplier} s LEFT JOIN (SELECT s_suppkey, s_suppkey * 2 AS place FROM {supplier} WHERE s_acctbal > 0) p ON s.s_suppkey = p.s_suppkey",
    "m29_qa_result": "SELECT doc_id, CASE WHEN quality = 0 OR toxic = 1 THEN 'yellow' ELSE 'green' END AS status FROM {labels}",
    # lookups and projections
    "x09_resolved_model": "SELECT user_id, coalesce(nullif(max(CASE WHEN event_type = 'signup' THEN props END), ''), 'default') AS model FROM {events} GROUP BY user_id",
    "x11_labelled_messages": "SELECT o_orderkey, concat('[', o_orderpriority, '] ', o_orderstatus) AS message FROM {orders}",
    "x12_category_severity": "SELECT o_orderpriority, CASE o_orderpriority WHEN '1-URGENT' THEN 'block' WHEN '5-LOW' THEN 'info' ELSE 'warn' END AS severity, count(*) AS n FROM {orders} GROUP BY o_orderpriority",
    "y03_matrix_issue": "SELECT id, title LIKE '质量%' AND name LIKE '%red%' AS is_issue FROM {section}",
    "y05_missing_parameters": "SELECT c_custkey, concat_ws(',', CASE WHEN c_acctbal < 0 THEN 'balance' END, CASE WHEN c_mktsegment = 'BUILDING' THEN 'segment' END) AS missing FROM {customer}",
    "y06_items_of_folder": "SELECT doc_id, row_number() OVER (PARTITION BY source ORDER BY n_chars, doc_id) AS place FROM {documents}",
    "y08_disabled_folder": "SELECT o_custkey, o_orderpriority FROM {orders} WHERE NOT (o_custkey % 2 = 0 AND o_orderpriority = '5-LOW')",
    "y23_leaf_words": "SELECT id, coalesce(CASE WHEN key_points > 3 AND target_words > 0 THEN target_words END, key_points, 0) AS words FROM {section}",
    "y41_patched_requirement": "SELECT id, coalesce(CASE WHEN is_risk = 1 THEN 'patched' END, title) AS title FROM {requirement}",
    "y46_export_counts": "SELECT count(*) AS leaves, count(CASE WHEN n_chars > 0 THEN 1 END) AS with_content, count(CASE WHEN n_chars > 5000 THEN 1 END) AS long FROM {documents}",
    "y47_counts_per_tab": "SELECT count(CASE WHEN status = 'pending' THEN 1 END) AS pending, count(CASE WHEN status = 'confirmed' THEN 1 END) AS confirmed, CAST(sum(is_risk) AS BIGINT) AS risk, count(CASE WHEN status = 'ignored' THEN 1 END) AS ignored FROM {requirement}",
    "y49_tables_only": "SELECT l_orderkey, l_linenumber FROM {lineitem} WHERE l_returnflag = 'R'",
}


def run(statement: str):
    names = sorted(set(re.findall(r"\{(\w+)\}", statement)))

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return spark.sql(statement, **{n: given(spark, sf_dir, n) if n in INPUTS else table(spark, sf_dir, n) for n in names})

    return query


def _duck(statement: str) -> str:
    """Stand-ins as common tables before the statement."""
    names = [n for n in INPUTS if "{" + n + "}" in statement]
    head = "WITH " + ", ".join(f"{n} AS ({INPUTS[n]})" for n in names) + " " if names else ""
    return head + re.sub(r"\{(\w+)\}", r"\1", statement)


QUERIES = {name: run(s) for name, s in STATEMENTS.items()}
SQL = {name: _duck(s) for name, s in STATEMENTS.items()}
