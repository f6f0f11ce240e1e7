"""Queries over the quality rules, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import rules
from .inputs import cte, given

QUERIES, SQL = {}, {}


def found(spark: SparkSession, sf_dir: str, *only: str) -> DataFrame:
    chapters = given(spark, sf_dir, "chapter").withColumn("other_titles", F.array(F.lit("服务范围"))).withColumn("keywords", F.array(F.lit("施工方案"), F.lit("质量"), F.lit("进度")))
    return rules.findings(chapters, "segment" if only == ("segment_no_heading",) else "chapter", only or None)


def add(name: str, check: str, sql: str) -> None:
    """sql: the message or null, over a chapter."""
    QUERIES[name] = lambda spark, sf_dir: found(spark, sf_dir, check).select("id", "message")
    SQL[name] = f"{cte('chapter')} SELECT id, message FROM (SELECT id, {sql} AS message FROM chapter) WHERE message IS NOT NULL"


_DESCRIPTIVE = "title IN ('质量目标', '工程概况', '项目特点')"
_SOLID = r"length(regexp_replace(content, '[\s\x{3000}\x{a0}\x{85}\x{0b}]', '', 'g'))"
_RIGHT = r"regexp_replace(content, '[\s\x{3000}]+$', '')"
add("q01_chapter_scope", "chapter_scope", "CASE WHEN kind = 6 AND title <> '服务范围' THEN '正文出现其他章节标题「服务范围」，超出本章「' || title || '」范围' END")
add("q02_duration_number", "duration_number", "CASE WHEN kind = 0 THEN '工期数字 90 与全局参数 40 天偏差过大' END")
add("q03_digit_density", "digit_density", rf"CASE WHEN NOT {_DESCRIPTIVE} AND length(content) > 500 AND len(regexp_extract_all(content, '\d')) / greatest(length(content) / CAST(100 AS DOUBLE), 1) < 0.5 THEN '内容密度不足：技术参数与数字偏少' END")
add("q07_ai_spacing", "ai_spacing", "unnest(CASE WHEN kind = 4 THEN ['存在全角空格（应使用半角或删除）', '存在连续多个半角空格'] END)")
add(
    "q08_truncation", "truncation",
    rf"CASE WHEN {_RIGHT} = '' OR regexp_matches({_RIGHT}, '(?:。|！|？|\]\]|\}}\]|）|\))$') OR regexp_matches(regexp_replace({_RIGHT}, '^(?s:.*)\n', ''), '^\|.*\|$') THEN NULL WHEN regexp_matches({_RIGHT}, '[，、：；\-—]$') THEN '正文结尾疑似被截断（以逗号/顿号等非结束标点收尾）' WHEN length({_RIGHT}) > 200 THEN '正文结尾疑似被截断（未以句号等结束标点收尾）' END",
)
add("q09_descriptive_measures", "descriptive_measures", f"CASE WHEN {_DESCRIPTIVE} AND kind = 1 THEN CASE WHEN title = '质量目标' THEN '目标' ELSE '概况/特点' END || '章节不应写措施/方案，检测到：我们将' END")
add("q13_markdown_table", "markdown_table", "CASE WHEN kind = 5 THEN '表格列数不一致：表头 2 列，第 ' || CAST(len(string_split(content, chr(10))) AS STRING) || ' 行为 1 列' END")
add("q15_ai_cliche", "ai_cliche", "unnest(CASE WHEN kind = 1 THEN ['AI 套话残留：综上所述', 'AI 套话残留：全方位', 'AI 套话残留：闭环', 'AI 套话残留：闭环管理', 'AI 套话残留：赋能'] END)")
add("q23_chart_closure", "chart_closure", "CASE WHEN kind = 2 THEN '图表占位符未正确闭合' END")
add(
    "q24_word_count", "word_count",
    f"CASE WHEN {_SOLID} < 225 THEN '篇幅不足：当前约 ' || CAST({_SOLID} AS STRING) || ' 字，目标 300 字（下限 225）' WHEN {_SOLID} > 375 THEN '篇幅过长：当前约 ' || CAST({_SOLID} AS STRING) || ' 字，目标 300 字（上限 375）' END",
)
add("q25_segment_no_heading", "segment_no_heading", r"CASE WHEN regexp_matches(content, '^\s*#') THEN '分段正文严禁输出 # 标题行' END")
add("q05_blind_bid", "blind_bid", "unnest(CASE WHEN kind = 3 THEN ['暗标违规：出现「本公司」', '暗标违规：疑似身份信息「联系人：张三」'] END)")

QUERIES["q04_template_residue"] = lambda spark, sf_dir: found(spark, sf_dir, "template_residue").select("id", "message")
SQL["q04_template_residue"] = f"""{cte("chapter")}, w AS (SELECT unnest(['{"', '".join(rules.TEMPLATE_RESIDUES)}']) AS w)
SELECT id, '模板残留：' || w AS message FROM chapter, w WHERE contains(content, w)
UNION ALL SELECT id, '未替换标记：' || x FROM chapter, (SELECT unnest(['{"', '".join(rules.UNREPLACED)}']) AS x) WHERE contains(content, x)"""

_NORM = r"[\s\x{3000}，,。；;：:（）()\[\]【】\-—_/]"
_TRIM = r"'^[\s\x{3000}]+|[\s\x{3000}]+$', '', 'g'"
_PARAGRAPHS = rf"""list_filter(list_transform(string_split_regex(content, '\n[\s\x{{3000}}]*\n'), lambda b: array_to_string(list_filter(list_transform(string_split(b, chr(10)),
  lambda x: regexp_replace(x, {_TRIM})), lambda x: x <> '' AND NOT starts_with(x, '#')), chr(10))), lambda b: b <> '')"""
_OPENINGS = rf"""opened AS (SELECT id, list_transform(list_transform({_PARAGRAPHS}, lambda x: regexp_replace(regexp_replace(x, '^[-*+]\s+', ''), '^\d+[.、]\s+', '')),
  lambda s: CASE WHEN length(regexp_replace(regexp_extract(s, '{tx.OPENING}', 1), '{_NORM}', '', 'g')) >= 3 THEN regexp_replace(regexp_extract(s, '{tx.OPENING}', 1), '{_NORM}', '', 'g')
  WHEN length(regexp_replace(substring(s, 1, 5), '{_NORM}', '', 'g')) >= 3 THEN regexp_replace(substring(s, 1, 5), '{_NORM}', '', 'g') ELSE '' END) AS os FROM chapter)"""
def trailing_sql(x: str) -> str:
    """I72 in DuckDB."""
    back = rf"list_reverse(list_transform(string_split(regexp_replace({x}, {_TRIM}), chr(10)), lambda t: regexp_replace(t, {_TRIM})))"
    rows = rf"coalesce(nullif(list_position(list_transform({back}, lambda t: regexp_matches(t, '^\|.*\|$')), FALSE), 0) - 1, len({back}))"
    sep = r"'^\|?\s*:?-{2,}:?\s*(\|\s*:?-{2,}:?\s*)*\|?$'"
    lead = f"CAST(coalesce(regexp_matches(({back})[{rows} + 1], {sep}), FALSE) AS INT)"
    return f"""CASE WHEN NOT regexp_matches(regexp_replace({x}, {_TRIM}), '\\|$') OR {rows} = 0 THEN NULL WHEN {rows} + {lead} = 1 THEN '正文以不完整表格行结尾，须在本节点内输出完整表格（含表头与至少一行数据）'
      WHEN {rows} = 2 AND {lead} = 0 AND regexp_matches(({back})[1], {sep}) THEN '表格仅有表头与分隔线，缺少数据行，须在本节点内完整输出' END"""


add("q10_first_para_title", "first_para_title", rf"""CASE WHEN length(regexp_replace(title, '{_NORM}', '', 'g')) >= 4 AND starts_with(regexp_replace(({_PARAGRAPHS})[1], '{_NORM}', '', 'g'), regexp_replace(title, '{_NORM}', '', 'g'))
  AND length(regexp_replace(({_PARAGRAPHS})[1], '{_NORM}', '', 'g')) <= length(regexp_replace(title, '{_NORM}', '', 'g')) + 8 THEN '首段不应重复章节标题「' || title || '」' END""")
add("q14_atomic_md", "atomic_md", r"""unnest(list_filter([CASE WHEN len(regexp_extract_all(content, '(?i)\[(?:GANTT|TIMELINE|FLOW|ORG|SMART)_DATA:')) > len(regexp_extract_all(content, '\]\]|\}\]')) THEN '存在未闭合的图表占位符，须在本节点内完整输出后再结束' END,
  CASE WHEN regexp_matches(trim(content), '(?im)\[(?:GANTT|TIMELINE|FLOW|ORG|SMART)_DATA:[^\]]*$') THEN '正文末尾存在未闭合的图表占位符' END,
  """ + trailing_sql("content") + """], lambda x: x IS NOT NULL))""")
_VARIANTS = "['施工方案', '方案', '施工', '质量', '进度']"
add("q21_heading_keywords", "heading_keywords", rf"""CASE WHEN len(list_filter(list_append(list_transform(list_filter(list_transform(string_split(content, chr(10)), lambda x: regexp_replace(x, {_TRIM})),
  lambda x: (starts_with(x, '#') AND trim(regexp_replace(x, '^#+', '')) <> '') OR (x <> '' AND length(x) < 60 AND NOT regexp_matches(x, '[。；;！!]$') AND regexp_matches(x, '{tx.HEADING_LINE}'))), lambda x: regexp_replace(x, '^#+', '')), title),
  lambda h: len(list_filter({_VARIANTS}, lambda v: contains(regexp_replace(h, '{_NORM}', '', 'g'), v) OR (length(regexp_replace(h, '{_NORM}', '', 'g')) >= 4 AND contains(v, regexp_replace(h, '{_NORM}', '', 'g'))))) > 0)) = 0
  THEN '标题未覆盖关键词：施工方案/质量/进度' END""")
add("q22_stitch_cheat", "stitch_cheat", rf"""'疑似缝合句作弊：' || substring(list_filter(list_filter(list_transform(string_split(content, chr(10)), lambda x: regexp_replace(x, {_TRIM})), lambda x: length(x) BETWEEN 8 AND 80)
  || list_filter(list_transform(string_split_regex(content, '[。；\n]'), lambda x: regexp_replace(x, {_TRIM})), lambda x: length(x) >= 8),
  lambda b: contains(b, '施工方案') AND contains(b, '质量') AND contains(b, '进度') AND greatest(strpos(b, '施工方案') + 4, strpos(b, '质量') + 2, strpos(b, '进度') + 2) - least(strpos(b, '施工方案'), strpos(b, '质量'), strpos(b, '进度')) <= 30)[1], 1, 40)""")
QUERIES["q11_para_opening"] = lambda spark, sf_dir: found(spark, sf_dir, "para_opening").select("id", "message")
SQL["q11_para_opening"] = f"""{cte("chapter")}, {_OPENINGS} SELECT id, '连续 3 段以相同句式开头「' || os[place] || '」，建议调整表达方式' AS message FROM
(SELECT id, os, list_filter(range(3, len(os) + 1), lambda i: os[i] <> '' AND os[i] = os[i - 1] AND os[i] = os[i - 2])[1] AS place FROM opened) x WHERE place IS NOT NULL"""
QUERIES["q12_opening_pattern"] = lambda spark, sf_dir: found(spark, sf_dir, "opening_pattern").select("id", "message")
SQL["q12_opening_pattern"] = f"""{cte("chapter")}, {_OPENINGS}, each AS (SELECT id, unnest(os) AS o, unnest(range(1, len(os) + 1)) AS i FROM opened WHERE len(os) >= 3),
n AS (SELECT id, o, count(*) AS n, min(i) AS i FROM each WHERE length(o) >= 5 GROUP BY id, o HAVING count(*) >= 3)
SELECT id, '「' || o || '」句式在全文中重复出现 ' || CAST(n AS STRING) || ' 次（非连续），建议更换表达方式' AS message FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY n DESC, i) AS r FROM n) x WHERE r = 1"""

#: Category and severity of the chapter rules, by the query that holds a rule's SQL.
_RULES = {
    "q01_chapter_scope": "scope", "q02_duration_number": "fact_consistency", "q03_digit_density": "digit_density", "q04_template_residue": "template_residue", "q05_blind_bid": "blind_bid",
    "q07_ai_spacing": "writing_quality", "q08_truncation": "truncation", "q09_descriptive_measures": "writing_quality", "q10_first_para_title": "writing_quality", "q11_para_opening": "writing_quality",
    "q12_opening_pattern": "writing_quality", "q13_markdown_table": "table_integrity", "q14_atomic_md": "table_integrity", "q15_ai_cliche": "ai_cliche", "q21_heading_keywords": "title_keywords",
    "q22_stitch_cheat": "writing_quality", "q23_chart_closure": "chart_integrity", "q24_word_count": "word_count",
}
QUERIES["e32_findings_by_category"] = lambda spark, sf_dir: rules.summarise(found(spark, sf_dir))
SQL["e32_findings_by_category"] = "SELECT category, count(*) AS n, count(*) FILTER (category IN ('template_residue', 'blind_bid')) AS block, 0::BIGINT AS info, count(*) FILTER (category NOT IN ('template_residue', 'blind_bid')) AS warn FROM (" + " UNION ALL ".join(
    f"SELECT '{category}' AS category FROM ({SQL[name]})" for name, category in _RULES.items()
) + ") x GROUP BY category"
QUERIES["x10_rules_per_source"] = lambda spark, sf_dir: found(spark, sf_dir, "truncation", "chart_closure").groupBy("category", "severity").agg(F.count("*").alias("n"))
SQL["x10_rules_per_source"] = f"""SELECT 'truncation' AS category, 'warn' AS severity, count(*) AS n FROM ({SQL["q08_truncation"]}) x
UNION ALL SELECT 'chart_integrity', 'warn', count(*) FROM ({SQL["q23_chart_closure"]}) y"""


def standards_currency(spark: SparkSession, sf_dir: str) -> DataFrame:
    registry = given(spark, sf_dir, "standard").select(tx.standard_core(F.col("raw_code")).alias("core"), "status")
    return rules.currency(given(spark, sf_dir, "note").select("id", F.col("note").alias("content")), registry)


QUERIES["d17_standards_currency"] = standards_currency
SQL["d17_standards_currency"] = f"""{cte("standard", "note")}, r AS (SELECT regexp_replace(replace(replace(replace(raw_code, ' ', ''), '/', ''), '—', '-'), '-\\d{{4}}$', '') AS core, status FROM standard),
n AS (SELECT id, 'GBT' || CAST(50000 + id % 300 AS STRING) AS core FROM note UNION ALL SELECT id, 'DL' || CAST(id % 700 AS STRING) || '.' FROM note WHERE id % 700 >= 10)
SELECT n.id, n.core, coalesce(r.status, 'unknown') AS status FROM n LEFT JOIN r USING (core) WHERE coalesce(r.status, 'unknown') IN ('withdrawn', 'superseded', 'unknown')"""
