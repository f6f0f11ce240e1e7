"""Queries over records held as JSON or built into text, each with SQL of its own."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import records as rec
from .inputs import cte, given
from .text_queries import trim

QUERIES, SQL = {}, {}
c = F.col


def project(name: str, source: str, columns, sql: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return given(spark, sf_dir, source).select("id", *(x.alias(n) for n, x in columns().items()))

    QUERIES[name] = run
    SQL[name] = f"{cte(source)} SELECT id, {sql} FROM {source}"


def _guidance():
    k = c("key_points")
    full = F.to_json(F.struct(F.concat(F.lit(" "), c("name")).alias("brief"), c("kind").alias("content_boundary"), (c("target_words") - 500).alias("target_words"), (k == 1).alias("split_origin"), F.lit(" Rigorous").alias("style_tier")))
    return F.when(k < 3, full).when(k == 3, '{"brief": 5, "target_words": "x"}').when(k == 4, c("name")).when(k == 5, "{broken")


project(
    "k03_writing_guidance", "section", lambda: {n: rec.writing_guidance(_guidance())[n] for n in ("brief", "content_boundary", "target_words", "split_origin", "style_tier")},
    """CASE WHEN key_points < 3 THEN name WHEN key_points = 3 THEN '5' ELSE '' END AS brief, CASE WHEN key_points < 3 THEN kind ELSE '' END AS content_boundary,
    CAST(CASE WHEN key_points < 3 AND target_words > 500 THEN target_words - 500 END AS INT) AS target_words, key_points = 1 AS split_origin, CASE WHEN key_points < 3 THEN 'rigorous' ELSE 'balanced' END AS style_tier""",
)
project(
    "k04_guidance_json", "section", lambda: {"raw": rec.guidance_json(c("name"), F.concat(F.lit(" "), c("kind")), F.when(c("key_points") > 2, c("target_words")).otherwise(0), c("key_points") == 1, F.lit(None).cast("string"))},
    """'{"brief":"' || name || '","content_boundary":"' || kind || '","style_tier":"balanced"' || CASE WHEN key_points > 2 AND target_words > 0 THEN ',"target_words":' || CAST(target_words AS STRING) ELSE '' END || CASE WHEN key_points = 1 THEN ',"split_origin":true' ELSE '' END || '}' AS raw""",
)
project(
    "k05_meta", "section", lambda: {"n": F.size(rec.meta(F.when(c("key_points") < 3, F.to_json(F.struct("name", "kind"))).when(c("key_points") == 3, "[1]").when(c("key_points") == 4, c("name")))), "name": rec.meta(F.when(c("key_points") < 3, F.to_json(F.struct("name", "kind"))))["name"]},
    "CAST(CASE WHEN key_points < 3 THEN 2 ELSE 0 END AS INT) AS n, CASE WHEN key_points < 3 THEN name END AS name",
)
project(
    "k14_coerced_issues", "section", lambda: {"issues": F.array_join(rec.coerced_issues(F.when(c("key_points") < 3, F.concat(F.lit('["a", null, "  ", " '), c("name"), F.lit('"]'))).when(c("key_points") == 3, F.concat(F.lit('" '), c("name"), F.lit('"'))).when(c("key_points") == 4, "17")), "|")},
    "CASE WHEN key_points < 3 THEN 'a|' || name WHEN key_points = 3 THEN name ELSE '' END AS issues",
)
project(
    "i67_merged_errors", "section", lambda: {"merged": rec.merged_errors(F.when(c("key_points") < 3, F.to_json(F.array("name", "kind"))).when(c("key_points") == 3, c("name")), F.array("kind", "folder", "kind"))},
    """CASE WHEN key_points < 3 THEN '["' || name || '","' || kind || '","' || folder || '"]' WHEN key_points = 3 THEN '["' || name || '","' || kind || '","' || folder || '"]' ELSE '["' || kind || '","' || folder || '"]' END AS merged""",
)
project(
    "c24_equal_values", "section", lambda: {"same": rec.equal_values(F.when(c("key_points") > 3, c("target_words").cast("string")).when(c("key_points") == 1, " "), F.when(c("key_points") > 4, F.concat(c("target_words").cast("string"), F.lit(".0"))).when(c("key_points") > 1, c("name")))},
    "key_points > 4 OR key_points < 2 AS same",
)
_BOUNDARY = "CASE key_points WHEN 0 THEN '写质量目标与指标，不写施工措施，仅限本章内容范围之内' WHEN 1 THEN '写质量目标，拟采用的措施和施工方法要写得尽量具体一些' WHEN 2 THEN '短' WHEN 3 THEN repeat('长', 201) ELSE '只写各类范围，描述工序与控制的全部参数，逐条写明' END"


def _boundary():
    k = c("key_points")
    return F.when(k == 0, "写质量目标与指标，不写施工措施，仅限本章内容范围之内").when(k == 1, "写质量目标，拟采用的措施和施工方法要写得尽量具体一些").when(k == 2, "短").when(k == 3, F.repeat(F.lit("长"), 201)).otherwise("只写各类范围，描述工序与控制的全部参数，逐条写明")


project(
    "c22_boundary_issues", "section", lambda: {"issues": F.array_join(rec.boundary_issues(c("title"), _boundary()), "|")},
    """concat_ws('|', CASE WHEN key_points = 2 THEN 'content_boundary 过短（少于 20 字）' WHEN key_points = 3 THEN 'content_boundary 超过 200 字上限' END,
      CASE WHEN title = '质量目标' AND key_points = 1 THEN '目标类章节 boundary 含禁止词「措施」|目标类章节 boundary 含禁止词「方法」' WHEN title = '质量目标' AND key_points > 3 THEN '目标类章节 boundary 含禁止词「工序」'
      WHEN title IN ('工程概况', '项目特点') AND key_points = 1 THEN '概况类章节 boundary 含禁止词「措施」|概况类章节 boundary 含禁止词「方法」|概况类章节 boundary 含禁止词「拟采用」' WHEN title IN ('工程概况', '项目特点') AND key_points > 3 THEN '概况类章节 boundary 含禁止词「工序」'
      WHEN title IN ('施工方案', '设备安装调试') AND key_points IN (2, 3) THEN '专项/安装类章节 boundary 缺少工序或控制要点表述' END) AS issues""",
)
QUERIES["i41_catalog"] = lambda spark, sf_dir: given(spark, sf_dir, "section").select("id", F.explode(rec.catalog(F.concat(F.lit("第一章 "), c("name"), F.lit("。\nskipped line\n1. "), c("kind"), F.lit("；\n\n2.1.3 "), c("folder"), F.lit("\n  indented\n（二）"), c("title")))).alias("e")).select("id", "e.*")
SQL["i41_catalog"] = f"""{cte("section")} SELECT id, t[1] AS title, CAST(t[2] AS INT) AS level, CAST(t[3] AS INT) AS sort_order FROM (SELECT id, unnest([[name, '1', '1'], [kind, '2', '2'], [folder, '3', '3'], ['indented', '2', '4'], [title, '1', '5']]) AS t FROM section) x"""
project(
    "i44_clean_title", "section", lambda: {"title": rec.clean_title(_raw_title())},
    "CASE key_points WHEN 0 THEN name WHEN 1 THEN title WHEN 2 THEN '施工组织设计的编制与实施说明' WHEN 3 THEN '质量' WHEN 4 THEN '分包工程管理' WHEN 5 THEN repeat('很', 40) ELSE title END AS title",
)


def _raw_title():
    k = c("key_points")
    return (
        F.when(k == 0, F.concat(F.lit(" "), c("name"), F.lit("………… 12"))).when(k == 1, F.concat(c("title"), F.lit("（含分项、子项）"))).when(k == 2, "施工组织设计的编制与实施说明，应当逐条响应")
        .when(k == 3, "质量（ ）：").when(k == 4, "分包工程管理质量管理要点").when(k == 5, F.repeat(F.lit("很"), 50)).otherwise(F.concat(c("title"), F.lit("拟采取的措施")))
    )


project(
    "g07_requirement_block", "requirement", lambda: {"block": F.md5(rec.requirement_block(c("title"), c("score"), c("is_risk"), F.lit(" "), c("keyword"), c("elements"), F.lit(None).cast("string"), F.lit("★"), F.when(c("is_risk") == 1, c("status"))))},
    """md5(concat_ws(chr(10), '【' || title || '】', CASE WHEN score > 0 THEN '- 分值：' || CAST(CAST(score AS INT) AS STRING) || ' 分' END, CASE WHEN score >= 8 THEN '- 篇幅要求：高分项，须写足工艺步骤、控制参数与可验证措施，避免空泛口号' END,
    CASE WHEN is_risk = 1 THEN '- 刚性：是（缺项或明显不响应将严重失分）' END, '- 评分关键词：' || keyword, '- 必备要素（须在本章逐条体现）：' || elements, '- 风险提示：★', CASE WHEN is_risk = 1 THEN '- 评分细则：' || chr(10) || status END)) AS block""",
)
_TOPIC = rf"""(SELECT CASE WHEN length(s) > 36 THEN regexp_replace(substring(s, 1, 35), '[\s\x{{3000}}]+$', '') || '…' ELSE s END FROM (SELECT CASE WHEN length(h) > 8 THEN substring(b, 1, length(h) + 1) ELSE substring(b, 1, 36) END AS s FROM
  (SELECT b, regexp_extract(b, '^([^。；;！!？?\n]*)[。；;！!？?\n]', 1) AS h FROM (SELECT regexp_replace({trim("text")}, '[\s\x{{3000}}\x{{a0}}\x{{85}}\x{{0b}}]+', ' ', 'g') AS b) x) y) z)"""
_PREFIX = f"'【所属：' || folder || '/' || CASE WHEN id % 2 = 0 THEN 'doc' || CAST(id AS STRING) ELSE '文档' END || CASE WHEN id % 3 = 0 THEN '，关键词：k' ELSE '' END || '】' || {_TOPIC}"
project(
    "i27_chunk_prefix", "chunk",
    lambda: {"prefix": rec.chunk_prefix(F.concat(F.lit("/"), c("folder")), F.when(c("id") % 2 == 0, F.concat(F.lit("a/doc"), c("id").cast("string"), F.lit(".txt"))), F.when(c("id") % 3 == 0, " k "), c("text"))},
    rf"CASE WHEN length({_PREFIX}) > 80 THEN regexp_replace(substring({_PREFIX}, 1, 79), '[\s\x{{3000}}]+$', '') || '…' ELSE {_PREFIX} END AS prefix",
)
project("i29_chunk_display", "chunk", lambda: {"shown": F.md5(rec.with_prefix(c("text"), F.when(c("id") % 2 == 0, F.concat(c("folder"), F.lit(" ")))))}, f"md5(CASE WHEN id % 2 = 0 THEN folder || CASE WHEN {trim('text')} = '' THEN '' ELSE chr(10) END ELSE '' END || {trim('text')}) AS shown")
project("e29_points_catalog", "section", lambda: {"listed": rec.points_catalog(F.array(c("name"), F.lit(" "), F.when(c("key_points") > 2, c("kind")), c("folder")))}, "'（一）' || name || chr(10) || CASE WHEN key_points > 2 THEN '（二）' || kind || chr(10) || '（三）' ELSE '（二）' END || folder AS listed")
project(
    "e23_merged_groups", "section",
    lambda: {"groups": F.array_join(F.transform(rec.merged_groups(F.array(*(F.struct(F.lit(t).alias("title"), x.alias("content")) for t, x in (("a", c("name")), ("b", c("kind")), (" a ", F.concat(c("folder"), F.lit("；"))), ("a", c("folder")), ("", c("kind")), ("b", F.lit(" ")), ("a", c("title")))))), lambda g: F.concat(g["title"], F.lit("="), g["content"])), "|")},
    "'a=' || name || '；' || folder || '；' || title || '|b=' || kind AS groups",
)

_FORMS = """CASE CAST(id % 6 AS INT) WHEN 0 THEN '第3天' WHEN 1 THEN '第3天' WHEN 2 THEN '2024-03-05' WHEN 3 THEN '2024/03/05' WHEN 4 THEN '7' END"""


def _span():
    k = c("id") % 6
    start = F.when(k < 2, "第3天").when(k == 2, "2024-03-05").when(k == 3, "2024/03/05").when(k == 4, "7")
    end = F.when(k == 0, "第9天").when(k == 2, "2024-03-15").when(k == 4, "9.5")
    length = F.when(k == 3, (c("id") % 50).cast("int")).when(k == 5, (c("id") % 9).cast("int"))
    return rec.gantt_span(start, end, length, F.when(c("id") % 4 == 0, F.to_date(F.lit("2024-03-01"))), k == 4)


project(
    "j03_gantt_span", "note", lambda: {"begin": _span()["begin"], "days": _span()["days"]},
    """CAST(CASE id % 6 WHEN 0 THEN 3 WHEN 1 THEN 3 WHEN 2 THEN CASE WHEN id % 4 = 0 THEN 5 ELSE 1 END WHEN 3 THEN CASE WHEN id % 4 = 0 THEN 5 ELSE 1 END WHEN 4 THEN 8 ELSE 1 END AS INT) AS begin,
    CAST(CASE id % 6 WHEN 0 THEN 6 WHEN 1 THEN 1 WHEN 2 THEN 10 WHEN 3 THEN greatest(id % 50, 1) WHEN 4 THEN 2 ELSE greatest(id % 9, 1) END AS INT) AS days""",
)


def _tasks():
    n = c("id").cast("string")
    dated = F.concat(F.lit('{"tasks":[{"name":"a","start":"2024-03-05","duration":'), (c("id") % 7).cast("string"), F.lit('},{"title":"b","start":"2024-03-09","end":"2024-03-12"}]}'))
    own = F.concat(F.lit('[{"工序":"甲'), n, F.lit('","开始第几天":4,"持续天数":0},{"持续天数":5}]'))
    return F.when(c("id") % 4 == 0, dated).when(c("id") % 4 == 1, own).when(c("id") % 4 == 2, '{"startDate":"2024-03-01","items":[{"start":3,"end":8}]}').otherwise('{"other":1}')


QUERIES["j04_gantt_tasks"] = lambda spark, sf_dir: given(spark, sf_dir, "note").select("id", F.explode(rec.gantt_tasks(_tasks())).alias("t")).select("id", "t.*")
SQL["j04_gantt_tasks"] = f"""{cte("note")} SELECT id, t[1] AS name, CAST(t[2] AS INT) AS begin, CAST(t[3] AS INT) AS days FROM (SELECT id, unnest(CASE id % 4 WHEN 0 THEN [['a', '1', CAST(greatest(id % 7, 1) AS STRING)], ['b', '5', '3']]
WHEN 1 THEN [['甲' || CAST(id AS STRING), '4', '1'], ['工序2', '1', '5']] WHEN 2 THEN [['工序1', '4', '5']] END) AS t FROM note) x"""

project(
    "y34_default_boundary", "section", lambda: {"boundary": rec.default_boundary(c("title"))},
    """CASE WHEN title = '质量目标' THEN '仅撰写「质量目标」的目标承诺（质量、工期、造价等概括性表述），不写保证措施、施工方案或工艺细节；不输出章节标题行。'
    WHEN title IN ('工程概况', '项目特点') THEN '仅撰写「' || title || '」的客观描述（规模、地点、设备、环境、工程特点等），可描述重难点现象但不写对策；不写施工方案、组织、措施或进度计划；不输出章节标题行。' END AS boundary""",
)
project(
    "m23_sane_boundary", "section", lambda: {"boundary": rec.sane_boundary(c("title"), _boundary())["boundary"], "n": F.size(rec.sane_boundary(c("title"), _boundary())["issues"])},
    f"""CASE WHEN title = '质量目标' AND key_points > 0 THEN '仅撰写「质量目标」的目标承诺（质量、工期、造价等概括性表述），不写保证措施、施工方案或工艺细节；不输出章节标题行。'
    WHEN title IN ('工程概况', '项目特点') AND key_points > 0 THEN '仅撰写「' || title || '」的客观描述（规模、地点、设备、环境、工程特点等），可描述重难点现象但不写对策；不写施工方案、组织、措施或进度计划；不输出章节标题行。' ELSE {_BOUNDARY} END AS boundary,
    CAST(CASE WHEN key_points IN (2, 3) THEN 1 + CAST(title IN ('施工方案', '设备安装调试') AS INT) WHEN title = '质量目标' AND key_points = 1 THEN 2 WHEN title IN ('工程概况', '项目特点') AND key_points = 1 THEN 3 WHEN title IN ('质量目标', '工程概况', '项目特点') AND key_points > 3 THEN 1 ELSE 0 END AS INT) AS n""",
)
_CHARTS = "CASE WHEN key_points = 0 THEN map_from_arrays(array(), array()) WHEN key_points = 1 THEN map(2, concat('<', name, '>')) ELSE map(0, '<a>', 3, concat('<', kind, '>'), 1, '<b>') END"
project(
    "k13_assembled_chapter", "section", lambda: {"text": rec.assembled_chapter(F.when(c("key_points") == 5, F.lit(" ")).when(c("key_points") == 4, c("name")).otherwise(F.concat(c("name"), F.lit(" [[CHART:1]] x [[CHART:7]]y [[CHART:3]] "))), F.expr(_CHARTS).cast("map<int,string>"))},
    """CASE WHEN key_points = 5 THEN '<a>' || chr(10) || '<b>' || chr(10) || '<' || kind || '>' WHEN key_points = 4 THEN name || chr(10) || chr(10) || '<a>' || chr(10) || '<b>' || chr(10) || '<' || kind || '>' WHEN key_points = 0 THEN name || '  x y'
    WHEN key_points = 1 THEN name || '  x y' || chr(10) || chr(10) || '<' || name || '>' ELSE name || ' <b> x y <' || kind || '>' || chr(10) || chr(10) || '<a>' END AS text""",
)


def _windows():
    k = c("key_points")
    one = lambda label, passed, *xs: F.struct(F.lit(label).alias("label"), passed.alias("passed"), F.array(*xs).cast("array<string>").alias("issues"))
    return F.array(one("开头", k != 2, F.when(k == 1, c("name")), F.lit(" ")), one(" ", F.lit(None).cast("boolean"), F.when(k == 1, c("name")), F.when(k == 1, c("name"))), one("结尾", F.lit(True)))


project(
    "e26_merged_windows", "section", lambda: {"passed": rec.merged_windows(_windows())["passed"], "issues": F.array_join(rec.merged_windows(_windows())["issues"], "|")},
    "key_points NOT IN (1, 2) AS passed, CASE WHEN key_points = 1 THEN '【开头】' || name || '|【片段】' || name ELSE '' END AS issues",
)


def _confidence():
    k, w = c("key_points"), c("target_words")
    n = F.floor(w / 50).cast("int")
    return rec.parse_confidence(k == 6, F.lit(3), k, k % 3, k + 2, k == 5, n % 20, n % 7, n % 15, n % 17, k % 5, F.lit(4))


project(
    "e12_parse_confidence", "section", lambda: {x: _confidence()[x] for x in ("confidence", "level", "n_warnings")},
    """CAST(v AS DOUBLE) AS confidence, CASE WHEN v >= 0.75 THEN 'high' WHEN v >= 0.5 THEN 'medium' ELSE 'low' END AS level, CAST(w AS INT) AS n_warnings""",
)
SQL["e12_parse_confidence"] = f"""{cte("section")}, b AS (SELECT id, key_points AS k, CAST(target_words // 50 AS INT) % 20 AS n, CAST(target_words // 50 AS INT) % 7 AS p, CAST(target_words // 50 AS INT) % 15 AS s, CAST(target_words // 50 AS INT) % 17 AS t FROM section),
d AS (SELECT *, CASE WHEN k = 6 THEN 0 ELSE 12 + 4 * CAST(k > 0 AS INT) + 5 * CAST(k % 3 > 0 AS INT) + 4 * CAST(k + 2 >= 5 AS INT) - 5 * CAST(k = 5 AS INT) END + CASE WHEN n = 0 THEN 0 ELSE 18 + 10 * CAST(2 * p >= n AS INT) + 12 * CAST(10 * s >= 7 * n AS INT) + 10 * CAST(10 * t >= 8 * n AS INT) END + 5 * (k % 5) AS points,
 CASE WHEN k = 6 THEN 1 ELSE CAST(k % 3 = 0 AS INT) + CAST(k + 2 < 5 AS INT) + CAST(k = 5 AS INT) END + CASE WHEN n = 0 THEN 1 ELSE CAST(2 * p < n AS INT) + CAST(10 * s < 7 * n AS INT) + CAST(10 * t < 8 * n AS INT) END + CAST(k % 5 < 2 AS INT) AS w FROM b)
SELECT id, least(points, 100) / CAST(100 AS DOUBLE) AS confidence, CASE WHEN points >= 75 THEN 'high' WHEN points >= 50 THEN 'medium' ELSE 'low' END AS level, CAST(w AS INT) AS n_warnings FROM d"""

project(
    "y52_is_blind_bid", "section", lambda: {"blind": F.coalesce(rec.is_blind_bid(F.when(c("key_points") == 0, '{"notice": {"blind_bid": true, "x": 1}}').when(c("key_points") == 1, '{"notice": {"blind_bid": "true"}}').when(c("key_points") == 2, '{"notice": {"blind_bid": false}}').when(c("key_points") == 3, "{").when(c("key_points") == 4, '{"blind_bid": true}')), F.lit(False))},
    "key_points = 0 AS blind",
)
project(
    "y51_anonymous_cover", "section", lambda: {"n": F.size(_cover()), "kept": F.array_join(F.array_sort(F.map_keys(_cover())), "|"), "name": _cover()["name"]},
    "CAST(CASE WHEN key_points < 3 THEN 2 ELSE 1 END AS INT) AS n, CASE WHEN key_points < 3 THEN 'blind_bid|name' ELSE 'blind_bid' END AS kept, CASE WHEN key_points < 3 THEN name END AS name",
)


def _cover():
    return rec.anonymous_cover(F.when(c("key_points") < 3, F.create_map(F.lit("name"), c("name"), F.lit("bidder_name"), c("kind"), F.lit("company_name"), c("kind"), F.lit("blind_bid"), F.lit("x"))))


project("y11_item_text", "chunk", lambda: {"digest": F.md5(rec.item_text(c("folder"), F.lit(None).cast("string"), c("text")))}, f"md5({trim('folder || chr(10) || chr(10) || text')}) AS digest")
project(
    "y12_item_block", "chunk", lambda: {"digest": F.md5(rec.item_block(F.concat(F.lit("t"), c("id").cast("string")), F.lit("r"), c("text"), F.when(c("n_chars") > 500, "a/b"), c("folder")))},
    f"md5('[来源：' || folder || '/' || CASE WHEN n_chars > 500 THEN 'a/b' ELSE 't' || CAST(id AS STRING) END || ']' || chr(10) || {trim(chr(39) + '【t' + chr(39) + ' || CAST(id AS STRING) || ' + chr(39) + '】' + chr(39) + ' || chr(10) || ' + chr(39) + 'r' + chr(39) + ' || chr(10) || chr(10) || text')}) AS digest",
)
project("e33_full_text", "section", lambda: {"text": rec.full_text(F.array(c("name"), F.lit(" "), F.when(c("key_points") > 2, c("kind"))))}, "name || CASE WHEN key_points > 2 THEN chr(10) || kind ELSE '' END AS text")
project(
    "c25_changed_fields", "section",
    lambda: {"fields": F.array_join(rec.changed_fields(F.create_map(F.lit("a"), c("name"), F.lit("b"), F.lit("5")), F.create_map(F.lit("b"), F.when(c("key_points") > 2, "5.0").otherwise("6"), F.lit("a"), F.when(c("key_points") != 1, c("name")), F.lit("c"), c("kind"), F.lit("d"), F.lit("")), {"a": "x", "b": "y", "c": "x"}), "|")},
    "CASE WHEN key_points > 2 THEN 'x' ELSE 'y|x' END AS fields",
)
