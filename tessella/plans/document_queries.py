"""Queries over running text, content rules with inputs of their own, projects, outlines and the chain of retrieval."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import prose
from ..functions import text as tx
from ..operators import outlines, projects, retrieval, rules
from .inputs import cte, given, table
from .text_queries import norm, trim

QUERIES, SQL = {}, {}
c = F.col


def project(name: str, source: str, columns, sql: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return given(spark, sf_dir, source).select("id", *(x.alias(n) for n, x in columns().items()))

    QUERIES[name] = run
    SQL[name] = f"{cte(source)} SELECT id, {sql} FROM {source}"


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


# --- prose ---------------------------------------------------------------------------------------------------------
_CONTRACT = "content || '成都电力有限公司，合同号:AB-1234/x；统一社会信用代码：91510100MA61'"
project(
    "i47_scrub_identity", "chapter", lambda: {"clean": F.md5(prose.scrub_identity(F.concat("content", F.lit("成都电力有限公司，合同号:AB-1234/x；统一社会信用代码：91510100MA61"))))},
    rf"""md5(regexp_replace({reduce(lambda t, w: f"replace({t}, '{w}', '投标人')", prose.COMPANY_MARKERS, rf"regexp_replace(regexp_replace(regexp_replace({_CONTRACT}, '[\x{{4e00}}-\x{{9fff}}]{{2,20}}(?:有限公司|股份有限公司|集团)', '投标人', 'g'), '(?:统一社会信用代码|组织机构代码)\s*[:：]?\s*[A-Z0-9]{{10,}}', '投标人', 'g'), '(?:联系人|项目经理)\s*[:：]\s*[\x{{4e00}}-\x{{9fff}}]{{2,4}}', '投标人', 'g')")},
      '(?:合同编号|合同号)\s*[:：]?\s*[A-Za-z0-9\-_/]{{4,}}', '合同编号：类似工程', 'g')) AS clean""",
)
project(
    "i49_passage_score", "chunk", lambda: {"score": F.round(prose.passage_score(c("text"), F.array(*map(F.lit, ("the", "de", "la", "")))), 6)},
    "round((CAST(contains(text, 'the') AS INT) + CAST(contains(text, 'de') AS INT) + CAST(contains(text, 'la') AS INT)) / greatest(least(length(text) / CAST(600 AS DOUBLE), 1.5), 0.5), 6) AS score",
)
project(
    "i50_reference_query", "section", lambda: {"asked": prose.reference_query(c("title"), F.concat(F.lit("  "), c("name")), F.repeat(c("kind"), 20), F.when(c("key_points") > 2, F.array("folder", "kind", F.lit(""))))},
    "title || ' ' || name || ' ' || substring(repeat(kind, 20), 1, 160) || CASE WHEN key_points > 2 THEN ' ' || folder || ' ' || kind ELSE '' END AS asked",
)
QUERIES["i52_cliches"] = lambda spark, sf_dir: given(spark, sf_dir, "chapter").select("id", F.explode(prose.cliches(F.concat("content", F.lit("不难发现，闭环管理赋能，不难发现")))).alias("h")).select("id", "h.*")
SQL["i52_cliches"] = f"""{cte("chapter")}, w AS (SELECT w, CASE WHEN list_contains(['{"', '".join(prose.FILLERS)}'], w) THEN w || '，' ELSE w END AS s FROM (SELECT unnest(['{"', '".join(prose.CLICHES)}']) AS w) x),
p AS (SELECT id, w, s, string_split(content || '不难发现，闭环管理赋能，不难发现', s) AS ps FROM chapter, w WHERE contains(content || '不难发现，闭环管理赋能，不难发现', s)),
k AS (SELECT id, w, s, ps, unnest(range(1, len(ps))) AS i FROM p)
SELECT id, CAST(list_sum(list_transform(ps[1:i], lambda x: length(x))) + (i - 1) * length(s) AS INT) AS start, CAST(list_sum(list_transform(ps[1:i], lambda x: length(x))) + i * length(s) AS INT) AS "end", w AS phrase FROM k"""


def _sentences(x: str) -> str:
    """I54 in DuckDB."""
    parts = "string_split(s, '，')"
    cut = f"CASE WHEN length(s) > 120 AND len({parts}) > 2 THEN array_to_string({parts}[1:len({parts}) // 2], '，') || '。' || chr(10) || array_to_string({parts}[len({parts}) // 2 + 1:], '，') ELSE s END"
    block = f"array_to_string(list_transform(list_filter(list_transform(string_split(regexp_replace(b, '([。；])', '\\1' || chr(1), 'g'), chr(1)), lambda x: {trim('x')}), lambda s: s <> ''), lambda s: {cut}), '')"
    return f"array_to_string(list_transform(string_split({x}, chr(10) || chr(10)), lambda b: {block}), chr(10) || chr(10))"


def _wordy():
    return F.concat(F.when(c("kind") == 4, "总体而言，助力").otherwise(""), "content", F.lit("\n\n众所周知，"), F.repeat(F.lit("采用甲，确保乙"), 30), F.lit("。综上所述，"), F.repeat(F.lit("采用丙，"), 3), F.lit("；顶层设计 A B"))


_WORDY = "CASE WHEN kind = 4 THEN '总体而言，助力' ELSE '' END || content || chr(10) || chr(10) || '众所周知，' || repeat('采用甲，确保乙', 30) || '。综上所述，' || repeat('采用丙，', 3) || '；顶层设计 A B'"
project("i54_long_sentences", "chapter", lambda: {"split": F.md5(prose.split_long_sentences(_wordy()))}, f"md5({_sentences(_WORDY)}) AS split")


def _humanized(x: str) -> str:
    for old, new in prose.REPLACED.items():
        x = f"replace({x}, '{old}', '{new}')"
    for w in prose.OPENERS:
        for mark in "，。":
            x = f"regexp_replace(replace({x}, chr(10) || '{w}{mark}', chr(10)), '^{w}{mark}', '')"
            for said in dict.fromkeys((f"。{w}{mark}", f"。{w}，", f"。{w}。")):
                x = f"replace({x}, '{said}', '。')"
    for w in prose.FILLERS:
        x = f"regexp_replace(replace({x}, chr(10) || '{w}，', chr(10)), '^{w}，', '')"
    return x


_STEPS = "h0 AS (SELECT id, " + _humanized(_WORDY) + " AS t FROM chapter)" + "".join(
    f""", h{i + 1} AS (SELECT id, CASE WHEN len(string_split(t, '{w}')) > 5 THEN array_to_string(list_transform(string_split(t, '{w}'), lambda p, k: CASE WHEN k = 1 THEN '' WHEN k <= 4 THEN '{w}' WHEN k % 2 = 1 THEN '{a}' ELSE '{b}' END || p), '') ELSE t END AS t FROM h{i})"""
    for i, (w, (a, b)) in enumerate(prose.VARIED.items())
)
QUERIES["i53_humanize"] = lambda spark, sf_dir: given(spark, sf_dir, "chapter").select("id", F.md5(prose.humanize(_wordy())).alias("said"))
SQL["i53_humanize"] = rf"""{cte("chapter")}, {_STEPS}, s AS (SELECT id, {_sentences("t")} AS t FROM h3)
SELECT id, md5(regexp_replace(regexp_replace(regexp_replace(replace(t, '　', ' '), ' {{2,}}', ' ', 'g'), '([\x{{4e00}}-\x{{9fff}}]) ([A-Za-z0-9])', '\1\2', 'g'), '([A-Za-z0-9]) ([\x{{4e00}}-\x{{9fff}}])', '\1\2', 'g')) AS said FROM s"""
project(
    "c23_negated", "section", lambda: {"negated": prose.negated(F.concat("kind", F.lit("措施，"), _negation(), F.lit("措施")), F.lit("措施"))},
    "key_points IN (1, 2, 3, 5) AS negated",
)


def _negation():
    forms = ["写", "不写具体的", "不涉及任何", "勿用各类的", "不涉及任何一种的", "不得写入各种", "写"]
    return reduce(lambda out, i: F.when(c("key_points") == i, forms[i]).otherwise(out), range(len(forms)), F.lit(""))


project("i48_passages", "chunk", lambda: {"n": F.size(prose.passages(c("text"))), "digest": F.md5(F.array_join(prose.passages(c("text")), "|"))}, "1")
project("g04_reference_snippets", "chunk", lambda: {"picked": F.md5(prose.reference_snippets(c("text"), F.array(*map(F.lit, ("the", "quality", "de", "la")))))}, "1")
for _name in ("i48_passages", "g04_reference_snippets"):  # folds: held against plain Python in tests
    del SQL[_name]
project(
    "i13_trim_to_scope", "chapter", lambda: {"kept": F.md5(rules.trimmed_to_scope(c("content"), c("title"), F.array(F.lit("服务范围"))))},
    rf"md5(CASE WHEN title <> '服务范围' AND contains(content, chr(10) || '# 服务范围') THEN regexp_replace(split_part(content, chr(10) || '# 服务范围', 1), '[\s\x{{3000}}]+$', '') ELSE content END) AS kept",
)


# --- content rules with inputs of their own ------------------------------------------------------------------------
def _judged(spark, sf_dir, only, **columns):
    chapters = given(spark, sf_dir, "chapter")
    return rules.findings(chapters.withColumns(columns), "chapter", (only,)).select("id", "message")


def rule_query(name: str, check: str, columns, sql: str) -> None:
    QUERIES[name] = lambda spark, sf_dir: _judged(spark, sf_dir, check, **columns())
    SQL[name] = f"{cte('chapter')} SELECT id, message FROM (SELECT id, {sql} AS message FROM chapter) x WHERE message IS NOT NULL"


rule_query(
    "q36_mandatory_elements", "mandatory_elements", lambda: {"elements": F.lit("质量及进度|the|GANTT_DATA")},
    f"""CASE WHEN len(list_filter(['质量及进度', 'the', 'GANTT_DATA'], lambda e: NOT contains({norm('content')}, replace(e, '_', '')))) > 0
    THEN '必备要素未覆盖：' || array_to_string(list_filter(['质量及进度', 'the', 'GANTT_DATA'], lambda e: NOT contains({norm('content')}, replace(e, '_', ''))), ', ') END""",
)
_HIT = "CAST(contains(content, '施工方案') OR contains(content, '全方位闭环') AS INT) + CAST(regexp_matches(content, 'the|quality|qual|qua|lit|qu|al|it') AS INT) + CAST(regexp_matches(content, 'abcdefgh|abcd|efgh|abc|def|ab|cd|ef|gh') AS INT)"
rule_query(
    "q19_plan_coverage", "plan_coverage", lambda: {"key_points": F.array(F.lit("施工方案 全方位闭环"), F.lit("the quality"), F.lit(" "), F.lit("abcdefgh"))},
    f"CASE WHEN {trim('content')} <> '' AND ({_HIT}) < 3 THEN '写作规划要点覆盖不足：仅命中 ' || CAST({_HIT} AS STRING) || '/3，请按规划补写未覆盖要点' END",
)
_ASKED = [("质量管理", "进度，the", "", 0), ("赋能", "", "全方位|闭环", 0), ("工期", "", "", 1)]
_ASKED_TYPE = "array<struct<title:string,keyword:string,elements:string,is_risk:int>>"
rule_query(
    "q20_scoring_coverage", "scoring_coverage", lambda: {"requirements": F.array(*(F.struct(*(F.lit(x) for x in r)) for r in _ASKED)).cast(_ASKED_TYPE)},
    f"""unnest(list_filter([
      CASE WHEN NOT regexp_matches({norm('content')}, '质量管理|质量|进度|the') THEN '评分项「质量管理」关键词未在正文中体现' END,
      CASE WHEN NOT contains({norm('content')}, '全方位') OR NOT contains({norm('content')}, '闭环') THEN '评分覆盖不足「赋能」：缺少必备要素 ' || array_to_string(list_filter(['全方位', '闭环'], lambda e: NOT contains({norm('content')}, e)), ', ') WHEN NOT contains({norm('content')}, '赋能') THEN '评分项「赋能」关键词未在正文中体现' END,
      CASE WHEN NOT contains({norm('content')}, '工期') THEN '刚性风险项「工期」关键词未在正文中体现' WHEN NOT regexp_matches(content, '完全响应|完全满足|实质性响应|无偏离|满足要求|符合要求|不低于') THEN '刚性风险项「工期」缺少实质性响应表述（如完全响应/满足要求/不低于等）' END], lambda x: x IS NOT NULL))""",
)
rule_query(
    "q17_global_facts", "global_facts",
    lambda: {
        "location": F.lit("四川省成都市"), "facts": F.lit("主变容量：50台；线路长度为 12km"),
        "content": F.concat("content", F.when(c("kind") == 0, "工程位于：上海市浦东新区，主变容量合计50台，主变容量增至60台。").when(c("kind") == 1, "建设地点为成都市，线路长度为12km").when(c("kind") == 2, "坐落于绵阳市；线路长度约 9.5 km").otherwise("")),
    },
    """unnest(CASE kind WHEN 0 THEN ['建设地点疑似不一致：全局为「四川省成都市」，正文出现「上海市」', '全局事实冲突「主变容量」：应为 50台，正文出现 60台'] WHEN 2 THEN ['全局事实冲突「线路长度」：应为 12km，正文出现 9.5 km'] END)""",
)


# --- repeats between chapters and segments ---------------------------------------------------------------------------
_QUOTED = "(SELECT conv_id, turn, coalesce(lag(text) OVER (PARTITION BY conv_id ORDER BY turn), '') || ' ' || text AS text FROM conversations) c"


def _turns(spark, sf_dir, names):
    """Turns that quote the one before."""
    before = F.lag("text").over(W.partitionBy("conv_id").orderBy("turn"))
    return table(spark, sf_dir, "conversations").select(c("conv_id").alias(names[0]), c("turn").alias("ord"), F.concat(F.coalesce(before, F.lit("")), F.lit(" "), "text").alias("content"))


@query("l15_cross_chapter_overlap", f"""WITH t AS (SELECT conv_id, turn, length({trim("text")}) AS n, regexp_replace({trim("text")}, '[^A-Za-z]', '', 'g') AS p FROM {_QUOTED} WHERE text IS NOT NULL),
a AS (SELECT conv_id, turn, p, list_filter(range(1, length(p) - 8, 5), lambda x: TRUE) AS places FROM t WHERE n >= 120 AND length(p) >= 40),
b AS (SELECT conv_id, turn, p, list_filter(places, lambda x, i: (i - 1) % greatest(1, len(places) // 50) = 0)[1:50] AS places FROM a WHERE len(places) >= 8),
w AS (SELECT conv_id, turn, len(places) AS size, substring(p, CAST(unnest(places) AS INT), 10) AS gram FROM b),
h AS (SELECT w.conv_id, w.turn, size, count(*) AS hits FROM w WHERE EXISTS (SELECT 1 FROM t WHERE t.conv_id = w.conv_id AND t.turn < w.turn AND t.n >= 80 AND contains(t.p, w.gram)) GROUP BY ALL)
SELECT conv_id, turn, round(hits / CAST(size AS DOUBLE), 6) AS ratio FROM h WHERE hits / CAST(size AS DOUBLE) >= 0.18""")
def cross_chapter_overlap(spark, sf_dir):
    found = projects.overlap(_turns(spark, sf_dir, ("project_id",)), keep="[^A-Za-z]")
    return found.select(c("project_id").alias("conv_id"), c("ord").alias("turn"), F.round("ratio", 6).alias("ratio"))


@query("f22_segment_stitches", f"""WITH t AS (SELECT conv_id, turn, {trim("text")} AS s FROM {_QUOTED} WHERE {trim("coalesce(text, '')")} <> ''),
p AS (SELECT conv_id, turn, regexp_replace(substring(s, 1, 220), '[^A-Za-z]', '', 'g') AS h, regexp_replace(lag(right(s, 220)) OVER (PARTITION BY conv_id ORDER BY turn), '[^A-Za-z]', '', 'g') AS b FROM t),
g AS (SELECT conv_id, turn, list_distinct(list_transform(range(1, length(h) - 6), lambda i: substring(h, i, 8))) AS h, list_distinct(list_transform(range(1, length(b) - 6), lambda i: substring(b, i, 8))) AS b FROM p WHERE b IS NOT NULL AND length(b) >= 8 AND length(h) >= 8)
SELECT conv_id, turn, round(len(list_intersect(h, b)) / CAST(len(h) AS DOUBLE), 6) AS ratio FROM g WHERE len(list_intersect(h, b)) / CAST(len(h) AS DOUBLE) >= 0.18""")
def segment_stitches(spark, sf_dir):
    found = projects.stitches(_turns(spark, sf_dir, ("chapter_id",)), keep="[^A-Za-z]")
    return found.select(c("chapter_id").alias("conv_id"), c("ord").alias("turn"), F.round("ratio", 6).alias("ratio"))


# --- projects --------------------------------------------------------------------------------------------------------
_PROJECT = """leaf AS (SELECT o_custkey AS project_id, 'L' || CAST(o_orderkey AS STRING) AS id, o_orderpriority || CASE WHEN o_orderstatus = 'P' THEN ' promo' ELSE '' END AS title, o_orderkey AS so,
  CASE WHEN o_orderstatus = 'P' THEN NULL ELSE coalesce((SELECT string_agg(p_name, ' ' ORDER BY l_linenumber, p_partkey) FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_orderkey = o_orderkey), '') || CASE WHEN o_orderpriority = '2-HIGH' THEN ' 满足要求 TODO' ELSE '' END END AS content FROM orders),
req AS (SELECT DISTINCT o_custkey AS project_id, CAST(p_partkey AS STRING) AS id, p_name AS title, lower(split_part(p_type, ' ', 1)) AS keyword, p_name || '|' || split_part(p_name, ' ', 1) || '|' || p_type AS elements,
  CASE WHEN p_size > 40 THEN 1 ELSE 0 END AS is_risk, CASE WHEN p_size % 10 = 0 THEN 'ignored' ELSE 'pending' END AS status FROM orders JOIN lineitem ON o_orderkey = l_orderkey JOIN part ON l_partkey = p_partkey)"""


def _project(spark, sf_dir):
    orders, part = table(spark, sf_dir, "orders"), table(spark, sf_dir, "part")
    items = table(spark, sf_dir, "lineitem").join(part, c("l_partkey") == c("p_partkey"))
    by = items.groupBy("l_orderkey").agg(F.to_json(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey"))), lambda x: x["l_partkey"].cast("string"))).alias("requirement_ids"), F.array_sort(F.collect_list(F.struct("l_linenumber", "p_partkey", "p_name"))).alias("names"))
    said = F.concat(F.coalesce(F.array_join(c("names")["p_name"], " "), F.lit("")), F.when(c("o_orderpriority") == "2-HIGH", " 满足要求 TODO").otherwise(""))
    leaves = orders.join(by, c("o_orderkey") == c("l_orderkey"), "left").select(
        c("o_custkey").alias("project_id"), F.concat(F.lit("L"), c("o_orderkey").cast("string")).alias("id"), F.concat("o_orderpriority", F.when(c("o_orderstatus") == "P", " promo").otherwise("")).alias("title"),
        c("o_orderkey").alias("sort_order"), F.when(c("o_orderstatus") != "P", said).alias("content"), "requirement_ids",
    )
    word = F.substring_index("p_name", " ", 1)
    named = part.select(
        "p_partkey", c("p_partkey").cast("string").alias("id"), c("p_name").alias("title"), F.lower(F.substring_index("p_type", " ", 1)).alias("keyword"), F.concat_ws("|", "p_name", word, "p_type").alias("elements"),
        F.lit(None).cast("string").alias("risk_hint"), F.when(c("p_size") > 40, 1).otherwise(0).alias("is_risk"), F.when(c("p_size") % 10 == 0, "ignored").otherwise("pending").alias("status"),
    ).distinct()
    pairs = orders.join(table(spark, sf_dir, "lineitem"), c("o_orderkey") == c("l_orderkey")).select(c("o_custkey").alias("project_id"), "l_partkey").distinct()  # keys alone are made distinct
    asked = pairs.join(named, c("l_partkey") == c("p_partkey")).drop("l_partkey", "p_partkey")
    return leaves, asked


def _pieces(leaves):
    return leaves.select("project_id", F.concat_ws("\n", "title", "content").alias("text"))


_MISSING = f"""e AS (SELECT project_id, id, title, unnest(list_distinct(list_filter(list_transform(string_split(elements, '|'), lambda x: trim(x)), lambda x: x <> ''))) AS e FROM req WHERE status <> 'ignored'),
lack AS (SELECT project_id, id, title, array_to_string(list_sort(list(e)), ', ') AS missing FROM e WHERE NOT EXISTS (SELECT 1 FROM leaf WHERE leaf.project_id = e.project_id AND contains({norm("title || chr(10) || coalesce(content, '')")}, {norm("e.e")})) GROUP BY ALL)""".replace("title || chr(10)", "leaf.title || chr(10)")


@query("d15_mandatory_elements", f"WITH {_PROJECT}, {_MISSING} SELECT project_id, id, missing FROM lack")
def mandatory_elements(spark, sf_dir):
    leaves, asked = _project(spark, sf_dir)
    return projects.mandatory_elements(_pieces(leaves), asked).select("project_id", "id", F.array_join("missing", ", ").alias("missing"))


_CS = "list_filter(list_prepend(title, list_prepend(keyword, list_filter(string_split(title, ' '), lambda w: length(w) BETWEEN 2 AND 10))), lambda w: length(w) >= 2)"
_RESPONSE = f"""rigid AS (SELECT project_id, id, title, {_CS} AS cs FROM req WHERE is_risk = 1),
said AS (SELECT project_id, title || chr(10) || coalesce(content, '') AS t FROM leaf),
near AS (SELECT DISTINCT r.project_id, r.id FROM (SELECT project_id, id, unnest(cs) AS w FROM rigid) r JOIN said s ON s.project_id = r.project_id AND contains(s.t, '满足要求') AND contains(s.t, r.w)
  AND length(s.t) - strpos(reverse(s.t), reverse(r.w)) + 1 + 120 >= strpos(s.t, '满足要求') + 3)"""


@query("d14_substantial_response", f"WITH {_PROJECT}, {_RESPONSE} SELECT project_id, id, (project_id, id) IN (SELECT (project_id, id) FROM near) AS responded FROM rigid")
def substantial_response(spark, sf_dir):
    leaves, asked = _project(spark, sf_dir)
    return projects.substantial_response(_pieces(leaves), asked).select("project_id", "id", "responded")


_TITLED = """kw AS (SELECT DISTINCT 'L' || CAST(l_orderkey AS STRING) AS id, lower(split_part(p_type, ' ', 1)) AS k FROM lineitem JOIN part ON l_partkey = p_partkey),
bare AS (SELECT leaf.id, leaf.project_id, leaf.title, count(*) AS n FROM leaf JOIN kw USING (id) GROUP BY ALL HAVING count(*) FILTER (contains(replace(replace(leaf.title, ' ', ''), '-', ''), k)) = 0)"""


@query("d08_title_keywords", f"WITH {_PROJECT}, {_TITLED} SELECT id, CAST(n AS INT) AS n FROM bare")
def title_keywords(spark, sf_dir):
    leaves, asked = _project(spark, sf_dir)
    return projects.title_keywords(leaves, asked).select("id", F.size("missing").alias("n"))


_SCORED = f"""cand AS (SELECT project_id, title, {norm("title")} AS t, list_distinct(list_filter(list_transform({_CS}, lambda x: {norm("x")}), lambda x: length(x) >= 2)) AS cs FROM req WHERE status <> 'ignored'),
form AS (SELECT DISTINCT project_id, unnest(list_append(cs, t)) AS f FROM cand),
held AS (SELECT project_id, list(f) AS fs FROM form WHERE EXISTS (SELECT 1 FROM leaf WHERE leaf.project_id = form.project_id AND contains({norm("leaf.title || chr(10) || coalesce(content, '')")}, f)) GROUP BY project_id),
score AS (SELECT project_id, title, coalesce(list_contains(fs, t), FALSE) AS exact, len(list_filter(cs, lambda x: coalesce(list_contains(fs, x), FALSE))) AS n FROM cand LEFT JOIN held USING (project_id))"""
_BOUND = """bound AS (SELECT 'L' || CAST(l_orderkey AS STRING) AS id, lower(split_part(p_type, ' ', 1)) AS k, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) AS pos FROM lineitem JOIN part ON l_partkey = p_partkey),
words AS (SELECT id, string_agg(k, '/' ORDER BY pos) AS ks FROM (SELECT id, k, min(pos) AS pos FROM bound GROUP BY id, k) x GROUP BY id)"""


@query("x05_project_findings", f"""WITH {_PROJECT}, {_MISSING}, {_RESPONSE}, {_TITLED}, {_SCORED}, {_BOUND},
size AS (SELECT project_id, sum(length(content)) AS total, count(*) AS k FROM leaf WHERE {trim("coalesce(content, '')")} <> '' GROUP BY project_id),
f AS (SELECT DISTINCT project_id, 'project_template_residue' AS check_id, 'TODO' AS m FROM leaf WHERE contains(content, 'TODO')
UNION ALL SELECT project_id, 'project_mandatory', title || missing FROM lack
UNION ALL SELECT project_id, 'project_scoring_coverage', title || CASE WHEN n = 1 THEN 'partial' ELSE 'missing' END FROM score WHERE NOT exact AND n < 2
UNION ALL SELECT bare.project_id, 'project_title_keywords', bare.title || ks FROM bare JOIN words USING (id)
UNION ALL SELECT DISTINCT project_id, 'project_substantial_response', title FROM rigid WHERE (project_id, id) NOT IN (SELECT (project_id, id) FROM near)
UNION ALL SELECT project_id, 'project_length_balance', leaf.title || CAST(length(content) AS STRING) FROM leaf JOIN size USING (project_id) WHERE k >= 2 AND {trim("coalesce(content, '')")} <> '' AND length(content) / CAST(total AS DOUBLE) > 0.4)
SELECT check_id, count(*) AS n FROM (SELECT DISTINCT * FROM f) x GROUP BY check_id""")
def project_findings(spark, sf_dir):
    leaves, asked = _project(spark, sf_dir)
    return projects.project_findings(leaves, asked).groupBy("check_id").agg(F.count("*").alias("n"))


@query("e31_combined_text", """SELECT conv_id AS project_id, md5(string_agg(role || chr(10) || coalesce(text, ''), chr(10) || chr(10) ORDER BY turn)) AS digest FROM conversations GROUP BY conv_id""")
def combined_text(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").select(c("conv_id").alias("project_id"), c("turn").alias("id"), c("turn").alias("sort_order"), c("role").alias("title"), c("text").alias("content"))
    return projects.combined_text(turns).select("project_id", F.md5("text").alias("digest"))


# --- outlines --------------------------------------------------------------------------------------------------------
_WALK = """w AS (SELECT id, [lpad(CAST(sort_order AS STRING), 6, '0') || '|' || id] AS p, is_leaf FROM tree WHERE parent_id IS NULL OR parent_id NOT IN (SELECT id FROM tree)
UNION ALL SELECT n.id, list_append(w.p, lpad(CAST(n.sort_order AS STRING), 6, '0') || '|' || n.id), n.is_leaf FROM tree n JOIN w ON n.parent_id = w.id WHERE w.is_leaf = 0)"""
_LEAFY = "CASE WHEN id LIKE 'C%' OR id IN ('N3', 'N7', 'R4') THEN 1 ELSE 0 END"
_RECURSIVE = cte("node").replace("WITH ", "WITH RECURSIVE ")


@query("f07_reorder_outline", f"{_RECURSIVE}, tree AS (SELECT *, {_LEAFY} AS is_leaf FROM node), {_WALK} SELECT id, CAST(len(p) AS INT) AS level, row_number() OVER (ORDER BY p) AS sort_order FROM w")
def reorder_outline(spark, sf_dir):
    return outlines.reordered(given(spark, sf_dir, "node").withColumn("is_leaf", F.expr(_LEAFY)))


@query("f19_heading_levels", f"""{_RECURSIVE}, e AS (SELECT *, NOT (id IN ('N1', 'N2', 'R0') OR sort_order = 3) AS emits FROM node), w AS (SELECT id, CAST(emits AS INT) AS level, emits FROM e WHERE parent_id IS NULL OR parent_id NOT IN (SELECT id FROM node)
UNION ALL SELECT e.id, w.level + CAST(e.emits AS INT), e.emits FROM e JOIN w ON e.parent_id = w.id) SELECT id, level FROM w WHERE emits""")
def heading_levels(spark, sf_dir):
    return outlines.heading_levels(given(spark, sf_dir, "node").withColumn("emits", F.expr("NOT (id IN ('N1', 'N2', 'R0') OR sort_order = 3)")))


_CHILDREN = "child AS (SELECT 'C' || CAST(o_custkey AS STRING) AS leaf_id, o_orderkey AS pos, CASE WHEN o_orderstatus = 'P' THEN ' ' ELSE o_orderpriority || ' part' END AS title, CASE WHEN o_orderpriority = '5-LOW' THEN NULL ELSE o_orderpriority END AS brief FROM orders)"


def _children(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    title = F.when(c("o_orderstatus") == "P", " ").otherwise(F.concat("o_orderpriority", F.lit(" part")))
    return o.select(F.concat(F.lit("C"), c("o_custkey").cast("string")).alias("leaf_id"), c("o_orderkey").alias("pos"), title.alias("title"), F.when(c("o_orderpriority") != "5-LOW", c("o_orderpriority")).alias("brief"))


@query("m21_valid_children", f"""WITH {_CHILDREN}, f AS (SELECT leaf_id, pos, CASE WHEN trim(title) = '' THEN '第 ' || CAST(row_number() OVER (PARTITION BY leaf_id ORDER BY pos) AS STRING) || ' 个子节点缺少标题' WHEN coalesce(brief, '') = '' THEN '子节点「' || trim(title) || '」缺少写作要点' END AS fault FROM child),
n AS (SELECT leaf_id, count(*) AS n, count(*) FILTER (fault IS NULL) AS fine, string_agg(fault, '|' ORDER BY pos) AS faults FROM f GROUP BY leaf_id)
SELECT leaf_id, concat_ws('|', CASE WHEN n < 3 THEN '子节点数量 ' || CAST(n AS STRING) || ' 少于 3' END, CASE WHEN n > 4 THEN '子节点数量 ' || CAST(n AS STRING) || ' 超过 4' END, faults, CASE WHEN fine < 3 THEN '有效子节点不足' END) AS issues FROM n""")
def valid_children(spark, sf_dir):
    return outlines.valid_children(_children(spark, sf_dir)).select("leaf_id", F.array_join("issues", "|").alias("issues"))


@query("m20_split_leaves", f"""{_RECURSIVE}, {_CHILDREN}, k AS (SELECT leaf_id, title, row_number() OVER (PARTITION BY leaf_id ORDER BY pos) AS k, count(*) OVER (PARTITION BY leaf_id) AS n FROM child WHERE leaf_id IN (SELECT id FROM node)),
base AS (SELECT id, parent_id, sort_order, CASE WHEN id LIKE 'C%' THEN 1 ELSE 0 END AS is_leaf, CASE WHEN id LIKE 'C%' AND sort_order > 1 THEN sort_order * 700 END AS words FROM node),
p AS (SELECT k.*, b.sort_order AS so, CASE WHEN words IS NULL THEN n WHEN words // n >= 400 THEN n ELSE least(n, greatest(3, words // 400)) END AS parts, words FROM k JOIN base b ON b.id = k.leaf_id),
tree AS (SELECT id, parent_id, sort_order, CASE WHEN id IN (SELECT leaf_id FROM p) THEN 0 ELSE is_leaf END AS is_leaf, CASE WHEN id NOT IN (SELECT leaf_id FROM p) THEN words END AS words FROM base
UNION ALL SELECT leaf_id || '.' || CAST(k AS STRING), leaf_id, so + k, 1, CASE WHEN words IS NULL THEN 800 WHEN words // n >= 400 THEN words // n ELSE greatest(400, words // parts) END FROM p WHERE k <= parts),
{_WALK} SELECT w.id, CAST(len(p) AS INT) AS level, row_number() OVER (ORDER BY p) AS sort_order, CAST(tree.words AS INT) AS target_words FROM w JOIN tree ON w.id = tree.id""")
def split_leaves(spark, sf_dir):
    nodes = given(spark, sf_dir, "node")
    nodes = nodes.withColumn("is_leaf", F.expr("CASE WHEN id LIKE 'C%' THEN 1 ELSE 0 END")).withColumn("target_words", F.expr("CASE WHEN id LIKE 'C%' AND sort_order > 1 THEN sort_order * 700 END"))
    return outlines.split_leaves(nodes, _children(spark, sf_dir)).select("id", "level", "sort_order", "target_words")


@query("d21_assign_requirements", """WITH child AS (SELECT l_orderkey AS leaf_id, l_linenumber AS pos, p_name AS text, CASE WHEN l_linenumber = 2 THEN [CAST(l_suppkey AS STRING), '1'] ELSE [] END AS claimed FROM lineitem JOIN part ON l_partkey = p_partkey),
req AS (SELECT DISTINCT l_orderkey AS leaf_id, CAST(l_suppkey AS STRING) AS rid, s_name || ' ' || (SELECT min(p_name) FROM part WHERE p_partkey = l_suppkey) AS text FROM lineitem JOIN supplier ON l_suppkey = s_suppkey),
done AS (SELECT DISTINCT c.leaf_id, c.pos, r.rid FROM child c JOIN req r ON c.leaf_id = r.leaf_id AND list_contains(c.claimed, r.rid)),
s AS (SELECT r.leaf_id, r.rid, c.pos, len(list_intersect(list_distinct(regexp_extract_all(c.text, '[A-Za-z0-9]{2,}')), list_distinct(regexp_extract_all(coalesce(r.text, ''), '[A-Za-z0-9]{2,}')))) AS n FROM req r JOIN child c ON c.leaf_id = r.leaf_id WHERE (r.leaf_id, r.rid) NOT IN (SELECT (leaf_id, rid) FROM done)),
b AS (SELECT *, row_number() OVER (PARTITION BY leaf_id, rid ORDER BY n DESC, pos) AS r FROM s)
SELECT leaf_id, pos, rid AS requirement_id FROM done UNION ALL SELECT leaf_id, pos, rid FROM b WHERE r = 1""")
def assign_requirements(spark, sf_dir):
    part, items = table(spark, sf_dir, "part"), table(spark, sf_dir, "lineitem")
    none = F.array().cast("array<string>")
    children = items.join(part, c("l_partkey") == c("p_partkey")).select(
        c("l_orderkey").alias("leaf_id"), c("l_linenumber").alias("pos"), c("p_name").alias("text"), F.when(c("l_linenumber") == 2, F.array(c("l_suppkey").cast("string"), F.lit("1"))).otherwise(none).alias("claimed")
    )
    named = table(spark, sf_dir, "supplier").join(part, c("p_partkey") == c("s_suppkey"), "left").select("s_suppkey", F.concat("s_name", F.lit(" "), "p_name").alias("text"))
    asked = items.join(named, c("l_suppkey") == c("s_suppkey")).select(c("l_orderkey").alias("leaf_id"), c("l_suppkey").cast("string").alias("requirement_id"), "text")
    return outlines.assigned_requirements(children, asked)


# --- retrieval -------------------------------------------------------------------------------------------------------
_TOKENS = r"regexp_extract_all({}, '[\x{{4e00}}-\x{{9fff}}]{{2,}}|[A-Za-z0-9]{{2,}}')"
_ASK = "q AS (SELECT item_id AS query_id, text, CASE CAST(item_id % 5 AS INT) WHEN 0 THEN NULL WHEN 1 THEN 'nowhere' ELSE (SELECT list_sort(list(DISTINCT source)) FROM documents)[CAST(item_id % 3 AS INT) + 1] END AS folder FROM benchmark)"
_ITEM = "item AS (SELECT source AS folder, doc_id AS id, lang AS title, substring(text, 1, 80) AS resume, text AS content, n_chars AS so FROM documents)"


def _queries(spark, sf_dir):
    docs, asked = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    names = docs.agg(F.array_sort(F.collect_set("source")).alias("names"))
    k = c("item_id")
    folder = F.when(k % 5 == 1, "nowhere").when(k % 5 != 0, F.get("names", (k % 3).cast("int")))
    return asked.crossJoin(F.broadcast(names)).select(k.alias("query_id"), "text", folder.alias("folder"))  # one row


def _items(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(c("source").alias("folder"), c("doc_id").alias("id"), c("lang").alias("title"), F.substring("text", 1, 80).alias("resume"), c("text").alias("content"), c("n_chars").alias("sort_order"))


def _okapi(corpus: str, asked: str) -> str:
    return f"""stats AS (SELECT folder, count(*) AS n, avg(len(ws)) AS mean_length FROM {corpus} GROUP BY folder),
tf AS (SELECT folder, id, dl, term, count(*) AS tf FROM (SELECT folder, id, len(ws) AS dl, unnest(ws) AS term FROM {corpus}) x GROUP BY ALL),
df AS (SELECT tf.folder, term, ln(n - count(*) + 0.5) - ln(count(*) + 0.5) AS idf FROM tf JOIN stats USING (folder) GROUP BY tf.folder, term, n),
mean AS (SELECT folder, avg(idf) AS m FROM df GROUP BY folder),
idf AS (SELECT folder, term, CASE WHEN idf < 0 THEN 0.25 * m ELSE idf END AS idf FROM df JOIN mean USING (folder)),
okapi AS (SELECT query_id, id, sum(qtf * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / mean_length))) AS score
  FROM (SELECT query_id, folder, term, count(*) AS qtf FROM (SELECT query_id, folder, unnest(ws) AS term FROM {asked}) y GROUP BY ALL) q JOIN idf USING (folder, term) JOIN tf USING (folder, term) JOIN stats USING (folder) GROUP BY query_id, id)"""


_LEXICAL = f"""{_ASK}, {_ITEM}, ask AS (SELECT query_id, folder, {_TOKENS.format("text")} AS ws FROM q WHERE folder IS NOT NULL),
words AS (SELECT folder, id, {_TOKENS.format("concat_ws(' ', title, resume, content)")} AS ws, so, content, {_TOKENS.format("title")} AS tt, {_TOKENS.format("resume")} AS tr, {_TOKENS.format("content")} AS tc FROM item),
{_okapi("words", "ask")},
pair AS (SELECT query_id, a.ws AS qs, w.* FROM ask a JOIN words w USING (folder)),
boost AS (SELECT query_id, id, so, 3 * len(list_intersect(list_distinct(qs), tt)) + 2 * len(list_intersect(list_distinct(qs), tr)) + len(list_intersect(list_distinct(qs), tc)) + CAST(len(list_filter(list_distinct(qs), lambda w: contains(content, w))) > 0 AS INT) AS b FROM pair),
scored AS (SELECT query_id, id, so, round(b + coalesce(score, 0), 6) AS score FROM boost LEFT JOIN okapi USING (query_id, id)),
lex AS (SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, so, id) AS rank FROM scored WHERE score > 0)"""


@query("l02_lexical_items", f"WITH {_LEXICAL} SELECT query_id, id, score, CAST(rank AS INT) AS rank FROM lex WHERE rank <= 5")
def lexical_items(spark, sf_dir):
    return retrieval.lexical_items(_items(spark, sf_dir), _queries(spark, sf_dir).where("folder IS NOT NULL")).where("rank <= 5")


_VECTORS = "v AS (SELECT label % 3 AS folder, vec_id AS id, embedding FROM embeddings), a AS (SELECT label AS query_id, label % 3 AS folder, embedding AS e FROM embeddings QUALIFY row_number() OVER (PARTITION BY label ORDER BY vec_id) = 1)"
_SEMANTIC = f"""{_VECTORS}, sem AS (SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM (SELECT query_id, id, round(list_dot_product(list_transform(embedding, lambda x: CAST(x AS DOUBLE)), list_transform(e, lambda x: CAST(x AS DOUBLE))), 6) AS score FROM a JOIN v USING (folder)) x)"""


def _semantic(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings").select((c("label") % 3).alias("folder"), c("vec_id").alias("id"), "label", "embedding")
    firsts = vectors.groupBy(c("label").alias("query_id"), "folder").agg(F.min_by("embedding", "id").alias("embedding"))
    return retrieval.semantic_items(vectors, firsts)


@query("l07_semantic_items", f"WITH {_SEMANTIC} SELECT query_id, id, score, CAST(rank AS INT) AS rank FROM sem WHERE rank <= 10")
def semantic_items(spark, sf_dir):
    return _semantic(spark, sf_dir).where("rank <= 10")


@query("g03_hybrid_items", f"""WITH {_SEMANTIC}, o AS (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY id) AS rank FROM sem),
f AS (SELECT sem.query_id, sem.id, round(1.0 / (60 + CAST(o.rank AS DOUBLE)) + 1.0 / (60 + CAST(sem.rank AS DOUBLE)), 9) AS score, o.rank AS r1, sem.rank AS r2 FROM sem JOIN o ON o.query_id = sem.query_id AND o.id = sem.id)
SELECT query_id, id, score, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, r1, r2, id) AS rank FROM f) x WHERE rank <= 5""")
def hybrid_items(spark, sf_dir):
    """The semantic ranking fused with one by id."""
    semantic = _semantic(spark, sf_dir)
    return retrieval.hybrid(semantic.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy("id"))), semantic, 5)


def _found(spark, sf_dir):
    """Items in the folders that sort before the last one, chunks in the last."""
    docs = table(spark, sf_dir, "documents")
    last = docs.agg(F.max("source").alias("last"))
    both = docs.crossJoin(F.broadcast(last))  # one row
    items = both.where("source < last").select(c("source").alias("folder"), c("doc_id").alias("id"), c("lang").alias("title"), F.lit("").alias("resume"), c("text").alias("content"), c("n_chars").alias("sort_order"))
    chunks = both.where("source = last").select(c("source").alias("folder"), c("doc_id").alias("id"), F.concat(F.lit("f"), c("doc_id").cast("string")).alias("source"), "text", c("lang").alias("prefix"), F.lit(None).cast("string").alias("keywords"))
    return retrieval.retrieve(_queries(spark, sf_dir), items, chunks, 5)


_RETRIEVED = f"""{_LEXICAL.replace("substring(text, 1, 80) AS resume", "'' AS resume").replace("FROM documents)" + ", ask", "FROM documents WHERE source < (SELECT max(source) FROM documents))" + ", ask")},
ask2 AS (SELECT * FROM ask WHERE folder = (SELECT max(source) FROM documents)), words2 AS (SELECT source AS folder, doc_id AS id, {_TOKENS.format("text || ' ' || lang")} AS ws FROM documents WHERE source = (SELECT max(source) FROM documents)),
{_okapi("words2", "ask2").replace("stats", "stats2").replace("tf AS", "tf2 AS").replace("FROM tf ", "FROM tf2 ").replace("JOIN tf ", "JOIN tf2 ").replace("tf.folder", "tf2.folder").replace("df AS", "df2 AS").replace("FROM df ", "FROM df2 ").replace("mean AS", "mean2 AS").replace("JOIN mean ", "JOIN mean2 ").replace("idf AS (SELECT folder, term, CASE", "idf2 AS (SELECT folder, term, CASE").replace("JOIN idf ", "JOIN idf2 ").replace("okapi AS", "okapi2 AS")},
lex2 AS (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, id) AS rank FROM okapi2 WHERE round(score, 6) > 0),
hit AS (SELECT query_id, id, rank FROM lex WHERE rank <= 5 UNION ALL SELECT query_id, id, rank FROM lex2 WHERE rank <= 5)"""


@query("l12_retrieve", f"""WITH {_RETRIEVED} SELECT query_id, id, CAST(rank AS INT) AS rank, md5('[来源：' || CASE WHEN source < (SELECT max(source) FROM documents) THEN source ELSE source || '/f' || CAST(doc_id AS STRING) END || ']' || chr(10) || {trim("lang || chr(10) || text")}) AS digest FROM hit JOIN documents ON id = doc_id""")
def retrieve(spark, sf_dir):
    return _found(spark, sf_dir)[0].select("query_id", "id", "rank", F.md5("text").alias("digest"))


@query("l11_retrieve_reason", f"WITH {_RETRIEVED} SELECT query_id, CASE WHEN folder IS NULL THEN 'no_folder' WHEN folder NOT IN (SELECT source FROM documents) THEN 'knowledge_empty' WHEN query_id NOT IN (SELECT query_id FROM hit) THEN 'no_match' END AS reason FROM q")
def retrieve_reason(spark, sf_dir):
    return _found(spark, sf_dir)[1]
