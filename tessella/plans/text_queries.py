"""Queries over the text functions that other operators are made of, each with SQL of its own."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import chapters as ch
from ..functions import text as tx
from ..operators import retrieval, trees
from .inputs import cte, given, table

QUERIES, SQL = {}, {}
c = F.col

_SPACE = r"[\s\x{3000}\x{a0}\x{85}\x{0b}]"
_N = r"[\s\x{3000}\x{a0}\x{85}\x{0b}，,。；;：:（）()\[\]【】\-—_/]"
norm = lambda x: f"regexp_replace({x}, '{_N}', '', 'g')"
trim = lambda x: f"regexp_replace({x}, '^{_SPACE}+|{_SPACE}+$', '', 'g')"


def project(name: str, source: str, columns, sql: str, with_: str = "") -> None:
    """A query that projects columns from a stand-in; sql is the select list over it."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return given(spark, sf_dir, source).select("id", *(x.alias(n) for n, x in columns().items()))

    QUERIES[name] = run
    SQL[name] = f"{cte(source)}{with_} SELECT id, {sql} FROM {source}"


def query(name: str, sql: str):
    def add(f):
        QUERIES[name], SQL[name] = f, sql
        return f

    return add


# --- phrases -----------------------------------------------------------------------------------------------------
_PHRASES = ["完全响应招标文件要求", "满足采购文件规定", "GANTT_DATA", "质量与进度", "工期为 90 天", ""]
_VERBS = "['完全响应', '实质性响应', '完全满足', '满足', '符合', '响应']"
_CHAPTER = "content || CASE kind WHEN 1 THEN '本方案满足招标文件要求。' WHEN 2 THEN '谈判；完全满足' WHEN 3 THEN '响应了采购文件' ELSE '' END"


def _answers():
    extra = F.when(c("kind") == 1, "本方案满足招标文件要求。").when(c("kind") == 2, "谈判；完全满足").when(c("kind") == 3, "响应了采购文件").otherwise("")
    return F.concat("content", extra)


project(
    "i04_phrase_covered", "chapter", lambda: {f"p{i}": tx.phrase_covered(_answers(), F.lit(p)) for i, p in enumerate(_PHRASES)},
    f"""list_aggregate(list_transform({_VERBS}, lambda v: contains({norm(_CHAPTER)}, v || '招标文件要求')), 'bool_or') OR (contains({norm(_CHAPTER)}, '招标文件')
      AND regexp_matches({norm(_CHAPTER)} || ({_CHAPTER}), '完全响应|实质性响应|完全满足|满足|符合|响应|无偏离|不低于')) AS p0,
    list_aggregate(list_transform({_VERBS}, lambda v: contains({norm(_CHAPTER)}, v || '采购文件规定')), 'bool_or') OR (contains({norm(_CHAPTER)}, '采购文件')
      AND regexp_matches({norm(_CHAPTER)} || ({_CHAPTER}), '完全响应|实质性响应|完全满足|满足|符合|响应|无偏离|不低于')) AS p1,
    contains({_CHAPTER}, 'GANTT_DATA') OR contains({norm(_CHAPTER)}, 'GANTTDATA') AS p2, contains({norm(_CHAPTER)}, '质量与进度') AS p3, contains({norm(_CHAPTER)}, '工期为90天') AS p4, TRUE AS p5""",
)


def _phrases_covered(spark, sf_dir):
    rows = given(spark, sf_dir, "chapter").select("id", F.coalesce(_answers(), F.lit("")).alias("text")).withColumn("normal", tx.normalize_for_match(c("text")))
    return rows.select("id", *(tx.phrase_covered_in(c("text"), c("normal"), F.lit(p)).alias(f"p{i}") for i, p in enumerate(_PHRASES)))


QUERIES["i04_phrase_covered"] = _phrases_covered
QUERIES["i05_element_covered"] = lambda spark, sf_dir: given(spark, sf_dir, "requirement").select("id", F.size(F.filter(tx.split_mandatory_elements(c("elements")), lambda e: ~tx.phrase_covered(c("title"), e))).alias("n_missing"))
SQL["i05_element_covered"] = f"{cte('requirement')} SELECT id, CAST(len(list_filter(string_split(elements, '|'), lambda e: NOT contains({norm('title')}, {norm('e')}))) AS INT) AS n_missing FROM requirement"
project(
    "i06_compliance_phrase", "note", lambda: {"says": tx.is_compliance_phrase(F.concat(F.when(c("id") % 3 == 0, "应满足").when(c("id") % 3 == 1, "须说明").otherwise("符合"), F.when(c("id") % 2 == 0, "文件中全部条款").otherwise("之")))},
    "id % 3 <> 1 AND id % 2 = 0 AS says",
)
_WORDS = "list_filter(list_transform(string_split(name, ' '), lambda w: trim(w)), lambda w: length(w) BETWEEN 2 AND 10)"
project(
    "i07_core_variants", "section", lambda: {"variants": F.array_join(tx.keyword_core_variants(c("title")), "|")},
    """CASE title WHEN '工程概况' THEN '工程概况|概况' WHEN '质量目标' THEN '质量目标' WHEN '施工方案' THEN '施工方案|方案|施工' WHEN '项目特点' THEN '项目特点|特点' WHEN '组织机构' THEN '组织机构'
      WHEN '服务范围' THEN '服务范围' WHEN '安全目标措施' THEN '安全目标措施|安全目标' WHEN '设备安装调试' THEN '设备安装调试' ELSE '项目总结|总结' END AS variants""",
)
project(
    "i08_keyword_in_headings", "section", lambda: {"covered": tx.keyword_covered_in_headings(F.array(c("title"), F.lit("3.2 特点分析")), F.when(c("key_points") < 3, "施工方案管理").when(c("key_points") < 5, "项目特点").otherwise("安全"))},
    "CASE WHEN key_points < 3 THEN title = '施工方案' WHEN key_points < 5 THEN TRUE ELSE title = '安全目标措施' END AS covered",
)
_CANDIDATES = rf"""list_filter(list_prepend(title, list_transform(string_split_regex(keyword, '[,，;；、/]+'), lambda w: trim(w))) || list_filter(string_split_regex(title, '[（）()\[\]【】、，,；;：:\s]+'), lambda w: length(w) BETWEEN 2 AND 10), lambda w: length({norm("w")}) >= 2)"""
project("i09_coverage_candidates", "requirement", lambda: {"n": F.size(tx.coverage_candidates(c("title"), c("keyword")))}, f"CAST(list_unique(list_transform({_CANDIDATES}, lambda w: {norm('w')})) AS INT) AS n")
project(
    "i10_matched_candidates", "requirement", lambda: {"n": F.size(tx.matched_candidates(F.concat(F.lit("Brand#1 "), F.upper("title"), F.lit("red")), tx.coverage_candidates(c("title"), c("keyword"))))},
    f"CAST(list_unique(list_filter(list_transform({_CANDIDATES}, lambda w: {norm('w')}), lambda w: contains({norm(repr('Brand#1 ') + ' || upper(title) || ' + repr('red'))}, w))) AS INT) AS n",
)

# --- headings and paragraphs ---------------------------------------------------------------------------------------
_LINES = "string_split(content || chr(10) || '1.2 Scope of work' || chr(10) || '（三）质量' || chr(10) || '第二章 总则；', chr(10))"
_HEAD = rf"""(SELECT list(CASE WHEN starts_with(s, '#') THEN nullif({trim("regexp_replace(s, '^#+', '')")}, '') WHEN s <> '' AND length(s) < 60 AND NOT regexp_matches(s, '[。；;！!]$') AND regexp_matches(s, '{tx.HEADING_LINE}') THEN s END) FROM (SELECT {trim("unnest(" + _LINES + ")")} AS s) x)"""


def _lined():
    return F.concat("content", F.lit("\n1.2 Scope of work\n（三）质量\n第二章 总则；"))


project("i11_line_as_heading", "chapter", lambda: {"n": F.size(F.filter(F.transform(tx.split_lines(_lined()), tx.line_as_heading), lambda h: h.isNotNull()))}, f"CAST(len(list_filter({_HEAD}, lambda x: x IS NOT NULL)) AS INT) AS n")
project("i12_headings", "chapter", lambda: {"heads": F.md5(F.array_join(tx.headings(_lined()), "|"))}, f"md5(array_to_string(list_filter({_HEAD}, lambda x: x IS NOT NULL), '|')) AS heads")
project(
    "d12_title_scope_match", "section", lambda: {"same": tx.title_scope_match(F.concat(F.lit("2、"), c("title")), F.when(c("key_points") < 4, "目标").otherwise("施工方案")), "short": tx.title_scope_match(c("title"), F.lit("目标"))},
    "CASE WHEN key_points < 4 THEN FALSE ELSE title = '施工方案' END AS same, FALSE AS short",
)
_PARAS = rf"""list_filter(list_transform(string_split_regex(content, '\n{_SPACE}*\n'), lambda b: array_to_string(list_filter(list_transform(string_split(b, chr(10)), lambda x: {trim("x")}), lambda x: x <> '' AND NOT starts_with(x, '#')), chr(10))), lambda b: b <> '')"""
project("i14_body_paragraphs", "chapter", lambda: {"n": F.size(tx.body_paragraphs(c("content"))), "digest": F.md5(F.array_join(tx.body_paragraphs(c("content")), "|"))}, f"CAST(len({_PARAS}) AS INT) AS n, md5(array_to_string({_PARAS}, '|')) AS digest")
_OPEN = rf"regexp_replace(regexp_replace({trim('note')}, '^[-*+]\s+', ''), '^\d+[.、]\s+', '')"
project(
    "i15_paragraph_opening", "note", lambda: {"opening": tx.paragraph_opening(c("note")), "listed": tx.paragraph_opening(F.concat(F.lit("- 本工程采用甲类"), c("id").cast("string"), F.lit("，乙")))},
    f"CASE WHEN length({norm(f'substring({_OPEN}, 1, 5)')}) >= 3 THEN {norm(f'substring({_OPEN}, 1, 5)')} ELSE '' END AS opening, CASE WHEN length('采用甲类' || CAST(id AS STRING)) <= 9 AND length(CAST(id AS STRING)) <= 0 THEN '' ELSE '本工程采用' END AS listed",
)

# --- facts, places, spacing ------------------------------------------------------------------------------------------
project(
    "i19_fact_pairs", "note", lambda: {"pairs": F.array_join(F.transform(tx.fact_pairs(F.concat(F.lit("主变容量：50台；线路 为 12km。\n"), F.lit("编号: N"), c("id").cast("string"))), lambda p: F.concat(p["key"], F.lit("="), p["value"])), "|")},
    "'主变容量=50台|线路=12km|编号=N' || CAST(id AS STRING) AS pairs",
)
project(
    "i20_location_parts", "section", lambda: {"parts": F.array_join(tx.location_parts(F.when(c("key_points") < 3, F.concat(F.lit("四川省成都市"), c("folder"))).when(c("key_points") == 3, " 上海市 ")), "|")},
    "CASE WHEN key_points < 3 THEN '四川省|成都市|四川省成都市' || folder WHEN key_points = 3 THEN '上海市' ELSE '' END AS parts",
)
_SPACED = "replace(content, '　', ' ')"
project(
    "i21_ai_spacing", "chapter", lambda: {"clean": F.md5(tx.normalize_ai_spacing(F.concat("content", F.lit(" 工期 90 天 ok　　ok"))))},
    r"""md5(regexp_replace(regexp_replace(regexp_replace(replace(content || ' 工期 90 天 ok　　ok', '　', ' '), ' {2,}', ' ', 'g'), '([\x{4e00}-\x{9fff}]) ([A-Za-z0-9])', '\1\2', 'g'), '([A-Za-z0-9]) ([\x{4e00}-\x{9fff}])', '\1\2', 'g')) AS clean""",
)
_BODY = rf"regexp_replace({trim('text')}, '{_SPACE}+', ' ', 'g')"
_SENTENCE = rf"regexp_extract({_BODY}, '^([^。；;！!？?\n]*)[。；;！!？?\n]', 1)"
_CUT = f"CASE WHEN length({_SENTENCE}) > 8 THEN substring({_BODY}, 1, length({_SENTENCE}) + 1) ELSE substring({_BODY}, 1, 36) END"
project("i26_topic_snippet", "chunk", lambda: {"topic": tx.topic_snippet(c("text"))}, f"CASE WHEN length({_CUT}) > 36 THEN regexp_replace(substring({_CUT}, 1, 35), '{_SPACE}+$', '') || '…' ELSE {_CUT} END AS topic")
_EVIDENCE = "CASE WHEN contains(text, 'the') THEN 'the' WHEN contains(text, 'de') THEN 'de' END"
project(
    "i31_evidence_snippet", "chunk", lambda: {"evidence": tx.evidence_snippet(c("text"), F.array(F.lit(""), F.lit("the"), F.lit("de")))},
    f"coalesce({trim(f'substring(text, greatest(strpos(text, {_EVIDENCE}) - 60, 1), strpos(text, {_EVIDENCE}) + length({_EVIDENCE}) + 60 - greatest(strpos(text, {_EVIDENCE}) - 60, 1))')}, '') AS evidence",
)
project("i33_is_goal", "section", lambda: {"goal": ch.is_goal(c("title"))}, "contains(title, '目标') AND NOT regexp_matches(title, '措施|保证|方案|计划|组织|方法') AND regexp_matches(title, '质量|工期|进度|造价|成本|安全|文明|项目目标') AS goal")
project("i34_is_overview", "section", lambda: {"overview": ch.is_overview(c("title"))}, "regexp_matches(title, '概况|简介|项目特点|工程特点|背景|规模|环境|条件') AND NOT regexp_matches(title, '措施|保证|方案|计划|组织|方法|应对|对策|解决') AS overview")
project("i35_is_descriptive", "section", lambda: {"descriptive": ch.is_descriptive(F.concat("title", F.when(c("key_points") == 0, "保证措施").otherwise("")))}, "title IN ('质量目标', '工程概况', '项目特点') AND key_points <> 0 AS descriptive")
project(
    "i42_catalog_level", "section", lambda: {"level": tx.catalog_level(_entry())["level"], "title": tx.catalog_level(_entry())["title"]},
    """CASE key_points WHEN 0 THEN 1 WHEN 1 THEN 1 WHEN 2 THEN 1 WHEN 3 THEN 2 WHEN 4 THEN 3 WHEN 5 THEN 2 END AS level, CASE WHEN key_points < 6 THEN name END AS title""",
)


def _entry():
    """A catalogue line of each form."""
    forms = ["（一）{}。", "第3章 {}", "二、{}；", "4. {}", "4.1.2 {}", "   {}", "{}"]
    out = F.lit(None).cast("string")
    for i, form in enumerate(forms):
        before, after = form.split("{}")
        out = F.when(c("key_points") == i, F.concat(F.lit(before), c("name"), F.lit(after))).otherwise(out)
    return out


project(
    "i69_meta_line", "note", lambda: {"key": tx.meta_line(_meta())["key"], "value": tx.meta_line(_meta())["value"]},
    "CASE WHEN id % 3 = 0 THEN 'source' END AS key, CASE WHEN id % 3 = 0 THEN title || ': x' END AS value",
)


def _meta():
    return F.when(c("id") % 3 == 0, F.concat(F.lit("  # Source : "), c("title"), F.lit(": x "))).when(c("id") % 3 == 1, F.concat(F.lit("#Source: "), c("title"))).otherwise(F.concat(F.lit("# "), c("title")))


project("y24_match_tokens", "chunk", lambda: {"n": F.size(tx.match_tokens(c("text")))}, r"CAST(list_unique(regexp_extract_all(text, '[\x{4e00}-\x{9fff}]{2,8}|[A-Za-z0-9]{2,}')) AS INT) AS n")
project(
    "l10_is_complex", "section", lambda: {"complex": ch.retrieval_route(c("title"), c("score"), c("target_words"), c("key_points"), F.lit(False))["mode"] == "deep"},
    "title NOT IN ('质量目标', '工程概况', '项目特点') AND (score >= 5 OR target_words >= 1800 OR key_points >= 4 OR (title = '施工方案' AND score >= 3)) AS complex",
)

# --- vocabulary, order -------------------------------------------------------------------------------------------------
_SYNONYMS = [("almond", 0, ["antique", "rosy"]), ("metallic", 1, ["steel"]), ("bluish", 2, ["blue", "navy"])]


@query("i25_expand_tokens", f"""{cte("requirement")}, s AS (SELECT * FROM (VALUES ('almond', 0, ['antique', 'rosy']), ('metallic', 1, ['steel']), ('bluish', 2, ['blue', 'navy'])) v(key, pos, words)),
t AS (SELECT id, unnest(ts) AS term FROM (SELECT id, regexp_extract_all(title, '[A-Za-z0-9]{{2,}}') AS ts FROM requirement) x),
e AS (SELECT t.id, t.term, s.pos, s.key, s.words, (t.term = s.key OR list_contains(s.words, t.term)) AS exact FROM t JOIN s ON t.term = s.key OR list_contains(s.words, t.term)
  OR (length(t.term) >= 3 AND (contains(s.key, t.term) OR contains(t.term, s.key)) AND abs(length(t.term) - length(s.key)) <= 2)),
k AS (SELECT * FROM e WHERE exact OR (id, term) NOT IN (SELECT (id, term) FROM e WHERE exact)),
a AS (SELECT id, term AS w FROM t UNION SELECT id, key FROM k UNION SELECT id, unnest(words) FROM k)
SELECT id, array_to_string(list_sort(list(w)), '|') AS terms FROM a GROUP BY id""")
def expand_tokens(spark, sf_dir):
    synonyms = spark.createDataFrame(_SYNONYMS, "key string, pos int, words array<string>")
    rows = given(spark, sf_dir, "requirement").select("id", tx.tokens(c("title")).alias("terms"))
    return retrieval.expand_tokens(rows, synonyms).select("id", F.array_join(F.array_sort("terms"), "|").alias("terms"))


_TREE = f"""{cte("node").replace("WITH ", "WITH RECURSIVE ")}, w AS (SELECT id, id AS root, [sort_order] AS p, [id] AS q FROM node WHERE parent_id IS NULL OR parent_id NOT IN (SELECT id FROM node)
UNION ALL SELECT n.id, w.root, list_append(w.p, n.sort_order), list_append(w.q, n.id) FROM node n JOIN w ON n.parent_id = w.id),
k AS (SELECT id, root, list_transform(range(1, len(p) + 1), lambda i: lpad(CAST(p[i] AS STRING), 6, '0') || '|' || q[i]) AS key FROM w)"""


@query("f08_leaves_in_order", f"{_TREE} SELECT id, CAST(row_number() OVER (ORDER BY key) AS BIGINT) AS place FROM k WHERE id NOT IN (SELECT parent_id FROM node WHERE parent_id IS NOT NULL)")
def leaves_in_order(spark, sf_dir):
    nodes = given(spark, sf_dir, "node")
    ranked = trees.depth_first(trees.walk(nodes))
    return trees.leaves(ranked, nodes).select("id", "place")


@query("f09_root_ancestor", f"{_TREE} SELECT id, root FROM k")
def root_ancestor(spark, sf_dir):
    return trees.walk(given(spark, sf_dir, "node")).select("id", c("root_id").alias("root"))


@query("l06_semantic_rank", """WITH q AS (SELECT label AS query_id, embedding AS e FROM embeddings QUALIFY row_number() OVER (PARTITION BY label ORDER BY vec_id) = 1),
s AS (SELECT query_id, vec_id AS id, round(list_dot_product(list_transform(embedding, lambda x: CAST(x AS DOUBLE)), list_transform(e, lambda x: CAST(x AS DOUBLE))), 6) AS score FROM embeddings, q)
SELECT query_id, id, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM s) x WHERE rank <= 20""")
def semantic_rank(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings")
    firsts = vectors.groupBy("label").agg(F.min_by("embedding", "vec_id").alias("embedding")).withColumnRenamed("label", "query_id")
    return retrieval.cosine(vectors.select(c("vec_id").alias("id"), "embedding"), firsts, 20).select("query_id", "id", "rank")
