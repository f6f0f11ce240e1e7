"""Queries over the text functions, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import chapters as ch
from ..functions import text as tx
from .inputs import cte, given, table

QUERIES, SQL = {}, {}

_NORM = r"[\s\x{3000}\x{a0}\x{85}\x{0b}，,。；;：:（）()\[\]【】\-—_/]"


def query(name: str, sql: str):
    def add(f):
        QUERIES[name], SQL[name] = f, sql
        return f

    return add


def project(name: str, source: str, columns, sql: str) -> None:
    """A query that projects columns from a stand-in; sql is the select list over it."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return given(spark, sf_dir, source).select("id", *(c.alias(n) for n, c in columns().items()))

    QUERIES[name] = run
    SQL[name] = f"{cte(source)} SELECT id, {sql} FROM {source}"


c = F.col
project("i01_normalize_for_match", "chunk", lambda: {"normal": F.md5(tx.normalize_for_match(c("text")))}, f"md5(regexp_replace(text, '{_NORM}', '', 'g')) AS normal")
project(
    "i02_split_keywords", "requirement", lambda: {"words": F.array_join(tx.split_keywords(c("keyword")), "|")},
    "array_to_string(list_filter(list_transform(string_split_regex(keyword, '[,，;；、/]+'), lambda x: trim(x)), lambda x: x <> ''), '|') AS words",
)
project(
    "i03_split_elements", "requirement", lambda: {"n": F.size(tx.split_mandatory_elements(c("elements")))},
    "CAST(len(list_filter(string_split_regex(elements, '[,，;；、/|]+'), lambda x: trim(x) <> '')) AS INT) AS n",
)

@query("i16_standard_core", f"""{cte("standard")} SELECT raw_code, regexp_replace(replace(replace(regexp_replace(upper(raw_code), '[\\s/]', '', 'g'), '—', '-'), '－', '-'), '-\\d{{4}}$', '') AS core FROM standard""")
def standard_core(spark, sf_dir):
    return given(spark, sf_dir, "standard").select("raw_code", tx.standard_core(c("raw_code")).alias("core"))


_CODE = r"(?i)(?:GB/?T?\s*[\d.]+(?:\s*[-—－]\s*\d{4})?|DL/?T?\s*[\d.]+(?:\s*[-—－]\s*\d{4})?)"
_CORE = "regexp_replace(replace(replace(regexp_replace(upper(x), '[\\s/]', '', 'g'), '—', '-'), '－', '-'), '-\\d{4}$', '')"
project(
    "i17_standard_codes", "note", lambda: {"codes": F.array_join(tx.standard_codes(c("note")), "|")},
    "'GB/T ' || CAST(50000 + id % 300 AS STRING) || '-2006' || CASE WHEN id % 700 >= 10 THEN '|DL ' || CAST(id % 700 AS STRING) || '.' ELSE '' END AS codes",
)
project("i22_solid_length", "chunk", lambda: {"n": tx.solid_length(c("text"))}, r"CAST(length(regexp_replace(text, '[\s\x{3000}\x{a0}\x{85}\x{0b}\x{1c}-\x{1f}]', '', 'g')) AS INT) AS n")
project("i23_text_hash", "chunk", lambda: {"hash": F.md5("text")}, "md5(text) AS hash")
project(
    "i24_tokens", "chunk", lambda: {"n": F.size(tx.tokens(c("text"))), "n_distinct": F.size(F.array_distinct(tx.tokens(c("text"))))},
    r"CAST(len(regexp_extract_all(text, '[\x{4e00}-\x{9fff}]{2,}|[A-Za-z0-9]{2,}')) AS INT) AS n, CAST(list_unique(regexp_extract_all(text, '[\x{4e00}-\x{9fff}]{2,}|[A-Za-z0-9]{2,}')) AS INT) AS n_distinct",
)
project(
    "i30_labeled_chunk", "chunk", lambda: {"labeled": F.md5(tx.labeled_chunk(c("text"), F.concat(F.lit("doc"), c("id").cast("string")), c("folder")))},
    r"md5('[来源：' || folder || '/doc' || CAST(id AS STRING) || ']' || chr(10) || regexp_replace(text, '^\s+|\s+$', '', 'g')) AS labeled",
)
project(
    "i32_chapter_type", "section", lambda: {"kind": ch.chapter_type(c("title")), "descriptive": ch.is_descriptive(c("title"))},
    "CASE WHEN title IN ('质量目标') THEN 'goal' WHEN title IN ('工程概况', '项目特点') THEN 'overview' ELSE 'construction' END AS kind, title IN ('质量目标', '工程概况', '项目特点') AS descriptive",
)
project(
    "i36_budget_weight", "section", lambda: {"weight": ch.word_budget_weight(c("title"))},
    """CAST(CASE WHEN title = '质量目标' THEN 0.5 WHEN title IN ('工程概况', '项目特点') THEN 0.65 WHEN contains(title, '服务范围') THEN 0.7
       WHEN contains(title, '组织机构') THEN 0.85 WHEN regexp_matches(title, '工艺|方案|措施|吊装|安装|调试|试验') THEN 1.15 ELSE 1.0 END AS DOUBLE) AS weight""",
)
project("i38_money_yuan", "note", lambda: {"total": F.aggregate(tx.money_yuan(c("note")), F.lit(0.0), lambda a, x: a + x)}, "CAST((id % 90 + 10.5) * 10000 + id % 9000 + 1000 AS DOUBLE) AS total")
project("i39_duration_days", "note", lambda: {"days": tx.duration_days(c("note"))}, r"CAST(regexp_extract(note, '(\d+)\s*(?:个日历日|(?:个)?日历天|日历日|天|日)', 1) AS INT) AS days")
project(
    "i40_chinese_number", "section", lambda: {"cn": tx.chinese_number(F.floor(c("target_words") / 50).cast("int"))},
    """(SELECT CASE WHEN n <= 0 THEN CAST(n AS STRING) WHEN n < 10 THEN d[n + 1] WHEN n = 10 THEN '十' WHEN n < 20 THEN '十' || d[n - 9]
        ELSE d[n // 10 + 1] || '十' || CASE WHEN n % 10 > 0 THEN d[n % 10 + 1] ELSE '' END END FROM (SELECT '〇一二三四五六七八九' AS d, CAST(target_words // 50 AS INT) AS n)) AS cn""",
)
project("i56_text_tokens", "chunk", lambda: {"tokens": tx.text_tokens(c("text"))}, "CAST(CASE WHEN length(text) = 0 THEN 0 ELSE greatest(1, floor(length(text) / CAST(0.6 AS DOUBLE))) END AS INT) AS tokens")
project(
    "i57_chapter_max_tokens", "section", lambda: {"most": tx.chapter_max_tokens(c("target_words"))},
    "CAST(CASE WHEN target_words = 0 THEN 4096 ELSE least(8000, greatest(4096, floor(target_words / CAST(0.6 AS DOUBLE)) + 500)) END AS INT) AS most",
)
project(
    "i58_word_count_display", "note", lambda: {"shown": tx.word_count_display(F.floor("amount").cast("int"))},
    "CASE WHEN floor(amount) >= 10000 THEN format('{:.2f}', CAST(floor(amount) AS DOUBLE) / CAST(10000 AS DOUBLE)) || '万字' ELSE CAST(CAST(floor(amount) AS INT) AS STRING) || '字' END AS shown",
)
project(
    "i59_capped", "chunk", lambda: {"cut": F.md5(tx.capped(c("text"), 1000, "……（已截断）"))},
    "md5(CASE WHEN length(text) > 1000 THEN substring(text, 1, 993) || '……（已截断）' ELSE text END) AS cut",
)
project("i61_mask_key", "section", lambda: {"masked": tx.mask_key(c("name"))}, "CASE WHEN name = '' THEN '' WHEN length(name) <= 8 THEN '****' ELSE left(name, 4) || '****' || right(name, 4) END AS masked")
project(
    "i62_safe_filename", "chunk", lambda: {"file": tx.safe_filename(F.substring("text", 1, 60), c("id").cast("string"))},
    r"""CAST(id AS STRING) || '_' || substring(regexp_replace(regexp_replace(substring(text, 1, 60), '[\\/:*?"<>|]', '_', 'g'), '^\s+|\s+$', '', 'g'), 1, 40) || '.md' AS file""",
)
project("i64_blind_bid", "section", lambda: {"blind": ch.blind_bid(F.concat(c("title"), F.when(c("key_points") == 3, "暗标").otherwise("")))}, "CASE WHEN key_points = 3 THEN TRUE END AS blind")
project("j02_day_label", "note", lambda: {"day": tx.day_label(c("note"))}, "CAST(id % 12 + 1 AS INT) AS day")
project("j05_target_pages", "section", lambda: {"pages": tx.bounded_int(c("target_words"), 10, 1200), "none": tx.bounded_int(c("name"), 10, 1200)}, "CAST(least(1200, greatest(10, target_words)) AS INT) AS pages, CAST(NULL AS INT) AS none")
project("j06_total_words", "section", lambda: {"words": tx.bounded_int(c("target_words") * 100, 3000, 500000)}, "CAST(least(500000, greatest(3000, target_words * 100)) AS INT) AS words")
project(
    "j07_scaled_words", "section", lambda: {"words": tx.scaled_words(c("target_words"), c("key_points") > 2)},
    "CAST(CASE WHEN key_points > 2 THEN greatest(200, round_even(target_words * CAST(0.6 AS DOUBLE), 0)) ELSE target_words END AS INT) AS words",
)
project(
    "k01_string_array", "section", lambda: {"n": F.size(tx.string_array(F.when(c("key_points") > 4, c("name")).otherwise(F.to_json(F.array("name", "folder")))))},
    "CAST(CASE WHEN key_points > 4 THEN 0 ELSE 2 END AS INT) AS n",
)
project(
    "k02_error_array", "section", lambda: {"errors": F.array_join(tx.error_array(F.when(c("key_points") > 4, c("name")).when(c("key_points") == 0, F.lit(" ")).otherwise(F.to_json(F.array("name", "folder")))), "|")},
    "CASE WHEN key_points > 4 THEN name WHEN key_points = 0 THEN '' ELSE name || '|' || folder END AS errors",
)
project(
    "l09_retrieval_route", "section", lambda: {k: ch.retrieval_route(c("title"), c("score"), c("target_words"), c("key_points"), c("followup"))[k] for k in ("mode", "top_k", "use_vector")},
    """CASE WHEN followup THEN 'plan_followup' WHEN title IN ('质量目标', '工程概况', '项目特点') THEN 'light'
       WHEN score >= 5 OR target_words >= 1800 OR key_points >= 4 OR (title = '施工方案' AND score >= 3) THEN 'deep' ELSE 'standard' END AS mode,
       CAST(CASE WHEN followup THEN 4 WHEN title IN ('质量目标', '工程概况', '项目特点') THEN 3
       WHEN score >= 5 OR target_words >= 1800 OR key_points >= 4 OR (title = '施工方案' AND score >= 3) THEN 8 ELSE 5 END AS INT) AS top_k,
       followup OR title NOT IN ('质量目标', '工程概况', '项目特点') AS use_vector""",
)
project("c18_skip_content_plan", "section", lambda: {"skip": ch.skip_content_plan(c("title"), c("target_words"))}, "title IN ('质量目标', '工程概况', '项目特点') OR (target_words > 0 AND target_words < 500) AS skip")
project("c19_should_segment", "section", lambda: {"segment": ch.should_segment(c("followup"), c("target_words"), c("key_points"))}, "NOT followup AND target_words >= 1800 AND key_points >= 4 AS segment")
project("y35_style_tier", "section", lambda: {"tier": ch.style_tier(F.when(c("key_points") == 1, " Rigorous ").when(c("key_points") == 2, c("name")))}, "CASE WHEN key_points = 1 THEN 'rigorous' ELSE 'balanced' END AS tier")
project(
    "h06_character_grams", "chunk", lambda: {"n": F.size(tx.character_grams(c("text"), 8, "[^A-Za-z]"))},
    "CAST((SELECT count(DISTINCT substring(pure, CAST(i AS INT), 8)) FROM (SELECT pure, unnest(generate_series(1, length(pure) - 7)) AS i FROM (SELECT regexp_replace(text, '[^A-Za-z]', '', 'g') AS pure) p) g) AS INT) AS n",
)


@query("i37_table_cells", """SELECT doc_id, CAST(sum(len(string_split(trim(regexp_replace(regexp_replace(trim(line), '^\\|', ''), '\\|$', '')), '|'))) AS BIGINT) AS cells
FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents) WHERE contains(line, '|') GROUP BY doc_id""")
def table_cells(spark, sf_dir):
    lines = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("line")).where(c("line").contains("|"))
    return lines.groupBy("doc_id").agg(F.sum(F.size(tx.table_cells(c("line")))).alias("cells"))


@query("j01_parsed_date", """SELECT event_id, strftime(ts, '%Y-%m-%d') AS day, CAST(date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) + 1 AS INT) AS start_day FROM events""")
def parsed_date(spark, sf_dir):
    said = F.when(c("event_id") % 2 == 0, F.date_format("ts", "yyyy/MM/dd HH:mm")).otherwise(F.date_format("ts", "yyyy.MM.dd"))
    day = tx.parsed_date(said)
    return table(spark, sf_dir, "events").select("event_id", F.date_format(day, "yyyy-MM-dd").alias("day"), (F.datediff(day, F.lit("2024-01-01").cast("date")) + 1).alias("start_day"))


@query("e20_message_tokens", """SELECT conv_id, CAST(greatest(0, CASE WHEN s = 0 THEN 0 ELSE greatest(1, floor(s / CAST(0.6 AS DOUBLE))) END) AS INT) AS system_tokens,
CAST(CASE WHEN u = 0 THEN 0 ELSE greatest(1, floor(u / CAST(0.6 AS DOUBLE))) END AS INT) AS user_tokens, messages, users
FROM (SELECT conv_id, coalesce(length(string_agg(CASE WHEN role = 'system' THEN text END, chr(10))), 0) AS s,
coalesce(length(string_agg(CASE WHEN role <> 'system' THEN text END, chr(10))), 0) AS u, count(*) AS messages, count(*) FILTER (role = 'user') AS users FROM conversations GROUP BY conv_id)""")
def message_tokens(spark, sf_dir):
    """Lengths of the texts joined by line feeds need no join of texts: their sum and the number of gaps."""
    n = F.length("text")
    joined = lambda cond: F.coalesce(F.sum(F.when(cond, n)) + F.greatest(F.count_if(cond) - 1, F.lit(0)), F.lit(0))
    est = lambda x: F.when(x == 0, 0).otherwise(F.greatest(F.lit(1), F.floor(x / 0.6).cast("int")))
    by = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(joined(c("role") == "system").alias("s"), joined(c("role") != "system").alias("u"), F.count("*").alias("messages"), F.count_if(c("role") == "user").alias("users"))
    return by.select("conv_id", est(c("s")).alias("system_tokens"), est(c("u")).alias("user_tokens"), "messages", "users")
