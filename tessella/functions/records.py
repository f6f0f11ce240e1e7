"""Records held as JSON or built into text: codecs and formatters, Column to Column, from built-in expressions only."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import chapters as ch
from . import prose
from . import text as tx

# Terms that a chapter's boundary must not or must hold.
GOAL_FORBIDDEN = ["措施", "保证", "方案", "计划", "组织", "方法", "工序", "检验频次", "工艺方法"]
OVERVIEW_FORBIDDEN = [*GOAL_FORBIDDEN, "我方将采取", "拟采用", "施工组织", "专项方案", "进度计划"]
CONSTRUCTION_HINTS = ["工序", "工艺", "控制", "要点", "参数", "质量", "安装", "调试", "验收", "措施"]
SPECIAL_TITLES = ["安装", "敷设", "调试", "专项", "施工方案"]


def _text(x: Column) -> Column:
    return tx.strip(F.coalesce(x, F.lit("")))


def writing_guidance(raw: Column) -> Column:
    """(brief, content_boundary, target_words, split_origin, style_tier) of a JSON object; anything else gives defaults. Words
    that are no whole number above zero are null. (K03)"""
    s = _text(raw)
    data = F.when(s.startswith("{"), F.from_json(s, "brief string, content_boundary string, target_words string, split_origin string, style_tier string"))
    words = data["target_words"].try_cast("int")
    return F.struct(
        _text(data["brief"]).alias("brief"), _text(data["content_boundary"]).alias("content_boundary"), F.when(words > 0, words).alias("target_words"),
        F.coalesce(~F.lower(data["split_origin"]).isin("false", "0", "", "null"), F.lit(False)).alias("split_origin"), ch.style_tier(data["style_tier"]).alias("style_tier"),
    )


def guidance_json(brief: Column, boundary: Column, words: Column, split_origin: Column, tier: Column) -> Column:
    """A JSON object; words only above zero and split_origin only where true are in it."""
    return F.to_json(
        F.struct(
            _text(brief).alias("brief"), _text(boundary).alias("content_boundary"), ch.style_tier(tier).alias("style_tier"), F.when(words > 0, words).alias("target_words"), F.when(split_origin, True).alias("split_origin")
        )
    )


def meta(raw: Column) -> Column:
    """A map of the values of a JSON object, as text; anything else: none."""
    return F.coalesce(F.from_json(raw, "map<string,string>"), F.create_map().cast("map<string,string>"))


def coerced_issues(raw: Column) -> Column:
    """A JSON list without nulls and blanks; a JSON string as a list of one; anything else: none."""
    s = _text(raw)
    listed = F.when(s.startswith("["), F.from_json(s, "array<string>"))
    single = F.when(s.startswith('"'), F.from_json(F.concat(F.lit("["), s, F.lit("]")), "array<string>"))
    found = F.coalesce(listed, single, F.array().cast("array<string>"))
    return F.filter(F.transform(F.array_compact(found), tx.strip), lambda x: x != "")


def merged_errors(raw: Column, extra: Column) -> Column:
    """Both lists as JSON, in order, each message once."""
    return F.to_json(F.array_distinct(F.concat(tx.error_array(raw), F.coalesce(extra, F.array().cast("array<string>")))))


def equal_values(old: Column, new: Column) -> Column:
    """Whether two values of a notice are the same: null and blank are alike, numbers compare as numbers."""
    a, b = _text(old), _text(new)
    x, y = a.try_cast("double"), b.try_cast("double")
    return F.when(x.isNotNull() & y.isNotNull(), x == y).otherwise(a == b)


def boundary_issues(title: Column, boundary: Column) -> Column:
    """What is wrong with a boundary for a chapter of that title."""
    s, kind = _text(boundary), ch.chapter_type(title)
    size = F.array(F.when(F.length(s) < 20, "content_boundary 过短（少于 20 字）"), F.when(F.length(s) > 200, "content_boundary 超过 200 字上限"))

    def forbidden(words: list[str], label: str) -> Column:
        return F.array(*(F.when(F.contains(s, F.lit(w)) & ~prose.negated(s, F.lit(w)), f"{label}章节 boundary 含禁止词「{w}」") for w in words))

    special = F.array(F.when(tx.contains_any(F.coalesce(title, F.lit("")), SPECIAL_TITLES) & ~tx.contains_any(s, CONSTRUCTION_HINTS), "专项/安装类章节 boundary 缺少工序或控制要点表述"))
    by_kind = F.when(kind == "goal", forbidden(GOAL_FORBIDDEN, "目标类")).when(kind == "overview", forbidden(OVERVIEW_FORBIDDEN, "概况类")).otherwise(special)
    return F.array_compact(F.concat(size, by_kind))


def catalog(text: Column) -> Column:
    """(title, level, sort_order) of the lines of a table of contents that have a level; others drop out."""
    found = F.filter(F.transform(tx.split_lines(text), tx.catalog_level), lambda x: x.isNotNull() & (x["title"] != ""))
    return F.transform(found, lambda x, i: F.struct(x["title"].alias("title"), x["level"].alias("level"), (i + 1).alias("sort_order")))


def clean_title(x: Column) -> Column:
    """A title without leaders, empty brackets, explanations and trailing clauses, 40 characters at most."""
    s = F.regexp_replace(F.regexp_replace(tx.strip(x), r"[…\.．]{2,}.*$", ""), "[.…]+$", "")
    s = F.regexp_replace(F.regexp_replace(s, r"(?U)[（(]\s*[）)]\s*$", ""), "^[ ：:.\\-—_]+|[ ：:.\\-—_]+$", "")

    def headed(t: Column) -> Column:
        head = lambda left: tx.strip(F.substring_index(t, left, 1))
        fits = lambda left: F.contains(t, F.lit(left)) & F.length(head(left)).between(2, 30)
        return F.when(fits("（"), head("（")).when(fits("("), head("(")).otherwise(t)

    def first_clause(t: Column) -> Column:
        return reduce(lambda out, m: F.when(F.contains(t, F.lit(m)) & (F.length(t) > 18), tx.strip(F.substring_index(t, m, 1))).otherwise(out), reversed("，,；;"), t)

    def listed(t: Column) -> Column:
        return F.when(F.contains(t, F.lit("、")) & (F.length(t) > 20) & ~tx.contains_any(t, ["（", "("]), tx.strip(F.substring_index(t, "、", 1))).otherwise(t)

    s = tx.let(tx.let(tx.let(s, headed), first_clause), listed)
    s = F.regexp_replace(s, "(要求内容全面|拟采取的措施|潜在问题的分析|为控制成本.*|应明确.*|等)$", "")
    s = F.regexp_replace(F.regexp_replace(s, "^[ 。.；;]+|[ 。.；;]+$", ""), "(管理)质量管理.*$", "$1")
    return F.when(F.length(s) > 40, F.regexp_replace(F.substring(s, 1, 40), r"(?U)\s+$", "")).otherwise(s)


def requirement_block(title: Column, score: Column, is_risk: Column, category: Column, keyword: Column, elements: Column, evidence: Column, hint: Column, source: Column) -> Column:
    """A requirement as a block of text; what is blank has no line."""
    say = lambda label, x: F.when(_text(x) != "", F.concat(F.lit(label), _text(x)))
    number = F.regexp_replace(F.format_string("%.6f", score.cast("double")), r"\.?0+$", "")
    lines = F.array_compact(
        F.array(
            F.concat(F.lit("【"), F.coalesce(F.nullif(title, F.lit("")), F.lit("未命名评分项")), F.lit("】")),
            F.when(score > 0, F.concat(F.lit("- 分值："), number, F.lit(" 分"))),
            F.when(score >= 8, "- 篇幅要求：高分项，须写足工艺步骤、控制参数与可验证措施，避免空泛口号"),
            F.when(is_risk == 1, "- 刚性：是（缺项或明显不响应将严重失分）"),
            say("- 评分类别：", category), say("- 评分关键词：", keyword), say("- 必备要素（须在本章逐条体现）：", elements), say("- 建议证据/附图：", evidence), say("- 风险提示：", hint), say("- 评分细则：\n", source),
        )
    )
    return tx.let(lines, lambda ls: F.array_join(F.when(F.size(ls) == 1, F.array_append(ls, F.lit("- 评分细则：（无摘录原文）"))).otherwise(ls), "\n"))


def chunk_prefix(folder: Column, source: Column, keywords: Column, body: Column, most: int = 80) -> Column:
    """Where a chunk comes from and what it is about, for its embedding."""
    top = F.regexp_replace(F.replace(F.coalesce(F.nullif(folder, F.lit("")), F.lit("知识库")), F.lit("\\"), F.lit("/")), "^/+|/+$", "")
    name = F.substring_index(F.coalesce(source, F.lit("")), "/", -1)
    stem = F.when(F.coalesce(source, F.lit("")) == "", "文档").otherwise(F.regexp_replace(name, r"(?<=.)\.[^.]*$", ""))
    words = F.when(_text(keywords) != "", F.concat(F.lit("，关键词："), _text(keywords))).otherwise("")
    whole = F.concat(F.lit("【所属："), F.coalesce(F.nullif(top, F.lit("")), F.lit("知识库")), F.lit("/"), stem, words, F.lit("】"), tx.topic_snippet(body))
    return tx.let(whole, lambda p: F.when(F.length(p) > most, F.concat(F.regexp_replace(F.substring(p, 1, most - 1), r"(?U)\s+$", ""), F.lit("…"))).otherwise(p))


def with_prefix(body: Column, prefix: Column) -> Column:
    """A chunk under its prefix, for embedding and for show."""
    return F.array_join(F.filter(F.array(_text(prefix), _text(body)), lambda x: x != ""), "\n")


def points_catalog(titles: Column) -> Column:
    """Titles as a numbered list; blank ones have no number."""
    kept = F.filter(F.transform(titles, _text), lambda t: t != "")
    return F.array_join(F.transform(kept, lambda t, i: F.concat(F.lit("（"), tx.chinese_number(i + 1), F.lit("）"), t)), "\n")


def merged_groups(groups: Column) -> Column:
    """(title, content) groups, those of equal titles as one: contents that the text so far does not hold are added after a
    semicolon, in order. Groups without title or content drop out. (E23)"""
    kept = F.filter(F.transform(groups, lambda g: F.struct(_text(g["title"]).alias("title"), _text(g["content"]).alias("content"))), lambda g: (g["title"] != "") & (g["content"] != ""))

    def joined(gs: Column, title: Column) -> Column:
        step = lambda acc, g: F.when(acc == "", g["content"]).when(F.contains(acc, g["content"]), acc).otherwise(F.regexp_replace(F.concat(F.regexp_replace(acc, "[；;]+$", ""), F.lit("；"), g["content"]), "^；+|；+$", ""))
        return F.struct(title.alias("title"), F.aggregate(F.filter(gs, lambda g: g["title"] == title), F.lit(""), step).alias("content"))

    return tx.let(kept, lambda gs: F.transform(F.array_distinct(gs["title"]), lambda t: joined(gs, t)))


def gantt_span(start: Column, end: Column, length: Column, base: Column, numeric: Column) -> Column:
    """(begin, days) of a task from labels (第3天), dates or, where `numeric`, offsets from 0; length wins over an end date.
    start, end: text; base: the date of day 1, the task's own start if null. (J03)"""
    one = F.lit(1)
    more = lambda x: F.greatest(x.cast("int"), one)
    s_label, e_label = tx.day_label(F.when(~numeric, start)), tx.day_label(F.when(~numeric, end))
    s_date, e_date = tx.parsed_date(F.when(~numeric, start)), tx.parsed_date(F.when(~numeric, end))
    s_number, e_number = F.when(numeric, start.try_cast("double")), F.when(numeric, end.try_cast("double"))
    span = lambda begin, days: F.struct(F.greatest(begin.cast("int"), one).alias("begin"), days.cast("int").alias("days"))
    given = F.coalesce(more(length), one)
    return (
        F.when(s_label.isNotNull(), span(s_label, F.when(e_label.isNotNull(), more(e_label - s_label)).otherwise(given)))
        .when(s_date.isNotNull(), span(F.datediff(s_date, F.coalesce(base, s_date)) + 1, F.when(length.isNotNull(), given).when(e_date.isNotNull(), more(F.datediff(e_date, s_date))).otherwise(one)))
        .when(s_number.isNotNull(), span(F.floor(s_number) + 1, F.when(e_number.isNotNull(), more(F.floor(e_number) - F.floor(s_number))).otherwise(given)))
        .otherwise(span(one, given))
    )


_TASK = "array<struct<name:string,title:string,start:string,end:string,duration:int,`工序`:string,`开始第几天`:int,`持续天数`:int>>"


def gantt_tasks(raw: Column) -> Column:
    """(name, begin, days) of the tasks in a JSON object (tasks, items or data; startDate) or list. The first day is that
    date, or the first start that is a date. Starts are numbers where all of a list's are. (J04)"""
    listed = F.when(tx.strip(raw).startswith("["), F.from_json(raw, _TASK))
    held = [F.from_json(F.get_json_object(raw, f"$.{k}"), _TASK) for k in ("tasks", "items", "data")]
    tasks = F.coalesce(listed, *held, F.array().cast(_TASK))
    stated = F.coalesce(tx.parsed_date(F.get_json_object(raw, "$.startDate")), tx.parsed_date(F.get_json_object(raw, "$.start_date")))
    numbers = ~raw.rlike(r'"start"\s*:\s*"')

    def spans(ts: Column) -> Column:
        first = F.get(F.array_compact(F.transform(ts, lambda t: F.when(~numbers, tx.parsed_date(t["start"])))), 0)

        def one(t: Column, i: Column) -> Column:
            own = t["工序"].isNotNull() | t["开始第几天"].isNotNull() | t["持续天数"].isNotNull()
            name = F.coalesce(F.nullif(F.when(own, t["工序"]).otherwise(F.coalesce(F.nullif(t["name"], F.lit("")), t["title"])), F.lit("")), F.concat(F.lit("工序"), (i + 1).cast("string")))
            placed = F.struct(F.coalesce(F.nullif(t["开始第几天"], F.lit(0)), F.lit(1)).alias("begin"), F.greatest(F.coalesce(t["持续天数"], F.lit(1)), F.lit(1)).alias("days"))
            span = F.when(own, placed).otherwise(gantt_span(t["start"], t["end"], F.coalesce(F.nullif(t["duration"], F.lit(0)), t["持续天数"]), F.coalesce(stated, first), numbers))
            return F.struct(name.alias("name"), span["begin"].alias("begin"), span["days"].alias("days"))

        return F.transform(ts, one)

    return tx.let(tasks, spans)


def default_boundary(title: Column) -> Column:
    """The boundary of a chapter of aims or of an overview that has none of its own; else null."""
    t = F.coalesce(title, F.lit(""))
    kind = ch.chapter_type(title)
    goal = F.concat(F.lit("仅撰写「"), t, F.lit("」的目标承诺（质量、工期、造价等概括性表述），不写保证措施、施工方案或工艺细节；不输出章节标题行。"))
    overview = F.concat(F.lit("仅撰写「"), t, F.lit("」的客观描述（规模、地点、设备、环境、工程特点等），可描述重难点现象但不写对策；不写施工方案、组织、措施或进度计划；不输出章节标题行。"))
    return F.when(kind == "goal", goal).when(kind == "overview", overview)


def sane_boundary(title: Column, boundary: Column) -> Column:
    """(boundary, issues): a boundary with issues gives way to the default of its title, if there is one."""
    return tx.let(boundary_issues(title, boundary), lambda xs: F.struct(F.when(F.size(xs) > 0, F.coalesce(default_boundary(title), _text(boundary))).otherwise(_text(boundary)).alias("boundary"), xs.alias("issues")))


def assembled_chapter(markdown: Column, charts: Column) -> Column:
    """Text with its `[[CHART:n]]` marks replaced by the charts (a map of number to text); marks without a chart go, charts
    without a mark follow in order of number. (K13)"""
    text = _text(markdown)
    marks = F.transform(F.regexp_extract_all(text, F.lit(r"\[\[CHART:(\d+)\]\]"), F.lit(1)), lambda x: x.cast("int"))
    gaps = F.split(text, r"\[\[CHART:\d+\]\]", -1)
    known = F.array_sort(F.map_keys(charts))

    def joined(ms: Column) -> Column:
        filled = F.array_join(F.zip_with(gaps, ms, lambda g, m: F.concat(g, F.coalesce(F.when(m.isNotNull(), F.try_element_at(charts, m)), F.lit("")))), "")
        rest = F.array_join(F.transform(F.filter(known, lambda k: ~F.array_contains(ms, k)), lambda k: charts[k]), "\n")
        body = F.when(F.size(ms) > 0, tx.rstrip(filled)).otherwise(filled)
        return F.when(rest == "", filled).when(body == "", rest).otherwise(F.concat(body, F.lit("\n\n"), rest))

    return tx.strip(tx.let(marks, joined))


def merged_windows(segments: Column) -> Column:
    """(passed, issues) of windows (label, passed, issues): issues after the label of their window, each once; passed if all
    windows are and there is no issue. (E26)"""
    label = lambda s: F.coalesce(F.nullif(_text(s["label"]), F.lit("")), F.lit("片段"))
    said = lambda s: F.transform(F.filter(s["issues"], lambda x: _text(x) != ""), lambda x: F.concat(F.lit("【"), label(s), F.lit("】"), _text(x)))
    issues = F.array_distinct(F.flatten(F.transform(segments, said)))
    fine = F.forall(segments, lambda s: F.coalesce(s["passed"], F.lit(True)))
    return tx.let(issues, lambda xs: F.struct((fine & (F.size(xs) == 0)).alias("passed"), xs.alias("issues")))


def parse_confidence(error: Column, n_items: Column, pages: Column, tables: Column, paragraphs: Column, scanned: Column, n: Column, with_page: Column, with_score: Column, with_source: Column, filled: Column, required: Column) -> Column:
    """(confidence, level, n_warnings) of a parse, from counts of what it found."""
    readable = ~F.coalesce(error, F.lit(False)) & (n_items > 0)
    yes = lambda cond, points: F.when(cond, points).otherwise(0.0)
    doc = 0.12 + yes(pages > 0, 0.04) + yes(tables > 0, 0.05) + yes(paragraphs >= 5, 0.04)
    doc = F.when(readable, F.when(scanned, F.greatest(F.lit(0.0), doc - 0.05)).otherwise(doc)).otherwise(0.0)
    total = F.greatest(n, F.lit(1))
    asked = F.when(n > 0, 0.18 + yes(with_page / total >= 0.5, 0.1) + yes(with_score / total >= 0.7, 0.12) + yes(with_source / total >= 0.8, 0.1)).otherwise(0.0)
    value = F.round(F.least(F.lit(1.0), doc + asked + filled / required * 0.2), 2)
    flags = [~readable, readable & (tables == 0), readable & (paragraphs < 5), readable & scanned, n == 0, (n > 0) & (with_page / total < 0.5), (n > 0) & (with_score / total < 0.7), (n > 0) & (with_source / total < 0.8), filled < F.greatest(F.lit(2), required - 2)]
    warnings = reduce(lambda a, b: a + b, (F.coalesce(f, F.lit(False)).cast("int") for f in flags))
    level = lambda v: F.when(v >= 0.75, "high").when(v >= 0.5, "medium").otherwise("low")
    return tx.let(value, lambda v: F.struct(v.alias("confidence"), level(v).alias("level"), warnings.alias("n_warnings")))


def is_blind_bid(detail: Column) -> Column:
    """Whether the notice of a JSON detail says blind_bid: true, the value itself and not a text."""
    notice = F.coalesce(F.get_json_object(detail, "$.notice"), F.lit(""))
    return (F.get_json_object(notice, "$.blind_bid") == "true") & notice.rlike(r'"blind_bid"\s*:\s*true')


def anonymous_cover(meta_: Column) -> Column:
    """A map of a cover's values without the names of bidder and company, marked as blind."""
    kept = F.map_filter(F.coalesce(meta_, F.create_map().cast("map<string,string>")), lambda k, v: ~k.isin("bidder_name", "company_name", "blind_bid"))
    return F.map_concat(kept, F.create_map(F.lit("blind_bid"), F.lit("true")))


def item_text(title: Column, resume: Column, content: Column) -> Column:
    """What of a knowledge item is embedded."""
    return tx.strip(F.concat(F.coalesce(title, F.lit("")), F.lit("\n"), F.coalesce(resume, F.lit("")), F.lit("\n"), F.coalesce(content, F.lit(""))))


def item_block(title: Column, resume: Column, content: Column, source: Column, folder: Column) -> Column:
    """A knowledge item as it is shown, under the label of its source."""
    body = F.concat(F.lit("【"), F.coalesce(title, F.lit("")), F.lit("】\n"), F.coalesce(resume, F.lit("")), F.lit("\n\n"), F.coalesce(content, F.lit("")))
    return tx.labeled_chunk(body, F.coalesce(F.nullif(source, F.lit("")), F.nullif(title, F.lit("")), F.lit("项目知识库")), folder)


def full_text(items: Column) -> Column:
    """The items that are not blank, a line each."""
    return F.array_join(F.filter(F.coalesce(items, F.array().cast("array<string>")), lambda x: _text(x) != ""), "\n")


def changed_fields(stored: Column, touched: Column, fields: dict[str, str]) -> Column:
    """The project's fields behind the keys of touched whose values differ from those stored (both maps), in order, each once.
    fields: key to field. (C25, Y29)"""
    names = F.create_map(*(F.lit(x) for kv in fields.items() for x in kv))
    keys = F.filter(F.map_keys(touched), lambda k: ~equal_values(F.try_element_at(stored, k), touched[k]))
    return F.array_distinct(F.array_compact(F.transform(keys, lambda k: F.try_element_at(names, k))))
