"""Quality rules: a registry of functions from a chapter's columns to messages, run in one pass over the chapters.

A rule sees a Chapter (columns) and returns an array of strings. `findings` evaluates all rules of a scope in one
projection and explodes what they found, so a text is read once however many rules there are. (2.N, X01-X05)"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import chapters as ch
from ..functions import text as tx
from ..functions.prose import CLICHES, COMPANY_MARKERS, FILLERS, IDENTITY_PATTERNS, occurrences

# Markers and phrases that rules look for.
TEMPLATE_RESIDUES = [
    "xxx 公司", "XXX公司", "XX公司", "xxx 项目", "XXX项目", "XX项目", "<甲方单位>", "<甲方名称>", "<乙方名称>", "<项目名称>", "<投标人名称>",
    "[甲方单位]", "[甲方名称]", "[乙方名称]", "[项目名称]", "[投标人名称]", "【甲方单位】", "【项目名称】", "【投标人名称】", "【公司名称】",
    "TODO", "todo", "【待补充】", "【待填写】", "【待人工确认】", "示例文本",
]
UNREPLACED = ["XXX", "待定", "TBD", "○○○"]
MEASURE_MARKERS = [
    "具体措施", "主要措施", "保证措施", "拟采取", "为实现上述目标", "为实现本工程", "针对上述特点", "针对本工程", "针对上述难点", "我方将", "我们将",
    "组织保障", "技术保障", "管理保障", "检验频次", "施工步骤", "施工工艺", "施工组织", "专项方案", "质量保证体系", "质量管理体系",
]
CHART_OPEN = r"(?i)\[(GANTT|TIMELINE|FLOW|ORG|SMART)_DATA:"
TABLE_ROW = r"^\|.*\|$"
TABLE_SEPARATOR = r"^\|?\s*:?-{2,}:?\s*(\|\s*:?-{2,}:?\s*)*\|?$"


class Chapter(NamedTuple):
    """What rules see. requirements: array of (title, keyword, elements, is_risk); the last four are made from the content
    once for all rules."""

    content: Column
    title: Column
    duration_days: Column
    target_words: Column
    keywords: Column
    other_titles: Column
    elements: Column
    key_points: Column
    requirements: Column
    facts: Column
    location: Column
    lines: Column  # as they are
    headings: Column
    paragraphs: Column
    openings: Column


class Rule(NamedTuple):
    category: str
    severity: str
    scopes: tuple[str, ...]
    check: Callable[[Chapter], Column]


REGISTRY: dict[str, Rule] = {}


def rule(check_id: str, category: str, severity: str = "warn", scopes: tuple[str, ...] = ("chapter",)):
    """Registers a rule, or replaces the one of that id."""

    def add(f: Callable[[Chapter], Column]) -> Callable[[Chapter], Column]:
        REGISTRY[check_id] = Rule(category, severity, scopes, f)
        return f

    return add


def rules_of(scope: str) -> dict[str, Rule]:
    """(X03)"""
    return {k: r for k, r in REGISTRY.items() if scope in r.scopes}


def _strings(*xs) -> Column:
    return F.array_compact(F.array(*xs)) if xs else F.array().cast("array<string>")


def _when(cond: Column, message) -> Column:
    return _strings(F.when(cond, message if isinstance(message, Column) else F.lit(message)))


def found_in(x: Column, words: list[str]) -> Column:
    """Which of the words occur, in the order of the list."""
    return F.filter(F.array(*map(F.lit, words)), lambda w: F.contains(x, w))


@rule("chapter_scope", "scope", scopes=("chapter", "segment"))
def chapter_scope(c: Chapter) -> Column:
    foreign = F.filter(c.headings, lambda h: ~tx.title_scope_match(h, c.title) & F.exists(c.other_titles, lambda o: tx.title_scope_match(h, o)))
    return F.transform(foreign, lambda h: F.concat(F.lit("正文出现其他章节标题「"), h, F.lit("」，超出本章「"), c.title, F.lit("」范围")))


@rule("duration_number", "fact_consistency")
def duration_number(c: Chapter) -> Column:
    days = F.transform(F.regexp_extract_all(c.content, F.lit(r"(\d+)\s*(天|日|日历天)"), F.lit(1)), lambda d: d.cast("decimal(38,0)"))
    bad = F.filter(days, lambda d: (c.duration_days > 0) & (d > c.duration_days * 2))
    return F.transform(bad, lambda d: F.concat(F.lit("工期数字 "), d.cast("string"), F.lit(" 与全局参数 "), c.duration_days.cast("string"), F.lit(" 天偏差过大")))


@rule("digit_density", "digit_density")
def digit_density(c: Chapter) -> Column:
    n = F.length(c.content)
    return _when(~ch.is_descriptive(c.title) & (n > 500) & (F.regexp_count(c.content, F.lit(r"\d")) / F.greatest(n / 100, F.lit(1.0)) < 0.5), "内容密度不足：技术参数与数字偏少")


def residues(text: Column) -> Column:
    """Messages for what a template left behind."""
    say = lambda label, words: F.transform(found_in(text, words), lambda w: F.concat(F.lit(label), w))
    return F.concat(say("模板残留：", TEMPLATE_RESIDUES), say("未替换标记：", UNREPLACED))


@rule("template_residue", "template_residue", "block", ("chapter", "segment"))
def template_residue(c: Chapter) -> Column:
    return residues(c.content)


@rule("blind_bid", "blind_bid", "block")
def blind_bid(c: Chapter) -> Column:
    return _identities(c.content)


def _identities(text: Column) -> Column:
    marks = F.transform(found_in(text, COMPANY_MARKERS), lambda w: F.concat(F.lit("暗标违规：出现「"), w, F.lit("」")))
    first = lambda p: F.substring(F.regexp_extract(text, p, 0), 1, 40)
    seen = [F.when(first(p) != "", F.concat(F.lit("暗标违规：疑似身份信息「"), first(p), F.lit("」"))) for p in IDENTITY_PATTERNS]
    return F.slice(F.array_distinct(F.concat(marks, _strings(*seen))), 1, 8)


def blind_bid_residues(text: Column, enabled: Column) -> Column:
    """Messages for an identity that shows, the first eight, where a bid is blind; else none."""
    none = F.array().cast("array<string>")
    return F.when(F.coalesce(enabled, F.lit(False)), _identities(F.coalesce(text, F.lit("")))).otherwise(none)


@rule("ai_spacing", "writing_quality", scopes=("chapter", "segment"))
def ai_spacing(c: Chapter) -> Column:
    wide = c.content.contains("  ") & F.exists(c.lines, lambda x: x.contains("  ") & ~tx.strip(x).rlike(TABLE_ROW))
    return _strings(F.when(c.content.contains("　"), "存在全角空格（应使用半角或删除）"), F.when(wide, "存在连续多个半角空格"))


@rule("truncation", "truncation")
def truncation(c: Chapter) -> Column:
    t = tx.rstrip(c.content)
    end = F.right(t, F.lit(2))
    fine = (t == "") | end.rlike(r"(?:。|！|？|\]\]|\}\]|）|\))$") | tx.strip(F.substring_index(t, "\n", -1)).rlike(TABLE_ROW)
    comma = "正文结尾疑似被截断（以逗号/顿号等非结束标点收尾）"
    return _strings(F.when(fine, F.lit(None)).when(end.rlike(r"[，、：；\-—]$"), comma).when(F.length(t) > 200, "正文结尾疑似被截断（未以句号等结束标点收尾）"))


@rule("descriptive_measures", "writing_quality")
def descriptive_measures(c: Chapter) -> Column:
    hits = found_in(c.content, MEASURE_MARKERS)
    label = F.when(ch.chapter_type(c.title) == "goal", "目标").otherwise("概况/特点")
    return _when(ch.is_descriptive(c.title) & (F.size(hits) > 0), F.concat(label, F.lit("章节不应写措施/方案，检测到："), F.array_join(F.slice(hits, 1, 5), ", ")))


@rule("first_para_title", "writing_quality")
def first_para_title(c: Chapter) -> Column:
    """What a paragraph begins with says mostly that it is no title; only else all of it is normalised."""

    def again(title: Column) -> Column:
        whole = lambda first: F.startswith(first, title) & (F.length(first) <= F.length(title) + 8)
        other = lambda begin: (F.length(begin) > F.length(title) + 8) | ((F.length(begin) >= F.length(title)) & ~F.startswith(begin, title))
        begun = tx.let(tx.normalize_for_match(F.substring(F.get(c.paragraphs, 0), 1, 200)), other)
        return (F.length(title) >= 4) & ~begun & tx.let(tx.normalize_for_match(F.get(c.paragraphs, 0)), whole)

    return _when(tx.let(tx.normalize_for_match(c.title), again), F.concat(F.lit("首段不应重复章节标题「"), c.title, F.lit("」")))


@rule("para_opening", "writing_quality")
def para_opening(c: Chapter) -> Column:
    """The first opening that three paragraphs in a row share."""
    start = F.struct(F.lit("").alias("last"), F.lit(0).alias("run"), F.lit("").alias("hit"))

    def step(acc: Column, o: Column) -> Column:
        run = F.when((o != "") & (o == acc["last"]), acc["run"] + 1).otherwise(1)
        return F.struct(o.alias("last"), run.alias("run"), F.when((acc["hit"] == "") & (run >= 3), o).otherwise(acc["hit"]).alias("hit"))

    hit = F.aggregate(c.openings, start, step, lambda acc: acc["hit"])
    return F.transform(F.filter(F.array(hit), lambda h: h != ""), lambda h: F.concat(F.lit("连续 3 段以相同句式开头「"), h, F.lit("」，建议调整表达方式")))


@rule("opening_pattern", "writing_quality")
def opening_pattern(c: Chapter) -> Column:
    """The opening that most paragraphs share, three at least; of equals the first. Equal ones lie together once sorted."""
    placed = F.array_sort(F.filter(F.transform(c.openings, lambda o, i: F.struct(o.alias("o"), i.alias("i"))), lambda p: F.length(p["o"]) >= 5))
    best = F.struct(F.lit(0).alias("n"), F.lit(0).alias("at"), F.lit("").alias("o"))
    start = F.struct(F.lit("").alias("last"), F.lit(0).alias("run"), F.lit(0).alias("first"), best.alias("best"))

    def step(acc: Column, p: Column) -> Column:
        same = p["o"] == acc["last"]
        run, first = F.when(same, acc["run"] + 1).otherwise(1), F.when(same, acc["first"]).otherwise(p["i"])
        now = F.struct(run.alias("n"), (-first).alias("at"), p["o"].alias("o"))
        return F.struct(p["o"].alias("last"), run.alias("run"), first.alias("first"), F.greatest(acc["best"], now).alias("best"))

    say = lambda b: F.when(b["n"] >= 3, F.concat(F.lit("「"), b["o"], F.lit("」句式在全文中重复出现 "), b["n"].cast("string"), F.lit(" 次（非连续），建议更换表达方式")))
    found = F.aggregate(placed, start, step, lambda acc: say(acc["best"]))
    return _strings(F.when(F.size(c.openings) >= 3, found))


@rule("markdown_table", "table_integrity", scopes=("chapter", "segment"))
def markdown_table(c: Chapter) -> Column:
    """Rows of a table that are empty or differ from its header in their number of cells."""
    start = F.struct(F.lit(0).alias("cols"), F.lit(0).alias("before"), F.lit(0).alias("n"), F.array().cast("array<string>").alias("out"))

    def step(acc: Column, line: Column) -> Column:
        cells = tx.table_cells(line)
        k, at, row = F.size(cells), acc["n"] + 1, line.rlike(TABLE_ROW)
        inside, sep = acc["cols"] > 0, line.rlike(TABLE_SEPARATOR)
        head = ~inside & sep & (acc["before"] > 0)
        bare = F.forall(cells, lambda x: x == "")
        fault = F.when(bare, F.concat(F.lit("表格存在空行或无效行（第 "), at.cast("string"), F.lit(" 行）"))).when(
            k != acc["cols"], F.concat(F.lit("表格列数不一致：表头 "), acc["cols"].cast("string"), F.lit(" 列，第 "), at.cast("string"), F.lit(" 行为 "), k.cast("string"), F.lit(" 列"))
        )
        out = F.when(inside & row & fault.isNotNull(), F.array_append(acc["out"], fault)).otherwise(acc["out"])
        cols = F.when(head, acc["before"]).when(inside & row, acc["cols"]).otherwise(0)
        before = F.when(~inside & ~head & row, k).otherwise(0)
        return F.struct(cols.alias("cols"), before.alias("before"), at.alias("n"), out.alias("out"))

    return F.when(c.content.contains("|"), F.aggregate(F.transform(c.lines, tx.strip), start, step, lambda acc: acc["out"])).otherwise(F.array().cast("array<string>"))


def trailing_table(content: Column) -> Column:
    """A message where the text ends in a table without a row of data, else null."""
    back = F.reverse(F.transform(tx.split_lines(tx.strip(content)), tx.strip))

    def judge(ls: Column) -> Column:
        other = F.array_position(F.transform(ls, lambda x: x.rlike(TABLE_ROW)), F.lit(False)).cast("int")
        rows = F.when(other == 0, F.size(ls)).otherwise(other - 1)
        lead = F.coalesce(F.get(ls, rows).rlike(TABLE_SEPARATOR), F.lit(False)).cast("int")
        bare = (rows == 2) & (lead == 0) & F.get(ls, 0).rlike(TABLE_SEPARATOR)
        return (
            F.when(rows == 0, F.lit(None).cast("string"))
            .when(rows + lead == 1, "正文以不完整表格行结尾，须在本节点内输出完整表格（含表头与至少一行数据）")
            .when(bare, "表格仅有表头与分隔线，缺少数据行，须在本节点内完整输出")
        )

    return F.when(tx.strip(content).endswith("|"), tx.let(back, judge))


@rule("atomic_md", "table_integrity", scopes=("chapter", "segment"))
def atomic_md(c: Chapter) -> Column:
    marked = F.contains(c.content, F.lit("["))
    t = tx.strip(c.content)
    opens, closes = F.regexp_count(t, F.lit(CHART_OPEN)), F.regexp_count(t, F.lit(r"\]\]|\}\]"))
    tail = t.rlike(r"(?im)\[(GANTT|TIMELINE|FLOW|ORG|SMART)_DATA:[^\]]*$")
    return _strings(F.when(marked & (opens > closes), "存在未闭合的图表占位符，须在本节点内完整输出后再结束"), F.when(marked & tail, "正文末尾存在未闭合的图表占位符"), trailing_table(c.content))


@rule("ai_cliche", "ai_cliche")
def ai_cliche(c: Chapter) -> Column:
    """The first five phrases by place of their first occurrence."""
    searched = {w: f"{w}，" if w in FILLERS else w for w in CLICHES}
    places = [F.when(F.contains(c.content, F.lit(x)), F.struct(F.instr(c.content, x).alias("at"), F.lit(w).alias("w"))) for w, x in searched.items()]
    hit = F.array_sort(F.array_compact(F.array(*places)))
    return F.transform(F.slice(hit, 1, 5), lambda p: F.concat(F.lit("AI 套话残留："), p["w"]))


@rule("heading_keywords", "title_keywords")
def heading_keywords(c: Chapter) -> Column:
    heads = F.concat(c.headings, F.array(F.coalesce(c.title, F.lit(""))))
    miss = (F.size(c.keywords) > 0) & ~F.exists(c.keywords, lambda k: tx.keyword_covered_in_headings(heads, k))
    return _when(miss, F.concat(F.lit("标题未覆盖关键词："), F.array_join(c.keywords, "/")))


@rule("stitch_cheat", "writing_quality")
def stitch_cheat(c: Chapter) -> Column:
    """A line or sentence that crams three keywords into 30 characters."""
    lines = F.filter(F.transform(c.lines, tx.strip), lambda x: F.length(x).between(8, 80))
    blocks = F.concat(lines, F.filter(F.transform(F.split(c.content, "[。；\n]"), tx.strip), lambda x: F.length(x) >= 8))

    def crammed(b: Column) -> Column:
        at = F.filter(F.transform(c.keywords, lambda k: F.struct(F.instr(b, k).alias("at"), F.length(k).alias("n"))), lambda p: p["at"] > 0)
        last = F.array_max(at)
        return (F.size(at) >= 3) & (last["at"] + last["n"] - F.array_min(at)["at"] <= 30)

    present = F.size(F.filter(c.keywords, lambda k: F.contains(c.content, k))) >= 3
    found = F.when(present, F.slice(F.filter(blocks, crammed), 1, 1)).otherwise(F.array().cast("array<string>"))
    return F.transform(found, lambda b: F.concat(F.lit("疑似缝合句作弊："), F.substring(b, 1, 40)))


@rule("chart_closure", "chart_integrity")
def chart_closure(c: Chapter) -> Column:
    return _when(F.contains(c.content, F.lit("[")) & (F.regexp_count(c.content, F.lit(CHART_OPEN)) > F.regexp_count(c.content, F.lit(r"\]\]|\}\]"))), "图表占位符未正确闭合")


@rule("word_count", "word_count")
def word_count(c: Chapter) -> Column:
    goal = c.target_words
    low, high = F.floor(goal * 0.75).cast("int"), F.floor(goal * 1.25).cast("int")
    say = lambda n, what, bound, name: F.concat(F.lit(f"{what}：当前约 "), n.cast("string"), F.lit(" 字，目标 "), goal.cast("string"), F.lit(f" 字（{name} "), bound.cast("string"), F.lit("）"))
    judged = tx.let(tx.solid_length(c.content), lambda n: F.when(n < low, say(n, "篇幅不足", low, "下限")).when(n > high, say(n, "篇幅过长", high, "上限")))
    return _strings(F.when(F.coalesce(goal, F.lit(0)) != 0, judged))


@rule("segment_no_heading", "writing_quality", scopes=("segment",))
def segment_no_heading(c: Chapter) -> Column:
    return _when(tx.strip(c.content).startswith("#"), "分段正文严禁输出 # 标题行")


@rule("mandatory_elements", "mandatory", scopes=("chapter", "project"))
def mandatory_elements(c: Chapter) -> Column:
    """(Q36)"""
    missing = F.filter(tx.split_mandatory_elements(c.elements), lambda e: ~tx.phrase_covered(c.content, e))
    return tx.let(missing, lambda m: _when(F.size(m) > 0, F.concat(F.lit("必备要素未覆盖："), F.array_join(m, ", "))))


@rule("plan_coverage", "plan_coverage")
def plan_coverage(c: Chapter) -> Column:
    """Fewer than 7 of 10 key points of a plan have a word in the content. (Q19)"""
    points = F.filter(F.transform(c.key_points, tx.strip), lambda p: p != "")

    def pieces(t: Column) -> Column:
        cut = lambda n: F.when(F.length(t) >= n, F.transform(F.sequence(F.lit(1), F.length(t) - n + 1, F.lit(n)), lambda i: F.substr(t, i, F.lit(n)))).otherwise(F.array().cast("array<string>"))
        return F.when(F.length(t) >= 6, F.concat(F.array(t), cut(4), cut(3), cut(2))).otherwise(F.array(t))

    def hit(p: Column) -> Column:
        words = F.array_distinct(F.flatten(F.transform(F.regexp_extract_all(p, F.lit(tx.MATCH_TOKEN), F.lit(0)), pieces)))
        longest = F.slice(F.array_sort(F.transform(words, lambda w: F.struct((-F.length(w)).alias("n"), w.alias("w")))), 1, 10)
        return (F.size(words) == 0) | F.exists(longest, lambda w: F.contains(c.content, w["w"]))

    n, k = F.size(points), F.size(F.filter(points, hit))
    say = F.concat(F.lit("写作规划要点覆盖不足：仅命中 "), k.cast("string"), F.lit("/"), n.cast("string"), F.lit("，请按规划补写未覆盖要点"))
    return _strings(F.when((n >= 2) & (tx.strip(c.content) != "") & (k * 10 < n * 7), say))


@rule("scoring_coverage", "scoring_coverage", "block")
def scoring_coverage(c: Chapter) -> Column:
    """Requirements whose elements or words are not met, or which are rigid and get no substantial response. (Q20)"""

    def judge(r: Column) -> Column:
        title = F.coalesce(F.nullif(r["title"], F.lit("")), F.lit("评分项"))
        missing = F.filter(tx.split_mandatory_elements(r["elements"]), lambda e: ~tx.phrase_covered(c.content, e))
        candidates = tx.coverage_candidates(title, r["keyword"])
        matched = tx.matched_candidates(c.content, candidates)
        rigid = F.coalesce(r["is_risk"] == 1, F.lit(False))
        responded = tx.contains_any(c.content, tx.SUBSTANTIAL_KEYWORDS)
        return (
            F.when(F.size(missing) > 0, F.concat(F.lit("评分覆盖不足「"), title, F.lit("」：缺少必备要素 "), F.array_join(missing, ", ")))
            .when((F.size(candidates) > 0) & (F.size(matched) == 0), F.concat(F.when(rigid, "刚性风险项").otherwise("评分项"), F.lit("「"), title, F.lit("」关键词未在正文中体现")))
            .when(rigid & (F.size(matched) > 0) & ~responded, F.concat(F.lit("刚性风险项「"), title, F.lit("」缺少实质性响应表述（如完全响应/满足要求/不低于等）")))
        )

    found = F.slice(F.array_compact(F.transform(c.requirements, judge)), 1, 10)
    return F.when((F.size(c.requirements) > 0) & (tx.strip(c.content) != ""), found).otherwise(F.array().cast("array<string>"))


COUNT = r"(\d+(?:\.\d+)?)\s*(台|套|基|回|km|公里|米|m|天|日|人)"
LOCATION_CLAIM = r"(?:建设地点|施工地点|工程地点|工程位于|项目位于|本工程位于|本项目位于|本工程(?:建设)?地址|项目地址|工程地址|坐落于)(?:[：:\s]|为|是)+([^\n，,。；;]{2,40})"


@rule("global_facts", "fact_consistency")
def global_facts(c: Chapter) -> Column:
    """A place other than the project's, and counts that differ from a fact's within 80 characters of its key; six at
    most. (Q17)"""
    location = tx.strip(F.coalesce(c.location, F.lit("")))
    parts = tx.location_parts(location)
    claims = F.transform(F.regexp_extract_all(c.content, F.lit(LOCATION_CLAIM), F.lit(1)), tx.strip)

    def foreign(claim: Column) -> Column:
        places = F.regexp_extract_all(claim, F.lit(tx.PLACE_NAME), F.lit(1))
        other = F.filter(places, lambda p: ~F.exists(parts, lambda x: F.contains(x, p) | F.contains(p, x)))
        return F.when(~F.exists(parts, lambda p: F.contains(claim, p)), F.get(other, 0))

    strange = F.get(F.array_compact(F.transform(claims, foreign)), 0)
    place = F.when((F.length(location) >= 2) & strange.isNotNull(), F.concat(F.lit("建设地点疑似不一致：全局为「"), location, F.lit("」，正文出现「"), strange, F.lit("」")))

    def conflict(fact: Column) -> Column:
        number, unit = F.regexp_extract(fact["value"], COUNT, 1), F.regexp_extract(fact["value"], COUNT, 2)
        # what follows each mention of the key, the key of later mentions included
        windows = F.transform(occurrences(c.content, fact["key"]), lambda at: F.substr(c.content, at + 1, F.lit(80)))

        def bad(w: Column) -> Column:
            each = lambda g: F.regexp_extract_all(w, F.lit(COUNT), F.lit(g))
            said = F.arrays_zip(each(0).alias("said"), each(1).alias("n"), each(2).alias("unit"))
            return F.get(F.filter(said, lambda x: (x["unit"] == unit) & (x["n"] != number)), 0)["said"]

        first = F.get(F.array_compact(F.transform(windows, bad)), 0)
        say = F.concat(F.lit("全局事实冲突「"), fact["key"], F.lit("」：应为 "), number, unit, F.lit("，正文出现 "), first)
        return F.when((number != "") & F.contains(c.content, fact["key"]), F.when(first.isNotNull(), say))

    conflicts = F.array_compact(F.transform(tx.fact_pairs(c.facts), conflict))
    stated = (c.location != "") | (c.facts != "")
    return F.when(stated & (tx.strip(c.content) != ""), F.slice(F.concat(_strings(place), conflicts), 1, 6)).otherwise(F.array().cast("array<string>"))


def trimmed_to_scope(content: Column, title: Column, others: Column) -> Column:
    """The content up to the first heading that is another chapter's and not its own."""
    lines = tx.split_lines(content)
    heads = F.transform(lines, tx.line_as_heading)
    foreign = F.transform(heads, lambda h: F.coalesce(h.isNotNull() & ~tx.title_scope_match(h, title) & F.exists(others, lambda o: tx.title_scope_match(h, o)), F.lit(False)))
    at = F.array_position(foreign, F.lit(True)).cast("int")
    return F.when((F.size(others) == 0) | (at == 0), content).otherwise(tx.rstrip(F.array_join(F.slice(lines, F.lit(1), at - 1), "\n")))


def currency(chapters: DataFrame, registry: DataFrame) -> DataFrame:
    """(id, core, status) of the codes in chapters (id, content) that the registry (core, status) does not hold as current:
    withdrawn, superseded or unknown. (D17, Q16, Q35)"""
    named = chapters.select("id", F.explode(tx.standard_codes(F.col("content"))).alias("code")).select("id", tx.standard_core(F.col("code")).alias("core")).distinct()
    found = named.join(registry.select("core", "status"), "core", "left").withColumn("status", F.coalesce("status", F.lit("unknown")))
    return found.where("status IN ('withdrawn', 'superseded', 'unknown')").select("id", "core", "status")


def findings(chapters: DataFrame, scope: str = "chapter", only: tuple[str, ...] | None = None) -> DataFrame:
    """(id, check_id, category, severity, message) of all rules of the scope. chapters: id, content and, where given, the
    other columns of Chapter up to location; a rule whose columns are not given finds nothing. Null content counts as empty. (X04, H04)"""
    have = lambda name, default: F.coalesce(F.col(name), default) if name in chapters.columns else default
    none = F.array().cast("array<string>")
    given = {"content": have("content", F.lit("")), "title": have("title", F.lit("")), "duration_days": have("duration_days", F.lit(0)), "target_words": have("target_words", F.lit(0))}
    given |= {"keywords": have("keywords", none), "other_titles": have("other_titles", none), "elements": have("elements", F.lit("")), "key_points": have("key_points", none)}
    asked = F.array().cast("array<struct<title:string,keyword:string,elements:string,is_risk:int>>")
    given |= {"requirements": have("requirements", asked), "facts": have("facts", F.lit("")), "location": have("location", F.lit(""))}
    # projections of their own, which Spark does not merge as their columns are used many times
    rows = chapters.select("id", *(v.alias(k) for k, v in given.items()))
    rows = rows.select("*", tx.split_lines(F.col("content")).alias("lines"), tx.body_paragraphs(F.col("content")).alias("paragraphs"))
    rows = rows.select("*", F.array_compact(F.transform("lines", tx.line_as_heading)).alias("headings"), F.transform("paragraphs", tx.paragraph_opening).alias("openings"))
    c = Chapter(*map(F.col, Chapter._fields))

    def finding(k: str, r: Rule) -> Callable[[Column], Column]:
        return lambda m: F.struct(F.lit(k).alias("check_id"), F.lit(r.category).alias("category"), F.lit(r.severity).alias("severity"), m.alias("message"))

    each = [F.transform(r.check(c), finding(k, r)) for k, r in rules_of(scope).items() if only is None or k in only]
    return rows.select("id", F.explode(F.array_distinct(F.concat(*each))).alias("f")).select("id", "f.*")


def summarise(found: DataFrame) -> DataFrame:
    """Counts by category and severity; what is neither block nor info counts as warn."""
    s = F.col("severity")
    return found.groupBy("category").agg(F.count("*").alias("n"), F.count_if(s == "block").alias("block"), F.count_if(s == "info").alias("info"), F.count_if(~s.isin("block", "info")).alias("warn"))
