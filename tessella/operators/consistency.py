"""Checks of whole projects against what is known of them: durations, staff, money, persons, grounds for exclusion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as tx
from . import coverage, sections

# Patterns, words and factors that results depend on.
D_PLUS = r"D\s*\+\s*(\d+)"
TEAM = ["项目组", "团队", "项目经理", "技术骨干", "核心人员", "专家", "工程师", "成员", "人员配置", "项目部"]
HINTS = ["实质性", "负偏离", "未响应", "漏项", "缺项", "暗标", "雷同", "抄袭", "虚假", "技术偏离", "不满足", "低于要求", "未提供", "未盖章", "正本", "副本", "密封", "投标有效期", "保证金"]
RISKS = [(r"XXX|xxx|【待|TODO|<甲方|<乙方|\[投标人", "疑似模板/占位残留，对照废标条款"), (r"(?:本公司|我公司|我单位).{0,8}(?:中标|中选)", "疑似承诺性身份表述，暗标/废标风险")]
DAY_COST, SHARE, OVER, FAR, SCANNED = 1500, 0.5, 1.5, 10, 8


def _thousands(x: Column) -> Column:
    """A number without decimals, half to even, with commas."""
    return F.format_number(F.bround(x.cast("decimal(30,6)"), 0), 0)


def _whole(xs: Column) -> Column:
    return F.array_compact(F.transform(xs, lambda x: x.try_cast("long")))


def team_sizes(text: Column) -> Column:
    """Numbers of persons that stand within 20 characters of a word for a team.

    The characters before a number are looked at up to 20, also those of another number."""
    at = F.regexp_extract_all(text, F.lit(r"(?s)(?<![0-9])(\d+)\s*(?:人|位)"), F.lit(1))
    parts = F.split(F.concat(F.lit(" "), text), r"(?<![0-9])(?=\d+\s*(?:人|位))")  # no number at the very beginning, which is not cut off
    # the text before the k-th number ends with its parts; 20 characters need no more than the last ones
    before = lambda k: F.right(F.array_join(F.slice(parts, F.lit(1), k + 1), ""), F.lit(20))
    near = F.filter(F.transform(at, lambda n, k: F.struct(n.alias("n"), tx.contains_any(before(k), TEAM).alias("team"))), lambda x: x["team"])
    return _whole(F.transform(near, lambda x: x["n"]))


def row_findings(duration: Column, budget: Column, text: Column) -> Column:
    """Array of (level, message) on one text: days after a start and numbers of days against the duration, the cost of the team
    and sums of money against the budget. Without a duration, or a budget above zero, what needs it is left out. (D28)"""
    days, plus, t = duration.cast("long"), F.array_distinct(F.array_sort(_whole(F.regexp_extract_all(text, F.lit(D_PLUS), F.lit(1))))), F.coalesce(text, F.lit(""))
    say = lambda level, *xs: F.struct(F.lit(level).alias("level"), F.concat(*(F.lit(x) if isinstance(x, str) else x.cast("string") for x in xs)).alias("message"))
    known, rich = F.coalesce(days > 0, F.lit(False)), F.coalesce(budget > 0, F.lit(False))
    hard = F.transform(F.filter(plus, lambda d: d > days * 2), lambda d: say("fail", "D+", d, " 明显超出总工期 ", days, " 天（超 ", d - days, " 天）"))
    soft = F.transform(F.filter(plus, lambda d: (d > days) & (d <= days * 2)), lambda d: say("warn", "D+", d, " 超出总工期 ", days, " 天，若属评审配合节点请人工复核"))
    fine = F.when((F.size(plus) > 0) & ~F.exists(plus, lambda d: d > days), F.array(say("pass", "D+N 节点均在 ", days, " 天工期内")))
    numbers = F.filter(_whole(F.regexp_extract_all(t, F.lit(tx.DAY_UNIT), F.lit(1))), lambda n: n > days * 2)
    numbers = F.transform(numbers, lambda n: say("warn", "正文工期数字 ", n, " 天与全局 ", days, " 天偏差过大"))
    most = F.array_max(team_sizes(t))
    cost = most * SHARE * days * DAY_COST
    spoken = F.concat(F.lit("团队成本估算 "), _thousands(cost), F.lit(" 元（"), most.cast("string"), F.lit(" 人×50%×"), days.cast("string"), F.lit(f" 天×{DAY_COST} 元/人·天），合同预算 "), _thousands(budget), F.lit(" 元"))
    team = F.when(known & rich & most.isNotNull(), F.array(F.struct(F.when(cost > budget * OVER, "fail").otherwise("pass").alias("level"), spoken.alias("message"))))
    far = F.filter(tx.money_yuan(t), lambda m: m > budget * FAR)
    sums = F.array_join(F.transform(F.slice(far, 1, 3), lambda m: F.format_string("%.1f", m)), ", ")
    money = F.when(rich & (F.size(far) > 0), F.array(say("fail", "正文金额 [", sums, "] 元大幅超出预算（10 倍以上）")))
    none = F.expr("filter(array(struct('' AS level, '' AS message)), x -> false)")
    found = [F.when(known, hard), F.when(known, soft), F.when(known, fine), F.when(known, numbers), team, money]
    return F.concat(*(F.coalesce(x, none) for x in found))


def cross_consistency(projects: DataFrame) -> DataFrame:
    """(project_id, level, message) of projects (project_id, duration_days, budget, text): row_findings(), and the persons that
    resumes name but organisation charts do not. (D28)"""
    rows = projects.select("project_id", F.explode(row_findings(F.col("duration_days"), F.col("budget").cast("double"), F.col("text"))).alias("f")).select("project_id", "f.level", "f.message")
    named = sections.unlisted(projects.select(F.col("project_id").alias("id"), "text")).select(F.col("id").alias("project_id"), F.lit("warn").alias("level"), "message")
    return rows.union(named)


def cross_findings(projects: DataFrame) -> DataFrame:
    """(project_id, check_id, category, severity, message): what of cross_consistency() is no pass. (Q33)"""
    severity = F.when(F.col("level") == "fail", "block").otherwise("warn")
    return cross_consistency(projects).where("level <> 'pass'").select("project_id", F.lit("project_cross_consistency").alias("check_id"), F.lit("fact_consistency").alias("category"), severity.alias("severity"), "message")


def disqualification(projects: DataFrame, items: DataFrame) -> DataFrame:
    """(project_id, seq, check_id, category, severity, message, evidence) of the grounds for exclusion (project_id, seq, label,
    description) of projects (project_id, text): those on technical matters, or the first eight where none is. A technical
    one blocks where the text shows a risk; others are to be looked at by hand. (D29, Q34)

    A text is reduced to its first risk before it meets the grounds, which are rows of their own."""
    t = F.coalesce("text", F.lit(""))
    risks = projects.select("project_id", F.coalesce(*(F.when(t.rlike(p), said) for p, said in RISKS)).alias("risk"))
    label = F.coalesce(tx.strip(F.coalesce(F.nullif("label", F.lit("")), F.lit("废标项"))), F.lit(""))
    said = F.coalesce("description", F.lit(""))
    marked = items.select("project_id", "seq", label.alias("label"), tx.strip(said).alias("said"), tx.contains_any(F.concat(F.coalesce("label", F.lit("")), F.lit(" "), said), HINTS).alias("technical"))
    of = W.partitionBy("project_id")
    marked = marked.withColumn("some", F.max("technical").over(of)).withColumn("nth", F.row_number().over(of.orderBy("seq", "label", "said")))
    scanned = marked.where("technical OR (NOT some AND nth <= 8)").join(risks, "project_id", "left")
    short = F.when(F.length("said") <= 80, F.col("said")).otherwise(F.concat(F.substring("said", 1, 77), F.lit("…")))
    blocks = F.col("technical") & F.col("risk").isNotNull()
    message = F.when(blocks, F.concat(F.lit("废标条款「"), "label", F.lit("」存在正文风险："), "risk")).otherwise(F.concat(F.lit("请人工核对废标条款#"), F.coalesce(F.col("seq").cast("string"), F.lit("None")), F.lit("「"), "label", F.lit("」："), short))
    severity = F.when(blocks, "block").when(F.col("technical"), "warn").otherwise("info")
    return scanned.select("project_id", "seq", F.lit("project_disqualification").alias("check_id"), F.lit("disqualification_risk").alias("category"), severity.alias("severity"), message.alias("message"), F.when(blocks, short).otherwise(F.col("said")).alias("evidence"))


def matrix_issues(requirements: DataFrame, leaves: DataFrame) -> DataFrame:
    """(leaf_id, requirement_id, issue): for each leaf (id, title, content, requirement_ids) what its requirements (as of
    coverage.response_matrix()) lack over all leaves that they are bound to; one issue without requirement for a leaf without
    text. Requirements that are ignored count for nothing. (D06)"""
    asked = requirements.where(~F.coalesce(F.col("status") == "ignored", F.lit(False)))
    matrix = coverage.response_matrix(asked, leaves).select("id", "n_matched", "missing")
    names = asked.select("id", "is_risk", F.coalesce(F.nullif("title", F.lit("")), "id").alias("name"), tx.coverage_candidates(F.col("title"), F.col("keyword")).alias("cs"))
    lacks = names.join(matrix, "id")
    prefix = F.when(F.col("is_risk") == 1, "刚性风险项").otherwise("评分项")
    missing = F.concat(prefix, F.lit("「"), "name", F.lit("」评分覆盖不足：缺少必备要素 "), F.array_join("missing", ", "))
    unmatched = F.concat(prefix, F.lit("「"), "name", F.lit("」关键词未在正文中体现（期望："), F.array_join(F.slice("cs", 1, 5), ", "), F.lit("）"))
    lacks = lacks.select(F.col("id").alias("requirement_id"), F.when(F.size("missing") > 0, missing).when((F.size("cs") > 0) & (F.col("n_matched") == 0), unmatched).alias("issue"))
    written = tx.strip(F.coalesce("content", F.lit(""))) != ""
    bound = leaves.select(F.col("id").alias("leaf_id"), F.when(~written, F.col("title")).alias("title"), written.alias("written"), F.explode(F.array_distinct(tx.string_array(F.col("requirement_ids")))).alias("requirement_id"))
    bound = bound.join(lacks, "requirement_id")  # what a leaf says of itself goes with its requirements, so it is not joined again
    empty = bound.where("NOT written").groupBy("leaf_id").agg(F.first("title").alias("title"))
    empty = empty.select("leaf_id", F.lit(None).cast("string").alias("requirement_id"), F.concat(F.lit("评分覆盖：章节「"), F.coalesce("title", F.lit("None")), F.lit("」正文为空，无法覆盖已绑定评分项")).alias("issue"))
    return bound.where("written AND issue IS NOT NULL").select("leaf_id", "requirement_id", "issue").union(empty)
