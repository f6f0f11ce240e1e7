"""Classifiers and decision tables over chapter titles and texts, Column to Column."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import contains_any, let, strip

# Marker lists that results depend on.
GOAL_EXCLUDE = ["措施", "保证", "方案", "计划", "组织", "方法"]
GOAL_MARKERS = ["项目目标", "质量目标", "工期目标", "进度目标", "造价目标", "成本目标", "安全目标", "文明施工目标"]
GOAL_TOPICS = ["质量", "工期", "进度", "造价", "成本", "安全", "文明"]
OVERVIEW_EXCLUDE = [*GOAL_EXCLUDE, "应对", "对策", "解决"]
OVERVIEW_MARKERS = ["项目特点", "工程特点", "工程概况", "项目概况", "项目背景", "建设规模", "工程简介", "项目简介", "工程规模", "现场条件", "施工条件", "自然环境", "社会环境"]
SCOPE_MARKERS = ["设计范围", "工作范围", "服务范围", "承包范围", "招标范围", "范围界定", "范围定义", "工作界面", "接口界面"]
ORGANISATION_MARKERS = ["组织机构", "组织架构", "岗位职责", "人员配置", "管理体系", "组织管理"]
TECHNICAL_MARKERS = ["工艺", "方案", "措施", "吊装", "安装", "调试", "试验", "施工方法", "专项", "工序", "关键技术"]
COMPLEX_TITLES = ["施工方案", "技术方案", "施工组织", "专项方案", "进度计划"]
BLIND_MARKERS = ["暗标", "匿名评审", "盲评", "不得出现投标人名称", "隐去投标人信息"]
STYLE_TIERS = ["rigorous", "balanced", "innovative"]


def is_goal(title: Column) -> Column:
    """(I33)"""
    t = strip(F.coalesce(title, F.lit("")))
    return t.contains("目标") & ~contains_any(t, GOAL_EXCLUDE) & (contains_any(t, GOAL_MARKERS) | contains_any(t, GOAL_TOPICS))


def is_overview(title: Column) -> Column:
    """(I34)"""
    t = strip(F.coalesce(title, F.lit("")))
    special = t.contains("特点") & ~contains_any(t, ["技术特点", "性能特点"]) & contains_any(t, ["项目", "工程", "施工"])
    return ~contains_any(t, OVERVIEW_EXCLUDE) & (contains_any(t, OVERVIEW_MARKERS) | contains_any(t, ["概况", "简介"]) | special)


def chapter_type(title: Column) -> Column:
    """(I32)"""
    return F.when(is_goal(title), "goal").when(is_overview(title), "overview").otherwise("construction")


def is_descriptive(title: Column) -> Column:
    """(I35)"""
    return chapter_type(title) != "construction"


def word_budget_weight(title: Column) -> Column:
    """(I36)"""
    t = strip(F.coalesce(title, F.lit("")))
    kind = chapter_type(t)
    return (
        F.when(t == "", 1.0)
        .when(kind == "goal", 0.5)
        .when(kind == "overview", 0.65)
        .when(contains_any(t, SCOPE_MARKERS), 0.7)
        .when(contains_any(t, ORGANISATION_MARKERS), 0.85)
        .when(contains_any(t, TECHNICAL_MARKERS), 1.15)
        .otherwise(1.0)
    )


def skip_content_plan(title: Column, target_words: Column, threshold: int = 500) -> Column:
    """(C18)"""
    n = F.coalesce(target_words, F.lit(0))
    return is_descriptive(title) | ((n > 0) & (n < threshold))


def should_segment(split_origin: Column, target_words: Column, key_points: Column) -> Column:
    """(C19)"""
    return ~F.coalesce(split_origin, F.lit(False)) & (F.coalesce(target_words, F.lit(0)) >= 1800) & (F.coalesce(key_points, F.lit(0)) >= 4)


def retrieval_route(title: Column, score: Column, target_words: Column, key_points: Column, followup: Column) -> Column:
    """Struct of mode, top_k, use_vector."""
    score, words, points = (F.coalesce(c, F.lit(0)) for c in (score, target_words, key_points))
    deep = (score >= 5) | (words >= 1800) | (points >= 4) | (contains_any(F.coalesce(title, F.lit("")), COMPLEX_TITLES) & (score >= 3))
    mode = F.when(F.coalesce(followup, F.lit(False)), "plan_followup").when(is_descriptive(title), "light").when(deep, "deep").otherwise("standard")
    top_k = lambda m: F.when(m == "plan_followup", 4).when(m == "light", 3).when(m == "deep", 8).otherwise(5)
    return let(mode, lambda m: F.struct(m.alias("mode"), top_k(m).alias("top_k"), (m != "light").alias("use_vector")))


def blind_bid(text: Column) -> Column:
    """True on a marker, else null: no evidence either way. (I64)"""
    return F.when(contains_any(F.coalesce(text, F.lit("")), BLIND_MARKERS), True)


def style_tier(x: Column) -> Column:
    """(Y35)"""
    t = F.lower(strip(F.coalesce(x, F.lit(""))))
    return F.when(t.isin(STYLE_TIERS), t).otherwise("balanced")


def row_status(bound: Column, written: Column, answered: Column, complete: Column, ignored: Column) -> Column:
    """Status of a requirement: whether leaves are bound, one has content, one with content matches, no element is
    missing. (Y01)"""
    return F.when(ignored, "ignored").when(~bound, "unbound").when(answered & complete, "covered").when(written, "partial").otherwise("bound_pending")
