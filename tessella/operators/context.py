"""What a chapter is written from: its path, its neighbours and what they say, its requirements, facts and material."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import chapters as ch
from ..functions import records as rec
from ..functions import text as tx
from . import coverage, trees
from .stored import dealt

# How much of what comes before is told, and what is said where there is nothing.
SUMMARIES, CONTENTS, SHORTEST, TOLD, TAIL, SOURCE = 5, 3, 120, 2500, 1500, 400
RUN, COPIES = 64, 32  # siblings one after the other that are dealt out together, and to how many places a family's go at most
CUT, NO_REQUIREMENTS, APART, MERGED = "（…前文省略…）\n", "（本章未绑定评分项）", "\n\n---\n\n", 8
NO_MATERIAL = "本节无可用检索素材：请基于评分项、工程参数与项目概况撰写；禁止编造规范标准号与未提供的品牌型号；缺数据处用 **[参数] 待核实** 标注。"


def neighbours(nodes: DataFrame) -> DataFrame:
    """(id, project_id, path, titles, place and, for leaves, last_summary, prior_summaries, prior_contents, prior_title, prior_body,
    sibling_titles, sibling_text: these joined by "|") of nodes (project_id, id, parent_id, sort_order, title, is_leaf, last_summary, content): the leaves of a
    project in depth-first order. (F02, F03, F04, F05, D19, F11)

    What a leaf is told of those before it are frames of at most five rows: over the leaves with a summary, and over those
    with a body of 120 characters, of which the last frame that is complete goes on to it. Bodies are cut before they are
    gathered. Siblings are gathered once for their parent, and join the leaves last: their titles are no part of what is
    shuffled by leaf."""
    told, titles = _told(nodes)
    out = _with_siblings(told, titles)
    return out.withColumn("sibling_text", F.concat(*_others("_barred", "|"))).drop("parent_id", "_nth", "_at", "_long", "_many", "_barred", "_listed")


def _told(nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """neighbours() with parent_id, _nth (the place among siblings), _at and _long (the bytes of the titles before its own among
    them, and of its own) in place of sibling_titles, and the titles of each parent's leaves in order, also joined to one text
    for each of two marks."""
    walked = trees.walk(nodes.select("id", "parent_id", "sort_order", "title")).select("id", "path", "titles")
    leaf = nodes.where("is_leaf = 1").join(walked, "id")
    body, said = tx.strip(F.coalesce("content", F.lit(""))), tx.strip(F.coalesce("last_summary", F.lit("")))
    leaf = leaf.select(
        "project_id", "id", "parent_id", "sort_order", "title", "path", "titles", "last_summary", F.when(said != "", F.concat(F.lit("「"), F.coalesce("title", F.lit("")), F.lit("」"), said)).alias("s"),
        F.when(F.length(body) >= SHORTEST, F.substring(body, 1, TOLD)).alias("b"),
        F.when(body != "", F.when(F.length(body) > TAIL, F.concat(F.lit(CUT), F.right(body, F.lit(TAIL)))).otherwise(body)).alias("tail"),
    )
    order = W.partitionBy("project_id").orderBy("path")
    before = order.rowsBetween(W.unboundedPreceding, -1)
    for name, most in (("s", SUMMARIES), ("b", CONTENTS)):  # frames over the rows that have one, by their number
        some = W.partitionBy("project_id", F.col(name).isNotNull()).orderBy("path").rowsBetween(-(most - 1), 0)
        leaf = leaf.withColumn(f"{name}s", F.when(F.col(name).isNotNull(), F.collect_list(name).over(some)))
    none = F.array().cast("array<string>")
    last = lambda name: F.coalesce(F.last(name, ignorenulls=True).over(before), none)
    siblings = W.partitionBy("project_id", "parent_id").orderBy(F.coalesce("sort_order", F.lit(0)), "path")
    own = lambda x: F.when(F.col("parent_id").isNotNull(), F.lag(x).over(siblings))
    family = W.partitionBy("project_id", "parent_id").orderBy("path")
    title = tx.strip(F.coalesce("title", F.lit("")))
    long = F.octet_length(title)
    told = leaf.select(
        "project_id", "id", "parent_id", "path", "titles", F.row_number().over(order).alias("place"), F.lag("last_summary").over(order).alias("last_summary"), last("ss").alias("prior_summaries"), last("bs").alias("prior_contents"),
        own(F.nullif(tx.strip(F.col("title")), F.lit(""))).alias("prior_title"), own("tail").alias("prior_body"), F.row_number().over(family).alias("_nth"),
        F.coalesce(F.sum(long).over(family.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).cast("int").alias("_at"), long.alias("_long"),
    )
    all_ = F.sort_array(F.collect_list(F.struct("path", title.alias("title"))))["title"]
    titles = leaf.groupBy(F.col("project_id").alias("_project"), F.col("parent_id").alias("_parent")).agg(all_.alias("_all"))
    joined = lambda mark: F.array_join("_all", mark).cast("binary")
    return told, titles.select("*", joined("|").alias("_barred"), joined("、").alias("_listed"), F.size("_all").alias("_many"))


def _with_siblings(rows: DataFrame, titles: DataFrame) -> DataFrame:
    """rows of _told() with sibling_titles: all but the own one of their parent's, and the texts of all of these (_barred, _listed).
    This is the work that grows with the square of a family, and families and projects may be few: a family's rows are dealt
    out in runs before, to COPIES places at most, and its titles go to each of these once."""
    run = lambda nth: F.pmod(F.floor((nth - 1) / RUN), F.lit(COPIES)).cast("int")
    given = rows.columns
    rows = dealt(rows.withColumns({"_of": F.struct("project_id", "parent_id"), "_run": run(F.col("_nth"))}), "_of", "_run")  # a struct, as its fields may be null
    runs = F.least(F.ceil(F.col("_many") / RUN), F.lit(COPIES)).cast("int")
    titles = titles.select("*", F.struct(F.col("_project").alias("project_id"), F.col("_parent").alias("parent_id")).alias("_family"), F.explode(F.sequence(F.lit(0), runs - 1)).alias("_place"))
    same = (F.col("_of") == F.col("_family")) & (F.col("_run") == F.col("_place"))
    others = F.concat(F.slice("_all", F.lit(1), F.col("_nth") - 1), F.slice("_all", F.col("_nth") + 1, F.size("_all")))
    return rows.join(titles, same).select(*given, others.alias("sibling_titles"), "_many", "_barred", "_listed")


def _others(text: str, mark: str) -> tuple[Column, Column]:
    """What stands before and after the own title in the text of a family's titles, which `mark` joins: together the other
    titles so joined. These are bytes cut out of one text, so no title is touched by itself for each of its siblings."""
    wide, first = len(mark.encode()), F.col("_nth") == 1
    at = F.col("_at") + (F.col("_nth") - 1) * wide
    before = F.substring(text, F.lit(1), F.greatest(at - wide, F.lit(0)))
    after = F.substring(text, at + F.col("_long") + 1 + F.when(first, wide).otherwise(0), F.octet_length(text))
    return before.cast("string"), after.cast("string")


def boundary(title: Column, given: Column, some: Column, siblings: tuple[Column, ...]) -> Column:
    """What a chapter keeps to: what is given, else its kind's default, else that its siblings, if there are `some`, are left
    alone; their titles are the parts of one text. (Y53)"""
    alone = F.lit("仅撰写「"), title, F.lit("」对应正文，不输出章节标题行，不重复上一章摘要。")
    apart = F.when(some, F.concat(*alone, F.lit("不得涉及兄弟章节："), *siblings, F.lit("。"))).otherwise(F.concat(*alone))
    return F.coalesce(F.nullif(given, F.lit("")), F.nullif(rec.default_boundary(title), F.lit("")), apart)


def bound_requirements(leaves: DataFrame, requirements: DataFrame) -> DataFrame:
    """(id, requirements): the requirements (id, title, keyword, elements, score, is_risk, category, evidence, hint, source) that the
    JSON of each leaf (id, requirement_ids) names, as structs in order of their ids. (L16)"""
    fields = ["title", "keyword", "elements", "score", "is_risk", "category", "evidence", "hint", "source"]
    named = coverage.bindings(leaves).select("leaf_id", "requirement_id").distinct()
    each = named.join(requirements.select(F.col("id").alias("requirement_id"), F.struct("id", *fields).alias("r")), "requirement_id")
    return each.groupBy(F.col("leaf_id").alias("id")).agg(F.sort_array(F.collect_list("r")).alias("requirements"))


def bundles(nodes: DataFrame, requirements: DataFrame, facts: DataFrame) -> DataFrame:
    """The context of every leaf of nodes (as of neighbours(), with requirement_ids and writing_guidance, both JSON): all that
    neighbours() tells of it, its path, guidance with a boundary, requirements as text, the query for its material and the
    route that this takes, and the facts (project_id, title, content, sort_order) of its project. (L16)

    Texts go no further than their own row and the frames of neighbours(); a project's facts are one row a project."""
    leaf = nodes.where("is_leaf = 1").select("id", "title", "requirement_ids", rec.writing_guidance(F.col("writing_guidance")).alias("g"))
    told, siblings = _told(nodes)
    known = facts.where(tx.strip(F.coalesce("content", F.lit(""))) != "").groupBy("project_id").agg(F.sort_array(F.collect_list(F.struct("sort_order", "title", "content"))).alias("fs"))
    known = known.select("project_id", F.array_join(F.transform("fs", lambda f: F.concat(F.lit("【"), f["title"], F.lit("】\n"), f["content"])), "\n\n").alias("facts_text"))
    out = leaf.join(told, "id").join(bound_requirements(leaf, requirements), "id", "left").join(known, "project_id", "left")
    out = _with_siblings(out, siblings)
    rs = F.coalesce("requirements", F.expr("filter(requirements, x -> false)"))
    block = lambda r: rec.requirement_block(r["title"], r["score"], r["is_risk"], r["category"], r["keyword"], r["elements"], r["evidence"], r["hint"], r["source"])
    text = F.when(F.size("requirements") > 0, F.array_join(F.transform(rs, block), "\n\n")).otherwise(NO_REQUIREMENTS)
    words = F.flatten(F.transform(rs, lambda r: F.array(r["keyword"], r["elements"], F.substring(r["source"], 1, SOURCE))))
    titles = F.array_join(F.transform(rs, lambda r: r["title"]), " ")
    asked = F.concat(F.array(F.col("title"), titles, F.col("g.brief"), F.col("g.content_boundary")), F.coalesce(words, F.array().cast("array<string>")))
    score = F.coalesce(F.aggregate(rs, F.lit(0.0), lambda a, r: a + F.coalesce(r["score"].cast("double"), F.lit(0.0))), F.lit(0.0))
    return out.select(
        "project_id", "id", "place", F.array_join("titles", " > ").alias("chapter_path"), "last_summary", "prior_summaries", "prior_contents", "prior_title", "prior_body", "sibling_titles", F.concat(*_others("_barred", "|")).alias("sibling_text"),
        F.col("g.brief").alias("brief"), boundary(F.col("title"), F.col("g.content_boundary"), F.col("_many") > 1, _others("_listed", "、")).alias("content_boundary"), text.alias("requirements_text"),
        tx.strip(F.array_join(F.filter(asked, lambda x: F.coalesce(x, F.lit("")) != ""), " ")).alias("query"), ch.retrieval_route(F.col("title"), score, F.col("g.target_words"), F.lit(0), F.lit(False)).alias("route"),
        F.coalesce("facts_text", F.lit("")).alias("facts_text"),
    )


def with_material(bundles_: DataFrame, found: DataFrame, reasons: DataFrame) -> DataFrame:
    """bundles with what was retrieved for each (found: id, rank, text; reasons: id, reason): retrieval_text, hit_count, and,
    without a hit, why and what to do then. (L16)"""
    by = found.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("rank", "text"))).alias("_ts"))
    out = bundles_.join(by, "id", "left").join(reasons, "id", "left")
    n = F.coalesce(F.size("_ts"), F.lit(0))
    n = F.greatest(n, F.lit(0))
    reason = F.when(n == 0, F.coalesce("reason", F.lit("no_match")))
    return out.select(*bundles_.columns, F.coalesce(F.array_join(F.col("_ts")["text"], APART), F.lit("")).alias("retrieval_text"), n.alias("hit_count"), reason.alias("empty_reason"), F.when((n == 0) & F.col("reason").isNotNull(), NO_MATERIAL).alias("empty_hint"))


def with_more(material: DataFrame, found: DataFrame, most: int = MERGED) -> DataFrame:
    """with_material() after a second search (found: id, rank, text): the first texts and the new ones that are not among them,
    `most` at most; a chapter for which it found nothing stays as it was. (L14)"""
    by = found.where(F.coalesce("text", F.lit("")) != "").groupBy("id").agg(F.sort_array(F.collect_list(F.struct("rank", "text"))).alias("_ts"))
    out = material.join(by, "id", "left")
    own = F.when(tx.strip(F.col("retrieval_text")) != "", F.split("retrieval_text", APART)).otherwise(F.array().cast("array<string>"))
    def merged(mine: Column) -> Column:
        all_ = F.slice(F.concat(mine, F.array_except(F.col("_ts")["text"], mine)), 1, most)
        return tx.let(all_, lambda xs: F.struct(F.array_join(xs, APART).alias("text"), F.size(xs).alias("n")))

    more, both = F.col("_ts").isNotNull(), tx.let(own, merged)
    none = F.lit(None).cast("string")
    new = {"retrieval_text": both["text"], "hit_count": both["n"], "empty_reason": none, "empty_hint": none}
    return out.select(*(F.when(more, new[c]).otherwise(F.col(c)).alias(c) if c in new else c for c in material.columns))


# --- plans of chapters -----------------------------------------------------------------------------------------------
def plan_issues(title: Column, target_words: Column, last_summary: Column, points: Column, methods: Column, avoid: Column, words: Column, elements: Column) -> Column:
    """What is wrong with a chapter's plan: points, methods and avoid are arrays, words the plan's own number, elements those that
    the chapter must have; all null: the plan is empty. (Q38)"""
    some = lambda xs: F.filter(F.transform(F.coalesce(xs, F.array().cast("array<string>")), lambda x: tx.strip(F.coalesce(x, F.lit("")))), lambda x: x != "")
    empty = points.isNull() & methods.isNull() & avoid.isNull() & words.isNull()
    ps = some(points)
    off = F.abs(words - target_words) / target_words > 0.35
    lacking = tx.let(F.array_join(ps, " "), lambda blob: F.filter(some(elements), lambda e: ~tx.phrase_covered(blob, e)))
    shown = F.array_join(F.array_distinct(F.slice(lacking, 1, 5)), "、")
    found = F.array(
        F.when(F.size(ps) < 2, "写作规划 key_points 少于 2 条"), F.when(~ch.is_descriptive(title) & (F.size(some(methods)) == 0), "施工/方案类章节规划缺少 technical_methods"),
        F.when((F.coalesce(last_summary, F.lit("")) != "") & (F.size(some(avoid)) == 0), "存在上一章摘要但规划 avoid 为空，易导致跨章重复"),
        F.when((target_words > 0) & (words != 0) & off, F.concat(F.lit("规划字数 "), words.cast("string"), F.lit(" 与目标 "), target_words.cast("string"), F.lit(" 偏差过大"))),
        F.when((F.size(ps) > 0) & (shown != ""), F.concat(F.lit("规划 key_points 未体现必备要素："), shown)),
    )
    return F.when(empty, F.array(F.lit("写作规划为空"))).otherwise(F.array_compact(found))


def fallback_plan(title: Column, brief: Column, requirements_text: Column, target_words: Column, last_summary: Column, priors: Column) -> Column:
    """The plan of a chapter for which none could be made: points from its brief and the short lines of its requirements. (Q39)"""
    name = F.coalesce(F.nullif(title, F.lit("")), F.lit("本章"))
    lines = F.transform(tx.split_lines(requirements_text), lambda x: F.regexp_replace(F.regexp_replace(tx.strip(x), "^【+", ""), "】+$", ""))
    lines = F.filter(lines, lambda x: F.length(x).between(4, 40) & ~x.startswith("http"))
    own = F.coalesce(tx.strip(brief), F.lit(""))
    first = F.when(own != "", F.array(F.substring(own, 1, 80))).otherwise(F.array().cast("array<string>"))
    points = F.slice(F.concat(first, lines), 1, 6)
    general = F.array(F.concat(name, F.lit("总体要求")), F.concat(name, F.lit("关键措施与控制要点")), F.concat(name, F.lit("验收与保障")))
    points = F.when(F.size(points) < 2, general).otherwise(points)
    avoid = F.array_compact(F.array(F.when(F.coalesce(last_summary, F.lit("")) != "", "勿重复上一章已写工艺与参数"), F.when(F.size(priors) > 0, "勿展开前序章节已覆盖的同类措施")))
    methods = F.when(ch.is_descriptive(name), F.array().cast("array<string>")).otherwise(F.array(F.concat(name, F.lit("主要工艺"))))
    words = F.coalesce(F.nullif(target_words, F.lit(0)), F.lit(1000))
    return F.struct(points.alias("key_points"), methods.alias("technical_methods"), words.cast("int").alias("word_count_target"), avoid.alias("avoid"), F.slice(points, 1, 4).alias("retrieval_focus"))
