"""Outlines: reordering, heading levels, splits of long leaves, nested records, and ids made unique. Nodes are (id, parent_id, sort_order, title, is_leaf and
what each function names)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import chapters as ch
from ..functions import records as rec
from ..functions import text as tx
from . import trees
from .stored import stored

#: Words of a part of a leaf without a budget of its own; words that a part has at least; fewest and most parts of a split.
TARGET, FLOOR, LEAST, MOST = 800, 400, 3, 4
#: Words from which a leaf is long, and the level below which none is split.
LONG, DEEPEST = 1500, 4


def reordered(nodes: DataFrame) -> DataFrame:
    """id, level, sort_order: depth-first order from 1 on and levels anew; what hangs below a leaf is left out."""
    nodes = stored(nodes.select("id", "parent_id", "sort_order", "title", "is_leaf"), "outline")
    open_ = nodes.where(F.coalesce(F.col("is_leaf"), F.lit(0)) != 1).select(F.col("id").alias("pid"))
    known = nodes.select(F.col("id").alias("pid"))
    lost = nodes.join(known, nodes["parent_id"] == known["pid"], "left_semi").join(open_, nodes["parent_id"] == open_["pid"], "left_anti").select("id")
    kept = nodes.join(lost, "id", "left_anti")
    # a node whose parent is left out is reached by no walk from a true root
    roots = nodes.join(known, nodes["parent_id"] == known["pid"], "left_anti").select(F.col("id").alias("root_id"))
    walked = trees.walk(kept.select("id", "parent_id", "sort_order", "title")).join(roots, "root_id", "left_semi")
    return trees.depth_first(walked).select("id", F.col("depth").alias("level"), F.col("rank").alias("sort_order"))


def heading_levels(nodes: DataFrame) -> DataFrame:
    """(id, level) of the nodes whose heading is emitted: one more than that of the nearest emitted ancestor. nodes: also
    emits (boolean). (F19)"""
    flags = nodes.select("id", F.col("emits").cast("int").alias("e"))
    up = trees.walk(nodes.select("id", "parent_id", "sort_order", "title")).select("id", F.explode(F.col("path")["id"]).alias("above"))
    counted = up.join(flags.withColumnRenamed("id", "above"), "above").groupBy("id").agg(F.sum("e").cast("int").alias("level"))
    return counted.join(flags.where("e = 1"), "id").select("id", "level")


def valid_children(children: DataFrame, least: int = LEAST, most: int = MOST) -> DataFrame:
    """(leaf_id, issues) for proposed parts (leaf_id, pos, title, brief) of leaves: how many there are, and what they lack, in
    order. (M21)"""
    title, brief = (tx.strip(F.coalesce(x, F.lit(""))) for x in ("title", "brief"))
    place = F.row_number().over(W.partitionBy("leaf_id").orderBy("pos")).cast("string")
    say = lambda *xs: F.concat(*(F.lit(x) if isinstance(x, str) else x for x in xs))
    fault = F.when(title == "", say("第 ", place, " 个子节点缺少标题")).when(brief == "", say("子节点「", title, "」缺少写作要点"))
    each = children.select("leaf_id", "pos", fault.alias("fault"))
    by = each.groupBy("leaf_id").agg(F.count("*").alias("n"), F.count_if(F.col("fault").isNull()).alias("fine"), F.array_sort(F.collect_list(F.when(F.col("fault").isNotNull(), F.struct("pos", "fault")))).alias("faults"))
    n = F.col("n").cast("string")
    before = F.array(F.when(F.col("n") < least, say("子节点数量 ", n, f" 少于 {least}")), F.when(F.col("n") > most, say("子节点数量 ", n, f" 超过 {most}")))
    after = F.array(F.when(F.col("fine") < least, "有效子节点不足"))
    return by.select("leaf_id", F.array_compact(F.concat(before, F.transform("faults", lambda f: f["fault"]), after)).alias("issues"))


def assigned_requirements(children: DataFrame, requirements: DataFrame) -> DataFrame:
    """(leaf_id, pos, requirement_id): which part of a leaf takes which of the leaf's requirements. children: (leaf_id, pos,
    text, claimed); requirements: (leaf_id, requirement_id, text), those of the leaf. Claimed ones stay with all who claim
    them; any other goes to the part with most words in common, of equals the first. The parts of a leaf, which are few, meet
    its requirements in one row: each table is shuffled once, by leaf. (D21)"""
    parts = children.groupBy("leaf_id").agg(F.collect_list(F.struct("pos", tx.match_tokens(F.col("text")).alias("words"), "claimed")).alias("parts"))
    asked = requirements.groupBy("leaf_id").agg(F.collect_set(F.struct("requirement_id", "text")).alias("rs"))
    each = asked.join(parts, "leaf_id").select("leaf_id", "parts", F.explode("rs").alias("r")).select("leaf_id", "parts", "r.requirement_id", tx.match_tokens(F.col("r.text")).alias("asked"))
    claims = F.filter("parts", lambda p: F.array_contains(p["claimed"], F.col("requirement_id")))
    best = F.array_min(F.transform("parts", lambda p: F.struct((-F.size(F.array_intersect(p["words"], "asked"))).alias("n"), p["pos"].alias("pos"))))
    # a requirement with several texts goes by the best of them; it lies with its leaf already
    found = each.groupBy("leaf_id", "requirement_id").agg(F.first(F.array_distinct(claims["pos"])).alias("claimed"), F.min(best).alias("best"))
    return found.select("leaf_id", F.explode(F.when(F.size("claimed") > 0, F.col("claimed")).otherwise(F.array("best.pos"))).alias("pos"), "requirement_id")


def words_of_parts(target_words: Column, n: Column) -> Column:
    """(parts, words): how many of n parts a leaf's words allow, and the words of each."""
    fits = F.floor(target_words / n) >= FLOOR
    parts = F.when(F.coalesce(target_words, F.lit(0)) == 0, n).when(fits, n).otherwise(F.least(n, F.greatest(F.lit(LEAST), F.floor(target_words / FLOOR))))
    words = F.when(F.coalesce(target_words, F.lit(0)) == 0, TARGET).otherwise(F.greatest(F.floor(target_words / parts), F.when(fits, 0).otherwise(FLOOR)))
    return F.struct(parts.cast("int").alias("parts"), words.cast("int").alias("words"))


def split_leaves(nodes: DataFrame, children: DataFrame) -> DataFrame:
    """nodes (id, parent_id, sort_order, title, is_leaf, target_words) with the leaves that children (leaf_id, pos, title)
    name made into containers of these parts: `leaf.1`, `leaf.2`, ... in order, each with its share of the words. Levels and
    order are anew. (M20)"""
    n = nodes.select("id", "parent_id", "sort_order", "title", "is_leaf", "target_words")
    counts = children.groupBy("leaf_id").agg(F.count("*").alias("n"))
    leaves = n.where("is_leaf = 1").join(counts, n["id"] == counts["leaf_id"]).select("leaf_id", "sort_order", words_of_parts(F.col("target_words"), F.col("n")).alias("w"))
    placed = children.withColumn("k", F.row_number().over(W.partitionBy("leaf_id").orderBy("pos")))
    made = placed.join(leaves, "leaf_id").where(F.col("k") <= F.col("w.parts"))
    made = made.select(
        F.concat("leaf_id", F.lit("."), F.col("k").cast("string")).alias("id"), F.col("leaf_id").alias("parent_id"), (F.coalesce("sort_order", F.lit(0)) + F.col("k")).alias("sort_order"),
        "title", F.lit(1).alias("is_leaf"), F.col("w.words").alias("target_words"),
    )
    split = leaves.select(F.col("leaf_id").alias("id"), F.lit(True).alias("split"))
    kept = n.join(split, "id", "left")
    kept = kept.select("id", "parent_id", "sort_order", "title", F.when(F.col("split"), 0).otherwise(F.col("is_leaf")).alias("is_leaf"), F.when(~F.coalesce("split", F.lit(False)), F.col("target_words")).alias("target_words"))
    merged = stored(kept.union(made), "split")
    return reordered(merged).join(merged.drop("sort_order"), "id")


# --- records of whole outlines ---------------------------------------------------------------------------------------
def outline_records(nodes: DataFrame, warnings: DataFrame) -> DataFrame:
    """nodes (id, parent_id, sort_order, title, level, is_leaf, requirement_ids, review_errors, writing_guidance: the last three
    JSON) in depth-first order (`rank`), their JSON parsed, with the chapter's type and, from warnings (id, warning), what went
    wrong with it. (E35, Y18)"""
    ranked = trees.depth_first(trees.walk(nodes)).select("id", "root_id", "depth", "rank")
    guidance = rec.writing_guidance(F.col("writing_guidance"))
    out = nodes.join(ranked, "id").join(warnings.select("id", F.nullif("warning", F.lit("")).alias("expand_warning")), "id", "left")
    return out.select(
        "id", "parent_id", "root_id", "depth", "rank", "title", "level", "is_leaf", tx.string_array(F.col("requirement_ids")).alias("requirement_ids"), tx.error_array(F.col("review_errors")).alias("review_errors"),
        *(guidance[n].alias(n) for n in ("brief", "content_boundary", "target_words", "style_tier")), F.col("expand_warning").isNotNull().alias("expand_degraded"), "expand_warning", ch.chapter_type(F.col("title")).alias("chapter_type"),
    )


def enrichable(nodes: DataFrame) -> DataFrame:
    """nodes as of outline_records() as the budget of words takes them."""
    g = rec.writing_guidance(F.col("writing_guidance"))
    return nodes.select(
        "id", "title", "parent_id", "sort_order", "level", "is_leaf", tx.string_array(F.col("requirement_ids")).alias("requirement_ids"), g["brief"].alias("guidance_brief"), g["content_boundary"].alias("content_boundary"),
        "writing_guidance", g["style_tier"].alias("style_tier"),
    )


def nested(nodes: DataFrame, fields: list[str]) -> DataFrame:
    """(root_id, json): each tree of nodes (id, parent_id, sort_order, title and fields) as one JSON object of its fields with
    `children`, in the order of siblings. (E35)

    Folded from the deepest level up: a level's objects are made by one join with those of the level below, gathered by
    parent, over stored levels; a row holds a subtree and the last ones a tree, as the result does."""
    depths = trees.walk(nodes).select("id", "depth")
    body = F.to_json(F.struct(*fields), {"ignoreNullFields": "false"})
    rows = stored(nodes.select("id", "parent_id", F.coalesce("sort_order", F.lit(0)).alias("so"), body.alias("body")).join(depths, "id"), "bodies", "depth")
    deepest = rows.agg(F.max("depth")).first()[0] or 0
    below = rows.limit(0).select("id", "parent_id", "so", F.col("body").alias("json"))
    for depth in range(deepest, 0, -1):
        kids = below.groupBy(F.col("parent_id").alias("pid")).agg(F.sort_array(F.collect_list(F.struct("so", "id", "json"))).alias("ks")).select("pid", F.array_join(F.col("ks")["json"], ",").alias("kids"))
        own = rows.where(F.col("depth") == depth)
        open_ = F.expr("substring(body, 1, length(body) - 1)")
        json = F.concat(open_, F.when(open_ != "{", ",").otherwise(""), F.lit('"children":['), F.coalesce("kids", F.lit("")), F.lit("]}"))
        below = stored(own.join(kids, own["id"] == kids["pid"], "left").select("id", "parent_id", "so", json.alias("json")), "subtrees")
    return below.select(F.col("id").alias("root_id"), "json")


# --- ids -------------------------------------------------------------------------------------------------------------
def free_numbers(asked: DataFrame, used: DataFrame, by: list[str], least: int = 1) -> DataFrame:
    """asked (by, j and whatever else) with number: the j-th whole number from `least` on that used (by, number) does not hold.
    Distinct used numbers u, the i-th of which leaves u - i free ones before it, are counted below each j by one running sum
    over both tables together, by key; no number is tried."""
    u = used.where(F.col("number") >= least).select(*by, "number").distinct()
    u = u.select(*by, (F.col("number") - (least - 1) - F.row_number().over(W.partitionBy(*by).orderBy("number"))).alias("before"))
    rows = asked.select(*by, F.col("j").alias("at"), F.lit(0).alias("is_used"), F.struct("*").alias("row")).unionByName(u.select(*by, (F.col("before") + 1).alias("at"), F.lit(1).alias("is_used")), allowMissingColumns=True)
    # a used number with b free ones before it comes before every j > b
    skipped = F.sum("is_used").over(W.partitionBy(*by).orderBy("at", F.desc("is_used")).rowsBetween(W.unboundedPreceding, 0))
    return rows.withColumn("number", (F.col("at") + skipped + (least - 1)).cast("long")).where("is_used = 0").select("row.*", "number")


def _numbered(ids: DataFrame, by: list[str]) -> DataFrame:
    """(by, base, number): for each prefix of ids (by, id) that ends before a dot, the number that follows it there."""
    parts = F.split("id", r"\.")
    each = F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(parts) - 1)), lambda k: F.struct(F.array_join(F.slice(parts, 1, k), ".").alias("base"), F.get(parts, k).alias("last")))
    found = ids.select(*by, F.explode(each).alias("p")).select(*by, "p.base", F.col("p.last").alias("last"))
    return found.where(F.col("last").rlike("^[1-9][0-9]{0,17}$")).select(*by, "base", F.col("last").cast("long").alias("number")).distinct()


def unique_ids(nodes: DataFrame, group: str = "project_id") -> DataFrame:
    """nodes (group, pos, id, parent_id and whatever else) with ids unique in their group, and old_id: what a renamed node was
    called, else null. (H08)

    A blank id becomes `outline-pos`. Of nodes alike in id the first by pos keeps it. A later one becomes the next free child
    of its parent, if a node of the parent's id comes before it, else `id-r2`, `id-r3` and so on. A free number is one that no
    id of the group holds and no earlier renaming took. Children of a renamed id go with the last node that bore it. Nodes
    are compared by id and numbered by parent, never sorted as a whole group."""
    own = tx.strip(F.coalesce("id", F.lit("")))
    n = stored(nodes.withColumn("id", F.when(own == "", F.concat(F.lit("outline-"), F.col("pos").cast("string"))).otherwise(own)), "nodes")
    marked = n.withColumn("_nth", F.row_number().over(W.partitionBy(group, "id").orderBy("pos")))
    again = stored(marked.where("_nth > 1").select(group, "pos", "id", "parent_id"), "again")
    ids = n.select(group, "id").distinct()
    first = n.groupBy(group, F.col("id").alias("pid")).agg(F.min("pos").alias("first"))
    placed = again.join(first, (again[group] == first[group]) & (again["parent_id"] == first["pid"]), "left").select(again[group], "pos", "id", F.when(F.col("first") < F.col("pos"), F.col("parent_id")).alias("under"))
    placed = placed.withColumn("base", F.when(F.col("under").isNotNull(), F.concat("under", F.lit("."))).otherwise(F.concat("id", F.lit("-r"))))
    placed = placed.withColumn("j", F.row_number().over(W.partitionBy(group, "base").orderBy("pos")).cast("long"))
    dotted = _numbered(ids, [group]).select(group, F.concat("base", F.lit(".")).alias("base"), "number")
    dashed = ids.where(F.col("id").rlike(r"-r[1-9][0-9]{0,17}$")).select(group, F.regexp_extract("id", r"^(.*-r)[0-9]+$", 1).alias("base"), F.regexp_extract("id", r"([0-9]+)$", 1).cast("long").alias("number"))
    by = [group, "base"]
    named = free_numbers(placed.where("under IS NOT NULL"), dotted, by).union(free_numbers(placed.where("under IS NULL"), dashed, by, 2))
    named = stored(named.select(group, "pos", F.concat("base", F.col("number").cast("string")).alias("new_id"), F.col("id").alias("old_id")), "renamed")
    moved = named.groupBy(group, F.col("old_id").alias("parent_id")).agg(F.max_by("new_id", "pos").alias("new_parent"))
    out = n.join(named, [group, "pos"], "left").join(moved, [group, "parent_id"], "left")
    new = {"id": F.coalesce("new_id", "id"), "parent_id": F.coalesce("new_parent", "parent_id")}
    return out.select(*(new[c].alias(c) if c in new else c for c in nodes.columns), "old_id")


def branch_ids(nodes: DataFrame, taken: DataFrame | None = None) -> DataFrame:
    """nodes (branch_id, branch_parent, id, parent_id, level, sort_order and whatever else), those of branches expanded apart,
    with ids of their branch alone, and old_id: what a renamed node was called. taken: ids (id) that are given already. (H09)

    By (level, sort_order, id): a node keeps its id if that is the branch's, or lies under it, is not taken and is the first of
    its kind. Others become children of their parent: of the last renamed node of the parent's id before them, else of that
    id if it lies under the branch, else of the branch. Numbers are the next free ones: no kept or taken id, nor the id
    that a renamed node has for its parent, lies at or below them. A parent is kept if it comes before the node, or is taken, and lies under the branch; else it is the branch.

    Renamed nodes hang together by references to one another; their paths are put together by pointer jumping, a stored
    table and two joins a round, so a chain of any length takes as many rounds as its logarithm. Nodes meet by id and by
    parent only: a branch may hold more of them than a task."""
    blank = lambda x: F.nullif(tx.strip(F.coalesce(x.cast("string"), F.lit(""))), F.lit(""))
    n = nodes.withColumn("_id", blank(F.col("id"))).withColumn("_pid", blank(F.col("parent_id"))).withColumn("_uid", F.monotonically_increasing_id())
    n = stored(n.withColumn("_key", F.struct(F.coalesce(F.nullif("level", F.lit(0)), F.lit(99)).alias("l"), F.coalesce("sort_order", F.lit(0)).alias("s"), F.coalesce("_id", F.lit("")).alias("i"), F.col("_uid").alias("u"))), "branches")
    taken = stored((taken if taken is not None else n.limit(0)).select(F.col("id").cast("string").alias("_id")).where("_id IS NOT NULL").distinct(), "taken").withColumn("_taken", F.lit(True))
    under = lambda x: (x == F.col("branch_id")) | x.startswith(F.concat("branch_id", F.lit(".")))
    nth = F.row_number().over(W.partitionBy("branch_id", "_id").orderBy("_key"))
    marked = n.select("branch_id", "_uid", "_key", "_id", "_pid", nth.alias("nth")).join(taken, "_id", "left")
    keeps = F.coalesce((F.col("_id") == F.col("branch_id")) | (under(F.col("_id")) & (F.col("nth") == 1) & F.col("_taken").isNull()), F.lit(False))
    marked = stored(marked.select("branch_id", "_uid", "_key", "_id", "_pid", keeps.alias("keeps")), "marked")
    kept, rest = marked.where("keeps"), marked.where("NOT keeps")
    last = rest.where("_id IS NOT NULL").groupBy("branch_id", F.col("_id").alias("_pid")).agg(F.max("_key").alias("up"))
    hung = rest.join(last, ["branch_id", "_pid"], "left")
    up = F.when(F.col("up") < F.col("_key"), F.col("up")["u"])
    hung = hung.select("branch_id", "_uid", "_key", "_id", up.alias("up"), F.when(up.isNull(), F.when(under(F.col("_pid")), F.col("_pid")).otherwise(F.col("branch_id"))).alias("base"))
    hung = hung.withColumn("j", F.row_number().over(W.partitionBy("branch_id", "up", "base").orderBy("_key")).cast("long"))
    # a taken id meets its branch by one of its own prefixes
    parts = F.split("_id", r"\.")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, 1, k), "."))
    given = taken.select(F.col("_id").alias("id"), F.explode(prefixes).alias("branch_id")).join(rest.select("branch_id").distinct(), "branch_id").select("branch_id", "id")
    named = hung.where("up IS NULL").select("branch_id", F.col("base").alias("id"))
    used = _numbered(kept.select("branch_id", F.col("_id").alias("id")).union(given).union(named).distinct(), ["branch_id"])
    based = free_numbers(hung.where("up IS NULL"), used, ["branch_id", "base"])
    chain = based.unionByName(hung.where("up IS NOT NULL").withColumn("number", F.col("j")))
    chain = stored(chain.select("branch_id", "_uid", "up", "base", F.concat(F.lit("."), F.col("number").cast("string")).alias("path")), "chain")
    open_ = chain.where("up IS NOT NULL")
    while not open_.isEmpty():
        above = chain.select(F.col("_uid").alias("up"), F.col("up").alias("up2"), F.col("base").alias("base2"), F.col("path").alias("path2"))
        moved = open_.drop("base").join(above, "up").select("branch_id", "_uid", F.col("up2").alias("up"), F.col("base2").alias("base"), F.concat("path2", "path").alias("path"))
        chain = stored(chain.where("up IS NULL").unionByName(moved), "chain")
        open_ = chain.where("up IS NOT NULL")
    new = chain.select("_uid", F.concat("base", "path").alias("_new"))
    named = stored(n.join(new, "_uid", "left"), "branches-named")
    to = named.where("_new IS NOT NULL").select(F.col("_uid").alias("to"), F.col("_new").alias("mapped"))
    known = kept.groupBy("branch_id", F.col("_id").alias("_pid")).agg(F.min("_key").alias("first"))
    out = named.join(last, ["branch_id", "_pid"], "left").join(known, ["branch_id", "_pid"], "left").join(taken.withColumnsRenamed({"_id": "_pid", "_taken": "_given"}), "_pid", "left")
    out = out.join(to, F.when(F.col("up") < F.col("_key"), F.col("up")["u"]) == F.col("to"), "left")
    stays = under(F.col("_pid")) & ((F.col("first") < F.col("_key")) | F.col("_given").isNotNull() | (F.col("_pid") == F.col("branch_id")))
    parent = F.when(F.coalesce("_new", "_id") == F.col("branch_id"), F.col("branch_parent")).when(F.col("mapped").isNotNull(), F.col("mapped")).when(stays, F.col("_pid")).otherwise(F.col("branch_id"))
    new = {"id": F.coalesce("_new", "_id"), "parent_id": parent}
    return out.select(*(new[c].alias(c) if c in new else F.col(c) for c in nodes.columns), F.when(F.col("_new").isNotNull(), F.coalesce("_id", F.lit(""))).alias("old_id"))


# --- long leaves -----------------------------------------------------------------------------------------------------
def split_refusal(is_leaf: Column, level: Column, words: Column, title: Column, threshold: int = LONG, deepest: int = DEEPEST) -> Column:
    """Why a node is not split, or null if it may be: it is no leaf, as deep as can be, short, or of a kind that is told in one
    piece. (C15, C16, Y45)"""
    level, words = F.coalesce(F.nullif(level, F.lit(0)), F.lit(1)), F.coalesce(words, F.lit(0))
    short = F.concat(F.lit("目标字数 "), words.cast("string"), F.lit(f" 低于阈值 {threshold}"))
    return (
        F.when(F.coalesce(is_leaf, F.lit(0)) != 1, "非叶子节点").when(level >= deepest, f"已达最大层级 {deepest}，无法再拆").when(words < threshold, short)
        .when(ch.is_descriptive(title), "概况/目标类章节不参与结构拆分")
    )


def split_long_leaves(nodes: DataFrame, children: DataFrame, threshold: int = LONG, deepest: int = DEEPEST) -> tuple[DataFrame, DataFrame]:
    """(nodes split, skipped): split_leaves() of the leaves of nodes (also level) that may be split and whose proposed parts (children
    as of valid_children()) have no issues; and (id, title, reason) of the other nodes that have proposals, and of ids that are no
    node. Of several issues the first two are the reason. (M22)"""
    n = stored(nodes, "long-leaves")
    refusal = split_refusal(F.col("is_leaf"), F.col("level"), F.col("target_words"), F.col("title"), threshold, deepest)
    judged = valid_children(children).join(n.select(F.col("id").alias("leaf_id"), "title", F.lit(True).alias("known"), refusal.alias("refusal")), "leaf_id", "left")
    issues = F.when(F.size("issues") > 0, F.array_join(F.slice("issues", 1, 2), "；"))
    reason = F.when(F.col("known").isNull(), "节点不存在").otherwise(F.coalesce("refusal", issues))
    judged = stored(judged.select(F.col("leaf_id"), "title", reason.alias("reason")), "judged")
    fine = children.join(judged.where("reason IS NULL").select("leaf_id"), "leaf_id", "left_semi")
    return split_leaves(n, fine), judged.where("reason IS NOT NULL").select(F.col("leaf_id").alias("id"), "title", "reason")
