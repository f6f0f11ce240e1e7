"""Changes of state as functions from tables to tables: claims, recoveries, locks, deletes, enabled folders, versions.

Spark tables have no row-level compare-and-set: a change is the new table, and where a caller must know what happened the
rows that changed are told by a column or a table of their own."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as tx
from .coverage import bindings

# What interrupted work is marked with, and where stages of parsing stand.
INTERRUPTED = "生成在服务重启前中断，请重新生成"
PARSE_INTERRUPTED = "解析在服务重启前中断，请重新上传招标文件"
STAGES = {"reading": 5, "extracting": 15, "saving": 90, "done": 100}


def claimed(projects: DataFrame, wanted: DataFrame) -> DataFrame:
    """projects (id, status, ...) with those wanted (id) set to generating, and `won`: true where the claim took, false where
    the project was generating already, null where nobody asked. (C12)"""
    asked = wanted.select("id").distinct().withColumn("asked", F.lit(True))
    won = F.when(F.col("asked"), F.coalesce(F.col("status") != "generating", F.lit(True)))
    return projects.join(asked, "id", "left").withColumn("won", won).withColumn("status", F.when(F.col("won"), "generating").otherwise(F.col("status"))).drop("asked")


def marked_red(leaves: DataFrame, hit: Column, message: str) -> DataFrame:
    """leaves (id, project_id, is_leaf, review_status, review_errors) with the generating ones that `hit` holds for as red,
    with the message, and `changed`. (M17)"""
    changed = F.coalesce(hit & (F.col("is_leaf") == 1) & (F.col("review_status") == "generating"), F.lit(False))
    out = leaves.withColumn("changed", changed)
    return out.withColumns({"review_status": F.when(F.col("changed"), "red").otherwise(F.col("review_status")), "review_errors": F.when(F.col("changed"), F.to_json(F.array(F.lit(message)))).otherwise(F.col("review_errors"))})


def recovered_generations(projects: DataFrame, leaves: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both tables after a restart: projects that were generating have their outline locked and no pause, their leaves that
    were are red. (M15)"""
    stuck = projects.where("status = 'generating'").select(F.col("id").alias("project_id"), F.lit(True).alias("stuck"))
    after = projects.withColumns({"pause_requested": F.when(F.col("status") == "generating", 0).otherwise(F.col("pause_requested")), "status": F.when(F.col("status") == "generating", "outline_locked").otherwise(F.col("status"))})
    return after, marked_red(leaves.join(stuck, "project_id", "left"), F.coalesce("stuck", F.lit(False)), INTERRUPTED).drop("stuck", "changed")


def recovered_parsing(projects: DataFrame) -> DataFrame:
    """projects (id, status, parse_error) after a restart: those that were parsing wait for confirmation, with an error."""
    was = F.col("status") == "parsing"
    return projects.withColumns({"parse_error": F.when(was, PARSE_INTERRUPTED).otherwise(F.col("parse_error")), "status": F.when(was, "confirming").otherwise(F.col("status"))})


def failure_events(leaves: DataFrame, hit: Column, message: str) -> DataFrame:
    """(project_id, chapter_id, stage, message): an error event for each leaf that marked_red() changes."""
    return marked_red(leaves, hit, message).where("changed").select("project_id", F.col("id").alias("chapter_id"), F.lit("error").alias("stage"), F.lit(message).alias("message"))


def cascaded(tables: dict[str, DataFrame], links: dict[str, tuple[str, str, str]], root: str, gone: DataFrame, key: str = "id") -> dict[str, DataFrame]:
    """The tables without the rows of `root` whose key is in gone, and without what hangs on them. links: child table to
    (its column, parent table, the parent's key), parents first. (M14)"""
    lost = {root: tables[root].join(gone.select(key).distinct(), key, "left_semi")}
    out = {root: tables[root].join(gone.select(key).distinct(), key, "left_anti")}
    for child, (column, parent, parent_key) in links.items():
        dead = lost[parent].select(F.col(parent_key).alias(column)).distinct()
        lost[child], out[child] = tables[child].join(dead, column, "left_semi"), tables[child].join(dead, column, "left_anti")
    return {name: out.get(name, df) for name, df in tables.items()}


def locked_outlines(leaves: DataFrame, requirements: DataFrame) -> DataFrame:
    """(project_id, locked, blocking): a project's outline is locked unless a risk requirement of it is bound by none of its
    leaves; how many are. leaves: (project_id, id, requirement_ids); requirements: (project_id, id, is_risk). (M18)"""
    bound = bindings(leaves).join(leaves.select(F.col("id").alias("leaf_id"), "project_id"), "leaf_id").select("project_id", F.col("requirement_id").alias("id")).distinct()
    open_ = requirements.where("is_risk = 1").join(bound, ["project_id", "id"], "left_anti").groupBy("project_id").agg(F.count("*").alias("blocking"))
    out = leaves.select("project_id").distinct().join(open_, "project_id", "left").withColumn("blocking", F.coalesce("blocking", F.lit(0)).cast("long"))
    return out.select("project_id", (F.col("blocking") == 0).alias("locked"), "blocking")


def enabled(bridge: DataFrame, added: DataFrame, removed: DataFrame) -> DataFrame:
    """bridge (project_id, folder) with pairs added that it lacks and pairs removed."""
    key = ["project_id", "folder"]
    kept = bridge.join(removed.select(*key).distinct(), key, "left_anti")
    new = added.select(*key).distinct().join(bridge.select(*key).distinct(), key, "left_anti").join(removed.select(*key).distinct(), key, "left_anti")
    return kept.select(*key).union(new)


def next_children(nodes: DataFrame) -> DataFrame:
    """(parent_id, next): for each parent the least number from 1 on whose `parent.number` is no id."""
    used = nodes.select("parent_id", F.regexp_extract("id", r"\.([1-9][0-9]*)$", 1).try_cast("int").alias("n"), "id")
    used = used.where(F.col("id") == F.concat("parent_id", F.lit("."), F.col("n").cast("string"))).select("parent_id", "n").distinct()
    # where the numbers run on without a gap, a number is its own place
    placed = used.withColumn("place", F.row_number().over(W.partitionBy("parent_id").orderBy("n")))
    run = placed.where("n = place").groupBy("parent_id").agg(F.max("n").alias("last"))
    parents = nodes.select("parent_id").where("parent_id IS NOT NULL").distinct()
    return parents.join(run, "parent_id", "left").select("parent_id", (F.coalesce("last", F.lit(0)) + 1).alias("next"))


def under_branch(node_id: Column, branch_id: Column) -> Column:
    """The branch itself or an id that begins with it and a dot."""
    return (node_id == branch_id) | F.startswith(node_id, F.concat(branch_id, F.lit(".")))


def parse_percent(stage: Column, index: Column, total: Column) -> Column:
    """How far parsing is; extracting moves on from 15 to 85 by chunks."""
    by_chunk = 15 + F.floor(70 * F.least(index, total) / F.greatest(total, F.lit(1)))
    out = reduce(lambda acc, kv: F.when(stage == kv[0], kv[1]).otherwise(acc), STAGES.items(), F.lit(0))
    return F.when((stage == "extracting") & (F.coalesce(total, F.lit(0)) > 0), by_chunk).otherwise(out).cast("int")


def matched_rules(chapters: DataFrame, rules: DataFrame, most: int = 4) -> DataFrame:
    """(id, pos, rule) of the first rules (pos, rule, keywords), a small stated set, of which a keyword occurs in a chapter's
    title, brief or boundary. (D27)"""
    pack = rules.agg(F.array_sort(F.collect_list(F.struct("pos", "rule", "keywords"))).alias("pack"))
    text = F.concat_ws(" ", "title", "brief", "boundary")
    each = chapters.select("id", text.alias("t")).crossJoin(F.broadcast(pack))  # one row
    hits = F.slice(F.filter("pack", lambda r: F.exists(r["keywords"], lambda k: (k != "") & F.contains("t", k))), 1, most)
    return each.select("id", F.explode(hits).alias("r")).select("id", "r.pos", "r.rule")


def versions(snapshots: DataFrame, most: int = 20) -> DataFrame:
    """(chapter_id, version_id, nth, preview) of the newest snapshots (chapter_id, version_id, at, content) of each chapter."""
    nth = F.row_number().over(W.partitionBy("chapter_id").orderBy(F.desc("at"), F.desc("version_id")))
    return snapshots.withColumn("nth", nth).where(F.col("nth") <= most).select("chapter_id", "version_id", "nth", F.substring(tx.strip(F.coalesce("content", F.lit(""))), 1, 120).alias("preview"))


def restored(chapters: DataFrame, snapshots: DataFrame, wanted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """chapters (id, content) with the content of the wanted versions (id, version_id), and the snapshots to add: what the
    chapters held before. A wanted version that is not the chapter's changes nothing. (M13)"""
    old = wanted.join(snapshots.select("version_id", F.col("chapter_id").alias("id"), F.col("content").alias("old")), ["id", "version_id"]).select("id", "old")
    both = chapters.join(old.withColumn("found", F.lit(True)), "id", "left")
    after = both.select("id", F.when(F.col("found"), F.col("old")).otherwise(F.col("content")).alias("content"))
    return after, both.where("found").select(F.col("id").alias("chapter_id"), "content")


def without_items(items: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """items without those in gone (id), and (id, found): whether each of them was there."""
    ids = gone.select("id").distinct()
    known = items.select("id").distinct().withColumn("known", F.lit(True))
    return items.join(ids, "id", "left_anti"), ids.join(known, "id", "left").select("id", F.coalesce("known", F.lit(False)).alias("found"))


def folders_of(bridge: DataFrame, projects: DataFrame) -> DataFrame:
    """(project_id, folders): the folders that are enabled for each project (project_id), sorted; none: an empty list."""
    by = bridge.groupBy("project_id").agg(F.array_sort(F.collect_set("folder")).alias("folders"))
    return projects.select("project_id").distinct().join(by, "project_id", "left").select("project_id", F.coalesce("folders", F.array().cast("array<string>")).alias("folders"))


def confirmed_fields(confirmed: Column, touched: Column, protectable: list[str]) -> Column:
    """Fields that a person has confirmed: those so far and those touched that can be protected, sorted."""
    none = F.array().cast("array<string>")
    return F.array_sort(F.array_union(F.coalesce(confirmed, none), F.array_intersect(F.coalesce(touched, none), F.array(*map(F.lit, protectable)))))


def folder_states(states: DataFrame, patch: DataFrame) -> DataFrame:
    """states (folder, status, error, item_count) with those of patch in their place; a count that patch leaves null stays, and
    an error goes with a new status. (Y10)"""
    new = patch.select("folder", F.col("status").alias("s"), F.col("error").alias("e"), F.col("item_count").alias("n"), F.lit(True).alias("given"))
    both = states.join(new, "folder", "full")
    pick = lambda a, b: F.when(F.col("given"), F.col(a)).otherwise(F.col(b))
    return both.select("folder", pick("s", "status").alias("status"), pick("e", "error").alias("error"), F.coalesce("n", "item_count").alias("item_count"))
