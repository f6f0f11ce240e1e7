"""Keyed tables: upserts with a change log, synchronisation by content hash, versions with retention. Each operator
returns the new state (and what changed) as DataFrames; nothing is updated in place."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def upsert(table: DataFrame, patch: DataFrame, key: str, fields: list[str], defaults: dict | None = None) -> tuple[DataFrame, DataFrame]:
    """The table with the patch applied, and the change log (key, field, old_value, new_value). Null in the patch
    leaves a field as it is; rows that are not in the table come in with the defaults; equal values are no change.
    One join by key. (M01, M03-M05, Y10, Y41)"""
    p = patch.select(key, *(F.col(f).alias(f"_new_{f}") for f in fields), F.lit(True).alias("_given"))
    t = table.select(key, *fields, F.lit(True).alias("_known"))
    both = t.join(p, key, "full")
    value = {f: F.coalesce(f"_new_{f}", F.when(F.col("_known"), F.col(f)).otherwise(F.lit((defaults or {}).get(f)))) for f in fields}
    state = both.select(key, *(value[f].alias(f) for f in fields))
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    change = [F.when(F.col(f"_new_{f}").isNotNull() & (text(f) != text(f"_new_{f}")), F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("old_value"), F.col(f"_new_{f}").cast("string").alias("new_value"))) for f in fields]
    log = both.where("_known AND _given").select(key, F.explode(F.array_compact(F.array(*change))).alias("c")).select(key, "c.*")
    return state, log


def sync_by_hash(stored: DataFrame, found: DataFrame) -> DataFrame:
    """(folder, hash, action): what brings the stored chunks (folder, hash, keywords) in line with those found
    (folder, source, text, keywords): insert, update, keep, delete. Equal texts of a folder are one chunk. (M06, E05)"""
    new = found.select("folder", F.md5("text").alias("hash"), "source", "keywords").groupBy("folder", "hash").agg(F.array_join(F.array_sort(F.collect_set("source")), ",").alias("sources"), F.min("keywords").alias("new_keywords"))
    old = stored.groupBy("folder", "hash").agg(F.min("keywords").alias("keywords"), F.lit(True).alias("known"))
    both = old.join(new, ["folder", "hash"], "full")
    action = F.when(F.col("known").isNull(), "insert").when(F.col("sources").isNull(), "delete").when(~F.col("keywords").eqNullSafe(F.col("new_keywords")), "update").otherwise("keep")
    return both.select("folder", "hash", action.alias("action"), "sources")


def append_versions(versions: DataFrame, snapshot: DataFrame, keep: int = 20) -> DataFrame:
    """versions (project, chapter, content, created_at) with the snapshots added that are not blank and differ from the
    newest of their chapter, each chapter cut to its newest `keep`. (B07, F12)"""
    newest = versions.groupBy("project", "chapter").agg(F.max_by("content", "created_at").alias("last"))
    fresh = snapshot.join(newest, ["project", "chapter"], "left").where((F.trim("content") != "") & ~F.col("content").eqNullSafe(F.col("last"))).select(*versions.columns)
    rank = F.row_number().over(W.partitionBy("project", "chapter").orderBy(F.desc("created_at"), "content"))
    return versions.unionByName(fresh).withColumn("_rank", rank).where(F.col("_rank") <= keep).drop("_rank")
