"""Trees held as adjacency lists: order, ancestors, paths. Nodes are (id, parent_id, sort_order, title)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .stored import stored


def walk(nodes: DataFrame, levels: int = 64) -> DataFrame:
    """nodes with path (array of structs that sorts in depth-first order), root_id, depth, titles (from the root on).

    Nodes whose parent does not exist are roots; siblings go by (sort_order, id); nodes on a cycle are never
    reached and are left out. Each level is a stored table, made by one join with the level above it, so no plan holds more
    than one level. (F06, F09, F11, J-path)"""
    key = F.struct(F.coalesce("sort_order", F.lit(0)).alias("so"), F.col("id").alias("id"))
    n = stored(nodes.select("id", "parent_id", "sort_order", "title"), "nodes")
    parents = n.select(F.col("id").alias("pid")).distinct()
    roots = n.join(parents, n["parent_id"] == parents["pid"], "left_anti")
    level = stored(roots.select("*", F.array(key).alias("path"), F.col("id").alias("root_id"), F.lit(1).alias("depth"), F.array(F.coalesce("title", F.lit(""))).alias("titles")), "level")
    found = [level]
    for _ in range(levels):
        up = level.select(F.col("id").alias("pid"), F.col("path").alias("ppath"), "root_id", F.col("depth").alias("pdepth"), F.col("titles").alias("ptitles"))
        level = n.join(up, n["parent_id"] == up["pid"]).select(
            *n.columns, F.array_append("ppath", key).alias("path"), "root_id", (F.col("pdepth") + 1).alias("depth"), F.array_append("ptitles", F.coalesce("title", F.lit(""))).alias("titles")
        )
        level = stored(level, "level")
        if level.isEmpty():
            return reduce(DataFrame.union, found)
        found.append(level)
    raise ValueError(f"a tree of more than {levels} levels")


def depth_first(walked: DataFrame) -> DataFrame:
    """walked with rank: the place in depth-first order over all trees, roots among themselves by their key.

    Paths begin with the root's key, so this is their order. They are dealt out by ranges of it, and stored, as the bounds are
    drawn anew each time; places are counted range by range, and a range's offset comes from the sizes of those before it. So a
    task holds a range, however large a tree is. (F06, F08)"""
    n = int(walked.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = stored(walked.repartitionByRange(n, "path").withColumn("_range", F.spark_partition_id()), "ranges")
    sizes = dealt.groupBy("_range").agg(F.count("*").alias("size"))
    before = F.coalesce(F.sum("size").over(W.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    own = dealt.withColumn("_own", F.row_number().over(W.partitionBy("_range").orderBy("path")))
    return own.join(F.broadcast(sizes.select("_range", before.alias("_before"))), "_range").withColumn("rank", (F.col("_before") + F.col("_own")).cast("long")).drop("_range", "_own", "_before")


def leaves(ranked: DataFrame, nodes: DataFrame) -> DataFrame:
    """The nodes of depth_first() that have no children, with their place among leaves. A leaf's place is counted within
    its tree; what earlier trees hold is one row a tree. (F08)"""
    parents = nodes.select(F.col("parent_id").alias("pid")).where("pid IS NOT NULL").distinct()
    bare = ranked.join(parents, ranked["id"] == parents["pid"], "left_anti")
    own = bare.withColumn("own", F.row_number().over(W.partitionBy("root_id").orderBy("rank")))
    trees = own.groupBy("root_id").agg(F.max("own").alias("size"), F.min("rank").alias("first"))
    before = F.coalesce(F.sum("size").over(W.orderBy("first").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return own.join(trees.select("root_id", before.alias("before")), "root_id").withColumn("place", (F.col("before") + F.col("own")).cast("long")).drop("own", "before")
