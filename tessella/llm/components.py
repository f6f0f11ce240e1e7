"""Connected components of a link table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def connected(links: DataFrame, rounds: int = 60) -> DataFrame:
    """links: (a, b). Returns (id, component): every id that has a link, with the least id it can reach.

    Null ends and self-links count for nothing, repeated links as one; without links the result is empty.
    Each step is two shuffles of the edges; all state is a table in the shared folder."""
    ends = [F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")]
    edges = written(links.where("a <> b").select(*ends).distinct(), "edges")

    def state(df: DataFrame):
        return df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()

    before = state(edges)
    for _ in range(rounds):
        if not before[0]:
            break
        both = edges.union(edges.select(F.col("v"), F.col("u"))).toDF("u", "v")
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        hung = large.join(least, "u")
        small = hung.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
        edges = written(small.distinct(), "edges")
        now = state(edges)
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"links did not settle in {rounds} rounds")
    out = edges.select(F.col("u").alias("id"), F.col("v").alias("component"))
    return out.union(edges.select("v", "v").distinct().toDF("id", "component"))
