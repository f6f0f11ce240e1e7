"""Word budgets of outline leaves."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.chapters import word_budget_weight
from ..functions.text import scaled_words

WORDS_PER_PAGE = 780


def allocate(leaves: DataFrame, bindings: DataFrame, requirements: DataFrame, target_pages: int = 40, compact: bool = False) -> DataFrame:
    """(id, base_words, target_words) for leaves (id, title), bindings (leaf_id, requirement_id), requirements (id, score).

    A requirement's words are its share of the scores, split among the leaves that bind it (each once); leaves
    without words share what is left, at least 400 each if that can be afforded. Weights by type of title are
    applied and scaled back to the total. Rounding is half to even. (E07)"""
    budget = float(target_pages * WORDS_PER_PAGE)
    total = requirements.agg(F.sum(F.coalesce("score", F.lit(0.0)).cast("double")).alias("total"))
    bound = bindings.select("leaf_id", "requirement_id").distinct().join(leaves.select(F.col("id").alias("leaf_id")), "leaf_id", "left_semi")
    scored = bound.join(requirements.select(F.col("id").alias("requirement_id"), F.col("score").cast("double").alias("score")), "requirement_id")
    shares = scored.groupBy("requirement_id").agg(F.count("*").alias("n"))
    scored = scored.join(shares, "requirement_id").join(F.broadcast(total)).where("score > 0 AND total > 0")
    words = scored.groupBy("leaf_id").agg(F.sum(F.bround(F.col("score") / F.col("total") * budget / F.col("n")).cast("long")).alias("words"))
    base = leaves.join(words.withColumnRenamed("leaf_id", "id"), "id", "left").withColumn("words", F.coalesce("words", F.lit(0)))
    sums = base.agg(F.sum("words").alias("used"), F.count_if(F.col("words") <= 0).alias("open"))
    left = F.greatest(F.lit(0.0), budget - F.col("used"))
    share = F.bround(left / F.col("open")).cast("long")
    floor = F.when(F.col("open") == 0, 0).when(left >= 400 * F.col("open"), F.greatest(F.lit(400), share)).otherwise(F.greatest(F.lit(0), share))
    base = base.join(F.broadcast(sums.select(floor.alias("floor"))))
    base = base.withColumn("base_words", F.when(F.col("words") > 0, F.col("words")).otherwise(F.col("floor")).cast("long"))
    base = base.withColumn("weighted", F.col("base_words") * word_budget_weight(F.col("title")))
    scale = base.agg((F.sum("base_words") / F.sum("weighted")).alias("scale"))
    goal = F.when(F.col("weighted") > 0, scaled_words(F.bround(F.col("weighted") * F.col("scale")).cast("long"), F.lit(compact)))
    return base.join(F.broadcast(scale)).select("id", "base_words", goal.cast("long").alias("target_words"))


def rescale(leaves: DataFrame, total_words: int) -> DataFrame:
    """leaves (id, target_words) scaled to a total, at least 200 each; leaves without words stay without."""
    total = min(500_000, max(3_000, total_words))
    s = leaves.agg(F.sum("target_words").alias("s"))
    new = F.greatest(F.lit(200), F.bround(F.col("target_words") * (total / F.col("s"))).cast("long"))
    return leaves.join(F.broadcast(s)).select("id", F.when(F.col("target_words") > 0, new).otherwise(F.col("target_words")).cast("long").alias("target_words"))
