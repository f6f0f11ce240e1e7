"""Segments of chapters: which ones a fix is about, and what each has before and after it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as tx

# Patterns of what a fix names.
CODES = r"(?i)(?:GB/?T?|CJJ|JGJ|JTG|DL/?T?|NB/?T?|Q/?GDW)[A-Z0-9/\-]{2,}"
QUOTED = r"[「『\"“]([^\n]{2,40}?)[」』\"”]"


def _patterns(words):
    """Distinct words of two characters and more."""
    return F.array_distinct(F.filter(F.transform(words, tx.strip), lambda w: F.length(w) >= 2))


def localized(parts: DataFrame, anchors: DataFrame, fixes: DataFrame, codes_in_quotes: bool = True) -> DataFrame:
    """(chapter_id, ord) of the segments (chapter_id, ord, content) that a fix is about: those that hold one of the chapter's
    anchors (chapter_id, anchor); in a chapter where none does, those that hold a code or a quoted phrase of its fix
    (chapter_id, fix). A part of a quoted phrase that looks like a code counts as one, too, unless `codes_in_quotes` is false.
    (D22)

    Each chapter has patterns of its own, so these are gathered to one row a chapter, whatever the number of segments; a
    segment is looked at once for both kinds, and only two flags of it go on, by chapter, as they lie."""
    by_anchor = anchors.groupBy("chapter_id").agg(F.collect_set(tx.strip(F.col("anchor"))).alias("ws")).select("chapter_id", _patterns(F.col("ws")).alias("first"))
    said = F.coalesce("fix", F.lit(""))
    coded = said if codes_in_quotes else F.regexp_replace(said, QUOTED, "「」")
    named = F.concat(F.regexp_extract_all(coded, F.lit(CODES), F.lit(0)), F.regexp_extract_all(said, F.lit(QUOTED), F.lit(1)))
    by_fix = fixes.groupBy("chapter_id").agg(F.flatten(F.collect_set(named)).alias("ws")).select("chapter_id", _patterns(F.col("ws")).alias("second"))
    patterns = by_anchor.join(by_fix, "chapter_id", "full")
    has = lambda ws: F.coalesce(F.exists(ws, lambda w: F.contains("content", w)), F.lit(False))
    flags = parts.join(patterns, "chapter_id").select("chapter_id", "ord", has("first").alias("a"), has("second").alias("b"))
    any_anchor = F.max(F.col("a")).over(W.partitionBy("chapter_id"))
    return flags.withColumn("any", any_anchor).where(F.col("a") | (~F.col("any") & F.col("b"))).select("chapter_id", "ord")


def key_points(points: DataFrame) -> DataFrame:
    """(chapter_id, since, k, point, first) of key points (chapter_id, ord, k, point: those of segment ord, in order k):
    each point once, with the segment that writes it (`since`). For a segment s its own points are those with since = s,
    the remaining ones those with since > s, and those already written, each text once, those marked `first` with since < s.
    So what a segment has before and after it is a bound on one column, and nothing grows with the square of their number.
    (F30)"""
    first = F.row_number().over(W.partitionBy("chapter_id", "point").orderBy("ord", "k")) == 1
    return points.select("chapter_id", F.col("ord").alias("since"), "k", "point", first.alias("first"))


def written_and_remaining(points: DataFrame, segments: DataFrame) -> DataFrame:
    """(chapter_id, ord, n_written, n_remaining): for each segment (chapter_id, ord), how many distinct points
    those before it wrote and how many points those after it hold. Counts by segment come first, running sums over them.
    (F30)"""
    by = key_points(points).groupBy("chapter_id", F.col("since").alias("ord")).agg(F.count("*").alias("n"), F.count_if("first").alias("new"))
    every = segments.select("chapter_id", "ord").distinct().join(by, ["chapter_id", "ord"], "left").select("chapter_id", "ord", *(F.coalesce(x, F.lit(0)).alias(x) for x in ("n", "new")))
    before = W.partitionBy("chapter_id").orderBy("ord").rowsBetween(W.unboundedPreceding, -1)
    after = W.partitionBy("chapter_id").orderBy("ord").rowsBetween(1, W.unboundedFollowing)
    total = lambda x, w: F.coalesce(F.sum(x).over(w), F.lit(0))
    return every.select("chapter_id", "ord", total("new", before).alias("n_written"), total("n", after).alias("n_remaining"))


def plans(points: DataFrame, chapters: DataFrame) -> DataFrame:
    """(chapter_id, ord, methods, data, charts, words) of segments with points (chapter_id, ord, k, point) of chapters
    (chapter_id, methods, data, charts, per_words: arrays and a number): the first segment takes the first half of the
    methods and data, rounded up, and all charts; the others take none of these. (F30)"""
    half = lambda x: F.slice(x, 1, F.floor((F.size(x) + 1) / 2).cast("int"))
    none = F.array().cast("array<string>")
    first = F.col("ord") == F.min("ord").over(W.partitionBy("chapter_id"))
    segments = points.select("chapter_id", "ord").distinct().select("chapter_id", "ord", first.alias("first"))
    out = segments.join(chapters, "chapter_id")
    pick = lambda x, found: F.when(F.col("first"), F.coalesce(found, none)).otherwise(none).alias(x)
    return out.select("chapter_id", "ord", pick("methods", half("methods")), pick("data", half("data")), pick("charts", F.col("charts")), F.col("per_words").alias("words"))
