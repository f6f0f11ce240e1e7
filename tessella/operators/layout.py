"""Characters of pages against the boxes of tables: a join of points with rectangles, by tiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: How far a box reaches beyond its edges, and how far apart the tops of one line's characters may lie.
PAD, LINE = 1.0, 3.0
#: Width and height of a tile, in points: a page has a few dozen, and so has the largest box.
TILE = 96.0


def _number(name: str) -> Column:
    return F.coalesce(F.col(name).cast("double"), F.lit(0.0))


def centre(low: str, high: str) -> Column:
    """The middle of an extent. A null low end counts as 0, a null or zero high end as the low one."""
    return (_number(low) + F.when(_number(high) == 0, _number(low)).otherwise(_number(high))) / 2


def outside_boxes(chars: DataFrame, boxes: DataFrame, pad: float = PAD, tile: float = TILE) -> DataFrame:
    """The rows of chars (page, x0, top, x1, bottom and whatever else) whose centre lies in no box of their page (page, x0,
    top, x1, bottom), edges and `pad` around them included. (A11, A12)

    Boxes go to all tiles that they touch, a character to its own; they meet by page and tile, so the join is one of equal
    keys whose rows a page deals out to its tiles, however many characters it has. Overlapping boxes drop a character once.
    A null page has no boxes; a box with its ends exchanged holds nothing."""
    names = {"cx": centre("x0", "x1"), "cy": centre("top", "bottom")}
    fresh = {n: n + "_" * sum(c.lower().startswith(n) for c in chars.columns) for n in (*names, "tx", "ty")}
    points = chars.withColumns({fresh[n]: x for n, x in names.items()})
    points = points.withColumns({fresh[t]: F.floor(F.col(fresh[c]) / tile) for t, c in (("tx", "cx"), ("ty", "cy"))})
    low = lambda name: _number(name) - pad
    high = lambda name: _number(name) + pad
    edges = boxes.select(F.col("page").alias("b_page"), low("x0").alias("b_x0"), high("x1").alias("b_x1"), low("top").alias("b_top"), high("bottom").alias("b_bottom"))
    tiles = lambda a, b: F.sequence(F.floor(F.col(a) / tile), F.floor(F.col(b) / tile))
    dealt = edges.where("b_x0 <= b_x1 AND b_top <= b_bottom").withColumn("b_tx", F.explode(tiles("b_x0", "b_x1"))).withColumn("b_ty", F.explode(tiles("b_top", "b_bottom")))
    p = {n: points[fresh[n]] for n in fresh}
    inside = p["cx"].between(dealt["b_x0"], dealt["b_x1"]) & p["cy"].between(dealt["b_top"], dealt["b_bottom"])
    same = (points["page"] == dealt["b_page"]) & (p["tx"] == dealt["b_tx"]) & (p["ty"] == dealt["b_ty"])
    return points.join(dealt, same & inside, "left_anti").select(*(points[c] for c in chars.columns))


def page_texts(chars: DataFrame, line: float = LINE) -> DataFrame:
    """(page, text) of characters (page, x0, top, char): lines from top to bottom, each from left to right. Characters whose
    tops fall into one step of `line` points make a line; a line is put together first, then the page. (A11)"""
    lines = chars.groupBy("page", F.floor(_number("top") / line).alias("line")).agg(F.sort_array(F.collect_list(F.struct(_number("x0").alias("x"), _number("top").alias("y"), F.coalesce("char", F.lit("")).alias("char")))).alias("cs"))
    lines = lines.select("page", "line", F.array_join(F.col("cs")["char"], "").alias("text"))
    return lines.groupBy("page").agg(F.sort_array(F.collect_list(F.struct("line", "text"))).alias("ls")).select("page", F.array_join(F.col("ls")["text"], "\n").alias("text"))
