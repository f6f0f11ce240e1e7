"""Links among many sets that resemble one another, without looking at all pairs.

A group is a set of members with a reference set; each member is held as its difference d from the reference. With
s(X) = |d| (t0 + t1) - (t1 - t0) |X| for a threshold of t0 / t1:

* s(A) + s(B) <= 0 makes A and B similar for certain, since their difference is at most |dA| + |dB|. All such pairs
  hang together through the member of least s, so a star of links to it stands for them.
* A similar pair with s(A) + s(B) > 0 must share o = (s(A) + s(B)) / (2 (t0 + t1)) elements of dA and dB. So the two
  meet in the first |d| - o + 1 elements of both, in any common order; here the rarest in the group come first.
  Members are classed by s, and each class of partners has its own prefix.

First the reference is moved to the majority: elements that more than half of the differences hold are flipped, so
every list holds half of its group at most. Short lists give candidate pairs, long ones are groups again.
Groups and lists whose members are all connected already are left alone.

One group may hold most rows. What is known of a group is counted where its rows lie, before it is shuffled, and joined
back by `join_groups`, which sends it to all executors or deals large groups out by member. Two joins go by a key that may be
hot without that, an element of a group with its count here, and the hub of a star in `connected`; both are plain
sort-merge joins, whose skewed partitions AQE splits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import join_groups, written
from .components import connected


def _difference(a, b):
    return F.concat(F.array_except(a, b), F.array_except(b, a))


def groups(lists: DataFrame, sets: DataFrame) -> DataFrame:
    """(g, id, n, d) from lists (v, id): a list's members against its least member."""
    least = lists.groupBy("v").agg(F.min("id").alias("g"))
    pairs = join_groups(lists.select("v", "id"), least, ["v"]).select("g", "id").distinct()
    heads = sets.select(F.col("id").alias("g"), F.col("set").alias("y")).join(least.select("g").distinct(), "g", "left_semi")
    found = join_groups(pairs.join(sets.select("id", F.col("set").alias("x")), "id"), heads, ["g"])
    return written(found.select("g", "id", F.size("x").cast("long").alias("n"), _difference("x", "y").alias("d")), "groups")


def _centred(rows: DataFrame, t: tuple[int, int]) -> DataFrame:
    """The rows against the majority, with s."""
    sizes = rows.groupBy("g").agg(F.count("*").alias("m"))
    often = rows.select("g", F.explode("d").alias("e")).groupBy("g", "e").agg(F.count("*").alias("c"))
    flips = join_groups(often, sizes, ["g"], spread="e").where("2 * c > m").groupBy("g").agg(F.collect_list("e").alias("f"))
    moved = join_groups(rows, written(flips, "flips"), ["g"], "left").withColumn("d", F.when(F.col("f").isNull(), F.col("d")).otherwise(_difference("d", "f"))).drop("f")
    return written(moved.withColumn("s", F.size("d") * (t[0] + t[1]) - F.col("n") * (t[1] - t[0])), "centred")


def _postings(rows: DataFrame, t: tuple[int, int]) -> DataFrame:
    """(g, e, lo, hi, id, comp, k, i, z, s): element e is the i-th of z of a member of class k, for the classes lo, hi."""
    unit = t[0] + t[1]
    best = rows.groupBy("g").agg(F.min("s").alias("low"))
    rows = join_groups(rows, best, ["g"]).withColumn("k", F.floor(F.log2((F.col("s") - F.col("low")) / unit + 1)).cast("int"))
    classes = rows.groupBy("g").agg(F.collect_set("k").alias("ks"))
    flat = rows.select("g", "id", "comp", "k", "s", "low", F.size("d").alias("z"), F.explode("d").alias("e"))
    often = flat.groupBy("g", "e").agg(F.count("*").alias("c")).where("c > 1")
    # elements of one member alone come first and match nobody
    flat = flat.join(often, ["g", "e"], "left").withColumn("i", F.row_number().over(W.partitionBy("g", "id").orderBy(F.col("c").asc_nulls_first(), "e"))).where("c IS NOT NULL")

    def within(other):
        """Whether the element is in the prefix for partners of that class."""
        least = F.col("low") + (F.pow(F.lit(2.0), other) - 1) * unit
        shared = F.greatest(F.lit(1), F.ceil((F.col("s") + least) / (2 * unit) - 1e-6))
        return F.col("i") <= F.col("z") - shared + 1

    flat = join_groups(flat, classes, ["g"]).withColumn("other", F.explode(F.filter("ks", within)))
    return flat.select("g", "e", F.least("k", "other").alias("lo"), F.greatest("k", "other").alias("hi"), "id", "comp", "k", "i", "z", "s")


def _candidates(lists: DataFrame, t: tuple[int, int]) -> DataFrame:
    key = ["g", "e", "lo", "hi"]
    a = lists.select(*key, F.col("id").alias("a"), F.col("comp").alias("ca"), F.col("k").alias("ka"), F.col("i").alias("ia"), F.col("z").alias("za"), F.col("s").alias("sa"))
    b = lists.select(*key, F.col("id").alias("b"), F.col("comp").alias("cb"), F.col("k").alias("kb"), F.col("i").alias("ib"), F.col("z").alias("zb"), F.col("s").alias("sb"))
    fit = (F.col("a") < F.col("b")) & (F.col("ca") != F.col("cb")) & (F.least("ka", "kb") == F.col("lo")) & (F.greatest("ka", "kb") == F.col("hi"))
    reach = 1 + F.least(F.col("za") - F.col("ia"), F.col("zb") - F.col("ib"))
    return a.join(b, key).where(fit & (2 * (t[0] + t[1]) * reach >= F.col("sa") + F.col("sb"))).select("a", "b").distinct()


#: Members of a list that are compared with one another, as a multiple of the bound for lists of retained values: the
#: places of the shared element leave few of these pairs.
WIDER = 4


def resolve(rows: DataFrame, links: DataFrame, t: tuple[int, int], hot: int) -> tuple[DataFrame, DataFrame]:
    """rows: as of groups(). Returns certain links (a, b), those given among them, and candidate pairs (a, b)."""
    candidates, hot = None, WIDER * hot
    for _ in range(40):
        rows = _centred(rows, t)
        hub = rows.groupBy("g").agg(F.min_by("id", F.struct("s", "id")).alias("a"), F.min("s").alias("low"))
        star = join_groups(rows, hub, ["g"]).where((F.col("id") != F.col("a")) & (F.col("s") + F.col("low") <= 0)).select("a", F.col("id").alias("b"))
        links = written(links.union(star).distinct(), "links")
        comps = connected(links)
        placed = rows.join(comps, "id", "left").withColumn("comp", F.coalesce("component", "id")).drop("component")
        open_ = placed.groupBy("g").agg(F.min("comp").alias("x"), F.max("comp").alias("y")).where("x <> y").select("g")
        open_ = written(open_, "open-groups")
        rows = written(join_groups(placed, open_, ["g"], "left_semi"), "open")
        if not rows.head(1):
            break
        postings = written(_postings(rows, t), "cloud-postings")
        key = ["g", "e", "lo", "hi"]
        lists = postings.groupBy(*key).agg(F.count("*").alias("c"), F.min("comp").alias("x"), F.max("comp").alias("y")).where("x <> y")
        lists = written(lists.select(*key, "c"), "cloud-lists")
        short = join_groups(postings, lists.where(F.col("c") <= hot), key, "left_semi", lists)
        found = written(_candidates(short, t), "cloud-pairs")
        candidates = found if candidates is None else candidates.union(found)
        long = lists.where(F.col("c") > hot)
        if not long.head(1):
            break
        members = join_groups(postings, long, key, "left_semi", lists).select(F.xxhash64(*key).alias("next"), "g", "id").distinct()
        rows = members.join(rows.select("g", "id", "n", "d"), ["g", "id"]).select(F.col("next").alias("g"), "id", "n", "d")
        rows = written(rows, "groups")
    else:
        raise RuntimeError("groups did not get smaller")
    return links, candidates if candidates is not None else links.limit(0)
