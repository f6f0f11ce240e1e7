"""MinHash near-dedup with bottom-k sketches from one hash function.

1. Every text becomes a set of hashed word shingles. Texts with equal sets form one class; from here on only
   one representative of each class (its least doc_id) is carried.
2. A class keeps the k least hashes of its set. Inverted lists of these retained values generate overlaps:
   classes that meet in a list of at most `hot` members are candidates.
3. The union sketch (the k least values of both sketches) estimates the similarity; pairs more than six
   standard errors below the threshold go.
4. Exact Jaccard over the full sets verifies. Links are merged into components.

Lists longer than `hot` (shared passages, large groups of copies) are never expanded into pairs. A class most
of whose retained values lie in short lists can ignore its long ones: any partner meets it in a short list
(chance of a miss below 1e-10 a pair; certain when the sketch is the whole set). The others are met again by
their full sets. Classes made of frequent shingles almost alone, such as members of large groups of copies, are
grouped by their least retained values and resolved by their differences (clouds.py). No list is capped or sampled.

Null and empty texts, and texts without words, have empty sets and link with nothing. Rows without doc_id link
with nothing, have a null component and are kept. Rows that repeat a doc_id are each judged by their own text.
An empty table gives an empty result. Only doc_id and text are read, so other columns may have any names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import clouds, common
from .components import connected

#: Words in a shingle, retained values, members of a list that are paired with one another, and how many
#: retained values outside longer lists a class needs so that those longer lists can be ignored.
WIDTH, K, HOT, ENOUGH = 5, 40, 40, 28
#: Retained values that group classes of frequent shingles; a similar pair shares none with a chance below 1e-8.
FEW = 12
#: Values of full sets that a task counts together before they are shuffled.
COMBINED = 2_000_000


def _sketch(width: int, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in common.slices(batch, "text"):
                sets = common.shingle_sets(part.column("text"), width)
                kept = [s[:k] for s in sets]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id").cast(pa.int64()),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in sets], pa.binary()),
                        pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, kept)]), pa.int32()), pa.array(np.concatenate(kept))),
                    ],
                    ["doc_id", "n", "fp", "sketch"],
                )

    return run


def sketches(docs: DataFrame, width: int = WIDTH, k: int = K) -> DataFrame:
    """doc_id, n (set size), fp (128-bit fingerprint of the set), sketch (its k least hashes, ascending)."""
    return docs.select(F.col("doc_id").cast("long"), "text").transform(common.in_small_batches).mapInArrow(_sketch(width, k), "doc_id long, n long, fp binary, sketch array<long>")


def _full(width: int, words: Broadcast):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.column("at").to_numpy()
            batch = batch.filter(pa.array((words.value[at >> 6] >> (at & 63)) & 1 == 1))
            for part in common.slices(batch, "text"):
                sets = common.shingle_sets(part.column("text"), width)
                values = pa.array(np.concatenate(sets))
                ends = pa.array(np.cumsum([0, *map(len, sets)]), pa.int32())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.ListArray.from_arrays(ends, values)], ["id", "set"])

    return run


def full_sets(docs: DataFrame, ids: DataFrame, width: int) -> DataFrame:
    """(id, set) of the documents in ids and of a few more, as a table. Texts are picked where they are read, by a filter of
    bounded size; no text is shuffled, at any number of ids. Later joins by id leave the others out."""
    words = common.id_filter(ids, "id")
    chosen = docs.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("long"), "text", common.place("doc_id", len(words)).alias("at"))
    sets = chosen.transform(common.in_small_batches).mapInArrow(_full(width, docs.sparkSession.sparkContext.broadcast(words)), "id long, set array<long>")
    return common.written(sets, "sets")


def _near(t: tuple[int, int]):
    """The length filter: sets of such sizes can still reach the threshold."""
    return F.least("n", "m") * t[1] >= F.greatest("n", "m") * t[0]


def _pairs(lists: DataFrame, t: tuple[int, int]) -> DataFrame:
    """(a, b) with a < b that meet in one of the short lists (v, id, n)."""
    a = lists.select("v", F.col("id").alias("a"), "n")
    b = lists.select("v", F.col("id").alias("b"), F.col("n").alias("m"))
    return a.join(b, "v").where((F.col("a") < F.col("b")) & _near(t)).select("a", "b").distinct()


def _estimated(pairs: DataFrame, nodes: DataFrame, t: tuple[int, int], k: int) -> DataFrame:
    """(a, b, est) of the pairs that the union sketch leaves."""
    side = lambda end, s, n: nodes.select(F.col("id").alias(end), F.col("sketch").alias(s), F.col("n").alias(n))
    both = pairs.join(side("a", "sa", "n"), "a").join(side("b", "sb", "m"), "b").where(_near(t))
    both = both.withColumn("u", F.slice(F.array_sort(F.array_union("sa", "sb")), 1, k))
    shared = F.size(F.array_intersect(F.array_intersect("sa", "sb"), F.col("u")))
    both = both.select("a", "b", shared.alias("shared"), F.size("u").alias("size"))
    p = t[0] / t[1]
    slack = 6 * (p * (1 - p) / k) ** 0.5
    keep = F.when(F.col("size") < k, F.col("shared") * t[1] >= F.col("size") * t[0]).otherwise(F.col("shared") >= (p - slack) * k)
    return both.where(keep).select("a", "b", (F.col("shared") / F.col("size")).alias("est"))


def _verified(pairs: DataFrame, sets: DataFrame, t: tuple[int, int]) -> DataFrame:
    """The pairs whose full sets reach the threshold."""
    side = lambda end, s: sets.select(F.col("id").alias(end), F.col("set").alias(s))
    both = pairs.select("a", "b").join(side("a", "x"), "a").join(side("b", "y"), "b")
    both = both.select("a", "b", F.size(F.array_intersect("x", "y")).alias("i"), (F.size("x") + F.size("y")).alias("s"))
    return both.where((F.col("i") * t[1] >= (F.col("s") - F.col("i")) * t[0])).select("a", "b").distinct()


def _listed(postings: DataFrame, name: str) -> DataFrame:
    """(v, id, n, c) of the postings whose list has c >= 2 members, as a table. Counting combines before it shuffles."""
    lists = postings.groupBy("v").agg(F.count("*").alias("c")).where("c > 1")
    lists = common.written(lists, f"{name}-sizes")
    return common.written(common.join_groups(postings, lists, ["v"], sizes=lists).select("v", "id", "n", "c"), name)


def _combined(hot: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ends = np.cumsum(batch.column("n").to_numpy())
            lo = 0
            while lo < len(batch):
                hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + COMBINED)))
                part = batch.slice(lo, hi - lo)
                n, v = part.column("n").to_numpy(), part.column("set").flatten().to_numpy()
                owner = np.repeat(np.arange(len(part)), n)
                value, back, times = np.unique(v, return_inverse=True, return_counts=True)
                many = times > hot
                cold = ~many[back]
                ids, none = part.column("id"), pa.nulls
                here = np.bincount(owner[~cold], minlength=len(part))
                some = np.flatnonzero(here)
                rows = (
                    (pa.array(v[cold]), ids.take(pa.array(owner[cold])), pa.array(n[owner[cold]]), pa.array(np.ones(int(cold.sum()), np.int64))),
                    (pa.array(value[many]), none(int(many.sum()), pa.int64()), none(int(many.sum()), pa.int64()), pa.array(times[many].astype(np.int64))),
                    (none(len(some), pa.int64()), ids.take(pa.array(some)), pa.array(n[some]), pa.array(here[some].astype(np.int64))),
                )
                yield pa.RecordBatch.from_arrays([pa.concat_arrays(c) for c in zip(*rows, strict=True)], ["v", "id", "n", "c"])
                lo = hi

    return run


def _full_lists(sets: DataFrame, hot: int) -> tuple[DataFrame, DataFrame]:
    """The lists of all values of the sets: (v, id, n, c) of those with 2 to `hot` members, and (id, n, h) with the
    number of a set's values in longer lists. Values that more than `hot` sets of a batch share are certain to be in
    longer lists: they are counted where they are read, a row for each value and one for each set."""
    sized = sets.select("id", F.size("set").cast("long").alias("n"), "set")
    rows = common.written(sized.mapInArrow(_combined(hot), "v long, id long, n long, c long"), "full-postings")
    lists = rows.where("v IS NOT NULL").groupBy("v").agg(F.sum("c").alias("size")).where("size > 1")
    single = rows.where("v IS NOT NULL AND id IS NOT NULL").select("v", "id", "n")
    lists = common.written(lists.withColumnRenamed("size", "c"), "full-sizes")
    again = common.written(common.join_groups(single, lists, ["v"], sizes=lists).select("v", "id", "n", "c"), "full-lists")
    long = again.where(F.col("c") > hot).select("id", "n", F.lit(1).cast("long").alias("c")).union(rows.where("v IS NULL").select("id", "n", "c"))
    return again.where(F.col("c") <= hot), long.groupBy("id", "n").agg(F.sum("c").alias("h"))


def near_duplicates(docs: DataFrame, threshold: tuple[int, int] = (80, 100), width: int = WIDTH, k: int = K, hot: int = HOT, enough: int = ENOUGH) -> DataFrame:
    """One row per row of docs: doc_id, n_shingles, component_id, kept. threshold: least similarity, as a fraction."""
    t = threshold
    every = common.written(sketches(docs, width, k), "sketches")
    classes = every.where("n > 0 AND doc_id IS NOT NULL").groupBy("fp").agg(F.min("doc_id").alias("id"), F.first("n").alias("n"), F.first("sketch").alias("sketch"), F.count("*").alias("c"))
    classes = common.written(classes, "classes")
    nodes = classes.select("id", "n", "sketch")

    lists = _listed(nodes.select("id", "n", F.explode("sketch").alias("v")), "lists")
    pairs = _pairs(lists.where(F.col("c") <= hot), t)
    # so many values may differ at most between the set and a partner's
    spare = F.floor(F.col("n") * (t[1] - t[0]) / t[0])
    free = F.least("n", F.lit(k)) - F.col("h")
    met = lists.where(F.col("c") > hot).groupBy("id", "n").agg(F.count("*").alias("h"))
    full = common.written(met.where(F.when(F.col("n") <= k, free <= spare).otherwise(free < enough)).select("id"), "full")
    core = None
    if full.head(1):
        sets = full_sets(docs, full, width)
        again, met = _full_lists(sets, hot)
        pairs = pairs.union(_pairs(again, t))
        common_only = common.written(met.where(F.col("n") - F.col("h") <= spare).select("id"), "common-only")
        if common_only.head(1):
            core = nodes.join(common_only, "id", "left_semi").select("id", "n", F.explode(F.slice("sketch", 1, FEW)).alias("v"))
            core = _listed(core, "core")

    found = common.written(_estimated(pairs.distinct(), nodes, t, k), "pairs")
    ids = found.select(F.col("a").alias("id")).union(found.select("b"))
    ids = ids if core is None else ids.union(core.select("id"))
    sets = full_sets(docs, ids, width)

    # Each class with its likeliest partner first: after that, most pairs lie within one component and need no look.
    ends = found.union(found.select(F.col("b"), F.col("a"), "est"))
    best = ends.groupBy("a").agg(F.max_by("b", F.struct("est", -F.col("b"))).alias("b"))
    best = best.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    links = common.written(_verified(best, sets, t), "links")
    found = found.select("a", "b")
    if core is not None:
        links, more = clouds.resolve(clouds.groups(core, sets), links, t, hot)
        found = found.union(more).distinct()
    comps = connected(links)
    at = lambda end, name: comps.select(F.col("id").alias(end), F.col("component").alias(name))
    across = found.join(at("a", "ca"), "a", "left").join(at("b", "cb"), "b", "left")
    across = across.where(F.coalesce("ca", "a") != F.coalesce("cb", "b")).select("a", "b")
    more = common.written(_verified(across, sets, t), "links")
    if more.head(1):
        comps = connected(links.union(more))

    names = classes.select("fp", F.col("id").alias("rep")).join(comps.withColumnRenamed("id", "rep"), "rep", "left")
    names = names.select("fp", F.coalesce("component", "rep").alias("class"))
    names = common.written(names, "names")
    out = common.join_groups(every.select("doc_id", "n", "fp"), names, ["fp"], "left", classes.select("fp", "c"), "doc_id")
    own = F.when(F.col("doc_id").isNotNull(), F.coalesce("class", "doc_id"))
    out = out.select("doc_id", F.col("n").alias("n_shingles"), own.alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def deduplicated(docs: DataFrame, threshold: tuple[int, int] = (80, 100)) -> DataFrame:
    """The rows of docs that stay: of each group of near duplicates the one with the least doc_id, all columns. Of
    rows that repeat a doc_id one stays (the least text); rows without doc_id all stay. Texts are shuffled once, at any
    size, to meet the ids that go, which are what tasks hold."""
    found = near_duplicates(docs, threshold)
    kept = found.where("kept").select("doc_id").distinct()
    gone = common.written(found.where("NOT kept").select("doc_id").distinct().join(kept, "doc_id", "left_anti"), "gone")
    repeats = docs.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id")
    left = docs.join(gone.hint("shuffle_hash"), "doc_id", "left_anti")
    if repeats.head(1):
        again, nth = left.join(repeats, "doc_id", "left_semi"), common.fresh(docs, "nth")
        first = again.withColumn(nth, F.row_number().over(W.partitionBy("doc_id").orderBy("text"))).where(F.col(nth) == 1).drop(nth)
        left = left.join(repeats, "doc_id", "left_anti").unionByName(first)
    return left.select(*docs.columns)


def op1_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(common.documents(spark, sf_dir), threshold=(85, 100))
