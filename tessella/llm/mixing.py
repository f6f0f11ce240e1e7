"""Mixing sources to target weights by the cube method.

A source's target over its size is how often each of its documents should be taken. The whole part is taken as
it is; the fractional part is an inclusion probability. The flight phase moves the probabilities of three documents
at a time along the direction that leaves the numbers of words and of documents as they are, up or down until one of them
is 0 or 1. Which way is drawn, with chances in inverse proportion to the two steps, so that every document is taken with
its probability. Draws follow from the seed and the hashes of a block, so reruns agree. The phase runs in blocks of bounded
size, dealt by hash; each block leaves at most two documents undecided. These go through the same phase again until one
block per source is left. There LANDING documents are held back and decided with what the flight leaves (the landing):
one of all choices that come near the target is drawn, by the chances that independent draws would give them. What a
document of the landing is taken with is near its probability, not equal to it.

A null text has size 0. A null source is a source of its own, after all others. Documents of size 0 are taken
0 times. Rows that repeat a doc_id are separate documents; rows alike in doc_id, source and size are decided
together with their number. An empty table gives an empty result. Only doc_id, text and source are read; `mixed` keeps
all columns, whose names may be any.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import common

#: Weights of the sources in order of name, repeating; the share of all words to take; the most copies of a source.
WEIGHTS, SHARE, CAP = (5, 2, 1), 1.5, 2
#: Documents in a block of the flight phase; two of each are left for the next round.
#: Documents of a source that are held back for the landing, and the seed of the deal and of all draws.
BLOCK, LANDING, SEED = 4000, 14, 20
#: How far from its target, as a share of it, the landing may leave a source.
NEAR = 0.002


def sized(docs: DataFrame) -> DataFrame:
    """doc_id, source, size (words of the text)."""
    n = F.coalesce(F.regexp_count("text", F.lit(common.WORD)), F.lit(0)).cast("long")
    return docs.select("doc_id", "source", n.alias("size"))


def targets(sizes: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """source, n_docs, source_size, target: weights share out share * all words; what is above cap * source_size is
    shared out again by weight until nothing is. The windows run over one row per source."""
    by = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
    place = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1
    by = by.withColumn("w", F.element_at(F.array(*map(F.lit, weights)), (place % len(weights) + 1).cast("int")).cast("double"))
    by = by.withColumn("most", F.col("source_size") * F.lit(float(cap)))
    every = W.partitionBy()
    by = by.withColumn("all", F.sum("source_size").over(every) * F.lit(float(share)))
    order = W.orderBy(F.col("most") / F.col("w"), F.col("source").asc_nulls_last())
    # the sources that fill first come first; the level is what one unit of weight gets once they are full
    by = by.withColumn("before", F.sum("most").over(order.rowsBetween(W.unboundedPreceding, 0)) - F.col("most"))
    by = by.withColumn("rest", F.sum("w").over(order.rowsBetween(0, W.unboundedFollowing)))
    by = by.withColumn("level", (F.col("all") - F.col("before")) / F.col("rest"))
    open_ = F.min(F.when(F.col("level") * F.col("w") <= F.col("most"), F.struct(F.col("most") / F.col("w"), F.col("level").alias("level")))).over(every)
    by = by.withColumn("level", open_["level"])
    target = F.least("most", F.coalesce(F.col("level") * F.col("w"), F.col("most")))
    return by.select("source", "n_docs", "source_size", target.alias("target"))


def flight(p: np.ndarray, size: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Moves p within [0, 1] so that sum(p) and sum(p * size) stay, until at most two are fractional. Each move goes one of
    two ways, drawn so that the expected value of every p stays what it was."""
    out = p.astype(float).tolist()
    x = size.astype(float).tolist()
    queue = [i for i, v in enumerate(out) if 1e-9 < v < 1 - 1e-9][::-1]
    draws = iter(rng.random(len(queue)).tolist())  # each move decides one document at least
    held: list[int] = []
    while True:
        while len(held) < 3 and queue:
            held.append(queue.pop())
        if len(held) < 3:
            break
        a, b, c = held
        # orthogonal to (1, 1, 1) and to the sizes
        u = (x[b] - x[c], x[c] - x[a], x[a] - x[b])
        if u == (0.0, 0.0, 0.0):
            u = (1.0, -1.0, 0.0)
        up = min((1 - out[i]) / d if d > 0 else -out[i] / d for i, d in zip(held, u, strict=True) if d)
        down = min(out[i] / d if d > 0 else (out[i] - 1) / d for i, d in zip(held, u, strict=True) if d)
        step = up if next(draws) * (up + down) < down else -down
        for i, d in zip(held, u, strict=True):
            out[i] = min(1.0, max(0.0, out[i] + step * d))
            if out[i] < 1e-9:
                out[i] = 0.0
            elif out[i] > 1 - 1e-9:
                out[i] = 1.0
        held = [i for i in held if 0.0 < out[i] < 1.0]
    return np.array(out)


def land(p: np.ndarray, size: np.ndarray, open_: np.ndarray, goal: float, draw: float) -> np.ndarray:
    """Decides the few documents in open_ together: of all choices whose words come within NEAR of the goal (if there is none,
    of the nearest ones) one is drawn, each with the chance that independent draws with p would give it."""
    choices = (np.arange(1 << len(open_))[:, None] >> np.arange(len(open_))) & 1
    fixed = np.ones(len(p), bool)
    fixed[open_] = False
    words = np.round(np.abs(choices @ size[open_] + float(p[fixed] @ size[fixed]) - goal), 6)
    near = np.flatnonzero(words <= max(words.min(), NEAR * goal))
    chance = np.cumsum(np.where(choices[near] == 1, p[open_], 1 - p[open_]).prod(axis=1))
    out = p.copy()
    out[open_] = choices[near[min(np.searchsorted(chance, draw * chance[-1], "right"), len(near) - 1)]]
    return out


def settle(p: np.ndarray, size: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """A whole source: a few documents, drawn evenly over all sizes, are held back from the flight and decided with what it
    leaves."""
    goal = float(p @ size)
    split = np.flatnonzero((p > 0) & (p < 1))
    split = split[np.argsort(-size[split], kind="stable")]
    n = min(LANDING, len(split))
    edges = (np.arange(n + 1) * len(split)) // max(n, 1)
    back = split[rng.integers(edges[:-1], edges[1:])] if n else split
    rest = np.setdiff1d(np.arange(len(p)), back)
    out = p.copy()
    out[rest] = flight(p[rest], size[rest], rng)
    return land(out, size, np.flatnonzero((out > 0) & (out < 1)), goal, rng.random())


def _round(last: bool, seed: int, level: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    def run(block: pd.DataFrame) -> pd.DataFrame:
        block = block.drop(columns="block").sort_values(["h", "doc_id", "size", "nth"], kind="stable", na_position="last").reset_index(drop=True)
        rng = np.random.default_rng([abs(seed), level, int(block["h"].iloc[0]) & (1 << 63) - 1, len(block)])
        decide = settle if last else flight
        return block.assign(p=decide(block["p"].to_numpy(), block["size"].to_numpy(), rng))

    return run


def mix(docs: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, cap: float = CAP, block: int = BLOCK, seed: int = SEED) -> DataFrame:
    """doc_id, source, size, source_size, target, copies, taken: one row per row of docs."""
    sizes = common.written(sized(docs), "sizes")
    by = common.written(targets(sizes, weights, share, cap), "targets")
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    goal = by.select(F.col("source").alias("of"), "n_docs", "source_size", "target", ratio.alias("ratio"))
    goal = common.sent(goal)
    rows = sizes.groupBy("doc_id", "source", "size").agg(F.count("*").alias("times"))
    rows = rows.select("doc_id", "source", "size", F.explode(F.sequence(F.lit(1), F.col("times").cast("int"))).alias("nth"))
    rows = rows.join(goal, F.col("source").eqNullSafe(F.col("of"))).drop("of")
    whole = F.floor("ratio")
    rows = rows.withColumn("p", F.when(F.col("size") > 0, F.col("ratio") - whole).otherwise(0.0)).withColumn("h", F.xxhash64(F.lit(seed), "doc_id", "source", "size", "nth"))
    state = rows.select("doc_id", "source", "size", "nth", "h", "p", F.col("n_docs").alias("n"))
    schema = state.schema
    done, level = None, 0
    while True:
        most = state.agg(F.max("n")).first()[0] or 0
        last = most <= block
        blocks = F.greatest(F.lit(1), F.ceil(F.col("n") / block))
        dealt = state.withColumn("block", F.pmod(F.xxhash64(F.lit(level), "h"), blocks))
        moved = dealt.groupBy("source", "block").applyInPandas(_round(last, seed, level), schema)
        moved = common.written(moved, "flight")
        decided = moved.where("p = 0 OR p = 1")
        done = decided if done is None else done.union(decided)
        if last:
            break
        left = moved.where("p > 0 AND p < 1")
        counts = left.groupBy("source").agg(F.count("*").alias("now"))
        counts = common.sent(common.written(counts, "undecided"))
        state = left.join(counts.withColumnRenamed("source", "of"), F.col("source").eqNullSafe(F.col("of"))).select("doc_id", "source", "size", "nth", "h", "p", F.col("now").alias("n"))
        level += 1
    out = done.join(goal, F.col("source").eqNullSafe(F.col("of")))
    copies = F.when(F.col("size") > 0, F.floor("ratio") + F.col("p").cast("long")).otherwise(F.lit(0)).cast("long")
    return out.select("doc_id", "source", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"))


def mixed(docs: DataFrame, **options) -> DataFrame:
    """docs as the mix takes them: each row as often as it has copies, all columns, whatever their names. Texts are shuffled
    once, at any size, to meet their copies, which are what tasks hold."""
    key = ["doc_id", "source", "size"]
    copies = mix(docs, **options).select(*key, "copies")
    copies = copies.withColumn("nth", F.row_number().over(W.partitionBy(*key).orderBy("copies")))
    copies = common.written(copies, "copies")
    # the row as one column, so that none of its names meets those used here
    n = F.coalesce(F.regexp_count("text", F.lit(common.WORD)), F.lit(0)).cast("long")
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").alias("id"), F.col("source").alias("of"), n.alias("n"))
    alike = F.col("id").eqNullSafe(F.col("doc_id")) & F.col("of").eqNullSafe(F.col("source")) & (F.col("n") == F.col("size"))
    again = common.written(copies.where("nth = 2").select(*key), "repeated")
    placed = rows.withColumn("place", F.lit(1))
    if again.head(1):  # rows alike in these are told apart by their texts
        several = rows.join(again.hint("shuffle_hash"), alike, "left_semi").withColumn("place", F.row_number().over(W.partitionBy("id", "of", "n").orderBy("row.text")))
        placed = rows.join(again.hint("shuffle_hash"), alike, "left_anti").withColumn("place", F.lit(1)).union(several)
    taken = placed.join(copies.where("copies > 0").hint("shuffle_hash"), alike & (F.col("place") == F.col("nth")))
    return taken.select("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("copy")).select("row.*")


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(common.documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")
