"""Quality classifier from weak labels.

Overlapping heuristics vote on every document: junk, fine or nothing. Expectation-maximisation over the counts of
all vote patterns (at most 3 to the number of heuristics, counted over all documents) estimates how often each
heuristic is right about junk and about fine text, and with that the chance of junk for every pattern. These
posterior labels train a linear scorer over hashed word shapes, with which all documents are scored. A long word, such
as a text without white space, is read whole: as consecutive pieces of PIECE characters, each counted as a word.

Patterns are counted over all documents. The scorer is trained on a sample of at most `sample` documents, those of
least hash of doc_id and text, each but once: that bound is a parameter and the only thing that is sampled.

A null or empty text, or one without words, has no votes and no features; it is rejected (score 0). Rows that
repeat a doc_id are each judged by their own text. An empty table gives an empty result; a table that trains
nothing (all of one label) is scored by the labels alone. Only doc_id and text are read. A column of docs that is named
like the new one stays, and the new one gets an underscore (common.fresh).
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Buckets of word shapes, documents that train the scorer, word shapes that a worker keeps.
BUCKETS, SAMPLE, KEPT = 512, 12_000, 100_000
#: Shares are taken of so many words at least: a very short text tells little.
FEW = 12
#: A document is kept from this chance of fine text on.
KEEP = 0.5

#: Heuristics: name, and share of words from which they vote junk and up to which they vote fine.
HEURISTICS = (
    ("symbols at word ends", 0.25, 0.05),
    ("symbols among characters", 0.08, 0.02),
    ("words in capitals", 0.30, 0.05),
    ("exclamation marks", 0.25, 0.05),
    ("bars between words", 0.15, 0.03),
    ("words of other characters alone", 0.20, 0.06),
    ("repeats of the word before", 0.20, 0.04),
    ("words seen before", 0.92, 0.80),
)
_PRIOR = 2.0


def measures(words: list[str], text: str) -> tuple[float, ...]:
    """What the heuristics look at, in their order."""
    n = max(FEW, len(words))
    symbols = sum(map(text.count, "*%&#$@~^_=|<>\\"))
    tails = sum(1 for w in words if w[-1] in "*%&#$@~^_=|<>\\" and len(w) > 1)
    capitals = sum(1 for w in words if w.isupper() and len(w) > 3)
    bars = text.count("|")
    bare = sum(1 for w in words if not w[0].isalnum() and not any(map(str.isalnum, w)))
    repeats = sum(map(str.__eq__, words, words[1:]))
    seen = (len(words) - len(set(words))) / n
    return tails / n, symbols / max(1, len(text)), capitals / n, text.count("!") / n, bars / n, bare / n, repeats / n, seen


def votes(text: str) -> list[int] | None:
    """1: junk, -1: fine, 0: nothing, for each heuristic; None without words."""
    words = text.split()
    if not words:
        return None
    return [1 if m >= junk else -1 if m <= fine else 0 for m, (_, junk, fine) in zip(measures(words, text), HEURISTICS, strict=True)]


#: A piece of a word has so many characters. Pieces end only there, so no character of a word goes unread.
PIECE = 40


def shape(piece: str) -> int:
    """The bucket of all runs of capitals, small letters, digits and other characters of a piece, hashed."""
    runs, before = [], ""
    for c in piece:
        kind = "A" if c.isupper() else "a" if c.isalpha() else "9" if c.isdigit() else c
        if kind != before:
            runs.append(kind)
            before = kind
    return zlib.crc32("".join(runs).encode("utf-8", "replace")) % (BUCKETS - 2)


class Shapes(dict):
    """Word of at most PIECE characters to its bucket; longer ones are not kept."""

    def __missing__(self, word: str) -> int:
        if len(self) > KEPT:
            self.clear()
        found = self[word] = shape(word)
        return found


def pieces(words: list[str]) -> list[str]:
    """The words, those of more than PIECE characters cut into consecutive pieces that all count as words."""
    if max(map(len, words), default=0) <= PIECE:
        return words
    return [w[i : i + PIECE] for w in words for i in range(0, len(w), PIECE)]


def features(text: str, shapes: Shapes) -> np.ndarray:
    """Shares of the buckets among the pieces of words; the last two: repeats of the piece before, distinct pieces."""
    words = pieces(text.split())
    out = np.bincount(list(map(shapes.__getitem__, words)), minlength=BUCKETS).astype(np.float32)
    out[-2] = sum(map(str.__eq__, words, words[1:]))
    out[-1] = len(set(words))
    return out / max(FEW, len(words))


def estimate(patterns: dict[tuple[int, ...], int], rounds: int = 200) -> tuple[dict[tuple[int, ...], float], np.ndarray]:
    """The chance of junk of every pattern, and per heuristic how often its votes are right on junk and on fine text."""
    v = np.array(list(patterns), np.int64).reshape(len(patterns), -1)
    n = np.array(list(patterns.values()), float)
    junk = np.where((v == 1).any(axis=1), 0.9, 0.05)
    right = np.zeros((2, v.shape[1]))
    for _ in range(rounds):
        share = (junk @ n + 1) / (n.sum() + 2)
        logs = np.log(np.array([1 - share, share]))[:, None] * np.ones(len(n))
        for c, weight in ((0, (1 - junk) * n), (1, junk * n)):
            for j in range(v.shape[1]):
                # the prior: on fine text a heuristic seldom cries junk, on junk it often does not
                says = np.array([weight[v[:, j] == x].sum() for x in (-1, 0, 1)]) + _PRIOR * np.array([[8.0, 1.5, 0.5], [5.0, 2.0, 3.0]][c])
                p = says / says.sum()
                right[c, j] = p[2] / (p[0] + p[2]) if c else p[0] / (p[0] + p[2])
                logs[c] += np.log(p[v[:, j] + 1])
        new = 1 / (1 + np.exp(np.clip(logs[0] - logs[1], -50, 50)))
        if np.abs(new - junk).max() < 1e-9:
            break
        junk = new
    return dict(zip(patterns, junk.tolist(), strict=True)), right


def train(x: np.ndarray, fine: np.ndarray, rounds: int = 300) -> np.ndarray:
    """Weights of a logistic scorer (the last one is the constant) for chances of fine text, by accelerated descent."""
    x = np.column_stack([x, np.ones(len(x), np.float32)]).astype(np.float64)
    weight = np.where(fine > 0.5, 0.5 / max(1.0, (fine > 0.5).sum()), 0.5 / max(1.0, (fine <= 0.5).sum()))
    w, speed = np.zeros(x.shape[1]), np.zeros(x.shape[1])
    step = 8.0
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ (w + 0.9 * speed), -40, 40)))
        grad = x.T @ (weight * (p - fine)) + 1e-5 * w
        speed = 0.9 * speed - step * grad
        w = w + speed
    return w


def voted(docs: DataFrame) -> DataFrame:
    """h (hash of doc_id and text), votes (a string, one character each; null without words) and how many rows have
    both: a table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for x in batch.column(1):
                v = votes(x.as_py() or "")
                found.append(None if v is None else "".join("f.j"[i + 1] for i in v))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.string())], ["h", "votes"])

    found = docs.select(F.xxhash64("doc_id", "text").alias("h"), "text").transform(common.in_small_batches).mapInArrow(run, "h long, votes string")
    return common.written(found.groupBy("h", "votes").count(), "votes")


def fit(docs: DataFrame, sample: int = SAMPLE) -> tuple[np.ndarray | None, dict[str, float], np.ndarray | None]:
    """Weights of the scorer (None if there is nothing to tell apart), chance of junk by pattern, the heuristics' accuracies."""
    table = voted(docs)
    counts = {r["votes"]: r["count"] for r in table.where("votes IS NOT NULL").groupBy("votes").agg(F.sum("count").alias("count")).collect()}
    if not counts:
        return None, {}, None
    known, right = estimate({tuple("f.j".index(c) - 1 for c in k): n for k, n in sorted(counts.items())})
    chance = {k: known[tuple("f.j".index(c) - 1 for c in k)] for k in counts}
    # the sample as a bound of the hash: no more rows than that reach the driver
    distinct = table.where("votes IS NOT NULL").select("h")
    bound = distinct.orderBy("h").limit(sample).agg(F.max("h")).first()[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shapes = Shapes()
        for batch in batches:
            h, x, y = [], [], []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                v = votes(text.as_py() or "")
                if v is not None:
                    h.append(key)
                    x.append(features(text.as_py(), shapes).tobytes())
                    y.append("".join("f.j"[i + 1] for i in v))
            yield pa.RecordBatch.from_arrays([pa.array(h, pa.int64()), pa.array(x, pa.binary()), pa.array(y, pa.string())], ["h", "x", "votes"])

    few = docs.select(F.xxhash64("doc_id", "text").alias("h"), "text").where(F.col("h") <= bound)
    rows = few.transform(common.in_small_batches).mapInArrow(run, "h long, x binary, votes string").dropDuplicates(["h", "votes"]).toPandas()
    x = np.frombuffer(b"".join(map(bytes, rows["x"])), np.float32).reshape(len(rows), BUCKETS)
    order = np.lexsort((rows["votes"].to_numpy(str), rows["h"].to_numpy()))  # the same order however rows arrive
    fine = 1 - np.array([chance[k] for k in rows["votes"]])
    if not len(x) or (fine > 0.5).all() or (fine <= 0.5).all():
        return None, chance, right
    return train(x[order], fine[order]), chance, right


def score(docs: DataFrame, weights: np.ndarray | None, chance: dict[str, float]) -> DataFrame:
    """docs with `score`, the chance of fine text (0 without words), under a name that is fresh to docs."""
    name = common.fresh(docs, "score")
    names = [*docs.columns, name]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shapes = Shapes()
        for batch in batches:
            for part in common.slices(batch, "text"):
                out = []
                for x in part.column("text"):
                    text = x.as_py() or ""
                    if not text.split():
                        out.append(0.0)
                    elif weights is None:
                        out.append(1 - chance["".join("f.j"[i + 1] for i in votes(text))])
                    else:
                        z = float(features(text, shapes) @ weights[:-1] + weights[-1])
                        out.append(float(1 / (1 + np.exp(-min(40.0, max(-40.0, z))))))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(out, pa.float64())], names)

    return docs.transform(common.in_small_batches).mapInArrow(run, common.T.StructType([*docs.schema.fields, common.T.StructField(name, common.T.DoubleType())]))


def classify(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """All columns of docs with `score`, trained on docs themselves."""
    weights, chance, _ = fit(docs, sample)
    return score(docs, weights, chance)


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.documents(spark, sf_dir).select("doc_id", "text")
    weights, chance, _ = fit(docs)
    return score(docs, weights, chance).select("doc_id", F.round("score", 6).alias("score"), (F.col("score") >= KEEP).alias("kept"))
