"""Importance resampling of documents towards a target by hashed word and word-pair features.

Two passes of Arrow batches over the texts. The first counts features by bucket: each partition yields one vector of a
fixed length from np.bincount, and treeReduce adds the vectors, so the driver sees one vector whatever the input. The
gains of the buckets follow from it and are sent to all tasks (8 bytes a bucket). The second pass gathers the gains of a
document's features and sums them by np.bincount with weights. A key hashed from doc_id turns weights into scores whose
highest are a draw without replacement (Gumbel's maximum). Ranks need no global sort: counts by bin, then by score within
a bin, tell where a score begins, and doc_id orders the rows of one score.

A feature is a word or two neighbouring words joined by one space; its bucket is the CRC-32 of its UTF-8 bytes. These are
computed for all words of a slice at once: byte k of every word that has one, from the longest word to the shortest.

A null or empty text has no words, weight 0 and n_features 0. A null doc_id is hashed as an empty one and comes last among
ties. Rows that repeat a doc_id are documents of their own with the same key; rows alike in doc_id, score and n_features
are ranked in any order, which no column shows. Texts of any length are read whole. An empty table gives an empty result,
an empty target counts 0 in each bucket. Only doc_id and text are read; further columns may have any name.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import common

#: Buckets, percent of the documents that are drawn, words that a document needs, and the seed of the keys.
BUCKETS, PERCENT, LEAST, SEED = 10_000, 25, 20, 7
#: Bytes of a word whose CRC is computed beside those of other words; longer ones go through zlib each.
_ASIDE = 64
#: Scores in a bin of the ranking.
_BIN = 128

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Bytes of words, after A-Z became small: digits, letters and all bytes of characters beyond ASCII.
_LETTER = np.zeros(256, bool)
_LETTER[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


def _table() -> np.ndarray:
    """What one byte does to a CRC-32 register (reflected polynomial 0xEDB88320)."""
    found = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        found = np.where(found & 1, (found >> 1) ^ np.uint32(0xEDB88320), found >> 1)
    return found


_CRC = _table()
_ONES = np.uint32(0xFFFFFFFF)


def advance(register: np.ndarray, raw: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """CRC-32 registers after raw[start : start + length] each."""
    order = np.argsort(-lengths, kind="stable")
    state, at, size = register[order], starts[order], lengths[order]
    most = int(size[0]) if len(size) else 0
    if most > _ASIDE:
        long = int(np.searchsorted(-size, -_ASIDE, "left"))
        for i in range(long):
            state[i] = zlib.crc32(raw[at[i] : at[i] + size[i]], int(state[i] ^ _ONES)) ^ 0xFFFFFFFF
    else:
        long = 0
    rest = -size[long:]
    for k in range(min(most, _ASIDE)):
        n = long + int(np.searchsorted(rest, -k, "left"))  # words with more than k bytes
        part = state[long:n]
        state[long:n] = _CRC[(part ^ raw[at[long:n] + k]) & np.uint32(255)] ^ (part >> np.uint32(8))
    out = np.empty_like(state)
    out[order] = state
    return out


def words(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and lengths of the words of all texts in order, and the number of words before each text."""
    solid = _LETTER[raw]
    edge = np.zeros(len(raw) + 1, bool)
    edge[at] = True  # words end with their text
    starts = np.flatnonzero(solid & (edge[:-1] | ~np.concatenate(([False], solid[:-1]))))
    ends = np.flatnonzero(solid & (edge[1:] | ~np.concatenate((solid[1:], [False])))) + 1
    return starts, ends - starts, np.searchsorted(starts, at)


def hashed(column: pa.Array, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For the texts of a column: the bucket and the text of every feature, and the number of words of every text."""
    raw, at = common.text_bytes(column)
    raw = _LOWER[raw]
    starts, lengths, first = words(raw, at)
    n = np.diff(first)
    of = np.repeat(np.arange(len(n)), n)
    one = advance(np.full(len(starts), _ONES), raw, starts, lengths)
    left = np.flatnonzero(of[:-1] == of[1:])  # the words that another one follows
    space = _CRC[(one[left] ^ np.uint32(32)) & np.uint32(255)] ^ (one[left] >> np.uint32(8))
    two = advance(space, raw, starts[left + 1], lengths[left + 1])
    crc = np.concatenate((one, two)) ^ _ONES
    return (crc % np.uint32(buckets)).astype(np.int64), np.concatenate((of, of[left])), n


def counts(docs: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """Features of all texts by bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for part in common.slices(batch, "text", 2 << 20):
                total += np.bincount(hashed(part.column("text"), buckets)[0], minlength=buckets)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["counts"])

    vectors = docs.select("text").mapInArrow(run, "counts binary").rdd.map(lambda r: np.frombuffer(r["counts"], np.int64))
    if not vectors.getNumPartitions():
        return np.zeros(buckets, np.int64)
    return vectors.treeReduce(np.add)


def gains(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 * the logarithm of how much more frequent a bucket is in the target), one added to every bucket."""
    size, goal, more = int(raw.sum()), int(target.sum()), len(raw)
    return np.array([math.floor(1000 * math.log((t + 1) * (size + more) / ((s + 1) * (goal + more)))) for s, t in zip(raw.tolist(), target.tolist(), strict=True)], np.int64)


def weighed(docs: DataFrame, gain: np.ndarray) -> DataFrame:
    """doc_id, n_words, n_features, weight (the floored mean of the gains of the features; 0 if there are none)."""
    gain = docs.sparkSession.sparkContext.broadcast(gain)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by = gain.value
        for batch in batches:
            for part in common.slices(batch, "text", 2 << 20):
                bucket, of, n = hashed(part.column("text"), len(by))
                features = np.maximum(2 * n - 1, 0)
                # sums of whole numbers below 2^53, so exact in doubles
                sums = np.bincount(of, weights=by[bucket], minlength=len(n)).astype(np.int64)
                weight = sums // np.maximum(features, 1)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *(pa.array(x, pa.int64()) for x in (n, features, weight))], ["doc_id", "n_words", "n_features", "weight"])

    return docs.select("doc_id", "text").mapInArrow(run, common.with_id(docs, "n_words long, n_features long, weight long"))


def keyed(weights: DataFrame, seed: int = SEED) -> DataFrame:
    """weights with score: the weight and 1000 times a Gumbel value that is hashed from doc_id, floored."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / F.lit(4294967296.0))))
    return weights.withColumn("score", F.col("weight") + noise)


def ranked(scores: DataFrame, percent: int = PERCENT, least: int = LEAST) -> DataFrame:
    """scores (a stored table) with rank: 1, 2, 3... for the highest percent of the documents with enough words."""
    fine = scores.where(F.col("n_words") >= least)
    bin_ = F.floor(F.col("score") / _BIN)
    by_score = fine.groupBy("score").agg(F.count("*").alias("c")).withColumn("bin", bin_)
    by_score = common.written(by_score, "scores")
    # weights are means of gains and noise is logarithmic: bins are a few hundred rows at any size of the input
    bins = by_score.groupBy("bin").agg(F.sum("c").alias("c"))
    above = F.sum("c").over(W.orderBy(F.desc("bin")).rowsBetween(W.unboundedPreceding, -1))
    bins = bins.select("bin", F.coalesce(above, F.lit(0)).alias("above"), (F.sum("c").over(W.partitionBy()) * percent / 100).alias("exact"))
    bins = bins.select("bin", "above", F.floor("exact").alias("most")).where("above < most")
    within = F.sum("c").over(W.partitionBy("bin").orderBy(F.desc("score")).rowsBetween(W.unboundedPreceding, -1))
    starts = by_score.join(common.sent(bins), "bin").select("score", "most", (F.col("above") + F.coalesce(within, F.lit(0))).alias("before"))
    starts = common.sent(starts.where("before < most"))
    place = F.row_number().over(W.partitionBy("score").orderBy(F.col("doc_id").asc_nulls_last(), "n_features", "n_words")) + F.col("before")
    drawn = fine.join(starts, "score").select(*scores.columns, "most", place.cast("long").alias("rank"))
    drawn = drawn.select(*scores.columns, F.when(F.col("rank") <= F.col("most"), F.col("rank")).alias("rank"))
    rest = scores.join(starts.select("score"), "score", "left_anti").where(F.col("n_words") >= least).unionByName(scores.where(F.col("n_words") < least))
    return drawn.unionByName(rest.withColumn("rank", F.lit(None).cast("long")))


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least: int = LEAST, buckets: int = BUCKETS, seed: int = SEED) -> DataFrame:
    """doc_id, n_words, n_features, weight, score, rank: one row for each row of docs, drawn towards the texts of target."""
    gain = gains(counts(docs, buckets), counts(target, buckets))
    return ranked(common.written(keyed(weighed(docs, gain), seed), "weights"), percent, least)


def resampled(docs: DataFrame, target: DataFrame, **options) -> DataFrame:
    """The rows of docs whose doc_id is drawn, all columns."""
    return common.semi(docs, resample(docs, target, **options).where("rank IS NOT NULL"), "doc_id")


def op11_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    target = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return resample(common.documents(spark, sf_dir), target).select("doc_id", "n_features", "weight", "score", "rank")


#: CRC-32 byte by byte in SQL: a list of what each byte does, then a fold over the bytes of every distinct feature.
SQL = r"""
WITH RECURSIVE step(b, k, r) AS (
    SELECT range, 0, range::BIGINT FROM range(256)
    UNION ALL SELECT b, k + 1, CASE WHEN r % 2 = 1 THEN xor(r // 2, 3988292384::BIGINT) ELSE r // 2 END FROM step WHERE k < 8
), crc AS MATERIALIZED (SELECT list(r ORDER BY b) AS t FROM step WHERE k = 8
), w AS MATERIALIZED (
    SELECT 0 AS part, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS x FROM documents
    UNION ALL
    SELECT 1, item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') FROM benchmark
), f AS MATERIALIZED (
    SELECT part, doc_id, f, count(*) AS n FROM (
        SELECT part, doc_id, unnest(x) AS f FROM w
        UNION ALL SELECT part, doc_id, unnest(list_transform(range(1, len(x)), lambda i: x[i] || ' ' || x[i + 1])) FROM w WHERE len(x) > 1)
    GROUP BY ALL
), d AS (SELECT DISTINCT f FROM f
), h AS MATERIALIZED (
    SELECT f, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(0, octet_length(encode(f))), lambda i: ('0x' || substr(hex(encode(f)), 2 * i::INT + 1, 2))::BIGINT)),
        lambda a, b: xor(t[1 + (xor(a, b) & 255)], a >> 8)), 4294967295::BIGINT) % 10000 AS bucket
    FROM d, crc
), g AS MATERIALIZED (
    SELECT bucket, floor(1000 * ln((t + 1)::DOUBLE * (SUM_S + 10000) / ((s + 1)::DOUBLE * (SUM_T + 10000))))::BIGINT AS gain
    FROM (SELECT range AS bucket, coalesce(s, 0) AS s, coalesce(t, 0) AS t, sum(coalesce(s, 0)) OVER () AS SUM_S, sum(coalesce(t, 0)) OVER () AS SUM_T
        FROM range(10000) LEFT JOIN (SELECT bucket, sum(n) FILTER (part = 0) AS s, sum(n) FILTER (part = 1) AS t FROM f JOIN h USING (f) GROUP BY bucket) AS b ON b.bucket = range)
), e AS (
    SELECT doc_id, floor(sum(n * gain) / sum(n))::BIGINT AS weight FROM f JOIN h USING (f) JOIN g USING (bucket) WHERE part = 0 GROUP BY doc_id
), s AS (
    SELECT w.doc_id, len(x) AS words, greatest(2 * len(x) - 1, 0)::BIGINT AS n_features, coalesce(weight, 0) AS weight,
        coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('7:' || w.doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score
    FROM w LEFT JOIN e USING (doc_id) WHERE part = 0
), r AS (
    SELECT *, row_number() OVER (PARTITION BY words >= 20 ORDER BY score DESC, doc_id) AS place, (count(*) FILTER (words >= 20) OVER ()) * 25 // 100 AS most FROM s
)
SELECT doc_id, n_features, weight, score, CASE WHEN words >= 20 AND place <= most THEN place END AS rank FROM r
"""
