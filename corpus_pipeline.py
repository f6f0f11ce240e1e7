"""Corpus pipeline: five stages, each written as Parquet and read again as the next one's documents.

Every stage works on all rows that its predecessor kept. All but the last return the columns of documents; the last
returns doc_id, n_tokens, ids and same (whether decoding gave the text back), a row for each copy that the mix takes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm import bpe, common, minhash, mixing, pii, quality


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, trained on these documents, takes for fine text."""
    weights, chance, _ = quality.fit(docs)
    return quality.score(docs, weights, chance).where(F.col(common.fresh(docs, "score")) >= quality.KEEP).select(*docs.columns)


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return minhash.deduplicated(docs, (80, 100))


def pseudonymise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data replaced by pseudonyms of the same format; n_chars follows the text."""
    found = pii.pseudonymise(docs, pii.key_of(spark))
    if "n_chars" in docs.columns:
        length = F.when(F.size(common.fresh(docs, "pii_kinds")) > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
        found = found.withColumn("n_chars", length)
    return found.select(*docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mixing.mixed(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, decoded again to prove them."""
    return bpe.round_trip(docs, bpe.vocabulary())


STAGES = [
    ("quality", classify),
    ("near-duplicates", deduplicate),
    ("pii", pseudonymise),
    ("mixing", mix),
    ("bpe", encode),
]

#: Neither training, candidate search, sampling nor tokenising can be expressed in SQL; tests compare every stage
#: with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = common.documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = common.written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
