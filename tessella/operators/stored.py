"""Intermediate tables in the folder of spark.checkpoint.dir: they cut lineage, are computed once and outlive executors; and rows
dealt out by key."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which driver and executors share. Only a local master that names none, as in tests,
    gets a temporary one; a cluster without it is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found and spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        found = spark.sparkContext._jsc.sc().getCheckpointDir().get()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="tessella-")
        spark.sparkContext.setCheckpointDir(found)
    return found


def new_path(spark: SparkSession, name: str) -> str:
    return f"{folder(spark)}/tables/{name}-{uuid.uuid4().hex}"


#: Whether a written table's shuffles go when it is written, as nothing reads them again; else they wait for the driver's garbage collection.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stored(df: DataFrame, name: str, by: str | None = None, codec: str | None = None) -> DataFrame:
    """df, written (in a folder for each value of a column, if `by` names one) and read again. The files of its shuffles are
    deleted then."""
    spark, path = df.sparkSession, new_path(df.sparkSession, name)
    writer = df.write.option("compression", codec) if codec else df.write
    before = spark.conf.get(_CLEANUP, None)
    try:
        spark.conf.set(_CLEANUP, "true")
        (writer.partitionBy(by) if by else writer).parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before) if before else spark.conf.unset(_CLEANUP)
    return spark.read.schema(df.schema).parquet(path)


def dealt(df: DataFrame, *by: str) -> DataFrame:
    """df, dealt out by columns to as many partitions as shuffles have. AQE joins small ones by their compressed bytes, which say
    little of rows that repeat themselves; these it leaves as they are."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *by)


def clear(spark: SparkSession, name: str = "tables") -> bool:
    """Deletes the tables that jobs of this library left in the folder (`tessella`: those of the corpus operators), whether there
    were any. For the end of an application: whatever still reads one of them fails."""
    place = spark._jvm.org.apache.hadoop.fs.Path(f"{folder(spark)}/{name}")
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
