"""Progress events as a table that is read as a stream: replayable, where the application's bus forgets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def stream(spark: SparkSession, path: str, files_per_batch: int = 1000) -> DataFrame:
    """The events of a folder of Parquet files, or of one file, as they arrive."""
    reader = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", files_per_batch)
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    if place.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(place).isFile():
        folder, _, name = path.rpartition("/")
        return reader.option("pathGlobFilter", name).parquet(folder)
    return reader.parquet(path)


def stage_counts(events: DataFrame) -> DataFrame:
    """Events and their greatest id by project and stage: a running count."""
    return events.groupBy(F.col("user_id").alias("project"), F.col("event_type").alias("stage")).agg(F.count("*").alias("n"), F.max("event_id").alias("last_id"))


def windowed(events: DataFrame, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Counts by hour and stage; events later than the watermark are dropped. An extension: the bus has no event time."""
    timed = events.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", late)
    return timed.groupBy(F.window("at", width), F.col("event_type").alias("stage")).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), "stage", "n")


def ended(events: DataFrame) -> DataFrame:
    """Projects whose last event ends their stream: complete, or an error without a chapter."""
    last = events.groupBy("project").agg(F.max_by(F.struct("stage", "chapter_id"), "event_id").alias("e"))
    return last.where("e.stage = 'complete' OR (e.stage = 'error' AND e.chapter_id IS NULL)").select("project", "e.stage")
