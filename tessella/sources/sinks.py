"""Sinks: report text, ordered block tables, debug exports."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

MARKS = {"block": "✗", "warn": "!", "info": "·"}


def markdown_report(findings: DataFrame) -> DataFrame:
    """(id, report): each chapter's findings as lines, most severe first, then by rule and message."""
    order = F.when(F.col("severity") == "block", 0).when(F.col("severity") == "warn", 1).otherwise(2)
    mark = F.create_map(*[F.lit(x) for kv in MARKS.items() for x in kv])
    line = F.concat(F.lit("- "), F.coalesce(mark[F.col("severity")], F.lit("!")), F.lit(" ["), F.col("category"), F.lit("] "), F.col("message"))
    by = findings.groupBy("id").agg(F.array_sort(F.collect_list(F.struct(order.alias("o"), "check_id", "message", line.alias("line")))).alias("x"))
    return by.select("id", F.array_join(F.col("x")["line"], "\n").alias("report"))


def export(datasets: dict[str, DataFrame], folder: str) -> None:
    """Each dataset as JSON lines in a folder of its name."""
    for name, df in datasets.items():
        df.write.mode("overwrite").json(f"{folder}/{name}")


def append_files(chunks: DataFrame, stored: DataFrame, path: str) -> int:
    """Appends the bodies that the stored ones do not hold as lines of text, line feeds within them as spaces; returns how
    many. Bodies are compared as they are stored, so a second run adds nothing. (A23)"""
    body = F.regexp_replace("text", r"\s*\n\s*", " ")
    known = stored.select(F.md5(body).alias("h")).distinct()
    fresh = chunks.select(body.alias("value"), F.md5(body).alias("h")).join(known, "h", "left_anti").dropDuplicates(["h"])
    seen = Observation()
    fresh.select("value").observe(seen, F.count("*").alias("n")).write.mode("append").text(path)
    return seen.get["n"]
