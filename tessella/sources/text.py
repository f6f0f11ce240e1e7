"""Sources: folders of text files, uploaded tables, templates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as tx

# The lines that head a paragraph with its keywords, and least and greatest lengths.
META = r"^#{0,3}\s*(?:关键词|适用章节)\s*[:：]\s*(.*)$"
LEAST_PARAGRAPH, LEAST_FILE, MOST_FILE = 20, 50, 12_000


def text_files(spark: SparkSession, folder: str, pattern: str = "*.txt") -> DataFrame:
    """(source, folder, text): every file below the folder, whole; a folder that does not exist gives no rows."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], "source string, folder string, text string")
    found = spark.read.text(folder, wholetext=True, recursiveFileLookup=True, pathGlobFilter=pattern)
    return found.select(F.col("_metadata.file_path").alias("source"), F.lit(folder).alias("folder"), F.col("value").alias("text"))


def split_meta(paragraph):
    """(keywords, body) of a paragraph: leading keyword lines go to keywords, ordered, distinct, joined by `、`."""
    lines = F.split(paragraph, "\n")
    start = F.struct(F.lit(True).alias("head"), F.array().cast("array<string>").alias("keys"), F.array().cast("array<string>").alias("body"))

    def step(acc, line):
        meta = acc["head"] & tx.strip(line).rlike(META)
        keys = F.concat(acc["keys"], F.filter(F.transform(F.split(F.regexp_extract(tx.strip(line), META, 1), "[、,，;；]"), tx.strip), lambda k: k != ""))
        inside = F.struct(F.lit(True).alias("head"), keys.alias("keys"), acc["body"].alias("body"))
        outside = F.struct(F.lit(False).alias("head"), acc["keys"].alias("keys"), F.array_append(acc["body"], line).alias("body"))
        return F.when(meta, inside).otherwise(outside)

    return F.aggregate(lines, start, step, lambda acc: F.struct(F.array_join(F.array_distinct(acc["keys"]), "、").alias("keywords"), tx.strip(F.array_join(acc["body"], "\n")).alias("body")))


def chunks(files: DataFrame, delimiter: str = r"\n\s*\n", least: int = LEAST_PARAGRAPH) -> DataFrame:
    """(folder, source, pos, keywords, text) of the paragraphs of files; short ones go, before and after their keyword
    lines are taken off. pos keeps the order of the file. (A01)"""
    parts = files.select("folder", "source", F.posexplode(F.split("text", delimiter)).alias("pos", "p")).where(F.length(tx.strip(F.col("p"))) >= least)
    parts = parts.withColumn("m", split_meta(tx.strip(F.col("p"))))
    return parts.where(F.length("m.body") >= least).select("folder", "source", "pos", F.col("m.keywords").alias("keywords"), F.col("m.body").alias("text"))


def uploaded_table(spark: SparkSession, path: str) -> DataFrame:
    """A CSV or TSV file with all columns as strings, null as empty, a byte order mark taken off the first name; a
    quote within quotes is doubled. (A13)"""
    suffix = path.lower().rsplit(".", 1)[-1]
    if suffix not in ("csv", "tsv"):
        raise ValueError(f"no table format: {suffix}")
    found = spark.read.csv(path, header=True, inferSchema=False, escape='"', sep="\t" if suffix == "tsv" else ",")
    return found.toDF(*(c.removeprefix("﻿").strip() for c in found.columns)).na.fill("")


def import_standards(rows: DataFrame, code: str = "编号", title: str = "标题", category: str = "类别", status: str = "状态", domains: str = "适用领域") -> DataFrame:
    """(row, code, raw_code, title, category, status, domains, error) of an uploaded table; rows without a code carry an
    error. row counts from 2, as in the file; it follows the order of reading. (A14)"""
    placed = rows.withColumn("_at", F.monotonically_increasing_id())
    part = F.shiftright("_at", 33)
    sizes = placed.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))  # one row a partition
    before = F.coalesce(F.sum("_n").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = F.broadcast(sizes.select("_part", before.alias("_before")))
    numbered = placed.withColumn("_part", part).join(starts, "_part").withColumn("row", F.col("_before") + F.col("_at").bitwiseAND((1 << 33) - 1) + 2)
    name = lambda c, default: F.coalesce(F.nullif(tx.strip(F.col(c)), F.lit("")), F.lit(default))
    parts = F.filter(F.transform(F.split(F.replace(domains, F.lit(";"), F.lit("；")), "；"), tx.strip), lambda d: d != "")
    blank = tx.strip(F.col(code)) == ""
    return numbered.select(
        "row", tx.standard_core(F.col(code)).alias("code"), tx.strip(F.col(code)).alias("raw_code"), tx.strip(F.col(title)).alias("title"), name(category, "国标").alias("category"),
        name(status, "active").alias("status"), F.array_distinct(parts).alias("domains"), F.when(blank, F.concat(F.lit("第 "), F.col("row").cast("string"), F.lit(" 行缺少编号"))).alias("error"),
    )


def templates(files: DataFrame) -> DataFrame:
    """(source, meta, text) of template files headed by `# key: value` lines, by source."""
    lines = F.split("text", "\n")
    meta = F.filter(F.transform(lines, tx.meta_line), lambda m: m.isNotNull())
    body = F.array_join(F.filter(lines, lambda x: tx.meta_line(x).isNull()), "\n")
    return files.select("source", F.map_from_entries(F.array_distinct(meta)).alias("meta"), tx.strip(body).alias("text"))
