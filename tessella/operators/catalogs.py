"""Tables of contents found in the lines of documents: runs of numbered lines, and the titles that follow an outline's
heading. Lines are (doc, pos, line) with pos 1, 2, 3... in each document."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import records as rec
from ..functions import text as tx

# Words and patterns that results depend on.
ANCHORS = ["投标函", "授权委托书", "法定代表人", "投标保证金", "资格审查", "报价清单", "项目实施方案", "商务标", "技术标", "技术部分", "商务部分"]
TECHNICAL = ["项目实施方案", "技术标", "技术部分", "技术文件", "施工组织设计", "技术方案"]
NUMERAL_LINE = r"^([一二三四五六七八九十百]+)[、．.]\s*(.+)$"
BRACKET_LINE = r"^[（(]\s*([一二三四五六七八九十百]+|\d{1,2})\s*[）)]\s*(.+)$"
NUMBER_LINE = r"^(\d{1,2}(?:\.\d+)+)\s*[．、.]?\s*(.+)$|^(\d{1,2})(?:[\s、．]+|\.\s+)(.+)$"
OUTLINE_HEAD = r"施工组织设计(?:纲要|大纲)|技术标(?:文件)?(?:组成|格式|目录)|技术部分(?:组成|格式|目录)|项目实施方案.{0,12}(?:应包含|包括|内容|组成|编写)"
OUTLINE_WORDS = ["工程", "施工", "质量", "安全", "进度", "平面", "组织", "环保", "文明", "资源", "工序", "设计特点"]
REFUSED = ["不得", "必须严格执行", "违约", "本合同", "招标人提供", "按国家", "应明确", "应附"]
REFUSED_STARTS = ["用", "简要", "分析因", "当承包人", "无论", "针对"]
#: Lines that an outline reaches beyond its heading, its titles, rows and anchors of a run, characters of a run's title.
REACH, TITLES, ROWS, HITS, LONGEST = 79, 20, 3, 2, 60


def lines_of(items: DataFrame) -> DataFrame:
    """(doc, pos, line) of items (doc, pos, text): the lines of all items in order, without blank ones."""
    split = F.filter(F.transform(F.split(F.coalesce("text", F.lit("")), r"[\r\n]+"), tx.strip), lambda s: s != "")
    each = items.select("doc", F.col("pos").alias("item"), F.posexplode(split).alias("sub", "line"))
    return each.select("doc", F.row_number().over(W.partitionBy("doc").orderBy("item", "sub")).alias("pos"), "line")


def runs(rows: DataFrame, group: str = "doc", order: str = "pos") -> DataFrame:
    """rows (those of whole numbered sequences that belong to a run) with run: the place where the run of neighbours that
    each belongs to begins. What no run has need not be given; only these rows are sorted."""
    island = F.col(order) - F.row_number().over(W.partitionBy(group).orderBy(order))
    return rows.withColumn("run", island).withColumn("run", F.min(order).over(W.partitionBy(group, "run")))


def contents(lines: DataFrame, least: int = ROWS, hits: int = HITS) -> DataFrame:
    """(doc, start, entries) of each document's longest run of numbered titles with enough rows and anchors; of equals the
    first. An entry is `numeral、title`. (I45)"""
    title = rec.clean_title(F.regexp_extract("line", NUMERAL_LINE, 2))
    rows = lines.where(F.col("line").rlike(NUMERAL_LINE)).select("doc", "pos", F.regexp_extract("line", NUMERAL_LINE, 1).alias("numeral"), title.alias("title"))
    rows = runs(rows.where((F.col("title") != "") & (F.length("title") <= LONGEST)))
    entry = F.struct("pos", F.concat("numeral", F.lit("、"), "title").alias("entry"))
    by = rows.groupBy("doc", "run").agg(F.count("*").alias("n"), F.count_if(tx.contains_any(F.col("title"), ANCHORS)).alias("hits"))
    best = by.where((F.col("n") >= least) & (F.col("hits") >= hits)).groupBy("doc").agg(F.min_by("run", F.struct(-F.col("n"), "run")).alias("run"))
    kept = rows.join(best, ["doc", "run"], "left_semi").groupBy("doc", "run").agg(F.sort_array(F.collect_list(entry)).alias("es"))
    return kept.select("doc", F.col("run").alias("start"), F.col("es")["entry"].alias("entries"))


def outline_title(line: Column) -> Column:
    """The title that a line gives an outline, or null."""
    number = F.when(F.regexp_extract(line, NUMBER_LINE, 4) != "", F.regexp_extract(line, NUMBER_LINE, 4)).otherwise(F.regexp_extract(line, NUMBER_LINE, 2))
    bare = tx.strip(F.regexp_replace(line, "^(简要叙述|要求|包括|含)", ""))
    point = tx.contains_any(bare, OUTLINE_WORDS) & (tx.contains_any(bare, ["，", "、", "等"]) | (F.length(bare) <= 40))
    found = (
        F.when(line.rlike(BRACKET_LINE), F.regexp_extract(line, BRACKET_LINE, 2)).when(line.rlike(NUMBER_LINE), number)
        .when(line.rlike(NUMERAL_LINE), F.regexp_extract(line, NUMERAL_LINE, 2)).when(point, bare)
    )
    refused = lambda t: tx.contains_any(t, REFUSED) | t.rlike("^(?:" + "|".join(REFUSED_STARTS) + ")")
    return tx.let(rec.clean_title(found), lambda t: F.when((F.length(t) >= 2) & ~refused(t), t))


def outlines(lines: DataFrame, reach: int = REACH, most: int = TITLES) -> DataFrame:
    """(doc, start, titles) of the heading whose outline has most titles; of equals the first. An outline takes the distinct
    titles of at most `reach` lines below its heading, `most` at most, up to a line that begins another part. (I46)

    What each line is, is told by expressions; the lines' marks and titles then pass by in order, and a task holds the
    headings of the last `reach` lines with their titles and the best so far, over the ends of batches, so a document may
    be of any length. Headings within others' reach are outlines of their own."""
    line = F.col("line")
    stop = (line.rlike(NUMERAL_LINE) & tx.contains_any(line, ANCHORS)) | line.rlike(r"^第[一二三四五六七八九十\d]+章") | line.rlike(r"^(?:1\.承包人|允许分包)")
    skip = line.rlike("^(?:注：|说明：)")
    marked = lines.select("doc", F.col("pos").cast("long"), F.coalesce(line.rlike(OUTLINE_HEAD), F.lit(False)).alias("head"), F.coalesce(stop, F.lit(False)).alias("stop"), F.when(~skip & ~stop, outline_title(line)).alias("title"))
    schema = T.StructType([lines.schema["doc"], *T.StructType.fromDDL("start long, titles array<string>").fields])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        doc, begun, best = None, False, (0, 0, [])
        open_: deque[tuple[int, list[str]]] = deque()
        out: list[tuple] = []

        def offer(start: int, titles: list[str]) -> None:
            nonlocal best
            if titles and (len(titles), -start) > (best[0], -best[1]):
                best = (len(titles), start, titles)

        def end() -> None:
            nonlocal best
            while open_:
                offer(*open_.popleft())
            if best[0]:
                out.append((doc, *best[1:]))
            best = (0, 0, [])

        for batch in batches:
            for at, pos, head, stop, title in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if begun and at != doc:
                    end()
                doc, begun = at, True
                while open_ and open_[0][0] < pos - reach:
                    offer(*open_.popleft())
                if stop:
                    while open_:
                        offer(*open_.popleft())
                elif title is not None:
                    for _, titles in open_:
                        if len(titles) < most and title not in titles:
                            titles.append(title)
                if head:
                    open_.append((pos, []))
            yield pa.RecordBatch.from_pylist([dict(zip(("doc", "start", "titles"), r, strict=True)) for r in out], pa.schema([("doc", batch.schema.field(0).type), ("start", pa.int64()), ("titles", pa.list_(pa.string()))]))
            out.clear()
            kind = batch.schema.field(0).type
        if begun:
            end()
            yield pa.RecordBatch.from_pylist([dict(zip(("doc", "start", "titles"), r, strict=True)) for r in out], pa.schema([("doc", kind), ("start", pa.int64()), ("titles", pa.list_(pa.string()))]))

    return marked.repartition("doc").sortWithinPartitions("doc", "pos").mapInArrow(scan, schema)


def catalogues(items: DataFrame) -> DataFrame:
    """(doc, catalog) of items (doc, pos, text): the outline's titles below the technical entry of the contents, if there are
    two of them; else the contents; else what there is of an outline. Documents without any have no row. (I43)"""
    lines = lines_of(items)
    found = contents(lines).select("doc", "entries").join(outlines(lines).select("doc", "titles"), "doc", "full")
    parent = F.get(F.filter("entries", lambda e: tx.contains_any(e, TECHNICAL)), F.lit(0))
    headed = F.when(parent.rlike("^[一二三四五六七八九十]+、"), parent).otherwise(F.concat(F.lit("（一）"), parent))
    below = F.transform("titles", lambda t, i: F.concat(F.lit("  "), (i + 1).cast("string"), F.lit(". "), t))
    alone = F.transform("titles", lambda t, i: F.concat(F.lit("（"), tx.chinese_number(i + 1), F.lit("）"), t))
    outline = F.array_join(F.when(parent.isNotNull(), F.array_prepend(below, headed)).otherwise(alone), "\n")
    many = F.coalesce(F.size("titles"), F.lit(0)) >= 2
    return found.select("doc", F.when(many | F.col("entries").isNull(), outline).otherwise(F.array_join("entries", "\n")).alias("catalog"))


def filled(records: DataFrame, items: DataFrame) -> DataFrame:
    """records (doc, catalog and whatever else) whose blank catalogues are those found in items (doc, pos, text)."""
    blank = F.coalesce(tx.strip(F.col("catalog")), F.lit("")) == ""
    asked = items.join(records.where(blank).select("doc").distinct(), "doc", "left_semi")
    found = catalogues(asked).withColumnRenamed("catalog", "_found")
    return records.join(found, "doc", "left").withColumn("catalog", F.when(blank, F.col("_found")).otherwise(F.col("catalog"))).drop("_found")
