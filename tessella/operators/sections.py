"""Sections of documents that open at a keyword line and close by rules, and what they name."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as tx

# Keywords, the pattern of a person with a duty, and the bounds of a section.
RESUMES = ["简历", "师资", "团队成员", "人员配置", "项目人员", "骨干"]
CHARTS = ["组织架构", "组织结构", "项目组织", "人员架构", "团队架构", "团队组成"]
PERSON = r"([一-龥]{2,4})(?:[,，、]\s*(?:担任|为|出任|是|负责)?\s*|(?:担任|为|出任|是|负责)\s*)([\x{4e00}-\x{9fa5}]{2,8})"
LINE_BREAK = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\x{2028}\x{2029}]"
HEAD, BLANK_AFTER, MOST, REPORTED = 40, 3, 60, 8


def lines_of(texts: DataFrame) -> DataFrame:
    """(id, pos, line) of texts (id, text)."""
    return texts.select("id", F.posexplode(F.split(F.coalesce("text", F.lit("")), LINE_BREAK)).alias("pos", "line"))


def _marked(lines: DataFrame, kinds: dict[str, list[str]], most: int) -> DataFrame:
    """lines (id, pos, line) with `kinds`: an array of (kind, section) for the kinds of sections that a line is within; lines of
    none have no row.

    The state of a line is where its section opened (the last opening so far) and where a section last closed: two running
    maxima a kind, all in one order, so that lines are sorted once and no text is folded as a whole."""
    far = W.partitionBy("id").orderBy("pos").rowsBetween(W.unboundedPreceding, 0)
    at, blank = F.col("pos"), tx.strip(F.col("line")) == ""
    opens = {k: F.coalesce(tx.contains_any(F.col("line"), words) & (F.length("line") < HEAD), F.lit(False)) for k, words in kinds.items()}
    marked = lines.select("id", "pos", "line", blank.alias("blank"), *(x.alias(f"opens_{k}") for k, x in opens.items()))
    marked = marked.withColumns({f"section_{k}": F.max(F.when(F.col(f"opens_{k}"), at)).over(far) for k in kinds})
    closes = lambda k: F.col("blank") & ~F.col(f"opens_{k}") & (at - F.col(f"section_{k}") > BLANK_AFTER) & (at - F.col(f"section_{k}") <= most)
    marked = marked.withColumns({f"closed_{k}": F.max(F.when(closes(k), at)).over(far) for k in kinds})

    def inside(k: str) -> Column:  # null where nothing has opened yet
        section = F.col(f"section_{k}")
        open_ = ~F.col(f"opens_{k}") & (at - section <= most) & ~F.coalesce(F.col(f"closed_{k}") > section, F.lit(False))
        return F.when(open_, F.struct(F.lit(k).alias("kind"), section.alias("section")))

    return marked.select("id", "pos", "line", F.array_compact(F.array(*map(inside, kinds))).alias("kinds")).where(F.size("kinds") > 0)


def within(lines: DataFrame, keywords: list[str], most: int = MOST) -> DataFrame:
    """(id, section, pos, line) of the lines (id, pos, line) within sections. A line with a keyword and fewer than 40
    characters opens one, anew if one is open, and is not of it. It closes at a blank line after its third, or after `most`
    lines; lines from there to the next opening are of none. (F23)"""
    return _marked(lines, {"one": keywords}, most).select("id", F.col("kinds")[0]["section"].alias("section"), "pos", "line")


def names_by_kind(lines: DataFrame, kinds: dict[str, list[str]], most: int = MOST) -> DataFrame:
    """(kind, id, name): the persons that the sections of texts, given as lines (id, pos, line), name, each once; keywords by
    kind of section. (F23)"""
    found = _marked(lines, kinds, most).select("id", F.explode("kinds.kind").alias("kind"), F.regexp_extract_all("line", F.lit(PERSON), F.lit(1)).alias("ns"))
    return found.select("kind", "id", F.explode("ns").alias("name")).distinct()


def names(texts: DataFrame, keywords: list[str], most: int = MOST) -> DataFrame:
    """(id, name): the persons that the sections of texts (id, text) name, each once."""
    return names_by_kind(lines_of(texts), {"one": keywords}, most).select("id", "name")


def unlisted(texts: DataFrame) -> DataFrame:
    """(id, message) of texts whose resumes name persons that their organisation charts, which name some, do not; at most
    eight names. (D28)"""
    both = names_by_kind(lines_of(texts), {"resume": RESUMES, "chart": CHARTS})
    resumes, charts = (both.where(F.col("kind") == k).select("id", "name") for k in ("resume", "chart"))
    only = resumes.join(charts, ["id", "name"], "left_anti").join(charts.select("id").distinct(), "id", "left_semi")
    by = only.groupBy("id").agg(F.sort_array(F.collect_list("name")).alias("ns"))
    return by.select("id", F.concat(F.lit("简历章节有、组织架构未出现的人名："), F.array_join(F.slice("ns", 1, REPORTED), ", ")).alias("message"))
