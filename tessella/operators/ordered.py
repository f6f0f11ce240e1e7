"""Order-dependent operators that no relational form expresses. `fuzzy_distinct` takes one group at a time in pandas, so a
group has to fit a task; `packed` takes groups of any length in batches."""

from __future__ import annotations

import difflib
import json
import struct
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as tx
from .stored import dealt


def fuzzy_distinct(rows: DataFrame, group: str, threshold: float = 0.9) -> DataFrame:
    """rows (group, pos, title) without those whose title resembles an earlier kept one, in order."""

    def keep(part: pd.DataFrame) -> pd.DataFrame:
        kept: list[str] = []
        out = []
        for row in part.sort_values(["pos", "title"]).itertuples(index=False):
            title = (row.title or "").strip()
            if not any(difflib.SequenceMatcher(None, title, k).ratio() >= threshold for k in kept):
                kept.append(title)
                out.append(row)
        return pd.DataFrame(out, columns=part.columns)

    return rows.groupBy(group).applyInPandas(keep, rows.schema)


def packed(items: DataFrame, group: str, most: int = 18_000) -> DataFrame:
    """(group, pos, chunk) of items (group, pos, text): filled in order up to `most` characters, a longer item alone. Only
    lengths are moved, and groups pass by in order: a task holds a batch of rows, however long a group is. (F15)"""
    lengths = items.select(group, F.lit(0).alias("step"), "pos", F.coalesce(F.length("text"), F.lit(0)).alias("n"))
    return _filled(dealt(lengths, group), group, most).drop("part")


def _filled(lengths: DataFrame, group: str, most: int) -> DataFrame:
    """(group, pos, part, chunk) of rows (group, step, pos, n) of which each group lies in one partition: a part for each step,
    filled anew up to `most`."""

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, step, part, chunk, held, begun = None, None, 0, 0, 0, False
        for batch in batches:
            parts, chunks = [], []
            for key, s, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(3).to_pylist(), strict=True):
                if not begun or key != at:
                    at, step, part, chunk, held, begun = key, s, 0, 0, 0, True
                elif s != step:
                    step, part, chunk, held = s, part + 1, 0, 0
                if held and held + n > most:
                    chunk, held = chunk + 1, 0
                parts.append(part)
                chunks.append(chunk)
                held += n
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(parts, pa.int32()), pa.array(chunks, pa.int32())], [group, "pos", "part", "chunk"])

    schema = T.StructType([lengths.schema[group], lengths.schema["pos"], *T.StructType.fromDDL("part int, chunk int").fields])
    return lengths.sortWithinPartitions(group, "step", "pos").mapInArrow(fill, schema)


def extraction_chunks(items: DataFrame, group: str, pages: int = 15, most: int = 18_000) -> DataFrame:
    """(group, pos, part, chunk) of items (group, page, pos, text): by steps of pages, and each step filled as packed() does; a
    group whose items all lie on one page is filled as a whole. Parts count the steps that hold items from 0 on, chunks those
    within a part. Texts are measured where they are read; lengths alone are dealt out, once, and sorted. (F17)"""
    lengths = dealt(items.select(group, "page", "pos", F.length(tx.strip(F.coalesce("text", F.lit("")))).alias("n")), group)
    single = F.min("page").over(W.partitionBy(group)) == F.max("page").over(W.partitionBy(group))
    step = F.when(single, 0).otherwise(F.floor((F.col("page") - 1) / pages).cast("int"))
    return _filled(lengths.select(group, step.alias("step"), "pos", "n"), group, most)


def line_diff(pairs: DataFrame) -> DataFrame:
    """(id, diff, added, removed) of pairs (id, old, new): a unified diff by lines and its counts."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = []
            for i, old, new in part[["id", "old", "new"]].itertuples(index=False):
                diff = list(difflib.unified_diff((old or "").splitlines(), (new or "").splitlines(), lineterm=""))
                body = diff[2:]
                rows.append((i, "\n".join(diff), sum(x.startswith("+") for x in body), sum(x.startswith("-") for x in body)))
            yield pd.DataFrame(rows, columns=["id", "diff", "added", "removed"])

    return pairs.select("id", "old", "new").mapInPandas(run, T.StructType([pairs.schema["id"], *T.StructType.fromDDL("diff string, added int, removed int").fields]))


def line_changes(pairs: DataFrame) -> DataFrame:
    """(id, added, removed) of pairs (id, old, new) with a change: lines that the new version holds more often, and less often,
    than the old one, wherever they stand. Lines count together before they are shuffled. (E22)"""
    each = lambda name, by: pairs.select("id", F.explode(F.split(F.coalesce(name, F.lit("")), r"\r\n|\r|\n")).alias("line")).select("id", F.xxhash64("line").alias("h"), F.lit(by).alias("by"))
    moved = each("new", 1).union(each("old", -1)).groupBy("id", "h").agg(F.sum("by").alias("n")).where("n <> 0")
    return moved.groupBy("id").agg(F.sum(F.greatest("n", F.lit(0))).alias("added"), F.sum(F.greatest(-F.col("n"), F.lit(0))).alias("removed"))


def balanced(text: str, at: int) -> int:
    """The place after the bracket that closes the one at `at`, strings and escapes apart; -1 if none does."""
    close = {"{": "}", "[": "]"}
    stack, quoted, i = [], False, at
    while i < len(text):
        c = text[i]
        if quoted:
            i += c == "\\"
            quoted = c != '"'
        elif c == '"':
            quoted = True
        elif c in close:
            stack.append(close[c])
        elif stack and c == stack[-1]:
            stack.pop()
            if not stack:
                return i + 1
        i += 1
    return -1


KINDS = ("GANTT", "TIMELINE", "FLOW", "ORG", "SMART")


def charts_of(text: str) -> list[tuple[int, int, str, str, bool]]:
    """(start, end, kind, json, valid) of the chart placeholders `[KIND_DATA:{...}]` of a text."""
    out, at = [], 0
    while (at := text.find("_DATA:", at)) >= 0:
        before = text[max(0, at - 9) : at].upper()  # as long as the longest kind and its bracket
        kind = next((k for k in KINDS if before.endswith(f"[{k}")), None)
        start, body = at - len(kind or "") - 1, at + len("_DATA:")
        while body < len(text) and text[body].isspace():
            body += 1
        at += 1
        if kind and body < len(text) and text[body] in "{[":
            end = balanced(text, body)
            if end > 0 and text[end : end + 1] == "]":
                try:
                    json.loads(text[body:end])
                    valid = True
                except ValueError:
                    valid = False
                out.append((start, end + 1, f"{kind}_DATA", text[body:end], valid))
                at = end
    return out


def chart_scan(chapters: DataFrame) -> DataFrame:
    """(id, start, end, kind, json, valid) of the chart placeholders of chapters (id, content)."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = [(i, *c) for i, text in part[["id", "content"]].itertuples(index=False) for c in charts_of(text or "")]
            yield pd.DataFrame(rows, columns=["id", "start", "end", "kind", "json", "valid"])

    schema = T.StructType([chapters.schema["id"], *T.StructType.fromDDL("start int, end int, kind string, json string, valid boolean").fields])
    return chapters.select("id", "content").mapInPandas(run, schema)


def repaired_json(text: str | None) -> str | None:
    """A JSON text out of a reply: fences and trailing commas taken off, a cut-off array closed after its last whole
    element; null if nothing parses. (K08, Y40)"""
    s = (text or "").strip()
    if s.startswith("```"):
        s = s.split("\n", 1)[-1].rsplit("```", 1)[0]
    s = s.strip()
    for tail in ("", "]", "]}", "}"):
        cut = len(s)
        while cut > 0:
            body = s[:cut].rstrip().rstrip(",")
            try:
                return json.dumps(json.loads(body + tail), ensure_ascii=False, sort_keys=True)
            except ValueError:
                cut = s.rfind("}", 0, cut - 1) + 1 if tail else 0
    return None


@F.pandas_udf(T.StringType())
def repair_json(x: pd.Series) -> pd.Series:
    return x.map(repaired_json)


@F.pandas_udf(T.BinaryType())
def to_blob(x: pd.Series) -> pd.Series:
    """A vector as bytes: its length (int32, little-endian), then float32 values."""
    return x.map(lambda v: None if v is None else struct.pack(f"<i{len(v)}f", len(v), *v))


@F.pandas_udf(T.ArrayType(T.FloatType()))
def from_blob(x: pd.Series) -> pd.Series:
    """The vector of such bytes, or of bare float32 values; null where the length fits neither."""

    def read(b: bytes | None) -> list[float] | None:
        if not b or len(b) % 4:
            return None
        if len(b) >= 8 and (n := struct.unpack_from("<i", b)[0]) > 0 and len(b) == 4 + 4 * n:
            return list(struct.unpack_from(f"<{n}f", b, 4))
        return list(struct.unpack(f"<{len(b) // 4}f", b))

    return x.map(read)


def blob_round_trip(vector: Column) -> Column:
    return from_blob(to_blob(vector))
