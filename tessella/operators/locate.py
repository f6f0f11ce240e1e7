"""Excerpts found again in the texts that they were taken from, over differences of spacing, punctuation and width.

A text is folded twice: with runs of white space as one space, and compact, without white space and punctuation. Each folded
character keeps the offset of the one it comes from, so whatever is found there cuts the raw text."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Characters that are left out, those of one form, punctuation, and the pieces of an excerpt that are tried.
INVISIBLE = "­​‌‍⁠﻿‎‏᠎͏"
SAME = {" ": " ", "　": " ", "“": '"', "”": '"', "„": '"', "‟": '"', "‘": "'", "’": "'", "‚": "'", "—": "-", "–": "-", "−": "-", "─": "-", "×": "x"}
SPACES = "\t\n\x0b\x0c\r                 "
PUNCTUATION = "，。、；：！？\"\"''‘’“”（）【】《》〈〉,.!?;:'\"()[]{}<>·…—_-/\\|=+*&^%$#@~`•·‧"
QUOTED = re.compile(r"[「『\"“](.{6,160})[」』\"”]")
LEAD = re.compile(r"^(若|如|凡|投标人|申请人|响应文件|招标文件)[^，。；]{0,16}[，：:]")
CLAUSES = re.compile(r"[。；;！？\n]")
PREFIXES, WINDOWS, WINDOWED, LEAST = (80, 64, 48, 36, 28, 20, 16, 12, 8), (24, 18, 14, 10), 240, 6
#: Excerpts that are looked for in one pass over a text.
TOGETHER = 500
#: The search of a text that makes its index of grams.
INDEXED = 32

_FORM = np.arange(0x10000, dtype=np.int64)
_FORM[0xFF01:0xFF5F] -= 0xFEE0
_FORM[[ord(c) for c in SAME]] = [ord(c) for c in SAME.values()]
_FORM[[ord(c) for c in INVISIBLE]] = -1
_SPACE = np.zeros(0x10000, bool)
_SPACE[[ord(c) for c in SPACES]] = True
_MARK = np.zeros(0x10000, bool)
_MARK[[ord(c) for c in PUNCTUATION]] = True


def _string(points: np.ndarray) -> str:
    return points.astype("<u4").tobytes().decode("utf-32-le")


def _hashes(points: np.ndarray) -> np.ndarray:
    """A hash of each gram of LEAST characters."""
    h = np.zeros(len(points) - LEAST + 1, np.uint64)
    for k in range(LEAST):
        h = (h ^ points[k : k + len(h)].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return h


class Folded:
    """A folded text with the raw offset of each of its characters. From its INDEXED-th search on, it knows where each gram of
    LEAST characters stands; an index costs more than a few searches."""

    def __init__(self, points: np.ndarray, offsets: np.ndarray):
        self.text, self.offsets, self.points, self.searches = _string(points), offsets, points, 0

    @cached_property
    def grams(self) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all grams in order, and their places, those of equal ones in order."""
        h = _hashes(self.points)
        places = np.argsort(h, kind="stable")
        return h[places], places

    def find(self, other: Folded) -> int:
        """Where another folded text of at least LEAST characters first stands in this one, or -1."""
        if len(other.text) < LEAST or len(other.text) > len(self.text):
            return -1
        self.searches += 1
        if self.searches < INDEXED:
            return self.text.find(other.text)
        grams, places = self.grams
        first = _hashes(other.points[:LEAST])[0]
        lo, hi = np.searchsorted(grams, first, "left"), np.searchsorted(grams, first, "right")
        return next((at for at in places[lo:hi].tolist() if self.text.startswith(other.text, at)), -1)

    def range(self, at: int, length: int) -> tuple[int, int]:
        """The raw range of a hit."""
        return int(self.offsets[at]), int(self.offsets[at + length - 1]) + 1


def folded(text: str | None) -> tuple[Folded, Folded]:
    """(spaced, compact)."""
    raw = np.frombuffer((text or "").encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
    offsets = np.arange(len(raw))
    small = raw < 0x10000
    form = raw.copy()
    form[small] = _FORM[raw[small]]
    dots = np.where(form == ord("…"), 3, 1)  # an ellipsis is three full stops
    form, offsets = np.repeat(np.where(form == ord("…"), ord("."), form), dots), np.repeat(offsets, dots)
    form, offsets = form[form >= 0], offsets[form >= 0]
    low = np.minimum(form, 0xFFFF)
    space = _SPACE[low]
    again = space & np.concatenate(([True], space[:-1]))
    spaced, at = np.where(space, 32, form)[~again], offsets[~again]
    if len(spaced) and spaced[-1] == 32:
        spaced, at = spaced[:-1], at[:-1]
    tight = ~space & ~_MARK[low]
    return Folded(spaced, at), Folded(form[tight], offsets[tight])


@lru_cache(maxsize=4096)
def candidates(needle: str) -> tuple[tuple[Folded, Folded], ...]:
    """The pieces of an excerpt that are tried, those with most compact characters first: first the excerpt itself."""
    spaced, compact = folded(needle)
    full, seen, out = spaced.text, set(), []

    def push(piece: str) -> None:
        both = folded(piece)
        if len(both[1].text) >= LEAST and both[0].text not in seen:
            seen.add(both[0].text)
            out.append(both)

    push(full)
    if quoted := QUOTED.search(full):
        push(quoted[1])
    push(LEAD.sub("", full, count=1))
    for part in CLAUSES.split(full):
        push(part)
    for n in PREFIXES:
        if len(full) > n:
            push(full[:n])
    for n in WINDOWS:
        if len(compact.text) > n:
            for at in range(0, min(len(compact.text), WINDOWED) - n + 1, max(4, n // 2)):
                push(compact.text[at : at + n])
    return tuple(sorted(out, key=lambda both: -len(both[1].text)))


def located(text: tuple[Folded, Folded], needle: str | None) -> tuple[int, int, int, bool] | None:
    """(start, end, score, fuzzy) of the longest piece of an excerpt that a folded text holds, or None. The score is the number
    of folded characters; a hit is fuzzy unless it is the whole excerpt, punctuation and spacing apart. (I66)"""
    both = folded(needle or "")
    whole = both[1].text
    if len(whole) < LEAST:
        return None
    for haystack, piece in zip(text, both, strict=True):  # the pieces are made of an excerpt only that is not there whole
        if (at := haystack.find(piece)) >= 0:
            return (*haystack.range(at, len(piece.text)), len(piece.text), False)
    best = None
    for spaced, compact in candidates(needle or ""):
        exact = compact.text == whole
        for haystack, piece in zip(text, (spaced, compact), strict=True):
            if (not best or len(piece.text) > best[2]) and (at := haystack.find(piece)) >= 0:
                best = (*haystack.range(at, len(piece.text)), len(piece.text), not exact)
                if exact:
                    return best
    return best


def locate(texts: DataFrame, needles: DataFrame) -> DataFrame:
    """(needle_id, id, start, end, score, fuzzy) of the excerpts (needle_id, id, needle) in their texts (id, text), offsets
    from 0 on in characters, end exclusive. Excerpts of fewer than six compact characters and such that are not found have
    no row. (I66)

    The excerpts of a text go to it in rows of at most TOGETHER, so its folded forms and gram index serve many of them, and a
    text with very many is looked at by several tasks."""
    counts = needles.groupBy("id").agg(F.count("*").alias("c"))
    parts = F.ceil(F.col("c") / TOGETHER)
    dealt = needles.join(counts, "id").groupBy("id", F.pmod(F.xxhash64("needle_id"), parts).alias("part")).agg(F.collect_list(F.struct("needle_id", "needle")).alias("asked"))
    schema = T.StructType([needles.schema["needle_id"], needles.schema["id"], *T.StructType.fromDDL("start int, end int, score int, fuzzy boolean").fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for i, text, asked in zip(*batch.columns, strict=True):
                text, i = folded(text.as_py()), i.as_py()
                rows.extend((n["needle_id"], i, *hit) for n in asked.as_py() if (hit := located(text, n["needle"])))
            kinds = (batch.schema.field("asked").type.value_type.field("needle_id").type, batch.schema.field("id").type, pa.int32(), pa.int32(), pa.int32(), pa.bool_())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*rows, strict=True)) or [()] * 6, kinds, strict=True)], schema.names)

    return texts.select("id", "text").join(dealt, "id").select("id", "text", "asked").mapInArrow(run, schema)
