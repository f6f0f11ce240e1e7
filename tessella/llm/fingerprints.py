"""Document fingerprints: invertible Bloom lookup tables of hashed paragraph cells.

A text is cut into paragraphs: at line ends, within a line after words picked by their own bytes (one in EVERY), and
where there are no words between characters picked by the eight bytes before them (one in BYTES), so that an edit moves
no cut but those beside it. Every paragraph's 64-bit hash, with its count of earlier occurrences, is a key. A table has
three parts; a key is added to one cell of each: count, sum of keys, sum of check values. Two versions' tables are
subtracted and peeled: a cell that holds one key gives it up, which frees others. If cells are left over, both tables are
built anew, twice as large, with other hash functions. What peeling recovers are the digests of the paragraphs that only
one version has (`differing_from_next`); likeness is shared keys over all keys of the two.

The fingerprint is the table of CELLS cells, the first that a comparison subtracts. It gives up some eight differences;
more of them need the larger tables of the retries, which are built from the texts and not kept. So near_edited and
near_next are those of the paragraphs, not an estimate from the short fingerprint.

A null text counts as empty: no keys, an all-zero table; two empty texts have likeness 1. Order is by descending
doc_id, null last, rows alike in doc_id by hash of text; the last row's next document is the first row. An empty
table gives an empty result. Only doc_id and text are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Cells of the table that is the fingerprint; comparisons begin with as many. One word, or byte, in so many ends a paragraph.
CELLS, EVERY, BYTES = 12, 8, 256
#: Bytes of text that are worked on at a time.
BLOCK = 2 << 20

_KEY, _CHECK = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def keys(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Keys of all texts in order, and which text each belongs to."""
    raw, at = common.text_bytes(pa.array(texts, pa.large_string()))
    if not len(raw):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    space = np.flatnonzero(raw == 0x20)
    inside = space - at[np.searchsorted(at, space, side="right") - 1]
    space = space[inside >= 4]
    tail = np.zeros(len(space), np.uint64)
    for k in range(1, 5):
        tail = tail << np.uint64(8) | raw[space - k]
    cuts = [space[common.mix(tail) % np.uint64(EVERY) == 0] + 1, np.flatnonzero(raw == 0x0A) + 1, at[:-1]]
    if len(raw) > 8:
        eight = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(raw, 8)[:-1]).view("<u8").ravel()
        picked = np.flatnonzero(common.mix(eight) % np.uint64(BYTES) == 0) + 8
        picked = picked[(raw[picked] & 0xC0) != 0x80]  # between characters
        cuts.append(picked[picked - at[np.searchsorted(at, picked, side="right") - 1] >= 8])
    starts = np.unique(np.concatenate(cuts))
    starts = starts[starts < len(raw)]
    owner = np.searchsorted(at, starts, side="right") - 1
    hashes = common.piece_hashes(raw, starts, np.append(starts[1:], len(raw)))
    order = np.lexsort((hashes, owner))
    h, o = hashes[order], owner[order]
    fresh = np.ones(len(h), bool)
    fresh[1:] = (h[1:] != h[:-1]) | (o[1:] != o[:-1])
    first = np.flatnonzero(fresh)
    times = np.arange(len(h)) - np.repeat(first, np.diff(np.append(first, len(h))))
    return common.mix(h + times.astype(np.uint64) * _KEY), o


class Tables:
    """As many tables of `cells` cells as there are owners."""

    def __init__(self, n: int, cells: int, turn: int = 0):
        self.n, self.cells, self.part = n, cells, np.uint64(cells // 3)
        self.turn = turn
        self.count = np.zeros(n * cells, np.int64)
        self.keys = np.zeros(n * cells, np.uint64)
        self.checks = np.zeros(n * cells, np.uint64)

    def add(self, key: np.ndarray, owner: np.ndarray, sign: np.ndarray | int) -> None:
        """sign: 1 adds, -1 takes away."""
        sign = np.broadcast_to(np.asarray(sign, np.int64), key.shape)
        signed = sign.astype(np.uint64)
        check = common.mix(key ^ _CHECK)
        for j in range(3):
            shift = np.uint64((3 * self.turn + j + 1) * int(_KEY) & 0xFFFFFFFFFFFFFFFF)
            slot = common.mix(key + shift) % self.part
            cell = owner * self.cells + j * int(self.part) + slot.astype(np.int64)
            np.add.at(self.count, cell, sign)
            np.add.at(self.keys, cell, key * signed)
            np.add.at(self.checks, cell, check * signed)

    def peel(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(keys, owners, signs) of what can be recovered; the tables are left with the rest."""
        found: list[tuple] = []
        look = np.flatnonzero(np.abs(self.count) == 1)
        while len(look):
            sign = self.count[look]
            key = self.keys[look] * sign.astype(np.uint64)
            pure = (np.abs(sign) == 1) & (self.checks[look] * sign.astype(np.uint64) == common.mix(key ^ _CHECK))
            key, owner, sign = key[pure], look[pure] // self.cells, sign[pure]
            if not len(key):
                break
            order = np.lexsort((key, owner))
            key, owner, sign = key[order], owner[order], sign[order]
            once = np.ones(len(key), bool)
            once[1:] = (key[1:] != key[:-1]) | (owner[1:] != owner[:-1])
            key, owner, sign = key[once], owner[once], sign[once]
            self.add(key, owner, -sign)
            found.append((key, owner, sign))
            look = np.flatnonzero(np.abs(self.count) == 1)
        if not found:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        return tuple(np.concatenate(x) for x in zip(*found, strict=True))

    def left(self) -> np.ndarray:
        """Which tables still hold something."""
        return ((self.count != 0) | (self.keys != 0)).reshape(self.n, self.cells).any(axis=1)

    def text(self) -> list[str]:
        """Each table as hexadecimal: count (32 bits), key sum (64), check sum (32) of every cell."""
        cell = np.dtype([("count", ">i4"), ("keys", ">u8"), ("checks", ">u4")])
        out = np.zeros(self.n * self.cells, cell)
        out["count"], out["keys"], out["checks"] = self.count, self.keys, self.checks & np.uint64(0xFFFFFFFF)
        return [row.tobytes().hex() for row in out.reshape(self.n, self.cells)]


def fingerprints(key: np.ndarray, owner: np.ndarray, n: int) -> list[str]:
    tables = Tables(n, CELLS)
    tables.add(key, owner, 1)
    return tables.text()


def recovered(a: tuple, b: tuple, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(keys, pairs, signs): for each of n pairs the keys that only the first (sign 1) or only the second (-1) has. a, b: (keys,
    owners), by owner."""
    size_a, size_b = np.bincount(a[1], minlength=n), np.bincount(b[1], minlength=n)
    cells = np.full(n, CELLS)
    short = cells < 2 * np.abs(size_a - size_b)  # at least so many keys differ
    while short.any():
        cells[short] *= 2
        short = cells < 2 * np.abs(size_a - size_b)
    waiting, found = np.ones(n, bool), []
    for turn in range(48):
        size = CELLS << turn
        now = np.flatnonzero(waiting & (cells <= size))
        if not len(now):
            if not waiting.any():
                break
            continue
        place = np.full(n, -1)
        place[now] = np.arange(len(now))
        tables = Tables(len(now), size, turn)
        for (key, owner), sign in ((a, 1), (b, -1)):
            mine = place[owner] >= 0
            tables.add(key[mine], place[owner[mine]], sign)
        key, owner, sign = tables.peel()
        fine = ~tables.left()
        whole = fine[owner]
        found.append((key[whole], now[owner[whole]], sign[whole]))
        waiting[now[fine]] = False
    if waiting.any():
        raise RuntimeError("a difference could not be recovered")
    if not found:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def differences(a: tuple, b: tuple, n: int) -> tuple[np.ndarray, np.ndarray]:
    """For each of n pairs how many keys only the first and only the second have."""
    _, pair, sign = recovered(a, b, n)
    return np.bincount(pair[sign > 0], minlength=n), np.bincount(pair[sign < 0], minlength=n)


def likeness(a: tuple, b: tuple, n: int) -> np.ndarray:
    only_a, _ = differences(a, b, n)
    size_a, size_b = np.bincount(a[1], minlength=n), np.bincount(b[1], minlength=n)
    shared = size_a - only_a
    return np.where(size_a + size_b > 0, shared / np.maximum(1, size_a + size_b - shared), 1.0)


def edited(text: str, following: str) -> str:
    """The last third of the text replaced by the beginning of the next document."""
    k = len(text) // 3
    return text[: len(text) - k] + following[:k]


def _differing(ids: list, texts: list[str]) -> pa.RecordBatch:
    """As _compare; a row for each digest that one of a text and its next one lacks."""
    key, owner = keys(texts)
    n = len(ids)
    found, pair, sign = recovered((key[owner < n], owner[owner < n]), (key[owner > 0], owner[owner > 0] - 1), n)
    sides = pa.array(np.where(sign > 0, "own", "next").tolist(), pa.string())
    return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()).take(pa.array(pair)), pa.array(found.view(np.int64)), sides], ["doc_id", "digest", "side"])


def _compare(ids: list, texts: list[str]) -> pa.RecordBatch:
    """texts: one more than ids, the last one's next."""
    n = len(ids)
    new = [edited(x, y) for x, y in zip(texts, texts[1:], strict=False)]
    key, owner = keys(texts)
    own, following = (key[owner < n], owner[owner < n]), (key[owner > 0], owner[owner > 0] - 1)
    changed = keys(new)
    return pa.RecordBatch.from_arrays(
        [
            pa.array(ids, pa.int64()),
            pa.array([len(x) for x in texts[:n]], pa.int64()),
            pa.array([hashlib.sha256(x.encode()).hexdigest() for x in new], pa.string()),
            pa.array(fingerprints(*own, n), pa.string()),
            pa.array(fingerprints(*changed, n), pa.string()),
            pa.array(likeness(own, changed, n), pa.float64()),
            pa.array(likeness(own, following, n), pa.float64()),
        ],
        ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
    )


def _stream(compare: Callable[[list, list[str]], pa.RecordBatch]):
    """Rows in order, in blocks for compare; the first that belongs to another partition is only the last one's next."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list = []
        texts: list[str] = []
        held, over = 0, False
        for batch in batches:
            for doc_id, text, beyond in zip(batch.column("doc_id"), batch.column("text"), batch.column("beyond").to_pylist(), strict=True):
                if over:
                    continue
                texts.append(text.as_py() or "")
                held += len(texts[-1])
                over = beyond
                if not beyond:
                    ids.append(doc_id.as_py())
                if held > BLOCK and len(texts) > 1 or over:
                    if len(texts) > 1:
                        yield compare(ids[: len(texts) - 1], texts)
                    ids, texts = ids[len(texts) - 1 :], texts[-1:]
                    held = len(texts[0])
        if ids and not over:
            raise RuntimeError("a partition lacks its next row")

    return run


def in_order(docs: DataFrame, parts: int | None = None) -> DataFrame:
    """Rows dealt out by ranges of descending doc_id and sorted; each partition also gets the first row of the next
    one (the last partition that of the first), marked `beyond`. One shuffle."""
    parts = parts or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    docs = docs.select(F.col("doc_id").cast("long"), "text")
    found = docs.agg(F.percentile_approx("doc_id", [i / parts for i in range(1, parts)] or [0.5], 100_000), F.max("doc_id")).first()
    top = found[1]
    bounds = sorted({x for x in found[0] or []}, reverse=True)
    limits = F.array(*map(F.lit, bounds)) if bounds else F.array().cast("array<bigint>")
    place = F.when(F.col("doc_id").isNull(), len(bounds)).otherwise(F.size(F.filter(limits, lambda b: F.col("doc_id") <= b)))
    to = lambda p, beyond: F.struct(F.lit(p).cast("int").alias("p") if isinstance(p, int) else p.cast("int").alias("p"), F.lit(beyond).alias("beyond"))
    none = F.array().cast("array<struct<p:int,beyond:boolean>>")
    begins = F.when(F.array_contains(limits, F.col("doc_id")), F.array(to(place - 1, True))).otherwise(none)
    first = F.col("doc_id") == top if top is not None else F.lit(True)
    wraps = F.when(first, F.array(to(len(bounds), True))).otherwise(none)
    copies = F.concat(F.array(to(place, False)), F.coalesce(begins, none), F.coalesce(wraps, none))
    dealt = docs.select("doc_id", "text", F.explode(copies).alias("at")).select("doc_id", "text", "at.p", "at.beyond")
    return dealt.repartitionById(len(bounds) + 1, F.col("p")).sortWithinPartitions("beyond", F.col("doc_id").desc_nulls_last(), F.xxhash64("text"), "text")


def compare_with_next(docs: DataFrame) -> DataFrame:
    """Every document against its edited text and the next document."""
    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return in_order(docs).select("doc_id", "text", "beyond").transform(common.in_small_batches).mapInArrow(_stream(_compare), schema)


def differing_from_next(docs: DataFrame) -> DataFrame:
    """(doc_id, digest, side): the paragraph digests that only a document (`own`) or only its next one (`next`) has."""
    rows = in_order(docs).select("doc_id", "text", "beyond").transform(common.in_small_batches)
    return rows.mapInArrow(_stream(_differing), "doc_id long, digest long, side string")


def op4_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare_with_next(common.documents(spark, sf_dir))
