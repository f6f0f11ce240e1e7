"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Words are runs of anything but these six bytes: space, tab, line feed, vertical tab, form feed, return.
WORD = r"[^\x20\x09-\x0D]+"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def with_id(df: DataFrame, columns: str, key: str = "doc_id") -> T.StructType:
    """The schema of df's key, of whatever type, and of further columns."""
    return T.StructType([df.schema[key], *T.StructType.fromDDL(columns).fields])


def fresh(df: DataFrame, name: str) -> str:
    """The name, with underscores after it until df has no such column."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which driver and executors share. Only where it is unset and the master is
    local, as in tests, a temporary folder is made and set; a cluster without that setting is an error."""
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
    return f"{shared_dir(spark)}/tessella/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder: cuts the lineage, outlives executors, is computed once."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def in_small_batches(df: DataFrame, rows: int = 1000) -> DataFrame:
    """df, with Arrow batches of at most so many rows in its session: what is in flight between Spark and Python then is
    a few MB of text a task. Results do not depend on it; a smaller bound that the session has already stays."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(df.sparkSession.conf.get(name))
    if now <= 0 or now > rows:
        df.sparkSession.conf.set(name, str(rows))
    return df


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts, end to end, and where each begins (one more entry for the end). Null: empty."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def slices(batch: pa.RecordBatch, column: str, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The batch in parts whose texts hold about so many bytes: what a task needs then depends on its longest text alone."""
    size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(size, dtype=np.int64)
    lo = 0
    while lo < len(batch):
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + most)))
        yield batch.slice(lo, hi - lo)
        lo = hi


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finalizer (multiply and xor-shift)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BASE = np.uint64(0x9E3779B97F4A7C15)
_STEP = 1 << 21


def piece_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = False) -> np.ndarray:
    """64-bit hashes of raw[start:end] for ascending pieces that are not empty; lower: as if A-Z were small.

    Works through the bytes in blocks that end between pieces, so memory stays in proportion to the input."""
    out = np.empty(len(starts), np.uint64)
    i = 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + _STEP)))
        lo, hi = int(starts[i]), int(ends[j - 1])
        piece = _LOWER[raw[lo:hi]] if lower else raw[lo:hi]
        length = ends[i:j] - starts[i:j]
        powers = np.empty(int(length.max()), np.uint64)
        powers[0] = 1
        powers[1:] = _BASE
        np.multiply.accumulate(powers, out=powers)
        first = np.cumsum(length) - length
        within = np.arange(int(length.sum())) - np.repeat(first, length)
        values = piece[within + np.repeat(starts[i:j] - lo, length)].astype(np.uint64) + np.uint64(1)
        sums = np.add.reduceat(values * powers[within], first)
        out[i:j] = mix(sums + length.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
        i = j
    return out


def word_hashes(raw: np.ndarray, at: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of all texts in order, and the number of words before each text."""
    if not len(raw):
        return np.zeros(0, np.uint64), np.zeros(len(at), np.int64)
    solid = ~_SPACE[raw]
    before = np.empty(len(raw), bool)
    before[0] = False
    before[1:] = solid[:-1]
    inner = at[1:-1][at[1:-1] < len(raw)]
    before[inner] = False  # a text's first byte begins a word
    starts = np.flatnonzero(solid & ~before)
    after = np.empty(len(raw), bool)
    after[-1] = False
    after[:-1] = solid[1:]
    last = at[1:-1] - 1
    after[last[last >= 0]] = False
    ends = np.flatnonzero(solid & ~after) + 1
    return piece_hashes(raw, starts, ends, lower), np.searchsorted(starts, at)


def shingle_sets(column: pa.Array, width: int) -> list[np.ndarray]:
    """For each text its distinct hashed shingles of `width` words, ascending (as signed 64-bit integers).

    With fewer words the whole sequence is one shingle; a text without words, or null, has none."""
    raw, at = text_bytes(column)
    words, first = word_hashes(raw, at)
    count = max(0, len(words) - width + 1)
    rolled = np.zeros(count, np.uint64)
    for k in range(width):
        rolled = mix(rolled * np.uint64(3) + words[k : k + count] + np.uint64(k))
    rolled = rolled.view(np.int64)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= width:
            s = np.sort(rolled[a : b - width + 1])
            out.append(s[np.concatenate(([True], s[1:] != s[:-1]))])
        elif b > a:
            short = np.array([b - a + 0x5BF03635], np.uint64)
            for k in range(a, b):
                short = mix(short * np.uint64(5) + words[k : k + 1])
            out.append(short.view(np.int64))
        else:
            out.append(np.zeros(0, np.int64))
    return out


#: Bytes of a table that may be sent to all executors, and rows of one key that may meet in one task.
SENT, DEALT = 32 << 20, 10_000


def small(df: DataFrame, most: int = SENT) -> bool:
    """Whether df holds at most so many bytes: the check before any broadcast. Strings and arrays are measured, other
    values count as 16 bytes, and a row as 16 more."""
    sizes = F.lit(16)
    for f in df.schema.fields:
        if isinstance(f.dataType, T.StringType | T.BinaryType):
            one = F.octet_length(F.col(f"`{f.name}`")) + 16
        elif isinstance(f.dataType, T.ArrayType):
            one = F.size(F.col(f"`{f.name}`")) * 16 + 16
        else:
            one = F.lit(16)
        sizes = sizes + F.coalesce(one, F.lit(16))
    return (df.agg(F.sum(sizes.cast("long"))).first()[0] or 0) <= most


def sent(df: DataFrame) -> DataFrame:
    """df, marked to be sent to all executors if it is small."""
    return F.broadcast(df) if small(df) else df


def join_groups(rows: DataFrame, side: DataFrame, keys: list[str], how: str = "inner", sizes: DataFrame | None = None, spread: str = "id") -> DataFrame:
    """rows joined with side on keys of which a few may hold most rows. A small side is sent to all executors. Beyond
    that the rows of a key with more than DEALT of them are dealt out by the column `spread`, and what side has for that
    key goes to each part. sizes: (keys, c), the rows of each key, if they are known already; the keys that are dealt
    out are at most one in DEALT rows, so their table is small by its making."""
    if small(side):
        return rows.join(F.broadcast(side), keys, how)
    if sizes is None:
        sizes = rows.groupBy(*keys).agg(F.count("*").alias("c"))
    hot = sent(sizes.where(F.col("c") > DEALT).select(*keys, F.ceil(F.col("c") / DEALT).cast("int").alias("_parts")))
    parts = F.coalesce("_parts", F.lit(1))
    dealt = rows.join(hot, keys, "left").withColumn("_part", F.pmod(F.xxhash64(spread), parts).cast("int")).drop("_parts")
    each = side.join(hot, keys, "left").withColumn("_part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("_parts")
    return dealt.join(each, [*keys, "_part"], how).drop("_part")


#: Bits of a filter of ids: so many for each id, a power of two, and 32 MB at most whatever the number of ids.
BITS, MOST_BITS = 64, 1 << 28


def place(column: str, words: int) -> Column:
    """Where the filter of so many words holds an id."""
    return F.pmod(F.xxhash64(F.col(column).cast("long")), F.lit(64 * words))


def id_filter(ids: DataFrame, column: str) -> np.ndarray:
    """A filter for the ids in a column (whole numbers) as words of 64 bits. An id that is there has its bit set; of the others
    few have. Its size is bounded: with very many ids it lets more through, so it may spare work, never decide. A word is
    put together where its ids meet; the driver sees words."""
    ids = ids.select(column).distinct()
    bits = min(MOST_BITS, max(1 << 13, 1 << (BITS * max(1, ids.count()) - 1).bit_length()))
    held = ids.select(place(column, bits // 64).alias("h")).groupBy(F.shiftright("h", 6).alias("at")).agg(F.bit_or(F.expr("shiftleft(1L, cast(h & 63 as int))")).alias("word")).toArrow()
    words = np.zeros(bits // 64, np.int64)
    words[held["at"].to_numpy()] = held["word"].to_numpy()
    return words


def semi(df: DataFrame, keys: DataFrame, on: str) -> DataFrame:
    """Rows of df whose `on` is among keys; keys are sent to all executors if they are small, else shuffled."""
    return df.join(sent(keys.select(on).distinct()), on, "left_semi")
