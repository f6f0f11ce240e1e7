"""BPE encoding and decoding by dynamic programming over prefixes.

For every prefix of a pre-token exactly one token can come last in its encoding. An automaton over the
vocabulary lists the tokens that are suffixes of the prefix, longest first; the first one that may stand beside
the last token of what lies before it is stored. Following these back-pointers from the end gives the ids.
Two tokens may stand beside each other if, undoing their merges from the latest on, no pair across the boundary
would have merged earlier.

A null text counts as empty and has no ids. Texts of any length are encoded whole; rows are independent, so
repeated rows, ties and nulls in other columns have no effect, and an empty table gives an empty result. Only
doc_id and text are read.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from . import common

#: Pre-tokens of byte-level vocabularies (a fixed value of the vocabulary's format).
PRE_TOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Encoded chunks and pre-tokens and judged pairs that a task keeps; when full, they are forgotten and found again.
#: Beside other stages of one application, tasks keep fewer and find more again.
KEPT, SPARING = (250_000, 250_000, 1_000_000), (60_000, 60_000, 200_000)


def _byte_of() -> dict[str, int]:
    """The character that stands for each byte in vocabulary files: itself if printable, else one from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Bpe(dict):
    """A byte-level vocabulary. As a mapping: chunk (pre-tokens between
    white space) to its ids, as little-endian unsigned 32-bit integers."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            found = json.load(file)
        vocab, merges, byte = found["model"]["vocab"], found["model"]["merges"], _byte_of()
        self.special = {x["content"]: x["id"] for x in found["added_tokens"]}
        self.bytes = [b""] * (1 + max([*vocab.values(), *self.special.values()]))
        for token, i in vocab.items():
            self.bytes[i] = bytes(byte[c] for c in token)
        for token, i in self.special.items():
            self.bytes[i] = token.encode()
        self.length = [len(x) for x in self.bytes]
        self.halves, self.merged = {}, {}
        for rank, pair in enumerate(merges):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            if vocab[a + b] != 256 + rank:
                raise ValueError("the ids of this vocabulary do not follow its merges")
            self.halves[256 + rank] = (vocab[a], vocab[b])
            self.merged[vocab[a], vocab[b]] = 256 + rank
        whole = [i < 256 for i in range(256)]
        for i, (a, b) in self.halves.items():
            whole.append(whole[a] and whole[b] and self.apart(a, b, i))
        self.automaton = ahocorasick.Automaton()
        for i, fine in enumerate(whole):
            if fine:
                self.automaton.add_word(self.bytes[i].decode("latin-1"), i)
        self.automaton.make_automaton()
        self.pairs: dict[int, bool] = {}
        self.most = KEPT
        self.split = regex.compile(PRE_TOKEN).findall
        self.runs = regex.compile(r"\s*\S+|\s+").findall
        self.spaces = [c for c in map(chr, range(0x3001)) if c != " " and regex.fullmatch(r"\s", c)]
        self.words: dict[str, bytes] = {}
        self.packed = [i.to_bytes(4, "little") for i in range(len(self.bytes))]
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None

    def apart(self, x: int, y: int, before: int = 1 << 32) -> bool:
        """Whether x and y stay two tokens; before: only merges earlier than this one count."""
        while True:
            joined = self.merged.get((x, y))
            if joined is not None and joined < before:
                return False
            if max(x, y) < 256:
                return True
            if x > y:
                before, x = x, self.halves[x][1]
            else:  # of two equal merges the left one comes first
                before, y = y + 1, self.halves[y][0]

    def word(self, word: str) -> bytes:
        """Ids of one pre-token."""
        text = word if word.isascii() else word.encode().decode("latin-1")
        n = len(text)
        last, length, pairs = [-1] * (n + 1), self.length, self.pairs
        for end, token in self.automaton.iter(text):
            end += 1
            if last[end] < 0:
                begin = end - length[token]
                if begin:
                    pair = last[begin] << 32 | token
                    fine = pairs.get(pair)
                    if fine is None:
                        fine = pairs[pair] = self.apart(last[begin], token)
                    if not fine:
                        continue
                last[end] = token
        out, packed = [], self.packed
        while n:
            out.append(packed[last[n]])
            n -= length[last[n]]
        out.reverse()
        return b"".join(out)

    def __missing__(self, chunk: str) -> bytes:
        words = self.split(chunk)
        known = self.words
        out = []
        for word in words:
            ids = known.get(word)
            if ids is None:
                ids = known[word] = self.word(word)
            out.append(ids)
        ids = self[chunk] = b"".join(out)
        return ids

    def _chunks(self, text: str) -> list[str]:
        """The text cut where white space follows other characters: no pre-token lies across such a place."""
        if "  " not in text and not any(c in text and c + " " in text for c in self.spaces):
            first, *rest = text.split(" ")
            return [first, *[" " + x for x in rest]]  # no space stands after white space: each begins a chunk
        return self.runs(text)

    def encode(self, text: str | None) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        parts = self.cut.split(text) if text and self.cut else [text or ""]
        out = []
        for k, part in enumerate(parts):
            if k % 2:
                out.append(self.packed[self.special[part]])
            else:
                out.extend(map(self.__getitem__, self._chunks(part)))
        for kept, most in zip((self, self.words, self.pairs), self.most, strict=True):
            if len(kept) > most:
                kept.clear()
        return b"".join(out)

    def forget(self) -> None:
        """At the end of a task: what the worker keeps for its next one is the vocabulary and the pairs."""
        self.clear()
        self.words.clear()
        pa.default_memory_pool().release_unused()

    def decode(self, ids: bytes) -> str:
        """The text of ids, special tokens included; bytes that are no UTF-8 become U+FFFD."""
        return b"".join(map(self.bytes.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def load(path: str) -> Bpe:
    return Bpe(path)


def encode(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, ids (array of int)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        bpe.most = KEPT
        for batch in batches:
            ids = [np.frombuffer(bpe.encode(x), "<u4").astype(np.int32) for x in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])
        bpe.forget()

    return docs.select("doc_id", "text").transform(common.in_small_batches).mapInArrow(run, common.with_id(docs, "ids array<int>"))


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id, text, from what encode() returns. Null ids count as none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        for batch in batches:
            texts = [bpe.decode(np.array(x or [], "<u4").tobytes()) for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").transform(common.in_small_batches).mapInArrow(run, common.with_id(encoded, "text string"))


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids (array of int), same (whether decoding the ids gave the text back)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        bpe.most = SPARING
        for batch in batches:
            for part in common.slices(batch, "text"):
                texts = part.column("text").to_pylist()
                ids = [bpe.encode(x) for x in texts]
                ends = np.cumsum([0, *(len(x) // 4 for x in ids)])
                flat = pa.array(np.frombuffer(b"".join(ids), np.int32))
                same = [bpe.decode(i) == (x or "") for i, x in zip(ids, texts, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(np.diff(ends), pa.int64()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat), pa.array(same)], ["doc_id", "n_tokens", "ids", "same"])
        bpe.forget()

    return docs.select("doc_id", "text").transform(common.in_small_batches).mapInArrow(run, common.with_id(docs, "n_tokens long, ids array<int>, same boolean"))


def digests(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: encodes and decodes without moving the ids out of the task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        bpe.most = KEPT
        for batch in batches:
            n, ids_sha, text_sha = [], [], []
            for x in batch.column("text"):
                ids = bpe.encode(x.as_py())
                n.append(len(ids) // 4)
                ids_sha.append(hashlib.sha256(ids).hexdigest())
                text_sha.append(hashlib.sha256(bpe.decode(ids).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
        bpe.forget()

    return docs.select("doc_id", "text").transform(common.in_small_batches).mapInArrow(run, common.with_id(docs, "n_tokens long, ids_sha256 string, decoded_sha256 string"))


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(common.documents(spark, sf_dir), vocabulary())
