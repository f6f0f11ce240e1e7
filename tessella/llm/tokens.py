"""Token counts of texts without their ids.

The vocabulary is examined once, before any text: which of its strings does it encode as one token by themselves? That is
proved by merging each string's bytes. In texts, a pre-token that is such a string counts one, without any work but the look
at a table; only the others are merged, the lowest rank first, of equal ranks the left one.

Tables of counts hold pre-tokens of up to LONG characters and are bounded; longer ones are merged each time, in n log n. Long
texts are taken in parts that end before a space after another character, where no pre-token lies across.

A null text counts as empty: 0 bytes, 0 tokens. Strings of special tokens within a text are those tokens, one each, as the
library takes them unless told otherwise. Rows are independent; repeated rows, ties and nulls in other columns have no
effect, and an empty table gives an empty result. Only doc_id and text are read. A file whose pre-tokens, normalizer,
added tokens or merges are of another kind is refused.
"""

from __future__ import annotations

import heapq
import json
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession

from . import common

#: Pre-tokens of byte-level vocabularies (a fixed value of the vocabulary's format).
PRE_TOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Tokens above which a document is over its limit; characters of a pre-token that is kept, and how many are; of a part.
LIMIT, LONG, KEPT, PART = 512, 64, 300_000, 1 << 20


def _characters() -> list[str]:
    """The character that stands for each byte in the file: itself if printable, else one from 256 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = iter(range(256, 512))
    return [chr(b if b in plain else next(rest)) for b in range(256)]


class Counter(dict):
    """Pre-token to its number of tokens, for a byte-level vocabulary file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            found = json.load(file)
        model, split = found["model"], found["pre_tokenizer"] or {}
        plain = model["type"] == "BPE" and not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
        if not plain or found["normalizer"] or found["post_processor"] or split.get("type") != "ByteLevel" or split.get("add_prefix_space") or not split.get("use_regex", True):
            raise ValueError(f"{path} is not a plain byte-level vocabulary")
        if any(t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"] for t in found["added_tokens"]):
            raise ValueError(f"{path} has added tokens that depend on what stands beside them")
        special = sorted((t["content"] for t in found["added_tokens"]), key=len, reverse=True)
        self.special = re.compile("|".join(map(re.escape, special))) if special else None
        character = _characters()
        self.spell = {b: c for b, c in enumerate(character)}  # for str.translate of Latin-1 text
        byte = {c: b for b, c in enumerate(character)}
        self.rank = {(a, b): k for k, (a, b) in enumerate(m if isinstance(m, list) else m.split(" ") for m in model["merges"])}
        self.split = regex.compile(PRE_TOKEN).findall
        self.breaks = regex.compile(r"(?<=\S) ").search  # with the white space of PRE_TOKEN, which is not that of re
        #: The strings that were proved to be one token by themselves, as texts; those that are no UTF-8 are in no text.
        self.whole: dict[str, int] = {}
        for token in model["vocab"]:
            if self.merge(token) == 1:
                try:
                    self.whole[bytes(byte[c] for c in token).decode()] = 1
                except UnicodeDecodeError:
                    continue
        self.update(self.whole)

    def merge(self, spelled: str) -> int:
        """The number of tokens that merging leaves of a pre-token, whose bytes are given by the file's characters."""
        parts, rank = list(spelled), self.rank
        n = len(parts)
        if n < 2:
            return n
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i) for i in range(n - 1) if (r := rank.get((parts[i], parts[i + 1]))) is not None]
        heapq.heapify(heap)
        left = n
        while heap:
            r, i = heapq.heappop(heap)
            j = after[i]
            if parts[i] is None or j >= n or rank.get((parts[i], parts[j])) != r:
                continue  # one of the two has gone into another merge
            parts[i], parts[j] = parts[i] + parts[j], None
            left -= 1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if (r := rank.get((parts[i], parts[k]))) is not None:
                    heapq.heappush(heap, (r, i))
            k = before[i]
            if k >= 0 and (r := rank.get((parts[k], parts[i]))) is not None:
                heapq.heappush(heap, (r, k))
        return left

    def __missing__(self, word: str) -> int:
        n = self.merge(word.encode().decode("latin-1").translate(self.spell))
        if len(word) <= LONG:
            if len(self) > KEPT + len(self.whole):
                self.forget()
            self[word] = n
        return n

    def forget(self) -> None:
        self.clear()
        self.update(self.whole)

    def parts(self, text: str) -> Iterator[str]:
        at = 0
        while at + PART < len(text):
            found = self.breaks(text, at + PART)
            if not found:
                break
            yield text[at : found.start()]
            at = found.start()
        yield text[at:]

    def count(self, text: str | None) -> int:
        """The number of tokens of a text."""
        if not text:
            return 0
        pieces = self.special.split(text) if self.special else [text]
        return len(pieces) - 1 + sum(sum(map(self.__getitem__, self.split(part))) for piece in pieces for part in self.parts(piece))


@lru_cache(maxsize=2)
def load(path: str) -> Counter:
    return Counter(path)


def counted(docs: DataFrame, path: str, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit (more than limit tokens)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = load(path)
        for batch in batches:
            for part in common.slices(batch, "text"):
                n = np.fromiter(map(counter.count, part.column("text").to_pylist()), np.int64, len(part))
                size = pc.fill_null(pc.binary_length(part.column("text")), 0).cast(pa.int64())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), size, pa.array(n), pa.array(n > limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])
        counter.forget()

    return docs.select("doc_id", "text").mapInArrow(run, common.with_id(docs, "n_bytes long, n_tokens long, over_limit boolean"))


def op13_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return counted(common.documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))
