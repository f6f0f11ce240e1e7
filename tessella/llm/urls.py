"""URL filter: a bit-parallel automaton for glob rules.

All globs are packed, one bit a position, into the words of one Shift-And mask: for every byte a mask of the
positions that it matches (and of the stars that it keeps open). One pass over a canonical URL, byte by byte,
moves all patterns at once; the URLs of a batch move together, a row of mask words each.

Canonical form: "." + host + NUL + path, so that `*` before a host rule cannot run into the path. In a glob `?`
is any byte but NUL, `*` any number of those, `**` any number of any bytes.

A null URL, or one without `://`, has an empty host and path; no rule fits it. Rows are independent: ties,
repeated rows, nulls in other columns have no effect; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import text_bytes, with_id


class Rule(NamedTuple):
    """Fits a host with its subdomains and all paths that start with `path`."""

    verdict: str
    host: str
    path: str

    @property
    def glob(self) -> str:
        return f"*.{self.host}\0{self.path}**"


RULES = [
    Rule("allow", "org", "/"),
    Rule("block", "example.org", "/es/"),
    Rule("block", "example.org", "/en/1"),
    Rule("allow", "com", "/fr/"),
    Rule("block", "com", "/de/"),
]
#: What is blocked where no rule fits: host names that tell of spam, adult or gambling pages.
BLOCKED = ["*spam*\0**", "*adult*\0**", "*casino*\0**", "*porn*\0**"]


class Globs:
    """Compiled patterns; match() tells for each text which of them match it as a whole."""

    def __init__(self, globs: list[str]):
        parts = [self._parse(g) for g in globs]
        size = sum(len(p) + 1 for p in parts)
        self.words = -(-size // 64)
        step, loop = np.zeros((256, self.words), np.uint64), np.zeros((256, self.words), np.uint64)
        self.begin, self.end = np.zeros(self.words, np.uint64), []
        at = 0
        for tokens in parts:
            # position k stands before token k; a star is no position of its own but keeps its position open
            k = at
            self._set(self.begin, k)
            for kind, byte in tokens:
                if kind == "star":
                    self._set(loop[1:], k)
                elif kind == "all":
                    self._set(loop, k)
                elif kind == "any":
                    self._set(step[1:], k + 1)
                    k += 1
                else:
                    self._set(step[byte], k + 1)
                    k += 1
            self.end.append(k)
            at = k + 1
        self.step, self.loop = step, loop

    @staticmethod
    def _set(mask: np.ndarray, k: int) -> None:
        mask[..., k // 64] |= np.uint64(1) << np.uint64(k % 64)

    @staticmethod
    def _parse(glob: str) -> list[tuple[str, int]]:
        out, data, i = [], glob.encode(), 0
        while i < len(data):
            if data[i : i + 2] == b"**":
                out.append(("all", 0))
                i += 1
            elif data[i] == 0x2A:
                out.append(("star", 0))
            elif data[i] == 0x3F:
                out.append(("any", 0))
            else:
                out.append(("byte", data[i]))
            i += 1
        return out

    def match(self, texts: pa.Array) -> np.ndarray:
        """A row for each text, a column for each pattern."""
        raw, at = text_bytes(texts)
        n = len(texts)
        length = np.diff(at)
        order = np.argsort(-length, kind="stable")
        at, length = at[:-1][order], length[order]
        state = np.tile(self.begin, (n, 1))
        one, top = np.uint64(1), np.uint64(63)
        for k in range(int(length.max(initial=0))):
            live = int(np.searchsorted(-length, -k))  # the texts of more than k bytes come first
            byte = raw[at[:live] + k]
            now = state[:live]
            moved = now << one
            moved[:, 1:] |= now[:, :-1] >> top
            state[:live] = moved & self.step[byte] | now & self.loop[byte]
        out = np.empty((n, len(self.end)), bool)
        for p, k in enumerate(self.end):
            out[order, p] = (state[:, k // 64] >> np.uint64(k % 64) & one).astype(bool)
        return out


def parts(url) -> tuple:
    """host and path columns. Host: after the first `://`, A-Z in lower case; path: up to `?` or `#`."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substr(rest, F.length(host) + 1), r"^[^?#]*", 0)
    lower = F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.coalesce(lower, F.lit("")), F.coalesce(path, F.lit(""))


def judge(pages: DataFrame, rules: list[Rule] = RULES, blocked: list[str] = BLOCKED) -> DataFrame:
    """page_id, host, path, rule (host and path of the longest rule that fits, the first of equals; else null), verdict."""
    ranked = sorted(rules, key=lambda r: -len((r.host + r.path).encode()))
    globs = [r.glob for r in ranked] + blocked
    names = np.array([r.host + r.path for r in ranked] + [None], object)
    verdicts = np.array([r.verdict for r in ranked] + ["allow", "block"], object)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compiled = Globs(globs)
        for batch in batches:
            hit = compiled.match(batch.column("canonical"))
            fits = np.column_stack([hit[:, : len(ranked)], np.ones(len(hit), bool)])
            first = fits.argmax(axis=1)
            bad = hit[:, len(ranked) :].any(axis=1)
            verdict = verdicts[np.where(first < len(ranked), first, len(ranked) + bad)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(names[first], pa.string()), pa.array(verdict, pa.string())], ["page_id", "host", "path", "rule", "verdict"])

    host, path = parts(F.col("url"))
    # a NUL within an URL would look like the separator
    clean = lambda c: F.translate(c, "\0", "\1")
    given = pages.select("page_id", host.alias("host"), path.alias("path"))
    given = given.withColumn("canonical", F.concat(F.lit("."), clean("host"), F.lit("\0"), clean("path")))
    return given.mapInArrow(run, with_id(pages, "host string, path string, rule string, verdict string", "page_id"))


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url"))


def _sql() -> str:
    fits = lambda r: f"('.' || host) LIKE '%.{r.host}' AND starts_with(path, '{r.path}')"
    ranked = sorted(RULES, key=lambda r: -len(r.host + r.path))
    rule = " ".join(f"WHEN {fits(r)} THEN '{r.host}{r.path}'" for r in ranked)
    verdict = " ".join(f"WHEN rule = '{r.host}{r.path}' THEN '{r.verdict}'" for r in ranked)
    bad = " OR ".join(f"contains(host, '{g.strip('*').split(chr(0))[0].strip('*')}')" for g in BLOCKED)
    return f"""
WITH cut AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
split AS (SELECT page_id, regexp_extract(rest, '^[^/?#]*') AS raw, rest FROM cut),
parts AS (
  SELECT page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path
  FROM split),
ruled AS (SELECT *, CASE {rule} END AS rule FROM parts)
SELECT page_id, host, path, rule, CASE {verdict} WHEN {bad} THEN 'block' ELSE 'allow' END AS verdict FROM ruled"""


SQL = _sql()
