"""Secret scan with linking of multipart credentials.

One pass over each whole text finds the parts: assignments, access identifiers and hexadecimal runs (the base
kinds, always reported) and two weak kinds: `blob`, a run of 30 or more base-64 characters with capitals, small
letters and digits and an entropy of at least BITS a character, and `endpoint`, the host of a URL or a dotted host name
with a port. Every pattern takes time in proportion to the text. A weak part is reported
only if a complementary part lies in its scope: a blob near an access identifier or an endpoint, an endpoint near
an access identifier, assignment, hexadecimal run or blob. The scope is `gap` characters between the two within
one document. The interval join deals parts out by document and scope-wide cell, so no pairs of far parts arise.

Spans are code points, the end exclusive. A null text counts as empty and has no spans; rows that repeat a doc_id
are each scanned on their own; an empty table gives an empty result. Only doc_id and text are read.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Base kinds in their order: pattern, the group that is measured and its least length.
BASE = {
    "assign": (re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), 2, 12),
    "access": (re.compile(r"AKIA[A-Z0-9]+"), 0, 18),
    "hex": (re.compile(r"[0-9a-f]+"), 0, 16),
}
#: What is tried in place of the last pattern: the same matches from 16 characters on, found faster.
_HEX = re.compile(r"[0-9a-f]{16,}")
#: Weak kinds.
WEAK = {
    "blob": re.compile(r"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z0-9+/_-]*[A-Z])(?=[A-Za-z0-9+/_-]*[a-z])(?=[A-Za-z0-9+/_-]*[0-9])[A-Za-z0-9+/_-]{30,}={0,2}"),
    # a run that ends in a port; only its last host name, if dotted, is the endpoint
    "endpoint": re.compile(r"https?://[A-Za-z0-9.-]++(?::[0-9]+)?|(?<![A-Za-z0-9.-])([A-Za-z0-9.-]++):[0-9]{2,5}\b"),
}
#: Kinds that complete a weak one.
COMPLETES = {"blob": ("access", "endpoint"), "endpoint": ("access", "assign", "hex", "blob")}
#: Characters between two parts of one credential at most; bits a character that a blob has at least.
GAP, BITS = 200, 3.5

_DIGIT = re.compile(r"[0-9+/_-]")
_LONG = re.compile(r"[A-Za-z0-9+/_-]{30,}")
_KIND = {k: i for i, k in enumerate([*BASE, *WEAK])}
PARTS = "array<struct<kind:string,start:int,end:int>>"


def entropy(run: str) -> float:
    """Bits a character."""
    counts = Counter(run).values()
    return -sum(n / len(run) * math.log2(n / len(run)) for n in counts)


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Base matches by start, then kind."""
    out = []
    pattern, group, least = BASE["assign"]
    if "=" in text or ":" in text:
        out += [("assign", *m.span()) for m in pattern.finditer(text) if len(m[group]) >= least]
    if "AKIA" in text:
        out += [("access", *m.span()) for m in BASE["access"][0].finditer(text) if m.end() - m.start() >= 18]
    out += [("hex", *m.span()) for m in _HEX.finditer(text)]
    return sorted(out, key=lambda s: (s[1], _KIND[s[0]]))


def weak_spans(text: str) -> list[tuple[str, int, int]]:
    out = []
    if _LONG.search(text):
        out += [("blob", *m.span()) for m in WEAK["blob"].finditer(text) if entropy(m[0]) >= BITS]
    if "://" in text or ":" in text:
        for m in WEAK["endpoint"].finditer(text):
            run = m[1]
            if run is None:
                out.append(("endpoint", *m.span()))
                continue
            host = run[run.rfind("..") + 1 :].lstrip(".-")
            if "." in host and host[-1] not in ".-":
                out.append(("endpoint", m.end(1) - len(host), m.end()))
    return out


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    spans = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
    for batch in batches:
        base, weak, keys = [], [], []
        for text in batch.column("text"):
            text = text.as_py() or ""
            base.append([{"kind": k, "start": s, "end": e} for k, s, e in base_spans(text)])
            weak.append([{"kind": k, "start": s, "end": e} for k, s, e in weak_spans(text)])
            keys.append(hashlib.sha256(text.encode()).digest()[:16] if weak[-1] else None)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(keys, pa.binary()), pa.array(base, spans), pa.array(weak, spans)], ["doc_id", "text_key", "base", "weak"])


def parts(docs: DataFrame) -> DataFrame:
    """doc_id, text_key (of the text, where it has weak parts), base and weak (arrays of kind, start, end)."""
    return docs.select("doc_id", "text").transform(common.in_small_batches).mapInArrow(_scan, common.with_id(docs, f"text_key binary, base {PARTS}, weak {PARTS}"))


def linked(found: DataFrame, gap: int = GAP) -> DataFrame:
    """text_key, added: the weak parts that have a complementary part within the gap. found: as of parts(); texts
    that occur again are linked once."""
    each = found.where("text_key IS NOT NULL").groupBy("text_key").agg(F.first("base").alias("base"), F.first("weak").alias("weak"))
    each = each.select("text_key", F.explode(F.concat("base", "weak")).alias("p")).select("text_key", "p.*")
    cell = lambda c: F.floor(F.col(c) / gap).cast("int")
    pairs = [(k, o) for k, others in COMPLETES.items() for o in others]
    # a weak part asks in every cell that it or its margin touches; a complementary one stands in each that it touches
    ask = each.where(F.col("kind").isin(*WEAK)).withColumn("cell", F.explode(F.sequence(cell("start") - 1, cell("end") + 1)))
    stand = each.select("text_key", F.col("kind").alias("other"), F.col("start").alias("s"), F.col("end").alias("e")).withColumn("cell", F.explode(F.sequence(cell("s"), cell("e"))))
    fit = F.lit(False)
    for k, o in pairs:
        fit = fit | ((F.col("kind") == k) & (F.col("other") == o))
    near = (F.col("s") < F.col("end") + gap) & (F.col("e") > F.col("start") - gap)
    apart = (F.col("s") >= F.col("end")) | (F.col("e") <= F.col("start"))
    stand = stand.withColumnsRenamed({"text_key": "k", "cell": "c"})
    hit = ask.join(stand, (F.col("text_key") == F.col("k")) & (F.col("cell") == F.col("c")) & fit & near & apart, "left_semi")
    return hit.groupBy("text_key").agg(F.array_sort(F.collect_set(F.struct("kind", "start", "end"))).alias("added"))


def scan(docs: DataFrame, gap: int = GAP) -> DataFrame:
    """doc_id, base, added, spans (all, by start, then kind): one row per row of docs."""
    found = common.written(parts(docs), "parts")
    links = linked(found, gap).withColumnRenamed("text_key", "k")
    out = found.join(links, F.col("text_key") == F.col("k"), "left")
    added = F.coalesce("added", F.array().cast(PARTS))
    order = F.create_map(*[F.lit(x) for k, i in _KIND.items() for x in (k, i)])
    keyed = F.transform(F.concat("base", added), lambda p: F.struct(p["start"].alias("start"), order[p["kind"]].alias("o"), p["end"].alias("end"), p["kind"].alias("kind")))
    spans = F.transform(F.array_sort(keyed), lambda p: F.struct(p["kind"].alias("kind"), p["start"].alias("start"), p["end"].alias("end")))
    return out.select("doc_id", "base", added.alias("added"), spans.alias("spans"))


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(common.documents(spark, sf_dir))
    said = lambda c: F.array_join(F.transform(c, lambda p: F.concat_ws(":", p["kind"], p["start"].cast("string"), p["end"].cast("string"))), ",")
    count = lambda kind: F.size(F.filter("base", lambda p: p["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *map(count, BASE), F.sha2(said("base"), 256).alias("base_sha256"), said("spans").alias("spans"))
