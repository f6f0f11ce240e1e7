"""Interleaved documents with media columns.

HTML is parsed into an ordered sequence of text and media-reference structs (pos, kind, text, ref, caption). Media
payloads are stored once written as 8-bit grey images (binary PGM, 64 samples a row), addressed by the SHA-256 of
the stored form. A digest join resolves references to payloads; positions and captions come along unchanged. What is
needed of a payload is computed where it is read, so the join moves digests and features, never payload bytes.

A null text counts as empty and is stored as 64 zero bytes. A reference without a stored payload stays in the
sequence with null features. Equal texts share one payload; rows that repeat a doc_id are documents of their own.
An empty table gives an empty result. Only doc_id and text (or an id and html) are read.
"""

from __future__ import annotations

import hashlib
import html
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Payloads are padded to a multiple of this, the width of the stored image.
ROW = 64
SEQUENCE = "array<struct<pos:int,kind:string,text:string,ref:string,caption:string,bytes:bigint>>"
_ARROW = pa.list_(pa.struct([("pos", pa.int32()), ("kind", pa.string()), ("text", pa.string()), ("ref", pa.string()), ("caption", pa.string()), ("bytes", pa.int64())]))

_SKIPPED = re.compile(r"<(script|style)\b", re.I)
_NAME = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9-]*+)")
#: Up to the end of a tag; quotes protect `>`.
_REST = re.compile(r"(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>")
_ATTRIBUTE = re.compile(r"(?<![a-zA-Z-])([a-zA-Z-]++)\s*+=\s*+(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")
#: Character references whose numbers are no code points, however long.
_NO_CHARACTER = re.compile(r"&#(?:0*[1-9][0-9]{7,}+|[xX]0*[1-9a-fA-F][0-9a-fA-F]{6,}+);?")
#: Elements whose text runs on in the same part.
_INLINE = frozenset("a abbr b bdi bdo cite code data dfn em i kbd mark q s samp small span strong sub sup time u var wbr".split())
_SMALL = {i: i + 32 for i in range(65, 91)}
_MEDIA = {"img": "src", "video": "src", "audio": "src", "source": "src", "embed": "src"}


def unescaped(text: str) -> str:
    return html.unescape(_NO_CHARACTER.sub("\ufffd", text) if "&#" in text else text)


def tags(page: str) -> Iterator[tuple[int, int, bool, str, str]]:
    """(begin, end, whether it closes, name, attributes) of comments, declarations, scripts (no name) and tags.

    Time is in proportion to the page: from the first tag on whose quote, or which itself, is never closed, quotes no
    longer protect `>`."""
    at, strict, lower = 0, True, None
    while (at := page.find("<", at)) >= 0:
        if page.startswith("<!--", at):
            end = page.find("-->", at + 4)
            end = len(page) if end < 0 else end + 3
            yield at, end, False, "", ""
        elif page.startswith("<!", at) and page[at + 2 : at + 3].isalnum():
            end = page.find(">", at) + 1
            if not end:
                return
            yield at, end, False, "", ""
        elif skipped := _SKIPPED.match(page, at):
            lower = lower or page.translate(_SMALL)
            end = lower.find(f"</{skipped[1].translate(_SMALL)}", at)
            end = lower.find(">", end) + 1 if end >= 0 else 0
            end = end or len(page)
            yield at, end, False, "", ""
        elif name := _NAME.match(page, at):
            rest = _REST.match(page, name.end()) if strict else None
            strict = rest is not None
            end = rest.end() if rest else page.find(">", name.end()) + 1
            if not end:
                return
            yield at, end, bool(name[1]), name[2].lower(), page[name.end() : end - 1]
        else:
            end = at + 1
        at = end


def parse(page: str | None) -> list[dict]:
    """The sequence of a page: runs of text between block elements, and media with the caption of their figure.

    A caption ends at </figcaption>, where the next begins, with its figure and with the page; a figure ends at </figure>,
    where the next begins and with the page. All captions of a figure, in lines, belong to all its media, whichever comes
    first; without media, or outside a figure, they stay in the sequence as text. So no text is lost."""
    out: list[dict] = []
    buffer: list[str] = []
    figure: list[dict] | None = None
    captions: list[dict] = []
    inside = False

    def flush(kind: str = "text") -> None:
        text = unescaped("".join(buffer)).strip(" \t\r\n\f")
        buffer.clear()
        if text:
            out.append({"kind": kind, "text": text, "ref": None, "caption": None, "bytes": None})
            if kind == "caption":
                captions.append(out[-1])

    def end_text() -> None:
        nonlocal inside
        flush("caption" if inside and figure is not None else "text")
        inside = False

    def end_figure() -> None:
        nonlocal figure
        said = "\n".join(c["text"] for c in captions)
        for part in figure or [] if captions else []:
            part["caption"] = said
        for c in captions:
            c["kind"] = None if figure else "text"
        captions.clear()
        figure = None

    page, at = page or "", 0
    for begin, end, closes, name, attributes in tags(page):
        buffer.append(page[at:begin])
        at = end
        if not name or name in _INLINE:
            continue
        if name in ("figure", "figcaption") or not inside:
            end_text()
        if name == "figure":
            end_figure()
            figure = None if closes else []
        elif name == "figcaption":
            inside = not closes
        elif name in _MEDIA and not closes:
            known = {k.lower(): unescaped(a or b or c) for k, a, b, c in _ATTRIBUTE.findall(attributes)}
            if known.get(_MEDIA[name]):
                n = known.get("data-bytes", "")
                part = {"kind": "media", "text": None, "ref": known[_MEDIA[name]], "caption": known.get("alt"), "bytes": int(n) if n.isdecimal() and len(n) <= 18 else None}
                out.append(part)
                if figure is not None:
                    figure.append(part)
    buffer.append(page[at:])
    end_text()
    end_figure()
    return [part | {"pos": k} for k, part in enumerate(p for p in out if p["kind"])]


def sequences(pages: DataFrame, key: str = "page_id") -> DataFrame:
    """key, sequence: the parsed html of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in common.slices(batch, "html"):
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([parse(x.as_py()) for x in part.column(1)], _ARROW)], [key, "sequence"])

    return pages.select(key, "html").transform(common.in_small_batches).mapInArrow(run, common.with_id(pages, f"sequence {SEQUENCE}", key))


def stored(payload: bytes) -> bytes:
    """The stored form of a payload whose length is a multiple of ROW."""
    return b"P5\n%d %d\n255\n" % (ROW, len(payload) // ROW) + payload


def read_back(media: bytes) -> bytes:
    """The samples of a stored form."""
    head = re.match(rb"P5\s+(\d+)\s+(\d+)\s+255\s", media)
    if not head or len(media) - head.end() != int(head[1]) * int(head[2]):
        raise ValueError("not a stored payload")
    return media[head.end() :]


def padded(text: str | None) -> tuple[bytes, int]:
    raw = (text or "").encode()
    return raw + bytes(max(ROW, -(-len(raw) // ROW) * ROW) - len(raw)), len(raw)


def feature(payload: bytes) -> str:
    """Mean, deviation and a histogram of 16 bins of the samples, in thousandths."""
    counts = np.bincount(np.frombuffer(payload, np.uint8), minlength=256)
    n, value = len(payload), np.arange(256)
    mean = float(counts @ value) / n
    spread = max(0.0, float(counts @ (value * value)) / n - mean * mean) ** 0.5
    bins = counts.reshape(16, 16).sum(axis=1) * 1000 // n
    return f"{mean:.3f};{spread:.3f};" + ",".join(map(str, bins))


def store(docs: DataFrame) -> DataFrame:
    """digest, media of every text, equal texts once, as a table in the shared folder. Only the texts that occur again
    are shuffled, one of each kind from each task."""
    texts = docs.select(F.coalesce("text", F.lit("")).alias("text"))
    texts = texts.withColumn("key", F.unhex(F.sha2(F.encode("text", "utf-8"), 256)))
    again = texts.groupBy("key").agg(F.count("*").alias("c")).where("c > 1").select("key")
    again = common.sent(common.written(again, "repeated"))
    first = texts.join(again, "key", "left_semi").groupBy("key").agg(F.first("text").alias("text"))
    once = texts.join(again, "key", "left_anti").select("text").union(first.select("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in common.slices(batch, "text"):
                media = [stored(padded(x.as_py())[0]) for x in part.column(0)]
                yield pa.RecordBatch.from_arrays([pa.array([hashlib.sha256(x).hexdigest() for x in media], pa.string()), pa.array(media, pa.binary())], ["digest", "media"])

    return common.written(once.transform(common.in_small_batches).mapInArrow(run, "digest string, media binary"), "media")


def features(media: DataFrame) -> DataFrame:
    """One row for each digest, from the stored bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for x in batch.column(0):  # one at a time, never a list of all payloads
                x = x.as_py()
                payload = read_back(x)
                rows.append((hashlib.sha256(x).hexdigest(), len(x), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-ROW:]), feature(payload)))
            columns = list(zip(*rows, strict=True)) or [()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string()), strict=True)], ["media_sha256", "media_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "feature"])

    found = media.select("media").transform(common.in_small_batches).mapInArrow(run, "media_sha256 string, media_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, feature string")
    return found.dropDuplicates(["media_sha256"])


def resolve(sequence: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """A row for each media reference: key, n_parts (of its sequence), pos, caption, ref, bytes and the features of its payload
    (null if none)."""
    media = F.filter("sequence", lambda part: part["kind"] == "media")
    refs = sequence.select(key, F.size("sequence").alias("n_parts"), F.explode(media).alias("part")).select(key, "n_parts", "part.pos", "part.caption", "part.ref", "part.bytes")
    return refs.join(found.withColumn("ref", F.concat(F.lit("sha256:"), "media_sha256")), "ref", "left")


def as_html(text: str | None) -> str:
    """A document as a page: its lines as paragraphs, its own payload as a figure in their midst."""
    payload, n = padded(text)
    lines = [f"<p>{html.escape(x, quote=False)}</p>" for x in (text or "").split("\n")]
    half = (len(lines) + 1) // 2
    digest = hashlib.sha256(stored(payload)).hexdigest()
    figure = f'<figure><img src="sha256:{digest}" data-bytes="{n}"><figcaption>{n} bytes after {half} of {len(lines)} lines</figcaption></figure>'
    return "<article>" + "".join(lines[:half]) + figure + "".join(lines[half:]) + "</article>"


def written_pages(docs: DataFrame) -> DataFrame:
    """doc_id, html: each document as a page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in common.slices(batch, "text"):
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([as_html(x.as_py()) for x in part.column(1)], pa.string())], ["doc_id", "html"])

    return docs.select("doc_id", "text").transform(common.in_small_batches).mapInArrow(run, common.with_id(docs, "html string"))


def op2_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.documents(spark, sf_dir)
    parsed = sequences(written_pages(docs), "doc_id")
    out = resolve(parsed, features(store(docs)), "doc_id")
    return out.select("doc_id", F.col("bytes").alias("n_bytes"), "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "n_parts", F.col("pos").alias("media_pos"), "caption")
