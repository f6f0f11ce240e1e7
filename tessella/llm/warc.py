"""WARC archives: writer and splittable reader.

Writer: a gzip member for each record, an archive for each task. Of records with equal payloads of at least `least`
bytes the one with the largest page_id is a response; the others are revisit records that name it and carry no
payload. A task writes under a name of its own attempt, and only names that a finished task has reported enter the
manifest, so repeated or lost attempts leave no record behind.

Reader: byte ranges of the archives are dealt out; a task scans its range for the magic bytes of gzip, accepts a
candidate only if it inflates to a WARC header, and owns the records whose members begin in its range, reading
beyond the end for the last one. False magic within compressed data is refused by that test.

A null page counts as empty html. Rows that repeat a page_id are records of their own; of equal payloads with equal
page_id one is the response. A null page_id is written as `null` and is the smallest: of equal payloads whose ids are
all null one is the response, and what the others refer to is null. An empty table gives an empty archive list and
result. Only page_id, url and html are read.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import common

MAGIC = b"\x1f\x8b\x08"
#: Payloads from so many bytes on are stored once; bytes in a reader's range and at most in a reader's task; compression.
LEAST, RANGE, TASK, LEVEL = 0, 4 << 20, 128 << 20, 4
READ = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def sha1_32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, revisit: bool = False, refers_to: int | None = None) -> bytes:
    """A record, uncompressed. refers_to: the page whose response a revisit names."""
    kind = "revisit" if revisit else "response"
    body = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    if not revisit:
        body += payload
    uri = "".join(c if 32 < ord(c) < 127 else "".join(f"%{b:02X}" for b in c.encode("utf-8", "replace")) for c in url or "")
    head = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id} {uri}')}>",
        "WARC-Date: 2024-01-01T00:00:00Z",
        f"WARC-Target-URI: {uri}",
        f"WARC-Payload-Digest: sha1:{sha1_32(payload)}",
        f"X-Page-Id: {'null' if page_id is None else page_id}",
        f"X-Payload-Length: {len(payload)}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(body)}",
    ]
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"X-Refers-To-Page-Id: {'null' if refers_to is None else refers_to}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def roles(pages: DataFrame, least: int = LEAST) -> DataFrame:
    """page_id, url, html, revisit (whether another page has this payload's response) and refers_to (its page_id)."""
    pages = pages.select(F.col("page_id").cast("long"), "url", F.coalesce("html", F.lit("")).alias("html"))
    pages = pages.withColumn("digest", F.unhex(F.sha1(F.encode("html", "utf-8"))))
    # the payloads are read once for their digests; all that is counted is counted over these
    each = common.written(pages.where(F.octet_length("html") >= least).groupBy("digest", "page_id").agg(F.count("*").alias("same")), "digests")
    order = F.struct(F.col("page_id").isNotNull(), "page_id")
    groups = each.groupBy("digest").agg(F.max_by(F.struct("page_id", "same"), order).alias("top"), F.sum("same").alias("copies")).where("copies > 1")
    many = common.written(groups.select(F.col("digest").alias("of"), F.col("top.page_id").alias("top"), F.col("top.same").alias("same")), "repeated")
    tied = many.where("same > 1").head(1)
    found = pages.join(common.sent(many), (F.col("digest") == F.col("of")) & (F.octet_length("html") >= least), "left")
    first = F.col("page_id").eqNullSafe(F.col("top"))
    if tied:  # rows that share the largest page_id: all but one revisit it
        first = first & (F.row_number().over(W.partitionBy("digest", "page_id").orderBy("url")) == 1)
        found = found.withColumn("first", first)
        first = F.col("first")
    revisit = F.col("of").isNotNull() & ~first
    return found.select("page_id", "url", "html", revisit.alias("revisit"), F.when(revisit, F.col("top")).alias("refers_to"))


def write(pages: DataFrame, folder: str) -> DataFrame:
    """Writes archives into the folder. pages: as of roles(). Returns the manifest (path, bytes, records), a table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pafs.FileSystem.from_uri(folder)
        fs.create_dir(root, recursive=True)
        name = f"{uuid.uuid4().hex}.warc.gz"
        out, size, records = None, 0, 0
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                out = out or fs.open_output_stream(f"{root}/{name}", compression=None, buffer_size=1 << 20)
                page_id, url, html, *role = row
                packer = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
                member = packer.compress(record(page_id, url, html.encode(), *role)) + packer.flush()
                out.write(member)
                size += len(member)
                records += 1
        if out:
            out.close()
            yield pa.RecordBatch.from_pylist([{"path": f"{folder}/{name}", "bytes": size, "records": records}], pa.schema([("path", pa.string()), ("bytes", pa.int64()), ("records", pa.int64())]))

    return common.written(pages.mapInArrow(run, "path string, bytes long, records long"), "manifest")


class Members:
    """Gzip members of one archive that begin in [begin, end)."""

    def __init__(self, file, size: int):
        self.file, self.size = file, size

    def _inflate(self, at: int, data: bytes) -> tuple[bytes, int] | None:
        """The member at this place, inflated, and where it ends; data: bytes from there on that are already read."""
        packer, out, taken = zlib.decompressobj(31), [], 0
        try:
            while not packer.eof:
                if not data:
                    data = self.file.read_at(min(1 << 18, self.size - at - taken), at + taken)
                    if not data:
                        return None
                out.append(packer.decompress(data))
                taken += len(data)
                data = b""
                if len(out) == 1 and len(out[0]) >= 5 and not out[0].startswith(b"WARC/"):
                    return None
        except zlib.error:
            return None
        whole = b"".join(out)
        return (whole, at + taken - len(packer.unused_data)) if whole.startswith(b"WARC/") else None

    def within(self, begin: int, end: int) -> Iterator[bytes]:
        block = self.file.read_at(min(end - begin + len(MAGIC) - 1, self.size - begin), begin)
        at = begin
        while True:
            k = block.find(MAGIC, at - begin)
            if k < 0 or begin + k >= end:
                return
            found = self._inflate(begin + k, block[k : k + (1 << 16)])
            if found:
                yield found[0]
            at = found[1] if found else begin + k + 1
            if at >= end:
                return


def parse(record_: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields and payload. The payload's digest is checked for responses."""
    head, _, rest = record_.partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
    body = rest[: int(fields["Content-Length"])]
    return fields, body.partition(b"\r\n\r\n")[2]


def read(manifest: DataFrame, span: int = RANGE) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of all records of the archives."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for path, size, begin in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                fs, at = pafs.FileSystem.from_uri(path)
                with fs.open_input_file(at) as file:
                    for found in Members(file, size).within(begin, min(size, begin + span)):
                        fields, payload = parse(found)
                        digest, page = fields["WARC-Payload-Digest"].removeprefix("sha1:"), fields["X-Page-Id"]
                        n = int(fields["X-Payload-Length"])
                        if fields["WARC-Type"] == "response" and (len(payload) != n or sha1_32(payload) != digest):
                            raise ValueError(f"damaged record of page {page} in {path}")
                        other = fields.get("X-Refers-To-Page-Id")
                        rows.append((None if page == "null" else int(page), n, digest, fields["WARC-Type"], int(other) if other and other != "null" else None))
            columns = list(zip(*rows, strict=True)) or [()] * 5
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])

    ranges = manifest.select("path", "bytes", F.explode(F.sequence(F.lit(0).cast("long"), F.col("bytes") - 1, F.lit(span).cast("long"))).alias("begin"))
    # a number of parts of its own, which Spark keeps: a few bytes of ranges would else become one task
    size, count = manifest.agg(F.sum("bytes"), F.sum(F.ceil(F.col("bytes") / span))).first()
    slots = manifest.sparkSession.sparkContext.defaultParallelism
    parts = max(1, min(count or 0, max(4 * slots, (size or 0) // TASK)))
    return ranges.repartition(parts).mapInArrow(run, READ)


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return read(write(roles(pages), common.new_path(spark, "warc")))
