"""Document files as a Spark data source: `spark.read.format("documents").load(folder)`.

A row for each paragraph and each table of a file (path, item, kind, text, error), in order. A file that cannot be read, or
is of a format that is not, gives one row with an error instead, and the others go on. Files are listed once and dealt to
tasks by size; each is read and parsed in its task, through the file systems that Arrow knows by URI. Word's zip-and-XML
format and plain text are read; for others, and for layout or scans, register a reader by suffix (`READERS`)."""

from __future__ import annotations

import io
import posixpath
import re
import zipfile
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions import text as tx

SCHEMA = "path string, item int, kind string, text string, error string"
#: What is said of files that are not read, and the length at which a reference's text is cut.
OLD_WORD, OTHER, CUT, MOST = "暂不支持 .doc 格式，请先转换为 .docx 后再上传", "不支持的文件格式: ", "\n\n…（已截断）", 120_000
NOTHING = "未能从参考标书中提取到有效文本"
#: Bytes of files in a task, and of a member that is unpacked.
SHARE, UNPACKED = 64 << 20, 256 << 20
_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"

Item = tuple[str, str]  # kind, text


def word_items(data: bytes) -> list[Item]:
    """Paragraphs and tables of a Word file, in order; a table's cells are parted by tabs, its rows by line feeds."""
    with zipfile.ZipFile(io.BytesIO(data)) as packed:
        member = packed.getinfo("word/document.xml")
        if member.file_size > UNPACKED:
            raise ValueError(f"word/document.xml unpacks to {member.file_size} bytes")
        xml = packed.read(member)
    if b"<!DOCTYPE" in xml[:4096] or b"<!ENTITY" in xml:
        raise ValueError("declarations of entities are not read")
    body = ElementTree.fromstring(xml).find(f"{_W}body")
    said = lambda p: "".join((x.text or "") if x.tag == f"{_W}t" else "\t" if x.tag == f"{_W}tab" else "\n" for x in p.iter() if x.tag in (f"{_W}t", f"{_W}tab", f"{_W}br"))
    out = []
    for block in body if body is not None else []:
        if block.tag == f"{_W}p":
            out.append(("paragraph", said(block)))
        elif block.tag == f"{_W}tbl":
            rows = ("\t".join(" ".join(said(p) for p in cell.iter(f"{_W}p")) for cell in row.findall(f"{_W}tc")) for row in block.findall(f"{_W}tr"))
            out.append(("table", "\n".join(rows)))
    return out


def text_items(data: bytes) -> list[Item]:
    """Blocks between blank lines of a text file, in UTF-8 or else GB 18030."""
    try:
        text = data.decode("utf-8-sig")
    except UnicodeDecodeError:
        text = data.decode("gb18030")
    return [("paragraph", block) for block in re.split(r"(?:\r?\n){2,}", text)]


#: What reads the files of a suffix: bytes to items. A reader raises for a file that it cannot read.
READERS: dict[str, Callable[[bytes], list[Item]]] = {".docx": word_items, ".txt": text_items, ".md": text_items}


def items_of(path: str, data: Callable[[], bytes], readers: dict[str, Callable[[bytes], list[Item]]]) -> Iterator[tuple]:
    """The rows of one file: items that are not blank, the first of those alike, or an error."""
    suffix = posixpath.splitext(path)[1].lower()
    if suffix not in readers:
        yield path, 0, None, None, OLD_WORD if suffix == ".doc" else f"{OTHER}{suffix}"
        return
    try:
        found = readers[suffix](data())
    except Exception as error:  # a damaged file is a row, whatever its reader says of it
        yield path, 0, None, None, f"{type(error).__name__}: {error}"
        return
    seen = set()
    for kind, text in found:
        if text.strip() and text.strip() not in seen:
            seen.add(text.strip())
            yield path, len(seen), kind, text, None


class Files(InputPartition):
    def __init__(self, paths: list[str]):
        super().__init__(None)
        self.paths = paths


class DocumentReader(DataSourceReader):
    def __init__(self, uri: str, share: int, readers: dict[str, Callable[[bytes], list[Item]]]):
        self.uri, self.share, self.readers = uri, share, readers

    def partitions(self) -> list[Files]:
        """The files below the folder in order of size, dealt so that each task has about `share` bytes."""
        files, at = pa.fs.FileSystem.from_uri(self.uri)
        single = files.get_file_info(at)
        found = [single] if single.type == pa.fs.FileType.File else files.get_file_info(pa.fs.FileSelector(at, recursive=True))
        known = sorted((f for f in found if f.type == pa.fs.FileType.File and not f.base_name.startswith((".", "_"))), key=lambda f: (-(f.size or 0), f.path))
        n = max(1, -(-sum(f.size or 0 for f in known) // self.share))
        # the largest first, in turn and back again, so shares are alike
        shares: list[list[str]] = [[] for _ in range(min(n, len(known)))]
        for k, f in enumerate(known):
            turn, place = divmod(k, len(shares))
            shares[place if turn % 2 == 0 else -1 - place].append(f.path)
        return [Files(s) for s in shares] or [Files([])]

    def read(self, partition: Files) -> Iterator[tuple]:
        files, _ = pa.fs.FileSystem.from_uri(self.uri)
        for path in partition.paths:
            yield from items_of(path, lambda p=path: files.open_input_stream(p).readall(), self.readers)


class Documents(DataSource):
    """Options: path (a URI or a local path of a folder or a file), share (bytes of files in a task)."""

    @classmethod
    def name(cls) -> str:
        return "documents"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DocumentReader:
        path = self.options["path"]
        return DocumentReader(path if "://" in path else f"file://{path}", int(self.options.get("share", SHARE)), dict(READERS))


def documents(spark: SparkSession, path: str, share: int = SHARE) -> DataFrame:
    """The items of all files below a folder."""
    spark.dataSource.register(Documents)
    return spark.read.format("documents").option("share", share).load(path)


def capped(text: Column, most: int = MOST) -> Column:
    """A text of at most so many characters, and a word that it was cut."""
    return F.when(F.length(text) > most, F.concat(F.regexp_replace(F.substring(text, 1, most), r"(?U)\s+$", ""), F.lit(CUT))).otherwise(text)


def reference_texts(items: DataFrame, most: int = MOST) -> DataFrame:
    """(path, text, error) of items (path, item, text, error): a file's items in order with blank lines between, cut; without
    any text an error, as with a file that was not read. Items that lie wholly beyond the cut are not gathered. (A15)"""
    fine = items.where("error IS NULL").select("path", "item", "text", (F.length("text") + 2).alias("n"))
    before = F.coalesce(F.sum("n").over(W.partitionBy("path").orderBy("item").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    kept = fine.withColumn("before", before).where(F.col("before") <= most + 1000)
    by = kept.groupBy("path").agg(F.sort_array(F.collect_list(F.struct("item", "text"))).alias("xs"))
    by = by.select("path", tx.strip(F.array_join(F.col("xs")["text"], "\n\n")).alias("text"))
    failed = items.groupBy("path").agg(F.min("error").alias("error"))
    out = failed.join(by, "path", "left")
    blank = F.coalesce("text", F.lit("")) == ""
    return out.select("path", F.when(~blank & F.col("error").isNull(), capped(F.col("text"), most)).alias("text"), F.coalesce("error", F.when(blank, NOTHING)).alias("error"))
