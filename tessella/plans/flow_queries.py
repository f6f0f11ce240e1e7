"""Queries over streams, groups that run one after the other, tables in versions and document files, each with SQL written on
its own."""

from __future__ import annotations

import io
import zipfile
from html import escape

import pandas as pd
import pyarrow.fs
from pyspark.sql import functions as F

from ..operators.stored import new_path
from ..sources import documents, versions
from ..streaming import events, follow
from .inputs import table

QUERIES, SQL = {}, {}
c = F.col


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


# --- progress --------------------------------------------------------------------------------------------------------
# purchases complete a project unless they are of a chapter; errors end it likewise
_EVENTS = """e AS (SELECT CAST(user_id AS STRING) AS project, event_id, date_trunc('millisecond', ts) AS ts, CASE event_type WHEN 'purchase' THEN 'complete' ELSE event_type END IN ('complete', 'error') AND value <= 10 AS ends FROM events),
n AS (SELECT *, lead(ts) OVER (PARTITION BY project ORDER BY ts, event_id) AS next FROM e)"""


def _progress(df):
    stage = F.when(c("event_type") == "purchase", "complete").otherwise(c("event_type"))
    return df.select("event_id", c("user_id").cast("string").alias("project"), F.date_trunc("millisecond", c("ts").cast("timestamp")).alias("ts"), stage.alias("stage"), F.when(c("value") > 10, "c").alias("chapter_id"))


def _summed(rows):
    """Whole results by project and kind: how many, and when the first and the last."""
    return rows.groupBy("project", "kind").agg(F.count("*").alias("n"), F.min(F.unix_millis("at")).alias("first"), F.max(F.unix_millis("at")).alias("last"))


def _pings(until: str) -> str:
    return f"""s AS (SELECT *, CASE WHEN ends THEN 0 WHEN next IS NOT NULL THEN (epoch_ms(next) - epoch_ms(ts) - 1) // 300000 ELSE greatest(0, ({until} - epoch_ms(ts)) // 300000) END AS n FROM n)
SELECT project, CASE WHEN ends THEN 'end' ELSE 'event' END AS kind, count(*) AS n, min(epoch_ms(ts)) AS first, max(epoch_ms(ts)) AS last FROM s GROUP BY ALL
UNION ALL SELECT project, 'ping', CAST(sum(n) AS BIGINT), min(epoch_ms(ts)) + 300000, max(epoch_ms(ts) + 300000 * n) FROM s WHERE n > 0 GROUP BY project"""


@query("s05_followed", f"WITH {_EVENTS}, {_pings('epoch_ms(ts)')}")
def followed(spark, sf_dir):
    return _summed(follow.followed(_progress(table(spark, sf_dir, "events"))))


@query("s05_replayed_stream", f"WITH {_EVENTS}, {_pings('(SELECT max(epoch_ms(ts)) - 600000 FROM e)')}")
def replayed_stream(spark, sf_dir):
    """The event table as a stream, through state with timers, up to its last watermark."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    spark.conf.set(name, follow.STORE)
    try:
        rows = follow.replay(_progress(events.stream(spark, f"{sf_dir}/events.parquet")), new_path(spark, "followed"))
    finally:
        spark.conf.set(name, before) if before else spark.conf.unset(name)
    return _summed(rows)


# groups: a customer's orders one after the other
_GROUPS = """g AS (SELECT o_custkey AS project, o_orderkey AS pos, CASE WHEN o_orderkey % 5 = 0 THEN 'failed' ELSE 'done' END AS status, CASE WHEN o_orderkey % 7 > 0 THEN o_orderpriority || CAST(o_orderkey AS STRING) END AS summary,
  o_orderkey % 11 = 3 AS paused, CAST(o_orderkey % 3 AS INT) AS n_green, CAST(o_orderkey % 2 AS INT) AS n_yellow, 1 AS n_red, CAST(o_orderkey % 4 AS INT) AS size FROM orders)"""


@query("s09_generation_groups", f"""WITH {_GROUPS}, stop AS (SELECT project, min(pos) AS pos FROM g WHERE paused AND status <> 'failed' GROUP BY project),
source AS (SELECT g.project, g.pos, max(b.pos) AS before FROM g LEFT JOIN g AS b ON b.project = g.project AND b.pos < g.pos AND b.status <> 'failed' AND b.size > 0 GROUP BY ALL),
r AS (SELECT g.*, stop.pos IS NULL OR g.pos <= stop.pos AS runs, b.summary AS entry FROM g JOIN source s ON s.project = g.project AND s.pos = g.pos LEFT JOIN g AS b ON b.project = g.project AND b.pos = s.before LEFT JOIN stop ON stop.project = g.project)
SELECT project, pos, CASE WHEN runs THEN entry END AS entry_summary, CAST(CASE WHEN runs AND status <> 'failed' THEN n_green ELSE 0 END AS BIGINT) AS green, CAST(CASE WHEN runs AND status <> 'failed' THEN n_yellow ELSE 0 END AS BIGINT) AS yellow,
  CAST(CASE WHEN NOT runs THEN 0 WHEN status = 'failed' THEN size ELSE n_red END AS BIGINT) AS red, runs FROM r""")
def generation_groups(spark, sf_dir):
    groups = spark.sql(f"WITH {_GROUPS.replace('FROM orders', 'FROM {orders}')} SELECT * FROM g", orders=table(spark, sf_dir, "orders"))
    return follow.generation_groups(groups)


# --- versions --------------------------------------------------------------------------------------------------------
@query("m26_evolved_chunks", """SELECT min(doc_id) AS id, source AS folder_path, md5(text) AS chunk_hash, CAST(NULL AS VARCHAR) AS keywords, CAST(NULL AS VARCHAR) AS context_prefix, 2 AS version FROM documents GROUP BY source, md5(text)""")
def evolved_chunks(spark, sf_dir):
    """Chunks of an older form, brought to the present one and read from there."""
    path = new_path(spark, "knowledge-chunks")
    old = table(spark, sf_dir, "documents").select(c("doc_id").alias("id"), c("source").alias("folder_path"), F.md5("text").alias("chunk_hash"))
    versions.write(old, path)
    version = versions.ensure(spark, {"knowledge_chunks": (path, versions.schema_steps()["knowledge_chunks"])})["knowledge_chunks"]
    return versions.read(spark, path).select("id", "folder_path", "chunk_hash", "keywords", "context_prefix", F.lit(version).alias("version"))


# --- document files --------------------------------------------------------------------------------------------------
#: Documents in a file, and the suffixes of files in turn.
_TOGETHER, _SUFFIXES = 50, (".docx", ".txt", ".md", ".doc", ".xyz")
_CLEAN = "regexp_replace(text, '[\\x00-\\x08\\x0b-\\x1f\\x{fffe}\\x{ffff}]', '', 'g')"


def _write(folder: str):
    """Writes the file of a block of documents (block, doc_id, text): the texts one after the other, with a blank line between."""
    files, at = pyarrow.fs.FileSystem.from_uri(folder)

    def run(block: pd.DataFrame) -> pd.DataFrame:
        number, texts = int(block["block"].iloc[0]), block.sort_values(["doc_id", "text"])["text"].tolist()
        suffix = _SUFFIXES[number % len(_SUFFIXES)]
        if suffix == ".docx":
            body = "".join(f'<w:p><w:r><w:t xml:space="preserve">{escape(t, quote=False)}</w:t></w:r></w:p>' for t in texts)
            data = io.BytesIO()
            with zipfile.ZipFile(data, "w", zipfile.ZIP_DEFLATED) as packed:
                packed.writestr("word/document.xml", f'<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body>{body}</w:body></w:document>')
            data = data.getvalue()
        else:
            data = "\n\n".join(texts).encode()
        files.create_dir(at)
        with files.open_output_stream(f"{at}/b{number:012d}{suffix}") as out:
            out.write(data)
        return pd.DataFrame({"n": [1]})

    return run


def _items(spark, sf_dir):
    """The documents as files, read again. A worker holds one block at a time, not as many as an Arrow batch has rows."""
    folder = new_path(spark, "files")
    folder = folder if "://" in folder else f"file://{folder}"
    text = F.regexp_replace(F.coalesce("text", F.lit("")), r"[\x00-\x08\x0b-\x1f\x{fffe}\x{ffff}]", "")
    docs = table(spark, sf_dir, "documents").select(F.floor(c("doc_id") / _TOGETHER).cast("long").alias("block"), "doc_id", text.alias("text"))
    docs.groupBy("block").applyInPandas(_write(folder), "n long").agg(F.sum("n")).collect()
    return documents.documents(spark, folder)


_FILES = f"""d AS (SELECT doc_id, doc_id // 50 AS block, doc_id // 50 % 5 AS kind, {_CLEAN} AS text FROM documents),
whole AS (SELECT block, string_agg(text, chr(10) || chr(10) ORDER BY doc_id) AS t FROM d WHERE kind IN (1, 2) GROUP BY block),
piece AS (SELECT block, 0 AS kind, doc_id AS pos, text FROM d WHERE kind = 0 UNION ALL SELECT block, 1, unnest(range(len(p))), unnest(p) FROM (SELECT block, regexp_split_to_array(t, '(?:\\r?\\n){{2,}}') AS p FROM whole) x),
fine AS (SELECT block, pos, text, regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS bare FROM piece), first AS (SELECT * FROM fine WHERE bare <> '' QUALIFY row_number() OVER (PARTITION BY block, bare ORDER BY pos) = 1),
item AS (SELECT block, CAST(row_number() OVER (PARTITION BY block ORDER BY pos) AS INT) AS item, text FROM first),
name AS (SELECT DISTINCT block, kind, 'b' || lpad(CAST(block AS VARCHAR), 12, '0') || ['.docx', '.txt', '.md', '.doc', '.xyz'][kind + 1] AS name,
  CASE kind WHEN 3 THEN '暂不支持 .doc 格式，请先转换为 .docx 后再上传' WHEN 4 THEN '不支持的文件格式: .xyz' END AS error FROM d)"""


@query("a04_document_files", f"WITH {_FILES} SELECT name, coalesce(item, 0) AS item, CASE WHEN item IS NOT NULL THEN 'paragraph' END AS kind, md5(text) AS digest, error FROM name LEFT JOIN item USING (block) WHERE item IS NOT NULL OR error IS NOT NULL")
def document_files(spark, sf_dir):
    return _items(spark, sf_dir).select(F.element_at(F.split("path", "/"), -1).alias("name"), "item", "kind", F.md5("text").alias("digest"), "error")


@query("a15_reference_texts", f"""WITH {_FILES}, whole2 AS (SELECT block, regexp_replace(string_agg(text, chr(10) || chr(10) ORDER BY item), '^\\s+|\\s+$', '', 'g') AS t FROM item GROUP BY block)
SELECT name, md5(CASE WHEN length(t) > 120000 THEN regexp_replace(substring(t, 1, 120000), '\\s+$', '') || chr(10) || chr(10) || '…（已截断）' ELSE t END) AS digest, CASE WHEN error IS NULL AND t IS NULL THEN '未能从参考标书中提取到有效文本' ELSE error END AS error FROM name LEFT JOIN whole2 USING (block)""")
def reference_texts(spark, sf_dir):
    found = documents.reference_texts(_items(spark, sf_dir))
    return found.select(F.element_at(F.split("path", "/"), -1).alias("name"), F.md5("text").alias("digest"), "error")
