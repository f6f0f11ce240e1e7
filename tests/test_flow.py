"""Streams, versions and document files: replays against batches, failures, damaged files."""

import datetime
import io
import random
import time
import zipfile

import pytest
from pyspark.sql import functions as F

from tessella.sources import documents, versions
from tessella.streaming import follow

SCHEMA = "event_id long, project string, ts timestamp, stage string, chapter_id string"
START = datetime.datetime(2024, 1, 1)


@pytest.fixture
def rocks(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    spark.conf.set(name, follow.STORE)
    yield
    spark.conf.set(name, before) if before else spark.conf.unset(name)


def rows_of(df):
    return sorted((r["project"], r["at"], r["kind"], r["event_id"] or -1) for r in df.collect())


def plain(rows, until):
    """followed() event by event."""
    out, by = [], {}
    for r in sorted(rows, key=lambda r: (r[2], r[0])):
        by.setdefault(r[1], []).append(r)
    for project, events in by.items():
        for e, after in zip(events, [*events[1:], None], strict=True):
            ends = e[3] in follow.ENDS and e[4] is None
            out.append((project, e[2], "end" if ends else "event", e[0]))
            ping = e[2] + datetime.timedelta(seconds=300)
            while not ends and (ping < after[2] if after else until is not None and ping <= until):
                out.append((project, ping, "ping", -1))
                ping += datetime.timedelta(seconds=300)
    return sorted(out)


def made(seed, n=240):
    rng, t, rows = random.Random(seed), 0, []
    for i in range(n):
        t += rng.choice([0, 1, 10, 299, 300, 301, 700])
        rows.append((i + 1, f"p{rng.randint(1, 6)}", START + datetime.timedelta(seconds=t), rng.choice(["stage"] * 8 + ["complete", "error", None]), rng.choice([None, None, "c"])))
    return rows


def test_followed_batch(spark):
    rows = made(1)
    until = max(r[2] for r in rows) + datetime.timedelta(seconds=900)
    df = spark.createDataFrame(rows, SCHEMA)
    assert rows_of(follow.followed(df)) == plain(rows, None)
    assert rows_of(follow.followed(df, F.lit(until))) == plain(rows, until)
    assert follow.followed(df.limit(0)).count() == 0


def test_stream_is_the_batch(spark, tmp_path, rocks):
    """Event files that arrive one after the other, and a restart from the checkpoint: the same rows as the batch; projects
    whose last event ends their stream leave no state."""
    rows = [*made(2), (900, "over", START, "stage", None), (901, "over", START + datetime.timedelta(seconds=1), "complete", None)]
    df = spark.createDataFrame(rows, SCHEMA)
    (tmp_path / "in").mkdir()
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    for low, high in ((0, 80), (80, 160)):
        df.where(f"event_id >= {low} AND event_id < {high} OR {low} = 0 AND event_id >= 900").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        time.sleep(1.1)
    follow.replay(stream, str(tmp_path / "out"), late="0 seconds")
    df.where("event_id >= 160 AND event_id < 900").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    got = follow.replay(stream, str(tmp_path / "out"), late="0 seconds")
    assert rows_of(got) == plain(rows, max(r[2] for r in rows))
    state = spark.read.format("statestore").option("stateVarName", "last").load(str(tmp_path / "out" / "checkpoint"))
    ended = {p for p in {r[1] for r in rows} if (e := max((r for r in rows if r[1] == p), key=lambda r: (r[2], r[0])))[3] in follow.ENDS and e[4] is None}
    assert "over" in ended and {r["key"]["project"] for r in state.collect()} == {r[1] for r in rows} - ended


def test_silence_is_one_row_of_the_stream(spark, tmp_path, rocks):
    """Pings of a month leave the state as one row with their number, before an event as by a timer."""
    month = datetime.timedelta(days=30)
    rows = [(1, "a", START, "stage", None), (2, "a", START + month, "complete", None), (3, "b", START, "stage", None)]
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(str(tmp_path / "in"))
    got = follow.replay(spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in")), str(tmp_path / "out"), late="0 seconds")
    assert rows_of(got) == plain(rows, START + month) and got.count() > 15_000
    assert spark.read.parquet(str(tmp_path / "out" / "rows")).count() == 5


def test_stream_needs_a_store_with_timers(spark):
    with pytest.raises(ValueError):
        follow.follow(spark.createDataFrame([], SCHEMA))


def test_groups_one_after_the_other(spark):
    rows = [("p", 1, "done", "a", False, 2, 0, 0, 2), ("p", 2, "failed", "no", True, 9, 9, 9, 3), ("p", 3, "done", None, False, 1, 1, 0, 2), ("p", 4, "done", "x", False, 0, 0, 0, 0), ("p", 5, "done", "b", True, 1, 0, 1, 2), ("p", 6, "done", "c", False, 1, 0, 0, 1), ("q", 1, None, "a", None, None, None, None, 1)]
    df = spark.createDataFrame(rows, "project string, pos int, status string, summary string, paused boolean, n_green int, n_yellow int, n_red int, size int")
    assert [tuple(r) for r in follow.generation_groups(df).orderBy("project", "pos").collect()] == [
        ("p", 1, None, 2, 0, 0, True), ("p", 2, "a", 0, 0, 3, True), ("p", 3, "a", 1, 1, 0, True), ("p", 4, None, 0, 0, 0, True), ("p", 5, None, 1, 0, 1, True), ("p", 6, None, 0, 0, 0, False), ("q", 1, None, 0, 0, 0, True),
    ]


# --- versions --------------------------------------------------------------------------------------------------------
def test_versions(spark, tmp_path):
    path = f"file://{tmp_path}/chunks"
    old = spark.createDataFrame([(3, "f", "h"), (1, "f", "h"), (2, "f", None), (5, "f", None), (4, "g", "h")], "id long, folder_path string, chunk_hash string")
    assert versions.versions(spark, path) == [] and versions.write(old, path) == 1
    before = versions.read(spark, path)
    steps = versions.schema_steps()["knowledge_chunks"]
    assert versions.migrate(spark, path, steps) == 2
    now = versions.read(spark, path)
    assert now.columns == ["id", "folder_path", "chunk_hash", "keywords", "context_prefix"]
    assert sorted(r["id"] for r in now.collect()) == [1, 2, 4]
    assert sorted(r["id"] for r in before.collect()) == [1, 2, 3, 4, 5]  # a reader of the older version goes on
    assert sorted(r["id"] for r in versions.read(spark, path, 1).collect()) == [1, 2, 3, 4, 5]
    assert versions.migrate(spark, path, steps) == 2 and versions.versions(spark, path) == [1, 2]  # nothing to do
    with pytest.raises(FileNotFoundError):
        versions.read(spark, path, 7)


def test_failed_and_competing_writes(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    versions.write(spark.createDataFrame([(1, "a")], "id long, bid_scope string"), path)
    broken = lambda df: df.withColumn("x", F.raise_error(F.lit("no")).cast("string"))
    with pytest.raises(RuntimeError, match="keeps its version 1"):
        versions.ensure(spark, {"t": (path, [broken]), "later": (path, [])})
    assert versions.versions(spark, path) == [1] and versions.read(spark, path).count() == 1
    two = spark.createDataFrame([(2, "b")], "id long, bid_scope string")
    assert versions.write(two, path, after=1) == 2
    with pytest.raises(versions.Conflict):
        versions.write(spark.createDataFrame([(3, "c")], "id long, bid_scope string"), path, after=1)
    assert [tuple(r) for r in versions.read(spark, path).collect()] == [(2, "b")]
    assert versions.ensure(spark, {"absent": (f"file://{tmp_path}/none", [broken])}) == {}


def test_steps(spark, tmp_path):
    path = f"file://{tmp_path}/projects"
    versions.write(spark.createDataFrame([(1, None), (2, "x")], "id long, name string"), path)
    assert versions.ensure(spark, {"projects": (path, versions.schema_steps()["projects"])}) == {"projects": 2}
    assert {r["bid_scope"] for r in versions.read(spark, path).collect()} == {"technical"}
    versions.write(spark.createDataFrame([(1, " "), (2, ""), (3, None), (4, "full")], "id long, bid_scope string"), path)
    versions.migrate(spark, path, versions.schema_steps()["projects"])
    assert {r["id"]: r["bid_scope"] for r in versions.read(spark, path).collect()} == {1: " ", 2: "technical", 3: "technical", 4: "full"}
    items = f"file://{tmp_path}/items"
    versions.write(spark.createDataFrame([(1, 2, "f")], "id long, Project_ID long, folder_path string"), items)
    assert versions.migrate(spark, items, versions.schema_steps()["knowledge_items"]) == 2
    found = versions.read(spark, items)
    assert found.count() == 0 and found.columns == ["id", "folder_path", "title", "resume", "content", "sort_order"]
    assert versions.migrate(spark, items, versions.schema_steps()["knowledge_items"]) == 2
    assert versions.without("gone", "id")(found).columns == found.columns[1:]


# --- document files --------------------------------------------------------------------------------------------------
def word(body, name="word/document.xml"):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as packed:
        packed.writestr(name, f'<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body>{body}</w:body></w:document>')
    return out.getvalue()


P = "<w:p><w:r><w:t>{}</w:t></w:r></w:p>"


def test_document_files(spark, tmp_path):
    table = "<w:tbl>" + "".join("<w:tr>" + "".join(f"<w:tc>{P.format(x)}</w:tc>" for x in row) + "</w:tr>" for row in ("ab", "cd")) + "</w:tbl>"
    files = {
        "a.docx": word(P.format("one") + P.format(" ") + table + "<w:p><w:r><w:t>t</w:t><w:tab/><w:t>w</w:t><w:br/><w:t>o</w:t></w:r></w:p>" + P.format(" one ")),
        "sub/b.TXT": "﻿x\r\n\r\ny\nz\n\n\n x".encode(), "gb.txt": "中文\n\n内容".encode("gb18030"), "damaged.docx": b"PK\x03\x04 nothing", "other.docx": word("", "word/other.xml"), "entity.docx": word('<!DOCTYPE x [<!ENTITY a "b">]>'),
        "old.doc": b"x", "scan.pdf": b"%PDF", "none": b"", "empty.txt": b"", "_hidden.txt": b"no", "long.md": b"\n\n".join(b"%d %s" % (k, b"w" * 97) for k in range(2000)),
    }
    for name, data in files.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(data)
    for share in (1, 1 << 30):
        items = documents.documents(spark, str(tmp_path), share)
        assert items.rdd.getNumPartitions() == (11 if share == 1 else 1)
        by = {}
        for r in items.orderBy("path", "item").collect():
            by.setdefault(r["path"].removeprefix(f"{tmp_path}/"), []).append((r["kind"], r["text"], r["error"]))
        assert by["a.docx"] == [("paragraph", "one", None), ("table", "a\tb\nc\td", None), ("paragraph", "t\tw\no", None)]
        assert [x[1] for x in by["sub/b.TXT"]] == ["x", "y\nz"] and [x[1] for x in by["gb.txt"]] == ["中文", "内容"]
        assert all(len(by[n]) == 1 and by[n][0][2] for n in ("damaged.docx", "other.docx", "entity.docx", "old.doc", "scan.pdf", "none"))
        assert by["scan.pdf"][0][2] == "不支持的文件格式: .pdf" and "empty.txt" not in by and "_hidden.txt" not in by
    got = {r["path"].rsplit("/", 1)[1]: (r["text"], r["error"]) for r in documents.reference_texts(items).collect()}
    assert got["a.docx"] == ("one\n\na\tb\nc\td\n\nt\tw\no", None) and got["old.doc"] == (None, documents.OLD_WORD)
    whole = files["long.md"].decode()
    assert got["long.md"][0] == whole[:120_000].rstrip() + documents.CUT
    blank = spark.createDataFrame([("p", 1, " ", None)], "path string, item int, text string, error string")
    assert [tuple(r) for r in documents.reference_texts(blank).collect()] == [("p", None, documents.NOTHING)]
    assert documents.documents(spark, str(tmp_path / "sub")).count() == 2
