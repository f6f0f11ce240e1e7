"""Pages, lines, sections, segments, excerpts and ids against plain Python."""

import random
import re

import pytest
from pyspark.sql import functions as F

from tessella.operators import catalogs, layout, locate, outlines, sections, segments, trees
from tessella.plans.structure_queries import QUERIES


def test_outside_boxes(spark):
    """Edges, overlapping, exchanged and null boxes, extra columns with the operator's names; no nested loop."""
    rng = random.Random(1)
    chars = [(k, rng.choice([1, 2, 3, None]), float(rng.randint(0, 300)), float(rng.randint(0, 300)), rng.choice([None, 0.0, 310.0]), None, "t") for k in range(2000)]
    boxes = [(rng.choice([1, 2, None]), float(rng.randint(-50, 250)), float(rng.randint(-50, 250)), float(rng.randint(0, 300)), float(rng.randint(0, 300))) for _ in range(12)]

    def out(c):
        _, page, x0, top, x1, _, _ = c
        cx, cy = (x0 + (x1 or x0)) / 2, (top + top) / 2
        return not any(page is not None and b[0] == page and b[1] - 1 <= cx <= b[3] + 1 and b[2] - 1 <= cy <= b[4] + 1 for b in boxes)

    c = spark.createDataFrame(chars, "cx long, page int, x0 double, top double, x1 double, bottom double, tx string")
    b = spark.createDataFrame(boxes, "page int, x0 double, top double, x1 double, bottom double")
    for tile in (96.0, 7.0):
        got = layout.outside_boxes(c, b, tile=tile)
        assert got.columns == c.columns and sorted(r["cx"] for r in got.collect()) == [r[0] for r in chars if out(r)]
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert layout.outside_boxes(c, b.limit(0)).count() == len(chars) and layout.outside_boxes(c.limit(0), b).count() == 0
    text = layout.page_texts(spark.createDataFrame([(1, 5.0, 0.0, "b"), (1, 1.0, 2.0, "a"), (1, 0.0, 9.0, "c"), (2, None, None, None)], "page int, x0 double, top double, char string"))
    assert {r["page"]: r["text"] for r in text.collect()} == {1: "ab\nc", 2: ""}


def outline(lines, title_of, reach=79, most=20):
    """The best outline of lines (head, stop, title) in plain Python."""
    best = (0, None, [])
    for start, (head, _, _) in enumerate(lines):
        titles = []
        for _, stop, title in lines[start + 1 : start + 1 + reach] if head else []:
            if stop:
                break
            if title and title not in titles and len(titles) < most:
                titles.append(title)
        if len(titles) > best[0]:
            best = (len(titles), start + 1, titles)
    return best


def test_outlines_cross_batches(spark):
    rng = random.Random(2)
    kinds = [("施工组织设计纲要", True, False, "施工组织设计纲要"), ("第二章 其他", False, True, None), ("其余从略", False, False, None), ("（1）不得分包", False, False, None), ("说明：施工", False, False, None)]
    docs, want = [], {}
    for doc in range(12):
        rows = []
        for k in range(rng.choice([5, 300])):
            rows.append(rng.choices([(f"（{k % 9}）进度{k % 60}", False, False, f"进度{k % 60}"), *kinds], [60, 3, 1, 20, 5, 5])[0])
        docs += [(doc, k + 1, r[0]) for k, r in enumerate(rows)]
        best = outline([r[1:] for r in rows], None)
        if best[0]:
            want[doc] = best[1:]
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, "16")
    try:
        got = catalogs.outlines(spark.createDataFrame(docs, "doc long, pos long, line string").repartition(3)).collect()
    finally:
        spark.conf.set(name, before)
    assert {r["doc"]: (r["start"], r["titles"]) for r in got} == want
    assert catalogs.outlines(spark.createDataFrame([], "doc long, pos long, line string")).count() == 0


def test_contents_and_catalogues(spark):
    text = "前言\n一、投标函\n二、授权委托书……3\r\n三、其他（含说明）\n正文\n一、商务标\n二、技术标\n三、x\n四、……\n五、报价清单\n六、投标函"
    items = spark.createDataFrame([("a", 1, text), ("a", 2, None), ("b", 1, "一、投标函\n二、其他\n三、另外"), ("c", 1, None), ("d", 1, text), ("d", 2, "技术部分组成\n1.2 质量\n（三）进度计划"), ("e", 1, "技术标目录\n4.1质量保证")], "doc string, pos int, text string")
    toc = {r["doc"]: (r["start"], r["entries"]) for r in catalogs.contents(catalogs.lines_of(items)).collect()}
    assert toc == {d: (2, ["一、投标函", "二、授权委托书", "三、其他"]) for d in "ad"}  # of equals the first
    got = {r["doc"]: r["catalog"] for r in catalogs.catalogues(items).collect()}
    assert got == {"a": "一、投标函\n二、授权委托书\n三、其他", "d": "（一）质量\n（二）进度计划", "e": "（一）质量保证"}
    records = spark.createDataFrame([("a", " "), ("b", None), ("d", "kept"), ("z", "")], "doc string, catalog string")
    assert {r["doc"]: r["catalog"] for r in catalogs.filled(records, items).collect()} == {"a": got["a"], "b": None, "d": "kept", "z": None}


def test_sections(spark):
    """Openings within sections, closing on blanks after the third line and after sixty, the line that opens not of it."""
    rng = random.Random(3)
    line = lambda: rng.choices(["简历", "简历" + "长" * 40, "", "  ", f"甲乙{rng.choice('丙丁戊')}，担任经理", "x", "张三负责质量管理"], [1, 1, 2, 1, 5, 9, 5])[0]
    texts = [(k, rng.choice(["\n", "\r\n", "\x0c"]).join(line() for _ in range(rng.choice([3, 40, 300])))) for k in range(40)] + [(98, None), (99, "")]
    texts.append((97, "简历\n" + "x\n" * 59 + "张三负责质量管理\n李四负责质量管理"))

    def plain(text):
        inside, k, out = False, 0, set()
        for x in (text or "").splitlines():
            if "简历" in x and len(x) < 40:
                inside, k = True, 0
            elif inside:
                k += 1
                if (not x.strip() and k > 3) or k > 60:
                    inside = False
                else:
                    out |= {m[1] for m in re.finditer(r"([一-龥]{2,4})(?:[,，、]\s*(?:担任|为|出任|是|负责)?\s*|(?:担任|为|出任|是|负责)\s*)([一-龥]{2,8})", x)}
        return out

    got = {}
    for r in sections.names(spark.createDataFrame(texts, "id long, text string"), ["简历"]).collect():
        got.setdefault(r["id"], set()).add(r["name"])
    assert got == {i: n for i, t in texts if (n := plain(t))} and got[97] == {"张三"}
    both = spark.createDataFrame([(1, "简历\n张三负责质量管理\n李四负责安全管理\n组织架构\n李四负责安全管理"), (2, "简历\n张三负责质量管理")], "id long, text string")
    assert [tuple(r) for r in sections.unlisted(both).collect()] == [(1, "简历章节有、组织架构未出现的人名：张三")]


def test_localized_fixes(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choices("ab中", k=rng.randint(1, 3)))
    parts = [(c, o, rng.choice([None, "", "".join(rng.choices("ab中", k=6)) + rng.choice(["", "GB/T50-1"])])) for c in range(60) for o in range(rng.randint(0, 5))]
    anchors = [(c, rng.choice([None, f" {word()} "])) for c in range(60) for _ in range(rng.randint(0, 2))]
    fixes = [(c, rng.choice([None, f"改「{word()}」与“{word()}”，按gb/t50-1"])) for c in range(60)]

    def plain(c):
        held = lambda ws: [o for cc, o, text in parts if cc == c and any(len(w) >= 2 and w in (text or "") for w in ws)]
        first = held([(a or "").strip() for cc, a in anchors if cc == c])
        said = "".join(f or "" for cc, f in fixes if cc == c)
        return first or held([*re.findall(segments.CODES.removeprefix("(?i)"), said, re.I), *(m.strip() for m in re.findall(segments.QUOTED, said))])

    got = segments.localized(spark.createDataFrame(parts, "chapter_id long, ord int, content string"), spark.createDataFrame(anchors, "chapter_id long, anchor string"), spark.createDataFrame(fixes, "chapter_id long, fix string"))
    assert sorted(map(tuple, got.collect())) == sorted({(c, o) for c in range(60) for o in plain(c)})


def test_codes_within_quotes(spark, tmp_path):
    """What looks like a code within a quote (F6), and a quote with an odd line break."""
    parts = spark.createDataFrame([(1, 0, "x nbebe"), (1, 1, "Enbebe"), (1, 2, "a\rb\u2028c"), (1, 3, "GB/T50-1")], "chapter_id long, ord int, content string")
    none = spark.createDataFrame([], "chapter_id long, anchor string")
    fixes = spark.createDataFrame([(1, "改「Enbebe」与「a\rb\u2028c」并按GB/T50-1")], "chapter_id long, fix string")
    found = lambda **how: sorted(r["ord"] for r in segments.localized(parts, none, fixes, **how).collect())
    assert found() == [0, 1, 2, 3] and found(codes_in_quotes=False) == [1, 2, 3]
    turns = [(4, 1, "u", "Enbebe said"), (4, 2, "u", "x nbebe"), (4, 4, "u", "other words"), (4, 5, "u", "to Enbebe")]
    spark.createDataFrame(turns, "conv_id long, turn int, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    assert sorted(r["ord"] for r in QUERIES["d22_localized_fixes"](spark, str(tmp_path)).collect()) == [1, 4, 5]


def test_points_of_segments(spark):
    points = [("c", o, k, p) for o, ps in enumerate(["ab", "", "bca", "d"]) for k, p in enumerate(ps)]
    df = spark.createDataFrame(points, "chapter_id string, ord int, k int, point string")
    rows = segments.key_points(df).collect()
    for s in range(4):  # what a segment has before and after it, from a bound on one column
        assert sorted(r["point"] for r in rows if r["since"] < s and r["first"]) == sorted({p for _, o, _, p in points if o < s})
        assert sorted(r["point"] for r in rows if r["since"] > s) == sorted(p for _, o, _, p in points if o > s)
    every = spark.createDataFrame([("c", o) for o in range(4)], "chapter_id string, ord int")
    assert [tuple(r)[1:] for r in segments.written_and_remaining(df, every).orderBy("ord").collect()] == [(0, 0, 4), (1, 2, 4), (2, 2, 1), (3, 3, 0)]
    chapters = spark.createDataFrame([("c", ["m1", "m2", "m3"], ["d"], ["x", "y"], 500)], "chapter_id string, methods array<string>, data array<string>, charts array<string>, per_words int")
    got = [tuple(r)[1:] for r in segments.plans(df, chapters).orderBy("ord").collect()]
    assert got == [(0, ["m1", "m2"], ["d"], ["x", "y"], 500), (2, [], [], [], 500), (3, [], [], [], 500)]


def test_located_excerpts(spark):
    """Hits cut the raw text to the excerpt, whatever lies between; the longest piece wins; nothing is found in other texts."""
    body = "第一条　投标人应按ＧＢ/Ｔ 50326—2017 的规定，编制　施工组织设计；质量、安全与进度须“全部响应”。第二条 另有约定的除外，工期为 120 天。"
    cut = lambda needle: (h := locate.located(locate.folded(body), needle)) and (body[h[0] : h[1]], h[3])
    assert cut("编制施工组织设计，质量安全与进度") == ("编制　施工组织设计；质量、安全与进度", False)
    assert cut("按GB/T 50326-2017的规定") == ("按ＧＢ/Ｔ 50326—2017 的规定", False)
    assert cut("GB/T50326-2017的规定​，编 制") == ("ＧＢ/Ｔ 50326—2017 的规定，编制", False)
    assert cut("投标人应当：第二条另有约定的除外，其余不变") == ("第二条 另有约定的除外", True)
    assert cut("短") is None and cut("") is None and cut("此处全然没有任何相同的文字可言") is None
    rng = random.Random(5)
    for _ in range(200):
        text = "".join(rng.choice(["ab", "é", "中", " ", "\n", "，", "…", "​", "x1", "😀"]) for _ in range(rng.randint(0, 80)))
        spaced, compact = locate.folded(text)
        assert len(spaced.text) == len(spaced.offsets) and len(compact.text) == len(compact.offsets)
        tight = re.sub(r"[\s，…​]", "", text)
        assert compact.text == tight and spaced.text == re.sub(r"\s+", " ", text.replace("​", "").replace("…", "...").replace("，", ",")).strip()
        if len(tight) >= 9:
            at = rng.randrange(len(tight) - 6)
            piece = tight[at : at + 7]
            start, end, _, fuzzy = locate.located((spaced, compact), piece)
            assert re.sub(r"[\s，…​]", "", text[start:end]) == piece and not fuzzy
    texts = spark.createDataFrame([(1, body), (2, None), (3, "别的")], "id long, text string")
    needles = spark.createDataFrame([(k, 1 + k % 3, "编制施工组织设计") for k in range(1300)] + [(9999, None, "x"), (9998, 1, None)], "needle_id long, id long, needle string")
    got = locate.locate(texts, needles).collect()
    assert sorted(r["needle_id"] for r in got) == [k for k in range(1300) if k % 3 == 0] and {(r["start"], r["end"]) for r in got} == {(body.index("编制"), body.index("；"))}


def test_located_in_long_texts():
    text = "甲乙" * 200_000 + "这里才是需要找到的一段文字" + "ab " * 100_000
    start, end, _, _ = locate.located(locate.folded(text), "需要找到的，一段文字")
    assert text[start:end] == "需要找到的一段文字"


def test_located_whole_without_pieces():
    """An excerpt that is there whole costs no pieces and no index of the text; many searches of a text go by its index."""
    text = locate.folded("第一条　编制　施工组织设计；质量、安全与进度须全部响应。" * 3 + "末尾另有六个字")
    locate.candidates.cache_clear()
    assert locate.located(text, "编制施工组织设计，质量安全与进度")[2:] == (15, False)
    assert locate.candidates.cache_info().misses == 0 and not any("grams" in vars(x) for x in text)
    hits = {locate.located(text, "末尾另有，六个字") for _ in range(2 * locate.INDEXED)}
    assert len(hits) == 1 and all("grams" in vars(x) for x in text)


def test_walk_plans_hold_one_level(spark):
    """A chain of forty nodes, a cycle, a node without parent: no plan grows with the levels."""
    rows = [(f"n{k}", f"n{k - 1}" if k else None, 1, f"t{k}") for k in range(40)] + [("a", "b", 1, "a"), ("b", "a", 1, "b"), ("o", "gone", 1, None)]
    walked = trees.walk(spark.createDataFrame(rows, "id string, parent_id string, sort_order int, title string"))
    assert {r["id"]: r["depth"] for r in walked.collect()} == {f"n{k}": k + 1 for k in range(40)} | {"o": 1}
    assert "Join" not in walked._jdf.queryExecution().executedPlan().toString()


def test_nested_outlines(spark):
    import json

    rows = [("r", None, 1, 'q"', 1), ("b", "r", 2, "b", 2), ("a", "r", 2, None, 3), ("c", "a", None, "c", 4), ("s", "gone", 0, "s", 5)]
    got = {r["root_id"]: json.loads(r["json"]) for r in outlines.nested(spark.createDataFrame(rows, "id string, parent_id string, sort_order int, title string, n int"), ["id", "title", "n"]).collect()}
    leaf = lambda i, t, n: {"id": i, "title": t, "n": n, "children": []}
    assert got == {"r": leaf("r", 'q"', 1) | {"children": [leaf("a", None, 3) | {"children": [leaf("c", "c", 4)]}, leaf("b", "b", 2)]}, "s": leaf("s", "s", 5)}
    assert outlines.nested(spark.createDataFrame([], "id string, parent_id string, sort_order int, title string, n int"), ["id"]).count() == 0


def test_free_numbers(spark):
    rng = random.Random(6)
    for least in (1, 2):
        used = [(g, n) for g in "ab" for n in rng.sample(range(15), 6)]
        asked = [(g, j, f"{g}{j}") for g in "abc" for j in range(1, 12)]
        got = outlines.free_numbers(spark.createDataFrame(asked, "g string, j long, name string"), spark.createDataFrame(used, "g string, number long"), ["g"], least)
        for r in got.collect():
            free = [n for n in range(least, 60) if (r["g"], n) not in used]
            assert r["number"] == free[r["j"] - 1] and r["name"] == f"{r['g']}{r['j']}"


def test_unique_ids(spark):
    rows = [("p", 1, "a", None), ("p", 2, "a", None), ("p", 3, "b", "a"), ("p", 4, "b", "a"), ("p", 5, "a-r2", None), ("p", 6, " ", "b"), ("p", 7, "a", None), ("p", 8, "a.1", None), ("q", 1, "a", "a"), ("q", 2, None, "a")]
    got = outlines.unique_ids(spark.createDataFrame(rows, "project_id string, pos long, id string, parent_id string")).orderBy("project_id", "pos").collect()
    # a-r2 is held by a node, so the copies of a take 3 and 4; a's children go with its last copy; b's copy is a child of a
    assert [tuple(r)[1:] for r in got] == [
        (1, "a", None, None), (2, "a-r3", None, "a"), (3, "b", "a-r4", None), (4, "a.2", "a-r4", "b"), (5, "a-r2", None, None), (6, "outline-6", "a.2", None), (7, "a-r4", None, "a"),
        (8, "a.1", None, None), (1, "a", "a", None), (2, "outline-2", "a", None),
    ]


def branch(nodes, taken):
    """branch_ids() in plain Python, node by node. nodes: (uid, branch_id, id, parent_id, level, sort_order)."""
    text = lambda x: (x or "").strip()
    below = lambda i, b: i == b or i.startswith(f"{b}.")
    out = {}
    for b in {n[1] for n in nodes}:
        of = sorted((n for n in nodes if n[1] == b), key=lambda n: (n[4] or 99, n[5] or 0, text(n[2]), n[0]))
        kept, first = {}, {}
        for k, n in enumerate(of):
            i = text(n[2])
            if i == b or i and below(i, b) and i not in first and i not in taken:
                kept[k] = i
            if i:
                first.setdefault(i, k)
        held = set(kept.values()) | taken
        earliest = {}
        for k, i in kept.items():
            earliest.setdefault(i, k)
        last = {text(n[2]): k for k, n in enumerate(of) if k not in kept and text(n[2])}
        new, used = {}, set()
        for k, n in enumerate(of):  # the ids that renamed nodes have for their parents
            p = text(n[3])
            if k not in kept and not (p in last and last[p] < k):
                held = held | {p if p and below(p, b) else b}
        for k, n in enumerate(of):
            if k in kept:
                continue
            p = text(n[3])
            up = last.get(p)
            moved = up is not None and up < k
            base = new[up] if moved else p if p and below(p, b) else b
            number = 1
            while f"{base}.{number}" in used or not moved and any(below(h, f"{base}.{number}") for h in held):
                number += 1
            new[k] = f"{base}.{number}"
            used.add(new[k])
        for k, n in enumerate(of):
            i, p = kept.get(k) or new[k], text(n[3])
            up = last.get(p)
            stays = p and below(p, b) and (p == b or p in taken or p in earliest and earliest[p] < k)
            parent = "top" if i == b else new[up] if up is not None and up < k else p if stays else b
            out[n[0]] = (i, parent, None if k in kept else text(n[2]))
    return out


@pytest.mark.parametrize("seed", range(3))
def test_branch_ids(spark, seed):
    rng = random.Random(seed)
    nodes = []
    for uid in range(400):
        b = rng.choice(["1", "2", "10"])
        level = rng.choice([1, 2, 3, 4, 5, None])
        pick = lambda: rng.choice([None, " ", b, f"{b}.{rng.randint(1, 9)}", f"{b}.{rng.randint(1, 4)}.{rng.randint(1, 4)}", f"x{rng.randint(1, 20)}", f"x{rng.randint(1, 20)}", "2.07"])
        nodes.append((uid, b, pick(), pick(), level, rng.randint(0, 3) if rng.random() < 0.9 else None))
    taken = {"1.2", "1.7.3", "2.2.2", "9"}
    # ties of key are told apart by their place, so one partition
    df = spark.createDataFrame(nodes, "uid long, branch_id string, id string, parent_id string, level int, sort_order int").coalesce(1).withColumn("branch_parent", F.lit("top"))
    got = outlines.branch_ids(df, spark.createDataFrame([(t,) for t in taken], "id string"))
    assert got.columns == [*df.columns, "old_id"]
    found = {r["uid"]: (r["id"], r["parent_id"], r["old_id"]) for r in got.collect()}
    assert found == branch(nodes, taken)
    for b in ("1", "2", "10"):
        ids = [found[n[0]][0] for n in nodes if n[1] == b and found[n[0]][0] != b]
        assert len(ids) == len(set(ids)) and all(i.startswith(f"{b}.") for i in ids)


def test_long_chains_take_few_rounds(spark):
    """A branch of a chain of renamed nodes: as many rounds as the logarithm of its length."""
    nodes = spark.createDataFrame([("1", "top", f"x{k}", f"x{k - 1}", k + 1, 0) for k in range(300)], "branch_id string, branch_parent string, id string, parent_id string, level int, sort_order int")
    found = {r["old_id"]: r["id"] for r in outlines.branch_ids(nodes).collect()}
    assert found == {f"x{k}": "1" + ".1" * (k + 1) for k in range(300)}


def test_stored_tables_are_cleared(spark):
    from pathlib import Path

    from tessella.operators import stored

    kept = stored.stored(spark.range(3).withColumn("k", F.col("id") % 2), "t", "k")
    assert sorted(r["id"] for r in kept.where("k = 0").collect()) == [0, 2]
    tables = Path(stored.folder(spark).removeprefix("file:").replace("//", "/")) / "tables"
    assert list(tables.iterdir()) and stored.clear(spark) and not tables.exists() and not stored.clear(spark)
