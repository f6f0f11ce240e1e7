"""Contexts and checks of projects against plain Python or by hand."""

import random
import re

from pyspark.sql import functions as F

from tessella.functions import text as tx
from tessella.operators import consistency, context, ordered, projects


def test_project_findings(spark):
    text = "D+30、D + 200 及D+90；工期150天，D+90；团队配备12人，另有一段离题很远很远很远很远很远很远很远的话30人。合同200万元，押金1000元。"
    rows = [(1, 60, 1000.0, text), (2, 60, None, text), (3, None, 1e9, text), (4, 0, -1.0, text), (5, 300, 1e9, "D+1 团队1人"), (6, 10, 10.0, None), (7, 100, 1_234_567.5, "专家十余3位、4 人")]
    got = {}
    for r in consistency.cross_consistency(spark.createDataFrame(rows, "project_id long, duration_days int, budget double, text string")).collect():
        got.setdefault(r["project_id"], []).append((r["level"], r["message"]))
    days = [("fail", "D+200 明显超出总工期 60 天（超 140 天）"), ("warn", "D+90 超出总工期 60 天，若属评审配合节点请人工复核"), ("warn", "正文工期数字 150 天与全局 60 天偏差过大")]
    cost = ("fail", "团队成本估算 540,000 元（12 人×50%×60 天×1500 元/人·天），合同预算 1,000 元")
    assert sorted(got[1]) == sorted([*days, cost, ("fail", "正文金额 [2000000.0] 元大幅超出预算（10 倍以上）")])
    assert sorted(got[2]) == sorted(days) and 3 not in got and 4 not in got and 6 not in got
    assert ("pass", "D+N 节点均在 300 天工期内") in got[5] and ("pass", "团队成本估算 300,000 元（4 人×50%×100 天×1500 元/人·天），合同预算 1,234,568 元") in got[7]
    assert {r["severity"] for r in consistency.cross_findings(spark.createDataFrame(rows[:1], "project_id long, duration_days int, budget double, text string")).collect()} == {"block", "warn"}


def test_findings_of_all_project_checks(spark):
    """Keywords of titles and coverage are among the findings; two projects share the id of a requirement, but not what it asks."""
    requirements = [
        (1, "a", "消防演练", "应急，疏散", "zz", None, 0, "pending"), (2, "a", "绿化养护", "苗木", None, None, 1, "pending"), (2, "b", "道路 照明", "电缆", None, None, 0, "confirmed"), (2, "c", "排水 管网", None, None, None, 0, "pending"),
        (2, "d", "xyz", "xyz", None, None, 0, "ignored"), (3, "a", "没有文件", None, None, None, 0, "pending"),
    ]
    leaves = [
        (1, "L1", "疏散组织", "TODO 应急", 1, '["a"]'), (1, "L2", "其他", "x", 2, '["a","a","gone"]'), (2, "L1", "概述", "绿化养护和电缆", 1, '["b","a"]'),
        (2, "L2", None, "道路", 2, '["b"]'), (2, "L3", "苗木", None, 3, '["a"]'), (2, "L4", "y", " ", 4, "broken"),
    ]
    requirements = spark.createDataFrame(requirements, "project_id long, id string, title string, keyword string, elements string, risk_hint string, is_risk int, status string")
    leaves = spark.createDataFrame(leaves, "project_id long, id string, title string, content string, sort_order int, requirement_ids string")
    found = projects.project_findings(leaves, requirements).collect()
    of = lambda check: sorted((r["project_id"], r["severity"], r["message"]) for r in found if r["check_id"] == check)
    assert of("project_title_keywords") == [(1, "warn", "章节「其他」标题未覆盖关键词：应急/疏散"), (2, "warn", "章节「」标题未覆盖关键词：电缆"), (2, "warn", "章节「概述」标题未覆盖关键词：电缆/苗木")]
    assert of("project_scoring_coverage") == [(2, "block", "排水 管网（missing）")]
    alone = requirements.where("id <> 'b'").union(requirements.where("id = 'b'").selectExpr("project_id", "id", "title", "'桥梁'", "elements", "risk_hint", "is_risk", "status"))
    assert ("道路 照明（partial）", "warn") in {(r["message"], r["severity"]) for r in projects.project_findings(leaves, alone).collect()}
    assert {r["check_id"] for r in found} == set(projects.CHECKS)


def test_team_sizes(spark):
    rng = random.Random(1)
    texts = ["".join(rng.choice(["团队", "专家", "3人", "12 位", "字", "字字字字字字字字", "7", "人", "，", "\n"]) for _ in range(rng.randint(0, 30))) for _ in range(300)]
    plain = lambda t: [int(m[1]) for m in re.finditer(r"(\d+)\s*(?:人|位)", t) if any(w in t[max(0, m.start() - 20) : m.start()] for w in consistency.TEAM)]
    got = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string").select("k", consistency.team_sizes(F.col("t")).alias("n"))
    assert {r["k"]: r["n"] for r in got.collect()} == {k: plain(t) for k, t in enumerate(texts)}


def test_grounds_for_exclusion(spark):
    projects = spark.createDataFrame([(1, "此处XXX，我公司必将中标"), (2, "clean"), (3, None)], "project_id long, text string")
    items = [(1, 1, "暗标要求", "d" * 81), (1, 2, "", None), (2, None, "其他", "未提供证明"), *((3, k, None, f"说明{k}") for k in range(1, 12)), (9, 1, "保证金", None)]
    got = sorted(map(tuple, consistency.disqualification(projects, spark.createDataFrame(items, "project_id long, seq int, label string, description string")).collect()), key=str)
    of = lambda p: [r[1:2] + r[4:] for r in got if r[0] == p]
    assert of(1) == [(1, "block", "废标条款「暗标要求」存在正文风险：疑似模板/占位残留，对照废标条款", "d" * 77 + "…")]
    assert of(2) == [(None, "warn", "请人工核对废标条款#None「其他」：未提供证明", "未提供证明")]
    assert sorted(r[0] for r in of(3)) == list(range(1, 9)) and {r[1] for r in of(3)} == {"info"}
    assert of(9) == [(1, "warn", "请人工核对废标条款#1「保证金」：", "")]


def test_matrix_issues(spark):
    requirements = spark.createDataFrame([("a", "消防演练", None, "应急照明|疏散通道", "confirmed", 1), ("b", "绿化养护", None, None, "pending", 0), ("c", "x", None, "zz", "ignored", 1)], "id string, title string, keyword string, elements string, status string, is_risk int")
    leaves = spark.createDataFrame([("1", "t1", "应急照明", '["a","b","c"]'), ("2", "t2", "疏散通道与绿化养护", '["a"]'), ("3", "t3", " ", '["a","b"]'), ("4", "t4", "其他", '["b"]'), ("5", "t5", None, '["c"]'), ("6", "t6", "x", "broken")], "id string, title string, content string, requirement_ids string")
    got = sorted(map(tuple, consistency.matrix_issues(requirements, leaves).collect()), key=str)
    assert got == [
        ("1", "a", "刚性风险项「消防演练」关键词未在正文中体现（期望：消防演练）"), ("1", "b", "评分项「绿化养护」关键词未在正文中体现（期望：绿化养护）"), ("2", "a", "刚性风险项「消防演练」关键词未在正文中体现（期望：消防演练）"),
        ("3", None, "评分覆盖：章节「t3」正文为空，无法覆盖已绑定评分项"), ("4", "b", "评分项「绿化养护」关键词未在正文中体现（期望：绿化养护）"),
    ]
    some = requirements.withColumn("elements", F.lit("应急照明|避难层"))
    assert {r["issue"] for r in consistency.matrix_issues(some, leaves).where("leaf_id = '1' AND requirement_id = 'a'").collect()} == {"刚性风险项「消防演练」评分覆盖不足：缺少必备要素 避难层"}


def test_neighbours(spark):
    """Frames of five summaries and three bodies over leaves that have one, blank ones between; siblings; two projects."""
    rng = random.Random(2)
    nodes, leaves = [], []
    for p in "pq":
        for k in range(4):
            nodes.append((p, f"{p}{k}", None, k, f"top {k}", 0, None, None))
            for j in range(6):
                said, body = rng.choice([None, " ", f"s{p}{k}{j}"]), rng.choice([None, "short", "b" * 119, f" {p}{k}{j}" + "x" * 130, "y" * 3000])
                leaves.append((p, f"{p}{k}.{j}", f"{p}{k}", j, f"t{k}{j}", 1, said, body))
    df = spark.createDataFrame(nodes + leaves, "project_id string, id string, parent_id string, sort_order int, title string, is_leaf int, last_summary string, content string")
    got = {r["id"]: r for r in context.neighbours(df).collect()}
    assert len(got) == len(leaves)
    for p in "pq":
        own = [x for x in leaves if x[0] == p]
        for k, x in enumerate(own):
            r, before = got[x[1]], own[:k]
            assert r["place"] == k + 1 and r["last_summary"] == (own[k - 1][6] if k else None)
            assert r["prior_summaries"] == [f"「{b[4]}」{b[6].strip()}" for b in before if (b[6] or "").strip()][-5:]
            assert r["prior_contents"] == [b[7].strip()[:2500] for b in before if len((b[7] or "").strip()) >= 120][-3:]
            sib = [b for b in own if b[2] == x[2]]
            assert r["sibling_titles"] == [b[4] for b in sib if b[1] != x[1]]
            prior = sib[sib.index(x) - 1] if sib.index(x) else None
            body = (prior[7] or "").strip() if prior else ""
            assert r["prior_title"] == (prior[4] if prior else None) and r["prior_body"] == ((context.CUT + body[-1500:] if len(body) > 1500 else body) or None)


def test_second_search(spark):
    first = spark.createDataFrame([(1, "q"), (2, "q"), (3, "q")], "id long, query string")
    found = spark.createDataFrame([(1, 2, "b"), (1, 1, "a"), (2, 1, "a")], "id long, rank int, text string")
    reasons = spark.createDataFrame([(3, "no_folder")], "id long, reason string")
    material = context.with_material(first, found, reasons)
    more = spark.createDataFrame([(1, 1, "b"), (1, 2, "c"), (1, 3, "c"), (1, 4, ""), (3, 1, "z"), *((1, 9 + k, f"n{k}") for k in range(9))], "id long, rank int, text string")
    got = {r["id"]: tuple(r)[2:] for r in context.with_more(material, more).collect()}
    assert got == {1: (context.APART.join(["a", "b", "c", *(f"n{k}" for k in range(5))]), 8, None, None), 2: ("a", 1, None, None), 3: ("z", 1, None, None)}
    assert {r["id"]: tuple(r)[2:] for r in material.collect()}[3] == ("", 0, "no_folder", context.NO_MATERIAL)


def test_extraction_chunks(spark):
    items = [("a", p, p, "x" * 30) for p in range(1, 40)] + [("b", 1, k, "y" * 40) for k in range(5)] + [("c", 20, 1, None), ("c", 50, 2, "z")]
    got = {(r["doc"], r["pos"]): (r["part"], r["chunk"]) for r in ordered.extraction_chunks(spark.createDataFrame(items, "doc string, page int, pos int, text string"), "doc", 15, 100).collect()}
    want = {("a", p): ((p - 1) // 15, ((p - 1) % 15) // 3) for p in range(1, 40)} | {("b", k): (0, k // 2) for k in range(5)} | {("c", 1): (0, 0), ("c", 2): (1, 0)}
    assert got == want


def test_long_white_space(spark):
    """A megabyte of blanks within, before and after a text."""
    blank = " \n\t　" * 250_000
    rows = [(1, "a" + blank + "b"), (2, blank), (3, blank + "a" + blank), (4, None)]
    got = {r["k"]: (r["s"], r["e"]) for r in spark.createDataFrame(rows, "k int, t string").select("k", tx.strip(F.col("t")).alias("s"), tx.rstrip(F.col("t")).alias("e")).collect()}
    assert got == {1: (rows[0][1], rows[0][1]), 2: ("", ""), 3: ("a", blank + "a"), 4: (None, None)}


def test_windows(spark):
    texts = ["", "a", "abc", "abcd", "é中😀b\nc", "ab" * 2000]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", tx.windows(F.col("t"), 3).alias("w")).collect()
    assert all(r["w"] == [r["t"][k : k + 3] for k in range(len(r["t"]) - 2)] for r in got)


def test_notices(spark):
    from tessella.operators import notices

    fields = "id long, name string, voltage_level string, capacity string, location string, project_type string, contract_mode string, engineering_domain string, extra_notes string, duration_days int, budget_yuan double, target_pages int, notice map<string,string>, confirmed array<string>"
    said = {"project_name": "N", "capacity": "", "duration_text": "约90天", "budget_yuan": "x", "target_pages": "7", "bid_domain": None, "tenderer": "T"}
    rows = [(1, "old", "v", "c", None, None, None, None, "notes", None, 1234500.0, None, said, None), (2, "old", None, None, None, None, None, "d", None, 60, None, 80, said, ["name", "duration_days", "target_pages"]), (3, None, *[None] * 12)]
    df = spark.createDataFrame(rows, fields)
    got = {r["id"]: r for r in notices.applied(df).collect()}
    assert (got[1]["name"], got[1]["capacity"], got[1]["duration_days"], got[1]["budget_yuan"], got[1]["target_pages"]) == ("N", "c", 90, 1234500.0, 10)
    assert (got[2]["name"], got[2]["duration_days"], got[2]["target_pages"]) == ("old", 60, 80) and got[3]["name"] is None
    forced = {r["id"]: r for r in notices.applied(df, force=True).collect()}
    assert (forced[2]["name"], forced[2]["duration_days"], forced[2]["target_pages"]) == ("N", 90, 10)
    back = {r["id"]: r["notice"] for r in notices.synced(df).collect()}
    assert set(back[1]) == set(notices.KEYS) and (back[1]["project_name"], back[1]["duration_text"], back[1]["budget_yuan"], back[1]["budget_wan"], back[1]["overview"], back[1]["tenderer"]) == ("old", "约90天", "1234500", "123.45", "notes", "T")
    assert (back[2]["bid_domain"], back[2]["duration_text"], back[2]["target_pages"], back[1]["bid_domain"]) == ("d", "60个日历天", "80", notices.DOMAIN) and back[3]["project_name"] is None
    raw = ['[{"seq":"3","description":" a "},{"source_text":"b","category":"k"},{"seq":2,"item_label":"l","description":"c","source_text":"d","source_page":"9"},{"seq":1},null]', "{}", None, "broken"]
    found = [r["g"] for r in spark.createDataFrame([(k, x) for k, x in enumerate(raw)], "k int, raw string").orderBy("k").select(notices.grounds(F.col("raw")).alias("g")).collect()]
    assert [tuple(g) for g in found[0]] == [(2, "k", "b", "b", None), (2, "l", "c", "d", 9), (3, "废标项", "a", "a", None)] and found[1:] == [[], [], []]


def test_hard_checks(spark):
    from tessella.operators import notices

    df = spark.createDataFrame([(1, "XXX公司负责，一律采用<甲方名称>，"), (2, "完整。"), (3, None)], "id long, content string")
    for scope in ("chapter", "segment"):
        got = {r["id"]: (r["errors"], r["notes"]) for r in notices.hard_checks(df, scope).collect()}
        blocked = [e for e, _ in got.values() if e]
        assert blocked and all(not n or scope == "chapter" for e, n in got.values() if e) and 2 not in {i for i, (e, _) in got.items() if e}
