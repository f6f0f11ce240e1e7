"""Queries on tables of a few rows, and what their plans move."""

import re
import time

import pandas as pd
from pyspark.sql import functions as F

from tessella.functions import text as tx
from tessella.operators import consistency, context, coverage, ordered, outlines, projects, retrieval, sections, trees
from tessella.operators.stored import stored
from tessella.plans import flow_queries, relational_queries, text_queries


def test_never_ordered(spark, tmp_path):
    """An order of any priority and state is an order."""
    spark.createDataFrame([(1,), (2,), (3,)], "c_custkey long").write.parquet(f"{tmp_path}/customer.parquet")
    spark.createDataFrame([(1, "1-URGENT", "F"), (2, "5-LOW", "O")], "o_custkey long, o_orderpriority string, o_orderstatus string").write.parquet(f"{tmp_path}/orders.parquet")
    assert [r[0] for r in relational_queries.QUERIES["h02_never_ordered"](spark, str(tmp_path)).collect()] == [3]


def test_mandatory_elements_by_first_row(spark):
    """Rows of a document against elements: plain ones stop at the first row, noun and verb may stand in different rows; no
    row is made for a pair of an element and a text."""
    docs = spark.createDataFrame([(1, "a b — c"), (1, "提供施工方案"), (1, "我方满足"), (1, None), (2, None)], "project_id long, text string")
    asked = [(1, "x", "t", "abc|zz|b", "pending"), (1, "y", None, "施工方案须响应文件要求", "pending"), (1, "i", "t", "zz", "ignored"), (1, "n", "t", None, None), (2, "y", "t", "施工方案须响应文件要求|q", None), (3, "x", "t", "q", "pending"), (None, "x", "t", "q", "pending")]
    found = projects.mandatory_elements(docs, spark.createDataFrame(asked, "project_id long, id string, title string, elements string, status string"))
    got = {(r["project_id"], r["id"]): list(r["missing"]) for r in found.collect()}
    covers = {r[0]: r[1] for r in spark.sql("SELECT 1 AS k, '提供施工方案\n我方满足' AS t").select("k", tx.phrase_covered(F.col("t"), F.lit("施工方案须响应文件要求"))).collect()}[1]
    assert got == {(1, "x"): ["zz"], (2, "y"): ["q", "施工方案须响应文件要求"]} | ({} if covers else {(1, "y"): ["施工方案须响应文件要求"]})
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Join LeftAnti" in plan and "Contains" in plan.replace("contains", "Contains")


def _shuffled(spark):
    """The shuffles whose files are on disk."""
    files = spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager().getAllFiles()
    return {m[1] for k in range(files.size()) if (m := re.match(r"shuffle_(\d+)_.*data$", files.apply(k).getName()))}


def test_stored_tables_leave_no_shuffles(spark):
    """What a stored table was shuffled for is deleted when it is written; the session's setting stays as it was."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before, set_ = _shuffled(spark), spark.conf.get(key)
    found = stored(spark.range(1000).selectExpr("id % 7 AS k").groupBy("k").count(), "counts")
    for _ in range(100):
        if not (left := _shuffled(spark) - before):
            break
        time.sleep(0.1)
    assert not left and spark.conf.get(key) == set_
    assert {tuple(r) for r in found.collect()} == {(k, 143 if k < 6 else 142) for k in range(7)}


def test_project_findings_one_check_after_the_other(spark):
    """Of all checks no shuffle is left and each reads stored chapters and requirements; those asked for alone are the same and
    store nothing."""
    leaves = spark.createDataFrame([(k % 3, f"L{k}", f"title {k}", "TODO words" if k % 2 else "满足要求 " + "x" * 30 * (k % 5), k, f'["{k % 4}"]') for k in range(20)], "project_id long, id string, title string, content string, sort_order int, requirement_ids string")
    asked = spark.createDataFrame([(k % 3, f"{k % 4}", f"asks {k}", f"word{k}", f"a{k}|words", None, k % 2, "pending") for k in range(12)], "project_id long, id string, title string, keyword string, elements string, risk_hint string, is_risk int, status string")
    leaves, asked = leaves.repartition(3, "id"), asked.repartition(3, "id")
    before = _shuffled(spark)
    found = projects.project_findings(leaves, asked)
    for _ in range(100):
        if not (left := _shuffled(spark) - before):
            break
        time.sleep(0.1)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert not left and "Join" not in plan and plan.count("Relation ") == len(projects.CHECKS)
    of = lambda df: sorted(map(tuple, df.collect()))
    rows = of(found)
    assert {r[1] for r in rows} >= {"project_template_residue", "project_scoring_coverage", "project_mandatory", "project_title_keywords"}
    apart = projects.project_findings(leaves, asked, most=4000)
    assert apart._jdf.queryExecution().optimizedPlan().toString().count("Relation ") >= 2 * len(projects.CHECKS) and of(apart) == rows
    for check in projects.CHECKS:
        alone = projects.project_findings(leaves, asked, (check,))
        assert of(alone) == [r for r in rows if r[1] == check]
        assert "Relation " not in alone._jdf.queryExecution().optimizedPlan().toString()


def test_siblings_join_last(spark):
    """The titles of siblings, which grow with the square of a family, pass no shuffle."""
    nodes = [("p", "t", None, 0, "top", 0), *(("p", f"c{k}", "t", k, f"n{k}", 1) for k in range(50))]
    df = spark.createDataFrame(nodes, "project_id string, id string, parent_id string, sort_order int, title string, is_leaf int").selectExpr("*", "CAST(NULL AS STRING) AS last_summary", "CAST(NULL AS STRING) AS content", "CAST(NULL AS STRING) AS requirement_ids", "CAST(NULL AS STRING) AS writing_guidance")
    asked = spark.createDataFrame([], "id string, title string, keyword string, elements string, score double, is_risk int, category string, evidence string, hint string, source string")
    facts = spark.createDataFrame([], "project_id string, title string, content string, sort_order int")
    for found in (context.neighbours(df), context.bundles(df, asked, facts)):
        assert {r["id"]: r["sibling_titles"] for r in found.collect()} == {f"c{k}": [f"n{j}" for j in range(50) if j != k] for k in range(50)}
        lines = found._jdf.queryExecution().optimizedPlan().toString().splitlines()
        made = next(k for k, x in enumerate(lines) if "slice(" in x and "_all" in x)
        assert not any(x.strip(" :+-").startswith(("Join", "Window", "Repartition", "Aggregate")) for x in lines[:made])


def test_sibling_texts_are_cut_from_one(spark):
    """A sibling's title is not touched by itself for each of the others: texts of siblings are bytes cut out of their family's
    text, and a family is dealt out to more than one place. Titles are blank, null, wide and alike, parents and projects null."""
    kinds = ["甲乙丙丁", " x ", "", None, "ab", "ab"]
    leaves = [("p", f"c{k}", "t", k, kinds[k % 6], 1) for k in range(150)] + [("q", "d0", "u", 0, "", 1), ("q", "d1", "u", 1, "é", 1), ("q", "e", "v", 0, "alone", 1), (None, "f0", None, 0, "f", 1), (None, "f1", None, 1, "施", 1), ("q", "g", None, 2, "施", 1)]
    nodes = [("p", "t", None, 0, "top", 0), ("q", "u", None, 0, "u", 0), ("q", "v", None, 1, "v", 0), *leaves]
    df = spark.createDataFrame(nodes, "project_id string, id string, parent_id string, sort_order int, title string, is_leaf int").selectExpr("*", "CAST(NULL AS STRING) AS last_summary", "CAST(NULL AS STRING) AS content", "CAST(NULL AS STRING) AS requirement_ids", "CAST(NULL AS STRING) AS writing_guidance")
    asked = spark.createDataFrame([], "id string, title string, keyword string, elements string, score double, is_risk int, category string, evidence string, hint string, source string")
    told, bundled = context.neighbours(df), context.bundles(df, asked, spark.createDataFrame([], "project_id string, title string, content string, sort_order int"))
    titles = {x[1]: [(y[4] or "").strip() for y in leaves if y[:3:2] == x[:3:2] and y[1] != x[1]] for x in leaves}
    for found in (told, bundled):
        got = {r["id"]: r for r in found.collect()}
        assert {k: r["sibling_titles"] for k, r in got.items()} == titles and {k: r["sibling_text"] for k, r in got.items()} == {k: "|".join(x) for k, x in titles.items()}
    for k, r in got.items():
        if leaves[[x[1] for x in leaves].index(k)][4] is not None:
            assert r["content_boundary"].endswith(f"不得涉及兄弟章节：{'、'.join(titles[k])}。" if titles[k] else "不重复上一章摘要。")
    places = lambda f: bundled.where("project_id = 'p'").select(F.spark_partition_id().alias("k"), f).distinct().select("k").distinct().count()
    assert places("content_boundary") > 1
    for plan in (told.select("id", F.md5("sibling_text")), bundled.select("id", F.md5("content_boundary"))):
        lines = plan._jdf.queryExecution().optimizedPlan().toString().splitlines()
        assert not any("slice(" in x for x in lines)


def test_bm25_deals_texts_by_id_alone(spark):
    """Terms are counted and scores summed where a text lies: no shuffle by id and term, nor by query and id."""
    corpus = spark.createDataFrame([(k, f"alpha beta word{k} word{k}") for k in range(9)], "id long, text string")
    found = retrieval.bm25(corpus, spark.createDataFrame([(1, "word3 alpha")], "query_id long, text string"))
    plan = re.sub(r"#\d+L?", "", found._jdf.queryExecution().executedPlan().toString())
    assert "hashpartitioning(id, dl" not in plan and "hashpartitioning(query_id, id" not in plan and "hashpartitioning(id, " in plan
    assert [(r["query_id"], r["id"]) for r in found.where("rank = 1").collect()] == [(1, 3)]


def test_nearest_in_length(spark, tmp_path):
    """Thirty documents of each of three lengths: a passage's first twenty are the least ids of the nearest length."""
    spark.createDataFrame([(k, "t", 10 * (k % 3 + 1)) for k in range(90)], "doc_id long, text string, n_chars int").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "x" * 19)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    found = relational_queries.QUERIES["l08_rrf"](spark, str(tmp_path))
    assert sorted((r["rank"], r["id"]) for r in found.collect()) == [(k + 1, 3 * k + 1) for k in range(5)]


def _lowest(plan, *kinds):
    """The line of a plan's last node of some kinds."""
    return max(k for k, x in enumerate(plan) if x.strip(" :+-").startswith(kinds))


def test_extraction_chunks_move_lengths(spark):
    """Texts are measured below every shuffle, window and sort, and rows are dealt out once."""
    items = [(1, 1, 1, "x" * 9), (1, 20, 2, " xx "), (1, 20, 3, "x" * 9), (1, 40, 4, None), (2, 50, 1, "x" * 9), (2, 50, 2, "xx"), (None, 3, 1, "x")]
    df = spark.createDataFrame(items, "doc long, page int, pos int, text string")
    found = ordered.extraction_chunks(df, "doc", most=10)
    assert sorted(tuple(r) for r in found.where("doc IS NOT NULL").collect()) == [(1, 1, 0, 0), (1, 2, 1, 0), (1, 3, 1, 1), (1, 4, 2, 0), (2, 1, 0, 0), (2, 2, 0, 1)]
    plan = found._jdf.queryExecution().optimizedPlan().toString().splitlines()
    assert min(k for k, x in enumerate(plan) if "length(" in x) > _lowest(plan, "Window", "Repartition", "Sort")
    assert sum("Repartition" in x for x in plan) == 1


def test_section_names_sort_lines_once(spark):
    """Both kinds of sections come from one pass over the lines, with one sort."""
    said = ["简历", "张三负责质量管理", "组织架构", "李四负责安全管理", "", "", "", "王五负责安全管理"]
    lines = spark.createDataFrame([(1, k, x) for k, x in enumerate(said)], "id long, pos int, line string")
    found = sections.names_by_kind(lines, {"resume": sections.RESUMES, "chart": sections.CHARTS})
    assert sorted(tuple(r) for r in found.collect()) == [("chart", 1, "李四"), ("resume", 1, "张三"), ("resume", 1, "李四")]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"\bSort \[", plan.split("Initial Plan")[0])) == 1


def test_lexical_items_score_where_they_are_read(spark):
    """Neither texts nor terms nor pairs of a query and an item are shuffled before pairs are ranked, by query."""
    items = [("f", 1, "alpha", None, "beta gamma", 3), ("f", 2, "x1", "beta", "alphabet", 2), ("f", 3, None, None, "nothing", 1), ("g", 4, "alpha", "alpha", "alpha", 0), (None, 5, "alpha", None, "alpha", 0)]
    asked = [(1, "f", "alpha beta"), (2, "g", "alpha"), (3, "f", "!"), (4, None, "alpha"), (5, "h", "alpha")]
    df = spark.createDataFrame(items, "folder string, id long, title string, resume string, content string, sort_order int")
    found = retrieval.lexical_items(df, spark.createDataFrame(asked, "query_id long, folder string, text string"))
    got = {(r["query_id"], r["id"]): (r["score"], r["rank"]) for r in found.collect()}
    assert set(got) == {(1, 1), (1, 2), (2, 4)} and got[1, 1][1] == 1 and got[1, 1][0] > 5 and got[1, 2][0] > 3
    plan = re.sub(r"#\d+L?", "", found._jdf.queryExecution().executedPlan().toString())
    assert set(re.findall(r"hashpartitioning\(([^)]*), \d+\)", plan)) == {"folder", "query_id"}  # the folders asked for, and ranks


def test_matrix_moves_packed_rows(spark):
    """What is asked of a leaf goes to it as strings, elements with and without a verb of compliance alike; issues are not
    joined with leaves again."""
    asked = [("a", "t", None, "x y|-|响应文件要求", None, 0, "pending"), ("b", "alpha", "k1/k2", None, None, 1, "pending"), ("c", "", None, "zz", None, 0, "pending"), ("d", "q", None, "a", None, 0, "ignored")]
    req = spark.createDataFrame(asked, "id string, title string, keyword string, elements string, score double, is_risk int, status string")
    leaves = spark.createDataFrame([("L1", "one", "满足文件要求 xy", '["a","b","a"]'), ("L2", "two", "k2", '["b","d"]'), ("L3", "three", " ", '["b","c"]'), ("L4", "four", None, '["d"]')], "id string, title string, content string, requirement_ids string")
    found = coverage.response_matrix(req, leaves)
    got = {r["id"]: (r["status"], r["n_bound"], r["n_matched"], list(r["missing"])) for r in found.collect()}
    assert got["b"] == ("covered", 3, 1, []) and got["c"] == ("bound_pending", 1, 0, ["zz"]) and got["d"][0] == "ignored" and got["a"][3] == ["-"]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert re.search(r"collect_list\(struct\(requirement_id, requirement_id#\d+, forms, forms#\d+, es, es#\d+", plan)
    issues = consistency.matrix_issues(req, leaves)
    assert {(r["leaf_id"], r["requirement_id"]) for r in issues.collect()} == {("L1", "a"), ("L3", None)}
    assert issues._jdf.queryExecution().optimizedPlan().toString().count("Join Inner, (leaf_id") == 1  # that of the matrix


def test_assigned_requirements_shuffle_by_leaf_alone(spark):
    """A requirement with two texts goes by the better one; claimed ones stay with all who claim them."""
    children = spark.createDataFrame([(1, 1, "aa bb", ["r1"]), (1, 2, "cc", ["r1", "x"]), (1, 3, "cc dd", None), (2, 1, "aa", [])], "leaf_id long, pos int, text string, claimed array<string>")
    asked = spark.createDataFrame([(1, "r1", "dd"), (1, "r2", "aa"), (1, "r2", "cc dd"), (1, "r3", None), (3, "r4", "aa")], "leaf_id long, requirement_id string, text string")
    found = outlines.assigned_requirements(children, asked)
    assert sorted(tuple(r) for r in found.collect()) == [(1, 1, "r1"), (1, 1, "r3"), (1, 2, "r1"), (1, 3, "r2")]
    plan = re.sub(r"#\d+L?", "", found._jdf.queryExecution().executedPlan().toString())
    assert set(re.findall(r"hashpartitioning\(([^)]*), \d+\)", plan)) == {"leaf_id"}


def test_phrases_normalise_a_text_once(spark, sf_dir):
    found = text_queries.QUERIES["i04_phrase_covered"](spark, sf_dir)
    assert found._jdf.queryExecution().optimizedPlan().toString().count("，,。；;：:（）") == 1


def test_depth_first_by_ranges(spark):
    """A tree is no group of its own: one of a hundred nodes is ranked in ranges of paths."""
    nodes = [("r", None, 1, "t"), ("s", None, 0, "t"), *((f"n{k:02d}", "r", k % 7, "t") for k in range(98)), ("x", "n00", 0, "t")]
    ranked = trees.depth_first(trees.walk(spark.createDataFrame(nodes, "id string, parent_id string, sort_order int, title string")))
    order = [r["id"] for r in sorted(ranked.collect(), key=lambda r: r["rank"])]
    kids = [f"n{k:02d}" for k in sorted(range(98), key=lambda k: (k % 7, k))]
    assert order == ["s", "r", "n00", "x", *kids[1:]]
    plan = ranked._jdf.queryExecution().optimizedPlan().toString()
    assert "root_id ASC" not in plan and not re.search(r"windowspecdefinition\(root_id", plan)


def test_files_are_written_block_by_block(spark, tmp_path):
    """However many blocks a partition has, a writer sees one at a time."""
    docs = [(k, f"t{k}") for k in range(120)]
    spark.createDataFrame(docs, "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    write = flow_queries._write(f"file://{tmp_path}/out")
    for block in range(3):
        write(pd.DataFrame([(block, *d) for d in reversed(docs) if d[0] // 50 == block], columns=["block", "doc_id", "text"]))
    assert (tmp_path / "out/b000000000001.txt").read_text() == "\n\n".join(f"t{k}" for k in range(50, 100))
    assert {r["name"] for r in flow_queries.QUERIES["a15_reference_texts"](spark, str(tmp_path)).collect()} == {"b000000000000.docx", "b000000000001.txt", "b000000000002.md"}
