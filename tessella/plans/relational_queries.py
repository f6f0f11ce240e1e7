"""Queries over joins, aggregates, windows, trees, sets, rankings and keyed state, each with its SQL."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import budget, coverage, retrieval, state, trees
from .inputs import cte, given, table

QUERIES, SQL = {}, {}
c = F.col


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


# --- retrieval -------------------------------------------------------------------------------------------------
_TOKENS = r"regexp_extract_all(text, '[\x{4e00}-\x{9fff}]{2,}|[A-Za-z0-9]{2,}')"
_BM25 = f"""words AS (SELECT doc_id AS id, {_TOKENS} AS ws FROM documents),
stats AS (SELECT count(*) AS n, avg(len(ws)) AS mean_length FROM words),
tf AS (SELECT id, dl, term, count(*) AS tf FROM (SELECT id, len(ws) AS dl, unnest(ws) AS term FROM words) GROUP BY ALL),
df AS (SELECT term, ln(n - count(*) + 0.5) - ln(count(*) + 0.5) AS idf FROM tf, stats GROUP BY term, n),
mean AS (SELECT avg(idf) AS m FROM df),
idf AS (SELECT term, CASE WHEN idf < 0 THEN 0.25 * m ELSE idf END AS idf FROM df, mean),
q AS (SELECT item_id AS query_id, term, count(*) AS qtf FROM (SELECT item_id, unnest({_TOKENS}) AS term FROM benchmark) GROUP BY ALL),
scores AS (SELECT query_id, id, round(sum(qtf * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / mean_length))), 6) AS score
  FROM q JOIN idf USING (term) JOIN tf USING (term), stats GROUP BY query_id, id),
lexical AS (SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM scores WHERE score > 0)"""


def _lexical(spark, sf_dir, top_k):
    corpus = table(spark, sf_dir, "documents").select(c("doc_id").alias("id"), "text")
    asked = table(spark, sf_dir, "benchmark").select(c("item_id").alias("query_id"), "text")
    return retrieval.bm25(corpus, asked, top_k)


@query("l01_bm25_top5", f"WITH {_BM25} SELECT query_id, id, score, CAST(rank AS INT) AS rank FROM lexical WHERE rank <= 5")
def bm25_top5(spark, sf_dir):
    return _lexical(spark, sf_dir, 5)


_COSINE = """vector AS (SELECT vec_id AS id, embedding FROM embeddings),
near AS (SELECT q.label AS query_id, v.id, round(list_dot_product(list_transform(v.embedding, lambda x: CAST(x AS DOUBLE)), list_transform(q.embedding, lambda x: CAST(x AS DOUBLE))), 6) AS score
  FROM vector v, (SELECT label, embedding FROM embeddings QUALIFY row_number() OVER (PARTITION BY label ORDER BY vec_id) = 1) q),
semantic AS (SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM near)"""


def _semantic(spark, sf_dir, top_k):
    vectors = table(spark, sf_dir, "embeddings")
    firsts = vectors.groupBy("label").agg(F.min_by("embedding", "vec_id").alias("embedding")).withColumnRenamed("label", "query_id")
    return retrieval.cosine(vectors.select(c("vec_id").alias("id"), "embedding"), firsts, top_k)


@query("l05_cosine_top5", f"WITH {_COSINE} SELECT query_id, id, score, CAST(rank AS INT) AS rank FROM semantic WHERE rank <= 5")
def cosine_top5(spark, sf_dir):
    return _semantic(spark, sf_dir, 5)


@query("l08_rrf", f"""WITH {_BM25}, a AS (SELECT * FROM lexical WHERE rank <= 20),
b AS (SELECT item_id AS query_id, doc_id AS id, row_number() OVER (PARTITION BY item_id ORDER BY abs(n_chars - length(b.text)), doc_id) AS rank FROM documents d, benchmark b),
f AS (SELECT coalesce(a.query_id, b.query_id) AS query_id, coalesce(a.id, b.id) AS id, a.rank AS r1, b.rank AS r2, round(coalesce(1.0 / (60 + CAST(a.rank AS DOUBLE)), 0) + coalesce(1.0 / (60 + CAST(b.rank AS DOUBLE)), 0), 9) AS score
  FROM a FULL JOIN (SELECT * FROM b WHERE rank <= 20) b ON a.query_id = b.query_id AND a.id = b.id)
SELECT query_id, id, score, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, r1 NULLS LAST, r2 NULLS LAST, id) AS rank FROM f) WHERE rank <= 5""")
def fused(spark, sf_dir):
    """The lexical ranking fused with one by nearness in length."""
    docs = table(spark, sf_dir, "documents").select(c("doc_id").alias("id"), "n_chars")
    # of documents of one length only the first twenty can be among a passage's first twenty
    docs = docs.withColumn("k", F.row_number().over(W.partitionBy("n_chars").orderBy("id"))).where("k <= 20").drop("k")
    asked = table(spark, sf_dir, "benchmark").select(c("item_id").alias("query_id"), F.length("text").alias("n"))
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.abs(c("n_chars") - c("n")), "id"))
    second = docs.join(F.broadcast(asked)).withColumn("rank", rank).where("rank <= 20").select("query_id", "id", "rank")
    return retrieval.rrf(_lexical(spark, sf_dir, 20), second)


@query("l13_retrieval_reason", """SELECT source AS folder, CASE WHEN count(*) FILTER (n_chars >= 2000) = 0 THEN 'knowledge_empty' WHEN count(*) FILTER (contains(text, 'Apache')) = 0 THEN 'no_match' END AS reason FROM documents GROUP BY source""")
def retrieval_reason(spark, sf_dir):
    by = table(spark, sf_dir, "documents").groupBy(c("source").alias("folder")).agg(F.count_if(c("n_chars") >= 2000).alias("k"), F.count_if(c("text").contains("Apache")).alias("hits"))
    return by.select("folder", F.when(c("k") == 0, "knowledge_empty").when(c("hits") == 0, "no_match").alias("reason"))


# --- sections and requirements -----------------------------------------------------------------------------------
_LEAVES = """leaf AS (SELECT 'L' || CAST(o_orderkey AS STRING) AS id, CASE WHEN o_orderpriority = '1-URGENT' THEN '工程概况' ELSE o_orderpriority END AS title,
  (SELECT string_agg(p_name, ' ' ORDER BY l_linenumber, p_partkey) FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_orderkey = o_orderkey AND l_returnflag <> 'A') AS content,
  (SELECT list(CAST(l_partkey AS STRING)) FROM lineitem WHERE l_orderkey = o_orderkey) AS ids FROM orders)"""


def _leaves(spark, sf_dir):
    items = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), c("l_partkey") == c("p_partkey"))
    by = items.groupBy("l_orderkey").agg(
        F.to_json(F.collect_list(c("l_partkey").cast("string"))).alias("requirement_ids"),
        F.array_sort(F.collect_list(F.when(c("l_returnflag") != "A", F.struct("l_linenumber", "p_partkey", "p_name")))).alias("names"),
    )
    orders = table(spark, sf_dir, "orders").join(by, c("o_orderkey") == c("l_orderkey"), "left")
    title = F.when(c("o_orderpriority") == "1-URGENT", "工程概况").otherwise(c("o_orderpriority"))
    content = F.array_join(c("names")["p_name"], " ")
    return orders.select(F.concat(F.lit("L"), c("o_orderkey").cast("string")).alias("id"), title.alias("title"), content.alias("content"), "requirement_ids")


_MATRIX = f"""{cte("requirement")}, {_LEAVES},
pair AS (SELECT r.id, l.id AS leaf_id, coalesce(l.content, '') AS content FROM leaf l, LATERAL (SELECT unnest(l.ids) AS rid) u, requirement r WHERE u.rid = r.id),
hit AS (SELECT p.*, trim(p.content) <> '' AS has_content,
  contains(replace(p.content, ' ', ''), replace(r.title, ' ', '')) OR EXISTS (SELECT 1 FROM (SELECT unnest(string_split_regex(r.keyword, '[,，/]') || string_split(r.title, ' ')) AS w) x WHERE length(replace(w, ' ', '')) >= 2 AND length(trim(w)) BETWEEN 2 AND 99 AND contains(replace(p.content, ' ', ''), replace(w, ' ', ''))) AS matched
  FROM pair p JOIN requirement r USING (id)),
agg AS (SELECT id, count(*) AS n_bound, count(*) FILTER (matched) AS n_matched, bool_or(has_content AND matched) AS covered, bool_or(has_content) AS any_content, string_agg(content, chr(10) ORDER BY leaf_id) AS joined FROM hit GROUP BY id),
m AS (SELECT r.id, r.is_risk, r.status AS given, coalesce(n_bound, 0) AS n_bound, coalesce(n_matched, 0) AS n_matched, coalesce(covered, FALSE) AS covered, coalesce(any_content, FALSE) AS any_content,
  len(list_filter(string_split(r.elements, '|'), lambda e: NOT contains(replace(coalesce(joined, ''), ' ', ''), replace(e, ' ', '')))) AS n_missing FROM requirement r LEFT JOIN agg USING (id)),
matrix AS (SELECT id, is_risk, n_bound, n_matched, n_missing, CASE WHEN given = 'ignored' THEN 'ignored' WHEN n_bound = 0 THEN 'unbound' WHEN covered AND n_missing = 0 THEN 'covered' WHEN any_content THEN 'partial' ELSE 'bound_pending' END AS status FROM m)"""


def _matrix(spark, sf_dir):
    return coverage.response_matrix(given(spark, sf_dir, "requirement"), _leaves(spark, sf_dir))


@query("d05_response_matrix", f"{_MATRIX} SELECT id, status, CAST(n_bound AS INT) AS n_bound, CAST(n_matched AS INT) AS n_matched, CAST(n_missing AS INT) AS n_missing FROM matrix")
def response_matrix(spark, sf_dir):
    return _matrix(spark, sf_dir).select("id", "status", "n_bound", "n_matched", F.size("missing").alias("n_missing"))


@query("e01_matrix_summary", f"""{_MATRIX} SELECT count(*) AS total, count(*) FILTER (status = 'covered') AS covered, count(*) FILTER (status = 'partial') AS partial, count(*) FILTER (status = 'bound_pending') AS bound_pending,
count(*) FILTER (status = 'unbound') AS unbound, count(*) FILTER (status = 'ignored') AS ignored, count(*) FILTER (is_risk = 1) AS risk_total, count(*) FILTER (is_risk = 1 AND status NOT IN ('covered', 'ignored')) AS risk_uncovered FROM matrix""")
def matrix_summary(spark, sf_dir):
    return coverage.matrix_summary(_matrix(spark, sf_dir))


@query("d09_uncovered", f"""{cte("requirement")}, {_LEAVES}, bound AS (SELECT DISTINCT unnest(ids) AS id FROM leaf WHERE id <> '')
SELECT 'risk_unbound' AS kind, id FROM requirement WHERE is_risk = 1 AND id NOT IN (SELECT id FROM bound)
UNION ALL SELECT 'confirmed_unbound', id FROM requirement WHERE status = 'confirmed' AND id NOT IN (SELECT id FROM bound)
UNION ALL SELECT CASE WHEN title = '工程概况' THEN 'descriptive_unbound' ELSE 'leaf_unbound' END, id FROM leaf WHERE coalesce(len(ids), 0) = 0""")
def uncovered(spark, sf_dir):
    return coverage.uncovered(given(spark, sf_dir, "requirement"), _leaves(spark, sf_dir))


_PLAIN = "regexp_replace({x}, '[\\s,;:()\\[\\]\\-_/]', '', 'g')"


@query("d13_document_coverage", f"""WITH q AS (SELECT item_id, {_PLAIN.format(x="substring(text, 1, 60)")} AS t, list_distinct(list_filter(list_transform(list_filter(
  string_split_regex(regexp_replace(substring(text, 1, 60), '^\\s+|\\s+$', '', 'g'), '[()\\[\\],;:\\s]+'), lambda w: length(w) BETWEEN 2 AND 10), lambda w: {_PLAIN.format(x="w")}), lambda w: length(w) >= 2)) AS cs FROM benchmark),
m AS (SELECT item_id, contains(d, t) AS exact, len(list_filter(cs, lambda w: contains(d, w) AND w <> t)) + CAST(contains(d, t) AS INT) AS n FROM (SELECT {_PLAIN.format(x="text")} AS d FROM documents) x, q)
SELECT item_id AS id, count(*) FILTER (exact OR n >= 2) AS covered, count(*) FILTER (NOT exact AND n = 0) AS missing FROM m GROUP BY item_id""")
def document_coverage(spark, sf_dir):
    """Beginnings of the benchmark passages as titles, looked for in all documents."""
    asked = table(spark, sf_dir, "benchmark").select(c("item_id").alias("id"), F.substring("text", 1, 60).alias("title"), F.lit("").alias("keyword"), F.lit("pending").alias("status"))
    return coverage.coverage_counts(asked, table(spark, sf_dir, "documents")).select("id", "covered", "missing")


@query("d13_passage_coverage", f"""WITH q AS (SELECT item_id, {_PLAIN.format(x="text")} AS t, list_distinct(list_filter(list_transform(list_filter(
  string_split_regex(regexp_replace(text, '^\\s+|\\s+$', '', 'g'), '[()\\[\\],;:\\s]+'), lambda w: length(w) BETWEEN 2 AND 10), lambda w: {_PLAIN.format(x="w")}), lambda w: length(w) >= 2)) AS cs FROM benchmark),
m AS (SELECT item_id, contains(d, t) AS exact, len(list_filter(cs, lambda w: contains(d, w) AND w <> t)) + CAST(contains(d, t) AS INT) AS n FROM (SELECT {_PLAIN.format(x="text")} AS d FROM documents) x, q)
SELECT item_id AS id, count(*) FILTER (exact OR n >= 2) AS covered, count(*) FILTER (NOT exact AND n = 0) AS missing, CAST(sum(n) AS BIGINT) AS n_matched FROM m GROUP BY item_id""")
def passage_coverage(spark, sf_dir):
    """Whole benchmark passages, and all their words, looked for in all documents."""
    asked = table(spark, sf_dir, "benchmark").select(c("item_id").alias("id"), c("text").alias("title"), F.lit("").alias("keyword"), F.lit("pending").alias("status"))
    return coverage.coverage_counts(asked, table(spark, sf_dir, "documents")).select("id", "covered", "missing", "n_matched")


@query("d01_standards_of_domain", f"""{cte("standard")} SELECT s.raw_code, s.title, s.status FROM standard s JOIN (SELECT DISTINCT raw_code AS code FROM standard WHERE domain = 'Brand#1') l ON s.raw_code = l.code""")
def standards_of_domain(spark, sf_dir):
    s = given(spark, sf_dir, "standard")
    links = s.where("domain = 'Brand#1'").select(c("raw_code").alias("code")).distinct()
    return s.join(links, c("raw_code") == c("code")).select("raw_code", "title", "status")


@query("d02_attach_domains", """SELECT c_custkey AS id, coalesce(string_agg(DISTINCT o_orderpriority, '|' ORDER BY o_orderpriority), '') AS domains FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey""")
def attach_domains(spark, sf_dir):
    links = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.array_join(F.array_sort(F.collect_set("o_orderpriority")), "|").alias("d"))
    return table(spark, sf_dir, "customer").join(links, c("c_custkey") == c("o_custkey"), "left").select(c("c_custkey").alias("id"), F.coalesce("d", F.lit("")).alias("domains"))


@query("d19_siblings", """SELECT a.c_custkey AS id, count(*) AS siblings FROM customer a JOIN customer b ON a.c_nationkey IS NOT DISTINCT FROM b.c_nationkey AND a.c_custkey <> b.c_custkey GROUP BY a.c_custkey""")
def siblings(spark, sf_dir):
    """Counted by parent, not by pairing siblings."""
    cust = table(spark, sf_dir, "customer")
    sizes = cust.groupBy("c_nationkey").agg(F.count("*").alias("n"))
    return cust.join(sizes, cust["c_nationkey"].eqNullSafe(sizes["c_nationkey"])).where("n > 1").select(c("c_custkey").alias("id"), (c("n") - 1).alias("siblings"))


@query("d26_resolve_domain", """SELECT o_orderkey AS id, coalesce(c_mktsegment, 'default') AS domain FROM orders LEFT JOIN customer ON o_custkey = c_custkey AND c_acctbal > 0""")
def resolve_domain(spark, sf_dir):
    known = table(spark, sf_dir, "customer").where("c_acctbal > 0")
    return table(spark, sf_dir, "orders").join(known, c("o_custkey") == c("c_custkey"), "left").select(c("o_orderkey").alias("id"), F.coalesce("c_mktsegment", F.lit("default")).alias("domain"))


# --- budgets and aggregates ----------------------------------------------------------------------------------------
_BUDGET = f"""{cte("section", "requirement")}, lv AS (SELECT o_orderkey AS id, CASE CAST(o_orderkey % 5 AS INT) WHEN 0 THEN '质量目标' WHEN 1 THEN '工程概况' WHEN 2 THEN '施工方案' ELSE o_orderpriority END AS title FROM orders),
b AS (SELECT DISTINCT l_orderkey AS leaf_id, CAST(l_partkey AS STRING) AS rid FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
t AS (SELECT sum(score) AS total FROM requirement), n AS (SELECT rid, count(*) AS n FROM b JOIN requirement r ON r.id = rid GROUP BY rid),
w AS (SELECT leaf_id, CAST(sum(round_even(score / total * CAST(7800000 AS DOUBLE) / n, 0)) AS BIGINT) AS words FROM b JOIN requirement r ON r.id = rid JOIN n USING (rid), t WHERE score > 0 GROUP BY leaf_id),
base AS (SELECT lv.id, title, coalesce(words, 0) AS words FROM lv LEFT JOIN w ON lv.id = leaf_id),
s AS (SELECT greatest(0, 7800000 - sum(words)) AS rest, count(*) FILTER (words <= 0) AS open FROM base),
x AS (SELECT id, CAST(CASE WHEN words > 0 THEN words WHEN open = 0 THEN 0 WHEN rest >= 400 * open THEN greatest(400, round_even(CAST(rest AS DOUBLE) / open, 0)) ELSE round_even(CAST(rest AS DOUBLE) / open, 0) END AS BIGINT) AS base_words,
  CASE WHEN title = '质量目标' THEN 0.5 WHEN title = '工程概况' THEN 0.65 WHEN title = '施工方案' THEN 1.15 ELSE 1.0 END AS weight FROM base, s),
y AS (SELECT sum(base_words) / CAST(sum(base_words * CAST(weight AS DOUBLE)) AS DOUBLE) AS scale FROM x)"""


@query("e07_word_budget", f"{_BUDGET} SELECT id, base_words, CASE WHEN base_words > 0 THEN CAST(round_even(base_words * CAST(weight AS DOUBLE) * scale, 0) AS BIGINT) END AS target_words FROM x, y")
def word_budget(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    k = c("o_orderkey") % 5
    leaves = o.select(c("o_orderkey").alias("id"), F.when(k == 0, "质量目标").when(k == 1, "工程概况").when(k == 2, "施工方案").otherwise(c("o_orderpriority")).alias("title"))
    bound = table(spark, sf_dir, "lineitem").select(c("l_orderkey").alias("leaf_id"), c("l_partkey").cast("string").alias("requirement_id"))
    return budget.allocate(leaves, bound, given(spark, sf_dir, "requirement").select("id", "score"), target_pages=10_000)


@query("e08_rescale", f"{cte('section')} SELECT id, CAST(CASE WHEN target_words > 0 THEN greatest(200, round_even(target_words * (CAST(40000 AS DOUBLE) / (SELECT sum(target_words) FROM section)), 0)) ELSE target_words END AS BIGINT) AS target_words FROM section")
def rescale(spark, sf_dir):
    return budget.rescale(given(spark, sf_dir, "section").select("id", "target_words"), 40_000)


@query("e02_retrieval_stats", """SELECT count(*) AS total, count(*) FILTER (n_chars < 200) AS zero_hit, count(*) FILTER (n_chars >= 200) AS hit, round(count(*) FILTER (n_chars < 200) / CAST(count(*) AS DOUBLE), 4) AS ratio FROM documents""")
def retrieval_stats(spark, sf_dir):
    zero = F.count_if(c("n_chars") < 200)
    return table(spark, sf_dir, "documents").agg(F.count("*").alias("total"), zero.alias("zero_hit"), F.count_if(c("n_chars") >= 200).alias("hit"), F.round(zero / F.count("*"), 4).alias("ratio"))


@query("e03_findings_summary", """SELECT o_orderpriority AS category, count(*) AS n, count(*) FILTER (o_orderstatus = 'F') AS block, count(*) FILTER (o_orderstatus = 'P') AS info, count(*) FILTER (o_orderstatus NOT IN ('F', 'P')) AS warn FROM orders GROUP BY o_orderpriority""")
def findings_summary(spark, sf_dir):
    s = c("o_orderstatus")
    return table(spark, sf_dir, "orders").groupBy(c("o_orderpriority").alias("category")).agg(F.count("*").alias("n"), F.count_if(s == "F").alias("block"), F.count_if(s == "P").alias("info"), F.count_if(~s.isin("F", "P")).alias("warn"))


@query("e04_status_pivot", f"{cte('standard')} SELECT domain, least(200, count(*) FILTER (status = 'active')) AS active, least(200, count(*) FILTER (status = 'draft')) AS draft FROM standard GROUP BY domain")
def status_pivot(spark, sf_dir):
    by = given(spark, sf_dir, "standard").groupBy("domain").pivot("status", ["active", "draft"]).count().na.fill(0)
    return by.select("domain", F.least(F.lit(200), "active").alias("active"), F.least(F.lit(200), "draft").alias("draft"))


@query("e05_least_id_per_text", "SELECT min(doc_id) AS doc_id, source, count(*) AS copies FROM documents GROUP BY source, md5(text)")
def least_id_per_text(spark, sf_dir):
    return table(spark, sf_dir, "documents").groupBy("source", F.md5("text").alias("h")).agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies")).select("doc_id", "source", "copies")


@query("e10_length_balance", "SELECT doc_id, source, round(n_chars / CAST(total AS DOUBLE), 6) AS ratio FROM (SELECT *, sum(n_chars) OVER (PARTITION BY source) AS total, count(*) OVER (PARTITION BY source) AS n FROM documents) WHERE n >= 2 AND n_chars / CAST(total AS DOUBLE) > 0.1")
def length_balance(spark, sf_dir):
    """Totals are joined back, so that a large source is not gathered in one task."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars")
    by = docs.groupBy("source").agg(F.sum("n_chars").alias("total"), F.count("*").alias("n")).where("n >= 2")
    return docs.join(by, "source").withColumn("r", c("n_chars") / c("total")).where("r > 0.1").select("doc_id", "source", F.round("r", 6).alias("ratio"))


@query("e11_opening_overuse", r"""WITH p AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents),
o AS (SELECT doc_id, regexp_replace(substring(regexp_replace(line, '^\s+|\s+$', '', 'g'), 1, 5), '[\s,;:()\[\]\-_/]', '', 'g') AS opening FROM p)
SELECT doc_id, opening, count(*) AS n FROM o WHERE length(opening) >= 5 GROUP BY ALL HAVING count(*) >= 3""")
def opening_overuse(spark, sf_dir):
    lines = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("line"))
    opening = F.regexp_replace(F.substring(F.regexp_replace("line", r"^\s+|\s+$", ""), 1, 5), r"[\s,;:()\[\]\-_/]", "")
    return lines.groupBy("doc_id", opening.alias("opening")).agg(F.count("*").alias("n")).where((F.length("opening") >= 5) & (c("n") >= 3))


@query("e16_review_counts", "SELECT lang, count(*) AS total, count(*) FILTER (quality = 1 AND toxic = 0) AS green, count(*) FILTER (quality = 1 AND toxic = 1) AS yellow, count(*) FILTER (quality = 0) AS red, count(*) FILTER (quality IS NULL) AS pending FROM documents LEFT JOIN labels USING (doc_id) GROUP BY lang")
def review_counts(spark, sf_dir):
    q, t = c("quality"), c("toxic")
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    return docs.groupBy("lang").agg(F.count("*").alias("total"), F.count_if((q == 1) & (t == 0)).alias("green"), F.count_if((q == 1) & (t == 1)).alias("yellow"), F.count_if(q == 0).alias("red"), F.count_if(q.isNull()).alias("pending"))


@query("e24_first_truthy", """SELECT user_id, arg_min(event_type, event_id) FILTER (value > 50) AS first_large, arg_max(event_type, (value, event_id)) AS largest FROM events GROUP BY user_id""")
def first_truthy(spark, sf_dir):
    large = F.when(c("value") > 50, F.struct("event_id", "event_type"))
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.min(large)["event_type"].alias("first_large"), F.max_by("event_type", F.struct("value", "event_id")).alias("largest"))


@query("e30_requirement_text", """SELECT l_orderkey AS id, md5(string_agg(CAST(l_linenumber AS STRING) || ':' || CAST(l_partkey AS STRING), chr(10) ORDER BY l_linenumber, l_partkey)) AS text FROM lineitem GROUP BY l_orderkey""")
def requirement_text(spark, sf_dir):
    row = F.struct("l_linenumber", "l_partkey", F.concat_ws(":", c("l_linenumber").cast("string"), c("l_partkey").cast("string")).alias("t"))
    by = table(spark, sf_dir, "lineitem").groupBy(c("l_orderkey").alias("id")).agg(F.array_sort(F.collect_list(row)).alias("r"))
    return by.select("id", F.md5(F.array_join(c("r")["t"], "\n")).alias("text"))


# --- order -------------------------------------------------------------------------------------------------------
_TREE = f"""WITH RECURSIVE {cte("node")[5:]}, t(id, key, root_id, depth, titles) AS (
  SELECT id, lpad(CAST(coalesce(sort_order, 0) AS STRING), 5, '0') || id, id, 1, title FROM node n WHERE NOT EXISTS (SELECT 1 FROM node p WHERE p.id = n.parent_id)
  UNION ALL SELECT n.id, t.key || '/' || lpad(CAST(coalesce(n.sort_order, 0) AS STRING), 5, '0') || n.id, t.root_id, t.depth + 1, t.titles || ' > ' || n.title FROM node n JOIN t ON n.parent_id = t.id)"""


@query("f06_depth_first", f"{_TREE} SELECT id, root_id, CAST(depth AS INT) AS depth, CAST(row_number() OVER (ORDER BY key) AS BIGINT) AS rank FROM t")
def depth_first(spark, sf_dir):
    return trees.depth_first(trees.walk(given(spark, sf_dir, "node"))).select("id", "root_id", "depth", "rank")


@query("f11_title_path", f"{_TREE} SELECT id, titles AS path FROM t")
def title_path(spark, sf_dir):
    return trees.walk(given(spark, sf_dir, "node")).select("id", F.array_join("titles", " > ").alias("path"))


@query("f01_previous_summary", "SELECT conv_id, turn, lag(md5(text)) OVER (PARTITION BY conv_id ORDER BY turn) AS previous FROM conversations")
def previous_summary(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.lag(F.md5("text")).over(W.partitionBy("conv_id").orderBy("turn")).alias("previous"))


@query("f02_prior_turns", "SELECT conv_id, turn, CAST(least(5, count(*) FILTER (role = 'user') OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) AS INT) AS n FROM conversations")
def prior_turns(spark, sf_dir):
    before = W.partitionBy("conv_id").orderBy("turn").rowsBetween(W.unboundedPreceding, -1)
    n = F.count_if(c("role") == "user").over(before)
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.least(F.lit(5), F.coalesce(n, F.lit(0))).cast("int").alias("n"))


@query("f12_newest_versions", "SELECT o_custkey, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) <= 20")
def newest_versions(spark, sf_dir):
    rank = F.row_number().over(W.partitionBy("o_custkey").orderBy(F.desc("o_orderdate"), F.desc("o_orderkey")))
    return table(spark, sf_dir, "orders").withColumn("r", rank).where("r <= 20").select("o_custkey", "o_orderkey")


@query("f14_same_role_runs", """SELECT user_id, event_type, count(*) AS n FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS island FROM events)
GROUP BY user_id, event_type, island HAVING count(*) >= 3""")
def same_role_runs(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", "event_type", "event_id")
    a, b = F.row_number().over(W.partitionBy("user_id").orderBy("event_id")), F.row_number().over(W.partitionBy("user_id", "event_type").orderBy("event_id"))
    return e.withColumn("island", a - b).groupBy("user_id", "event_type", "island").agg(F.count("*").alias("n")).where("n >= 3").drop("island")


@query("f16_page_buckets", "SELECT l_orderkey, CAST(floor((l_linenumber - 1) / 3) AS INT) AS bucket, count(*) AS n, CAST(sum(l_quantity) AS DOUBLE) AS quantity FROM lineitem GROUP BY ALL")
def page_buckets(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey", F.floor((c("l_linenumber") - 1) / 3).cast("int").alias("bucket")).agg(F.count("*").alias("n"), F.sum("l_quantity").alias("quantity"))


@query("f21_running_caption", "SELECT conv_id, turn, role, count(*) OVER (PARTITION BY conv_id, role ORDER BY turn ROWS UNBOUNDED PRECEDING) AS caption FROM conversations")
def running_caption(spark, sf_dir):
    w = W.partitionBy("conv_id", "role").orderBy("turn").rowsBetween(W.unboundedPreceding, 0)
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.count("*").over(w).alias("caption"))


@query("f25_qa_windows", """SELECT doc_id, md5(CASE WHEN n_chars <= 8000 THEN text ELSE substring(text, 1, 2800) || '|' || substring(text, CAST(length(text) // 2 - 1400 + 1 AS INT), 2800) || '|' || right(text, 2800) END) AS windows FROM documents""")
def qa_windows(spark, sf_dir):
    t = c("text")
    parts = F.concat_ws("|", F.substring(t, 1, 2800), F.substr(t, (F.floor(F.length(t) / 2) - 1400 + 1).cast("int"), F.lit(2800)), F.right(t, F.lit(2800)))
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(F.when(c("n_chars") <= 8000, t).otherwise(parts)).alias("windows"))


@query("g05_evaluation_focus", "SELECT l_orderkey, l_linenumber, l_partkey FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_returnflag = 'R' DESC, l_extendedprice DESC, l_linenumber, l_partkey) AS r FROM lineitem) WHERE r <= 6")
def evaluation_focus(spark, sf_dir):
    r = F.row_number().over(W.partitionBy("l_orderkey").orderBy(F.desc(c("l_returnflag") == "R"), F.desc("l_extendedprice"), "l_linenumber", "l_partkey"))
    return table(spark, sf_dir, "lineitem").withColumn("r", r).where("r <= 6").select("l_orderkey", "l_linenumber", "l_partkey")


# --- filters and sets --------------------------------------------------------------------------------------------
@query("c01_list_standards", f"{cte('standard')} SELECT raw_code, title FROM standard WHERE status = 'active' AND (raw_code LIKE '%7%' OR title ILIKE '%red%') ORDER BY raw_code, title LIMIT 200")
def list_standards(spark, sf_dir):
    s = given(spark, sf_dir, "standard").where((c("status") == "active") & (c("raw_code").like("%7%") | c("title").ilike("%red%")))
    return s.orderBy("raw_code", "title").limit(200).select("raw_code", "title")


@query("c02_requirements_in_order", f"{cte('requirement')} SELECT id, row_number() OVER (PARTITION BY keyword ORDER BY is_risk DESC, score DESC NULLS LAST, id) AS place FROM requirement")
def requirements_in_order(spark, sf_dir):
    w = W.partitionBy("keyword").orderBy(F.desc("is_risk"), F.desc_nulls_last("score"), "id")
    return given(spark, sf_dir, "requirement").select("id", F.row_number().over(w).alias("place"))


@query("c08_codes_among", "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')")
def codes_among(spark, sf_dir):
    return table(spark, sf_dir, "customer").join(table(spark, sf_dir, "orders").where("o_orderstatus = 'F'"), c("c_custkey") == c("o_custkey"), "left_semi").select("c_custkey")


@query("h02_never_ordered", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def never_ordered(spark, sf_dir):
    return table(spark, sf_dir, "customer").join(table(spark, sf_dir, "orders"), c("c_custkey") == c("o_custkey"), "left_anti").select("c_custkey")


@query("h03_union_of_names", "SELECT n_name AS name FROM nation UNION SELECT r_name FROM region UNION SELECT s_name FROM supplier")
def union_of_names(spark, sf_dir):
    names = [table(spark, sf_dir, t).select(c(k).alias("name")) for t, k in (("nation", "n_name"), ("region", "r_name"), ("supplier", "s_name"))]
    return names[0].union(names[1]).union(names[2]).distinct()


@query("h04_first_of_equals", "SELECT event_type, user_id, min(event_id) AS event_id FROM events GROUP BY ALL")
def first_of_equals(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("event_type", "user_id").agg(F.min("event_id").alias("event_id"))


@query("h10_ordered_distinct", "SELECT o_custkey, string_agg(o_orderpriority, '|' ORDER BY k) AS seen FROM (SELECT o_custkey, o_orderpriority, min(o_orderkey) AS k FROM orders GROUP BY ALL) GROUP BY o_custkey")
def ordered_distinct(spark, sf_dir):
    first = table(spark, sf_dir, "orders").groupBy("o_custkey", "o_orderpriority").agg(F.min("o_orderkey").alias("k"))
    return first.groupBy("o_custkey").agg(F.array_join(F.array_sort(F.collect_list(F.struct("k", "o_orderpriority")))["o_orderpriority"], "|").alias("seen"))


# --- keyed state -------------------------------------------------------------------------------------------------
def _upsert(spark, sf_dir):
    old = table(spark, sf_dir, "customer").where("c_acctbal < 5000").select("c_custkey", "c_name", "c_mktsegment")
    new = table(spark, sf_dir, "customer").where("c_acctbal > 2000").select("c_custkey", F.when(c("c_nationkey") > 5, c("c_name")).alias("c_name"), F.when(c("c_nationkey") > 12, "NEW").otherwise(c("c_mktsegment")).alias("c_mktsegment"))
    return state.upsert(old, new, "c_custkey", ["c_name", "c_mktsegment"], {"c_name": "unnamed"})


@query("m01_upsert_state", """SELECT coalesce(o.c_custkey, n.c_custkey) AS c_custkey, coalesce(n.c_name, o.c_name, 'unnamed') AS c_name, coalesce(n.c_mktsegment, o.c_mktsegment) AS c_mktsegment
FROM (SELECT * FROM customer WHERE c_acctbal < 5000) o FULL JOIN (SELECT c_custkey, CASE WHEN c_nationkey > 5 THEN c_name END AS c_name, CASE WHEN c_nationkey > 12 THEN 'NEW' ELSE c_mktsegment END AS c_mktsegment FROM customer WHERE c_acctbal > 2000) n ON o.c_custkey = n.c_custkey""")
def upsert_state(spark, sf_dir):
    return _upsert(spark, sf_dir)[0]


@query("m01_upsert_log", """SELECT c_custkey, 'c_mktsegment' AS field, c_mktsegment AS old_value, 'NEW' AS new_value FROM customer WHERE c_acctbal < 5000 AND c_acctbal > 2000 AND c_nationkey > 12""")
def upsert_log(spark, sf_dir):
    return _upsert(spark, sf_dir)[1]


@query("m06_sync_by_hash", """WITH old AS (SELECT source AS folder, md5(text) AS hash, min(lang) AS keywords FROM documents WHERE n_chars > 500 GROUP BY ALL),
new AS (SELECT source AS folder, md5(text) AS hash, string_agg(DISTINCT CAST(doc_id AS STRING), ',' ORDER BY CAST(doc_id AS STRING)) AS sources, min(CASE WHEN n_chars > 3000 THEN 'long' ELSE lang END) AS keywords FROM documents WHERE n_chars < 5000 GROUP BY ALL)
SELECT coalesce(o.folder, n.folder) AS folder, coalesce(o.hash, n.hash) AS hash, CASE WHEN o.hash IS NULL THEN 'insert' WHEN n.hash IS NULL THEN 'delete' WHEN o.keywords IS DISTINCT FROM n.keywords THEN 'update' ELSE 'keep' END AS action, n.sources
FROM old o FULL JOIN new n ON o.folder = n.folder AND o.hash = n.hash""")
def sync_by_hash(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    old = docs.where("n_chars > 500").select(c("source").alias("folder"), F.md5("text").alias("hash"), c("lang").alias("keywords"))
    found = docs.where("n_chars < 5000").select(c("source").alias("folder"), c("doc_id").cast("string").alias("source"), "text", F.when(c("n_chars") > 3000, "long").otherwise(c("lang")).alias("keywords"))
    return state.sync_by_hash(old, found)


@query("b07_append_versions", """WITH v AS (SELECT o_custkey AS project, o_orderpriority AS chapter, CAST(o_orderkey AS STRING) AS content, o_orderdate AS created_at FROM orders WHERE o_orderstatus <> 'P'),
s AS (SELECT o_custkey AS project, o_orderpriority AS chapter, CASE WHEN o_orderkey % 3 = 0 THEN ' ' ELSE CAST(o_orderkey AS STRING) END AS content, o_orderdate AS created_at FROM orders WHERE o_orderstatus = 'P'),
l AS (SELECT project, chapter, arg_max(content, created_at) AS last FROM v GROUP BY ALL),
a AS (SELECT * FROM v UNION ALL SELECT s.* FROM s LEFT JOIN l USING (project, chapter) WHERE trim(s.content) <> '' AND s.content IS DISTINCT FROM last)
SELECT project, chapter, content FROM a QUALIFY row_number() OVER (PARTITION BY project, chapter ORDER BY created_at DESC, content) <= 2""")
def append_versions(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(c("o_custkey").alias("project"), c("o_orderpriority").alias("chapter"), c("o_orderkey").cast("string").alias("content"), c("o_orderdate").alias("created_at"), "o_orderstatus", "o_orderkey")
    v = o.where("o_orderstatus <> 'P'").drop("o_orderstatus", "o_orderkey")
    s = o.where("o_orderstatus = 'P'").withColumn("content", F.when(c("o_orderkey") % 3 == 0, " ").otherwise(c("content"))).drop("o_orderstatus", "o_orderkey")
    return state.append_versions(v, s, keep=2).select("project", "chapter", "content")


# --- events ------------------------------------------------------------------------------------------------------
@query("s04_latest_run", """SELECT user_id AS project, count(*) AS n FROM (SELECT *, max(CASE WHEN event_type = 'signup' THEN event_id END) OVER (PARTITION BY user_id) AS start FROM events) WHERE event_id >= start GROUP BY user_id""")
def latest_run(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    start = e.where("event_type = 'signup'").groupBy("user_id").agg(F.max("event_id").alias("start"))
    return e.join(start, "user_id").where("event_id >= start").groupBy(c("user_id").alias("project")).agg(F.count("*").alias("n"))


@query("s11_stage_counts", "SELECT user_id AS project, event_type AS stage, count(*) AS n, CAST(sum(CAST(json_extract_string(props, '$.k') AS INT)) AS BIGINT) AS k FROM events GROUP BY ALL")
def stage_counts(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy(c("user_id").alias("project"), c("event_type").alias("stage")).agg(F.count("*").alias("n"), F.sum(F.get_json_object("props", "$.k").cast("int")).alias("k"))


@query("j09_stale_status", "SELECT event_id, CASE WHEN event_type = 'click' AND date_diff('second', ts, TIMESTAMP '2024-01-15 00:00:00') > 120 THEN 'failed' WHEN value < 5 THEN 'pending' ELSE event_type END AS status FROM events")
def stale_status(spark, sf_dir):
    late = F.timestamp_diff("SECOND", c("ts"), F.lit("2024-01-15 00:00:00").cast("timestamp_ntz")) > 120
    return table(spark, sf_dir, "events").select("event_id", F.when((c("event_type") == "click") & late, "failed").when(c("value") < 5, "pending").otherwise(c("event_type")).alias("status"))
