"""Requirements and the sections that answer them.

requirements: (id, title, keyword, elements, score, is_risk, status); leaves: (id, title, content, requirement_ids as
a JSON array)."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import chapters
from ..functions import text as tx


def bindings(leaves: DataFrame) -> DataFrame:
    """(leaf_id, requirement_id, pos) of the leaves' JSON arrays, malformed ones empty."""
    return leaves.select(F.col("id").alias("leaf_id"), F.posexplode(tx.string_array(F.col("requirement_ids"))).alias("pos", "requirement_id"))


def response_matrix(requirements: DataFrame, leaves: DataFrame) -> DataFrame:
    """One row per requirement: status, n_bound, n_matched (leaves with a match), missing (elements), in every status of
    the matrix. (D05, Y01, Y02)

    An element is covered by all bound leaves together: one holds the phrase, or one its noun and one a verb of
    compliance. A phrase that begins in one leaf and ends in the next does not count. What is asked of a leaf is gathered
    to it in small rows; its text is normalised once and tested where it lies. Only flags leave that row, one for the leaf and
    one for each element, and they are counted together before they are shuffled."""
    req = requirements.withColumn("candidates", tx.coverage_candidates(F.col("title"), F.col("keyword"))).withColumn("asked", tx.split_mandatory_elements(F.col("elements")))
    elements = F.array_distinct("asked")
    # what goes to each leaf is packed: normalised forms hold no white space, elements no bar, as these part them
    packed = lambda xs, by: F.when(F.size(xs) > 0, F.array_join(xs, by))
    parted = lambda x, by: F.coalesce(F.split(x, by, -1), F.array().cast("array<string>"))
    small = req.select(
        F.col("id").alias("requirement_id"), packed(tx.candidate_forms(F.col("candidates")), "\n").alias("forms"), packed(elements, "|").alias("es"),
        packed(F.transform(elements, tx.normalize_for_match), "|").alias("ps"), packed(F.transform(elements, lambda e: F.when(tx.is_compliance_phrase(e), "y").otherwise("n")), "|").alias("says"),
    )
    asked = bindings(leaves).join(small, "requirement_id").groupBy("leaf_id").agg(F.collect_list(F.struct("requirement_id", "forms", "es", "ps", "says")).alias("rs"))
    texts = leaves.select(F.col("id").alias("leaf_id"), F.coalesce("content", F.lit("")).alias("text"))
    texts = texts.select("leaf_id", "text", tx.normalize_for_match(F.col("text")).alias("t"), (tx.strip(F.col("text")) != "").alias("written"))
    text, normal, no = F.col("text"), F.col("t"), F.lit(False)

    def flags(r: Column) -> Column:
        one = F.struct(F.lit(None).cast("string").alias("e"), F.exists(parted(r["forms"], "\n"), lambda n: F.contains(normal, n)).alias("matched"), no.alias("plain"), no.alias("noun"), no.alias("verb"))

        def flag(x: Column) -> Column:
            e, p = x["e"], x["p"]
            held = F.struct(((e == "") | F.contains(text, e) | ((p != "") & F.contains(normal, p))).alias("plain"), no.alias("noun"), no.alias("verb"))
            parts = F.when(x["says"] == "y", tx.covered_parts(text, e, normal, p)).otherwise(held)
            return tx.let(parts, lambda c: F.struct(e.alias("e"), no.alias("matched"), c["plain"].alias("plain"), c["noun"].alias("noun"), c["verb"].alias("verb")))

        each = F.transform(F.arrays_zip(parted(r["es"], "\\|").alias("e"), parted(r["ps"], "\\|").alias("p"), parted(r["says"], "\\|").alias("says")), flag)
        return F.transform(F.array_append(each, one), lambda f: F.struct(r["requirement_id"].alias("requirement_id"), f.alias("f")))

    rows = texts.join(asked, "leaf_id").select("written", F.explode(F.flatten(F.transform("rs", flags))).alias("x")).select("written", "x.requirement_id", "x.f.*")
    any_ = lambda x, name: F.bool_or(x).alias(name)
    rows = rows.groupBy("requirement_id", "e").agg(
        F.count("*").alias("n"), F.count_if("matched").alias("n_matched"), any_("written", "written"), any_(F.col("written") & F.col("matched"), "answered"), any_("plain", "plain"), any_("noun", "noun"), any_("verb", "verb")
    )
    leaf, met = F.col("e").isNull(), F.col("plain") | (F.col("noun") & F.col("verb"))
    bound = rows.groupBy(F.col("requirement_id").alias("id")).agg(
        F.max(F.when(leaf, F.col("n"))).alias("n_bound"), F.max(F.when(leaf, F.col("n_matched"))).alias("n_matched"), any_(leaf & F.col("written"), "written"), any_(leaf & F.col("answered"), "answered"), F.collect_set(F.when(met, F.col("e"))).alias("met")
    )
    out = req.join(bound, "id", "left")
    none = F.array().cast("array<string>")
    out = out.withColumn("missing", F.filter("asked", lambda e: ~F.array_contains(F.coalesce("met", none), e)))
    yes = lambda name: F.coalesce(F.col(name), F.lit(False))
    n = lambda name: F.coalesce(F.col(name), F.lit(0)).cast("int").alias(name)
    status = chapters.row_status(n("n_bound") > 0, yes("written"), yes("answered"), F.size("missing") == 0, F.coalesce(F.col("status") == "ignored", F.lit(False)))
    return out.select("id", "is_risk", status.alias("status"), n("n_bound"), n("n_matched"), "missing")


def matrix_summary(matrix: DataFrame) -> DataFrame:
    """Counts by status and of risks."""
    n = lambda cond, name: F.count_if(cond).alias(name)
    s, risk = F.col("status"), F.col("is_risk") == 1
    return matrix.agg(
        F.count("*").alias("total"), *(n(s == x, x) for x in ("covered", "partial", "bound_pending", "unbound", "ignored")),
        n(risk, "risk_total"), n(risk & ~s.isin("covered", "ignored"), "risk_uncovered"),
    )


def uncovered(requirements: DataFrame, leaves: DataFrame) -> DataFrame:
    """(kind, id): risk requirements no leaf binds, confirmed ones no leaf binds, leaves that bind none (descriptive
    ones apart). (D09, H02)"""
    bound = bindings(leaves).select(F.col("requirement_id").alias("id")).distinct()
    open_ = requirements.join(bound, "id", "left_anti")
    bare = leaves.where(F.size(tx.string_array(F.col("requirement_ids"))) == 0)
    kind = F.when(chapters.is_descriptive(F.col("title")), "descriptive_unbound").otherwise("leaf_unbound")
    return (
        open_.where("is_risk = 1").select(F.lit("risk_unbound").alias("kind"), "id")
        .union(open_.where("status = 'confirmed'").select(F.lit("confirmed_unbound"), "id"))
        .union(bare.select(kind, "id"))
    )


#: Requirements that are looked for in one pass over the documents.
BLOCK = 20_000


def document_coverage(requirements: DataFrame, documents: DataFrame, block: int = BLOCK) -> DataFrame:
    """(id, doc_id, status, n_matched) of the pairs of a requirement and a document (doc_id, text) that holds at least one
    candidate or the title: covered with the exact title or two candidates, else partial. A pair without a row is missing,
    so no row is made for it; `coverage_counts` counts those. (D13, Q27)

    The requirements are a stated set. They are taken in blocks of about `block`, each sent to the tasks as one automaton
    of its distinct words; a text is normalised where it is read and run through it once, whatever the number of words."""
    req = requirements.where(F.coalesce("status", F.lit("")) != "ignored")
    req = req.select("id", tx.normalize_for_match(F.col("title")).alias("t"), F.transform(tx.coverage_candidates(F.col("title"), F.col("keyword")), tx.normalize_for_match).alias("cs"))
    found = words_in_texts(req, documents.select("doc_id", tx.normalize_for_match(F.col("text")).alias("d")), block)
    status = F.when(F.col("exact") | (F.col("n_matched") >= 2), "covered").otherwise("partial")
    return found.select("id", "doc_id", status.alias("status"), "n_matched")


def words_in_texts(asked: DataFrame, texts: DataFrame, block: int = BLOCK) -> DataFrame:
    """(id, doc_id, exact, n_matched) for texts (doc_id, d) that hold words of asked (id, cs and, if given, t): whether t is
    in d, and how many of cs are. asked is a stated set, taken in blocks of about `block`."""
    asked = asked if "t" in asked.columns else asked.withColumn("t", F.lit(None).cast("string"))
    asked = asked.select("id", "t", "cs")
    blocks = max(1, -(-asked.count() // block))
    schema = T.StructType([asked.schema["id"], texts.schema["doc_id"], *T.StructType.fromDDL("exact boolean, n_matched int").fields])
    found = [texts.select("doc_id", "d").mapInArrow(_matcher(asked.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == k).toArrow()), schema) for k in range(blocks)]
    return reduce(DataFrame.union, found)


def coverage_counts(requirements: DataFrame, documents: DataFrame) -> DataFrame:
    """(id, covered, partial, missing, n_matched) of every requirement that is not ignored, over all documents."""
    n = F.count_if
    by = document_coverage(requirements, documents).groupBy("id").agg(n(F.col("status") == "covered").alias("covered"), n(F.col("status") == "partial").alias("partial"), F.sum("n_matched").alias("n_matched"))
    asked = requirements.where(F.coalesce("status", F.lit("")) != "ignored").select("id")
    zero = lambda name: F.coalesce(F.col(name), F.lit(0)).cast("long")
    total = documents.count()
    return asked.join(by, "id", "left").select("id", zero("covered").alias("covered"), zero("partial").alias("partial"), (F.lit(total) - zero("covered") - zero("partial")).alias("missing"), zero("n_matched").alias("n_matched"))


def _matcher(req: pa.Table):
    """Finds the words of the requirements (id, t, cs) in normalised texts (doc_id, d)."""
    ids, titles, words = req.column("id").combine_chunks(), req.column("t").to_pylist(), req.column("cs").to_pylist()
    owners: dict[str, tuple[list[int], list[int]]] = {}
    for i, (title, cs) in enumerate(zip(titles, words, strict=True)):
        if title is not None:
            owners.setdefault(title, ([], []))[0].append(i)
        for w in cs:
            owners.setdefault(w, ([], []))[1].append(i)
    always = np.zeros(len(ids), bool)
    always[owners.pop("", ([], []))[0]] = True  # an empty title is in every text
    names = list(owners)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        automaton = ahocorasick.Automaton()
        for k, w in enumerate(names):
            automaton.add_word(w, k)
        automaton.make_automaton()
        exact_of, word_of = ([np.array(owners[w][side], np.int64) for w in names] for side in (0, 1))
        for batch in batches:
            for doc_id, text in zip(batch.column(0), batch.column(1), strict=True):
                hits = {k for _, k in automaton.iter(text.as_py())} if names else ()
                exact, n = always.copy(), np.zeros(len(ids), np.int32)
                for k in hits:
                    exact[exact_of[k]] = True
                    n[word_of[k]] += 1
                at = np.flatnonzero(exact | (n > 0))
                if len(at):
                    same = pa.array([doc_id.as_py()] * len(at), batch.column(0).type)
                    yield pa.RecordBatch.from_arrays([ids.take(pa.array(at)), same, pa.array(exact[at]), pa.array(n[at])], ["id", "doc_id", "exact", "n_matched"])

    return run
