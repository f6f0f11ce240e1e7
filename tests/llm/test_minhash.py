"""Near-dedup against brute force, on the driver's table and on hot groups."""

import random
import re
from collections import Counter

import pytest

from tessella.llm import common, minhash

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {i: i + 32 for i in range(65, 91)}


def shingles(text):
    w = WORDS.findall((text or "").translate(LOWER))
    if len(w) >= 5:
        return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    return frozenset([tuple(w)] if w else [])


def brute(docs, t):
    """Component of every id, by looking at all pairs that share a shingle."""
    sets = {i: shingles(x) for i, x in docs}
    lists, parent = {}, {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, s in sets.items():
        shared = Counter(j for v in s for j in lists.get(v, ()))
        for v in s:
            lists.setdefault(v, []).append(i)
        for j, n in shared.items():
            if n * t[1] >= (len(s) + len(sets[j]) - n) * t[0]:
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    return {i: (len(sets[i]), root(i)) for i in sets}


def check(spark, docs, t, **options):
    df = spark.createDataFrame(docs, "doc_id long, text string")
    found = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in minhash.near_duplicates(df, t, **options).collect()}
    assert found == brute(docs, t)


def test_whole_table(spark, sf_dir):
    docs = [(r["doc_id"], r["text"]) for r in common.documents(spark, sf_dir).select("doc_id", "text").collect()]
    check(spark, docs, (85, 100))


@pytest.mark.parametrize("t", [(80, 100), (85, 100)])
def test_hot_groups(spark, t):
    """A cloud of near copies about the threshold, a line that most documents share, short documents of it alone."""
    rng = random.Random(7)
    word = lambda: "".join(rng.choices("abcdefgh", k=4))
    base, line = [word() for _ in range(90)], " ".join(word() for _ in range(12))
    docs = []
    for i in range(120):
        text = list(base)
        for _ in range(rng.randint(0, 5)):
            text[rng.randrange(len(text))] = word()
        docs.append((i, " ".join(text)))
    docs += [(200 + i, line + "\n" + " ".join(word() for _ in range(rng.randint(0, 60)))) for i in range(80)]
    docs += [(400 + i, docs[i][1]) for i in range(20)]
    check(spark, docs, t, k=16, hot=4, enough=11)


@pytest.mark.parametrize("words", range(7))
def test_slices_of_few_words(words):
    """A slice may hold fewer words than a shingle has."""
    import pyarrow as pa

    text = " ".join("cdefghi"[:words])
    assert [len(s) for s in common.shingle_sets(pa.array([text]), 5)] == [len(shingles(text))]
    one, two, _ = common.shingle_sets(pa.array([text, text.upper(), None]), 5)
    assert one.tolist() == two.tolist()


def test_hot_groups_dealt_out(spark, monkeypatch):
    """The same results when nothing may be sent to all executors and keys of more than ten rows are dealt out."""
    monkeypatch.setattr(common, "small", lambda df, most=0: False)
    monkeypatch.setattr(common, "DEALT", 10)
    test_hot_groups(spark, (80, 100))


def test_long_text_and_clashing_names(spark):
    rng = random.Random(9)
    long = " ".join("".join(rng.choices("abcdef", k=5)) for _ in range(400_000))
    rows = [(1, long, 7), (2, long + " more", 8), (2, "x y z", 9), (3, "q" * 3_000_000, 10)]
    df = spark.createDataFrame(rows, "doc_id long, text string, _nth long").selectExpr("*", "_nth AS nth", "_nth AS n", "_nth AS kept")
    kept = minhash.deduplicated(df)
    assert kept.columns == df.columns and sorted((r["doc_id"], r["_nth"], r["nth"]) for r in kept.collect()) == [(1, 7, 7), (3, 10, 10)]


def test_edges(spark):
    """Null, empty and blank texts, null ids, repeated rows, extra columns."""
    rows = [(1, None, "x"), (2, "", "x"), (3, " \n", "x"), (4, "a b", None), (5, "A B", "x"), (5, "A B", "x"), (None, "a b", "x"), (6, "one two three four five six", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, component_id string")
    found = sorted(minhash.near_duplicates(df).collect(), key=lambda r: (r["doc_id"] is None, r["doc_id"] or 0))
    assert [(r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in found] == [
        (1, 0, 1, True), (2, 0, 2, True), (3, 0, 3, True), (4, 1, 4, True), (5, 1, 4, False), (5, 1, 4, False), (6, 2, 6, True), (None, 1, None, True),
    ]
    assert minhash.near_duplicates(df.limit(0)).count() == 0
    kept = minhash.deduplicated(df)
    assert kept.columns == df.columns
    assert sorted(r["doc_id"] or 0 for r in kept.collect()) == [0, 1, 2, 3, 4, 6]
