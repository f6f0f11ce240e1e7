"""Importance resampling, source divergence and token counts against brute force in plain Python."""

import hashlib
import math
import random
import re
import time
import zlib
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from tessella.llm import common, divergence, resampling, tokens

EDGES = [(1, None), (2, ""), (3, " \n\t.,"), (4, "X"), (5, "x y"), (5, "x y"), (None, "null Id 7"), (6, "é中😀 aB9 " * 30), (7, "w" * 300_000 + " v"), (8, "a b" * 40)]


@pytest.fixture(scope="module")
def edges(spark):
    rows = [(i, t, None if i == 3 else "en", None if i == 4 else f"s{(i or 0) % 3}", "n", 1, "r") for i, t in EDGES]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, value string, rank int, score string")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def duck(sf_dir, sql):
    con = duckdb.connect()
    for name in ("documents", "benchmark"):
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con.sql(sql)


def plain(rows):
    return sorted(tuple(-1 if v is None else v for v in r) for r in rows)


# --- importance resampling -------------------------------------------------------------------------------------------
def features(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text))
    return words, words + [f"{a} {b}" for a, b in zip(words, words[1:], strict=False)]


def brute_resampling(docs, target, percent=25, least=20, buckets=10_000, seed=7):
    count = lambda texts: Counter(zlib.crc32(f.encode()) % buckets for t in texts for f in features(t)[1])
    s, t = count(x for _, x in docs), count(target)
    size, goal = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (size + buckets) / ((s[b] + 1) * (goal + buckets)))) for b in range(buckets)]
    out = []
    for i, text in docs:
        words, found = features(text)
        weight = sum(gain[zlib.crc32(f.encode()) % buckets] for f in found) // max(1, len(found))
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(words)])
    fine = sorted((r for r in out if r[4] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    rank = {id(r): k for k, r in enumerate(fine[: len(fine) * percent // 100], 1)}
    return [(*r[:4], rank.get(id(r))) for r in out]


def test_resampling(spark, sf_dir):
    got = resampling.op11_resampling(spark, sf_dir)
    docs = [(r["doc_id"], r["text"]) for r in common.documents(spark, sf_dir).collect()]
    target = [r["text"] for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    sql = duck(sf_dir, resampling.SQL)
    assert sql.columns == got.columns and set(dict(got.dtypes).values()) == {"bigint"}
    assert plain(got.collect()) == plain(brute_resampling(docs, target)) == plain(sql.fetchall())


def test_resampling_edges(spark, edges):
    target = spark.createDataFrame([("x y z",), (None,)], "text string")
    columns = ["doc_id", "n_features", "weight", "score", "rank"]
    for least, percent in ((1, 70), (0, 100), (2, 33), (10**9, 25)):
        got = resampling.resample(edges, target, percent=percent, least=least).select(columns)
        assert plain(got.collect()) == plain(brute_resampling(EDGES, ["x y z"], percent, least))
    empty = edges.limit(0)
    assert resampling.resample(empty, target).count() == 0
    assert resampling.resample(edges, empty, least=1).count() == len(EDGES)
    drawn = resampling.resampled(edges, target, percent=100, least=2)
    assert drawn.columns == edges.columns and {r["doc_id"] for r in drawn.collect()} == {5, 6, 7, 8}  # a null id joins nothing


def test_resampling_ranks_ties(spark):
    """Ranks beyond bins and ties of one score, over a few partitions."""
    rng = random.Random(3)
    rows = [(k, 30, 59, 0, rng.randint(-300, 300)) for k in range(3000)] + [(9000 + k, 3, 5, 0, 500) for k in range(10)]
    found = resampling.ranked(spark.createDataFrame(rows, "doc_id long, n_words long, n_features long, weight long, score long").repartition(5), 40)
    want = {r[0]: k for k, r in enumerate(sorted(rows[:3000], key=lambda r: (-r[4], r[0]))[:1200], 1)}
    assert {r["doc_id"]: r["rank"] for r in found.collect()} == {r[0]: want.get(r[0]) for r in rows}


def test_registers_of_words():
    rng = random.Random(4)
    raw = bytes(rng.randrange(256) for _ in range(5000))
    at = sorted(rng.sample(range(5000), 400))
    starts, ends = np.array(at[::2]), np.array(at[1::2])
    starts, ends = np.append(starts, 0), np.append(ends, 5000)  # longer than what is done aside
    got = resampling.advance(np.full(len(starts), np.uint32(0xFFFFFFFF)), np.frombuffer(raw, np.uint8), starts, ends - starts) ^ np.uint32(0xFFFFFFFF)
    assert got.tolist() == [zlib.crc32(raw[a:b]) for a, b in zip(starts, ends, strict=True)]


# --- source divergence -----------------------------------------------------------------------------------------------
def brute_divergence(docs, least=10, best=10):
    """docs: (lang, source, text)."""
    docs = [(lang or "", source or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", lower(text))) for lang, source, text in docs]
    out = []
    for lang in {d[0] for d in docs}:
        of = [d for d in docs if d[0] == lang]
        in_docs = Counter(t for d in of for t in set(d[2]))
        kept = sorted((t for t, n in in_docs.items() if n >= least), key=str.encode)
        sources = sorted({d[1] for d in of}, key=str.encode)
        counts = {s: Counter(t for d in of if d[1] == s for t in d[2] if in_docs[t] >= least) for s in sources}
        share = lambda c: {t: 1 + 10**9 * (c[t] + 2) // (sum(c.values()) + 2 * len(kept)) for t in kept}
        p, q = {s: share(c) for s, c in counts.items()}, share(sum(counts.values(), Counter()))
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for s in sources:
            pairs = sorted(((-sum(f(p[s][t], p[o][t]) for t in kept), o.encode()) for o in sources if o != s))
            terms = sorted((-f(p[s][t], q[t]), t.encode()) for t in kept if counts[s][t] and p[s][t] > q[t])[:best]
            out += [(lang, s, part, o.decode(), -v, k) for part, found in (("pair", pairs), ("term", terms)) for k, (v, o) in enumerate(found, 1)]
    return out


def test_divergence(spark, sf_dir):
    got = divergence.op12_divergence(spark, sf_dir)
    docs = [(r["lang"], r["source"], r["text"]) for r in common.documents(spark, sf_dir).collect()]
    sql = duck(sf_dir, divergence.SQL)
    assert sql.columns == got.columns and dict(got.dtypes) | {"value": "bigint", "rank": "int"} == dict(got.dtypes)
    assert plain(got.collect()) == plain(brute_divergence(docs)) == plain(sql.fetchall())


def test_divergence_edges(spark, edges, monkeypatch):
    rows = [(r["lang"], r["source"], r["text"]) for r in edges.collect()]
    for least, best in ((1, 10), (2, 3), (99, 10)):
        assert plain(divergence.audit(edges, least, best).collect()) == plain(brute_divergence(rows, least, best))
    assert divergence.audit(edges.limit(0)).count() == 0
    # tries handed on after each slice, rows of one leaf, one term in a batch's matrix, nothing sent to all executors
    rng = random.Random(5)
    words = ["a", "ab", "abc", "abd", "b", "é", "éa", "中", "中文", "the", "there", "then", "Then"]
    many = [(rng.choice(["en", "de", None]), rng.choice("xyz"), " ".join(rng.choices(words, k=rng.randint(0, 30)))) for _ in range(300)]
    df = spark.createDataFrame(many, "lang string, source string, text string").repartition(7)
    want = plain(brute_divergence(many, 5, 4))
    monkeypatch.setattr(divergence, "ROW", 1)
    monkeypatch.setattr(divergence, "PREFIX", 2)
    monkeypatch.setattr(divergence, "KEPT", 1)
    monkeypatch.setattr(divergence, "CELLS", 1)
    monkeypatch.setattr(common, "SENT", -1)
    monkeypatch.setattr(common, "small", lambda df, most=0: False)
    monkeypatch.setattr(common, "DEALT", 5)
    assert plain(divergence.audit(df, 5, 4, leaves=1).collect()) == want
    subtrees = common.written(divergence.counted(df, 1), "subtrees")
    terms = [[(r["lang"], r["term"], sorted(zip(r["sources"], r["counts"], strict=True))) for r in divergence.merged(subtrees, 5, most).collect()] for most in (1, 50_000)]
    assert sorted(terms[0]) == sorted(terms[1]) != []


def test_tries_merge():
    rng = random.Random(6)
    terms = [bytes(rng.choices(b"ab\xc3", k=rng.randint(1, 9))) for _ in range(3000)] + [b"a" * 100, b"a" * 100 + b"b", b"a" * 101]
    leaves = [(f"l{k % 2}", t) for k, t in enumerate(terms)]
    n = len(leaves)
    trie = divergence.Trie.merged(leaves, np.ones(n, np.int64), np.arange(n), np.arange(n) % 3, np.full(n, 2))
    assert trie.leaves == sorted(set(leaves)) and dict(zip(trie.leaves, trie.docs.tolist(), strict=True)) == Counter(leaves)
    want = Counter((leaf, k % 3) for k, leaf in enumerate(leaves))
    assert {(trie.leaves[o], s): c for o, s, c in zip(trie.owner.tolist(), trie.sources.tolist(), trie.counts.tolist(), strict=True)} == {k: 2 * c for k, c in want.items()}
    ascending = sorted(set(terms))
    shared = lambda a, b: next((k for k in range(min(len(a), len(b))) if a[k] != b[k]), min(len(a), len(b)))
    assert divergence.shared_bytes(pa.array(ascending, pa.binary())).tolist() == [0, *map(shared, ascending, ascending[1:])]
    some = trie.where(trie.docs >= 3)
    assert some.leaves == [x for x, c in zip(trie.leaves, trie.docs.tolist(), strict=True) if c >= 3] and some.counts.sum() == 2 * some.docs.sum()


def test_shares_are_exact():
    rng = random.Random(7)
    counts = [rng.randrange(10**k) for k in range(1, 15) for _ in range(50)]
    size = [c + rng.randrange(10**14) for c in counts]
    got = divergence.shares(np.array(counts), np.array(size), np.array(50))
    assert got.tolist() == [1 + 10**9 * (c + 2) // (n + 100) for c, n in zip(counts, size, strict=True)]


# --- token counts ----------------------------------------------------------------------------------------------------
@pytest.fixture(scope="module")
def vocabulary():
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def library(path):
    from tokenizers import Tokenizer

    found = Tokenizer.from_file(path)
    return lambda text: len(found.encode(text or "", add_special_tokens=False).ids)


def test_token_counts(spark, sf_dir, edges, vocabulary):
    count = library(vocabulary)
    want = lambda i, t: (i, len((t or "").encode()), count(t), count(t) > 512)
    got = tokens.op13_token_counts(spark, sf_dir)
    assert got.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"]
    assert plain(got.collect()) == plain(want(r["doc_id"], r["text"]) for r in common.documents(spark, sf_dir).collect())
    assert plain(tokens.counted(edges, vocabulary).collect()) == plain(want(*r) for r in EDGES)
    assert tokens.counted(edges.limit(0), vocabulary).count() == 0


def test_token_counts_of_odd_texts(vocabulary, monkeypatch):
    count, counter, rng = library(vocabulary), tokens.load(vocabulary), random.Random(8)
    bits = ["a", "the", " ", "  ", "\n", "\t", "é", "中", "'s", "'S", "9", "½", "\x1c", "\x85", " ", "　", "😀", "<|endoftext|>", "<|end", "!!", "=", "́", "\x00", "‍"]
    for part in (1 << 20, 3):  # parts as short as can be, too
        monkeypatch.setattr(tokens, "PART", part)
        for _ in range(1500):
            text = "".join(rng.choices(bits, k=rng.randint(0, 40)))
            assert counter.count(text) == count(text), repr(text)
    monkeypatch.setattr(tokens, "KEPT", 5)
    for _ in range(300):
        text = " ".join("".join(rng.choices("abcdefé", k=9)) for _ in range(9))
        assert counter.count(text) == count(text)
    assert len(counter) <= 5 + len(counter.whole) + 1


def test_whole_tokens_are_proved(vocabulary):
    count, counter = library(vocabulary), tokens.load(vocabulary)
    assert len(counter.whole) > 49_000
    assert all(count(t) == 1 for t in random.Random(9).sample(sorted(counter.whole), 3000) if counter.split(t) == [t])


def test_long_pretokens(vocabulary):
    counter, began = tokens.load(vocabulary), time.time()
    for text in ("a" * 400_000, "ab" * 200_000, " " * 400_000, "=" * 400_000, "é" * 200_000):
        assert counter.count(text) > 0
    assert time.time() - began < 60


def test_other_vocabularies_are_refused():
    import public_tokenizers

    with pytest.raises(ValueError):
        tokens.Counter(public_tokenizers.path("word_bpe_49k.json"))
