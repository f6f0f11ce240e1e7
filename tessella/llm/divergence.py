"""Audit of how far sources of one language differ, by tries of their terms.

Each task counts the terms of its texts and makes byte tries of them (radix: an edge carries a run of bytes), whose leaves
hold the documents of the language that have the term and its occurrences by source. Tries are handed on as subtrees: the
leaves below one prefix, in order of their bytes, of each the bytes that the one before it does not share. Subtrees are dealt
by ranges of (language, prefix) and merged, and a walk in byte order gives the terms in enough documents. That table is read twice:
for the number of occurrences in every source, and in batches that give, for every pair of sources, the sum of the
differences over the terms, and for every source the best few terms. What a task holds is a trie of bounded size, the terms
of one prefix, or a matrix of the sources of one language; no term is dealt to a task by itself, however common it is.

Whole numbers throughout: a share p = 1 + floor(SCALE * (count + 2) / (N + 2 * V)) by long division in 64 bits (for N + 2 * V
up to 9e15), a difference floor((p - q)^2 / (p + q)).

Null text, language and source count as ''. A group without terms has its shares all the same; a language without kept terms
has value 0 for its pairs and no terms; a source alone in its language has no pairs and, as its shares are those of the
language, no terms. Rows that repeat a doc_id are documents of their own. Terms and texts may have any length. An empty
table gives an empty result. Only text, lang and source are read.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import common

#: Documents of its language that a kept term is in, what shares are multiplied by, and terms reported for a source.
LEAST, SCALE, BEST = 10, 1_000_000_000, 10
#: Counters of a task's leaves before they are handed on; bytes of a prefix; leaves in one row; leaves that are merged at
#: once; cells of a batch's matrix.
LEAVES, PREFIX, ROW, MERGED, CELLS = 1_000_000, 4, 64, 50_000, 1 << 20
#: Sources of a language up to which a task adds up its pairs before it hands them on.
KEPT = 1000
#: Bytes of a term that are compared beside those of other terms.
_ASIDE = 64

#: A-Z become small; all bytes but letters and those of characters beyond ASCII become spaces.
_TERM = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def shared_bytes(terms: pa.Array) -> np.ndarray:
    """How many bytes each of ascending binary terms shares with the one before it."""
    n = len(terms)
    if n < 2:
        return np.zeros(n, np.int64)
    size = pc.binary_length(terms).to_numpy().astype(np.int64)
    raw, at = np.frombuffer(terms.buffers()[2], np.uint8), np.frombuffer(terms.buffers()[1], np.int32)[:n].astype(np.int64)
    most = np.minimum(size[1:], size[:-1])
    out, open_ = np.zeros(n - 1, np.int64), np.arange(n - 1)
    for k in range(_ASIDE):  # byte k of all pairs that share the bytes before it
        open_ = open_[most[open_] > k]
        open_ = open_[raw[at[open_] + k] == raw[at[open_ + 1] + k]]
        if not len(open_):
            break
        out[open_] = k + 1
    for i in open_[most[open_] > _ASIDE].tolist():  # terms alike in more bytes than any but junk has
        a, b = raw[at[i] : at[i] + most[i]], raw[at[i + 1] : at[i + 1] + most[i]]
        differ = np.flatnonzero(a != b)
        out[i] = differ[0] if len(differ) else most[i]
    return np.concatenate(([0], out))


class Trie:
    """A radix trie of the terms of languages, held flat: its leaves in order of (language, bytes), with the documents of each
    and its occurrences by source (for leaf owner[i], source sources[i]: counts[i]). Its inner nodes are the runs of leaves
    that share their first bytes; so a subtree is a slice, a walk in byte order goes from left to right, and tries merge by
    going through their leaves once."""

    def __init__(self, leaves: list[tuple[str, bytes]], docs: np.ndarray, owner: np.ndarray, sources: np.ndarray, counts: np.ndarray):
        self.leaves, self.docs, self.owner, self.sources, self.counts = leaves, docs, owner, sources, counts

    @classmethod
    def merged(cls, leaves: list[tuple[str, bytes]], docs: np.ndarray, owner: np.ndarray, sources: np.ndarray, counts: np.ndarray) -> Trie:
        """The trie of the leaves of several, in any order, of which some may be alike: their counters add up."""
        found = sorted(set(leaves))
        place = dict(zip(found, range(len(found)), strict=True))
        to = np.fromiter(map(place.__getitem__, leaves), np.int64, len(leaves))
        total = np.zeros(len(found), np.int64)
        np.add.at(total, to, docs)
        by = to[owner]
        order = np.lexsort((sources, by))
        by, sources, counts = by[order], sources[order], counts[order]
        first = np.flatnonzero(np.concatenate(([True], (by[1:] != by[:-1]) | (sources[1:] != sources[:-1])))) if len(by) else by
        return cls(found, total, by[first], sources[first], np.add.reduceat(counts, first) if len(by) else counts)

    def where(self, kept: np.ndarray) -> Trie:
        """The trie of some of its leaves."""
        to, of = np.cumsum(kept) - 1, kept[self.owner]
        return Trie([x for x, fine in zip(self.leaves, kept.tolist(), strict=True) if fine], self.docs[kept], to[self.owner[of]], self.sources[of], self.counts[of])


#: A row is a subtree: leaves below one prefix, ROW at most. Of each leaf: the bytes it shares with the one before it in the
#: row, the others, its documents, how many sources it has; then the sources (places in names) and occurrences of all.
_SUBTREE = "lang string, prefix binary, shared array<int>, rest array<binary>, docs array<long>, sizes array<int>, names array<string>, sources array<int>, counts array<long>"


def _lists(values: pa.Array, ends: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], ends)), pa.int32()), values)


def _subtrees(trie: Trie, names: list[str]) -> Iterator[pa.RecordBatch]:
    """A trie as rows, those of a language in one batch."""
    langs = np.array([lang for lang, _ in trie.leaves])
    edges = [0, *(np.flatnonzero(langs[1:] != langs[:-1]) + 1).tolist(), len(langs)] if len(langs) else [0]
    for lo, hi in zip(edges, edges[1:], strict=False):
        terms = [term for _, term in trie.leaves[lo:hi]]
        shared = shared_bytes(pa.array(terms, pa.binary()))
        fresh = shared < PREFIX  # another prefix begins
        fresh[0] = True
        within = np.arange(hi - lo) - np.flatnonzero(fresh)[np.cumsum(fresh) - 1]
        heads = np.flatnonzero(within % ROW == 0)
        shared[heads] = 0
        ends = np.append(heads[1:], hi - lo)
        a, b = np.searchsorted(trie.owner, [lo, hi])
        owner = trie.owner[a:b] - lo
        sizes = np.bincount(owner, minlength=hi - lo)
        upto = np.cumsum(sizes)[ends - 1]
        codes, said, said_ends = np.empty(b - a, np.int32), [], []
        for x, y in zip([0, *upto[:-1].tolist()], upto.tolist(), strict=True):
            used, codes[x:y] = np.unique(trie.sources[a + x : a + y], return_inverse=True)
            said.extend(names[k] for k in used.tolist())
            said_ends.append(len(said))
        columns = (
            pa.array([trie.leaves[lo][0]] * len(heads), pa.string()),
            pa.array([terms[k][:PREFIX] for k in heads.tolist()], pa.binary()),
            _lists(pa.array(shared, pa.int32()), ends),
            _lists(pa.array([t[k:] for t, k in zip(terms, shared.tolist(), strict=True)], pa.binary()), ends),
            _lists(pa.array(trie.docs[lo:hi]), ends),
            _lists(pa.array(sizes, pa.int32()), ends),
            _lists(pa.array(said, pa.string()), np.array(said_ends)),
            _lists(pa.array(codes), upto),
            _lists(pa.array(trie.counts[a:b]), upto),
        )
        yield pa.RecordBatch.from_arrays(list(columns), ["lang", "prefix", "shared", "rest", "docs", "sizes", "names", "sources", "counts"])


def counted(docs: DataFrame, leaves: int = LEAVES) -> DataFrame:
    """The tries of every task, as subtrees."""

    def trie_of(found: dict[tuple[str, str], Counter], docs: dict[str, Counter]) -> Iterator[pa.RecordBatch]:
        names = sorted({source for _, source in found})
        code = {source: k for k, source in enumerate(names)}
        for lang, of in docs.items():
            place = dict(zip(of, range(len(of)), strict=True))
            groups = [(code[source], by) for (of_lang, source), by in found.items() if of_lang == lang and by]
            owner = np.concatenate([np.zeros(0, np.int64), *(np.fromiter(map(place.__getitem__, by), np.int64, len(by)) for _, by in groups)])
            counts = np.concatenate([np.zeros(0, np.int64), *(np.fromiter(by.values(), np.int64, len(by)) for _, by in groups)])
            sources = np.repeat(np.array([k for k, _ in groups], np.int64), [len(by) for _, by in groups])
            leaves = [(lang, term) for term in of]
            yield from _subtrees(Trie.merged(leaves, np.fromiter(of.values(), np.int64, len(of)), owner, sources, counts), names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[tuple[str, str], Counter] = defaultdict(Counter)
        docs: dict[str, Counter] = defaultdict(Counter)
        for batch in batches:
            for part in common.slices(batch, "text"):
                for lang, source, text in zip(*(part.column(c).to_pylist() for c in ("lang", "source", "text")), strict=True):
                    terms = (text or "").encode().translate(_TERM).split()
                    found[lang or "", source or ""].update(terms)
                    docs[lang or ""].update(set(terms))
                if sum(map(len, found.values())) >= leaves:
                    yield from trie_of(found, docs)
                    found.clear()
                    docs.clear()
        yield from trie_of(found, docs)

    return docs.select("lang", "source", "text").mapInArrow(run, _SUBTREE)


def merged(subtrees: DataFrame, least: int = LEAST, most: int = MERGED) -> DataFrame:
    """lang, term, sources, counts (in the same order) of the terms in enough documents, from stored subtrees. These are dealt
    by ranges of (language, prefix); a task holds `most` leaves and the merged ones of a prefix."""
    flat = lambda batch, name: pc.list_flatten(batch.column(name))

    def out(trie: Trie, names: list[str]) -> pa.RecordBatch:
        trie = trie.where(trie.docs >= least)
        ends = np.cumsum(np.bincount(trie.owner, minlength=len(trie.leaves)))
        said = pa.array(names, pa.string()).take(pa.array(trie.sources))
        columns = [pa.array([lang for lang, _ in trie.leaves], pa.string()), pa.array([term.decode() for _, term in trie.leaves], pa.string()), _lists(said, ends), _lists(pa.array(trie.counts), ends)]
        return pa.RecordBatch.from_arrays(columns, ["lang", "term", "sources", "counts"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code: dict[str, int] = {}
        held: list[tuple] = []  # leaves, docs, sizes, sources, counts of batches or parts of them
        n, full, last = 0, 4 * most, None

        def merge() -> Trie:
            leaves = [x for part in held for x in part[0]]
            docs, sizes, sources, counts = (np.concatenate([part[k] for part in held]) for k in (1, 2, 3, 4))
            return Trie.merged(leaves, docs, np.repeat(np.arange(len(leaves)), sizes), sources, counts)

        for batch in batches:
            langs, prefixes = batch.column("lang").to_pylist(), batch.column("prefix").to_pylist()
            length = pc.list_value_length(batch.column("rest")).to_numpy()
            places = np.fromiter((code.setdefault(x, len(code)) for x in flat(batch, "names").to_pylist()), np.int64)
            entries = pc.list_value_length(batch.column("sources")).to_numpy()
            first = np.cumsum(pc.list_value_length(batch.column("names")).to_numpy()) - pc.list_value_length(batch.column("names")).to_numpy()
            sources = places[flat(batch, "sources").to_numpy() + np.repeat(first, entries)] if len(places) else np.zeros(0, np.int64)
            leaves, before = [], b""
            of = np.repeat(np.arange(len(batch)), length).tolist()
            for row, k, rest in zip(of, flat(batch, "shared").to_pylist(), flat(batch, "rest").to_pylist(), strict=True):
                before = before[:k] + rest
                leaves.append((langs[row], before))
            docs, sizes, counts = (flat(batch, c).to_numpy() for c in ("docs", "sizes", "counts"))
            keys = list(zip(langs, prefixes, strict=True))
            at, to = np.concatenate(([0], np.cumsum(length))), np.concatenate(([0], np.cumsum(entries)))
            lo = 0
            for hi in [*(k for k in range(1, len(keys)) if keys[k] != keys[k - 1]), len(keys)]:
                if keys[lo] != last and n >= most:  # a prefix ends here
                    yield out(merge(), list(code))
                    held, n, full = [], 0, 4 * most
                held.append((leaves[at[lo] : at[hi]], docs[at[lo] : at[hi]], sizes[at[lo] : at[hi]], sources[to[lo] : to[hi]], counts[to[lo] : to[hi]]))
                n += int(at[hi] - at[lo])
                if n >= full:  # within one prefix
                    trie = merge()
                    n = len(trie.leaves)
                    held, full = [(trie.leaves, trie.docs, np.bincount(trie.owner, minlength=n), trie.sources, trie.counts)], 2 * n + 4 * most
                last, lo = keys[lo], hi
        if held:
            yield out(merge(), list(code))

    ranges = subtrees.repartitionByRange("lang", "prefix").sortWithinPartitions("lang", "prefix")
    return ranges.mapInArrow(run, "lang string, term string, sources array<string>, counts array<long>")


def shares(counts: np.ndarray, size: np.ndarray, terms: np.ndarray) -> np.ndarray:
    """1 + floor(SCALE * (counts + 2) / (size + 2 * terms)), exact: three digits of the quotient at a time."""
    left, by, out = counts + 2, size + 2 * terms, np.zeros(np.broadcast(counts, size).shape, np.int64)
    for _ in range(3):
        left = left * 1000
        out = out * 1000 + left // by
        left = left % by
    return out + 1


def differences(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // (p + q)


def _compared(best: int):
    """Rows (lang, source, item, value): part `term`: candidates of this partition; part `pair`: sums over its terms, item by
    the place of the other source among the language's."""
    schema = pa.schema([("part", pa.string()), ("lang", pa.string()), ("source", pa.string()), ("item", pa.string()), ("value", pa.int64()), ("values", pa.list_(pa.int64()))])

    def out(part: str, lang: str, found: list[tuple]) -> pa.RecordBatch:
        source, item, value, values = zip(*found, strict=True)
        n = len(found)
        return pa.RecordBatch.from_arrays([pa.array([part] * n), pa.array([lang] * n), pa.array(source, pa.string()), pa.array(item, pa.string()), pa.array(value, pa.int64()), pa.array(values, pa.list_(pa.int64()))], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        names: dict[str, list[str]] = {}
        tops: dict[tuple[str, str], list[tuple[int, bytes]]] = defaultdict(list)
        for batch in batches:
            order = pc.sort_indices(batch.column("term").cast(pa.binary()))  # of equal values the first term comes first
            batch = batch.take(order)
            for lang in pc.unique(batch.column("lang")).to_pylist():
                of = batch.filter(pc.equal(batch.column("lang"), lang))
                every = of.column("every")[0].as_py()
                size, all_size, n_terms = (np.array(of.column(c)[0].as_py(), np.int64) for c in ("sizes", "size", "n_terms"))
                names[lang], m = every, len(every)
                step = max(1, CELLS // m)
                for lo in range(0, len(of), step):
                    part = of.slice(lo, step)
                    rows = pc.list_parent_indices(part.column("sources")).to_numpy()
                    places = pc.index_in(pc.list_flatten(part.column("sources")), value_set=pa.array(every, pa.string())).to_numpy()
                    counts = np.zeros((len(part), m), np.int64)
                    counts[rows, places] = pc.list_flatten(part.column("counts")).to_numpy()
                    p, q = shares(counts, size[None, :], n_terms), shares(counts.sum(axis=1), all_size, n_terms)[:, None]
                    f = np.where((counts > 0) & (p > q), differences(p, q), -1)
                    terms = part.column("term")
                    for k in range(m):
                        ahead = np.argsort(-f[:, k], kind="stable")[:best]
                        more = [(-int(f[i, k]), terms[int(i)].as_py().encode()) for i in ahead if f[i, k] >= 0]
                        if more:
                            tops[lang, every[k]] = sorted(tops[lang, every[k]] + more)[:best]
                    if m > KEPT:
                        for k in range(m):
                            yield out("pair", lang, [(every[k], None, None, differences(p[:, k : k + 1], p).sum(axis=0).tolist())])
                    elif m > 1:
                        total = sums.setdefault(lang, np.zeros((m, m), np.int64))
                        for k in range(m):
                            total[k] += differences(p[:, k : k + 1], p).sum(axis=0)
        for lang, total in sums.items():
            yield out("pair", lang, [(source, None, None, row.tolist()) for source, row in zip(names[lang], total, strict=True)])
        for (lang, source), found in tops.items():
            yield out("term", lang, [(source, term.decode(), -value, None) for value, term in found])

    return run


def audit(docs: DataFrame, least: int = LEAST, best: int = BEST, leaves: int = LEAVES) -> DataFrame:
    """lang, source, part (pair, term), item, value, rank: for each source of a language all others by how far their terms'
    shares are from its own, and the terms that it has more often than its language, by the difference."""
    subtrees = common.written(counted(docs, leaves), "subtrees")
    terms = common.written(merged(subtrees, least), "terms")
    groups = docs.select(*(F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source"))).distinct()
    occurred = terms.select("lang", F.explode(F.arrays_zip("sources", "counts")).alias("x")).groupBy("lang", F.col("x.sources").alias("source")).agg(F.sum("x.counts").alias("n"))
    groups = groups.join(occurred, ["lang", "source"], "left").select("lang", F.struct("source", F.coalesce("n", F.lit(0)).alias("n")).alias("x"))
    langs = groups.groupBy("lang").agg(F.sort_array(F.collect_list("x")).alias("x"), F.sum("x.n").alias("size"))
    n_terms = terms.groupBy("lang").agg(F.count("*").alias("n_terms"))
    langs = langs.join(n_terms, "lang", "left").select("lang", F.col("x.source").alias("every"), F.col("x.n").alias("sizes"), "size", F.coalesce("n_terms", F.lit(0)).alias("n_terms"))
    langs = common.written(langs, "languages")
    with_all = common.join_groups(terms, langs, ["lang"], spread="term")
    schema = "part string, lang string, source string, item string, value long, values array<long>"
    found = common.written(with_all.mapInArrow(_compared(best), schema), "compared")
    place = F.posexplode("values").alias("k", "value")
    sums = found.where("part = 'pair'").select("lang", "source", place).groupBy("lang", "source", "k").agg(F.sum("value").alias("value"))
    every = langs.select("lang", F.explode("every").alias("source"), "every").select("lang", "source", F.posexplode("every").alias("k", "item")).where("source != item")
    pairs = every.join(sums, ["lang", "source", "k"], "left").select("lang", "source", F.lit("pair").alias("part"), "item", F.coalesce("value", F.lit(0)).alias("value"))
    order = W.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = pairs.withColumn("rank", F.row_number().over(order))
    words = found.where("part = 'term'").select("lang", "source", "part", "item", "value").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= best)
    return pairs.unionByName(words)


def op12_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(common.documents(spark, sf_dir))


SQL = r"""
WITH t AS MATERIALIZED (
    SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
        regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS x
    FROM documents
), g AS (SELECT DISTINCT lang, source FROM t
), w AS MATERIALIZED (SELECT lang, source, r, unnest(x) AS term FROM t
), k AS MATERIALIZED (SELECT lang, term FROM w GROUP BY lang, term HAVING count(DISTINCT r) >= 10
), v AS (SELECT lang, count(*) AS v FROM k GROUP BY lang
), c AS MATERIALIZED (SELECT lang, source, term, count(*) AS n FROM w JOIN k USING (lang, term) GROUP BY ALL
), n AS (SELECT lang, source, sum(n) AS n FROM c GROUP BY ALL
), p AS MATERIALIZED (
    SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, 1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 2)) // (coalesce(n.n, 0) + 2 * v.v) AS p
    FROM g JOIN k ON g.lang = k.lang JOIN v ON g.lang = v.lang LEFT JOIN n ON n.lang = g.lang AND n.source = g.source
        LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term
), q AS (
    SELECT lang, term, 1 + (1000000000::HUGEINT * (sum(n) + 2)) // (any_value(a) + 2 * any_value(v)) AS q
    FROM c JOIN v USING (lang) JOIN (SELECT lang, sum(n) AS a FROM c GROUP BY lang) USING (lang) GROUP BY lang, term
), pairs AS (
    SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value
    FROM p AS a JOIN p AS b ON a.lang = b.lang AND a.term = b.term AND a.source != b.source GROUP BY ALL
), parts AS (
    SELECT x.lang, x.source, 'pair' AS part, y.source AS item, coalesce(value, 0)::BIGINT AS value
    FROM g AS x JOIN g AS y ON x.lang = y.lang AND x.source != y.source LEFT JOIN pairs ON pairs.lang = x.lang AND pairs.source = x.source AND pairs.item = y.source
    UNION ALL
    SELECT p.lang, source, 'term', p.term, ((p - q) * (p - q) // (p + q))::BIGINT FROM p JOIN q ON p.lang = q.lang AND p.term = q.term WHERE n > 0 AND p > q
), ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank FROM parts)
SELECT * FROM ranked WHERE part = 'pair' OR rank <= 10
"""
