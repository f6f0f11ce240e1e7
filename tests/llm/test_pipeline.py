"""Every stage of the pipeline against what its operator says of the stage's own input."""

import re

import corpus_pipeline
from tessella.llm import common, mixing, quality

from .test_minhash import brute
from .test_operators import luhn


def test_stages(spark, sf_dir):
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality", "near-duplicates", "pii", "mixing", "bpe"]
    docs = common.documents(spark, sf_dir)
    columns, given = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        out = common.written(stage(spark, docs, sf_dir), name)
        given[name] = (docs.collect(), out.collect())
        if name != "bpe":
            assert out.columns == columns
        docs = out

    before, after = given["quality"]
    scores = {r["doc_id"]: r["score"] for r in quality.classify(common.documents(spark, sf_dir)).collect()}
    assert sorted(r["doc_id"] for r in after) == sorted(i for i, s in scores.items() if s >= 0.5)

    before, after = given["near-duplicates"]
    groups = brute([(r["doc_id"], r["text"]) for r in before], (80, 100))
    assert sorted(r["doc_id"] for r in after) == sorted({c for _, c in groups.values()})

    before, after = given["pii"]
    old = {r["doc_id"]: r for r in before}
    assert sorted(old) == sorted(r["doc_id"] for r in after)
    card = re.compile(r"(?<!\w)\d{16}(?!\w)")
    for r in after:
        assert r["n_chars"] == len(r["text"]) or r["text"] == old[r["doc_id"]]["text"]
        assert not set(card.findall(r["text"])) & set(filter(luhn, card.findall(old[r["doc_id"]]["text"])))

    before, after = given["mixing"]
    copies = {r["doc_id"]: r["copies"] for r in mixing.mix(spark.createDataFrame(before)).collect()}
    counts = {}
    for r in after:
        counts[r["doc_id"]] = counts.get(r["doc_id"], 0) + 1
    assert counts == {i: n for i, n in copies.items() if n}

    before, after = given["bpe"]
    assert len(before) == len(after) and all(r["same"] and r["n_tokens"] == len(r["ids"]) for r in after)
