"""Every query with SQL gives what DuckDB gives for it on the driver's smallest tables."""

import glob
import math
import os
import re

import duckdb
import pytest

from tessella.plans import PLANS

SQL = {name: (m.QUERIES[name], sql) for m in PLANS for name, sql in m.SQL.items()}
REST = {name: q for m in PLANS for name, q in m.QUERIES.items() if name not in m.SQL}


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for f in glob.glob(f"{sf_dir}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}{'/*.parquet' if os.path.isdir(f) else ''}'")
    return con


def plain(x):
    if x is None or isinstance(x, float) and math.isnan(x):
        return "~"
    if isinstance(x, float):
        return repr(round(x, 6) + 0.0)
    return str(x)


def rows(columns, found):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(plain(r[i]) for i in order) for r in found)


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(spark, duck, sf_dir, name):
    query, sql = SQL[name]
    ours = query(spark, sf_dir)
    theirs = duck.sql(sql)
    assert rows(ours.columns, ours.collect()) == rows(theirs.columns, theirs.fetchall())


def fuzzy_titles(duck):
    """Titles of a brand that resemble none kept before them."""
    import difflib

    out, kept = [], {}
    for brand, pos, title in duck.sql("SELECT p_brand, p_partkey, p_name FROM part ORDER BY p_brand, p_partkey, p_name").fetchall():
        known = kept.setdefault(brand, [])
        if not any(difflib.SequenceMatcher(None, title.strip(), k).ratio() >= 0.9 for k in known):
            known.append(title.strip())
            out.append((brand, pos, title))
    return ["p_brand", "pos", "title"], out


def version_diff(duck):
    """A changed line is one removed and one added; the diff applied to the old text gives the new one's lines."""
    out = []
    for doc_id, text in duck.sql("SELECT doc_id, text FROM documents").fetchall():
        import difflib

        new = re.sub(r"e(?=\n|$)", "e!", text)
        diff = list(difflib.unified_diff(text.splitlines(), new.splitlines(), lineterm=""))
        changed = sum(a != b for a, b in zip(text.splitlines(), new.splitlines(), strict=True))
        assert changed == sum(x.startswith("+") for x in diff[2:])
        out.append((doc_id, "\n".join(diff), changed, changed))
    return ["id", "diff", "added", "removed"], out


#: Queries that SQL cannot express, in plain Python; i48 and g04 are in test_functions.py.
PLAIN = {"i55_fuzzy_titles": fuzzy_titles, "e22_version_diff": version_diff}


@pytest.mark.parametrize("name", sorted(REST))
def test_same_as_plain_python(spark, duck, sf_dir, name):
    found = REST[name](spark, sf_dir)
    if name in PLAIN:
        assert rows(found.columns, found.collect()) == rows(*PLAIN[name](duck))
    else:
        assert name in ("i48_passages", "g04_reference_snippets") and found.count() > 0
