"""Ranked search against scoring every document."""

import math
import random
import re

import duckdb
import pyarrow as pa
import pytest

from measurelake.llm import queries, ranked

SF = "/root/testdata/sf0.01"
UPPER = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})


def terms_of(text):
    return re.findall(ranked.TERM, (text or "").translate(UPPER))


def brute(docs, items, k=10):
    words = [(i, terms_of(t)) for i, t in docs]
    n_docs, n_terms = sum(bool(w) for _, w in words), sum(len(w) for _, w in words)
    df = {}
    for _, w in words:
        for t in set(w):
            df[t] = df.get(t, 0) + 1
    asked = {}
    for i, t in items:
        asked.setdefault(i, set()).update(terms_of(t))
    out = set()
    for item, terms in asked.items():
        found = []
        for doc, w in words:
            score = 0
            for t in terms & set(w):
                weight = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                m, tf = 100 - 90 + (90 * len(w) * n_docs) // n_terms, w.count(t)
                score += weight * ((1_000_000_000 * tf) // (1000 * tf + 8 * m))
            if score > 0:
                found.append((-score, doc is None, doc))
        found.sort(key=lambda f: (f[0], f[1], f[2] or 0))
        out |= {(item, r + 1, f[2], -f[0]) for r, f in enumerate(found[:k])}
    return out


def run(spark, docs, items, k=10):
    d = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 AS block", "'x' AS term", "2 AS t", "3 AS query")
    i = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "1 AS rank")
    return [tuple(r) for r in ranked.search(ranked.build_index(d.repartition(3)), i, k).collect()]


WORDS = ["ab", "Ab", "the", "ñandú", "x1", "zz", "q", "été", "I", "i", "ı", "Ñ", "a_b", "日本", "9"]


@pytest.mark.parametrize("sizes", [{}, {"BLOCK_DOCS": 7, "PANEL_QUERIES": 3}, {"BLOCK_BYTES": 60, "PANEL_BYTES": 40, "KNOWN_BLOCKS": 0}])
def test_against_all_documents(spark, sizes, monkeypatch):
    for name, value in sizes.items():
        monkeypatch.setattr(ranked, name, value)
    rng = random.Random(4)
    docs = [(i, rng.choice([" ", ", ", "-", "\n"]).join(rng.choices(WORDS, k=rng.randrange(0, 40)))) for i in range(120)]
    docs += [(200 + i, docs[5][1]) for i in range(30)] + [(7, docs[7][1]), (None, docs[5][1]), (None, "zz zz"), (300, None), (301, ""), (302, "\x00 !?"), (303, "zz " * 60_000)]
    items = [(i, " ".join(rng.choices(WORDS + ["unseen"], k=rng.randrange(1, 9)))) for i in range(10)]
    items += [(50, None), (51, ""), (52, "unseen"), (53, "zz zz ZZ"), (53, "q"), (None, "ab")]
    got = run(spark, docs, items)
    assert len(got) == len(set(got))
    assert set(got) == brute(docs, items)


def test_many_copies(spark):
    """All copies tie; the smallest ids win, whatever block they are in."""
    docs = [(i, "apple pear plum") for i in range(500, 0, -1)] + [(1000, "apple pear plum fig"), (1001, "fig")]
    items = [(1, "apple"), (2, "fig plum")]
    assert set(run(spark, docs, items)) == brute(docs, items)


def test_empty_tables(spark):
    assert run(spark, [], [(1, "a")]) == []
    assert run(spark, [(1, "a")], []) == []
    assert run(spark, [(1, None)], [(1, "a")]) == []


def test_bounds_hold():
    """A byte's impact is never below the exact one, nor a step or more above it."""
    import numpy as np

    rng = np.random.default_rng(3)
    tf, n = rng.integers(1, 2000, 5000), rng.integers(2000, 3_000_000, 5000)
    r = ranked.impacts(tf, n, 1_000_000, 300_000_000)
    u = (r * ranked.STEPS + ranked.FULL - 1) // ranked.FULL
    assert (u * ranked.FULL >= r * ranked.STEPS).all() and ((u - 1) * ranked.FULL < r * ranked.STEPS).all() and u.max() <= 255


def test_terms_equal_the_pattern():
    texts = ["", "a", " a", "a ", "aB_c1-Ñé İ x\x7fy\x80", None, "zz", "\x00"]
    names, term, doc = ranked._terms(pa.array(texts))
    got = [[] for _ in texts]
    for t, d in zip(term, doc):
        got[d].append(names[int(t)].as_py())
    assert got == [terms_of(t) for t in texts]
    assert ranked.lengths(pa.array(texts)).tolist() == [len(terms_of(t)) for t in texts]


def test_query_against_sql(spark):
    c = duckdb.connect()
    for t in ("documents", "benchmark"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    q = c.execute(ranked.ORACLE_SQL)
    names = [x[0] for x in q.description]
    df = queries.op12_ranked_search(spark, SF)
    assert sorted(names) == sorted(df.columns)
    got, want = sorted(tuple(r) for r in df.select(names).collect()), sorted(q.fetchall())
    assert got == want and len(want) == 400
