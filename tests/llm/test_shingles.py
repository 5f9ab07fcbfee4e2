"""Near-duplicates of the pipeline's stage against exact Jaccard similarity of five-word shingles."""

import pytest

import corpus_pipeline
from measurelake.llm import simhash

SF = "/root/testdata/sf0.01"


def brute_set(text):
    words = (text or "").encode().lower().split()
    return frozenset(tuple(words[a : a + 5]) for a in range(max(1, len(words) - 4))) if words else frozenset()


def brute_kept(rows):
    """The least id of every component of texts at similarity 0.8 or more."""
    least = {}
    for d, text in rows:
        own = brute_set(text)
        least[own] = min(least.get(own, d), d)
    sets = sorted(least, key=least.get)
    parent = list(range(len(sets)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if 5 * min(len(a), len(b)) >= 4 * max(len(a), len(b)) > 0:
                both = len(a & b)
                if 5 * both >= 4 * (len(a) + len(b) - both):
                    low, high = sorted((find(i), find(j)))
                    parent[high] = low
    return {least[sets[i]] for i in range(len(sets)) if find(i) == i}


def changed(base, places):
    words = [f"w{base}n{i}" for i in range(200)]
    for p in places:
        words[p] = f"x{base}p{p}"
    return " ".join(words)


def stage(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    return {r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, docs, SF).collect()}


def test_one_changed_word_in_200(spark):
    rows = [(1000 * k + b, changed(b, range(10, 10 + 30 * k, 30))) for b in range(30) for k in (0, 1, 4)]
    assert stage(spark, rows) == set(range(30)) == brute_kept(rows)  # Jaccard 0.95 and 0.81
    rows = [(1000 * k + b, changed(b, range(10, 10 + 30 * k, 30))) for b in range(30) for k in (0, 5)]
    assert stage(spark, rows) == {d for d, _ in rows} == brute_kept(rows)  # Jaccard 0.77


def test_stage_on_the_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = {r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, docs, SF).collect()}
    assert got == brute_kept([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])


@pytest.mark.parametrize("bucket_nodes", [simhash.BUCKET_NODES, 7])
def test_dense_group_in_chunks(spark, monkeypatch, bucket_nodes):
    monkeypatch.setattr(simhash, "BUCKET_NODES", bucket_nodes)
    rows = [(p, changed(0, [p])) for p in range(200)] + [(500, None), (501, " "), (502, "A b"), (503, "a  B")]
    assert stage(spark, rows) == {0, 500, 502} == brute_kept(rows)


def test_recall_of_parts():
    """Sets at similarity 0.8 share a part, whatever their size and on whichever side the difference lies."""
    import numpy as np

    rng = np.random.default_rng(3)
    missed = asked = 0
    for n in (4, 5, 9, 10, 20, 33, 64, 127, 128, 200, 511, 1000, 4000):
        for grow in (0.0, 0.5, 1.0):
            for _ in range(60):
                # c common hashes, a only in one set, b only in the other: c / (a + b + c) >= 0.8.
                apart = n // 5
                a = int(apart * grow)
                pool = rng.integers(0, 2**64, n, dtype=np.uint64)
                common, left, right = pool[apart:], pool[:a], pool[a:apart]
                one, two = (np.unique(np.concatenate([common, x])) for x in (left, right))
                if len(common) and 5 * len(common) >= 4 * n:
                    asked += 1
                    missed += not set(simhash.part_cells(one).tolist()) & set(simhash.part_cells(two).tolist())
    assert asked > 2000 and missed <= 0.002 * asked


def test_unrelated_sets_share_no_part():
    import numpy as np

    rng = np.random.default_rng(4)
    sets = [np.unique(rng.integers(0, 2**64, 300, dtype=np.uint64)) for _ in range(300)]
    cells = [c for s in sets for c in set(simhash.part_cells(s).tolist())]
    assert len(cells) == len(set(cells))
