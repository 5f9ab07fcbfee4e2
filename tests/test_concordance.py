"""Pair counts by binary digits against every pair."""

import numpy as np
import pytest

from measurelake.operators import concordance


@pytest.mark.parametrize("levels", [3, 40, 1000])
def test_counts_equal_every_pair(spark, levels):
    rng = np.random.default_rng(levels)
    rows = [("a" if i % 3 else None, float(rng.integers(0, levels)), float(rng.integers(0, levels)), int(rng.integers(0, 4)), int(rng.integers(0, 3))) for i in range(200)]
    rows += [("one", 1.0, 1.0, 1, 1), ("tied", 2.0, 1.0, 1, 1), ("tied", 2.0, 3.0, 1, 1), ("a", None, 1.0, 5, 5), ("a", 1.0, None, 5, 5)]
    df = spark.createDataFrame(rows, "g string, x double, y double, l int, r int").repartition(3)
    got = {r.g: r.pairs for r in concordance.dominated(df, ["g"], "x", "y", "l", "r").collect()}
    use = [r for r in rows if None not in r[1:3]]
    want = {g: sum(a[3] * b[4] for a in use for b in use if a[0] == b[0] == g and a[1] < b[1] and a[2] < b[2]) for g in {r[0] for r in use}}
    assert got == want
    ratio = {r.g: (r.concordant, r["all"], r.ratio) for r in concordance.weighted_concordance(df, ["g"], "x", "y", "l").collect()}
    for g in want:
        own = [r for r in use if r[0] == g]
        pairs = [(a[3] * b[3], (a[1] - b[1]) * (a[2] - b[2]) > 0) for i, a in enumerate(own) for b in own[:i]]
        total = sum(w for w, _ in pairs)
        assert ratio[g] == (sum(w for w, c in pairs if c), total, pytest.approx(sum(w for w, c in pairs if c) / total) if total else None)
    assert concordance.dominated(df.limit(0), ["g"], "x", "y", "l", "r").count() == 0


@pytest.mark.parametrize("levels", [2, 30, 5000])
@pytest.mark.parametrize("chunk", [5, 100_000])
def test_large_groups_are_cut(spark, levels, chunk):
    """However a group is cut: ties at cuts, one heavy value, whole and real weights, a group of nulls."""
    rng = np.random.default_rng(levels)
    x, y = rng.integers(0, levels, 900), rng.integers(0, levels, 900)
    x[:200], y[100:300] = levels // 2, levels // 2
    rows = [("a" if i % 4 else None, int(a), float(b), int(rng.integers(0, 10**6)), float(rng.random())) for i, (a, b) in enumerate(zip(x, y))]
    df = spark.createDataFrame([*rows, ("none", None, 1.0, 1, 1.0), ("one", 1, 1.0, 1, 1.0)], "g string, x int, y double, k long, w double").repartition(3)
    got = {r.g: r for r in concordance.dominated_sums(df, ["g"], "x", "y", {"kk": ("k", "k"), "kw": ("k", "w"), "ww": ("w", "w")}, chunk).collect()}
    assert set(got) == {"a", None, "one"} and got["one"].kk == 0
    for g in ("a", None):
        own = [r for r in rows if r[0] == g]
        x, y, k, w = (np.array(c) for c in list(zip(*own))[1:])
        pair = (x[:, None] < x) & (y[:, None] < y)
        assert got[g].kk == sum(int(k[i]) * int(k[pair[i]].sum()) for i in range(len(k)))
        assert (got[g].kw, got[g].ww) == (pytest.approx(k @ (pair @ w)), pytest.approx(w @ (pair @ w)))


def test_sums_beyond_64_bits_raise(spark):
    df = spark.createDataFrame([(i, i, 3 * 10**9) for i in range(3)], "x int, y int, k long")
    with pytest.raises(Exception, match="64 bits"):
        concordance.dominated_sums(df.withColumn("g", df.x * 0), ["g"], "x", "y", {"s": ("k", "k")}).collect()
