"""Tail probabilities, the contrast engine's three branches and the closed forms, against direct computation."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from measurelake.functions import special, tails
from measurelake.operators import contrasts, inference, relational, resampling


def test_tails(spark):
    rows = [(float(t), float(n)) for t in (0, 0.01, 0.894, 2, 3.3, 12, 45, -2) for n in (1, 2, 2.7, 5, 9.5, 144.4, 1000)]
    df = spark.createDataFrame(rows, "x double, n double")
    got = df.select("x", "n", tails.t_two_sided(F.col("x"), F.col("n")).alias("t"), tails.normal_two_sided(F.col("x")).alias("z"), tails.chi2_upper(F.abs("x"), F.floor("n")).alias("c"))
    for r in got.collect():
        assert r.t == pytest.approx(float(special.t_two_sided(r.x, r.n)), rel=2e-9, abs=1e-300)
        assert r.z == pytest.approx(math.erfc(abs(r.x) / math.sqrt(2)), rel=1e-9, abs=1e-300)
        assert r.c == pytest.approx(float(special.chi2_sf(abs(r.x), math.floor(r.n))), abs=1e-9)
    none = spark.range(1).select(tails.t_two_sided(F.lit(None).cast("double"), F.lit(3)), tails.normal_two_sided(F.lit(None).cast("double"))).first()
    assert tuple(none) == (None, None)


def clustered(a, b):
    """Least squares on an arm indicator with errors clustered by unit; a and b map units to values."""
    y = np.array([*a.values(), *b.values()])
    x = np.column_stack([np.ones(len(y)), [1.0] * len(a) + [0.0] * len(b)])
    unit = np.array([*a, *b])
    bread = np.linalg.inv(x.T @ x)
    beta = bread @ x.T @ y
    e = y - x @ beta
    meat = sum(np.outer(s, s) for s in (x[unit == u].T @ e[unit == u] for u in set(unit)))
    g = len(set(unit))
    cov = bread @ meat @ bread * g / (g - 1) * (len(y) - 1) / (len(y) - 2)
    return beta[1], math.sqrt(cov[1, 1])


def test_contrast_branches(spark):
    rng = np.random.default_rng(4)
    T, N = ({i: float(rng.normal(m)) for i in range(n)} for m, n in ((0.4, 9), (0.0, 8)))
    H, A = {i + 5: float(rng.normal()) for i in range(7)}, {i + 100: float(rng.normal(1)) for i in range(6)}
    rows = [(1, u, arm, 0, v) for arm, x in (("T", T), ("N", N), ("H", H), ("A", A)) for u, v in x.items()]
    rows += [(2, u, arm, 0, float(u)) for u in (1, 2) for arm in ("T", "N")] + [(1, 3, "T", 1, 0.5), (1, 4, "N", 1, None)]
    pairs = [("T", "N"), ("T", "H"), ("H", "A")]
    df = spark.createDataFrame(rows, "study int, unit int, arm string, probe int, value double")
    planned = spark.createDataFrame([(s, p, h, low) for s in (1, 2) for p in (0, 1) for h, low in pairs], "study int, probe int, high string, low string")
    got = {(r.study, r.probe, r.high + r.low): r for r in contrasts.contrast_rows(df, planned, pairs, "study", "unit", "arm", "probe", "value", scale=1.0).collect()}
    assert len(got) == 12
    r = got[1, 0, "TN"]
    delta = np.array([T[u] - N[u] for u in T.keys() & N.keys()])
    se = delta.std(ddof=1) / math.sqrt(len(delta))
    assert (r.method, r.status, r.n_high, r.n_low, r.df) == ("paired_t", "estimated", 8, 8, 7.0)
    assert (r.estimate, r.se, r.p) == pytest.approx((delta.mean(), se, float(special.t_two_sided(delta.mean() / se, 7))), abs=1e-8)
    r = got[1, 0, "TH"]
    b, se = clustered(T, H)
    assert (r.method, r.n_high, r.n_low, r.n_shared, r.df) == ("patient_cluster_OLS", 9, 7, 4, None)
    assert (r.estimate, r.se, r.p) == pytest.approx((b, se, math.erfc(abs(b / se) / math.sqrt(2))), abs=1e-8)
    r = got[1, 0, "HA"]
    h, a = np.array([*H.values()]), np.array([*A.values()])
    x, y = h.var(ddof=1) / 7, a.var(ddof=1) / 6
    dof = (x + y) ** 2 / (x * x / 6 + y * y / 5)
    t = (h.mean() - a.mean()) / math.sqrt(x + y)
    assert (r.method, r.n_shared) == ("Welch_t", 0)
    assert (r.se, r.df, r.p) == pytest.approx((math.sqrt(x + y), dof, float(special.t_two_sided(t, dof))), abs=1e-8)
    assert (got[1, 1, "TN"].method, got[1, 1, "TN"].status) == ("paired_t", "insufficient_data")
    assert (got[2, 0, "TN"].method, got[2, 0, "TN"].status, got[2, 0, "TN"].p_for_bh) == ("patient_cluster_OLS", "insufficient_data", 1.0)
    assert (got[2, 1, "HA"].status, got[2, 1, "HA"].q) == ("probe_absent", 1.0)
    family = [got[s, p, "TH"] for s in (1, 2) for p in (0, 1)]
    assert min(f.q for f in family) == pytest.approx(min(1.0, 4 * min(f.p_for_bh for f in family)))


def test_leave_one_out(spark):
    rng = np.random.default_rng(7)
    groups = {0: [0.3], 1: [0.1, 0.1], 2: [1.0, 2.0, 2.0], 3: [float(x) for x in rng.random(41)], 4: [float(x) for x in rng.integers(0, 5, 60)]}
    df = spark.createDataFrame([(g, v) for g, x in groups.items() for v in x] + [(2, None)], "g int, v double")
    got = {r.g: tuple(r)[1:] for r in inference.cutoff_leave_one_out(df, ["g"], "v").collect()}
    assert set(got) == {1, 2, 3, 4}
    for g, found in got.items():
        x = groups[g]
        rest = [sorted(x[:i] + x[i + 1 :]) for i in range(len(x))]
        cuts = [r[math.ceil((len(r) - 1) * 0.95 - 1e-9)] for r in rest]
        means = [2.5 * sum(r) / len(r) for r in rest]
        assert found == pytest.approx((len(x), min(cuts), max(cuts), min(means), max(means)))


def test_poisson_weights(spark):
    """Weights have mean and variance one, belong to the draw and unit, and do not depend on partitions."""
    units = spark.range(400).select(F.lit(0).alias("g"), "id", F.when(F.col("id") < 200, 1.0).otherwise(0.0).alias("v"))
    a, b = (resampling.poisson_mean(units.repartition(n), ["g"], "id", "v", 300, 5).first() for n in (1, 7))
    assert (a.n_draws, a.low, a.high) == pytest.approx((b.n_draws, b.low, b.high))
    spread = 1.96 * 0.5 / math.sqrt(400)
    assert (a.low, a.high) == pytest.approx((0.5 - spread, 0.5 + spread), abs=0.015)
    assert resampling.POISSON_CUTS[0] == math.ceil(2**32 / math.e) and resampling.POISSON_CUTS[-1] <= 2**32


def test_transpose(spark):
    df = spark.createDataFrame([(0, 1.0, 2.0), (1, None, 4.0)], "k int, `a.b` double, c double")
    got = relational.transpose(df, "k", [0, 1], "name", "k_")
    assert {tuple(r) for r in got.collect()} == {("a.b", 1.0, None), ("c", 2.0, 4.0)}
