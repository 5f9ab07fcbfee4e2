"""Closed-form cases of the operators."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from measurelake.functions import numeric, scalar, special
from measurelake.operators import grouped, inference, ranking, survival


def adjusted(spark, ps, **kw):
    df = spark.createDataFrame([("f", i, p) for i, p in enumerate(ps)], "family string, i int, p double")
    return [r.q for r in ranking.bh_adjust(df, "p", "family", "q", **kw).orderBy("i").collect()]


def test_bh(spark):
    assert adjusted(spark, [0.01, 0.04, 0.03, 1.0]) == pytest.approx([0.04, 0.16 / 3, 0.16 / 3, 1.0])
    fixed = adjusted(spark, [0.001, None, 0.02], denominator=77)
    assert fixed[1] is None and [fixed[0], fixed[2]] == pytest.approx([0.077, 0.77])
    assert adjusted(spark, [0.001, None, 0.02], denominator="finite")[2] == pytest.approx(0.02)
    assert adjusted(spark, [0.001, None, 0.02], nulls="one")[1] == 1.0


def frame(spark, times, events, scores=None):
    rows = [(0, t, e, float(s), 1) for t, e, s in zip(times, events, scores or [0] * len(times))]
    return spark.createDataFrame(rows, "fold int, t int, event int, score double, n long")


def test_censoring_curve(spark):
    got = {r.t: (r.surv, r.surv_before) for r in survival.kaplan_meier(frame(spark, [1, 2, 2, 4], [1, 0, 1, 0]), ["fold"], of=0).collect()}
    assert got[2] == pytest.approx((2 / 3, 1.0)) and got[4][1] == pytest.approx(2 / 3) and got[4][0] == 0.0


def test_breslow_ties(spark):
    got = survival.breslow(frame(spark, [2, 2, 3, 4], [1, 1, 0, 1], [0.0, 1.0, 0.5, 0.2]), ["fold"], F.exp("score")).orderBy("t").collect()
    risks = np.exp([0.0, 1.0, 0.5, 0.2])
    assert [r.t for r in got] == [2, 4]
    assert [r.cumhaz for r in got] == pytest.approx([2 / risks.sum(), 2 / risks.sum() + 1 / risks[3]])


def test_concordance_tie(spark):
    r = survival.concordance(frame(spark, [1, 2, 3], [1, 1, 0], [2.0, 1.0, 1.0]), ["fold"], ipcw=False).first()
    assert (r.numerator, r.denominator) == (2.5, 3.0)


def test_constant_risk_auc(spark):
    r = survival.time_auc(frame(spark, [1, 2, 5, 6], [1, 1, 0, 1], [1.0] * 4), ["fold"], 3).first()
    assert r.auc == pytest.approx(0.5)


def test_paired_edges(spark):
    rows = [("zero", 0.0)] * 3 + [("const", 0.1)] * 3 + [("few", 0.1)] * 2 + [("norm", x) for x in (0.08, 0.09, 0.07, 0.092)]
    got = {r.k: r for r in inference.paired_effects(spark.createDataFrame(rows, "k string, delta double"), ["k"]).collect()}
    assert got["zero"].p == 1.0 and got["few"].p is None and got["norm"].mean == pytest.approx(8.3)
    t = got["norm"].t
    assert got["norm"].p == pytest.approx(float(special.t_two_sided(t, 3)), rel=1e-9)


def test_distributions():
    assert special.t_two_sided(2.0, 10) == pytest.approx(0.07338803477, rel=1e-8)
    assert special.chi2_sf(np.array([3.84, 0.1, 50.0]), np.array([1, 2, 10])) == pytest.approx([0.05004352, 0.951229425, 2.669083e-07], rel=1e-5)
    assert special.norm_ppf(np.array([0.975, 0.5, 0.001])) == pytest.approx([1.959963985, 0.0, -3.090232306], abs=1e-8)
    assert special.t_ppf(0.975, 4) == pytest.approx(2.776445105, rel=1e-8)
    assert special.f_sf(4.0, 2, 10) == pytest.approx(0.05288, rel=1e-3)


def test_reml_identical_effects():
    r = numeric.meta_reml([1.0, 1.0, 1.0], [0.5, 1.0, 2.0])
    assert r["tau2"] == 0.0 and r["effect"] == pytest.approx(1.0) and r["hk_scale"] == 1.0 and r["i2"] == 0.0
    wide = numeric.meta_reml([0.0, 5.0, 10.0], [0.1, 0.1, 0.1])
    assert wide["tau2"] == pytest.approx(25 - 0.1, rel=1e-4)  # equal variances: sample variance less the noise


def test_wilcoxon_exact():
    assert numeric.wilcoxon_p(np.array([1.0, 2.0, 3.0, 4.0, 5.0])) == pytest.approx(2 / 32)
    assert numeric.wilcoxon_p(np.zeros(4)) == 1.0


def test_cluster_ols_against_loops():
    rng = np.random.default_rng(0)
    g = np.repeat(np.arange(12), 3)
    x = np.column_stack([np.ones(36), rng.normal(size=36)])
    y = x @ [1.0, 2.0] + rng.normal(size=36)
    fit = numeric.ols(x, y, g)
    bread = np.linalg.inv(x.T @ x)
    meat = sum(np.outer(x[g == k].T @ (y - x @ fit["beta"])[g == k], x[g == k].T @ (y - x @ fit["beta"])[g == k]) for k in range(12))
    want = np.sqrt(np.diag(bread @ meat @ bread * 12 / 11 * 35 / 34))
    assert fit["se"] == pytest.approx(want)


def test_cox_two_groups():
    """One covariate, no ties: the score equation holds at the estimate."""
    t, e, x = np.array([1.0, 2, 3, 4, 5, 6]), np.array([1, 1, 0, 1, 1, 0]), np.array([[0.5], [1], [0], [1], [0.2], [0.4]])
    b = numeric.cox(t, e, x)["beta"]
    score = sum(x[i] - (np.exp(x[t >= t[i]] @ b)[:, None] * x[t >= t[i]]).sum(0) / np.exp(x[t >= t[i]] @ b).sum() for i in np.flatnonzero(e))
    assert score == pytest.approx([0.0], abs=1e-8)


def test_nested_cv_ignores_held_out_scale(spark):
    """Moving the held-out rows far away must not change what was tuned and fitted on the others."""
    rng = np.random.default_rng(1)
    rows = [(i, int(i % 2), float(rng.normal() + i % 2), float(rng.normal())) for i in range(40)]
    folds = spark.createDataFrame([(0, i, i % 4) for i in range(40)], "repeat int, u int, fold int")
    run = lambda data: {r.u: (r.c, r.score) for r in grouped.nested_cv(spark.createDataFrame(data, "u int, y int, a double, b double"), folds, "u", "y", ["a", "b"]).filter("held = 0").collect()}
    base, moved = run(rows), run([(u, y, a + 1e4 * (u % 4 == 0), b) for u, y, a, b in rows])
    assert {c for c, _ in base.values()} == {c for c, _ in moved.values()} and base != moved


def test_scalars(spark):
    rows = [("0.2",), ("NA",), ("1.1",), ("Inf",), ("-.1",), ("bad",), (None,), ("",)]
    df = spark.createDataFrame(rows, "c string").select(scalar.token_to_double(F.col("c")).alias("x"))
    assert [(r.x.value, r.x.error) for r in df.collect()] == [
        (0.2, False), (None, False), (1.1, False), (None, True), (-0.1, False), (None, True), (None, False), (None, False)
    ]
    stage = spark.sql("select 'pT3aN1M0' a, 'T9N0M0' b").select(scalar.tnm(F.col("a")).alias("a"), scalar.tnm(F.col("b")).alias("b")).first()
    assert tuple(stage.a) == ("3a", "1", "0") and tuple(stage.b) == (None, None, None)
    where = spark.sql("select 'A;B;A' n, 'Body;TSS200;TSS200' g, 'x;y' h")
    kind = lambda n, g: where.select(scalar.location_category(F.col(n), F.col(g), "A", ("TSS200",), ("Body",))).first()[0]
    assert kind("n", "g") == "promoter" and kind("n", "h") is None


def test_bca_edges():
    """All draws above the mean: the interval follows from half a draw below; no spread: the value itself."""
    import numpy as np

    from measurelake.functions import numeric

    x = np.array([1.0, 2.0, 3.0, 6.0])
    low, high = numeric.bca_interval(x, np.linspace(3.5, 4.0, 100))
    assert 3.5 <= low <= high < 3.75
    assert numeric.bca_interval(np.ones(5), np.ones(50)) == (1.0, 1.0)
    draws = np.random.default_rng(1).normal(3.0, 0.5, 4000)
    low, high = numeric.bca_interval(x, draws)
    assert low < 3.0 < high and abs((high - low) - 1.96) < 0.4


def test_products_of_units(spark):
    """Pair sums with missing probes against numpy, at several partitionings."""
    import numpy as np

    from measurelake.operators import structure

    rng = np.random.default_rng(2)
    cells = [(int(u), f"p{p}", float(rng.normal())) for u in range(60) for p in range(7) if rng.random() < 0.8]
    table = {(u, p): r for u, p, r in cells}
    names = sorted({p for _, p, _ in cells})
    want = {}
    for i, a in enumerate(names):
        for b in names[i + 1 :]:
            both = [table[u, a] * table[u, b] for u in range(60) if (u, a) in table and (u, b) in table]
            want[a, b] = (sum(both), len(both))
    for parts in (1, 5):
        df = spark.createDataFrame(cells, "unit long, probe string, r double").repartition(parts)
        got = {(r.probe_i, r.probe_j): (r.rho, r.n) for r in structure.spearman_pairs(df).collect()}
        assert set(got) == set(want)
        assert all(abs(got[k][0] - want[k][0]) < 1e-9 and got[k][1] == want[k][1] for k in want)
    assert structure.spearman_pairs(df.limit(0)).count() == 0
