"""Model kernels against conditions of their optimum, explicit loops and enumeration."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from measurelake.functions import numeric
from measurelake.operators import grouped, inference, recurrence, resampling, survival


def subjects(n=60, seed=3):
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((n, 3))
    t = np.ceil(rng.exponential(np.exp(-0.6 * x[:, 0])) * 6)
    return t, (rng.random(n) < 0.7).astype(int), x, rng.integers(1, 4, n).astype(float)


def cox_loss(t, e, x, w, beta):
    """Mean negative log partial likelihood (Breslow ties), by a loop over events."""
    eta = x @ beta
    total = 0.0
    for i in np.flatnonzero(e == 1):
        total += w[i] * (np.log((w * np.exp(eta))[t >= t[i]].sum()) - eta[i])
    return total / w.sum()


def slopes(f, beta, h=1e-6):
    return np.array([(f(beta + h * d) - f(beta - h * d)) / (2 * h) for d in np.eye(len(beta))])


def test_ridge_path_is_penalised_newton():
    t, e, x, w = subjects()
    for penalty, beta in zip([1.0, 0.01], numeric.cox_path(t, e, x, w, [1.0, 0.01], 0.0)):
        assert beta == pytest.approx(numeric.cox(t, e, x, w, ridge=penalty, ties="breslow")["beta"], abs=1e-6)


@pytest.mark.parametrize("penalty", [100.0, 0.2, 0.05, 0.001])
def test_elastic_path_optimum(penalty):
    t, e, x, w = subjects()
    beta = numeric.cox_path(t, e, x, w, [penalty], 0.5)[0]
    grad = slopes(lambda b: cox_loss(t, e, x, w, b), beta) + penalty * 0.5 * beta
    on = beta != 0
    assert grad[on] == pytest.approx(-penalty * 0.5 * np.sign(beta[on]), abs=1e-6)
    assert (np.abs(grad[~on]) <= penalty * 0.5 + 1e-6).all()
    assert penalty < 100 or not on.any()


def test_path_order_and_repeats():
    t, e, x, w = subjects()
    a = numeric.cox_path(t, e, x, w, [0.1, 1.0, 0.1], 0.5)
    assert a[0] == pytest.approx(a[2]) and a[1] == pytest.approx(numeric.cox_path(t, e, x, w, [1.0], 0.5)[0], abs=1e-7)


def test_deviance():
    t, e, x, w = subjects()
    eta = x @ [0.3, -0.2, 0.1]
    deaths = np.array([w[(t == u) & (e == 1)].sum() for u in np.unique(t[e == 1])])
    wanted = 2 * (w.sum() * cox_loss(t, e, x, w, np.array([0.3, -0.2, 0.1])) - (deaths * np.log(deaths)).sum())
    assert numeric.cox_deviance(t, e, eta, w) == pytest.approx(wanted)


def test_one_standard_error():
    losses = np.array([[3.0, 1.0, 1.3, 5.0], [3.0, 2.0, 1.9, np.inf]])
    assert numeric.one_se(losses, [0.1, 1.0, 10.0, 100.0]) == (1.0, 10.0)
    assert np.isnan(numeric.one_se(np.array([[np.nan]]), [1.0])).all()


def test_schoenfeld_trend():
    t, e, x, w = subjects()
    x = x[:, 0]
    fit = numeric.cox(t, e, x[:, None], w)
    beta, se = fit["beta"][0], fit["se"][0]
    times, residuals = [], []
    for i in np.flatnonzero(e == 1):
        r = (w * np.exp(beta * x))[t >= t[i]]
        times += [t[i]] * int(w[i])
        residuals += [x[i] - r @ x[t >= t[i]] / r.sum()] * int(w[i])
    g = np.array(times) - np.mean(times)
    rho, chi2 = numeric.schoenfeld_trend(t, e, x, w, beta, se)
    assert rho == pytest.approx(np.corrcoef(times, residuals)[0, 1])
    assert chi2 == pytest.approx((g @ residuals) ** 2 * len(times) * se**2 / (g @ g))


def brute_c(score, t, e, horizon, floor=0.1):
    """Uno's C by all pairs of subjects."""
    top = bottom = 0.0
    for i in range(len(t)):
        if e[i] != 1 or t[i] >= horizon or not (t > t[i]).any():
            continue
        g = 1.0
        for u in np.unique(t[t < t[i]]):
            g *= 1 - ((t == u) & (e == 0)).sum() / (t >= u).sum()
        if g <= floor:
            return np.nan
        late = t > t[i]
        top += ((score[i] > score[late]) + 0.5 * (score[i] == score[late])).sum() / g**2
        bottom += late.sum() / g**2
    return top / bottom if bottom else np.nan


def counted(score, t, e):
    cells, at = np.unique(np.column_stack([t, e]), axis=0, return_inverse=True)
    _, row = np.unique(score, return_inverse=True)
    table = np.zeros((row.max() + 1, len(cells)), np.int64)
    np.add.at(table, (row, at.ravel()), 1)
    return table, cells[:, 0], cells[:, 1]


def test_uno_c_of_counts():
    rng = np.random.default_rng(8)
    for _ in range(30):
        score, t, e = rng.integers(0, 4, 25), rng.integers(1, 8, 25).astype(float), rng.integers(0, 2, 25)
        table, times, events = counted(score, t, e)
        assert numeric.uno_c(table, times, events, 6, 0.1) == pytest.approx(brute_c(score, t, e, 6), nan_ok=True)


def test_random_tables_are_permutations():
    """Shares of the drawn tables against all orders of six subjects."""
    score, t, e = np.array([0, 0, 1, 1, 1, 2]), np.array([1.0, 2, 2, 3, 3, 4]), np.array([1, 0, 1, 1, 0, 1])
    table, *_ = counted(score, t, e)
    every = [counted(score, t[list(o)], e[list(o)])[0].tobytes() for o in itertools.permutations(range(6))]
    drawn = [numeric.random_table(table, np.random.default_rng([5, i])) for i in range(6000)]
    assert all((d.sum(0) == table.sum(0)).all() and (d.sum(1) == table.sum(1)).all() for d in drawn)
    found = [d.tobytes() for d in drawn]
    assert set(found) <= set(every)
    for kind in set(every):
        p = every.count(kind) / len(every)
        assert abs(found.count(kind) / len(found) - p) < 5 * np.sqrt(p / len(found))


def levels(spark, n=80, seed=2):
    rng = np.random.default_rng(seed)
    rows = [(0, int(a), int(b), int(c), 1) for a, b, c in zip(rng.integers(1, 9, n), rng.integers(0, 2, n), rng.integers(0, 5, n))]
    return spark.createDataFrame(rows, "fold int, t int, event int, score int, n long"), np.array(rows)


def test_joint_permutation(spark):
    df, rows = levels(spark)
    one, two = (recurrence.joint_permutation(df, ["fold"], 60, 4, 7, block=b).first() for b in (7, 60))
    assert one == two and one.n_valid == 60 and one.p == (one.n_extreme + 1) / 61
    assert one.observed == pytest.approx(brute_c(rows[:, 3], rows[:, 1], rows[:, 2], 7))
    c = survival.concordance(df, ["fold"], ipcw=True, horizon=7).first()
    assert one.observed == pytest.approx(c.c_index)


def test_joint_permutation_keeps_bad_draws(spark):
    df = spark.createDataFrame([(0, 1, 0, 1, 5), (0, 2, 0, 2, 5)], "fold int, t int, event int, score int, n long")
    r = recurrence.joint_permutation(df, ["fold"], 5, 1, 9).first()
    assert r.p is None and r.n_valid == 0


def test_metric_bootstrap(spark):
    df, rows = levels(spark)
    got = {r.metric: r for r in recurrence.metric_bootstrap(df.withColumn("half", F.floor(F.col("score") / 2)), ["fold"], ["score", "half"], 200, 3, 7).collect()}
    a, b = brute_c(rows[:, 3], rows[:, 1], rows[:, 2], 7), brute_c(rows[:, 3] // 2, rows[:, 1], rows[:, 2], 7)
    assert got["score"].value == pytest.approx(a) and got["half-score"].value == pytest.approx(b - a)
    assert got["score"].low < a < got["score"].high


def test_brier_grid(spark):
    df, rows = levels(spark)
    t, e, s = rows[:, 1].astype(float), rows[:, 2], rows[:, 3] * 0.2
    got = recurrence.brier_grid(df, ["fold"], F.col("score") * 0.2, 6.0, points=7).orderBy("tau").collect()

    def g_at(u, strictly):
        g = 1.0
        for v in np.unique(t[(t < u) if strictly else (t <= u)]):
            g *= 1 - ((t == v) & (e == 0)).sum() / (t >= v).sum()
        return g

    for r in got:
        h = sum(((t == v) & (e == 1)).sum() / np.exp(s[t >= v]).sum() for v in np.unique(t[t <= r.tau]))
        risk = 1 - np.exp(-h * np.exp(s))
        terms = [(1 - p) ** 2 / g_at(u, True) if d == 1 and u <= r.tau else p**2 / g_at(r.tau, False) if u > r.tau else 0.0 for u, d, p in zip(t, e, risk)]
        assert r.brier == pytest.approx(np.mean(terms))
    area = recurrence.integrated(recurrence.brier_grid(df, ["fold"], F.col("score") * 0.2, 6.0, points=7), ["fold"], 6.0).first()
    assert area.ibs == pytest.approx(np.trapezoid([r.brier for r in got], [r.tau for r in got]) / 6)


def test_weighted_cutoffs(spark):
    rng = np.random.default_rng(1)
    values, weights = rng.random(40).round(2), rng.integers(0, 4, 40)
    df = spark.createDataFrame([(0, float(v), int(w)) for v, w in zip(values, weights)], "k int, v double, weight int")
    r = inference.weighted_cutoffs(df, ["k"], "v").first()
    long = np.repeat(values, weights)
    assert r.q95 == np.quantile(long, 0.95, method="higher") and r.mean25 == pytest.approx(2.5 * long.mean())


def test_poisson_draws_are_retryable(spark):
    df = spark.createDataFrame([(i, i * 1.0) for i in range(50)], "u int, v double")
    one = {tuple(r) for r in resampling.poisson_draws(df, ["v"], "u", 10, 3).collect()}
    two = {tuple(r) for r in resampling.poisson_draws(df.repartition(7), ["v"], "u", 10, 3).collect()}
    assert one == two and len(one) == 500


def test_hc3():
    rng = np.random.default_rng(4)
    x = np.column_stack([np.ones(20), rng.standard_normal((20, 2))])
    y = x @ [1, 2, -1] + rng.standard_normal(20) * (1 + np.abs(x[:, 1]))
    fit = numeric.ols(x, y)
    bread, meat = np.linalg.inv(x.T @ x), np.zeros((3, 3))
    residual = y - x @ np.linalg.lstsq(x, y, rcond=None)[0]
    for row, r in zip(x, residual):
        meat += np.outer(row, row) * (r / (1 - row @ bread @ row)) ** 2
    assert fit["se"] == pytest.approx(np.sqrt(np.diag(bread @ meat @ bread)))


def test_partial_spearman_by_recursion():
    """With one covariate the partial correlation has a closed form."""
    rng = np.random.default_rng(5)
    x, y, z = rng.standard_normal((3, 30)).round(1)
    ranks = [numeric.midranks(v) for v in (x, y, z)]
    xy, xz, yz = (np.corrcoef(ranks[a], ranks[b])[0, 1] for a, b in ((0, 1), (0, 2), (1, 2)))
    rho, _, df = numeric.partial_spearman(x, y, z[:, None])
    assert rho == pytest.approx((xy - xz * yz) / np.sqrt((1 - xz**2) * (1 - yz**2))) and df == 27


def test_first_axis():
    x = np.random.default_rng(6).standard_normal((25, 4)) @ np.diag([1, 2, 3, 4]) + 7
    load, scores, share = numeric.pc1(x)
    values, vectors = np.linalg.eigh(np.corrcoef(x.T))
    assert share == pytest.approx(values[-1] / 4) and np.abs(load) == pytest.approx(np.abs(vectors[:, -1]))
    assert load[np.abs(load).argmax()] > 0 and scores.var(ddof=1) == pytest.approx(values[-1])


def labelled(seed=7):
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((50, 4))
    return x, (x[:, 0] + rng.standard_normal(50) > 0).astype(int)


def test_ridge_logistic_optimum():
    x, y = labelled()
    beta = numeric.ridge_logistic(x, y, 2.0)
    p = 1 / (1 + np.exp(-(x @ beta[:-1] + beta[-1])))
    assert 2 * x.T @ (p - y) + beta[:-1] == pytest.approx(0, abs=1e-7) and (p - y).sum() == pytest.approx(0, abs=1e-7)


def test_elastic_net_logistic_optimum():
    x, y = labelled()
    beta = numeric.elastic_net_logistic(x, y, 0.1, steps=20000)
    p = 1 / (1 + np.exp(-(x @ beta[:-1] + beta[-1])))
    grad = 0.1 * x.T @ (p - y) + 0.5 * beta[:-1]
    on = beta[:-1] != 0
    assert grad[on] == pytest.approx(-0.5 * np.sign(beta[:-1][on]), abs=1e-5) and (np.abs(grad[~on]) <= 0.5 + 1e-6).all()


def test_kernel_svm_optimum():
    """Margins of the box-constrained dual: at least 1 outside the sample of support, at most 1 at the bound."""
    x, y = labelled()
    margin = np.where(y == 1, 1, -1) * numeric.rbf_svm(x, y, c=1e6, gamma=2.0, sweeps=20000)(x)
    assert margin.min() == pytest.approx(1, abs=1e-3)
    soft = np.where(y == 1, 1, -1) * numeric.rbf_svm(x, y, c=0.5, gamma=0.1, sweeps=5000)(x)
    assert soft.min() < 1 < soft.max()


def test_calibration_of_true_logits(spark):
    rng = np.random.default_rng(9)
    s = rng.standard_normal(4000)
    y = (rng.random(4000) < 1 / (1 + np.exp(-(1.5 * s - 0.3)))).astype(int)
    df = spark.createDataFrame([(0, int(a), float(b)) for a, b in zip(y, s)], "g int, y int, score double")
    r = grouped.calibration(df, ["g"], "y", "score").first()
    assert r.slope == pytest.approx(1.5, abs=0.2) and r.intercept == pytest.approx(-0.3, abs=0.15)
    p = 1 / (1 + np.exp(-(r.slope * s + r.intercept)))
    assert (p - y).sum() == pytest.approx(0, abs=1e-4) and s @ (p - y) == pytest.approx(0, abs=1e-4)


def test_block_permutation_finds_links(spark):
    rng = np.random.default_rng(10)
    shared = rng.standard_normal(40)
    rows = [(0, i, float(shared[i] + 0.1 * a), float(shared[i] + 0.1 * b), float(c)) for i, (a, b, c) in enumerate(rng.standard_normal((40, 3)))]
    df = spark.createDataFrame(rows, "g int, u int, a double, b double, c double")
    linked = grouped.block_permutation(df, ["g"], "u", {"x": ["a"], "y": ["b"]}, draws=99).first()
    free = grouped.block_permutation(df, ["g"], "u", {"x": ["a"], "y": ["c"]}, draws=99).first()
    a, b = (numeric.midranks(np.array([r[k] for r in rows])) for k in (2, 3))
    assert linked.p == 0.01 and linked.observed == pytest.approx(np.corrcoef(a, b)[0, 1]) and free.p > 0.01


def test_spearman_bootstrap(spark):
    rng = np.random.default_rng(11)
    x = rng.standard_normal(60)
    y = x + rng.standard_normal(60)
    df = spark.createDataFrame([(0, i, float(a), float(b)) for i, (a, b) in enumerate(zip(x, y))], "g int, u int, x double, y double")
    r = grouped.spearman_bootstrap(df, ["g"], "u", "x", "y", draws=300).first()
    assert r.rho == pytest.approx(numeric.spearman(x, y)[0]) and r.low < r.rho < r.high and r.high - r.low < 0.6
