"""Models fitted in shared passes, against loops over rows gathered in NumPy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from measurelake.functions import numeric
from measurelake.operators import fitting, inference
from measurelake.operators.fitting import Family, Folds


def table(n=240, d=4, seed=3, signal=1.0):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, d)) * np.arange(1, d + 1) + 5
    y = (rng.random(n) < 1 / (1 + np.exp(-signal * (x[:, 0] - 5) - 0.3 * (x[:, -1] - 5)))).astype(int)
    return x, y


def frame(spark, x, y):
    rows = [(i, int(b), [float(v) for v in a]) for i, (a, b) in enumerate(zip(x, y))]
    return spark.createDataFrame(rows, "unit long, y int, x array<double>").repartition(3)


def marks(rows, folds):
    found = folds.marked(rows, "unit").orderBy("unit").collect()
    return np.array([r.outer for r in found]), np.array([r.inside for r in found])


def ridge(x, y, c, weights=None):
    w = np.ones(len(y)) if weights is None else weights
    mean = (w[:, None] * x).sum(0) / w.sum()
    sd = np.sqrt((w[:, None] * (x - mean) ** 2).sum(0) / w.sum())
    b = numeric.ridge_logistic((x - mean) / sd, y, c, w, penalise_intercept=True)
    return lambda z: ((z - mean) / sd) @ b[:-1] + b[-1]


def net(x, y, c):
    mean, sd = x.mean(0), x.std(0)
    b = numeric.elastic_net_logistic((x - mean) / sd, y, c)
    return lambda z: ((z - mean) / sd) @ b[:-1] + b[-1]


def loss(y, score):
    p = np.clip(1 / (1 + np.exp(-score)), 1e-8, 1 - 1e-8)
    return -(y * np.log(p) + (1 - y) * np.log(1 - p)).mean()


CANDIDATES = (0.01, 0.1, 1.0, 10.0)


def chosen_by_loop(x, y, inside, family):
    """Penalty, feature, and the inner out-of-fold scores at the choice."""
    d = x.shape[1]
    options = [(j, c) for j in (range(d) if family == "best_single" else [None]) for c in CANDIDATES]

    def model(a, b, option):
        j, c = option
        use = slice(None) if j is None else slice(j, j + 1)
        inner = (net if family == "elastic_net" else ridge)(a[:, use], b, c)
        return lambda z: inner(z[:, use])

    parts = np.unique(inside)
    losses = np.array([[loss(y[inside == f], model(x[inside != f], y[inside != f], o)(x[inside == f])) for f in parts] for o in options])
    mean, error = losses.mean(1), losses.std(1, ddof=1) / np.sqrt(len(parts))
    best = int(mean.argmin())
    able = [i for i in range(len(options)) if mean[i] <= mean[best] + error[best]]
    pick = min(able, key=lambda i: (options[i][1], mean[i], i))
    scores = np.empty(len(y))
    for f in parts:
        scores[inside == f] = model(x[inside != f], y[inside != f], options[pick])(x[inside == f])
    return options[pick], scores, model(x, y, options[pick])


@pytest.fixture(scope="module")
def nested(spark):
    x, y = table()
    rows = frame(spark, x, y)
    folds = Folds(outer=3, repeats=2, inner=3, seed=5)
    found = fitting.nested_cv(rows, "unit", x.shape[1], folds)
    return x, y, rows, folds, found, found.oof(rows, "unit").toPandas()


@pytest.mark.parametrize("family", ["ridge", "elastic_net", "best_single"])
def test_nested_equals_loop(nested, family):
    x, y, rows, folds, found, oof = nested
    outer, inside = marks(rows, folds)
    own = oof[oof.family == family].set_index(["repeat", "unit"]).sort_index()
    assert len(own) == folds.repeats * len(y)
    for r in range(folds.repeats):
        for h in range(folds.outer):
            train, cell = outer[:, r] != h, r * folds.outer + h
            (j, c), scores, model = chosen_by_loop(x[train], y[train], inside[train, cell], family)
            assert (found.penalty[family][cell], found.feature[family][cell]) == (c, -1 if j is None else j)
            cut = np.quantile(scores[y[train] == 0], 0.95, method="higher")
            assert found.thresholds[family][cell] == pytest.approx(cut, abs=2e-5)
            got = own.loc[r].loc[np.flatnonzero(~train)]
            assert got.score.to_numpy() == pytest.approx(model(x[~train]), abs=2e-5)
            assert (got.above == (got.score > got.threshold)).all() and (got.fold == h).all()


def test_metric_block(nested, spark):
    oof = nested[5]
    got = fitting.metric_block(spark.createDataFrame(oof), ["family", "repeat"]).toPandas().set_index(["family", "repeat"])
    assert len(got) == 6
    for (family, repeat), own in oof.groupby(["family", "repeat"]):
        y, score, p = own.y.to_numpy(), own.score.to_numpy(), own.probability.to_numpy()
        g = got.loc[(family, repeat)]
        pairs = score[y == 1][:, None] - score[y == 0]
        assert g.auc == pytest.approx((pairs > 0).mean() + (pairs == 0).mean() / 2)
        assert g.brier == pytest.approx(((p - y) ** 2).mean())
        for prefix, called in (("half", p >= 0.5), ("q95", own.above.to_numpy())):
            assert g[f"{prefix}_sensitivity"] == pytest.approx(called[y == 1].mean())
            assert g[f"{prefix}_specificity"] == pytest.approx(1 - called[y == 0].mean())
        assert g.calibration_status == "estimable"
        z = np.log(np.clip(p, 1e-6, 1 - 1e-6) / (1 - np.clip(p, 1e-6, 1 - 1e-6)))
        rest = 1 / (1 + np.exp(-(g.calibration_intercept + g.calibration_slope * z))) - y
        assert abs(rest.sum()) < 1e-5 and abs((rest * z).sum()) < 1e-5


def test_calibration_statuses(spark):
    rows = [("constant", y, 0.5) for y in (0, 1, 1)] + [("up", y, float(y)) for y in (0, 1)] + [("down", y, -float(y)) for y in (0, 1, 1, 0)]
    rows = [(g, y, s + (n * 0.01 if g != "constant" else 0)) for n, (g, y, s) in enumerate(rows)] + [("one", 1, 0.1), ("one", 1, 0.3), (None, 0, 1.0), (None, 1, 0.5), (None, 1, 2.0), (None, None, 3.0), (None, 1, None)]
    got = {r.g: (r.status, r.slope is None, r.n) for r in fitting.calibration(spark.createDataFrame(rows, "g string, y int, s double"), ["g"], "y", "s").collect()}
    assert got == {
        "constant": ("nonestimable_constant_score", True, 3),
        "up": ("nonestimable_complete_separation_increasing", True, 2),
        "down": ("nonestimable_complete_separation_decreasing", True, 4),
        "one": ("nonestimable_one_class", True, 2),
        None: ("estimable", False, 3),
    }
    assert fitting.calibration(spark.createDataFrame([], "g string, y int, s double"), ["g"], "y", "s").count() == 0


def test_weighted_calibration(spark):
    rng = np.random.default_rng(4)
    s, w = rng.normal(size=80), rng.integers(1, 5, 80)
    y = (rng.random(80) < 1 / (1 + np.exp(-s))).astype(int)
    df = spark.createDataFrame([(int(a), float(b), int(c)) for a, b, c in zip(y, s, w)], "y int, s double, w int")
    g = fitting.calibration(df, [], "y", "s", "w").first()
    slope, intercept = numeric.ridge_logistic(s[:, None], y.astype(float), 1e8, w.astype(float))
    assert (g.slope, g.intercept) == (pytest.approx(slope, abs=1e-4), pytest.approx(intercept, abs=1e-4))


def test_order_statistics(spark):
    rng = np.random.default_rng(2)
    values = np.concatenate([rng.normal(size=(90, 3)) * 1e3, np.zeros((10, 3)), -np.zeros((5, 3)), np.full((5, 3), -1e-300)])
    used = rng.random(values.shape) < 0.7
    used[:, 2] = False
    rows = spark.createDataFrame([([float(v) for v in a], [int(u) for u in b]) for a, b in zip(values, used)], "v array<double>, u array<int>").repartition(4)
    for q in (0.0, 0.3, 0.95, 1.0):
        place = lambda n: np.ceil((np.maximum(n, 1) - 1) * q)  # noqa: E731, B023
        got = fitting.order_statistics(rows, lambda b: (b["v"], b["u"] == 1), place, 3)
        assert got[:2] == pytest.approx([np.quantile(values[used[:, g], g], q, method="higher") for g in (0, 1)], abs=0) and np.isnan(got[2])


def test_optimism_equals_loop(spark):
    x, y = table(n=150, d=3)
    rows = frame(spark, x, y)
    draws, inner = 4, 3
    got = {r.draw: r for r in fitting.optimism(rows, "unit", 3, draws, inner, seed=9).collect()}
    cdf = fitting._POISSON
    for draw in range(draws):
        u = F.pmod(F.xxhash64(F.lit(9), F.lit(draw), "unit"), F.lit(1 << 52)) / F.lit(float(1 << 52))
        drawn = rows.orderBy("unit").select(u.alias("u"), F.pmod(F.xxhash64(F.lit(10), F.lit(draw), "unit"), F.lit(inner)).alias("f")).collect()
        w = np.searchsorted(cdf, [r.u for r in drawn], "left")
        f = np.array([r.f for r in drawn])
        assert 0.7 < w.mean() < 1.3
        losses = np.empty((4, inner))
        for k, c in enumerate(CANDIDATES):
            for j in range(inner):
                s = ridge(x[f != j], y[f != j], c, w[f != j].astype(float))(x[f == j])
                p = np.logaddexp(0, s) - y[f == j] * s
                losses[k, j] = (p * w[f == j]).sum() / w[f == j].sum()
        mean = losses.mean(1)
        best = mean.argmin()
        c = CANDIDATES[min(k for k in range(4) if mean[k] <= mean[best] + losses[best].std(ddof=1) / np.sqrt(inner))]
        score = ridge(x, y, c, w.astype(float))(x)
        assert got[draw].c == c
        assert got[draw].original == pytest.approx(numeric.fast_auc(y, score), abs=1e-6)
        at = np.repeat(np.arange(len(y)), w)
        assert got[draw].apparent == pytest.approx(numeric.fast_auc(y[at], score[at]), abs=1e-6)


def test_subset_sweep_equals_loop(spark):
    x, y = table(n=120, d=3)
    rows = frame(spark, x, y)
    subsets = [(7, (0,)), (8, (1, 2)), (9, (0, 1, 2))]
    got = {r.id: r.auc for r in fitting.subset_sweep(rows, "unit", subsets, 3, folds=3, seed=1).collect()}
    fold = np.array([r.f for r in rows.orderBy("unit").select(F.pmod(F.xxhash64(F.lit(1), "unit"), F.lit(3)).alias("f")).collect()])
    for i, columns in subsets:
        score = np.empty(len(y))
        for f in range(3):
            score[fold == f] = ridge(x[fold != f][:, columns], y[fold != f], 1.0)(x[fold == f][:, columns])
        assert got[i] == pytest.approx(numeric.fast_auc(y, score), abs=1e-9)


def test_odd_tables(spark):
    """A constant feature, separable labels and a training set of one class are fitted without failing."""
    x, y = table(n=60, d=3)
    x[:, 1] = 2.0
    x[:, 2] = y * 10.0
    found = fitting.nested_cv(frame(spark, x, y), "unit", 3, Folds(3, 1, 2), (Family("ridge"), Family("elastic_net", mix=0.5, whole=False)))
    assert all(np.isfinite(b).all() and np.abs(b[1]).max() < 1e-6 for b in found.chosen.values())
    ones = fitting.nested_cv(frame(spark, x, np.ones(60, int)), "unit", 3, Folds(3, 1, 2), (Family("ridge"),))
    assert np.isfinite(ones.chosen["ridge"]).all() and np.isnan(ones.thresholds["ridge"]).all()


def test_weighted_auc(spark):
    df = spark.createDataFrame([(1, 0.5, 2), (0, 0.5, 1), (1, 0.9, 1), (0, 0.1, 3)], "y int, s double, w int")
    once = df.withColumn("i", F.explode(F.sequence(F.lit(1), "w")))
    assert inference.auc(df, [], "y", "s", "w").first().auc == pytest.approx(inference.auc(once, [], "y", "s").first().auc)
