"""Models compared on the same folds, against loops over rows gathered in NumPy."""

import numpy as np
import pytest

from measurelake.functions import numeric
from measurelake.operators import comparison


def table(n=150, d=3, seed=8):
    rng = np.random.default_rng(seed)
    x = np.round(rng.normal(size=(n, d)) * [1, 3, 0.5], 1) + 2
    y = (rng.random(n) < 1 / (1 + np.exp(-1.5 * (x[:, 0] - 2)))).astype(int)
    return np.concatenate([x, x[:20]]), np.concatenate([y, y[:20]]), np.concatenate([np.arange(n), np.arange(20) + 1]) % 3


def frame(spark, x, y, fold):
    return spark.createDataFrame([(int(b), [float(v) for v in a], int(f)) for a, b, f in zip(x, y, fold)], "y int, x array<double>, fold int").repartition(3)


def test_box_optimum():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(60, 2))
    m = x @ x.T  # of rank two
    upper = rng.uniform(0.1, 2, 60)
    a = numeric.box_optimum(m, np.ones(60), upper)
    slope = 1 - m @ a
    assert (a >= 0).all() and (a <= upper).all()
    assert slope[a < upper].max() < 1e-4 and slope[a > 0].min() > -1e-4


@pytest.mark.parametrize("working_set", [12, 1000])
def test_machine_of_working_sets(spark, working_set):
    """Decision values of the held rows are those of a machine with the whole kernel, copies and all, however few rows meet in a task."""
    x, y, fold = table()
    got = comparison.kernel_values(frame(spark, x, y, fold), 3, 3, working_set=working_set).collect()
    assert sum(r.n for r in got) == len(y)
    for f in range(3):
        train = fold != f
        z = (x - x[train].mean(0)) / x[train].std(0)
        decide = numeric.rbf_svm(z[train], y[train], sweeps=20000)
        want = {}
        for v, label in zip(decide(z[~train]), y[~train]):
            want.setdefault(int(label), []).append(v)
        for label, values in want.items():
            own = [v for r in got if r.fold == f and r.y == label for v in [r.value] * r.n]
            assert np.sort(own) == pytest.approx(np.sort(values), abs=0.02)


def test_compare(spark):
    x, y, fold = table()
    got = {(r.model, r.held): r for r in comparison.compare(frame(spark, x, y, fold), 3, 3).collect()}
    assert len(got) == 12 and sum(r.n for r in got.values()) == 4 * len(y)
    for f in range(3):
        train = fold != f
        z = (x - x[train].mean(0)) / x[train].std(0)
        for name, b in (("ridge", numeric.ridge_logistic(z[train], y[train], 1.0)), ("elastic_net", numeric.elastic_net_logistic(z[train], y[train], 0.1, steps=20000))):
            assert got[name, f].auc == pytest.approx(numeric.fast_auc(y[~train], z[~train] @ b[:-1] + b[-1]), abs=2e-3)
        single = np.array([numeric.fast_auc(y[train], c) for c in z[train].T])
        best = np.abs(single - 0.5).argmax()
        assert got["best_single", f].auc == pytest.approx(numeric.fast_auc(y[~train], z[~train][:, best] * (1 if single[best] >= 0.5 else -1)))


@pytest.mark.parametrize("steps", [0, 20])
def test_box_ascent(monkeypatch, steps):
    """From any start, by coordinates or by what follows them."""
    monkeypatch.setattr(numeric, "ASCENT_STEPS", steps)
    rng = np.random.default_rng(2)
    x = rng.normal(size=(80, 4))
    m = np.exp(-((x[:, None] - x) ** 2).sum(2)) + 1
    upper = rng.uniform(0.1, 2, 80)
    start = rng.uniform(0, 1, 80) * upper
    a = numeric.box_ascent(m.astype(np.float32), 1 - m @ start, start, upper, 1e-4)
    slope = 1 - m @ a
    assert (a >= 0).all() and (a <= upper).all()
    assert slope[a < upper].max() < 2e-4 and slope[a > 0].min() > -2e-4


def test_machine_of_noise_takes_few_rounds(spark, monkeypatch):
    """Labels without a pattern leave most rows at their bound; sets of the worst rows alone undid each other's steps without end."""
    monkeypatch.setattr(comparison, "MOST_ROUNDS", 30)
    rng = np.random.default_rng(5)
    x, y, fold = rng.normal(size=(600, 5)), rng.integers(0, 2, 600), np.arange(600) % 2
    got = comparison.kernel_values(frame(spark, x, y, fold), 2, 5, working_set=100).collect()
    for f in range(2):
        train = fold != f
        z = (x - x[train].mean(0)) / x[train].std(0)
        decide = numeric.rbf_svm(z[train], y[train], sweeps=20000)
        for label in (0, 1):
            own = np.sort([r.value for r in got if r.fold == f and r.y == label])
            assert own == pytest.approx(np.sort(decide(z[~train][y[~train] == label])), abs=0.02)


def test_comparison_leaves_no_plan(spark):
    """Its few rows are computed; a plan of all its curves in one job cost the driver more memory than it has."""
    x, y, fold = table(n=60)
    got = comparison.compare(frame(spark, x, y, fold), 3, 3)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert not any(node in plan for node in ("Exchange", "Join", "Window", "InMemory", "Arrow"))
