"""Work of the shared passes that must not grow faster than rows times models."""

import numpy as np
import pytest

from measurelake.functions import numeric
from measurelake.operators import fitting, inference

from .test_fitting import frame, table


def test_models_start_near(spark):
    """Starting from the model of all rows takes no more passes and ends at the same coefficients, beyond a block of rows."""
    x, y = table(n=5000, d=3)
    rows = frame(spark, x, y).selectExpr("*", "int(pmod(hash(unit), 4)) fold").persist()
    fold = np.array([r.fold for r in rows.orderBy("unit").collect()])
    weights = lambda b: (b["fold"][:, None] != np.arange(4)).astype(float)
    make = lambda: [fitting.Models(np.array(c), np.tile(np.arange(4), 2), np.repeat([0.1, 1.0], 4), np.full(8, mix)) for c, mix in (((0, 1, 2), 0.0), ((0, 1, 2), 0.5), ((1,), 0.0))]
    far, near = make(), make()
    fitting.fit(rows, weights, 4, far, 3)
    fitting.fit(rows, weights, 4, near, 3, near=True)
    for a, b in zip(far, near):
        assert b.coefficients == pytest.approx(a.coefficients, abs=1e-7) and b.passes.max() <= a.passes.max()
    assert sum(m.passes.sum() for m in near) < sum(m.passes.sum() for m in far)
    for f in range(4):
        own = x[fold != f]
        z = (own - own.mean(0)) / own.std(0)
        want = numeric.ridge_logistic(z, y[fold != f], 1.0)
        assert near[0].coefficients[:-1, 4 + f] * own.std(0) == pytest.approx(want[:-1], abs=1e-6)


@pytest.mark.parametrize("auc_rows", [7, 40, None])
def test_packed_auc(spark, auc_rows):
    """However the scores are cut: ties, weights, a constant score, and one class only."""
    x, y = table(n=130, d=3)
    x = np.round(x)
    x[:, 2] = 4.0
    w = np.random.default_rng(1).integers(0, 4, 130)
    rows = spark.createDataFrame([(int(b), [float(v) for v in a], int(c)) for a, b, c in zip(x, y, w)], "y int, x array<double>, w int").repartition(3)

    def values(block):
        sign = np.where(block["y"] == 1, 1, -1)[:, None]
        return np.concatenate([block["x"], block["x"][:, :2]], axis=1), np.concatenate([sign * np.ones((1, 3), int), sign * block["w"][:, None], np.abs(sign)], axis=1)

    got = {r.model: r.auc for r in fitting.auc_of(rows, values, 5, auc_rows).collect()}
    at = np.repeat(np.arange(130), w)
    want = [numeric.fast_auc(y, c) for c in x.T] + [numeric.fast_auc(y[at], x[at, 0])]
    assert [got[i] for i in range(4)] == pytest.approx(want, abs=1e-12) and got[2] == 0.5 and got[4] is None


def test_sweep_makes_no_row_of_a_score(spark, monkeypatch):
    monkeypatch.setattr(inference, "auc", None)
    x, y = table(n=60, d=2)
    assert len(fitting.subset_sweep(frame(spark, x, y), "unit", [(3, (0,)), (4, (0, 1))], 2).collect()) == 2


def test_optimism_makes_no_row_of_a_score(spark, monkeypatch):
    monkeypatch.setattr(inference, "auc", None)
    x, y = table(n=60, d=2)
    assert len(fitting.optimism(frame(spark, x, y), "unit", 2, 3, 2).collect()) == 3
