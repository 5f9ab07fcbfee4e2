"""Rank correlations in Poisson draws, against copies of rows ranked in NumPy."""

import numpy as np
import pytest

from measurelake.functions import numeric
from measurelake.operators import battery, resampling


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(4)
    x = np.round(rng.normal(size=90), 1)
    values = [("ab"[i % 2], i, float(v), float(np.round(v + rng.normal(), 1))) for i, v in enumerate(x)]
    values += [(None, i, float(-i % 4), float(i)) for i in range(7)] + [("flat", i, 2.0, float(i)) for i in range(6)] + [("a", 99, None, 1.0)]
    return spark.createDataFrame(values, "g string, u long, x double, y double").repartition(3)


@pytest.mark.parametrize("range_rows", [5, 1000])
def test_drawn_rank_correlation(rows, range_rows):
    draws, seed = 9, 3
    weights = {}
    for r in resampling.poisson_draws(rows, ["g", "u", "x", "y"], "u", draws, seed).collect():
        if r.x is not None:
            weights.setdefault((r.g, r.draw), []).append((r.x, r.y, r.weight))
    for r in rows.collect():
        if r.x is not None:
            weights.setdefault((r.g, -1), []).append((r.x, r.y, 1))
    found = battery.drawn_rank_correlation(rows, ["g"], "u", "x", "y", draws, seed, range_rows).collect()
    assert len(found) == 4 * (draws + 1)
    for r in found:
        x, y, w = map(np.array, zip(*weights[r.g, r.draw]))
        assert r.n == w.sum()
        x, y = np.repeat(x, w), np.repeat(y, w)
        if len(x) == 0 or np.ptp(x) == 0 or np.ptp(y) == 0:
            assert r.rho is None
        else:
            assert r.rho == pytest.approx(numeric.spearman(x, y)[0], abs=1e-12)


def test_constant_side_has_no_correlation(rows):
    got = {r.g: r.rho for r in battery.rank_correlation(rows, ["g"], "x", "y").collect()}
    assert got["flat"] is None and all(got[g] is not None for g in ("a", "b", None))


def test_draws_are_no_rows(spark):
    """The plan's rows are those of the pairs: nothing is exploded by draw before the products are added."""
    pairs = spark.range(400).selectExpr("id % 2 g", "id u", "double(id * 7 % 31) x", "double(id * 5 % 17) y")
    out = battery.drawn_rank_correlation(pairs, ["g"], "u", "x", "y", 50, 1)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("posexplode") < plan.index("FlatMapGroupsInArrow")
