"""Prefix counts, ranks and order statistics over ranges, wherever the ranges are cut."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from measurelake.operators import ranking


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(6)
    values = [("a", float(v)) for v in np.round(rng.normal(size=400), 1)] + [("b", 2.0)] * 50 + [(None, float(v)) for v in range(9)] + [("c", None), ("d", -0.5)]
    return spark.createDataFrame(values, "g string, v double").repartition(3)


@pytest.mark.parametrize("ranges", [1, 2, 7, 64])
def test_cumulated(rows, ranges):
    levels = rows.filter("v is not null").groupBy("g", "v").agg(F.count(F.lit(1)).alias("n"))
    got = ranking.cumulated(levels, ["g"], "v", ["n"], ranges).collect()
    given = [(r.g, r.v) for r in rows.collect() if r.v is not None]
    assert len(got) == len(set(given))
    for r in got:
        own = [v for g, v in given if g == r.g]
        assert (r.n, r.n__below, r.n__total) == (own.count(r.v), sum(v < r.v for v in own), len(own))
    whole = ranking.cumulated(levels.groupBy("v").agg(F.sum("n").alias("n")), [], "v", ["n"], ranges).collect()
    assert all(r.n__below == sum(v < r.v for _, v in given) for r in whole)


def test_quantiles(rows):
    got = {r.g: r for r in ranking.quantile_linear(rows, ["g"], "v", {"low": 0.1, "mid": 0.5, "top": 1.0}).collect()}
    high = {r.g: r.h for r in ranking.quantile_higher(rows, "v", ["g"], 0.9, "h").collect()}
    given = {}
    for r in rows.filter("v is not null").collect():
        given.setdefault(r.g, []).append(r.v)
    assert set(got) == set(given) == set(high)
    for g, own in given.items():
        assert [got[g].low, got[g].mid, got[g].top] == pytest.approx([np.quantile(own, q) for q in (0.1, 0.5, 1.0)])
        assert high[g] == np.quantile(own, 0.9, method="higher")
    assert ranking.quantile_linear(rows.limit(0), ["g"], "v", {"q": 0.5}).count() == 0


def test_no_window_over_a_whole_group(rows):
    """Windows in order of the values are over a range each; whole groups only have sums per range."""
    plan = ranking.quantile_higher(rows, "v", ["g"], 0.5, "h")._jdf.queryExecution().optimizedPlan().toString()
    windows = [line for line in plan.splitlines() if "Window [" in line]
    assert windows and all("__range" in line for line in windows if " v#" in line)
