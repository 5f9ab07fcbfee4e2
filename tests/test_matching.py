"""The caliper grid join against measuring every pair."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from measurelake.operators import matching


def brute(slots, runs, scale, tiers, gate, least, most):
    out = set()
    for slot, f, k in slots:
        found = {t: {} for t in [*tiers, float("inf")]}
        for group, start, g, clusters in runs:
            if clusters != k or not gate(g):
                continue
            z = (np.array(g) - np.array(f)) / np.array(scale)
            distance = round(float(np.sqrt((z * z).mean())), 9)
            for t in found:
                if np.abs(z).max() <= t + 1e-12:
                    found[t][group] = min(found[t].get(group, (np.inf, 0)), (distance, start))
        tier = next((t for t in tiers if len(found[t]) >= least), float("inf"))
        near = sorted((d, group, start) for group, (d, start) in found[tier].items())[:most]
        out |= {(slot, tier, len(found[tier]), i + 1, group, start, d) for i, (d, group, start) in enumerate(near)}
    return out


@pytest.mark.parametrize("grid", [1, 3])
def test_matches_equal_every_pair(spark, grid):
    rng = np.random.default_rng(8)
    runs = [(f"g{i % 17}", i, [float(x) for x in rng.normal(size=4)], int(rng.integers(1, 3))) for i in range(600)]
    slots = [(f"s{i}", [float(x) for x in np.sign(rng.normal(size=4)) * (0.3 * i)], 1 + i % 2) for i in range(9)] + [("none", [0.0] * 4, 9)]
    scale, tiers = [1.0, 0.5, 2.0, 1.0], [0.9, 1.8]
    df = spark.createDataFrame(runs, "g string, start int, features array<double>, clusters int").repartition(4)
    got = matching.caliper_matches(spark.createDataFrame(slots, "slot string, features array<double>, clusters int"), df, "g", scale, tiers, lambda f: F.get(f, 1) > -1.0, grid, least=6, most=8)
    got = {tuple(r) for r in got.select("slot", "tier", "n_groups", "rank", "g", "start", "distance").collect()}
    want = brute(slots, runs, scale, tiers, lambda f: f[1] > -1.0, 6, 8)
    assert got == want and len({r[1] for r in want}) == 3
    assert matching.caliper_matches(spark.createDataFrame(slots, "slot string, features array<double>, clusters int"), df.limit(0), "g", scale, tiers, lambda f: F.lit(True)).count() == 0
