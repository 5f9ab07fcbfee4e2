"""Steps that must not grow faster than their input, and their exact results on small cases."""

import numpy as np

from measurelake.operators import ranking, relational, resampling, survival as sv
from measurelake.plans import matching_queries, relational_queries


def test_overlaps_are_counted_without_pairs(spark):
    rng = np.random.default_rng(3)
    # Repeated keys, nulls, touching ends, and intervals that end before they start.
    rows = [("ab"[i % 2], int(rng.integers(0, 60)), int(s), int(s + rng.integers(-4, 25))) for i, s in enumerate(rng.integers(0, 120, 160))]
    df = spark.createDataFrame([*rows, ("a", None, 1, 9), (None, 1, 1, 9), ("a", 1, None, 9), ("none", 1, 5, 9)], "chr string, k long, start long, end long").repartition(3)
    got = {r.chr: (r.n_pairs, r.sum_a, r.sum_b) for r in relational.overlap_sums(df, "chr", "k").collect()}
    want = {}
    for c in "ab":
        pairs = [(a[1], b[1]) for a in rows for b in rows if a[0] == b[0] == c and a[2] <= b[3] and b[2] <= a[3] and a[1] < b[1]]
        want[c] = (len(pairs), sum(a for a, _ in pairs), sum(b for _, b in pairs))
    assert got == want
    # Every pair of 20,000 intervals: 200 million, of which none is a row.
    many = spark.range(20000).selectExpr("'c' chr", "id k", "id % 7 start", "id % 7 + 9 `end`")
    r = relational.overlap_sums(many, "chr", "k").first()
    n = 20000
    assert (r.n_pairs, r.sum_a, r.sum_b) == (n * (n - 1) // 2, sum(k * (n - 1 - k) for k in range(n)), sum(k * k for k in range(n)))


def test_small_groups_have_no_quantiles(spark):
    """Groups of up to WHOLE rows are one range: no digest a group, and the same counts."""
    rows = spark.range(3000).selectExpr("id % 1000 g", "id v", "1 n")
    out = ranking.cumulated(rows, ["g"], "v", ["n"])
    assert {(r.v, r.n__below, r.n__total) for r in out.collect()} == {(v, v // 1000, 3) for v in range(3000)}
    assert "__size" in out._jdf.queryExecution().optimizedPlan().toString()


def test_sums_of_levels_scan_the_subjects_once(spark):
    levels = spark.createDataFrame([("a", i % 7 + 1, i % 2, i % 5, 2) for i in range(60)], "fold string, t int, event int, score int, n int")
    plan = sv.concordance(levels, ["fold"], True)._jdf.queryExecution().withCachedData().toString()
    assert "InMemoryRelation" in plan and plan.count("LogicalRDD") + plan.count("LocalRelation") == 0


def test_runs_are_never_broadcast(spark):
    plan = matching_queries.matched_controls(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    joins = [line for line in plan.splitlines() if "Join Inner" in line]
    assert joins and all("Hint=(strategy=broadcast)" in line.replace("rightHint", "Hint").replace("leftHint", "Hint") for line in joins)


def test_units_bring_their_columns_and_weights_add_up(spark):
    units = spark.range(300).selectExpr("id % 3 g", "id u", "array(id, -id) own")
    rows = resampling.bootstrap_weights(units, ["g"], "u", 7, 5).collect()
    assert all(r.own == [r.u, -r.u] and r.g == r.u % 3 for r in rows)
    total = {}
    for r in rows:
        total[r.g, r.draw] = total.get((r.g, r.draw), 0) + r.weight
    assert set(total.values()) == {100} and len(total) == 21


def test_cube_counts_lines_by_part_first(spark):
    plan = relational_queries.grouping_sets_location(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    join = next(i for i, line in enumerate(plan.splitlines()) if "Join Inner" in line)
    assert any("Aggregate [l_partkey" in line for line in plan.splitlines()[join:])


def test_overlaps_broadcast_only_cuts(spark):
    """Joins choose their side themselves: sizes of files do not tell how many rows are made of them.  The table is read a few times only."""
    plan = relational_queries.interval_overlap(spark, "/root/testdata/sf0.001")._jdf.queryExecution()
    joins = [line for line in plan.optimizedPlan().toString().splitlines() if "Join " in line]
    assert joins and all("strategy=" in line for line in joins)
    assert plan.executedPlan().toString().count("FileScan") <= 10
