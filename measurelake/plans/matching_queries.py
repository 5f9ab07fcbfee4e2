"""Matched controls, frozen random sets and their balance; conditioning on two axes; weighted calibration."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..functions.scalar import counter_random
from ..operators import grouped, matching, ranking, structure, survival as sv
from .frames import SURV, rounded, survival, table
from .survival_queries import _UNIT, _km_sql, _ranks

TIERS = (0.1, 0.25, 0.5)
#: Accepted random sets.
SETS = 5000


def _matched(spark: SparkSession, d: str) -> DataFrame:
    """Each type's mean as a slot; parts of other types by scaled distance, over two features."""
    parts = table(spark, d, "part").select("p_partkey", "p_type", "p_brand", F.col("p_size").cast("double").alias("a"), F.col("p_retailprice").alias("b"))
    scale = parts.agg(F.stddev_pop("a").alias("sa"), F.stddev_pop("b").alias("sb"))
    slots = parts.groupBy(F.col("p_type").alias("slot")).agg(F.avg("a").alias("ma"), F.avg("b").alias("mb")).crossJoin(scale)
    # Slots are the few levels of a registry: each part meets them by explosion of one broadcast row.
    every = slots.agg(F.collect_list(F.struct("slot", "ma", "mb", "sa", "sb")).alias("slots"))
    pairs = parts.crossJoin(F.broadcast(every)).select("p_partkey", "p_type", "p_brand", "a", "b", F.explode("slots").alias("s"))
    z = lambda x, m, s: (F.col(x) - F.col(m)) / F.col(s)
    far = F.round(F.sqrt((z("a", "s.ma", "s.sa") ** 2 + z("b", "s.mb", "s.sb") ** 2) / 2), 9)
    return pairs.filter(F.col("p_type") != F.col("s.slot")).select(F.col("s.slot").alias("slot"), "p_partkey", "p_brand", "a", "b", far.alias("distance"))


_MATCHED = """x AS (SELECT stddev_pop(p_size) AS sa, stddev_pop(p_retailprice) AS sb FROM part), c AS (SELECT p_type AS slot, avg(p_size) AS ma, avg(p_retailprice) AS mb FROM part GROUP BY 1),
m AS (SELECT slot, p_partkey, p_brand, p_size AS a, p_retailprice AS b, round(sqrt((pow((p_size - ma) / sa, 2) + pow((p_retailprice - mb) / sb, 2)) / 2), 9) AS distance FROM part, c, x WHERE p_type <> slot)"""


def _tiered(spark: SparkSession, d: str) -> DataFrame:
    """The narrowest caliper tier at which a slot has controls of ten brands, and the controls within it."""
    tier = F.explode(F.array(*map(F.lit, TIERS))).alias("tier")
    within = _matched(spark, d).select("*", tier).filter("distance <= tier")
    enough = within.groupBy("slot", "tier").agg(F.count_distinct("p_brand").alias("n_brands"), F.count(F.lit(1)).alias("n")).filter("n_brands >= 10")
    chosen = enough.groupBy("slot").agg(F.min("tier").alias("tier"))
    return within.join(F.broadcast(chosen), ["slot", "tier"])


_TIERED = f"""{_MATCHED}, w AS (SELECT m.*, tier FROM m, (VALUES (CAST(0.1 AS DOUBLE)), (CAST(0.25 AS DOUBLE)), (CAST(0.5 AS DOUBLE))) t(tier) WHERE distance <= tier),
e AS (SELECT slot, tier FROM w GROUP BY 1, 2 HAVING count(DISTINCT p_brand) >= 10), h AS (SELECT slot, min(tier) AS tier FROM e GROUP BY 1), v AS (SELECT w.* FROM w JOIN h ON w.slot = h.slot AND w.tier = h.tier)"""


def caliper_tiers(spark: SparkSession, d: str) -> DataFrame:
    return _tiered(spark, d).groupBy("slot", "tier").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("p_brand").alias("n_brands"))


CALIPERS = f"WITH {_TIERED} SELECT slot, tier, count(*) AS n, count(DISTINCT p_brand) AS n_brands FROM v GROUP BY 1, 2"


def _sets(spark: SparkSession, d: str, n: int = SETS) -> DataFrame:
    """The first ``n`` accepted random sets: one of the twenty nearest controls per slot by hashed draws; sets with a brand twice are rejected.

    Candidates are drawn until ``n`` are accepted; which sets these are does not
    depend on how many were drawn at a time.
    """
    nearest = ranking.top_k(_tiered(spark, d), "slot", [F.col("distance"), F.col("p_brand"), F.col("p_partkey")], 20)
    sizes = nearest.groupBy("slot").agg(F.count(F.lit(1)).alias("k"))
    whole = Window.partitionBy("set_id")
    most = n
    while True:
        most *= 4
        # One draw a slot and candidate; the control it names comes by an equality join.
        drawn = sizes.withColumn("set_id", F.explode(F.sequence(F.lit(0), F.lit(most - 1))))
        drawn = drawn.withColumn("rank", (F.pmod(counter_random(43, "set_id", "slot"), F.col("k")) + 1).cast("int")).join(nearest, ["slot", "rank"])
        checked = drawn.withColumn("brands", F.size(F.collect_set("p_brand").over(whole))).withColumn("members", F.count(F.lit(1)).over(whole))
        accepted = checked.filter("brands = members")
        # The n-th accepted id, or null: one number to the driver.
        ids = accepted.select("set_id").distinct().orderBy("set_id").limit(n)
        found = ids.agg(F.count("set_id").alias("n"), F.max("set_id").alias("last")).first()
        if found["n"] >= n or most >= 256 * n:
            break
    if found["n"] < n:
        raise ValueError(f"{found['n']} of {most} candidate sets were accepted, {n} are wanted")
    kept = accepted.filter(F.col("set_id") <= F.lit(found["last"]))
    return kept.select("set_id", "slot", "p_partkey", "p_brand", "a", "b", "distance")


_SETS = f"""{_TIERED}, t AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY slot ORDER BY distance, p_brand, p_partkey) AS rank FROM v) WHERE rank <= 20), k AS (SELECT *, count(*) OVER (PARTITION BY slot) AS k FROM t),
g AS (SELECT s AS set_id, k.* FROM k, range({8 * SETS}) r(s) WHERE CAST('0x' || substr(md5('43|' || s || '|' || slot), 1, 8) AS BIGINT) % k = rank - 1),
f AS (SELECT * FROM g WHERE set_id IN (SELECT set_id FROM g GROUP BY 1 HAVING count(DISTINCT p_brand) = count(*) ORDER BY set_id LIMIT {SETS}))"""


def frozen_sets(spark: SparkSession, d: str) -> DataFrame:
    return _sets(spark, d).select("set_id", "slot", "p_partkey")


FROZEN = f"WITH {_SETS} SELECT CAST(set_id AS INTEGER) AS set_id, slot, p_partkey FROM f"


def set_balance(spark: SparkSession, d: str) -> DataFrame:
    """Features of the controls weighted by how often the sets use them."""
    used = _sets(spark, d).groupBy("slot", "p_partkey", "a", "b", "distance").agg(F.count(F.lit(1)).alias("w"))
    mean = lambda c: F.sum(F.col(c) * F.col("w")) / F.sum("w")
    return rounded(used.groupBy("slot").agg(F.count(F.lit(1)).alias("n_controls"), mean("a").alias("mean_a"), mean("b").alias("mean_b"), mean("distance").alias("mean_distance")), "mean_a", "mean_b", "mean_distance")


BALANCE = f"WITH {_SETS} SELECT slot, count(DISTINCT p_partkey) AS n_controls, round(avg(a), 6) + 0.0 AS mean_a, round(avg(b), 6) + 0.0 AS mean_b, round(avg(distance), 6) + 0.0 AS mean_distance FROM f GROUP BY 1"


def two_axis_rho(spark: SparkSession, d: str) -> DataFrame:
    """Correlations of the first sixty-two components given the two others: the second axis is made orthogonal to the first."""
    ranks = _ranks(spark, d)
    axis = lambda p: ranks.filter(F.col("probe") == p).select("unit", F.col("r").alias("s"))
    first = axis(62)
    rest = structure.condition_on(ranks.filter("probe <> 62"), first)
    second = rest.filter("probe = 63").select("unit", F.col("r").alias("s"))
    return rounded(structure.spearman_pairs(structure.condition_on(rest.filter("probe < 62"), second)), "rho")


TWO_AXES = f"""WITH {_UNIT}, s1 AS (SELECT unit, r AS s FROM u WHERE probe = 62), e AS (SELECT u.unit, probe, r - s * sum(r * s) OVER (PARTITION BY probe) AS r FROM u JOIN s1 USING (unit) WHERE probe <> 62),
f AS (SELECT unit, probe, r / sqrt(sum(r * r) OVER (PARTITION BY probe)) AS r FROM e), s2 AS (SELECT unit, r AS s FROM f WHERE probe = 63),
g AS (SELECT f.unit, probe, r - s * sum(r * s) OVER (PARTITION BY probe) AS r FROM f JOIN s2 USING (unit) WHERE probe < 62), h AS (SELECT unit, probe, r / sqrt(sum(r * r) OVER (PARTITION BY probe)) AS r FROM g)
SELECT a.probe AS probe_i, b.probe AS probe_j, round(sum(a.r * b.r), 6) + 0.0 AS rho, count(*) AS n FROM h a JOIN h b ON a.unit = b.unit AND a.probe < b.probe GROUP BY 1, 2"""


def ipcw_weights(spark: SparkSession, d: str) -> DataFrame:
    """Censoring weights at 36 months: the mass of cases and controls they stand for, by fold."""
    rows = survival(spark, d)
    curve = sv.kaplan_meier(rows, ["fold"], of=0)
    at = curve.filter("t <= 36").groupBy("fold").agg(F.min("surv").alias("g"))
    joined = rows.join(curve.select("fold", "t", "surv_before"), ["fold", "t"]).join(F.broadcast(at), "fold")
    case = (F.col("event") == 1) & (F.col("t") <= 36)
    weight = F.when(case, F.col("n") / F.col("surv_before")).when(F.col("t") > 36, F.col("n") / F.col("g")).otherwise(0.0)
    out = joined.groupBy("fold").agg(F.sum(F.when(case, weight)).alias("case_mass"), F.sum(F.when(F.col("t") > 36, weight)).alias("control_mass"))
    return rounded(out, "case_mass", "control_mass", digits=4)


IPCW = f"""WITH {SURV}, {_km_sql(0)}, g AS (SELECT fold, min(surv) AS g FROM km WHERE t <= 36 GROUP BY 1)
SELECT s.fold, round(sum(CASE WHEN event = 1 AND t <= 36 THEN n / surv_before END), 4) + 0.0 AS case_mass, round(sum(CASE WHEN t > 36 THEN n / g END), 4) + 0.0 AS control_mass FROM surv s JOIN km USING (fold, t) JOIN g USING (fold) GROUP BY 1"""


def ipcw_calibration(spark: SparkSession, d: str) -> DataFrame:
    """Weighted recalibration of the score at 36 months, by fold, over counted levels."""
    rows = survival(spark, d)
    curve = sv.kaplan_meier(rows, ["fold"], of=0)
    at = curve.filter("t <= 36").groupBy("fold").agg(F.min("surv").alias("g"))
    joined = rows.join(curve.select("fold", "t", "surv_before"), ["fold", "t"]).join(F.broadcast(at), "fold")
    case = (F.col("event") == 1) & (F.col("t") <= 36)
    weight = F.when(case, F.col("n") / F.col("surv_before")).when(F.col("t") > 36, F.col("n") / F.col("g"))
    levels = joined.withColumn("w", weight).filter("w is not null").groupBy("fold", "score", case.cast("int").alias("y")).agg(F.sum("w").alias("w"))
    return grouped.calibration(levels.withColumn("score", F.col("score").cast("double")), ["fold"], "y", "score", "w")


RUN, APART, CALIPERS_SD = 5, 40, [1.5, 2.5]
FIXED = [f"Brand#{i}" for i in range(1, 6)]
_TYPES = ["ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL"]
_SIZE, _PRICE = "p_size / 50.0", "p_retailprice / 1000.0"
#: Fifteen features with the geometry that every run has: means of these, deviations of the first two.
MEANS = {"size": _SIZE, "price": _PRICE} | {t.lower(): f"CAST(p_type = '{t}' AS INTEGER)" for t in _TYPES}
MEANS |= {"product": f"{_SIZE} * {_PRICE}", "small": "CAST(p_name LIKE 'small%' AS INTEGER)", "red": "CAST(p_name LIKE 'red%' AS INTEGER)"}
SPREADS = {"size": _SIZE, "price": _PRICE}
WIDTH = len(MEANS) + len(SPREADS) + 3


def _runs(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, list[float]]:
    """Slots (the first run of each fixed brand), the runs of all other brands, and the features' scales over all runs."""
    cast = lambda given: {k: F.expr(e) for k, e in given.items()}
    runs = matching.run_features(table(spark, d, "part"), "p_brand", "p_partkey", RUN, cast(MEANS), cast(SPREADS), APART)
    fixed = F.col("p_brand").isin(FIXED)
    slots = ranking.top_k(runs.filter(fixed), "p_brand", [F.col("start")], 1).select(F.col("p_brand").alias("slot"), "features", "clusters")
    return slots, runs.filter(~fixed), matching.scales(runs, WIDTH)


def _controls(slots: DataFrame, runs: DataFrame, scale: list[float]) -> DataFrame:
    return matching.caliper_matches(slots, runs, "p_brand", scale, CALIPERS_SD, lambda f: F.get(f, 0) >= 0.10)


def matched_controls(spark: SparkSession, d: str) -> DataFrame:
    """Twenty nearest control runs of each slot over fifteen features; tier 3 is without a caliper."""
    tier = F.when(F.col("tier") == CALIPERS_SD[0], 1).when(F.col("tier") == CALIPERS_SD[1], 2).otherwise(3)
    return _controls(*_runs(spark, d)).select("slot", tier.alias("tier"), "n_groups", "rank", "p_brand", "start", "distance")


def matched_balance(spark: SparkSession, d: str) -> DataFrame:
    slots, runs, scale = _runs(spark, d)
    return rounded(matching.feature_balance(_controls(slots, runs, scale), slots, runs, "p_brand", scale), "slot_value", "control_mean", "difference")


_F = [f"f{i}" for i in range(WIDTH)]
_AVG = [f"avg({e}) OVER r" for e in MEANS.values()] + [f"stddev_pop({e}) OVER r" for e in SPREADS.values()]
_GEO = ["p_partkey - first_value(p_partkey) OVER r", "median(gap) OVER q", "max(gap) OVER q"]
_DIFF = [f"(u.{f} - s.{f}) / c.s{i}" for i, f in enumerate(_F)]
_RUNS = f"""p AS (SELECT *, p_partkey - lag(p_partkey) OVER w AS gap, row_number() OVER w AS i FROM part WINDOW w AS (PARTITION BY p_brand ORDER BY p_partkey)),
a AS (SELECT p_brand, i, first_value(p_partkey) OVER r AS start, {", ".join(f"{e} AS {f}" for e, f in zip(_AVG + [f"ln(greatest({g}, 1))" for g in _GEO], _F))}, 1 + count(*) FILTER (gap > {APART}) OVER q AS clusters FROM p
WINDOW r AS (PARTITION BY p_brand ORDER BY p_partkey ROWS {RUN - 1} PRECEDING), q AS (PARTITION BY p_brand ORDER BY p_partkey ROWS {RUN - 2} PRECEDING)),
u AS (SELECT * FROM a WHERE i >= {RUN}), c AS (SELECT {", ".join(f"coalesce(nullif(stddev_pop({f}), 0), 1) AS s{i}" for i, f in enumerate(_F))} FROM u),
s AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY start) AS k FROM u WHERE p_brand IN ({", ".join(repr(b) for b in FIXED)})) WHERE k = 1),
m AS (SELECT s.p_brand AS slot, u.p_brand, u.start, round(sqrt(({" + ".join(f"pow({x}, 2)" for x in _DIFF)}) / {WIDTH}), 9) AS distance, greatest({", ".join(f"abs({x})" for x in _DIFF)}) AS far
FROM s, u, c WHERE u.p_brand NOT IN ({", ".join(repr(b) for b in FIXED)}) AND u.clusters = s.clusters AND u.f0 >= 0.10),
w AS (SELECT slot, tier, p_brand, min({{'distance': distance, 'start': start}}) AS b FROM m, (VALUES (1, {CALIPERS_SD[0]}), (2, {CALIPERS_SD[1]}), (3, 1e300)) t(tier, width) WHERE far <= width + 1e-12 GROUP BY ALL),
n AS (SELECT slot, tier, count(*) AS n_groups FROM w GROUP BY ALL HAVING count(*) >= 10 OR tier = 3),
v AS (SELECT w.slot, w.tier, n_groups, p_brand, b.start AS start, b.distance AS distance FROM w JOIN (SELECT slot, min(tier) AS tier FROM n GROUP BY 1) USING (slot, tier) JOIN n USING (slot, tier)),
k AS (SELECT *, row_number() OVER (PARTITION BY slot ORDER BY distance, p_brand, start) AS rank FROM v)"""
CONTROLS = f"WITH {_RUNS} SELECT slot, tier, n_groups, CAST(rank AS INTEGER) AS rank, p_brand, start, distance FROM k WHERE rank <= 20"
_EACH = "unnest(range({n})) AS feature, unnest([{x}]) AS {name}"
BALANCE_15 = f"""WITH {_RUNS}, e AS (SELECT slot, {_EACH.format(n=WIDTH, x=", ".join("u." + f for f in _F), name="v")} FROM k JOIN u USING (p_brand, start) WHERE rank <= 20),
o AS (SELECT p_brand AS slot, {_EACH.format(n=WIDTH, x=", ".join(_F), name="slot_value")} FROM s), z AS (SELECT {_EACH.format(n=WIDTH, x=", ".join(f"s{i}" for i in range(WIDTH)), name="sd")} FROM c),
g AS (SELECT slot, feature, slot_value, avg(v) AS control_mean, any_value(sd) AS sd FROM e JOIN o USING (slot, feature) JOIN z USING (feature) GROUP BY ALL)
SELECT slot, CAST(feature AS INTEGER) AS feature, round(slot_value, 6) + 0.0 AS slot_value, round(control_mean, 6) + 0.0 AS control_mean, round((slot_value - control_mean) / sd, 6) + 0.0 AS difference FROM g"""

QUERIES = {
    "matched_controls": (matched_controls, CONTROLS),
    "matched_balance": (matched_balance, BALANCE_15),
    "caliper_tiers": (caliper_tiers, CALIPERS),
    "frozen_sets": (frozen_sets, FROZEN),
    "set_balance": (set_balance, BALANCE),
    "two_axis_rho": (two_axis_rho, TWO_AXES),
    "ipcw_weights": (ipcw_weights, IPCW),
    "ipcw_calibration": (ipcw_calibration, None),
}
