"""The axis battery: axes of every patient, tests against the customer table, agreement of the axes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.tails import t_two_sided
from ..operators import battery, ranking, resampling
from ..operators.battery import GROUPS, RANKS, REGRESSION, REST, TWO_GROUPS, Planned
from .contrast_queries import _r, _t_sql, _z_sql
from .frames import DELTA, SPEC, deltas, rounded, specimens, table

PLAN = [
    Planned("building against machinery", "segment", TWO_GROUPS, "BUILDING", "MACHINERY"),
    Planned("building against all others", "segment", TWO_GROUPS, "BUILDING", REST),
    Planned("segments", "segment", GROUPS),
    Planned("segment without rows", "segment", TWO_GROUPS, "BUILDING", "NONE"),
    Planned("balance", "balance", RANKS),
    Planned("balance, line", "balance", REGRESSION, family=False),
    Planned("specimens", "specimens", RANKS, family=False),
]
DRAWS, SEED, MIN_N = 200, 71, 5


def _axes(spark: SparkSession, d: str) -> DataFrame:
    """tumour, normal and contrast (first three probes against the others, whatever its sign) of each patient, aligned with tumour."""
    s = specimens(spark, d).filter("beta IS NOT NULL")
    arm = lambda t: F.avg(F.when(F.col("tissue") == t, F.col("beta")))
    part = lambda low: F.avg(F.when((F.col("tissue") == "T") & ((F.col("probe") < 3) if low else (F.col("probe") >= 3)), F.col("beta")))
    wide = s.groupBy("cohort", "patient").agg(arm("T").alias("tumour"), arm("N").alias("normal"), (part(False) - part(True)).alias("contrast"))
    long = wide.unpivot(["cohort", "patient"], ["tumour", "normal", "contrast"], "axis", "value").withColumn("value", F.round("value", 12))
    return battery.aligned(long.filter("value IS NOT NULL"), ["cohort"], "axis", "patient", "value", "tumour")


def _variables(spark: SparkSession, d: str) -> DataFrame:
    customers = table(spark, d, "customer").select(F.col("c_custkey").alias("patient"), "c_mktsegment", "c_acctbal")
    counts = specimens(spark, d).groupBy("cohort", "patient").agg(F.count(F.lit(1)).alias("k"))
    both = counts.join(customers, "patient")
    row = lambda name, level, number: F.struct(F.lit(name).alias("variable"), level.cast("string").alias("level"), number.cast("double").alias("number"))
    none = F.lit(None)
    rows = F.array(row("segment", F.col("c_mktsegment"), none), row("balance", none, F.col("c_acctbal")), row("specimens", none, F.col("k")))
    return both.select("cohort", "patient", F.explode(rows).alias("r")).select("cohort", "patient", "r.*")


def axis_battery(spark: SparkSession, d: str) -> DataFrame:
    out = battery.battery(_axes(spark, d), _variables(spark, d), PLAN, "cohort", "patient", "axis", "value", MIN_N)
    return rounded(out, "estimate", "median_difference", "statistic", "p", "q")


def axis_agreement(spark: SparkSession, d: str) -> DataFrame:
    out = battery.axis_agreement(_axes(spark, d), ["cohort"], "patient", "axis", "value", DRAWS, SEED, MIN_N)
    return rounded(out, "rho", "low", "high")


AXES = f"""{SPEC}, wide AS (SELECT cohort, patient, avg(beta) FILTER (tissue = 'T') AS tumour, avg(beta) FILTER (tissue = 'N') AS normal,
avg(beta) FILTER (tissue = 'T' AND probe >= 3) - avg(beta) FILTER (tissue = 'T' AND probe < 3) AS contrast FROM spec WHERE beta IS NOT NULL GROUP BY 1, 2),
long AS (SELECT cohort, patient, axis, round(value, 12) AS value FROM wide UNPIVOT (value FOR axis IN (tumour, normal, contrast))),
sgn AS (SELECT a.cohort, a.axis, CASE WHEN corr(a.value, r.value) < 0 THEN -1.0 ELSE 1.0 END AS s FROM long a JOIN long r ON a.cohort = r.cohort AND a.patient = r.patient AND r.axis = 'tumour' GROUP BY 1, 2),
ax AS (SELECT cohort, patient, axis, value * coalesce(s, 1.0) AS v FROM long LEFT JOIN sgn USING (cohort, axis))"""
_LEVELS = "rank() OVER (PARTITION BY {k} ORDER BY {v}) + (count(*) OVER (PARTITION BY {k}, {v}) - 1) / 2.0"
_KEY = "cohort, axis, label"
#: The upper tail of chi-squared for one to four degrees of freedom.
_CHI = f"""CASE df WHEN 1 THEN {_z_sql('sqrt(h)')} WHEN 2 THEN exp(-h / 2) WHEN 3 THEN {_z_sql('sqrt(h)')} + sqrt(2 * h / pi()) * exp(-h / 2) WHEN 4 THEN exp(-h / 2) * (1 + h / 2) END"""
_ROWS = ", ".join(f"('{p.label}', '{p.variable}', '{p.kind}', {repr(p.high) if p.high else 'NULL'}, {repr(p.low) if p.low else 'NULL'}, {str(p.family).lower()})" for p in PLAN)

BATTERY = f"""WITH {AXES}, k AS (SELECT cohort, patient, count(*) AS k FROM spec GROUP BY 1, 2),
va AS (SELECT cohort, patient, 'segment' AS variable, c_mktsegment AS level, CAST(NULL AS DOUBLE) AS number FROM k JOIN customer ON c_custkey = patient
UNION ALL SELECT cohort, patient, 'balance', NULL, c_acctbal FROM k JOIN customer ON c_custkey = patient UNION ALL SELECT cohort, patient, 'specimens', NULL, CAST(k AS DOUBLE) FROM k JOIN customer ON c_custkey = patient),
plan(label, variable, kind, high, low, in_family) AS (VALUES {_ROWS}),
ca AS (SELECT ax.*, plan.*, level, number FROM ax JOIN va USING (cohort, patient) JOIN plan USING (variable)),
w AS (SELECT {_KEY}, v, level = high AS arm FROM ca WHERE kind = 'two_groups' AND (level = high OR level = low OR (low = '*' AND level IS NOT NULL))),
wr AS (SELECT *, {_LEVELS.format(k=_KEY, v='v')} AS r FROM w),
wt AS (SELECT {_KEY}, sum(c * c * c - c) AS ties FROM (SELECT {_KEY}, v, count(*) AS c FROM w GROUP BY ALL) GROUP BY ALL),
ws AS (SELECT {_KEY}, 1.0 * count(*) FILTER (arm) AS a, 1.0 * count(*) FILTER (NOT arm) AS b, sum(r) FILTER (arm) AS sr, median(v) FILTER (arm) - median(v) FILTER (NOT arm) AS md FROM wr GROUP BY ALL),
wu AS (SELECT *, a + b AS n, sr - a * (a + 1) / 2 AS u FROM ws JOIN wt USING ({_KEY})),
wz AS (SELECT {_KEY}, n, 2 * u / (a * b) - 1 AS estimate, md, greatest(0.0, abs(u - a * b / 2) - 0.5) / sqrt(a * b / 12 * ((n + 1) - ties / (n * (n - 1)))) AS z FROM wu WHERE least(a, b) >= {MIN_N}),
t1 AS (SELECT {_KEY}, estimate, md, z AS st, {_z_sql('z')} AS p FROM wz),
n1 AS (SELECT {_KEY}, n FROM wu),
g AS (SELECT *, count(*) OVER (PARTITION BY {_KEY}, level) AS c FROM ca WHERE kind = 'groups' AND level IS NOT NULL),
gr AS (SELECT *, {_LEVELS.format(k=_KEY, v='v')} AS r FROM g WHERE c >= {MIN_N}),
ga AS (SELECT {_KEY}, level, sum(r) AS s, count(*) AS c FROM gr GROUP BY ALL),
gt AS (SELECT {_KEY}, sum(c * c * c - c) AS ties FROM (SELECT {_KEY}, v, count(*) AS c FROM gr GROUP BY ALL) GROUP BY ALL),
gh AS (SELECT {_KEY}, 1.0 * sum(c) AS n, count(*) - 1 AS df, sum(s * s / c) AS q FROM ga GROUP BY ALL),
gs AS (SELECT {_KEY}, n, df, (12 / (n * (n + 1)) * q - 3 * (n + 1)) / nullif(1 - ties / (n * n * n - n), 0) AS h FROM gh JOIN gt USING ({_KEY})),
t2 AS (SELECT {_KEY}, (h - df) / (n - df - 1) AS estimate, CAST(NULL AS DOUBLE) AS md, h AS st, {_CHI} AS p FROM gs WHERE df >= 1 AND h IS NOT NULL),
x AS (SELECT {_KEY}, v, number FROM ca WHERE kind = 'ranks' AND number IS NOT NULL),
xr AS (SELECT *, {_LEVELS.format(k=_KEY, v='v')} AS a, {_LEVELS.format(k=_KEY, v='number')} AS b FROM x),
xs AS (SELECT {_KEY}, count(*) AS n, corr(a, b) AS rho FROM xr GROUP BY ALL),
xt AS (SELECT *, CASE WHEN abs(rho) < 1 THEN rho * sqrt((n - 2) / (1 - rho * rho)) END AS t FROM xs WHERE n >= {MIN_N}),
t3 AS (SELECT {_KEY}, rho AS estimate, CAST(NULL AS DOUBLE) AS md, t AS st, CASE WHEN t IS NOT NULL THEN {_t_sql('t', '(n - 2)')} END AS p FROM xt),
l AS (SELECT {_KEY}, count(*) AS n, regr_slope(v, number) AS b, regr_sxx(v, number) AS sxx, regr_syy(v, number) AS syy FROM ca WHERE kind = 'regression' AND number IS NOT NULL GROUP BY ALL),
lt AS (SELECT *, CASE WHEN n >= {MIN_N} AND sxx > 0 AND syy - b * b * sxx > 0 THEN b / sqrt((syy - b * b * sxx) / (n - 2) / sxx) END AS t FROM l),
t4 AS (SELECT {_KEY}, CASE WHEN t IS NOT NULL THEN b END AS estimate, CAST(NULL AS DOUBLE) AS md, t AS st, CASE WHEN t IS NOT NULL THEN {_t_sql('t', '(n - 2)')} END AS p FROM lt),
n AS (SELECT * FROM n1 UNION ALL SELECT {_KEY}, n FROM gs UNION ALL SELECT {_KEY}, n FROM xs UNION ALL SELECT {_KEY}, n FROM lt),
t AS (SELECT * FROM t1 UNION ALL SELECT * FROM t2 UNION ALL SELECT * FROM t3 UNION ALL SELECT * FROM t4),
e AS (SELECT cohort, axis, label, kind, in_family, coalesce(CAST(n AS BIGINT), 0) AS n, estimate, md AS median_difference, st AS statistic, p
FROM (SELECT DISTINCT cohort, axis FROM ax) CROSS JOIN plan LEFT JOIN n USING ({_KEY}) LEFT JOIN t USING ({_KEY})),
o AS (SELECT *, row_number() OVER (PARTITION BY cohort, in_family ORDER BY p NULLS LAST) AS rk, count(p) OVER (PARTITION BY cohort, in_family) AS fam FROM e),
q AS (SELECT *, CASE WHEN p IS NOT NULL THEN least(1.0, min(p * fam / rk) OVER (PARTITION BY cohort, in_family ORDER BY rk DESC ROWS UNBOUNDED PRECEDING)) END AS q FROM o)
SELECT cohort, axis, label, kind, in_family, n, p IS NOT NULL AS tested, {_r('estimate', 'median_difference', 'statistic', 'p', 'q')} FROM q"""


def _weights() -> str:
    return " + ".join(f"CASE WHEN h >= {c} THEN 1 ELSE 0 END" for c in resampling.POISSON_CUTS)


_OWN = "cohort, axis_a, axis_b"
#: A row for each time that a unit is drawn; ranks by window.
AGREEMENT = f"""WITH {AXES}, p AS (SELECT a.cohort, a.patient, a.axis AS axis_a, b.axis AS axis_b, a.v AS x, b.v AS y FROM ax a JOIN ax b ON a.cohort = b.cohort AND a.patient = b.patient AND a.axis < b.axis),
h AS (SELECT p.*, dr, CAST('0x' || substr(md5('{SEED}|' || (dr // 4) || '|' || patient), 1 + 8 * (dr % 4), 8) AS BIGINT) AS h FROM p CROSS JOIN range({DRAWS}) r(dr)),
w AS (SELECT {_OWN}, x, y, dr, unnest(range({_weights()})) AS copy FROM h UNION ALL SELECT {_OWN}, x, y, -1, 0 FROM p),
r AS (SELECT {_OWN}, dr, {_LEVELS.format(k=_OWN + ', dr', v='x')} AS a, {_LEVELS.format(k=_OWN + ', dr', v='y')} AS b FROM w),
c AS (SELECT {_OWN}, dr, count(*) AS n, CASE WHEN var_pop(a) > 0 AND var_pop(b) > 0 THEN corr(a, b) END AS rho FROM r GROUP BY ALL),
i AS (SELECT {_OWN}, quantile_cont(rho, 0.025) AS low, quantile_cont(rho, 0.975) AS high FROM c WHERE dr >= 0 AND rho IS NOT NULL GROUP BY ALL)
SELECT {_OWN}, n, {_r('rho', 'low', 'high')} FROM (SELECT * FROM c WHERE dr = -1 AND n >= {MIN_N}) LEFT JOIN i USING ({_OWN})"""

def _probe_pair(spark: SparkSession, d: str) -> DataFrame:
    """Differences of the first two probes of every patient who has both."""
    pick = lambda p: F.max(F.when(F.col("probe") == p, F.col("delta")))
    return deltas(spark, d).groupBy("cohort", "patient").agg(pick(0).alias("x"), pick(1).alias("y")).dropna()


def spearman_p(spark: SparkSession, d: str) -> DataFrame:
    """Rank correlation of two probes by cohort with its t p."""
    rho = battery.rank_correlation(_probe_pair(spark, d), ["cohort"], "x", "y").filter("n >= 3")
    t = F.when(F.abs("rho") < 1, F.col("rho") * F.sqrt((F.col("n") - 2) / (1 - F.col("rho") * F.col("rho"))))
    return rounded(rho.withColumn("df", (F.col("n") - 2).cast("double")).withColumn("p", t_two_sided(t, F.col("df"))), "rho", "p")


def spearman_bootstrap(spark: SparkSession, d: str) -> DataFrame:
    """Percentile interval of the rank correlation; every draw is ranked anew."""
    pairs = _probe_pair(spark, d)
    drawn = battery.drawn_rank_correlation(pairs, ["cohort"], "patient", "x", "y", DRAWS, SEED).persist()
    each = drawn.filter((F.col("draw") >= 0) & F.col("rho").isNotNull())
    valid = each.groupBy("cohort").agg(F.count(F.lit(1)).alias("n_valid"))
    interval = ranking.quantile_linear(each, ["cohort"], "rho", {"low": 0.025, "high": 0.975}).join(valid, "cohort")
    return rounded(drawn.filter("draw < 0").drop("draw").join(interval, "cohort"), "rho", "low", "high")


_PAIR = f"""{SPEC}, {DELTA}, p AS (SELECT a.cohort, a.patient, a.delta AS x, b.delta AS y FROM delta a JOIN delta b ON a.cohort = b.cohort AND a.patient = b.patient WHERE a.probe = 0 AND b.probe = 1)"""
SPEARMAN_P = f"""WITH {_PAIR}, r AS (SELECT cohort, {_LEVELS.format(k='cohort', v='x')} AS a, {_LEVELS.format(k='cohort', v='y')} AS b FROM p),
c AS (SELECT cohort, count(*) AS n, corr(a, b) AS rho, CAST(count(*) - 2 AS DOUBLE) AS df FROM r GROUP BY 1 HAVING count(*) >= 3), t AS (SELECT *, CASE WHEN abs(rho) < 1 THEN rho * sqrt((n - 2) / (1 - rho * rho)) END AS t FROM c)
SELECT cohort, n, df, {_r('rho')}, round({_t_sql('t', 'df')}, 6) + 0.0 AS p FROM t"""
SPEARMAN_BOOTSTRAP = f"""WITH {_PAIR}, h AS (SELECT p.*, dr, CAST('0x' || substr(md5('{SEED}|' || (dr // 4) || '|' || patient), 1 + 8 * (dr % 4), 8) AS BIGINT) AS h FROM p CROSS JOIN range({DRAWS}) r(dr)),
w AS (SELECT cohort, x, y, dr, unnest(range({_weights()})) AS copy FROM h UNION ALL SELECT cohort, x, y, -1, 0 FROM p),
r AS (SELECT cohort, dr, {_LEVELS.format(k='cohort, dr', v='x')} AS a, {_LEVELS.format(k='cohort, dr', v='y')} AS b FROM w),
c AS (SELECT cohort, dr, count(*) AS n, CASE WHEN var_pop(a) > 0 AND var_pop(b) > 0 THEN corr(a, b) END AS rho FROM r GROUP BY ALL),
i AS (SELECT cohort, count(*) AS n_valid, quantile_cont(rho, 0.025) AS low, quantile_cont(rho, 0.975) AS high FROM c WHERE dr >= 0 AND rho IS NOT NULL GROUP BY 1)
SELECT cohort, n, n_valid, {_r('rho', 'low', 'high')} FROM (SELECT * FROM c WHERE dr = -1) JOIN i USING (cohort)"""

QUERIES = {
    "axis_battery": (axis_battery, BATTERY),
    "axis_agreement": (axis_agreement, AGREEMENT),
    "spearman_p": (spearman_p, SPEARMAN_P),
    "spearman_bootstrap": (spearman_bootstrap, SPEARMAN_BOOTSTRAP),
}
