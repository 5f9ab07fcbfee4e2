"""Recurrence models over counted levels, and the stability of cut-offs under resampling."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators import inference, recurrence, resampling
from .frames import SPEC, SURV, rounded, specimens, survival, table
from .survival_queries import HORIZON, _km_sql

BY = ["fold"]
#: The linear predictor of the risk queries.
SLOPE = 0.1
PENALTIES = [float(p) for p in 10 ** np.linspace(-4, 2, 25)]
COVARIATES = ["quantity", "discount", "open"]


def _grid(spark: SparkSession, d: str) -> DataFrame:
    return recurrence.brier_grid(survival(spark, d), BY, F.col("score") * SLOPE, HORIZON)


_GRID = f"""{SURV}, {_km_sql(0)}, b AS (SELECT fold, t, sum(hazard) OVER (PARTITION BY fold ORDER BY t ROWS UNBOUNDED PRECEDING) AS cumhaz FROM (
  SELECT fold, t, n_event / sum(r) OVER (PARTITION BY fold ORDER BY t DESC ROWS UNBOUNDED PRECEDING) AS hazard FROM (
    SELECT fold, t, sum(n * exp(score * {SLOPE})) AS r, sum(CASE WHEN event = 1 THEN n ELSE 0 END) AS n_event FROM surv GROUP BY 1, 2))),
q AS (SELECT fold, i * CAST({HORIZON / 100} AS DOUBLE) AS tau FROM (SELECT DISTINCT fold FROM surv) CROSS JOIN range(101) r(i)),
gg AS (SELECT q.fold, tau, coalesce(arg_max(surv, t), 1.0) AS g FROM q LEFT JOIN km ON q.fold = km.fold AND km.t <= tau GROUP BY 1, 2),
hh AS (SELECT q.fold, tau, coalesce(arg_max(cumhaz, t), 0.0) AS h FROM q LEFT JOIN b ON q.fold = b.fold AND b.t <= tau GROUP BY 1, 2),
x AS (SELECT s.fold, tau, s.t, event, n, surv_before, g, 1 - exp(-h * exp(score * {SLOPE})) AS risk FROM surv s JOIN km USING (fold, t) JOIN gg ON gg.fold = s.fold JOIN hh USING (fold, tau)),
y AS (SELECT fold, tau, sum(CASE WHEN event = 1 AND t <= tau THEN n * pow(1 - risk, 2) / surv_before WHEN t > tau THEN n * pow(risk, 2) / g ELSE 0.0 END) / sum(n) AS v,
  min(CASE WHEN event = 1 AND t <= tau THEN surv_before WHEN t > tau THEN g ELSE 1.0 END) AS used FROM x GROUP BY 1, 2),
grid AS (SELECT fold, tau, CASE WHEN used > 0.1 THEN v END AS brier FROM y)"""


def cox_brier_grid(spark: SparkSession, d: str) -> DataFrame:
    """IPCW Brier score of the Cox risk at 101 points up to the horizon."""
    return rounded(_grid(spark, d), "tau", "brier")


GRID = f"WITH {_GRID} SELECT fold, round(tau, 6) + 0.0 AS tau, round(brier, 6) + 0.0 AS brier FROM grid"


def ipcw_ibs(spark: SparkSession, d: str) -> DataFrame:
    return rounded(recurrence.integrated(_grid(spark, d), BY, HORIZON), "ibs")


IBS = f"""WITH {_GRID}, s AS (SELECT fold, brier, (lead(tau) OVER w - tau) * (lead(brier) OVER w + brier) / 2.0 AS a FROM grid WINDOW w AS (PARTITION BY fold ORDER BY tau))
SELECT fold, count(brier) AS n_points, CASE WHEN count(brier) = count(*) THEN round(sum(a) / {HORIZON}.0, 6) + 0.0 END AS ibs FROM s GROUP BY 1"""


def _subjects(spark: SparkSession, d: str) -> DataFrame:
    """Levels of (fold, inner fold, time, event, three covariates) with their counts."""
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_shipdate", "l_returnflag", "l_quantity", "l_discount", "l_linestatus")
    orders = table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderdate")
    frame = lines.join(orders, "l_orderkey").withColumn("d", F.datediff("l_shipdate", "o_orderdate")).filter("d > 0")
    return frame.groupBy(
        (F.col("l_linenumber") % 4).alias("fold"), (F.col("l_orderkey") % 5).cast("int").alias("inner"), F.ceil(F.col("d") / 30.0).cast("int").alias("t"), (F.col("l_returnflag") == "R").cast("int").alias("event"),
        F.floor(F.col("l_quantity") / 5).cast("double").alias("quantity"), F.round(F.col("l_discount") * 100).cast("double").alias("discount"), (F.col("l_linestatus") == "O").cast("double").alias("open"),
    ).agg(F.count(F.lit(1)).alias("n"))


def cox_ridge_path(spark: SparkSession, d: str) -> DataFrame:
    """Coefficients along 25 ridge penalties, by fold."""
    return rounded(recurrence.cox_path(_subjects(spark, d), BY, COVARIATES, PENALTIES, 0.0), "beta")


def cox_tuned(spark: SparkSession, d: str) -> DataFrame:
    """Ridge and elastic-net Cox models by inner cross-validated deviance and the one-standard-error rule."""
    rows = _subjects(spark, d)
    parts = [recurrence.cox_tuned(rows, BY, "inner", COVARIATES, PENALTIES, mix).withColumn("mix", F.lit(mix)) for mix in (0.0, 0.5)]
    return rounded(parts[0].unionByName(parts[1]), "beta", "beta_raw")


def cox_proportionality(spark: SparkSession, d: str) -> DataFrame:
    return rounded(recurrence.proportionality(survival(spark, d), BY, "score"), "beta", "rho", "chi2", "p")


def joint_permutation(spark: SparkSession, d: str) -> DataFrame:
    """999 joint permutations of (time, event) against the score, by fold."""
    return rounded(recurrence.joint_permutation(survival(spark, d), BY, 999, 909, HORIZON), "observed", "p")


def recurrence_metrics(spark: SparkSession, d: str) -> DataFrame:
    """Uno's C of two scores and their difference with intervals over 500 shared draws."""
    rows = _subjects(spark, d).groupBy("fold", "t", "event", "quantity", "discount").agg(F.sum("n").alias("n"))
    return rounded(recurrence.metric_bootstrap(rows, BY, ["quantity", "discount"], 500, 31, HORIZON), "value", "low", "high")


def _normal(spark: SparkSession, d: str) -> DataFrame:
    return specimens(spark, d).filter("tissue = 'N' and beta is not null").select("cohort", "patient", "probe", "beta")


def cutoff_folds(spark: SparkSession, d: str) -> DataFrame:
    """Range of the cut-offs over the training parts of 5 folds repeated 20 times."""
    rows = _normal(spark, d)
    folds = resampling.kfolds(rows.select("patient").distinct(), "patient", 5, 20, 53)
    held = F.explode(F.sequence(F.lit(0), F.lit(4))).alias("held")
    parts = rows.join(folds, "patient").select("cohort", "probe", "beta", "repeat", "fold", held).filter("fold <> held").withColumn("weight", F.lit(1))
    cuts = inference.weighted_cutoffs(parts, ["cohort", "probe", "repeat", "held"], "beta")
    out = cuts.groupBy("cohort", "probe").agg(F.count(F.lit(1)).alias("n_fits"), *[f(c).alias(f"{c}_{n}") for c in ("q95", "mean25") for n, f in (("low", F.min), ("high", F.max))])
    return rounded(out, "q95_low", "q95_high", "mean25_low", "mean25_high")


_CUTS = """c AS (SELECT {by}, min(CASE WHEN r >= ceil((n - 1) * 0.95 - 1e-9) + 1 THEN beta END) AS q95, 2.5 * sum(w * beta) / sum(w) AS mean25 FROM (
  SELECT *, sum(w) OVER (PARTITION BY {by} ORDER BY beta RANGE UNBOUNDED PRECEDING) AS r, sum(w) OVER (PARTITION BY {by}) AS n FROM p WHERE w > 0) GROUP BY ALL)"""

FOLDS = f"""WITH {SPEC}, s AS (SELECT * FROM spec WHERE tissue = 'N' AND beta IS NOT NULL),
k AS (SELECT repeat, patient, ntile(5) OVER (PARTITION BY repeat ORDER BY md5('53|' || repeat || '|' || patient), patient) - 1 AS fold FROM (SELECT DISTINCT patient FROM s) CROSS JOIN range(20) r(repeat)),
p AS (SELECT cohort, probe, beta, repeat, held, 1 AS w FROM s JOIN k USING (patient) CROSS JOIN range(5) h(held) WHERE fold <> held), {_CUTS.format(by='cohort, probe, repeat, held')}
SELECT cohort, probe, count(*) AS n_fits, round(min(q95), 6) + 0.0 AS q95_low, round(max(q95), 6) + 0.0 AS q95_high, round(min(mean25), 6) + 0.0 AS mean25_low, round(max(mean25), 6) + 0.0 AS mean25_high FROM c GROUP BY 1, 2"""


def cutoff_bootstrap(spark: SparkSession, d: str) -> DataFrame:
    """Percentile intervals of the cut-offs over 100 draws of patients with Poisson weights."""
    drawn = resampling.poisson_draws(_normal(spark, d), ["cohort", "probe", "beta"], "patient", 100, 59)
    cuts = inference.weighted_cutoffs(drawn, ["cohort", "probe", "draw"], "beta")
    ends = (("low", 0.025), ("high", 0.975))
    out = cuts.groupBy("cohort", "probe").agg(F.count(F.lit(1)).alias("n_draws"), *[F.percentile(c, F.lit(q)).alias(f"{c}_{n}") for c in ("q95", "mean25") for n, q in ends])
    return rounded(out, "q95_low", "q95_high", "mean25_low", "mean25_high")


BOOT = f"""WITH {SPEC}, s AS (SELECT * FROM spec WHERE tissue = 'N' AND beta IS NOT NULL),
h AS (SELECT cohort, probe, beta, draw, CAST('0x' || substr(md5('59|' || (draw // 4) || '|' || patient), 1 + 8 * (draw % 4), 8) AS BIGINT) AS h FROM s CROSS JOIN range(100) r(draw)),
p AS (SELECT cohort, probe, beta, draw, {' + '.join(f'CASE WHEN h >= {c} THEN 1 ELSE 0 END' for c in resampling.POISSON_CUTS)} AS w FROM h), {_CUTS.format(by='cohort, probe, draw')}
SELECT cohort, probe, count(*) AS n_draws, {', '.join(f'round(quantile_cont({c}, {q}), 6) + 0.0 AS {c}_{n}' for c in ('q95', 'mean25') for n, q in (('low', 0.025), ('high', 0.975)))} FROM c GROUP BY 1, 2"""


QUERIES = {
    "cox_brier_grid": (cox_brier_grid, GRID),
    "ipcw_ibs": (ipcw_ibs, IBS),
    "cox_ridge_path": (cox_ridge_path, None),
    "cox_tuned": (cox_tuned, None),
    "cox_proportionality": (cox_proportionality, None),
    "joint_permutation": (joint_permutation, None),
    "recurrence_metrics": (recurrence_metrics, None),
    "cutoff_folds": (cutoff_folds, FOLDS),
    "cutoff_bootstrap": (cutoff_bootstrap, BOOT),
}
