"""Rules per column: results by nation against the same with planted drifts, decisions and masks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators import compare
from ..operators.compare import Rule
from .frames import rounded, table

RULES = {
    "effect": Rule(1e-7, 1e-5, "percentage points", sign=True),
    "se": Rule(1e-7, 1e-5, "percentage points", positive=True),
    "p": Rule(1e-7, 0.0, "probability", cuts=(0.05,), probability=True),
    "tau2": Rule(1e-7, 1e-4, "squared percentage points", zero=True),
}


def _results(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "customer").groupBy(F.col("c_nationkey").alias("nation")).agg(
        F.count(F.lit(1)).alias("k"), F.round(F.avg("c_acctbal") / 1000, 9).alias("effect"), F.round(F.stddev_samp("c_acctbal") / 1000, 9).alias("se"),
        (F.pmod(F.sum("c_custkey"), F.lit(97)) / 970.0).alias("p"),
    )
    return s.withColumn("tau2", F.greatest(F.col("effect") - 4.4, F.lit(0.0)))


def _planted(rows: DataFrame) -> DataFrame:
    """By nation modulo 9: 1 drift within, 2 beyond the unit's floor, 3 p across 0.05, 4 tau2 off zero, 5 a mask, 6 a count, 7 a sign; nation 8 is gone."""
    n = F.col("nation") % 9
    return rows.filter("nation <> 8").select(
        "nation",
        F.when(n == 6, F.col("k") + 1).otherwise(F.col("k")).alias("k"),
        F.when(n == 1, F.col("effect") + 5e-6).when(n == 2, F.col("effect") + 2e-3).when(n == 7, -F.col("effect")).otherwise(F.col("effect")).alias("effect"),
        F.when(n == 5, None).otherwise(F.col("se")).alias("se"),
        F.when(n == 3, F.when(F.col("p") < 0.05, 0.07).otherwise(0.03)).otherwise(F.col("p")).alias("p"),
        F.when((n == 4) & (F.col("tau2") == 0), 1e-10).otherwise(F.col("tau2")).alias("tau2"),
    )


def unit_gates(spark: SparkSession, d: str) -> DataFrame:
    """Every violation of a rule."""
    rows = _results(spark, d)
    return compare.gated(rows, _planted(rows), ["nation"], RULES)[0].select("nation", "column_name", "reason")


def gate_diagnostics(spark: SparkSession, d: str) -> DataFrame:
    rows = _results(spark, d)
    return rounded(compare.gated(rows, _planted(rows), ["nation"], RULES)[1], "largest_absolute", "largest_relative", digits=7)


_BOTH = """a AS (SELECT c_nationkey AS nation, count(*) AS k, round(avg(c_acctbal) / 1000, 9) AS effect, round(stddev_samp(c_acctbal) / 1000, 9) AS se, (sum(c_custkey) % 97) / 970.0 AS p FROM customer GROUP BY 1),
x AS (SELECT *, greatest(effect - 4.4, 0.0) AS tau2, nation % 9 AS n FROM a),
j AS (SELECT *, CASE n WHEN 1 THEN effect + 5e-6 WHEN 2 THEN effect + 2e-3 WHEN 7 THEN -effect ELSE effect END AS effect2, CASE WHEN n <> 5 THEN se END AS se2,
CASE WHEN n = 3 THEN CASE WHEN p < 0.05 THEN 0.07 ELSE 0.03 END ELSE p END AS p2, CASE WHEN n = 4 AND tau2 = 0 THEN 1e-10 ELSE tau2 END AS tau22 FROM x)"""
UNIT_GATES = f"""WITH {_BOTH} SELECT nation, '' AS column_name, 'missing key' AS reason FROM j WHERE nation = 8
UNION ALL SELECT nation, 'k', 'exact label or count mismatch' FROM j WHERE n = 6 UNION ALL SELECT nation, 'effect', 'numerical tolerance exceeded' FROM j WHERE n IN (2, 7) AND effect2 <> effect
UNION ALL SELECT nation, 'effect', 'direction changed' FROM j WHERE nation <> 8 AND sign(effect) <> sign(effect2) UNION ALL SELECT nation, 'se', 'missing-value mask changed' FROM j WHERE n = 5
UNION ALL SELECT nation, 'p', unnest(['numerical tolerance exceeded', 'decision at 0.05 changed']) FROM j WHERE n = 3
UNION ALL SELECT nation, 'tau2', 'zero boundary changed' FROM j WHERE nation <> 8 AND (tau2 = 0) <> (tau22 = 0)"""
DIAGNOSTICS = f"""WITH {_BOTH}, m AS (SELECT 'effect' AS column_name, 'percentage points' AS unit, effect AS x, effect2 AS y, CASE WHEN n = 2 THEN 1 WHEN n = 7 AND effect <> 0 THEN 2 ELSE 0 END AS v FROM j WHERE nation <> 8
UNION ALL SELECT 'se', 'percentage points', se, se2, CASE WHEN n = 5 THEN 1 ELSE 0 END FROM j WHERE nation <> 8 UNION ALL SELECT 'p', 'probability', p, p2, CASE WHEN n = 3 THEN 2 ELSE 0 END FROM j WHERE nation <> 8
UNION ALL SELECT 'tau2', 'squared percentage points', tau2, tau22, CASE WHEN (tau2 = 0) <> (tau22 = 0) THEN 1 ELSE 0 END FROM j WHERE nation <> 8)
SELECT column_name, unit, count(abs(x - y)) AS n, round(max(abs(x - y)), 7) + 0.0 AS largest_absolute, round(max(CASE WHEN x <> 0 THEN abs(x - y) / abs(x) END), 7) + 0.0 AS largest_relative,
count(*) FILTER (x = 0 AND y <> 0) AS left_zero, CAST(sum(v) AS BIGINT) AS violations FROM m GROUP BY 1, 2"""

QUERIES = {
    "unit_gates": (unit_gates, UNIT_GATES),
    "gate_diagnostics": (gate_diagnostics, DIAGNOSTICS),
}
