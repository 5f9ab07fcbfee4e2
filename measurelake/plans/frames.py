"""The driver tables read as measurements, and the same views as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import scalar
from ..operators import relational

#: event type to tissue code; other types are no specimens.
TISSUE = {"purchase": "T", "view": "N", "signup": "H", "click": "A"}
SCALE = 500.0
#: Planned probes: one more than the data can have, so that a planned row stays without estimate.
PROBES = 7

SPEC = """spec AS (
  SELECT user_id % 5 AS cohort, user_id AS patient,
         CASE event_type WHEN 'purchase' THEN 'T' WHEN 'view' THEN 'N' WHEN 'signup' THEN 'H' WHEN 'click' THEN 'A' END AS tissue,
         CAST(hour(ts) // 4 AS INTEGER) AS probe,
         round(avg(CASE WHEN value / 500.0 BETWEEN 0 AND 1 THEN value / 500.0 END), 12) AS beta,
         count(CASE WHEN value / 500.0 BETWEEN 0 AND 1 THEN 1 END) AS n_replicates
  FROM events WHERE event_type IN ('purchase', 'view', 'signup', 'click') GROUP BY ALL)"""
DELTA = """delta AS (
  SELECT t.cohort, t.patient, t.probe, t.beta AS hi, n.beta AS lo, t.beta - n.beta AS delta
  FROM spec t JOIN spec n ON t.cohort = n.cohort AND t.patient = n.patient AND t.probe = n.probe
  WHERE t.tissue = 'T' AND n.tissue = 'N' AND t.beta IS NOT NULL AND n.beta IS NOT NULL)"""
SURV = """surv AS (
  SELECT l_linenumber % 4 AS fold, CAST(ceil(d / 30.0) AS INTEGER) AS t, CAST(l_returnflag = 'R' AS INTEGER) AS event,
         CAST(floor(l_quantity / 5) AS INTEGER) AS score, count(*) AS n
  FROM (SELECT *, datediff('day', o_orderdate, l_shipdate) AS d FROM lineitem JOIN orders ON l_orderkey = o_orderkey)
  WHERE d > 0 GROUP BY ALL)"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def raw_specimens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per event of a specimen type, measured value masked to [0, 1]."""
    events = table(spark, sf_dir, "events").filter(F.col("event_type").isin(*TISSUE))
    kinds = F.create_map(*[F.lit(x) for pair in TISSUE.items() for x in pair])
    masked = scalar.out_of_range(F.col("value") / SCALE, tolerance=1e9)["value"]
    return events.select(
        (F.col("user_id") % 5).alias("cohort"),
        F.col("user_id").alias("patient"),
        kinds[F.col("event_type")].alias("tissue"),
        F.floor(F.hour("ts") / 4).cast("int").alias("probe"),
        masked.alias("beta"),
    )


def specimens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replicates collapsed: one row per cohort, patient, tissue and probe.

    Means are rounded to 12 digits: equal ones tie in ranks, whatever the order of their sums.
    """
    rows = relational.collapse_replicates(raw_specimens(spark, sf_dir), ["cohort", "patient", "tissue", "probe"], "beta")
    return rows.withColumn("beta", F.round("beta", 12))


def deltas(spark: SparkSession, sf_dir: str, high: str = "T", low: str = "N") -> DataFrame:
    """cohort, patient, probe, high, low and delta of every verified pair."""
    return relational.paired_differences(
        specimens(spark, sf_dir), ["cohort", "patient", "probe"], "tissue", "beta", high, low
    )


def survival(spark: SparkSession, sf_dir: str) -> DataFrame:
    """fold, t (months of 30 days), event, score and n, the number of lines: a table bounded by the levels."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_shipdate", "l_returnflag", "l_quantity")
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderdate")
    days = F.datediff("l_shipdate", "o_orderdate")
    frame = lines.join(orders, "l_orderkey").withColumn("d", days).filter("d > 0")
    return frame.groupBy(
        (F.col("l_linenumber") % 4).alias("fold"),
        F.ceil(F.col("d") / 30.0).cast("int").alias("t"),
        (F.col("l_returnflag") == "R").cast("int").alias("event"),
        F.floor(F.col("l_quantity") / 5).cast("int").alias("score"),
    ).agg(F.count(F.lit(1)).alias("n"))


def rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    """Doubles rounded, with negative zero made zero."""
    return df.withColumns({c: F.round(F.col(c), digits) + F.lit(0.0) for c in columns})
