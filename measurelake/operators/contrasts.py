"""The contrast engine: planned contrasts dispatched to a paired, clustered or Welch estimate, with p-values."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.tails import normal_two_sided, t_two_sided
from .ranking import bh_adjust

PAIRED, CLUSTERED, UNPAIRED = "paired_t", "patient_cluster_OLS", "Welch_t"


def _arms(rows: DataFrame, keys: list[str], unit: str, arm: str, contrasts) -> DataFrame:
    """keys, unit, high, low, a and b: the unit's value in either arm of every contrast it has part in."""
    plan = F.array(*[F.struct(F.lit(h).alias("high"), F.lit(low).alias("low")) for h, low in contrasts])
    mine = F.filter(plan, lambda c: (c["high"] == F.col(arm)) | (c["low"] == F.col(arm)))
    each = rows.select(*keys, unit, arm, "value", F.explode(mine).alias("c")).select(*keys, unit, arm, "value", "c.*")
    pick = lambda side: F.max(F.when(F.col(arm) == F.col(side), F.col("value")))
    return each.groupBy(*keys, unit, "high", "low").agg(pick("high").alias("a"), pick("low").alias("b"))


def contrast_rows(
    rows: DataFrame, planned: DataFrame, contrasts: list[tuple[str, str]], study: str, unit: str, arm: str, probe: str, value: str,
    paired: tuple[str, str] = ("T", "N"), scale: float = 100.0, min_n: int = 3,
) -> DataFrame:
    """One row per planned study, contrast and probe: method, status, estimate, p and q.

    ``rows`` has one value per study, unit, arm and probe.  The method belongs to
    the study's contrast: paired for the contrast ``paired`` with ``min_n`` shared
    units or more; otherwise, by probe, least squares with errors clustered by
    unit where units are in both arms, and Welch where none is.  All three are
    closed forms of sums that one aggregation over units yields.  q is by
    Benjamini-Hochberg over the planned rows of a contrast, all studies pooled;
    what has no estimate counts as p = 1.
    """
    used = rows.filter(F.col(value).isNotNull()).withColumnRenamed(value, "value")
    units = _arms(used, [study, probe], unit, arm, contrasts)
    both = F.col("a").isNotNull() & F.col("b").isNotNull()
    shared = _arms(used.withColumn("value", F.lit(1.0)), [study], unit, arm, contrasts)
    shared = shared.groupBy(study, "high", "low").agg(F.count_if(both).alias("n_both"))
    delta = F.when(both, F.col("a") - F.col("b"))
    s = units.groupBy(study, probe, "high", "low").agg(
        F.count("a").alias("na"), F.count("b").alias("nb"), F.count(delta).alias("k"), F.count(F.lit(1)).alias("n_units"),
        F.avg("a").alias("ma"), F.avg("b").alias("mb"), F.var_samp("a").alias("va"), F.var_samp("b").alias("vb"),
        F.avg(delta).alias("md"), F.stddev_samp(delta).alias("sd"), F.sum(F.when(both, F.col("a") * F.col("b"))).alias("ab"),
        F.sum(F.when(both, F.col("a"))).alias("sa"), F.sum(F.when(both, F.col("b"))).alias("sb"),
    )
    joined = planned.join(shared, [study, "high", "low"], "left").join(s, [study, probe, "high", "low"], "left")
    c = F.col
    is_paired = (c("high") == paired[0]) & (c("low") == paired[1]) & (F.coalesce("n_both", F.lit(0)) >= min_n)
    overlap = F.coalesce("k", F.lit(0)) > 0
    method = F.when(is_paired, PAIRED).when(overlap, CLUSTERED).otherwise(UNPAIRED)
    enough = F.when(is_paired, c("k") >= min_n).otherwise(F.least("na", "nb") >= min_n)
    status = F.when(c("n_units").isNull(), "probe_absent").when(enough, "estimated").otherwise("insufficient_data")
    out = joined.withColumn("method", method).withColumn("status", status)
    ok, by_pairs, clustered = c("status") == "estimated", c("method") == PAIRED, c("method") == CLUSTERED
    xa, xb = c("va") / c("na"), c("vb") / c("nb")
    # Scores of a unit in both arms multiply: their sum of products about the arms' means.
    cross = c("ab") - c("ma") * c("sb") - c("mb") * c("sa") + c("k") * c("ma") * c("mb")
    score = (c("na") - 1) * xa / c("na") + (c("nb") - 1) * xb / c("nb") - 2 * cross / (c("na") * c("nb"))
    n = c("na") + c("nb")
    robust = F.sqrt(F.greatest(score, F.lit(0.0)) * c("n_units") / (c("n_units") - 1) * (n - 1) / (n - 2))
    se = F.when(by_pairs, c("sd") / F.sqrt("k")).when(clustered, robust).otherwise(F.sqrt(xa + xb))
    welch = F.try_divide((xa + xb) * (xa + xb), xa * xa / (c("na") - 1) + xb * xb / (c("nb") - 1))
    out = out.withColumn("estimate", F.when(ok, F.when(by_pairs, c("md")).otherwise(c("ma") - c("mb")))).withColumn("se", F.when(ok, se))
    out = out.withColumn("statistic", F.when(c("se") > 0, c("estimate") / c("se")))
    out = out.withColumn("df", F.when(ok & by_pairs, (c("k") - 1).cast("double")).when(ok & ~clustered, welch))
    p = F.when(clustered, normal_two_sided(c("statistic"))).otherwise(t_two_sided(c("statistic"), c("df")))
    out = out.withColumn("p", p).withColumn("p_for_bh", F.coalesce("p", F.lit(1.0)))
    out = bh_adjust(out, "p_for_bh", ["high", "low"], "q")
    count = lambda x: F.coalesce(F.when(by_pairs, c("k")).otherwise(c(x)), F.lit(0))
    return out.select(
        study, "high", "low", probe, "method", "status", count("na").alias("n_high"), count("nb").alias("n_low"), F.coalesce("k", F.lit(0)).alias("n_shared"),
        (c("estimate") * scale).alias("estimate"), (c("se") * scale).alias("se"), "statistic", "df", "p", "p_for_bh", "q",
    )
