"""Censored-survival estimators over counts per (by, time, event, score).

Rows carry a count ``n``, so any number of subjects is first reduced to the
distinct levels; pair statistics join those levels within ``by`` and never the
subjects themselves.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .concordance import dominated
from .ranking import cumulated, matched

FLOOR = 0.1


def kaplan_meier(df: DataFrame, by: list[str], time: str = "t", event: str = "event", n: str = "n", of: int = 1) -> DataFrame:
    """n_risk, n_event, survival at and just before each time; ``of=0`` estimates the censoring curve."""
    steps = df.groupBy(*by, F.col(time).alias("t")).agg(
        F.sum(n).alias("__leave"), F.sum(F.when(F.col(event) == of, F.col(n)).otherwise(0)).alias("n_event")
    )
    down = Window.partitionBy(*by).orderBy(F.col("t").desc()).rowsBetween(Window.unboundedPreceding, 0)
    up = Window.partitionBy(*by).orderBy("t").rowsBetween(Window.unboundedPreceding, 0)
    risk = steps.withColumn("n_risk", F.sum("__leave").over(down))
    share = 1 - F.col("n_event") / F.col("n_risk")
    # A running product by logarithms; a factor of zero ends the curve at zero.
    logs = F.sum(F.when(share > 0, F.log(share)).otherwise(0.0)).over(up)
    ended = F.max((F.col("n_event") == F.col("n_risk")).cast("int")).over(up)
    curve = risk.withColumn("surv", F.when(ended == 1, 0.0).otherwise(F.exp(logs)))
    before = F.coalesce(F.lag("surv").over(Window.partitionBy(*by).orderBy("t")), F.lit(1.0))
    return curve.select(*by, "t", "n_risk", "n_event", "surv", before.alias("surv_before"))


def breslow(df: DataFrame, by: list[str], risk: Column, time: str = "t", event: str = "event", n: str = "n") -> DataFrame:
    """Baseline hazard and cumulative hazard at each event time; ``risk`` is exp(linear predictor)."""
    steps = df.groupBy(*by, F.col(time).alias("t")).agg(
        F.sum(F.col(n) * risk).alias("__r"), F.sum(F.when(F.col(event) == 1, F.col(n)).otherwise(0)).alias("n_event")
    )
    down = Window.partitionBy(*by).orderBy(F.col("t").desc()).rowsBetween(Window.unboundedPreceding, 0)
    up = Window.partitionBy(*by).orderBy("t").rowsBetween(Window.unboundedPreceding, 0)
    at = steps.withColumn("hazard", F.col("n_event") / F.sum("__r").over(down))
    return at.withColumn("cumhaz", F.sum("hazard").over(up)).filter("n_event > 0").select(*by, "t", "n_event", "hazard", "cumhaz")


def _with_censoring(df: DataFrame, by: list[str]) -> DataFrame:
    curve = kaplan_meier(df, by, of=0).select(*by, "t", F.col("surv").alias("g"), F.col("surv_before").alias("g_before"))
    return df.join(curve, [*by, "t"])


def concordance(df: DataFrame, by: list[str], ipcw: bool, horizon: float | None = None, floor: float = FLOOR) -> DataFrame:
    """Harrell's C, or Uno's with ``ipcw``: per ``by`` numerator, denominator and their ratio.

    A pair counts if the earlier one is an event and the times differ; the
    higher score should fail first, ties count half (`concordance.dominated`).  With ``ipcw`` an event
    whose censoring weight is at or below ``floor`` makes the result null.
    """
    # Read by every sum below; the subjects behind the levels are scanned once.
    levels = df.groupBy(*by, "t", "event", "score").agg(F.sum("n").alias("n")).persist()
    early = _with_censoring(levels, by).filter("event = 1")
    if horizon is not None:
        early = early.filter(F.col("t") < horizon)
    weight = 1 / (F.col("g_before") * F.col("g_before")) if ipcw else F.lit(1.0)
    bad = (F.col("g_before") <= floor) if ipcw else F.lit(False)
    # Early rows fail, late ones are outlived; no pair is formed, so continuous scores cost no more than their digits.
    early = early.select(*by, "t", "score", (F.col("n") * weight).cast("double").alias("w"), F.lit(0).cast("long").alias("m"), bad.alias("bad"))
    late = levels.select(*by, "t", "score", F.lit(0.0).alias("w"), F.col("n").alias("m"), F.lit(None).cast("boolean").alias("bad"))
    both = early.unionByName(late).groupBy(*by, "t", "score").agg(F.sum("w").alias("w"), F.sum("m").alias("m"), F.max("bad").alias("bad"))
    won = dominated(both.withColumn("lower", -F.col("score")), by, "t", "lower", "w", "m")
    outlived = lambda keys: cumulated(both.groupBy(*keys, "t").agg(F.sum("w").alias("w"), F.sum("m").alias("m")), keys, "t", ["w"])
    tied = outlived([*by, "score"]).groupBy(*by).agg(F.sum(F.col("m") * F.col("w__below")).alias("tied"))
    whole = outlived(by).groupBy(*by).agg(F.sum(F.col("m") * F.col("w__below")).alias("denominator"))
    # An event without anyone who outlives it is in no pair, whatever its weight.
    last = both.filter("m > 0").groupBy(*by).agg(F.max("t").alias("last"))
    worst = matched(both, last, by).filter("t < last").groupBy(*by).agg(F.coalesce(F.max("bad"), F.lit(False)).alias("bad"))
    out = matched(matched(matched(whole, won, by), tied, by), worst, by).filter("denominator > 0")
    out = out.withColumn("numerator", F.col("pairs") + F.col("tied") / 2)
    c = F.when(~F.col("bad"), F.col("numerator") / F.col("denominator"))
    return out.select(*by, F.when(~F.col("bad"), F.col("numerator")).alias("numerator"), F.when(~F.col("bad"), F.col("denominator")).alias("denominator"), c.alias("c_index"))


def time_auc(df: DataFrame, by: list[str], horizon: float, floor: float = FLOOR) -> DataFrame:
    """Cumulative/dynamic AUC at a horizon with inverse censoring weights for the cases."""
    levels = df.groupBy(*by, "t", "event", "score").agg(F.sum("n").alias("n"))
    marked = _with_censoring(levels, by)
    cases = marked.filter((F.col("event") == 1) & (F.col("t") <= horizon)).groupBy(*by, F.col("score").alias("s1")).agg(
        F.sum(F.col("n") / F.col("g_before")).alias("w"), F.min("g_before").alias("least")
    )
    controls = levels.filter(F.col("t") > horizon).groupBy(*by, F.col("score").alias("s2")).agg(F.sum("n").alias("m"))
    won = F.when(F.col("s1") > F.col("s2"), 1.0).when(F.col("s1") == F.col("s2"), 0.5).otherwise(0.0)
    out = cases.join(controls, by).groupBy(*by).agg(
        (F.sum(F.col("w") * F.col("m") * won) / F.sum(F.col("w") * F.col("m"))).alias("auc"), F.min("least").alias("least")
    )
    return out.select(*by, F.when(F.col("least") > floor, F.col("auc")).alias("auc"))


def ipcw_brier(df: DataFrame, by: list[str], risk: Column, horizon: float, floor: float = FLOOR) -> DataFrame:
    """Brier score at a horizon: weighted squared errors over the original number of rows."""
    levels = df.groupBy(*by, "t", "event", "score").agg(F.sum("n").alias("n"))
    marked = _with_censoring(levels, by)
    at = kaplan_meier(levels, by, of=0).filter(F.col("t") <= horizon).groupBy(*by).agg(F.min("surv").alias("g_h"))
    joined = marked.join(at, by, "left").withColumn("g_h", F.coalesce("g_h", F.lit(1.0)))
    term = (
        F.when((F.col("event") == 1) & (F.col("t") <= horizon), F.col("n") * (1 - risk) * (1 - risk) / F.col("g_before"))
        .when(F.col("t") > horizon, F.col("n") * risk * risk / F.col("g_h"))
        .otherwise(0.0)
    )
    used = F.least(F.when((F.col("event") == 1) & (F.col("t") <= horizon), F.col("g_before")).otherwise(1.0), F.when(F.col("t") > horizon, F.col("g_h")).otherwise(1.0))
    out = joined.groupBy(*by).agg((F.sum(term) / F.sum("n")).alias("brier"), F.min(used).alias("least"))
    return out.select(*by, F.when(F.col("least") > floor, F.col("brier")).alias("brier"))


def horizon_support(df: DataFrame, by: list[str], horizons: list[int]) -> DataFrame:
    """Events by, and rows still at risk after, each horizon."""
    at = F.explode(F.array(*map(F.lit, horizons))).alias("horizon")
    rows = df.select(*by, "t", "event", "n", at)
    return rows.groupBy(*by, "horizon").agg(
        F.sum(F.when((F.col("event") == 1) & (F.col("t") <= F.col("horizon")), F.col("n")).otherwise(0)).alias("n_events"),
        F.sum(F.when(F.col("t") > F.col("horizon"), F.col("n")).otherwise(0)).alias("n_at_risk"),
        F.sum(F.when((F.col("event") == 0) & (F.col("t") <= F.col("horizon")), F.col("n")).otherwise(0)).alias("n_censored"),
    )


def curve_quantile(curve: DataFrame, by: list[str], q: float, out: str) -> DataFrame:
    """First time at which the curve is at or below 1 - q; null if it never is."""
    return curve.groupBy(*by).agg(F.min(F.when(F.col("surv") <= 1 - q + 1e-12, F.col("t"))).alias(out))
