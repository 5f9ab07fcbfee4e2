"""Contrasts and rank tests whose statistics are plain aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.tails import t_two_sided
from . import ranking
from .ranking import counted_ranks


def paired_effects(deltas: DataFrame, by: list[str], value: str = "delta", scale: float = 100.0, min_n: int = 3) -> DataFrame:
    """n, mean, sd, se, t, df, p and signs of paired differences; null statistics below ``min_n`` pairs.

    All-zero differences have p = 1; a constant other difference has p = 0.
    """
    x = F.col(value) * scale
    s = deltas.groupBy(*by).agg(
        F.count(value).alias("n"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("sd"), F.median(x).alias("median"),
        F.count_if(x > 0).alias("n_pos"), F.count_if(x < 0).alias("n_neg"),
    )
    ok = F.col("n") >= min_n
    se = F.when(ok, F.col("sd") / F.sqrt("n"))
    t = F.when(F.col("sd") > 0, F.col("mean") / (F.col("sd") / F.sqrt("n")))
    p = F.when(F.col("sd") > 0, t_two_sided(t, F.col("n") - 1)).when(F.col("mean") == 0, 1.0).otherwise(0.0)
    return s.select(*by, "n", "mean", "sd", "median", "n_pos", "n_neg", se.alias("se"), F.when(ok, t).alias("t"), F.when(ok, p).alias("p"))


def welch(df: DataFrame, by: list[str], arm: str, value: str, high: str, low: str) -> DataFrame:
    """Unpaired difference of means with Welch's standard error and degrees of freedom."""
    pick = lambda level: F.when(F.col(arm) == level, F.col(value))
    s = df.filter(F.col(arm).isin(high, low)).groupBy(*by).agg(
        F.count(pick(high)).alias("n_high"), F.count(pick(low)).alias("n_low"), F.avg(pick(high)).alias("m1"), F.avg(pick(low)).alias("m0"),
        F.var_samp(pick(high)).alias("v1"), F.var_samp(pick(low)).alias("v0"),
    )
    a, b = F.col("v1") / F.col("n_high"), F.col("v0") / F.col("n_low")
    out = s.withColumn("diff", F.col("m1") - F.col("m0")).withColumn("se", F.sqrt(a + b))
    dof = (a + b) * (a + b) / (a * a / (F.col("n_high") - 1) + b * b / (F.col("n_low") - 1))
    return out.select(*by, "n_high", "n_low", "diff", "se", F.try_divide("diff", "se").alias("t"), dof.alias("df"))


def _ties(n: str = "n") -> Column:
    """Sum over levels of n^3 - n, in doubles: counts of huge groups have no whole cubes."""
    c = F.col(n).cast("double")
    return F.sum(c * c * c - c)


def mann_whitney(df: DataFrame, by: list[str], arm: str, value: str, high: str, low: str) -> DataFrame:
    """U of ``high``, rank-biserial correlation and the tie-corrected normal z, from counted values."""
    two = df.filter(F.col(arm).isin(high, low) & F.col(value).isNotNull())
    levels = counted_ranks(two, by, value, {"__h": (F.col(arm) == high).cast("int")})
    out = levels.groupBy(*by).agg(F.sum("__h").alias("n_high"), F.sum(F.col("n") - F.col("__h")).alias("n_low"), F.sum(F.col("__h") * F.col("rank")).alias("__w"), _ties().alias("__t"))
    n1, n0 = F.col("n_high").cast("double"), F.col("n_low").cast("double")
    n = n1 + n0
    # Without any of the high arm there is no rank sum.
    u = F.when(n1 > 0, F.col("__w")) - n1 * (n1 + 1) / 2
    spread = F.sqrt(n1 * n0 / 12 * ((n + 1) - F.try_divide(F.col("__t"), n * (n - 1))))
    return out.select(*by, "n_high", "n_low", u.alias("u"), (F.try_divide(2 * u, n1 * n0) - 1).alias("rank_biserial"), F.try_divide(u - n1 * n0 / 2, spread).alias("z"))


def kruskal(df: DataFrame, by: list[str], arm: str, value: str, min_n: int = 5) -> DataFrame:
    """H with tie correction and epsilon squared, from counted values; arms below ``min_n`` values are left out."""
    cells = df.filter(F.col(value).isNotNull()).groupBy(*by, arm, value).agg(F.count(F.lit(1)).alias("__c"))
    large = cells.groupBy(*by, arm).agg(F.sum("__c").alias("__a")).filter(F.col("__a") >= min_n).drop("__a")
    cells = ranking.matched(cells, large, [*by, arm])
    levels = cells.groupBy(*by, value).agg(F.sum("__c").alias("n"))
    levels = ranking.cumulated(levels, by, value, ["n"]).withColumn("rank", F.col("n__below") + (F.col("n") + 1) / 2.0)
    ranked = ranking.matched(cells, levels.select(*by, value, "rank"), [*by, value])
    arms = ranked.groupBy(*by, arm).agg(F.sum(F.col("__c") * F.col("rank")).alias("s"), F.sum("__c").alias("n"))
    h = arms.groupBy(*by).agg(F.sum(F.col("s") * F.col("s") / F.col("n")).alias("q"), F.sum("n").alias("n"), F.count(F.lit(1)).alias("k"))
    ties = levels.groupBy(*by).agg(_ties().alias("__t"))
    n = F.col("n").cast("double")
    raw = 12 / (n * (n + 1)) * F.col("q") - 3 * (n + 1)
    stat = F.try_divide(raw, 1 - F.col("__t") / (n * n * n - n))
    return ranking.matched(h, ties, by).select(*by, "n", "k", stat.alias("h"), F.try_divide(stat - F.col("k") + 1, n - F.col("k")).alias("epsilon2"))


def wilcoxon(deltas: DataFrame, by: list[str], value: str = "delta") -> DataFrame:
    """Signed-rank sums of the non-zero differences and the tie-corrected normal z, from counted sizes."""
    used = deltas.filter(F.col(value) != 0).withColumn("__a", F.abs(F.col(value)))
    levels = counted_ranks(used, by, "__a", {"__p": (F.col(value) > 0).cast("int")})
    s = levels.groupBy(*by).agg(
        F.sum("n").alias("n"), F.sum(F.col("__p") * F.col("rank")).alias("w_pos"), F.sum((F.col("n") - F.col("__p")) * F.col("rank")).alias("w_neg"), _ties().alias("__t")
    )
    n = F.col("n").cast("double")
    spread = F.sqrt(n * (n + 1) * (2 * n + 1) / 24 - F.col("__t") / 48)
    low = F.least("w_pos", "w_neg")
    return s.select(*by, "n", "w_pos", "w_neg", F.try_divide(low - n * (n + 1) / 4, spread).alias("z"))


def auc(df: DataFrame, by: list[str], label: str, score: str, weight: str | None = None) -> DataFrame:
    """Area under the curve by mid-ranks of counted score levels; ties count half, a row ``weight`` times.

    Rows are reduced to their distinct scores before anything is ordered.
    """
    number = lambda y: F.count_if(F.col(label) == y) if weight is None else F.sum(F.when(F.col(label) == y, F.col(weight)).otherwise(0))
    levels = df.filter(F.col(score).isNotNull() & F.col(label).isin(0, 1)).groupBy(*by, F.col(score).alias("__s")).agg(
        number(1).alias("__p"), number(0).alias("__n")
    )
    counted = ranking.cumulated(levels, by, "__s", ["__n"]).withColumn("__b", F.col("__n__below"))
    out = counted.groupBy(*by).agg(
        F.sum("__p").alias("n_pos"), F.sum("__n").alias("n_neg"), F.sum(F.col("__p") * (F.col("__b") + F.col("__n") / 2.0)).alias("__u")
    )
    return out.select(*by, "n_pos", "n_neg", F.try_divide(F.col("__u"), F.col("n_pos") * F.col("n_neg")).alias("auc"))


def confusion(df: DataFrame, by: list[str], label: str, predicted: Column, probability: Column | None = None) -> DataFrame:
    """Counts, sensitivity, specificity, balanced accuracy and (given probabilities) the Brier score."""
    y = F.col(label)
    s = df.groupBy(*by).agg(
        F.count_if((y == 1) & predicted).alias("tp"), F.count_if((y == 0) & predicted).alias("fp"),
        F.count_if((y == 0) & ~predicted).alias("tn"), F.count_if((y == 1) & ~predicted).alias("fn"),
        (F.avg((probability - y) * (probability - y)) if probability is not None else F.lit(None).cast("double")).alias("brier"),
    )
    sens, spec = F.try_divide("tp", F.col("tp") + F.col("fn")), F.try_divide("tn", F.col("tn") + F.col("fp"))
    return s.select(*by, "tp", "fp", "tn", "fn", sens.alias("sensitivity"), spec.alias("specificity"), ((sens + spec) / 2).alias("balanced_accuracy"), "brier")


def youden(df: DataFrame, by: list[str], label: str, score: str) -> DataFrame:
    """The cut with the largest sensitivity + specificity - 1; of equal ones the largest."""
    levels = df.filter(F.col(score).isNotNull()).groupBy(*by, F.col(score).alias("cut")).agg(
        F.count_if(F.col(label) == 1).alias("__p"), F.count_if(F.col(label) == 0).alias("__n")
    )
    run = ranking.cumulated(levels, by, "cut", ["__p", "__n"])
    above = lambda c: (F.col(f"{c}__total") - F.col(f"{c}__below")) / F.col(f"{c}__total")
    scored = run.withColumn("j", F.round(above("__p") - above("__n"), 12))
    return scored.groupBy(*by).agg(F.max_by("cut", F.struct("j", "cut")).alias("cut"), F.max("j").alias("j"))


def cutoff_rules(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """Normal-sample cut-offs: higher order statistics at .95 and .975, multiples of the mean, mean + 4 sd."""
    kept = df.filter(F.col(value).isNotNull())
    place = lambda q: F.ceil((F.col("n__total") - 1) * F.lit(q) - 1e-9)
    cuts = ranking.order_statistic(kept, by, value, {"q95": place(0.95), "q975": place(0.975)})
    means = kept.groupBy(*by).agg(
        (2.5 * F.avg(value)).alias("mean25"), (3.0 * F.avg(value)).alias("mean3"), (F.avg(value) + 4 * F.stddev_samp(value)).alias("mean4sd"),
    )
    return ranking.matched(cuts, means, by)


def cutoff_leave_one_out(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """Smallest and largest .95 order statistic and 2.5-fold mean with each single row left out.

    Without a row at or below place r of the others, the statistic is the next
    value, without a later one it is the r-th itself: two order statistics and
    the extremes tell all, and no row meets another.
    """
    kept = df.filter(F.col(value).isNotNull())
    place = F.ceil((F.col("n__total") - 2) * F.lit(0.95) - 1e-9)
    cuts = ranking.order_statistic(kept, by, value, {"q95_low": place, "q95_high": place + 1}).filter("n > 1").withColumnRenamed("n", "n_left_out")
    sums = kept.groupBy(*by).agg(F.sum(value).alias("__s"), F.min(value).alias("__a"), F.max(value).alias("__b"))
    s = ranking.matched(cuts, sums, by)
    rest = lambda c: 2.5 * (F.col("__s") - F.col(c)) / (F.col("n_left_out") - 1)
    return s.select(*by, "n_left_out", "q95_low", "q95_high", rest("__b").alias("mean25_low"), rest("__a").alias("mean25_high"))


def weighted_cutoffs(drawn: DataFrame, by: list[str], value: str, weight: str = "weight") -> DataFrame:
    """The 95 % order statistic (higher) and 2.5 times the mean of rows that count ``weight`` times."""
    kept = drawn.filter(F.col(weight) > 0)
    levels = kept.groupBy(*by, value).agg(F.sum(weight).alias("__w"))
    placed = ranking.cumulated(levels, by, value, ["__w"])
    reached = F.col("__w__below") + F.col("__w") >= F.ceil((F.col("__w__total") - 1) * F.lit(0.95) - 1e-9) + 1
    mean = F.sum(F.col("__w") * F.col(value)) / F.sum("__w")
    return placed.groupBy(*by).agg(F.min(F.when(reached, F.col(value))).alias("q95"), (2.5 * mean).alias("mean25"))


def fixed_effect_meta(effects: DataFrame, by: list[str], effect: str = "mean", se: str = "se", min_k: int = 3) -> DataFrame:
    """Inverse-variance pooled effect with Q and I squared; null below ``min_k`` studies."""
    w = 1 / (F.col(se) * F.col(se))
    used = effects.filter((F.col(se) > 0) & F.col(effect).isNotNull())
    s = used.groupBy(*by).agg(F.count(F.lit(1)).alias("k"), F.sum(w).alias("w"), F.sum(w * F.col(effect)).alias("wx"), F.sum(w * F.col(effect) * F.col(effect)).alias("wxx"))
    mean = F.col("wx") / F.col("w")
    q = F.greatest(F.col("wxx") - F.col("wx") * F.col("wx") / F.col("w"), F.lit(0.0))
    ok = F.col("k") >= min_k
    i2 = F.when(q > 0, F.greatest(F.lit(0.0), (q - (F.col("k") - 1)) / q * 100)).otherwise(0.0)
    return s.select(*by, "k", F.when(ok, mean).alias("fixed_effect"), F.when(ok, 1 / F.sqrt("w")).alias("fixed_se"), F.when(ok, q).alias("q"), F.when(ok, i2).alias("i2"))
