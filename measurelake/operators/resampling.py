"""Resampling with draws from a counter-based generator: the same in every engine and order.

Draw tables hold multiplicities per unit, so data are joined once per draw and
unit and never copied per observation drawn.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.scalar import counter_random
from .ranking import cumulated


#: Rows of drawn units that one task counts.
DRAWN_ROWS = 2_000_000


def bootstrap_weights(units: DataFrame, by: list[str], unit: str, draws: int, seed: int) -> DataFrame:
    """by, draw, unit and weight: how often each unit is drawn, in ``draws`` samples of the units' number.

    ``units`` has one row per by and unit, whose further columns come along; units are numbered in their order,
    by prefix counts.  Draws are shuffled once, to as many tasks as their number asks for, and counted
    and given their units where they arrive.
    """
    numbered = cumulated(units.withColumn("__one", F.lit(1)), by, unit, ["__one"])
    numbered = numbered.withColumn("__i", F.col("__one__below").cast("long")).withColumn("__n", F.col("__one__total"))
    spark = units.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(units.count() * draws / DRAWN_ROWS))
    # Numbering may leave a group in one task; draws are made in all.
    dealt = numbered.select(*by, "__i", "__n").repartition(parts, *by, "__i")
    drawn = dealt.withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))))
    drawn = drawn.withColumn("__j", F.pmod(counter_random(seed, "draw", *by, "__i"), F.col("__n")))
    at = drawn.select(*by, "draw", F.col("__j").alias("__i")).repartition(parts, *by, "__i")
    picked = at.groupBy(*by, "draw", "__i").agg(F.count(F.lit(1)).alias("weight"))
    rest = [c for c in units.columns if c not in (*by, unit)]
    return picked.join(numbered.select(*by, "__i", unit, *rest), [*by, "__i"]).select(*by, "draw", unit, "weight", *rest)


def bootstrap_mean(values: DataFrame, by: list[str], unit: str, value: str, draws: int, seed: int, level: float = 0.95) -> DataFrame:
    """Percentile interval of the mean over whole units."""
    units = values.groupBy(*by, unit).agg(F.sum(value).alias("__s"), F.count(F.lit(1)).alias("__c"))
    weights = bootstrap_weights(units, by, unit, draws, seed)
    means = weights.groupBy(*by, "draw").agg((F.sum(F.col("weight") * F.col("__s")) / F.sum(F.col("weight") * F.col("__c"))).alias("m"))
    tail = (1 - level) / 2
    return means.groupBy(*by).agg(
        F.count("m").alias("n_draws"), F.percentile("m", F.lit(tail)).alias("low"), F.percentile("m", F.lit(1 - tail)).alias("high")
    )


#: Places of the Poisson(1) distribution function on the scale of a 32-bit hash: a unit counts once for each it reaches.
POISSON_CUTS = [
    math.ceil(2**32 * math.exp(-1) * sum(1 / math.factorial(j) for j in range(k + 1))) for k in range(12)
]


def poisson_draws(rows: DataFrame, keep: list[str], unit: str, draws: int, seed: int) -> DataFrame:
    """``keep``, draw and weight: each row once per draw with its unit's Poisson(1) weight, from a hash of draw and unit."""
    blocks = rows.select(*keep, F.col(unit).cast("string").alias("__u"), F.explode(F.sequence(F.lit(0), F.lit((draws - 1) // 4))).alias("__b"))
    # One md5 serves four draws: eight hexadecimal digits each.
    hashed = blocks.withColumn("__m", F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("__b").cast("string"), "__u").cast("binary")))
    parts = hashed.select(*keep, "__b", "__m", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("__k"))
    h = F.conv(F.substring("__m", F.col("__k") * 8 + 1, F.lit(8)), 16, 10).cast("long")
    parts = parts.select(*keep, (F.col("__b") * 4 + F.col("__k")).alias("draw"), h.alias("__h")).filter(F.col("draw") < draws)
    weight = sum((F.when(F.col("__h") >= F.lit(c), 1).otherwise(0) for c in POISSON_CUTS), F.lit(0))
    # No filter on the weight: pushed down, it would repeat the hash for every cut.
    return parts.select(*keep, "draw", weight.alias("weight"))


def poisson_digests(unit: Column, draws: int, seed: int) -> Column:
    """The hashes behind ``poisson_draws`` of one unit, four bytes a draw, as one binary value."""
    hashes = F.transform(F.sequence(F.lit(0), F.lit((draws - 1) // 4)), lambda b: F.md5(F.concat_ws("|", F.lit(str(seed)), b.cast("string"), unit.cast("string")).cast("binary")))
    return F.unhex(F.array_join(hashes, ""))


def poisson_weights(digests: list[bytes], draws: int) -> np.ndarray:
    """Weights (units by draws) from ``poisson_digests``."""
    h = np.frombuffer(b"".join(digests), ">u4").reshape(len(digests), -1)[:, :draws]
    return np.searchsorted(np.array(POISSON_CUTS), h.astype(np.int64), "right").astype(np.uint8)


def poisson_mean(values: DataFrame, by: list[str], unit: str, value: str, draws: int, seed: int, level: float = 0.95) -> DataFrame:
    """Percentile interval of the mean over whole units, each with a Poisson(1) weight per draw.

    A weight depends on the draw and the unit alone, so nothing is numbered or
    joined: every task adds its rows to ``draws`` sums, and only those are
    shuffled.  A unit has the same weight in all groups.
    """
    drawn = poisson_draws(values, [*by, value], unit, draws, seed)
    means = drawn.groupBy(*by, "draw").agg(F.try_divide(F.sum(F.col("weight") * F.col(value)), F.sum("weight")).alias("m"))
    tail = (1 - level) / 2
    return means.groupBy(*by).agg(
        F.count("m").alias("n_draws"), F.percentile("m", F.lit(tail)).alias("low"), F.percentile("m", F.lit(1 - tail)).alias("high")
    )


def sign_flip(deltas: DataFrame, by: list[str], unit: str, value: str, draws: int, seed: int) -> DataFrame:
    """Add-one permutation p of the absolute mean under within-unit label flips."""
    flips = deltas.withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))))
    sign = F.when(F.pmod(counter_random(seed, "draw", unit), F.lit(2)) == 1, -1.0).otherwise(1.0)
    null = flips.groupBy(*by, "draw").agg(F.avg(sign * F.col(value)).alias("m"))
    observed = deltas.groupBy(*by).agg(F.avg(value).alias("observed"))
    joined = null.join(observed, by)
    hit = F.abs("m") >= F.abs("observed") - 1e-12
    return joined.groupBy(*by).agg(
        F.max("observed").alias("observed"), F.count_if(hit).alias("n_extreme"), ((F.count_if(hit) + 1) / (F.lit(draws) + 1)).alias("p")
    )


def kfolds(units: DataFrame, unit: str, folds: int, repeats: int, seed: int, strata: list[str] = ()) -> DataFrame:
    """repeat, unit and fold: units in hashed order, dealt in runs of near-equal length (or round robin by stratum)."""
    each = units.withColumn("repeat", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))))
    hashed = each.withColumn("__h", F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("repeat").cast("string"), F.col(unit).cast("string")).cast("binary")))
    own = Window.partitionBy("repeat", *strata).orderBy("__h", unit)
    fold = F.ntile(folds).over(own) - 1 if not strata else (F.row_number().over(own) - 1) % folds
    return hashed.select("repeat", *strata, unit, fold.cast("int").alias("fold"))
