"""Matched control windows in many dimensions: features of runs, a caliper grid join, tiers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.scalar import median_of
from . import ranking


def run_features(
    df: DataFrame, by: str, position: str, n: int, means: dict[str, Column], spreads: dict[str, Column], apart: float
) -> DataFrame:
    """Every run of ``n`` neighbours of a group: by, start, stop, features (means, deviations, then log span, median and largest gap), clusters.

    Gaps count as one at least before the logarithm; a gap over ``apart`` begins a new cluster.
    """
    order = Window.partitionBy(by).orderBy(position)
    run, inner = order.rowsBetween(1 - n, 0), order.rowsBetween(2 - n, 0)
    gap = (F.col(position) - F.lag(position).over(order)).cast("double")
    named = {f"__m{i}": c for i, c in enumerate(means.values())} | {f"__s{i}": c for i, c in enumerate(spreads.values())}
    rows = df.select(by, position, *[c.cast("double").alias(k) for k, c in named.items()]).withColumn("__gap", gap).withColumn("__i", F.row_number().over(order))
    floor = lambda x: F.log(F.greatest(x, F.lit(1.0)))
    parts = [F.avg(k).over(run) if k.startswith("__m") else F.stddev_pop(k).over(run) for k in named]
    parts += [floor((F.col(position) - F.first(position).over(run)).cast("double")), floor(median_of(F.collect_list("__gap").over(inner))), floor(F.max("__gap").over(inner))]
    island = F.count_if(F.col("__gap") > apart).over(inner)
    out = rows.select(by, F.first(position).over(run).alias("start"), F.col(position).alias("stop"), "__i", *[p.alias(f"f{i}") for i, p in enumerate(parts)], (island + 1).alias("clusters"))
    count = len(parts)
    return out.filter(F.col("__i") >= n).select(by, "start", "stop", F.array(*[f"f{i}" for i in range(count)]).alias("features"), "clusters")


def scales(runs: DataFrame, width: int) -> list[float]:
    """Population deviation of every feature over all runs; a constant one has one."""
    row = runs.agg(*[F.stddev_pop(F.get("features", i)).alias(f"s{i}") for i in range(width)]).first()
    return [s if s else 1.0 for s in row]


def caliper_matches(
    slots: DataFrame, runs: DataFrame, by: str, scale: list[float], tiers: list[float], gate: Callable[[Column], Column], grid: int = 3, least: int = 10, most: int = 20
) -> DataFrame:
    """The ``most`` nearest controls of each slot within its tier: slot, tier, n_groups, rank, by, start, distance.

    ``slots`` has slot, features and clusters.  A run may match a slot with as many
    clusters if ``gate`` holds for its features; it lies within a tier if no
    feature differs by more than the tier times its scale.  Of each group only
    the nearest run counts (ties to the smaller start).  The narrowest tier with
    ``least`` groups is taken, without one all runs that pass the gates.
    Distance is the root mean square of the scaled differences.

    Tiers are joined through a grid: cells of the widest tier's width over the
    first ``grid`` features, a slot standing in its own cell and all
    neighbouring ones.  Only slots without a tier meet all runs, and of those
    pairs only the nearest per group leaves a task.
    """
    width = tiers[-1]
    cell = lambda features, i: F.floor(F.get(features, i) / F.lit(width * scale[i]))
    cells = [f"__c{i}" for i in range(grid)]
    near = slots.select("slot", F.col("features").alias("__f"), F.col("clusters").alias("__k"))
    around = near
    for i, c in enumerate(cells):
        around = around.withColumn(c, F.explode(F.array(*[cell("__f", i) + k for k in (-1, 0, 1)])))
    able = runs.filter(gate(F.col("features")))
    placed = able.select("*", *[cell("features", i).alias(c) for i, c in enumerate(cells)])
    scaled = F.zip_with(F.zip_with("features", "__f", lambda a, b: a - b), F.array(*map(F.lit, scale)), lambda x, s: x / s)
    squares = F.aggregate(scaled, F.lit(0.0), lambda t, z: t + z * z)
    measured = lambda pairs: pairs.filter(F.col("clusters") == F.col("__k")).select(
        "slot", by, "start", F.round(F.sqrt(squares / len(scale)), 9).alias("distance"), F.array_max(F.transform(scaled, F.abs)).alias("__far")
    )
    nearest = lambda df, keys: df.groupBy(*keys, by).agg(F.min(F.struct("distance", "start")).alias("__b")).select(*keys, by, "__b.start", "__b.distance")

    # Slots are a registry; runs grow with the table and are never sent to the driver, whatever their size is taken for.
    joined = measured(placed.join(F.broadcast(around), cells))
    tier = F.explode(F.array(*map(F.lit, tiers))).alias("tier")
    within = nearest(joined.select("*", tier).filter(F.col("__far") <= F.col("tier") + 1e-12), ["slot", "tier"])
    enough = within.groupBy("slot", "tier").agg(F.count(F.lit(1)).alias("n_groups")).filter(F.col("n_groups") >= least)
    chosen = enough.groupBy("slot").agg(F.min(F.struct("tier", "n_groups")).alias("__t")).select("slot", "__t.*")
    rest = near.join(chosen, "slot", "left_anti")
    every = nearest(measured(able.join(F.broadcast(rest), F.col("clusters") == F.col("__k"))), ["slot"]).withColumn("tier", F.lit(float("inf")))
    sized = every.groupBy("slot").agg(F.count(F.lit(1)).alias("n_groups"))
    pool = within.join(F.broadcast(chosen), ["slot", "tier"]).unionByName(every.join(F.broadcast(sized), "slot"))
    return ranking.top_k(pool, "slot", [F.col("distance"), F.col(by), F.col("start")], most)


def feature_balance(matches: DataFrame, slots: DataFrame, runs: DataFrame, by: str, scale: list[float]) -> DataFrame:
    """slot, feature, slot_value, control_mean and the scaled difference of every feature over the matched controls."""
    controls = runs.select(by, "start", "features").join(F.broadcast(matches), [by, "start"])  # a few matches a slot
    each = controls.select("slot", F.posexplode("features").alias("feature", "value")).groupBy("slot", "feature").agg(F.avg("value").alias("control_mean"))
    own = slots.select("slot", F.posexplode("features").alias("feature", "slot_value"))
    size = F.get(F.array(*map(F.lit, scale)), F.col("feature"))
    return own.join(each, ["slot", "feature"]).withColumn("difference", (F.col("slot_value") - F.col("control_mean")) / size)
