"""Rank correlation structure: pairs, balanced medians, conditioning, covariance parts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .ranking import midrank


def unit_ranks(df: DataFrame, probe: str, unit: str, value: str) -> DataFrame:
    """Centred mid-ranks of each probe over the units, scaled to length one; constant probes drop out."""
    own = Window.partitionBy(probe)
    ranked = df.filter(F.col(value).isNotNull()).withColumn("__r", midrank(F.col(value), probe))
    centred = ranked.withColumn("__r", F.col("__r") - F.avg("__r").over(own))
    length = F.sqrt(F.sum(F.col("__r") * F.col("__r")).over(own))
    return centred.withColumn("__l", length).filter("__l > 0").select(
        F.col(probe).alias("probe"), F.col(unit).alias("unit"), (F.col("__r") / F.col("__l")).alias("r")
    )


def spearman_pairs(ranks: DataFrame) -> DataFrame:
    """probe_i < probe_j, rho (products of unit rank vectors) and n (units with both).

    Each unit's vector is gathered once (its length is the number of probes, a
    registry).  Every task adds its units up to one matrix product, so what is
    shuffled is a table of probe pairs per task; the units, which grow with the
    data, are never joined with each other, nor are their pairs written out.
    """
    kind = ranks.schema["probe"].dataType.simpleString()
    packed = ranks.groupBy("unit").agg(F.collect_list(F.struct("probe", "r")).alias("v")).select("v")
    sums = packed.mapInArrow(_products, f"probe_i {kind}, probe_j {kind}, rho double, n long")
    return sums.groupBy("probe_i", "probe_j").agg(F.sum("rho").alias("rho"), F.sum("n").alias("n"))


def _products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of products of every two probes over the task's units."""
    places: dict = {}
    total, count = np.zeros((0, 0)), np.zeros((0, 0))
    kind = None
    for batch in batches:
        lists = batch.column(0)
        flat = lists.flatten()
        coded = flat.field(0).dictionary_encode()
        kind = coded.dictionary.type
        local = np.array([places.setdefault(p, len(places)) for p in coded.dictionary.to_pylist()], np.int64)
        grow = len(places) - len(total)
        total, count = np.pad(total, (0, grow)), np.pad(count, (0, grow))
        rows = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
        at = (rows, local[coded.indices.to_numpy()])
        values, there = np.zeros((len(lists), len(places))), np.zeros((len(lists), len(places)))
        values[at], there[at] = flat.field(1).to_numpy(), 1.0
        total += values.T @ values
        count += there.T @ there
    names = sorted(places)
    order = np.array([places[p] for p in names], np.int64)
    i, j = np.triu_indices(len(names), 1)
    a, b = order[i], order[j]
    met = count[a, b] > 0
    if met.any():
        column = pa.array(names, kind)
        i, j, a, b = i[met], j[met], a[met], b[met]
        yield pa.RecordBatch.from_arrays(
            [column.take(pa.array(i)), column.take(pa.array(j)), pa.array(total[a, b]), pa.array(count[a, b].astype(np.int64))],
            ["probe_i", "probe_j", "rho", "n"],
        )


def balanced_median(rho: DataFrame, group_of) -> DataFrame:
    """Median over group pairs of the median over their probe pairs, beside the plain median."""
    labelled = rho.withColumn("__a", group_of(F.col("probe_i"))).withColumn("__b", group_of(F.col("probe_j")))
    between = labelled.filter("__a <> __b").withColumn("g_i", F.least("__a", "__b")).withColumn("g_j", F.greatest("__a", "__b"))
    medians = between.groupBy("g_i", "g_j").agg(F.median("rho").alias("m"), F.count(F.lit(1)).alias("k"))
    balanced = medians.agg(F.median("m").alias("balanced"), F.count(F.lit(1)).alias("n_group_pairs"))
    return balanced.crossJoin(between.agg(F.median("rho").alias("weighted"), F.count(F.lit(1)).alias("n_probe_pairs")))


def condition_on(ranks: DataFrame, score: DataFrame) -> DataFrame:
    """Unit rank vectors with their part along a unit score (unit, s) removed and rescaled."""
    own = Window.partitionBy("probe")
    joined = ranks.join(score, "unit")
    rest = joined.withColumn("r", F.col("r") - F.col("s") * F.sum(F.col("r") * F.col("s")).over(own))
    length = F.sqrt(F.sum(F.col("r") * F.col("r")).over(own))
    return rest.withColumn("__l", length).filter("__l > 1e-12").select("probe", "unit", (F.col("r") / F.col("__l")).alias("r"))


def common_score(ranks: DataFrame, group_of) -> DataFrame:
    """unit and s: mean of the groups' unit mean vectors, ranked again and scaled to length one."""
    means = ranks.groupBy(group_of(F.col("probe")).alias("g"), "unit").agg(F.avg("r").alias("m"))
    own = Window.partitionBy("g")
    scaled = means.withColumn("m", F.try_divide("m", F.sqrt(F.sum(F.col("m") * F.col("m")).over(own))))
    total = scaled.groupBy("unit").agg(F.avg("m").alias("v")).withColumn("probe", F.lit(0))
    return unit_ranks(total, "probe", "unit", "v").select("unit", F.col("r").alias("s"))


def covariance_parts(wide: DataFrame, by: list[str], high_i: str, low_i: str, high_j: str, low_j: str) -> DataFrame:
    """Cov of differences split into the arms' covariances and the two cross terms."""
    c = F.covar_samp
    out = wide.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        c(high_i, high_j).alias("cov_high"),
        c(low_i, low_j).alias("cov_low"),
        (c(high_i, low_j) + c(low_i, high_j)).alias("cov_cross"),
        c(F.col(high_i) - F.col(low_i), F.col(high_j) - F.col(low_j)).alias("cov_delta"),
    )
    gap = F.col("cov_high") + F.col("cov_low") - F.col("cov_cross") - F.col("cov_delta")
    return out.withColumn("identity_ok", F.abs(gap) <= 1e-12)
