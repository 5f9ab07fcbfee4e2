"""A battery of association tests as one typed table.

Every planned row names an axis and a variable and the kind of test that the
variable asks for: two named groups, several groups, a number by ranks, a number
by regression.  All rows of all cohorts are tested together: a dispatcher deals
complete cases to the kinds, each kind is one aggregation over counted values,
and a row that cannot be tested stays in the result with the reason.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.tails import chi2_upper, normal_two_sided, t_two_sided
from . import inference, ranking, resampling

TWO_GROUPS, GROUPS, RANKS, REGRESSION = "two_groups", "groups", "ranks", "regression"
#: The low level that stands for every other one.
REST = "*"


@dataclass(frozen=True)
class Planned:
    """One test of every cohort and axis; rows of the family are corrected together, the others together."""

    label: str
    variable: str
    kind: str
    high: str | None = None
    low: str | None = None
    family: bool = True


def aligned(values: DataFrame, by: list[str], axis: str, unit: str, value: str, reference: str) -> DataFrame:
    """``values`` with every axis turned to correlate positively with the reference axis of its group.

    An axis without a correlation (constant, or fewer than two shared units) stays as it is.
    """
    own = values.filter(F.col(axis) == reference).select(*by, unit, F.col(value).alias("__ref"))
    sign = values.join(own, [*by, unit]).groupBy(*by, axis).agg(F.corr(value, "__ref").alias("__c"))
    sign = sign.select(*by, axis, F.when(F.col("__c") < 0, -1.0).otherwise(1.0).alias("__sign"))
    return ranking.matched(values, sign, [*by, axis], "left").withColumn(value, F.col(value) * F.coalesce("__sign", F.lit(1.0))).drop("__sign")


def rank_correlation(df: DataFrame, by: list[str], x: str, y: str, weight: Column | None = None) -> DataFrame:
    """n (the weights' sum) and Spearman's rho of each group, from counted pairs; every value's mid-rank comes from prefix counts."""
    used = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull()).withColumn("__w", weight if weight is not None else F.lit(1))
    pairs = used.filter("__w > 0").groupBy(*by, x, y).agg(F.sum("__w").alias("__w"))

    def ranked(v: str, out: str) -> DataFrame:
        levels = ranking.cumulated(pairs.groupBy(*by, v).agg(F.sum("__w").alias("n")), by, v, ["n"])
        # The mean rank is half of the total and one, whatever the ties.
        return levels.select(*by, v, (F.col("n__below") + (F.col("n") - F.col("n__total")) / 2.0).alias(out))

    both = ranking.matched(ranking.matched(pairs, ranked(x, "__a"), [*by, x]), ranked(y, "__b"), [*by, y])
    w, a, b = F.col("__w"), F.col("__a"), F.col("__b")
    s = both.groupBy(*by).agg(F.sum(w).alias("n"), F.sum(w * a * b).alias("__ab"), F.sum(w * a * a).alias("__aa"), F.sum(w * b * b).alias("__bb"))
    return s.select(*by, "n", _rho("__ab", "__aa", "__bb"))


def _rho(ab: str, aa: str, bb: str) -> Column:
    """Correlation from sums of products about the means; null where one side is constant."""
    rho = F.try_divide(F.col(ab), F.sqrt(F.col(aa)) * F.sqrt(F.col(bb)))
    return F.when(rho.isNotNull(), F.greatest(F.least(rho, F.lit(1.0)), F.lit(-1.0))).alias("rho")


#: Rows of a group that are ranked together, in all draws at once.
RANGE_ROWS = 8192


def drawn_rank_correlation(pairs: DataFrame, by: list[str], unit: str, x: str, y: str, draws: int, seed: int, range_rows: int | None = None) -> DataFrame:
    """by, draw, n and rho: Spearman's rho of each group in every draw of ``resampling.poisson_draws``, and in draw -1 with each row once.

    A row is never copied by draw: it carries its weights of all draws.  Groups are cut into ranges of
    about ``range_rows`` rows (and a value's rows stay together); a task ranks a range in all draws from
    the ranges' weights before it.  Rows go once through the ranges of x, then with their ranks
    through those of y, where products are added.  Ranks are about their mean, doubled, so they are whole.
    """
    used = pairs.filter(F.col(x).isNotNull() & F.col(y).isNotNull())
    width = draws + 1
    base = used.select(*by, F.col(x).cast("double").alias("__x"), F.col(y).cast("double").alias("__y"), resampling.poisson_digests(F.col(unit), draws, seed).alias("__w"))

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            w = resampling.poisson_weights(batch.column("__w").to_pylist(), draws)
            w = np.concatenate([np.ones((len(w), 1), np.uint8), w], axis=1)
            yield batch.set_column(batch.schema.get_field_index("__w"), "__w", pa.array([r.tobytes() for r in w], pa.binary()))

    # Kept, because means made anew may differ in their last digit.
    base = base.mapInArrow(weigh, base.schema).persist()
    sizes = base.groupBy(*by).agg(F.count(F.lit(1)).alias("__size"))
    rows = range_rows or RANGE_ROWS
    ranges = math.ceil((sizes.agg(F.max("__size")).first()[0] or 1) / rows)
    if ranges > 1:
        shares = [i / ranges for i in range(1, ranges)]
        large = ranking.matched(base, F.broadcast(sizes.filter(F.col("__size") > rows)), by)
        edges = large.groupBy(*by).agg(*[F.percentile_approx(v, shares, 20 * ranges).alias(f"{v}e") for v in ("__x", "__y")]).localCheckpoint()
        placed = ranking.matched(base, F.broadcast(edges), by, "left")
        cut = lambda v: F.coalesce(F.size(F.filter(f"{v}e", lambda e: e < F.col(v))), F.lit(0)).alias(f"{v}r")
        placed = placed.select(*base.columns, *[F.when(F.col(f"{v}e").isNull(), 0).otherwise(cut(v)).alias(f"{v}r") for v in ("__x", "__y")])
    else:
        placed = base.select("*", F.lit(0).alias("__xr"), F.lit(0).alias("__yr"))
    spark = pairs.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    types = [f"`{c}` {pairs.schema[c].dataType.simpleString()}" for c in by]

    def matrix(column: pa.ChunkedArray, kind) -> np.ndarray:
        return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(-1, width)

    def whole(table: pa.Table, more: dict) -> pa.Table:
        first = table.slice(0, 1)
        return pa.table({c: first.column(c) for c in by} | {c: first.column(c) for c in ("side", "range") if c in table.column_names} | more)

    def add(table: pa.Table) -> pa.Table:
        return whole(table, {"sums": pa.array([matrix(table.column("__w"), np.uint8).sum(0, dtype=np.int64).tolist()])})

    # Weights of the ranges before each range, and of its group, by draw.
    sides = placed.select(*by, "__w", F.explode(F.array(F.struct(F.lit("x").alias("side"), F.col("__xr").alias("range")), F.struct(F.lit("y").alias("side"), F.col("__yr").alias("range")))).alias("s"))
    sides = sides.select(*by, "__w", "s.*").repartition(parts, *by, "side", "range").groupBy(*by, "side", "range")
    sums = sides.applyInArrow(add, ", ".join([*types, "side string, range int, sums array<long>"]))
    own = Window.partitionBy(*by, "side", "draw")
    each = sums.select(*by, "side", "range", F.posexplode("sums").alias("draw", "s"))
    before = F.coalesce(F.sum("s").over(own.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    each = each.select(*by, "side", "range", "draw", before.alias("b"), F.sum("s").over(own).alias("t"))
    lists = each.groupBy(*by, "side", "range").agg(F.array_sort(F.collect_list(F.struct("draw", "b", "t"))).alias("l"))
    known = lists.select(*by, "side", "range", F.col("l.b").alias("__before"), F.col("l.t").alias("__total")).localCheckpoint()

    def ranks(table: pa.Table, v: str) -> tuple[np.ndarray, np.ndarray, pa.Table]:
        """Doubled ranks about their mean (levels by draw), each row's level, and the rows in order of ``v``."""
        table = table.take(pa.array(np.argsort(table.column(v).to_numpy(), kind="stable")))
        value, w = table.column(v).to_numpy(), matrix(table.column("__w"), np.uint8)
        starts = np.flatnonzero(np.concatenate([[True], value[1:] != value[:-1]]))
        own = np.add.reduceat(w, starts, axis=0, dtype=np.int64)
        before, total = (np.array(table.column(c)[0].as_py(), np.int64) for c in ("__before", "__total"))
        return 2 * (before + own.cumsum(0) - own) + own - total, np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(value)))), table

    def by_x(table: pa.Table) -> pa.Table:
        found, level, table = ranks(table, "__x")
        packed = [r.tobytes() for r in found]
        return table.select([*by, "__y", "__yr", "__w"]).append_column("__a", pa.array([packed[i] for i in level], pa.binary()))

    def by_y(table: pa.Table) -> pa.Table:
        found, level, table = ranks(table, "__y")
        total = np.zeros((3, width))
        for start in range(0, len(level), 1024):
            part = table.slice(start, 1024)
            w, a = matrix(part.column("__w"), np.uint8).astype(float), matrix(part.column("__a"), np.int64).astype(float)
            b = found[level[start : start + 1024]].astype(float)
            total += [(w * a * b).sum(0), (w * a * a).sum(0), (w * b * b).sum(0)]
        return whole(table, {n: pa.array([s.tolist()]) for n, s in zip(("ab", "aa", "bb"), total)} | {"n": table.column("__total").slice(0, 1)})

    def with_known(df: DataFrame, side: str) -> DataFrame:
        mine = known.filter(F.col("side") == side).select(*by, F.col("range").alias(f"__{side}r"), "__before", "__total")
        return ranking.matched(df, F.broadcast(mine), [*by, f"__{side}r"]).repartition(parts, *by, f"__{side}r").groupBy(*by, f"__{side}r")

    turned = with_known(placed, "x").applyInArrow(by_x, ", ".join([*types, "__y double, __yr int, __w binary, __a binary"]))
    products = with_known(turned, "y").applyInArrow(by_y, ", ".join([*types, "ab array<double>, aa array<double>, bb array<double>, n array<long>"]))
    each = products.select(*by, F.posexplode(F.arrays_zip("ab", "aa", "bb", "n")).alias("draw", "s")).groupBy(*by, "draw")
    each = each.agg(F.first("s.n").alias("n"), *[F.sum(f"s.{c}").alias(c) for c in ("ab", "aa", "bb")])
    return each.select(*by, (F.col("draw") - 1).alias("draw"), "n", _rho("ab", "aa", "bb"))


def battery(values: DataFrame, variables: DataFrame, planned: list[Planned], cohort: str, unit: str, axis: str, value: str, min_n: int = 5) -> DataFrame:
    """One row per cohort, axis and planned test: estimate, statistic, p, and q within cohort and family.

    ``variables`` is long: cohort, unit, variable, level (text) and number.  Groups
    below ``min_n`` values leave a test of two untested and take no part in one of
    several; ranks and regression need ``min_n`` complete cases.
    Estimates: rank-biserial correlation (with the difference of the medians),
    epsilon squared, rho, slope.
    """
    spark = values.sparkSession
    schema = "label string, variable string, kind string, high string, low string, in_family boolean"
    plan = F.broadcast(spark.createDataFrame([(p.label, p.variable, p.kind, p.high, p.low, p.family) for p in planned], schema))  # a plan, written by hand
    by = [cohort, axis, "label"]
    cases = values.filter(F.col(value).isNotNull()).join(variables, [cohort, unit]).join(plan, "variable")

    two = cases.filter(F.col("kind") == TWO_GROUPS).filter("level = high OR level = low OR (low = '*' AND level IS NOT NULL)")
    two = two.withColumn("__arm", F.when(F.col("level") == F.col("high"), 1).otherwise(0))
    u = inference.mann_whitney(two, by, "__arm", value, 1, 0)
    half = F.col("n_high") * F.col("n_low") / 2
    z = F.when(F.col("u") == half, 0.0).otherwise(F.abs("z") * (1 - 0.5 / F.abs(F.col("u") - half)))
    u = u.withColumn("__z", F.greatest(z, F.lit(0.0)))
    medians = ranking.quantile_linear(two, [*by, "__arm"], value, {"__m": 0.5}).groupBy(*by).agg((F.max(F.when(F.col("__arm") == 1, F.col("__m"))) - F.max(F.when(F.col("__arm") == 0, F.col("__m")))).alias("median_difference"))
    ok = (F.least("n_high", "n_low") >= min_n) & F.col("__z").isNotNull()
    found = [
        ranking.matched(u, medians, by).select(
            *by, (F.col("n_high") + F.col("n_low")).alias("n"), F.when(ok, F.col("rank_biserial")).alias("estimate"), F.when(ok, F.col("median_difference")).alias("median_difference"),
            F.when(ok, F.col("__z")).alias("statistic"), F.when(ok, normal_two_sided(F.col("__z"))).alias("p"),
        )
    ]

    groups = cases.filter((F.col("kind") == GROUPS) & F.col("level").isNotNull())
    h = inference.kruskal(groups, by, "level", value, min_n)
    ok = (F.col("k") >= 2) & F.col("h").isNotNull()
    none = F.lit(None).cast("double").alias("median_difference")
    found.append(h.select(*by, "n", F.when(ok, F.col("epsilon2")).alias("estimate"), none, F.when(ok, F.col("h")).alias("statistic"), F.when(ok, chi2_upper(F.col("h"), F.col("k") - 1)).alias("p")))

    numbers = cases.filter(F.col("number").isNotNull())
    rho = rank_correlation(numbers.filter(F.col("kind") == RANKS), by, value, "number")
    ok = (F.col("n") >= min_n) & (F.abs("rho") < 1)
    t = F.when(ok, F.col("rho") * F.sqrt((F.col("n") - 2) / (1 - F.col("rho") * F.col("rho"))))
    rho = rho.withColumn("__t", t).withColumn("__df", F.when(ok, F.col("n") - 2))
    found.append(rho.select(*by, "n", F.when(F.col("n") >= min_n, F.col("rho")).alias("estimate"), none, F.col("__t").alias("statistic"), t_two_sided(F.col("__t"), F.col("__df")).alias("p")))

    x = F.col("number")
    line = numbers.filter(F.col("kind") == REGRESSION).groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.covar_pop(value, x).alias("__xy"), F.var_pop(x).alias("__xx"), F.var_pop(value).alias("__yy")
    )
    slope = F.try_divide(F.col("__xy"), F.col("__xx"))
    rest = F.greatest(F.col("__yy") - slope * F.col("__xy"), F.lit(0.0))
    ok = (F.col("n") >= min_n) & (F.col("__xx") > 0) & (rest > 0)
    line = line.withColumn("__df", F.when(ok, F.col("n") - 2)).withColumn("__t", F.when(ok, slope / F.sqrt(rest / (F.col("n") - 2) / F.col("__xx"))))
    found.append(line.select(*by, "n", F.when(ok, slope).alias("estimate"), none, F.col("__t").alias("statistic"), t_two_sided(F.col("__t"), F.col("__df")).alias("p")))

    tested = found[0]
    for more in found[1:]:
        tested = tested.unionByName(more)
    every = values.select(cohort, axis).distinct().crossJoin(plan.select("label", "kind", "in_family"))  # cohorts x axes x plan
    out = ranking.matched(every, tested, by, "left").withColumn("n", F.coalesce("n", F.lit(0))).withColumn("tested", F.col("p").isNotNull())
    return ranking.bh_adjust(out, "p", [cohort, "in_family"], "q", "finite")


def axis_agreement(values: DataFrame, by: list[str], unit: str, axis: str, value: str, draws: int, seed: int, min_n: int = 5, level: float = 0.95) -> DataFrame:
    """rho of every pair of axes of a group with a percentile interval over whole units, ranked anew in every draw.

    Pairs below ``min_n`` shared units are left out.
    """
    a = values.filter(F.col(value).isNotNull()).select(*by, unit, F.col(axis).alias("axis_a"), F.col(value).alias("x"))
    b = values.filter(F.col(value).isNotNull()).select(*by, unit, F.col(axis).alias("axis_b"), F.col(value).alias("y"))
    own = [*by, "axis_a", "axis_b"]
    pairs = a.join(b, [*by, unit]).filter("axis_a < axis_b").select(*own, unit, "x", "y")
    drawn = drawn_rank_correlation(pairs, own, unit, "x", "y", draws, seed).persist()
    point = drawn.filter((F.col("draw") < 0) & (F.col("n") >= min_n)).drop("draw")
    each = drawn.filter((F.col("draw") >= 0) & F.col("rho").isNotNull())
    tail = (1 - level) / 2
    interval = ranking.quantile_linear(each, own, "rho", {"low": tail, "high": 1 - tail})
    return ranking.matched(point, interval, own, "left")
