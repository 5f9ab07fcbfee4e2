"""Ranks, running extremes and ordered-window operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.scalar import median_of


def _keys(by) -> list[str]:
    return [by] if isinstance(by, str) else list(by)


def midrank(value: Column, by) -> Column:
    """Average rank of ``value`` within ``by``; ties share the mean of their places, nulls get none."""
    own = Window.partitionBy(*_keys(by)).orderBy(value.asc_nulls_last())
    ties = Window.partitionBy(*_keys(by), value)
    return F.when(value.isNotNull(), F.rank().over(own) + (F.count(F.lit(1)).over(ties) - 1) / 2.0)


#: Ranges of values that a group is cut into, so that its levels are cumulated by many tasks.
RANGES = 64
#: Rows of a group up to which it is one range.
WHOLE = 100_000


def matched(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join on keys that may be null; the right side's keys are dropped."""
    named = right.withColumnsRenamed({k: f"__r{i}" for i, k in enumerate(keys)})
    same = F.lit(True)
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"__r{i}"))
    return left.join(named, same, how).drop(*[f"__r{i}" for i in range(len(keys))])


def cumulated(levels: DataFrame, by, value: str, counts: list[str], ranges: int | None = None) -> DataFrame:
    """``levels`` (one row per group and value) with ``c__below`` and ``c__total`` for each column of ``counts``.

    Prefix counts without a window over a whole large group: approximate quantiles cut the
    values of a group of more than ``WHOLE`` rows into ranges, sums per range are added up
    over the ranges (few rows a group), and within a range over its levels.  Smaller groups,
    of which there may be any number, are one range and need no quantiles.  The result
    does not depend on where the cuts fall.
    """
    keys, whole, ranges = _keys(by), WHOLE if ranges is None else 0, ranges or RANGES
    share = [i / ranges for i in range(1, ranges)]
    # Large groups are fewer than rows / WHOLE, so what is known of them is broadcast.
    large = levels.groupBy(*keys).agg(F.count(F.lit(1)).alias("__size")).filter(F.col("__size") > whole)
    edges = matched(levels, F.broadcast(large), keys).groupBy(*keys).agg(F.percentile_approx(value, share, 20 * ranges).alias("__edges"))
    placed = matched(levels, F.broadcast(edges), keys, "left")
    cut = F.size(F.filter("__edges", lambda e: e < F.col(value)))
    placed = placed.withColumn("__range", F.when(F.col("__edges").isNotNull(), cut).otherwise(-1)).drop("__edges")
    spot = [*keys, "__range"]
    sums = placed.filter("__range >= 0").groupBy(*spot).agg(*[F.sum(c).alias(c) for c in counts])
    over = Window.partitionBy(*keys)
    before = over.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(*spot, *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"{c}__before") for c in counts], *[F.sum(c).over(over).alias(f"{c}__all") for c in counts])
    own = Window.partitionBy(*spot).orderBy(value)
    first, every = own.rowsBetween(Window.unboundedPreceding, -1), own.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    counted = placed.withColumns({f"{c}__own": F.coalesce(F.sum(c).over(first), F.lit(0)) for c in counts} | {f"{c}__sum": F.sum(c).over(every) for c in counts})
    joined = matched(counted, F.broadcast(offsets), spot, "left")
    below = [(F.coalesce(f"{c}__before", F.lit(0)) + F.col(f"{c}__own")).alias(f"{c}__below") for c in counts]
    return joined.select(*levels.columns, *below, *[F.coalesce(f"{c}__all", f"{c}__sum").alias(f"{c}__total") for c in counts])


def counted_ranks(df: DataFrame, by, value: str, counts: dict[str, Column]) -> DataFrame:
    """One row per group and value: counts (a Column each, summed), their ``n``, and the mid-rank ``rank`` of the value."""
    keys = _keys(by)
    levels = df.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n"), *[F.sum(c).alias(name) for name, c in counts.items()])
    ranked = cumulated(levels, keys, value, ["n"])
    return ranked.withColumn("rank", F.col("n__below") + (F.col("n") + 1) / 2.0)


def order_statistic(df: DataFrame, by, value: str, places: dict[str, Column]) -> DataFrame:
    """One row per group: for each name the value at a place (from 0, a Column in ``n__total``) in ascending order."""
    keys = _keys(by)
    levels = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n"))
    ranked = cumulated(levels, keys, value, ["n"])
    at = lambda place: F.max(F.when((F.col("n__below") <= place) & (place < F.col("n__below") + F.col("n")), F.col(value)))
    return ranked.groupBy(*keys).agg(F.max("n__total").alias("n"), *[at(place).alias(name) for name, place in places.items()])


def bh_adjust(
    df: DataFrame, p: str, by, out: str = "q", denominator: int | str = "all", nulls: str = "keep", eligible: Column | None = None
) -> DataFrame:
    """Benjamini-Hochberg over families ``by`` with an explicit denominator and null policy.

    ``denominator``: "all" rows of the family, "finite" p-values only, or a
    fixed number.  ``nulls``: "keep" (null p stays null), "one" (null p counts
    and is returned as 1).  Rows that are not ``eligible`` count as p = 1 and
    come back null.
    """
    if nulls not in ("keep", "one"):
        raise ValueError(f"nulls: {nulls}")
    chosen = F.col(p) if eligible is None else F.when(eligible, F.col(p)).otherwise(F.lit(1.0))
    chosen = F.coalesce(chosen, F.lit(1.0)) if nulls == "one" else chosen
    family = Window.partitionBy(*_keys(by))
    if denominator == "all":
        m = F.count(F.lit(1)).over(family)
    elif denominator == "finite":
        m = F.count("__p").over(family)
    else:
        m = F.lit(int(denominator))
    place = F.row_number().over(family.orderBy(F.col("__p").asc_nulls_last()))
    down = family.orderBy(F.col("__r").desc()).rowsBetween(Window.unboundedPreceding, 0)
    ranked = df.withColumn("__p", chosen).withColumn("__m", m).withColumn("__r", place)
    raw = F.when(F.col("__p").isNotNull(), F.col("__p") * F.col("__m") / F.col("__r"))
    q = F.when(F.col("__p").isNotNull(), F.least(F.min(raw).over(down), F.lit(1.0)))
    if eligible is not None:
        q = F.when(eligible, q)
    return ranked.withColumn(out, q).drop("__p", "__m", "__r")


def holm_adjust(df: DataFrame, p: str, by, out: str = "p_holm") -> DataFrame:
    """Holm's step-down adjustment over families ``by``."""
    family = Window.partitionBy(*_keys(by))
    up = family.orderBy("__r").rowsBetween(Window.unboundedPreceding, 0)
    ranked = df.withColumn("__r", F.row_number().over(family.orderBy(F.col(p).asc_nulls_last())))
    m = F.count(p).over(family)
    return ranked.withColumn("__s", F.least(F.lit(1.0), F.col(p) * (m - F.col("__r") + 1))).withColumn(
        out, F.when(F.col(p).isNotNull(), F.max("__s").over(up))
    ).drop("__r", "__s")


def leave_one_out_mean(value: Column, by) -> Column:
    """Mean of the others in the group; null for a group of one."""
    own = Window.partitionBy(*_keys(by))
    n = F.count(value).over(own)
    return F.when(n > 1, (F.sum(value).over(own) - value) / (n - 1))


def quantile_linear(df: DataFrame, by, value: str, shares: dict[str, float]) -> DataFrame:
    """Exact quantiles with linear interpolation, from order statistics; one row per group."""
    keys = _keys(by)
    spot = lambda q: (F.col("n__total") - 1) * F.lit(q)
    places = {f"__{s}_{n}": f(spot(q)) for n, q in shares.items() for s, f in (("low", F.floor), ("high", F.ceil))}
    found = order_statistic(df, keys, value, places).withColumnRenamed("n", "n__total")
    low, high = (lambda n: F.col(f"__low_{n}").cast("double")), (lambda n: F.col(f"__high_{n}").cast("double"))
    return found.select(*keys, *[(low(n) + (high(n) - low(n)) * (spot(q) - F.floor(spot(q)))).alias(n) for n, q in shares.items()])


def quantile_higher(df: DataFrame, value: str, by, q: float, out: str) -> DataFrame:
    """Exact quantile as an order statistic, the next higher one; one row per group."""
    place = F.ceil((F.col("n__total") - 1) * F.lit(q) - 1e-9)
    return order_statistic(df, by, value, {out: place}).select(*_keys(by), out)


def top_k(df: DataFrame, by, order: list[Column], k: int, rank: str = "rank") -> DataFrame:
    """The first ``k`` rows of each group; ``order`` must break ties."""
    own = Window.partitionBy(*_keys(by)).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(own)).filter(F.col(rank) <= k)


def window_features(df: DataFrame, by, position: str, value: str, n: int, apart: float | None = None) -> DataFrame:
    """For each run of ``n`` neighbours in order of position: mean value, span, largest and median gap, and clusters.

    A gap over ``apart`` parts clusters: islands are numbered by a running count of such
    gaps, and a run has as many clusters as islands from its first place to its last.
    """
    ordered = Window.partitionBy(*_keys(by)).orderBy(position)
    run, inner = ordered.rowsBetween(1 - n, 0), ordered.rowsBetween(2 - n, 0)
    gaps = df.withColumn("__gap", F.col(position) - F.lag(position).over(ordered)).withColumn("__i", F.row_number().over(ordered))
    island = F.count_if(F.col("__gap") > F.lit(apart)).over(ordered.rowsBetween(Window.unboundedPreceding, 0))
    gaps = gaps.withColumn("__island", island)
    featured = gaps.select(
        "*",
        (F.col("__island") - F.first("__island").over(run) + 1).alias("clusters"),
        F.avg(value).over(run).alias("window_mean"),
        (F.col(position) - F.first(position).over(run)).alias("span"),
        F.max("__gap").over(inner).alias("max_gap"),
        median_of(F.collect_list("__gap").over(inner)).alias("median_gap"),
    )
    return featured.filter(F.col("__i") >= n).drop("__gap", "__i", "__island")


def trapezoid(df: DataFrame, by, x: str, y: str, out: str) -> DataFrame:
    """Integral of y over the ordered grid x of each group, divided by the grid's length."""
    own = Window.partitionBy(*_keys(by)).orderBy(x)
    parts = df.withColumn("__dx", F.lead(x).over(own) - F.col(x)).withColumn("__my", (F.lead(y).over(own) + F.col(y)) / 2.0)
    whole = parts.groupBy(*_keys(by)).agg(F.sum(F.col("__dx") * F.col("__my")).alias("__a"), (F.max(x) - F.min(x)).alias("__l"))
    return whole.select(*_keys(by), F.try_divide("__a", "__l").alias(out))
