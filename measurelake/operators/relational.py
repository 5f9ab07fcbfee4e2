"""Pairing, pivots, coverage-gated scores and other shapes of long measurements."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .concordance import dominated_sums


def collapse_replicates(df: DataFrame, keys: list[str], value: str, guard: list[str] = ()) -> DataFrame:
    """Mean over replicates, how many there were, and whether the guard columns agree within the key."""
    same = F.count_distinct(F.struct(*guard)) <= 1 if guard else F.lit(True)
    return df.groupBy(*keys).agg(
        F.avg(value).alias(value), F.count(value).alias("n_replicates"), same.alias("guard_ok")
    )


def paired_differences(df: DataFrame, keys: list[str], arm: str, value: str, high: str, low: str) -> DataFrame:
    """high - low of every verified pair, by one aggregation and no self-join.

    A key is verified if it has exactly one row of each arm (`verify_pairs`); with a
    second one there is no telling which of them is meant, so it is no pair.
    """
    pick = lambda level: F.max(F.when(F.col(arm) == level, F.col(value)))
    n = lambda level: F.count_if(F.col(arm) == level)
    both = df.filter(F.col(arm).isin(high, low)).groupBy(*keys).agg(pick(high).alias("high"), pick(low).alias("low"), n(high).alias("__h"), n(low).alias("__l"))
    verified = both.filter("__h = 1 AND __l = 1 AND high IS NOT NULL AND low IS NOT NULL").drop("__h", "__l")
    return verified.withColumn("delta", F.col("high") - F.col("low"))


def verify_pairs(samples: DataFrame, keys: list[str], arm: str, high: str, low: str) -> DataFrame:
    """How many samples of each arm a patient has, and whether it is exactly one of both."""
    n = lambda level: F.count_if(F.col(arm) == level)
    counted = samples.groupBy(*keys).agg(n(high).alias("n_high"), n(low).alias("n_low"))
    return counted.withColumn("pair_verified", (F.col("n_high") == 1) & (F.col("n_low") == 1))


def repair_pairs(samples: DataFrame, title: str, high: str, low: str) -> DataFrame:
    """Patient codes from titles by two patterns; a code is a pair if both arms have it."""
    code = F.coalesce(F.nullif(F.regexp_extract(title, low, 1), F.lit("")), F.nullif(F.regexp_extract(title, high, 1), F.lit("")))
    arm = F.when(F.regexp_extract(title, low, 1) != "", "low").when(F.regexp_extract(title, high, 1) != "", "high")
    coded = samples.withColumn("code", code).withColumn("arm", arm)
    own = Window.partitionBy("code")
    both = (F.max((F.col("arm") == "low").cast("int")).over(own) + F.max((F.col("arm") == "high").cast("int")).over(own)) == 2
    return coded.withColumn("paired", F.coalesce(both & F.col("code").isNotNull(), F.lit(False)))


def pivot_strict(df: DataFrame, index: list[str], column: str, levels: list, value: str) -> DataFrame:
    """Long to wide over known levels; a cell with several rows raises when the row is read."""
    wide = df.groupBy(*index).pivot(column, levels).agg(
        F.when(F.count(value) > 1, F.raise_error(F.lit(f"several values for one {column}")).cast("double")).otherwise(F.max(value))
    )
    return wide


def unpivot(df: DataFrame, ids: list[str], values: list[str], name: str, value: str) -> DataFrame:
    return df.unpivot(ids, values, name, value)


def planned_rows(planned: DataFrame, estimates: DataFrame, keys: list[str], p: str = "p") -> DataFrame:
    """One row per planned key even without an estimate: status, and p_for_bh with 1 in place of a missing p."""
    marked = estimates.withColumn("__there", F.lit(True))
    joined = planned.join(marked, keys, "left")
    status = F.when(F.col("__there").isNull(), "missing").when(F.col(p).isNull(), "not_estimable").otherwise("estimated")
    return joined.withColumn("status", status).withColumn("p_for_bh", F.coalesce(F.col(p), F.lit(1.0))).drop("__there")


def gated_score(measured: DataFrame, registry: DataFrame, keys: list[str], value: str, share: float = 0.8) -> DataFrame:
    """Mean of a group's probes if at least ceil(share * targets) have values, else null.

    ``registry`` has columns gene and probe; every gene of it gets a row for every key.
    """
    targets = registry.groupBy("gene").agg(F.count(F.lit(1)).alias("n_target"))
    present = measured.join(F.broadcast(registry.select("gene", "probe")), "probe")
    sums = present.groupBy(*keys, "gene").agg(F.count(value).alias("n_valid"), F.avg(value).alias("__mean"))
    grid = measured.select(*keys).distinct().crossJoin(F.broadcast(targets))
    joined = grid.join(sums, [*keys, "gene"], "left").withColumn("n_valid", F.coalesce("n_valid", F.lit(0)))
    needed = F.ceil(F.col("n_target") * share - 1e-9)
    return joined.withColumn("score", F.when(F.col("n_valid") >= needed, F.col("__mean"))).drop("__mean")


def coverage(measured: DataFrame, registry: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Valid and missing measurements of every registry probe by key."""
    grid = measured.select(*keys).distinct().crossJoin(F.broadcast(registry.select("probe").distinct()))
    counts = measured.groupBy(*keys, "probe").agg(F.count(value).alias("n_valid"), F.count(F.lit(1)).alias("n_rows"))
    joined = grid.join(counts, [*keys, "probe"], "left")
    return joined.select(
        *keys, "probe", F.coalesce("n_valid", F.lit(0)).alias("n_valid"), F.coalesce("n_rows", F.lit(0)).alias("n_rows")
    )


def one_hot(df: DataFrame, column: str, prefix: str, levels: list[str], drop_constants: bool = False) -> DataFrame:
    """Indicator columns of sorted levels, the first dropped; without those that are the same in all rows if wanted."""
    flags = {f"{prefix}_{v}": F.when(F.col(column) == v, 1).otherwise(0) for v in sorted(levels)[1:]}
    out = df.withColumns(flags)
    if drop_constants and flags:
        ends = out.agg(*[F.struct(F.min(c), F.max(c)).alias(c) for c in flags]).first()  # two numbers a level
        out = out.drop(*[c for c in flags if ends[c][0] == ends[c][1]])
    return out


def all_subsets(spark, names: list[str]) -> DataFrame:
    """Every non-empty subset: id, size and members, in order of size and then members."""
    n = len(names)
    ids = spark.range(1, 1 << n)
    flags = [F.when(F.col("id").bitwiseAND(1 << i) != 0, F.lit(x)) for i, x in enumerate(names)]
    member = F.filter(F.array(*flags), lambda x: x.isNotNull())
    out = ids.select("id", member.alias("members")).withColumn("size", F.size("members"))
    return out.select("id", "size", F.array_join("members", ";").alias("members"))


def unordered_pairs(df: DataFrame, by: list[str], item: str) -> DataFrame:
    """All pairs item_i < item_j within ``by``; the equality on ``by`` keeps it a hash join."""
    a = df.select(*by, F.col(item).alias("item_i")).distinct()
    b = df.select(*by, F.col(item).alias("item_j")).distinct()
    return a.join(b, by).filter("item_i < item_j")


def overlap_matrix(df: DataFrame, group: str, item: str) -> DataFrame:
    """Common items of every two groups; items in several groups only are joined."""
    sets = df.groupBy(item).agg(F.array_sort(F.collect_set(group)).alias("g")).filter("size(g) > 1")
    pairs = sets.select(item, F.explode("g").alias("group_i"), "g").select(item, "group_i", F.explode("g").alias("group_j"))
    return pairs.filter("group_i < group_j").groupBy("group_i", "group_j").agg(F.count(F.lit(1)).alias("n_common"))


def step_lookup(steps: DataFrame, asked: DataFrame, by: list[str], at: str, value: str, left_limit: bool = False) -> DataFrame:
    """Last value at or before ``at`` (before it, for the left limit) by one sorted pass; no range join."""
    tagged = steps.select(*by, F.col(at).alias("__t"), F.col(value).alias("__v"), F.lit(1 if left_limit else 0).alias("__o"))
    asking = asked.withColumn("__t", F.col(at)).withColumn("__o", F.lit(0 if left_limit else 1))
    both = tagged.unionByName(asking, allowMissingColumns=True)
    own = Window.partitionBy(*by).orderBy("__t", "__o").rowsBetween(Window.unboundedPreceding, 0)
    found = both.withColumn(value, F.last("__v", ignorenulls=True).over(own))
    return found.filter(F.col("__o") == (0 if left_limit else 1)).drop("__t", "__v", "__o")


def overlaps(a: DataFrame, b: DataFrame, chromosome: str = "chr", start: str = "start", end: str = "end", bin_size: int = 1 << 14) -> DataFrame:
    """Pairs of intervals that share a position, by an equality join on position bins."""
    bins = F.explode(F.sequence(F.floor(F.col(start) / bin_size), F.floor(F.col(end) / bin_size)))
    left = a.select(*[F.col(c).alias(f"a_{c}") for c in a.columns], F.col(chromosome).alias("__c"), bins.alias("__b"))
    right = b.select(*[F.col(c).alias(f"b_{c}") for c in b.columns], F.col(chromosome).alias("__c"), bins.alias("__b"))
    hit = (F.col(f"a_{start}") <= F.col(f"b_{end}")) & (F.col(f"b_{start}") <= F.col(f"a_{end}"))
    # A pair is reported in the first bin that both lie in.
    first = F.floor(F.greatest(F.col(f"a_{start}"), F.col(f"b_{start}")) / bin_size)
    # Spark does not count the rows that bins make, so it would broadcast a side through the driver by the size of its file.
    return left.join(right.hint("merge"), ["__c", "__b"]).filter(hit & (F.col("__b") == first)).drop("__c", "__b")


def overlap_sums(df: DataFrame, by: str, key: str, start: str = "start", end: str = "end") -> DataFrame:
    """by, n_pairs, sum_a and sum_b: overlapping pairs of one table, and the sums of their smaller and larger keys.

    No pair is formed.  Of all pairs with a smaller and a larger key
    those are taken off in which one interval ends before the other starts; these are pairs
    in one order of end and start, with the smaller key on the left side and then on the right.
    All three are sums over pairs in the same order of two values (`dominated_sums`).  An interval
    that ends before it starts overlaps what contains it whole, as in `overlaps`, which joins those.
    """
    names = ["n_pairs", "sum_a", "sum_b"]
    k = F.col(key)
    known = df.filter(F.col(by).isNotNull() & k.isNotNull() & F.col(start).isNotNull() & F.col(end).isNotNull()).select(by, key, start, end)
    proper, reverse = known.filter(F.col(start) <= F.col(end)), known.filter(F.col(start) > F.col(end))
    side = lambda at, left, right, own: F.struct(F.col(at).alias("__at"), F.lit(left).cast("long").alias("__m"), F.lit(right).cast("long").alias("__n"), (k * left).alias("__mk"), (k * right).alias("__nk"), (k * (own or 1)).alias("__x"), F.lit(own).alias("__side"))
    # Side 0 orders keys by themselves.  Else the one that ends is left, the one that starts is right; on side -1 the left one has the larger key.
    sides = [side(key, 1, 1, 0)] + [side(at, 1 - one, one, own) for own in (1, -1) for one, at in ((0, end), (1, start))]
    ends = proper.select(by, F.explode(F.array(*sides)).alias("e")).select(by, "e.*")
    found = dominated_sums(ends, [by, "__side"], "__x", "__at", {"n_pairs": ("__m", "__n"), "left": ("__mk", "__n"), "right": ("__m", "__nk")})
    sign, smaller = F.when(F.col("__side") == 0, 1).otherwise(-1), F.col("__side") >= 0
    counted = found.select(by, (sign * F.col("n_pairs")).alias("n_pairs"), (sign * F.when(smaller, F.col("left")).otherwise(F.col("right"))).alias("sum_a"), (sign * F.when(smaller, F.col("right")).otherwise(F.col("left"))).alias("sum_b"))
    odd = overlaps(reverse, proper, by, start, end).select(F.col(f"a_{by}").alias(by), F.least(f"a_{key}", f"b_{key}").alias("__a"), F.greatest(f"a_{key}", f"b_{key}").alias("__b"))
    more = odd.filter("__a < __b").groupBy(by).agg(F.count(F.lit(1)).alias("n_pairs"), F.sum("__a").alias("sum_a"), F.sum("__b").alias("sum_b"))
    out = counted.unionByName(more).groupBy(by).agg(*[F.sum(c).alias(c) for c in names])
    return out.filter("n_pairs > 0")


def gated_mean(value: Column, policy: str = "all") -> Column:
    """Aggregate mean: "all" gives null if any value is missing, "skip" ignores missing ones."""
    return F.when(F.count(value) == F.count(F.lit(1)), F.avg(value)) if policy == "all" else F.avg(value)


def union_all(*frames: DataFrame) -> DataFrame:
    """UNION ALL by name; columns missing from a frame are null."""
    out = frames[0]
    for more in frames[1:]:
        out = out.unionByName(more, allowMissingColumns=True)
    return out


def transpose(matrix: DataFrame, row: str, rows: list, name: str, prefix: str = "") -> DataFrame:
    """Columns of ``matrix`` but ``row`` as rows, called ``name``; the given values of ``row`` as columns."""
    values = [c for c in matrix.columns if c != row]
    cells = F.explode(F.array(*[F.struct(F.lit(c).alias(name), F.col(f"`{c}`").alias("__v")) for c in values])).alias("x")
    long = matrix.select(F.col(row).alias("__row"), cells).select("__row", "x.*")
    wide = long.groupBy(name).pivot("__row", rows).agg(F.first("__v"))
    return wide.select(name, *[F.col(f"`{r}`").alias(f"{prefix}{r}") for r in rows])
