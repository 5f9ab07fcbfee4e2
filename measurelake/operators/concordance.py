"""Weighted counts of ordered pairs without forming a pair."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import DoubleType, IntegralType, LongType, StructField, StructType

from .ranking import matched

#: Rows of a group up to which one task counts its pairs, and cuts of x and of y for a larger group.
CHUNK, CUTS = 1 << 17, 64


def _ordered_sums(x: np.ndarray, y: np.ndarray, lefts: list[np.ndarray], rights: list[np.ndarray], products: list[tuple[int, int]]) -> list:
    """For each (i, j) the sum of lefts[i](a) * rights[j](b) over pairs with x(a) < x(b) and y(a) < y(b).

    The values of y are ranked; two ranks differ first at one binary digit, where the
    smaller has 0 and the larger 1, below equal leading digits.  Rows with equal leading
    digits are one block, and its pairs are prefix sums in the order of x.
    """
    x, y = (np.unique(v, return_inverse=True)[1] for v in (x, y))
    order = np.argsort(x, kind="stable")
    x, y = x[order], y[order]
    lefts, rights = [v[order] for v in lefts], [v[order] for v in rights]
    total = [0 for _ in products]
    at = np.arange(len(x))
    for digit in range(int(y.max(initial=0)).bit_length()):
        block = y >> (digit + 1)
        o = np.argsort(block.astype(np.uint16) if block.max() < 1 << 16 else block, kind="stable")
        own, level = block[o], x[o]
        one = ((y[o] >> digit) & 1).astype(bool)
        starts = np.concatenate([[True], own[1:] != own[:-1]])
        ties = starts | np.concatenate([[True], level[1:] != level[:-1]])
        first, tied = (np.maximum.accumulate(np.where(s, at, 0)) for s in (starts, ties))
        below = []
        for v in lefts:
            run = np.concatenate([[0], np.cumsum(np.where(one, 0, v[o]))])
            below.append((run[tied] - run[first])[one])
        for k, (i, j) in enumerate(products):
            total[k] += _dot(below[i], rights[j][o][one])
    return total


def _dot(a: np.ndarray, b: np.ndarray):
    """Sum of products; whole numbers stay exact or raise."""
    if a.dtype.kind == b.dtype.kind == "i" and np.abs(a.astype(float)) @ np.abs(b.astype(float)) > 9e18:
        raise OverflowError("sums over pairs do not fit 64 bits")
    return (a @ b).item()


def _cell_sums(x: np.ndarray, y: np.ndarray, lefts: list[np.ndarray], rights: list[np.ndarray], products: list[tuple[int, int]]) -> list:
    """`_ordered_sums` of a few levels of x and y by a table of both."""
    (nx, x), (ny, y) = ((len(levels), at) for levels, at in (np.unique(v, return_inverse=True) for v in (x, y)))
    below = []
    for v in lefts:
        cells = np.zeros((nx + 1, ny + 1), v.dtype)
        np.add.at(cells, (x + 1, y + 1), v)
        below.append(cells.cumsum(0).cumsum(1)[x, y])
    return [_dot(below[i], rights[j]) for i, j in products]


def dominated_sums(df: DataFrame, by: list[str], x: str, y: str, products: dict[str, tuple[str, str]], chunk: int | None = None) -> DataFrame:
    """Per group, for each name, the sum of left(a) * right(b) over all pairs of rows with x(a) < x(b) and y(a) < y(b).

    A group of up to ``CHUNK`` rows is counted in one task.  In a larger one x and y are cut at
    approximate quantiles; a value at a cut is a range of its own, so that no range with
    several values is large for its ties.  A pair's values of y lie in one range (a task of that range
    counts it), or else those of x do (likewise, y compared by range), or neither (sums per cell
    of ranges).  So a row is sent twice at most, and what is broadcast are the cuts of large groups.
    Rows with a null in x or y take no part.
    """
    lefts, rights = (list(dict.fromkeys(p[i] for p in products.values())) for i in (0, 1))
    at = [(lefts.index(a), rights.index(b)) for a, b in products.values()]
    whole = {c: isinstance(df.schema[c].dataType, IntegralType) for c in (*lefts, *rights)}
    number = lambda c: F.coalesce(F.col(c).cast("long" if whole[c] else "double"), F.lit(0))
    names = [f"__left{i}" for i in range(len(lefts))], [f"__right{i}" for i in range(len(rights))]
    weights = [number(c).alias(n) for columns, own in zip((lefts, rights), names) for c, n in zip(columns, own)]
    used = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull()).select(*by, F.col(x).alias("__x"), F.col(y).alias("__y"), *weights)

    large = used.groupBy(*by).agg(F.count(F.lit(1)).alias("__size")).filter(F.col("__size") > (chunk or CHUNK)).select(*by)
    share = [i / CUTS for i in range(1, CUTS)]
    cuts = lambda c: F.array_distinct(F.percentile_approx(c, share, 20 * CUTS))
    edges = matched(used, F.broadcast(large), by).groupBy(*by).agg(cuts("__x").alias("__ex"), cuts("__y").alias("__ey"))
    placed = matched(used, F.broadcast(edges), by, "left")
    split = F.col("__ex").isNotNull()
    # Twice the cuts below a value (by halving steps), and one more at a cut: ranges of a single value are odd.
    steps = F.array(*[F.lit(1 << i) for i in reversed(range(CUTS.bit_length()))])

    def place(e: str, v: str):
        below = F.aggregate(steps, F.lit(0), lambda at, step: at + F.when(F.get(e, at + step - 1) < F.col(v), step).otherwise(0))
        at_cut = lambda n: 2 * n + F.when(F.get(e, n) == F.col(v), 1).otherwise(0)
        return F.transform(F.array(below), at_cut)[0]

    placed = placed.withColumn("__px", F.when(split, place("__ex", "__x"))).withColumn("__py", F.when(split, place("__ey", "__y"))).drop("__ex", "__ey")

    schema = StructType([df.schema[c] for c in by] + [StructField(n, LongType() if whole[a] and whole[b] else DoubleType()) for n, (a, b) in products.items()])

    def counted(count):
        def run(table: pa.Table) -> pa.Table:
            column = lambda c: table.column(c).to_numpy()
            found = count(column, [column(n) for n in names[0]], [column(n) for n in names[1]], at)
            values = {n: pa.array([v], pa.int64() if whole[a] and whole[b] else pa.float64()) for v, (n, (a, b)) in zip(found, products.items())}
            return pa.table({c: table.column(c).slice(0, 1) for c in by} | values)

        return run

    route = lambda kind, part: F.struct(F.lit(kind).alias("__kind"), part.cast("int").alias("__part"))
    two = F.filter(F.array(route("y", F.col("__py")), route("x", F.col("__px"))), lambda r: r["__part"] % 2 == 0)
    routes = F.when(F.col("__px").isNull(), F.array(route("y", F.lit(0)))).otherwise(two)
    sent = placed.select(*by, "__x", "__y", *names[0], *names[1], F.coalesce("__py", F.lit(0)).alias("__py"), F.explode(routes).alias("__to"))
    sent = sent.select("*", "__to.*").drop("__to")
    in_range = lambda column, *rest: _ordered_sums(column("__x"), column("__py" if column("__kind")[0] == "x" else "__y"), *rest)
    inner = sent.groupBy(*by, "__kind", "__part").applyInArrow(counted(in_range), schema)
    cells = placed.filter(F.col("__px").isNotNull()).groupBy(*by, "__px", "__py").agg(*[F.sum(n).alias(n) for n in (*names[0], *names[1])])
    across = cells.groupBy(*by).applyInArrow(counted(lambda column, *rest: _cell_sums(column("__px"), column("__py"), *rest)), schema)
    return inner.unionByName(across).groupBy(*by).agg(*[F.sum(n).alias(n) for n in products])


def dominated(df: DataFrame, by: list[str], x: str, y: str, left: str, right: str) -> DataFrame:
    """Per group ``pairs``: the one sum of `dominated_sums`."""
    return dominated_sums(df, by, x, y, {"pairs": (left, right)})


def weighted_concordance(df: DataFrame, by: list[str], x: str, y: str, weight: str) -> DataFrame:
    """Per group concordant, all and their ratio: weights of pairs of rows in the same strict order of x and y, and of all pairs.

    Null if a group has no pair of a positive weight; its rows are counted ``weight`` times, but never paired with themselves.
    """
    used = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull())
    w = F.col(weight).cast("double")
    whole = used.groupBy(*by).agg(((F.sum(w) * F.sum(w) - F.sum(w * w)) / 2).alias("all"))
    both = matched(whole, dominated(used, by, x, y, weight, weight), by)
    return both.select(*by, F.col("pairs").alias("concordant"), "all", F.try_divide("pairs", "all").alias("ratio"))
