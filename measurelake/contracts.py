"""Fail-closed validation: joins with asserted cardinality, key sets and rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


class ContractError(ValueError):
    """A validated input breaks its contract."""


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys on more than one row, with their count."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def join_violations(left: DataFrame, right: DataFrame, keys: list[str], validate: str) -> DataFrame:
    """side and keys of every duplicate that breaks ``validate`` (1:1, m:1, 1:m)."""
    sides = {"1:1": ("left", "right"), "m:1": ("right",), "1:m": ("left",), "m:m": ()}[validate]
    frames = {"left": left, "right": right}
    found = [duplicate_keys(frames[s], keys).select(F.lit(s).alias("side"), *keys, "n") for s in sides]
    if not found:
        return left.limit(0).select(F.lit("").alias("side"), *keys, F.lit(0).cast("long").alias("n"))
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def validated_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner", validate: str = "1:1") -> DataFrame:
    """A join that raises if a side asserted to be unique is not."""
    bad = join_violations(left, right, keys, validate).head(3)
    if bad:
        raise ContractError(f"{validate} join on {keys}: {[r.asDict() for r in bad]}")
    return left.join(right, keys, how)


def key_difference(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Keys on one side only, with the side; empty if the key sets are equal."""
    a, b = left.select(*keys).distinct(), right.select(*keys).distinct()
    only = lambda x, y, side: x.join(y, keys, "left_anti").withColumn("side", F.lit(side))
    return only(a, b, "left").unionByName(only(b, a, "right"))


def assert_equal_keys(left: DataFrame, right: DataFrame, keys: list[str]) -> None:
    if bad := key_difference(left, right, keys).head(3):
        raise ContractError(f"key sets differ: {[r.asDict() for r in bad]}")


def violations(df: DataFrame, rules: dict[str, Column], keys: list[str]) -> DataFrame:
    """rule and keys of every row for which a rule is not true; one pass over ``df``."""
    broken = F.filter(
        F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items()]), lambda x: x.isNotNull()
    )
    return df.select(*keys, F.explode(broken).alias("rule"))


def enforce(df: DataFrame, rules: dict[str, Column], keys: list[str]) -> DataFrame:
    if bad := violations(df, rules, keys).head(5):
        raise ContractError(f"{[r.asDict() for r in bad]}")
    return df
