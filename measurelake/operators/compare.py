"""Keyed comparison of two tables with per-column tolerances."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from ..contracts import ContractError
from ..functions.scalar import is_close


def compare_tables(left: DataFrame, right: DataFrame, keys: list[str], columns: dict[str, tuple[float, float] | None]) -> DataFrame:
    """One row per difference: the key, the column and missing_left, missing_right or value.

    ``columns`` maps a column to (relative, absolute) tolerances, or None where
    values must be equal; a null equals only a null.
    """
    a = left.select(*keys, F.lit(True).alias("__a"), *[F.col(c).alias(f"a_{c}") for c in columns])
    b = right.select(*keys, F.lit(True).alias("__b"), *[F.col(c).alias(f"b_{c}") for c in columns])
    both = a.join(b, keys, "full_outer")

    def differs(c):
        x, y, limits = F.col(f"a_{c}"), F.col(f"b_{c}"), columns[c]
        same = x.eqNullSafe(y) if limits is None else is_close(x, y, *limits)
        return F.when(~same, F.struct(F.lit(c).alias("column_name"), F.lit("value").alias("problem")))

    one = lambda problem: F.array(F.struct(F.lit("").alias("column_name"), F.lit(problem).alias("problem")))
    found = (
        F.when(F.col("__a").isNull(), one("missing_left"))
        .when(F.col("__b").isNull(), one("missing_right"))
        .otherwise(F.filter(F.array(*map(differs, columns)), lambda x: x.isNotNull()))
    )
    return both.select(*keys, F.explode(found).alias("x")).select(*keys, "x.*")


@dataclass(frozen=True)
class Rule:
    """How far a column may drift, in its own unit, and which decisions may not change at all.

    ``cuts``: no value may move across one; ``sign``: neither may the sign change;
    ``zero``: nothing may become or cease to be zero, nor be negative;
    ``probability``: within [0, 1]; ``positive``: over zero.  A column without a
    rule has to be equal as text.
    """

    relative: float = 0.0
    absolute: float = 0.0
    unit: str = "dimensionless"
    cuts: tuple[float, ...] = ()
    sign: bool = False
    zero: bool = False
    probability: bool = False
    positive: bool = False

    def reasons(self, x: Column, y: Column) -> Column:
        """The reasons against ``y`` where ``x`` is expected, an array; a value that is not a number is one of its own."""
        missing = lambda c: c.isNull() | F.isnan(c)
        infinite = F.abs(x).eqNullSafe(float("inf")) | F.abs(y).eqNullSafe(float("inf"))
        found = [F.when(~is_close(x, y, self.relative, self.absolute), "numerical tolerance exceeded")]
        found += [F.when((x < c) != (y < c), f"decision at {c} changed") for c in self.cuts]
        if self.sign:
            found.append(F.when(F.signum(x) != F.signum(y), "direction changed"))
        if self.zero:
            found.append(F.when(((x == 0) != (y == 0)) | (y < 0), "zero boundary changed"))
        if self.probability:
            found.append(F.when((y < 0) | (y > 1), "probability out of bounds"))
        if self.positive:
            found.append(F.when(y <= 0, "not positive"))
        kept = F.filter(F.array(*found), lambda r: r.isNotNull())
        one = lambda reason: F.array(F.lit(reason))
        none = F.array().cast("array<string>")
        return F.when(missing(x) != missing(y), one("missing-value mask changed")).when(missing(x), none).when(infinite, one("nonfinite numerical result")).otherwise(kept)


def gated(expected: DataFrame, actual: DataFrame, keys: list[str], rules: dict[str, Rule]) -> tuple[DataFrame, DataFrame]:
    """Violations (keys, column_name, reason, expected, actual) and diagnostics by column, of one keyed join.

    Diagnostics: rows compared, largest absolute and relative error, values that
    left an expected zero, and violations of every column with a rule, whatever
    fails elsewhere.  Differing columns raise at once; keys that are missing,
    unexpected or duplicated are violations under the column "".
    """
    if set(expected.columns) != set(actual.columns) or not set(rules) <= set(expected.columns):
        raise ContractError(f"columns differ: {sorted(set(expected.columns) ^ set(actual.columns) | set(rules) - set(expected.columns))}")
    values = [c for c in expected.columns if c not in keys]

    def side(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy(*keys).agg(F.count(F.lit(1)).alias(f"{name}_rows"), *[F.first(c).alias(f"{name}_{c}") for c in values])

    both = side(expected, "a").join(side(actual, "b"), keys, "full_outer")
    number = lambda c: F.col(c).cast("double")

    def judged(c: str) -> Column:
        x, y = F.col(f"a_{c}"), F.col(f"b_{c}")
        if c in rules:
            reasons = rules[c].reasons(number(f"a_{c}"), number(f"b_{c}"))
        else:
            reasons = F.when(x.cast("string").eqNullSafe(y.cast("string")), F.array().cast("array<string>")).otherwise(F.array(F.lit("exact label or count mismatch")))
        return F.transform(reasons, lambda r: F.struct(F.lit(c).alias("column_name"), r.alias("reason"), x.cast("string").alias("expected"), y.cast("string").alias("actual")))

    rows = F.col("a_rows"), F.col("b_rows")
    key = lambda reason: F.array(F.struct(F.lit("").alias("column_name"), F.lit(reason).alias("reason"), rows[0].cast("string").alias("expected"), rows[1].cast("string").alias("actual")))
    found = F.when(rows[0].isNull(), key("unexpected key")).when(rows[1].isNull(), key("missing key")).when((rows[0] > 1) | (rows[1] > 1), key("duplicated key")).otherwise(F.flatten(F.array(*map(judged, values))))
    violations = both.select(*keys, F.explode(found).alias("v")).select(*keys, "v.*")

    measured = both.filter("a_rows = 1 AND b_rows = 1").select(
        F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.lit(r.unit).alias("unit"), number(f"a_{c}").alias("x"), number(f"b_{c}").alias("y"), r.reasons(number(f"a_{c}"), number(f"b_{c}")).alias("r")) for c, r in rules.items()])).alias("m")
    ).select("m.*")
    error = F.abs(F.col("x") - F.col("y"))
    diagnostics = measured.groupBy("column_name", "unit").agg(
        F.count(error).alias("n"),
        F.max(error).alias("largest_absolute"),
        F.max(F.when(F.col("x") != 0, error / F.abs("x"))).alias("largest_relative"),
        F.count_if((F.col("x") == 0) & (F.col("y") != 0)).alias("left_zero"),
        F.sum(F.size("r")).alias("violations"),
    )
    return violations, diagnostics


def require_gated(expected: DataFrame, actual: DataFrame, keys: list[str], rules: dict[str, Rule]) -> DataFrame:
    """The diagnostics; any violation raises, after all columns were compared."""
    violations, diagnostics = gated(expected, actual, keys, rules)
    if found := violations.orderBy(*keys, "column_name", "reason").head(10):
        raise ContractError(f"{violations.count()} violations, the first: {[r.asDict() for r in found]}")
    return diagnostics
