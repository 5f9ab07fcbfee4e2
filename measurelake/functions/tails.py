"""Tail probabilities as column expressions of fixed cost: Student's t, the normal and chi-squared.

A p-value costs the same at any sample size and stays in the JVM.  Near the
centre it is one less an integral by Simpson's rule; further out the tail itself
is integrated by Gauss-Laguerre nodes, so that small p-values keep some ten
significant digits.

Give the arguments names of their own: in a select that also defines an alias
of the same name, Spark takes that alias within the lambdas here.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, functions as F

#: Intervals of Simpson's rule; even.
NODES = 256
#: The tail is integrated where the exponent of its leading factor reaches this.
_OUT = 1.5
_TAIL = [(float(r), float(w)) for r, w in zip(*np.polynomial.laguerre.laggauss(64)) if w > 1e-30]
#: The series of gamma(x + 1/2) / gamma(x) / sqrt(x) in powers of 1 / x.
_RATIO = (1.0, -1 / 8, 1 / 128, 5 / 1024, -21 / 32768, -399 / 262144)
_SHIFT = 16


def _simpson(upper: Column, f) -> Column:
    """Integral of ``f`` from 0 to ``upper``."""
    step = upper / NODES

    def add(total, i):
        weight = F.when((i == 0) | (i == NODES), 1.0).when(i % 2 == 1, 4.0).otherwise(2.0)
        return total + weight * f(step * i)

    return F.aggregate(F.sequence(F.lit(0), F.lit(NODES)), F.lit(0.0), add) * step / 3


def _gamma_ratio(x: Column) -> Column:
    """gamma(x + 1/2) / gamma(x): the series at x + 16, brought down by the recurrence."""
    y = x + _SHIFT
    series = F.lit(0.0)
    for c in reversed(_RATIO):
        series = series / y + c
    down = F.aggregate(F.sequence(F.lit(0), F.lit(_SHIFT - 1)), F.lit(1.0), lambda a, i: a * (x + i) / (x + i + 0.5))
    return F.sqrt(y) * series * down


def _laguerre(f) -> Column:
    """Integral of exp(-r) ``f``(r) over all positive r."""
    nodes = F.array(*[F.struct(F.lit(r).alias("r"), F.lit(w).alias("w")) for r, w in _TAIL])
    return F.aggregate(nodes, F.lit(0.0), lambda total, x: total + x["w"] * f(x["r"]))


def t_two_sided(t: Column, df: Column) -> Column:
    """Two-sided p of Student's t for any real degrees of freedom of 1 or more; null for null arguments."""
    df = df.cast("double")
    d = df / 2 * F.log1p(t * t / df)
    scale = _gamma_ratio(df / 2) / math.sqrt(math.pi)
    inside = 2 * scale * _simpson(F.atan(F.abs(t) / F.sqrt(df)), lambda u: F.pow(F.cos(u), df - 1))
    outside = F.exp(-d) * scale * 2 / df * _laguerre(lambda r: 1 / F.sqrt(-F.expm1(-2 / df * (d + r))))
    return F.when(t.isNotNull() & (df >= 1), F.when(d < _OUT, 1 - inside).otherwise(outside))


def normal_two_sided(z: Column) -> Column:
    """Two-sided p of a normal deviate."""
    d = z * z / 2
    inside = math.sqrt(2 / math.pi) * _simpson(F.abs(z), lambda u: F.exp(-u * u / 2))
    outside = F.exp(-d) / math.sqrt(math.pi) * _laguerre(lambda r: 1 / F.sqrt(d + r))
    return F.when(z.isNotNull(), F.when(d < _OUT, 1 - inside).otherwise(outside))


def chi2_upper(x: Column, df: Column) -> Column:
    """Upper tail of chi-squared for whole degrees of freedom: a finite sum, after the normal tail for odd ones."""
    half, odd, k = x / 2, df % 2 == 1, df.cast("int")
    start = F.when(odd, F.sqrt(half) * 2 / math.sqrt(math.pi)).otherwise(F.lit(1.0))
    terms = F.floor(k / 2).cast("int")
    zero = F.struct(F.lit(0.0).alias("total"), start.alias("term"))

    def step(a, j):
        divisor = j + F.when(odd, 0.5).otherwise(0.0)
        return F.struct((a["total"] + a["term"]).alias("total"), (a["term"] * half / divisor).alias("term"))

    steps = F.when(terms >= 1, F.sequence(F.lit(1), F.greatest(terms, F.lit(1)))).otherwise(F.array().cast("array<int>"))
    total = F.exp(-half) * F.aggregate(steps, zero, step)["total"] + F.when(odd, normal_two_sided(F.sqrt(x))).otherwise(0.0)
    return F.when(x.isNotNull() & (k >= 1), F.least(F.when(x <= 0, 1.0).otherwise(total), F.lit(1.0)))
