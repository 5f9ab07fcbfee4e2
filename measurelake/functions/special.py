"""Distribution functions on NumPy arrays: normal, t, F, chi-squared."""

from __future__ import annotations

import math

import numpy as np

_erfc = np.vectorize(math.erfc, otypes=[float])
_lgamma = np.vectorize(math.lgamma, otypes=[float])


def norm_cdf(x):
    return 0.5 * _erfc(-np.asarray(x, float) / math.sqrt(2))


def norm_sf(x):
    return 0.5 * _erfc(np.asarray(x, float) / math.sqrt(2))


def norm_ppf(p):
    """Inverse normal by bisection-safe Newton steps from a logistic start."""
    p = np.asarray(p, float)
    x = np.where(p > 0.5, 1.0, -1.0) * np.sqrt(np.maximum(-2 * np.log(np.clip(np.minimum(p, 1 - p), 1e-300, None)), 1e-12)) * 0.6
    for _ in range(60):
        density = np.exp(-0.5 * x * x) / math.sqrt(2 * math.pi)
        u = (norm_cdf(x) - p) / np.maximum(density, 1e-300)
        x = x - np.clip(u / (1 + 0.5 * x * u), -1, 1)
    return np.where(p <= 0, -np.inf, np.where(p >= 1, np.inf, x))


def _beta_fraction(a, b, x):
    """Lentz's continued fraction of the incomplete beta function."""
    tiny = 1e-300
    c = np.ones_like(x)
    d = 1 - (a + b) * x / (a + 1)
    d = 1 / np.where(np.abs(d) < tiny, tiny, d)
    h = d.copy()
    for m in range(1, 400):
        for numerator in (
            m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
            -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)),
        ):
            d = 1 + numerator * d
            d = 1 / np.where(np.abs(d) < tiny, tiny, d)
            c = 1 + numerator / c
            c = np.where(np.abs(c) < tiny, tiny, c)
            h = h * d * c
        if np.all(np.abs(d * c - 1) < 1e-15):
            break
    return h


def betainc(a, b, x):
    """Regularised incomplete beta function."""
    a, b, x = np.broadcast_arrays(*(np.asarray(v, float) for v in (a, b, x)))
    inner = np.clip(x, 1e-300, 1 - 1e-16)
    front = np.exp(_lgamma(a + b) - _lgamma(a) - _lgamma(b) + a * np.log(inner) + b * np.log1p(-inner))
    direct = inner < (a + 1) / (a + b + 2)
    low = front * _beta_fraction(a, b, np.where(direct, inner, 0.0)) / a
    high = 1 - front * _beta_fraction(b, a, np.where(direct, 0.0, 1 - inner)) / b
    out = np.where(direct, low, high)
    return np.where(x <= 0, 0.0, np.where(x >= 1, 1.0, out))


def t_two_sided(t, df):
    """Two-sided p of Student's t."""
    t, df = np.asarray(t, float), np.asarray(df, float)
    return betainc(df / 2, 0.5, df / (df + t * t))


def t_ppf(p, df):
    """Quantile of Student's t by bisection."""
    p, df = np.broadcast_arrays(np.asarray(p, float), np.asarray(df, float))
    low, high = np.full(p.shape, -1e6), np.full(p.shape, 1e6)
    for _ in range(200):
        mid = (low + high) / 2
        tail = t_two_sided(mid, df) / 2
        cdf = np.where(mid > 0, 1 - tail, tail)
        low, high = np.where(cdf < p, mid, low), np.where(cdf < p, high, mid)
    return (low + high) / 2


def f_sf(f, d1, d2):
    f = np.asarray(f, float)
    return betainc(np.asarray(d2) / 2, np.asarray(d1) / 2, d2 / (d2 + d1 * f))


def chi2_sf(x, df):
    """Upper tail of chi-squared: series below, continued fraction above."""
    x, df = np.broadcast_arrays(np.asarray(x, float), np.asarray(df, float))
    a, z = df / 2, np.maximum(x / 2, 1e-300)
    front = np.exp(a * np.log(z) - z - _lgamma(a))
    term = total = 1 / a
    for n in range(1, 1000):
        term = term * z / (a + n)
        total = total + term
        if np.all(np.abs(term) < 1e-17 * np.abs(total)):
            break
    b = z + 1 - a
    c, d = np.full(z.shape, 1e300), 1 / np.where(b == 0, 1e-300, b)
    h = d
    for n in range(1, 1000):
        an = -n * (n - a)
        b = b + 2
        d = an * d + b
        d = 1 / np.where(d == 0, 1e-300, d)
        c = b + an / c
        c = np.where(c == 0, 1e-300, c)
        h = h * d * c
        if np.all(np.abs(d * c - 1) < 1e-15):
            break
    out = np.where(z < a + 1, 1 - front * total, front * h)
    return np.where(x <= 0, 1.0, np.clip(out, 0, 1))
