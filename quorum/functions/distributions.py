"""Normal, Student t, noncentral t and binomial distributions, for a few values at a time."""

from __future__ import annotations

import math
from functools import lru_cache
from statistics import NormalDist

import numpy as np

_NORMAL = NormalDist()
_NODES, _WEIGHTS = np.polynomial.legendre.leggauss(200)


def normal_cdf(x: float) -> float:
    return 0.5 * math.erfc(-x / math.sqrt(2))


def normal_quantile(p: float) -> float:
    return _NORMAL.inv_cdf(p)


def _beta_fraction(a: float, b: float, x: float) -> float:
    """The continued fraction of the incomplete beta function, evaluated from its end."""
    terms = 400
    value = 0.0
    for k in range(terms, 0, -1):
        half = k // 2
        d = half * (b - half) * x / ((a + k - 1) * (a + k)) if k % 2 == 0 else -(a + half) * (a + b + half) * x / ((a + k - 1) * (a + k))
        value = d / (1 + value)
    return 1 / (1 + value)


def incomplete_beta(a: float, b: float, x: float) -> float:
    """The regularised incomplete beta function."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - incomplete_beta(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    return front * _beta_fraction(a, b, x) / a


def t_sf(t: float, df: float) -> float:
    """P(T > t)."""
    if math.isinf(t):
        return float(t < 0)
    tail = 0.5 * incomplete_beta(df / 2, 0.5, df / (df + t * t))
    return tail if t >= 0 else 1 - tail


def t_cdf(t: float, df: float) -> float:
    return t_sf(-t, df)


@lru_cache(maxsize=4096)
def t_quantile(p: float, df: float) -> float:
    if p == 0.5:
        return 0.0
    if p < 0.5:
        return -t_quantile(1 - p, df)
    low, high = 0.0, 1.0
    while t_cdf(high, df) < p:
        low, high = high, high * 2
    for _ in range(200):
        middle = (low + high) / 2
        if middle in (low, high):
            break
        low, high = (middle, high) if t_cdf(middle, df) < p else (low, middle)
    return (low + high) / 2


def noncentral_t_cdf(t: float, df: float, shift: float) -> float:
    """P((Z + shift) / sqrt(chi-square / df) <= t), by quadrature over the chi density."""
    spread = 1 / math.sqrt(2 * df)
    low, high = max(0.0, 1 - 12 * spread), 1 + 12 * spread
    s = (high - low) / 2 * _NODES + (high + low) / 2  # sqrt(chi-square / df)
    log_density = math.log(2) + df / 2 * math.log(df / 2) - math.lgamma(df / 2) + (df - 1) * np.log(np.maximum(s, 1e-300)) - df * s**2 / 2
    inner = np.array([normal_cdf(t * x - shift) for x in s])
    return float(min(1.0, max(0.0, (high - low) / 2 * np.sum(_WEIGHTS * np.exp(log_density) * inner))))


def binomial_half_cdf(k: int, n: int) -> float:
    """P(X <= k) of n fair coins, from whole numbers."""
    if k < 0:
        return 0.0
    term, total = 1, 0
    for i in range(min(k, n) + 1):
        total += term
        term = term * (n - i) // (i + 1)
    return total / 2**n if n < 1000 else float(np.exp(_log_int(total) - n * math.log(2)))


def _log_int(x: int) -> float:
    shift = max(0, x.bit_length() - 1000)
    return math.log(x >> shift) + shift * math.log(2)


def mcnemar_exact(n_pos: int, n_neg: int) -> float:
    """Two-sided exact McNemar p-value of the discordant counts; 1 where they are equal."""
    if n_pos < 0 or n_neg < 0:
        raise ValueError("counts must not be negative")
    if n_pos == n_neg:
        return 1.0
    return min(1.0, 2 * binomial_half_cdf(min(n_pos, n_neg), n_pos + n_neg))
