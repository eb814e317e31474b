"""Sample sizes, power and detectable effects of paired comparisons, as columns of a table of designs.

Means use Student's t; binary outcomes use Connor's normal approximation, whose detectable effect has a closed form.
Designs that make no sense are errors when their row is computed.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from quorum.functions import distributions as law


def _sound(ok: Column, value: Column, what: str) -> Column:
    return F.when(ok, value).otherwise(F.raise_error(F.lit(what)))


def _column(x: Column | float) -> Column:
    return x if isinstance(x, Column) else F.lit(float(x))


def design_effect(mean_size: Column, rho: Column) -> Column:
    """How much clusters of this mean size, whose items correlate by rho, inflate a variance."""
    return _sound((mean_size >= 1) & rho.between(0, 1), 1 + (mean_size - 1) * rho, "a cluster has one item or more, and rho lies between 0 and 1")


def _each(kind: str, of: Callable[..., float]) -> Callable[..., Column]:
    """A scalar function of a design's numbers as a column function, by batches."""

    @F.pandas_udf(kind)
    def batch(*columns: pd.Series) -> pd.Series:
        return pd.Series([of(*row) for row in zip(*columns)])

    return batch


def detectable_mean(n: Column, sd: Column, alpha: float = 0.05, power: float = 0.8, df: Column | None = None) -> Column:
    """The mean difference that n items find with this power; df is n - 1 where none is given."""
    df = n - 1 if df is None else df
    reach = _each("double", lambda k: law.t_quantile(1 - alpha / 2, int(k)) + law.t_quantile(power, int(k)))
    ok = (n >= 2) & (sd > 0) & (df >= 1)
    return _sound(ok, reach(F.when(ok, df).otherwise(1)) * sd / F.sqrt(n), "two items, a positive deviation and a degree of freedom are needed")


def power_mean(n: Column, delta: Column | float, sd: Column, alpha: float = 0.05) -> Column:
    """The power of the two-sided t test of n paired differences, by the noncentral t law."""

    def of(k: float, shift: float) -> float:
        df = int(k) - 1
        edge = law.t_quantile(1 - alpha / 2, df)
        return 1 - law.noncentral_t_cdf(edge, df, shift) + law.noncentral_t_cdf(-edge, df, shift)

    ok = (n >= 2) & (sd > 0)
    return _sound(ok, _each("double", of)(F.when(ok, n).otherwise(2), F.when(ok, F.sqrt(n) * _column(delta) / sd).otherwise(0.0)), "two items and a positive deviation are needed")


def _least_n(size: Callable[[float, float], float], alpha: float, power: float) -> int:
    """The least n that is no smaller than the size that t quantiles with n - 1 degrees of freedom ask for."""
    n = max(3, math.floor(size(law.normal_quantile(1 - alpha / 2), law.normal_quantile(power))))
    while n < size(law.t_quantile(1 - alpha / 2, n - 1), law.t_quantile(power, n - 1)):
        n += 1
    return n


def items_for_mean(delta: Column, sd: Column, alpha: float = 0.05, power: float = 0.8, deff: Column | float = 1.0) -> Column:
    """Items that find a mean difference with this power, times the design effect."""
    ok = (delta != 0) & (sd > 0)
    ratio = F.when(ok, (sd / delta) * (sd / delta)).otherwise(1.0)
    n = _each("long", lambda r: _least_n(lambda a, b: (a + b) ** 2 * r, alpha, power))(ratio)
    return _sound(ok, F.ceil(n * _column(deff)), "a difference other than 0 and a positive deviation are needed")


def _possible(delta: Column, psi: Column) -> Column:
    return (psi > 0) & (psi <= 1) & (F.abs(delta) <= psi)


def items_for_binary(delta: Column, psi: Column, alpha: float = 0.05, power: float = 0.8) -> Column:
    """Items that find a difference of pass rates where a share psi of items is discordant."""
    ok = _possible(delta, psi) & (delta != 0)
    n = _each("long", lambda d, s: _least_n(lambda a, b: ((a * math.sqrt(s) + b * math.sqrt(s - d * d)) / d) ** 2, alpha, power))
    return _sound(ok, n(F.when(ok, F.abs(delta)).otherwise(0.1), F.when(ok, psi).otherwise(0.5)), "0 < |delta| <= psi <= 1 is needed")


def _normal_cdf() -> Callable[..., Column]:
    return _each("double", law.normal_cdf)


def power_binary(n: Column, delta: Column, psi: Column, alpha: float = 0.05) -> Column:
    rest = psi - delta * delta
    z = (F.sqrt(n) * F.abs(delta) - law.normal_quantile(1 - alpha / 2) * F.sqrt(psi)) / F.sqrt(F.when(rest > 0, rest).otherwise(1.0))
    return _sound(_possible(delta, psi) & (n >= 1), F.when(rest <= 0, 1.0).otherwise(_normal_cdf()(z)), "|delta| <= psi, 0 < psi <= 1 and an item are needed")


def detectable_binary(n: Column, psi: Column, alpha: float = 0.05, power: float = 0.8) -> Column:
    """The difference of pass rates that n items find with this power (a half or more): the root of a quadratic equation."""
    if not 0.5 <= power < 1:
        raise ValueError("the power must lie between a half and 1")
    edge, reach = law.normal_quantile(1 - alpha / 2), law.normal_quantile(power)
    # sqrt(n) x - edge sqrt(psi) = reach sqrt(psi - x^2)
    spread = F.sqrt(edge**2 * psi * n - (n + reach**2) * (edge**2 - reach**2) * psi)
    root = (edge * F.sqrt(psi * n) + spread) / (n + reach**2)
    root = _sound(root <= psi, root, "no difference reaches this power with so few items")
    return _sound((psi > 0) & (psi <= 1) & (n >= 1), root, "0 < psi <= 1 and an item are needed")
