"""Krippendorff's alpha for nominal, ordinal and interval judgments, and the sums per cluster that its interval needs.

Alpha is 1 - observed / expected disagreement, each a mean squared distance over pairs of judgments: of a unit, and of all
units. A squared difference needs no pairs, as sums and sums of squares give it. Ordinal distances are differences, too: the
distance of two values is the number of judgments between their middles in the marginal distribution, so with each value
replaced by its place there (the judgments below it and half of its own) ordinal alpha is interval alpha. No product of
values with values is formed; the places come from one window over the distinct values.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quorum.operators.running import join_null_safe

LEVELS = ("nominal", "ordinal", "interval")
#: What ``alpha`` sums up.
SUMS = ("units", "judgments", "within", "total", "squares")


def _counts(judgments: DataFrame, unit: Sequence[str], value: str, by: Sequence[str]) -> DataFrame:
    """(by, unit, value, n, m): how often a unit of m judgments, two or more, has a value."""
    keys = [*by, *unit]
    counts = judgments.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).alias("value")).agg(F.count("*").alias("n"))
    units = counts.groupBy(*keys).agg(F.sum("n").alias("m")).where(F.col("m") >= 2)
    return join_null_safe(counts, units, keys)


def _placed(counts: DataFrame, by: Sequence[str]) -> DataFrame:
    """The counts with x, the value's place in the marginal distribution, between 0 and 1."""
    values = counts.groupBy(*by, "value").agg(F.sum("n").alias("all"))
    below = Window.partitionBy(*by).orderBy("value").rowsBetween(Window.unboundedPreceding, -1)  # a row for each distinct value
    place = (F.coalesce(F.sum("all").over(below), F.lit(0)) + F.col("all") / 2) / F.sum("all").over(Window.partitionBy(*by))
    return join_null_safe(counts, values.select(*by, "value", place.alias("x")), [*by, "value"])


def alpha_sums(judgments: DataFrame, unit: Sequence[str], value: str, by: Sequence[str] = (), level: str = "interval", cluster: str | None = None) -> DataFrame:
    """(by, cluster, SUMS) over units with two judgments or more: sums from which ``alpha`` follows.

    Nominal values give a total for each value instead of moments, so they have no form here that clusters could sum up by
    themselves: use ``nominal_sums``. The places of ordinal values are those of all judgments.
    """
    if level not in LEVELS[1:]:
        raise ValueError(f"the level must be one of {LEVELS[1:]}")
    by, unit = list(by), [*unit, *([cluster] if cluster else [])]
    counts = _counts(judgments, unit, value, by)
    counts = _placed(counts, by) if level == "ordinal" else counts.withColumn("x", F.col("value").cast("double"))
    n, x = F.col("n"), F.col("x")
    units = counts.groupBy(*by, *unit).agg(F.first("m").alias("m"), F.sum(n * x).alias("total"), F.sum(n * x * x).alias("squares"))
    within = F.greatest(F.col("m") * F.col("squares") - F.col("total") * F.col("total"), F.lit(0.0)) / (F.col("m") - 1)
    return units.groupBy(*by, *([cluster] if cluster else [])).agg(
        F.count("*").cast("double").alias("units"), F.sum("m").cast("double").alias("judgments"), F.sum(within).alias("within"), F.sum("total").alias("total"), F.sum("squares").alias("squares")
    )


def observed() -> Column:
    return 2 * F.try_divide(F.col("within"), F.col("judgments"))


def expected() -> Column:
    n = F.col("judgments")
    return 2 * F.try_divide(n * F.col("squares") - F.col("total") * F.col("total"), n * (n - 1))


def alpha() -> Column:
    """Alpha from SUMS; null where all judgments are alike."""
    return F.when(expected() > 1e-12, 1 - observed() / expected())


def krippendorff(judgments: DataFrame, unit: Sequence[str], value: str, level: str, by: Sequence[str] = ()) -> DataFrame:
    """(by, n_units, n_judgments, observed, expected, alpha) of ordinal or interval judgments."""
    rows = alpha_sums(judgments, unit, value, by, level)
    return rows.select(*by, F.col("units").cast("long").alias("n_units"), F.col("judgments").cast("long").alias("n_judgments"), observed().alias("observed"), expected().alias("expected"), alpha().alias("alpha"))


def nominal_sums(judgments: DataFrame, unit: Sequence[str], value: str, values: Sequence[str], cluster: str, by: Sequence[str] = ()) -> DataFrame:
    """(by, cluster, units, judgments, agreeing, one count for each of ``values``), for ``nominal_alpha``."""
    unit = [*unit, cluster]
    counts = _counts(judgments, unit, value, list(by))
    n, m = F.col("n"), F.col("m")
    units = counts.groupBy(*by, *unit).agg(F.first("m").alias("m"), F.sum(n * (n - 1) / (m - 1)).alias("agreeing"), *[F.sum(F.when(F.col("value") == v, n).otherwise(0)).alias(v) for v in values])
    return units.groupBy(*by, cluster).agg(F.count("*").cast("double").alias("units"), F.sum("m").cast("double").alias("judgments"), F.sum("agreeing").alias("agreeing"), *[F.sum(v).cast("double").alias(v) for v in values])


def nominal_alpha(values: Sequence[str]) -> Column:
    """Nominal alpha from ``nominal_sums``; null where all judgments are alike."""
    total = F.col("judgments")
    pairs = [F.col(v) * (F.col(v) - 1) for v in values]
    chance = F.try_divide(sum(pairs[1:], pairs[0]), total * (total - 1))
    return F.try_divide(F.try_divide(F.col("agreeing"), total) - chance, 1 - chance)
