"""Confidence sequences: intervals of a mean that hold at every run at once, so that one may look at each and stop at any.

The interval is the predictable plug-in empirical-Bernstein confidence sequence for bounded observations: I. Waudby-Smith
and A. Ramdas, "Estimating means of bounded random variables by betting", Journal of the Royal Statistical Society B 86
(2024), arXiv:2010.09686, Theorem 2. With X_t scaled to [0, 1], m_t = (1/2 + sum X_i) / (t + 1),
s_t = (1/4 + sum (X_i - m_i)^2) / (t + 1), v_t = 4 (X_t - m_(t-1))^2 and psi(l) = (-log(1 - l) - l) / 4:

    sum l_i X_i / sum l_i  +-  (log(2 / alpha) + sum v_i psi(l_i)) / sum l_i.

The weights l_t are known before X_t: ``anytime`` takes min(1/2, sqrt(2 log(2/alpha) / (s_(t-1) t log(1 + t)))), and ``horizon``,
narrowest when ``horizon`` observations are in, min(1/2, sqrt(2 log(2/alpha) / (s_(t-1) horizon))). Both hold at all times; which is
wanted depends on how runs are looked at, so neither is a default.

An observation is a cluster's mean in a run. Clusters of a run come in the order of the MD5 of their names, which is blind
to their values; runs must draw their clusters anew, as a cluster that comes back would be counted as independent.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quorum.operators.running import earlier_sums

METHODS = ("anytime", "horizon")
#: No weight is above this.
MOST_WEIGHT = 0.5
#: Clusters of a run are dealt into 16 to this power of buckets.
BUCKET_DIGITS = 3


def cluster_means(rows: DataFrame, by: Sequence[str], run: str, value: str, cluster: str = "cluster") -> DataFrame:
    """(by, run, cluster, x): each cluster's mean in each run; rows without a run, a cluster or a value are left out."""
    rows = rows.where(F.col(run).isNotNull() & F.col(cluster).isNotNull() & F.col(value).isNotNull())
    return rows.groupBy(*by, F.col(run).alias("run"), F.col(cluster).cast("string").alias("cluster")).agg(F.avg(value).alias("x"))


def confidence_sequence(units: DataFrame, by: Sequence[str], method: str, low: float, high: float, alpha: float = 0.05, horizon: int | None = None) -> DataFrame:
    """(by, run, n, estimate, cs_low, cs_high, all_low, all_high) at the end of each run, from the (by, run, cluster, x) of all runs.

    n counts the observations so far; estimate is the weighted mean in the interval's middle. all_low and all_high are the
    interval's intersection with those of earlier runs, which holds as well (all_low > all_high shows that the mean has
    moved). A value outside [low, high] is an error.
    """
    if method not in METHODS:
        raise ValueError(f"the method must be one of {METHODS}")
    if (method == "horizon") != (horizon is not None) or horizon is not None and horizon < 1:
        raise ValueError("a horizon of at least one observation goes with the method 'horizon', and with no other")
    if not low < high or not 0 < alpha < 1:
        raise ValueError("low must be below high, and alpha between 0 and 1")
    by, edge = list(by), math.log(2 / alpha)
    x = (F.col("x") - low) / (high - low)
    slack = 1e-9  # means of values at the bounds
    x = F.when((x >= -slack) & (x <= 1 + slack), x).otherwise(F.raise_error(F.concat(F.lit(f"an observation must be between {low} and {high}, not "), F.col("x").cast("string"))))
    rows = units.withColumns({"_x": x.cast("double"), "_md5": F.md5("cluster")}).withColumn("_bucket", F.substring("_md5", 1, BUCKET_DIGITS))
    place = ["run", "_bucket"], ["_md5", "cluster"]
    rows = earlier_sums(rows, by, *place, {"_n": F.lit(1), "_sum": F.col("_x")})
    t, before = F.col("_n") + 1, (F.lit(0.5) + F.col("_sum")) / (F.col("_n") + 1)
    after = (F.lit(0.5) + F.col("_sum") + F.col("_x")) / (F.col("_n") + 2)
    rows = rows.withColumns({"_before": before, "_square": F.pow(F.col("_x") - after, 2)})
    rows = earlier_sums(rows, by, *place, {"_squares": F.col("_square")})
    spread = (F.lit(0.25) + F.col("_squares")) / t
    pace = F.lit(horizon) if method == "horizon" else t * F.log(1 + t)
    rows = rows.withColumn("_l", F.least(F.lit(MOST_WEIGHT), F.sqrt(F.lit(2 * edge) / (spread * pace))))
    psi = (-F.log(1 - F.col("_l")) - F.col("_l")) / 4
    runs = rows.groupBy(*by, "run").agg(F.count("*").alias("_n"), F.sum("_l").alias("_l"), F.sum(F.col("_l") * F.col("_x")).alias("_lx"), F.sum(4 * F.pow(F.col("_x") - F.col("_before"), 2) * psi).alias("_v"))
    so_far = Window.partitionBy(*by).orderBy("run").rowsBetween(Window.unboundedPreceding, 0)  # a row a run
    runs = runs.withColumns({c: F.sum(c).over(so_far) for c in ("_n", "_l", "_lx", "_v")})
    middle, half = F.col("_lx") / F.col("_l"), (F.lit(edge) + F.col("_v")) / F.col("_l")
    scaled = lambda c: F.lit(low) + F.lit(high - low) * c
    runs = runs.select(*by, "run", F.col("_n").alias("n"), scaled(middle).alias("estimate"), scaled(F.greatest(middle - half, F.lit(0.0))).alias("cs_low"), scaled(F.least(middle + half, F.lit(1.0))).alias("cs_high"))
    return runs.withColumns({"all_low": F.max("cs_low").over(so_far), "all_high": F.min("cs_high").over(so_far)})
