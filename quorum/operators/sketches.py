"""Sketches of a run's values that are kept as columns and merged across runs, where exact quantiles would sort every value.

A quantile sketch (KLL) holds a few thousand values however many it was given; a member sketch (theta) holds the least hashes
of what it was given, so that sketches also meet: how many members two runs share. Both are merged without the rows, in
partial aggregations, so a group of any size is no single task's. While a group has fewer values than ``QUANTILE_K``, and
fewer members than ``2 ** MEMBER_LOG_K``, the answers are exact; beyond, they lie within the errors below, and differ between
runs of the same job within them, as the sketch draws what it drops.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

QUANTILE_K, MEMBER_LOG_K = 800, 12


def rank_error(k: int = QUANTILE_K) -> float:
    """By how much the rank of an estimated quantile is off, as a share of all values, in 1 of 100 cases."""
    return 2.296 / k**0.9723  # fixed values: the error's published fit


def member_error(log_k: int = MEMBER_LOG_K) -> float:
    """The relative standard error of a number of members."""
    return (2**log_k - 1) ** -0.5


def sketched(rows: DataFrame, by: Sequence[str], value: str, member: str, k: int = QUANTILE_K, log_k: int = MEMBER_LOG_K) -> DataFrame:
    """(by, n, quantiles, members): a row for each group, to be stored; nulls and NaN are in no sketch, n counts values."""
    number = F.nullif(F.col(value).cast("double"), F.lit(float("nan")))
    return rows.groupBy(*by).agg(F.count(number).alias("n"), F.kll_sketch_agg_double(number, k).alias("quantiles"), F.theta_sketch_agg(F.col(member), log_k).alias("members"))


def merged(sketches: DataFrame, by: Sequence[str], k: int = QUANTILE_K, log_k: int = MEMBER_LOG_K) -> DataFrame:
    """(by, n, quantiles, members, n_sketches) of coarser groups, or of all."""
    return sketches.groupBy(*by).agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.kll_merge_agg_double(F.col("quantiles"), k).alias("quantiles"), F.theta_union_agg(F.col("members"), log_k).alias("members"), F.count("*").alias("n_sketches")
    )


def quantiles(sketches: DataFrame, by: Sequence[str], probabilities: Sequence[float]) -> DataFrame:
    """(by, p, value): estimated quantiles, each the least value whose rank reaches p; null for a group without values."""
    each = F.array(*[F.struct(F.lit(float(p)).alias("p"), F.when(F.col("n") > 0, F.kll_sketch_get_quantile_double("quantiles", F.lit(float(p)))).alias("value")) for p in probabilities])
    return sketches.select(*by, F.explode(each).alias("_q")).select(*by, "_q.p", "_q.value")


def counted(sketches: DataFrame, by: Sequence[str]) -> DataFrame:
    """(by, n, n_members): values, and the estimated number of different members."""
    return sketches.select(*by, "n", F.theta_sketch_estimate("members").alias("n_members"))


def shared_members(sketches: DataFrame, by: Sequence[str], run: str, following) -> DataFrame:
    """(by, run, n_members, n_kept): members of each run, and how many of them the run ``following(run)`` has again.

    Two stored sketches meet for each run; no row is read again. A run without a following one keeps none.
    """
    own = sketches.select(*by, run, "members", following(F.col(run)).alias("_next"))
    later = sketches.select(*by, F.col(run).alias("_next"), F.col("members").alias("_later"))
    kept = F.theta_sketch_estimate(F.theta_intersection("members", "_later"))
    return own.join(later, [*by, "_next"], "left").select(*by, run, F.theta_sketch_estimate("members").alias("n_members"), F.coalesce(kept, F.lit(0)).alias("n_kept"))
