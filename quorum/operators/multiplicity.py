"""Adjusted p-values within families of contrasts, by window functions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quorum.functions.ids import hash_number


def adjusted(rows: DataFrame, p: str, order: str, family: Sequence[str] = ()) -> DataFrame:
    """Adds ``holm`` and ``bh`` to rows with p-values; ``order`` breaks ties. A p-value outside 0..1 is an error."""
    family = list(family)
    value = F.when(F.col(p).isNotNull() & ~F.isnan(p) & F.col(p).between(0, 1), F.col(p)).otherwise(F.raise_error(F.lit("p-values must lie between 0 and 1")))
    rows = rows.withColumn("_p", value)
    sizes = rows.groupBy(*family).agg(F.count("*").alias("_m")) if family else None
    rows = rows.join(sizes, family) if family else rows.withColumn("_m", F.count("*").over(Window.partitionBy()))
    ranked = Window.partitionBy(*family).orderBy("_p", order)
    rows = rows.withColumn("_rank", F.row_number().over(ranked))
    up, down = ranked.rowsBetween(Window.unboundedPreceding, 0), ranked.rowsBetween(0, Window.unboundedFollowing)
    holm = F.least(F.lit(1.0), F.max((F.col("_m") - F.col("_rank") + 1) * F.col("_p")).over(up))
    bh = F.least(F.lit(1.0), F.min(F.col("_p") * F.col("_m") / F.col("_rank")).over(down))
    return rows.withColumn("holm", holm).withColumn("bh", bh).drop("_p", "_m", "_rank")


def max_t(totals: DataFrame, by: Sequence[str], seed: int, n_perm: int = 1_000) -> DataFrame:
    """(by, t_stat, max_t_p): p-values adjusted by the largest statistic over contrasts, from cluster totals.

    A cluster has one sign in each draw for all contrasts, so their dependence is kept. Statistics are the totals'
    sum over the root of their sum of squares, which no sign changes.
    """
    by = list(by)
    signs = totals.select(*by, "cluster", "total", F.explode(F.sequence(F.lit(0), F.lit(n_perm - 1))).alias("b"))
    sign = 2 * (hash_number(seed, "max-t", F.col("b"), F.col("cluster")) % 2) - 1
    root = F.sqrt(F.sum(F.col("total") * F.col("total")))
    drawn = signs.groupBy(*by, "b").agg(F.coalesce(F.try_divide(F.abs(F.sum(F.col("total") * sign)), root), F.lit(0.0)).alias("t"))
    most = drawn.groupBy("b").agg(F.max("t").alias("most"))
    seen = totals.groupBy(*by).agg(F.coalesce(F.try_divide(F.sum("total"), root), F.lit(0.0)).alias("t_stat"))
    # contrasts meet draws on the draw's number, which each contrast lists
    pairs = seen.withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(n_perm - 1)))).join(most, "b")
    hits = F.count_if(F.col("most") >= F.abs("t_stat") - 1e-9)
    return pairs.groupBy(*by, "t_stat").agg(((hits + 1) / F.lit(n_perm + 1)).alias("max_t_p"))
