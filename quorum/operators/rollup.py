"""Estimates and standard errors at every level of grouping from one aggregation of cluster totals."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


def rolled_up(totals: DataFrame, columns: Sequence[str], sets: Sequence[Sequence[str]]) -> DataFrame:
    """(columns, level, n_items, n_clusters, estimate, se, df) for each of the grouping sets, from (columns, cluster, total, size).

    A column that a set leaves out is null, and ``level`` names the columns that it has, so a null of the data is told from a
    total. A cluster may lie in several groups: its totals are added up for each set before clusters are counted. The squares
    are sums over clusters of total^2, total * size and size^2, so one pass of grouping sets serves all sets, and none needs
    the estimate first. One cluster has no standard error.
    """
    columns, sets = list(columns), [list(s) for s in sets]
    unknown = {c for s in sets for c in s} - set(columns)
    if unknown or not sets:
        raise ValueError(f"grouping sets must name some of {columns}, not {sorted(unknown)}")
    own = totals.select(*[F.col(c) for c in columns], F.col("cluster").alias("_cluster"), F.col("total").cast("double").alias("total"), F.col("size").cast("long").alias("size"))
    parts = own.groupingSets([[*[F.col(c) for c in s], F.col("_cluster")] for s in sets], *[F.col(c) for c in columns], F.col("_cluster"))
    bits = F.shiftright(F.grouping_id(*[F.col(c) for c in columns], F.col("_cluster")), 1)  # the cluster is in every set
    parts = parts.agg(bits.alias("_set"), F.sum("total").alias("total"), F.sum("size").alias("size"))
    total, size = F.col("total"), F.col("size").cast("double")
    sums = parts.groupBy(*columns, "_set").agg(
        F.sum("size").alias("n_items"), F.count("*").alias("n_clusters"), F.sum(total).alias("t"), F.sum(total * total).alias("tt"), F.sum(total * size).alias("ts"), F.sum(size * size).alias("ss")
    )
    estimate, c = F.col("t") / F.col("n_items"), F.col("n_clusters")
    squares = F.greatest(F.col("tt") - 2 * estimate * F.col("ts") + estimate * estimate * F.col("ss"), F.lit(0.0))
    se = F.when(c > 1, F.sqrt(F.try_divide(c, c - 1) * squares) / F.col("n_items"))
    present = [F.when(F.getbit("_set", F.lit(len(columns) - 1 - k)) == 0, F.lit(name)) for k, name in enumerate(columns)]
    level = F.coalesce(F.nullif(F.concat_ws(", ", *present), F.lit("")), F.lit("all")).cast(StringType())
    return sums.select(*columns, level.alias("level"), "n_items", "n_clusters", estimate.alias("estimate"), se.alias("se"), (c - 1).alias("df"))
