"""Bootstrap intervals of statistics that aren't means, from replicate weights of clusters.

A statistic here is a function of sums over clusters: cells of a table, moments, counts. A replicate draws clusters with
replacement, so a cluster counts as often as it was drawn: its weight. Weights are drawn in blocks of clusters, by the same
law and the same numbers as the bootstrap of means, and meet the clusters' sums in a product of two matrices; what leaves a
block is one row a replicate. No judgment is ever drawn, and no task sees a whole contrast.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quorum.functions.ids import mixed_numbers
from quorum.operators import inference
from quorum.operators.inference import block_draws


def block_weights(n: int, c: int, block: int, held: int, n_boot: int, seed: int):
    """Yields (first replicate, weights by replicate and cluster) of the n clusters of a block, a bounded part at a time."""
    draws = block_draws(c, block, held, n_boot, seed)
    step = max(1, inference.DRAWN // max(n, int(draws.max(initial=1))))
    for first in range(0, n_boot, step):
        own = draws[first : first + step]
        b = np.repeat(np.arange(first, first + len(own)), own)
        slot = np.arange(len(b)) - np.repeat(np.cumsum(own) - own, own)
        at = mixed_numbers(seed, block, b, slot) % n
        yield first, np.bincount((b - first) * n + at, minlength=len(own) * n).reshape(len(own), n)


def replicate_sums(stats: DataFrame, by: Sequence[str], columns: Sequence[str], seed: int, n_boot: int = 10_000) -> DataFrame:
    """(by, replicate, columns): the columns' sums over the clusters that each replicate draws; stats has one row a cluster.

    A null in a column counts as nothing.
    """
    if n_boot < 2:
        raise ValueError("at least two bootstrap draws are needed")
    by, columns, held = list(by), list(columns), inference.BLOCK_CLUSTERS
    rows = inference._numbered(stats.select(*by, "cluster", *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in columns]), by)
    rows = rows.withColumn("_block", (F.col("_place") / held).cast("long")).drop("cluster")
    schema = ", ".join([f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in by] + ["replicate long", *[f"`{c}` double" for c in columns]])

    def sums(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("_place")
        one, values = part.iloc[0], part[columns].to_numpy(float)
        drawn = np.concatenate([weights @ values for _, weights in block_weights(len(part), int(one["_clusters"]), int(one["_block"]), held, n_boot, seed)])
        return pd.concat([pd.DataFrame({c: [one[c]] * n_boot for c in by} | {"replicate": np.arange(n_boot)}), pd.DataFrame(drawn, columns=columns)], axis=1)

    drawn = rows.groupBy(*by, "_block").applyInPandas(sums, schema)
    return drawn.groupBy(*by, "replicate").agg(*[F.sum(c).alias(c) for c in columns])


def intervals(stats: DataFrame, by: Sequence[str], columns: Sequence[str], statistics: dict[str, Column], seed: int, alpha: float = 0.05, n_boot: int = 10_000) -> DataFrame:
    """(by, statistic, n_clusters, estimate, boot_low, boot_high, boot_se, n_defined) of each statistic, an expression over summed columns.

    Replicates in which a statistic is null (none of what it divides by was drawn) are left out and show in n_defined.
    """
    by, columns = list(by), list(columns)
    each = F.explode(F.array(*[F.struct(F.lit(name).alias("statistic"), c.cast("double").alias("value")) for name, c in statistics.items()])).alias("_one")
    seen = stats.groupBy(*by).agg(F.count("*").alias("n_clusters"), *[F.sum(c).alias(c) for c in columns]).select(*by, "n_clusters", each)
    seen = seen.select(*by, "n_clusters", "_one.statistic", F.col("_one.value").alias("estimate"))
    drawn = replicate_sums(stats, by, columns, seed, n_boot).select(*by, each).select(*by, "_one.*")
    edges = drawn.groupBy(*by, "statistic").agg(F.percentile("value", F.array(F.lit(alpha / 2), F.lit(1 - alpha / 2))).alias("edges"), F.stddev_samp("value").alias("boot_se"), F.count("value").alias("n_defined"))
    rows = seen.join(edges, [*by, "statistic"])
    return rows.select(*by, "statistic", "n_clusters", "estimate", F.get("edges", F.lit(0)).alias("boot_low"), F.get("edges", F.lit(1)).alias("boot_high"), "boot_se", "n_defined")


def moments(items: DataFrame, by: Sequence[str], value: str = "d") -> DataFrame:
    """(by, cluster, n, total, squares) of the items with a value, for ``standardized``."""
    x = F.col(value)
    return items.where(x.isNotNull()).groupBy(*by, "cluster").agg(F.count("*").cast("double").alias("n"), F.sum(x).alias("total"), F.sum(x * x).alias("squares"))


def standardized() -> Column:
    """The mean over the standard deviation, from ``moments``; null where the values don't differ."""
    n, mean = F.col("n"), F.try_divide(F.col("total"), F.col("n"))
    variance = F.try_divide(F.col("squares") - n * mean * mean, n - 1)
    return F.when(variance > 1e-12, mean / F.sqrt(variance))


def kappa(values: Sequence[str], cell: Callable[[str, str], Column]) -> Column:
    """Cohen's kappa from the cells of a table, ``cell(a, b)``; null where chance agrees always."""
    add = lambda cs: sum(cs[1:], cs[0])
    n = add([cell(a, b) for a in values for b in values])
    agreement = F.try_divide(add([cell(v, v) for v in values]), n)
    chance = F.try_divide(add([add([cell(v, b) for b in values]) * add([cell(a, v) for a in values]) for v in values]), n * n)
    return F.try_divide(agreement - chance, 1 - chance)
