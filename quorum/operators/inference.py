"""One inference engine for all contrasts: cluster-robust t, cluster bootstrap and cluster sign-flip test.

Items are summed up by cluster first, so that everything after works on (by, cluster, total, size). The closed-form
parts are DataFrame aggregations. Resampling draws counter-based random numbers: each depends on nothing but the seed,
the draw and the cluster's name or place, so results are the same on any partitioning and no task sees a whole contrast.
Only sums by draw are shuffled.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quorum.functions import distributions
from quorum.functions.ids import hash_number, mixed_numbers
from quorum.functions.recode import settled

ALTERNATIVES = ("two-sided", "greater", "less")
#: Up to this many clusters all sign assignments are enumerated.
ENUMERATE = 13
#: Clusters whose totals a task holds at a time, and numbers that it draws at a time.
BLOCK_CLUSTERS, DRAWN = 4_096, 2_000_000
#: Signs that one hash gives.
SIGN_BITS = 48
#: Clusters below which intervals are unreliable, and below which the analytic interval is the primary one.
FEW_CLUSTERS, ANALYTIC_BELOW = 20, 50


def cluster_totals(items: DataFrame, by: Sequence[str], value: str = "d") -> DataFrame:
    """(by, cluster, total, size) of the items with a value."""
    checked = F.when(F.isnan(value) | (F.abs(F.col(value)) == float("inf")), F.raise_error(F.lit("item values must be finite"))).otherwise(F.col(value))
    rows = items.where(F.col(value).isNotNull())
    return rows.groupBy(*by, "cluster").agg(F.sum(checked).alias("total"), F.count("*").alias("size"), F.min(value).alias("low"), F.max(value).alias("high"))


def cluster_moments(totals: DataFrame, by: Sequence[str]) -> DataFrame:
    """(by, n_items, n_clusters, estimate, squares, degenerate, cluster_sizes) from cluster totals, in one aggregation.

    Clusters of one size are summed up first, so that a contrast's row is made from its distinct sizes: their number is
    that of the map cluster_sizes, at most the root of twice the items. ``squares`` is the sum of the clusters' squared
    residuals, from the totals' variance within a size and the sizes' means.
    """
    alike = totals.groupBy(*by, "size").agg(
        F.count("*").alias("n"), F.sum("total").alias("total"), F.avg("total").alias("mean"), (F.count("*") * F.var_pop("total")).alias("within"), F.min("low").alias("low"), F.max("high").alias("high")
    )
    rows = alike.groupBy(*by).agg(
        F.sum(F.col("n") * F.col("size")).alias("n_items"),
        F.coalesce(F.sum("n"), F.lit(0)).alias("n_clusters"),
        (F.sum("total") / F.sum(F.col("n") * F.col("size"))).alias("estimate"),
        (settled(F.min("low")) == settled(F.max("high"))).alias("degenerate"),
        F.sort_array(F.collect_list(F.struct("size", "n", "mean", "within"))).alias("sizes"),
    )
    residuals = F.aggregate("sizes", F.lit(0.0), lambda q, x: q + x["within"] + x["n"] * F.pow(x["mean"] - x["size"] * F.col("estimate"), 2))
    sizes = F.map_from_entries(F.transform("sizes", lambda x: F.struct(x["size"], x["n"])))
    return rows.select(*by, "n_items", "n_clusters", "estimate", residuals.alias("squares"), "degenerate", sizes.alias("cluster_sizes"))


def with_robust_error(moments: DataFrame) -> DataFrame:
    """Adds se, t_stat and df; se and t are NaN for one cluster."""
    c, nan = F.col("n_clusters"), F.lit(float("nan"))
    se = F.when(c > 1, F.sqrt(F.try_divide(c, c - 1) * F.col("squares")) / F.col("n_items")).otherwise(nan)
    estimate = F.col("estimate")
    t = F.when(F.col("se") > 0, F.try_divide(estimate, F.col("se"))).when(estimate == 0, 0.0).otherwise(F.signum(estimate) * float("inf"))
    return moments.withColumn("se", se).withColumn("t_stat", F.when(F.isnan("se"), nan).otherwise(t)).withColumn("df", c - 1)


def cluster_robust(totals: DataFrame, by: Sequence[str]) -> DataFrame:
    """(by, n_items, n_clusters, estimate, se, t_stat, df, degenerate) from cluster totals."""
    return with_robust_error(cluster_moments(totals, by)).select(*by, "n_items", "n_clusters", "estimate", "se", "t_stat", "df", "degenerate")


def with_t_interval(rows: DataFrame, alpha: float = 0.05, alternative: str = "two-sided", power: float = 0.8) -> DataFrame:
    """Adds ci_low, ci_high (always two-sided), p_value and mde (achieved at ``power``) by Student's t."""
    if alternative not in ALTERNATIVES:
        raise ValueError(f"the alternative must be one of {ALTERNATIVES}")

    @F.pandas_udf("ci_low double, ci_high double, p_value double, mde double")
    def interval(estimate: pd.Series, se: pd.Series, t: pd.Series, df: pd.Series) -> pd.DataFrame:
        out = []
        for e, s, x, k in zip(estimate, se, t, df):
            if k < 1 or s != s:
                out.append((np.nan,) * 4)
                continue
            edge = distributions.t_quantile(1 - alpha / 2, int(k))
            if s == 0:
                p = float(e == 0) if alternative == "two-sided" else float(e <= 0) if alternative == "greater" else float(e >= 0)
            elif alternative == "two-sided":
                p = 2 * distributions.t_sf(abs(x), int(k))
            else:
                p = distributions.t_sf(x if alternative == "greater" else -x, int(k))
            out.append((e - edge * s, e + edge * s, p, (edge + distributions.t_quantile(power, int(k))) * s))
        return pd.DataFrame(out, columns=["ci_low", "ci_high", "p_value", "mde"])

    rows = rows.withColumn("t", interval("estimate", "se", "t_stat", "df"))
    return rows.select(*[c for c in rows.columns if c != "t"], "t.*")


def cluster_sizes(totals: DataFrame, by: Sequence[str]) -> DataFrame:
    """(by, size, n_clusters)."""
    return totals.groupBy(*by, "size").agg(F.count("*").alias("n_clusters"))


def _numbered(totals: DataFrame, by: Sequence[str]) -> DataFrame:
    """Adds _place, that of each cluster by the MD5 of its name from 0, and _clusters, their number.

    Clusters are ranked among those whose MD5 begins alike, after the counts of those before them, so that no task sorts
    all clusters of a contrast.
    """
    by = list(by)
    rows = totals.withColumn("_md5", F.md5("cluster")).withColumn("_bucket", F.substring("_md5", 1, 3))
    counts = rows.groupBy(*by, "_bucket").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*by).orderBy("_bucket")  # 4,096 buckets at most
    counts = counts.withColumn("_before", F.coalesce(F.sum("_n").over(before.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).withColumn("_clusters", F.sum("_n").over(Window.partitionBy(*by)))
    within = F.row_number().over(Window.partitionBy(*by, "_bucket").orderBy("_md5", "cluster"))
    return rows.join(counts, [*by, "_bucket"]).withColumn("_place", within - 1 + F.col("_before")).drop("_md5", "_bucket", "_n", "_before")


def block_draws(c: int, block: int, held: int, n_boot: int, seed: int) -> np.ndarray:
    """How many of the c draws of each replicate fall into a block of ``held`` clusters: a multinomial law, split in halves.

    Every block on a half's way down sees the same split, as it is drawn from the seed and the half alone.
    """
    low, high = 0, -(-c // held)
    draws = np.full(n_boot, c, np.int64)
    while high - low > 1:
        middle = (low + high) // 2
        first = (middle - low) * held
        whole = min(high * held, c) - low * held
        left = np.random.default_rng([seed, low, high]).binomial(draws, first / whole)
        low, high, draws = (low, middle, left) if block < middle else (middle, high, draws - left)
    return draws


def _block_sums(total: np.ndarray, size: np.ndarray, c: int, block: int, held: int, n_boot: int, seed: int) -> pd.DataFrame:
    """(replicate, sum, items) of the clusters of a block, sorted by their place, that each replicate draws."""
    draws = block_draws(c, block, held, n_boot, seed)
    ends = np.cumsum(draws)
    totals, sizes = np.zeros(n_boot), np.zeros(n_boot, np.int64)
    first = 0
    while first < n_boot:
        last = max(first + 1, int(np.searchsorted(ends, (ends[first - 1] if first else 0) + DRAWN, side="right")))
        own = np.arange(first, last)
        b = np.repeat(own, draws[first:last])
        slot = np.arange(len(b)) - np.repeat(np.cumsum(draws[first:last]) - draws[first:last], draws[first:last])
        at = mixed_numbers(seed, block, b, slot) % len(total)
        totals[first:last] = np.bincount(b - first, total[at], last - first)
        sizes[first:last] = np.bincount(b - first, size[at], last - first).astype(np.int64)
        first = last
    return pd.DataFrame({"_b": np.arange(n_boot), "_sum": totals, "_drawn": sizes})


def bootstrap(totals: DataFrame, by: Sequence[str], seed: int | Column, alpha: float = 0.05, n_boot: int = 10_000, most: int | None = None) -> DataFrame:
    """(by, boot_low, boot_high, boot_se): cluster bootstrap, in blocks of BLOCK_CLUSTERS clusters.

    A replicate draws as many clusters as there are, with replacement; a block's share of them follows the multinomial
    law, and within a block each draw is a hash of seed, block, replicate and slot. Blocks give sums by replicate.
    ``most`` is the greatest number of clusters of a contrast, where it is known: contrasts of one block are numbered in
    their task, which gives the same draws without a shuffle for the numbers.
    """
    if n_boot < 2:
        raise ValueError("at least two bootstrap draws are needed")
    by, held = list(by), BLOCK_CLUSTERS
    if most is not None and most <= held:
        rows = totals.withColumns({"_block": F.lit(0).cast("long"), "_place": F.md5("cluster"), "_clusters": F.lit(None).cast("long")})
    else:
        rows = _numbered(totals, by).withColumn("_block", (F.col("_place") / held).cast("long"))
    rows = rows.select(*by, "_block", "_place", "_clusters", F.col("total").alias("_total"), F.col("size").alias("_size"), _seed(seed).alias("_seed"))
    schema = ", ".join([f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in by] + ["_b long", "_sum double", "_drawn long"])

    def sums(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("_place")
        one = part.iloc[0]
        c = len(part) if pd.isna(one["_clusters"]) else int(one["_clusters"])
        out = _block_sums(part["_total"].to_numpy(float), part["_size"].to_numpy(np.int64), c, int(one["_block"]), held, n_boot, int(one["_seed"]))
        return pd.concat([pd.DataFrame({c: [one[c]] * len(out) for c in by}), out], axis=1)

    drawn = rows.groupBy(*by, "_block").applyInPandas(sums, schema)
    means = drawn.groupBy(*by, "_b").agg((F.sum("_sum") / F.sum("_drawn")).alias("_mean"))
    edges = means.groupBy(*by).agg(F.percentile("_mean", F.array(F.lit(alpha / 2), F.lit(1 - alpha / 2))).alias("edges"), F.stddev_samp("_mean").alias("boot_se"))
    return edges.select(*by, F.get("edges", F.lit(0)).alias("boot_low"), F.get("edges", F.lit(1)).alias("boot_high"), "boot_se")


def _seed(seed: int | Column) -> Column:
    return (seed if isinstance(seed, Column) else F.lit(seed)).cast("long")


def _hit(drawn: Column, seen: Column, alternative: str) -> Column:
    slack = 1e-9  # sums in another order differ in their last digits
    return F.abs(drawn) >= F.abs(seen) - slack if alternative == "two-sided" else drawn >= seen - slack if alternative == "greater" else drawn <= seen + slack


def sign_flip_by_hash(totals: DataFrame, by: Sequence[str], seed: int | Column, n_perm: int = 10_000, alternative: str = "two-sided") -> DataFrame:
    """(by, flip_p): Monte Carlo sign flips; a hash of seed and cluster gives the signs of SIGN_BITS draws."""
    if n_perm < 1:
        raise ValueError("at least one sign draw is needed")
    by = list(by)
    chunks = totals.select(*by, "cluster", "total", _seed(seed).alias("_seed"), F.explode(F.sequence(F.lit(0), F.lit((n_perm - 1) // SIGN_BITS))).alias("_chunk"))
    bits = chunks.select(*by, "total", "_chunk", hash_number(F.col("_seed"), "flip", F.col("_chunk"), F.col("cluster")).alias("_bits"))
    ends = F.least(F.lit(SIGN_BITS), F.lit(n_perm) - F.col("_chunk") * SIGN_BITS) - 1
    signs = bits.select(*by, "total", "_chunk", "_bits", F.explode(F.sequence(F.lit(0), ends)).alias("_bit"))
    sign = 2 * F.getbit("_bits", F.col("_bit")).cast("int") - 1
    sums = signs.groupBy(*by, "_chunk", "_bit").agg(F.sum(F.col("total") * sign).alias("drawn"), F.sum("total").alias("seen"))
    return sums.groupBy(*by).agg(((F.count_if(_hit(F.col("drawn"), F.col("seen"), alternative)) + 1) / F.lit(n_perm + 1)).alias("flip_p"))


def sign_flips(totals: DataFrame, by: Sequence[str], seed: int | Column, n_perm: int = 10_000, alternative: str = "two-sided", least: int = 0) -> DataFrame:
    """(by, flip_p, flip_method): exact for contrasts with at most ENUMERATE clusters, Monte Carlo for the others.

    ``least`` is the smallest number of clusters of a contrast, where it is known.
    """
    by = list(by)
    if least > ENUMERATE:
        return sign_flip_by_hash(totals, by, seed, n_perm, alternative).withColumn("flip_method", F.lit("sign-flip-mc"))
    many = totals.groupBy(*by).agg(F.count("*").alias("_c")).where(F.col("_c") > ENUMERATE).select(*by)
    exact = sign_flip_exact(totals, by, alternative).select(*by, "flip_p", F.lit("sign-flip-exact").alias("flip_method"))
    return exact.unionByName(sign_flip_by_hash(totals.join(many, by, "left_semi"), by, seed, n_perm, alternative).withColumn("flip_method", F.lit("sign-flip-mc")))


def sign_flip_exact(totals: DataFrame, by: Sequence[str], alternative: str = "two-sided") -> DataFrame:
    """(by, n_clusters, flip_p) over all sign assignments of contrasts with at most ENUMERATE clusters."""
    by = list(by)
    small = totals.groupBy(*by).agg(F.count("*").alias("n_clusters")).where(F.col("n_clusters") <= ENUMERATE)
    lists = totals.join(small, by).groupBy(*by, "n_clusters").agg(F.sort_array(F.collect_list(F.struct("cluster", "total"))).alias("clusters"))
    rows = lists.withColumn("bits", F.explode(F.sequence(F.lit(0), F.pow(F.lit(2), F.col("n_clusters")).cast("int") - 1)))
    sign = lambda i: F.when(F.get(F.reverse(F.split(F.lpad(F.bin("bits"), ENUMERATE, "0"), "")), i) == "1", 1.0).otherwise(-1.0)
    flipped = F.transform("clusters", lambda x, i: x["total"] * sign(i))
    add = lambda xs: F.aggregate(xs, F.lit(0.0), lambda a, x: a + x)
    rows = rows.select(*by, "n_clusters", add(flipped).alias("drawn"), add(F.transform("clusters", lambda x: x["total"])).alias("seen"))
    return rows.groupBy(*by, "n_clusters").agg(F.avg(_hit(F.col("drawn"), F.col("seen"), alternative).cast("double")).alias("flip_p"))


def mcnemar(rows: DataFrame, n_pos: str, n_neg: str, name: str = "mcnemar_p") -> DataFrame:
    """Adds the exact McNemar p-value of two columns of counts."""

    @F.pandas_udf("double")
    def p_value(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([distributions.mcnemar_exact(int(x), int(y)) if x == x and y == y else np.nan for x, y in zip(a, b)])

    return rows.withColumn(name, p_value(F.col(n_pos), F.col(n_neg)))


def primary_interval(n_clusters: Column, analytic_low: Column) -> Column:
    """Which interval leads a report: the analytic one below ANALYTIC_BELOW clusters, if there is one."""
    return F.when((n_clusters < ANALYTIC_BELOW) & ~F.isnan(analytic_low), "analytic").otherwise("bootstrap")


#: Measured coverage of nominal 95% intervals by number of clusters (bootstrap, analytic).
COVERAGE = ((20, 0.9253, 0.9494), (30, 0.9348, 0.9502), (50, 0.9415, 0.9505), (200, 0.9472, 0.95))


def coverage_disclosure(n_clusters: Column) -> Column:
    """What was measured at the largest studied number of clusters that the run reaches."""
    text = F.lit("no coverage was measured for so few clusters")
    for c, boot, analytic in COVERAGE:
        text = F.when(n_clusters >= c, F.lit(f"measured coverage at {c} clusters: bootstrap {boot:.2%}, analytic {analytic:.2%}; this run's own was not measured")).otherwise(text)
    return text
