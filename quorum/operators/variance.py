"""Judge noise and variance components."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quorum.operators.running import join_null_safe


def judge_variance(judgments: DataFrame, value: str, within: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """(by, sigma2_j, n_used, df): pooled variance within the groups ``within`` that have two calls or more; null without any."""
    groups = judgments.groupBy(*by, *within).agg(F.count(value).alias("n"), F.var_samp(value).alias("v")).where(F.col("n") >= 2)
    out = groups.groupBy(*by).agg(F.sum(F.col("v") * (F.col("n") - 1)).alias("squares"), F.count("*").alias("n_used"), F.sum(F.col("n") - 1).alias("df"))
    return out.select(*by, F.try_divide("squares", "df").alias("sigma2_j"), "n_used", F.coalesce("df", F.lit(0)).alias("df"))


def within_item_variance(r: Column, m: Column, sigma2_j: Column, sigma2_g: Column | None = None, pairwise: bool = False) -> Column:
    """Variance of an item's difference from r responses of m calls each."""
    value = (F.lit(0.0) if sigma2_g is None else sigma2_g / r) + sigma2_j / (r * m)
    return value if pairwise else 2 * value


def variance_components(items: DataFrame, within: str, by: Sequence[str] = (), value: str = "d") -> DataFrame:
    """(by, var_d, sigma2_w, sigma2_b, icc, truncated) from items with their within-item variance; one item is an error."""
    out = items.groupBy(*by).agg(F.count(value).alias("n"), F.var_samp(value).alias("var_d"), F.avg(within).alias("sigma2_w"))
    raw = F.when(F.col("n") < 2, F.raise_error(F.lit("variance components need two items or more"))).otherwise(F.col("var_d") - F.col("sigma2_w"))
    out = out.withColumn("raw", raw.cast("double")).withColumn("sigma2_b", F.greatest(F.col("raw"), F.lit(0.0)))
    icc = F.coalesce(F.try_divide(F.col("sigma2_b"), F.col("sigma2_b") + F.col("sigma2_w")), F.lit(0.0))
    return out.select(*by, "var_d", "sigma2_w", "sigma2_b", icc.alias("icc"), (F.col("raw") < 0).alias("truncated"))


def nested_variance(judgments: DataFrame, value: str, group: Sequence[str], response: str, by: Sequence[str] = ()) -> DataFrame:
    """(by, sigma2_j, df_j, sigma2_g, df_g, weight, identified, truncated_g): calls within responses within groups, unbalanced.

    A two-level analysis of variance by expected mean squares. With m calls for a response and N for its group, the mean
    square of responses has the expectation sigma2_j + weight * sigma2_g, weight = sum over groups of
    (N - sum m^2 / N) / df_g and df_g = sum over groups of (responses - 1); sigma2_j is pooled within responses. The
    generation variance sigma2_g is identified where some group has two responses and some response two calls; elsewhere it
    is null. A negative estimate becomes 0 and shows as truncated.
    """
    by, group = list(by), list(group)
    responses = judgments.where(F.col(value).isNotNull()).groupBy(*by, *group, response).agg(F.count("*").alias("m"), F.avg(F.col(value).cast("double")).alias("y"), F.var_samp(value).alias("v"))
    m, y = F.col("m"), F.col("y")
    groups = responses.groupBy(*by, *group).agg((F.sum(m * y) / F.sum(m)).alias("mean"), F.count("*").alias("r"), F.sum("m").alias("n"), F.sum(m * m).alias("m2"))
    spread = join_null_safe(responses, groups.select(*by, *group, "mean"), [*by, *group]).groupBy(*by).agg(
        F.sum(m * F.pow(y - F.col("mean"), 2)).alias("squares_g"), F.sum(F.when(m >= 2, F.col("v") * (m - 1))).alias("squares_j"), F.sum(m - 1).alias("df_j")
    )
    sizes = groups.groupBy(*by).agg(F.sum(F.col("r") - 1).alias("df_g"), F.sum(F.col("n") - F.col("m2") / F.col("n")).alias("effective"))
    rows = join_null_safe(spread, sizes, by)
    sigma2_j, weight = F.try_divide("squares_j", "df_j"), F.try_divide("effective", "df_g")
    rows = rows.select(*by, F.when(F.col("df_j") > 0, sigma2_j).alias("sigma2_j"), "df_j", "df_g", F.when(F.col("df_g") > 0, weight).alias("weight"), F.try_divide("squares_g", "df_g").alias("square"))
    raw = F.when((F.col("df_g") > 0) & (F.col("df_j") > 0), (F.col("square") - F.col("sigma2_j")) / F.col("weight"))
    return rows.select(*by, "sigma2_j", "df_j", F.greatest(raw, F.when(raw.isNotNull(), 0.0)).alias("sigma2_g"), "df_g", "weight", raw.isNotNull().alias("identified"), F.coalesce(raw < 0, F.lit(False)).alias("truncated_g"))


def item_noise(judgments: DataFrame, value: str, sides: Sequence[str], components: DataFrame, by: Sequence[str] = (), side: str = "variant_id", item: str = "item_id", response: str = "response_id") -> DataFrame:
    """(by, item, within): the noise in the difference of an item's two sides, each the mean of its responses' means.

    A side of r responses has sigma2_g / r + sigma2_j * (sum over them of 1 / m) / r^2; where sigma2_g isn't identified
    its part is left out, and without sigma2_j the noise is null. Items without one of the sides have no row.
    """
    by, names = list(by), list(sides)
    rows = judgments.where(F.col(value).isNotNull() & F.col(side).isin(names)).groupBy(*by, item, side, response).agg(F.count("*").alias("m"))
    rows = rows.groupBy(*by, item, side).agg(F.count("*").alias("r"), F.sum(1 / F.col("m")).alias("h"))
    known = components.select(*by, "sigma2_j", "sigma2_g")
    rows = join_null_safe(rows, known, by)
    r = F.col("r")
    noise = F.coalesce(F.col("sigma2_g"), F.lit(0.0)) / r + F.col("sigma2_j") * F.col("h") / (r * r)
    return rows.groupBy(*by, item).agg(F.sum(noise).alias("within"), F.count("*").alias("n_sides")).where(F.col("n_sides") == len(names)).drop("n_sides")
