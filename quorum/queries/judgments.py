"""Reductions, inference, multiplicity and variance over the judgment views."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quorum.functions.ids import ADDED, PRIME
from quorum.functions.recode import settled
from quorum.operators import inference, multiplicity, reduce, variance
from quorum.plans import compare
from quorum.sources import tables

ONE = ["contrast_id"]
SEED, N_BOOT, N_PERM = 7, 200, 300


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    """Nine digits, and no negative zero: what any order of summation gives."""
    return df.withColumns({c: settled(F.col(c)) for c in columns})


def _one(df: DataFrame, name: str = "A vs B") -> DataFrame:
    return df.withColumn("contrast_id", F.lit(name))


def _pairwise(spark: SparkSession, sf: str, cluster: str = "p_brand") -> DataFrame:
    return reduce.reduce_pairwise(_one(tables.pairwise_judgments(spark, sf, cluster)), "A", "B", ONE)


def _scores(spark: SparkSession, sf: str) -> DataFrame:
    return reduce.reduce_scores(_one(tables.score_judgments(spark, sf), "A vs N"), "A", "N", ONE)


def _binary(spark: SparkSession, sf: str) -> DataFrame:
    return reduce.reduce_scores(_one(tables.binary_judgments(spark, sf), "A vs N"), "A", "N", ONE)


def pairwise_items(spark: SparkSession, sf: str) -> DataFrame:
    items = rounded(_pairwise(spark, sf), "s", "d")
    return items.select("item_id", "cluster", "s", "d", "n_pairs", "n_single_order", "n_calls", "n_ties")


def pairwise_cluster_se(spark: SparkSession, sf: str) -> DataFrame:
    rows = inference.cluster_robust(inference.cluster_totals(_pairwise(spark, sf), ONE), ONE)
    return rounded(rows, "estimate", "se", "t_stat").select("n_items", "n_clusters", "estimate", "se", "t_stat", "df")


def pairwise_cluster_sizes(spark: SparkSession, sf: str) -> DataFrame:
    return inference.cluster_sizes(inference.cluster_totals(_pairwise(spark, sf), ONE), ONE).select("size", "n_clusters")


def pairwise_tie_rate(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(reduce.pairwise_diagnostics(_pairwise(spark, sf), ONE), "tie_rate").drop("contrast_id")


def scalar_items(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(_scores(spark, sf), "x_a", "x_b", "d").drop("contrast_id")


def scalar_side_balance(spark: SparkSession, sf: str) -> DataFrame:
    return _scores(spark, sf).groupBy("side_unbalanced").agg(F.count("*").alias("n_items"), F.count_if(F.col("d").isNull()).alias("n_excluded"))


def scalar_score_distribution(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(reduce.score_distribution(tables.score_judgments(spark, sf)), "share")


def scalar_skewness(spark: SparkSession, sf: str) -> DataFrame:
    rows = _scores(spark, sf).groupBy(*ONE).agg(F.count("d").alias("n_items"), reduce.sample_skewness(F.col("d")).alias("skewness"), F.stddev_samp("d").alias("sd"))
    return rounded(rows, "skewness", "sd").drop("contrast_id")


def scalar_ceiling(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(reduce.ceiling_fraction(tables.score_judgments(spark, sf), 5.0), "ceiling")


def binary_discordant_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Items that pass on one side only; any verdict but pass or fail would be an error."""
    return reduce.discordant_counts(_binary(spark, sf), ONE).drop("contrast_id")


def binary_concordance(spark: SparkSession, sf: str) -> DataFrame:
    return reduce.concordance(_binary(spark, sf), ONE).drop("contrast_id")


def binary_mcnemar(spark: SparkSession, sf: str) -> DataFrame:
    rows = inference.mcnemar(reduce.concordance(_binary(spark, sf), ONE), "n_pass_fail", "n_fail_pass")
    return rounded(rows, "mcnemar_p").select("n_pass_fail", "n_fail_pass", "mcnemar_p")


def signflip_exact(spark: SparkSession, sf: str) -> DataFrame:
    totals = inference.cluster_totals(_pairwise(spark, sf, "p_type"), ONE)
    return rounded(inference.sign_flip_exact(totals, ONE), "flip_p").select("n_clusters", "flip_p")


def bootstrap_ci_hash(spark: SparkSession, sf: str) -> DataFrame:
    totals = inference.cluster_totals(_pairwise(spark, sf, "p_type"), ONE)
    return rounded(inference.bootstrap(totals, ONE, SEED, n_boot=N_BOOT), "boot_low", "boot_high", "boot_se").drop("contrast_id")


def signflip_mc_hash(spark: SparkSession, sf: str) -> DataFrame:
    totals = inference.cluster_totals(_pairwise(spark, sf), ONE)
    return rounded(inference.sign_flip_by_hash(totals, ONE, SEED, n_perm=N_PERM), "flip_p").select("flip_p")


def holm_bh(spark: SparkSession, sf: str) -> DataFrame:
    """Exact sign-flip p-values of each judge's comparison, adjusted over the judges."""
    items = reduce.reduce_pairwise(tables.pairwise_judgments(spark, sf, "p_type"), "A", "B", ["judge_model"])
    p = inference.sign_flip_exact(inference.cluster_totals(items, ["judge_model"]), ["judge_model"])
    return rounded(multiplicity.adjusted(p, "flip_p", "judge_model"), "flip_p", "holm", "bh").select("judge_model", "flip_p", "holm", "bh")


def judge_variance(spark: SparkSession, sf: str) -> DataFrame:
    rows = variance.judge_variance(tables.score_judgments(spark, sf), "judgment", ["item_id", "variant_id", "response_id"])
    return rounded(rows, "sigma2_j")


def variance_components(spark: SparkSession, sf: str) -> DataFrame:
    noise = variance.judge_variance(tables.score_judgments(spark, sf), "judgment", ["item_id", "variant_id"])
    items = reduce.paired(_scores(spark, sf)).join(F.broadcast(noise.select("sigma2_j")))  # one row
    calls = F.col("n_calls") / 2
    items = items.withColumn("within", variance.within_item_variance(calls, F.lit(1.0), F.col("sigma2_j")))
    return rounded(variance.variance_components(items, "within"), "var_d", "sigma2_w", "sigma2_b", "icc")


def variant_contrasts(spark: SparkSession, sf: str) -> DataFrame:
    """All pairs of variants: estimate, cluster-robust standard error and t."""
    items = compare.variant_contrasts(tables.score_judgments(spark, sf))
    rows = inference.cluster_robust(inference.cluster_totals(items, ONE), ONE)
    return rounded(rows, "estimate", "se", "t_stat").drop("degenerate")


def cross_run_items(spark: SparkSession, sf: str) -> DataFrame:
    """Win rates of two runs (by judge) on the items that both have, with the items that only one has."""
    items = reduce.reduce_pairwise(tables.pairwise_judgments(spark, sf), "A", "B", ["judge_model"])
    run = lambda j, name: items.where(F.col("judge_model") == j).select("item_id", F.col("s").alias(name))
    both = run("judge-1", "s1").join(run("judge-2", "s2"), "item_id", "full_outer")
    out = both.agg(F.count_if(F.col("s1").isNotNull() & F.col("s2").isNotNull()).alias("n_both"), F.count_if(F.col("s2").isNull()).alias("n_first_only"), F.count_if(F.col("s1").isNull()).alias("n_second_only"), F.avg(F.col("s2") - F.col("s1")).alias("change"))
    return rounded(out, "change")


def effect_supplements(spark: SparkSession, sf: str) -> DataFrame:
    """Win rate without ties, probability of superiority, and d over its standard deviation."""
    calls = tables.pairwise_judgments(spark, sf)
    wins = calls.agg((F.count_if(((F.col("judgment") == "first") & (F.col("variant_first") == "A")) | ((F.col("judgment") == "second") & (F.col("variant_first") == "B"))) / F.count_if(F.col("judgment") != "tie")).alias("conditional_win_rate"))
    sign = settled(F.col("d"))
    items = _pairwise(spark, sf).agg(F.avg(F.when(sign > 0, 1.0).when(sign < 0, 0.0).otherwise(0.5)).alias("superiority"), (F.avg("d") / F.stddev_samp("d")).alias("d_z"))
    return rounded(wins.join(F.broadcast(items)), "conditional_win_rate", "superiority", "d_z")


def replicate_variance(spark: SparkSession, sf: str) -> DataFrame:
    """Judge noise within a pair and order, by judge."""
    calls = tables.pairwise_judgments(spark, sf).withColumn("y", F.when(F.col("judgment") == "tie", 0.5).when(F.col("judgment") == "first", 1.0).otherwise(0.0))
    return rounded(variance.judge_variance(calls, "y", ["pair_id", "variant_first"], ["judge_model"]), "sigma2_j")


def judge_agreement(spark: SparkSession, sf: str) -> DataFrame:
    """Cohen's kappa of two judges over pair and order, each with its most frequent judgment (ties by name)."""
    calls = tables.pairwise_judgments(spark, sf).where(F.col("judge_model").isin("judge-0", "judge-1"))
    votes = calls.groupBy("pair_id", "variant_first", "judge_model", "judgment").agg(F.count("*").alias("n"))
    chosen = votes.groupBy("pair_id", "variant_first", "judge_model").agg(F.min_by("judgment", F.struct(-F.col("n"), F.col("judgment"))).alias("judgment"))
    said = lambda j: F.max(F.when(F.col("judge_model") == j, F.col("judgment")))
    both = chosen.groupBy("pair_id", "variant_first").agg(said("judge-0").alias("a"), said("judge-1").alias("b")).where(F.col("a").isNotNull() & F.col("b").isNotNull())
    share = lambda c: F.avg(c.cast("double"))
    sums = both.agg(F.count("*").alias("n"), share(F.col("a") == F.col("b")).alias("agreement"), *[share(F.col(c) == j).alias(f"{c}_{j}") for c in ("a", "b") for j in ("first", "second", "tie")])
    chance = F.col("a_first") * F.col("b_first") + F.col("a_second") * F.col("b_second") + F.col("a_tie") * F.col("b_tie")
    return rounded(sums.select("n", "agreement", ((F.col("agreement") - chance) / (1 - chance)).alias("kappa")), "agreement", "kappa")




def max_t_hash(spark: SparkSession, sf: str) -> DataFrame:
    """Judges' comparisons adjusted by their largest statistic."""
    items = reduce.reduce_pairwise(tables.pairwise_judgments(spark, sf), "A", "B", ["judge_model"])
    rows = multiplicity.max_t(inference.cluster_totals(items, ["judge_model"]), ["judge_model"], SEED, N_PERM)
    return rounded(rows, "t_stat", "max_t_p")


QUERIES = {
    f.__name__: f
    for f in (
        pairwise_items, pairwise_cluster_se, pairwise_cluster_sizes, pairwise_tie_rate, scalar_items, scalar_side_balance, scalar_score_distribution, scalar_skewness, scalar_ceiling,
        binary_concordance, binary_discordant_counts, binary_mcnemar, signflip_exact, bootstrap_ci_hash, signflip_mc_hash, holm_bh, judge_variance, variance_components, variant_contrasts, cross_run_items,
        effect_supplements, replicate_variance, judge_agreement, max_t_hash,
    )
}

_CLUSTER = "coalesce(nullif(source_doc_id, ''), '__singleton__:' || item_id)"


def _pairwise_sql(cluster: str = _CLUSTER, by: str = "", where: str = "") -> str:
    by = by and f"{by}, "
    return f"""
  calls AS (SELECT {by}item_id, {cluster} AS cluster, pair_id, variant_first, CAST(judgment = 'tie' AS INT) AS tie,
    CASE WHEN judgment = 'tie' THEN 0.5e0 WHEN (judgment = 'first') = (variant_first = 'A') THEN 1e0 ELSE 0e0 END AS y FROM ({tables.PAIRWISE_SQL}) {where}),
  orders AS (SELECT {by}item_id, cluster, pair_id, variant_first, avg(y) AS y, count(*) AS n, sum(tie) AS ties FROM calls GROUP BY ALL),
  pairs AS (SELECT {by}item_id, cluster, pair_id, avg(y) AS y, count(*) AS orders, sum(n) AS n, sum(ties) AS ties FROM orders GROUP BY ALL),
  items AS (SELECT {by}item_id, cluster, avg(y) AS s, 2 * avg(y) - 1 AS d, count(*) AS n_pairs, count(*) FILTER (orders = 1) AS n_single_order,
    CAST(sum(n) AS BIGINT) AS n_calls, CAST(sum(ties) AS BIGINT) AS n_ties FROM pairs GROUP BY ALL)"""


def _scores_sql(a: str = "A", b: str = "N", source: str = tables.SCORES_SQL, cluster: str = "source_doc_id") -> str:
    return f"""
  responses AS (SELECT item_id, {cluster} AS cluster, variant_id, response_id, avg(judgment) AS y, count(*) AS m FROM ({source})
    WHERE variant_id IN ('{a}', '{b}') GROUP BY ALL),
  sides AS (SELECT item_id, cluster, variant_id, avg(y) AS x, list(m ORDER BY m) AS shape, sum(m) AS n FROM responses GROUP BY ALL),
  items AS (SELECT item_id, cluster, max(x) FILTER (variant_id = '{a}') AS x_a, max(x) FILTER (variant_id = '{b}') AS x_b,
    max(shape) FILTER (variant_id = '{a}') <> max(shape) FILTER (variant_id = '{b}') AS side_unbalanced, CAST(sum(n) AS BIGINT) AS n_calls FROM sides GROUP BY ALL)"""


def mixed_sql(rows: str, *parts: str) -> str:
    """The rows of a FROM clause with x: the numbers of ``ids.mixed_numbers`` over these parts."""
    rows = f"(SELECT *, CAST(0 AS BIGINT) AS x FROM {rows})"
    for part in (*parts, "0", "0"):
        rows = f"(SELECT * EXCLUDE (a, q), (q * q % {PRIME} * a + {ADDED}) % {PRIME} AS x FROM (SELECT *, a * a % {PRIME} AS q FROM (SELECT * EXCLUDE (x), (x + {part}) % {PRIME} AS a FROM {rows})))"
    return rows


_ROBUST = """
  totals AS (SELECT {by}cluster, sum(d) AS total, count(*) AS size FROM items WHERE d IS NOT NULL GROUP BY ALL),
  means AS (SELECT {by}CAST(sum(size) AS BIGINT) AS n_items, count(*) AS n_clusters, sum(total) / sum(size) AS estimate FROM totals GROUP BY ALL),
  squares AS (SELECT {by}n_items, n_clusters, estimate, sum((total - size * estimate) ** 2) AS q FROM totals {join} GROUP BY ALL),
  robust AS (SELECT {by}n_items, n_clusters, estimate, n_clusters - 1 AS df, sqrt(n_clusters / (n_clusters - 1) * q) / n_items AS se FROM squares)"""
_BITS = "CASE WHEN (b >> CAST(k AS INT)) & 1 = 1 THEN 1e0 ELSE -1e0 END"
_HASH = "CAST(('0x' || substr(md5(concat_ws('|', '7', '{tag}', CAST({b} AS VARCHAR), CAST({at} AS VARCHAR))), 1, 12)) AS BIGINT)"
_NUMBERED = "numbered AS (SELECT *, row_number() OVER (ORDER BY cluster) - 1 AS k, count(*) OVER () AS c FROM totals)"
_PLACED = "numbered AS (SELECT *, row_number() OVER (ORDER BY md5(cluster), cluster) - 1 AS k, count(*) OVER () AS c FROM totals)"
_TOTALS = "totals AS (SELECT cluster, sum(d) AS total, count(*) AS size FROM items GROUP BY ALL)"

ORACLE_SQL = {
    "pairwise_items": f"WITH {_pairwise_sql()} SELECT item_id, cluster, round(s, 9) + 0e0 AS s, round(d, 9) + 0e0 AS d, n_pairs, n_single_order, n_calls, n_ties FROM items",
    "pairwise_cluster_se": f"WITH {_pairwise_sql()}, {_ROBUST.format(by='', join='CROSS JOIN means')} SELECT n_items, n_clusters, round(estimate, 9) + 0e0 AS estimate, round(se, 9) + 0e0 AS se, round(estimate / se, 9) + 0e0 AS t_stat, df FROM robust",
    "pairwise_cluster_sizes": f"WITH {_pairwise_sql()}, {_TOTALS} SELECT size, count(*) AS n_clusters FROM totals GROUP BY size",
    "pairwise_tie_rate": f"""WITH {_pairwise_sql()} SELECT count(*) AS n_items, CAST(sum(n_pairs) AS BIGINT) AS n_pairs, CAST(sum(n_single_order) AS BIGINT) AS n_single_order,
      CAST(sum(n_calls) AS BIGINT) AS n_calls, round(sum(n_ties) / sum(n_calls), 9) + 0e0 AS tie_rate, sum(n_single_order) = 0 AS counterbalanced FROM items""",
    "scalar_items": f"WITH {_scores_sql()} SELECT item_id, cluster, round(x_a, 9) + 0e0 AS x_a, round(x_b, 9) + 0e0 AS x_b, round(x_a - x_b, 9) + 0e0 AS d, side_unbalanced, n_calls FROM items",
    "scalar_side_balance": f"WITH {_scores_sql()} SELECT side_unbalanced, count(*) AS n_items, count(*) FILTER (x_a - x_b IS NULL) AS n_excluded FROM items GROUP BY ALL",
    "scalar_score_distribution": f"""WITH counts AS (SELECT variant_id, judgment, count(*) AS n FROM ({tables.SCORES_SQL}) GROUP BY ALL)
      SELECT variant_id, judgment, n, round(n / sum(n) OVER v, 9) + 0e0 AS share, max(n) OVER v / sum(n) OVER v > 0.5e0 AS degenerate FROM counts WINDOW v AS (PARTITION BY variant_id)""",
    "scalar_skewness": f"WITH {_scores_sql()} SELECT count(x_a - x_b) AS n_items, round(skewness(x_a - x_b), 9) + 0e0 AS skewness, round(stddev_samp(x_a - x_b), 9) + 0e0 AS sd FROM items",
    "scalar_ceiling": f"SELECT variant_id, round(avg(CASE WHEN judgment = 5 THEN 1e0 ELSE 0e0 END), 9) + 0e0 AS ceiling FROM ({tables.SCORES_SQL}) GROUP BY ALL",
    "binary_discordant_counts": f"""WITH b AS (SELECT item_id, max(judgment) FILTER (variant_id = 'A') AS x, max(judgment) FILTER (variant_id = 'N') AS y FROM ({tables.BINARY_SQL}) GROUP BY ALL)
      SELECT count(*) AS n_items, count(*) FILTER (x > y) AS n_pass_fail, count(*) FILTER (x < y) AS n_fail_pass FROM b WHERE x IS NOT NULL AND y IS NOT NULL""",
    "binary_concordance": f"""WITH b AS (SELECT item_id, max(judgment) FILTER (variant_id = 'A') AS x, max(judgment) FILTER (variant_id = 'N') AS y FROM ({tables.BINARY_SQL}) GROUP BY ALL)
      SELECT true AS single, count(*) FILTER (x = 1 AND y = 1) AS n_pass_pass, count(*) FILTER (x = 1 AND y = 0) AS n_pass_fail, count(*) FILTER (x = 0 AND y = 1) AS n_fail_pass,
        count(*) FILTER (x = 0 AND y = 0) AS n_fail_fail, count(*) FILTER (x <> y) AS n_discordant FROM b WHERE x IS NOT NULL AND y IS NOT NULL""",
    "binary_mcnemar": f"""WITH b AS (SELECT item_id, max(judgment) FILTER (variant_id = 'A') AS x, max(judgment) FILTER (variant_id = 'N') AS y FROM ({tables.BINARY_SQL}) GROUP BY ALL),
      n AS (SELECT count(*) FILTER (x = 1 AND y = 0) AS a, count(*) FILTER (x = 0 AND y = 1) AS b FROM b)
      SELECT a AS n_pass_fail, b AS n_fail_pass, round(CASE WHEN a = b THEN 1e0 ELSE least(1e0, (SELECT sum(2 * exp(lgamma(a + b + 1e0) - lgamma(i + 1e0) - lgamma(a + b - i + 1e0) - (a + b) * ln(2e0)))
        FROM range(0, least(a, b) + 1) AS t(i))) END, 9) + 0e0 AS mcnemar_p FROM n""",
    "signflip_exact": f"""WITH {_pairwise_sql("p_type")}, {_TOTALS}, {_NUMBERED},
      drawn AS (SELECT b, sum(total * {_BITS}) AS drawn, sum(total) AS seen FROM numbered, (SELECT unnest(range(0, CAST(2 ** (SELECT count(*) FROM totals) AS BIGINT))) AS b) GROUP BY b)
      SELECT (SELECT count(*) FROM totals) AS n_clusters, round(avg(CASE WHEN abs(drawn) >= abs(seen) - 1e-9 THEN 1e0 ELSE 0e0 END), 9) + 0e0 AS flip_p FROM drawn""",
    "bootstrap_ci_hash": f"""WITH {_pairwise_sql("p_type")}, {_TOTALS}, {_PLACED},
      draws AS (SELECT b, x % c AS k FROM {mixed_sql(f"numbered, range(0, {N_BOOT}) AS r(b)", str(SEED), "0", "b", "k")}),
      means AS (SELECT b, sum(total) / sum(size) AS mean FROM draws JOIN numbered USING (k) GROUP BY b)
      SELECT round(quantile_cont(mean, 0.025e0), 9) + 0e0 AS boot_low, round(quantile_cont(mean, 0.975e0), 9) + 0e0 AS boot_high, round(stddev_samp(mean), 9) + 0e0 AS boot_se FROM means""",
    "signflip_mc_hash": f"""WITH {_pairwise_sql()}, {_TOTALS},
      drawn AS (SELECT chunk, bit, sum(total * (2 * (({_HASH.format(tag="flip", b="chunk", at="cluster")} >> CAST(bit AS INT)) & 1) - 1)) AS drawn, sum(total) AS seen
        FROM totals, range(0, {-(-N_PERM // inference.SIGN_BITS)}) AS r(chunk), range(0, {inference.SIGN_BITS}) AS t(bit) WHERE chunk * {inference.SIGN_BITS} + bit < {N_PERM} GROUP BY ALL)
      SELECT round((1 + count(*) FILTER (abs(drawn) >= abs(seen) - 1e-9)) / ({N_PERM} + 1e0), 9) + 0e0 AS flip_p FROM drawn""",
    "holm_bh": f"""WITH {_pairwise_sql("p_type", "judge_model")},
      totals AS (SELECT judge_model, cluster, sum(d) AS total FROM items GROUP BY ALL),
      numbered AS (SELECT *, row_number() OVER (PARTITION BY judge_model ORDER BY cluster) - 1 AS k, count(*) OVER (PARTITION BY judge_model) AS c FROM totals),
      drawn AS (SELECT judge_model, b, sum(total * {_BITS}) AS drawn, sum(total) AS seen FROM numbered, (SELECT unnest(range(0, 8192)) AS b) WHERE b < 2 ** c GROUP BY ALL),
      p AS (SELECT judge_model, avg(CASE WHEN abs(drawn) >= abs(seen) - 1e-9 THEN 1e0 ELSE 0e0 END) AS flip_p FROM drawn GROUP BY ALL),
      r AS (SELECT *, row_number() OVER (ORDER BY flip_p, judge_model) AS k, count(*) OVER () AS m FROM p)
      SELECT judge_model, round(flip_p, 9) + 0e0 AS flip_p, round(least(1, max((m - k + 1) * flip_p) OVER (ORDER BY k)), 9) + 0e0 AS holm,
        round(least(1, min(flip_p * m / k) OVER (ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)), 9) + 0e0 AS bh FROM r""",
    "judge_variance": f"""WITH g AS (SELECT item_id, variant_id, response_id, count(*) AS n, var_samp(judgment) AS v FROM ({tables.SCORES_SQL}) GROUP BY ALL HAVING count(*) >= 2)
      SELECT round(sum(v * (n - 1)) / sum(n - 1), 9) + 0e0 AS sigma2_j, count(*) AS n_used, CAST(coalesce(sum(n - 1), 0) AS BIGINT) AS df FROM g""",
    "variance_components": f"""WITH {_scores_sql()},
      g AS (SELECT item_id, variant_id, count(*) AS n, var_samp(judgment) AS v FROM ({tables.SCORES_SQL}) GROUP BY ALL HAVING count(*) >= 2),
      j AS (SELECT sum(v * (n - 1)) / sum(n - 1) AS sigma2_j FROM g),
      w AS (SELECT x_a - x_b AS d, 2 * sigma2_j / (n_calls / 2e0) AS w FROM items, j WHERE x_a - x_b IS NOT NULL),
      c AS (SELECT var_samp(d) AS var_d, avg(w) AS sigma2_w FROM w)
      SELECT round(var_d, 9) + 0e0 AS var_d, round(sigma2_w, 9) + 0e0 AS sigma2_w, round(greatest(0, var_d - sigma2_w), 9) + 0e0 AS sigma2_b,
        round(greatest(0, var_d - sigma2_w) / (greatest(0, var_d - sigma2_w) + sigma2_w), 9) + 0e0 AS icc, var_d < sigma2_w AS truncated FROM c""",
    "variant_contrasts": f"""WITH responses AS (SELECT item_id, source_doc_id AS cluster, variant_id, response_id, avg(judgment) AS y FROM ({tables.SCORES_SQL}) GROUP BY ALL),
      x AS (SELECT item_id, cluster, variant_id, avg(y) AS x FROM responses GROUP BY ALL),
      items AS (SELECT a.variant_id || ' vs ' || b.variant_id AS contrast_id, a.cluster, a.x - b.x AS d FROM x a JOIN x b ON a.item_id = b.item_id AND a.variant_id < b.variant_id),
      {_ROBUST.format(by="contrast_id, ", join="JOIN means USING (contrast_id)")}
      SELECT contrast_id, n_items, n_clusters, round(estimate, 9) + 0e0 AS estimate, round(se, 9) + 0e0 AS se, round(estimate / se, 9) + 0e0 AS t_stat, df FROM robust""",
    "cross_run_items": f"""WITH {_pairwise_sql(by="judge_model")}
      SELECT count(*) FILTER (a.s IS NOT NULL AND b.s IS NOT NULL) AS n_both, count(*) FILTER (b.s IS NULL) AS n_first_only, count(*) FILTER (a.s IS NULL) AS n_second_only, round(avg(b.s - a.s), 9) + 0e0 AS change
      FROM (SELECT * FROM items WHERE judge_model = 'judge-1') a FULL JOIN (SELECT * FROM items WHERE judge_model = 'judge-2') b USING (item_id)""",
    "effect_supplements": f"""WITH {_pairwise_sql()}
      SELECT round((SELECT avg(y) FROM calls WHERE tie = 0), 9) + 0e0 AS conditional_win_rate, round(avg(CASE WHEN round(d, 9) > 0 THEN 1e0 WHEN round(d, 9) < 0 THEN 0e0 ELSE 0.5e0 END), 9) + 0e0 AS superiority, round(avg(d) / stddev_samp(d), 9) + 0e0 AS d_z FROM items""",
    "replicate_variance": f"""WITH g AS (SELECT judge_model, pair_id, variant_first, count(*) AS n, var_samp(CASE judgment WHEN 'tie' THEN 0.5e0 WHEN 'first' THEN 1e0 ELSE 0e0 END) AS v
        FROM ({tables.PAIRWISE_SQL}) GROUP BY ALL HAVING count(*) >= 2)
      SELECT judge_model, round(sum(v * (n - 1)) / sum(n - 1), 9) + 0e0 AS sigma2_j, count(*) AS n_used, CAST(sum(n - 1) AS BIGINT) AS df FROM g GROUP BY ALL""",
    "judge_agreement": f"""WITH v AS (SELECT pair_id, variant_first, judge_model, judgment, count(*) AS n FROM ({tables.PAIRWISE_SQL}) WHERE judge_model IN ('judge-0', 'judge-1') GROUP BY ALL),
      c AS (SELECT pair_id, variant_first, judge_model, arg_min(judgment, (-n, judgment)) AS judgment FROM v GROUP BY ALL),
      w AS (SELECT max(judgment) FILTER (judge_model = 'judge-0') AS a, max(judgment) FILTER (judge_model = 'judge-1') AS b FROM c GROUP BY pair_id, variant_first),
      s AS (SELECT count(*) AS n, avg(CASE WHEN a = b THEN 1e0 ELSE 0e0 END) AS agreement,
        avg(CAST(a = 'first' AS DOUBLE)) * avg(CAST(b = 'first' AS DOUBLE)) + avg(CAST(a = 'second' AS DOUBLE)) * avg(CAST(b = 'second' AS DOUBLE)) + avg(CAST(a = 'tie' AS DOUBLE)) * avg(CAST(b = 'tie' AS DOUBLE)) AS chance
        FROM w WHERE a IS NOT NULL AND b IS NOT NULL)
      SELECT n, round(agreement, 9) + 0e0 AS agreement, round((agreement - chance) / (1 - chance), 9) + 0e0 AS kappa FROM s""",
    "max_t_hash": f"""WITH {_pairwise_sql(by="judge_model")}, totals AS (SELECT judge_model, cluster, sum(d) AS total FROM items GROUP BY ALL),
      drawn AS (SELECT judge_model, b, abs(sum(total * (2 * ({_HASH.format(tag="max-t", b="b", at="cluster")} % 2) - 1))) / sqrt(sum(total * total)) AS t FROM totals, (SELECT unnest(range(0, {N_PERM})) AS b) GROUP BY ALL),
      most AS (SELECT b, max(t) AS most FROM drawn GROUP BY b), seen AS (SELECT judge_model, sum(total) / sqrt(sum(total * total)) AS t_stat FROM totals GROUP BY ALL)
      SELECT judge_model, round(t_stat, 9) + 0e0 AS t_stat, round((1 + count(*) FILTER (most >= abs(t_stat) - 1e-9)) / ({N_PERM} + 1e0), 9) + 0e0 AS max_t_p FROM seen, most GROUP BY judge_model, t_stat""",
}
