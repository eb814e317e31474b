"""Bias estimators over the judgment views."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quorum.functions import recode
from quorum.operators import inference, reduce
from quorum.plans import compare
from quorum.queries.judgments import _CLUSTER, _ROBUST, rounded
from quorum.sources import tables


def position_bias_items(spark: SparkSession, sf: str) -> DataFrame:
    items = reduce.order_balanced(tables.pairwise_judgments(spark, sf), recode.prefers_first())
    return rounded(items, "g", "d")


def position_bias_by_judge(spark: SparkSession, sf: str) -> DataFrame:
    by = ["judge_model"]
    items = reduce.order_balanced(tables.pairwise_judgments(spark, sf), recode.prefers_first(), by)
    rows = inference.cluster_robust(inference.cluster_totals(items, by), by)
    rows = rows.select(*by, "n_items", "n_clusters", (F.col("estimate") / 2).alias("beta"), (F.col("se") / 2).alias("se"))
    return rounded(rows, "beta", "se")


def verbosity_association_items(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(reduce.order_balanced(tables.pairwise_judgments(spark, sf), recode.prefers_longer()), "g", "d")


def verbosity_call_counts(spark: SparkSession, sf: str) -> DataFrame:
    return reduce.call_counts(tables.pairwise_judgments(spark, sf), recode.prefers_longer()).drop("judges")


def token_diagnostics(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(reduce.token_diagnostics(tables.pairwise_judgments(spark, sf)), "mean_tokens", "abs_gap_mean")


def verbosity_controlled_check(spark: SparkSession, sf: str) -> DataFrame:
    """Items and mean of each arm, of both, and of their difference on the items that have both."""
    items = compare.controlled_items(tables.arm_judgments(spark, sf), "orig", "padded", "condensed")
    return rounded(items.groupBy("arm").agg(F.count("*").alias("n_items"), F.avg("g").alias("g")), "g")


def self_preference_items(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(reduce.self_preference(tables.pairwise_judgments(spark, sf), "judge-0", "A", "B"), "s_self", "s_panel", "d")


def order_patterns(spark: SparkSession, sf: str) -> DataFrame:
    """How the two orders of a pair agree, by judge: on content, on position, against it, or otherwise."""
    calls = tables.pairwise_judgments(spark, sf)
    y = lambda v: F.avg(F.when(F.col("variant_first") == v, F.when(F.col("judgment") == "first", 1.0).when(F.col("judgment") == "tie", 0.5).otherwise(0.0)))
    pairs = calls.groupBy("judge_model", "pair_id").agg(y("A").alias("a"), y("B").alias("b")).where(F.col("a").isNotNull() & F.col("b").isNotNull())
    a, b = recode.settled(F.col("a")), recode.settled(F.col("b"))
    pattern = F.when((a == 1) & (b == 1), "position").when((a == 0) & (b == 0), "against position").when((recode.settled(a + b) == 1) & (a != b), "content").otherwise("mixed")
    return pairs.groupBy("judge_model", pattern.alias("pattern")).agg(F.count("*").alias("n_pairs"))


def position_histogram(spark: SparkSession, sf: str) -> DataFrame:
    """Items by their order-balanced share of first wins, in quarters, and by judge."""
    items = reduce.order_balanced(tables.pairwise_judgments(spark, sf), recode.prefers_first(), ["judge_model"]).where(F.col("g").isNotNull())
    return items.groupBy("judge_model", (F.floor(F.round(F.col("g") * 4, 9)) / 4).alias("quarter")).agg(F.count("*").alias("n_items"))


def position_bias_by_gap(spark: SparkSession, sf: str) -> DataFrame:
    """Position bias by the difference in length of the two responses."""
    gap = F.abs(F.col("tokens_first") - F.col("tokens_second"))
    calls = tables.pairwise_judgments(spark, sf).withColumn("gap", F.when(gap < 50, "0-49").when(gap < 150, "50-149").otherwise("150-"))
    items = reduce.order_balanced(calls, recode.prefers_first(), ["gap"])
    return rounded(items.groupBy("gap").agg(F.count("g").alias("n_items"), (F.avg("g") - 0.5).alias("beta")), "beta")


def competence_gate(spark: SparkSession, sf: str, least: float = 0.65) -> DataFrame:
    """Whether each judge prefers the variant known to be better often enough, by order-balanced items."""
    items = reduce.reduce_pairwise(tables.pairwise_judgments(spark, sf), "A", "B", ["judge_model"])
    rows = items.groupBy("judge_model").agg(F.count("*").alias("n_items"), F.avg("s").alias("win_rate"))
    return rounded(rows, "win_rate").withColumn("passes", F.col("win_rate") >= least)


QUERIES = {
    f.__name__: f
    for f in (
        position_bias_items, position_bias_by_judge, verbosity_association_items, verbosity_call_counts, token_diagnostics, verbosity_controlled_check, self_preference_items,
        order_patterns, position_histogram, position_bias_by_gap, competence_gate,
    )
}

_FIRST = "CASE judgment WHEN 'tie' THEN 0.5e0 WHEN 'first' THEN 1e0 ELSE 0e0 END"
_LONGER = "CASE WHEN tokens_first = tokens_second THEN NULL WHEN judgment = 'tie' THEN 0.5e0 WHEN (judgment = 'first') = (tokens_first > tokens_second) THEN 1e0 ELSE 0e0 END"


def _balanced_sql(code: str, by: str = "", source: str = tables.PAIRWISE_SQL) -> str:
    by = by and f"{by}, "
    return f"""
  calls AS (SELECT *, {_CLUSTER} AS cluster, {code} AS y, CAST(judgment = 'tie' AS INT) AS tie FROM ({source})),
  orders AS (SELECT {by}item_id, cluster, pair_id, variant_first, avg(y) AS y, count(*) AS n, sum(tie) AS ties FROM calls WHERE y IS NOT NULL AND variant_first <> variant_second GROUP BY ALL),
  pairs AS (SELECT {by}item_id, cluster, pair_id, avg(y) AS y, count(*) AS orders, sum(n) AS n, sum(ties) AS ties FROM orders GROUP BY ALL),
  items AS (SELECT {by}item_id, cluster, avg(y) FILTER (orders >= 2) AS g, 2 * avg(y) FILTER (orders >= 2) - 1 AS d, count(*) FILTER (orders >= 2) AS n_pairs, count(*) FILTER (orders < 2) AS n_single_order,
    CAST(sum(n) AS BIGINT) AS n_calls, CAST(sum(ties) AS BIGINT) AS n_ties FROM pairs GROUP BY ALL)"""


_ITEMS = "SELECT item_id, cluster, round(g, 9) + 0e0 AS g, round(d, 9) + 0e0 AS d, n_pairs, n_single_order, n_calls, n_ties FROM items"
_ARMS = f"""
  SELECT item_id, source_doc_id, pair_id, judge_model, judgment, arm,
    CASE variant_first WHEN 'A' THEN 'orig' ELSE own END AS variant_first, CASE variant_second WHEN 'A' THEN 'orig' ELSE own END AS variant_second,
    CASE WHEN variant_first = 'A' THEN 150 WHEN own = 'padded' THEN 300 ELSE 80 END AS tokens_first, CASE WHEN variant_second = 'A' THEN 150 WHEN own = 'padded' THEN 300 ELSE 80 END AS tokens_second
  FROM (SELECT *, CASE WHEN ends_with(pair_id, '::A') THEN 'padded' ELSE 'condensed' END AS own FROM ({tables.PAIRWISE_SQL}) WHERE NOT ends_with(pair_id, '::N')), (VALUES ('own'), ('pooled')) AS t(arm)"""

ORACLE_SQL = {
    "position_bias_items": f"WITH {_balanced_sql(_FIRST)} {_ITEMS}",
    "position_bias_by_judge": f"""WITH {_balanced_sql(_FIRST, "judge_model")}, {_ROBUST.format(by="judge_model, ", join="JOIN means USING (judge_model)")}
      SELECT judge_model, n_items, n_clusters, round(estimate / 2, 9) + 0e0 AS beta, round(se / 2, 9) + 0e0 AS se FROM robust""",
    "verbosity_association_items": f"WITH {_balanced_sql(_LONGER)} {_ITEMS}",
    "verbosity_call_counts": f"""SELECT count(*) FILTER (variant_first <> variant_second AND y IS NOT NULL) AS n_calls_used, count(*) FILTER (variant_first <> variant_second AND y IS NULL) AS n_calls_skipped,
        count(*) FILTER (variant_first = variant_second) AS n_same_variant, count(DISTINCT judge_model) FILTER (y IS NOT NULL) AS n_judges FROM (SELECT *, {_LONGER} AS y FROM ({tables.PAIRWISE_SQL}))""",
    "token_diagnostics": f"""WITH s AS (SELECT unnest([variant_first, variant_second]) AS variant_id, unnest([tokens_first, tokens_second]) AS tokens, abs(tokens_first - tokens_second) AS gap FROM ({tables.PAIRWISE_SQL}))
      SELECT variant_id, count(*) AS n_calls, round(avg(tokens), 9) + 0e0 AS mean_tokens, min(tokens) AS min_tokens, max(tokens) AS max_tokens, round(avg(gap), 9) + 0e0 AS abs_gap_mean FROM s GROUP BY ALL""",
    "verbosity_controlled_check": f"""WITH arms AS (SELECT * REPLACE (CASE arm WHEN 'own' THEN CASE WHEN ends_with(pair_id, '::A') THEN 'padded' ELSE 'condensed' END ELSE 'pooled' END AS arm) FROM ({_ARMS})),
      {_balanced_sql(_LONGER, "arm", "FROM arms")},
      seen AS (SELECT arm, item_id, g FROM items WHERE g IS NOT NULL),
      differ AS (SELECT p.g - c.g AS g FROM seen p JOIN seen c ON p.item_id = c.item_id AND p.arm = 'padded' AND c.arm = 'condensed')
      SELECT arm, count(*) AS n_items, round(avg(g), 9) + 0e0 AS g FROM (SELECT arm, g FROM seen UNION ALL SELECT 'check', g FROM differ) GROUP BY ALL""",
    "self_preference_items": f"""WITH calls AS (SELECT *, {_CLUSTER} AS cluster, CASE WHEN judgment = 'tie' THEN 0.5e0 WHEN (judgment = 'first') = (variant_first = 'A') THEN 1e0 ELSE 0e0 END AS y FROM ({tables.PAIRWISE_SQL})),
      orders AS (SELECT judge_model, item_id, cluster, pair_id, variant_first, avg(y) AS y FROM calls GROUP BY ALL),
      pairs AS (SELECT judge_model, item_id, cluster, pair_id, avg(y) AS y FROM orders GROUP BY ALL),
      s AS (SELECT judge_model, item_id, cluster, avg(y) AS s FROM pairs GROUP BY ALL),
      i AS (SELECT item_id, cluster, max(s) FILTER (judge_model = 'judge-0') AS s_self, avg(s) FILTER (judge_model <> 'judge-0') AS s_panel, count(*) FILTER (judge_model <> 'judge-0') AS n_panel FROM s GROUP BY ALL)
      SELECT item_id, cluster, round(s_self, 9) + 0e0 AS s_self, round(s_panel, 9) + 0e0 AS s_panel, n_panel, round(s_self - s_panel, 9) + 0e0 AS d FROM i""",
    "order_patterns": f"""WITH p AS (SELECT judge_model, pair_id, round(avg({_FIRST}) FILTER (variant_first = 'A'), 9) AS a, round(avg({_FIRST}) FILTER (variant_first = 'B'), 9) AS b FROM ({tables.PAIRWISE_SQL}) GROUP BY ALL)
      SELECT judge_model, CASE WHEN a = 1 AND b = 1 THEN 'position' WHEN a = 0 AND b = 0 THEN 'against position' WHEN round(a + b, 9) = 1 AND a <> b THEN 'content' ELSE 'mixed' END AS pattern, count(*) AS n_pairs
      FROM p WHERE a IS NOT NULL AND b IS NOT NULL GROUP BY ALL""",
    "position_histogram": f"WITH {_balanced_sql(_FIRST, 'judge_model')} SELECT judge_model, floor(round(g * 4, 9)) / 4 AS quarter, count(*) AS n_items FROM items WHERE g IS NOT NULL GROUP BY ALL",
    "position_bias_by_gap": f"""WITH gaps AS (SELECT *, CASE WHEN abs(tokens_first - tokens_second) < 50 THEN '0-49' WHEN abs(tokens_first - tokens_second) < 150 THEN '50-149' ELSE '150-' END AS gap FROM ({tables.PAIRWISE_SQL})),
      {_balanced_sql(_FIRST, "gap", "FROM gaps")} SELECT gap, count(g) AS n_items, round(avg(g) - 0.5e0, 9) + 0e0 AS beta FROM items GROUP BY ALL""",
    "competence_gate": f"""WITH calls AS (SELECT *, CASE WHEN judgment = 'tie' THEN 0.5e0 WHEN (judgment = 'first') = (variant_first = 'A') THEN 1e0 ELSE 0e0 END AS y FROM ({tables.PAIRWISE_SQL})),
      orders AS (SELECT judge_model, item_id, pair_id, variant_first, avg(y) AS y FROM calls GROUP BY ALL), pairs AS (SELECT judge_model, item_id, pair_id, avg(y) AS y FROM orders GROUP BY ALL),
      i AS (SELECT judge_model, item_id, avg(y) AS s FROM pairs GROUP BY ALL)
      SELECT judge_model, count(*) AS n_items, round(avg(s), 9) + 0e0 AS win_rate, round(avg(s), 9) >= 0.65e0 AS passes FROM i GROUP BY ALL""",
}
