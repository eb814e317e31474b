"""Report rows. The SQL has all but the t quantiles; it numbers clusters as one block, so up to ``inference.BLOCK_CLUSTERS`` of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quorum.operators import inference
from quorum.plans import compare
from quorum.queries.bias import _ARMS, _FIRST, _LONGER, _balanced_sql
from quorum.queries.judgments import _pairwise_sql, mixed_sql, rounded
from quorum.sources import tables

SEED, N_BOOT, N_PERM = 20, 2_000, 2_000
DRAWS = {"n_boot": N_BOOT, "n_perm": N_PERM}
MARGIN = 0.1
_SHOWN = ["estimate", "boot_low", "boot_high", "boot_se", "analytic_se", "t_stat", "analytic_p", "p_value", "sd", "skewness"]


def _flat(rows: DataFrame, by: str, *more: str, digits: tuple[str, ...] = ()) -> DataFrame:
    """The columns of a report that SQL can express, without structs."""
    rows = rows.withColumns({"boot_low": F.col("bootstrap_ci.low"), "boot_high": F.col("bootstrap_ci.high"), "warnings": F.array_join("warnings", "; ")})
    return rounded(rows, *_SHOWN, *digits).select(by, *_SHOWN, "df", "n_items", "n_clusters", "test_method", "ci_method", "disclosure", "warnings", *more)


def compare_pairwise_report(spark: SparkSession, sf: str) -> DataFrame:
    """Win rate of A over B, by judge."""
    rows = compare.compare_pairwise(tables.pairwise_judgments(spark, sf), "A", "B", ["judge_model"], seed=SEED, **DRAWS)
    return _flat(rows, "judge_model", "n_pairs", "n_single_order", "n_calls", "tie_rate", "counterbalanced", "n_records_used", "n_records_ignored", digits=("tie_rate",))


def compare_pairwise_greater_report(spark: SparkSession, sf: str) -> DataFrame:
    """Whether A wins more often than B, by judge: a one-sided test; intervals stay two-sided."""
    rows = compare.compare_pairwise(tables.pairwise_judgments(spark, sf), "A", "B", ["judge_model"], seed=SEED, alternative="greater", **DRAWS)
    return _flat(rows, "judge_model", "tie_rate", digits=("tie_rate",))


_SIDES = ["mean_a", "mean_b", "n_excluded", "n_side_unbalanced", "n_records_used", "n_records_ignored"]


def compare_scalar_report(spark: SparkSession, sf: str) -> DataFrame:
    rows = compare.compare_scores(tables.score_judgments(spark, sf), "A", "N", ["judge_model"], seed=SEED, **DRAWS)
    return _flat(rows, "judge_model", *_SIDES, digits=("mean_a", "mean_b"))


def compare_scalar_less_report(spark: SparkSession, sf: str) -> DataFrame:
    """Whether A scores lower than N, by judge: a one-sided test."""
    rows = compare.compare_scores(tables.score_judgments(spark, sf), "A", "N", ["judge_model"], seed=SEED, alternative="less", **DRAWS)
    return _flat(rows, "judge_model", *_SIDES, digits=("mean_a", "mean_b"))


def compare_binary_report(spark: SparkSession, sf: str) -> DataFrame:
    rows = compare.compare_scores(tables.binary_judgments(spark, sf).withColumn("contrast_id", F.lit("A vs N")), "A", "N", ["contrast_id"], seed=SEED, binary=True, **DRAWS)
    return _flat(rows, "contrast_id", *_SIDES, "n_pass_fail", "n_fail_pass", "n_discordant", "mcnemar_p", digits=("mean_a", "mean_b", "mcnemar_p"))


_USED = ["n_pairs_used", "n_pairs_single_order", "n_items_dropped", "tie_rate", "n_calls_used", "n_calls_skipped", "n_same_variant", "n_judges", "judges"]


def position_bias_report(spark: SparkSession, sf: str) -> DataFrame:
    return _flat(compare.position_bias(tables.pairwise_judgments(spark, sf), ["judge_model"], seed=SEED, **DRAWS), "judge_model", *_USED, digits=("tie_rate",))


def verbosity_association_report(spark: SparkSession, sf: str) -> DataFrame:
    """All judges together, which the report warns of."""
    rows = compare.verbosity_association(tables.pairwise_judgments(spark, sf).withColumn("contrast_id", F.lit("all")), ["contrast_id"], seed=SEED, **DRAWS)
    return _flat(rows, "contrast_id", *_USED, digits=("tie_rate",))


def verbosity_controlled_report(spark: SparkSession, sf: str) -> DataFrame:
    rows = compare.verbosity_bias_controlled(tables.arm_judgments(spark, sf), original="orig", padded="padded", condensed="condensed", seed=SEED, **DRAWS)
    # the pooled row's warning depends on an interval by t quantiles
    return _flat(rows.where("arm <> 'pooled'").union(rows.where("arm = 'pooled'").withColumn("warnings", F.filter("warnings", lambda w: ~w.startswith("the check")))), "arm")


def self_preference_report(spark: SparkSession, sf: str) -> DataFrame:
    rows = compare.self_preference_bias(tables.pairwise_judgments(spark, sf), self_judge="judge-0", self_variant="A", other_variant="B", seed=SEED, **DRAWS)
    return _flat(rows, "contrast_id", "n_self_only", "n_panel_only", "panel_min", "panel_max", "naive", digits=("naive",))


def non_inferiority_report(spark: SparkSession, sf: str) -> DataFrame:
    rows = compare.report(compare.variant_contrasts(tables.score_judgments(spark, sf), control="N"), ["contrast_id"], seed=SEED, **DRAWS)
    return _flat(compare.non_inferiority(rows, MARGIN), "contrast_id", "non_inferior")


def contrast_matrix_report(spark: SparkSession, sf: str) -> DataFrame:
    """All pairs of variants as one family."""
    rows = compare.contrast_report(compare.variant_contrasts(tables.score_judgments(spark, sf)), seed=SEED, **DRAWS)
    return _flat(rows, "contrast_id", "holm", "best", "family_size", digits=("holm",))


QUERIES = {
    f.__name__: f
    for f in (
        compare_pairwise_report, compare_pairwise_greater_report, compare_scalar_report, compare_scalar_less_report, compare_binary_report, position_bias_report, verbosity_association_report, verbosity_controlled_report, self_preference_report,
        non_inferiority_report, contrast_matrix_report,
    )
}


def _tail_sql(t: str, df: str) -> str:
    """Two-sided p-value of Student's t with a whole number of degrees of freedom, by its finite series."""
    q, sine = f"({df} / ({df} + {t} * {t}))", f"(abs({t}) / sqrt({df} + {t} * {t}))"
    series = lambda n, log: f"coalesce(list_sum(list_transform(range(0, CAST({n} AS BIGINT)), lambda j: exp({log} + j * ln({q})))), 0)"
    even = f"{sine} * {series(f'{df} // 2', 'lgamma(j + 0.5e0) - lgamma(0.5e0) - lgamma(j + 1e0)')}"
    odd = f"2 / pi() * (atan(abs({t}) / sqrt({df})) + {sine} * sqrt({q}) * {series(f'({df} - 1) // 2', 'lgamma(j + 1e0) + lgamma(1.5e0) - lgamma(j + 1.5e0)')})"
    return f"(1 - CASE WHEN {df} % 2 = 0 THEN {even} ELSE {odd} END)"


_R = "round({}, 9) + 0e0"
#: When a flipped sum is as extreme as the seen one, and the p-value from the two-sided one, by alternative.
_SIDED = {
    "two-sided": ("abs(drawn) >= abs(seen) - 1e-9", "{p}"),
    "greater": ("drawn >= seen - 1e-9", "CASE WHEN mean > 0 THEN {p} / 2 ELSE 1 - {p} / 2 END"),
    "less": ("drawn <= seen + 1e-9", "CASE WHEN mean < 0 THEN {p} / 2 ELSE 1 - {p} / 2 END"),
}


def _report_sql(items: str, by: str, *, scale: str = "1e0", offset: str = "0e0", seed: str = str(SEED), alpha: str = "0.05e0", more: str = "", join: str = "", columns: str = "", warnings: tuple[str, ...] = (), alternative: str = "two-sided") -> str:
    """The report of CTEs that end in items (by, item_id, cluster, d), with further CTEs, joins, columns and warnings."""
    disclosure = "CASE " + " ".join(f"WHEN n_clusters >= {c} THEN 'measured coverage at {c} clusters: bootstrap {boot:.2%}, analytic {analytic:.2%}; this run''s own was not measured'" for c, boot, analytic in reversed(inference.COVERAGE)) + " ELSE 'no coverage was measured for so few clusters' END"
    shown = lambda c: _R.format(f"({c} * {scale} + {offset})")
    warned = ", ".join(["CASE WHEN n_clusters < 20 THEN 'few clusters: ' || n_clusters END", "CASE WHEN low = high THEN 'all items have the same value: the interval is a point' END", *(["CASE WHEN abs(skew) > 1 THEN 'one-sided test of skewed values' END"] if alternative != "two-sided" else []), *warnings])
    extreme, tail = _SIDED[alternative]
    chunks, bits = -(-N_PERM // inference.SIGN_BITS), inference.SIGN_BITS
    hit = f"avg(CASE WHEN {extreme} THEN 1e0 ELSE 0e0 END)"
    return f"""WITH {items.replace("items AS (", "items AS MATERIALIZED (")},
      totals AS (SELECT {by}, cluster, sum(d) AS total, count(*) AS size FROM items WHERE d IS NOT NULL GROUP BY ALL),
      numbered AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY md5(cluster), cluster) - 1 AS k, count(*) OVER (PARTITION BY {by}) AS c FROM totals),
      means AS (SELECT {by}, CAST(sum(size) AS BIGINT) AS n_items, count(*) AS n_clusters, sum(total) / sum(size) AS mean FROM totals GROUP BY ALL),
      squares AS (SELECT {by}, n_items, n_clusters, mean, sum((total - size * mean) ** 2) AS q FROM totals JOIN means USING ({by}) GROUP BY ALL),
      robust AS (SELECT {by}, n_items, n_clusters, mean, n_clusters - 1 AS df, sqrt(n_clusters / (n_clusters - 1) * q) / n_items AS se FROM squares),
      slots AS (SELECT {by}, b, x % c AS k FROM {mixed_sql(f"numbered, range(0, {N_BOOT}) AS r(b)", seed, "0", "b", "k")}),
      boots AS (SELECT s.{by}, s.b, sum(n.total) / sum(n.size) AS mean FROM slots s JOIN numbered n ON s.{by} = n.{by} AND s.k = n.k GROUP BY ALL),
      edges AS (SELECT {by}, quantile_cont(mean, {alpha} / 2) AS boot_low, quantile_cont(mean, 1 - {alpha} / 2) AS boot_high, stddev_samp(mean) AS boot_se FROM boots GROUP BY ALL),
      every AS (SELECT {by}, b, sum(total * CASE WHEN (b >> CAST(k AS INT)) & 1 = 1 THEN 1e0 ELSE -1e0 END) AS drawn, sum(total) AS seen FROM numbered, range(0, {2**inference.ENUMERATE}) AS r(b) WHERE c <= {inference.ENUMERATE} AND b < 2 ** c GROUP BY ALL),
      hashed AS (SELECT {by}, total, chunk, CAST(('0x' || substr(md5(concat_ws('|', CAST({seed} AS VARCHAR), 'flip', CAST(chunk AS VARCHAR), cluster)), 1, 12)) AS BIGINT) AS h FROM numbered, range(0, {chunks}) AS r(chunk) WHERE c > {inference.ENUMERATE}),
      drawn AS (SELECT {by}, chunk, bit, sum(total * (2 * ((h >> CAST(bit AS INT)) & 1) - 1)) AS drawn, sum(total) AS seen FROM hashed, range(0, {bits}) AS r(bit) WHERE chunk * {bits} + bit < {N_PERM} GROUP BY ALL),
      flips AS (SELECT {by}, {hit} AS flip_p, 'sign-flip-exact' AS test_method FROM every GROUP BY {by}
        UNION ALL SELECT {by}, (1 + count(*) FILTER ({extreme})) / ({N_PERM} + 1e0), 'sign-flip-mc' FROM drawn GROUP BY {by}),
      spread AS (SELECT {by}, stddev_samp(d) AS sd_d, skewness(d) AS skew, round(min(d), 9) AS low, round(max(d), 9) AS high FROM items WHERE d IS NOT NULL GROUP BY ALL){more}
      SELECT {by}, {shown("mean")} AS estimate, {shown("boot_low")} AS boot_low, {shown("boot_high")} AS boot_high, {_R.format(f"boot_se * {scale}")} AS boot_se, {_R.format(f"se * {scale}")} AS analytic_se,
        {_R.format("mean / se")} AS t_stat, {_R.format(tail.format(p=_tail_sql("(mean / se)", "df")))} AS analytic_p, {_R.format("flip_p")} AS p_value, {_R.format(f"sd_d * {scale}")} AS sd, {_R.format("skew")} AS skewness, df, n_items, n_clusters, test_method,
        CASE WHEN n_clusters < 50 THEN 'analytic' ELSE 'bootstrap' END AS ci_method, {disclosure} AS disclosure, concat_ws('; ', {warned}) AS warnings{columns}
      FROM robust JOIN edges USING ({by}) JOIN flips USING ({by}) JOIN spread USING ({by}) {join}"""


_SCORED = """,
      sides_of AS (SELECT {by}, avg(x_a) FILTER (d IS NOT NULL) AS mean_a, avg(x_b) FILTER (d IS NOT NULL) AS mean_b, count(*) FILTER (d IS NULL) AS n_excluded, count(*) FILTER (side_unbalanced) AS n_side_unbalanced FROM items GROUP BY ALL),
      used AS (SELECT {by}, count(*) FILTER (variant_id IN ('A', 'N')) AS n_records_used, count(*) FILTER (variant_id NOT IN ('A', 'N')) AS n_records_ignored FROM records GROUP BY ALL),
      unbalanced AS (SELECT {by}, array_to_string(list_sort(list(item_id))[1:8], ', ') || CASE WHEN count(*) > 8 THEN ', ...' ELSE '' END AS ids FROM items WHERE side_unbalanced GROUP BY ALL),
      points AS (SELECT {by}, bool_or(2 * n > total) AS degenerate FROM (SELECT {by}, n, sum(n) OVER (PARTITION BY {by}, variant_id) AS total FROM (SELECT {by}, variant_id, judgment, count(*) AS n FROM records WHERE variant_id IN ('A', 'N') GROUP BY ALL)) GROUP BY ALL)"""
_SCORED_JOIN = "JOIN sides_of USING ({by}) JOIN used USING ({by}) LEFT JOIN unbalanced USING ({by}) JOIN points USING ({by})"
_SCORED_COLUMNS = f", {_R.format('mean_a')} AS mean_a, {_R.format('mean_b')} AS mean_b, n_excluded, n_side_unbalanced, n_records_used, n_records_ignored"
_SCORED_WARNINGS = (
    "CASE WHEN n_excluded > 0 THEN n_excluded || ' items lack one of the variants' END",
    "CASE WHEN n_side_unbalanced > 0 THEN CASE WHEN abs(skew) > 1 THEN 'MIND: ' ELSE '' END || n_side_unbalanced || ' items have unlike numbers of calls on their two sides: ' || ids END",
)
_SCALAR = f"""
  records AS ({tables.SCORES_SQL}),
  responses AS (SELECT judge_model, item_id, source_doc_id AS cluster, variant_id, response_id, avg(judgment) AS y, count(*) AS m FROM records WHERE variant_id IN ('A', 'N') GROUP BY ALL),
  sides AS (SELECT judge_model, item_id, cluster, variant_id, avg(y) AS x, list(m ORDER BY m) AS shape FROM responses GROUP BY ALL),
  halves AS (SELECT judge_model, item_id, cluster, max(x) FILTER (variant_id = 'A') AS x_a, max(x) FILTER (variant_id = 'N') AS x_b,
    max(shape) FILTER (variant_id = 'A') <> max(shape) FILTER (variant_id = 'N') AS side_unbalanced FROM sides GROUP BY ALL),
  items AS (SELECT *, x_a - x_b AS d FROM halves)"""
_BINARY = f"""
  records AS (SELECT 'A vs N' AS contrast_id, * FROM ({tables.BINARY_SQL})),
  halves AS (SELECT contrast_id, item_id, '__singleton__:' || item_id AS cluster, max(judgment) FILTER (variant_id = 'A') AS x_a, max(judgment) FILTER (variant_id = 'N') AS x_b, false AS side_unbalanced FROM records WHERE variant_id IN ('A', 'N') GROUP BY ALL),
  items AS (SELECT *, x_a - x_b AS d FROM halves)"""
_BALANCED = """,
      used AS (SELECT {by}, CAST(sum(n_pairs) AS BIGINT) AS n_pairs_used, CAST(sum(n_single_order) AS BIGINT) AS n_pairs_single_order, count(*) FILTER (g IS NULL) AS n_items_dropped, sum(n_ties) / sum(n_calls) AS tie_rate FROM items GROUP BY ALL),
      counts AS (SELECT {by}, count(*) FILTER (y IS NOT NULL AND variant_first <> variant_second) AS n_calls_used, count(*) FILTER (y IS NULL AND variant_first <> variant_second) AS n_calls_skipped, count(*) FILTER (variant_first = variant_second) AS n_same_variant,
        count(DISTINCT judge_model) FILTER (y IS NOT NULL) AS n_judges, array_to_string(list_sort(list(DISTINCT judge_model) FILTER (y IS NOT NULL)), ', ') AS judges FROM calls GROUP BY {by}),
      single AS (SELECT {by}, array_to_string(list_sort(list(pair_id))[1:8], ', ') || CASE WHEN count(*) > 8 THEN ', ...' ELSE '' END AS ids FROM pairs WHERE orders < 2 GROUP BY ALL)"""
_BALANCED_JOIN = "JOIN used USING ({by}) JOIN counts USING ({by}) LEFT JOIN single USING ({by})"
_BALANCED_COLUMNS = f", n_pairs_used, n_pairs_single_order, n_items_dropped, {_R.format('tie_rate')} AS tie_rate, n_calls_used, n_calls_skipped, n_same_variant, n_judges, judges"
_BALANCED_WARNINGS = (
    "CASE WHEN n_pairs_single_order > 0 THEN 'MIND: ' || n_pairs_single_order || ' pairs without one of their orders are left out: ' || ids || '; so are items without another pair: ' || n_items_dropped END",
    "CASE WHEN n_judges > 1 THEN 'a mixture of judges: ' || judges END",
)
_VARIANTS = f"""
  responses AS (SELECT item_id, source_doc_id AS cluster, variant_id, response_id, avg(judgment) AS y FROM ({tables.SCORES_SQL}) GROUP BY ALL),
  x AS (SELECT item_id, cluster, variant_id, avg(y) AS x FROM responses GROUP BY ALL),
  items AS (SELECT a.variant_id || ' vs ' || b.variant_id AS contrast_id, a.item_id, a.cluster, a.x - b.x AS d FROM x a JOIN x b ON a.item_id = b.item_id AND {{chosen}})"""
_ARM_ITEMS = f"""
  arms AS (SELECT * REPLACE (CASE arm WHEN 'own' THEN CASE WHEN ends_with(pair_id, '::A') THEN 'padded' ELSE 'condensed' END ELSE 'pooled' END AS arm) FROM ({_ARMS})),
  calls AS (SELECT *, coalesce(nullif(source_doc_id, ''), '__singleton__:' || item_id) AS cluster, {_LONGER} AS y FROM arms),
  orders AS (SELECT arm, item_id, cluster, pair_id, variant_first, avg(y) AS y FROM calls WHERE y IS NOT NULL GROUP BY ALL),
  pairs AS (SELECT arm, item_id, cluster, pair_id, avg(y) AS y FROM orders GROUP BY ALL HAVING count(*) >= 2),
  own AS MATERIALIZED (SELECT arm, item_id, cluster, avg(y) AS g FROM pairs GROUP BY ALL),
  items AS (SELECT arm, item_id, cluster, 2 * g - 1 AS d FROM own
    UNION ALL SELECT 'check', p.item_id, p.cluster, 2 * (p.g - c.g) FROM own p JOIN own c ON p.item_id = c.item_id AND p.arm = 'padded' AND c.arm = 'condensed')"""
_SELF_ITEMS = f"""{_pairwise_sql(by="judge_model").replace("items AS", "judged AS")},
  seen AS (SELECT item_id, cluster, max(s) FILTER (judge_model = 'judge-0') AS s_self, avg(s) FILTER (judge_model <> 'judge-0') AS s_panel, count(*) FILTER (judge_model <> 'judge-0') AS n_panel FROM judged GROUP BY ALL),
  items AS (SELECT 'judge-0 on A' AS contrast_id, *, s_self - s_panel AS d FROM seen)"""
_MCNEMAR = """,
      cells AS (SELECT contrast_id, count(*) FILTER (x_a > x_b) AS n_pass_fail, count(*) FILTER (x_a < x_b) AS n_fail_pass FROM items GROUP BY ALL)"""
_MCNEMAR_P = """round(CASE WHEN n_pass_fail = n_fail_pass THEN 1e0 ELSE least(1e0, list_sum(list_transform(range(0, least(n_pass_fail, n_fail_pass) + 1),
        lambda i: 2 * exp(lgamma(n_pass_fail + n_fail_pass + 1e0) - lgamma(i + 1e0) - lgamma(n_pass_fail + n_fail_pass - i + 1e0) - (n_pass_fail + n_fail_pass) * ln(2e0))))) END, 9) + 0e0 AS mcnemar_p"""

ORACLE_SQL = {
    "compare_pairwise_report": _report_sql(
        _pairwise_sql(by="judge_model"), "judge_model", scale="0.5e0", offset="0.5e0",
        more=""",
      counts AS (SELECT judge_model, CAST(sum(n_pairs) AS BIGINT) AS n_pairs, CAST(sum(n_single_order) AS BIGINT) AS n_single_order, CAST(sum(n_calls) AS BIGINT) AS n_calls, sum(n_ties) / sum(n_calls) AS tie_rate FROM items GROUP BY ALL),
      used AS (SELECT judge_model, count(*) AS n_records_used, CAST(0 AS BIGINT) AS n_records_ignored FROM calls GROUP BY ALL)""",
        join="JOIN counts USING (judge_model) JOIN used USING (judge_model)",
        columns=f", n_pairs, n_single_order, n_calls, {_R.format('tie_rate')} AS tie_rate, n_pairs > 0 AND n_single_order = 0 AS counterbalanced, n_records_used, n_records_ignored",
        warnings=("CASE WHEN n_single_order > 0 THEN n_single_order || ' pairs lack one of their two orders' END", "CASE WHEN tie_rate > 0.3e0 THEN 'ties make up over 30% of the calls, which brings the win rate closer to 0.5' END"),
    ),
    "compare_pairwise_greater_report": _report_sql(
        _pairwise_sql(by="judge_model"), "judge_model", scale="0.5e0", offset="0.5e0", alternative="greater",
        more=""",
      counts AS (SELECT judge_model, CAST(sum(n_single_order) AS BIGINT) AS n_single_order, sum(n_ties) / sum(n_calls) AS tie_rate FROM items GROUP BY ALL)""",
        join="JOIN counts USING (judge_model)", columns=f", {_R.format('tie_rate')} AS tie_rate",
        warnings=("CASE WHEN n_single_order > 0 THEN n_single_order || ' pairs lack one of their two orders' END", "CASE WHEN tie_rate > 0.3e0 THEN 'ties make up over 30% of the calls, which brings the win rate closer to 0.5' END"),
    ),
    "compare_scalar_less_report": _report_sql(
        _SCALAR, "judge_model", more=_SCORED.format(by="judge_model"), join=_SCORED_JOIN.format(by="judge_model"), columns=_SCORED_COLUMNS, alternative="less",
        warnings=(*_SCORED_WARNINGS, "CASE WHEN degenerate THEN 'more than half of a variant''s scores are the same' END"),
    ),
    "compare_scalar_report": _report_sql(
        _SCALAR, "judge_model", more=_SCORED.format(by="judge_model"), join=_SCORED_JOIN.format(by="judge_model"), columns=_SCORED_COLUMNS,
        warnings=(*_SCORED_WARNINGS, "CASE WHEN degenerate THEN 'more than half of a variant''s scores are the same' END"),
    ),
    "compare_binary_report": _report_sql(
        _BINARY, "contrast_id", more=_SCORED.format(by="contrast_id") + _MCNEMAR, join=_SCORED_JOIN.format(by="contrast_id") + " JOIN cells USING (contrast_id)",
        columns=f"{_SCORED_COLUMNS}, n_pass_fail, n_fail_pass, n_pass_fail + n_fail_pass AS n_discordant, {_MCNEMAR_P}",
        warnings=(*_SCORED_WARNINGS, "CASE WHEN n_pass_fail + n_fail_pass < 10 THEN 'fewer than 10 discordant items' END"),
    ),
    "position_bias_report": _report_sql(
        _balanced_sql(_FIRST, "judge_model"), "judge_model", scale="0.5e0", more=_BALANCED.format(by="judge_model"), join=_BALANCED_JOIN.format(by="judge_model"), columns=_BALANCED_COLUMNS, warnings=_BALANCED_WARNINGS,
    ),
    "verbosity_association_report": _report_sql(
        _balanced_sql(_LONGER, "contrast_id", f"SELECT 'all' AS contrast_id, * FROM ({tables.PAIRWISE_SQL})"), "contrast_id", scale="0.5e0", offset="0.5e0",
        more=_BALANCED.format(by="contrast_id"), join=_BALANCED_JOIN.format(by="contrast_id"), columns=_BALANCED_COLUMNS, warnings=_BALANCED_WARNINGS,
    ),
    "verbosity_controlled_report": _report_sql(_ARM_ITEMS, "arm", scale="0.5e0", seed=f"({SEED} + CASE arm WHEN 'padded' THEN 1 WHEN 'condensed' THEN 2 WHEN 'check' THEN 3 ELSE 0 END)"),
    "self_preference_report": _report_sql(
        _SELF_ITEMS, "contrast_id",
        more=""",
      sides AS (SELECT contrast_id, count(*) FILTER (s_self IS NOT NULL AND s_panel IS NULL) AS n_self_only, count(*) FILTER (s_self IS NULL) AS n_panel_only, min(n_panel) FILTER (d IS NOT NULL) AS panel_min, max(n_panel) FILTER (d IS NOT NULL) AS panel_max, avg(s_self) - 0.5e0 AS naive FROM items GROUP BY ALL)""",
        join="JOIN sides USING (contrast_id)", columns=f", n_self_only, n_panel_only, panel_min, panel_max, {_R.format('naive')} AS naive",
    ),
    "non_inferiority_report": _report_sql(
        _VARIANTS.format(chosen="b.variant_id = 'N' AND a.variant_id <> 'N'"), "contrast_id",
        columns=f", CASE WHEN n_clusters < 50 THEN mean + {MARGIN}e0 > 0 AND {_tail_sql(f'((mean + {MARGIN}e0) / se)', 'df')} < 0.05e0 ELSE boot_low > -{MARGIN}e0 END AS non_inferior",
    ),
    "contrast_matrix_report": _report_sql(
        _VARIANTS.format(chosen="a.variant_id < b.variant_id"), "contrast_id", alpha="(0.05e0 / 3)",
        more=""",
      ranked AS (SELECT *, row_number() OVER (ORDER BY flip_p, contrast_id) AS place, row_number() OVER (ORDER BY mean DESC, contrast_id) = 1 AS best, count(*) OVER () AS family_size FROM flips JOIN means USING (contrast_id)),
      family AS (SELECT contrast_id, best, CAST(family_size AS INT) AS family_size, least(1e0, max((family_size - place + 1) * flip_p) OVER (ORDER BY place)) AS holm_p FROM ranked)""",
        join="JOIN family USING (contrast_id)", columns=f", {_R.format('holm_p')} AS holm, best, family_size",
        warnings=("CASE WHEN best AND family_size > 1 THEN 'the best of ' || family_size || ' contrasts overstates its effect' END",),
    ),
}
