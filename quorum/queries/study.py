"""What a study reports beside its estimates: reliability, failures by order, agreement, arms, plans and designs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quorum.functions import distributions, recode, verdicts
from quorum.functions.ids import cache_key
from quorum.operators import inference, planning, reduce, variance
from quorum.plans import compare, requests
from quorum.plans import study as phases
from quorum.queries.bias import _FIRST, _balanced_sql
from quorum.queries.judging import SELF_ID
from quorum.queries.judgments import _pairwise_sql, _scores_sql, rounded
from quorum.queries.reports import DRAWS, SEED, _flat, _report_sql
from quorum.sources import tables
from quorum.sources.tables import table

JUDGE = ["judge_model"]
#: Differences that designs are made for.
DELTAS = (0.05, 0.1, 0.2)


def judge_reliability(spark: SparkSession, sf: str) -> DataFrame:
    """Noise within pair and order, variance between items, and ICC, by judge."""
    calls = tables.pairwise_judgments(spark, sf)
    noise = variance.judge_variance(calls.withColumn("y", recode.prefers("A")), "y", ["pair_id", "variant_first"], JUDGE).select("judge_model", "sigma2_j")
    items = reduce.reduce_pairwise(calls, "A", "B", JUDGE).join(noise, "judge_model")
    # d is twice the win rate less one, so its variance is four times that of the mean of its calls
    items = items.withColumn("within", 4 * variance.within_item_variance(F.col("n_calls"), F.lit(1.0), F.col("sigma2_j"), pairwise=True))
    rows = variance.variance_components(items, "within", JUDGE).join(noise, "judge_model")
    return rounded(rows.select(*JUDGE, "sigma2_j", "sigma2_w", "sigma2_b", "icc", "truncated"), "sigma2_j", "sigma2_w", "sigma2_b", "icc")


def _outputs(spark: SparkSession, sf: str) -> DataFrame:
    """Pairwise calls with whether their text has no verdict: some texts are spoilt on purpose."""
    calls = tables.pairwise_judgments(spark, sf)
    spoilt = F.col("judge_call_id").startswith("3") | (F.col("judge_call_id").startswith("4") & (F.col("variant_first") == "A"))
    text = F.when(spoilt, "no verdict").otherwise(F.concat(F.lit("VERDICT: "), F.col("judgment")))
    return calls.withColumn("failed", verdicts.pairwise_verdict(text)["error"].isNotNull())


def parse_failures_by_order(spark: SparkSession, sf: str) -> DataFrame:
    """Share of calls without a verdict, by judge and presentation order."""
    rows = _outputs(spark, sf).groupBy("judge_model", "variant_first").agg(F.count("*").alias("n_calls"), F.count_if("failed").alias("n_failed"))
    return rounded(rows.withColumn("share", F.col("n_failed") / F.col("n_calls")), "share")


def parse_failure_asymmetry(spark: SparkSession, sf: str) -> DataFrame:
    """Whether one order fails more often: the engine on each pair's difference of failure rates, by judge."""
    items = reduce.order_difference(_outputs(spark, sf), F.col("failed").cast("double"), "A", JUDGE)
    rows = compare.report(items, JUDGE, seed=SEED, **DRAWS)
    return _flat(rows, "judge_model").withColumn("passes", F.col("p_value") > 0.05)


def near_tie_content(spark: SparkSession, sf: str) -> DataFrame:
    """Whether arms that should be exchangeable win alike: the near-tie stratum (return flag N), by judge."""
    near = tables.pairwise_judgments(spark, sf).where(F.col("pair_id").endswith("::N"))
    rows = compare.compare_pairwise(near, "A", "B", JUDGE, seed=SEED, **DRAWS)
    return _flat(rows, "judge_model").drop("warnings").withColumn("passes", F.col("p_value") > 0.05)


def position_bias_by_stratum(spark: SparkSession, sf: str) -> DataFrame:
    """Position bias by judge and stratum."""
    by = ["judge_model", "stratum"]
    calls = tables.pairwise_judgments(spark, sf).withColumn("stratum", F.when(F.col("pair_id").endswith("::N"), "near-tie").otherwise("gap"))
    items = reduce.order_balanced(calls, recode.prefers_first(), by)
    rows = inference.cluster_robust(inference.cluster_totals(items, by), by)
    return rounded(rows.select(*by, "n_items", "n_clusters", (F.col("estimate") / 2).alias("beta"), (F.col("se") / 2).alias("se")), "beta", "se")


def judge_differences(spark: SparkSession, sf: str) -> DataFrame:
    """Differences of position bias between judges, paired by pair."""
    pairs = reduce.balanced_pairs(tables.pairwise_judgments(spark, sf), recode.prefers_first(), JUDGE)
    rows = compare.report(compare.judge_contrasts(pairs), ["contrast_id"], seed=SEED, **DRAWS)
    return _flat(rows, "contrast_id")


def krippendorff_alpha(spark: SparkSession, sf: str) -> DataFrame:
    """Agreement of all judges over pair and order, for nominal judgments."""
    return rounded(reduce.krippendorff_alpha(tables.pairwise_judgments(spark, sf), ["pair_id", "variant_first"], "judgment"), "agreement", "chance", "alpha")


def arm_check(spark: SparkSession, sf: str) -> DataFrame:
    """What became of near-tie responses: each document answers beside the first one of its length, by id, and the last one is the new response.

    The first document of a length is the other side of all the rest, so every document takes part that isn't alone in its length.
    """
    docs = table(spark, sf, "documents").where(F.col("text").isNotNull() & F.col("n_chars").isNotNull())
    ends = docs.groupBy("n_chars").agg(F.min("doc_id").alias("least"), F.min_by("text", "doc_id").alias("first"), F.max_by("text", "doc_id").alias("last"))
    rows = docs.join(ends, "n_chars").where(F.col("doc_id") != F.col("least"))
    side = lambda v, text: F.struct(F.lit(v).alias("variant_id"), F.col(text).alias("text"))
    shown = rows.select(F.col("doc_id").alias("prompt_id"), F.inline(F.array(side("first", "first"), side("second", "text"), side("second-again", "last"))))
    return phases.check_arms(shown, "first", "second", shown.where("variant_id = 'second-again'"))


def arm_check_summary(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(phases.arm_summary(arm_check(spark, sf)), "share")


def judge_configs(spark: SparkSession, sf: str) -> DataFrame:
    """Planned calls by judge configuration."""
    plan = phases.with_judge_config(tables.request_plan_rows(spark, sf), {"judge-1": '{"thinking":"disabled"}'}, '{"max_tokens":64}')
    return plan.groupBy("judge_config_id", "params").agg(F.count("*").alias("n_calls"))


def cache_key_reuse(spark: SparkSession, sf: str) -> DataFrame:
    """Distinct requests and cache keys by judge, where half of the calls list their parameters in another order."""
    calls = tables.pairwise_judgments(spark, sf)
    params = F.when(F.col("tokens_first") % 2 == 0, '{"a": 1, "b": "x"}').otherwise('{"b":"x","a":1}')
    keys = calls.select("judge_model", cache_key(F.concat("pair_id", F.lit(" "), "variant_first"), F.col("judge_model"), F.lit(7), params).alias("key"))
    return keys.groupBy("judge_model").agg(F.count("*").alias("n_calls"), F.count_distinct("key").alias("n_keys"))


def resume_full_set(spark: SparkSession, sf: str) -> DataFrame:
    """What a resumed run returns: the records of all its tasks, old and new, by the tasks' order."""
    tasks = tables.request_plan_rows(spark, sf).where("call_role = 'primary'").select("judge_call_id", F.col("judge_call_id").alias("position")).distinct()
    store = tables.realized_rows(spark, sf).groupBy("judge_call_id").agg(F.min("judgment").alias("judgment"))
    return requests.full_set(tasks, store, "judge_call_id", "position")


def prompt_set(spark: SparkSession, sf: str) -> DataFrame:
    """The prompts that a study keeps, each with the digest that its set is known by."""
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("prompt_id"), "text")
    return requests.prompt_set(docs, SELF_ID, 40, 2500).select("prompt_id", "text_sha256")


def binary_design(spark: SparkSession, sf: str) -> DataFrame:
    """The difference of pass rates that the data can find, from their items and discordance."""
    rows = reduce.concordance(reduce.reduce_scores(tables.binary_judgments(spark, sf), "A", "N"))
    n = F.col("n_pass_pass") + F.col("n_pass_fail") + F.col("n_fail_pass") + F.col("n_fail_fail")
    rows = rows.select(n.alias("n_items"), (F.col("n_discordant") / n).alias("psi"))
    return rounded(rows.withColumn("detectable", planning.detectable_binary(F.col("n_items"), F.col("psi"))), "psi", "detectable")


def mean_designs(spark: SparkSession, sf: str) -> DataFrame:
    """By judge and difference: the items that a study needs to find it, and what the items at hand find, from the items' deviation."""
    rows = reduce.paired(reduce.reduce_pairwise(tables.pairwise_judgments(spark, sf), "A", "B", JUDGE)).groupBy(*JUDGE).agg(F.count("*").alias("n_items"), F.stddev_samp("d").alias("sd"))
    rows = rows.withColumn("delta", F.explode(F.array(*[F.lit(x) for x in DELTAS])))
    rows = rows.withColumns({"items_needed": planning.items_for_mean(F.col("delta"), F.col("sd"), deff=1.5), "detectable": planning.detectable_mean(F.col("n_items"), F.col("sd"))})
    return rounded(rows.withColumn("detectable", F.round("detectable", 6)), "sd", "detectable")


def binary_designs(spark: SparkSession, sf: str) -> DataFrame:
    """By share of the discordance that is a difference of pass rates: the items that find it, and the power of the items at hand."""
    rows = reduce.concordance(reduce.reduce_scores(tables.binary_judgments(spark, sf), "A", "N"))
    n = F.col("n_pass_pass") + F.col("n_pass_fail") + F.col("n_fail_pass") + F.col("n_fail_fail")
    rows = rows.select(n.alias("n_items"), (F.col("n_discordant") / n).alias("psi")).withColumn("share", F.explode(F.array(*[F.lit(x) for x in DELTAS])))
    delta = F.col("share") * F.col("psi")
    rows = rows.withColumns({"items_needed": planning.items_for_binary(delta, F.col("psi")), "power": planning.power_binary(F.col("n_items"), delta, F.col("psi"))})
    return rounded(rows, "psi", "power")


def clustered_design(spark: SparkSession, sf: str) -> DataFrame:
    """Design effect of the score comparison at an intraclass correlation of 0.1."""
    items = reduce.paired(reduce.reduce_scores(tables.score_judgments(spark, sf), "A", "N"))
    rows = inference.cluster_totals(items, []).agg(F.avg("size").alias("mean_size"))
    return rounded(rows.withColumn("deff", planning.design_effect(F.col("mean_size"), F.lit(0.1))), "mean_size", "deff")


QUERIES = {
    f.__name__: f
    for f in (
        judge_reliability, parse_failures_by_order, parse_failure_asymmetry, near_tie_content, position_bias_by_stratum, judge_differences, krippendorff_alpha, arm_check, arm_check_summary,
        judge_configs, cache_key_reuse, resume_full_set, prompt_set, binary_design, mean_designs, binary_designs, clustered_design,
    )
}

_R = "round({}, 9) + 0e0"
_OUTPUTS = f"SELECT *, starts_with(judge_call_id, '3') OR (starts_with(judge_call_id, '4') AND variant_first = 'A') AS failed FROM ({tables.PAIRWISE_SQL})"
_CLUSTER = "coalesce(nullif(source_doc_id, ''), '__singleton__:' || item_id)"
_ARM_CHECK = """WITH d AS (SELECT * FROM documents WHERE text IS NOT NULL AND n_chars IS NOT NULL),
      e AS (SELECT n_chars, min(doc_id) AS least, arg_min(text, doc_id) AS a, arg_max(text, doc_id) AS c FROM d GROUP BY n_chars),
      checked AS (SELECT doc_id AS prompt_id, CASE WHEN text <> a THEN 'distinct' WHEN c <> a THEN 'regenerated' ELSE 'excluded' END AS status,
        CASE WHEN text <> a THEN 'second' WHEN c <> a THEN 'second-again' END AS second FROM d JOIN e USING (n_chars) WHERE doc_id <> least)"""
_EDGE, _REACH = (repr(distributions.normal_quantile(p)) for p in (0.975, 0.8))
_A, _B = f"{_EDGE}e0", f"{_REACH}e0"
_DELTAS = f"unnest([{', '.join(f'{x}e0' for x in DELTAS)}])"


def _t(z: str, df: str) -> str:
    """SQL of Student's t quantile by its expansion around the normal quantile z, right to 8 digits from 30 degrees of freedom on."""
    return f"""({z} + ({z} ** 3 + {z}) / 4 / {df} + (5 * {z} ** 5 + 16 * {z} ** 3 + 3 * {z}) / 96 / {df} ** 2 + (3 * {z} ** 7 + 19 * {z} ** 5 + 17 * {z} ** 3 - 15 * {z}) / 384 / {df} ** 3
      + (79 * {z} ** 9 + 776 * {z} ** 7 + 1482 * {z} ** 5 - 1920 * {z} ** 3 - 945 * {z}) / 92160 / {df} ** 4)"""


def _least(size: str, start: str) -> str:
    """SQL of the least n from ``start`` on that is no smaller than ``size``, which is written in a and b, the quantiles at n - 1."""
    sized = size.replace("{a}", _t(_A, "(n - 1e0)")).replace("{b}", _t(_B, "(n - 1e0)"))
    return f"list_min(list_filter(range(CAST({start} AS BIGINT), CAST({start} AS BIGINT) + 20), lambda n: n >= {sized}))"


ORACLE_SQL = {
    "judge_reliability": f"""WITH {_pairwise_sql(by="judge_model")},
      g AS (SELECT judge_model, count(*) AS n, var_samp(y) AS v FROM calls GROUP BY judge_model, pair_id, variant_first HAVING count(*) >= 2),
      j AS (SELECT judge_model, sum(v * (n - 1)) / sum(n - 1) AS sigma2_j FROM g GROUP BY ALL),
      w AS (SELECT judge_model, sigma2_j, var_samp(d) AS v, avg(4 * sigma2_j / n_calls) AS sigma2_w FROM items JOIN j USING (judge_model) GROUP BY ALL)
      SELECT judge_model, {_R.format("sigma2_j")} AS sigma2_j, {_R.format("sigma2_w")} AS sigma2_w, {_R.format("greatest(v - sigma2_w, 0)")} AS sigma2_b,
        {_R.format("greatest(v - sigma2_w, 0) / (greatest(v - sigma2_w, 0) + sigma2_w)")} AS icc, v < sigma2_w AS truncated FROM w""",
    "parse_failures_by_order": f"SELECT judge_model, variant_first, count(*) AS n_calls, count(*) FILTER (failed) AS n_failed, {_R.format('count(*) FILTER (failed) / count(*)')} AS share FROM ({_OUTPUTS}) GROUP BY ALL",
    "parse_failure_asymmetry": "SELECT *, p_value > 0.05e0 AS passes FROM ("
    + _report_sql(
        f"""calls AS ({_OUTPUTS}),
      orders AS (SELECT judge_model, item_id, pair_id, {_CLUSTER} AS cluster, variant_first, avg(CAST(failed AS DOUBLE)) AS y FROM calls GROUP BY ALL),
      items AS (SELECT judge_model, item_id, cluster, max(y) FILTER (variant_first = 'A') - max(y) FILTER (variant_first <> 'A') AS d FROM orders GROUP BY judge_model, item_id, cluster, pair_id)""",
        "judge_model",
    )
    + ")",
    "near_tie_content": "SELECT * EXCLUDE (warnings), p_value > 0.05e0 AS passes FROM (" + _report_sql(_pairwise_sql(by="judge_model", where="WHERE ends_with(pair_id, '::N')"), "judge_model", scale="0.5e0", offset="0.5e0") + ")",
    "position_bias_by_stratum": f"""WITH strata AS (SELECT *, CASE WHEN ends_with(pair_id, '::N') THEN 'near-tie' ELSE 'gap' END AS stratum FROM ({tables.PAIRWISE_SQL})), {_balanced_sql(_FIRST, "judge_model, stratum", "FROM strata")},
      totals AS (SELECT judge_model, stratum, cluster, sum(d) AS total, count(*) AS size FROM items WHERE d IS NOT NULL GROUP BY ALL),
      means AS (SELECT judge_model, stratum, CAST(sum(size) AS BIGINT) AS n_items, count(*) AS n_clusters, sum(total) / sum(size) AS mean FROM totals GROUP BY ALL),
      squares AS (SELECT judge_model, stratum, n_items, n_clusters, mean, sum((total - size * mean) ** 2) AS q FROM totals JOIN means USING (judge_model, stratum) GROUP BY ALL)
      SELECT judge_model, stratum, n_items, n_clusters, {_R.format("mean / 2")} AS beta, {_R.format("sqrt(n_clusters / (n_clusters - 1) * q) / n_items / 2")} AS se FROM squares""",
    "judge_differences": _report_sql(
        f"""{_balanced_sql(_FIRST, "judge_model").replace("items AS", "unused AS")},
      both_orders AS (SELECT * FROM pairs WHERE orders >= 2),
      items AS (SELECT a.judge_model || ' vs ' || b.judge_model AS contrast_id, a.item_id, a.cluster, a.y - b.y AS d FROM both_orders a JOIN both_orders b ON a.pair_id = b.pair_id AND a.item_id = b.item_id AND a.judge_model < b.judge_model)""",
        "contrast_id",
    ),
    "krippendorff_alpha": f"""WITH v AS (SELECT pair_id, variant_first, judgment, count(*) AS n FROM ({tables.PAIRWISE_SQL}) GROUP BY ALL),
      u AS (SELECT *, sum(n) OVER (PARTITION BY pair_id, variant_first) AS m FROM v),
      k AS (SELECT * FROM u WHERE m >= 2),
      t AS (SELECT sum(n) AS n, sum(n * (n - 1) / (m - 1)) / sum(n) AS agreement, count(DISTINCT (pair_id, variant_first)) AS n_units FROM k),
      c AS (SELECT sum(s * (s - 1)) AS q FROM (SELECT judgment, sum(n) AS s FROM k GROUP BY judgment))
      SELECT n_units, CAST(n AS BIGINT) AS n_judgments, {_R.format("agreement")} AS agreement, {_R.format("q / (n * (n - 1))")} AS chance, {_R.format("1 - (1 - agreement) / (1 - q / (n * (n - 1)))")} AS alpha FROM t, c""",
    "arm_check": f"{_ARM_CHECK} SELECT * FROM checked",
    "arm_check_summary": f"""{_ARM_CHECK} SELECT count(*) AS n_checked, count(*) FILTER (status <> 'distinct') AS n_regenerated, count(*) FILTER (status = 'excluded') AS n_excluded,
      {_R.format("count(*) FILTER (status = 'excluded') / count(*)")} AS share, count(*) FILTER (status = 'excluded') / count(*) <= 0.05e0 AS passes FROM checked""",
    "judge_configs": f"""SELECT judge_model || '-v1' AS judge_config_id, CASE judge_model WHEN 'judge-1' THEN '{{"thinking":"disabled"}}' ELSE '{{"max_tokens":64}}' END AS params, count(*) AS n_calls FROM ({tables.PLAN_SQL}) GROUP BY ALL""",
    "cache_key_reuse": f"SELECT judge_model, count(*) AS n_calls, count(DISTINCT (pair_id, variant_first)) AS n_keys FROM ({tables.PAIRWISE_SQL}) GROUP BY ALL",
    "resume_full_set": f"""SELECT p.judge_call_id, p.judge_call_id AS position, b.judgment FROM (SELECT DISTINCT judge_call_id FROM ({tables.PLAN_SQL}) WHERE call_role = 'primary') p
      JOIN (SELECT judge_call_id, min(judgment) AS judgment FROM ({tables.REALIZED_SQL}) GROUP BY ALL) b USING (judge_call_id)""",
    "prompt_set": r"""SELECT doc_id AS prompt_id, sha256(text) AS text_sha256 FROM documents WHERE NOT regexp_matches(text, '(?i)\b(as an ai|language model)\b') AND length(text) BETWEEN 40 AND 2500""",
    "binary_design": f"""WITH b AS (SELECT item_id, max(judgment) FILTER (variant_id = 'A') AS x, max(judgment) FILTER (variant_id = 'N') AS y FROM ({tables.BINARY_SQL}) GROUP BY ALL),
      s AS (SELECT count(*) AS n, count(*) FILTER (x <> y) / count(*) AS psi FROM b WHERE x IS NOT NULL AND y IS NOT NULL)
      SELECT n AS n_items, {_R.format("psi")} AS psi,
        {_R.format(f"({_EDGE} * sqrt(psi * n) + sqrt({_EDGE} ** 2 * psi * n - (n + {_REACH} ** 2) * ({_EDGE} ** 2 - {_REACH} ** 2) * psi)) / (n + {_REACH} ** 2)")} AS detectable FROM s""",
    "mean_designs": f"""WITH {_pairwise_sql(by="judge_model")}, s AS (SELECT judge_model, count(*) AS n_items, stddev_samp(d) AS sd FROM items WHERE d IS NOT NULL GROUP BY ALL),
      g AS (SELECT *, {_DELTAS} AS delta FROM s)
      SELECT judge_model, n_items, {_R.format("sd")} AS sd, delta, CAST(ceil({_least("(({a} + {b}) * sd / delta) ** 2", f"floor((({_A} + {_B}) * sd / delta) ** 2)")} * 1.5e0) AS BIGINT) AS items_needed,
        round(({_t(_A, "(n_items - 1e0)")} + {_t(_B, "(n_items - 1e0)")}) * sd / sqrt(n_items), 6) + 0e0 AS detectable FROM g""",
    # the normal law by its series: 1/2 + density * sum of z^(2k+1) / (1 * 3 * ... * (2k+1))
    "binary_designs": f"""WITH b AS (SELECT item_id, max(judgment) FILTER (variant_id = 'A') AS x, max(judgment) FILTER (variant_id = 'N') AS y FROM ({tables.BINARY_SQL}) GROUP BY ALL),
      s AS (SELECT count(*) AS n_items, count(*) FILTER (x <> y) / count(*) AS psi FROM b WHERE x IS NOT NULL AND y IS NOT NULL),
      g AS (SELECT *, share * psi AS d FROM (SELECT *, {_DELTAS} AS share FROM s)),
      z AS (SELECT *, (sqrt(n_items) * d - {_A} * sqrt(psi)) / sqrt(psi - d ** 2) AS z FROM g)
      SELECT n_items, {_R.format("psi")} AS psi, share, {_least("(({a} * sqrt(psi) + {b} * sqrt(psi - d ** 2)) / d) ** 2", f"floor((({_A} * sqrt(psi) + {_B} * sqrt(psi - d ** 2)) / d) ** 2)")} AS items_needed,
        {_R.format("0.5e0 + sign(z) * exp(-z * z / 2) / sqrt(2 * pi()) * list_sum(list_transform(range(0, 400), lambda k: exp((2 * k + 1) * ln(abs(z)) - lgamma(2 * k + 2e0) + k * ln(2e0) + lgamma(k + 1e0))))")} AS power FROM z""",
    "clustered_design": f"""WITH {_scores_sql()}, t AS (SELECT cluster, count(*) AS size FROM items WHERE x_a - x_b IS NOT NULL GROUP BY ALL)
      SELECT {_R.format("avg(size)")} AS mean_size, {_R.format("1 + (avg(size) - 1) * 0.1e0")} AS deff FROM t""",
}
