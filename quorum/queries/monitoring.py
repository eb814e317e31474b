"""Monitoring over runs, nested variance, agreement by level of measurement, and intervals of what isn't a mean."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quorum.functions import recode
from quorum.operators import agreement, asof, inference, reduce, replicates, rollup, sequences, sketches, variance
from quorum.operators.running import join_null_safe
from quorum.queries.bias import _FIRST, _balanced_sql
from quorum.queries.judgments import N_BOOT, SEED, _CLUSTER, _PLACED, _pairwise_sql, _scores_sql, mixed_sql, rounded
from quorum.sources import tables
from quorum.streaming import gate

#: Clusters (over all runs) at which the horizon method is narrowest.
HORIZON = 2_000
WORDS = ("first", "second", "tie")
UNIT = ["pair_id", "variant_first"]
PROBABILITIES = (0.5, 0.95, 0.99)


def _sequence(spark: SparkSession, sf: str, method: str, horizon: int | None) -> DataFrame:
    calls = tables.dated_judgments(spark, sf).withColumns({"y": recode.prefers("A"), "cluster": recode.cluster_key()})
    rows = sequences.confidence_sequence(sequences.cluster_means(calls, ["judge_model"], "run", "y"), ["judge_model"], method, 0.0, 1.0, horizon=horizon)
    return rounded(rows, "estimate", "cs_low", "cs_high", "all_low", "all_high")


def win_rate_sequence(spark: SparkSession, sf: str) -> DataFrame:
    """The win rate over monthly runs, by judge, with intervals that hold at every month at once."""
    return _sequence(spark, sf, "anytime", None)


def win_rate_sequence_to_horizon(spark: SparkSession, sf: str) -> DataFrame:
    """The same, narrowest once HORIZON clusters are in."""
    return _sequence(spark, sf, "horizon", HORIZON)


def _nested(spark: SparkSession, sf: str):
    scores = tables.score_judgments(spark, sf).where(F.col("variant_id").isin("A", "N"))
    return scores, variance.nested_variance(scores, "judgment", ["item_id", "variant_id"], "response_id")


def nested_variance(spark: SparkSession, sf: str) -> DataFrame:
    """Variance between responses of an item and variant, and between calls for a response."""
    return rounded(_nested(spark, sf)[1], "sigma2_j", "sigma2_g", "weight")


def nested_components(spark: SparkSession, sf: str) -> DataFrame:
    """What differences of items are made of: generation, judging, and items."""
    scores, nested = _nested(spark, sf)
    noise = variance.item_noise(scores, "judgment", ["A", "N"], nested)
    items = join_null_safe(reduce.reduce_scores(scores, "A", "N"), noise, ["item_id"])
    rows = join_null_safe(variance.variance_components(items, "within"), nested.select("sigma2_j", "sigma2_g"), [])
    return rounded(rows, "var_d", "sigma2_w", "sigma2_b", "icc", "sigma2_j", "sigma2_g")


def score_alpha(spark: SparkSession, sf: str) -> DataFrame:
    """Ordinal and interval agreement on scores from 1 to 5, over items and variants with any number of judgments."""
    scores = tables.score_judgments(spark, sf)
    rows = [agreement.krippendorff(scores, ["item_id", "variant_id"], "judgment", level).withColumn("level", F.lit(level)) for level in ("ordinal", "interval")]
    return rounded(rows[0].unionByName(rows[1]), "observed", "expected", "alpha")


def _intervals(stats: DataFrame, columns: list[str], statistics: dict) -> DataFrame:
    rows = replicates.intervals(stats, [], columns, statistics, SEED, n_boot=N_BOOT)
    return rounded(rows, "estimate", "boot_low", "boot_high", "boot_se")


def effect_supplement_intervals(spark: SparkSession, sf: str) -> DataFrame:
    """Cluster bootstrap intervals of the win rate without ties and of d over its standard deviation, from N_BOOT draws."""
    calls = tables.pairwise_judgments(spark, sf).withColumns({"y": recode.prefers("A"), "cluster": recode.cluster_key()})
    wins = calls.groupBy("cluster").agg(F.count_if(F.col("y") == 1).alias("wins"), F.count_if(F.col("y") == 0).alias("losses"))
    d = replicates.moments(reduce.reduce_pairwise(tables.pairwise_judgments(spark, sf), "A", "B"), [])
    stats = wins.join(d, "cluster", "full").withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in ("wins", "losses", "n", "total", "squares")})
    rate = F.try_divide(F.col("wins"), F.col("wins") + F.col("losses"))
    return _intervals(stats, ["wins", "losses", "n", "total", "squares"], {"conditional_win_rate": rate, "d_z": replicates.standardized()})


def nominal_alpha_interval(spark: SparkSession, sf: str) -> DataFrame:
    """Nominal alpha of all judges over pair and order, with its cluster bootstrap interval from N_BOOT draws."""
    calls = tables.pairwise_judgments(spark, sf).withColumn("cluster", recode.cluster_key())
    return _intervals(agreement.nominal_sums(calls, UNIT, "judgment", WORDS, "cluster"), ["judgments", "agreeing", *WORDS], {"alpha": agreement.nominal_alpha(WORDS)})


def interval_alpha_interval(spark: SparkSession, sf: str) -> DataFrame:
    """Interval alpha of scores over items and variants, with its cluster bootstrap interval from N_BOOT draws."""
    scores = tables.score_judgments(spark, sf).withColumn("cluster", recode.cluster_key())
    return _intervals(agreement.alpha_sums(scores, ["item_id", "variant_id"], "judgment", cluster="cluster"), list(agreement.SUMS), {"alpha": agreement.alpha()})


def kappa_interval(spark: SparkSession, sf: str) -> DataFrame:
    """Cohen's kappa of two judges over all pairs of their calls for a pair and order, with its interval from N_BOOT draws."""
    calls = tables.pairwise_judgments(spark, sf).withColumn("cluster", recode.cluster_key())
    said = lambda judge, name: calls.where(F.col("judge_model") == judge).groupBy("cluster", *UNIT, F.col("judgment").alias(name)).agg(F.count("*").alias(f"n_{name}"))
    both = said("judge-0", "a").join(said("judge-1", "b"), ["cluster", *UNIT])
    cells = {f"{a}_{b}": F.sum(F.when((F.col("a") == a) & (F.col("b") == b), F.col("n_a") * F.col("n_b")).otherwise(0)) for a in WORDS for b in WORDS}
    stats = both.groupBy("cluster").agg(*[c.alias(name) for name, c in cells.items()])
    return _intervals(stats, list(cells), {"kappa": replicates.kappa(WORDS, lambda a, b: F.col(f"{a}_{b}"))})


def resolved_gate(spark: SparkSession, sf: str) -> DataFrame:
    """The gate's statuses by the streams' own expressions, over tables: calls and answers by id, then flags by key."""
    plan = tables.request_plan_rows(spark, sf).withColumn("planned_at", F.lit("2026-01-01").cast("timestamp"))
    answers = tables.realized_rows(spark, sf).withColumn("answered_at", F.lit("2026-01-01").cast("timestamp"))
    rows = gate.table_statuses(gate.resolved_calls(plan, answers, "1 HOUR"))
    return rows.groupBy("judge_model", "status").agg(F.count("*").alias("n_keys"))


def position_bias_rollup(spark: SparkSession, sf: str) -> DataFrame:
    """Position bias by judge and stratum, by either alone, and over all, with the error of each."""
    by = ["judge_model", "stratum"]
    calls = tables.pairwise_judgments(spark, sf).withColumn("stratum", F.when(F.col("pair_id").endswith("::N"), "near-tie").otherwise("gap"))
    totals = inference.cluster_totals(reduce.order_balanced(calls, recode.prefers_first(), by), by)
    return rounded(rollup.rolled_up(totals, by, [by, by[:1], by[1:], []]), "estimate", "se")


def _prices(rows: DataFrame, at: str) -> DataFrame:
    """Prices of calls as they change over time: a version for each judge and month, drawn from the month's own calls."""
    return rows.groupBy("judge_model", F.date_trunc("month", at).alias("valid_from")).agg((F.lit(1.0) + F.sum("tokens_first") % 97 / 100.0).alias("price"), F.md5(F.max("judge_call_id")).alias("config"))


def cost_as_of(spark: SparkSession, sf: str) -> DataFrame:
    """What each month's calls cost at the price valid when they were made: a price holds from the middle of a month on."""
    calls = tables.dated_judgments(spark, sf)
    prices = _prices(calls, "judged_at").withColumn("valid_from", F.col("valid_from") + F.expr("INTERVAL 14 DAYS"))
    rows = asof.asof_join(calls, prices, ["judge_model"], "judged_at", "valid_from", ["price"], slice_seconds=30 * 86_400)
    out = rows.groupBy("judge_model", "run").agg(F.count("*").alias("n_calls"), F.count("price").alias("n_priced"), F.sum(F.col("price") * (F.col("tokens_first") + F.col("tokens_second"))).alias("cost"))
    return rounded(out, "cost")


def config_as_of(spark: SparkSession, sf: str) -> DataFrame:
    """How many calls ran under each configuration of their judge, the one that was valid at their time."""
    calls = tables.dated_judgments(spark, sf)
    rows = asof.asof_join(calls, _prices(calls, "judged_at"), ["judge_model"], "judged_at", "valid_from", ["config", "price"])
    return rows.groupBy("judge_model", "config").agg(F.count("*").alias("n_calls"), F.min("judged_at").cast("string").alias("first_call"))


def _amounts(spark: SparkSession, sf: str) -> DataFrame:
    return tables.pairwise_judgments(spark, sf, "p_brand", F.date_format("l_shipdate", "yyyy-MM").alias("run"), F.col("l_extendedprice").alias("amount"))


def amount_sketches(spark: SparkSession, sf: str) -> DataFrame:
    """Quantiles and numbers of items by judge from sketches of its months, held against the exact ones.

    The bounds are three times the rank error of 1 in 100 cases, and five standard errors of the number of items.
    """
    calls = _amounts(spark, sf)
    whole = sketches.merged(sketches.sketched(calls, ["judge_model", "run"], "amount", "item_id"), ["judge_model"])
    reached = sketches.quantiles(whole, ["judge_model"], PROBABILITIES)
    values = calls.groupBy("judge_model", "amount").agg(F.count("*").alias("n"))  # equal amounts meet once
    upto = lambda c: F.sum(F.when(c, F.col("n")).otherwise(0)) / F.sum("n")
    ranks = values.join(reached, "judge_model").groupBy("judge_model", "p").agg(
        F.sum("n").alias("n_calls"), upto(F.col("amount") < F.col("value")).alias("below"), upto(F.col("amount") <= F.col("value")).alias("reached")
    )
    off = F.greatest(F.col("below") - F.col("p"), F.col("p") - F.col("reached"))
    items = calls.groupBy("judge_model").agg(F.count_distinct("item_id").alias("n_items"), F.count_distinct("run").alias("n_runs"))
    rows = ranks.join(items, "judge_model").join(sketches.counted(whole, ["judge_model"]).drop("n"), "judge_model")
    near = F.abs(F.col("n_members") / F.col("n_items") - 1) <= 5 * sketches.member_error()
    return rows.select("judge_model", "p", "n_calls", "n_runs", "n_items", (off <= 3 * sketches.rank_error()).alias("rank_within"), near.alias("items_within"))


def kept_items(spark: SparkSession, sf: str) -> DataFrame:
    """Items that a judge sees in a month, and how many of them again in the next: months' sketches meet, held against exact numbers."""
    calls = _amounts(spark, sf)
    following = lambda run: F.date_format(F.add_months(F.to_date(F.concat(run, F.lit("-01"))), 1), "yyyy-MM")
    by = ["judge_model", "run"]
    found = sketches.shared_members(sketches.sketched(calls, by, "amount", "item_id"), ["judge_model"], "run", following)
    seen = calls.select(*by, "item_id").distinct()
    again = seen.select("judge_model", "item_id", F.col("run").alias("_next"))
    exact = seen.withColumn("_next", following(F.col("run"))).join(again.withColumn("_kept", F.lit(1)), ["judge_model", "item_id", "_next"], "left")
    exact = exact.groupBy(*by).agg(F.count("*").alias("n_items"), F.count("_kept").alias("n_again"))
    bound = 5 * sketches.member_error() * F.col("n_items") + 1e-9
    within = (F.abs(F.col("n_members") - F.col("n_items")) <= bound) & (F.abs(F.col("n_kept") - F.col("n_again")) <= bound)
    return exact.join(found, by).select(*by, "n_items", "n_again", within.alias("within"))


QUERIES = {
    f.__name__: f
    for f in (amount_sketches, kept_items, position_bias_rollup, cost_as_of, config_as_of, resolved_gate, win_rate_sequence, win_rate_sequence_to_horizon, nested_variance, nested_components, score_alpha, effect_supplement_intervals, nominal_alpha_interval, interval_alpha_interval, kappa_interval)
}

_R = "round({0}, 9) + 0e0"


def _sequence_sql(pace: str) -> str:
    return f"""
      WITH u AS (SELECT judge_model, run, {_CLUSTER} AS cluster, avg(CASE WHEN judgment = 'tie' THEN 0.5e0 WHEN (judgment = 'first') = (variant_first = 'A') THEN 1e0 ELSE 0e0 END) AS x FROM ({tables.DATED_SQL}) GROUP BY ALL),
      a AS (SELECT *, row_number() OVER w AS t, coalesce(sum(x) OVER e, 0) AS s FROM u WINDOW w AS (PARTITION BY judge_model ORDER BY run, md5(cluster), cluster), e AS (PARTITION BY judge_model ORDER BY run, md5(cluster), cluster ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
      b AS (SELECT *, (0.5e0 + s) / t AS before, (x - (0.5e0 + s + x) / (t + 1)) ** 2 AS q FROM a),
      c AS (SELECT *, (0.25e0 + coalesce(sum(q) OVER e, 0)) / t AS spread FROM b WINDOW e AS (PARTITION BY judge_model ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
      d AS (SELECT *, least(0.5e0, sqrt(2 * ln(40) / (spread * {pace}))) AS l FROM c),
      r AS (SELECT judge_model, run, count(*) AS n, sum(l) AS l, sum(l * x) AS lx, sum(4 * (x - before) ** 2 * (-ln(1 - l) - l) / 4) AS v FROM d GROUP BY ALL),
      f AS (SELECT judge_model, run, CAST(sum(n) OVER o AS BIGINT) AS n, sum(l) OVER o AS l, sum(lx) OVER o AS lx, sum(v) OVER o AS v FROM r WINDOW o AS (PARTITION BY judge_model ORDER BY run)),
      g AS (SELECT judge_model, run, n, lx / l AS estimate, greatest(lx / l - (ln(40) + v) / l, 0e0) AS cs_low, least(lx / l + (ln(40) + v) / l, 1e0) AS cs_high FROM f)
      SELECT judge_model, run, n, {_R.format("estimate")} AS estimate, {_R.format("cs_low")} AS cs_low, {_R.format("cs_high")} AS cs_high,
        {_R.format("max(cs_low) OVER o")} AS all_low, {_R.format("min(cs_high) OVER o")} AS all_high FROM g WINDOW o AS (PARTITION BY judge_model ORDER BY run)"""


_NESTED_SQL = f"""
  scored AS (SELECT * FROM ({tables.SCORES_SQL}) WHERE variant_id IN ('A', 'N')),
  resp AS (SELECT item_id, variant_id, response_id, count(*) AS m, avg(judgment) AS y, coalesce(var_samp(judgment), 0) * (count(*) - 1) AS q FROM scored GROUP BY ALL),
  placed AS (SELECT *, sum(m * y) OVER g / sum(m) OVER g AS mean, sum(m) OVER g AS n FROM resp WINDOW g AS (PARTITION BY item_id, variant_id)),
  level AS (SELECT sum(q) / sum(m - 1) AS sigma2_j, CAST(sum(m - 1) AS BIGINT) AS df_j, sum(m * (y - mean) ** 2) AS squares, count(*) - count(DISTINCT (item_id, variant_id)) AS df_g, sum(m) - sum(m * m / n) AS effective FROM placed),
  nested AS (SELECT sigma2_j, df_j, df_g, effective / df_g AS weight, (squares / df_g - sigma2_j) / (effective / df_g) AS raw FROM level)"""


def _interval_sql(stats: str, statistics: dict[str, str]) -> str:
    """Replicates of statistics over sums of the columns of ``stats``, which has a row for each cluster."""
    each = " UNION ALL ".join(f"SELECT b, '{name}' AS statistic, {c} AS value FROM ({{rows}})" for name, c in statistics.items())
    return f"""WITH {stats}, {_PLACED.replace("totals", "stats")},
      draws AS (SELECT b, x % c AS k FROM {mixed_sql(f"numbered, range(0, {N_BOOT}) AS r(b)", str(SEED), "0", "b", "k")}),
      sums AS (SELECT b, sum(COLUMNS(* EXCLUDE (b, k, c, cluster))) FROM draws JOIN numbered USING (k) GROUP BY b),
      whole AS (SELECT -1 AS b, sum(COLUMNS(* EXCLUDE (cluster))) FROM stats),
      drawn AS ({each.format(rows="FROM sums")}), seen AS ({each.format(rows="FROM whole")}),
      edges AS (SELECT statistic, quantile_cont(value, 0.025e0) AS low, quantile_cont(value, 0.975e0) AS high, stddev_samp(value) AS se, count(value) AS n_defined FROM drawn GROUP BY statistic)
      SELECT statistic, (SELECT count(*) FROM stats) AS n_clusters, {_R.format("value")} AS estimate, {_R.format("low")} AS boot_low, {_R.format("high")} AS boot_high, {_R.format("se")} AS boot_se, n_defined
      FROM seen JOIN edges USING (statistic)"""


_NOMINAL_SUMS_SQL = f"""
  v AS (SELECT {_CLUSTER} AS cluster, pair_id, variant_first, judgment, count(*) AS n FROM ({tables.PAIRWISE_SQL}) GROUP BY ALL),
  u AS (SELECT *, sum(n) OVER (PARTITION BY cluster, pair_id, variant_first) AS m FROM v),
  stats AS (SELECT cluster, sum(n) AS judgments, sum(n * (n - 1) / (m - 1)) AS agreeing, {", ".join(f"coalesce(sum(n) FILTER (judgment = '{v}'), 0) AS {v}_" for v in WORDS)} FROM u WHERE m >= 2 GROUP BY cluster)"""
_CHANCE = "(" + " + ".join(f"{v}_ * ({v}_ - 1)" for v in WORDS) + ") / (judgments * (judgments - 1))"
_SCORE_SUMS_SQL = f"""
  v AS (SELECT source_doc_id AS cluster, item_id, variant_id, count(*) AS m, sum(judgment) AS total, sum(judgment * judgment) AS squares FROM ({tables.SCORES_SQL}) GROUP BY ALL HAVING count(*) >= 2),
  stats AS (SELECT cluster, sum(m) AS judgments, sum((m * squares - total * total) / (m - 1)) AS inside, sum(total) AS total, sum(squares) AS squares FROM v GROUP BY cluster)"""
_CELLS = [(a, b) for a in WORDS for b in WORDS]
_KAPPA_SQL = f"""
  calls AS (SELECT {_CLUSTER} AS cluster, pair_id, variant_first, judge_model, judgment FROM ({tables.PAIRWISE_SQL})),
  met AS (SELECT a.cluster, a.judgment AS x, b.judgment AS y FROM calls a JOIN calls b USING (cluster, pair_id, variant_first) WHERE a.judge_model = 'judge-0' AND b.judge_model = 'judge-1'),
  stats AS (SELECT cluster, {", ".join(f"count(*) FILTER (x = '{a}' AND y = '{b}') AS {a}_{b}" for a, b in _CELLS)} FROM met GROUP BY cluster)"""
_N = "(" + " + ".join(f"{a}_{b}" for a, b in _CELLS) + ")"
_BY_CHANCE = "(" + " + ".join("(" + " + ".join(f"{v}_{b}" for b in WORDS) + ") * (" + " + ".join(f"{a}_{v}" for a in WORDS) + ")" for v in WORDS) + f") / ({_N} * {_N})"
_AGREED = "(" + " + ".join(f"{v}_{v}" for v in WORDS) + f") / {_N}"

_PRICES_SQL = f"""
  calls AS (SELECT * FROM ({tables.DATED_SQL})),
  prices AS (SELECT judge_model, CAST(date_trunc('month', judged_at) AS TIMESTAMP) AS valid_from, 1e0 + CAST(sum(tokens_first) AS BIGINT) % 97 / 100e0 AS price, md5(max(judge_call_id)) AS config FROM calls GROUP BY ALL)"""



def _level_sql(level: str, judge: str, stratum: str) -> str:
    """One level of a rollup by itself, with squares about its own mean."""
    return f"""
      SELECT judge_model, stratum, '{level}' AS level, CAST(sum(size) AS BIGINT) AS n_items, count(*) AS n_clusters, {_R.format("any_value(mean)")} AS estimate,
        {_R.format("sqrt(count(*) / (count(*) - 1) * sum((total - size * mean) ** 2)) / sum(size)")} AS se, count(*) - 1 AS df
      FROM (SELECT *, sum(total) OVER g / sum(size) OVER g AS mean FROM (SELECT {judge} AS judge_model, {stratum} AS stratum, cluster, sum(d) AS total, count(*) AS size FROM items WHERE d IS NOT NULL GROUP BY ALL)
        WINDOW g AS (PARTITION BY judge_model, stratum)) GROUP BY judge_model, stratum"""


_LEVELS = (("judge_model, stratum", "judge_model", "stratum"), ("judge_model", "judge_model", "CAST(NULL AS VARCHAR)"), ("stratum", "CAST(NULL AS VARCHAR)", "stratum"), ("all", "CAST(NULL AS VARCHAR)", "CAST(NULL AS VARCHAR)"))

ORACLE_SQL = {
    "amount_sketches": f"""WITH calls AS ({tables.DATED_SQL})
      SELECT judge_model, unnest([0.5e0, 0.95e0, 0.99e0]) AS p, n_calls, n_runs, n_items, true AS rank_within, true AS items_within
      FROM (SELECT judge_model, count(*) AS n_calls, count(DISTINCT run) AS n_runs, count(DISTINCT item_id) AS n_items FROM calls GROUP BY ALL)""",
    "kept_items": f"""WITH seen AS (SELECT DISTINCT judge_model, run, item_id FROM ({tables.DATED_SQL}))
      SELECT a.judge_model AS judge_model, a.run AS run, count(*) AS n_items, count(b.item_id) AS n_again, true AS within FROM seen a
      LEFT JOIN seen b ON b.judge_model = a.judge_model AND b.item_id = a.item_id AND b.run = strftime(strptime(a.run || '-01', '%Y-%m-%d') + INTERVAL 1 MONTH, '%Y-%m') GROUP BY ALL""",
    "position_bias_rollup": f"""WITH strata AS (SELECT *, CASE WHEN ends_with(pair_id, '::N') THEN 'near-tie' ELSE 'gap' END AS stratum FROM ({tables.PAIRWISE_SQL})), {_balanced_sql(_FIRST, "judge_model, stratum", "FROM strata")}
      {" UNION ALL ".join(_level_sql(*level) for level in _LEVELS)}""",
    "cost_as_of": f"""WITH {_PRICES_SQL}, later AS (SELECT * REPLACE (valid_from + INTERVAL 14 DAYS AS valid_from) FROM prices)
      SELECT judge_model, run, count(*) AS n_calls, count(price) AS n_priced, {_R.format("sum(price * (tokens_first + tokens_second))")} AS cost
      FROM calls c ASOF LEFT JOIN later p ON c.judge_model = p.judge_model AND c.judged_at >= p.valid_from GROUP BY ALL""".replace("SELECT judge_model, run", "SELECT c.judge_model AS judge_model, run"),
    "config_as_of": f"""WITH {_PRICES_SQL}
      SELECT c.judge_model AS judge_model, config, count(*) AS n_calls, strftime(min(judged_at), '%Y-%m-%d %H:%M:%S') AS first_call FROM calls c ASOF JOIN prices p ON c.judge_model = p.judge_model AND c.judged_at >= p.valid_from GROUP BY ALL""",
    "resolved_gate": f"""WITH p AS ({tables.PLAN_SQL}), r AS ({tables.REALIZED_SQL}),
      met AS (SELECT p.judge_model AS pj, p.pair_id AS pp, p.variant_first AS pv, p.call_role, r.judge_model AS rj, r.pair_id AS rp, r.variant_first AS rv, p.judge_call_id AS planned, r.judge_call_id AS back
        FROM (SELECT DISTINCT judge_call_id, judge_model, pair_id, variant_first, call_role FROM p) p FULL JOIN (SELECT DISTINCT judge_call_id, judge_model, pair_id, variant_first FROM r) r ON p.judge_call_id = r.judge_call_id),
      said AS (
        SELECT pj AS judge_model, pp AS pair_id, pv AS variant_first, false AS unplanned, false AS any_back, call_role = 'primary' AS has_primary, call_role = 'primary' AND back IS NOT NULL AS primary_hit, call_role <> 'primary' AND back IS NOT NULL AS replicate_hit FROM met WHERE planned IS NOT NULL
        UNION ALL SELECT rj, rp, rv, planned IS NULL, true, false, false, false FROM met WHERE back IS NOT NULL),
      k AS (SELECT judge_model, pair_id, variant_first, bool_or(unplanned) AS u, bool_or(any_back) AS b, bool_or(has_primary) AS h, bool_or(primary_hit) AS p, bool_or(replicate_hit) AS r FROM said GROUP BY ALL)
      SELECT judge_model, CASE WHEN u OR (b AND NOT h) THEN 'plumbing' WHEN p THEN 'normal' WHEN r THEN 'promotion' ELSE 'exclusion' END AS status, count(*) AS n_keys FROM k GROUP BY ALL""",
    "win_rate_sequence": _sequence_sql("t * ln(1 + t)"),
    "win_rate_sequence_to_horizon": _sequence_sql(str(HORIZON)),
    "nested_variance": f"""WITH {_NESTED_SQL}
      SELECT {_R.format("sigma2_j")} AS sigma2_j, df_j, {_R.format("greatest(raw, 0e0)")} AS sigma2_g, df_g, {_R.format("weight")} AS weight, true AS identified, raw < 0 AS truncated_g FROM nested""",
    "nested_components": f"""WITH {_NESTED_SQL}, sided AS (SELECT item_id, variant_id, avg(y) AS x, count(*) AS r, sum(1 / m) AS h FROM resp GROUP BY ALL),
      noise AS (SELECT item_id, max(x) FILTER (variant_id = 'A') - max(x) FILTER (variant_id = 'N') AS d, sum(greatest(raw, 0e0) / r + sigma2_j * h / (r * r)) AS w FROM sided, nested GROUP BY item_id HAVING count(*) = 2),
      c AS (SELECT var_samp(d) AS var_d, avg(w) AS sigma2_w FROM noise)
      SELECT {_R.format("var_d")} AS var_d, {_R.format("sigma2_w")} AS sigma2_w, {_R.format("greatest(var_d - sigma2_w, 0e0)")} AS sigma2_b, {_R.format("greatest(var_d - sigma2_w, 0e0) / (greatest(var_d - sigma2_w, 0e0) + sigma2_w)")} AS icc,
        var_d - sigma2_w < 0 AS truncated, {_R.format("sigma2_j")} AS sigma2_j, {_R.format("greatest(raw, 0e0)")} AS sigma2_g FROM c, nested""",
    "score_alpha": f"""WITH v AS (SELECT item_id, variant_id, judgment AS value, count(*) AS n FROM ({tables.SCORES_SQL}) GROUP BY ALL),
      u AS (SELECT *, sum(n) OVER (PARTITION BY item_id, variant_id) AS m FROM v),
      k AS (SELECT * FROM u WHERE m >= 2),
      marginal AS (SELECT value, sum(n) AS n FROM k GROUP BY value),
      total AS (SELECT sum(n) AS total FROM marginal),
      distances AS (
        SELECT 'interval' AS level, c.value AS c, k.value AS k, (c.value - k.value) ** 2 AS q FROM marginal c, marginal k
        UNION ALL SELECT 'ordinal', c.value, k.value, ((SELECT sum(g.n) FROM marginal g WHERE g.value BETWEEN least(c.value, k.value) AND greatest(c.value, k.value)) - (c.n + k.n) / 2) ** 2 / total ** 2
        FROM marginal c, marginal k, total),
      seen AS (SELECT level, sum(a.n * b.n * q / (a.m - 1)) AS q FROM k a JOIN k b USING (item_id, variant_id) JOIN distances ON c = a.value AND distances.k = b.value GROUP BY level),
      chance AS (SELECT level, sum(x.n * y.n * q) AS q FROM distances JOIN marginal x ON x.value = c JOIN marginal y ON y.value = k GROUP BY level)
      SELECT level, (SELECT count(DISTINCT (item_id, variant_id)) FROM k) AS n_units, CAST(total AS BIGINT) AS n_judgments, {_R.format("seen.q / total")} AS observed,
        {_R.format("chance.q / (total * (total - 1))")} AS expected, {_R.format("1 - (seen.q / total) / (chance.q / (total * (total - 1)))")} AS alpha FROM seen JOIN chance USING (level), total""",
    "effect_supplement_intervals": _interval_sql(
        f"""{_pairwise_sql()}, w AS (SELECT cluster, count(*) FILTER (y = 1) AS wins, count(*) FILTER (y = 0) AS losses FROM calls GROUP BY cluster),
        m AS (SELECT cluster, count(*) AS n, sum(d) AS total, sum(d * d) AS squares FROM items GROUP BY cluster),
        stats AS (SELECT * FROM w JOIN m USING (cluster))""",
        {"conditional_win_rate": "wins / (wins + losses)", "d_z": "total / n / sqrt((squares - total * total / n) / (n - 1))"},
    ),
    "nominal_alpha_interval": _interval_sql(_NOMINAL_SUMS_SQL, {"alpha": f"(agreeing / judgments - {_CHANCE}) / (1 - {_CHANCE})"}),
    "interval_alpha_interval": _interval_sql(_SCORE_SUMS_SQL, {"alpha": "1 - (inside / judgments) / ((judgments * squares - total * total) / (judgments * (judgments - 1)))"}),
    "kappa_interval": _interval_sql(_KAPPA_SQL, {"kappa": f"({_AGREED} - {_BY_CHANCE}) / (1 - {_BY_CHANCE})"}),
}
