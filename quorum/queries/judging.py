"""Verdicts, prompts, ids, request plans, gates and stores over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quorum.functions import prompts, verdicts
from quorum.functions.ids import derived_id
from quorum.operators import inference, membership, reduce
from quorum.plans import requests, study
from quorum.queries.judgments import rounded
from quorum.sources import records, tables
from quorum.sources.tables import table

SELF_ID = r"(?i)\b(as an ai|language model)\b"
PLAN_SEED = 3


def _verdicts(rows: DataFrame, parsed) -> DataFrame:
    return rows.select("doc_id", parsed.alias("v")).select("doc_id", "v.verdict", "v.error")


def verdict_parse_pairwise(spark: SparkSession, sf: str) -> DataFrame:
    return _verdicts(tables.judge_outputs(spark, sf), verdicts.pairwise_verdict(F.col("pairwise_output"), ties_allowed=False))


def verdict_parse_binary(spark: SparkSession, sf: str) -> DataFrame:
    return _verdicts(tables.judge_outputs(spark, sf), verdicts.binary_verdict(F.col("binary_output")))


def verdict_parse_scalar(spark: SparkSession, sf: str) -> DataFrame:
    return _verdicts(tables.judge_outputs(spark, sf), verdicts.scalar_verdict(F.col("score_output"), 1, 5))


def parse_failures(spark: SparkSession, sf: str) -> DataFrame:
    """Share of judge texts without a usable verdict, by error and source."""
    rows = tables.judge_outputs(spark, sf).join(table(spark, sf, "documents").select("doc_id", "source"), "doc_id")
    parsed = rows.select("source", verdicts.pairwise_verdict(F.col("pairwise_output")).alias("v"))
    out = parsed.groupBy("source").agg(F.count("*").alias("n"), F.count_if(F.col("v.error") == "missing").alias("n_missing"), F.count_if(F.col("v.error") == "conflicting").alias("n_conflicting"))
    return rounded(out.withColumn("share", (F.col("n_missing") + F.col("n_conflicting")) / F.col("n")), "share")


def _pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Pairs of responses to the items of the benchmark: two consecutive documents each, dealt to the items in turn.

    A document without its neighbour meets an empty response.
    """
    benchmark = table(spark, sf, "benchmark")
    n = benchmark.agg(F.max("item_id") + 1).first()[0]
    side = lambda k, v: F.max(F.when(F.col("doc_id") % 2 == k, F.struct(F.lit(v).alias("variant_id"), F.concat(F.lit("r"), F.col("doc_id").cast("string")).alias("response_id"), "text")))
    pairs = table(spark, sf, "documents").groupBy(F.floor(F.col("doc_id") / 2).alias("deal")).agg(side(0, "A").alias("a"), side(1, "B").alias("b"))
    none = lambda v: F.struct(F.lit(v).alias("variant_id"), F.concat(F.lit("e"), F.col("deal").cast("string")).alias("response_id"), F.lit("").alias("text"))
    pairs = pairs.withColumns({"a": F.coalesce("a", none("A")), "b": F.coalesce("b", none("B")), "item_id": F.col("deal") % n})
    rows = benchmark.select("item_id", F.col("text").alias("task")).join(pairs, "item_id")
    return rows.select(F.concat(F.lit("b"), F.col("item_id").cast("string")).alias("item_id"), "task", "a", "b")


def counterbalanced_tasks(spark: SparkSession, sf: str) -> DataFrame:
    rows = requests.counterbalanced(_pairs(spark, sf))
    return rows.select("item_id", "pair_id", F.col("first.variant_id").alias("variant_first"), F.col("second.variant_id").alias("variant_second"), F.col("first.response_id").alias("response_first"), F.col("second.response_id").alias("response_second"))


def prompt_render(spark: SparkSession, sf: str) -> DataFrame:
    """Digests of the prompts of both orders, with and without ties, and of the other kinds."""
    rows = requests.counterbalanced(_pairs(spark, sf))
    task, first, second = F.col("task"), F.col("first.text"), F.col("second.text")
    return rows.select(
        "pair_id",
        F.col("first.variant_id").alias("variant_first"),
        F.md5(prompts.pairwise_prompt(task, first, second)).alias("pairwise"),
        F.md5(prompts.pairwise_prompt(task, first, second, ties_allowed=False)).alias("pairwise_no_ties"),
        F.md5(prompts.scalar_prompt(task, first, "Clear and right.", 1, 5)).alias("scalar"),
        F.md5(prompts.binary_prompt(task, first, "Clear and right.")).alias("binary_kind"),
        F.md5(prompts.generation_prompt(task)).alias("generation"),
    )


def derived_ids(spark: SparkSession, sf: str) -> DataFrame:
    calls = tables.pairwise_judgments(spark, sf)
    return calls.select("judge_call_id", derived_id((F.col("pair_id"), True), (F.col("judge_model"), True), (F.col("tokens_first"), False)).alias("id"))


def prompt_filter_counts(spark: SparkSession, sf: str) -> DataFrame:
    return requests.prompt_drops(table(spark, sf, "documents"), SELF_ID, 40, 2500)


def _items(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").select(F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("item_id"))


def replicate_draw_hash(spark: SparkSession, sf: str) -> DataFrame:
    return requests.replicate_items(_items(spark, sf), PLAN_SEED)


def request_plan(spark: SparkSession, sf: str) -> DataFrame:
    """Calls planned for every item, both orders and three judges, with drawn items replicated."""
    items = _items(spark, sf)
    orders = F.explode(F.array(F.struct(F.lit("A").alias("variant_first"), F.lit("B").alias("variant_second")), F.struct(F.lit("B").alias("variant_first"), F.lit("A").alias("variant_second"))))
    tasks = items.select("item_id", F.concat("item_id", F.lit("::AB")).alias("pair_id"), orders.alias("o")).select("item_id", "pair_id", "o.*")
    judges = spark.createDataFrame([("judge-0",), ("judge-1",), ("judge-2",)], "judge_model string")
    plan = requests.request_plan(tasks, requests.replicate_items(items, PLAN_SEED), judges, PLAN_SEED)
    return plan.select("item_id", "pair_id", "variant_first", "judge_model", "call_role", "judge_call_id")


def plan_gate(spark: SparkSession, sf: str) -> DataFrame:
    return requests.gate(tables.request_plan_rows(spark, sf), tables.realized_rows(spark, sf))


def plan_gate_summary(spark: SparkSession, sf: str) -> DataFrame:
    return requests.gate_summary(plan_gate(spark, sf))


def primary_selection(spark: SparkSession, sf: str) -> DataFrame:
    return requests.primary_calls(tables.request_plan_rows(spark, sf), tables.realized_rows(spark, sf))


def incomplete_pairs(spark: SparkSession, sf: str) -> DataFrame:
    return reduce.incomplete_pairs(tables.pairwise_judgments(spark, sf), ["judge_model"])


def resume_antijoin(spark: SparkSession, sf: str) -> DataFrame:
    """Planned calls that are still to be made, by judge and role."""
    left = requests.pending(tables.request_plan_rows(spark, sf), tables.realized_rows(spark, sf), "judge_call_id")
    return left.groupBy("judge_model", "call_role").agg(F.count("*").alias("n_calls"))


def resume_by_filter(spark: SparkSession, sf: str) -> DataFrame:
    """The same calls by way of a Bloom filter of what came back: only those that it admits meet the answers."""
    realized = tables.realized_rows(spark, sf).select("judge_call_id")
    left = membership.absent(tables.request_plan_rows(spark, sf), realized, "judge_call_id", membership.pages_for(realized.count()))
    return left.groupBy("judge_model", "call_role").agg(F.count("*").alias("n_calls"))


def dry_run(spark: SparkSession, sf: str) -> DataFrame:
    """What a rerun of the plan would do if some calls were recorded and some completions cached."""
    plan = tables.request_plan_rows(spark, sf).select("judge_call_id", F.col("call_role").alias("kind"), F.col("judge_model").alias("model"), F.md5("judge_call_id").alias("cache_key"))
    store = plan.where(F.col("judge_call_id").startswith("1"))
    cache = plan.where(F.col("cache_key").startswith("2"))
    return requests.dry_run(plan, store.select("judge_call_id"), cache.select("cache_key"), "judge_call_id", "cache_key", "model")


def arm_distinctness(spark: SparkSession, sf: str) -> DataFrame:
    """Prompts for which two arms gave the same text: two consecutive documents for each prompt."""
    docs = table(spark, sf, "documents")
    rows = docs.select(F.floor(F.col("doc_id") / 2).alias("prompt_id"), F.when(F.col("doc_id") % 2 == 0, "arm-0").otherwise("arm-1").alias("variant_id"), "text")
    return rounded(requests.arm_distinctness(rows, "arm-0", "arm-1"), "share")


def exclusion_asymmetry(spark: SparkSession, sf: str) -> DataFrame:
    """Share of keys that were excluded, by judge, and whether one order fails more often (exact binomial test)."""
    gated = plan_gate(spark, sf)
    gone = F.col("status") == "exclusion"
    rows = gated.groupBy("judge_model").agg(F.count("*").alias("n_keys"), F.count_if(gone & (F.col("variant_first") == "A")).alias("n_a_first"), F.count_if(gone & (F.col("variant_first") == "B")).alias("n_b_first"))
    rows = inference.mcnemar(rows, "n_a_first", "n_b_first", "order_p")
    rows = rows.withColumn("share", (F.col("n_a_first") + F.col("n_b_first")) / F.col("n_keys")).withColumn("passes", F.col("share") <= 0.05)
    return rounded(rows, "share", "order_p")


def token_summary(spark: SparkSession, sf: str) -> DataFrame:
    """Mean and 95th percentile of input tokens by judge."""
    rows = tables.pairwise_judgments(spark, sf).groupBy("judge_model").agg(F.avg("tokens_first").alias("mean_tokens"), F.percentile("tokens_first", F.lit(0.95)).alias("p95_tokens"))
    return rounded(rows, "mean_tokens", "p95_tokens")


def projected_cost(spark: SparkSession, sf: str) -> DataFrame:
    """Cost of the calls by judge, in dollars, from tokens in and out and prices for a million."""
    prices = F.broadcast(spark.createDataFrame([("judge-0", 1.0, 5.0), ("judge-1", 3.0, 15.0), ("judge-2", 0.25, 1.25)], "judge_model string, price_in double, price_out double"))
    rows = tables.pairwise_judgments(spark, sf).groupBy("judge_model").agg(F.count("*").alias("n_calls"), F.sum(F.col("tokens_first") + F.col("tokens_second")).alias("tokens_in")).join(prices, "judge_model")
    cost = (F.col("tokens_in") * F.col("price_in") + F.col("n_calls") * 10 * F.col("price_out")) / 1e6
    return rounded(rows.select("judge_model", "n_calls", "tokens_in", cost.alias("cost")), "cost")


def false_alarms(spark: SparkSession, sf: str) -> DataFrame:
    """Expected false alarms so far in a series of monthly runs at a level of 0.05."""
    from pyspark.sql import Window

    runs = table(spark, sf, "orders").groupBy(F.date_format("o_orderdate", "yyyy-MM").alias("month")).agg(F.count("*").alias("n_orders"))
    return rounded(runs.withColumn("expected", F.count("*").over(Window.orderBy("month")) * 0.05), "expected")


def latest_orders(spark: SparkSession, sf: str) -> DataFrame:
    """The last row of each key, by date and number: each customer's last order."""
    rows = table(spark, sf, "orders").select("o_custkey", "o_orderkey", F.concat(F.date_format("o_orderdate", "yyyyMMddHHmmss"), F.lpad(F.col("o_orderkey").cast("string"), 12, "0")).alias("sequence"))
    return requests.latest(rows, ["o_custkey"], "sequence").select("o_custkey", "o_orderkey")


def record_problems(spark: SparkSession, sf: str) -> DataFrame:
    """Records by what is wrong with them, some spoilt on purpose."""
    rows = tables.request_plan_rows(spark, sf)
    start = F.substring("judge_call_id", 1, 1)
    rows = rows.withColumn("judgment", F.when(start == "0", "A").otherwise(F.col("judgment"))).withColumn("judge_model", F.when(start.isin("0", "1"), F.concat("judge_model", F.lit("-latest"))).otherwise(F.col("judge_model")))
    rows = rows.withColumn("call_role", F.when(start == "2", "third").otherwise(F.col("call_role")))
    return records.with_problems(rows).groupBy(F.array_join("problems", ", ").alias("problems")).agg(F.count("*").alias("n"))


def records_from_outputs(spark: SparkSession, sf: str) -> DataFrame:
    """Judgments read from judges' texts, one for each document."""
    outputs = tables.judge_outputs(spark, sf).select(F.concat(F.lit("c"), F.col("doc_id").cast("string")).alias("judge_call_id"), F.col("pairwise_output").alias("output"))
    tasks = table(spark, sf, "documents").select(F.concat(F.lit("c"), F.col("doc_id").cast("string")).alias("judge_call_id"), F.col("source").alias("source_doc_id"))
    return records.pairwise_records(tasks, outputs).select("judge_call_id", "source_doc_id", "judgment", "parse_error")


def study_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Pairs of a study with three consecutive documents to a prompt: gap pairs, and near-ties unless their texts are the same.

    Where a prompt lacks one of the three, an empty response stands in for it.
    """
    arm = lambda k, v: F.max(F.when(F.col("doc_id") % 3 == k, F.struct(F.lit(v).alias("variant_id"), F.concat(F.lit("r"), F.col("doc_id").cast("string")).alias("response_id"), "text")))
    none = lambda v: F.struct(F.lit(v).alias("variant_id"), F.concat(F.lit("e"), F.col("prompt_id").cast("string")).alias("response_id"), F.lit("").alias("text"))
    names = ["strong", "again", "weak"]
    prompts = table(spark, sf, "documents").groupBy(F.floor(F.col("doc_id") / 3).alias("prompt_id")).agg(*[arm(k, v).alias(v) for k, v in enumerate(names)])
    prompts = prompts.withColumns({v: F.coalesce(v, none(v)) for v in names})
    rows = prompts.select("prompt_id", F.inline(F.array(*names)))
    pairs = records.study_pairs(rows, "strong", "weak", "again", prompts.where("strong.text = again.text").select("prompt_id"))
    return pairs.select("prompt_id", "stratum", F.col("a.response_id").alias("response_a"), F.col("b.response_id").alias("response_b"))


def scores_from_outputs(spark: SparkSession, sf: str) -> DataFrame:
    """Scores read from judges' texts, one for each document."""
    outputs = tables.judge_outputs(spark, sf).select("doc_id", F.col("score_output").alias("output"))
    return records.response_records(table(spark, sf, "documents").select("doc_id", "source"), outputs, "scalar", "doc_id", 1, 5)


def prompt_draw(spark: SparkSession, sf: str) -> DataFrame:
    """A hundred documents drawn as prompts."""
    return study.draw_prompts(table(spark, sf, "documents").select(F.col("doc_id").alias("prompt_id"), "text"), 100, PLAN_SEED).select("prompt_id")


def generation_tasks(spark: SparkSession, sf: str) -> DataFrame:
    """What would be asked for each benchmark item and arm."""
    pool = table(spark, sf, "benchmark").select(F.col("item_id").alias("prompt_id"), "text")
    rows = study.generation_tasks(pool, [("strong-0", "m1"), ("strong-1", "m1"), ("weak-0", "m2")], PLAN_SEED)
    return rows.select("prompt_id", "variant_id", "model", "seed", "response_id", F.md5("prompt").alias("prompt_md5"))


QUERIES = {
    f.__name__: f
    for f in (
        verdict_parse_pairwise, verdict_parse_binary, verdict_parse_scalar, parse_failures, counterbalanced_tasks, prompt_render, derived_ids, prompt_filter_counts, replicate_draw_hash, request_plan,
        plan_gate, plan_gate_summary, primary_selection, incomplete_pairs, resume_antijoin, resume_by_filter, dry_run, arm_distinctness, exclusion_asymmetry, token_summary, projected_cost, false_alarms,
        latest_orders, record_problems, records_from_outputs, study_pairs, scores_from_outputs, prompt_draw, generation_tasks,
    )
}

_OUTPUTS = r"""SELECT doc_id, source, text || chr(10) || CASE doc_id % 5 WHEN 0 THEN 'VERDICT: FIRST' WHEN 1 THEN 'verdict : second' WHEN 2 THEN 'VERDICT: TIE'
      WHEN 3 THEN 'VERDICT: FIRST' || chr(10) || 'VERDICT: SECOND' ELSE 'no verdict' END AS pairwise_output,
    text || chr(10) || CASE doc_id % 4 WHEN 0 THEN 'SCORE: 4' || chr(10) || 'SCORE: 4.0' WHEN 1 THEN 'SCORE: 3' || chr(10) || 'SCORE: 4' WHEN 2 THEN 'score: 2' ELSE 'SCORE: 9' END AS score_output,
    text || chr(10) || CASE doc_id % 3 WHEN 0 THEN 'Verdict: pass' WHEN 1 THEN 'VERDICT:FAIL' ELSE 'VERDICT: PASS VERDICT: FAIL' END AS binary_output FROM documents"""


def _found(column: str, pattern: str, each: str) -> str:
    return rf"""f AS (SELECT doc_id, source, list_distinct(list_transform(regexp_extract_all({column}, '{pattern}', 1), lambda x: {each})) AS found FROM ({_OUTPUTS}))"""


_ERROR = "CASE WHEN len(found) = 0 THEN 'missing' WHEN len(found) > 1 THEN 'conflicting' {more} END"
_PAIR_PATTERN = r"(?i)VERDICT\s*:\s*(FIRST|SECOND|TIE)\b"
def _dealt(n: int, k: int, name: str) -> str:
    """SQL of the response and text of the document in place k of n, or of an empty response."""
    own = f"FILTER (doc_id % {n} = {k})"
    return f"coalesce(max('r' || doc_id) {own}, 'e' || doc_id // {n}) AS r{name}, CASE WHEN count(*) {own} = 0 THEN '' ELSE max(text) {own} END AS t{name}"


_PAIRS = f"""SELECT 'b' || i.item_id AS item_id, i.text AS task, ra, ta, rb, tb FROM (SELECT doc_id // 2 AS deal, {_dealt(2, 0, "a")}, {_dealt(2, 1, "b")} FROM documents GROUP BY doc_id // 2)
    JOIN benchmark i ON i.item_id = deal % (SELECT max(item_id) + 1 FROM benchmark)"""
_TASKS = f"""SELECT item_id, task, item_id || '::' || least(ra, rb) || '::' || greatest(ra, rb) AS pair_id, unnest(['A', 'B']) AS variant_first, unnest(['B', 'A']) AS variant_second,
    unnest([ra, rb]) AS response_first, unnest([rb, ra]) AS response_second, unnest([ta, tb]) AS first, unnest([tb, ta]) AS second FROM ({_PAIRS})"""
_N = "chr(10)"
_ITEM_HASH = f"CAST(('0x' || substr(md5(concat_ws('|', '{PLAN_SEED}', 'replicate', item_id)), 1, 12)) AS BIGINT)"
_DRAWN = f"""SELECT item_id FROM (SELECT item_id, row_number() OVER (ORDER BY {_ITEM_HASH}, item_id) AS k, count(*) OVER () AS n FROM (SELECT 'p' || p_partkey AS item_id FROM part))
    WHERE k <= ceil(least(n * 2, greatest(10, least(30, round_even(n * 2 * 0.2e0, 0)))) / 2)"""
_GATE = f"""WITH plan AS ({tables.PLAN_SQL}), back AS ({tables.REALIZED_SQL}),
      got AS (SELECT judge_model, pair_id, variant_first, bool_or(judge_call_id NOT IN (SELECT judge_call_id FROM plan)) AS unplanned FROM back GROUP BY ALL),
      want AS (SELECT judge_model, pair_id, variant_first, bool_or(call_role = 'primary') AS has_primary, bool_or(call_role = 'primary' AND hit) AS primary_hit, bool_or(call_role = 'replicate' AND hit) AS replicate_hit
        FROM (SELECT *, judge_call_id IN (SELECT judge_call_id FROM back) AS hit FROM plan) GROUP BY ALL),
      gated AS (SELECT judge_model, pair_id, variant_first, CASE WHEN unplanned OR (unplanned IS NOT NULL AND NOT coalesce(has_primary, false)) THEN 'plumbing' WHEN primary_hit THEN 'normal'
        WHEN replicate_hit THEN 'promotion' ELSE 'exclusion' END AS status FROM want FULL JOIN got USING (judge_model, pair_id, variant_first))"""

_PENDING = f"""WITH plan AS ({tables.PLAN_SQL}), back AS ({tables.REALIZED_SQL})
      SELECT judge_model, call_role, count(*) AS n_calls FROM plan ANTI JOIN back USING (judge_call_id) GROUP BY ALL"""

ORACLE_SQL = {
    "verdict_parse_pairwise": f"""WITH {_found("pairwise_output", _PAIR_PATTERN, "lower(x)")} SELECT doc_id, CASE WHEN len(found) = 1 AND found[1] <> 'tie' THEN found[1] END AS verdict,
      {_ERROR.format(more="WHEN found[1] = 'tie' THEN 'tie'")} AS error FROM f""",
    "verdict_parse_binary": f"""WITH {_found("binary_output", "(?i)VERDICT\\s*:\\s*(PASS|FAIL)" + chr(92) + "b", "lower(x)")} SELECT doc_id, CASE WHEN len(found) = 1 THEN CASE found[1] WHEN 'pass' THEN 1e0 ELSE 0e0 END END AS verdict,
      {_ERROR.format(more="")} AS error FROM f""",
    "verdict_parse_scalar": f"""WITH {_found("score_output", "SCORE\\s*:\\s*([+-]?\\d+(?:\\.\\d+)?)", "CAST(x AS DOUBLE)")} SELECT doc_id, CASE WHEN len(found) = 1 AND found[1] BETWEEN 1 AND 5 THEN found[1] END AS verdict,
      {_ERROR.format(more="WHEN found[1] NOT BETWEEN 1 AND 5 THEN 'scale'")} AS error FROM f""",
    "parse_failures": f"""WITH {_found("pairwise_output", _PAIR_PATTERN, "lower(x)")} SELECT source, count(*) AS n, count(*) FILTER (len(found) = 0) AS n_missing, count(*) FILTER (len(found) > 1) AS n_conflicting,
      round(count(*) FILTER (len(found) <> 1) / count(*), 9) + 0e0 AS share FROM f GROUP BY ALL""",
    "counterbalanced_tasks": f"SELECT item_id, pair_id, variant_first, variant_second, response_first, response_second FROM ({_TASKS})",
    "prompt_render": f"""SELECT pair_id, variant_first,
      md5('Two responses to one task follow. Which serves the task better, by its text alone?' || {_N} || {_N} || '## Task' || {_N} || task || {_N} || {_N} || '## FIRST' || {_N} || first || {_N} || {_N} || '## SECOND' || {_N} || second
        || {_N} || {_N} || 'Answer with one line:' || {_N} || 'VERDICT: FIRST | VERDICT: SECOND | VERDICT: TIE' || {_N}) AS pairwise,
      md5('Two responses to one task follow. Which serves the task better, by its text alone?' || {_N} || {_N} || '## Task' || {_N} || task || {_N} || {_N} || '## FIRST' || {_N} || first || {_N} || {_N} || '## SECOND' || {_N} || second
        || {_N} || {_N} || 'Answer with one line:' || {_N} || 'VERDICT: FIRST | VERDICT: SECOND' || {_N}) AS pairwise_no_ties,
      md5('Score a response by this rubric, from 1 (worst) to 5 (best):' || {_N} || 'Clear and right.' || {_N} || {_N} || '## Task' || {_N} || task || {_N} || {_N} || '## Response' || {_N} || first || {_N} || {_N}
        || 'Answer with one line:' || {_N} || 'SCORE: <number from 1 to 5>' || {_N}) AS scalar,
      md5('Does a response meet these criteria?' || {_N} || 'Clear and right.' || {_N} || {_N} || '## Task' || {_N} || task || {_N} || {_N} || '## Response' || {_N} || first || {_N} || {_N}
        || 'Answer with one line:' || {_N} || 'VERDICT: PASS | VERDICT: FAIL' || {_N}) AS binary_kind,
      md5('Write 150 to 350 words in answer to this question.' || {_N} || {_N} || task || {_N}) AS generation FROM ({_TASKS})""",
    "derived_ids": f"SELECT judge_call_id, substr(sha256('''' || pair_id || '''' || chr(31) || '''' || judge_model || '''' || chr(31) || tokens_first), 1, 24) AS id FROM ({tables.PAIRWISE_SQL})",
    "prompt_filter_counts": r"""SELECT CASE WHEN regexp_matches(text, '(?i)\b(as an ai|language model)\b') THEN 'excluded' WHEN length(text) < 40 THEN 'too short' WHEN length(text) > 2500 THEN 'too long' ELSE 'kept' END AS reason, count(*) AS n
      FROM documents GROUP BY ALL""",
    "replicate_draw_hash": _DRAWN,
    "request_plan": f"""SELECT item_id, pair_id, variant_first, judge_model, call_role,
        substr(sha256('''' || pair_id || '''' || chr(31) || '''' || variant_first || '''' || chr(31) || '''' || judge_model || '''' || chr(31) || '''' || call_role || ''''), 1, 24) AS judge_call_id
      FROM (SELECT 'p' || p_partkey AS item_id, 'p' || p_partkey || '::AB' AS pair_id FROM part), (VALUES ('A'), ('B')) AS o(variant_first), (VALUES ('judge-0'), ('judge-1'), ('judge-2')) AS j(judge_model),
        (VALUES ('primary'), ('replicate')) AS r(call_role) WHERE call_role = 'primary' OR item_id IN ({_DRAWN})""",
    "plan_gate": f"{_GATE} SELECT * FROM gated",
    "plan_gate_summary": f"""{_GATE} SELECT count(*) FILTER (status = 'normal') AS n_normal, count(*) FILTER (status = 'promotion') AS n_promotions, count(*) FILTER (status = 'exclusion') AS n_exclusions,
      count(*) FILTER (status = 'plumbing') AS n_plumbing, bool_or(status = 'plumbing') AS blocks_run FROM gated""",
    "primary_selection": f"""WITH plan AS ({tables.PLAN_SQL}), back AS ({tables.REALIZED_SQL})
      SELECT b.judge_model, b.pair_id, b.variant_first, arg_min(b.judge_call_id, (CASE WHEN p.call_role = 'primary' THEN 0 ELSE 1 END, b.judge_call_id)) AS judge_call_id, NOT bool_or(p.call_role = 'primary') AS promoted
      FROM back b JOIN plan p USING (judge_call_id) GROUP BY ALL""",
    "incomplete_pairs": f"SELECT judge_model, pair_id, min(variant_first) AS only_order FROM ({tables.PAIRWISE_SQL}) GROUP BY judge_model, pair_id HAVING count(DISTINCT variant_first) = 1",
    "resume_antijoin": _PENDING,
    "resume_by_filter": _PENDING,
    "dry_run": f"""WITH plan AS (SELECT judge_call_id, call_role AS kind, md5(judge_call_id) AS cache_key FROM ({tables.PLAN_SQL})),
      store AS (SELECT DISTINCT judge_call_id FROM plan WHERE starts_with(judge_call_id, '1')), cache AS (SELECT DISTINCT cache_key FROM plan WHERE starts_with(cache_key, '2'))
      SELECT kind, count(*) AS total, count(s.judge_call_id) AS already_recorded, count(*) FILTER (s.judge_call_id IS NULL AND c.cache_key IS NOT NULL) AS cache_hits,
        count(*) FILTER (s.judge_call_id IS NULL AND c.cache_key IS NULL) AS model_calls
      FROM plan p LEFT JOIN store s ON s.judge_call_id = p.judge_call_id LEFT JOIN cache c ON c.cache_key = p.cache_key GROUP BY ALL""",
    "arm_distinctness": """WITH p AS (SELECT doc_id // 2 AS prompt_id, max(text) FILTER (doc_id % 2 = 0) AS a, max(text) FILTER (doc_id % 2 = 1) AS b FROM documents GROUP BY ALL)
      SELECT count(*) AS n_prompts, count(*) FILTER (a = b) AS n_equal, round(count(*) FILTER (a = b) / count(*), 9) + 0e0 AS share, count(*) FILTER (a = b) / count(*) <= 0.05e0 AS passes FROM p WHERE a IS NOT NULL AND b IS NOT NULL""",
    "exclusion_asymmetry": f"""{_GATE}, n AS (SELECT judge_model, count(*) AS n_keys, count(*) FILTER (status = 'exclusion' AND variant_first = 'A') AS a, count(*) FILTER (status = 'exclusion' AND variant_first = 'B') AS b FROM gated GROUP BY ALL)
      SELECT judge_model, n_keys, a AS n_a_first, b AS n_b_first, round((a + b) / n_keys, 9) + 0e0 AS share, (a + b) / n_keys <= 0.05e0 AS passes,
        round(CASE WHEN a = b THEN 1e0 ELSE least(1e0, (SELECT sum(2 * exp(lgamma(a + b + 1e0) - lgamma(i + 1e0) - lgamma(a + b - i + 1e0) - (a + b) * ln(2e0))) FROM range(0, least(a, b) + 1) AS t(i))) END, 9) + 0e0 AS order_p FROM n""",
    "token_summary": f"SELECT judge_model, round(avg(tokens_first), 9) + 0e0 AS mean_tokens, round(quantile_cont(CAST(tokens_first AS DOUBLE), 0.95e0), 9) + 0e0 AS p95_tokens FROM ({tables.PAIRWISE_SQL}) GROUP BY ALL",
    "projected_cost": f"""SELECT judge_model, count(*) AS n_calls, CAST(sum(tokens_first + tokens_second) AS BIGINT) AS tokens_in, round((sum(tokens_first + tokens_second) * price_in + count(*) * 10 * price_out) / 1e6, 9) + 0e0 AS cost
      FROM ({tables.PAIRWISE_SQL}) JOIN (VALUES ('judge-0', 1e0, 5e0), ('judge-1', 3e0, 15e0), ('judge-2', 0.25e0, 1.25e0)) AS p(judge_model, price_in, price_out) USING (judge_model) GROUP BY judge_model, price_in, price_out""",
    "false_alarms": "SELECT month, n_orders, round(count(*) OVER (ORDER BY month) * 0.05e0, 9) + 0e0 AS expected FROM (SELECT strftime(o_orderdate, '%Y-%m') AS month, count(*) AS n_orders FROM orders GROUP BY ALL)",
    "latest_orders": "SELECT o_custkey, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS o_orderkey FROM orders GROUP BY ALL",
    "record_problems": f"""WITH spoilt AS (SELECT CASE WHEN starts_with(judge_call_id, '0') THEN 'A' ELSE judgment END AS judgment,
        CASE WHEN substr(judge_call_id, 1, 1) IN ('0', '1') THEN judge_model || '-latest' ELSE judge_model END AS judge_model, CASE WHEN starts_with(judge_call_id, '2') THEN 'third' ELSE call_role END AS call_role FROM ({tables.PLAN_SQL}))
      SELECT concat_ws(', ', CASE WHEN ends_with(judge_model, '-latest') THEN 'judge not pinned' END, CASE WHEN judgment NOT IN ('first', 'second', 'tie') THEN 'judgment' END,
        CASE WHEN call_role NOT IN ('primary', 'replicate') THEN 'role' END) AS problems, count(*) AS n FROM spoilt GROUP BY ALL""",
    "records_from_outputs": f"""WITH {_found("pairwise_output", _PAIR_PATTERN, "lower(x)")} SELECT 'c' || doc_id AS judge_call_id, source AS source_doc_id, CASE WHEN len(found) = 1 THEN found[1] END AS judgment,
      {_ERROR.format(more="")} AS parse_error FROM f""",
    "study_pairs": f"""WITH p AS (SELECT doc_id // 3 AS prompt_id, {_dealt(3, 0, "s")}, {_dealt(3, 1, "a")}, {_dealt(3, 2, "w")} FROM documents GROUP BY doc_id // 3)
      SELECT prompt_id, 'gap' AS stratum, rs AS response_a, rw AS response_b FROM p
      UNION ALL SELECT prompt_id, 'near-tie', rs, ra FROM p WHERE ts IS DISTINCT FROM ta OR ts IS NULL""",
    "scores_from_outputs": f"""WITH {_found("score_output", "SCORE\\s*:\\s*([+-]?\\d+(?:\\.\\d+)?)", "CAST(x AS DOUBLE)")} SELECT doc_id, source, CASE WHEN len(found) = 1 AND found[1] BETWEEN 1 AND 5 THEN found[1] END AS judgment,
      {_ERROR.format(more="WHEN found[1] NOT BETWEEN 1 AND 5 THEN 'scale'")} AS parse_error FROM f""",
    "prompt_draw": f"SELECT doc_id AS prompt_id FROM documents ORDER BY CAST(('0x' || substr(md5(concat_ws('|', '{PLAN_SEED}', 'prompt', CAST(doc_id AS VARCHAR))), 1, 12)) AS BIGINT), doc_id LIMIT 100",
    "generation_tasks": f"""WITH t AS (SELECT item_id AS prompt_id, text, variant_id, model, CAST(('0x' || substr(md5(concat_ws('|', '{PLAN_SEED}', 'generate', CAST(item_id AS VARCHAR), variant_id)), 1, 12)) AS BIGINT) AS seed
        FROM benchmark, (VALUES ('strong-0', 'm1'), ('strong-1', 'm1'), ('weak-0', 'm2')) AS a(variant_id, model))
      SELECT prompt_id, variant_id, model, seed, substr(sha256(prompt_id || chr(31) || '''' || variant_id || '''' || chr(31) || '''' || model || '''' || chr(31) || seed), 1, 24) AS response_id,
        md5('Write 150 to 350 words in answer to this question.' || {_N} || {_N} || text || {_N}) AS prompt_md5 FROM t""",
}
