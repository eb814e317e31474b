"""A study from prompts to judged pairs, each phase a function from tables to a table.

generate -> check arms -> plan -> judge -> gate. A phase reads what the one before it wrote, so any of them can be run
again: calls resume from the cache, and appends add only what is new.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quorum.functions import prompts
from quorum.functions.ids import derived_id, hash_number
from quorum.plans import requests, run
from quorum.sources import records
from quorum.sources.store import append_new


def draw_prompts(pool: DataFrame, n: int, seed: int) -> DataFrame:
    """n prompts of a pool (prompt_id, text), those with the least hashes: the same on every run."""
    return pool.orderBy(hash_number(seed, "prompt", F.col("prompt_id")), "prompt_id").limit(n)


def generation_tasks(pool: DataFrame, arms: Sequence[tuple[str, str]], seed: int) -> DataFrame:
    """(prompt_id, variant_id, model, prompt, seed, params, response_id): each prompt once for each (variant_id, model)."""
    listed = F.explode(F.array(*[F.struct(F.lit(v).alias("variant_id"), F.lit(m).alias("model")) for v, m in arms]))
    rows = pool.withColumn("arm", listed).select("prompt_id", "arm.*", prompts.generation_prompt(F.col("text")).alias("prompt"))
    rows = rows.withColumn("seed", hash_number(seed, "generate", F.col("prompt_id"), F.col("variant_id"))).withColumn("params", F.lit("{}"))
    return rows.withColumn("response_id", derived_id((F.col("prompt_id"), False), (F.col("variant_id"), True), (F.col("model"), True), (F.col("seed"), False)))


def generate(tasks: DataFrame, client: run.Client, cache: str) -> DataFrame:
    """The tasks with their texts; whatever the cache has is not asked for again."""
    return run.run_calls(tasks, client, cache).withColumnRenamed("completion", "text").drop("cache_key")


def judging_calls(pairs: DataFrame, tasks: DataFrame, judges: DataFrame, replicated: DataFrame, seed: int) -> DataFrame:
    """Planned calls with their prompts: both orders of each pair (item_id, a, b) with every judge, drawn items again.

    tasks has (item_id, task), the text that both responses answer.
    """
    shown = requests.counterbalanced(pairs).withColumn("variant_first", F.col("first.variant_id")).withColumn("variant_second", F.col("second.variant_id"))
    plan = requests.request_plan(shown, replicated, judges, seed).join(tasks.select("item_id", "task"), "item_id")
    plan = plan.withColumn("prompt", prompts.pairwise_prompt(F.col("task"), F.col("first.text"), F.col("second.text"))).drop("task", "first", "second")
    return plan.withColumn("model", F.col("judge_model")).withColumn("seed", F.col("judge_seed")).withColumn("params", F.lit("{}"))


def with_judge_config(calls: DataFrame, params: Mapping[str, str], default: str = "{}", version: str = "v1") -> DataFrame:
    """Adds params, by judge (JSON text; ``default`` for the others), and judge_config_id, which names judge and version."""
    own = F.lit(default)
    for model, text in params.items():
        own = F.when(F.col("judge_model") == model, F.lit(text)).otherwise(own)
    return calls.withColumn("params", own).withColumn("judge_config_id", F.concat_ws("-", "judge_model", F.lit(version)))


def write_plan(calls: DataFrame, path: str) -> DataFrame:
    """The planned calls as written to the plan's store before any call is made; a plan that is written again adds nothing."""
    append_new(calls, path, "judge_call_id")
    return calls.sparkSession.read.parquet(path)


def judge(calls: DataFrame, client: run.Client, cache: str) -> DataFrame:
    """The calls with their judgments; ``parse_error`` says why one has none."""
    done = run.run_calls(calls, client, cache)
    return records.pairwise_records(done.drop("completion"), done.select("judge_call_id", F.col("completion").alias("output")))


def check_arms(responses: DataFrame, first: str, second: str, regenerated: DataFrame | None = None) -> DataFrame:
    """(prompt_id, status, second): whether a prompt's two near-tie responses (prompt_id, variant_id, text) differ.

    Status: distinct; regenerated, where they were the same and the new response (prompt_id, variant_id, text) differs,
    which then is the second; excluded, where it doesn't, or there is none.
    """
    text = lambda v: F.max(F.when(F.col("variant_id") == v, F.col("text")))
    rows = responses.where(F.col("variant_id").isin(first, second)).groupBy("prompt_id").agg(text(first).alias("a"), text(second).alias("b"))
    whole = F.col("a").isNotNull() & F.col("b").isNotNull()
    rows = rows.withColumn("a", F.when(whole, F.col("a")).otherwise(F.raise_error(F.concat(F.lit("missing near-tie response for prompt "), F.col("prompt_id").cast("string")))))
    if regenerated is None:
        rows = rows.withColumns({"again": F.lit(None).cast("string"), "again_id": F.lit(None).cast("string")})
    else:
        once = regenerated.groupBy("prompt_id").agg(F.min(F.struct("variant_id", "text")).alias("new"))
        rows = rows.join(once.select("prompt_id", F.col("new.text").alias("again"), F.col("new.variant_id").alias("again_id")), "prompt_id", "left")
    same, new = F.col("a") == F.col("b"), F.col("again").isNotNull() & (F.col("again") != F.col("a"))
    status = F.when(~same, "distinct").when(new, "regenerated").otherwise("excluded")
    return rows.select("prompt_id", status.alias("status"), F.when(~same, F.lit(second)).when(new, F.col("again_id")).alias("second"))


def arm_summary(checked: DataFrame, most: float = 0.05) -> DataFrame:
    """(n_checked, n_regenerated, n_excluded, share, passes) of ``check_arms``: too many excluded prompts fail the study."""
    out = checked.agg(F.count("*").alias("n_checked"), F.count_if(F.col("status") != "distinct").alias("n_regenerated"), F.count_if(F.col("status") == "excluded").alias("n_excluded"))
    out = out.withColumn("share", F.coalesce(F.try_divide(F.col("n_excluded").cast("double"), F.col("n_checked")), F.lit(0.0)))
    return out.withColumn("passes", F.col("share") <= most)


def regenerate_equal(pool: DataFrame, responses: DataFrame, first: str, second: str, client: run.Client, cache: str, model: str, seed: int) -> DataFrame:
    """``check_arms`` with one more response for each prompt of the pool (prompt_id, text) whose two are the same."""
    equal = check_arms(responses, first, second).where("status = 'excluded'").select("prompt_id")
    tasks = generation_tasks(pool.join(equal, "prompt_id", "left_semi"), [(f"{second}-again", model)], seed)
    return check_arms(responses, first, second, generate(tasks, client, cache))


def write_check(checked: DataFrame, path: str) -> None:
    """The checked prompts as JSON lines, which ``read_check`` reads."""
    checked.write.mode("overwrite").json(path)


def read_check(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("prompt_id string, status string, second string").json(path)
