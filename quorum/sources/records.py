"""Judgment records: what makes a row valid, and rows made from judges' texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quorum.functions import verdicts
from quorum.functions.recode import JUDGMENTS

ROLES = ("primary", "replicate")


def problems(judgment: Column, judge_model: Column, call_role: Column) -> Column:
    """What is wrong with a pairwise record, as sorted names; empty for a valid one."""
    checks = [(~F.coalesce(judgment.isin(*JUDGMENTS), F.lit(False)), "judgment"), (F.coalesce(judge_model.endswith("-latest"), F.lit(True)), "judge not pinned"), (~F.coalesce(call_role.isin(*ROLES), F.lit(False)), "role")]
    return F.array_sort(F.array_compact(F.array(*[F.when(bad, F.lit(name)) for bad, name in checks])))


def with_problems(judgments: DataFrame) -> DataFrame:
    return judgments.withColumn("problems", problems(F.col("judgment"), F.col("judge_model"), F.col("call_role")))


def valid(judgments: DataFrame) -> DataFrame:
    """The same rows; a row with a problem is an error that names it."""
    rows = with_problems(judgments)
    checked = F.when(F.size("problems") == 0, F.col("judgment")).otherwise(F.raise_error(F.concat(F.lit("invalid record: "), F.array_join("problems", ", "))))
    return rows.withColumn("judgment", checked).drop("problems")


def pairwise_records(tasks: DataFrame, outputs: DataFrame, key: str = "judge_call_id", ties_allowed: bool = True) -> DataFrame:
    """The tasks with the judgment read from their outputs (key, output) and ``parse_error`` where there is none."""
    rows = tasks.join(outputs.select(key, F.col("output").alias("_output")), key)
    rows = rows.withColumn("_v", verdicts.pairwise_verdict(F.col("_output"), ties_allowed))
    return rows.withColumn("judgment", F.col("_v.verdict")).withColumn("parse_error", F.col("_v.error")).drop("_v", "_output")


def response_records(tasks: DataFrame, outputs: DataFrame, kind: str, key: str = "judge_call_id", low: float | None = None, high: float | None = None) -> DataFrame:
    """The tasks with the score (kind scalar, between low and high) or the pass or fail (kind binary) of their outputs."""
    if kind not in ("scalar", "binary") or kind == "scalar" and not (low is not None and high is not None and low < high):
        raise ValueError("the kind must be binary, or scalar with low below high")
    rows = tasks.join(outputs.select(key, F.col("output").alias("_output")), key)
    read = verdicts.binary_verdict(F.col("_output")) if kind == "binary" else verdicts.scalar_verdict(F.col("_output"), low, high)
    return rows.withColumn("_v", read).withColumn("judgment", F.col("_v.verdict")).withColumn("parse_error", F.col("_v.error")).drop("_v", "_output")


def study_pairs(responses: DataFrame, strong: str, weak: str, again: str, excluded: DataFrame, seconds: DataFrame | None = None) -> DataFrame:
    """(prompt_id, stratum, a, b): for each prompt strong against weak, and strong against a second draw of it.

    responses has (prompt_id, variant_id, response_id, text). Excluded prompts (prompt_id) lose the second pair;
    ``seconds`` (prompt_id, second) names a prompt's second draw where it isn't ``again``. A prompt without one of the
    responses is an error.
    """
    names = None if seconds is None else seconds.where(F.col("second").isNotNull()).groupBy("prompt_id").agg(F.min("second").alias("_second"))
    rows = responses.withColumn("_second", F.lit(again)) if names is None else responses.join(names, "prompt_id", "left")
    side = lambda v: F.max(F.when(F.col("variant_id") == v, F.struct("variant_id", "response_id", "text")))
    rows = rows.groupBy("prompt_id").agg(side(strong).alias("a"), side(weak).alias("weak"), side(F.coalesce("_second", F.lit(again))).alias("again"))
    missing = F.raise_error(F.concat(F.lit("missing response for prompt "), F.col("prompt_id").cast("string")))
    gap = rows.withColumn("a", F.when(F.col("a").isNotNull() & F.col("weak").isNotNull(), F.col("a")).otherwise(missing)).select("prompt_id", F.lit("gap").alias("stratum"), "a", F.col("weak").alias("b"))
    near = rows.join(excluded.select("prompt_id").distinct(), "prompt_id", "left_anti")
    near = near.withColumn("a", F.when(F.col("a").isNotNull() & F.col("again").isNotNull(), F.col("a")).otherwise(missing)).select("prompt_id", F.lit("near-tie").alias("stratum"), "a", F.col("again").alias("b"))
    return gap.unionByName(near)
