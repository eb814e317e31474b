from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from quorum.plans import requests, run, study
from quorum.sources import records


class Model:
    """Writes its name and the prompt; as a judge, prefers the first response."""

    def complete(self, prompt, *, model, seed, params):
        return run.Completion("VERDICT: FIRST" if model.startswith("judge") else f"{model} {seed}: {prompt}", 5)


def test_a_study_from_prompts_to_the_gate(spark, tmp_path):
    pool = spark.createDataFrame([(k, f"question {k}") for k in range(6)], "prompt_id long, text string")
    tasks = study.generation_tasks(study.draw_prompts(pool, 4, 1), [("strong", "m1"), ("again", "m1"), ("weak", "m2")], 1)
    texts = study.generate(tasks, Model(), str(tmp_path / "texts"))
    assert texts.count() == 12
    assert requests.arm_distinctness(texts, "strong", "again").first()["passes"]
    pairs = records.study_pairs(texts, "strong", "weak", "again", pool.where("false")).where("stratum = 'gap'")
    pairs = pairs.withColumn("item_id", F.col("prompt_id").cast("string")).select("item_id", "a", "b")
    judges = spark.createDataFrame([("judge-1",), ("judge-2",)], "judge_model string")
    questions = pool.select(F.col("prompt_id").cast("string").alias("item_id"), F.col("text").alias("task"))
    drawn = pairs.select("item_id").orderBy("item_id").limit(1)
    calls = study.judging_calls(pairs, questions, judges, drawn, 1)
    assert calls.count() == 2 * 2 * (4 + 1)
    assert calls.select("seed").distinct().count() == calls.count()
    judged = study.judge(calls, Model(), str(tmp_path / "verdicts"))
    assert {(r["judgment"], r["parse_error"]) for r in judged.collect()} == {("first", None)}
    gated = requests.gate_summary(requests.gate(calls, judged)).first()
    assert (gated["n_normal"], gated["blocks_run"]) == (16, False)


def test_a_run_that_lost_answers_is_found_by_the_gate(spark):
    plan = "judge_model string, pair_id string, variant_first string, call_role string, judge_call_id string"
    planned = spark.createDataFrame([("j", "p", "A", "primary", "a")], plan)
    assert requests.gate_summary(requests.gate(planned, planned.where("false"))).first()["n_exclusions"] == 1


def test_equal_arms_are_regenerated_once(spark, tmp_path):
    pool = spark.createDataFrame([(k, f"question {k}") for k in range(4)], "prompt_id long, text string")
    rows = [(0, "a", "x"), (0, "b", "y"), (1, "a", "same"), (1, "b", "same"), (2, "a", "same"), (2, "b", "same")]
    texts = spark.createDataFrame(rows, "prompt_id long, variant_id string, text string").withColumn("response_id", F.concat("variant_id", F.col("prompt_id").cast("string")))

    class Again:
        def complete(self, prompt, *, model, seed, params):
            return run.Completion("same" if "question 2" in prompt else "new", 1)

    checked = study.regenerate_equal(pool, texts, "a", "b", Again(), str(tmp_path / "cache"), "m", 1)
    assert {r["prompt_id"]: (r["status"], r["second"]) for r in checked.collect()} == {0: ("distinct", "b"), 1: ("regenerated", "b-again"), 2: ("excluded", None)}
    summary = study.arm_summary(checked).first()
    assert (summary["n_checked"], summary["n_regenerated"], summary["n_excluded"], summary["passes"]) == (3, 2, 1, False)
    study.write_check(checked, str(tmp_path / "check"))
    back = study.read_check(spark, str(tmp_path / "check"))
    more = texts.union(spark.createDataFrame([(1, "b-again", "new", "b-again1"), *[(k, "w", "weak", f"w{k}") for k in range(3)]], texts.schema))
    pairs = records.study_pairs(more, "a", "w", "b", back.where("status = 'excluded'"), back)
    assert {(int(r["prompt_id"]), r["stratum"], r["b"]["response_id"]) for r in pairs.collect()} == {(0, "gap", "w0"), (1, "gap", "w1"), (2, "gap", "w2"), (0, "near-tie", "b0"), (1, "near-tie", "b-again1")}
    with pytest.raises(Exception, match="missing near-tie response for prompt 3"):
        study.check_arms(texts.union(spark.createDataFrame([(3, "a", "x", "a3")], texts.schema)), "a", "b").collect()


def test_plans_are_written_once_before_any_call(spark, tmp_path):
    plan = spark.createDataFrame([("c1", "judge-1"), ("c2", "judge-2")], "judge_call_id string, judge_model string")
    plan = study.with_judge_config(plan, {"judge-1": '{"thinking":"disabled"}'})
    for _ in range(2):
        written = study.write_plan(plan, str(tmp_path / "plan"))
    assert sorted((r["judge_config_id"], r["params"]) for r in written.collect()) == [("judge-1-v1", '{"thinking":"disabled"}'), ("judge-2-v1", "{}")]
