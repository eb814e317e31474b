from __future__ import annotations

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from quorum.plans import requests, run
from quorum.sources import store
from quorum.streaming import ingest

PLAN = "judge_model string, pair_id string, variant_first string, call_role string, judge_call_id string"


def test_gate_takes_the_first_rule_that_fits(spark):
    plan = spark.createDataFrame([("j", "p1", "A", "primary", "a"), ("j", "p2", "A", "primary", "b"), ("j", "p2", "A", "replicate", "b2"), ("j", "p3", "A", "primary", "c"), ("j", "p4", "A", "primary", "d"), ("j", "p5", "A", "replicate", "e")], PLAN)
    back = spark.createDataFrame([("j", "p1", "A", "primary", "a"), ("j", "p2", "A", "replicate", "b2"), ("j", "p4", "A", "primary", "d"), ("j", "p4", "A", "primary", "stray"), ("j", "p5", "A", "replicate", "e")], PLAN)
    gated = requests.gate(plan, back)
    assert {r["pair_id"]: r["status"] for r in gated.collect()} == {"p1": "normal", "p2": "promotion", "p3": "exclusion", "p4": "plumbing", "p5": "plumbing"}
    assert requests.gate_summary(gated).first()["blocks_run"]
    assert {r["pair_id"]: (r["judge_call_id"], r["promoted"]) for r in requests.primary_calls(plan, back).collect()} == {"p1": ("a", False), "p2": ("b2", True), "p4": ("d", False)}


@pytest.mark.parametrize(("n", "options", "want"), [(1000, {"fraction": 0.0}, 5), (1000, {"fraction": 1.0}, 15), (3, {"fraction": 1.0}, 3), (0, {}, 0)])
def test_replicate_sizes(spark, n, options, want):
    assert spark.range(1).select(requests.replicate_size(F.lit(n), **options).alias("k")).first()["k"] == want


def test_counterbalanced_pairs_share_their_id(spark):
    side = "struct<variant_id:string,response_id:string,text:string>"
    rows = requests.counterbalanced(spark.createDataFrame([("i", ("A", "r2", "x"), ("B", "r1", "y"))], f"item_id string, a {side}, b {side}")).collect()
    assert {r["pair_id"] for r in rows} == {"i::r1::r2"} and {r["first"]["variant_id"] for r in rows} == {"A", "B"}


def test_unpinned_judges_are_refused(spark):
    tasks = spark.createDataFrame([("i", "p", "A")], "item_id string, pair_id string, variant_first string")
    judges = spark.createDataFrame([("judge-latest",)], "judge_model string")
    with pytest.raises(Exception, match="must be pinned"):
        requests.request_plan(tasks, tasks.select("item_id"), judges, 1).collect()


class Echo:
    """Answers with the prompt; fails where the prompt says so."""

    def complete(self, prompt, *, model, seed, params):
        if prompt == "fail":
            raise OSError("no answer")
        return run.Completion(f"{model}: {prompt}", len(prompt))


def test_runs_resume_and_keep_what_succeeded(spark, tmp_path):
    calls = spark.createDataFrame([("a", "m", 1, "{}"), ("a", "m", 1, "{}"), ("fail", "m", 1, "{}")], "prompt string, model string, seed long, params string")
    cache = str(tmp_path / "cache")
    with pytest.raises(RuntimeError, match="no answer"):
        run.run_calls(calls, Echo(), cache)
    assert spark.read.parquet(cache).count() == 1
    done = run.run_calls(calls.where("prompt <> 'fail'"), None, cache)  # everything is cached: no client is needed
    assert [r["completion"] for r in done.collect()] == ["m: a", "m: a"]


def test_retries_pause_only_for_rate_limits():
    seen, pauses = [], []

    def call():
        seen.append(1)
        if len(seen) < 3:
            raise run.RateLimited
        return run.Completion("x", 1)

    assert run.with_retries(call, run.Retries(base=1), 7, pauses.append).text == "x"
    assert len(pauses) == 2 and 0.5 <= pauses[0] < 1.5 and 1 <= pauses[1] < 3


def test_json_lines(spark, tmp_path):
    schema = StructType([StructField("k", StringType()), StructField("v", StringType())])
    assert store.read_lines(spark, str(tmp_path / "none"), schema).count() == 0
    (tmp_path / "x.jsonl").write_text('{"k": "a", "v": "1"}\n\n{"k": "b"}\n')
    assert [tuple(r) for r in store.read_lines(spark, str(tmp_path / "x.jsonl"), schema).orderBy("k").collect()] == [("a", "1"), ("b", None)]
    (tmp_path / "y.jsonl").write_text('{"k": "a"}\n{"k": "b\n')
    with pytest.raises(Exception, match="malformed line"):
        store.read_lines(spark, str(tmp_path / "y.jsonl"), schema).collect()


def test_appending_again_adds_nothing(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int")
    for _ in range(2):
        store.append_new(rows, str(tmp_path / "store"), "k")
    assert spark.read.parquet(str(tmp_path / "store")).count() == 2


def test_streamed_judgments_are_stored_once(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    (source / "a.json").write_text('{"judge_call_id": "a", "judgment": "first"}\n{"judge_call_id": "b", "judgment": "tie"}\n')
    (source / "b.json").write_text('{"judge_call_id": "a", "judgment": "first"}\n')
    schema = StructType([StructField("judge_call_id", StringType()), StructField("judgment", StringType())])
    stream = ingest.judgments(spark, str(source), schema, files_per_batch=1)
    query = ingest.store_once(stream, str(tmp_path / "store"), str(tmp_path / "checkpoint"))
    assert query.awaitTermination(60)
    assert sorted(r["judge_call_id"] for r in spark.read.parquet(str(tmp_path / "store")).collect()) == ["a", "b"]


def test_running_win_rates(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    line = '{"judge_call_id": "%s", "judge_model": "j", "variant_first": "%s", "judgment": "%s", "created_at": "2026-01-01T00:%s:00"}\n'
    (source / "a.json").write_text(line % ("a", "A", "first", "01") + line % ("a", "A", "first", "01") + line % ("b", "B", "first", "02"))
    schema = "judge_call_id string, judge_model string, variant_first string, judgment string, created_at timestamp"
    stream = ingest.judgments(spark, str(source), StructType.fromDDL(schema))
    query = ingest.running_win_rates(stream, "A").writeStream.outputMode("update").format("memory").queryName("rates").trigger(availableNow=True).start()
    assert query.awaitTermination(60)
    assert [(r["n_calls"], r["win_rate"]) for r in spark.sql("select * from rates").collect()] == [(2, 0.5)]


def test_resumed_runs_return_all_tasks_in_order(spark):
    tasks = spark.createDataFrame([("b", 0), ("a", 1), ("c", 2)], "judge_call_id string, position int")
    stored = spark.createDataFrame([("a", "first"), ("b", "tie"), ("z", "tie"), ("b", "tie")], "judge_call_id string, judgment string")
    assert [tuple(r) for r in requests.full_set(tasks, stored, "judge_call_id", "position").collect()] == [("b", 0, "tie"), ("a", 1, "first")]


def test_dry_runs_refuse_unpinned_judges(spark):
    tasks = spark.createDataFrame([("primary", "a", "k", "judge-latest")], "kind string, id string, cache_key string, model string")
    with pytest.raises(Exception, match="must be pinned"):
        requests.dry_run(tasks, tasks.select("id"), tasks.select("cache_key"), "id", "cache_key", "model").collect()


def test_csv_publication(spark, tmp_path):
    store.write_csv(spark.createDataFrame([("a", 1.5)], "k string, v double"), str(tmp_path / "out"))
    (part,) = (tmp_path / "out").glob("*.csv")
    assert part.read_text() == "k,v\na,1.5\n"


def test_prompt_sets_are_known_by_their_digest(spark, tmp_path):
    pool = spark.createDataFrame([(1, "x" * 50), (2, "As an AI I " + "x" * 50), (3, "short"), (4, None)], "prompt_id long, text string")
    kept = requests.prompt_set(pool, r"(?i)\bas an ai\b", 40, 2500)
    digest = requests.write_prompt_set(kept, str(tmp_path / "a"))
    assert [r["prompt_id"] for r in spark.read.json(str(tmp_path / "a")).collect()] == [1]
    assert digest == requests.write_prompt_set(kept.repartition(3), str(tmp_path / "b"))
