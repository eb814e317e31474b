from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from quorum.operators import inference, reduce
from quorum.plans import requests
from quorum.sources import tables
from quorum.streaming import gate

START = "TIMESTAMP '2026-01-01 00:00:00'"
WAIT, LATE, BEHIND, SECONDS = "2 HOURS", "1 hour", "6 days", 3 * 3600


@pytest.fixture()
def timed(spark, sf):
    """Plan and answers of the tables, each with a time within ten days."""
    before = spark.conf.get(gate.STATE_STORE[0], None)
    spark.conf.set(*gate.STATE_STORE)
    minute = F.pmod(F.xxhash64("pair_id"), F.lit(14_400))
    at = lambda more: F.expr(START) + F.make_interval(mins=(minute + more).cast("int"))
    plan = tables.request_plan_rows(spark, sf).withColumn("planned_at", at(F.lit(0)))
    answers = tables.realized_rows(spark, sf).withColumn("answered_at", at(F.pmod(F.xxhash64("judge_call_id"), F.lit(90))))
    yield plan, answers
    spark.conf.unset(gate.STATE_STORE[0]) if before is None else spark.conf.set(gate.STATE_STORE[0], before)


def write(rows, path, time, days):
    """A file for each run of days, whose rows are in no order."""
    for first, end in days:
        day = F.datediff(time, F.lit("2026-01-01").cast("date"))
        rows.where((day >= first) & (day < end)).orderBy(F.md5("judge_call_id")).coalesce(1).write.mode("append").parquet(path)


def heartbeat(rows, time, day):
    """A call of its own that was planned and answered long after all others: time moves on with rows only."""
    named = {c: F.lit(f"heartbeat {day}") for c in ("judge_call_id", "pair_id", "item_id", "source_doc_id")}
    late = rows.limit(1).withColumns({time: F.lit(f"2026-01-{day:02d} 00:00:00").cast("timestamp"), **named, "call_role": F.lit("primary")})
    return late.select(*rows.columns)


def done(query):
    assert query.awaitTermination(300)
    assert query.exception() is None
    return query


def test_streams_give_the_gate_and_the_estimate_of_tables(spark, timed, tmp_path):
    plan, answers = timed
    path = lambda name: str(tmp_path / name)

    def run():
        source = lambda rows, name: spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(path(name))
        calls = gate.resolved_calls(source(plan, "plan"), source(answers, "answers"), WAIT, late=LATE)
        done(gate.append_to(calls, path("calls"), path("check-calls")))
        again = spark.readStream.schema(calls.schema).parquet(path("calls"))
        statuses = done(gate.append_to(gate.key_statuses(again, SECONDS, BEHIND), path("statuses"), path("check-statuses")))
        done(gate.append_to(gate.cluster_sums(again, "A", "B", 12 * 86_400, BEHIND), path("sums"), path("check-sums")))
        return statuses

    write(plan, path("plan"), "planned_at", [(0, 4), (4, 9)])
    write(answers, path("answers"), "answered_at", [(0, 4), (4, 9)])
    run()
    first = spark.read.parquet(path("statuses")).count()
    assert 0 < first < plan.select(*requests.ORDER_KEY).distinct().count()
    run()  # nothing is new
    assert spark.read.parquet(path("statuses")).count() == first
    write(plan, path("plan"), "planned_at", [(9, 20)])
    write(answers, path("answers"), "answered_at", [(9, 20)])
    run()
    left = []
    for day in (15, 16, 30, 31):
        heartbeat(plan, "planned_at", day).write.mode("append").parquet(path("plan"))
        heartbeat(answers, "answered_at", day).write.mode("append").parquet(path("answers"))
        left += [op["numRowsTotal"] for p in run().recentProgress for op in p["stateOperators"]]
    assert max(left) > 100 and left[-1] <= 12  # of the heartbeats only

    key = list(requests.ORDER_KEY)
    found = sorted(tuple(r) for r in spark.read.parquet(path("statuses")).where("pair_id NOT LIKE 'heartbeat%'").select(*key, "status").collect())
    assert found == sorted(tuple(r) for r in requests.gate(plan, answers).select(*key, "status").collect())
    assert found == sorted(tuple(r) for r in gate.table_statuses(gate.resolved_calls(plan, answers, WAIT)).select(*key, "status").collect())

    planned = answers.join(plan.select("judge_call_id"), "judge_call_id", "left_semi")
    want = inference.cluster_robust(inference.cluster_totals(reduce.reduce_pairwise(planned.withColumn("contrast_id", F.lit("x")), "A", "B", ["contrast_id"]), ["contrast_id"]), ["contrast_id"]).first()
    mine = gate.cluster_estimates(spark.read.parquet(path("sums")).where("cluster NOT LIKE 'heartbeat%'")).first()
    assert (mine["n_items"], mine["n_clusters"]) == (want["n_items"], want["n_clusters"])
    assert (mine["estimate"], mine["se"]) == (pytest.approx(want["estimate"]), pytest.approx(want["se"]))


def test_resolved_calls_of_odd_tables(spark):
    plan = spark.createDataFrame([("a", "primary", "p", "2026-01-01 00:00:00"), ("a", "primary", "p", "2026-01-01 00:00:00"), (None, "primary", "p", "2026-01-01 00:00:00"), ("c", "replicate", None, "2026-01-01 00:00:00")], "judge_call_id string, call_role string, pair_id string, t string")
    answers = spark.createDataFrame([("a", "p", "2026-01-01 01:00:00"), ("b", "q", None), (None, "p", "2026-01-01 01:00:00"), ("c", None, "2026-01-02 00:00:00")], "judge_call_id string, pair_id string, t string")
    time = lambda rows, name: rows.withColumn(name, F.col("t").cast("timestamp")).drop("t")
    rows = gate.resolved_calls(time(plan, "planned_at"), time(answers, "answered_at"), WAIT, key=["pair_id"])
    found = sorted(((r["judge_call_id"], r["call_role"], r["answer_key"] is not None) for r in rows.collect()), key=repr)
    # c was answered too late, so its call and its answer stand alone
    assert found == sorted([("a", "primary", True), (None, "primary", False), ("c", "replicate", False), ("b", None, True), (None, None, True), ("c", None, True)], key=repr)
    statuses = {r["pair_id"]: r["status"] for r in gate.table_statuses(rows, ["pair_id"]).collect()}
    assert statuses == {"p": "plumbing", "q": "plumbing", None: "plumbing"}
    assert gate.table_statuses(rows.where("false"), ["pair_id"]).count() == 0
