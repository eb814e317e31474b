from __future__ import annotations

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quorum.operators import membership
from quorum.sources import keyed


def _rows(spark, first, end):
    return spark.range(first, end).select(F.concat(F.lit("k"), "id").alias("k"), F.col("id").cast("int").alias("v"))


def _files(rows):
    return rows.select(F.input_file_name()).distinct().count()


@pytest.fixture
def store(spark, tmp_path):
    made = keyed.create(spark, str(tmp_path / "store"), _rows(spark, 0, 0).schema, "k", 20_000, 16)
    keyed.append_new(_rows(spark, 0, 5_000), made)
    return made


def test_two_appends_of_a_key_leave_one_row(spark, store):
    keyed.append_new(_rows(spark, 4_990, 5_010).union(_rows(spark, 4_990, 5_010)), keyed.opened(spark, store.path))
    keyed.append_new(_rows(spark, 4_990, 5_010), store)
    rows = store.rows(spark)
    assert (rows.count(), rows.select("k").distinct().count()) == (5_010, 5_010)


def test_new_keys_read_next_to_nothing(spark, store):
    whole = _files(store.rows(spark))
    assert whole >= 16
    assert len(keyed.touched(_rows(spark, 10_000, 10_500), store)) <= 1
    few = keyed.touched(_rows(spark, 7, 9).union(_rows(spark, 10_000, 10_100)), store)
    assert 1 <= len(few) <= 3 and _files(store.rows(spark, few)) < whole / 3
    plan = store.rows(spark, few)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and keyed.BUCKET in plan.split("PartitionFilters: [")[1].split("]")[0]


def test_pending_is_the_anti_join(spark, store):
    tasks = _rows(spark, 4_900, 5_100).union(spark.createDataFrame([(None, 1)], "k string, v int")).union(_rows(spark, 6_000, 6_001)).union(_rows(spark, 6_000, 6_001))
    want = tasks.join(store.rows(spark).select("k"), "k", "left_anti")
    assert sorted(map(repr, keyed.pending(tasks, store).collect())) == sorted(map(repr, want.select("k", "v").collect()))


def test_lost_between_filter_and_rows(spark, store):
    membership.bloom(_rows(spark, 8_000, 8_010), "k", store.n_pages).write.mode("append").parquet(f"{store.path}/filters")
    assert keyed.pending(_rows(spark, 8_000, 8_010), store).count() == 10
    keyed.append_new(_rows(spark, 8_000, 8_010), store)
    assert store.rows(spark).where("v >= 8000").count() == 10


def test_compacted_filters_deny_nothing_that_is_stored(spark, store):
    for k in range(3):
        keyed.append_new(_rows(spark, 6_000 + k, 6_001 + k), store)
    before = sorted((r["page"], bytes(r["bits"])) for r in store.filters(spark).collect())
    keyed.compact_filters(spark, store)
    after = spark.read.parquet(f"{store.path}/filters")
    assert sorted((r["page"], bytes(r["bits"])) for r in after.collect()) == before
    assert keyed.pending(_rows(spark, 0, 5_000), store).count() == 0


def test_filters_of_stores_merge(spark, store, tmp_path):
    other = keyed.create(spark, str(tmp_path / "other"), store.schema, "k", 20_000, 16)
    keyed.append_new(_rows(spark, 9_000, 9_100), other)
    both = keyed.union([store, other], spark)
    assert membership.with_maybe(_rows(spark, 0, 5_000).union(_rows(spark, 9_000, 9_100)), "k", both, store.n_pages, "m").where("not m").count() == 0
    with pytest.raises(ValueError, match="same size"):
        keyed.union([store, keyed.create(spark, str(tmp_path / "third"), store.schema, "k", 10, 8)], spark)


def test_rows_without_a_key_or_with_other_columns_are_refused(spark, store):
    with pytest.raises(Exception, match="needs a key"):
        keyed.append_new(spark.createDataFrame([(None, 1)], "k string, v int"), store)
    with pytest.raises(ValueError, match="columns are k, v"):
        keyed.append_new(spark.createDataFrame([("a",)], "k string"), store)


def test_an_empty_append_and_an_empty_store(spark, tmp_path):
    made = keyed.create(spark, str(tmp_path / "none"), _rows(spark, 0, 0).schema, "k", 0)
    keyed.append_new(_rows(spark, 0, 0), made)
    assert made.rows(spark).count() == 0 and keyed.touched(_rows(spark, 0, 9), made) == []
    assert keyed.pending(_rows(spark, 0, 9), made).count() == 9


def test_false_alarms_stay_at_their_rate(spark):
    n = 40_000
    pages = membership.pages_for(n)
    filters = membership.bloom(_rows(spark, 0, n), "k", pages)
    wrong = membership.with_maybe(_rows(spark, 10**6, 10**6 + 200_000), "k", filters, pages, "m").where("m").count()
    assert wrong < 200_000 / 2_000
    full = membership.fill(filters).first()
    assert full["n_pages"] == pages and 0.25 < full["mean_fill"] < 0.4 and full["false_share"] < 1 / 2_000


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.sampled_from(["", "a", "b", None, "é", "x" * 300]), max_size=12), st.lists(st.sampled_from(["", "a", None, "é", "c"]), max_size=6))
def test_absent_rows_are_those_of_the_anti_join(spark, rows, known):
    left = spark.createDataFrame([(k, i) for i, k in enumerate(rows)], "k string, maybe int")
    right = spark.createDataFrame([(k,) for k in known], "k string")
    want = [(k, i) for i, k in enumerate(rows) if k is None or k not in known]
    assert sorted(map(repr, map(tuple, membership.absent(left, right, "k", 2).collect()))) == sorted(map(repr, want))
