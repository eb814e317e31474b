from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from quorum.operators import sketches


def _runs(spark, n, months=12):
    """Values 0 to n - 1 in an order of their own, dealt to months; members repeat."""
    value = F.pmod(F.col("id") * 7_919, F.lit(n))
    return spark.range(n).select((F.col("id") % months).cast("int").alias("run"), value.cast("double").alias("value"), (F.col("id") % (n // 4)).cast("string").alias("member"))


def test_stored_sketches_of_months_merge_into_one_of_all(spark, tmp_path):
    n = 60_000
    rows = _runs(spark, n)
    sketches.sketched(rows, ["run"], "value", "member").write.parquet(str(tmp_path / "s"))
    stored = spark.read.parquet(str(tmp_path / "s"))
    assert stored.count() == 12
    for whole in (sketches.merged(stored, []), sketches.sketched(rows, [], "value", "member")):
        found = {r["p"]: r["value"] for r in sketches.quantiles(whole, [], np.linspace(0.01, 0.99, 21)).collect()}
        assert max(abs(v / n - p) for p, v in found.items()) <= 3 * sketches.rank_error()
        counts = sketches.counted(whole, []).first()
        assert counts["n"] == n and abs(counts["n_members"] / (n // 4) - 1) <= 5 * sketches.member_error()
    assert sketches.merged(stored, []).first()["n_sketches"] == 12
    assert len(sketches.merged(stored, []).first()["quantiles"]) < 64_000  # not the values


def test_few_values_are_exact(spark):
    rows = spark.createDataFrame([("a", float(v), f"m{v % 7}") for v in range(100)] + [("b", 5.0, "x")] * 3, "g string, v double, m string")
    merged = sketches.merged(sketches.sketched(rows, ["g", "m"], "v", "m"), ["g"])
    found = {(r["g"], r["p"]): r["value"] for r in sketches.quantiles(merged, ["g"], [0.25, 0.5, 1.0]).collect()}
    assert found == {("a", 0.25): 24.0, ("a", 0.5): 49.0, ("a", 1.0): 99.0, ("b", 0.25): 5.0, ("b", 0.5): 5.0, ("b", 1.0): 5.0}
    assert {r["g"]: (r["n"], r["n_members"]) for r in sketches.counted(merged, ["g"]).collect()} == {"a": (100, 7), "b": (3, 1)}


def test_nulls_and_empty_groups(spark):
    rows = spark.createDataFrame([("a", 1.0, "x"), ("a", float("nan"), "y"), ("a", None, None), ("b", None, None)], "g string, v double, m string")
    made = sketches.sketched(rows, ["g"], "v", "m")
    assert {r["g"]: (r["n"], r["n_members"]) for r in sketches.counted(made, ["g"]).collect()} == {"a": (1, 2), "b": (0, 0)}
    assert {r["g"]: r["value"] for r in sketches.quantiles(made, ["g"], [0.5]).collect()} == {"a": 1.0, "b": None}
    assert sketches.merged(made.where("false"), ["g"]).count() == 0
    nothing = sketches.merged(made.where("false"), [])
    assert (nothing.first()["n"], sketches.quantiles(nothing, [], [0.5]).first()["value"]) == (0, None)


@pytest.mark.parametrize("n", [40, 60_000])
def test_members_that_runs_share(spark, n):
    rows = spark.range(n).select(F.lit(0).alias("run"), F.lit(1.0).alias("v"), "id").union(spark.range(n // 4, n).select(F.lit(1), F.lit(1.0), "id"))
    found = sketches.shared_members(sketches.sketched(rows, ["run"], "v", "id"), [], "run", lambda run: run + 1).orderBy("run").collect()
    bound = 0 if n < 4_096 else 5 * sketches.member_error() * n
    assert abs(found[0]["n_members"] - n) <= bound and abs(found[0]["n_kept"] - 3 * n // 4) <= bound
    assert found[1]["n_kept"] == 0
