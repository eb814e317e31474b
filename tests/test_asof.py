from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from quorum.operators import asof, inference, rollup


@pytest.mark.parametrize("slice_seconds", [60, 3_600, 10**9])
def test_asof_joins_are_those_of_a_loop(spark, slice_seconds):
    rng = np.random.default_rng(1)
    keys = [None, "a", "b", "c"]
    rows = [(keys[int(rng.integers(0, 4))], int(rng.integers(0, 20_000)), k) for k in range(400)] + [("a", None, 1_000), ("a", 5, 1_001)]
    versions = [(keys[int(rng.integers(0, 3))], int(rng.integers(0, 20_000)), f"v{k}") for k in range(60)] + [("a", 5, "x"), ("a", 5, "y"), ("a", None, "never"), ("b", 100, None)]
    second = lambda c: F.timestamp_seconds(c)
    left = spark.createDataFrame(rows, "k string, s long, id long").withColumn("at", second(F.col("s")))
    right = spark.createDataFrame(versions, "k string, s long, v string").select("k", second(F.col("s")).alias("since"), "v")
    found = asof.asof_join(left, right, ["k"], "at", "since", ["v"], slice_seconds)
    assert found.columns == [*left.columns, "v"]
    valid = lambda k, s: [(t, v or "", v) for q, t, v in versions if q == k and t is not None and s is not None and t <= s]
    want = {i: max(valid(k, s))[2] if valid(k, s) else None for k, s, i in rows}
    assert {r["id"]: r["v"] for r in found.collect()} == want and found.count() == len(rows)
    assert asof.asof_join(left, right.where("false"), ["k"], "at", "since", ["v"]).where("v is not null").count() == 0
    assert asof.asof_join(left.where("false"), right, ["k"], "at", "since", ["v"]).count() == 0
    with pytest.raises(ValueError, match="already"):
        asof.asof_join(left, right.withColumn("id", F.lit(1)), ["k"], "at", "since", ["id"])


def test_rollup_levels_are_those_of_their_own_estimates(spark):
    rng = np.random.default_rng(2)
    rows = [(None if k % 5 == 0 else "ab"[k % 2], "xyz"[k % 3], f"c{k % 17}", float(rng.normal())) for k in range(200)]
    items = spark.createDataFrame(rows, "judge string, stratum string, cluster string, d double")
    by = ["judge", "stratum"]
    found = rollup.rolled_up(inference.cluster_totals(items, by), by, [by, ["judge"], [], ["stratum"]])
    levels = {"judge, stratum": by, "judge": ["judge"], "stratum": ["stratum"], "all": []}
    mine = {(r["level"], r["judge"], r["stratum"]): (r["n_items"], r["n_clusters"], r["estimate"], r["se"]) for r in found.collect()}
    want = 0
    for level, columns in levels.items():
        own = items.withColumns({c: F.lit(None).cast("string") for c in by if c not in columns}).withColumns({c: F.coalesce(F.col(c), F.lit("none")) for c in columns}).withColumn("one", F.lit(1))
        keys = [*columns, "one"]
        for r in inference.cluster_robust(inference.cluster_totals(own, keys), keys).collect():
            at = (level, *[(None if r[c] == "none" else r[c]) if c in columns else None for c in by])
            assert mine[at] == pytest.approx((r["n_items"], r["n_clusters"], r["estimate"], r["se"]))
            want += 1
    assert want == len(mine)
    with pytest.raises(ValueError):
        rollup.rolled_up(inference.cluster_totals(items, by), by, [["arm"]])
