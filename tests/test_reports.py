"""The engine behind reports: moments by cluster size, draws with and without numbering, and the folder of checkpoints."""

from __future__ import annotations

from types import SimpleNamespace

import numpy as np
import pytest
from pyspark.sql import functions as F

from quorum.operators import inference
from quorum.plans import compare
from quorum.sources import checkpoints

COLUMNS = "contrast_id string, item_id string, cluster string, d double"


def _items(spark, sizes: dict[str, int], shift: float = 0.0):
    rng = np.random.default_rng(4)
    return spark.createDataFrame([(c, f"i{k}", f"doc{k % n}", float(rng.integers(-2, 3)) + shift) for c, n in sizes.items() for k in range(3 * n + n // 2)], COLUMNS)


def test_moments_are_those_of_residuals(spark):
    items = _items(spark, {"x": 40, "y": 5}, 1e6)
    totals = inference.cluster_totals(items, ["contrast_id"])
    found = {r["contrast_id"]: r for r in inference.cluster_moments(totals, ["contrast_id"]).collect()}
    for name, own in items.toPandas().groupby("contrast_id"):
        groups = own.groupby("cluster")["d"].agg(["sum", "count"])
        residuals = groups["sum"] - groups["count"] * own["d"].mean()
        assert found[name]["squares"] == pytest.approx((residuals**2).sum(), rel=1e-6)
        assert found[name]["cluster_sizes"] == groups["count"].value_counts().to_dict() and found[name]["n_items"] == len(own)
        assert found[name]["estimate"] == pytest.approx(own["d"].mean())


def test_draws_need_no_numbers_within_a_block(spark):
    totals = inference.cluster_totals(_items(spark, {"x": 40, "y": 5}), ["contrast_id"])
    one, other = (inference.bootstrap(totals, ["contrast_id"], 3, 0.1, 50, most).orderBy("contrast_id").collect() for most in (None, 40))
    assert one == other and len(one) == 2


def test_few_and_many_clusters_in_one_report(spark):
    items = _items(spark, {"x": 40, "y": 5}).withColumn("extra", F.lit(2))
    rows = {r["contrast_id"]: r for r in compare.report(items, ["contrast_id"], seed=1, n_boot=40, n_perm=40, also={"extra": F.sum("extra")}).collect()}
    assert {c: r["test_method"] for c, r in rows.items()} == {"x": "sign-flip-mc", "y": "sign-flip-exact"}
    assert rows["x"]["extra"] == 2 * rows["x"]["n_items"]


def test_report_without_items_has_no_rows(spark):
    assert compare.report(spark.createDataFrame([], COLUMNS), ["contrast_id"], seed=1, n_boot=10, n_perm=10).count() == 0
    lost = spark.createDataFrame([("x", "i", "doc", None)], COLUMNS)
    assert compare.report(lost, ["contrast_id"], seed=1, n_boot=10, n_perm=10).count() == 0
    with pytest.raises(Exception, match="nothing here: x"):
        compare.report(lost, ["contrast_id"], seed=1, n_boot=10, n_perm=10, empty="nothing here").collect()


def test_a_cluster_needs_a_shared_folder(spark):
    context = spark.sparkContext
    away = SimpleNamespace(master="spark://host:7077", getCheckpointDir=lambda: None, _jvm=context._jvm, _jsc=context._jsc)
    conf = SimpleNamespace(get=lambda name, default=None: default if name == "spark.checkpoint.dir" else "file:/tmp/warehouse")
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        checkpoints.shared_dir(SimpleNamespace(sparkContext=away, conf=conf))
