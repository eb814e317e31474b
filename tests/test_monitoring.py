from __future__ import annotations

import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from quorum.operators import agreement, inference, replicates, running, sequences, variance

UNITS = "series string, run string, cluster string, x double"


def plain_sequence(rows, alpha=0.05, horizon=None):
    """(run, n, estimate, low, high) by one loop over [0, 1] observations in order; rows are (run, cluster, x)."""
    rows = sorted(rows, key=lambda r: (r[0], hashlib.md5(r[1].encode()).hexdigest(), r[1]))
    edge, total, squares, l_sum, lx, v, out = math.log(2 / alpha), 0.0, 0.0, 0.0, 0.0, 0.0, {}
    for t, (run, _, x) in enumerate(rows, 1):
        before, spread = (0.5 + total) / t, (0.25 + squares) / t
        weight = min(0.5, math.sqrt(2 * edge / (spread * (horizon or t * math.log(1 + t)))))
        total += x
        squares += (x - (0.5 + total) / (t + 1)) ** 2
        l_sum, lx, v = l_sum + weight, lx + weight * x, v + (x - before) ** 2 * (-math.log(1 - weight) - weight)
        out[run] = (t, lx / l_sum, max(0.0, (lx - edge - v) / l_sum), min(1.0, (lx + edge + v) / l_sum))
    return out


@pytest.mark.parametrize("method, horizon", [("anytime", None), ("horizon", 60)])
def test_sequence_is_that_of_one_loop(spark, method, horizon):
    rng = np.random.default_rng(1)
    rows = [(s, f"2024-{m:02d}", f"c{k}", float(rng.beta(2, 3))) for s in "ab" for m in (1, 2, 3, 5) for k in range(25)]
    found = sequences.confidence_sequence(spark.createDataFrame(rows, UNITS), ["series"], method, 0.0, 1.0, horizon=horizon).collect()
    for s in "ab":
        want = plain_sequence([r[1:] for r in rows if r[0] == s], horizon=horizon)
        mine = {r["run"]: (r["n"], r["estimate"], r["cs_low"], r["cs_high"]) for r in found if r["series"] == s}
        assert mine.keys() == want.keys() and all(mine[k] == pytest.approx(want[k]) for k in want)
    last = [r for r in found if r["run"] == "2024-05"]
    assert all(r["all_low"] == max(x["cs_low"] for x in found if x["series"] == r["series"]) for r in last)


def test_sequences_cover_at_all_times(spark):
    """500 series with the same mean, looked at after each of 20 runs: hardly one is ever missed."""
    rng = np.random.default_rng(2)
    rows = [(f"s{s}", f"{m:02d}", f"c{k}", float(x)) for s in range(500) for m in range(20) for k, x in enumerate(rng.choice([-1.0, 0.0, 1.0], 8, p=[0.2, 0.3, 0.5]))]
    table = spark.createDataFrame(rows, UNITS)
    for method, horizon in (("anytime", None), ("horizon", 100)):
        found = sequences.confidence_sequence(table, ["series"], method, -1.0, 1.0, horizon=horizon)
        missed = found.where((F.col("cs_low") > 0.3) | (F.col("cs_high") < 0.3)).select("series").distinct().count()
        ends = found.where("run = '19'").agg(F.avg(F.col("cs_high") - F.col("cs_low"))).first()[0]
        assert missed <= 25 and ends < 0.8


def test_sequences_ask_for_a_choice(spark):
    table = spark.createDataFrame([("a", "1", "c", 0.5)], UNITS)
    for bad in ({"method": "best", "low": 0.0, "high": 1.0}, {"method": "horizon", "low": 0.0, "high": 1.0}, {"method": "anytime", "low": 0.0, "high": 1.0, "horizon": 9}, {"method": "anytime", "low": 1.0, "high": 1.0}):
        with pytest.raises(ValueError):
            sequences.confidence_sequence(table, ["series"], **bad)
    with pytest.raises(Exception, match="between"):
        sequences.confidence_sequence(table, ["series"], "anytime", 0.0, 0.25).collect()
    assert sequences.confidence_sequence(table.where("false"), ["series"], "anytime", 0.0, 1.0).count() == 0
    means = sequences.cluster_means(spark.createDataFrame([("1", "c", 0.0), ("1", "c", 1.0), (None, "c", 1.0), ("2", None, 1.0), ("2", "c", None)], "run string, cluster string, y double"), [], "run", "y")
    assert [tuple(r) for r in means.collect()] == [("1", "c", 0.5)]


def test_running_sums_cross_buckets(spark):
    rows = spark.createDataFrame([("a" if k % 3 else "b", k // 7, k, float(k)) for k in range(60)], "s string, bucket long, k long, x double")
    for r in running.earlier_sums(rows, ["s"], ["bucket"], ["k"], {"n": F.lit(1), "total": F.col("x")}).collect():
        earlier = [k for k in range(r["k"]) if ("a" if k % 3 else "b") == r["s"]]
        assert (r["n"], r["total"]) == (len(earlier), sum(earlier))


def test_joins_of_null_keys(spark):
    left, right = spark.createDataFrame([(1, "x"), (None, "y")], "k long, v string"), spark.createDataFrame([(None, 5), (2, 6)], "k long, w long")
    assert [tuple(r) for r in running.join_null_safe(left, right, ["k"]).collect()] == [(None, "y", 5)]
    assert sorted((tuple(r) for r in running.join_null_safe(left, right, ["k"], "left").collect()), key=repr) == [(1, "x", None), (None, "y", 5)]
    assert running.join_null_safe(left, right.limit(1).drop("k"), []).count() == 2


# --- nested variance


CALLS = "by string, item_id string, variant_id string, response_id string, judgment double"


def test_variance_components_of_an_unbalanced_nest(spark):
    rng = np.random.default_rng(3)
    rows = []
    for i in range(3_000):
        for k in range(int(rng.integers(1, 4))):
            g = rng.normal(0, 0.7)
            rows += [(None if i % 2 else "b", f"i{i}", "A", f"r{k}", float(g + rng.normal(0, 0.4))) for _ in range(int(rng.integers(1, 5)))]
    found = variance.nested_variance(spark.createDataFrame(rows, CALLS), "judgment", ["item_id", "variant_id"], "response_id", ["by"]).collect()
    assert len(found) == 2
    for r in found:
        assert r["sigma2_j"] == pytest.approx(0.16, rel=0.1) and r["sigma2_g"] == pytest.approx(0.49, rel=0.12) and r["identified"] and not r["truncated_g"]


def test_nested_variance_by_hand(spark):
    nested = lambda rows: variance.nested_variance(spark.createDataFrame([("x", *r) for r in rows], CALLS), "judgment", ["item_id", "variant_id"], "response_id").first()
    r = nested([("i", "A", "r", 1.0), ("i", "A", "r", 3.0), ("i", "A", "s", 8.0)])
    # means 2 and 8 of 2 and 1 calls about 4: squares 2 * 4 + 16 = 24; weight 3 - 5 / 3; within 2
    assert (r["sigma2_j"], r["df_j"], r["df_g"], r["weight"], r["sigma2_g"]) == (2.0, 1, 1, pytest.approx(4 / 3), pytest.approx(22 / (4 / 3)))
    r = nested([("i", "A", "r", 1.0), ("i", "A", "s", 3.0)])  # no call is repeated
    assert (r["sigma2_j"], r["sigma2_g"], r["identified"]) == (None, None, False)
    r = nested([("i", "A", "r", 1.0), ("i", "A", "r", 3.0), ("j", "A", "r", None)])  # no second response
    assert (r["sigma2_j"], r["sigma2_g"], r["identified"]) == (2.0, None, False)
    r = nested([("i", "A", "r", 1.0), ("i", "A", "r", 3.0), ("i", "A", "s", 2.0)])
    assert (r["sigma2_g"], r["identified"], r["truncated_g"]) == (0.0, True, True)


def test_item_noise_weighs_each_response(spark):
    calls = spark.createDataFrame([("x", "i", "A", "r", 1.0), ("x", "i", "A", "r", 1.0), ("x", "i", "A", "s", 1.0), ("x", "i", "N", "t", 1.0), ("x", "j", "A", "r", 1.0)], CALLS)
    known = lambda g: spark.createDataFrame([(0.5, g)], "sigma2_j double, sigma2_g double")
    (r,) = variance.item_noise(calls, "judgment", ["A", "N"], known(2.0)).collect()
    assert (r["item_id"], r["within"]) == ("i", pytest.approx(2 / 2 + 0.5 * 1.5 / 4 + 2 + 0.5))
    (r,) = variance.item_noise(calls, "judgment", ["A", "N"], known(None)).collect()
    assert r["within"] == pytest.approx(0.5 * 1.5 / 4 + 0.5)


# --- agreement


def plain_alpha(units, distance):
    units = [u for u in units if len(u) > 1]
    n = sum(map(len, units))
    everything = [x for u in units for x in u]
    seen = sum(sum(distance(a, b, everything) for a in u for b in u) / (len(u) - 1) for u in units) / n
    return 1 - seen / (sum(distance(a, b, everything) for a in everything for b in everything) / (n * (n - 1)))


def ordinal(a, b, everything):
    low, high = min(a, b), max(a, b)
    return (sum(low <= x <= high for x in everything) - (everything.count(a) + everything.count(b)) / 2) ** 2


def test_alpha_by_level(spark):
    rng = np.random.default_rng(4)
    units = [[float(x) for x in rng.integers(1, 6, rng.integers(1, 6))] for _ in range(40)] + [[5.0] * 9, [1.0, 5.0]]
    rows = spark.createDataFrame([(f"u{k}" if k else None, x) for k, u in enumerate(units) for x in u] + [("u1", None)], "unit string, x double")
    for level, distance in (("interval", lambda a, b, _: (a - b) ** 2), ("ordinal", ordinal)):
        r = agreement.krippendorff(rows, ["unit"], "x", level).first()
        assert r["alpha"] == pytest.approx(plain_alpha(units, distance)) and r["n_units"] == sum(len(u) > 1 for u in units)
    sums = agreement.nominal_sums(rows.withColumns({"word": F.concat(F.lit("v"), F.col("x").cast("int").cast("string")), "cluster": F.lit("c")}), ["unit"], "word", [f"v{k}" for k in range(1, 6)], "cluster")
    assert sums.select(agreement.nominal_alpha([f"v{k}" for k in range(1, 6)])).first()[0] == pytest.approx(plain_alpha(units, lambda a, b, _: float(a != b)))
    alike = spark.createDataFrame([("u", 2.0), ("u", 2.0)], "unit string, x double")
    assert [agreement.krippendorff(alike, ["unit"], "x", level).first()["alpha"] for level in ("ordinal", "interval")] == [None, None]
    with pytest.raises(ValueError):
        agreement.alpha_sums(alike, ["unit"], "x", level="nominal")


# --- replicate weights


def test_weights_of_blocks_add_up(monkeypatch):
    monkeypatch.setattr(inference, "DRAWN", 40)
    c, held, n_boot = 23, 10, 50
    weights = []
    for block, n in enumerate((10, 10, 3)):
        parts = list(replicates.block_weights(n, c, block, held, n_boot, 5))
        assert [first for first, _ in parts] == list(np.cumsum([0, *(len(w) for _, w in parts[:-1])]))
        weights.append(np.concatenate([w for _, w in parts]))
    whole = np.concatenate(weights, axis=1)
    assert whole.shape == (n_boot, c) and (whole.sum(axis=1) == c).all() and len(np.unique(whole, axis=0)) == n_boot


def test_intervals_are_those_of_the_mean_bootstrap(spark, monkeypatch):
    monkeypatch.setattr(inference, "BLOCK_CLUSTERS", 16)
    rng = np.random.default_rng(6)
    rows = [("ab"[k % 2], f"c{k}", float(rng.normal(0.1, 1)) * 3, 3, None if k == 4 else 1.0) for k in range(90)]
    totals = spark.createDataFrame(rows, "by string, cluster string, total double, size long, other double")
    mean = F.col("total") / F.col("size")
    mine = {r["by"]: r for r in replicates.intervals(totals, ["by"], ["total", "size", "other"], {"mean": mean, "share": F.try_divide("other", "size")}, 7, n_boot=300).where("statistic = 'mean'").collect()}
    for r in inference.bootstrap(totals.drop("other"), ["by"], 7, n_boot=300).collect():
        own = mine[r["by"]]
        assert (own["boot_low"], own["boot_high"], own["boot_se"], own["n_clusters"], own["n_defined"]) == (pytest.approx(r["boot_low"]), pytest.approx(r["boot_high"]), pytest.approx(r["boot_se"]), 45, 300)


def test_undefined_replicates_are_counted(spark):
    stats = spark.createDataFrame([("a", 1.0, 0.0), ("b", 0.0, 0.0), ("c", 0.0, 1.0)], "cluster string, wins double, losses double")
    r = replicates.intervals(stats, [], ["wins", "losses"], {"rate": F.try_divide(F.col("wins"), F.col("wins") + F.col("losses"))}, 1, n_boot=400).first()
    assert r["estimate"] == 0.5 and 350 < r["n_defined"] < 400 and (r["boot_low"], r["boot_high"]) == (0.0, 1.0)
    with pytest.raises(ValueError):
        replicates.replicate_sums(stats, [], ["wins"], 1, 1)
    cell = lambda a, b: F.lit({"xx": 20.0, "xy": 5.0, "yx": 10.0, "yy": 15.0}[a + b])
    assert stats.limit(1).select(replicates.kappa(["x", "y"], cell)).first()[0] == pytest.approx(0.4)
