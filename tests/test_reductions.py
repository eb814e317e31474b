from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from quorum.functions import recode
from quorum.operators import inference, multiplicity, reduce, variance
from quorum.plans import compare

PAIRWISE = "item_id string, source_doc_id string, pair_id string, variant_first string, variant_second string, judge_model string, tokens_first int, tokens_second int, judgment string"
SCORES = "item_id string, source_doc_id string, variant_id string, response_id string, judgment double"


def pairs(spark, *rows):
    """Rows of (item, pair, first, second, judgment), with judge and tokens if given."""
    return spark.createDataFrame([(r[0], None, r[1], r[2], r[3], *(r[5:] or ("j", 10, 20)), r[4]) for r in rows], PAIRWISE)


def test_responses_weigh_alike_and_sides_are_compared(spark):
    rows = spark.createDataFrame([("i1", None, "A", "a1", 4.0), ("i1", None, "A", "a1", 5.0), ("i1", None, "A", "a2", 3.0), ("i1", "", "B", "b1", 2.0), ("i2", None, "A", "a3", 1.0), ("i2", None, "C", "c", 9.0)], SCORES)
    found = {r["item_id"]: r for r in reduce.reduce_scores(rows, "A", "B").collect()}
    assert (found["i1"]["x_a"], found["i1"]["d"], found["i1"]["side_unbalanced"]) == (3.75, 1.75, True)
    assert found["i1"]["cluster"] == "__singleton__:i1"
    assert found["i2"]["d"] is None


def test_orders_are_averaged_before_calls(spark):
    # three of four calls with A first prefer A once each; the only call with B first prefers B
    rows = pairs(spark, ("i", "p", "A", "B", "first"), ("i", "p", "A", "B", "first"), ("i", "p", "A", "B", "second"), ("i", "p", "A", "B", "first"), ("i", "p", "B", "A", "first"))
    row = reduce.reduce_pairwise(rows, "A", "B").first()
    assert row["s"] == 0.375 and row["n_single_order"] == 0


def test_ties_count_half(spark):
    row = reduce.reduce_pairwise(pairs(spark, ("i", "p", "B", "A", "first"), ("i", "p", "A", "B", "tie")), "A", "B").first()
    assert (row["s"], row["n_ties"], row["n_calls"]) == (0.25, 1, 2)


def test_conflicts_and_unknown_judgments_are_errors(spark):
    rows = spark.createDataFrame([("i", "d1", "p", "A", "B", "j", 1, 2, "first"), ("i", "d2", "p", "B", "A", "j", 1, 2, "first")], PAIRWISE)
    with pytest.raises(Exception, match="conflicting source documents"):
        reduce.reduce_pairwise(rows, "A", "B").collect()
    with pytest.raises(Exception, match="must be first, second or tie"):
        reduce.reduce_pairwise(pairs(spark, ("i", "p", "A", "B", "third")), "A", "B").collect()
    with pytest.raises(Exception, match="conflicting variants"):
        reduce.order_balanced(pairs(spark, ("i", "p", "A", "B", "first"), ("i", "p", "C", "A", "first")), recode.prefers_first()).collect()
    with pytest.raises(ValueError):
        reduce.reduce_pairwise(rows, "A", "A")


def test_position_bias_of_a_judge_that_always_takes_the_first(spark):
    rows = pairs(spark, *[(f"i{k}", f"p{k}", *o, "first") for k in range(6) for o in (("A", "B"), ("B", "A"))])
    assert [r["g"] for r in reduce.order_balanced(rows, recode.prefers_first()).collect()] == [1.0] * 6
    report = compare.position_bias(rows.withColumn("c", F.lit(1)), ["c"], seed=1, n_boot=50).first()
    assert report["estimate"] == 0.5 and report["n_items"] == 6 and report["test_method"] == "sign-flip-exact"


def test_single_order_pairs_leave_the_bias_estimand(spark):
    row = reduce.order_balanced(pairs(spark, ("i", "p", "A", "B", "first"), ("i", "q", "A", "B", "first"), ("i", "q", "B", "A", "second")), recode.prefers_first()).first()
    assert (row["g"], row["n_pairs"], row["n_single_order"]) == (0.5, 1, 1)


def test_equal_lengths_are_skipped(spark):
    rows = pairs(spark, ("i", "p", "A", "B", "first", "j", 5, 5), ("i", "p", "A", "B", "first", "j", 9, 5), ("i", "p", "B", "A", "first", "j", 5, 9))
    assert reduce.order_balanced(rows, recode.prefers_longer()).first()["g"] == 0.5
    counts = reduce.call_counts(rows, recode.prefers_longer()).first()
    assert (counts["n_calls_used"], counts["n_calls_skipped"], counts["n_same_variant"]) == (2, 1, 0)


def test_controlled_arms_find_an_artifact(spark):
    rows = []
    for k in range(6):
        for name, tokens in (("padded", 300), ("condensed", 80)):
            for first in (True, False):  # the manipulated version always wins
                a, b = (name, "orig") if first else ("orig", name)
                t = (tokens, 150) if first else (150, tokens)
                rows.append((f"i{k}", f"i{k}-{name}", a, b, "first" if first else "second", "j", *t))
    found = {r["arm"]: r["estimate"] for r in compare.verbosity_bias_controlled(pairs(spark, *rows), original="orig", padded="padded", condensed="condensed", seed=3, n_boot=50).collect()}
    assert found == {"padded": 0.5, "condensed": -0.5, "check": 1.0, "pooled": 0.0}


def test_self_preference_against_a_panel(spark):
    rows = []
    for k in range(6):
        for a, b in (("S", "O"), ("O", "S")):
            rows.append((f"i{k}", f"p{k}", a, b, "first" if a == "S" else "second", "self", 1, 2))
            rows.append((f"i{k}", f"p{k}", a, b, "tie", "other", 1, 2))
    row = compare.self_preference_bias(pairs(spark, *rows), self_judge="self", self_variant="S", other_variant="O", seed=2, n_boot=50).first()
    assert (row["estimate"], row["naive"], row["panel_max"]) == (0.5, 0.5, 1)


def test_cluster_statistics(spark):
    items = spark.createDataFrame([("x", "a", 1.0), ("x", "a", 2.0), ("x", "b", 3.0), ("x", "b", 4.0)], "c string, cluster string, d double")
    totals = inference.cluster_totals(items, ["c"])
    row = inference.cluster_robust(totals, ["c"]).first()
    assert (row["n_clusters"], row["estimate"], row["df"]) == (2, 2.5, 1)
    assert [(r["size"], r["n_clusters"]) for r in inference.cluster_sizes(totals, ["c"]).collect()] == [(2, 2)]


def test_singleton_clusters_give_the_paired_t_test(spark):
    d = [0.3, -0.1, 0.4, 0.2, 0.6, -0.2]
    items = spark.createDataFrame([("x", f"c{k}", v) for k, v in enumerate(d)], "c string, cluster string, d double")
    row = inference.cluster_robust(inference.cluster_totals(items, ["c"]), ["c"]).first()
    mean = sum(d) / len(d)
    assert row["se"] == pytest.approx(math.sqrt(sum((x - mean) ** 2 for x in d) / (len(d) - 1) / len(d)))


@pytest.mark.parametrize("n", [(5, 1, 0), (3, 3, 2), (0, 4, 1), (7, 2, 0)])
def test_exact_sign_flips_are_the_exact_mcnemar_test(spark, n):
    from quorum.functions.distributions import mcnemar_exact

    d = [1.0] * n[0] + [-1.0] * n[1] + [0.0] * n[2]
    items = spark.createDataFrame([("x", f"c{k:02d}", v) for k, v in enumerate(d)], "c string, cluster string, d double")
    totals = inference.cluster_totals(items, ["c"])
    assert inference.sign_flip_exact(totals, ["c"]).first()["flip_p"] == pytest.approx(mcnemar_exact(n[0], n[1]))
    both = inference.sign_flips(totals, ["c"], 5).first()
    assert (both["flip_p"], both["flip_method"]) == (pytest.approx(mcnemar_exact(n[0], n[1])), "sign-flip-exact")


def clusters(spark, rows):
    return inference.cluster_totals(spark.createDataFrame(rows, "c string, cluster string, d double"), ["c"])


def test_engine_does_not_depend_on_the_order_of_rows_but_on_the_seed(spark):
    rows = [("x", f"c{k:02d}", float((k * 7) % 5) - 1.7) for k in range(20)]

    def run(r, seed):
        totals = clusters(spark, r)
        return inference.bootstrap(totals, ["c"], seed, n_boot=300).first(), inference.sign_flips(totals, ["c"], seed, n_perm=300).first()

    assert run(rows, 9) == run(rows[::-1], 9)
    assert run(rows, 9)[0] != run(rows, 10)[0]


def test_draws_of_blocks_are_those_of_one_law(spark, monkeypatch):
    """Blocks share out a replicate's draws without loss, and the interval is that of the plain bootstrap."""
    monkeypatch.setattr(inference, "BLOCK_CLUSTERS", 16)
    draws = [inference.block_draws(100, block, 16, 500, 3) for block in range(7)]
    assert (sum(draws) == 100).all()
    assert all(abs(d.mean() - m) < 0.6 for d, m in zip(draws, [16] * 6 + [4]))
    rng = np.random.default_rng(0)
    d = rng.normal(0.3, 1, 300)
    rows = [("x", f"c{k:03d}", float(v)) for k, v in enumerate(d)]
    one = rng.choice(d, (4_000, 300)).mean(axis=1)
    found = inference.bootstrap(clusters(spark, rows), ["c"], 5, n_boot=4_000).first()
    assert found["boot_se"] == pytest.approx(one.std(ddof=1), rel=0.06)
    assert found["boot_low"] == pytest.approx(np.quantile(one, 0.025), abs=0.02) and found["boot_high"] == pytest.approx(np.quantile(one, 0.975), abs=0.02)


def test_seeds_may_differ_by_contrast(spark):
    rows = [(c, f"c{k:02d}", float((k * 7) % 5) - 1.7) for k in range(20) for c in ("x", "y")]
    seed = F.when(F.col("c") == "x", 1).otherwise(2)
    found = {r["c"]: r["boot_se"] for r in inference.bootstrap(clusters(spark, rows), ["c"], seed, n_boot=100).collect()}
    alone = inference.bootstrap(clusters(spark, [r for r in rows if r[0] == "y"]), ["c"], 2, n_boot=100).first()["boot_se"]
    assert found["y"] == pytest.approx(alone) and abs(found["y"] - found["x"]) > 1e-6


def test_float_ties_are_ties(spark):
    rows = [(7 / 12 + 7 / 12 + 1 / 3) / 3 - 0.5, 0.1 + 0.2 - 0.3]
    assert [r[0] for r in spark.createDataFrame([(v,) for v in rows], "v double").select(recode.settled(F.col("v"))).collect()] == [0.0, 0.0]
    items = spark.createDataFrame([("x", "a", 0.1 + 0.2), ("x", "b", 0.3)], "c string, cluster string, d double")
    assert inference.cluster_robust(inference.cluster_totals(items, ["c"]), ["c"]).first()["degenerate"]


def test_holm_and_benjamini_hochberg(spark):
    rows = spark.createDataFrame([(0, 0.01), (1, 0.04), (2, 0.03), (3, 0.005)], "k int, p double")
    found = multiplicity.adjusted(rows, "p", "k").orderBy("k").collect()
    assert [r["holm"] for r in found] == pytest.approx([0.03, 0.06, 0.06, 0.02])
    assert [r["bh"] for r in found] == pytest.approx([0.02, 0.04, 0.04, 0.02])
    with pytest.raises(Exception, match="between 0 and 1"):
        multiplicity.adjusted(spark.createDataFrame([(0, 1.5)], "k int, p double"), "p", "k").collect()


def test_variance_components(spark):
    calls = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("b", 2.0), ("b", 2.0), ("c", 5.0)], "response_id string, y double")
    row = variance.judge_variance(calls, "y", ["response_id"]).first()
    assert (row["sigma2_j"], row["n_used"], row["df"]) == (1.0, 2, 2)
    items = spark.createDataFrame([(float(k), 1.0, 10.0) for k in range(4)], "d double, low double, high double")
    assert variance.variance_components(items, "low").first()["sigma2_b"] == pytest.approx(2 / 3)
    row = variance.variance_components(items, "high").first()
    assert (row["sigma2_b"], row["icc"], row["truncated"]) == (0.0, 0.0, True)


def test_empty_input_gives_no_rows(spark):
    empty = pairs(spark, ("i", "p", "A", "B", "first")).where("false").withColumn("c", F.lit(1))
    assert compare.compare_pairwise(empty, "A", "B", ["c"], seed=1, n_boot=10).count() == 0


def test_reports_refuse_what_they_cannot_estimate(spark):
    single = pairs(spark, ("i", "p", "A", "B", "first")).withColumn("c", F.lit("x"))
    with pytest.raises(Exception, match="no pair was judged in both orders: x"):
        compare.position_bias(single, ["c"], seed=1, n_boot=10).collect()
    equal = pairs(spark, ("i", "p", "A", "B", "first", "j", 5, 5), ("i", "p", "B", "A", "first", "j", 5, 5), ("i", "q", "A", "B", "first", "j", 5, 6)).withColumn("c", F.lit("x"))
    with pytest.raises(Exception, match="no pair of different lengths"):
        compare.verbosity_association(equal, ["c"], seed=1, n_boot=10).collect()
    alone = pairs(spark, ("i", "p", "A", "B", "first", "me", 1, 2))
    for judge in ("me", "other"):
        with pytest.raises(Exception, match="no item was judged by the self judge and by another"):
            compare.self_preference_bias(alone, self_judge=judge, self_variant="A", other_variant="B", seed=1, n_boot=10).collect()
    arm = pairs(spark, ("i", "p", "orig", "padded", "first", "j", 5, 9), ("i", "p", "padded", "orig", "first", "j", 9, 5))
    with pytest.raises(Exception, match="in arm: condensed"):
        compare.verbosity_bias_controlled(arm, original="orig", padded="padded", condensed="condensed", seed=1, n_boot=10).collect()
    found = {r["arm"]: r["warnings"] for r in compare.verbosity_bias_controlled(arm, original="orig", padded="padded", seed=1, n_boot=10).collect()}
    assert set(found) == {"pooled", "padded"} and any("one arm only" in w for w in found["pooled"])
    scores = spark.createDataFrame([("i", None, "A", "a", 1.0), ("j", None, "B", "b", 1.0)], SCORES).withColumn("c", F.lit("x"))
    with pytest.raises(Exception, match="no item has both variants: x"):
        compare.compare_scores(scores, "A", "B", ["c"], seed=1, n_boot=10).collect()


def test_warnings_name_eight_pairs_and_every_judge(spark):
    rows = [(f"i{k}", f"p{k:02d}", "A", "B", "first", f"j{k % 2}", 1, 2) for k in range(12)] + [("i0", "p00", "B", "A", "second", "j0", 1, 2), ("i0", "p00", "C", "C", "tie", "j0", 1, 2)]
    report = compare.position_bias(pairs(spark, *rows).withColumn("c", F.lit("x")), ["c"], seed=1, n_boot=10).first()
    assert (report["n_items"], report["n_items_dropped"], report["n_pairs_single_order"], report["n_same_variant"], report["judges"]) == (1, 11, 11, 1, "j0, j1")
    assert any("11 pairs" in w and w.count("p0") == 8 and "p08, ..." in w for w in report["warnings"]) and any("mixture of judges: j0, j1" in w for w in report["warnings"])
    used = compare.compare_pairwise(pairs(spark, *rows).withColumn("c", F.lit("x")), "A", "B", ["c"], seed=1, n_boot=10).first()
    assert (used["n_records_used"], used["n_records_ignored"]) == (13, 1)


def test_a_family_of_contrasts(spark):
    items = spark.createDataFrame([(c, f"i{k}", f"d{k}", float(k % 3) - 0.5 + lift) for k in range(12) for c, lift in (("a", 0.0), ("b", 0.9))], "contrast_id string, item_id string, cluster string, d double")
    rows = {r["contrast_id"]: r for r in compare.contrast_report(items, seed=3, n_boot=50).collect()}
    assert rows["b"]["best"] and any("the best of 2" in w for w in rows["b"]["warnings"]) and not rows["a"]["best"]
    assert rows["b"]["alpha"] == 0.025 and rows["b"]["holm"] == min(1.0, 2 * rows["b"]["p_value"])
    assert '"contrast_id":"a"' in compare.as_json(compare.contrast_report(items, seed=3, n_boot=50).where("contrast_id = 'a'")).first()["report"]


def test_krippendorff_alpha(spark):
    # four units by two observers with one disagreement; the fifth unit has one observer only
    rows = [("1", "a"), ("1", "a"), ("2", "b"), ("2", "b"), ("3", "a"), ("3", "b"), ("4", "b"), ("4", "b"), ("5", "a")]
    found = reduce.krippendorff_alpha(spark.createDataFrame(rows, "u string, v string"), ["u"], "v").first()
    disagree, expected = 2 / 8, 1 - (3 * 2 + 5 * 4) / (8 * 7)
    assert (found["n_units"], found["n_judgments"], found["alpha"]) == (4, 8, pytest.approx(1 - disagree / expected))
