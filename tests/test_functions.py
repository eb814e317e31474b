from __future__ import annotations

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from quorum.functions import distributions as dist
from quorum.functions import ids, prompts, verdicts
from quorum.operators import inference, planning


def verdict(spark, parse, text):
    row = spark.createDataFrame([(text,)], "t string").select(parse(F.col("t")).alias("v")).first()["v"]
    return row["verdict"], row["error"]


@pytest.mark.parametrize(("text", "want"), [("x\nVERDICT: FIRST", ("first", None)), ("verdict : second", ("second", None)), ("none", (None, "missing")), (None, (None, "missing")), ("VERDICT: TIE VERDICT: tie", ("tie", None)), ("VERDICT: FIRST\nVERDICT: SECOND", (None, "conflicting")), ("VERDICT: FIRSTLY", (None, "missing"))])
def test_pairwise_verdicts(spark, text, want):
    assert verdict(spark, verdicts.pairwise_verdict, text) == want


def test_other_verdicts(spark):
    scale = lambda t: verdicts.scalar_verdict(t, 1, 5)
    assert verdict(spark, scale, "SCORE: 4\nSCORE: 4.0") == (4.0, None)
    assert verdict(spark, scale, "SCORE: 3\nSCORE: 4") == (None, "conflicting")
    assert verdict(spark, scale, "score: 3") == (None, "missing")
    assert verdict(spark, scale, "SCORE: 7") == (None, "scale")
    assert verdict(spark, verdicts.binary_verdict, "VERDICT: pass") == (1.0, None)
    assert verdict(spark, lambda t: verdicts.pairwise_verdict(t, ties_allowed=False), "VERDICT: TIE") == (None, "tie")


def test_prompts_offer_ties_only_where_allowed(spark):
    row = spark.range(1).select(prompts.pairwise_prompt(F.lit("t"), F.lit("a"), F.lit("b")).alias("x"), prompts.pairwise_prompt(F.lit("t"), F.lit("a"), F.lit("b"), ties_allowed=False).alias("y")).first()
    assert "VERDICT: TIE" in row["x"] and "TIE" not in row["y"]
    with pytest.raises(ValueError):
        prompts.scalar_prompt(F.lit("t"), F.lit("r"), "x", 5, 5)


def test_ids_are_hashes_of_quoted_parts(spark):
    found = spark.range(1).select(ids.derived_id((F.lit("a"), True), (F.lit(3), False)).alias("i"), ids.derived_seed((F.lit("a"), True), (F.lit(3), False)).alias("s")).first()
    digest = hashlib.sha256("'a'\x1f3".encode()).hexdigest()
    assert found["i"] == digest[:24] and int(found["s"]) == int(digest[:16], 16)


def test_distributions():
    assert dist.t_quantile(0.975, 10) == pytest.approx(2.228138851986274, abs=1e-9)
    assert dist.t_quantile(0.975, 1) == pytest.approx(12.706204736174694, abs=1e-6)
    assert dist.t_sf(2.0, 5) == pytest.approx(0.05096973941492917, abs=1e-10)
    assert dist.t_cdf(-1e6, 3) == pytest.approx(0, abs=1e-10)
    assert dist.noncentral_t_cdf(2.0, 1e6, 0.0) == pytest.approx(dist.normal_cdf(2.0), abs=1e-4)
    assert dist.noncentral_t_cdf(1.5, 8, 0.0) == pytest.approx(dist.t_cdf(1.5, 8), abs=1e-9)
    assert dist.mcnemar_exact(5, 1) == 14 / 64
    assert dist.mcnemar_exact(4, 4) == 1.0
    assert dist.mcnemar_exact(2000, 1000) < 1e-20


def planned(spark, column, **design):
    return spark.createDataFrame([tuple(float(v) for v in design.values())], ", ".join(f"{k} double" for k in design)).select(column).first()[0]


def test_designs(spark):
    n, sd, psi, delta = (F.col(c) for c in ("n", "sd", "psi", "delta"))
    assert planned(spark, planning.power_mean(n, 0.31, sd), n=50, sd=1) == pytest.approx(0.575, abs=0.002)
    assert planned(spark, planning.power_mean(n, 0.52, sd), n=30, sd=1) == pytest.approx(0.786, abs=0.002)
    found = planned(spark, planning.detectable_binary(n, psi), n=50, psi=0.3)
    assert 0.19 < found < 0.23
    assert planned(spark, planning.power_binary(n, delta, psi), n=50, psi=0.3, delta=found) == pytest.approx(0.8, abs=1e-9)
    assert planned(spark, planning.items_for_mean(delta, sd), delta=0.5, sd=1) == 34
    assert planned(spark, planning.items_for_mean(delta, sd, deff=planning.design_effect(F.lit(5.0), F.lit(0.25))), delta=-0.5, sd=1) == 68
    items = planned(spark, planning.items_for_binary(delta, psi), delta=0.1, psi=0.3)
    assert 230 < items < 240
    assert planned(spark, planning.detectable_mean(n, sd), n=34, sd=1) < 0.5 < planned(spark, planning.detectable_mean(n, sd), n=33, sd=1)
    assert planned(spark, planning.power_binary(n, delta, psi), n=1, psi=1, delta=1) == 1.0


@pytest.mark.parametrize(("of", "x", "y"), [(planning.design_effect, 0.5, 0.1), (planning.items_for_mean, 0.0, 1.0), (planning.detectable_binary, 3.0, 0.01), (planning.items_for_binary, 0.4, 0.3), (planning.detectable_mean, 1.0, 1.0)])
def test_designs_that_make_no_sense_are_errors(spark, of, x, y):
    with pytest.raises(Exception, match="needed|between 0 and 1|so few items"):
        planned(spark, of(F.col("x"), F.col("y")), x=x, y=y)


def test_false_positives_stay_near_their_level(spark):
    d = np.random.default_rng(8).normal(0, 1, (300, 30))
    rows = [(k, f"{k}-{j}", float(v)) for k, row in enumerate(d) for j, v in enumerate(row)]
    totals = inference.cluster_totals(spark.createDataFrame(rows, "k int, cluster string, d double"), ["k"])
    p = [r["flip_p"] for r in inference.sign_flip_by_hash(totals, ["k"], 8, n_perm=199).collect()]
    assert len(p) == 300 and np.mean(np.array(p) <= 0.05) < 0.05 + 4 * np.sqrt(0.05 * 0.95 / 300)


def test_mixed_numbers_are_spread_evenly():
    slots = np.arange(200_000)
    drawn = ids.mixed_numbers(7, 0, 3, slots) % 100
    counts = np.bincount(drawn, minlength=100)
    assert ((counts - 2_000) ** 2 / 2_000).sum() < 150  # chi-square with 99 degrees of freedom
    other = ids.mixed_numbers(7, 0, 4, slots) % 100
    assert abs(np.corrcoef(drawn, other)[0, 1]) < 0.01 and abs(np.corrcoef(drawn[1:], drawn[:-1])[0, 1]) < 0.01


def test_cache_keys_do_not_depend_on_the_order_of_parameters(spark):
    rows = [('{"b": 2, "a": {"x": 1}}',), ('{"a":{"x":1},"b":2}',), ('{"a":{"x":2},"b":2}',), ("{}",)]
    keys = [r[0] for r in spark.createDataFrame(rows, "params string").select(ids.cache_key(F.lit("p"), F.lit("m"), F.lit(1), F.col("params"))).collect()]
    assert keys[0] == keys[1] and len(set(keys)) == 3
