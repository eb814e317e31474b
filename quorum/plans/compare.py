"""Report rows: a comparison or a bias estimate for each contrast, in one job."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quorum.functions import recode
from quorum.operators import inference, multiplicity, reduce
from quorum.sources.checkpoints import cut

#: Contrasts up to whose number a table with one row for each is broadcast.
BROADCAST_CONTRASTS = 100_000
CAVEAT = "Read every result as seen by the judge that was used: more items or repeated calls don't lessen the errors that a judge makes throughout."


def _warnings(*pairs: tuple[Column, Column | str]) -> Column:
    return F.array_compact(F.array(*[F.when(when, F.lit(what) if isinstance(what, str) else what) for when, what in pairs]))


def report(
    items: DataFrame, by: Sequence[str], *, seed: int | Column, scale: float = 1.0, offset: float = 0.0, alpha: float = 0.05, n_boot: int = 10_000, n_perm: int = 10_000, alternative: str = "two-sided",
    value: str = "d", null: float = 0.0, empty: str | None = None, expected: DataFrame | None = None, also: Mapping[str, Column] | None = None,
) -> DataFrame:
    """A row for each contrast of items with a value: estimate, both intervals, the primary one, p-values and warnings.

    The engine works on the items' values; estimates and intervals are shown as scale * x + offset. A contrast without
    an item with a value has no row or, with ``empty``, is an error of that text; ``expected`` has the contrasts that
    must be there. ``also`` are more aggregates of a contrast's items, as columns of the report.

    What comes from items is one aggregation, what comes from clusters another, whose greatest and smallest numbers of
    clusters tell which draws are needed.
    """
    by = list(by)
    also = also or {}
    items = cut(items)
    totals = cut(inference.cluster_totals(items, by, value))
    moments = cut(inference.with_robust_error(inference.cluster_moments(totals, by)))
    seen = moments.agg(F.count("*").alias("n"), F.min("n_clusters").alias("least"), F.max("n_clusters").alias("most")).first()
    closed = inference.with_t_interval(moments, alpha, alternative)
    closed = F.broadcast(closed) if seen["n"] <= BROADCAST_CONTRASTS else closed
    drawn = inference.bootstrap(totals, by, seed, alpha, n_boot, seen["most"]).join(inference.sign_flips(totals, by, seed, n_perm, alternative, seen["least"] or 0), by)
    number = F.col(value)
    of_items = items.groupBy(*by).agg(
        F.count(number).alias("_n"), F.coalesce(F.stddev_samp(number), F.lit(float("nan"))).alias("sd"), reduce.sample_skewness(number).alias("skewness"), *[c.alias(name) for name, c in also.items()]
    )
    rows = drawn.join(closed, by)
    if empty is None:
        rows = of_items.join(rows, by)
    else:
        asked = of_items if expected is None else expected.join(of_items, by, "left")
        name = F.concat_ws(", ", *[F.col(c).cast("string") for c in by])
        none = F.coalesce(F.col("_n"), F.lit(0)) == 0
        rows = asked.join(rows, by, "left").withColumn("estimate", F.when(none, F.raise_error(F.concat(F.lit(empty + ": "), name)).cast("double")).otherwise(F.col("estimate")))
    shown = lambda c: F.col(c) * scale + offset
    primary = inference.primary_interval(F.col("n_clusters"), F.col("ci_low"))
    analytic = F.struct(shown("ci_low").alias("low"), shown("ci_high").alias("high"))
    bootstrap = F.struct(shown("boot_low").alias("low"), shown("boot_high").alias("high"))
    warnings = _warnings(
        (F.col("n_clusters") < inference.FEW_CLUSTERS, F.concat(F.lit("few clusters: "), F.col("n_clusters").cast("string"))),
        (F.col("degenerate"), "all items have the same value: the interval is a point"),
        (F.col("n_clusters") < 2, "one cluster: no analytic interval"),
        (F.lit(alternative != "two-sided") & (F.abs("skewness") > 1), "one-sided test of skewed values"),
    )
    return rows.select(
        *by,
        shown("estimate").alias("estimate"),
        F.when(primary == "analytic", analytic["low"]).otherwise(bootstrap["low"]).alias("ci_low"),
        F.when(primary == "analytic", analytic["high"]).otherwise(bootstrap["high"]).alias("ci_high"),
        primary.alias("ci_method"),
        F.lit(alpha).alias("alpha"),
        analytic.alias("analytic_ci"),
        bootstrap.alias("bootstrap_ci"),
        (F.col("boot_se") * scale).alias("boot_se"),
        (F.col("se") * scale).alias("analytic_se"),
        "t_stat",
        "df",
        F.col("p_value").alias("analytic_p"),
        F.col("flip_p").alias("p_value"),
        F.col("flip_method").alias("test_method"),
        (F.col("mde") * scale).alias("mde_80"),
        (F.col("sd") * scale).alias("sd"),
        "skewness",
        "n_items",
        "n_clusters",
        "cluster_sizes",
        inference.coverage_disclosure(F.col("n_clusters")).alias("disclosure"),
        warnings.alias("warnings"),
        F.lit(CAVEAT).alias("caveat"),
        F.lit(null).alias("null_value"),
        *also,
    )


def as_json(report_rows: DataFrame) -> DataFrame:
    """(report): each row as JSON text."""
    return report_rows.select(F.to_json(F.struct(*report_rows.columns)).alias("report"))


def _with(rows: DataFrame, more: DataFrame, by: list[str]) -> DataFrame:
    return rows.join(more, by, "left")


def _warned(rows: DataFrame, *pairs: tuple[Column, Column | str]) -> DataFrame:
    return rows.withColumn("warnings", F.concat("warnings", _warnings(*pairs)))


def _count(c: str, text: str) -> Column:
    return F.concat(F.col(c).cast("string"), F.lit(f" {text}"))


def compare_pairwise(judgments: DataFrame, a: str, b: str, by: Sequence[str], *, seed: int, **options) -> DataFrame:
    """Win rate of a over b, ties a half, against 0.5."""
    by = list(by)
    items = reduce.reduce_pairwise(judgments, a, b, by)
    rows = report(items, by, seed=seed, scale=0.5, offset=0.5, null=0.5, also=reduce.diagnostic_columns(), **options)
    rows = _with(rows, reduce.record_counts(judgments, recode.pair_of(a, b), by), by)
    return _warned(rows, (~F.col("counterbalanced"), _count("n_single_order", "pairs lack one of their two orders")), (F.col("tie_rate") > 0.3, "ties make up over 30% of the calls, which brings the win rate closer to 0.5"))


def compare_scores(scores: DataFrame, a: str, b: str, by: Sequence[str], *, seed: int, binary: bool = False, **options) -> DataFrame:
    """Difference of mean scores or, with ``binary``, of pass rates; a contrast without an item that has both is an error."""
    by = list(by)
    if binary:
        value = F.col("judgment").cast("double")
        scores = scores.withColumn("judgment", F.when(value.isin(0.0, 1.0), value).otherwise(F.raise_error(F.lit("a binary judgment must be 0 or 1"))))
    items = cut(reduce.reduce_scores(scores, a, b, by))
    whole = F.col("d").isNotNull()
    also = {"mean_a": F.avg(F.when(whole, F.col("x_a"))), "mean_b": F.avg(F.when(whole, F.col("x_b"))), "n_excluded": F.count_if(~whole), "n_side_unbalanced": F.count_if(F.col("side_unbalanced"))}
    also = also | (reduce.concordance_columns() if binary else {})
    rows = report(items, by, seed=seed, empty="no item has both variants", also=also, **options)
    rows = _with(rows, reduce.record_counts(scores, F.col("variant_id").isin(a, b), by), by)
    rows = _with(rows, reduce.first_ids(items.where("side_unbalanced"), "item_id", by).withColumnRenamed("ids", "_unbalanced"), by)
    unbalanced = F.concat(F.when(F.abs("skewness") > 1, "MIND: ").otherwise(""), _count("n_side_unbalanced", "items have unlike numbers of calls on their two sides: "), F.col("_unbalanced"))
    rows = _warned(rows, (F.col("n_excluded") > 0, _count("n_excluded", "items lack one of the variants")), (F.col("n_side_unbalanced") > 0, unbalanced)).drop("_unbalanced")
    if not binary:
        alike = reduce.degenerate_scores(scores.where(F.col("variant_id").isin(a, b)), by)
        return _warned(_with(rows, alike.withColumnRenamed("degenerate", "_alike"), by), (F.col("_alike"), "more than half of a variant's scores are the same")).drop("_alike")
    rows = inference.mcnemar(rows, "n_pass_fail", "n_fail_pass")
    rows = rows.withColumn("mcnemar_p", F.when(F.col("single") & (F.col("n_clusters") == F.col("n_items")), F.col("mcnemar_p")))
    return _warned(rows, (F.col("n_discordant") < 10, "fewer than 10 discordant items"))


def _balanced_report(judgments: DataFrame, code: Column, by: list[str], empty: str, **options) -> DataFrame:
    """The report of order-balanced items with what was used, skipped and dropped on the way."""
    pairs = cut(reduce.balanced_pairs(judgments, code, by))
    also = {"n_pairs_used": F.sum("n_pairs"), "n_pairs_single_order": F.sum("n_single_order"), "n_items_dropped": F.count_if(F.col("g").isNull()), "tie_rate": F.try_divide(F.sum("n_ties").cast("double"), F.sum("n_calls"))}
    rows = report(reduce.balanced_items(pairs, by), by, scale=0.5, empty=empty, also=also, **options)
    rows = _with(rows, reduce.call_counts(judgments, code, by), by)
    rows = _with(rows, reduce.first_ids(pairs.where("orders < 2"), "pair_id", by), by)
    single = F.concat(F.lit("MIND: "), _count("n_pairs_single_order", "pairs without one of their orders are left out: "), F.col("ids"), F.lit("; so are items without another pair: "), F.col("n_items_dropped").cast("string"))
    return _warned(rows, (F.col("n_pairs_single_order") > 0, single), (F.col("n_judges") > 1, F.concat(F.lit("a mixture of judges: "), F.col("judges")))).drop("ids")


def position_bias(judgments: DataFrame, by: Sequence[str], *, seed: int, **options) -> DataFrame:
    """How much more often than half the first response wins, orders balanced; without a pair in both orders it is an error."""
    return _balanced_report(judgments, recode.prefers_first(), list(by), "no pair was judged in both orders", seed=seed, **options)


def verbosity_association(judgments: DataFrame, by: Sequence[str], *, seed: int, **options) -> DataFrame:
    """How often the longer response wins: an association with length, which doesn't tell its cause."""
    rows = _balanced_report(judgments, recode.prefers_longer(), list(by), "no pair of different lengths was judged in both orders", seed=seed, offset=0.5, null=0.5, **options)
    return rows.withColumn("identified", F.lit(False))


def controlled_arms(judgments: DataFrame, original: str, padded: str | None, condensed: str | None) -> DataFrame:
    """The judgments of each arm, and of all arms together, told apart by ``arm``."""
    arms = [(name, judgments.where(recode.pair_of(original, v))) for name, v in (("padded", padded), ("condensed", condensed)) if v is not None]
    if not arms:
        raise ValueError("one arm at least is needed")
    out = None
    for name, rows in arms:
        rows = rows.withColumn("arm", F.explode(F.array(F.lit(name), F.lit("pooled"))))
        out = rows if out is None else out.unionByName(rows)
    return out


def controlled_items(judgments: DataFrame, original: str, padded: str | None, condensed: str | None) -> DataFrame:
    """Order-balanced items of each arm and, as arm ``check``, padded less condensed on the items that have both."""
    items = reduce.order_balanced(controlled_arms(judgments, original, padded, condensed), recode.prefers_longer(), ["arm"]).where(F.col("g").isNotNull())
    items = items.select("arm", "item_id", "cluster", "g", "d")
    if padded is None or condensed is None:
        return items
    of = lambda arm: items.where(F.col("arm") == arm).select("item_id", F.col("cluster").alias(f"cluster_{arm}"), F.col("g").alias(f"g_{arm}"))
    both = of("padded").join(of("condensed"), "item_id")
    same = F.when(F.col("cluster_padded") == F.col("cluster_condensed"), F.col("cluster_padded")).otherwise(F.raise_error(F.concat(F.lit("conflicting source documents across arms for item "), F.col("item_id"))))
    difference = F.col("g_padded") - F.col("g_condensed")
    return items.unionByName(both.select(F.lit("check").alias("arm"), "item_id", same.alias("cluster"), difference.alias("g"), (2 * difference).alias("d")))


def verbosity_bias_controlled(judgments: DataFrame, *, original: str, padded: str | None = None, condensed: str | None = None, seed: int, **options) -> DataFrame:
    """Rows pooled, padded, condensed and check: how much more often than half the longer of two versions wins.

    The rows' seeds are seed, seed + 1, seed + 2 and seed + 3. An arm that was asked for and has no pair of different
    lengths in both orders is an error; without a check the pooled row says so.
    """
    items = cut(controlled_items(judgments, original, padded, condensed))
    arms = ["pooled", *(name for name, v in (("padded", padded), ("condensed", condensed)) if v is not None)]
    expected = judgments.sparkSession.createDataFrame([(name,) for name in arms], "arm string")
    expected = expected.union(items.where("arm = 'check'").select("arm").distinct())
    own = F.lit(seed) + F.when(F.col("arm") == "padded", 1).when(F.col("arm") == "condensed", 2).when(F.col("arm") == "check", 3).otherwise(0)
    rows = report(items, ["arm"], seed=own, scale=0.5, empty="no pair of different lengths was judged in both orders in arm", expected=expected, **options)
    check, four = F.col("arm") == "check", Window.partitionBy()  # four rows at most
    checked = rows.withColumn("_checked", F.bool_or(check).over(four)).withColumn("_rejects", F.bool_or(check & ((F.col("ci_low") > 0) | (F.col("ci_high") < 0))).over(four))
    pooled = F.col("arm") == "pooled"
    why = "one arm only: whether judges respond to length or to the rewriting is unchecked" if len(arms) == 2 else "no item has both arms: whether judges respond to length or to the rewriting is unchecked"
    return _warned(checked, (pooled & ~F.col("_checked"), why), (pooled & F.col("_rejects"), "the check's interval excludes 0: the pooled row is not an effect of length alone")).drop("_checked", "_rejects")


def self_preference_bias(judgments: DataFrame, *, self_judge: str, self_variant: str, other_variant: str, seed: int, **options) -> DataFrame:
    """Win rate of a judge's own variant as it sees it, less as the other judges see it on the same items; without such an item it is an error."""
    name = f"{self_judge} on {self_variant}"
    items = reduce.self_preference(judgments, self_judge, self_variant, other_variant).withColumn("contrast_id", F.lit(name))
    expected = judgments.sparkSession.createDataFrame([(name,)], "contrast_id string")
    own, panel, used = F.col("s_self").isNotNull(), F.col("s_panel").isNotNull(), F.col("d").isNotNull()
    also = {"n_self_only": F.count_if(own & ~panel), "n_panel_only": F.count_if(~own), "panel_min": F.min(F.when(used, F.col("n_panel"))), "panel_max": F.max(F.when(used, F.col("n_panel"))), "naive": F.avg("s_self") - 0.5}
    return report(items, ["contrast_id"], seed=seed, empty="no item was judged by the self judge and by another", expected=expected, also=also, **options)


def variant_contrasts(scores: DataFrame, control: str | None = None) -> DataFrame:
    """(contrast_id, item_id, cluster, d) of each pair of variants, or of each variant against the control.

    Variants meet by an equi-join on the item, so a pair costs only the items that have both.
    """
    rows = scores.withColumn("cluster", recode.cluster_key()).groupBy("item_id", "cluster", "variant_id", "response_id").agg(F.avg("judgment").alias("y"))
    means = rows.groupBy("item_id", "cluster", "variant_id").agg(F.avg("y").alias("x"))
    a, b = means.alias("a"), means.alias("b")
    chosen = (F.col("b.variant_id") == control) & (F.col("a.variant_id") != control) if control else F.col("a.variant_id") < F.col("b.variant_id")
    pairs = a.join(b, (F.col("a.item_id") == F.col("b.item_id")) & (F.col("a.cluster") == F.col("b.cluster")) & chosen)
    return pairs.select(F.concat_ws(" vs ", "a.variant_id", "b.variant_id").alias("contrast_id"), "a.item_id", "a.cluster", (F.col("a.x") - F.col("b.x")).alias("d"))


def judge_contrasts(pairs: DataFrame) -> DataFrame:
    """(contrast_id, item_id, cluster, d) of each two judges: their difference on each balanced pair that both saw in both orders."""
    both = pairs.where(F.col("orders") >= 2)
    a, b = both.alias("a"), both.alias("b")
    met = a.join(b, (F.col("a.item_id") == F.col("b.item_id")) & (F.col("a.pair_id") == F.col("b.pair_id")) & (F.col("a.judge_model") < F.col("b.judge_model")))
    return met.select(F.concat_ws(" vs ", "a.judge_model", "b.judge_model").alias("contrast_id"), "a.item_id", F.col("a.low").alias("cluster"), (F.col("a.y") - F.col("b.y")).alias("d"))


def contrast_report(items: DataFrame, *, seed: int, alpha: float = 0.05, **options) -> DataFrame:
    """Report rows of all contrasts as one family: Holm's p-values, intervals at 1 - alpha / m, and a caveat on the best one."""
    items = cut(items)
    m = items.select("contrast_id").distinct().count()
    rows = multiplicity.adjusted(report(items, ["contrast_id"], seed=seed, alpha=alpha / max(m, 1), **options), "p_value", "contrast_id")
    best = F.row_number().over(Window.orderBy(F.desc("estimate"), "contrast_id")) == 1  # a row for each contrast
    rows = rows.withColumn("best", best).withColumn("family_size", F.lit(m))
    return _warned(rows, (F.col("best") & (F.col("family_size") > 1), F.concat(F.lit("the best of "), F.col("family_size").cast("string"), F.lit(" contrasts overstates its effect"))))


def non_inferiority(report_rows: DataFrame, margin: float) -> DataFrame:
    """Adds whether the interval's lower end lies above -margin."""
    return report_rows.withColumn("non_inferior", F.col("ci_low") > -margin)
