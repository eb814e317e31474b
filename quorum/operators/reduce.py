"""Reductions of judgment rows to one number for each item.

Every function takes ``by``, the columns that tell contrasts apart (judge, arm, stratum, replication), and reduces all
contrasts in one job. Averages nest: calls, then responses or presentation orders, then pairs, then the item. Each
level is a partial aggregation of its own, so an item with a third of all rows is spread over its pairs and orders.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quorum.functions import recode


#: Ids that a warning names at most.
NAMED_IDS = 8


def _ids(rows: DataFrame) -> DataFrame:
    return rows.withColumn("cluster", recode.cluster_key()).withColumn("item_id", F.col("item_id").cast("string"))


def _one_cluster() -> Column:
    return recode.one_of(F.min("low"), F.min("low"), F.max("high"), F.concat(F.lit("conflicting source documents for item "), F.first("item_id")))


def reduce_scores(scores: DataFrame, a: str, b: str, by: Sequence[str] = ()) -> DataFrame:
    """(by, item_id, cluster, x_a, x_b, d, side_unbalanced, n_calls) of each item with a score for either variant.

    An item without one of the variants has a null d. Responses weigh alike however many calls they have; an item is
    side-unbalanced if its variants' responses differ in their numbers of calls.
    """
    if a == b:
        raise ValueError("the two variants must differ")
    by = list(by)
    rows = _ids(scores.where(F.col("variant_id").isin(a, b)))
    responses = rows.groupBy(*by, "item_id", "variant_id", F.col("response_id").cast("string").alias("response_id")).agg(
        F.avg(F.col("judgment").cast("double")).alias("y"), F.count("*").alias("m"), F.min("cluster").alias("low"), F.max("cluster").alias("high")
    )
    # responses with as many calls go together, so that the list of counts stays short
    counts = responses.groupBy(*by, "item_id", "variant_id", "m").agg(F.sum("y").alias("y"), F.count("*").alias("r"), F.min("low").alias("low"), F.max("high").alias("high"))
    sides = counts.groupBy(*by, "item_id", "variant_id").agg(
        (F.sum("y") / F.sum("r")).alias("x"),
        F.sort_array(F.collect_list(F.struct("m", "r"))).alias("shape"),
        F.sum(F.col("m") * F.col("r")).alias("n"),
        F.min("low").alias("low"),
        F.max("high").alias("high"),
    )
    side = lambda v, c: F.max(F.when(F.col("variant_id") == v, F.col(c)))
    items = sides.groupBy(*by, "item_id").agg(
        _one_cluster().alias("cluster"), side(a, "x").alias("x_a"), side(b, "x").alias("x_b"), side(a, "shape").alias("shape_a"), side(b, "shape").alias("shape_b"), F.sum("n").alias("n_calls")
    )
    items = items.withColumn("d", F.col("x_a") - F.col("x_b"))
    return items.select(*by, "item_id", "cluster", "x_a", "x_b", "d", (F.col("shape_a") != F.col("shape_b")).alias("side_unbalanced"), "n_calls")


def paired(items: DataFrame) -> DataFrame:
    """The items that have both variants."""
    return items.where(F.col("d").isNotNull())


def _pairs(calls: DataFrame, by: list[str], order: Column) -> DataFrame:
    tie = (F.col("judgment") == "tie").cast("long")
    orders = calls.groupBy(*by, "item_id", F.col("pair_id").cast("string").alias("pair_id"), order.alias("order")).agg(
        F.avg("y").alias("y"), F.count("*").alias("n"), F.sum(tie).alias("ties"), F.min("cluster").alias("low"), F.max("cluster").alias("high"), F.min("variants").alias("vlow"), F.max("variants").alias("vhigh")
    )
    return orders.groupBy(*by, "item_id", "pair_id").agg(
        recode.one_of(F.avg("y"), F.min("vlow"), F.max("vhigh"), F.concat(F.lit("conflicting variants for pair "), F.first("pair_id"))).alias("y"),
        F.count("*").alias("orders"),
        F.sum("n").alias("n"),
        F.sum("ties").alias("ties"),
        F.min("low").alias("low"),
        F.max("high").alias("high"),
    )


def _with_variants(rows: DataFrame) -> DataFrame:
    first, second = F.col("variant_first").cast("string"), F.col("variant_second").cast("string")
    return rows.withColumn("variants", F.concat_ws("\x1f", F.least(first, second), F.greatest(first, second)))


def reduce_pairwise(judgments: DataFrame, a: str, b: str, by: Sequence[str] = ()) -> DataFrame:
    """(by, item_id, cluster, s, d, n_pairs, n_single_order, n_calls, n_ties): s is the win rate of a, d = 2 s - 1.

    Orders are averaged before pairs, which removes a position effect even where calls are uneven. Pairs seen in one
    order only are kept and counted.
    """
    if a == b:
        raise ValueError("the two variants must differ")
    by = list(by)
    rows = _with_variants(_ids(judgments.where(recode.pair_of(a, b)))).withColumn("y", recode.prefers(a))
    pairs = _pairs(rows, by, F.col("variant_first") == a)
    items = pairs.groupBy(*by, "item_id").agg(
        _one_cluster().alias("cluster"),
        F.avg("y").alias("s"),
        F.count("*").alias("n_pairs"),
        F.count_if(F.col("orders") == 1).alias("n_single_order"),
        F.sum("n").alias("n_calls"),
        F.sum("ties").alias("n_ties"),
    )
    return items.withColumn("d", 2 * F.col("s") - 1)


def balanced_pairs(judgments: DataFrame, code: Column, by: Sequence[str] = ()) -> DataFrame:
    """(by, item_id, pair_id, y, orders, n, ties, low, high) of each pair, from a recode of each call to 0..1 or null.

    Calls that compare a variant with itself or are recoded to null are left out.
    """
    rows = _with_variants(_ids(judgments)).withColumn("y", code).where((F.col("variant_first") != F.col("variant_second")) & F.col("y").isNotNull())
    return _pairs(rows, list(by), F.col("variant_first"))


def balanced_items(pairs: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by, item_id, cluster, g, d, n_pairs, n_single_order, n_calls, n_ties) of balanced pairs.

    Pairs seen in one order only are left out, as they would bring the position effect back. An item without any other
    pair has a null g.
    """
    both = F.col("orders") >= 2
    items = pairs.groupBy(*by, "item_id").agg(
        _one_cluster().alias("cluster"),
        F.avg(F.when(both, F.col("y"))).alias("g"),
        F.count_if(both).alias("n_pairs"),
        F.count_if(~both).alias("n_single_order"),
        F.sum("n").alias("n_calls"),
        F.sum("ties").alias("n_ties"),
    )
    return items.withColumn("d", 2 * F.col("g") - 1)


def order_balanced(judgments: DataFrame, code: Column, by: Sequence[str] = ()) -> DataFrame:
    """The items of ``balanced_items`` over the pairs of ``balanced_pairs``."""
    return balanced_items(balanced_pairs(judgments, code, by), by)


def order_difference(judgments: DataFrame, value: Column, variant: str, by: Sequence[str] = ()) -> DataFrame:
    """(by, item_id, pair_id, cluster, d) of each pair in both orders: the mean of ``value`` with the variant in front, less that behind."""
    rows = _ids(judgments).withColumn("y", value)
    orders = rows.groupBy(*by, "item_id", "pair_id", (F.col("variant_first") == variant).alias("front")).agg(F.avg("y").alias("y"), F.min("cluster").alias("low"), F.max("cluster").alias("high"))
    of = lambda front: F.max(F.when(F.col("front") == front, F.col("y")))
    pairs = orders.groupBy(*by, "item_id", "pair_id").agg(_one_cluster().alias("cluster"), (of(True) - of(False)).alias("d"))
    return pairs.where(F.col("d").isNotNull())


def krippendorff_alpha(judgments: DataFrame, unit: Sequence[str], value: str, by: Sequence[str] = ()) -> DataFrame:
    """(by, n_units, n_judgments, agreement, chance, alpha) of nominal judgments, over units with two or more."""
    by, unit = list(by), list(unit)
    counts = judgments.where(F.col(value).isNotNull()).groupBy(*by, *unit, value).agg(F.count("*").alias("n"))
    units = counts.groupBy(*by, *unit).agg(F.sum("n").alias("m"), F.sum(F.col("n") * (F.col("n") - 1)).alias("agreeing"), F.collect_list(F.struct(F.col(value).alias("value"), "n")).alias("values")).where(F.col("m") >= 2)
    means = units.groupBy(*by).agg(F.count("*").alias("n_units"), F.sum("m").alias("n_judgments"), (F.sum(F.col("agreeing") / (F.col("m") - 1)) / F.sum("m")).alias("agreement"))
    totals = units.select(*by, F.explode("values").alias("v")).groupBy(*by, "v.value").agg(F.sum("v.n").alias("n"))
    chance = totals.groupBy(*by).agg((F.sum(F.col("n") * (F.col("n") - 1)) / (F.sum("n") * (F.sum("n") - 1))).alias("chance"))
    rows = means.join(chance, by) if by else means.join(F.broadcast(chance))  # one row
    return rows.withColumn("alpha", 1 - F.try_divide(1 - F.col("agreement"), 1 - F.col("chance")))


def first_ids(rows: DataFrame, id_: str, by: Sequence[str] = ()) -> DataFrame:
    """(by, ids): the first NAMED_IDS ids of each contrast as text, and an ellipsis where there are more."""
    by = list(by)
    place = F.row_number().over(Window.partitionBy(*by).orderBy(id_))
    few = rows.select(*by, id_).withColumn("_place", place).where(F.col("_place") <= NAMED_IDS + 1)
    out = few.groupBy(*by).agg(F.array_sort(F.collect_list(id_)).alias("ids"))
    return out.select(*by, F.concat(F.array_join(F.slice("ids", 1, NAMED_IDS), ", "), F.when(F.size("ids") > NAMED_IDS, ", ...").otherwise("")).alias("ids"))


def record_counts(records: DataFrame, used: Column, by: Sequence[str] = ()) -> DataFrame:
    """(by, n_records_used, n_records_ignored): the records that a comparison takes, and the others."""
    taken = F.coalesce(used, F.lit(False))
    return records.groupBy(*by).agg(F.count_if(taken).alias("n_records_used"), F.count_if(~taken).alias("n_records_ignored"))


def call_counts(judgments: DataFrame, code: Column, by: Sequence[str] = ()) -> DataFrame:
    """(by, n_calls_used, n_calls_skipped, n_same_variant, n_judges, judges: their names) of the calls that ``order_balanced`` sees."""
    rows = judgments.withColumn("y", code)
    same = F.col("variant_first") == F.col("variant_second")
    used = ~same & F.col("y").isNotNull()
    judges = F.collect_set(F.when(used, F.col("judge_model")))
    return rows.groupBy(*by).agg(
        F.count_if(used).alias("n_calls_used"),
        F.count_if(~same & F.col("y").isNull()).alias("n_calls_skipped"),
        F.count_if(same).alias("n_same_variant"),
        F.size(judges).cast("long").alias("n_judges"),
        F.array_join(F.array_sort(judges), ", ").alias("judges"),
    )


def diagnostic_columns() -> dict[str, Column]:
    """n_pairs, n_single_order, n_calls, tie_rate and counterbalanced as aggregates of reduced pairwise items."""
    counts = {c: F.sum(c) for c in ("n_pairs", "n_single_order", "n_calls")}
    tie_rate = F.try_divide(F.sum("n_ties").cast("double"), counts["n_calls"])
    return counts | {"tie_rate": tie_rate, "counterbalanced": (counts["n_pairs"] > 0) & (counts["n_single_order"] == 0)}


def pairwise_diagnostics(items: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by, n_items, n_pairs, n_single_order, n_calls, tie_rate, counterbalanced) of reduced pairwise items."""
    return items.groupBy(*by).agg(F.count("*").alias("n_items"), *[c.alias(name) for name, c in diagnostic_columns().items()])


def sample_skewness(value: Column) -> Column:
    """Bias-corrected sample skewness, 0 where it is undefined."""
    n = F.count(value).cast("double")
    corrected = F.skewness(value) * F.sqrt(n * (n - 1)) / (n - 2)
    alike = recode.settled(F.min(value)) == recode.settled(F.max(value))
    return F.when((F.count(value) < 3) | alike, 0.0).otherwise(F.when(F.isnan(corrected), 0.0).otherwise(corrected))


def score_distribution(scores: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by, variant_id, judgment, n, share, degenerate): degenerate where one score has more than half."""
    counts = scores.groupBy(*by, "variant_id", "judgment").agg(F.count("*").alias("n"))
    totals = counts.groupBy(*by, "variant_id").agg(F.sum("n").alias("total"), F.max("n").alias("most"))
    rows = counts.join(totals, [*by, "variant_id"])
    return rows.select(*by, "variant_id", "judgment", "n", (F.col("n") / F.col("total")).alias("share"), (F.col("most") / F.col("total") > 0.5).alias("degenerate"))


def ceiling_fraction(scores: DataFrame, high: float, by: Sequence[str] = ()) -> DataFrame:
    """(by, variant_id, ceiling): the share of judgments at the scale's upper end."""
    return scores.groupBy(*by, "variant_id").agg(F.avg((F.col("judgment") == high).cast("double")).alias("ceiling"))


def degenerate_scores(scores: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by, degenerate): whether more than half of a variant's scores are the same."""
    counts = scores.groupBy(*by, "variant_id", "judgment").agg(F.count("*").alias("n"))
    variants = counts.groupBy(*by, "variant_id").agg((F.max("n") / F.sum("n") > 0.5).alias("degenerate"))
    return variants.groupBy(*by).agg(F.bool_or("degenerate").alias("degenerate"))


def concordance_columns() -> dict[str, Column]:
    """single, n_pass_pass, n_pass_fail, n_fail_pass, n_fail_fail and n_discordant as aggregates of binary items, of those with both variants."""
    both, a, b = F.col("d").isNotNull(), recode.settled(F.col("x_a")), recode.settled(F.col("x_b"))
    single = F.bool_and(F.when(both, a.isin(0.0, 1.0) & b.isin(0.0, 1.0)))
    cells = {"n_pass_pass": (a == 1) & (b == 1), "n_pass_fail": (a == 1) & (b == 0), "n_fail_pass": (a == 0) & (b == 1), "n_fail_fail": (a == 0) & (b == 0), "n_discordant": a != b}
    return {"single": single} | {name: F.when(single, F.count_if(both & cell)) for name, cell in cells.items()}


def concordance(items: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by, n_pass_pass, n_pass_fail, n_fail_pass, n_fail_fail, n_discordant, single) of paired binary items.

    ``single`` tells whether every item has a plain 0 or 1 on both sides; the other columns are null where it is not.
    """
    return paired(items).groupBy(*by).agg(*[c.alias(name) for name, c in concordance_columns().items()])


def incomplete_pairs(judgments: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by, pair_id, only_order): pairs judged with one variant in front only."""
    pairs = judgments.groupBy(*by, "pair_id").agg(F.min("variant_first").alias("only_order"), F.max("variant_first").alias("other"))
    return pairs.where(F.col("only_order") == F.col("other")).drop("other")


def token_diagnostics(judgments: DataFrame) -> DataFrame:
    """(variant_id, n_calls, mean_tokens, min_tokens, max_tokens, abs_gap_mean) over every call, either side."""
    sides = F.explode(F.array(F.struct(F.col("variant_first").alias("variant_id"), F.col("tokens_first").alias("tokens")), F.struct(F.col("variant_second").alias("variant_id"), F.col("tokens_second").alias("tokens"))))
    rows = judgments.select(sides.alias("side"), F.abs(F.col("tokens_first") - F.col("tokens_second")).alias("gap"))
    return rows.groupBy("side.variant_id").agg(F.count("*").alias("n_calls"), F.avg("side.tokens").alias("mean_tokens"), F.min("side.tokens").alias("min_tokens"), F.max("side.tokens").alias("max_tokens"), F.avg("gap").alias("abs_gap_mean"))


def self_preference(judgments: DataFrame, self_judge: str, self_variant: str, other_variant: str) -> DataFrame:
    """(item_id, cluster, s_self, s_panel, n_panel, d) of every item; d is null unless the self judge and another have it.

    Each judge is reduced by itself; the panel's mean weighs its judges alike.
    """
    items = reduce_pairwise(judgments, self_variant, other_variant, ["judge_model"])
    own = F.col("judge_model") == self_judge
    rows = items.groupBy("item_id").agg(
        recode.one_of(F.min("cluster"), F.min("cluster"), F.max("cluster"), F.concat(F.lit("conflicting source documents for item "), F.first("item_id"))).alias("cluster"),
        F.max(F.when(own, F.col("s"))).alias("s_self"),
        F.avg(F.when(~own, F.col("s"))).alias("s_panel"),
        F.count_if(~own).alias("n_panel"),
    )
    return rows.withColumn("d", F.col("s_self") - F.col("s_panel"))


def discordant_counts(items: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by, n_items, n_pass_fail, n_fail_pass) of paired binary items; a side other than 0 or 1 is an error that names its item."""
    sides = paired(items).withColumns({c: recode.settled(F.col(c)) for c in ("x_a", "x_b")})
    plain = F.col("x_a").isin(0.0, 1.0) & F.col("x_b").isin(0.0, 1.0)
    named = F.concat(F.lit("neither pass nor fail: item "), F.coalesce(F.col("item_id").cast("string"), F.lit("null")))
    change = F.when(plain, F.col("x_a") - F.col("x_b")).otherwise(F.raise_error(named))
    return sides.withColumn("_change", change).groupBy(*by).agg(F.count("_change").alias("n_items"), F.count_if(F.col("_change") == 1).alias("n_pass_fail"), F.count_if(F.col("_change") == -1).alias("n_fail_pass"))
