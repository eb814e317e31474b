"""Request plans, what came back of them, and what is still to do."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quorum.functions.ids import derived_id, hash_number

ORDER_KEY = ("judge_model", "pair_id", "variant_first")


def counterbalanced(pairs: DataFrame) -> DataFrame:
    """Both presentation orders of each pair (item_id, a, b: structs of variant_id, response_id, text) under one pair_id."""
    a, b = F.col("a.response_id"), F.col("b.response_id")
    pair = F.when(a != b, F.concat_ws("::", "item_id", F.least(a, b), F.greatest(a, b))).otherwise(F.raise_error(F.lit("the two responses of a pair must differ")))
    rows = pairs.withColumn("pair_id", pair).withColumn("shown", F.explode(F.array(F.struct(F.col("a").alias("first"), F.col("b").alias("second")), F.struct(F.col("b").alias("first"), F.col("a").alias("second")))))
    return rows.select(*[c for c in pairs.columns if c not in ("a", "b")], "pair_id", "shown.first", "shown.second")


def replicate_size(n_items: Column, least: int = 10, most: int = 30, fraction: float = 0.2, per_item: int = 2) -> Column:
    """Items to replicate so that a share of all responses, within bounds, is judged again; halves round to even."""
    responses = n_items * per_item
    wanted = F.greatest(F.lit(least), F.least(F.lit(most), F.bround(responses * F.lit(float(fraction)), 0).cast("long")))
    return F.when(n_items <= 0, 0).otherwise(F.ceil(F.least(wanted, responses) / F.lit(per_item))).cast("long")


def replicate_items(items: DataFrame, seed: int, **bounds) -> DataFrame:
    """(item_id) of the drawn items: those with the least hashes, as many as ``replicate_size`` says."""
    rows = items.select(F.col("item_id").cast("string").alias("item_id")).distinct()
    size = rows.agg(replicate_size(F.count("*"), **bounds).alias("k")).first()["k"]
    return rows.orderBy(hash_number(seed, "replicate", F.col("item_id")), "item_id").limit(size)  # size is bounded by ``most``


def request_plan(tasks: DataFrame, replicated: DataFrame, judges: DataFrame, seed: int) -> DataFrame:
    """A row for each call: every task with every judge, and once more as a replicate for drawn items.

    judges (judge_model) is a short list. A replicate has a seed of its own, so that no cached answer stands in for it.
    """
    rows = tasks.join(replicated.select("item_id", F.lit(True).alias("drawn")).distinct(), "item_id", "left")
    roles = F.when(F.col("drawn"), F.array(F.lit("primary"), F.lit("replicate"))).otherwise(F.array(F.lit("primary")))
    names = [r["judge_model"] for r in judges.select("judge_model").distinct().orderBy("judge_model").collect()]
    rows = rows.withColumn("judge_model", F.explode(F.array(*[F.lit(n) for n in names]))).withColumn("call_role", F.explode(roles)).drop("drawn")
    rows = rows.withColumn("judge_model", pinned(F.col("judge_model")))
    parts = [(F.col("pair_id"), True), (F.col("variant_first"), True), (F.col("judge_model"), True), (F.col("call_role"), True)]
    rows = rows.withColumn("judge_call_id", derived_id(*parts))
    return rows.withColumn("judge_seed", hash_number(seed, "judge", F.col("judge_call_id")))


def _met(planned: DataFrame, realized: DataFrame, key: tuple[str, ...]) -> DataFrame:
    """(judge_call_id, role, planned, back, at: key and side) of each planned or realized call, once: plan and answers meet by id in one shuffle.

    The side is primary, replicate or realized; role is the plan's for the id, planned and back tell whether the plan and
    the answers have it.
    """
    side = lambda df, c: df.select("judge_call_id", F.struct(*key, c.alias("side")).alias("at"))
    plan = side(planned, F.when(F.col("call_role") == "primary", "primary").otherwise("replicate"))
    rows = plan.union(side(realized, F.lit("realized")))
    own = F.col("at.side")
    by_id = rows.groupBy("judge_call_id").agg(F.collect_set("at").alias("all"), F.min(F.when(own != "realized", own)).alias("role"), F.bool_or(own == "realized").alias("back"))
    return by_id.select("judge_call_id", "role", F.col("role").isNotNull().alias("planned"), "back", F.explode("all").alias("at"))


def gate(planned: DataFrame, realized: DataFrame, key: tuple[str, ...] = ORDER_KEY) -> DataFrame:
    """(key, status) of every key of a plan or of what came back: plumbing, normal, promotion or exclusion.

    Plumbing: a call came back that was not planned, or one came back where no primary was planned. Normal: the primary came
    back. Promotion: only a replicate did. Exclusion: nothing did.
    """
    side = F.col("at.side")
    came = side == "realized"
    rows = _met(planned, realized, key).groupBy(*[F.col(f"at.{k}").alias(k) for k in key]).agg(
        F.bool_or(came & ~F.col("planned")).alias("unplanned"),
        F.bool_or(came).alias("any_back"),
        F.bool_or(side == "primary").alias("has_primary"),
        F.bool_or((side == "primary") & F.col("back")).alias("primary_hit"),
        F.bool_or((side == "replicate") & F.col("back")).alias("replicate_hit"),
    )
    plumbing = F.col("unplanned") | (F.col("any_back") & ~F.col("has_primary"))
    return rows.select(*key, F.when(plumbing, "plumbing").when(F.col("primary_hit"), "normal").when(F.col("replicate_hit"), "promotion").otherwise("exclusion").alias("status"))


def gate_summary(gated: DataFrame) -> DataFrame:
    """(n_normal, n_promotions, n_exclusions, n_plumbing, blocks_run)."""
    count = lambda s: F.count_if(F.col("status") == s)
    return gated.agg(count("normal").alias("n_normal"), count("promotion").alias("n_promotions"), count("exclusion").alias("n_exclusions"), count("plumbing").alias("n_plumbing"), (count("plumbing") > 0).alias("blocks_run"))


def primary_calls(planned: DataFrame, realized: DataFrame, key: tuple[str, ...] = ORDER_KEY) -> DataFrame:
    """One realized call for each key with a planned primary: the primary, else its first realized replicate by id."""
    came = (F.col("at.side") == "realized") & F.col("planned")
    chosen = F.min(F.when(came, F.struct((F.col("role") != "primary").alias("later"), F.col("judge_call_id")))).alias("chosen")
    picked = _met(planned, realized, key).groupBy(*[F.col(f"at.{k}").alias(k) for k in key]).agg(chosen, F.bool_or(F.col("at.side") == "primary").alias("has_primary"))
    return picked.where(F.col("has_primary") & F.col("chosen").isNotNull()).select(*key, "chosen.judge_call_id", F.col("chosen.later").alias("promoted"))


def pending(tasks: DataFrame, store: DataFrame, key: str) -> DataFrame:
    """Tasks whose key the store doesn't have."""
    return tasks.join(store.select(key).distinct(), key, "left_anti")


def full_set(tasks: DataFrame, store: DataFrame, key: str, position: str) -> DataFrame:
    """The store's record of each task, by the tasks' ``position``: what a resumed run returns, old records and new ones alike."""
    have = store.dropDuplicates([key])
    return tasks.select(key, position).join(have.select(key, *[c for c in have.columns if c not in (key, position)]), key).orderBy(position)


def pinned(model: Column) -> Column:
    """The model's name; one that ends in -latest is an error, as what it names may change."""
    return F.when(model.endswith("-latest"), F.raise_error(F.concat(F.lit("a judge must be pinned: "), model))).otherwise(model)


def dry_run(tasks: DataFrame, store: DataFrame, cache: DataFrame, key: str, cache_key: str, model: str | None = None) -> DataFrame:
    """(kind, total, already_recorded, cache_hits, model_calls): what a run would do, by ``kind`` of task.

    With the name of the column that has the model, a task for a model that isn't pinned is an error.
    """
    if model is not None:
        tasks = tasks.withColumn("kind", F.when(pinned(F.col(model)).isNotNull(), F.col("kind")))
    recorded = store.select(key).distinct().withColumn("recorded", F.lit(True))
    cached = cache.select(cache_key).distinct().withColumn("cached", F.lit(True))
    rows = tasks.join(recorded, key, "left").join(cached, cache_key, "left")
    r, c = F.col("recorded").isNotNull(), F.col("cached").isNotNull()
    return rows.groupBy("kind").agg(F.count("*").alias("total"), F.count_if(r).alias("already_recorded"), F.count_if(~r & c).alias("cache_hits"), F.count_if(~r & ~c).alias("model_calls"))


def _drop_reason(excluded: str, least: int, most: int) -> Column:
    length = F.length("text")
    reason = F.when(F.col("text").rlike(excluded), "excluded").when(length < least, "too short").when(length > most, "too long").otherwise("kept")
    return F.when(F.col("text").isNull(), "too short").otherwise(reason)


def prompt_drops(prompts: DataFrame, excluded: str, least: int, most: int) -> DataFrame:
    """(reason, n): why prompts are left out (the first reason counts) or kept."""
    return prompts.groupBy(_drop_reason(excluded, least, most).alias("reason")).agg(F.count("*").alias("n"))


def prompt_set(prompts: DataFrame, excluded: str, least: int, most: int) -> DataFrame:
    """The prompts that are kept, with text_sha256."""
    return prompts.where(_drop_reason(excluded, least, most) == "kept").withColumn("text_sha256", F.sha2("text", 256))


def write_prompt_set(prompts: DataFrame, path: str) -> str:
    """Writes the set as JSON lines; returns the SHA-256 of its prompts' sorted digests, which names the set.

    A set is a study's drawn prompts, hundreds of rows, whose digests are sorted in one row.
    """
    prompts.write.mode("overwrite").json(path)
    return prompts.agg(F.sha2(F.array_join(F.array_sort(F.collect_list("text_sha256")), ""), 256).alias("digest")).first()["digest"]


def arm_distinctness(responses: DataFrame, a: str, b: str, most: float = 0.05) -> DataFrame:
    """(n_prompts, n_equal, share, passes): prompts whose responses from two arms have the same text."""
    both = responses.where(F.col("variant_id").isin(a, b)).groupBy("prompt_id").agg(F.max(F.when(F.col("variant_id") == a, F.col("text"))).alias("a"), F.max(F.when(F.col("variant_id") == b, F.col("text"))).alias("b"))
    both = both.where(F.col("a").isNotNull() & F.col("b").isNotNull())
    out = both.agg(F.count("*").alias("n_prompts"), F.count_if(F.col("a") == F.col("b")).alias("n_equal"))
    return out.withColumn("share", F.try_divide(F.col("n_equal").cast("double"), F.col("n_prompts"))).withColumn("passes", F.coalesce(F.col("share") <= most, F.lit(True)))


def latest(rows: DataFrame, key: list[str], sequence: str) -> DataFrame:
    """The last row of each key by its sequence number."""
    return rows.withColumn("_last", F.row_number().over(Window.partitionBy(*key).orderBy(F.desc(sequence)))).where("_last = 1").drop("_last")
