"""The request gate and cluster estimates over streams: planned calls and answers that arrive out of order.

Two steps, each a streaming query with a checkpoint of its own, with a table between them. First, planned calls and answers
meet by id in a stream-stream full outer join: watermarks bound how long either side waits, and what has met nothing by then
comes out alone. ``resolved_calls`` is the same expression for streams and for tables. Second, stateful operators read the
resolved calls. ``key_statuses`` keeps five flags for each key, ``cluster_sums`` the calls' sums for each pair and order of a
contrast's cluster; both give their result, and drop their state, once the watermark has passed the last of a key's
calls by the given wait, so state is bounded by what is under way. Time moves on with rows: a source that falls silent should
send a call of its own now and then, planned and answered, so that what came before it ends. A call that met nothing comes
out of the first step a batch after its time is up; so the second step's lateness must cover the wait for answers, the first
step's lateness, and the longest silence. The state store must be RocksDB's
(``STATE_STORE``), as map states and timers need it. A file sink notes the batches that it has written, so a query
that starts again from its checkpoint repeats nothing.

A cluster may hold a third of all calls: its state is dealt into PARTS by a hash of the item, and each part gives a partial
sum; ``cluster_estimates`` adds them up.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues
from pyspark.sql.types import BooleanType, DoubleType, LongType, StringType, StructField, StructType

from quorum.functions import recode
from quorum.operators import inference
from quorum.plans.requests import ORDER_KEY

#: The setting, and its value, that sessions need for these streams.
STATE_STORE = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
FLAGS = ("unplanned", "any_back", "has_primary", "primary_hit", "replicate_hit")
#: Partial sums of a cluster.
PARTS = 16
_DUE = StructType([StructField("due", LongType())])
_FLAGS = StructType([StructField(c, BooleanType()) for c in FLAGS])
_AT = StructType([StructField(c, StringType()) for c in ("item_id", "pair_id", "front")])
_SUM = StructType([StructField("total", DoubleType()), StructField("n", LongType())])
_CLUSTER = StructType([StructField("total", DoubleType()), StructField("size", LongType()), StructField("low", DoubleType()), StructField("high", DoubleType())])


def resolved_calls(planned: DataFrame, answers: DataFrame, wait: str, key: Sequence[str] = ORDER_KEY, planned_at: str = "planned_at", answered_at: str = "answered_at", late: str | None = None) -> DataFrame:
    """(judge_call_id, call_role, plan_key, answer_key, answer, at): planned calls and answers by id, either side null without the other.

    An answer belongs to a call that was planned up to ``wait`` before it. With ``late``, how far a stream may be out of
    order, both sides are watermarked and rows that repeat an id and key within it count once; in tables they do without it. Calls or
    answers without an id meet nothing; an id of several keys meets each.
    """
    plan = planned.select(F.col("judge_call_id").alias("_planned_id"), "call_role", F.struct(*key).alias("plan_key"), F.col(planned_at).alias("_planned_at"))
    answered = answers.select(F.col("judge_call_id").alias("_answered_id"), F.struct(*key).alias("answer_key"), F.struct(*[c for c in answers.columns if c != answered_at]).alias("answer"), F.col(answered_at).alias("_answered_at"))
    if late is None:
        plan, answered = plan.dropDuplicates(["_planned_id", "plan_key"]), answered.dropDuplicates(["_answered_id", "answer_key"])
    else:
        plan = plan.withWatermark("_planned_at", late).dropDuplicatesWithinWatermark(["_planned_id", "plan_key"])
        answered = answered.withWatermark("_answered_at", late).dropDuplicatesWithinWatermark(["_answered_id", "answer_key"])
    met = (F.col("_planned_id") == F.col("_answered_id")) & (F.col("_answered_at") >= F.col("_planned_at")) & (F.col("_answered_at") <= F.col("_planned_at") + F.expr(f"INTERVAL {wait}"))
    rows = plan.join(answered, met, "full_outer")
    return rows.select(F.coalesce("_planned_id", "_answered_id").alias("judge_call_id"), "call_role", "plan_key", "answer_key", "answer", F.coalesce("_answered_at", "_planned_at").alias("at"))


def _flags(calls: DataFrame) -> DataFrame:
    """(key, FLAGS, at): what a resolved call says about the key it was planned for and the key it was answered for."""
    primary, back, planned = F.col("call_role") == "primary", F.col("answer_key").isNotNull(), F.col("plan_key").isNotNull()
    said = lambda k, *flags: F.struct(F.col(k).alias("key"), *[F.coalesce(c, F.lit(False)).alias(name) for name, c in zip(FLAGS, flags)])
    no = F.lit(False)
    both = F.array(F.when(planned, said("plan_key", no, no, primary, primary & back, ~primary & back)), F.when(back, said("answer_key", ~planned, F.lit(True), no, no, no)))
    return calls.select(F.explode(F.array_compact(both)).alias("said"), "at").select("said.*", "at")


def _status() -> Column:
    plumbing = F.col("unplanned") | (F.col("any_back") & ~F.col("has_primary"))
    return F.when(plumbing, "plumbing").when(F.col("primary_hit"), "normal").when(F.col("replicate_hit"), "promotion").otherwise("exclusion")


def table_statuses(calls: DataFrame, key: Sequence[str] = ORDER_KEY) -> DataFrame:
    """(key, status) of each key of a table of resolved calls."""
    rows = _flags(calls).groupBy("key").agg(*[F.bool_or(c).alias(c) for c in FLAGS])
    return rows.select(*[F.col(f"key.{k}").alias(k) for k in key], _status().alias("status"))


class _Waiting(StatefulProcessor):
    """Keeps something for each key until the watermark has passed its last row by ``wait`` seconds, then gives it and forgets."""

    def __init__(self, wait: int, names: Sequence[str]):
        self.wait, self.named = wait * 1_000, Row(*names)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.due = handle.getValueState("due", _DUE)
        self.open_(handle)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues: TimerValues) -> Iterator[Row]:
        last = self.add(rows)
        due = max(int(last.timestamp() * 1_000) + self.wait, timerValues.getCurrentWatermarkInMs() + 1)
        before = self.due.get()[0] if self.due.exists() else None
        if before is None or due > before:
            if before is not None:
                self.handle.deleteTimer(before)
            self.handle.registerTimer(due)
            self.due.update((due,))
        return iter(())

    def handleExpiredTimer(self, key, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[Row]:
        out = self.result(key)
        self.due.clear()
        return iter([out])

    def close(self) -> None:
        pass


class _Flags(_Waiting):
    def open_(self, handle: StatefulProcessorHandle) -> None:
        self.flags = handle.getValueState("flags", _FLAGS)

    def add(self, rows: Iterator[Row]):
        flags = list(self.flags.get()) if self.flags.exists() else [False] * len(FLAGS)
        last = None
        for r in rows:
            flags = [a or r[c] for a, c in zip(flags, FLAGS)]
            last = r["at"] if last is None else max(last, r["at"])
        self.flags.update(tuple(flags))
        return last

    def result(self, key) -> Row:
        flags = self.flags.get()
        self.flags.clear()
        return self.named(*key, *map(bool, flags))


class _Sums(_Waiting):
    """Sums and counts of the calls of each item, pair and order; the total of the items' d and their number come out."""

    def open_(self, handle: StatefulProcessorHandle) -> None:
        self.sums = handle.getMapState("sums", _AT, _SUM)

    def add(self, rows: Iterator[Row]):
        new, last = {}, None
        for r in rows:
            at = r["item_id"], r["pair_id"], r["variant_first"]
            total, n = new.get(at, (0.0, 0))
            new[at] = total + r["y"], n + 1
            last = r["at"] if last is None else max(last, r["at"])
        for at, (total, n) in new.items():
            old = self.sums.getValue(at) if self.sums.containsKey(at) else (0.0, 0)
            self.sums.updateValue(at, (old[0] + total, old[1] + n))
        return last

    def result(self, key) -> Row:
        pairs: dict = {}
        for (item, pair, _), (total, n) in self.sums.iterator():
            pairs.setdefault(item, {}).setdefault(pair, []).append(total / n)
        mean = lambda xs: sum(xs) / len(xs)
        d = [2 * mean([mean(orders) for orders in of.values()]) - 1 for of in pairs.values()]
        self.sums.clear()
        return self.named(*key, sum(d), len(d), min(d), max(d))


def _keyed(rows: DataFrame, by: Sequence[str], processor: type[_Waiting], wait_seconds: int, added: StructType) -> DataFrame:
    schema = StructType([rows.schema[c] for c in by] + added.fields)
    return rows.groupBy(*by).transformWithState(processor(wait_seconds, schema.names), schema, "append", "eventTime")


def key_statuses(calls: DataFrame, wait_seconds: int, late: str, key: Sequence[str] = ORDER_KEY) -> DataFrame:
    """(key, status) of each key of a stream of resolved calls, once ``wait_seconds`` have passed since its last call.

    A key that is planned or answered again after that comes out again, by its later calls only.
    """
    rows = _flags(calls.withWatermark("at", late)).select(*[F.col(f"key.{k}").alias(k) for k in key], *FLAGS, "at")
    out = _keyed(rows, list(key), _Flags, wait_seconds, _FLAGS)
    return out.select(*key, _status().alias("status"))


def cluster_sums(calls: DataFrame, variant: str, other: str, wait_seconds: int, late: str, by: Sequence[str] = ()) -> DataFrame:
    """(by, cluster, part, total, size, low, high): sums over items of the order-balanced difference of two variants.

    Answers count that were planned, under the key they were planned for. The wait must be longer than any pause within a run:
    a part that is quiet for longer comes out, and an item with calls on both sides of the pause counts on each.
    """
    rows = calls.where(F.col("plan_key").isNotNull() & F.col("plan_key").eqNullSafe(F.col("answer_key"))).withWatermark("at", late).select("answer.*", "at").where(recode.pair_of(variant, other))
    rows = rows.select(*by, recode.cluster_key().alias("cluster"), F.pmod(F.xxhash64("item_id"), F.lit(PARTS)).alias("part"), F.col("item_id").cast("string").alias("item_id"), "pair_id", "variant_first", recode.prefers(variant).alias("y"), "at")
    return _keyed(rows, [*by, "cluster", "part"], _Sums, wait_seconds, _CLUSTER)


def cluster_estimates(parts: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """The estimate and its standard error from a table of ``cluster_sums``."""
    every = list(by) or ["_every"]
    rows = parts if by else parts.withColumn("_every", F.lit(0))
    totals = rows.groupBy(*every, "cluster").agg(F.sum("total").alias("total"), F.sum("size").alias("size"), F.min("low").alias("low"), F.max("high").alias("high"))
    return inference.cluster_robust(totals, every).drop("_every")


def append_to(stream: DataFrame, path: str, checkpoint: str, form: str = "parquet") -> StreamingQuery:
    """Takes all that is there and writes each batch once; started again with the same checkpoint it goes on with what is new."""
    return stream.writeStream.format(form).option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
