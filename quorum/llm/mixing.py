"""Mixing sources to target weights by weighted fair queueing, with DataFrame functions only.

Sources are ordered by code point, null last, and weigh 5, 2, 1 and so on in turn. They share ``share`` times all
words; a target stops at ``repeats`` times its source's words and the excess goes to the others by weight. Within a
source, documents are shuffled by a hash of their id and size; the k-th copy of a document has as its virtual finish time the
source's words up to its end, over the weight. Copies are range-sorted by finish time over all sources and taken until
the budget is spent. Sources that run out stop by themselves, so each one's taken words meet its target to within
a document.

Running totals are two-level: sums of buckets of a source are summed up, then the documents within a bucket, so no
task holds a source. Documents that agree in source, id and size are one row with a number until their places are
known, so that no bucket fills up with them. Sources themselves (about 100 bytes each) meet in one task. Defined cases: a
null text has size 0; very long texts are counted whole; a null source is a source; a null or repeated doc_id is a
document like any other; ties go by source, copy, hash, id and size; an empty table gives no rows; further columns of
the input are left aside.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quorum.llm.common import cut, word_count

WEIGHTS = (5, 2, 1)
SHARE, REPEATS, SEED = 1.5, 2, 17
#: Documents of a bucket, at least (it grows with the square root of its source), and rows of a range, about.
BUCKET_ROWS, RANGE_ROWS = 250, 20_000
#: Alike documents that a task writes out at a time.
ALIKE_ROWS = 10_000
#: Up to this many sources are sent to every executor (about 100 bytes each); more are joined by a shuffle.
BROADCAST_SOURCES = 50_000
#: The order of the queue: virtual finish time, then ties.
QUEUE = ("finish", "source_no", "copy", "shuffled", "doc_id", "size")


def source_targets(sized: DataFrame, weights=WEIGHTS, share: float = SHARE, repeats: int = REPEATS) -> DataFrame:
    """(source, source_no, n, source_size, weight, target): one row for each source."""
    sources = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
    order = Window.orderBy(F.col("source").isNull(), F.col("source"))
    sources = sources.withColumn("source_no", F.row_number().over(order))
    place = (F.col("source_no") - 1) % len(weights) + 1
    sources = sources.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), place)).withColumn("most", F.col("source_size") * float(repeats))
    # water-filling: by how soon sources fill up, each tells the level that the rest reach if all before it are full
    every = Window.partitionBy()
    before = Window.orderBy(F.col("most") / F.col("weight"), "source_no").rowsBetween(Window.unboundedPreceding, -1)
    left = F.sum("source_size").over(every) * share - F.coalesce(F.sum("most").over(before), F.lit(0.0))
    level = left / (F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    sources = sources.withColumn("level", level)
    level = F.max(F.when(F.col("most") / F.col("weight") >= F.col("level"), F.col("level"))).over(every)
    target = F.coalesce(F.least(F.col("most"), level * F.col("weight")), F.col("most"))
    return sources.select("source", "source_no", "n", "source_size", "weight", target.alias("target"))


def _paced(sized: DataFrame, seed: int) -> DataFrame:
    """Adds ``done``: the source's words up to the end of this document, in shuffled order."""
    sources = cut(source_targets(sized))
    known = sources.withColumn("buckets", F.ceil(F.col("n") / F.greatest(F.lit(float(BUCKET_ROWS)), F.sqrt("n"))).cast("int")).drop("n")
    if sources.count() <= BROADCAST_SOURCES:
        known = F.broadcast(known)
    alike = sized.groupBy("source", "doc_id", "size").agg(F.count("*").alias("alike"))
    rows = alike.join(known.withColumnRenamed("source", "known"), F.col("source").eqNullSafe(F.col("known"))).drop("known")
    digits = F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("doc_id").cast("string"), F.col("size").cast("string"))), 1, 15)  # 60 bits
    rows = rows.withColumn("shuffled", F.conv(digits, 16, 10).cast("long"))
    rows = rows.withColumn("bucket", F.shiftright(F.shiftright("shuffled", 30) * F.col("buckets"), 30))  # ascends with it
    words = F.col("size") * F.col("alike")
    sums = rows.groupBy("source_no", "bucket").agg(F.sum(words).alias("words"))
    before = Window.partitionBy("source_no").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("source_no", "bucket", F.coalesce(F.sum("words").over(before), F.lit(0)).alias("before"))
    within = Window.partitionBy("source_no", "bucket").orderBy("shuffled", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("start", F.sum(words).over(within) - words).join(sums, ["source_no", "bucket"])
    rows = rows.withColumn("start", F.col("start") + F.col("before")).drop("before", "bucket", "buckets")
    few = rows.where(F.col("alike") <= ALIKE_ROWS).withColumn("nth", F.explode(F.sequence(F.lit(1).cast("long"), F.col("alike"))))
    runs = rows.where(F.col("alike") > ALIKE_ROWS).withColumn("run", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(alike - 1) div {ALIKE_ROWS}")))).repartition("source", "doc_id", "size", "run")
    many = runs.withColumn("nth", F.explode(F.sequence(F.col("run") * ALIKE_ROWS + 1, F.least(F.col("alike"), (F.col("run") + 1) * ALIKE_ROWS)))).drop("run")
    return few.unionByName(many).withColumn("done", F.col("start") + F.col("nth") * F.col("size")).drop("alike", "nth", "start")


def _key(copy: Column) -> Column:
    """The place of a copy in the queue, by QUEUE."""
    finish = (copy * F.col("source_size") + F.col("done")) / F.col("weight")
    return F.struct(finish.alias("finish"), F.col("source_no"), copy.alias("copy"), F.col("shuffled"), F.col("doc_id"), F.col("size"))


def mix(docs: DataFrame, share: float = SHARE, repeats: int = REPEATS, seed: int = SEED) -> DataFrame:
    """(doc_id, size, source_size, target, taken, copies, finish: virtual finish time of the first copy) of each document."""
    sized = cut(docs.select("doc_id", "source", word_count(F.col("text")).alias("size")))
    paced = cut(_paced(sized, seed))
    total = paced.agg(F.count("*").alias("n"), F.coalesce(F.sum("size"), F.lit(0)).alias("words")).first()
    budget = int(total["words"] * share)
    ranges = max(1, -(-total["n"] * repeats // RANGE_ROWS))

    copies = paced.withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(repeats - 1).cast("long"))))
    queue = copies.select(_key(F.col("copy")).alias("key"))
    queue = queue.select("key.*").repartitionByRange(ranges, *QUEUE)
    queue = cut(queue.withColumn("range", F.spark_partition_id()))
    spent, cut_range = 0, None
    for row in queue.groupBy("range").agg(F.sum("size").alias("words")).orderBy("range").collect():  # a row for each range
        if spent + row["words"] > budget:
            cut_range = row["range"]
            break
        spent += row["words"]
    taken = [F.lit(1)] * repeats
    if cut_range is not None:
        inside = queue.where(F.col("range") == cut_range)
        running = F.sum("size").over(Window.partitionBy("range").orderBy(*QUEUE).rowsBetween(Window.unboundedPreceding, 0))
        inside = inside.withColumn("words", running).where(F.col("words") + spent <= budget)
        last = queue.where(F.col("range") < cut_range).select(*QUEUE).union(inside.select(*QUEUE)).agg(F.max(F.struct(*QUEUE)).alias("key")).first()["key"]
        edge = F.struct(*[F.lit(None if last is None else last[k]).cast(queue.schema[k].dataType).alias(k) for k in QUEUE])
        taken = [F.when((_key(F.lit(k).cast("long")) <= edge) & F.lit(last is not None), 1).otherwise(0) for k in range(repeats)]
    n = sum(taken[1:], taken[0])
    return paced.select(
        "doc_id",
        "size",
        "source_size",
        "target",
        (n * F.col("size")).cast("long").alias("taken"),
        n.cast("int").alias("copies"),
        (F.col("done") / F.col("weight")).alias("finish"),
    )
