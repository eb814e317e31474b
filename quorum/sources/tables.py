"""Tables of the driver's folder, and views of them in the shape of judgment data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def call_id() -> Column:
    """An id that is unique in lineitem."""
    return F.md5(F.concat_ws("|", *[F.col(c).cast("string") for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")]))


def judged_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))


def pairwise_judgments(spark: SparkSession, sf_dir: str, cluster: str = "p_brand", *more: Column) -> DataFrame:
    """One pairwise judgment for each line: variants A and B by line status, three judges by line number; ``more`` columns of the line."""
    first = F.col("l_linestatus") == "O"
    item = F.concat(F.lit("p"), F.col("l_partkey").cast("string"))
    document = F.when(F.col("l_partkey") % 10 != 0, F.col("p_brand")) if cluster == "p_brand" else F.col(cluster)
    return judged_lines(spark, sf_dir).select(
        item.alias("item_id"),
        document.alias("source_doc_id"),
        F.concat(item, F.lit("::"), F.col("l_returnflag")).alias("pair_id"),
        F.when(first, "A").otherwise("B").alias("variant_first"),
        F.when(first, "B").otherwise("A").alias("variant_second"),
        (F.col("l_orderkey") % 400).cast("long").alias("tokens_first"),
        (F.col("l_suppkey") * 4 % 400).cast("long").alias("tokens_second"),
        F.concat(F.lit("judge-"), (F.col("l_linenumber") % 3).cast("string")).alias("judge_model"),
        call_id().alias("judge_call_id"),
        F.when(F.col("l_quantity") <= 22, "first").when(F.col("l_quantity") <= 28, "tie").otherwise("second").alias("judgment"),
        *more,
    )


def dated_judgments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pairwise judgments with the time of the call and its month as the run."""
    return pairwise_judgments(spark, sf_dir, "p_brand", F.col("l_shipdate").alias("judged_at"), F.date_format("l_shipdate", "yyyy-MM").alias("run"))


def score_judgments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One score from 1 to 5 for each line: variants A, N and R by return flag, responses by order."""
    return judged_lines(spark, sf_dir).select(
        F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("item_id"),
        F.col("p_brand").alias("source_doc_id"),
        F.col("l_returnflag").alias("variant_id"),
        F.col("l_orderkey").cast("string").alias("response_id"),
        F.concat(F.lit("judge-"), (F.col("l_linenumber") % 3).cast("string")).alias("judge_model"),
        call_id().alias("judge_call_id"),
        (F.lit(1.0) + F.col("l_quantity").cast("long") % 5).alias("judgment"),
        F.col("l_discount").alias("discount"),
    )


def binary_judgments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One pass or fail for each item and variant, without source documents."""
    rows = score_judgments(spark, sf_dir).groupBy("item_id", "variant_id").agg(F.min_by("discount", "judge_call_id").alias("discount"), F.min_by("response_id", "judge_call_id").alias("response_id"), F.min("judge_call_id").alias("judge_call_id"))
    return rows.select("item_id", F.lit(None).cast("string").alias("source_doc_id"), "variant_id", "response_id", "judge_call_id", F.when(F.col("discount") > 0.05, 1.0).otherwise(0.0).alias("judgment"))


def arm_judgments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairwise judgments of an original against a padded (return flag A) or a condensed (R) rewrite."""
    rows = pairwise_judgments(spark, sf_dir).where(F.col("pair_id").endswith("::A") | F.col("pair_id").endswith("::R"))
    other = F.when(F.col("pair_id").endswith("::A"), "padded").otherwise("condensed")
    tokens = lambda c: F.when(c == "orig", 150).when(c == "padded", 300).otherwise(80).cast("long")
    rows = rows.withColumn("variant_first", F.when(F.col("variant_first") == "A", "orig").otherwise(other)).withColumn("variant_second", F.when(F.col("variant_second") == "A", "orig").otherwise(other))
    return rows.withColumn("tokens_first", tokens(F.col("variant_first"))).withColumn("tokens_second", tokens(F.col("variant_second")))


def request_plan_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Planned calls: the first of a judge, pair and order is the primary, the others are replicates."""
    first = F.min("judge_call_id").over(Window.partitionBy("judge_model", "pair_id", "variant_first"))
    return pairwise_judgments(spark, sf_dir).withColumn("call_role", F.when(F.col("judge_call_id") == first, "primary").otherwise("replicate"))


def realized_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls that came back, with strays that nobody planned."""
    planned = request_plan_rows(spark, sf_dir)
    strays = planned.where(F.col("judge_call_id").startswith("ff")).withColumn("judge_call_id", F.concat(F.lit("stray-"), F.col("judge_call_id")))
    return planned.where(~F.col("judge_call_id").startswith("0")).union(strays)


def judge_outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts of judges, with one verdict, several, or none."""
    line = (
        F.when(F.col("doc_id") % 5 == 0, "VERDICT: FIRST")
        .when(F.col("doc_id") % 5 == 1, "verdict : second")
        .when(F.col("doc_id") % 5 == 2, "VERDICT: TIE")
        .when(F.col("doc_id") % 5 == 3, "VERDICT: FIRST\nVERDICT: SECOND")
        .otherwise("no verdict")
    )
    scores = F.when(F.col("doc_id") % 4 == 0, "SCORE: 4\nSCORE: 4.0").when(F.col("doc_id") % 4 == 1, "SCORE: 3\nSCORE: 4").when(F.col("doc_id") % 4 == 2, "score: 2").otherwise("SCORE: 9")
    passes = F.when(F.col("doc_id") % 3 == 0, "Verdict: pass").when(F.col("doc_id") % 3 == 1, "VERDICT:FAIL").otherwise("VERDICT: PASS VERDICT: FAIL")
    return table(spark, sf_dir, "documents").select("doc_id", *[F.concat(F.col("text"), F.lit("\n"), c).alias(k) for k, c in (("pairwise_output", line), ("score_output", scores), ("binary_output", passes))])


#: The same views for DuckDB.
PAIRWISE_SQL = """
  SELECT concat('p', CAST(l_partkey AS VARCHAR)) AS item_id,
    CASE WHEN l_partkey % 10 = 0 THEN NULL ELSE p_brand END AS source_doc_id, p_type,
    concat('p', CAST(l_partkey AS VARCHAR), '::', l_returnflag) AS pair_id,
    CASE WHEN l_linestatus = 'O' THEN 'A' ELSE 'B' END AS variant_first,
    CASE WHEN l_linestatus = 'O' THEN 'B' ELSE 'A' END AS variant_second,
    CAST(l_orderkey % 400 AS BIGINT) AS tokens_first, CAST(l_suppkey * 4 % 400 AS BIGINT) AS tokens_second,
    concat('judge-', CAST(l_linenumber % 3 AS VARCHAR)) AS judge_model,
    md5(concat_ws('|', CAST(l_orderkey AS VARCHAR), CAST(l_linenumber AS VARCHAR), CAST(l_partkey AS VARCHAR), CAST(l_suppkey AS VARCHAR))) AS judge_call_id,
    CASE WHEN l_quantity <= 22 THEN 'first' WHEN l_quantity <= 28 THEN 'tie' ELSE 'second' END AS judgment
  FROM lineitem JOIN part ON l_partkey = p_partkey"""
DATED_SQL = PAIRWISE_SQL.replace("p_type,", "p_type, l_shipdate AS judged_at, strftime(l_shipdate, '%Y-%m') AS run,", 1)
SCORES_SQL = """
  SELECT concat('p', CAST(l_partkey AS VARCHAR)) AS item_id, p_brand AS source_doc_id, l_returnflag AS variant_id,
    CAST(l_orderkey AS VARCHAR) AS response_id, concat('judge-', CAST(l_linenumber % 3 AS VARCHAR)) AS judge_model,
    md5(concat_ws('|', CAST(l_orderkey AS VARCHAR), CAST(l_linenumber AS VARCHAR), CAST(l_partkey AS VARCHAR), CAST(l_suppkey AS VARCHAR))) AS judge_call_id,
    1e0 + CAST(l_quantity AS BIGINT) % 5 AS judgment, l_discount AS discount
  FROM lineitem JOIN part ON l_partkey = p_partkey"""
BINARY_SQL = f"""
  SELECT item_id, variant_id, CASE WHEN discount > 0.05e0 THEN 1e0 ELSE 0e0 END AS judgment
  FROM (SELECT *, row_number() OVER (PARTITION BY item_id, variant_id ORDER BY judge_call_id) AS k FROM ({SCORES_SQL})) WHERE k = 1"""
PLAN_SQL = f"""
  SELECT *, CASE WHEN row_number() OVER (PARTITION BY judge_model, pair_id, variant_first ORDER BY judge_call_id) = 1
    THEN 'primary' ELSE 'replicate' END AS call_role FROM ({PAIRWISE_SQL})"""
REALIZED_SQL = f"""
  SELECT * FROM ({PLAN_SQL}) WHERE NOT starts_with(judge_call_id, '0')
  UNION ALL SELECT * REPLACE ('stray-' || judge_call_id AS judge_call_id) FROM ({PLAN_SQL}) WHERE starts_with(judge_call_id, 'ff')"""
