"""URL filtering by hashed host-suffix and path-prefix expressions, with DataFrame functions only.

Each url is expanded into the expressions that a rule could be: every suffix of its host at a label, joined with every
prefix of its path that is as long as some rule's path. Expressions meet rules in an equi-join on a short prefix of
their SHA-256 digest; then the full digest is confirmed and the longest rule wins (of equally long ones that with the
longer host; where one rule has both verdicts, block). Where the rules are too many to broadcast, each different
expression meets them once, with the number of its rows; what fits is then looked up by digest, frequent expressions (a
top-level domain that a third of all pages share) by broadcast, so that no task takes all rows of one.

A url of l labels and p fitting path lengths makes l * p digests, l no more than the labels of the longest rule.

Defined cases: a url that is null or has no ``://`` has an empty host and path and no rule; a url without a rule gets
the default verdict; repeated rows are judged alike and all returned; further columns of the input are left aside;
no rules or no pages give default verdicts or no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quorum.llm.common import ascii_lower, lookup

SHORT_DIGITS = 8
#: Rules up to this many are sent to every executor (about 200 bytes each); more are joined by a shuffle.
BROADCAST_RULES = 50_000
DEFAULT_VERDICT = "allow"


def url_host(url: Column) -> Column:
    return ascii_lower(F.coalesce(F.regexp_extract(url, "://([^/?#]*)", 1), F.lit("")))


def url_path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, "://[^/?#]*([^?#]*)", 1), F.lit(""))


def _short(digest: Column) -> Column:
    return F.substring(digest, 1, SHORT_DIGITS)


def _fitting(rows: DataFrame, known: DataFrame) -> DataFrame:
    """The rows, each once without a rule, and once more for each of its expressions that is a rule, with that as ``known``."""
    shown = [c for c in rows.columns if c != "digests"]
    expressions = rows.select(*shown, F.explode("digests").alias("digest"))
    different = expressions.groupBy("digest").agg(F.count("*").alias("n")).withColumn("short", _short(F.col("digest")))
    confirmed = different.join(known, "short").where(F.col("known.digest") == F.col("digest"))
    found = lookup(expressions, confirmed.groupBy("digest").agg(F.max("known").alias("known"), F.max("n").alias("n")), "digest")
    none = F.lit(None).cast(known.schema["known"].dataType)
    return rows.select(*shown, none.alias("known")).unionByName(found.select(*shown, "known"))


def judge_urls(pages: DataFrame, rules: DataFrame, default: str = DEFAULT_VERDICT) -> DataFrame:
    """(page_id, host, path, rule, verdict) of each page; rules: (host, path, verdict allow or block)."""
    known = rules.groupBy(F.col("host"), F.col("path")).agg(F.max("verdict").alias("verdict"))
    shape = known.agg(F.collect_set(F.length("path")).alias("lengths"), F.max(F.size(F.split("host", r"\."))).alias("labels"), F.count("*").alias("n")).first()
    digest = F.sha2(F.concat("host", "path"), 256)
    known = known.select(
        _short(digest).alias("short"),
        F.struct(F.length(F.concat("host", "path")).alias("n"), F.length("host").alias("host_n"), F.concat("host", "path").alias("rule"), F.col("verdict"), digest.alias("digest")).alias("known"),
    )

    rows = pages.groupBy("page_id", "url").agg(F.count("*").alias("copies"))
    rows = rows.select("*", url_host(F.col("url")).alias("host"), url_path(F.col("url")).alias("path"))
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.least(F.size(labels), F.lit(shape["labels"] or 1))), lambda k: F.array_join(F.slice(labels, F.size(labels) - k + 1, k), "."))
    lengths = F.array(*[F.lit(n) for n in sorted(shape["lengths"])]).cast("array<int>")
    prefixes = F.transform(F.filter(lengths, lambda n: n <= F.length("path")), lambda n: F.substr(F.col("path"), F.lit(1), n))
    digests = F.flatten(F.transform(suffixes, lambda s: F.transform(prefixes, lambda p: F.sha2(F.concat(s, p), 256))))
    rows = rows.select("page_id", "url", "host", "path", "copies", F.when(F.col("host") != "", digests).alias("digests"))
    if shape["n"] <= BROADCAST_RULES:
        rows = rows.withColumn("digest", F.explode_outer("digests"))
        met = rows.withColumn("short", _short(F.col("digest"))).join(F.broadcast(known), "short", "left")
        met = met.withColumn("known", F.when(F.col("known.digest") == F.col("digest"), F.col("known")))
    else:
        met = _fitting(rows, known)
    judged = met.groupBy("page_id", "url", "host", "path", "copies").agg(F.max("known").alias("best"))
    judged = judged.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    return judged.select("page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))
