"""Dashboards, rankings, quotas and table maintenance of the usage data."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.sources.scratch import stored


def calendar(facts: DataFrame, day: str) -> DataFrame:
    """Every day of the years between the first and the last fact: a few thousand rows, whatever the number of facts."""
    span = facts.agg(F.year(F.min(day)).alias("a"), F.year(F.max(day)).alias("b"))
    days = F.sequence(F.make_date("a", F.lit(1), F.lit(1)), F.make_date("b", F.lit(12), F.lit(31)))
    return span.where("a is not null").select(F.explode(days).alias("day"))


def daily_counts(facts: DataFrame, when: str) -> DataFrame:
    """(day, n) of every day of the calendar, 0 where nothing happened."""
    counts = facts.groupBy(F.to_date(when).alias("day")).agg(F.count("*").alias("n"))
    return calendar(facts, when).join(counts, "day", "left").select("day", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def ranked(facts: DataFrame, key: str, k: int) -> DataFrame:
    """The k most frequent keys, ties by key. The limit is the feature."""
    return facts.groupBy(key).agg(F.count("*").alias("n")).orderBy(F.desc("n"), key).limit(k)


def shares(facts: DataFrame, key: str) -> DataFrame:
    """(key, n, percent): counts with their share of all, from a sum over the counts."""
    counts = facts.groupBy(key).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("total"))
    return counts.crossJoin(F.broadcast(total)).select(key, "n", F.format_string("%.1f", 100 * F.col("n") / F.col("total")).alias("percent"))  # one row


def page(rows: DataFrame, order: list, number: int, size: int = 5) -> DataFrame:
    """Page `number` (from 1) of the rows in an order. The limit is the feature."""
    return rows.orderBy(*order).offset((number - 1) * size).limit(size)


def next_ids(existing: DataFrame, new: DataFrame, key: str, order: str) -> DataFrame:
    """new with consecutive ids after the largest existing one: counts of ranges of the order, not one window over all rows."""
    start = existing.agg(F.coalesce(F.max(key), F.lit(-1)).alias("start"))
    sorted_rows = new.repartitionByRange(order).sortWithinPartitions(order).withColumn("_p", F.spark_partition_id()).withColumn("_i", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)))
    sorted_rows = stored(sorted_rows, "ranged")  # both uses see the same ranges
    sizes = sorted_rows.groupBy("_p").agg(F.count("*").alias("c"))
    before = sizes.select("_p", (F.sum("c").over(Window.orderBy("_p")) - F.col("c")).alias("before"))  # a row for each partition
    return sorted_rows.join(before, "_p").crossJoin(F.broadcast(start)).withColumn("id", F.col("start") + 1 + F.col("before") + F.col("_i")).drop("_p", "_i", "before", "start")


def cascade(parents: DataFrame, children: DataFrame, key: str, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Parents and children less those whose key is gone."""
    return parents.join(gone, key, "left_anti"), children.join(gone, key, "left_anti")


def text_search(docs: DataFrame, words: list[str], k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """(doc_id, score): BM25 of the words in lower-cased texts split at what is not a letter or digit; one pass and one aggregate for the statistics."""
    tokens = F.split(F.lower(F.coalesce("text", F.lit(""))), "[^\\p{L}\\p{N}]+")
    counted = docs.select("doc_id", F.filter(tokens, lambda t: t != "").alias("t"))
    times = lambda w: F.size(F.filter("t", lambda t: t == F.lit(w)))
    counts = [times(w).alias(f"c{i}") for i, w in enumerate(words)]
    rows = stored(counted.select("doc_id", F.size("t").alias("len"), *counts), "counted")
    stats = rows.agg(F.count("*").alias("total"), F.avg("len").alias("avg"), *[F.count_if(F.col(f"c{i}") > 0).alias(f"d{i}") for i in range(len(words))])
    joined = rows.where(" or ".join(f"c{i} > 0" for i in range(len(words)))).crossJoin(F.broadcast(stats))  # one row
    parts = []
    for i in range(len(words)):
        idf = F.ln((F.col("total") - F.col(f"d{i}") + 0.5) / (F.col(f"d{i}") + 0.5) + 1)
        tf = F.col(f"c{i}")
        parts.append(idf * tf * (k1 + 1) / (tf + k1 * (1 - b + b * F.col("len") / F.col("avg"))))
    return joined.select("doc_id", sum(parts, F.lit(0.0)).alias("score"))
