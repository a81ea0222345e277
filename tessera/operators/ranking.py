"""Top-k, ranks, order statistics and lookups by order."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.sources.scratch import stored


def top_k(rows: DataFrame, value: str, k: int, tie: str, largest: bool = True) -> DataFrame:
    """The k rows with the largest (or smallest) values. The limit is the feature: each task keeps k rows."""
    return rows.orderBy(F.desc(value) if largest else F.asc(value), tie).limit(k)


def value_ranks(rows: DataFrame, values: DataFrame, column: str, decreasing: bool) -> DataFrame:
    """(value, least, most): the first and last rank, from 0, that each of the given values has among the column; NaN and null have none.

    Ranks are sums over the distinct values' counts; values absent from the column get the rank they would have.
    """
    wanted = values.select(F.col(column).cast("double").alias("value")).where("value is not null and not isnan(value)").distinct()
    counts = rows.select(F.col(column).cast("double").alias("value")).where("value is not null and not isnan(value)").groupBy("value").agg(F.count("*").alias("n"))
    every = counts.join(wanted.withColumn("_w", F.lit(True)), "value", "full").select("value", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("_w", F.lit(False)).alias("wanted"))
    # two levels: the sums of ranges of values, then within each, so that no task sees all values
    ranged = stored(every.repartitionByRange("value").withColumn("_p", F.spark_partition_id()), "ranged")  # both uses see the same ranges
    order = F.desc if decreasing else F.asc
    within = F.sum("n").over(Window.partitionBy("_p").orderBy(order("value"))) - F.col("n")
    totals = ranged.groupBy("_p").agg(F.sum("n").alias("t"))
    before = totals.select("_p", (F.sum("t").over(Window.orderBy(order("_p"))) - F.col("t")).alias("before"))  # a row for each partition
    out = ranged.withColumn("_in", within).join(before, "_p").where("wanted")
    least = F.col("before") + F.col("_in")
    return out.select("value", least.cast("long").alias("least"), (least + F.greatest(F.col("n") - 1, F.lit(0))).cast("long").alias("most"))


def as_of(rows: DataFrame, points: DataFrame, key: str, at: str, value: str) -> DataFrame:
    """points with the value of the last row of the same key at or before them; null where there is none.

    One union and one window by key, in which each point looks back: the cost is a sort, not a range join.
    """
    both = rows.select(key, F.col(at).alias("_at"), F.col(value).alias("_v"), F.lit(0).alias("_kind"), *[F.lit(None).cast(points.schema[c].dataType).alias(c) for c in points.columns if c not in (key, at)])
    asked = points.select(key, F.col(at).alias("_at"), F.lit(None).cast(rows.schema[value].dataType).alias("_v"), F.lit(1).alias("_kind"), *[c for c in points.columns if c not in (key, at)])
    w = Window.partitionBy(key).orderBy("_at", "_kind").rowsBetween(Window.unboundedPreceding, 0)
    found = both.unionByName(asked).withColumn("_last", F.last("_v", ignorenulls=True).over(w)).where("_kind = 1")
    return found.select(F.col(key), F.col("_at").alias(at), *[c for c in points.columns if c not in (key, at)], F.col("_last").alias(value))
