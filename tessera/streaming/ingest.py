"""Online additions: new descriptors arrive as a stream and are assigned, signed and added to a stored index.

Every batch publishes a snapshot of the index with its points, and with word weights and norms that count
them; a batch that is run again after a failure is in the index once, since the snapshot that has its
points has its number too.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tessera.operators import hamming, inverted, knn
from tessera.sources import index
from tessera.sources.scratch import stored


def to_postings(points: DataFrame, codebook: DataFrame, basis, medians: DataFrame) -> DataFrame:
    near = knn.nearest(points, codebook).withColumnRenamed("centroid_id", "vw").drop("d2", "rnk")
    signed = hamming.signatures(hamming.project(near, basis), medians)
    return inverted.with_geometry(signed).drop("vec", "proj")


def append_images(points: DataFrame, path: str, checkpoint: str, codebook: DataFrame, basis, medians: DataFrame, once: bool = False, layout: index.Layout = index.Layout()) -> StreamingQuery:
    """Starts a query that adds the postings of a stream of points to the index in `path`, which it creates if there is none."""

    def add(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        # the batch is read by several jobs
        new = stored(to_postings(batch, codebook, basis, medians), "batch")
        if index.latest(spark, path) is None:
            index.store(new.where("false"), codebook, path, layout)
        index.add(new, path, checkpoint, number)

    writer = points.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def windowed_counts(events: DataFrame, window: str = "1 day", late: str = "1 day") -> DataFrame:
    """Events by window and type, with late ones up to a bound; for a stream the state is that of open windows only."""
    stamped = events.withColumn("at", F.col("ts").cast("timestamp"))
    return stamped.withWatermark("at", late).groupBy(F.window("at", window), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
