"""Matches between the points of a query image and those of the images on its short list, by the mode that a query asks for.

Points of an image are packed into blocks of BLOCK point numbers; a block of the query meets each block of
the images on its list in one product of matrices, which leaves what can count: pairs within the threshold,
or k a query point. Neither an image nor a list is ever held whole by a task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import vectors as v
from tessera.operators import knn, points
from tessera.operators.geometry import MatchMode

#: Point numbers in a block.
BLOCK = 4096
GEOMETRY = ("x", "y", "scale", "angle")
PAIR = "query_id long, qpt long, image_id long, dbpt long, d2 double, " + ", ".join(f"{side}{c} double" for side in ("q", "") for c in GEOMETRY)


def _packed(rows: DataFrame, owner: str, side: str) -> DataFrame:
    """(owner, <side>block, <side>pts, <side>body): the points of a block by number, each the vector and then the geometry."""

    def pack(table: pa.Table) -> pa.Table:
        table = table.combine_chunks().sort_by("pt")
        body = np.column_stack([knn.matrix(table.column("vec").combine_chunks()), *[table.column(c).to_numpy() for c in GEOMETRY]])
        pts = table.column("pt").to_numpy().tobytes()
        return pa.table({owner: table.column(owner)[:1], f"{side}block": table.column("block")[:1], f"{side}pts": pa.array([pts], pa.binary()), f"{side}body": pa.array([body.tobytes()], pa.binary())})

    complete = "pt is not null and vec is not null and not exists(vec, x -> x is null or isnan(x))"
    own = rows.where(complete).select(F.col(owner).cast("long").alias(owner), F.col("pt").cast("long").alias("pt"), "vec", *[F.col(c).cast("double").alias(c) for c in GEOMETRY])
    numbered = own.withColumn("block", F.floor(F.col("pt") / BLOCK).cast("long"))
    return numbered.groupBy(owner, "block").applyInArrow(pack, f"{owner} long, {side}block long, {side}pts binary, {side}body binary")


def _pairs(queries: DataFrame, others: DataFrame, shortlist: DataFrame, limit: float | None, k: int | None) -> DataFrame:
    """Pairs of a query's points and those of its images, within distance `limit`, or k of each query point and block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                query, image = (batch.column(i)[row].as_py() for i in (0, 1))
                q_pts, pts = (np.frombuffer(batch.column(i)[row].as_buffer(), np.int64) for i in (2, 4))
                q, p = (np.frombuffer(batch.column(i)[row].as_buffer(), np.float64).reshape(n, -1) for i, n in ((3, len(q_pts)), (5, len(pts))))
                for low in range(0, len(q), 1024):  # bounds the matrix of distances
                    part = q[low : low + 1024]
                    d = np.round(knn.distances(part[:, :-4], p[:, :-4]), 9)
                    if k is None:
                        a, b = np.nonzero(d <= limit * limit)
                        d2 = d[a, b]
                    else:
                        a, b, d2 = knn.smallest(d, np.arange(len(p)), k)
                    columns = [np.full(len(a), query), q_pts[low + a], np.full(len(a), image), pts[b], d2, *part[a, -4:].T, *p[b, -4:].T]
                    yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in columns], names)

    names = [c.split()[0] for c in PAIR.split(", ")]
    met = shortlist.join(_packed(queries, "query_id", "q"), "query_id").join(_packed(others, "image_id", ""), "image_id")
    return met.select("query_id", "image_id", "qpts", "qbody", "pts", "body").mapInArrow(run, PAIR)


def _scored(pairs: DataFrame) -> DataFrame:
    """score: 1 - d / sqrt(1.1 * the largest squared distance of the query); 1 where that is zero."""
    most = pairs.groupBy("query_id").agg(F.sqrt(1.1 * F.max("d2")).alias("_t"))
    return pairs.join(most, "query_id").withColumn("score", F.when(F.col("_t") > 0, 1 - F.sqrt("d2") / F.col("_t")).otherwise(1.0)).drop("_t")


def _on_words(queries: DataFrame, others: DataFrame, shortlist: DataFrame, most: float) -> DataFrame:
    named = [F.col("pt").cast("long").alias("qpt"), "vw", F.col("binsign").alias("_s"), *[F.col(c).alias(f"q{c}") for c in GEOMETRY]]
    asked = queries.select("query_id", *named).join(shortlist, "query_id")
    hd = v.hamming(F.col("_s"), F.col("binsign"))
    met = others.select("image_id", F.col("pt").cast("long").alias("dbpt"), "vw", "binsign", *GEOMETRY).join(asked, ["image_id", "vw"])
    return met.where(hd <= int(most)).withColumn("score", 1 - hd / (int(most) + 1.0))


def match(queries: DataFrame, others: DataFrame, shortlist: DataFrame, mode: MatchMode, threshold: float) -> DataFrame:
    """(query_id, qpt, image_id, dbpt, score, qx, qy, qscale, qangle, x, y, scale, angle): matches that `geometry.verify` takes.

    queries: query_id, pt and geometry; others: image_id, pt and geometry; both with vec, or vw and binsign
    where the mode is words; with cornerness where it crops. shortlist: (query_id, image_id), once a pair.
    pt numbers the points of an image. Of several modes the first of these counts:

    exact: all pairs within the distance `threshold`, scored 1 - d / threshold; nearest: the `threshold`
    nearest points in each image; nearest_of_all: those over all images of the list (ties by image, then
    point); words: pairs on a word within the Hamming distance `threshold`. crop keeps the strongest points
    of every image and query first. Points with a null or NaN in vec, or without number, have no match.
    No mode at all is an error, as no matches would be asked for.
    """
    shortlist = shortlist.select(F.col("query_id").cast("long").alias("query_id"), F.col("image_id").cast("long").alias("image_id"))
    if mode.crop is not None:
        others = points.strongest(others, mode.crop)
        queries = points.strongest(queries.withColumn("image_id", F.col("query_id")), mode.crop)
    if mode.exact:
        found = _pairs(queries, others, shortlist, threshold, None).withColumn("score", 1 - F.sqrt("d2") / threshold)
    elif mode.nearest or mode.nearest_of_all:
        k = int(threshold)
        of = ("query_id", "qpt", "image_id") if mode.nearest else ("query_id", "qpt")
        order = Window.partitionBy(*of).orderBy("d2", "image_id", "dbpt")
        pairs = _pairs(queries, others, shortlist, None, k)
        found = _scored(pairs.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= k).drop("_r"))
    elif mode.words:
        found = _on_words(queries, others, shortlist, threshold)
    else:
        raise ValueError("a mode of matching must be given: exact, nearest, nearest_of_all or words")
    return found.select("query_id", "qpt", "image_id", "dbpt", "score", *[f"q{c}" for c in GEOMETRY], *GEOMETRY)
