"""Nearest centroids of vectors: exact, weighted, by other distances, in a tree, and in two levels.

Distances to a codebook are products of matrices over Arrow batches, against a codebook that every
task holds. A codebook is broadcast in parts of at most MAX_BROADCAST centroids; with more than one
part, each gives its nearest and a window picks among those, so that nothing broadcast grows with the
data.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions import vectors as v
from tessera.sources.scratch import stored

MAX_BROADCAST = 65_536


def matrix(column: pa.Array) -> np.ndarray:
    """The vectors of a list column as rows; all have the same length and no nulls."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def distances(a: np.ndarray, b: np.ndarray, metric: str = "l2") -> np.ndarray:
    """Rows of a against rows of b: squared L2, L1, or symmetric chi-squared."""
    if metric == "l2":
        d = np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1)[None] - 2 * a @ b.T, 0)
        i, j = np.nonzero(d < 1e-9)  # where the difference of large terms says little
        d[i, j] = ((a[i] - b[j]) ** 2).sum(1)
        return d
    out = np.empty((len(a), len(b)))
    for j, c in enumerate(b):
        if metric == "l1":
            out[:, j] = np.abs(a - c).sum(1)
        elif metric == "chi2":
            s = a + c
            out[:, j] = np.divide((a - c) ** 2, s, out=np.zeros_like(a), where=s != 0).sum(1)
        else:
            raise ValueError(f"unknown metric {metric}")
    return out


def nearest(points: DataFrame, centroids: DataFrame, k: int = 1, metric: str = "l2", max_broadcast: int = MAX_BROADCAST) -> DataFrame:
    """points (vec, ...) with centroid_id, d2 and rnk (from 1): k rows a point, the nearest first, ties by id.

    centroids: an id, `centroid` and optionally `weight`, which multiplies the distance, or `offset`,
    which is added to it. Points whose vec is null or has a NaN have no row. An empty codebook gives none.
    """
    points = points.where("vec is not null and not exists(vec, x -> x is null or isnan(x))")
    name = centroids.columns[0]
    has = [c for c in ("weight", "offset") if c in centroids.columns]
    centroids = centroids.select(F.col(name).cast("long").alias("id"), F.col("centroid").cast("array<double>").alias("centroid"), *has)
    parts = max(1, -(-centroids.count() // max_broadcast))
    numbered = centroids.withColumn("_part", F.pmod(F.xxhash64("id"), F.lit(parts)))
    out = None
    if parts > 1:  # each row is a point of its own, whatever its columns
        points = stored(points.withColumn("_point", F.monotonically_increasing_id()), "points")
    for i in range(parts):
        rows = sorted(numbered.where(F.col("_part") == i).drop("_part").collect(), key=lambda r: r["id"])
        if rows:
            part = _nearest_part(points, rows, k, metric)
            out = part if out is None else out.unionByName(part)
    if out is None:
        empty = points.withColumns({"centroid_id": F.lit(0).cast("long"), "d2": F.lit(0.0), "rnk": F.lit(1)})
        return empty.where("false").drop("_point")
    if parts > 1:
        by = Window.partitionBy("_point").orderBy("d2", "centroid_id")
        out = out.withColumn("rnk", F.row_number().over(by)).where(F.col("rnk") <= k).drop("_point")
    return out


def _nearest_part(points: DataFrame, rows: list, k: int, metric: str) -> DataFrame:
    shared = points.sparkSession.sparkContext.broadcast((
        np.array([r["id"] for r in rows]), np.array([r["centroid"] for r in rows], np.float64),
        np.array([r["weight"] for r in rows], np.float64) if "weight" in rows[0] else None,
        np.array([r["offset"] for r in rows], np.float64) if "offset" in rows[0] else None,
    ))
    at = points.columns.index("vec")
    schema = T.StructType([*points.schema.fields, T.StructField("centroid_id", T.LongType()), T.StructField("d2", T.DoubleType()), T.StructField("rnk", T.IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, centroid, weight, offset = shared.value
        n = min(k, len(ids))
        for batch in batches:
            for low in range(0, batch.num_rows, 2048):
                part = batch.slice(low, 2048)
                d = distances(matrix(part.column(at)), centroid, metric)
                if weight is not None:
                    d = d * weight
                if offset is not None:
                    d = d + offset
                best = np.argsort(d, axis=1, kind="stable")[:, :n] if n > 1 else d.argmin(1)[:, None]
                rows_of = np.repeat(np.arange(part.num_rows), n)
                taken = part.take(pa.array(rows_of))
                flat = best.ravel()
                yield pa.RecordBatch.from_arrays([*taken.columns, pa.array(ids[flat], pa.int64()), pa.array(d[rows_of, flat]), pa.array(np.tile(np.arange(1, n + 1), part.num_rows), pa.int32())], schema.names)

    return points.mapInArrow(run, schema)


def cross_distances(points: DataFrame, others: DataFrame, metric: str = "l2") -> DataFrame:
    """Every distance of points to a bounded set of others (id, centroid): their number is the product by definition."""
    return nearest(points, others, others.count() or 1, metric).drop("rnk")


def assign_two_level(points: DataFrame, coarse: DataFrame, edges: DataFrame, leaves: DataFrame, k: int = 1, coarse_k: int = 1) -> DataFrame:
    """The k nearest leaves among those that edges (node, leaf) lead to from the coarse_k nearest nodes.

    A point whose nodes have no edges has no row, in place of the missing leaf.
    """
    at = nearest(points, coarse, coarse_k).select(*points.columns, F.col("centroid_id").alias("node"))
    tried = at.join(edges, "node").join(leaves.select(F.col(leaves.columns[0]).alias("leaf"), F.col("centroid")), "leaf")
    keys = [c for c in points.columns if c != "vec"]
    tried = tried.select(*points.columns, "leaf", v.distance_l2_squared(F.col("vec"), F.col("centroid")).alias("d2")).dropDuplicates([*keys, "leaf"])
    w = Window.partitionBy(*keys).orderBy("d2", "leaf")
    return tried.withColumn("rnk", F.row_number().over(w)).where(F.col("rnk") <= k)


def co_assignment_edges(coarse_of: DataFrame, leaf_of: DataFrame, least: int) -> DataFrame:
    """(leaf, node, n) with at least `least` points assigned to both; inputs (vec_id, node) and (vec_id, leaf)."""
    return coarse_of.join(leaf_of, "vec_id").groupBy("leaf", "node").agg(F.count("*").alias("n")).where(F.col("n") >= least)


def tree_assign(points: DataFrame, levels: list[DataFrame]) -> DataFrame:
    """Words of a hierarchical codebook: at each level the nearest child, word = word * branch + child.

    levels: (parent, child, centroid, factor); factor multiplies the squared distance.
    """
    keys = [c for c in points.columns if c != "vec"]
    at = points.withColumn("word", F.lit(0).cast("long"))
    for level in levels:
        branch = level.agg(F.max("child")).first()[0] + 1
        tried = at.join(level.withColumnRenamed("parent", "word"), "word")
        scored = tried.select(*points.columns, "word", "child", (v.distance_l2_squared(F.col("vec"), F.col("centroid")) * F.col("factor")).alias("d"))
        best = scored.groupBy(*keys, "word").agg(F.min(F.struct("d", "child")).alias("b"), F.any_value("vec").alias("vec"))
        at = best.select(*keys, "vec", (F.col("word") * branch + F.col("b.child")).alias("word"))
    return at


def within_ratio(assigned: DataFrame, keys: list[str], ratio: float) -> DataFrame:
    """Assignments (keys, d2) nearer than ratio times the nearest of the same point."""
    w = Window.partitionBy(*keys)
    return assigned.withColumn("_least", F.min("d2").over(w)).where(F.col("d2") < F.col("_least") * ratio).drop("_least")


def _packed(rows: DataFrame, size: int) -> tuple[DataFrame, int]:
    """(block, ids, tags, flat): rows (id, tag, vec) in blocks of about `size`, by a hash of the id; and the number of blocks."""
    blocks = max(1, -(-rows.count() // size))

    def pack(table: pa.Table) -> pa.Table:
        table = table.combine_chunks().sort_by("id")
        m = matrix(table.column("vec").combine_chunks())
        body = [x.tobytes() for x in (table.column("id").to_numpy(), table.column("tag").to_numpy(), m)]
        return pa.table({"block": pa.array([table.column("block")[0].as_py()], pa.int64()), **{n: pa.array([b], pa.binary()) for n, b in zip(("ids", "tags", "flat"), body, strict=True)}})

    numbered = rows.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks)))
    return numbered.groupBy("block").applyInArrow(pack, "block long, ids binary, tags binary, flat binary"), blocks


def smallest(d: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, id, d) of the k smallest finite entries of each row, in order, ties by id; ids: of the columns."""
    n = min(k, d.shape[1])
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    most = np.partition(d, n - 1, axis=1)[:, n - 1 : n]
    row, at = np.nonzero((d <= most) & (d < np.inf))
    value, of = d[row, at], ids[at]
    by = np.lexsort((of, value, row))
    row, value, of = row[by], value[by], of[by]
    heads = np.flatnonzero(np.diff(row, prepend=-1))
    good = np.arange(len(row)) - np.repeat(heads, np.diff(np.append(heads, len(row)))) < n
    return row[good], of[good], value[good]


def best_of_each(found: DataFrame, k: int) -> DataFrame:
    """(query_id, vec_id, d2, rnk): the k nearest of each query, ties by vec_id."""
    w = Window.partitionBy("query_id").orderBy("d2", "vec_id")
    return found.withColumn("rnk", F.row_number().over(w)).where(F.col("rnk") <= k).select("query_id", "vec_id", "d2", "rnk")


def nearest_in_blocks(
    queries: DataFrame, points: DataFrame, k: int, keep: Callable | None = None, rebuild: Callable | None = None, sizes: tuple[int, int] = (1024, 8192)
) -> DataFrame:
    """(query_id, vec_id, d2, rnk): the k nearest points of each query, ties by id; neither side is collected or broadcast.

    queries: query_id, tag, vec; points: vec_id, tag, vec, the tag a long. The queries, the smaller side,
    go in blocks to every block of points; each pair of blocks is one product of matrices, which leaves k
    rows of a query. keep(query vectors, query tags, point tags) is the mask of the pairs that count;
    rebuild(vectors, tags) makes the points' vectors, and a number added to the distances of each, out of
    what is in vec (codes, say).
    """
    complete = "vec is not null and not exists(vec, x -> x is null or isnan(x))"
    q, _ = _packed(queries.where(complete).select(F.col("query_id").cast("long").alias("id"), F.col("tag").cast("long").alias("tag"), "vec"), sizes[0])
    p, np_ = _packed(points.where(complete).select(F.col("vec_id").cast("long").alias("id"), F.col("tag").cast("long").alias("tag"), "vec"), sizes[1])
    q = q.select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(np_ - 1).cast("long"))).alias("block"), *[F.col(c).alias(f"q_{c}") for c in ("ids", "tags", "flat")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                q_ids, q_tags, q_flat, ids, tags, flat = (np.frombuffer(batch.column(i)[row].as_buffer(), t) for i, t in enumerate((np.int64, np.int64, np.float64) * 2))
                a, b, more = q_flat.reshape(len(q_ids), -1), flat.reshape(len(ids), -1), 0.0
                if rebuild is not None:
                    b, more = rebuild(b, tags)
                d = np.round(distances(a, b) + more, 9)
                if keep is not None:
                    d[~keep(a, q_tags, tags)] = np.inf
                at, of, value = smallest(d, ids, k)
                yield pa.RecordBatch.from_arrays([pa.array(q_ids[at]), pa.array(of), pa.array(value)], ["query_id", "vec_id", "d2"])

    pairs = p.join(q, "block").select("q_ids", "q_tags", "q_flat", "ids", "tags", "flat")
    return best_of_each(pairs.mapInArrow(run, "query_id long, vec_id long, d2 double"), k)
