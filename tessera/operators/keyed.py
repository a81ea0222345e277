"""k-means of many groups at once: the parents of a tree, the subspaces of a product code, the starts of one clustering.

A round is one pass over all points, whatever the number of groups. A task holds the centroids and sums of
every group (cells x dimensions, a parameter), and sends its sums only, so a group with most of the points
costs no more than others. With more than `max_broadcast` centroids the groups are dealt into parts, and a
round is a pass for each part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.operators import knn

Book = dict[int, np.ndarray]  # the centroids of each group, a row each


def _usable(points: DataFrame) -> DataFrame:
    return points.where("grp is not null and vec is not null and not exists(vec, x -> x is null or isnan(x))")


def _parts(book: Book, most: int) -> Iterator[Book]:
    part, size = {}, 0
    for g, c in book.items():
        if part and size + len(c) > most:
            yield part
            part, size = {}, 0
        part[g], size = c, size + len(c)
    if part:
        yield part


def _by_group(groups: np.ndarray, book: Book) -> Iterator[tuple[int, np.ndarray]]:
    """Of each group of the book its rows in the batch."""
    order = np.argsort(groups, kind="stable")
    found, starts = np.unique(groups[order], return_index=True)
    for g, rows in zip(found.tolist(), np.split(order, starts[1:]), strict=True):
        if g in book:
            yield g, rows


def starts(points: DataFrame, k: int, salt: Column | str = "") -> Book:
    """k points of each group (all, if fewer), the first by a hash of salt and vec_id. Each task sends k of a group at most."""
    prefix = salt if isinstance(salt, Column) else F.lit(salt)
    hashed = points.select("grp", F.col("vec_id").cast("long").alias("vec_id"), F.coalesce(F.md5(F.concat(prefix, F.col("vec_id").cast("string"))), F.lit("")).alias("_h"), F.col("vec").cast("array<double>").alias("vec"))

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[int, tuple[pa.Table, bytes | None]] = {}  # the first k of a group, and the hash of the last of them
        for batch in batches:
            if not batch.num_rows:
                continue
            groups, h = batch.column(0).to_numpy(), batch.column(2).to_numpy(zero_copy_only=False).astype("S32")
            order = np.argsort(groups, kind="stable")
            found, at = np.unique(groups[order], return_index=True)
            for g, rows in zip(found.tolist(), np.split(order, at[1:]), strict=True):
                own, last = kept.get(g, (None, None))
                if last is not None:
                    rows = rows[h[rows] <= last]
                if not len(rows):
                    continue
                new = pa.Table.from_batches([batch.take(pa.array(rows))])
                own = new if own is None else pa.concat_tables([own, new])
                by = np.lexsort((own.column(1).to_numpy(), own.column(2).to_numpy().astype("S32")))[:k]
                own = own.take(pa.array(by)).combine_chunks()
                kept[g] = own, own.column(2)[k - 1].as_py().encode() if len(own) == k else None
        for own, _ in kept.values():
            yield from own.to_batches()

    least = hashed.mapInArrow(first, hashed.schema)
    ranked = least.withColumn("_r", F.row_number().over(Window.partitionBy("grp").orderBy("_h", "vec_id"))).where(F.col("_r") <= k)
    book: dict[int, list] = {}
    for r in sorted(ranked.select("grp", "_r", "vec").collect(), key=lambda r: (r["grp"], r["_r"])):
        book.setdefault(r["grp"], []).append(r["vec"])
    return {g: np.array(c, np.float64) for g, c in book.items()}


def sums(points: DataFrame, book: Book) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Of each group the sums, numbers and squared distances of the points nearest to each centroid: one pass."""
    if not book:
        return {}
    shared = points.sparkSession.sparkContext.broadcast(book)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: Book = shared.value
        found: dict[int, tuple] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            m = knn.matrix(batch.column(1))
            for g, rows in _by_group(batch.column(0).to_numpy(), own):
                c = own[g]
                if g not in found:
                    found[g] = np.zeros_like(c), np.zeros(len(c), np.int64), np.zeros(len(c))
                s, n, cost = found[g]
                for low in range(0, len(rows), 2048):
                    part = m[rows[low : low + 2048]]
                    d = knn.distances(part, c)
                    of = d.argmin(1)
                    np.add.at(s, of, part)
                    n += np.bincount(of, minlength=len(c))
                    cost += np.bincount(of, d[np.arange(len(of)), of], len(c))
        for g, (s, n, cost) in found.items():
            at = np.flatnonzero(n)
            lists = pa.array(s[at].tolist(), pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), g), pa.int64()), pa.array(at, pa.int32()), pa.array(n[at]), pa.array(cost[at]), lists], ["grp", "cell", "n", "cost", "s"])

    rows = points.select("grp", "vec").mapInArrow(partial, "grp long, cell int, n long, cost double, s array<double>")
    entries = rows.select("grp", "cell", "n", "cost", F.posexplode("s").alias("j", "x"))
    table = entries.groupBy("grp", "cell", "j").agg(F.sum("x").alias("x"), F.sum("n").alias("n"), F.sum("cost").alias("cost")).toArrow()
    shared.unpersist()
    grp, cell, j, x, n, cost = (table.column(c).to_numpy() for c in ("grp", "cell", "j", "x", "n", "cost"))
    out = {}
    order = np.argsort(grp, kind="stable")
    found, first = np.unique(grp[order], return_index=True)
    for g, at in zip(found.tolist(), np.split(order, first[1:]), strict=True):
        s, count, d = np.zeros_like(book[g]), np.zeros(len(book[g]), np.int64), np.zeros(len(book[g]))
        s[cell[at], j[at]], count[cell[at]], d[cell[at]] = x[at], n[at], cost[at]
        out[g] = s, count, d
    return out


def costs(points: DataFrame, book: Book, max_broadcast: int = knn.MAX_BROADCAST) -> dict[int, float]:
    """Of each group the sum of squared distances to the nearest centroid."""
    return {g: float(d.sum()) for part in _parts(book, max_broadcast) for g, (_, _, d) in sums(_usable(points), part).items()}


def kmeans(points: DataFrame, k: int, rounds: int = 20, tolerance: float = 1e-9, salt: Column | str = "", max_broadcast: int = knn.MAX_BROADCAST) -> tuple[Book, dict[int, np.ndarray]]:
    """The centroids of every group after Lloyd rounds, and the numbers of points of their cells in the last round.

    points: grp (long), vec_id, vec; a point may be in several groups. Each group ends as
    `clustering.kmeans` of its own points does: from the same start, an empty cell re-seeded from a split
    of the largest, and no further rounds once no centroid moves by more than tolerance. Points without
    group or with a null or NaN in vec take no part; a group with fewer than k points has as many cells.
    """
    points = _usable(points)
    book = starts(points, k, salt)
    counts = {g: np.zeros(len(c), np.int64) for g, c in book.items()}
    going = dict(book)
    for _ in range(rounds):
        if not going:
            break
        for part in list(_parts(going, max_broadcast)):
            for g, (s, n, _) in sums(points, part).items():
                old, new = book[g], book[g].copy()
                full = n > 0
                new[full] = s[full] / n[full, None]
                split = new[n.argmax()] * (1 + 1e-5 * (-1.0) ** np.arange(new.shape[1]))
                new[~full] = split
                book[g], counts[g] = new, n
                if np.abs(new - old).max() <= tolerance:
                    del going[g]
                else:
                    going[g] = new
    return book, counts


def assign(points: DataFrame, book: Book, max_broadcast: int = knn.MAX_BROADCAST) -> DataFrame:
    """points with `cell`, the nearest centroid of their own group; those of groups that the book lacks have no row."""
    points = _usable(points)
    schema = T.StructType([*points.schema.fields, T.StructField("cell", T.IntegerType())])
    grp, vec = points.columns.index("grp"), points.columns.index("vec")
    out = None
    for part in _parts(book, max_broadcast):
        shared = points.sparkSession.sparkContext.broadcast(part)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            own: Book = shared.value
            for batch in batches:
                if not batch.num_rows:
                    continue
                m, cell = knn.matrix(batch.column(vec)), np.full(batch.num_rows, -1, np.int32)
                for g, rows in _by_group(batch.column(grp).to_numpy(), own):
                    for low in range(0, len(rows), 2048):
                        at = rows[low : low + 2048]
                        cell[at] = knn.distances(m[at], own[g]).argmin(1)
                known = pa.array(np.flatnonzero(cell >= 0))
                yield pa.RecordBatch.from_arrays([*batch.take(known).columns, pa.array(cell[cell >= 0])], schema.names)

        rows = points.mapInArrow(run, schema)
        out = rows if out is None else out.unionByName(rows)
    return points.withColumn("cell", F.lit(0)).where("false") if out is None else out


def table(spark, book: Book, counts: dict[int, np.ndarray]) -> DataFrame:
    """(grp, vw, centroid, n)."""
    rows = [(g, i, c.tolist(), int(n)) for g in sorted(book) for i, (c, n) in enumerate(zip(book[g], counts[g], strict=True))]
    return spark.createDataFrame(rows, "grp long, vw long, centroid array<double>, n long")
