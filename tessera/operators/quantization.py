"""Product quantisation: codes, distances by lookup, residual codes, and inverted lists of codes.

Models are small tables bounded by their parameters (subspaces x cells); they are broadcast as arrays,
and codes and distances are computed on matrices of a batch.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions import vectors as v
from tessera.operators import clustering, keyed, knn


@dataclass(frozen=True)
class ProductQuantizer:
    """centroids: (subspaces, cells, dimensions of a subspace); errors: mean squared error of each cell."""

    centroids: np.ndarray
    errors: np.ndarray | None = None

    @property
    def dim(self) -> int:
        return self.centroids.shape[0] * self.centroids.shape[2]

    def encode(self, m: np.ndarray) -> np.ndarray:
        parts = m.reshape(len(m), self.centroids.shape[0], -1)
        return np.stack([knn.distances(parts[:, q], c).argmin(1) for q, c in enumerate(self.centroids)], 1)

    def decode(self, codes: np.ndarray) -> np.ndarray:
        return np.concatenate([c[codes[:, q]] for q, c in enumerate(self.centroids)], 1)

    def tables(self, m: np.ndarray, corrected: bool = False) -> np.ndarray:
        """Squared distances of each row's subvectors to every cell, plus the cell's error if corrected."""
        parts = m.reshape(len(m), self.centroids.shape[0], -1)
        t = np.stack([knn.distances(parts[:, q], c) for q, c in enumerate(self.centroids)], 1)
        return t + self.errors if corrected else t

    def cell_distances(self, corrected: bool = False) -> np.ndarray:
        """(subspace, cell, cell): squared distances between cells, plus both errors if corrected."""
        t = np.stack([knn.distances(c, c) for c in self.centroids])
        return t + self.errors[:, :, None] + self.errors[:, None, :] if corrected else t


def from_rows(rows: list[np.ndarray], subspaces: int) -> ProductQuantizer:
    """A quantiser whose cells are the subvectors of the given vectors."""
    m = np.array(rows, np.float64)
    return ProductQuantizer(m.reshape(len(m), subspaces, -1).transpose(1, 0, 2).copy())


def subvectors(points: DataFrame, subspaces: int) -> DataFrame:
    """(vec_id, grp, vec): a row for each subspace."""
    part = lambda q: F.slice("vec", F.lit(q) * (F.size("vec") / subspaces).cast("int") + 1, (F.size("vec") / subspaces).cast("int"))
    return points.select("vec_id", F.posexplode(F.array(*[part(q) for q in range(subspaces)])).alias("grp", "vec")).withColumn("grp", F.col("grp").cast("long"))


def learn(points: DataFrame, subspaces: int, cells: int, rounds: int = 10) -> ProductQuantizer:
    """k-means in every subspace, all in the same passes; the cells alone come to the driver."""
    book, _ = keyed.kmeans(subvectors(points, subspaces), cells, rounds)
    return with_errors(points, ProductQuantizer(np.stack([book[q] for q in range(subspaces)])))


def _kmeans(m: np.ndarray, cells: int, rounds: int, rng: np.random.Generator) -> np.ndarray:
    c = m[rng.choice(len(m), min(cells, len(m)), replace=False)].copy()
    for _ in range(rounds):
        of = knn.distances(m, c).argmin(1)
        n = np.bincount(of, minlength=len(c))
        sums = np.zeros_like(c)
        np.add.at(sums, of, m)
        c[n > 0] = sums[n > 0] / n[n > 0, None]
    return c


def learn_lists(points: DataFrame, lists_: int, subspaces: int, cells: int, sample: int = 8192, rounds: int = 10, seed: int = 1) -> tuple[np.ndarray, ProductQuantizer]:
    """Centroids of the lists and a quantiser of residuals, by k-means on `sample` points at most (the first by a hash of vec_id), on the driver."""
    rows = points.select("vec_id", "vec").orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).collect()
    m, rng = np.array([r["vec"] for r in rows], np.float64), np.random.default_rng(seed)
    centroids = _kmeans(m, lists_, rounds, rng)
    rest = m - centroids[knn.distances(m, centroids).argmin(1)]
    parts = rest.reshape(len(m), subspaces, -1)
    return centroids, ProductQuantizer(np.stack([_kmeans(np.ascontiguousarray(parts[:, q]), cells, rounds, rng) for q in range(subspaces)]))


#: Codes in a block of a list, and queries in a block of those that probe a list.
BLOCK, ASKED = 4096, 1024


def list_blocks(built: DataFrame, size: int = BLOCK) -> DataFrame:
    """(vw, block, of, n, ids, codes): lists (vw, vec_id, codes) cut into `of` blocks of about `size` codes each, by a hash of vec_id."""
    sizes = built.groupBy("vw").agg(F.ceil(F.count("*") / size).cast("long").alias("of"))  # a row a list
    dealt = built.join(F.broadcast(sizes), "vw").withColumn("block", F.pmod(F.xxhash64("vec_id"), F.col("of")))

    def pack(table: pa.Table) -> pa.Table:
        table = table.combine_chunks().sort_by("vec_id")
        codes = table.column("codes").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.uint16)
        one = {c: table.column(c)[:1] for c in ("vw", "block", "of")}
        return pa.table({**one, "n": pa.array([len(table)], pa.int64()), "ids": pa.array([table.column("vec_id").to_numpy().tobytes()], pa.binary()), "codes": pa.array([codes.tobytes()], pa.binary())})

    return dealt.select("vw", F.col("vec_id").cast("long").alias("vec_id"), "codes", "block", "of").groupBy("vw", "block").applyInArrow(pack, "vw long, block long, of long, n long, ids binary, codes binary")


def probed_blocks(queries: DataFrame, blocks: DataFrame, codebook: DataFrame, probes: int, size: int = ASKED, relative: bool = True) -> DataFrame:
    """(vw, block, n, ids, codes, q_ids, q_flat): the blocks of the lists that queries probe, each with a block of those queries.

    queries: query_id, vec; q_flat: their residuals to the list, or the vectors where codes are not relative to it. Blocks of a list that nothing probes meet no
    query. Of a long list each block goes to a task of its own, and the queries follow it there.
    """
    near = knn.nearest(queries.select("query_id", "vec"), codebook, probes).select("query_id", "vec", F.col("centroid_id").alias("vw"))
    rest = near.join(F.broadcast(codebook.select(F.col("vw").cast("long").alias("vw"), "centroid")), "vw").select("vw", "query_id", (F.zip_with("vec", "centroid", lambda x, y: x - y) if relative else F.col("vec")).alias("rest"))
    groups = rest.groupBy("vw").agg(F.ceil(F.count("*") / size).cast("long").alias("of"))
    dealt = rest.join(F.broadcast(groups), "vw").withColumn("part", F.pmod(F.xxhash64("query_id"), F.col("of")))

    def pack(table: pa.Table) -> pa.Table:
        table = table.combine_chunks().sort_by("query_id")
        m = knn.matrix(table.column("rest").combine_chunks())
        return pa.table({"vw": table.column("vw")[:1], "q_ids": pa.array([table.column("query_id").to_numpy().tobytes()], pa.binary()), "q_flat": pa.array([m.tobytes()], pa.binary())})

    packed_ = dealt.select("vw", F.col("query_id").cast("long").alias("query_id"), "rest", "part").groupBy("vw", "part").applyInArrow(pack, "vw long, q_ids binary, q_flat binary")
    sizes = blocks.select("vw", "of").distinct()
    asked = packed_.join(F.broadcast(sizes), "vw").withColumn("block", F.explode(F.expr("sequence(0L, of - 1)"))).drop("of")
    return blocks.drop("of").join(asked, ["vw", "block"])


def nearest_codes(probed: DataFrame, pq: ProductQuantizer, short: int) -> DataFrame:
    """(query_id, vec_id, d2, rnk): the `short` nearest codes of each query; `short` of each pair of blocks leave a task.

    A point in several lists counts once, with its nearest code.
    """
    shared = probed.sparkSession.sparkContext.broadcast(pq)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pq = shared.value
        for batch in batches:
            for row in range(batch.num_rows):
                ids, codes, q_ids, q_flat = (np.frombuffer(batch.column(i)[row].as_buffer(), t) for i, t in enumerate((np.int64, np.uint16, np.int64, np.float64)))
                made = pq.decode(codes.reshape(len(ids), -1).astype(np.int64))
                at, of, d = knn.smallest(np.round(knn.distances(q_flat.reshape(len(q_ids), -1), made), 9), ids, short)
                yield pa.RecordBatch.from_arrays([pa.array(q_ids[at]), pa.array(of), pa.array(d)], ["query_id", "vec_id", "d2"])

    found = probed.select("ids", "codes", "q_ids", "q_flat").mapInArrow(run, "query_id long, vec_id long, d2 double")
    return knn.best_of_each(found.groupBy("query_id", "vec_id").agg(F.min("d2").alias("d2")), short)


def search_reranked(queries: DataFrame, points: DataFrame, blocks: DataFrame, codebook: DataFrame, pq: ProductQuantizer, probes: int, short: int, k: int) -> DataFrame:
    """(query_id, vec_id, d2, rnk): the k nearest by exact distance among each query's `short` nearest codes in its `probes` nearest lists.

    queries: query_id, vec, of any number; blocks: as of `list_blocks`.
    """
    coarse = nearest_codes(probed_blocks(queries, blocks, codebook, probes), pq, short).select("query_id", "vec_id")
    both = coarse.join(points.select("vec_id", "vec"), "vec_id").join(queries.select("query_id", F.col("vec").alias("asked")), "query_id")
    return nearest(both.select("query_id", "vec_id", v.distance_l2_squared(F.col("asked"), F.col("vec")).alias("d2")), k)


def _map(points: DataFrame, added: list[T.StructField], compute) -> DataFrame:
    at = points.columns.index("vec")
    schema = T.StructType([*points.schema.fields, *added])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([*batch.columns, *compute(knn.matrix(batch.column(at)))], schema.names)

    return points.mapInArrow(run, schema)


def lists(m: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.arange(0, m.size + 1, m.shape[1], dtype=np.int32)), pa.array(m.ravel(), kind))


def encode(points: DataFrame, pq: ProductQuantizer) -> DataFrame:
    """points with `codes`, the nearest cell of each subspace (the first among equals)."""
    shared = points.sparkSession.sparkContext.broadcast(pq)
    return _map(points, [T.StructField("codes", T.ArrayType(T.IntegerType()))], lambda m: [lists(shared.value.encode(m), pa.int32())])


def residuals(points: DataFrame, pq: ProductQuantizer) -> DataFrame:
    """points with vec replaced by what the decoded code leaves of it, and `codes`."""
    shared = points.sparkSession.sparkContext.broadcast(pq)

    def compute(m: np.ndarray) -> list:
        codes = shared.value.encode(m)
        return [lists(codes, pa.int32()), lists(m - shared.value.decode(codes), pa.float64())]

    found = _map(points, [T.StructField("codes", T.ArrayType(T.IntegerType())), T.StructField("rest", T.ArrayType(T.DoubleType()))], compute)
    return found.drop("vec").withColumnRenamed("rest", "vec")


def with_errors(points: DataFrame, pq: ProductQuantizer) -> ProductQuantizer:
    """The quantiser with the mean squared error of each cell over the points; 0 for a cell without any."""
    shared = points.sparkSession.sparkContext.broadcast(pq)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q, cells, _ = shared.value.centroids.shape
        sums, counts = np.zeros((q, cells)), np.zeros((q, cells), np.int64)
        for batch in batches:
            if batch.num_rows:
                t = shared.value.tables(knn.matrix(batch.column(0)))
                best = t.argmin(2)
                for i in range(q):
                    np.add.at(sums[i], best[:, i], t[np.arange(len(t)), i, best[:, i]])
                    np.add.at(counts[i], best[:, i], 1)
        a, b = (x.ravel() for x in np.indices((q, cells)))
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int32()), pa.array(b, pa.int32()), pa.array(sums.ravel()), pa.array(counts.ravel())], ["q", "c", "s", "n"])

    errors = np.zeros(pq.centroids.shape[:2])
    rows = points.select("vec").mapInArrow(run, "q int, c int, s double, n long").groupBy("q", "c").agg(F.sum("s").alias("s"), F.sum("n").alias("n")).collect()
    for r in rows:
        errors[r["q"], r["c"]] = r["s"] / r["n"] if r["n"] else 0.0
    return ProductQuantizer(pq.centroids, errors)


def pair_distances(pairs: DataFrame, pq: ProductQuantizer, symmetric: bool = False, corrected: bool = False) -> DataFrame:
    """(query_id, vec_id, d2) of pairs (query_id, vec, vec_id, codes): of the vector to the code, or of its own code to the code."""
    shared = pairs.sparkSession.sparkContext.broadcast((pq, pq.cell_distances(corrected)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pq, between = shared.value
        for batch in batches:
            if batch.num_rows:
                m, codes = knn.matrix(batch.column(1)), batch.column(3).flatten().to_numpy().reshape(batch.num_rows, -1)
                q = np.arange(codes.shape[1])[None]
                d = between[q, pq.encode(m), codes] if symmetric else np.take_along_axis(pq.tables(m, corrected), codes[:, :, None], 2)[:, :, 0]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(d.sum(1))], ["query_id", "vec_id", "d2"])

    return pairs.select(F.col("query_id").cast("long"), "vec", F.col("vec_id").cast("long"), "codes").mapInArrow(run, "query_id long, vec_id long, d2 double")


def approximated(rows: DataFrame, pq: ProductQuantizer) -> DataFrame:
    """rows with vec replaced by what its code stands for."""
    shared = rows.sparkSession.sparkContext.broadcast(pq)
    made = _map(rows, [T.StructField("made", T.ArrayType(T.DoubleType()))], lambda m: [lists(shared.value.decode(shared.value.encode(m)), pa.float64())])
    return made.drop("vec").withColumnRenamed("made", "vec")


def search_codes(queries: DataFrame, coded: DataFrame, pq: ProductQuantizer, k: int, symmetric: bool = False, corrected: bool = False) -> DataFrame:
    """(query_id, vec_id, d2, rnk): the k nearest of all codes (vec_id, codes) for each query (query_id, vec), of any number.

    symmetric: the query is what its own code stands for. corrected: with the errors of the codes, that of
    the query's own code aside, which is the same for all points.
    """
    shared = coded.sparkSession.sparkContext.broadcast(pq)

    def rebuild(codes: np.ndarray, _: np.ndarray) -> tuple[np.ndarray, np.ndarray | float]:
        c = codes.astype(np.int64)
        return shared.value.decode(c), shared.value.errors[np.arange(c.shape[1]), c].sum(1) if corrected else 0.0

    asked = approximated(queries, pq) if symmetric else queries
    points = coded.select("vec_id", F.lit(0).alias("tag"), F.col("codes").cast("array<double>").alias("vec"))
    return knn.nearest_in_blocks(asked.select("query_id", F.lit(0).alias("tag"), "vec"), points, k, rebuild=rebuild)


def nearest(distances: DataFrame, k: int) -> DataFrame:
    """The k nearest of each query, ties by vec_id."""
    w = Window.partitionBy("query_id").orderBy(F.round("d2", 9), "vec_id")
    return distances.withColumn("rnk", F.row_number().over(w)).where(F.col("rnk") <= k)


def rerank(coarse: DataFrame, coded: DataFrame, queries: DataFrame, first: ProductQuantizer, second: ProductQuantizer, k: int) -> DataFrame:
    """The k nearest among a short list (query_id, vec_id) by both codes' reconstruction; coded: vec_id, codes, rest_codes; queries: query_id, vec."""
    shared = coded.sparkSession.sparkContext.broadcast((first, second))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, second = shared.value
        for batch in batches:
            if batch.num_rows:
                a, b = (batch.column(i).flatten().to_numpy().reshape(batch.num_rows, -1) for i in (2, 3))
                d = ((knn.matrix(batch.column(4)) - first.decode(a) - second.decode(b)) ** 2).sum(1)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(d)], ["query_id", "vec_id", "d2"])

    joined = coarse.select("query_id", "vec_id").join(coded, "vec_id").join(queries.select("query_id", "vec"), "query_id").select("query_id", "vec_id", "codes", "rest_codes", "vec")
    return nearest(joined.mapInArrow(run, "query_id long, vec_id long, d2 double"), k)


def build_lists(points: DataFrame, codebook: DataFrame, pq: ProductQuantizer, spill: int = 1, relative: bool = True) -> DataFrame:
    """(vw, vec_id, codes): the residual of each point to its word's centroid (the point itself, if not relative) as a code; spill: a point is in so many nearest lists."""
    near = knn.nearest(points.select("vec_id", "vec"), codebook, spill)
    rest = near.join(codebook.select(F.col("vw").alias("centroid_id"), "centroid"), "centroid_id")
    rest = rest.select("vec_id", F.col("centroid_id").alias("vw"), (F.zip_with("vec", "centroid", lambda x, y: x - y) if relative else F.col("vec")).alias("vec"))
    return encode(rest, pq).select("vw", "vec_id", "codes")


def search_lists(queries: DataFrame, lists_: DataFrame, codebook: DataFrame, pq: ProductQuantizer, cells: int, k: int, ratio: float | None = None) -> DataFrame:
    """(query_id, vw, vec_id, d2, rnk): the k nearest codes in each query's nearest cells, by tables of the query's residuals.

    queries: query_id, vec. Codes meet the query's tables in a join on the cell, so that only the probed
    lists are read. With a ratio, only cells nearer than ratio times the nearest are probed.
    """
    near = knn.nearest(queries.select("query_id", "vec"), codebook, cells)
    if ratio is not None:
        near = knn.within_ratio(near, ["query_id"], ratio)
    rest = near.join(codebook.select(F.col("vw").alias("centroid_id"), "centroid"), "centroid_id")
    rest = rest.select("query_id", F.col("centroid_id").alias("vw"), F.zip_with("vec", "centroid", lambda x, y: x - y).alias("vec"))
    shared = queries.sparkSession.sparkContext.broadcast(pq)

    def table(m: np.ndarray) -> list:
        t = shared.value.tables(m)
        return [lists(t.reshape(len(t), -1), pa.float64())]

    luts = _map(rest, [T.StructField("lut", T.ArrayType(T.DoubleType()))], table).drop("vec")
    size = pq.centroids.shape[1]
    d2 = F.aggregate(F.transform("codes", lambda c, q: F.element_at("lut", q * size + c + 1)), F.lit(0.0), lambda a, x: a + x)
    found = lists_.join(luts, "vw").select("query_id", "vw", "vec_id", d2.alias("d2"))
    return nearest(found, k)


def merge_lists(first: DataFrame, second: DataFrame, shift: int) -> DataFrame:
    """The lists of two shards (vw, vec_id, codes) as one; the vec_ids of the second move by `shift`."""
    return first.select("vw", "vec_id", "codes").unionByName(second.select("vw", (F.col("vec_id") + shift).alias("vec_id"), "codes"))


def list_sizes(lists_: DataFrame, words: DataFrame) -> DataFrame:
    """(vw, n) for every word, 0 where a list is empty."""
    counts = lists_.groupBy("vw").agg(F.count("*").alias("n"))
    return words.select("vw").join(counts, "vw", "left").select("vw", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def packed(coded: DataFrame, bits: int) -> DataFrame:
    """coded with `codes` as bytes: `bits` bits for each subspace, low bits first, the last byte filled with zeros."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                at = batch.schema.get_field_index("codes")
                codes = batch.column(at).flatten().to_numpy().reshape(batch.num_rows, -1)
                if codes.size and int(codes.max()) >> bits:
                    raise ValueError(f"a code does not fit {bits} bits")
                flags = (codes[:, :, None] >> np.arange(bits)) & 1
                rows = np.packbits(flags.reshape(len(codes), -1).astype(np.uint8), axis=1, bitorder="little")
                yield batch.set_column(at, "codes", pa.array([r.tobytes() for r in rows], pa.binary()))

    return coded.mapInArrow(run, T.StructType([T.StructField("codes", T.BinaryType()) if f.name == "codes" else f for f in coded.schema.fields]))


def unpacked(rows: DataFrame, subspaces: int, bits: int) -> DataFrame:
    """rows with `codes` as arrays again; see `packed`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                at = batch.schema.get_field_index("codes")
                body = np.frombuffer(b"".join(batch.column(at).to_pylist()), np.uint8).reshape(batch.num_rows, -1)
                flags = np.unpackbits(body, axis=1, bitorder="little")[:, : subspaces * bits].reshape(batch.num_rows, subspaces, bits)
                yield batch.set_column(at, "codes", lists((flags.astype(np.int32) << np.arange(bits, dtype=np.int32)).sum(2, dtype=np.int32), pa.int32()))

    return rows.mapInArrow(run, T.StructType([T.StructField("codes", T.ArrayType(T.IntegerType())) if f.name == "codes" else f for f in rows.schema.fields]))


def decoded(coded: DataFrame, pq: ProductQuantizer) -> DataFrame:
    """(vec_id, vec) of codes."""
    shared = coded.sparkSession.sparkContext.broadcast(pq)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                m = shared.value.decode(batch.column(1).flatten().to_numpy().reshape(batch.num_rows, -1))
                yield pa.RecordBatch.from_arrays([batch.column(0), lists(m, pa.float64())], ["vec_id", "vec"])

    return coded.select(F.col("vec_id").cast("long"), "codes").mapInArrow(run, "vec_id long, vec array<double>")


def code_kmeans(coded: DataFrame, pq: ProductQuantizer, k: int, rounds: int, start: list | None = None) -> DataFrame:
    """(vw, centroid, n): k-means of codes (vec_id, codes), whose vectors are made as they are read."""
    return clustering.kmeans(decoded(coded, pq), k, rounds, start=start)


def distance_scores(found: DataFrame, kind: int, sigma: float, k: int) -> DataFrame:
    """found (query_id, dqid, d2, ...) with `score` by one of the distance weights 0, 1, 2, 4, 5, 6, 8.

    0 and 1 fall linearly with the distance up to a threshold (of the query, of the query point); 2 is a
    Gaussian, 4 and 6 exponentials scaled by the largest or a low quantile of the point's squared
    distances, 5 a reciprocal, 8 exponentials that sum to one for each point. There is no weight 3.
    """
    d, point = F.col("d2"), Window.partitionBy("query_id", "dqid")
    most = F.max("d2").over(point)
    if kind == 0:
        score = 1 - F.sqrt(d) / F.sqrt((1 + sigma) * F.max("d2").over(Window.partitionBy("query_id")))
    elif kind == 1:
        score = 1 - F.sqrt(d) / F.sqrt(sigma * most)
    elif kind == 2:
        score = F.exp(-d / (4 * sigma * most))
    elif kind == 4:
        score = F.exp(-d / (most * sigma))
    elif kind == 5:
        score = 1 / (d + sigma)
    elif kind == 6:
        real = F.when(d > 1e-4, d)
        rank = F.when(d > 1e-4, F.row_number().over(point.orderBy(F.when(d > 1e-4, 0).otherwise(1), F.round("d2", 9), "vec_id")))
        found = found.withColumn("_r", rank).withColumn("_at", F.floor(F.count(real).over(point) * (k // 4) / k) + 1)
        found = found.withColumn("_t", F.max(F.when(F.col("_r") == F.col("_at"), d)).over(point))
        score = F.exp(-d / (F.col("_t") * sigma))
    elif kind == 8:
        found = found.withColumn("_e", F.when(d > 0, F.exp(-d / (most * sigma))).otherwise(0.0))
        score = F.try_divide(F.col("_e"), F.sum("_e").over(point))
    else:
        raise ValueError(f"no distance weight {kind}")
    return found.withColumn("score", score).drop("_r", "_at", "_t", "_e")
