"""Learning of inverted lists of codes over all points: which components a subspace takes, and what lists and codes are made of.

All of it is passes over the points that leave a model of bounded size: a covariance (the square of the
dimension), the centroids of the lists, and the cells of each subspace.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import vectors as v
from tessera.operators import clustering, knn
from tessera.operators import quantization as pq


@dataclass(frozen=True)
class ListModel:
    """order: of the components. centroids: of the lists, as they are used. codes: of these centroids where a product code makes them."""

    order: list[int]
    centroids: np.ndarray
    quantizer: pq.ProductQuantizer
    relative: bool
    codes: np.ndarray | None = None

    def codebook(self, spark) -> DataFrame:
        return spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(self.centroids)], "vw long, centroid array<double>")


def component_order(points: DataFrame, subspaces: int) -> list[int]:
    """The components subspace by subspace, each with those that are most correlated with one another.

    A code of a subspace spends its cells on what its components share, so the error falls. Every subspace
    starts with the free component of the largest variance and takes, one by one, the free component with
    the largest sum of squared correlations to those it has (ties: the smaller number).
    """
    rows = clustering.covariance(points).collect()  # the square of the dimension
    d = max(r["i"] for r in rows) + 1
    if d % subspaces:
        raise ValueError(f"{subspaces} subspaces do not divide {d} components")
    c = np.zeros((d, d))
    for r in rows:
        c[r["i"], r["j"]] = r["c"]
    variance = np.diag(c).clip(min=0)
    scale = np.sqrt(np.outer(variance, variance))
    shared = np.divide(c, scale, out=np.zeros_like(c), where=scale > 0) ** 2
    free, order = list(range(d)), []
    for _ in range(subspaces):
        own = [max(free, key=lambda i: (round(variance[i], 12), -i))]
        free.remove(own[0])
        while len(own) < d // subspaces:
            own.append(max(free, key=lambda i: (round(shared[i, own].sum(), 12), -i)))
            free.remove(own[-1])
        order += own
    return order


def reordered(points: DataFrame, order: list[int]) -> DataFrame:
    """points with the components of vec in another order; distances stay as they are."""
    return points.withColumn("vec", F.transform(F.array(*[F.lit(i) for i in order]), lambda i: F.get("vec", i)))


def coded_centroids(centroids: DataFrame, quantizer: pq.ProductQuantizer) -> tuple[np.ndarray, np.ndarray]:
    """Codes of a codebook's centroids and what they stand for, in order of vw: lists that are named by a product code."""
    m = np.array([r["centroid"] for r in sorted(centroids.collect(), key=lambda r: r["vw"])], np.float64)
    codes = quantizer.encode(m)
    return codes, quantizer.decode(codes)


def learn(points: DataFrame, n: int, subspaces: int, cells: int, rounds: int = 10, relative: bool = True, coarse_cells: int | None = None, order: bool = True) -> ListModel:
    """A model of n lists, learned on all points (vec_id, vec).

    relative: codes are of residuals to the list's centroid, and of the vectors otherwise. coarse_cells:
    the centroids are themselves product codes with so many cells a subspace (n or fewer), so that a
    codebook of any size is its codes. order: components are reordered first, by `component_order`.
    """
    spark = points.sparkSession
    placed = component_order(points, subspaces) if order else list(range(len(points.select("vec").first()["vec"])))
    points = reordered(points.select("vec_id", "vec"), placed)
    found = clustering.kmeans(points, n, rounds)
    codes, centroids = None, np.array([r["centroid"] for r in sorted(found.collect(), key=lambda r: r["vw"])])
    if coarse_cells is not None:
        book = found.select(F.col("vw").alias("vec_id"), F.col("centroid").alias("vec"))
        codes, centroids = coded_centroids(found, pq.learn(book, subspaces, coarse_cells, rounds))
    model = ListModel(placed, centroids, None, relative, codes)
    if relative:
        book = model.codebook(spark)
        near = knn.nearest(points, book).join(F.broadcast(book.withColumnRenamed("vw", "centroid_id")), "centroid_id")  # a codebook of the given size
        points = near.select("vec_id", F.zip_with("vec", "centroid", lambda x, y: x - y).alias("vec"))
    return ListModel(placed, centroids, pq.learn(points, subspaces, cells, rounds), relative, codes)


def build(points: DataFrame, model: ListModel, spill: int = 1) -> DataFrame:
    """(vw, block, of, n, ids, codes): the lists of points (vec_id, vec) in blocks, as searches take them."""
    own = reordered(points.select("vec_id", "vec"), model.order)
    return pq.list_blocks(pq.build_lists(own, model.codebook(points.sparkSession), model.quantizer, spill, model.relative))


def search(queries: DataFrame, blocks: DataFrame, model: ListModel, probes: int, k: int) -> DataFrame:
    """(query_id, vec_id, d2, rnk): the k nearest codes of each query (query_id, vec) in its nearest lists."""
    own = reordered(queries.select("query_id", "vec"), model.order)
    return pq.nearest_codes(pq.probed_blocks(own, blocks, model.codebook(queries.sparkSession), probes, relative=model.relative), model.quantizer, k)


def search_reranked(queries: DataFrame, points: DataFrame, blocks: DataFrame, model: ListModel, probes: int, short: int, k: int) -> DataFrame:
    """(query_id, vec_id, d2, rnk): the k nearest by exact distance among the `short` nearest codes of each query."""
    coarse = search(queries, blocks, model, probes, short).select("query_id", "vec_id")
    both = coarse.join(points.select("vec_id", "vec"), "vec_id").join(queries.select("query_id", F.col("vec").alias("asked")), "query_id")
    return pq.nearest(both.select("query_id", "vec_id", v.distance_l2_squared(F.col("asked"), F.col("vec")).alias("d2")), k)


def error(points: DataFrame, model: ListModel) -> float:
    """The mean squared distance of a point to what its list and code stand for."""
    own = reordered(points.select("vec_id", "vec"), model.order)
    book = model.codebook(points.sparkSession).select(F.col("vw").alias("centroid_id"), "centroid")
    near = knn.nearest(own, book).join(F.broadcast(book), "centroid_id")
    rest = near.select("vec_id", F.zip_with("vec", "centroid", lambda x, y: x - y).alias("vec")) if model.relative else own
    left = pq.residuals(rest, model.quantizer)
    return left.agg(F.avg(F.aggregate("vec", F.lit(0.0), lambda a, x: a + x * x))).first()[0]
