"""Hamming embedding: projections, medians by word and bit, and 64-bit binary signatures."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions import vectors as v
from tessera.operators.knn import matrix
from tessera.operators.medians import group_medians


def hadamard(n: int) -> np.ndarray:
    """Orthogonal basis of n rows, a power of two: entry (-1) ** popcount(i & j) / sqrt(n)."""
    h = np.ones((1, 1))
    while len(h) < n:
        h = np.block([[h, h], [h, -h]])
    return h / np.sqrt(n)


def random_orthogonal(n: int, seed: int) -> np.ndarray:
    """The Q of a Gaussian matrix, its signs fixed by R."""
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((n, n)))
    return q * np.sign(np.diag(r))


def whitened_basis(components: DataFrame, n: int, seed: int) -> np.ndarray:
    """n rows: a random rotation of the principal directions, each divided by the root of its eigenvalue.

    components: (component, value, vector) of `clustering.principal_components`, n of them at least.
    """
    rows = sorted(components.collect(), key=lambda r: r["component"])[:n]  # n vectors of one dimension
    scaled = np.array([np.array(r["vector"]) / np.sqrt(max(r["value"], 1e-12)) for r in rows])
    return random_orthogonal(n, seed) @ scaled


def crop(projected: DataFrame, n: int, column: str = "proj") -> DataFrame:
    """projected (or medians) with the first n components only."""
    return projected.withColumn(column, F.slice(column, 1, n))


def project(points: DataFrame, basis: np.ndarray, digits: int = 9) -> DataFrame:
    """points with `proj` = basis . vec, rounded so that a later comparison doesn't hang on the last bit."""
    at = points.columns.index("vec")
    schema = T.StructType([*points.schema.fields, T.StructField("proj", T.ArrayType(T.DoubleType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                p = np.round(matrix(batch.column(at)) @ basis.T, digits) + 0.0
                offsets = pa.array(np.arange(0, p.size + 1, p.shape[1], dtype=np.int32))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.ListArray.from_arrays(offsets, pa.array(p.ravel()))], schema.names)

    return points.mapInArrow(run, schema)


def medians(projected: DataFrame, words: DataFrame | None = None, hold: int = 1 << 16) -> DataFrame:
    """(vw, medians): of each word the median of every projected component over all its points, the mean of the middle two.

    Exact at every size; see `medians.group_medians` for `hold`. projected is read several times. Words
    without points have no row, or a null where `words` lists them; a signature takes that as zeros.
    """
    found = group_medians(projected, "vw", "proj", hold)
    if words is None:
        return found
    return words.select("vw").distinct().join(found, "vw", "left")


def near_signatures(queries: DataFrame, points: DataFrame, most: int, block: int = 4096) -> DataFrame:
    """(a, b, hd): the points (vec_id, binsign) whose signatures differ from a query's in `most` bits or fewer.

    Each block of points stays in its task; the queries, the smaller side, go to every block in blocks.
    """

    def blocks(rows: DataFrame) -> tuple[DataFrame, int]:
        n = max(1, -(-rows.count() // block))
        dealt = rows.select(F.pmod(F.xxhash64("vec_id"), F.lit(n)).alias("block"), "vec_id", "binsign")
        return dealt.groupBy("block").agg(F.collect_list(F.struct("vec_id", "binsign")).alias("rows")), n  # about `block` rows

    (q, _), (p, n) = blocks(queries), blocks(points)
    asked = q.select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))).alias("block"), F.col("rows").alias("asked"))
    pairs = p.join(asked, "block").select("rows", F.explode("asked").alias("q")).select("q", F.explode("rows").alias("p"))
    hd = v.hamming(F.col("q.binsign"), F.col("p.binsign"))
    return pairs.where(hd <= most).select(F.col("q.vec_id").alias("a"), F.col("p.vec_id").alias("b"), hd.cast("int").alias("hd"))


def signatures(projected: DataFrame, medians_: DataFrame, first: int = 0) -> DataFrame:
    """projected with binsign: bit j is set if component first + j is at least its word's median (0 without one); 64 bits at most."""
    joined = projected.join(medians_, "vw", "left")
    bits = F.slice(F.col("proj"), first + 1, 64)
    marks = F.zip_with(bits, F.slice(F.coalesce("medians", F.transform("proj", lambda x: F.lit(0.0))), first + 1, 64), lambda p, m: p >= m)
    # two's complement: the pattern of the bits, whatever its sign
    sign = F.aggregate(F.transform(marks, lambda b, j: F.when(b, F.call_function("shiftleft", F.lit(1).cast("long"), j)).otherwise(F.lit(0).cast("long"))), F.lit(0).cast("long"), lambda a, b: a.bitwiseOR(b))
    return joined.withColumn("binsign", sign).drop("medians")


def wide_signatures(projected: DataFrame, medians_: DataFrame, n_bits: int) -> DataFrame:
    """Signatures of more than 64 bits, as arrays of longs; a word without medians has zeros."""
    joined = projected.join(medians_, "vw", "left")
    joined = joined.withColumn("medians", F.coalesce("medians", F.transform("proj", lambda x: F.lit(0.0))))
    words = []
    for low in range(0, n_bits, 64):
        size = min(64, n_bits - low)
        marks = F.zip_with(F.slice("proj", low + 1, size), F.slice("medians", low + 1, size), lambda p, m: p >= m)
        words.append(F.aggregate(F.transform(marks, lambda b, j: F.when(b, F.call_function("shiftleft", F.lit(1).cast("long"), j)).otherwise(F.lit(0).cast("long"))), F.lit(0).cast("long"), lambda a, b: a.bitwiseOR(b)))
    return joined.withColumn("binsigns", F.array(*words)).drop("medians")
