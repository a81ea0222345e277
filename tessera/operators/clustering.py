"""k-means and its relatives as aggregations; only centroids, whose number is a parameter, reach the driver."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators import keyed, knn


def subset(rows: DataFrame, key: str, n: int, salt: str = "") -> DataFrame:
    """n rows without replacement, by the order of a hash of their key. This is a sampling operator."""
    return rows.orderBy(F.md5(F.concat(F.lit(salt), F.col(key).cast("string"))), key).limit(n)


def kmeans_step(points: DataFrame, centroids: DataFrame) -> DataFrame:
    """(id, centroid, n): the means of the points nearest to each centroid; sums are made within each batch first."""
    name = centroids.columns[0]
    near = knn.nearest(points, centroids.select(F.col(name), "centroid")).select("vec", "centroid_id")

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, list] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            m, ids = knn.matrix(batch.column(0)), batch.column(1).to_numpy()
            for i in np.unique(ids).tolist():
                own = m[ids == i]
                old = sums.get(i)
                sums[i] = [own.sum(0) + (old[0] if old else 0), len(own) + (old[1] if old else 0)]
        rows = [(i, j, float(x), n) for i, (s, n) in sums.items() for j, x in enumerate(s)]
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int64(), pa.int32(), pa.float64(), pa.int64()))], ["id", "j", "s", "n"])

    sums = near.mapInArrow(partial, "id long, j int, s double, n long").groupBy("id", "j").agg(F.sum("s").alias("s"), F.sum("n").alias("n"))
    means = sums.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("j", (F.col("s") / F.col("n")).alias("m")))).alias("c"), F.max("n").alias("n"))
    return means.select(F.col("id").alias(name), F.transform("c", lambda x: x["m"]).alias("centroid"), "n")


def kmeans(points: DataFrame, k: int, rounds: int = 20, tolerance: float = 1e-9, salt: str = "", start: list | None = None) -> DataFrame:
    """(vw, centroid, n) after Lloyd rounds from k points chosen by hash, or from the vectors `start`; an empty cell is re-seeded from a split of the largest."""
    spark = points.sparkSession
    rows = [(i, list(c)) for i, c in enumerate(start if start is not None else (r["vec"] for r in subset(points, "vec_id", k, salt).collect()))]
    for _ in range(rounds):
        table = spark.createDataFrame(rows, "vw long, centroid array<double>")
        found = {r["vw"]: r for r in kmeans_step(points, table).collect()}
        new = []
        for i, old in rows:
            if i in found:
                new.append((i, found[i]["centroid"], found[i]["n"]))
            else:
                big = max(found.values(), key=lambda r: (r["n"], -r["vw"]))
                new.append((i, [x * (1 + 1e-5 * (-1) ** j) for j, x in enumerate(big["centroid"])], 0))
        moved = max(float(np.abs(np.array(a[1]) - np.array(b[1])).max()) for a, b in zip(new, rows, strict=True))
        rows = [(i, list(c)) for i, c, _ in new]
        if moved <= tolerance:
            break
    return spark.createDataFrame([(i, c, n) for i, c, n in new], "vw long, centroid array<double>, n long")


def best_kmeans(points: DataFrame, k: int, rounds: int, starts: int) -> DataFrame:
    """The result of the start, out of several, with the least sum of squared distances (the first of equals); a round is one pass for all starts."""
    every = points.select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(starts - 1).cast("long"))).alias("grp"), "vec_id", "vec")
    book, counts = keyed.kmeans(every, k, rounds, salt=F.col("grp").cast("string"))
    cost = keyed.costs(every, book)
    best = min(book, key=lambda g: (cost[g], g))
    return keyed.table(points.sparkSession, {best: book[best]}, counts).drop("grp")


def hierarchical_kmeans(points: DataFrame, branch: int, levels: int, rounds: int) -> DataFrame:
    """(level, parent, child, centroid, n): every cell of a level is split by k-means of its own points, all of a level in the same passes.

    A point's cell is found by going down the tree in each pass, so that nothing but the tree is kept
    between levels. A level has branch ** level parents, a parameter.
    """
    out, cells = None, points.select("vec_id", "vec", F.lit(0).cast("long").alias("grp"))
    for level in range(levels):
        book, counts = keyed.kmeans(cells, branch, rounds)
        rows = keyed.table(points.sparkSession, book, counts).select(F.lit(level).alias("level"), F.col("grp").alias("parent"), F.col("vw").alias("child"), "centroid", "n")
        out = rows if out is None else out.unionByName(rows)
        cells = keyed.assign(cells, book).select("vec_id", "vec", (F.col("grp") * branch + F.col("cell")).alias("grp"))
    return out


def balance_step(counts: DataFrame, dim: int) -> DataFrame:
    """(vw, factor): cells with more than their share of n points get a factor above 1 on squared distances."""
    total = counts.agg((F.sum("n") / F.count("*")).alias("share"))
    return counts.crossJoin(F.broadcast(total)).select("vw", F.pow(F.col("n") / F.col("share"), F.lit(0.5 / dim**0.5)).alias("factor"))  # one row


def balance_factors(points: DataFrame, centroids: DataFrame, rounds: int = 60, additive: bool = False) -> DataFrame:
    """(vw, factor) after rounds of assignment under the factors so far; an empty cell counts as one of one point.

    Factors multiply the squared distances, by (n / share) ** (0.5 / sqrt(dim)) a round; additive ones are
    added, and grow by the cell's mean distance times (n / share) ** (0.2 / sqrt(dim)) - 1. A round is one
    pass, of which a row for each centroid comes to the driver.
    """
    name = centroids.columns[0]
    rows = sorted(centroids.select(F.col(name).cast("long").alias("vw"), "centroid").collect(), key=lambda r: r["vw"])
    power = (0.2 if additive else 0.5) / len(rows[0]["centroid"]) ** 0.5
    factor = {r["vw"]: 0.0 if additive else 1.0 for r in rows}
    for _ in range(rounds):
        book = points.sparkSession.createDataFrame([(r["vw"], r["centroid"], factor[r["vw"]]) for r in rows], f"vw long, centroid array<double>, {'offset' if additive else 'weight'} double")
        found = {r["centroid_id"]: r for r in knn.nearest(points.select("vec"), book).groupBy("centroid_id").agg(F.count("*").alias("n"), F.avg("d2").alias("d")).collect()}
        share = sum(r["n"] for r in found.values()) / len(rows)
        for vw in factor:
            grown = ((found[vw]["n"] if vw in found else 1) / share) ** power
            factor[vw] = factor[vw] + (found[vw]["d"] if vw in found else 0.0) * (grown - 1) if additive else factor[vw] * grown
    return points.sparkSession.createDataFrame(sorted(factor.items()), "vw long, factor double")


def kmedoids(points: DataFrame, candidates: DataFrame, medoids: list[int], rounds: int) -> list[int]:
    """Medoids after rounds of swaps: round r tries to replace medoid r (modulo their number) by the candidate that lowers the cost most.

    candidates: a bounded set (id, centroid) that holds the first medoids. A swap that doesn't lower the
    sum of squared distances is not made; among equals the smallest id enters. It ends when no medoid can
    be replaced.
    """
    medoids, stuck = list(medoids), 0
    for r in range(rounds):
        slot = r % len(medoids)
        best = medoid_swaps(points, candidates, medoids, medoids[slot]).orderBy(F.round("change", 9), "candidate").first()
        if best is not None and best["change"] < -1e-9:
            medoids[slot], stuck = best["candidate"], 0
        else:
            stuck += 1
            if stuck == len(medoids):
                break
    return medoids


def distance_corrections(centroids: DataFrame, k: int, alpha: float, rounds: int) -> DataFrame:
    """(vw, factor) of contextual dissimilarity among centroids (vw, centroid), a bounded set.

    A round takes each centroid's k nearest ones under squared factors (itself included), r as the mean of
    the root of these distances times its own factor, and multiplies its factor by (geometric mean of r / r) ** alpha.
    """
    spark = centroids.sparkSession
    rows = sorted(centroids.collect(), key=lambda r: r["vw"])
    points = spark.createDataFrame([(r["vw"], r["centroid"]) for r in rows], "vec_id long, vec array<double>")
    factor = {r["vw"]: 1.0 for r in rows}
    for _ in range(rounds):
        book = spark.createDataFrame([(r["vw"], r["centroid"], factor[r["vw"]] ** 2) for r in rows], "vw long, centroid array<double>, weight double")
        near = knn.nearest(points, book, k).groupBy("vec_id").agg(F.avg(F.sqrt("d2")).alias("r")).collect()
        r = {x["vec_id"]: x["r"] * factor[x["vec_id"]] for x in near}
        mean = float(np.exp(np.mean(np.log(list(r.values())))))
        factor = {vw: f * (mean / r[vw]) ** alpha for vw, f in factor.items()}
    return spark.createDataFrame(sorted(factor.items()), "vw long, factor double")


def pruned_kmeans(points: DataFrame, start: list, rounds: int, store) -> DataFrame:
    """(vw, centroid, n): Lloyd rounds from the vectors `start` with bounds by the triangle inequality, the same result with fewer distances.

    Every point keeps its cell, an upper bound of the distance to it and a lower one to each centroid. A
    round moves the bounds by how far centroids went, and computes only distances that they leave open.
    store(df, name) writes the points' state (the bounds) and reads it again.
    """
    spark = points.sparkSession
    centroids = np.array(start, np.float64)
    k = len(centroids)
    state = points.select("vec", F.lit(0).alias("cell"), F.lit(float("inf")).alias("upper"), F.array_repeat(F.lit(0.0), k).alias("lower"))
    moved, counts = np.zeros(k), np.zeros(k, np.int64)
    for _ in range(rounds):
        shared = spark.sparkContext.broadcast((centroids, moved))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            c, moved = shared.value
            apart = np.sqrt(knn.distances(c, c))
            near = np.where(np.eye(len(c), dtype=bool), np.inf, apart).min(1) / 2
            for batch in batches:
                if not batch.num_rows:
                    continue
                m, cell = knn.matrix(batch.column(0)), batch.column(1).to_numpy().copy()
                upper, lower = batch.column(2).to_numpy() + moved[cell], np.maximum(knn.matrix(batch.column(3)) - moved, 0)
                open_ = np.flatnonzero(upper > near[cell])
                upper[open_] = np.sqrt(((m[open_] - c[cell[open_]]) ** 2).sum(1))
                lower[open_, cell[open_]] = upper[open_]
                for j in range(len(c)):
                    at = open_[(cell[open_] != j) & (upper[open_] > lower[open_, j]) & (upper[open_] > apart[cell[open_], j] / 2)]
                    d = np.sqrt(((m[at] - c[j]) ** 2).sum(1))
                    lower[at, j] = d
                    better = (d < upper[at]) | ((d == upper[at]) & (j < cell[at]))
                    cell[at[better]], upper[at[better]] = j, d[better]
                offsets = pa.array(np.arange(0, lower.size + 1, lower.shape[1], dtype=np.int32))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(cell, pa.int32()), pa.array(upper), pa.ListArray.from_arrays(offsets, pa.array(lower.ravel()))], ["vec", "cell", "upper", "lower"])

        state = store(state.mapInArrow(run, "vec array<double>, cell int, upper double, lower array<double>"), "bounds")
        sums = state.select("cell", F.posexplode("vec").alias("j", "x")).groupBy("cell", "j").agg(F.avg("x").alias("x"), F.count("*").alias("n")).collect()
        new, counts = centroids.copy(), np.zeros(k, np.int64)
        for r in sums:
            new[r["cell"], r["j"]], counts[r["cell"]] = r["x"], r["n"]
        moved = np.sqrt(((new - centroids) ** 2).sum(1)) * (1 + 1e-12)
        centroids = new
        if not moved.any():
            break
    return spark.createDataFrame([(i, c.tolist(), int(n)) for i, (c, n) in enumerate(zip(centroids, counts, strict=True))], "vw long, centroid array<double>, n long")


def medoid_swaps(points: DataFrame, candidates: DataFrame, medoids: list[int], leaving: int) -> DataFrame:
    """(candidate, change): how the sum of squared distances to the nearest medoid changes if `leaving` is replaced."""
    d = knn.cross_distances(points, candidates).select("vec_id", F.col("centroid_id").alias("id"), "d2")
    inside = F.col("id").isin(medoids)
    cost = d.groupBy("vec_id").agg(F.min(F.when(inside, F.col("d2"))).alias("now"), F.min(F.when(inside & (F.col("id") != leaving), F.col("d2"))).alias("kept"))
    others = d.where(~inside).join(cost, "vec_id")
    return others.groupBy(F.col("id").alias("candidate")).agg(F.sum(F.least(F.col("kept"), F.col("d2")) - F.col("now")).alias("change"))


def distance_correction(distances: DataFrame, k: int, alpha: float) -> DataFrame:
    """(vw, factor): (geometric mean of r / r) ** alpha, r being the mean distance to a centroid's k nearest points."""
    w = Window.partitionBy("vw").orderBy("d2", "vec_id")
    r = distances.withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= k).groupBy("vw").agg(F.avg("d2").alias("r"))
    mean = r.agg(F.exp(F.avg(F.ln("r"))).alias("g"))
    return r.crossJoin(F.broadcast(mean)).select("vw", F.pow(F.col("g") / F.col("r"), F.lit(alpha)).alias("factor"))  # one row


def covariance(points: DataFrame) -> DataFrame:
    """(i, j, c): E[x_i x_j] - E[x_i] E[x_j]; each batch gives one matrix of sums."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        second = first = None
        n = 0
        for batch in batches:
            if batch.num_rows:
                m = knn.matrix(batch.column(0))
                second = m.T @ m + (0 if second is None else second)
                first = m.sum(0) + (0 if first is None else first)
                n += len(m)
        if n:
            d = len(first)
            i, j = (x.ravel() for x in np.indices((d, d)))
            yield pa.RecordBatch.from_arrays([pa.array(i, pa.int64()), pa.array(j, pa.int64()), pa.array(second.ravel()), pa.array(first[i]), pa.array(first[j]), pa.array(np.full(d * d, n), pa.int64())], ["i", "j", "s", "a", "b", "n"])

    sums = points.select("vec").mapInArrow(partial, "i long, j long, s double, a double, b double, n long").groupBy("i", "j").agg(*[F.sum(c).alias(c) for c in "sabn"])
    return sums.select("i", "j", (F.col("s") / F.col("n") - F.col("a") / F.col("n") * (F.col("b") / F.col("n"))).alias("c"))


def principal_components(points: DataFrame, k: int) -> DataFrame:
    """(component, value, vector) of the covariance, the largest eigenvalue first; each vector's largest entry is positive."""
    rows = covariance(points).collect()  # the square of the dimension
    d = max(r["i"] for r in rows) + 1
    m = np.zeros((d, d))
    for r in rows:
        m[r["i"], r["j"]] = r["c"]
    values, vectors = np.linalg.eigh(m)
    out = []
    for c, i in enumerate(np.argsort(-values)[:k]):
        x = vectors[:, i]
        x = x * np.sign(x[np.abs(x).argmax()])
        out.append((c, float(values[i]), x.tolist()))
    return points.sparkSession.createDataFrame(out, "component int, value double, vector array<double>")


def lsh_neighbours(points: DataFrame, centroids: DataFrame, width: float = 0.5, tables: int = 6, seed: int = 666) -> DataFrame:
    """(vec_id, centroid_id, d): the nearest centroid among those that share a bucket of random projections, if any does."""
    from pyspark.ml.feature import BucketedRandomProjectionLSH
    from pyspark.ml.functions import array_to_vector

    model = BucketedRandomProjectionLSH(inputCol="v", outputCol="h", bucketLength=width, numHashTables=tables, seed=seed)
    a = points.select("vec_id", array_to_vector("vec").alias("v"))
    b = centroids.select(F.col(centroids.columns[0]).alias("centroid_id"), array_to_vector("centroid").alias("v"))
    pairs = model.fit(a).approxSimilarityJoin(a, b, float("inf"), "d")
    best = pairs.groupBy(F.col("datasetA.vec_id").alias("vec_id")).agg(F.min(F.struct("d", F.col("datasetB.centroid_id").alias("centroid_id"))).alias("b"))
    return best.select("vec_id", "b.centroid_id", "b.d")
