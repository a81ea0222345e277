"""Clusterings of many groups in the same passes are those of each group alone, and cost no more jobs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import clustering, keyed
from tessera.operators import quantization as pq

SCHEMA = "grp long, vec_id long, vec array<double>"


def points(n=300, dim=6, groups=3, seed=3):
    rng = np.random.default_rng(seed)
    # the first group holds most of the points
    return [(int(0 if i % 3 else 1 + i % max(groups - 1, 1)), i, rng.normal(size=dim).tolist()) for i in range(n)]


@pytest.mark.parametrize("most", [65_536, 5])
def test_each_group_ends_as_alone(spark, most):
    rows = spark.createDataFrame(points(), SCHEMA).repartition(4)
    book, counts = keyed.kmeans(rows, 4, 6, max_broadcast=most)
    assert sorted(book) == [0, 1, 2]
    for g in book:
        alone = sorted(clustering.kmeans(rows.where(F.col("grp") == g).drop("grp"), 4, 6).collect(), key=lambda r: r["vw"])
        assert np.allclose(book[g], [r["centroid"] for r in alone])
        assert counts[g].tolist() == [r["n"] for r in alone]
    at = keyed.assign(rows, book, most).collect()
    assert len(at) == 300
    for r in at:
        d = ((book[r["grp"]] - np.array(r["vec"])) ** 2).sum(1)
        assert d[r["cell"]] <= d.min() + 1e-9


def test_rows_of_every_kind(spark):
    same = [1.0, 2.0]
    rows = [(1, i, same) for i in range(6)] + [(2, 10, [0.0, 0.0]), (None, 11, same), (1, 12, None), (1, 13, [float("nan"), 0.0]), (2, 10, [0.0, 0.0]), (3, None, same), (3, None, [0.0, 0.0])]
    book, counts = keyed.kmeans(spark.createDataFrame(rows, SCHEMA), 3, 2)
    assert counts[1].tolist() == [6, 0, 0] and len(book[1]) == 3  # equal points fill one cell, the others are splits of it
    assert np.allclose(book[1], same, rtol=1e-4)
    assert len(book[2]) == 2 and counts[2].sum() == 2
    assert counts[3].sum() == 2  # points without id are points
    empty = spark.createDataFrame([], SCHEMA)
    assert keyed.kmeans(empty, 3, 2) == ({}, {})
    assert keyed.assign(empty, {}).count() == 0
    assert keyed.assign(spark.createDataFrame(rows, SCHEMA), {1: book[1]}).count() == 6


def jobs(spark, run) -> int:
    name = f"jobs-{np.random.randint(1 << 30)}"
    spark.sparkContext.setJobGroup(name, name)
    run()
    spark.sparkContext.setJobGroup("", "")
    return len(spark.sparkContext.statusTracker().getJobIdsForGroup(name))


def test_jobs_do_not_grow_with_the_groups(spark):
    rows = spark.createDataFrame([r[1:] for r in points(400, 8)], "vec_id long, vec array<double>")
    few, many = (jobs(spark, lambda b=b: clustering.hierarchical_kmeans(rows, b, 2, 2).count()) for b in (2, 6))
    assert few == many
    few, many = (jobs(spark, lambda q=q: pq.learn(rows, q, 3, 2)) for q in (2, 8))
    assert few == many


def test_best_start(spark):
    rows = spark.createDataFrame([r[1:] for r in points(200, 4)], "vec_id long, vec array<double>")
    best = np.array([r["centroid"] for r in clustering.best_kmeans(rows, 5, 3, 4).orderBy("vw").collect()])
    m = np.array([r["vec"] for r in rows.collect()])
    cost = lambda c: ((m[:, None] - c[None]) ** 2).sum(2).min(1).sum()
    alone = [np.array([r["centroid"] for r in clustering.kmeans(rows, 5, 3, salt=str(i)).orderBy("vw").collect()]) for i in range(4)]
    assert np.isclose(cost(best), min(cost(c) for c in alone))


def test_tree_is_that_of_each_parent_alone(spark):
    rows = spark.createDataFrame([r[1:] for r in points(200, 4)], "vec_id long, vec array<double>")
    tree = clustering.hierarchical_kmeans(rows, 3, 2, 3).collect()
    top = np.array([r["centroid"] for r in sorted(tree, key=lambda r: r["child"]) if r["level"] == 0])
    own = [(r["vec_id"], r["vec"]) for r in rows.collect()]
    of = {i: int(((top - np.array(x)) ** 2).sum(1).argmin()) for i, x in own}
    for parent in range(3):
        alone = clustering.kmeans(rows.where(F.col("vec_id").isin([i for i in of if of[i] == parent])), 3, 3).orderBy("vw").collect()
        found = sorted((r for r in tree if r["level"] == 1 and r["parent"] == parent), key=lambda r: r["child"])
        assert np.allclose([r["centroid"] for r in found], [r["centroid"] for r in alone])
