"""Queries that do a whole job, against brute force: every id divisible by 20 against all rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import geometry, hamming, quantization
from tessera.plans import QUERIES, fixtures, quantized, whole

SF = "/root/testdata/sf0.001"


def vectors(spark, sf=SF):
    rows = sorted(fixtures.descriptors(spark, sf).select("vec_id", "vec").collect())
    return np.array([r["vec_id"] for r in rows]), np.array([r["vec"] for r in rows])


def squared(a, b):
    return ((a[:, None] - b[None]) ** 2).sum(2)


@pytest.mark.parametrize("name", ["ivfpq_reranked", "ivfpq_learned", "pq_reranked"])
@pytest.mark.parametrize("sf", [SF, "/root/testdata/sf0.1"])
def test_recall_of_approximate_search(spark, name, sf):
    ids, m = vectors(spark, sf)
    asked = ids[ids % 20 == 0]
    near = ids[np.argsort(squared(m[ids % 20 == 0], m), 1, kind="stable")[:, :10]]
    got = {}
    for r in QUERIES[name](spark, sf).collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    assert sorted(got) == asked.tolist() and all(len(x) == 10 for x in got.values())
    recall = np.mean([len(got[q] & set(x)) / 10 for q, x in zip(asked.tolist(), near.tolist(), strict=True)])
    print(name, sf, "recall@10", recall)
    assert recall >= 0.9


def test_a_search_reads_the_probed_lists_only(spark):
    queries, points, blocks, book, model = quantized.reranked(spark, SF, 3)
    sizes = {r["vw"]: r["n"] for r in blocks.groupBy("vw").agg(F.sum("n").alias("n")).collect()}
    assert sum(sizes.values()) == 3 * points.count()
    centroids = {r["vw"]: np.array(r["centroid"]) for r in book.collect()}
    for r in queries.where("query_id in (0, 40)").collect():
        near = sorted(centroids, key=lambda c: (((np.array(r["vec"]) - centroids[c]) ** 2).sum(), c))[:16]
        one = queries.where(F.col("query_id") == r["query_id"])
        read = quantization.probed_blocks(one, blocks, book, 16)
        assert {x["vw"] for x in read.select("vw").collect()} == set(near) & set(sizes)
        assert read.agg(F.sum("n")).first()[0] == sum(sizes.get(c, 0) for c in near) < 0.7 * sum(sizes.values())
    # small blocks of codes and of queries give the same
    cut = quantization.list_blocks(quantization.build_lists(points, book, model, 3), 4)
    assert cut.count() > blocks.count() and cut.agg(F.max("n")).first()[0] < 30
    same = [sorted(map(tuple, quantization.nearest_codes(quantization.probed_blocks(queries, b, book, 16, n), model, 30).collect())) for b, n in ((blocks, 1024), (cut, 2))]
    assert same[0] == same[1]


def test_pruned_search_with_fewer_codes_than_asked_for(spark):
    points = spark.createDataFrame([(0, [0.0, 0.0]), (1, [1.0, 0.0]), (2, [9.0, 9.0]), (3, None)], "vec_id long, vec array<double>")
    book = spark.createDataFrame([(0, [0.0, 0.0]), (1, [9.0, 9.0])], "vw long, centroid array<double>")
    model = quantization.from_rows([np.array([0.0, 0.0]), np.array([1.0, 0.0])], 1)
    blocks = quantization.list_blocks(quantization.build_lists(points, book, model))
    found = quantization.search_reranked(points.withColumnRenamed("vec_id", "query_id"), points, blocks, book, model, 1, 5, 5)
    assert sorted((r["query_id"], r["vec_id"], r["rnk"]) for r in found.collect()) == [(0, 0, 1), (0, 1, 2), (1, 0, 2), (1, 1, 1), (2, 2, 1)]


@pytest.mark.parametrize("sf", [SF, "/root/testdata/sf0.1"])
def test_recall_of_two_level_assignment(spark, sf):
    exact = QUERIES["assign_1nn"](spark, sf).withColumnRenamed("vw", "exact")
    both = QUERIES["ann_assign"](spark, sf).join(exact, "vec_id")
    recall = both.agg(F.avg((F.col("leaf") == F.col("exact")).cast("double"))).first()[0]
    print(sf, "recall@1 of ann_assign", recall)
    assert both.count() == exact.count() and recall >= 0.9


@pytest.mark.parametrize("block", [7, 4096])
def test_near_signatures(spark, block):
    rng = np.random.default_rng(5)
    signs = [int(x) for x in rng.integers(-(2**63), 2**63, 60)]
    signs += [x ^ int(b) for x, b in zip(signs[:20], rng.integers(0, 4096, 20), strict=True)]
    p = spark.createDataFrame(list(enumerate(signs)), "vec_id long, binsign long")
    got = hamming.near_signatures(p.where("vec_id % 3 = 0"), p, 26, block).collect()
    want = [(a, b, n) for a, x in enumerate(signs) if a % 3 == 0 for b, y in enumerate(signs) if (n := bin((x ^ y) & (2**64 - 1)).count("1")) <= 26]
    assert sorted(map(tuple, got)) == want


def test_videos_are_verified_jointly(spark):
    rng = np.random.default_rng(3)
    rows = []
    for i, (x, y) in enumerate(rng.uniform(0, 300, (12, 2)).tolist()):  # half of a map's matches in either frame
        rows.append((0, 100 + i % 2, i, i, 1.0, x, y, 2.0, 0.3, 1.05 * x + 15, 1.05 * y - 10, 2.1, 0.3))
    for i in range(12):  # chance matches, in the same video and in another
        x, y, u, w = rng.uniform(0, 900, 4).tolist()
        rows.append((0, 102 if i % 2 else 777, i, 50 + i, 1.0, x, y, 2.0, 0.3, u, w, 3.1 + i, 0.3 + i / 5))
    m = spark.createDataFrame(rows, "query_id long, image_id long, qpt long, dbpt long, score double, qx double, qy double, qscale double, qangle double, x double, y double, scale double, angle double")
    found = geometry.joint_inliers(m, F.floor(F.col("image_id") / 10))
    assert sorted((r["grp"], r["image_id"], r["dbpt"]) for r in found.collect()) == sorted((10, 100 + i % 2, i) for i in range(12))
    points = m.select(F.floor(F.col("image_id") / 10).alias("grp"), "x", "y")
    box, = whole.bbox_counts(found, points).collect()
    planted = np.array([r[9:11] for r in rows[:12]])
    assert np.allclose([box["x0"], box["x1"], box["y0"], box["y1"]], [planted[:, 0].min(), planted[:, 0].max(), planted[:, 1].min(), planted[:, 1].max()])
    assert box["n"] == sum(r[1] // 10 == 10 and box["x0"] <= r[9] <= box["x1"] and box["y0"] <= r[10] <= box["y1"] for r in rows)


def test_angles_are_those_of_inliers(spark):
    hist = {r["bin"]: r["n"] for r in QUERIES["inlier_angle_hist"](spark, SF).collect()}
    assert sum(hist.values()) == sum(r["nmatch"] for r in QUERIES["verify_whole"](spark, SF).collect())
    scores = QUERIES["joint_pair_scores"](spark, SF).collect()
    videos = {(r["query_id"], r["video"]) for r in QUERIES["joint_bbox_count"](spark, SF).collect()}
    assert scores and {(r["query_id"], r["video"]) for r in scores} == videos
