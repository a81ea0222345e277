"""Properties of operators that have no SQL, and edge cases."""

import numpy as np
from pyspark.sql import functions as F

from tessera.operators import clustering, geometry, hamming, inverted, knn, points, quantization
from tessera.plans import fixtures

SF = "/root/testdata/sf0.001"


def sse(points_, centroids):
    return knn.nearest(points_, centroids).agg(F.sum("d2")).first()[0]


def test_kmeans_does_not_get_worse(spark):
    vecs = fixtures.descriptors(spark, SF).select("vec_id", "vec")
    one, many = (clustering.kmeans(vecs, 6, rounds=r).select("vw", "centroid") for r in (1, 6))
    assert sse(vecs, many) <= sse(vecs, one) + 1e-9


def test_codebook_in_parts_gives_the_same(spark):
    d, cb = fixtures.descriptors(spark, SF).select("vec_id", "vec"), fixtures.codebook(spark, SF)
    whole = knn.nearest(d, cb, 3).select("vec_id", "centroid_id", "rnk").collect()
    parts = knn.nearest(d, cb, 3, max_broadcast=5).select("vec_id", "centroid_id", "rnk").collect()
    assert sorted(whole) == sorted(parts)


def test_vectors_with_nan_or_null_have_no_word(spark):
    rows = spark.createDataFrame([(1, [0.0, 1.0]), (2, [float("nan"), 1.0]), (3, None)], "vec_id long, vec array<double>")
    cb = spark.createDataFrame([(0, [0.0, 0.0]), (1, [0.0, 1.0])], "vw long, centroid array<double>")
    assert [tuple(r) for r in knn.nearest(rows, cb).select("vec_id", "centroid_id").collect()] == [(1, 1)]
    assert knn.nearest(rows, cb.where("false")).count() == 0


def test_merge_equals_build_of_both(spark):
    p = fixtures.assigned(spark, SF).select("vw", "image_id", "pt")
    merged = inverted.merge(p.where("image_id < 10"), p.where("image_id >= 10"), 0)
    assert merged.exceptAll(p).count() == 0 and merged.count() == p.count()


def test_histograms_only_lower_scores(spark):
    p = fixtures.postings(spark, SF)
    cb = fixtures.codebook(spark, SF)
    q = fixtures.query_points(p)
    found = inverted.votes(inverted.probe(q, p, 28), inverted.word_weights(p, cb), inverted.SearchParams())
    flat = spark.createDataFrame([(d, b, 1.0) for d, n in (("angle", 64), ("scale", 63)) for b in range(n)], "dim string, bin int, wt double")
    total = found.groupBy("query_id", "image_id").agg(F.sum("score").alias("all"))
    scored = inverted.geometric_scores(inverted.histograms(found), flat, 5)
    assert scored.join(total, ["query_id", "image_id"]).where("score > `all` + 1e-9").count() == 0


def test_verification_recovers_a_known_map(spark):
    rng = np.random.default_rng(1)
    xy = rng.uniform(0, 300, (20, 2))
    rows = [(0, 0, i, i, 1.0, float(x), float(y), 2.0, 0.3, float(1.05 * x + 15), float(1.05 * y - 10), 2.1, 0.3) for i, (x, y) in enumerate(xy)]
    m = spark.createDataFrame(rows, "query_id int, image_id int, qpt int, dbpt int, score double, qx double, qy double, qscale double, qangle double, x double, y double, scale double, angle double")
    found = geometry.verify(m).collect()
    assert len(found) == 1 and found[0]["nmatch"] == 20
    assert np.allclose(found[0]["affine"], [1.05, 0, 15, 0, 1.05, -10], atol=1e-6)


def test_bases_are_orthogonal():
    for b in (hamming.hadamard(64), hamming.random_orthogonal(16, 1)):
        assert np.allclose(b @ b.T, np.eye(len(b)))


def test_codes_of_cells_are_exact(spark):
    cb = fixtures.codebook(spark, SF).collect()
    pq = quantization.from_rows([r["centroid"] for r in cb], 8)
    codes = pq.encode(np.array([r["centroid"] for r in cb]))
    assert np.allclose(pq.decode(codes), [r["centroid"] for r in cb])


def test_missing_ranges_across_blocks(spark):
    ids = spark.createDataFrame([(0,), (5,), ((1 << 20) + 3,)], "id long")
    got = sorted(tuple(r) for r in points.missing_ranges(ids, 0, (1 << 20) + 4).collect())
    assert got == [(1, 4), (6, (1 << 20) + 2), ((1 << 20) + 4, (1 << 20) + 4)]
