"""Medians of many groups by selection, and nearest centroids in parts, against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import hamming, knn, medians
from tessera.plans import fixtures
from tessera.sources.scratch import stored

SF = "/root/testdata/sf0.001"


def vectors(seed):
    """Groups of very different sizes, the first with half of all rows; ties, constants, tiny and huge values."""
    rng = np.random.default_rng(seed)
    rows = []
    for g, n in [(7, 3000), (-2, 700), (0, 600), (11, 501), (12, 60), (13, 1), (14, 2), (15, 3)]:
        m = np.stack([rng.normal(size=n), np.round(rng.normal(size=n), 1), np.full(n, 4.25), rng.normal(size=n) * 10.0 ** rng.integers(-300, 300, n), rng.integers(0, 2, n) * 1e-9 - 0.0], 1)
        rows += [(g, x.tolist()) for x in m]
    rng.shuffle(rows)
    return rows


def expected(rows):
    by = {}
    for g, x in rows:
        by.setdefault(g, []).append(x)
    return {g: np.median(np.array(x), 0) for g, x in by.items()}


@pytest.mark.parametrize("settings", [{}, {"hold": 50, "enough": 10, "at_once": 2}, {"hold": 2, "enough": 1}, {"hold": 400, "enough": 100_000}])
def test_medians_against_numpy(spark, settings):
    rows = [(int(g), x) for g, x in vectors(3)]
    table = stored(spark.createDataFrame([*rows, (None, [0.0] * 5)], "vw long, proj array<double>").repartition(6), "vectors")
    got = {r["vw"]: np.array(r["medians"]) for r in medians.group_medians(table, "vw", "proj", **settings).collect()}
    want = expected(rows)
    assert got.keys() == want.keys()
    for g, m in want.items():
        assert np.array_equal(got[g], m), (g, got[g], m)


def test_a_large_group_sends_counts_not_values(spark):
    n = 20_000
    rng = np.random.default_rng(1)
    table = stored(spark.createDataFrame([(1, [float(x)]) for x in rng.normal(size=n)], "g long, v array<double>").repartition(4), "vectors")
    low, high = np.array([[-10.0]]), np.array([[10.0]])
    counts = medians._counts(table, np.array([1]), low, high, True)
    assert counts.count() <= medians.BUCKETS and counts.agg(F.sum("n")).first()[0] == n


def test_no_rows_and_words_without_points(spark):
    none = spark.createDataFrame([], "vw long, proj array<double>")
    assert medians.group_medians(none, "vw", "proj").count() == 0
    p = spark.createDataFrame([(1, 5, [1.0, -1.0]), (2, 5, [3.0, -3.0]), (3, 6, [-1.0, 2.0])], "vec_id long, vw long, proj array<double>")
    words = spark.createDataFrame([(5,), (6,), (8,)], "vw long")
    found = {r["vw"]: r["medians"] for r in hamming.medians(p, words).collect()}
    assert found == {5: [2.0, -2.0], 6: [-1.0, 2.0], 8: None}
    # a point whose word has no medians keeps a signature, against zeros
    late = spark.createDataFrame([(9, 8, [1.0, -1.0]), (10, 99, [-1.0, 1.0])], "vec_id long, vw long, proj array<double>")
    assert {r["vec_id"]: r["binsign"] for r in hamming.signatures(late, hamming.medians(p, words)).collect()} == {9: 1, 10: 2}
    assert hamming.wide_signatures(late, hamming.medians(p, words), 2).count() == 2


def test_every_point_has_a_signature(spark):
    projected = stored(hamming.project(fixtures.assigned(spark, SF), hamming.hadamard(64)), "projected")
    by_rounds, at_once = (hamming.signatures(projected, hamming.medians(projected, hold=h)).select("vec_id", "binsign").collect() for h in (8, 1 << 16))
    assert sorted(by_rounds) == sorted(at_once) and len(at_once) == fixtures.descriptors(spark, SF).count()


def test_points_without_other_columns_in_parts(spark):
    d, cb = fixtures.descriptors(spark, SF).select("vec"), fixtures.codebook(spark, SF)
    d = d.unionByName(d.limit(7))  # repeated rows
    key = lambda rows: sorted((tuple(r["vec"]), r["centroid_id"], r["rnk"]) for r in rows)
    whole, parts = knn.nearest(d, cb, 2).collect(), knn.nearest(d, cb, 2, max_broadcast=5).collect()
    assert len(parts) == 2 * d.count() and key(whole) == key(parts)
