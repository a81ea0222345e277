"""Learning loops, atoms, transport, presets, stored models and filtered reads by brute force, properties and round trips."""

from itertools import combinations, permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions import vectors as v
from tessera.operators import clustering, geometry, hamming, knn, quantization, sparse
from tessera.plans import fixtures
from tessera.sources import binary, models
from tessera.sources.scratch import stored

SF = "/root/testdata/sf0.001"


def test_transport_against_all_assignments():
    rng = np.random.default_rng(1)
    for n in (1, 2, 4, 6):
        for _ in range(5):
            cost = rng.random((n, n))
            best = min(sum(cost[i, p[i]] for i in range(n)) for p in permutations(range(n))) / n
            assert abs(sparse.transport_cost(np.full(n, 1 / n), np.full(n, 1 / n), cost) - best) < 1e-9
    a, b = rng.random(7), rng.random(5)
    a, b = a / a.sum(), b / b.sum()
    line = np.abs(np.arange(7)[:, None] - np.arange(5)[None]).astype(float)
    shares = np.zeros(7)
    shares[:5] = b
    assert abs(sparse.transport_cost(a, b, line) - np.abs(np.cumsum(a - shares)).sum()) < 1e-9
    assert sparse.transport_cost(np.zeros(3), np.zeros(2), np.ones((3, 2))) == 0


def test_transport_of_empty_rows(spark):
    rows = spark.createDataFrame([(1, [], [], []), (2, [0.0], [1.0], [[1.0]]), (3, [2.0], [5.0], [[1.5]])], "k long, a array<double>, b array<double>, cost array<array<double>>")
    assert {r["k"]: r["d"] for r in sparse.earth_mover(rows, "k").collect()} == {1: None, 2: None, 3: 1.5}


def supports(atoms):
    out = {}
    for r in atoms.collect():
        assert r["a"] == 1.0
        out.setdefault(r["atom"], set()).add(r["vw"])
    return out


def test_atoms(spark):
    found = supports(sparse.intersection_atoms(spark, 16, 2, 1))
    assert len(found) == 15 and all(0 in s and len(s) == 4 for s in found.values())
    apart = supports(sparse.separate_atoms(spark, 8, 16, 3, 3))
    assert all(len(x & y) <= 1 for x, y in combinations(apart.values(), 2)) and len(apart) == 8
    shared = supports(sparse.aggregate_atoms(spark, 8, 16, 4, 4))
    assert len(shared) == 8 and all(len(s) == 4 for s in shared.values()) and sum((list(shared[i]) for i in range(4)), []).__len__() == 16 == len(set.union(*(shared[i] for i in range(4))))
    many = supports(sparse.random_atoms(spark, 40, 100, 0.3, 2))
    assert 0.2 < np.mean([len(s) / 100 for s in many.values()]) < 0.4
    more = sparse.add_atom(sparse.crop_atoms(sparse.random_atoms(spark, 4, 10, 0.9, 2), 1, 3), 7, [2, 5])
    assert set(supports(more)) == {0, 1, 7} and supports(more)[7] == {2, 5}


def test_presets():
    mode, params = geometry.presets(0)
    assert params == geometry.HoughParams() and mode == geometry.MatchMode()
    mode, params = geometry.presets(0x1000 | 5 << 8 | 2 | 8)
    assert mode.crop == 1000 and mode.words and not mode.exact and params.weighted and params.tolerance == 10 and params.least_after == 4
    assert geometry.presets(4 << 8)[1].least_after == 3


def test_pruned_kmeans_is_kmeans(spark):
    points = fixtures.descriptors(spark, SF).select("vec_id", "vec")
    start = [r["vec"] for r in points.orderBy("vec_id").limit(5).collect()]
    for rounds in (1, 4):
        a = {r["vw"]: r for r in clustering.kmeans(points, 5, rounds, start=start).collect()}
        b = {r["vw"]: r for r in clustering.pruned_kmeans(points, start, rounds, stored).collect()}
        assert all(np.allclose(a[i]["centroid"], b[i]["centroid"]) and a[i]["n"] == b[i]["n"] for i in a)


def test_balancing_evens_out_cells(spark):
    points, cb = fixtures.descriptors(spark, SF).select("vec_id", "vec"), fixtures.codebook(spark, SF)
    spread = lambda book: knn.nearest(points, book).groupBy("centroid_id").count().agg(F.max("count")).first()[0]
    factors = clustering.balance_factors(points, cb, 8)
    assert spread(cb.join(factors.withColumnRenamed("factor", "weight"), "vw")) < spread(cb)


def test_whitened_projections(spark):
    points = fixtures.descriptors(spark, SF).select("vec_id", "vec")
    basis = hamming.whitened_basis(clustering.principal_components(points, 8), 8, 3)
    p = np.array([r["proj"] for r in hamming.project(points, basis).collect()])
    assert np.allclose(np.cov(p.T), np.eye(8), atol=0.05)


def test_models_come_back(spark, tmp_path):
    points, cb = fixtures.descriptors(spark, SF).select("vec_id", "vec"), fixtures.codebook(spark, SF)
    model = quantization.with_errors(points, quantization.from_rows([r["centroid"] for r in cb.orderBy("vw").collect()], 8))
    models.write_quantizer(spark, model, f"{tmp_path}/q")
    back = models.read_quantizer(spark, f"{tmp_path}/q")
    assert (back.centroids == model.centroids).all() and (back.errors == model.errors).all()
    built = quantization.build_lists(points, cb, model)
    models.write_lists(spark, built, cb, model, f"{tmp_path}/l")
    rows, book, _ = models.read_lists(spark, f"{tmp_path}/l")
    assert rows.exceptAll(built).count() == 0 and rows.count() == built.count() and book.count() == 16
    tree = clustering.hierarchical_kmeans(points, 2, 2, 1)
    models.write_tree(spark, tree, f"{tmp_path}/t")
    assert models.read_tree(spark, f"{tmp_path}/t").count() == tree.count()
    atoms = sparse.random_atoms(spark, 3, 10, 0.5, 1)
    models.write_atoms(spark, atoms, f"{tmp_path}/a")
    assert supports(models.read_atoms(spark, f"{tmp_path}/a")) == supports(atoms)
    edges = spark.createDataFrame([(0, 1)], "node long, leaf long")
    models.write_two_level(spark, cb, edges, cb, f"{tmp_path}/n")
    assert models.read_two_level(spark, f"{tmp_path}/n")[1].collect() == edges.collect()
    with pytest.raises(ValueError, match="holds atoms"):
        models.read_tree(spark, f"{tmp_path}/a")


def test_filtered_reads_and_first(spark, tmp_path):
    binary.register(spark)
    rows = [("", i, float(i), float(i % 7), 1.0, 0.0, 1.0, 0.0, 0.0, 1.0, float("nan") if i == 9 else float(i * 2), bytes([i, 3])) for i in range(50)]
    schema = "file string, pt long, " + ", ".join(f"{g} float" for g in binary.GEOMETRY) + ", desc binary"
    spark.createDataFrame(rows, schema).coalesce(1).write.format("points").option("layout", "siftgeo").mode("append").save(str(tmp_path / "p"))
    read = lambda: spark.read.format("points")
    for test in ("cornerness > 40", "x <= 3 and y = 2", "y >= 5", "cornerness < 10 and mi11 <> 0", "x = 1e1"):
        kept = read().option("keep", test).load(str(tmp_path / "p"))
        assert sorted(r["x"] for r in kept.collect()) == sorted(r["x"] for r in spark.createDataFrame(rows, schema).where(test).collect()), test
    with pytest.raises(Exception, match="does not compare"):
        read().option("keep", "desc > 1").load(str(tmp_path / "p")).count()
    assert sorted(r["pt"] for r in spark.read.format("points").option("first", 4).load(str(tmp_path / "p")).collect()) == [0, 1, 2, 3]


def test_sparse_and_raw_vectors(spark, tmp_path):
    binary.register(spark)
    rows = [("", i, [float(i), 0.0, 0.0, -1.5]) for i in range(5)] + [("", 5, [0.0] * 4)]
    df = spark.createDataFrame(rows, "file string, id long, vec array<float>")
    for kind in ("spfvecs", "rawfvecs"):
        df.coalesce(1).write.format(kind).mode("append").save(f"{tmp_path}/{kind}")
        back = spark.read.format(kind).option("dim", 4).load(f"{tmp_path}/{kind}")
        assert sorted(r["vec"] for r in back.collect()) == sorted(r[2] for r in rows)
        assert spark.read.format(kind).option("dim", 4).option("first", 2).load(f"{tmp_path}/{kind}").count() == 2


def test_vector_helpers(spark):
    df = spark.range(3).select("id", v.permutation(F.col("id"), 9).alias("p"), v.shuffled(F.sequence(F.lit(10), F.lit(18)), F.col("id"), 9).alias("s"))
    for r in df.collect():
        assert sorted(r["p"]) == list(range(9)) and r["s"] == [10 + i for i in r["p"]]
    row = spark.range(1).select(v.mahalanobis(F.array(F.lit(1.0), F.lit(2.0)), F.array(F.lit(0.0), F.lit(0.0)), F.array(F.array(F.lit(2.0), F.lit(1.0)), F.array(F.lit(1.0), F.lit(3.0)))).alias("d")).first()
    assert row["d"] == 1 * (2 + 2) + 2 * (1 + 6)
