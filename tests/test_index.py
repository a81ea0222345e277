"""The stored index: searches equal those on tables, additions equal a rebuild, snapshots are whole."""

import re

import pytest
from py4j.protocol import Py4JJavaError
from pyspark.sql import functions as F

from tessera.operators import hamming, inverted
from tessera.plans import fixtures
from tessera.plans.retrieval import PARAMS
from tessera.sources import files, index
from tessera.sources.scratch import stored
from tessera.streaming import ingest

SF = "/root/testdata/sf0.001"
LAYOUT = index.Layout(buckets=4, slice_rows=16)


@pytest.fixture(scope="module")
def postings(spark):
    return fixtures.postings(spark, SF)


@pytest.fixture(scope="module")
def medians(spark):
    return stored(hamming.medians(stored(hamming.project(fixtures.assigned(spark, SF), hamming.hadamard(64)), "projected")), "medians")


def found(df):
    return sorted((r["query_id"], r["image_id"], round(r["score"], 9), r["rnk"]) for r in df.collect())


def on_tables(spark, p):
    return found(inverted.search(fixtures.query_points(p), p, fixtures.codebook(spark, SF), PARAMS))


@pytest.mark.parametrize("layout", [LAYOUT, index.Layout(buckets=3)])
def test_search_on_a_stored_index(spark, postings, tmp_path, layout):
    path = str(tmp_path / "ix")
    index.store(postings, fixtures.codebook(spark, SF), path, layout, shortlist=20)
    snapshot = index.load(spark, path)
    asked = fixtures.query_points(postings)
    assert found(index.search(asked, snapshot, PARAMS)) == on_tables(spark, postings)
    assert snapshot.facts["settings"] == {"shortlist": 20}
    rows = lambda df: sorted(map(tuple, df.select("vw", "image_id", "pt", "binsign").collect()))
    assert rows(snapshot.postings()) == rows(postings)
    cells = snapshot.segments()[0][0].groupBy("vw").agg(F.count_distinct("cell").alias("cells"), F.count("*").alias("n")).collect()
    assert all((r["cells"] > 1) == (r["n"] > layout.slice_rows) for r in cells)


def test_no_exchange_of_postings(spark, postings, tmp_path):
    path = str(tmp_path / "ix")
    index.store(postings, fixtures.codebook(spark, SF), path, LAYOUT)
    index.add(postings.where("image_id < 9"), path)
    before = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = index.load(spark, path).pairs(fixtures.query_points(postings), 28)._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, x in before.items():
            spark.conf.set(k, x)
    assert len(re.findall(r"FileScan parquet spark_catalog\.default\.tessera_segment.*Bucketed: true", plan)) == 2
    assert len(re.findall(r"Exchange hashpartitioning\(cell", plan)) == 2  # of the queries, once for each segment
    for side in plan.split("SortMergeJoin")[1:]:  # between a join and the scan of its postings there is no exchange
        assert "Exchange" not in side[: side.index("FileScan parquet spark_catalog")]


def test_storing_again_replaces(spark, postings, tmp_path):
    path, cb = str(tmp_path / "ix"), fixtures.codebook(spark, SF)
    first = index.store(postings, cb, path, LAYOUT)
    second = index.store(postings, cb, path, LAYOUT)
    assert (first.number, second.number) == (1, 2)
    assert index.load(spark, path).postings().count() == index.load(spark, path, 1).postings().count() == postings.count()
    assert index.load(spark, path).norms().count() == postings.select("image_id").distinct().count()


def test_a_number_is_taken_once(spark, postings, tmp_path):
    path = str(tmp_path / "ix")
    snapshot = index.store(postings.limit(5), fixtures.codebook(spark, SF), path, LAYOUT)
    with pytest.raises(Py4JJavaError, match="already exists|AlreadyExists"):
        index._publish(spark, path, snapshot.number, {"other": 1})
    assert index.load(spark, path).facts == snapshot.facts
    assert files.names(spark, f"{path}/snapshots") == ["00000001.json"] and files.names(spark, f"{path}/nothing") == []
    with pytest.raises(ValueError, match="no index"):
        index.load(spark, str(tmp_path / "none"))


def parts(points, n):
    """n batches; some images have points in several."""
    return [points.where(F.expr(f"(image_id + (case when image_id % 5 = 0 then pt else 0 end)) % {n} = {i}")) for i in range(n)]


def test_additions_equal_a_rebuild(spark, medians, tmp_path):
    path, source, cb = str(tmp_path / "ix"), str(tmp_path / "in"), fixtures.codebook(spark, SF)
    points = fixtures.descriptors(spark, SF)
    whole = fixtures.postings(spark, SF)
    so_far = None
    for i, part in enumerate(parts(points, 3)):
        part.coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(points.schema).parquet(source)
        ingest.append_images(stream, path, str(tmp_path / "ck"), cb, hamming.hadamard(64), medians, True, LAYOUT).awaitTermination()
        so_far = part.select("vec_id") if so_far is None else so_far.unionByName(part.select("vec_id"))
        mine = stored(whole.join(so_far, "vec_id", "left_semi"), "mine")
        snapshot = index.load(spark, path)
        assert len(snapshot.facts["segments"]) == i + 2 and snapshot.facts["streams"] == {str(tmp_path / "ck"): i}
        assert found(index.search(fixtures.query_points(mine), snapshot, PARAMS)) == on_tables(spark, mine)
        rebuilt = {r["image_id"]: tuple(r) for r in inverted.image_norms(mine).collect()}
        assert {r["image_id"]: tuple(r) for r in snapshot.norms().collect()} == rebuilt
    assert any(s["images_again"] for s in snapshot.facts["segments"])
    # a batch that is run again changes nothing, and so does no batch at all
    again = index.add(whole.where("image_id = 1"), path, str(tmp_path / "ck"), 2)
    assert again.number == snapshot.number and index.load(spark, path).facts == snapshot.facts
    compacted = index.compact(spark, path)
    assert len(compacted.facts["segments"]) == 1
    assert found(index.search(fixtures.query_points(whole), compacted, PARAMS)) == on_tables(spark, whole)
    assert index.vacuum(spark, path) >= 4
    assert found(index.search(fixtures.query_points(whole), index.load(spark, path), PARAMS)) == on_tables(spark, whole)


def test_an_old_snapshot_stays_as_it_was(spark, postings, tmp_path):
    path, cb = str(tmp_path / "ix"), fixtures.codebook(spark, SF)
    half = stored(postings.where("image_id < 25"), "half")
    first = index.store(half, cb, path, LAYOUT)
    index.add(postings.where("image_id >= 25"), path)
    assert found(index.search(fixtures.query_points(half), first, PARAMS)) == on_tables(spark, half)
    index.add(postings.where("false"), path)
    assert found(index.search(fixtures.query_points(postings), index.load(spark, path), PARAMS)) == on_tables(spark, postings)
