"""Matches of the pairs that can have a hypothesis, against all matches."""

from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import geometry as g
from tessera.plans import fixtures, verification, whole

SF = "/root/testdata/sf0.001"


def scene(spark):
    """Points of 60 images: chance ones, copies of others by a map, null and degenerate geometries."""
    rng = np.random.default_rng(11)
    rows = []
    for image in range(60):
        for pt in range(int(rng.integers(3, 14))):
            rows.append([image, pt, int(rng.integers(4)), int(rng.integers(0, 1 << 5)), *rng.uniform(0, 60, 2).tolist(), float(rng.uniform(1, 3)), float(rng.integers(-3, 4)) / 2])
    rows += [[r[0] + 100, r[1], r[2], r[3], 1.1 * r[4] + 13, 1.1 * r[5] - 26, 1.1 * r[6], r[7]] for r in rows if r[0] % 20 == 0]
    for r in rows[::29]:
        r[4] = None
    for r in rows[::31]:
        r[6] = 0.0
    rows[50][2] = rows[51][3] = None
    p = spark.createDataFrame(rows, "image_id long, pt long, vw long, binsign long, x double, y double, scale double, angle double")
    return p.where("image_id % 20 = 0").withColumn("query_id", F.col("image_id")).where("scale > 0"), p.where("scale > 0")


@pytest.mark.parametrize("sizes, hold", [((1024, 8192), 1 << 16), ((9, 25), 1 << 16), ((1024, 8192), 8)])
@pytest.mark.parametrize("flags, video", [(0, False), (4 << 8, False), (0, True)])
def test_no_pair_with_a_hypothesis_is_left_out(spark, sizes, hold, flags, video):
    (queries, postings), params = scene(spark), g.presets(flags)[1]
    group = F.floor(F.col("image_id") / 10).cast("long") if video else None
    every = g.match_words(queries, postings, 2)
    some = g.match_candidates(queries, postings, 2, params, group, sizes, hold).select(*every.columns)
    of = F.floor(F.col("image_id") / 10).cast("long") if video else F.col("image_id")
    of_pairs = every.withColumn("image_id", of)
    n = {(r["query_id"], r["image_id"]): r["count"] for r in of_pairs.groupBy(*g.PAIR).count().collect()}
    crowded = {(r["query_id"], r["image_id"]) for r in g.cells(g.spread_votes(of_pairs, params)).where(F.col("n") >= params.least_before).select(*g.PAIR).distinct().collect()}
    pair = lambda r: (r["query_id"], r["image_id"] // 10 if video else r["image_id"])
    all_rows, rows = every.collect(), some.collect()
    found = {pair(r) for r in rows}
    assert crowded <= found <= set(n) and len(crowded) < len(n)
    assert Counter(rows) == Counter(r for r in all_rows if pair(r) in found)  # whole pairs, each match once
    if hold > 8:
        assert all(n[k] >= params.least_before for k in found)


def test_a_cell_counts_on_both_sides_of_its_edge():
    of = lambda pair, q, p: g._crowded(np.array(pair), q, p, g.HoughParams()).tolist()
    q, p = np.full((4, 3), 1.0), np.full((4, 3), 1.0)  # log scale and angle are 0, an edge
    p[3] = [1 - 1e-15, 1.0, 1 + 1e-15]
    assert of([7, 7, 7], q, p) == [7]
    p[2], p[3] = 1.2, 1.3
    assert of([7, 7, 7], q, p) == [7] and of([7, 7, 8], q, p) == []
    p[0] = [1.0, 1.0, 900.0]
    assert of([7, 7, 7], q, p) == []
    p[0, 0] = np.nan
    assert of([7, 7, 7], q, p) == [7]
    assert of([], q[:, :0], p[:, :0]) == []


def test_few_matches_go_on(spark):
    """Verification spreads, stores and sends the matches that can matter, a small part of all."""
    sf = "/root/testdata/sf0.1"
    every = verification.matches(spark, sf).count()
    assert 0 < verification.candidates(spark, sf).count() < 0.2 * every
    assert 0 < whole._candidates(fixtures.postings(spark, sf), whole._video()).count() < 0.7 * every


def test_videos_of_candidates_are_those_of_all_matches(spark):
    p = fixtures.postings(spark, SF)
    a, b = (g.joint_inliers(m, whole._video()) for m in (whole._matches(p), whole._candidates(p, whole._video())))
    order = sorted(a.columns)
    assert Counter(map(str, a.select(order).collect())) == Counter(map(str, b.select(order).collect())) and a.count()
