"""Modes of matching against brute force, on blocks that split an image."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import geometry, matching

COLUMNS = "image_id long, pt int, vec array<double>, x double, y double, scale double, angle double, cornerness double"


def image(i, numbers, rng):
    return [(i, int(p), np.round(rng.normal(size=4), 1).tolist(), float(p), float(i), 1.0, 0.5, float(rng.integers(5))) for p in numbers]


@pytest.fixture(scope="module")
def tables(spark):
    rng = np.random.default_rng(4)
    rows = image(1, range(8), rng) + image(2, range(4090, 4105), rng) + image(3, range(5), rng) + image(4, [], rng)
    rows += [(3, 3, None, 0.0, 0.0, 1.0, 0.0, 0.0), (3, 9, [1.0, float("nan"), 0.0, 0.0], 0.0, 0.0, 1.0, 0.0, 0.0)]
    points = spark.createDataFrame(rows, COLUMNS).repartition(4)
    queries = points.where("image_id < 3").withColumn("query_id", F.col("image_id"))
    shortlist = spark.createDataFrame([(1, 1), (1, 2), (2, 3), (2, 1), (2, 4)], "query_id long, image_id long")
    return rows, queries, points, shortlist


def brute(rows, shortlist, crop=None):
    rows = [r for r in rows if r[2] is not None and not np.isnan(r[2]).any()]
    if crop:
        kept = {i: {(r[0], r[1]) for r in sorted((r for r in rows if r[0] == i), key=lambda r: (-r[7], r[1]))[:crop]} for i in range(5)}
        rows = [r for r in rows if (r[0], r[1]) in kept[r[0]]]
    for q, i in shortlist:
        for a in (r for r in rows if r[0] == q):
            for b in (r for r in rows if r[0] == i):
                yield q, a[1], i, b[1], round(float(((np.array(a[2]) - np.array(b[2])) ** 2).sum()), 9)


@pytest.mark.parametrize("flags, threshold", [(4, 1.5), (0x10, 2), (0x20, 3), (2 | 0x20, 2)])
def test_modes(tables, flags, threshold):
    rows, queries, points, shortlist = tables
    mode = geometry.presets(flags)[0]
    if mode.crop:
        mode = geometry.MatchMode(crop=4, nearest_of_all=True)
    pairs = list(brute(rows, [tuple(r) for r in shortlist.collect()], mode.crop))
    if flags & 4:
        kept = [p for p in pairs if p[4] <= threshold**2]
        most = dict.fromkeys((1, 2), threshold)
    else:
        groups = {}
        for p in pairs:
            groups.setdefault(p[:3] if flags & 0x10 else p[:2], []).append(p)
        kept = [p for g in groups.values() for p in sorted(g, key=lambda p: (p[4], p[2], p[3]))[: int(threshold)]]
        most = {q: (1.1 * max(p[4] for p in kept if p[0] == q)) ** 0.5 for q in (1, 2)}
    found = matching.match(queries, points, shortlist, mode, threshold).collect()
    assert {(r["query_id"], r["qpt"], r["image_id"], r["dbpt"]): round(r["score"], 6) for r in found} == pytest.approx({p[:4]: round(1 - p[4] ** 0.5 / most[p[0]], 6) for p in kept})
    assert len(found) == len(kept)
    assert all(r["qx"] == r["qpt"] and r["x"] == r["dbpt"] and r["y"] == r["image_id"] for r in found)


def test_no_mode_and_empty_tables(tables):
    _, queries, points, shortlist = tables
    with pytest.raises(ValueError):
        matching.match(queries, points, shortlist, geometry.presets(0)[0], 2)
    for flags in (4, 0x10, 0x20):
        mode = geometry.presets(flags)[0]
        assert matching.match(queries.where("false"), points, shortlist, mode, 2).count() == 0
        assert matching.match(queries, points, shortlist.where("false"), mode, 2).count() == 0
