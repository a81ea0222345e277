"""Whole jobs beside the queries of the other modules: voted images only, all pairs of vectors, and videos verified jointly.

All queries take every image or vector whose id 20 divides; those here whose name ends in `_whole` were the
first to do so and give the rows of their namesakes.
"""

from __future__ import annotations

from math import pi

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators import clustering, hamming, inverted, knn, points, sparse
from tessera.operators import geometry as g
from tessera.plans.fixtures import BASE, BITS, HAMMING, codebook, descriptors, postings, query_points
from tessera.plans.numeric import E, _vectors, bags
from tessera.plans.quantized import nearest_codes
from tessera.plans.registry import ORACLE_SQL, query
from tessera.plans.retrieval import PARAMS, r6
from tessera.plans.verification import M
from tessera.sources.scratch import stored


def _search(p: DataFrame, spark, sf) -> DataFrame:
    """The best images of every query; images without votes, which score 0, are not listed."""
    words, norms = inverted.word_weights(p, codebook(spark, sf)), inverted.image_norms(p)
    found = inverted.votes(inverted.probe(query_points(p), p, PARAMS.hamming), words, PARAMS)
    found = inverted.damp_between_images(inverted.damp_within_images(found, PARAMS.burst_intra, PARAMS.cancel_multiple))
    scored = inverted.geometric_scores(inverted.histograms(found), inverted.wgc_weights(spark, PARAMS.wgc_class), PARAMS.wgc_window)
    scored = scored.join(norms.select("image_id", F.col("l2").alias("n")), "image_id").join(norms.select(F.col("image_id").alias("query_id"), F.col("l2").alias("qn")), "query_id")
    return inverted.top(scored.select("query_id", "image_id", (F.col("score") / (F.col("n") * F.col("qn"))).alias("score")).where("score > 0"), PARAMS.shortlist)


@query("ivf_search_whole", BASE + "SELECT query_id, image_id, round(score, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, image_id)::INTEGER AS rnk FROM scores WHERE score > 0 QUALIFY rnk <= 20")
def _(spark, sf):
    return _search(postings(spark, sf), spark, sf).select("query_id", "image_id", r6(F.col("score")).alias("score"), "rnk")


def _matches(p: DataFrame) -> DataFrame:
    return g.match_words(points.affine(query_points(p), (1.05, 0.0, 15.0, 0.0, 1.05, -10.0), 1.05), p, HAMMING)


def _candidates(p: DataFrame, group: F.Column | None = None) -> DataFrame:
    return stored(g.match_candidates(points.affine(query_points(p), (1.05, 0.0, 15.0, 0.0, 1.05, -10.0), 1.05), p, HAMMING, group=group), "candidates")


@query("match_vw_whole", ORACLE_SQL["match_vw"])
def _(spark, sf):
    return _matches(postings(spark, sf)).select("query_id", "qpt", "image_id", "dbpt", r6(F.col("score")).alias("score"))


@query("verify_whole", M + "SELECT query_id, image_id, nmatch, round(votes, 6) AS votes FROM best")
def _(spark, sf):
    return g.verify(_candidates(postings(spark, sf))).select("query_id", "image_id", "nmatch", r6(F.col("votes")).alias("votes"))


@query("search_verified_whole", ORACLE_SQL["search_verified"])
def _(spark, sf):
    p = postings(spark, sf)
    m = _matches(p).join(_search(p, spark, sf).select("query_id", "image_id"), ["query_id", "image_id"], "left_semi")
    w = Window.partitionBy("query_id").orderBy(F.desc(F.round("votes", 9)), F.desc("nmatch"), "image_id")
    return g.verify(m).where("votes > 0").select("query_id", "image_id", "nmatch", r6(F.col("votes")).alias("votes"), F.row_number().over(w).alias("place"))


@query("match_exact_whole", ORACLE_SQL["match_exact_knn"])
def _(spark, sf):
    d = descriptors(spark, sf).select("vec_id", F.col("image_id").alias("tag"), "vec")
    asked = d.where("tag % 20 = 0").withColumnRenamed("vec_id", "query_id")
    near = knn.nearest_in_blocks(asked, d, 3, keep=lambda _, a, b: a[:, None] != b[None])
    rows = near.select(F.floor(F.col("query_id") / 10).alias("query_id"), (F.col("query_id") % 10).alias("qpt"), F.floor(F.col("vec_id") / 10).alias("image_id"), (F.col("vec_id") % 10).alias("dbpt"), "d2")
    most = rows.groupBy("query_id").agg(F.sqrt(1.1 * F.max("d2")).alias("t"))
    return rows.join(most, "query_id").select("query_id", "qpt", "image_id", "dbpt", r6(1 - F.sqrt("d2") / F.col("t")).alias("score"))


for _name, _how in (("adc", {}), ("adc_cor", {"corrected": True}), ("sdc", {"symmetric": True}), ("sdc_cor", {"symmetric": True, "corrected": True})):

    @query(f"pq_nn_{_name}_whole", ORACLE_SQL[f"pq_nn_{_name}"])
    def _(spark, sf, how=_how):
        return nearest_codes(spark, sf, **how)


# all words, dimensions and pairs of images ----------------------------------------------------------


@query("sparse_dot_whole", ORACLE_SQL["sparse_dot"])
def _(spark, sf):
    rows = stored(bags(spark, sf), "bags")
    return sparse.dot_products_of_all(rows.where("image_id % 20 = 0"), rows).where("a <> b")


@query("matmul_whole", E + ", m AS (SELECT vec_id AS r, i.i, v[i.i + 1] AS x FROM e CROSS JOIN (SELECT unnest(range(0, 64)) AS i) i) SELECT a.r, b.r AS c, round(sum(a.x * b.x), 6) + 0.0 AS x FROM m a JOIN m b ON a.i = b.i GROUP BY ALL")
def _(spark, sf):
    cells = _vectors(spark, sf).select(F.col("vec_id").alias("id"), F.posexplode("v").alias("idx", "x"))
    return sparse.row_products(cells, cells).select(F.col("a").alias("r"), F.col("b").alias("c"), r6(F.col("dot")).alias("x"))


@query("to_dense_whole", ORACLE_SQL["to_dense"])
def _(spark, sf):
    dense = sparse.to_dense(bags(spark, sf).select("image_id", F.col("vw").alias("idx"), F.col("n").alias("x")), "image_id", 1000)
    return dense.select("image_id", F.aggregate(F.transform("v", lambda x, i: x * i), F.lit(0).cast("long"), lambda a, x: a + x.cast("long")).alias("s"))


@query("covariance_whole", ORACLE_SQL["covariance"])
def _(spark, sf):
    return clustering.covariance(descriptors(spark, sf).select("vec_id", "vec")).select("i", "j", r6(F.col("c")).alias("c"))


@query("hadamard_project_whole", ORACLE_SQL["hadamard_project"])
def _(spark, sf):
    p = hamming.project(descriptors(spark, sf).select("vec_id", "vec"), hamming.hadamard(BITS))
    return p.select("vec_id", F.posexplode("proj").alias("bit", "v")).select("vec_id", F.col("bit").cast("long").alias("bit"), r6(F.col("v")).alias("v"))


@query("affine_lsq_whole")
def _(spark, sf):
    h = g.hypotheses(g.spread_votes(_matches(postings(spark, sf))))
    return h.select("query_id", "image_id", *g.CELL, "n", (F.round(F.col("affine")[0], 3) + 0.0).alias("a"), (F.round(F.col("affine")[4], 3) + 0.0).alias("e"))


@query("affine_inliers_whole", ORACLE_SQL["affine_inliers"])
def _(spark, sf):
    m = _candidates(postings(spark, sf))
    return g.agreeing(g.hypotheses(g.spread_votes(m)), m).groupBy("query_id", "image_id", "qpt", "dbpt").agg(F.count("*").alias("n"))


@query("match_coords_whole", ORACLE_SQL["match_coords"])
def _(spark, sf):
    m = _candidates(postings(spark, sf))
    found = m.join(g.verify(m).select(*g.PAIR), list(g.PAIR), "left_semi")
    return found.select("query_id", "image_id", "qpt", "dbpt", F.round("qx", 4).alias("qx"), F.round("x", 4).alias("x"))


# videos: ten images each, verified jointly ----------------------------------------------------------

def _video() -> F.Column:
    return F.floor(F.col("image_id") / 10)


@query("joint_pair_scores")
def _(spark, sf):
    found = g.joint_inliers(_candidates(postings(spark, sf), _video()), _video())
    return found.groupBy("query_id", F.col("grp").alias("video"), "image_id").agg(F.count("*").alias("nmatch"), r6(F.sum("score")).alias("score"))


@query("joint_bbox_count")
def _(spark, sf):
    p = postings(spark, sf)
    return bbox_counts(g.joint_inliers(_candidates(p, _video()), _video()), p.withColumn("grp", _video()))


def bbox_counts(inliers: DataFrame, rows: DataFrame) -> DataFrame:
    """(query_id, video, x0, x1, y0, y1, n): the box of each video's inliers and how many of all its points (grp, x, y) lie in it."""
    box = inliers.groupBy("query_id", "grp").agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"))
    inside = rows.select("grp", "x", "y").join(box, "grp").where("x >= x0 and x <= x1 and y >= y0 and y <= y1")
    return inside.groupBy("query_id", F.col("grp").alias("video"), "x0", "x1", "y0", "y1").agg(F.count("*").alias("n"))


@query("inlier_angle_hist")
def _(spark, sf):
    m = _candidates(postings(spark, sf))
    turn = (F.col("qangle") - F.col("angle")) / (2 * pi)
    return g.agreeing(g.best_hypotheses(m), m).groupBy(F.floor((turn - F.floor(turn)) * 16).cast("long").alias("bin")).agg(F.count("*").alias("n"))
