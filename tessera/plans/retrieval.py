"""Queries on points, words, signatures and the inverted file."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import vectors as v
from tessera.operators import clustering, hamming, inverted, knn, points
from tessera.plans.fixtures import BASE, BITS, EVERY, HAMMING, WORDS, assigned, codebook, descriptors, postings, query_points
from tessera.plans.registry import query, table
from tessera.sources.scratch import stored

PARAMS = inverted.SearchParams(hamming=HAMMING)


def r6(c) -> F.Column:
    return F.round(c, 6) + 0.0


# points ------------------------------------------------------------------------------------------


@query("scan_cornerness_gt", BASE + "SELECT image_id, pt FROM d WHERE cornerness > 100")
def _(spark, sf):
    return descriptors(spark, sf).where("cornerness > 100").select("image_id", "pt")


@query("scan_mask_semijoin", BASE + "SELECT vec_id FROM d WHERE vec_id IN (SELECT doc_id FROM documents WHERE lang = 'fr')")
def _(spark, sf):
    mask = table(spark, sf, "documents").where("lang = 'fr'").select(F.col("doc_id").alias("vec_id"))
    return table(spark, sf, "embeddings").select("vec_id").join(mask, "vec_id", "left_semi")


@query("count_points", "SELECT count(*) AS n, max(len(embedding))::BIGINT AS dim FROM embeddings")
def _(spark, sf):
    return table(spark, sf, "embeddings").agg(F.count("*").alias("n"), F.max(F.size("embedding")).cast("long").alias("dim"))


@query("lookup_by_id", "SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderkey = (SELECT min(o_orderkey) FROM orders)")
def _(spark, sf):
    orders = table(spark, sf, "orders")
    return orders.join(orders.agg(F.min("o_orderkey").alias("o_orderkey")), "o_orderkey", "left_semi").select("o_orderkey", "o_custkey", "o_totalprice")


@query("missing_ranges", """
    WITH e AS (SELECT DISTINCT doc_id AS id FROM labels UNION SELECT -1 UNION SELECT max(doc_id) + 1 FROM documents),
    g AS (SELECT lag(id) OVER (ORDER BY id) AS b, id FROM e) SELECT b + 1 AS low, id - 1 AS high FROM g WHERE id - b > 1""")
def _(spark, sf):
    last = table(spark, sf, "documents").agg(F.max("doc_id")).first()[0]
    return points.missing_ranges(table(spark, sf, "labels").select(F.col("doc_id").alias("id")), 0, last)


@query("desc_rescale", "SELECT vec_id, round(list_sum(list_transform(embedding, lambda z: (floor((z::DOUBLE + 1) * 127.5) + 0.5) / 512)), 6) AS s FROM embeddings")
def _(spark, sf):
    scaled = F.transform(v.doubles(F.col("embedding")), lambda x: (F.floor((x + 1) * 127.5) + 0.5) / 512)
    return table(spark, sf, "embeddings").select("vec_id", r6(v.total(scaled)).alias("s"))


@query("explode_assignments", BASE + "SELECT vec_id, rnk, vw FROM ranked WHERE rnk <= 3")
def _(spark, sf):
    near = knn.nearest(descriptors(spark, sf), codebook(spark, sf), 3)
    lists = near.groupBy("vec_id").agg(F.sort_array(F.collect_list(F.struct("rnk", "centroid_id"))).alias("vws"))
    return lists.select("vec_id", F.explode("vws").alias("a")).select("vec_id", F.col("a.rnk").cast("long").alias("rnk"), F.col("a.centroid_id").alias("vw"))


@query("affine_transform", BASE + "SELECT vec_id, round(1.05::DOUBLE * x + 15, 6) AS x, round(1.05::DOUBLE * y - 10, 6) AS y, round(scale * 1.05::DOUBLE, 6) AS scale FROM d")
def _(spark, sf):
    moved = points.affine(descriptors(spark, sf), (1.05, 0.0, 15.0, 0.0, 1.05, -10.0), 1.05)
    return moved.select("vec_id", r6(F.col("x")).alias("x"), r6(F.col("y")).alias("y"), r6(F.col("scale")).alias("scale"))


@query("append_sets", BASE + "SELECT image_id, pt FROM d WHERE image_id < 10 UNION ALL SELECT image_id, pt FROM d WHERE image_id >= 5")
def _(spark, sf):
    d = descriptors(spark, sf).select("image_id", "pt")
    return d.where("image_id < 10").unionByName(d.where("image_id >= 5"))


@query("topn_cornerness", BASE + "SELECT image_id, pt, round(cornerness, 6) AS cornerness FROM d QUALIFY row_number() OVER (PARTITION BY image_id ORDER BY cornerness DESC, pt) <= 3")
def _(spark, sf):
    return points.strongest(descriptors(spark, sf), 3).select("image_id", "pt", r6(F.col("cornerness")).alias("cornerness"))


@query("filter_cornerness_ge", BASE + "SELECT image_id, pt FROM d WHERE cornerness >= 50")
def _(spark, sf):
    return descriptors(spark, sf).where("cornerness >= 50").select("image_id", "pt")


@query("crop_bbox_in", BASE + "SELECT vec_id FROM d WHERE x > 300 AND x < 340 AND y > 220 AND y < 260")
def _(spark, sf):
    return descriptors(spark, sf).where(points.in_box(300, 340, 220, 260)).select("vec_id")


@query("crop_bbox_out", BASE + "SELECT vec_id FROM d WHERE NOT (x > 300 AND x < 340 AND y > 220 AND y < 260)")
def _(spark, sf):
    return descriptors(spark, sf).where(~points.in_box(300, 340, 220, 260)).select("vec_id")


@query("crop_polygon", BASE + "SELECT vec_id FROM d WHERE x - 300 > 0 AND y - 220 > 0 AND -x - y + 600 > 0")
def _(spark, sf):
    return descriptors(spark, sf).where(v.inside_half_planes(F.col("x"), F.col("y"), [(1, 0, -300), (0, 1, -220), (-1, -1, 600)])).select("vec_id")


@query("dedup_vw", BASE + "SELECT image_id, vw, min(pt) AS pt FROM post GROUP BY image_id, vw")
def _(spark, sf):
    return inverted.first_of_word(assigned(spark, sf)).select("image_id", "vw", "pt")


@query("sample_hash", BASE + "SELECT image_id, pt FROM d WHERE ('0x' || substr(md5(image_id || '-' || pt), 1, 8))::BIGINT < 1288490188")
def _(spark, sf):
    return points.sample(descriptors(spark, sf), 0.3, ["image_id", "pt"]).select("image_id", "pt")


@query("mask_binsign", BASE + "SELECT vec_id, bit_count(lo & 65535)::BIGINT AS bits FROM post")
def _(spark, sf):
    return postings(spark, sf).select("vec_id", F.bit_count(F.col("binsign").bitwiseAND(F.lit(65535).cast("long"))).cast("long").alias("bits"))


_MA = BASE + "SELECT vec_id, vw, round(d2, 6) AS d2 FROM (SELECT *, min(d2) OVER (PARTITION BY vec_id) AS m FROM ranked WHERE rnk <= 4) WHERE "


@query("ma_filter_ratio", _MA + "d2 < m * 1.2::DOUBLE")
def _(spark, sf):
    near = knn.nearest(descriptors(spark, sf), codebook(spark, sf), 4)
    return knn.within_ratio(near, ["vec_id"], 1.2).select("vec_id", F.col("centroid_id").alias("vw"), r6(F.col("d2")).alias("d2"))


@query("ma_filter_thresh", _MA + "d2 < 1.5")
def _(spark, sf):
    near = knn.nearest(descriptors(spark, sf), codebook(spark, sf), 4)
    return near.where("d2 < 1.5").select("vec_id", F.col("centroid_id").alias("vw"), r6(F.col("d2")).alias("d2"))


@query("quantize_scale", BASE + "SELECT vec_id, greatest(0, least(31, trunc(ln(scale) / ln(1.2::DOUBLE) + 0.5)))::INTEGER AS q FROM d")
def _(spark, sf):
    return descriptors(spark, sf).select("vec_id", v.quantized_scale(F.col("scale")).alias("q"))


@query("quantize_angle", BASE + "SELECT vec_id, greatest(0, least(63, floor((angle + pi()) * 64 / (2 * pi()))))::INTEGER AS q FROM d")
def _(spark, sf):
    return descriptors(spark, sf).select("vec_id", v.quantized_angle(F.col("angle")).alias("q"))


@query("ldc_cornerness", BASE + "SELECT d.vec_id, round(d.cornerness * d.cornerness / 5 + sqrt(c.n_chars), 6) AS cornerness FROM d JOIN documents c ON c.doc_id = d.vec_id")
def _(spark, sf):
    saliency = table(spark, sf, "documents").select(F.col("doc_id").alias("vec_id"), "n_chars")
    return descriptors(spark, sf).join(saliency, "vec_id").select("vec_id", r6(F.col("cornerness") * F.col("cornerness") / 5 + F.sqrt("n_chars")).alias("cornerness"))


@query("desc_scale", "SELECT p_partkey, round(CASE WHEN p_size * p_retailprice > 10000 THEN sqrt(10000 / (p_size * p_retailprice)) ELSE 1 END, 6) AS f FROM part")
def _(spark, sf):
    pixels = F.col("p_size") * F.col("p_retailprice")
    return table(spark, sf, "part").select("p_partkey", r6(F.when(pixels > 10000, F.sqrt(10000 / pixels)).otherwise(1.0)).alias("f"))


@query("invert_affine", BASE + """SELECT vec_id, round(e / det, 6) + 0.0 AS a0, round((b * f - e * c) / det, 6) + 0.0 AS a2, round(-dd / det, 6) + 0.0 AS a3
    FROM (SELECT *, a * e - b * dd AS det FROM (SELECT vec_id, 1 + vec[1] AS a, vec[2] AS b, x AS c, vec[3] AS dd, 1 + vec[4] AS e, y AS f FROM d))""")
def _(spark, sf):
    at = lambda i: F.col("vec")[i]
    m = F.array(1 + at(0), at(1), F.col("x"), at(2), 1 + at(3), F.col("y"))
    inverse = descriptors(spark, sf).select("vec_id", m.alias("m")).select("vec_id", v.inverse_affine(F.col("m")).alias("i"))
    return inverse.select("vec_id", *[(r6(F.col("i")[k])).alias(f"a{k}") for k in (0, 2, 3)])


@query("allowed_file", "SELECT page_id, regexp_matches(regexp_extract(url, '[^/]*$'), '\\.(png|jpg|jpeg)$') AS ok FROM pages")
def _(spark, sf):
    return table(spark, sf, "pages").select("page_id", F.regexp_extract("url", "[^/]*$", 0).rlike(r"\.(png|jpg|jpeg)$").alias("ok"))


@query("hashed_name", "SELECT page_id, md5(page_id::VARCHAR) || '_' || md5(url) || '.jpg' AS name FROM pages")
def _(spark, sf):
    return table(spark, sf, "pages").select("page_id", F.concat(F.md5(F.col("page_id").cast("string")), F.lit("_"), F.md5("url"), F.lit(".jpg")).alias("name"))


@query("apply_homography", BASE + "SELECT vec_id, round((1.1::DOUBLE * x + 0.2::DOUBLE * y + 5) / (0.001::DOUBLE * x + 1), 6) AS u, round((0.1::DOUBLE * x + 0.9::DOUBLE * y - 3) / (0.001::DOUBLE * x + 1), 6) AS w FROM d")
def _(spark, sf):
    x, y = F.col("x"), F.col("y")
    below = 0.001 * x + 1
    return descriptors(spark, sf).select("vec_id", r6((1.1 * x + 0.2 * y + 5) / below).alias("u"), r6((0.1 * x + 0.9 * y - 3) / below).alias("w"))


# words -------------------------------------------------------------------------------------------


@query("cross_distances", BASE + "SELECT vec_id, vw, round(d2, 6) AS d2 FROM dist")
def _(spark, sf):
    return knn.cross_distances(descriptors(spark, sf), codebook(spark, sf)).select("vec_id", F.col("centroid_id").alias("vw"), r6(F.col("d2")).alias("d2"))


@query("cross_l1", BASE + "SELECT d.vec_id, cb.vw, round(list_sum(list_transform(list_zip(d.vec, cb.centroid), lambda z: abs(z[1] - z[2]))), 6) AS d1 FROM d CROSS JOIN cb")
def _(spark, sf):
    return knn.cross_distances(descriptors(spark, sf), codebook(spark, sf), "l1").select("vec_id", F.col("centroid_id").alias("vw"), r6(F.col("d2")).alias("d1"))


@query("cross_chi2", BASE + """SELECT d.vec_id, cb.vw, round(list_sum(list_transform(list_zip(d.vec, cb.centroid), lambda z:
    CASE WHEN abs(z[1]) + abs(z[2]) = 0 THEN 0 ELSE (abs(z[1]) - abs(z[2])) * (abs(z[1]) - abs(z[2])) / (abs(z[1]) + abs(z[2])) END)), 6) AS d FROM d CROSS JOIN cb""")
def _(spark, sf):
    absolute = lambda df, c: df.withColumn(c, F.transform(c, lambda x: F.abs(x)))
    found = knn.cross_distances(absolute(descriptors(spark, sf), "vec"), absolute(codebook(spark, sf), "centroid"), "chi2")
    return found.select("vec_id", F.col("centroid_id").alias("vw"), r6(F.col("d2")).alias("d"))


@query("assign_1nn", BASE + "SELECT vec_id, vw, round(d2, 6) AS d2 FROM asg")
def _(spark, sf):
    return assigned(spark, sf).select("vec_id", "vw", r6(F.col("d2")).alias("d2"))


@query("assign_knn", BASE + "SELECT vec_id, vw, rnk::INTEGER AS rnk, round(d2, 6) AS d2 FROM ranked WHERE rnk <= 5")
def _(spark, sf):
    return knn.nearest(descriptors(spark, sf), codebook(spark, sf), 5).select("vec_id", F.col("centroid_id").alias("vw"), "rnk", r6(F.col("d2")).alias("d2"))


@query("assign_weighted", BASE + "SELECT vec_id, vw, round(w, 6) AS d2 FROM (SELECT vec_id, vw, d2 * (1 + vw / 10.0::DOUBLE) AS w FROM dist) QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY w, vw) = 1")
def _(spark, sf):
    weighted = codebook(spark, sf).withColumn("weight", 1 + F.col("vw") / 10.0)
    return knn.nearest(descriptors(spark, sf), weighted).select("vec_id", F.col("centroid_id").alias("vw"), r6(F.col("d2")).alias("d2"))


def _coarse(spark, sf) -> DataFrame:
    return codebook(spark, sf).where("vw < 4").withColumnRenamed("vw", "node")


_ANN = BASE + """, leafnode AS (SELECT a.vw AS leaf, b.vw AS node, row_number() OVER (PARTITION BY a.vw ORDER BY list_sum(list_transform(list_zip(a.centroid, b.centroid), lambda z: (z[1] - z[2]) * (z[1] - z[2]))), b.vw) AS r
  FROM cb a CROSS JOIN (SELECT * FROM cb WHERE vw < 4) b
), edges AS (SELECT asg.vw AS leaf, co.node FROM asg JOIN (SELECT vec_id, vw AS node FROM dist WHERE vw < 4 QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY d2, vw) = 1) co USING (vec_id) GROUP BY ALL HAVING count(*) >= 2
), near AS (SELECT vec_id, vw AS node, row_number() OVER (PARTITION BY vec_id ORDER BY d2, vw) AS r FROM dist WHERE vw < 4
), tried AS (SELECT DISTINCT n.vec_id, dist.vw, dist.d2, n.r FROM near n JOIN edges e USING (node) JOIN dist ON dist.vec_id = n.vec_id AND dist.vw = e.leaf)
"""


def _edges(spark, sf, least: int = 2) -> DataFrame:
    """Leaves and nodes that are nearest to the same points, `least` of them."""
    d = descriptors(spark, sf).select("vec_id", "vec")
    node = knn.nearest(d, _coarse(spark, sf)).select("vec_id", F.col("centroid_id").alias("node"))
    leaf = knn.nearest(d, codebook(spark, sf)).select("vec_id", F.col("centroid_id").alias("leaf"))
    return knn.co_assignment_edges(node, leaf, least)


@query("ann_assign", _ANN + "SELECT vec_id, vw AS leaf, round(d2, 6) AS d2 FROM (SELECT DISTINCT vec_id, vw, d2 FROM tried WHERE r = 1) QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY d2, vw) = 1")
def _(spark, sf):
    found = knn.assign_two_level(descriptors(spark, sf).select("vec_id", "vec"), _coarse(spark, sf), _edges(spark, sf).select("leaf", "node"), codebook(spark, sf))
    return found.select("vec_id", "leaf", r6(F.col("d2")).alias("d2"))


@query("ann_assign_k", _ANN + "SELECT vec_id, vw AS leaf, round(d2, 6) AS d2 FROM (SELECT DISTINCT vec_id, vw, d2 FROM tried WHERE r <= 2) QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY d2, vw) <= 3")
def _(spark, sf):
    found = knn.assign_two_level(descriptors(spark, sf).select("vec_id", "vec"), _coarse(spark, sf), _edges(spark, sf).select("leaf", "node"), codebook(spark, sf), 3, 2)
    return found.select("vec_id", "leaf", r6(F.col("d2")).alias("d2"))


@query("ann_edges", BASE + ", co AS (SELECT vec_id, vw AS node FROM dist WHERE vw < 4 QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY d2, vw) = 1) SELECT asg.vw AS leaf, co.node, count(*) AS n FROM asg JOIN co USING (vec_id) GROUP BY ALL HAVING count(*) >= 3")
def _(spark, sf):
    return _edges(spark, sf, 3)


@query("ann_default_edges", _ANN + "SELECT leaf, node FROM leafnode WHERE r = 1")
def _(spark, sf):
    leaves = codebook(spark, sf).select(F.col("vw").alias("leaf"), F.col("centroid").alias("vec"))
    return knn.nearest(leaves, _coarse(spark, sf)).select("leaf", F.col("centroid_id").alias("node"))


@query("hkm_quantize", BASE + """, l1 AS (SELECT vec_id, vw AS word FROM dist WHERE vw < 4 QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY d2 * (1 + vw / 20.0::DOUBLE), vw) = 1)
    SELECT l1.vec_id, l1.word * 3 + c.child AS word FROM l1 JOIN (SELECT vw, (vw - 4) // 3 AS parent, (vw - 4) % 3 AS child FROM cb WHERE vw >= 4) c ON c.parent = l1.word
    JOIN dist ON dist.vec_id = l1.vec_id AND dist.vw = c.vw QUALIFY row_number() OVER (PARTITION BY l1.vec_id ORDER BY d2, child) = 1""")
def _(spark, sf):
    cb = codebook(spark, sf)
    top = cb.where("vw < 4").select(F.lit(0).cast("long").alias("parent"), F.col("vw").alias("child"), "centroid", (1 + F.col("vw") / 20.0).alias("factor"))
    low = cb.where("vw >= 4").select(F.floor((F.col("vw") - 4) / 3).cast("long").alias("parent"), ((F.col("vw") - 4) % 3).alias("child"), "centroid", F.lit(1.0).alias("factor"))
    return knn.tree_assign(descriptors(spark, sf).select("vec_id", "vec"), [top, low]).select("vec_id", "word")


@query("hkm_learn")
def _(spark, sf):
    return clustering.hierarchical_kmeans(descriptors(spark, sf).select("vec_id", "vec"), branch=3, levels=2, rounds=4)


@query("balance_factors", BASE + """, c AS (SELECT vw, count(*) AS n FROM asg GROUP BY vw)
    SELECT vw, round(pow(n / ((SELECT sum(n) FROM c) / (SELECT count(*) FROM c)), 0.5::DOUBLE / sqrt(64)), 6) AS factor FROM c""")
def _(spark, sf):
    counts = assigned(spark, sf).groupBy("vw").agg(F.count("*").alias("n"))
    return clustering.balance_step(counts, 64).select("vw", r6(F.col("factor")).alias("factor"))


@query("assign_balanced", BASE + """, c AS (SELECT vw, count(*) AS n FROM asg GROUP BY vw), f AS (SELECT vw, pow(n / ((SELECT sum(n) FROM c) / (SELECT count(*) FROM c)), 0.5::DOUBLE / sqrt(64)) AS factor FROM c)
    SELECT vec_id, vw FROM dist JOIN f USING (vw) QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY d2 * factor, vw) = 1""")
def _(spark, sf):
    counts = assigned(spark, sf).groupBy("vw").agg(F.count("*").alias("n"))
    factors = clustering.balance_step(counts, 64).select("vw", F.col("factor").alias("weight"))
    found = knn.nearest(descriptors(spark, sf), codebook(spark, sf).join(factors, "vw"))
    return found.select("vec_id", F.col("centroid_id").alias("vw"))


@query("point_to_points", BASE + "SELECT d.vec_id, round(dist.d2, 6) AS d2 FROM d JOIN dist USING (vec_id) WHERE dist.vw = 3")
def _(spark, sf):
    one = codebook(spark, sf).where("vw = 3")
    return knn.nearest(descriptors(spark, sf), one).select("vec_id", r6(F.col("d2")).alias("d2"))


@query("lsh_assign")
def _(spark, sf):
    return clustering.lsh_neighbours(descriptors(spark, sf).select("vec_id", "vec"), codebook(spark, sf))


# learning ----------------------------------------------------------------------------------------


@query("kmeans_step", BASE + "SELECT asg.vw, i.i, round(avg(asg.vec[i.i + 1]), 6) + 0.0 AS value FROM asg CROSS JOIN (SELECT unnest(range(0, 64)) AS i) i GROUP BY ALL")
def _(spark, sf):
    step = clustering.kmeans_step(descriptors(spark, sf).select("vec_id", "vec"), codebook(spark, sf))
    return step.select("vw", F.posexplode("centroid").alias("i", "value")).select("vw", F.col("i").cast("long").alias("i"), r6(F.col("value")).alias("value"))


@query("kmeans")
def _(spark, sf):
    return clustering.kmeans(descriptors(spark, sf).select("vec_id", "vec"), 8, rounds=6)


@query("kmeans_n")
def _(spark, sf):
    return clustering.best_kmeans(descriptors(spark, sf).select("vec_id", "vec"), 6, rounds=3, starts=2)


@query("kmedoids_cost", BASE + """, cost AS (SELECT dist.vec_id, min(d2) FILTER (vw < 4) AS now, min(d2) FILTER (vw < 3) AS kept FROM dist GROUP BY vec_id)
    SELECT dist.vw AS candidate, round(sum(least(cost.kept, dist.d2)) - (SELECT sum(now) FROM cost), 6) AS change FROM cost JOIN dist USING (vec_id) WHERE dist.vw >= 4 GROUP BY dist.vw""")
def _(spark, sf):
    found = clustering.medoid_swaps(descriptors(spark, sf).select("vec_id", "vec"), codebook(spark, sf), medoids=[0, 1, 2, 3], leaving=3)
    return found.select("candidate", r6(F.col("change")).alias("change"))


@query("cdm_iteration", BASE + """, r AS (SELECT vw, avg(d2) AS r FROM (SELECT *, row_number() OVER (PARTITION BY vw ORDER BY d2, vec_id) AS k FROM dist) WHERE k <= 10 GROUP BY vw)
    SELECT vw, round(pow(exp((SELECT avg(ln(r)) FROM r)) / r, 0.5::DOUBLE), 6) AS factor FROM r""")
def _(spark, sf):
    d = knn.cross_distances(descriptors(spark, sf).select("vec_id", "vec").where("vec_id >= 0"), codebook(spark, sf))
    return clustering.distance_correction(d.withColumnRenamed("centroid_id", "vw"), 10, 0.5).select("vw", r6(F.col("factor")).alias("factor"))


@query("covariance", BASE + """, p AS (SELECT i.i, j.i AS j, avg(d.vec[i.i + 1] * d.vec[j.i + 1]) - avg(d.vec[i.i + 1]) * avg(d.vec[j.i + 1]) AS c FROM d CROSS JOIN (SELECT unnest(range(0, 64)) AS i) i CROSS JOIN (SELECT unnest(range(0, 64)) AS i) j GROUP BY ALL)
    SELECT i, j, round(c, 6) + 0.0 AS c FROM p""")
def _(spark, sf):
    vecs = descriptors(spark, sf).select("vec_id", "vec")
    return clustering.covariance(vecs).select("i", "j", r6(F.col("c")).alias("c"))


@query("pca")
def _(spark, sf):
    return clustering.principal_components(descriptors(spark, sf).select("vec_id", "vec"), 8)


@query("hadamard_project", BASE + "SELECT vec_id, bit, round(v, 6) + 0.0 AS v FROM proj")
def _(spark, sf):
    p = hamming.project(descriptors(spark, sf).select("vec_id", "vec"), hamming.hadamard(BITS))
    return p.select("vec_id", F.posexplode("proj").alias("bit", "v")).select("vec_id", F.col("bit").cast("long").alias("bit"), r6(F.col("v")).alias("v"))


@query("unbalance_factor", BASE + "SELECT round(16 * sum(n * n) / pow(sum(n), 2), 6) AS uf FROM (SELECT vw, count(*)::DOUBLE AS n FROM asg GROUP BY vw)")
def _(spark, sf):
    n = F.col("n")
    return assigned(spark, sf).groupBy("vw").agg(F.count("*").alias("n")).agg(r6(WORDS * F.sum(n * n) / F.pow(F.sum(n), F.lit(2))).alias("uf"))


@query("desc_subset", "SELECT vec_id FROM embeddings ORDER BY md5(vec_id::VARCHAR), vec_id LIMIT 100")
def _(spark, sf):
    return clustering.subset(table(spark, sf, "embeddings"), "vec_id", 100).select("vec_id")


# signatures --------------------------------------------------------------------------------------


def _projected(spark, sf) -> DataFrame:
    return stored(hamming.project(assigned(spark, sf), hamming.hadamard(BITS)), "projected")


@query("he_project", BASE + "SELECT vec_id, round(sum(abs(v)), 6) AS s FROM proj GROUP BY vec_id")
def _(spark, sf):
    return _projected(spark, sf).select("vec_id", r6(v.norm(F.col("proj"), 1)).alias("s"))


@query("he_medians", BASE + "SELECT vw, bit, round(m, 6) + 0.0 AS m FROM med")
def _(spark, sf):
    return hamming.medians(_projected(spark, sf)).select("vw", F.posexplode("medians").alias("bit", "m")).select("vw", F.col("bit").cast("long").alias("bit"), r6(F.col("m")).alias("m"))


@query("he_signature", BASE + "SELECT vec_id, lo, hi FROM sig")
def _(spark, sf):
    low = F.lit((1 << 32) - 1).cast("long")
    return postings(spark, sf).select("vec_id", F.col("binsign").bitwiseAND(low).alias("lo"), F.shiftrightunsigned("binsign", 32).alias("hi"))


@query("he_signature_wide", BASE + "SELECT vec_id, bit_count(lo) + bit_count(hi) AS n FROM sig")
def _(spark, sf):
    p = _projected(spark, sf)
    wide = hamming.wide_signatures(p.withColumn("proj", F.concat("proj", "proj")), hamming.medians(p).withColumn("medians", F.concat("medians", "medians")), 128)
    return wide.select("vec_id", F.bit_count(F.col("binsigns")[1]).alias("n"))


_HAM = "bit_count(xor(a.lo, b.lo)) + bit_count(xor(a.hi, b.hi))"


@query("hamming", BASE + f"SELECT a.vec_id, {_HAM} AS hd FROM post a JOIN post b ON a.image_id = b.image_id AND b.pt = 0")
def _(spark, sf):
    p = postings(spark, sf)
    first = p.where("pt = 0").select("image_id", F.col("binsign").alias("b"))
    return p.join(first, "image_id").select("vec_id", v.hamming(F.col("binsign"), F.col("b")).cast("int").alias("hd"))


@query("hamming_cross", BASE + f"SELECT a.vec_id AS a, b.vec_id AS b, {_HAM} AS hd FROM post a JOIN post b ON a.vec_id % 20 = 0 AND {_HAM} <= 20")
def _(spark, sf):
    p = postings(spark, sf).select("vec_id", "binsign")
    return hamming.near_signatures(p.where("vec_id % 20 = 0"), p, 20).select("a", "b", "hd")


# inverted file -----------------------------------------------------------------------------------


@query("ivf_build", BASE + "SELECT vw, image_id, pt, qscale, qangle FROM post")
def _(spark, sf):
    return postings(spark, sf).select("vw", "image_id", "pt", "qscale", "qangle")


@query("ivf_merge", BASE + "SELECT vw, image_id, pt FROM post WHERE image_id < 10 UNION ALL SELECT vw, image_id + 1000, pt FROM post WHERE image_id >= 10")
def _(spark, sf):
    p = assigned(spark, sf).select("vw", "image_id", "pt")
    return inverted.merge(p.where("image_id < 10"), p.where("image_id >= 10"), 1000)


@query("ivf_crop", BASE + "SELECT vw, image_id, pt FROM post WHERE image_id < 20")
def _(spark, sf):
    return assigned(spark, sf).where("image_id < 20").select("vw", "image_id", "pt")


@query("ivf_max_label", BASE + "SELECT coalesce(max(image_id), -1) AS label FROM post")
def _(spark, sf):
    return descriptors(spark, sf).agg(F.coalesce(F.max("image_id"), F.lit(-1)).alias("label"))


@query("ivf_dedup", BASE + "SELECT vw, image_id, pt, qscale FROM post QUALIFY row_number() OVER (PARTITION BY vw, image_id ORDER BY pt) = 1")
def _(spark, sf):
    return inverted.first_of_word(postings(spark, sf)).select("vw", "image_id", "pt", "qscale")


@query("ivf_check", BASE + "SELECT count(*) AS n, count(*) FILTER (vw < 0 OR vw >= 16 OR qscale > 31 OR qangle > 63)::BIGINT AS bad, count(DISTINCT image_id) AS images FROM post")
def _(spark, sf):
    bad = (F.col("vw") < 0) | (F.col("vw") >= WORDS) | (F.col("qscale") > 31) | (F.col("qangle") > 63)
    return postings(spark, sf).agg(F.count("*").alias("n"), F.count_if(bad).alias("bad"), F.count_distinct("image_id").alias("images"))


@query("tfidf", BASE + "SELECT vw, n, round(w, 6) AS w FROM words")
def _(spark, sf):
    return inverted.word_weights(assigned(spark, sf), codebook(spark, sf)).select("vw", "n", r6(F.col("w")).alias("w"))


@query("image_norms", BASE + "SELECT image_id, round(l1, 6) AS l1, round(l2, 6) AS l2, round(l3, 6) AS l3 FROM norms")
def _(spark, sf):
    return inverted.image_norms(assigned(spark, sf)).select("image_id", *[r6(F.col(c)).alias(c) for c in ("l1", "l2", "l3")])


@query("scale_weights", BASE + "SELECT vec_id, round(exp(qscale * 0.06::DOUBLE), 6) AS w FROM post")
def _(spark, sf):
    return inverted.with_geometry(descriptors(spark, sf)).select("vec_id", r6(F.exp(F.col("qscale") * 0.06)).alias("w"))


@query("he_weights", BASE + "SELECT query_id, dqid, image_id, pt, round(64 * exp(-(hd::DOUBLE * hd) / 256), 6) AS w2, round(hw, 6) AS w1 FROM pairs JOIN hew USING (hd)")
def _(spark, sf):
    p = postings(spark, sf)
    pairs = inverted.probe(query_points(p), p, 64)
    joined = pairs.join(inverted.he_weights(spark, 1), "hd").join(inverted.he_weights(spark, 2).withColumnRenamed("hw", "h2"), "hd")
    return joined.select("query_id", "dqid", "image_id", "pt", r6(F.col("h2")).alias("w2"), r6(F.col("hw")).alias("w1"))


@query("wgc_weights", BASE + "SELECT vec_id, round(wt, 6) AS w FROM post JOIN wgcw ON dim = 'angle' AND bin = qangle")
def _(spark, sf):
    weights = inverted.wgc_weights(spark).where("dim = 'angle'").select(F.col("bin").alias("qangle"), "wt")
    return inverted.with_geometry(descriptors(spark, sf)).join(weights, "qangle").select("vec_id", r6(F.col("wt")).alias("w"))


def _votes(spark, sf) -> DataFrame:
    p = postings(spark, sf)
    return inverted.votes(inverted.probe(query_points(p), p, HAMMING), inverted.word_weights(p, codebook(spark, sf)), PARAMS)


_KEYS = ("query_id", "dqid", "image_id", "pt")


@query("ivf_probe", BASE + "SELECT query_id, dqid, image_id, pt, da::INTEGER AS da, ds::INTEGER AS ds, round(score, 6) AS score FROM votes")
def _(spark, sf):
    return _votes(spark, sf).select(*_KEYS, F.col("da").cast("int").alias("da"), F.col("ds").cast("int").alias("ds"), r6(F.col("score")).alias("score"))


@query("burst_cancel_mm", BASE + "SELECT query_id, dqid, image_id, pt, round(s1, 6) AS score FROM intra QUALIFY row_number() OVER (PARTITION BY query_id, image_id, vw, dqid ORDER BY score DESC, pt) = 1")
def _(spark, sf):
    return inverted.damp_within_images(_votes(spark, sf), 0, True).select(*_KEYS, r6(F.col("score")).alias("score"))


_FACTORS = {0: "sqrt(score / sum(score) OVER g)", 1: "sqrt(score / max(score) OVER g)", 2: "ln(1 + score / sum(score) OVER g)", 3: "ln(1 + score / max(score) OVER g)", 4: "sqrt(1.0::DOUBLE / count(*) OVER g)", 5: "1.0::DOUBLE / count(*) OVER g"}
for _kind, _factor in _FACTORS.items():

    @query(f"burst_intra_{_kind}", BASE + f"SELECT query_id, dqid, image_id, pt, round(CASE WHEN count(*) OVER g >= 2 THEN score * {_factor} ELSE score END, 6) AS score FROM votes WINDOW g AS (PARTITION BY query_id, image_id, vw)")
    def _(spark, sf, kind=_kind):
        return inverted.damp_within_images(_votes(spark, sf), kind).select(*_KEYS, r6(F.col("score")).alias("score"))


def _damped(spark, sf) -> DataFrame:
    return inverted.damp_between_images(inverted.damp_within_images(_votes(spark, sf)))


@query("burst_inter", BASE + "SELECT query_id, dqid, image_id, pt, round(s2, 6) AS score FROM burst")
def _(spark, sf):
    return _damped(spark, sf).select(*_KEYS, r6(F.col("score")).alias("score"))


@query("wgc_hist", BASE + "SELECT query_id, image_id, dim, bin::INTEGER AS bin, round(s, 6) AS s FROM bins")
def _(spark, sf):
    return inverted.histograms(_damped(spark, sf)).select("query_id", "image_id", "dim", "bin", r6(F.col("s")).alias("s"))


@query("wgc_score", BASE + "SELECT query_id, image_id, round(score, 6) AS score FROM wgc")
def _(spark, sf):
    found = inverted.geometric_scores(inverted.histograms(_damped(spark, sf)), inverted.wgc_weights(spark), 5)
    return found.select("query_id", "image_id", r6(F.col("score")).alias("score"))


def _scores(spark, sf) -> DataFrame:
    p = postings(spark, sf)
    q = query_points(p)
    norms = inverted.image_norms(p)
    of_queries = norms.where(F.col("image_id") % EVERY == 0).withColumnRenamed("image_id", "query_id")
    return inverted.score_images(q, p, inverted.word_weights(p, codebook(spark, sf)), norms, of_queries, PARAMS)


@query("ivf_normalize", BASE + "SELECT query_id, image_id, round(score, 6) AS score FROM scores WHERE score > 0")
def _(spark, sf):
    return _scores(spark, sf).where("score > 0").select("query_id", "image_id", r6(F.col("score")).alias("score"))


@query("ivf_search_topk", BASE + "SELECT query_id, image_id, round(score, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, image_id)::INTEGER AS rnk FROM scores QUALIFY rnk <= 20")
def ivf_search_topk(spark, sf):
    p = postings(spark, sf)
    return inverted.search(query_points(p), p, codebook(spark, sf), PARAMS).select("query_id", "image_id", r6(F.col("score")).alias("score"), "rnk")


@query("ivf_scores_all", BASE + "SELECT query_id, image_id, round(score, 6) AS score FROM scores")
def _(spark, sf):
    return _scores(spark, sf).select("query_id", "image_id", r6(F.col("score")).alias("score"))


@query("ivf_multi_query", BASE + "SELECT query_id, count(*) AS n, round(max(score), 6) AS best FROM scores GROUP BY query_id")
def _(spark, sf):
    return _scores(spark, sf).groupBy("query_id").agg(F.count("*").alias("n"), r6(F.max("score")).alias("best"))


@query("probe_stats", BASE + f"SELECT query_id, count(*) AS visited, count(*) FILTER (hd <= {HAMMING})::BIGINT AS hits, count(DISTINCT image_id) FILTER (hd <= {HAMMING}) AS images FROM pairs GROUP BY query_id")
def _(spark, sf):
    p = postings(spark, sf)
    near = F.col("hd") <= HAMMING
    return inverted.probe(query_points(p), p, 64).groupBy("query_id").agg(F.count("*").alias("visited"), F.count_if(near).alias("hits"), F.count_distinct(F.when(near, F.col("image_id"))).alias("images"))


@query("ivf_summary", BASE + "SELECT count(*) AS n, count(DISTINCT image_id) AS images, count(DISTINCT vw) AS words, max(n)::BIGINT AS longest FROM (SELECT *, count(*) OVER (PARTITION BY vw) AS n FROM post)")
def _(spark, sf):
    a = assigned(spark, sf)
    return a.groupBy("vw").agg(F.count("*").alias("m")).agg(F.sum("m").alias("n"), F.count("*").alias("words"), F.max("m").alias("longest")).crossJoin(a.agg(F.count_distinct("image_id").alias("images")))


@query("burst_hist", BASE + "SELECT least(m, 5)::BIGINT AS length, count(*) AS n FROM (SELECT count(*) AS m FROM post GROUP BY vw, image_id) GROUP BY 1")
def _(spark, sf):
    return inverted.run_lengths(assigned(spark, sf), 5).select(F.col("length").cast("long").alias("length"), "n")


@query("id_gap_hist", BASE + "SELECT gap, count(*) AS n FROM (SELECT image_id - coalesce(lag(image_id) OVER (PARTITION BY vw ORDER BY image_id, pt), -1) AS gap FROM post) GROUP BY gap")
def _(spark, sf):
    return inverted.gap_lengths(assigned(spark, sf))


@query("index_filter", BASE + "SELECT image_id, pt FROM d QUALIFY row_number() OVER (PARTITION BY image_id ORDER BY cornerness DESC, pt) <= 5 AND cornerness >= 80")
def _(spark, sf):
    return points.strongest(descriptors(spark, sf), 5).where("cornerness >= 80").select("image_id", "pt")


@query("bow_l1_topk", BASE + """, bow AS (SELECT image_id, vw, count(*) * any_value(w) / (SELECT 1) AS x FROM post JOIN words USING (vw) GROUP BY image_id, vw),
    nb AS (SELECT image_id, vw, x / sum(x) OVER (PARTITION BY image_id) AS x FROM bow),
    common AS (SELECT a.image_id AS query_id, b.image_id, sum(abs(a.x - b.x) - a.x - b.x) AS s FROM nb a JOIN nb b USING (vw) WHERE a.image_id % 20 = 0 GROUP BY ALL)
    SELECT q.query_id, i.image_id, round(2 + coalesce(s, 0), 6) + 0.0 AS d FROM (SELECT DISTINCT image_id AS query_id FROM nb WHERE image_id % 20 = 0) q CROSS JOIN (SELECT DISTINCT image_id FROM nb) i LEFT JOIN common c ON c.query_id = q.query_id AND c.image_id = i.image_id
    QUALIFY row_number() OVER (PARTITION BY q.query_id ORDER BY round(2 + coalesce(s, 0), 9), i.image_id) <= 10""")
def _(spark, sf):
    a = assigned(spark, sf)
    bow = a.groupBy("image_id", "vw").agg(F.count("*").alias("n")).join(inverted.word_weights(a, codebook(spark, sf)).select("vw", "w"), "vw")
    bow = bow.select("image_id", "vw", (F.col("n") * F.col("w")).alias("x"))
    bow = bow.withColumn("x", F.col("x") / F.sum("x").over(Window.partitionBy("image_id")))
    q = bow.where(F.col("image_id") % EVERY == 0).select(F.col("image_id").alias("query_id"), "vw", F.col("x").alias("y"))
    # |x - y| summed over both vectors is 2 plus what the common words take off
    common = bow.join(q, "vw").groupBy("query_id", "image_id").agg(F.sum(F.abs(F.col("x") - F.col("y")) - F.col("x") - F.col("y")).alias("s"))
    nearest = inverted.filled(common.select("query_id", "image_id", (-F.round(2 + F.col("s"), 9)).alias("score")), q.select("query_id").distinct(), bow.select("image_id").distinct(), 10, -2.0)
    return nearest.select("query_id", "image_id", r6(-F.col("score")).alias("d"))
