"""Queries on product-quantised vectors. Cells are the subvectors of the codebook's vectors."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators import knn, lists, shards
from tessera.operators import quantization as pq
from tessera.plans.fixtures import BASE, codebook, descriptors
from tessera.plans.registry import query
from tessera.plans.retrieval import r6
from tessera.sources.scratch import stored

P = BASE[:-1] + """, sub AS (SELECT d.vec_id, q.q, d.vec[q.q * 8 + 1 : q.q * 8 + 8] AS v FROM d CROSS JOIN (SELECT unnest(range(0, 8)) AS q) q
), pc AS (SELECT vec_id AS c, q, v FROM sub WHERE vec_id < 16
), pd AS (SELECT sub.vec_id, sub.q, pc.c, list_sum(list_transform(list_zip(sub.v, pc.v), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS d2 FROM sub JOIN pc USING (q)
), code AS (SELECT vec_id, q, c, d2 FROM pd QUALIFY row_number() OVER (PARTITION BY vec_id, q ORDER BY d2, c) = 1
), err AS (SELECT pc.q, pc.c, coalesce(avg(code.d2), 0) AS e FROM pc LEFT JOIN code USING (q, c) GROUP BY ALL
), between AS (SELECT a.q, a.c AS c1, b.c AS c2, list_sum(list_transform(list_zip(a.v, b.v), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS d2 FROM pc a JOIN pc b USING (q)
), adc AS (SELECT pd.vec_id AS query_id, code.vec_id, sum(pd.d2) AS d2, sum(pd.d2 + err.e) AS cor FROM pd JOIN code USING (q, c) JOIN err USING (q, c) WHERE pd.vec_id % 20 = 0 GROUP BY ALL
), sdc AS (SELECT a.vec_id AS query_id, b.vec_id, sum(w.d2) AS d2, sum(w.d2 + ea.e + eb.e) AS cor FROM code a JOIN code b USING (q) JOIN between w ON w.q = a.q AND w.c1 = a.c AND w.c2 = b.c JOIN err ea ON ea.q = a.q AND ea.c = a.c JOIN err eb ON eb.q = b.q AND eb.c = b.c WHERE a.vec_id % 20 = 0 GROUP BY ALL
), rest AS (SELECT asg.vec_id, asg.vw, list_transform(list_zip(asg.vec, cb.centroid), lambda z: z[1] - z[2]) AS v FROM asg JOIN cb USING (vw)
), rsub AS (SELECT vec_id, vw, q.q, v[q.q * 8 + 1 : q.q * 8 + 8] AS v FROM rest CROSS JOIN (SELECT unnest(range(0, 8)) AS q) q
), rpc AS (SELECT vec_id - 16 AS c, q, v FROM rsub WHERE vec_id BETWEEN 16 AND 31
), rcode AS (SELECT rsub.vec_id, rsub.vw, rsub.q, rpc.c FROM rsub JOIN rpc USING (q) QUALIFY row_number() OVER (PARTITION BY rsub.vec_id, rsub.q ORDER BY list_sum(list_transform(list_zip(rsub.v, rpc.v), lambda z: (z[1] - z[2]) * (z[1] - z[2]))), rpc.c) = 1
), probe AS (SELECT r.vec_id AS query_id, r.vw, q.q, list_transform(list_zip(d.vec, cb.centroid), lambda z: z[1] - z[2])[q.q * 8 + 1 : q.q * 8 + 8] AS v FROM ranked r JOIN d USING (vec_id) JOIN cb USING (vw) CROSS JOIN (SELECT unnest(range(0, 8)) AS q) q WHERE r.rnk <= 3 AND r.vec_id % 20 = 0
), ivf AS (SELECT p.query_id, p.vw, rc.vec_id, sum(list_sum(list_transform(list_zip(p.v, rpc.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))) AS d2 FROM probe p JOIN rcode rc USING (vw, q) JOIN rpc ON rpc.q = p.q AND rpc.c = rc.c GROUP BY ALL)
"""


def _points(spark, sf) -> DataFrame:
    return descriptors(spark, sf).select("vec_id", "vec")


def _model(spark, sf) -> pq.ProductQuantizer:
    return pq.from_rows([r["centroid"] for r in sorted(codebook(spark, sf).collect(), key=lambda r: r["vw"])], 8)


def _queries(spark, sf) -> DataFrame:
    return _points(spark, sf).where("vec_id % 20 = 0").withColumnRenamed("vec_id", "query_id")


@query("pq_subvectors", P + "SELECT vec_id, q, round(list_sum(v), 6) + 0.0 AS s FROM sub")
def _(spark, sf):
    parts = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda q: F.struct(q.alias("q"), F.aggregate(F.slice("vec", q * 8 + 1, F.lit(8)), F.lit(0.0), lambda a, x: a + x).alias("s")))
    return _points(spark, sf).select("vec_id", F.explode(parts).alias("p")).select("vec_id", F.col("p.q").cast("long").alias("q"), r6(F.col("p.s")).alias("s"))


@query("pq_encode", P + "SELECT vec_id, q, c FROM code")
def _(spark, sf):
    coded = pq.encode(_points(spark, sf), _model(spark, sf))
    return coded.select("vec_id", F.posexplode("codes").alias("q", "c")).select("vec_id", F.col("q").cast("long").alias("q"), F.col("c").cast("long").alias("c"))


@query("pq_decode", P + "SELECT code.vec_id, round(sum(list_sum(pc.v)), 6) + 0.0 AS s FROM code JOIN pc USING (q, c) GROUP BY code.vec_id")
def _(spark, sf):
    rest = pq.residuals(_points(spark, sf), _model(spark, sf)).select("vec_id", F.col("vec").alias("rest"))
    whole = _points(spark, sf).join(rest, "vec_id").select("vec_id", F.zip_with("vec", "rest", lambda x, y: x - y).alias("v"))
    return whole.select("vec_id", r6(F.aggregate("v", F.lit(0.0), lambda a, x: a + x)).alias("s"))


@query("pq_residual", P + "SELECT vec_id, round(sum(d2), 6) + 0.0 AS e FROM code GROUP BY vec_id")
def _(spark, sf):
    rest = pq.residuals(_points(spark, sf), _model(spark, sf))
    return rest.select("vec_id", r6(F.aggregate("vec", F.lit(0.0), lambda a, x: a + x * x)).alias("e"))


def next_distances(spark, sf, **how) -> DataFrame:
    """Distances of every vector to the code of the next one."""
    model = pq.with_errors(_points(spark, sf), _model(spark, sf))
    coded = pq.encode(_points(spark, sf), model).select((F.col("vec_id") - 1).alias("query_id"), "vec_id", "codes")
    pairs = coded.join(_points(spark, sf).withColumnRenamed("vec_id", "query_id"), "query_id")
    return pq.pair_distances(pairs, model, **how).select("query_id", "vec_id", r6(F.col("d2")).alias("d2"))


def nearest_codes(spark, sf, symmetric: bool = False, corrected: bool = False) -> DataFrame:
    """The ten nearest codes of every twentieth vector."""
    model = pq.with_errors(_points(spark, sf), _model(spark, sf))
    coded = pq.encode(_points(spark, sf), model)
    return pq.search_codes(_queries(spark, sf), coded, model, 10, symmetric, corrected).select("query_id", "vec_id", "rnk")


_SUM = {"adc": "pd.d2", "adc_cor": "pd.d2 + eb.e", "sdc": "w.d2", "sdc_cor": "w.d2 + ea.e + eb.e"}
for _name, _column, _how in (("adc", "d2", {}), ("adc_cor", "cor", {"corrected": True}), ("sdc", "d2", {"symmetric": True}), ("sdc_cor", "cor", {"symmetric": True, "corrected": True})):

    @query(f"pq_{_name}", P + f"""SELECT a.vec_id AS query_id, b.vec_id, round(sum({_SUM[_name]}), 6) + 0.0 AS d2 FROM code a JOIN code b ON b.vec_id = a.vec_id + 1 AND b.q = a.q JOIN err ea ON ea.q = a.q AND ea.c = a.c JOIN err eb ON eb.q = b.q AND eb.c = b.c
        JOIN between w ON w.q = a.q AND w.c1 = a.c AND w.c2 = b.c JOIN pd ON pd.vec_id = a.vec_id AND pd.q = b.q AND pd.c = b.c GROUP BY ALL""")
    def _(spark, sf, how=_how):
        return next_distances(spark, sf, **how)

    @query(f"pq_nn_{_name}", P + f"SELECT query_id, vec_id, row_number() OVER (PARTITION BY query_id ORDER BY round({_column}, 9), vec_id)::INTEGER AS rnk FROM {_name[:3]} QUALIFY rnk <= 10")
    def _(spark, sf, how=_how):
        return nearest_codes(spark, sf, **how)


@query("pq_nn_fc", P + """SELECT query_id, vec_id, row_number() OVER (PARTITION BY query_id ORDER BY round(d2, 9), vec_id)::INTEGER AS rnk
    FROM (SELECT a.vec_id AS query_id, pd.vec_id, sum(pd.d2) AS d2 FROM code a JOIN pd USING (q, c) WHERE a.vec_id % 20 = 0 GROUP BY ALL) QUALIFY rnk <= 10""")
def _(spark, sf):
    """Codes of queries against vectors."""
    asked = pq.approximated(_queries(spark, sf), _model(spark, sf)).withColumn("tag", F.lit(0))
    return knn.nearest_in_blocks(asked, _points(spark, sf).withColumn("tag", F.lit(0)), 10).select("query_id", "vec_id", "rnk")


@query("pq_learn")
def _(spark, sf):
    model = pq.learn(_points(spark, sf), 2, 4, 3)
    coded = pq.encode(_points(spark, sf), model)
    return coded.select("vec_id", "codes")


@query("pq_kmeans_step", P + "SELECT a.c AS cell, code.q, mode(code.c ORDER BY code.c)::BIGINT AS c, count(*) AS n FROM code JOIN (SELECT vec_id, c FROM code WHERE q = 0) a USING (vec_id) WHERE code.q = 1 GROUP BY ALL")
def _(spark, sf):
    coded = pq.encode(_points(spark, sf), _model(spark, sf)).select(F.col("codes")[0].cast("long").alias("cell"), F.col("codes")[1].cast("long").alias("c"))
    counts = coded.groupBy("cell", "c").agg(F.count("*").alias("m"))
    best = counts.groupBy("cell").agg(F.min_by("c", F.struct(-F.col("m"), F.col("c"))).alias("c"), F.sum("m").alias("n"))
    return best.select("cell", F.lit(1).cast("long").alias("q"), "c", "n")


@query("pqr_rerank")
def _(spark, sf):
    points, first = _points(spark, sf), _model(spark, sf)
    rest = pq.residuals(points, first)
    second = pq.from_rows([r["vec"] for r in sorted(rest.where("vec_id between 16 and 31").collect(), key=lambda r: r["vec_id"])], 8)
    coded = pq.encode(rest.withColumnRenamed("codes", "first_codes"), second).select("vec_id", F.col("first_codes").alias("codes"), F.col("codes").alias("rest_codes"))
    short = pq.search_codes(_queries(spark, sf), coded.select("vec_id", "codes"), first, 30)
    return pq.rerank(short, coded, _queries(spark, sf), first, second, 10).select("query_id", "vec_id", r6(F.col("d2")).alias("d2"), "rnk")


def _residual_model(spark, sf) -> pq.ProductQuantizer:
    near = knn.nearest(_points(spark, sf).where("vec_id between 16 and 31"), codebook(spark, sf)).join(codebook(spark, sf).withColumnRenamed("vw", "centroid_id"), "centroid_id")
    rows = sorted(near.collect(), key=lambda r: r["vec_id"])
    return pq.from_rows([np.array(r["vec"]) - np.array(r["centroid"]) for r in rows], 8)


@query("ivfpq_build", P + "SELECT vec_id, vw, q, c FROM rcode")
def _(spark, sf):
    built = pq.build_lists(_points(spark, sf), codebook(spark, sf), _residual_model(spark, sf))
    return built.select("vec_id", "vw", F.posexplode("codes").alias("q", "c")).select("vec_id", "vw", F.col("q").cast("long").alias("q"), F.col("c").cast("long").alias("c"))


def _found(spark, sf) -> DataFrame:
    model, cb = _residual_model(spark, sf), codebook(spark, sf)
    built = pq.build_lists(_points(spark, sf), cb, model)
    queries = _points(spark, sf).where("vec_id % 20 = 0").withColumnRenamed("vec_id", "query_id")
    return pq.search_lists(queries, built, cb, model, 3, 10)


_TOP = " FROM ivf QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(d2, 9), vec_id) <= 10"


@query("ivfpq_search", P + "SELECT query_id, vec_id, round(d2, 6) + 0.0 AS d2" + _TOP)
def _(spark, sf):
    return _found(spark, sf).select("query_id", "vec_id", r6(F.col("d2")).alias("d2"))


@query("ivfpq_search_vw", P + "SELECT query_id, vw, vec_id" + _TOP)
def _(spark, sf):
    return _found(spark, sf).select("query_id", "vw", "vec_id")


# lists as they are learned ------------------------------------------------------------------------


@query("ivfpq_coded_centroids", P + """, ccode AS (SELECT cs.vec_id AS vw, cs.q, cell.v FROM sub cs JOIN sub cell ON cell.q = cs.q AND cell.vec_id BETWEEN 16 AND 31 WHERE cs.vec_id < 16
      QUALIFY row_number() OVER (PARTITION BY cs.vec_id, cs.q ORDER BY list_sum(list_transform(list_zip(cs.v, cell.v), lambda z: (z[1] - z[2]) * (z[1] - z[2]))), cell.vec_id) = 1
    ), made AS (SELECT vw, flatten(list(v ORDER BY q)) AS v FROM ccode GROUP BY vw
    ), cd AS (SELECT vec_id, vw, list_sum(list_transform(list_zip(d.vec, made.v), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS d2 FROM d CROSS JOIN made)
    SELECT vec_id, vw, round(d2, 6) AS d2 FROM cd QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY d2, vw) = 1""")
def _(spark, sf):
    cells = sorted(_points(spark, sf).where("vec_id between 16 and 31").collect(), key=lambda r: r["vec_id"])
    codes, made = lists.coded_centroids(codebook(spark, sf), pq.from_rows([r["vec"] for r in cells], 8))
    book = lists.ListModel(list(range(64)), made, None, True, codes).codebook(spark)
    return knn.nearest(_points(spark, sf), book).select("vec_id", F.col("centroid_id").alias("vw"), r6(F.col("d2")).alias("d2"))


@query("ivfpq_absolute", P + """SELECT query_id, vec_id, round(adc.d2, 6) + 0.0 AS d2, row_number() OVER (PARTITION BY query_id ORDER BY round(adc.d2, 9), vec_id)::INTEGER AS rnk
    FROM adc JOIN asg USING (vec_id) JOIN (SELECT vec_id AS query_id, vw FROM ranked WHERE rnk <= 3) r USING (query_id, vw) QUALIFY rnk <= 10""")
def _(spark, sf):
    centroids = np.array([r["centroid"] for r in sorted(codebook(spark, sf).collect(), key=lambda r: r["vw"])])
    model = lists.ListModel(list(range(64))[::-1], centroids[:, ::-1], pq.from_rows(list(centroids[:, ::-1]), 8), relative=False)
    return lists.search(_queries(spark, sf), stored(lists.build(_points(spark, sf), model), "lists"), model, 3, 10).select("query_id", "vec_id", r6(F.col("d2")).alias("d2"), "rnk")


@query("ivfpq_learned")
def _(spark, sf):
    """A quarter of the lists probed, whose centroids are product codes; each vector is in three, as in `ivfpq_reranked`."""
    points = _points(spark, sf)
    model = lists.learn(points, _LISTS, 16, 64, rounds=5, coarse_cells=32)
    return lists.search_reranked(_queries(spark, sf), points, stored(lists.build(points, model, _SPILL), "lists"), model, _PROBES, _SHORT, 10)


# shards: points of even images, and after them those of odd ones -------------------------------------

_SHARDS = P[:-1] + """, num AS (SELECT vec_id, image_id, row_number() OVER o - 1 AS label, dense_rank() OVER i - 1 AS image FROM d WINDOW o AS (ORDER BY image_id % 2, image_id, pt), i AS (ORDER BY image_id % 2, image_id))
"""


def _shards(spark, sf) -> shards.Shard:
    coded = pq.build_lists(_points(spark, sf), codebook(spark, sf), _residual_model(spark, sf))
    points = stored(coded.join(descriptors(spark, sf).select("vec_id", "image_id", "pt"), "vec_id"), "coded")
    return shards.merge(*(shards.build(points.where(F.col("image_id") % 2 == i)) for i in (0, 1)))


@query("shards_merged", _SHARDS + "SELECT num.vec_id, asg.vw, num.label, num.image FROM num JOIN asg USING (vec_id)")
def _(spark, sf):
    both = _shards(spark, sf)
    return shards.images_of(both.points.drop("image_id"), both.images).select("vec_id", "vw", "label", "image")


@query("shard_ends", _SHARDS + 'SELECT image, image_id, max(label) + 1 AS "end" FROM num GROUP BY ALL')
def _(spark, sf):
    return _shards(spark, sf).images.select("image", "image_id", "end")


@query("shard_votes", _SHARDS + """SELECT query_id, image, image_id, count(*) AS votes FROM (
    SELECT query_id, label, image, num.image_id FROM ivf JOIN num USING (vec_id) QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(d2, 9), label) <= 10) GROUP BY ALL""")
def _(spark, sf):
    both = _shards(spark, sf)
    built = both.points.select(F.col("label").alias("vec_id"), "vw", "codes")
    found = pq.search_lists(_queries(spark, sf), built, codebook(spark, sf), _residual_model(spark, sf), 3, 10)
    return shards.images_of(found.select("query_id", F.col("vec_id").alias("label")), both.images).groupBy("query_id", "image", "image_id").agg(F.count("*").alias("votes"))


# lists of which a quarter is probed ------------------------------------------------------------------

#: Of 64 lists 16 are probed, and each vector is in 3: the given vectors fill their space almost evenly, so that neighbours lie in many lists.
_LISTS, _PROBES, _SPILL, _SHORT = 64, 16, 3, 200


def reranked(spark, sf, spill: int) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame, pq.ProductQuantizer]:
    """(queries, points, blocks of the learned lists, codebook, quantiser)"""
    points = _points(spark, sf)
    centroids, model = pq.learn_lists(points, _LISTS, 16, 256)
    book = spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centroids)], "vw long, centroid array<double>")
    blocks = stored(pq.list_blocks(pq.build_lists(points, book, model, spill)), "lists")
    return points.where("vec_id % 20 = 0").withColumnRenamed("vec_id", "query_id"), points, blocks, book, model


@query("ivfpq_reranked")
def _(spark, sf):
    found = pq.search_reranked(*reranked(spark, sf, _SPILL), _PROBES, _SHORT, 10)
    return found.select("query_id", "vec_id", r6(F.col("d2")).alias("d2"), "rnk")


@query("pq_reranked")
def _(spark, sf):
    found = pq.search_reranked(*reranked(spark, sf, 1), _LISTS, _SHORT, 10)
    return found.select("query_id", "vec_id", r6(F.col("d2")).alias("d2"), "rnk")


_SQUARED = "list_sum(list_transform(list_zip({}, {}), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
_MINUS = "list_transform(list_zip({}, {}), lambda z: z[1] - z[2])"
_EIGHTH = "CROSS JOIN (SELECT unnest(range(0, 8)) AS q) q"


@query("ivfpq_pruned", f"""WITH d AS (SELECT vec_id, list_transform(embedding, lambda z: z::DOUBLE) AS vec FROM embeddings
), l AS (SELECT vec_id AS vw, vec AS centroid FROM d WHERE vec_id < 64
), near AS (SELECT vec_id, vw, {_MINUS.format("vec", "centroid")} AS rest, row_number() OVER (PARTITION BY vec_id ORDER BY {_SQUARED.format("vec", "centroid")}, vw) AS rnk FROM d CROSS JOIN l
), sub AS (SELECT vec_id, vw, rnk, q.q, rest[q.q * 8 + 1 : q.q * 8 + 8] AS v FROM near {_EIGHTH}
), cell AS (SELECT vec_id - 64 AS c, q, v FROM sub WHERE rnk = 1 AND vec_id BETWEEN 64 AND 127
), code AS (SELECT s.vec_id, s.vw, s.q, c.c, c.v FROM sub s JOIN cell c USING (q) WHERE s.rnk <= 3 QUALIFY row_number() OVER (PARTITION BY s.vec_id, s.vw, s.q ORDER BY {_SQUARED.format("s.v", "c.v")}, c.c) = 1
), adc AS (SELECT p.vec_id AS query_id, code.vec_id, p.vw, round(sum({_SQUARED.format("p.v", "code.v")}), 9) AS d2 FROM sub p JOIN code USING (vw, q) WHERE p.rnk <= 16 AND p.vec_id % 20 = 0 GROUP BY ALL
), best AS (SELECT query_id, vec_id, min(d2) AS d2 FROM adc GROUP BY ALL
), short AS (SELECT query_id, vec_id FROM best QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY d2, vec_id) <= 200
), exact AS (SELECT query_id, s.vec_id, {_SQUARED.format("a.vec", "b.vec")} AS d2 FROM short s JOIN d a ON a.vec_id = s.query_id JOIN d b ON b.vec_id = s.vec_id)
SELECT query_id, vec_id, round(d2, 6) + 0.0 AS d2, row_number() OVER (PARTITION BY query_id ORDER BY round(d2, 9), vec_id)::INTEGER AS rnk FROM exact QUALIFY rnk <= 10""")
def _(spark, sf):
    """A quarter of the lists probed, as `ivfpq_reranked` does; the lists and cells are given vectors, which SQL can name."""
    points = _points(spark, sf)
    book = points.where("vec_id < 64").select(F.col("vec_id").alias("vw"), F.col("vec").alias("centroid"))
    near = knn.nearest(points.where("vec_id between 64 and 127"), book).join(book, F.col("centroid_id") == F.col("vw"))
    model = pq.from_rows([np.array(r["vec"]) - np.array(r["centroid"]) for r in sorted(near.collect(), key=lambda r: r["vec_id"])], 8)
    blocks = stored(pq.list_blocks(pq.build_lists(points, book, model, _SPILL)), "lists")
    found = pq.search_reranked(points.where("vec_id % 20 = 0").withColumnRenamed("vec_id", "query_id"), points, blocks, book, model, _PROBES, _SHORT, 10)
    return found.select("query_id", "vec_id", r6(F.col("d2")).alias("d2"), "rnk")


# the lists' neighbours as votes for images, with scale weights and weak geometry -------------------

_SIGMA = 0.5
_POINT = "(PARTITION BY query_id)"
_WEIGHTS = {
    0: f"1 - sqrt(d2) / sqrt((1 + {_SIGMA}) * max(d2) OVER (PARTITION BY query_id // 10))",
    1: f"1 - sqrt(d2) / sqrt({_SIGMA} * max(d2) OVER {_POINT})",
    2: f"exp(-d2 / (4 * {_SIGMA} * max(d2) OVER {_POINT}))",
    4: f"exp(-d2 / (max(d2) OVER {_POINT} * {_SIGMA}))",
    5: f"1 / (d2 + {_SIGMA})",
    6: f"exp(-d2 / (t * {_SIGMA}))",
    8: f"CASE WHEN d2 > 0 THEN exp(-d2 / (max(d2) OVER {_POINT} * {_SIGMA})) ELSE 0 END / sum(CASE WHEN d2 > 0 THEN exp(-d2 / (mx * {_SIGMA})) ELSE 0 END) OVER {_POINT}",
}


def _geo_sql(weight: str) -> str:
    return P[:-1] + f""", nn AS (SELECT * FROM ivf QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(d2, 9), vec_id) <= 10
), mm AS (SELECT *, max(d2) OVER {_POINT} AS mx, count(*) FILTER (d2 > 1e-4) OVER {_POINT} AS j, row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN d2 > 1e-4 THEN 0 ELSE 1 END, round(d2, 9), vec_id) AS r FROM nn
), qq AS (SELECT *, max(CASE WHEN r = floor(j * 2 / 10.0) + 1 THEN d2 END) OVER {_POINT} AS t FROM mm
), gs AS (SELECT *, {weight} AS f FROM qq
), gv AS (SELECT q.image_id AS query_id, p.image_id, gs.f * w.w * w.w * exp(least(q.qscale, p.qscale) * 0.06::DOUBLE) AS s, (p.qangle - q.qangle + 64) % 64 AS da, p.qscale - q.qscale + 31 AS ds
          FROM gs JOIN post q ON q.vec_id = gs.query_id JOIN post p ON p.vec_id = gs.vec_id JOIN words w ON w.vw = gs.vw
), gb AS (SELECT query_id, image_id, 'angle' AS dim, da AS bin, sum(s) AS s FROM gv GROUP BY ALL UNION ALL SELECT query_id, image_id, 'scale' AS dim, ds AS bin, sum(s) AS s FROM gv GROUP BY ALL
), gm AS (SELECT query_id, image_id, dim, bin + o.o AS bin, sum(s * wt) AS s FROM gb JOIN wgcw USING (dim, bin) CROSS JOIN (SELECT unnest(range(0, 5)) AS o) o WHERE bin + o.o >= 4 AND bin + o.o < CASE WHEN dim = 'angle' THEN 64 ELSE 63 END GROUP BY ALL)
SELECT query_id, image_id, round(min(m), 5) + 0.0 AS score FROM (SELECT query_id, image_id, dim, max(s) AS m FROM gm GROUP BY ALL) GROUP BY query_id, image_id"""


for _kind, _weight in _WEIGHTS.items():

    @query(f"ivfpq_geo_w{_kind}", _geo_sql(_weight))
    def _(spark, sf, kind=_kind):
        from tessera.operators import inverted
        from tessera.plans.fixtures import assigned

        found = _found(spark, sf).select(F.col("query_id").alias("qvec"), "vw", "vec_id", "d2")
        geo = inverted.with_geometry(descriptors(spark, sf)).select("vec_id", "image_id", "pt", "qscale", "qangle")
        asked = geo.select(F.col("vec_id").alias("qvec"), F.col("image_id").alias("query_id"), F.col("pt").alias("dqid"), F.col("qscale").alias("qs"), F.col("qangle").alias("qa"))
        scored = pq.distance_scores(found.join(asked, "qvec"), kind, _SIGMA, 10)
        words = inverted.word_weights(assigned(spark, sf), codebook(spark, sf)).select("vw", "w")
        voted = scored.join(geo, "vec_id").join(words, "vw")
        score = F.col("score") * F.col("w") * F.col("w") * F.exp(F.least("qscale", "qs") * 0.06)
        voted = voted.select("query_id", "image_id", score.alias("score"), F.pmod(F.col("qangle") - F.col("qa"), F.lit(64)).alias("da"), (F.col("qscale") - F.col("qs") + 31).alias("ds"))
        out = inverted.geometric_scores(inverted.histograms(voted), inverted.wgc_weights(spark), 5)
        return out.select("query_id", "image_id", (F.round("score", 5) + 0.0).alias("score"))
