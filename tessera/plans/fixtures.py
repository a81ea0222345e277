"""Views of the given tables in the shapes that the retrieval operators work on, in Spark and in SQL.

embeddings are the local descriptors of images of ten points each: geometry comes from their first
components, the first 16 vectors are the codebook, a Hadamard basis the projection. BASE is the same
as SQL (common table expressions), for the oracles; unused ones cost nothing there.
"""

from __future__ import annotations

from math import comb, log2, pi

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import vectors as v
from tessera.operators import hamming, inverted, knn
from tessera.plans.registry import table
from tessera.sources.scratch import stored

WORDS = 16
BITS = 64
#: Signatures of the fixture lie far apart; the default for real descriptors is 22.
HAMMING = 28
#: Queries are the images, or vectors, whose id this divides.
EVERY = 20


def descriptors(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = v.doubles(F.col("embedding"))
    df = table(spark, sf_dir, "embeddings").select("vec_id", "label", e.alias("vec"))
    at = lambda i: F.col("vec")[i]
    return df.select(
        "vec_id", F.floor(F.col("vec_id") / 10).cast("long").alias("image_id"), (F.col("vec_id") % 10).alias("pt"), "label", "vec",
        (320 * (1 + at(0))).alias("x"), (240 * (1 + at(1))).alias("y"), F.exp(1 + 4 * F.abs(at(2))).alias("scale"),
        (pi * F.greatest(F.lit(-1.0), F.least(F.lit(1.0), 4 * at(3)))).alias("angle"), (1000 * F.abs(at(4))).alias("cornerness"),
    )


def codebook(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").where(F.col("vec_id") < WORDS).select(F.col("vec_id").alias("vw"), v.doubles(F.col("embedding")).alias("centroid"))


def assigned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return knn.nearest(descriptors(spark, sf_dir), codebook(spark, sf_dir), 1).withColumnRenamed("centroid_id", "vw")


def postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """image_id, pt, vw, binsign, qscale, qangle, cornerness and geometry of every descriptor, written once for all parts of a plan."""
    projected = stored(hamming.project(assigned(spark, sf_dir), hamming.hadamard(BITS)), "projected")
    medians = hamming.medians(projected)
    return stored(inverted.with_geometry(hamming.signatures(projected, medians)).drop("proj"), "postings")


def query_points(points: DataFrame) -> DataFrame:
    """The postings of the images that are queries; query_id is the image."""
    return points.where(F.col("image_id") % EVERY == 0).withColumn("query_id", F.col("image_id"))


_BINOMIAL = ", ".join(f"({i}, {64 - log2(sum(comb(64, j) for j in range(i + 1)))!r}::DOUBLE)" for i in range(65))

BASE = f"""
WITH d AS (
  SELECT vec_id, vec_id // 10 AS image_id, vec_id % 10 AS pt, label, vec,
         320 * (1 + vec[1]) AS x, 240 * (1 + vec[2]) AS y, exp(1 + 4 * abs(vec[3])) AS scale,
         pi() * greatest(-1.0::DOUBLE, least(1.0::DOUBLE, 4 * vec[4])) AS angle, 1000 * abs(vec[5]) AS cornerness
  FROM (SELECT vec_id, label, list_transform(embedding, lambda z: z::DOUBLE) AS vec FROM embeddings)
), cb AS (SELECT vec_id AS vw, vec AS centroid FROM d WHERE vec_id < {WORDS}
), dist AS (SELECT d.vec_id, cb.vw, list_sum(list_transform(list_zip(d.vec, cb.centroid), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS d2 FROM d CROSS JOIN cb
), ranked AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY d2, vw) AS rnk FROM dist
), asg AS (SELECT d.*, r.vw, r.d2 FROM d JOIN ranked r USING (vec_id) WHERE r.rnk = 1
), proj AS (
  SELECT a.vec_id, a.vw, b.bit, round(list_sum(list_transform(range(0, {BITS}), lambda i: a.vec[i + 1] * (1 - 2 * (bit_count(i & b.bit) % 2)))) / 8, 9) AS v
  FROM asg a CROSS JOIN (SELECT unnest(range(0, {BITS})) AS bit) b
), med AS (SELECT vw, bit, median(v) AS m FROM proj GROUP BY vw, bit
), sig AS (
  SELECT p.vec_id, sum(CASE WHEN p.bit < 32 AND p.v >= m.m THEN 1::BIGINT << p.bit ELSE 0 END)::BIGINT AS lo,
         sum(CASE WHEN p.bit >= 32 AND p.v >= m.m THEN 1::BIGINT << (p.bit - 32) ELSE 0 END)::BIGINT AS hi
  FROM proj p JOIN med m USING (vw, bit) GROUP BY p.vec_id
), post AS (
  SELECT a.vec_id, a.image_id, a.pt, a.vw, s.lo, s.hi, a.x, a.y, a.scale, a.angle, a.cornerness,
         greatest(0, least(31, trunc(ln(a.scale) / ln(1.2::DOUBLE) + 0.5)))::INTEGER AS qscale,
         greatest(0, least(63, floor((a.angle + pi()) * 64 / (2 * pi()))))::INTEGER AS qangle
  FROM asg a JOIN sig s USING (vec_id)
), words AS (SELECT cb.vw, count(p.vw) AS n, CASE WHEN count(p.vw) = 0 THEN ln(sum(count(p.vw)) OVER ()) ELSE ln(sum(count(p.vw)) OVER () / count(p.vw)) END AS w FROM cb LEFT JOIN post p USING (vw) GROUP BY cb.vw
), hew AS (SELECT * FROM (VALUES {_BINOMIAL}) t(hd, hw)
), pairs AS (
  SELECT q.image_id AS query_id, q.pt AS dqid, p.image_id, p.pt, p.vw, bit_count(xor(q.lo, p.lo)) + bit_count(xor(q.hi, p.hi)) AS hd,
         (p.qangle - q.qangle + 64) % 64 AS da, p.qscale - q.qscale + 31 AS ds, least(q.qscale, p.qscale) AS ms
  FROM post q JOIN post p USING (vw) WHERE q.image_id % {EVERY} = 0
), votes AS (
  SELECT pairs.*, words.w * words.w * exp(ms * 0.06::DOUBLE) * hew.hw AS score
  FROM pairs JOIN words USING (vw) JOIN hew USING (hd) WHERE pairs.hd <= {HAMMING}
), intra AS (
  SELECT *, CASE WHEN count(*) OVER g >= 2 THEN score * sqrt(score / sum(score) OVER g) ELSE score END AS s1 FROM votes WINDOW g AS (PARTITION BY query_id, image_id, vw)
), burst AS (SELECT *, s1 * sqrt(s1 / sum(s1) OVER (PARTITION BY query_id, dqid)) AS s2 FROM intra
), prior AS (
  SELECT a.a, s.s, 1 + 4 * (exp(-(a.a * a.a) / 5.0::DOUBLE) + exp(-((a.a - 64) * (a.a - 64)) / 5.0::DOUBLE)) + 0.4::DOUBLE * exp(-((a.a - 32) * (a.a - 32)) / 5.0::DOUBLE)
         + 0.2::DOUBLE * (exp(-((a.a - 16) * (a.a - 16)) / 5.0::DOUBLE) + exp(-((a.a - 48) * (a.a - 48)) / 5.0::DOUBLE)) + exp(-((s.s - 31) * (s.s - 31)) / 40.0::DOUBLE) AS b
  FROM (SELECT unnest(range(0, 64)) AS a) a CROSS JOIN (SELECT unnest(range(0, 63)) AS s) s
), bins AS (
  SELECT query_id, image_id, 'angle' AS dim, da AS bin, sum(s2) AS s FROM burst GROUP BY ALL
  UNION ALL SELECT query_id, image_id, 'scale' AS dim, ds AS bin, sum(s2) AS s FROM burst GROUP BY ALL
), wgcw AS (
  SELECT 'angle' AS dim, a AS bin, sum(b) AS wt FROM prior GROUP BY a UNION ALL SELECT 'scale' AS dim, s AS bin, sum(b) AS wt FROM prior GROUP BY s
), smooth AS (
  SELECT query_id, image_id, dim, bin + o.o AS bin, sum(s * wt) AS s
  FROM bins JOIN wgcw USING (dim, bin) CROSS JOIN (SELECT unnest(range(0, 5)) AS o) o
  WHERE bin + o.o >= 4 AND bin + o.o < CASE WHEN dim = 'angle' THEN 64 ELSE 63 END GROUP BY ALL
), wgc AS (SELECT query_id, image_id, min(m) AS score FROM (SELECT query_id, image_id, dim, max(s) AS m FROM smooth GROUP BY ALL) GROUP BY query_id, image_id
), norms AS (SELECT image_id, sum(n)::DOUBLE AS l1, sqrt(sum(n * n)) AS l2, sqrt(sum(n)) AS l3 FROM (SELECT image_id, vw, count(*) AS n FROM post GROUP BY ALL) GROUP BY image_id
), scores AS (
  SELECT q.query_id, i.image_id, coalesce(w.score, 0) / (i.l2 * qn.l2) AS score
  FROM (SELECT image_id AS query_id FROM norms WHERE image_id % {EVERY} = 0) q CROSS JOIN norms i JOIN norms qn ON qn.image_id = q.query_id
  LEFT JOIN wgc w ON w.query_id = q.query_id AND w.image_id = i.image_id
)
"""
