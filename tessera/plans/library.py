"""Queries on learning loops, codes and lists, presets, pairs of matches, atoms, matrices, distances, and files written and read."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import vectors as v
from tessera.operators import clustering, hamming, inverted, knn, points, sparse
from tessera.operators import geometry as g
from tessera.operators import quantization as pq
from tessera.plans.fixtures import BASE, BITS, assigned, codebook, descriptors, postings, query_points
from tessera.plans.numeric import E, _pairs, _vectors
from tessera.plans.quantized import P, _model, _points, _residual_model
from tessera.plans.registry import ORACLE_SQL, query
from tessera.plans.retrieval import PARAMS, r6
from tessera.plans.verification import M, candidates, matches
from tessera.sources import binary, index, models
from tessera.sources.scratch import scratch, stored
from tessera.streaming import ingest


# points --------------------------------------------------------------------------------------------


@query("first_points", BASE + "SELECT image_id, pt FROM d WHERE pt < 3")
def _(spark, sf):
    return points.first_points(descriptors(spark, sf), 3).select("image_id", "pt")


_SHAPE = BASE + """, t AS (SELECT vec_id, 1 + vec[1] AS a, vec[2] AS b, vec[3] AS c, 1 + vec[4] AS d FROM d
), s AS (SELECT vec_id, sqrt(pow((a + d) / 2, 2) + pow((c - b) / 2, 2)) AS q, sqrt(pow((a - d) / 2, 2) + pow((c + b) / 2, 2)) AS r, (atan2((c + b) / 2, (a - d) / 2) + atan2((c - b) / 2, (a + d) / 2)) / 2 AS phi, a * d - b * c AS det FROM t WHERE a * d - b * c > 0)
SELECT vec_id, round(q + r, 6) AS major, round(abs(q - r), 6) AS minor, round(abs(cos(phi)), 5) AS v1, round(sin(phi) * CASE WHEN cos(phi) < 0 THEN -1 ELSE 1 END, 5) + 0.0 AS v2, round(sqrt(det), 6) AS size FROM s"""


@query("keypoint_ellipse", _SHAPE)
def _(spark, sf):
    at = lambda i: F.col("vec")[i]
    a, b, c, d = 1 + at(0), at(1), at(2), 1 + at(3)
    rows = descriptors(spark, sf).where(a * d - b * c > 0).select("vec_id", *[e.alias(k) for k, e in points.ellipse(a, b, c, d).items()])
    return rows.select("vec_id", r6(F.col("major")).alias("major"), r6(F.col("minor")).alias("minor"), (F.round("v1", 5) + 0.0).alias("v1"), (F.round("v2", 5) + 0.0).alias("v2"), r6(F.col("size")).alias("size"))


@query("votes_nonzero", BASE + """, lin AS (SELECT query_id, dqid, image_id, pt, greatest(0, 1 - hd / 20.0::DOUBLE) AS score FROM pairs)
    SELECT query_id, dqid, image_id, pt, round(score, 6) AS score FROM lin WHERE score > 0""")
def _(spark, sf):
    p = postings(spark, sf)
    q = query_points(p).select("query_id", F.col("pt").alias("dqid"), "vw", F.col("binsign").alias("_s"))
    votes = p.join(q, "vw").withColumn("score", F.greatest(F.lit(0.0), 1 - v.hamming(F.col("_s"), F.col("binsign")) / 20.0))
    return inverted.without_zero_votes(votes).select("query_id", "dqid", "image_id", "pt", r6(F.col("score")).alias("score"))


# learning loops ------------------------------------------------------------------------------------


def _balance_sql(additive: bool, rounds: int) -> str:
    out = BASE[:-1] + f", f0 AS (SELECT vw, {0 if additive else 1}::DOUBLE AS f FROM cb)"
    d, power = ("dist.d2 + f", "0.2::DOUBLE / 8") if additive else ("dist.d2 * f", "0.5::DOUBLE / 8")
    for i in range(rounds):
        out += f""", a{i} AS (SELECT vec_id, vw, {d} AS m FROM dist JOIN f{i} USING (vw) QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY {d}, vw) = 1
), n{i} AS (SELECT f.vw, f.f, greatest(1, count(a.vw)) AS n, coalesce(avg(a.m), 0) AS m, sum(count(a.vw)) OVER () / 16.0::DOUBLE AS share FROM f{i} f LEFT JOIN a{i} a USING (vw) GROUP BY f.vw, f.f
), f{i + 1} AS (SELECT vw, {f'f + m * (pow(n / share, {power}) - 1)' if additive else f'f * pow(n / share, {power})'} AS f FROM n{i})"""
    return out + f" SELECT vw, round(f, 6) + 0.0 AS factor FROM f{rounds}"


for _name, _additive in (("balance_factors_loop", False), ("balance_factors_additive", True)):

    @query(_name, _balance_sql(_additive, 4))
    def _(spark, sf, additive=_additive):
        found = clustering.balance_factors(descriptors(spark, sf), codebook(spark, sf), 4, additive)
        return found.select("vw", r6(F.col("factor")).alias("factor"))


def _medoids_sql(rounds: int) -> str:
    out = BASE[:-1] + ", m0 AS (SELECT vw AS slot, vw FROM cb WHERE vw < 4)"
    for i in range(rounds):
        out += f""", c{i} AS (SELECT vec_id, min(d2) FILTER (m.vw IS NOT NULL) AS now, min(d2) FILTER (m.vw IS NOT NULL AND m.slot <> {i % 4}) AS kept FROM dist LEFT JOIN m{i} m USING (vw) GROUP BY vec_id
), b{i} AS (SELECT d.vw, sum(least(c.kept, d.d2) - c.now) AS change FROM dist d JOIN c{i} c USING (vec_id) WHERE d.vw NOT IN (SELECT vw FROM m{i}) GROUP BY d.vw
), w{i} AS (SELECT vw FROM b{i} WHERE change < -1e-9 ORDER BY round(change, 9), vw LIMIT 1
), m{i + 1} AS (SELECT slot, CASE WHEN slot = {i % 4} THEN coalesce((SELECT vw FROM w{i}), vw) ELSE vw END AS vw FROM m{i})"""
    return out + f" SELECT slot, vw FROM m{rounds}"


@query("kmedoids", _medoids_sql(6))
def _(spark, sf):
    found = clustering.kmedoids(descriptors(spark, sf).select("vec_id", "vec"), codebook(spark, sf), [0, 1, 2, 3], 6)
    return spark.createDataFrame(list(enumerate(found)), "slot long, vw long")


def _cdm_sql(rounds: int) -> str:
    out = BASE[:-1] + ", f0 AS (SELECT vw, 1::DOUBLE AS f FROM cb), cc AS (SELECT d.vec_id AS a, d.vw AS b, d.d2 FROM dist d WHERE d.vec_id < 16)"
    for i in range(rounds):
        out += f""", k{i} AS (SELECT a, sqrt(d2 * f * f) AS d FROM cc JOIN f{i} ON vw = b QUALIFY row_number() OVER (PARTITION BY a ORDER BY d2 * f * f, b) <= 5
), r{i} AS (SELECT vw, f, avg(d) * f AS r FROM k{i} JOIN f{i} ON vw = a GROUP BY vw, f
), f{i + 1} AS (SELECT vw, f * pow(exp(avg(ln(r)) OVER ()) / r, 0.5::DOUBLE) AS f FROM r{i})"""
    return out + f" SELECT vw, round(f, 6) + 0.0 AS factor FROM f{rounds}"


@query("cdm_loop", _cdm_sql(3))
def _(spark, sf):
    return clustering.distance_corrections(codebook(spark, sf), 5, 0.5, 3).select("vw", r6(F.col("factor")).alias("factor"))


def _kmeans_sql(base: str, table: str, start: str, rounds: int) -> str:
    """Lloyd rounds over table (vec_id, vec) from the centroids (vw, c) that `start` selects."""
    out = base[:-1] + f", c0 AS ({start})"
    for i in range(rounds):
        d = "list_sum(list_transform(list_zip(t.vec, c.c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
        out += f""", a{i} AS (SELECT t.vec_id, c.vw FROM {table} t CROSS JOIN c{i} c QUALIFY row_number() OVER (PARTITION BY t.vec_id ORDER BY {d}, c.vw) = 1
), c{i + 1} AS (SELECT vw, list(x ORDER BY j) AS c, any_value(n) AS n FROM (SELECT a.vw, j.j, avg(t.vec[j.j + 1]) AS x, count(*) AS n FROM a{i} a JOIN {table} t USING (vec_id) CROSS JOIN (SELECT unnest(range(0, 64)) AS j) j GROUP BY a.vw, j.j) GROUP BY vw)"""
    return out + f" SELECT vw, n, unnest(range(0, 64)) AS i, round(unnest(c), 6) + 0.0 AS value FROM c{rounds}"


def _cells(found: DataFrame) -> DataFrame:
    return found.select("vw", "n", F.posexplode("centroid").alias("i", "value")).select("vw", "n", F.col("i").cast("long").alias("i"), r6(F.col("value")).alias("value"))


_START = "SELECT vec_id AS vw, vec AS c FROM d WHERE vec_id < 6"


def _start(spark, sf, n: int) -> list:
    return [r["vec"] for r in sorted(_points(spark, sf).where(F.col("vec_id") < n).collect(), key=lambda r: r["vec_id"])]


@query("kmeans_fixed", _kmeans_sql(BASE, "d", _START, 3))
def _(spark, sf):
    return _cells(clustering.kmeans(_points(spark, sf), 6, 3, start=_start(spark, sf, 6)))


@query("kmeans_pruned", _kmeans_sql(BASE, "d", _START, 3))
def _(spark, sf):
    return _cells(clustering.pruned_kmeans(_points(spark, sf), _start(spark, sf, 6), 3, stored))


# codes and lists -----------------------------------------------------------------------------------

_DECODED = P[:-1] + ", dec AS (SELECT code.vec_id, list(pc.v[j.j + 1] ORDER BY code.q, j.j) AS vec FROM code JOIN pc USING (q, c) CROSS JOIN (SELECT unnest(range(0, 8)) AS j) j GROUP BY code.vec_id)\n"


@query("pq_kmeans", _kmeans_sql(_DECODED, "dec", "SELECT vec_id AS vw, vec AS c FROM dec WHERE vec_id BETWEEN 20 AND 22", 2).replace("SELECT vw, n,", "SELECT vw - 20 AS vw, n,"))
def _(spark, sf):
    model = _model(spark, sf)
    coded = pq.encode(_points(spark, sf), model)
    start = [r["vec"] for r in sorted(pq.decoded(coded.where("vec_id between 20 and 22"), model).collect(), key=lambda r: r["vec_id"])]
    return _cells(pq.code_kmeans(coded, model, 3, 2, start))


@query("pq_pack", P + "SELECT vec_id, string_agg(format('{:x}{:x}', hi, lo), '' ORDER BY b) AS body FROM (SELECT vec_id, q // 2 AS b, max(c) FILTER (q % 2 = 0) AS lo, max(c) FILTER (q % 2 = 1) AS hi FROM code GROUP BY ALL) GROUP BY vec_id")
def _(spark, sf):
    coded = pq.encode(_points(spark, sf), _model(spark, sf)).select("vec_id", "codes")
    return pq.packed(coded, 4).select("vec_id", F.lower(F.hex("codes")).alias("body"))


@query("pq_unpack", P + "SELECT vec_id, q, c FROM code")
def _(spark, sf):
    coded = pq.encode(_points(spark, sf), _model(spark, sf)).select("vec_id", "codes")
    back = pq.unpacked(pq.packed(coded, 5), 8, 5)
    return back.select("vec_id", F.posexplode("codes").alias("q", "c")).select("vec_id", F.col("q").cast("long").alias("q"), F.col("c").cast("long").alias("c"))


@query("ivfpq_merge", P + "SELECT vw, CASE WHEN vec_id % 2 = 0 THEN vec_id ELSE vec_id + 1000000 END AS vec_id, q, c FROM rcode")
def _(spark, sf):
    merged = _merged(spark, sf)
    return merged.select("vw", "vec_id", F.posexplode("codes").alias("q", "c")).select("vw", "vec_id", F.col("q").cast("long").alias("q"), F.col("c").cast("long").alias("c"))


def _merged(spark, sf) -> DataFrame:
    p, cb, model = _points(spark, sf), codebook(spark, sf), _residual_model(spark, sf)
    return pq.merge_lists(pq.build_lists(p.where("vec_id % 2 = 0"), cb, model), pq.build_lists(p.where("vec_id % 2 = 1"), cb, model), 1_000_000)


@query("ivfpq_count", P + "SELECT cb.vw, count(r.vec_id) AS n FROM cb LEFT JOIN (SELECT DISTINCT vw, vec_id FROM rcode) r USING (vw) GROUP BY cb.vw")
def _(spark, sf):
    return pq.list_sizes(_merged(spark, sf), codebook(spark, sf))


_PRUNED = P.replace("WHERE r.rnk <= 3 AND r.vec_id % 20 = 0", "WHERE r.rnk <= 5 AND r.d2 < 1.1::DOUBLE * (SELECT min(x.d2) FROM ranked x WHERE x.vec_id = r.vec_id) AND r.vec_id % 20 = 0")


@query("ivfpq_search_pruned", _PRUNED + "SELECT query_id, vw, vec_id, round(d2, 6) + 0.0 AS d2 FROM ivf QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(d2, 9), vec_id) <= 10")
def _(spark, sf):
    model, cb = _residual_model(spark, sf), codebook(spark, sf)
    built = pq.build_lists(_points(spark, sf), cb, model)
    queries = _points(spark, sf).where("vec_id % 20 = 0").withColumnRenamed("vec_id", "query_id")
    return pq.search_lists(queries, built, cb, model, 5, 10, ratio=1.1).select("query_id", "vw", "vec_id", r6(F.col("d2")).alias("d2"))


@query("he_crop", BASE + ", s AS (SELECT vec_id, sum(CASE WHEN p.bit < 24 AND p.v >= m.m THEN 1::BIGINT << p.bit ELSE 0 END)::BIGINT AS sign FROM proj p JOIN med m USING (vw, bit) GROUP BY vec_id) SELECT vec_id, sign FROM s")
def _(spark, sf):
    projected = stored(hamming.project(assigned(spark, sf), hamming.hadamard(BITS)), "projected")
    medians = hamming.crop(hamming.medians(projected), 24, "medians")
    return hamming.signatures(hamming.crop(projected, 24), medians).select("vec_id", F.col("binsign").alias("sign"))


@query("he_whitened")
def _(spark, sf):
    """Signatures on a random rotation of the whitened principal directions, with the medians there."""
    p = assigned(spark, sf)
    basis = hamming.whitened_basis(clustering.principal_components(p.select("vec_id", "vec"), BITS), BITS, 7)
    projected = stored(hamming.project(p, basis, 6), "projected")
    return hamming.signatures(projected, hamming.medians(projected)).select("vec_id", "vw", "binsign")


# verification --------------------------------------------------------------------------------------


def _preset_sql(detail: int) -> str:
    p = g.presets(detail << 8)[1]
    a, b, c, d = p.bins
    sql = M.replace("c0 / ln(3.0::DOUBLE) AS c0, c1 / (pi() / 3) AS c1, c2 / 13 AS c2, c3 / 13 AS c3", f"c0 / {a!r}::DOUBLE AS c0, c1 / {b!r}::DOUBLE AS c1, c2 / {c!r}::DOUBLE AS c2, c3 / {d!r}::DOUBLE AS c3")
    sql = sql.replace(", 2) < 15", f", 2) < {p.tolerance**2!r}::DOUBLE").replace("n >= 3 AND", f"n >= {p.least_before} AND")
    sql = sql.replace("nmatch >= 4 AND nq >= 4 AND nd >= 4", f"nmatch >= {p.least_after} AND nq >= {p.least_after} AND nd >= {p.least_after}")
    return sql.replace("abs(h2 - c / 13) < 3 AND abs(h3 - f / 13) < 3", f"abs(h2 - c / {c!r}::DOUBLE) < 3 AND abs(h3 - f / {d!r}::DOUBLE) < 3") + "SELECT query_id, image_id, count(*) AS n FROM acc GROUP BY ALL"


for _detail in (4, 5):

    @query(f"verify_preset_{_detail}", _preset_sql(_detail))
    def _(spark, sf, detail=_detail):
        params = g.presets(detail << 8)[1]
        m = candidates(spark, sf, params)
        found = g.agreeing(g.hypotheses(g.spread_votes(m, params), params), m, params).groupBy(*g.PAIR, *g.CELL, "place")
        found = found.agg(F.count("*").alias("nmatch"), F.count_distinct("qpt").alias("nq"), F.count_distinct("dbpt").alias("nd"), F.first("affine").alias("affine"))
        enough = (F.col("nmatch") >= params.least_after) & (F.col("nq") >= params.least_after) & (F.col("nd") >= params.least_after)
        return found.where(g.acceptable(params) & enough).groupBy(*g.PAIR).agg(F.count("*").alias("n"))


_PAIRS2 = M[:-1] + f""", rk AS (SELECT *, row_number() OVER (PARTITION BY query_id, image_id ORDER BY round(score, 9) DESC, qpt, dbpt) - 1 AS i, count(*) OVER (PARTITION BY query_id, image_id) AS m FROM m
), ss AS (SELECT query_id, image_id, any_value(m) AS m, unnest(range(1, 2 * any_value(m) - 2)) AS s FROM rk GROUP BY query_id, image_id
), st AS (SELECT *, s // 2 + 1 AS low, unnest(range(1, 11)) AS k FROM ss
), dr AS (SELECT *, low + ('0x' || substr(md5(s || ':' || k), 1, 8))::BIGINT % (least(s, m - 1) - low + 1) AS i FROM st
), ij AS (SELECT DISTINCT query_id, image_id, i, s - i AS j FROM dr
), p2 AS (
  SELECT ij.query_id, ij.image_id, a.qpt AS qpt1, a.dbpt AS dbpt1, b.qpt AS qpt2, b.dbpt AS dbpt2, a.score + b.score AS score,
         (a.x - b.x) / (a.qx - b.qx) AS ax, (a.y - b.y) / (a.qy - b.qy) AS ay, b.x AS bx, b.qx AS bqx, b.y AS yb, b.qy AS bqy
  FROM ij JOIN rk a ON a.query_id = ij.query_id AND a.image_id = ij.image_id AND a.i = ij.i JOIN rk b ON b.query_id = ij.query_id AND b.image_id = ij.image_id AND b.i = ij.j
  WHERE pow(a.qx - b.qx, 2) + pow(a.qy - b.qy, 2) >= {g.HoughParams().distinct**2!r}::DOUBLE AND pow(a.x - b.x, 2) + pow(a.y - b.y, 2) >= {g.HoughParams().distinct**2!r}::DOUBLE AND a.qx <> b.qx AND a.qy <> b.qy
)
"""


@query("hough_2aff", _PAIRS2 + "SELECT query_id, image_id, qpt1, dbpt1, qpt2, dbpt2, round(score, 6) AS score, round(ln(ax), 4) + 0.0 AS c0, round(bx - ax * bqx, 2) + 0.0 AS c1, round(ln(ay), 4) + 0.0 AS c2, round(yb - ay * bqy, 2) + 0.0 AS c3 FROM p2 WHERE ax > 0 AND ay > 0")
def _(spark, sf):
    found = g.two_axis_coordinates(matches(spark, sf))
    rounded = [(F.round(f"c{i}", 4 if i % 2 == 0 else 2) + 0.0).alias(f"c{i}") for i in range(4)]
    return found.select("query_id", "image_id", "qpt1", "dbpt1", "qpt2", "dbpt2", r6(F.col("score")).alias("score"), *rounded)


@query("hough_2aff_votes", _PAIRS2 + "SELECT query_id, image_id, count(*) AS pairs, round(sum(score), 5) AS votes FROM p2 WHERE ax > 0 AND ay > 0 GROUP BY ALL")
def _(spark, sf):
    """The 16 shares of a pair sum to its score."""
    cells = g.two_axis_votes(matches(spark, sf))
    return cells.groupBy("query_id", "image_id").agg(F.count_distinct("qpt1", "dbpt1", "qpt2", "dbpt2").alias("pairs"), F.round(F.sum("vote"), 5).alias("votes"))


# whole vectors of operations whose other queries return sums -------------------------------------------


@query("vec_elements", E + """SELECT vec_id, i, i * label AS ranged, round(sqrt(abs((v[i + 1] + 1) * 3 / 2 - 0.5)), 6) AS scalar, round(v[i + 1] + u[i + 1], 6) + 0.0 AS added, round(v[i + 1] - u[i + 1], 6) + 0.0 AS subtracted,
    round(v[i + 1] * u[i + 1], 6) + 0.0 AS multiplied, round(v[i + 1] / list_sum(list_transform(v, lambda y: abs(y))), 6) + 0.0 AS normalized, round(CASE WHEN v[i + 1] < -0.1 THEN 7 ELSE v[i + 1] END, 6) + 0.0 AS purged,
    round((floor((v[i + 1] + 1) * 127.5) + 0.5) / 512, 6) AS rescaled FROM f CROSS JOIN (SELECT unnest(range(0, 64)) AS i)""")
def _(spark, sf):
    a, b = F.col("v"), F.col("u")
    made = {
        "ranged": F.transform(v.numbered(64), lambda i: i * F.col("label")), "scalar": F.transform(a, lambda x: F.sqrt(F.abs((x + 1) * 3 / 2 - 0.5))), "added": v.add(a, b), "subtracted": v.subtract(a, b), "multiplied": v.multiply(a, b),
        "normalized": v.normalized(a, 1), "purged": v.without_nans(F.transform(a, lambda x: F.when(x < -0.1, F.lit(float("nan"))).otherwise(x)), 7.0), "rescaled": F.transform(a, lambda x: (F.floor((x + 1) * 127.5) + 0.5) / 512),
    }
    rows = _pairs(spark, sf).select("vec_id", F.posexplode(F.arrays_zip(*[c.alias(k) for k, c in made.items()])).alias("i", "x"))
    return rows.select("vec_id", F.col("i").cast("long").alias("i"), F.col("x.ranged").alias("ranged"), *[r6(F.col(f"x.{k}")).alias(k) for k in made if k != "ranged"])


@query("pq_elements", P + "SELECT code.vec_id, code.q * 8 + j.j AS i, round(sub.v[j.j + 1], 6) + 0.0 AS part, round(pc.v[j.j + 1], 6) + 0.0 AS decoded FROM code JOIN pc USING (q, c) JOIN sub ON sub.vec_id = code.vec_id AND sub.q = code.q CROSS JOIN (SELECT unnest(range(0, 8)) AS j) j")
def _(spark, sf):
    model = _model(spark, sf)
    back = pq.decoded(pq.encode(_points(spark, sf), model), model).withColumnRenamed("vec", "back")
    rows = _points(spark, sf).join(back, "vec_id").select("vec_id", F.posexplode(F.arrays_zip(F.col("vec").alias("a"), F.col("back").alias("b"))).alias("i", "x"))
    return rows.select("vec_id", F.col("i").cast("long").alias("i"), r6(F.col("x.a")).alias("part"), r6(F.col("x.b")).alias("decoded"))


@query("invert_affine_whole", BASE + """SELECT vec_id, round(e / det, 5) + 0.0 AS a0, round(-b / det, 5) + 0.0 AS a1, round((b * f - e * c) / det, 4) + 0.0 AS a2, round(-dd / det, 5) + 0.0 AS a3, round(a / det, 5) + 0.0 AS a4, round((dd * c - a * f) / det, 4) + 0.0 AS a5
    FROM (SELECT *, a * e - b * dd AS det FROM (SELECT vec_id, 1 + vec[1] AS a, vec[2] AS b, x AS c, vec[3] AS dd, 1 + vec[4] AS e, y AS f FROM d))""")
def _(spark, sf):
    at = lambda i: F.col("vec")[i]
    m = F.array(1 + at(0), at(1), F.col("x"), at(2), 1 + at(3), F.col("y"))
    inverse = descriptors(spark, sf).select("vec_id", m.alias("m")).select("vec_id", v.inverse_affine(F.col("m")).alias("i"))
    return inverse.select("vec_id", *[(F.round(F.col("i")[k], 4 if k in (2, 5) else 5) + 0.0).alias(f"a{k}") for k in range(6)])


@query("he_signature_words", BASE + """, w AS (SELECT vec_id, sum(CASE WHEN bit < 16 AND v >= m THEN 1::BIGINT << bit ELSE 0 END)::BIGINT AS a, sum(CASE WHEN bit >= 16 AND bit < 48 AND v >= m THEN 1::BIGINT << (bit - 16) ELSE 0 END)::BIGINT AS b, sum(CASE WHEN bit >= 48 AND v >= m THEN 1::BIGINT << (bit - 48) ELSE 0 END)::BIGINT AS c FROM proj JOIN med USING (vw, bit) GROUP BY vec_id)
    SELECT vec_id, b AS low, c + (a << 16) AS high, b & 65535 AS second FROM w""")
def _(spark, sf):
    """80 bits in two words: components 16 to 63, and then 0 to 31, of which the second word has 16."""
    p = stored(hamming.project(assigned(spark, sf), hamming.hadamard(BITS)), "projected")
    turned = lambda c: F.concat(F.slice(c, 17, 48), F.slice(c, 1, 32))
    wide = hamming.wide_signatures(p.withColumn("proj", turned("proj")), hamming.medians(p).withColumn("medians", turned("medians")), 80)
    first = F.col("binsigns")[0]
    return wide.select("vec_id", first.bitwiseAND(F.lit((1 << 32) - 1).cast("long")).alias("low"), F.shiftrightunsigned(first, 32).alias("high"), F.col("binsigns")[1].alias("second"))


# atoms, matrices, distances ------------------------------------------------------------------------


@query("atoms_crop_sorted", "WITH a AS (SELECT label AS atom, vec_id % 10 AS vw, sum(embedding[1]::DOUBLE) AS a FROM embeddings GROUP BY ALL) SELECT atom - 1 AS atom, string_agg(vw::VARCHAR, ',' ORDER BY vw) AS words, round(sum(a), 6) + 0.0 AS total FROM a WHERE atom >= 1 AND atom < 4 GROUP BY atom")
def _(spark, sf):
    e = _vectors(spark, sf).groupBy(F.col("label").cast("long").alias("atom"), (F.col("vec_id") % 10).cast("long").alias("vw")).agg(F.sum(F.col("v")[0]).alias("a"))
    rows = sparse.sorted_atoms(sparse.crop_atoms(e, 1, 4))
    return rows.select("atom", F.concat_ws(",", F.transform("words", lambda w: w.cast("string"))).alias("words"), r6(v.total(F.col("values"))).alias("total"))


def _atoms_query(name: str, make) -> None:
    @query(name)
    def _(spark, sf):
        """Products of the images' bags of words with atoms that are built for 16 words."""
        x = sparse.tfidf_normalized(sparse.bag(postings(spark, sf).select("image_id", "vw")))
        return sparse.project(x, make(spark)).select("image_id", "atom", r6(F.col("s")).alias("s"))


_atoms_query("atoms_intersections", lambda spark: sparse.intersection_atoms(spark, 16, 2, 1))
_atoms_query("atoms_random", lambda spark: sparse.random_atoms(spark, 8, 16, 0.4, 2))
_atoms_query("atoms_separate", lambda spark: sparse.separate_atoms(spark, 8, 16, 3, 3))
_atoms_query("atoms_aggregate", lambda spark: sparse.aggregate_atoms(spark, 8, 16, 4, 4))

_MATRIX = E + ", m AS (SELECT vec_id AS r, i.i, v[i.i + 1] AS x FROM e CROSS JOIN (SELECT unnest(range(0, 64)) AS i) i) "


def _matrix(spark, sf) -> DataFrame:
    return _vectors(spark, sf).select(F.col("vec_id").alias("r"), F.posexplode("v").alias("i", "x")).select("r", F.col("i").cast("long").alias("i"), "x")


@query("matmul_at_b", _MATRIX + "SELECT a.i AS r, b.i AS c, round(sum(a.x * b.x), 6) + 0.0 AS x FROM m a JOIN m b ON a.r = b.r GROUP BY ALL")
def _(spark, sf):
    a = _matrix(spark, sf)
    at = sparse.transposed(a, "r", "i")
    return sparse.matrix_product(at, a.select(F.col("r").alias("i"), F.col("i").alias("c"), F.col("x").alias("y"))).select("r", "c", r6(F.col("x")).alias("x"))


@query("mat_vec", _MATRIX + "SELECT m.r, round(sum(m.x * o.x), 6) + 0.0 AS y FROM m JOIN m o ON o.r = 0 AND o.i = m.i GROUP BY m.r")
def _(spark, sf):
    a = _matrix(spark, sf)
    return sparse.matrix_vector(a, a.where("r = 0").select("i", F.col("x").alias("v"))).select("r", r6(F.col("y")).alias("y"))


@query("submatrix", _MATRIX + "SELECT r - 5 AS r, i - 8 AS i, round(x, 6) + 0.0 AS x FROM m WHERE r >= 5 AND r < 105 AND i >= 8 AND i < 24")
def _(spark, sf):
    return sparse.submatrix(_matrix(spark, sf), (5, 105), (8, 24)).select("r", "i", r6(F.col("x")).alias("x"))


@query("vec_constructors", E + "SELECT vec_id, i, 0.0::DOUBLE AS zero, label::DOUBLE AS fixed, i AS ranged, round(v[i + 1], 6) + 0.0 AS copied FROM e CROSS JOIN (SELECT unnest(range(0, 64)) AS i)")
def _(spark, sf):
    e = _vectors(spark, sf).select("vec_id", F.posexplode(F.arrays_zip(v.zeros(64).alias("z"), v.constant(F.col("label").cast("double"), 64).alias("c"), v.numbered(64).alias("r"), F.col("v").alias("v"))).alias("i", "x"))
    return e.select("vec_id", F.col("i").cast("long").alias("i"), F.col("x.z").alias("zero"), F.col("x.c").alias("fixed"), F.col("x.r").alias("ranged"), r6(F.col("x.v")).alias("copied"))


@query("random_permutation", E + "SELECT vec_id, list(i ORDER BY md5(vec_id || '-' || i), i)::VARCHAR AS p FROM e CROSS JOIN (SELECT unnest(range(0, 64)) AS i) GROUP BY vec_id")
def _(spark, sf):
    return _vectors(spark, sf).select("vec_id", v.permutation(F.col("vec_id"), 64).cast("string").alias("p"))


_ANGLES = "lambda z: CASE WHEN abs(z[2] - z[4]) < pi() THEN 1 - abs(z[2] - z[4]) / pi() ELSE 1 - (2 * pi() - abs(z[2] - z[4])) / pi() END"


@query("desc_distances_more", E + """, o AS (SELECT vec_id, v, u, list_transform(range(0, 32), lambda i: v[2 * i + 1]) AS a, list_transform(range(0, 32), lambda i: 6 * v[2 * i + 2]) AS s, list_transform(range(0, 32), lambda i: u[2 * i + 1]) AS b, list_transform(range(0, 32), lambda i: 6 * u[2 * i + 2]) AS t FROM f
    ), w AS (SELECT *, list_transform(list_zip(a, s, b, t), """ + _ANGLES + """) AS k FROM o)
    SELECT vec_id, round(list_sum(list_transform(list_zip(v, u), lambda z: floor(abs(100 * z[1] - 100 * z[2]))))::DOUBLE, 6) AS hist,
      round(list_sum(list_transform(list_zip(v, u), lambda z: CASE WHEN z[1] + z[2] = 0 THEN 0 ELSE (z[1] - z[2]) * (z[1] - z[2]) / ((z[1] + z[2]) * (z[1] + z[2])) END)) / 1e3, 4) AS chi,
      round(list_sum(list_transform(list_zip(a, b, k), lambda z: ((z[1] - z[3] * z[2]) * (z[1] - z[3] * z[2]) + (z[3] * z[1] - z[2]) * (z[3] * z[1] - z[2])) / (1 + z[3] * z[3]))), 6) AS csift,
      round(list_sum(list_transform(list_zip(a, b, k), lambda z: CASE WHEN z[3] > 0.8 THEN (z[1] - z[2]) * (z[1] - z[2]) ELSE z[1] * z[1] + z[2] * z[2] END)), 6) AS csift_cut,
      round(list_sum(list_transform(list_zip(v, u, range(0, 64)), lambda z: (z[1] - z[2]) * (z[1] - z[2]) * (1 + z[3]))), 6) AS mahalanobis FROM w""")
def _(spark, sf):
    x, y = F.col("v"), F.col("u")
    pick = lambda c, k, by: F.transform(F.sequence(F.lit(0), F.lit(31)), lambda i: by * F.element_at(c, 2 * i + 1 + k))
    a, s, b, t = pick(x, 0, 1.0), pick(x, 1, 6.0), pick(y, 0, 1.0), pick(y, 1, 6.0)
    hundred = lambda c: F.transform(c, lambda z: 100 * z)
    return _pairs(spark, sf).select(
        "vec_id", r6(v.histogram_distance(hundred(x), hundred(y))).alias("hist"), F.round(v.chi_distance(x, y) / 1e3, 4).alias("chi"), r6(v.polar_distance(a, s, b, t)).alias("csift"),
        r6(v.polar_distance(a, s, b, t, cut=0.8)).alias("csift_cut"), r6(v.mahalanobis_diagonal(x, y, F.transform(v.numbered(64), lambda i: 1.0 + i))).alias("mahalanobis"),
    )


@query("emd_transport", E + """, h AS (SELECT vec_id, list_transform(v[1:8], lambda z: abs(z) + 0.01) AS a, list_transform(u[1:8], lambda z: abs(z) + 0.01) AS b FROM f
    ), c AS (SELECT vec_id, i, sum(a[i + 1] / list_sum(a) - b[i + 1] / list_sum(b)) OVER (PARTITION BY vec_id ORDER BY i) AS c FROM h CROSS JOIN (SELECT unnest(range(0, 8)) AS i))
    SELECT vec_id, round(sum(abs(c)), 6) AS d FROM c GROUP BY vec_id""")
def _(spark, sf):
    """By the general solver; along a line it is the sum of the differences of cumulated shares."""
    part = lambda c: F.transform(F.slice(c, 1, 8), lambda z: F.abs(z) + 0.01)
    eight = F.sequence(F.lit(0), F.lit(7))
    cost = F.transform(eight, lambda i: F.transform(eight, lambda j: F.abs(i - j).cast("double")))
    rows = _pairs(spark, sf).select("vec_id", part(F.col("v")).alias("a"), part(F.col("u")).alias("b"), cost.alias("cost"))
    return sparse.earth_mover(rows, "vec_id").select("vec_id", r6(F.col("d")).alias("d"))


# files ---------------------------------------------------------------------------------------------

_STORED = BASE + ", s AS (SELECT image_id, pt, x::FLOAT AS x, y::FLOAT AS y, cornerness::FLOAT AS cornerness, list_transform(vec, lambda z: greatest(0, least(255, floor((z + 1) * 127.5)))::INTEGER) AS b FROM d) "


def _stored(spark, sf) -> str:
    """A point file of the descriptors, whose scale holds the image and angle the point; its path."""
    binary.register(spark)
    b = F.transform("vec", lambda z: F.greatest(F.lit(0.0), F.least(F.lit(255.0), F.floor((z + 1) * 127.5).cast("double"))).cast("int"))
    body = F.unhex(F.concat_ws("", F.transform(b, lambda z: F.lpad(F.hex(z), 2, "0"))))
    rows = descriptors(spark, sf).select(
        F.lit("").alias("file"), "pt", "x", "y", F.col("image_id").alias("scale"), F.col("pt").alias("angle"), *[F.lit(float(i in (0, 3))).alias(f"mi{n}") for i, n in enumerate((11, 12, 21, 22))], "cornerness", body.alias("desc")
    )
    rows = rows.select(*[F.col(c).cast("float") if c in binary.GEOMETRY else F.col(c) for c in rows.columns])
    path = scratch(spark, "points")
    rows.write.format("points").option("layout", "siftgeo").mode("append").save(path)
    return path


_BYTES = "list_sum(list_transform(list_zip(b, range(0, 64)), lambda z: z[1] * (z[2] + 1)))::BIGINT AS body"


def _read(rows: DataFrame) -> DataFrame:
    number = F.aggregate(F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.conv(F.substring(F.hex("desc"), 2 * i + 1, F.lit(2)), 16, 10).cast("long") * (i + 1)), F.lit(0).cast("long"), lambda a, x: a + x)
    return rows.select(F.col("scale").cast("long").alias("image_id"), F.col("angle").cast("long").alias("pt"), "x", "y", "cornerness", number.alias("body"))


@query("points_roundtrip", _STORED + f"SELECT image_id, pt, x, y, cornerness, {_BYTES} FROM s")
def _(spark, sf):
    return _read(spark.read.format("points").load(_stored(spark, sf)))


@query("points_read_filtered", _STORED + f"SELECT image_id, pt, x, y, cornerness, {_BYTES} FROM s WHERE cornerness > 100 AND x <= 320")
def _(spark, sf):
    return _read(spark.read.format("points").option("keep", "cornerness > 100 and x <= 320").load(_stored(spark, sf)))


@query("points_read_first", "SELECT least(7, count(*)) AS n FROM embeddings")
def _(spark, sf):
    """The first rows of each file; all descriptors are in one here."""
    path = scratch(spark, "first")
    spark.read.format("points").load(_stored(spark, sf)).coalesce(1).write.format("points").option("layout", "siftgeo").mode("append").save(path)
    return spark.read.format("points").option("first", 7).load(path).agg(F.count("*").alias("n"))


@query("fvecs_roundtrip", "SELECT vec_id, i, embedding[i + 1]::FLOAT AS value FROM embeddings CROSS JOIN (SELECT unnest(range(0, 64)) AS i)")
def _(spark, sf):
    return _vector_files(spark, sf, "fvecs")


@query("fvecs_sparse_roundtrip", "SELECT vec_id, i, embedding[i + 1]::FLOAT AS value FROM embeddings CROSS JOIN (SELECT unnest(range(0, 64)) AS i)")
def _(spark, sf):
    return _vector_files(spark, sf, "spfvecs")


@query("fvecs_raw_roundtrip", "SELECT vec_id, i, embedding[i + 1]::FLOAT AS value FROM embeddings CROSS JOIN (SELECT unnest(range(0, 64)) AS i)")
def _(spark, sf):
    return _vector_files(spark, sf, "rawfvecs")


def _vector_files(spark, sf, kind: str) -> DataFrame:
    """Vectors with their vec_id in front, written and read."""
    binary.register(spark)
    rows = _vectors(spark, sf).select(F.lit("").alias("file"), F.col("vec_id").alias("id"), F.concat(F.array(F.col("vec_id").cast("float")), F.transform("v", lambda z: z.cast("float"))).alias("vec"))
    path = scratch(spark, kind)
    rows.write.format(kind).mode("append").save(path)
    back = spark.read.format(kind).option("dim", 65).load(path)
    return back.select(F.col("vec")[0].cast("long").alias("vec_id"), F.posexplode(F.slice("vec", 2, 64)).alias("i", "value")).select("vec_id", F.col("i").cast("long").alias("i"), "value")


@query("ivecs_roundtrip", "SELECT vec_id, label::BIGINT AS label FROM embeddings")
def _(spark, sf):
    binary.register(spark)
    path = scratch(spark, "ivecs")
    rows = _vectors(spark, sf).select(F.lit("").alias("file"), F.col("vec_id").alias("id"), F.array(F.col("vec_id").cast("int"), F.col("label").cast("int")).alias("vec"))
    rows.write.format("ivecs").mode("append").save(path)
    return spark.read.format("ivecs").load(path).select(F.col("vec")[0].cast("long").alias("vec_id"), F.col("vec")[1].cast("long").alias("label"))


@query("index_stored", BASE + "SELECT p.image_id, p.pt, p.vw, p.qscale, p.qangle, round(n.l2, 6) AS l2 FROM post p JOIN norms n USING (image_id)")
def _(spark, sf):
    """The index written as a snapshot, and read."""
    path = scratch(spark, "index")
    index.store(postings(spark, sf), codebook(spark, sf), path, index.Layout(buckets=8), words=16)
    found = index.load(spark, path)
    if found.facts["settings"] != {"words": 16}:
        raise ValueError("the snapshot names another codebook")
    return found.postings().join(found.norms(), "image_id").select("image_id", "pt", "vw", "qscale", "qangle", r6(F.col("l2")).alias("l2"))


@query("ivf_search_stored", ORACLE_SQL["ivf_search_topk"])
def _(spark, sf):
    """The search on a stored index: its postings, weights and norms are read, not made."""
    p, path = postings(spark, sf), scratch(spark, "index")
    index.store(p, codebook(spark, sf), path, index.Layout(buckets=8, slice_rows=64))
    found = index.search(query_points(p), index.load(spark, path), PARAMS)
    return found.select("query_id", "image_id", r6(F.col("score")).alias("score"), "rnk")


@query("ivf_search_added", ORACLE_SQL["ivf_search_topk"])
def _(spark, sf):
    """The search after all points were added as a stream of three batches."""
    path, source = scratch(spark, "index"), scratch(spark, "stream")
    points_ = descriptors(spark, sf)
    points_.repartition(3).write.parquet(source)
    projected = stored(hamming.project(assigned(spark, sf), hamming.hadamard(BITS)), "projected")
    stream = spark.readStream.schema(points_.schema).option("maxFilesPerTrigger", 1).parquet(source)
    medians = stored(hamming.medians(projected), "medians")
    ingest.append_images(stream, path, scratch(spark, "stream-state"), codebook(spark, sf), hamming.hadamard(BITS), medians, True, index.Layout(buckets=8)).awaitTermination()
    found = index.load(spark, path)
    asked = stored(query_points(found.postings()), "asked")
    return index.search(asked, found, PARAMS).select("query_id", "image_id", r6(F.col("score")).alias("score"), "rnk")


@query("models_stored", P + "SELECT vec_id, q, c FROM code")
def _(spark, sf):
    """Codes by a quantiser that was written and read."""
    path = scratch(spark, "model")
    models.write_quantizer(spark, _model(spark, sf), path)
    coded = pq.encode(_points(spark, sf), models.read_quantizer(spark, path))
    return coded.select("vec_id", F.posexplode("codes").alias("q", "c")).select("vec_id", F.col("q").cast("long").alias("q"), F.col("c").cast("long").alias("c"))


@query("medians_stored", BASE + "SELECT vec_id, lo, hi FROM sig")
def _(spark, sf):
    """Signatures by a basis and medians that were written and read."""
    projected = stored(hamming.project(assigned(spark, sf), hamming.hadamard(BITS)), "projected")
    path = scratch(spark, "binarizer")
    models.write_binarizer(spark, hamming.hadamard(BITS), hamming.medians(projected), path)
    basis, medians = models.read_binarizer(spark, path)
    s = hamming.signatures(hamming.project(assigned(spark, sf), basis), medians)
    return s.select("vec_id", F.col("binsign").bitwiseAND(F.lit((1 << 32) - 1)).alias("lo"), F.shiftrightunsigned("binsign", 32).alias("hi"))
