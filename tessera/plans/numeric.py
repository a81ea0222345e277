"""Queries on order statistics, vectors, bags of features and sparse vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import vectors as v
from tessera.operators import ranking, sparse
from tessera.plans.fixtures import BASE, descriptors
from tessera.plans.registry import query, table
from tessera.plans.retrieval import r6
from tessera.sources.scratch import stored

E = "WITH e AS (SELECT vec_id, label, list_transform(embedding, lambda z: z::DOUBLE) AS v FROM embeddings), f AS (SELECT e.*, b.v AS u FROM e JOIN e b ON b.vec_id = e.vec_id + 1) "


def _vectors(spark, sf) -> DataFrame:
    return table(spark, sf, "embeddings").select("vec_id", "label", v.doubles(F.col("embedding")).alias("v"))


def _pairs(spark, sf) -> DataFrame:
    e = _vectors(spark, sf)
    return e.join(e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("v").alias("u")), "vec_id")


# order statistics --------------------------------------------------------------------------------


@query("topk_max", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 50")
def _(spark, sf):
    return ranking.top_k(table(spark, sf, "orders"), "o_totalprice", 50, "o_orderkey").select("o_orderkey", "o_totalprice")


@query("topk_min", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice, o_orderkey LIMIT 50")
def _(spark, sf):
    return ranking.top_k(table(spark, sf, "orders"), "o_totalprice", 50, "o_orderkey", False).select("o_orderkey", "o_totalprice")


@query("argsort", "SELECT l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice, l_linenumber)::INTEGER AS pos FROM lineitem")
def _(spark, sf):
    w = Window.partitionBy("l_orderkey").orderBy("l_extendedprice", "l_linenumber")
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.row_number().over(w).alias("pos"))


@query("invert_perm", "SELECT l_orderkey, pos, l_linenumber FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice, l_linenumber)::INTEGER AS pos FROM lineitem)")
def _(spark, sf):
    perm = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct("l_extendedprice", "l_linenumber"))).alias("p"))
    placed = perm.select("l_orderkey", F.posexplode("p").alias("i", "x"))
    return placed.select("l_orderkey", (F.col("i") + 1).alias("pos"), F.col("x.l_linenumber").alias("l_linenumber"))


for _name, _op in (("ranks_dec", ">"), ("ranks_inc", "<")):

    @query(_name, f"SELECT w.value, count(*) FILTER (p.p_retailprice {_op} w.value) AS least, count(*) FILTER (p.p_retailprice {_op}= w.value) - 1 AS most FROM part p CROSS JOIN (SELECT DISTINCT p_retailprice AS value FROM part WHERE p_size = 7) w GROUP BY w.value")
    def _(spark, sf, decreasing=_op == ">"):
        p = table(spark, sf, "part")
        return ranking.value_ranks(p, p.where("p_size = 7"), "p_retailprice", decreasing)


@query("find_labels", "SELECT p.p_partkey, coalesce(s.s_suppkey, -1) AS found FROM part p LEFT JOIN supplier s ON s.s_suppkey = p.p_partkey * 3")
def _(spark, sf):
    s = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("k"))
    p = table(spark, sf, "part").select("p_partkey", (F.col("p_partkey") * 3).alias("k"))
    return p.join(s.withColumn("found", F.col("k")), "k", "left").select("p_partkey", F.coalesce("found", F.lit(-1)).alias("found"))


@query("asof_find", "SELECT a.event_id, (SELECT max_by(b.event_id, (b.ts, b.event_id)) FROM events b WHERE b.user_id = a.user_id AND b.event_type = (SELECT min(event_type) FROM events) AND b.ts <= a.ts) AS last FROM events a WHERE a.event_type = (SELECT max(event_type) FROM events)")
def _(spark, sf):
    e = table(spark, sf, "events")
    ends = e.agg(F.min("event_type").alias("low"), F.max("event_type").alias("high"))
    marked = e.crossJoin(F.broadcast(ends))  # one row
    rows = marked.where("event_type = low").groupBy("user_id", "ts").agg(F.max("event_id").alias("last"))
    return ranking.as_of(rows, marked.where("event_type = high").select("user_id", "ts", "event_id"), "user_id", "ts", "last").select("event_id", "last")


@query("count_distinct", "SELECT l_returnflag, count(DISTINCT l_partkey) AS parts, count(*) FILTER (l_quantity = 10)::BIGINT AS tens FROM lineitem GROUP BY l_returnflag")
def _(spark, sf):
    return table(spark, sf, "lineitem").groupBy("l_returnflag").agg(F.count_distinct("l_partkey").alias("parts"), F.count_if(F.col("l_quantity") == 10).alias("tens"))


@query("median", "SELECT l_returnflag, round(median(l_quantity), 6) AS m FROM lineitem GROUP BY l_returnflag")
def _(spark, sf):
    return table(spark, sf, "lineitem").groupBy("l_returnflag").agg(r6(F.median("l_quantity")).alias("m"))


@query("quantile", "SELECT l_returnflag, round(quantile_disc(l_quantity, 0.25), 6) AS q FROM lineitem GROUP BY l_returnflag")
def _(spark, sf):
    # order statistic from the counts of distinct values
    counts = table(spark, sf, "lineitem").groupBy("l_returnflag", "l_quantity").agg(F.count("*").alias("n"))
    w = Window.partitionBy("l_returnflag")
    at = counts.withColumn("c", F.sum("n").over(w.orderBy("l_quantity"))).withColumn("t", F.sum("n").over(w))
    return at.where("c >= ceil(0.25D * t)").groupBy("l_returnflag").agg(r6(F.min("l_quantity")).alias("q"))


@query("argmin", "SELECT o_custkey, arg_min(o_orderkey, (o_totalprice, o_orderkey)) AS least, arg_max(o_orderkey, (o_totalprice, o_orderkey)) AS most, min(o_totalprice) AS low FROM orders GROUP BY o_custkey")
def _(spark, sf):
    by = F.struct("o_totalprice", "o_orderkey")
    return table(spark, sf, "orders").groupBy("o_custkey").agg(F.min_by("o_orderkey", by).alias("least"), F.max_by("o_orderkey", by).alias("most"), F.min("o_totalprice").alias("low"))


@query("merge_ordered", "SELECT k, row_number() OVER (ORDER BY k, src)::BIGINT AS pos FROM (SELECT p_partkey AS k, 0 AS src FROM part UNION ALL SELECT s_suppkey, 1 FROM supplier)")
def _(spark, sf):
    both = table(spark, sf, "part").select(F.col("p_partkey").alias("k"), F.lit(0).alias("src")).unionByName(table(spark, sf, "supplier").select(F.col("s_suppkey").alias("k"), F.lit(1).alias("src")))
    ranged = stored(both.repartitionByRange("k", "src").withColumn("_p", F.spark_partition_id()), "ranged")  # both uses see the same ranges
    sizes = ranged.groupBy("_p").agg(F.count("*").alias("c"))
    before = sizes.select("_p", (F.sum("c").over(Window.orderBy("_p")) - F.col("c")).alias("before"))  # a row for each partition
    w = Window.partitionBy("_p").orderBy("k", "src")
    return ranged.withColumn("i", F.row_number().over(w)).join(before, "_p").select("k", (F.col("before") + F.col("i")).alias("pos"))


# vectors -----------------------------------------------------------------------------------------


@query("vec_range", E + "SELECT vec_id, list_sum(list_transform(range(0, len(v)), lambda i: i * label))::BIGINT AS s FROM e")
def _(spark, sf):
    steps = F.transform(F.sequence(F.lit(0), F.size("v") - 1), lambda i: i * F.col("label"))
    return _vectors(spark, sf).select("vec_id", F.aggregate(steps, F.lit(0).cast("long"), lambda a, x: a + x).alias("s"))


@query("vec_scalar_ops", E + "SELECT vec_id, round(list_sum(list_transform(v, lambda z: sqrt(abs((z + 1) * 3 / 2 - 0.5)))), 6) AS s FROM e")
def _(spark, sf):
    return _vectors(spark, sf).select("vec_id", r6(v.total(F.transform("v", lambda x: F.sqrt(F.abs((x + 1) * 3 / 2 - 0.5))))).alias("s"))


@query("vec_pair_ops", E + "SELECT vec_id, round(list_sum(list_transform(list_zip(v, u), lambda z: z[1] + z[2])), 6) + 0.0 AS a, round(list_sum(list_transform(list_zip(v, u), lambda z: z[1] - z[2])), 6) + 0.0 AS s, round(list_sum(list_transform(list_zip(v, u), lambda z: z[1] * z[2])), 6) + 0.0 AS m FROM f")
def _(spark, sf):
    a, b = F.col("v"), F.col("u")
    return _pairs(spark, sf).select("vec_id", r6(v.total(v.add(a, b))).alias("a"), r6(v.total(v.subtract(a, b))).alias("s"), r6(v.total(v.multiply(a, b))).alias("m"))


@query("vec_norms", E + "SELECT vec_id, round(list_sum(list_transform(v, lambda z: abs(z))), 6) AS l1, round(sqrt(list_sum(list_transform(v, lambda z: z * z))), 6) AS l2, round(pow(list_sum(list_transform(v, lambda z: pow(abs(z), 3))), 1.0::DOUBLE / 3), 6) AS l3, len(list_filter(v, lambda z: z > 0))::BIGINT AS positive FROM e")
def _(spark, sf):
    c = F.col("v")
    return _vectors(spark, sf).select("vec_id", r6(v.norm(c, 1)).alias("l1"), r6(v.norm(c, 2)).alias("l2"), r6(v.norm(c, 3)).alias("l3"), F.size(F.filter("v", lambda x: x > 0)).cast("long").alias("positive"))


@query("entropy", E + "SELECT vec_id, round(-list_sum(list_transform(v, lambda z: z * z * log2(z * z + 1e-300::DOUBLE))), 6) + 0.0 AS h FROM e")
def _(spark, sf):
    return _vectors(spark, sf).select("vec_id", r6(v.entropy(F.transform("v", lambda x: x * x))).alias("h"))


@query("vec_normalize", E + "SELECT vec_id, round(list_sum(list_transform(v, lambda z: z / list_sum(list_transform(v, lambda y: abs(y))))), 6) + 0.0 AS s FROM e")
def _(spark, sf):
    return _vectors(spark, sf).select("vec_id", r6(v.total(v.normalized(F.col("v"), 1))).alias("s"))


@query("purge_nans", E + "SELECT vec_id, round(list_sum(list_transform(v, lambda z: CASE WHEN z < -0.1 THEN 7 ELSE z END)), 6) + 0.0 AS s FROM e")
def _(spark, sf):
    broken = F.transform("v", lambda x: F.when(x < -0.1, F.lit(float("nan"))).otherwise(x))
    return _vectors(spark, sf).select("vec_id", r6(v.total(v.without_nans(broken, 7.0))).alias("s"))


@query("vec_distances", E + "SELECT vec_id, round(list_sum(list_transform(list_zip(v, u), lambda z: abs(z[1] - z[2]))), 6) AS l1, round(list_sum(list_transform(list_zip(v, u), lambda z: (z[1] - z[2]) * (z[1] - z[2]))), 6) AS l2, round(list_sum(list_transform(list_zip(v, u), lambda z: z[1] * z[2])), 6) + 0.0 AS ip FROM f")
def _(spark, sf):
    a, b = F.col("v"), F.col("u")
    return _pairs(spark, sf).select("vec_id", r6(v.distance_l1(a, b)).alias("l1"), r6(v.distance_l2_squared(a, b)).alias("l2"), r6(v.inner_product(a, b)).alias("ip"))


@query("desc_distances", E + "SELECT vec_id, round(sqrt(list_sum(list_transform(list_zip(v, u), lambda z: (z[1] - z[2]) * (z[1] - z[2])))), 6) AS euclid, round(list_sum(list_transform(list_zip(v, u), lambda z: least(abs(z[1]), abs(z[2])))), 6) AS shared, round(list_sum(list_transform(list_zip(v, u), lambda z: CASE WHEN abs(z[1]) + abs(z[2]) = 0 THEN 0 ELSE (abs(z[1]) - abs(z[2])) * (abs(z[1]) - abs(z[2])) / (abs(z[1]) + abs(z[2])) END)), 6) AS chi2 FROM f")
def _(spark, sf):
    a, b = (F.transform(c, F.abs) for c in ("v", "u"))
    return _pairs(spark, sf).select("vec_id", r6(F.sqrt(v.distance_l2_squared(F.col("v"), F.col("u")))).alias("euclid"), r6(v.total(F.zip_with(a, b, lambda x, y: F.least(x, y)))).alias("shared"), r6(v.distance_chi2(a, b)).alias("chi2"))


@query("chi2_dist", E + "SELECT vec_id, round(list_sum(list_transform(list_zip(v, u), lambda z: CASE WHEN abs(z[1]) + abs(z[2]) = 0 THEN 0 ELSE (abs(z[1]) - abs(z[2])) * (abs(z[1]) - abs(z[2])) / (abs(z[1]) + abs(z[2])) END)), 6) AS d FROM f")
def _(spark, sf):
    a, b = (F.transform(c, F.abs) for c in ("v", "u"))
    return _pairs(spark, sf).select("vec_id", r6(v.distance_chi2(a, b)).alias("d"))


@query("desc_moments", E + "SELECT vec_id, round(list_avg(v), 6) + 0.0 AS mean, round(list_median(v), 6) + 0.0 AS med, round(list_var_pop(v), 6) AS var FROM e")
def _(spark, sf):
    x = _vectors(spark, sf).select("vec_id", F.explode("v").alias("x")).groupBy("vec_id")
    return x.agg(r6(F.avg("x")).alias("mean"), r6(F.median("x")).alias("med"), r6(F.var_pop("x")).alias("var"))


@query("histogram", E + "SELECT label, greatest(0, least(9, floor((x + 0.5) * 10)))::BIGINT AS bin, count(*) AS n FROM (SELECT label, unnest(v) AS x FROM e) GROUP BY ALL")
def _(spark, sf):
    bins = F.greatest(F.lit(0), F.least(F.lit(9), F.floor((F.col("x") + 0.5) * 10))).cast("long")
    return _vectors(spark, sf).select("label", F.explode("v").alias("x")).groupBy("label", bins.alias("bin")).agg(F.count("*").alias("n"))


@query("vec_positions", E + "SELECT vec_id, len(list_filter(v, lambda z: z > 0.2))::BIGINT AS n, coalesce(list_position(list_transform(v, lambda z: z > 0.2), true), 0)::BIGINT AS first FROM e")
def _(spark, sf):
    high = F.transform("v", lambda x: x > 0.2)
    return _vectors(spark, sf).select("vec_id", F.size(F.filter(high, lambda x: x)).cast("long").alias("n"), F.array_position(high, F.lit(True)).alias("first"))


@query("vec_poly_hash", E + "SELECT vec_id, list_reduce(list_prepend(0::BIGINT, list_transform(v, lambda z: floor(z * 100)::BIGINT)), lambda a, x: (a * 31 + x) % 1000003) AS h FROM e")
def _(spark, sf):
    whole = F.transform("v", lambda x: F.floor(x * 100).cast("long"))
    return _vectors(spark, sf).select("vec_id", F.aggregate(whole, F.lit(0).cast("long"), lambda a, x: (a * 31 + x) % 1000003).alias("h"))


@query("splat_add", "SELECT p_size AS slot, round(sum(p_retailprice), 6) AS s FROM part GROUP BY p_size")
def _(spark, sf):
    return table(spark, sf, "part").groupBy(F.col("p_size").alias("slot")).agg(r6(F.sum("p_retailprice")).alias("s"))


@query("matmul", E + ", m AS (SELECT vec_id AS r, i.i, v[i.i + 1] AS x FROM e CROSS JOIN (SELECT unnest(range(0, 64)) AS i) i) SELECT a.i AS r, b.i AS c, round(sum(a.x * b.x), 6) + 0.0 AS x FROM m a JOIN m b ON a.r = b.r GROUP BY ALL")
def _(spark, sf):
    """The product of the transposed matrix of all vectors and that matrix."""
    cells = _vectors(spark, sf).select("vec_id", F.posexplode("v").alias("p", "x"))
    left = cells.select(F.col("p").cast("long").alias("r"), F.col("vec_id").alias("i"), "x")
    return sparse.matrix_product(left, left.select("i", F.col("r").alias("c"), F.col("x").alias("y"))).select("r", "c", r6(F.col("x")).alias("x"))


@query("splat_separable", "SELECT l_linenumber AS r, l_returnflag AS c, round(sum(l_quantity), 6) AS s FROM lineitem GROUP BY ALL")
def _(spark, sf):
    return table(spark, sf, "lineitem").groupBy(F.col("l_linenumber").alias("r"), F.col("l_returnflag").alias("c")).agg(r6(F.sum("l_quantity")).alias("s"))


@query("joint_hist", "SELECT o_orderstatus AS a, o_orderpriority AS b, count(*) AS n FROM orders GROUP BY ALL")
def _(spark, sf):
    return table(spark, sf, "orders").groupBy(F.col("o_orderstatus").alias("a"), F.col("o_orderpriority").alias("b")).agg(F.count("*").alias("n"))


@query("emd", E + """, c AS (SELECT f.vec_id, i.i, sum(abs(f.v[i.i + 1]) / list_sum(list_transform(f.v, lambda z: abs(z))) - abs(f.u[i.i + 1]) / list_sum(list_transform(f.u, lambda z: abs(z)))) OVER (PARTITION BY f.vec_id ORDER BY i.i) AS c FROM f CROSS JOIN (SELECT unnest(range(0, 64)) AS i) i)
    SELECT vec_id, round(sum(abs(c)), 6) AS d FROM c GROUP BY vec_id""")
def _(spark, sf):
    return _pairs(spark, sf).select("vec_id", r6(sparse.earth_mover_1d(F.transform("v", F.abs), F.transform("u", F.abs))).alias("d"))


# bags of features and sparse vectors -------------------------------------------------------------

BAG = "WITH b AS (SELECT doc_id AS image_id, ('0x' || substr(md5(w), 1, 6))::BIGINT % 1000 AS vw, count(*) AS n FROM (SELECT doc_id, unnest(string_split_regex(text, '[ \\t\\n\\r\\v\\f]+')) AS w FROM documents) WHERE w <> '' GROUP BY ALL) "


def bags(spark, sf) -> DataFrame:
    """Documents as images and words as points, hashed to 1000 visual words."""
    return sparse.bag_of_texts(table(spark, sf, "documents").select(F.col("doc_id").alias("image_id"), "text"), 1000)


@query("bof", BAG + "SELECT image_id, vw, n FROM b")
def _(spark, sf):
    return bags(spark, sf)


_SIGN = "(1 - 2 * (bit_count(vw & atom) % 2))"
_ATOMS = BAG[:-1] + f", w AS (SELECT vw, ln((SELECT sum(n) FROM b) / sum(n)) AS w FROM b GROUP BY vw), x AS (SELECT b.image_id, b.vw, n * w / sqrt(sum(n * w * n * w) OVER (PARTITION BY image_id)) AS x FROM b JOIN w USING (vw)), s AS (SELECT image_id, atom, round(sum(x * {_SIGN}), 6) + 0.0 AS s FROM x CROSS JOIN (SELECT unnest(range(1, 9)) AS atom) a GROUP BY ALL) "


def _signatures(spark, sf) -> DataFrame:
    x = sparse.tfidf_normalized(bags(spark, sf))
    return sparse.hadamard_atoms(x, range(1, 9)).select("image_id", "atom", r6(F.col("s")).alias("s"))


@query("atoms_signature", _ATOMS + "SELECT image_id, atom, s FROM s")
def _(spark, sf):
    return _signatures(spark, sf)


@query("hesp_signature", _ATOMS + "SELECT image_id, atom FROM s QUALIFY row_number() OVER (PARTITION BY image_id ORDER BY s DESC, atom) <= 4")
def _(spark, sf):
    return sparse.half_strongest(_signatures(spark, sf), 8)


@query("to_sparse", E + "SELECT vec_id, i - 1 AS idx, round(x, 6) AS x FROM (SELECT vec_id, unnest(range(1, 65)) AS i, unnest(v) AS x FROM e) WHERE x > 0.1")
def _(spark, sf):
    return sparse.from_dense(_vectors(spark, sf).select("vec_id", F.transform("v", lambda x: F.when(x > 0.1, x).otherwise(0.0)).alias("v")), "vec_id").select("vec_id", F.col("idx").cast("long").alias("idx"), r6(F.col("x")).alias("x"))


@query("to_dense", BAG + "SELECT image_id, list_sum(list_transform(range(0, 1000), lambda i: i * coalesce(list_extract(map_extract(m, i), 1), 0)))::BIGINT AS s FROM (SELECT image_id, map_from_entries(list((vw, n))) AS m FROM b GROUP BY image_id)")
def _(spark, sf):
    dense = sparse.to_dense(bags(spark, sf).select("image_id", F.col("vw").alias("idx"), F.col("n").alias("x")), "image_id", 1000)
    return dense.select("image_id", F.aggregate(F.transform("v", lambda x, i: x * i), F.lit(0).cast("long"), lambda a, x: a + x.cast("long")).alias("s"))


@query("sparse_dot", BAG + "SELECT p.image_id AS a, q.image_id AS b, sum(p.n * q.n)::BIGINT AS dot FROM b p JOIN b q USING (vw) WHERE p.image_id % 20 = 0 AND p.image_id <> q.image_id GROUP BY ALL")
def _(spark, sf):
    rows = stored(bags(spark, sf), "bags")
    return sparse.dot_products_of_all(rows.where("image_id % 20 = 0"), rows).where("a <> b")
