"""Queries on usage data: dashboards, quotas, rankings, paging, search, and changes of tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators import usage
from tessera.plans.registry import query, table
from tessera.plans.retrieval import r6
from tessera.sources import text_index
from tessera.sources.scratch import scratch

#: Plan, visuals, queries, price of a query beyond them.
PLANS = [("freemium", 10, 1, None), ("basic", 1000, 1, 0.09), ("intermediate", 5000, 50000, 0.04), ("premium", 10000, 100000, 0.02)]
_PLANS_SQL = "plans AS (SELECT * FROM (VALUES ('freemium', 10, 1, NULL::DOUBLE), ('basic', 1000, 1, 0.09::DOUBLE), ('intermediate', 5000, 50000, 0.04::DOUBLE), ('premium', 10000, 100000, 0.02::DOUBLE)) t(plan, visuals, queries, price))"
#: events as the queries table; 100 visuals in 5 projects of 10 users.
Q = """WITH q AS (SELECT event_id AS id, user_id AS phone_id, value AS latitude, -value AS longitude, event_type AS city, ts AS quering_date,
  (props::JSON->>'k')::BIGINT % 100 AS visual_id, (props::JSON->>'k')::BIGINT % 5 AS project_id FROM events)
"""


def searches(spark, sf) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("long")
    return table(spark, sf, "events").select(F.col("event_id").alias("id"), F.col("user_id").alias("phone_id"), F.col("value").alias("latitude"), (-F.col("value")).alias("longitude"), F.col("event_type").alias("city"), F.col("ts").alias("quering_date"), (k % 100).alias("visual_id"), (k % 5).alias("project_id"))


def _plans(spark) -> DataFrame:
    return spark.createDataFrame(PLANS, "plan string, visuals int, queries int, price double")


_PLAN_OF = "CASE c_custkey % 4 WHEN 0 THEN 'freemium' WHEN 1 THEN 'basic' WHEN 2 THEN 'intermediate' ELSE 'premium' END"


def _users(spark, sf) -> DataFrame:
    return table(spark, sf, "customer").select(F.col("c_custkey").alias("user_id"), F.col("c_name").alias("username"), F.expr(_PLAN_OF).alias("plan"))


@query("filter_first", "SELECT min(c_custkey) AS user_id FROM customer WHERE c_mktsegment = (SELECT min(c_mktsegment) FROM customer)")
def _(spark, sf):
    c = table(spark, sf, "customer")
    first = c.agg(F.min("c_mktsegment").alias("c_mktsegment"))
    return c.join(first, "c_mktsegment", "left_semi").orderBy("c_custkey").limit(1).select(F.col("c_custkey").alias("user_id"))


@query("usage_current_month", Q + "SELECT phone_id, count(*) AS n FROM q WHERE quering_date >= TIMESTAMP '2024-01-01' AND quering_date < TIMESTAMP '2024-02-01' GROUP BY phone_id")
def _(spark, sf):
    inside = F.col("quering_date").between(F.expr("timestamp_ntz'2024-01-01'"), F.expr("timestamp_ntz'2024-01-31 23:59:59.999999'"))
    return searches(spark, sf).where(inside).groupBy("phone_id").agg(F.count("*").alias("n"))


@query("project_counts", "SELECT c_custkey, count(DISTINCT o_orderkey) AS visuals, count(l_orderkey) AS queries FROM customer LEFT JOIN orders ON o_custkey = c_custkey LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY c_custkey")
def _(spark, sf):
    lines = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("lines"))
    visuals = table(spark, sf, "orders").join(lines, "o_orderkey", "left").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("visuals"), F.sum("lines").alias("queries"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return table(spark, sf, "customer").select("c_custkey").join(visuals, "c_custkey", "left").select("c_custkey", zero("visuals"), zero("queries"))


@query("quota_check", f"WITH {_PLANS_SQL} SELECT c_custkey AS user_id, count(o_orderkey) >= any_value(visuals) AS reached FROM (SELECT *, {_PLAN_OF} AS plan FROM customer) JOIN plans USING (plan) LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey")
def _(spark, sf):
    counts = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("user_id")).agg(F.count("*").alias("n"))
    joined = _users(spark, sf).join(_plans(spark), "plan").join(counts, "user_id", "left")
    return joined.select("user_id", (F.coalesce("n", F.lit(0)) >= F.col("visuals")).alias("reached"))


@query("usage_summary", Q[:-1] + f", {_PLANS_SQL} SELECT phone_id, monthname(quering_date) AS month, count(*) AS now, any_value(queries)::BIGINT AS most, any_value(price) AS price FROM (SELECT *, CASE phone_id % 4 WHEN 0 THEN 'freemium' WHEN 1 THEN 'basic' WHEN 2 THEN 'intermediate' ELSE 'premium' END AS plan FROM q) JOIN plans USING (plan) GROUP BY ALL")
def _(spark, sf):
    plan = F.expr(_PLAN_OF.replace("c_custkey", "phone_id"))
    used = searches(spark, sf).groupBy("phone_id", F.date_format("quering_date", "MMMM").alias("month")).agg(F.count("*").alias("now")).withColumn("plan", plan)
    return used.join(_plans(spark), "plan").select("phone_id", "month", "now", F.col("queries").cast("long").alias("most"), "price")


@query("queries_this_month", Q + "SELECT project_id, count(*) AS n FROM q WHERE month(quering_date) = 1 GROUP BY project_id")
def _(spark, sf):
    return searches(spark, sf).where(F.month("quering_date") == 1).groupBy("project_id").agg(F.count("*").alias("n"))


_DAYS = Q[:-1] + """, cal AS (SELECT unnest(generate_series(make_date(year(min(quering_date))::BIGINT, 1, 1)::TIMESTAMP, make_date(year(max(quering_date))::BIGINT, 12, 31)::TIMESTAMP, INTERVAL 1 DAY))::DATE AS day FROM q),
days AS (SELECT cal.day, count(q.id) AS n FROM cal LEFT JOIN q ON q.quering_date::DATE = cal.day GROUP BY cal.day) """


@query("dash_daily", _DAYS + "SELECT year(day)::INTEGER AS y, month(day)::INTEGER AS m, dayofmonth(day)::INTEGER AS d, n FROM days")
def _(spark, sf):
    days = usage.daily_counts(searches(spark, sf), "quering_date")
    return days.select(F.year("day").alias("y"), F.month("day").alias("m"), F.dayofmonth("day").alias("d"), "n")


@query("dash_monthly", _DAYS + "SELECT year(day)::INTEGER AS y, month(day)::INTEGER AS m, sum(n)::BIGINT AS n FROM days GROUP BY 1, 2")
def _(spark, sf):
    return usage.daily_counts(searches(spark, sf), "quering_date").groupBy(F.year("day").alias("y"), F.month("day").alias("m")).agg(F.sum("n").alias("n"))


@query("dash_yearly", Q + "SELECT year(quering_date)::INTEGER AS y, count(*) AS n FROM q GROUP BY 1")
def _(spark, sf):
    return searches(spark, sf).groupBy(F.year("quering_date").alias("y")).agg(F.count("*").alias("n"))


@query("dash_rollup", _DAYS + "SELECT year(day)::INTEGER AS y, month(day)::INTEGER AS m, dayofmonth(day)::INTEGER AS d, sum(n)::BIGINT AS n FROM days GROUP BY ROLLUP (1, 2, 3)")
def _(spark, sf):
    days = usage.daily_counts(searches(spark, sf), "quering_date").select(F.year("day").alias("y"), F.month("day").alias("m"), F.dayofmonth("day").alias("d"), "n")
    return days.rollup("y", "m", "d").agg(F.sum("n").alias("n"))


@query("dash_empty", _DAYS + "SELECT p.project_id, cal.day::VARCHAR AS day, count(q.id) AS n FROM cal CROSS JOIN (SELECT unnest([0, 99]) AS project_id) p LEFT JOIN q ON q.quering_date::DATE = cal.day AND q.project_id = p.project_id GROUP BY ALL")
def _(spark, sf):
    facts = searches(spark, sf)
    days = usage.calendar(facts, "quering_date").withColumn("project_id", F.explode(F.array(F.lit(0), F.lit(99))))
    counts = facts.groupBy(F.to_date("quering_date").alias("day"), F.col("project_id").cast("int").alias("project_id")).agg(F.count("*").alias("n"))
    return days.join(counts, ["day", "project_id"], "left").select("project_id", F.col("day").cast("string").alias("day"), F.coalesce("n", F.lit(0)).alias("n"))


@query("dash_unique_users", Q + "SELECT project_id, year(quering_date)::INTEGER AS y, count(DISTINCT phone_id) AS users FROM q GROUP BY ALL")
def _(spark, sf):
    return searches(spark, sf).groupBy("project_id", F.year("quering_date").alias("y")).agg(F.count_distinct("phone_id").alias("users"))


@query("dash_returning", Q + "SELECT project_id, y, count(*) FILTER (n > 1) AS users FROM (SELECT project_id, year(quering_date)::INTEGER AS y, phone_id, count(*) AS n FROM q GROUP BY ALL) GROUP BY project_id, y")
def _(spark, sf):
    per_user = searches(spark, sf).groupBy("project_id", F.year("quering_date").alias("y"), "phone_id").agg(F.count("*").alias("n"))
    return per_user.groupBy("project_id", "y").agg(F.count_if(F.col("n") > 1).alias("users"))


@query("dash_markers", Q + "SELECT year(quering_date)::INTEGER AS y, phone_id, printf('(%f, %f)', latitude, longitude) AS at, count(*) AS n FROM q GROUP BY ALL")
def _(spark, sf):
    return searches(spark, sf).groupBy(F.year("quering_date").alias("y"), "phone_id", F.format_string("(%f, %f)", "latitude", "longitude").alias("at")).agg(F.count("*").alias("n"))


@query("dash_center", Q + "SELECT project_id, round(avg(latitude), 6) AS lat, round(avg(longitude), 6) AS lon FROM q GROUP BY project_id")
def _(spark, sf):
    return searches(spark, sf).groupBy("project_id").agg(r6(F.avg("latitude")).alias("lat"), r6(F.avg("longitude")).alias("lon"))


@query("dash_cities", Q + "SELECT city, count(*) AS n, printf('%.1f', 100 * count(*) / sum(count(*)) OVER ()::DOUBLE) AS percent FROM q GROUP BY city")
def _(spark, sf):
    return usage.shares(searches(spark, sf), "city")


@query("rank_visuals", Q + "SELECT visual_id, count(*) AS n FROM q GROUP BY visual_id ORDER BY n DESC, visual_id LIMIT 10")
def _(spark, sf):
    return usage.ranked(searches(spark, sf), "visual_id", 10)


@query("page_visuals", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 5 OFFSET 10")
def _(spark, sf):
    return usage.page(table(spark, sf, "orders"), [F.desc("o_orderdate"), "o_orderkey"], 3).select("o_orderkey", "o_totalprice")


_NOTES = "SELECT event_id FROM events WHERE event_type = (SELECT min(event_type) FROM events) ORDER BY ts DESC, event_id "


def _notes(spark, sf) -> DataFrame:
    e = table(spark, sf, "events")
    return e.join(F.broadcast(e.agg(F.min("event_type").alias("event_type"))), "event_type", "left_semi")  # one row


@query("notif_latest", _NOTES + "LIMIT 5")
def _(spark, sf):
    return usage.page(_notes(spark, sf), [F.desc("ts"), "event_id"], 1).select("event_id")


@query("notif_rest", _NOTES + "OFFSET 5")
def _(spark, sf):
    notes = _notes(spark, sf)
    newest = usage.page(notes, [F.desc("ts"), "event_id"], 1).select("event_id")
    return notes.join(F.broadcast(newest), "event_id", "left_anti").select("event_id")  # five rows


@query("notif_defresh", "SELECT event_id, CASE WHEN user_id % 2 = 0 THEN false ELSE value > 0 END AS fresh FROM events")
def _(spark, sf):
    return table(spark, sf, "events").select("event_id", F.when(F.col("user_id") % 2 == 0, F.lit(False)).otherwise(F.col("value") > 0).alias("fresh"))


@query("bills_desc", "SELECT o_custkey, o_orderkey, round(o_totalprice, 2) AS total, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey)::INTEGER AS r FROM orders")
def _(spark, sf):
    w = Window.partitionBy("o_custkey").orderBy(F.desc("o_orderdate"), "o_orderkey")
    return table(spark, sf, "orders").select("o_custkey", "o_orderkey", F.round("o_totalprice", 2).alias("total"), F.row_number().over(w).alias("r"))


@query("text_search", """WITH t AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda w: w <> '') AS t FROM documents),
    c AS (SELECT doc_id, len(t)::DOUBLE AS n, len(list_filter(t, lambda w: w = 'worthless'))::DOUBLE AS a, len(list_filter(t, lambda w: w = 'license'))::DOUBLE AS b FROM t),
    s AS (SELECT count(*)::DOUBLE AS total, avg(n) AS av, count(*) FILTER (a > 0)::DOUBLE AS da, count(*) FILTER (b > 0)::DOUBLE AS db FROM c)
    SELECT doc_id, round(ln((total - da + 0.5) / (da + 0.5) + 1) * a * 2.2::DOUBLE / (a + 1.2::DOUBLE * (0.25 + 0.75 * n / av)) + ln((total - db + 0.5) / (db + 0.5) + 1) * b * 2.2::DOUBLE / (b + 1.2::DOUBLE * (0.25 + 0.75 * n / av)), 6) AS score
    FROM c, s WHERE a > 0 OR b > 0""")
def _(spark, sf):
    found = usage.text_search(table(spark, sf, "documents"), ["worthless", "license"])
    return found.select("doc_id", r6(F.col("score")).alias("score"))


_WORDS = ("worthless", "license", "the")


@query("text_search_stored", """WITH t AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda w: w <> '') AS t FROM documents),
    c AS (SELECT doc_id, coalesce(len(t), 0)::DOUBLE AS n, len(list_filter(t, lambda w: w = 'worthless'))::DOUBLE AS a, len(list_filter(t, lambda w: w = 'license'))::DOUBLE AS b, len(list_filter(t, lambda w: w = 'the'))::DOUBLE AS c FROM t),
    s AS (SELECT count(*)::DOUBLE AS total, avg(n) AS av, count(*) FILTER (a > 0)::DOUBLE AS da, count(*) FILTER (b > 0)::DOUBLE AS db, count(*) FILTER (c > 0)::DOUBLE AS dc FROM c),
    f AS (SELECT doc_id, round(2.2::DOUBLE * (ln((total - da + 0.5) / (da + 0.5) + 1) * a / (a + 1.2::DOUBLE * (0.25 + 0.75 * n / av)) + ln((total - db + 0.5) / (db + 0.5) + 1) * b / (b + 1.2::DOUBLE * (0.25 + 0.75 * n / av))
      + ln((total - dc + 0.5) / (dc + 0.5) + 1) * c / (c + 1.2::DOUBLE * (0.25 + 0.75 * n / av))), 9) AS score FROM c, s WHERE a > 0 OR b > 0 OR c > 0)
    SELECT doc_id, round(score, 6) AS score, row_number() OVER (ORDER BY score DESC, doc_id)::INTEGER AS rnk FROM f QUALIFY rnk <= 50""")
def _(spark, sf):
    index = text_index.write(table(spark, sf, "documents"), scratch(spark, "text_index"))
    return text_index.search(index, list(_WORDS), 50).rows.select("doc_id", r6(F.col("score")).alias("score"), "rnk")


@query("cascade_delete", "SELECT 'orders' AS tbl, count(*) AS n FROM orders WHERE o_custkey % 7 <> 0 UNION ALL SELECT 'lineitem', count(*) FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_custkey % 7 <> 0")
def _(spark, sf):
    orders = table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    gone = orders.where("o_custkey % 7 = 0").select("o_orderkey")
    lines = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"))
    kept, lines_kept = usage.cascade(orders, lines, "o_orderkey", gone)
    count = lambda df, name: df.agg(F.count("*").alias("n")).select(F.lit(name).alias("tbl"), "n")
    return count(kept, "orders").unionByName(count(lines_kept, "lineitem"))


@query("unique_check", "SELECT s_suppkey, EXISTS (SELECT 1 FROM customer WHERE c_custkey = s_suppkey AND c_nationkey = s_nationkey) AS taken FROM supplier")
def _(spark, sf):
    taken = table(spark, sf, "customer").select(F.col("c_custkey").alias("s_suppkey"), F.col("c_nationkey").alias("s_nationkey"), F.lit(True).alias("taken")).distinct()
    return table(spark, sf, "supplier").join(taken, ["s_suppkey", "s_nationkey"], "left").select("s_suppkey", F.coalesce("taken", F.lit(False)).alias("taken"))


@query("validate_users", "SELECT c_custkey, length(c_name) BETWEEN 4 AND 32 AND regexp_matches(lower(c_name) || '@mail.org', '^[^@]+@[^@]+\\.[a-z]+$') AND c_acctbal BETWEEN -500 AND 9000 AS valid FROM customer")
def _(spark, sf):
    mail = F.concat(F.lower("c_name"), F.lit("@mail.org")).rlike(r"^[^@]+@[^@]+\.[a-z]+$")
    return table(spark, sf, "customer").select("c_custkey", (F.length("c_name").between(4, 32) & mail & F.col("c_acctbal").between(-500, 9000)).alias("valid"))


@query("overage_bill", Q[:-1] + f", {_PLANS_SQL}, u AS (SELECT phone_id, count(*) AS n, CASE phone_id % 4 WHEN 0 THEN 'freemium' WHEN 1 THEN 'basic' WHEN 2 THEN 'intermediate' ELSE 'premium' END AS plan FROM q GROUP BY phone_id) SELECT phone_id, greatest(n - queries, 0)::BIGINT AS extra, round(greatest(n - queries, 0) * price, 6) AS total FROM u JOIN plans USING (plan)")
def _(spark, sf):
    used = searches(spark, sf).groupBy("phone_id").agg(F.count("*").alias("n")).withColumn("plan", F.expr(_PLAN_OF.replace("c_custkey", "phone_id")))
    extra = F.greatest(F.col("n") - F.col("queries"), F.lit(0)).cast("long")
    return used.join(_plans(spark), "plan").select("phone_id", extra.alias("extra"), r6(extra * F.col("price")).alias("total"))


@query("alloc_ids", "SELECT page_id, (SELECT max(vec_id) FROM embeddings) + row_number() OVER (ORDER BY page_id) AS id FROM pages")
def _(spark, sf):
    return usage.next_ids(table(spark, sf, "embeddings"), table(spark, sf, "pages").select("page_id"), "vec_id", "page_id").select("page_id", "id")
