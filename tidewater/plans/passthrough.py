"""Registered queries: what expressions and clauses pass through to Spark SQL, stored tables that change, and rooms."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.functions import scalars
from tidewater.operators import documents, joins, kv, mutate
from tidewater.plans.registry import query
from tidewater.plans.relational import database
from tidewater.runtime import shared_dir
from tidewater.sources.tables import rewrite
from tidewater.streaming import state


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


@query("sel_cube", "SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS q FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
def cube(spark, d):
    return database(spark, d).select("lineitem").column("l_returnflag", "l_linestatus").column_expr("count(*) AS n").column_expr("round(sum(l_quantity), 2) AS q").group("CUBE (l_returnflag, l_linestatus)").df()


@query("sel_grouping_sets", "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY GROUPING SETS ((o_orderstatus), (o_orderpriority), ())")
def grouping_sets(spark, d):
    return database(spark, d).select("orders").column("o_orderstatus", "o_orderpriority").column_expr("count(*) AS n").group("GROUPING SETS ((o_orderstatus), (o_orderpriority), ())").df()


@query("sel_window_rank", """
SELECT p_partkey, CAST(dense_rank() OVER (PARTITION BY p_brand ORDER BY p_size) AS BIGINT) AS dr, CAST(ntile(4) OVER (PARTITION BY p_brand ORDER BY p_retailprice, p_partkey) AS BIGINT) AS nt,
round(percent_rank() OVER (PARTITION BY p_brand ORDER BY p_size), 6) AS pr, round(cume_dist() OVER (PARTITION BY p_brand ORDER BY p_size), 6) AS cd FROM part""")
def window_rank(spark, d):
    q = database(spark, d).select("part").column("p_partkey")
    q.column_expr("CAST(dense_rank() OVER (PARTITION BY p_brand ORDER BY p_size) AS BIGINT) AS dr").column_expr("CAST(ntile(?) OVER (PARTITION BY p_brand ORDER BY p_retailprice, p_partkey) AS BIGINT) AS nt", 4)
    return q.column_expr("round(percent_rank() OVER (PARTITION BY p_brand ORDER BY p_size), 6) AS pr").column_expr("round(cume_dist() OVER (PARTITION BY p_brand ORDER BY p_size), 6) AS cd").df()


@query("sel_window_frames", """
SELECT event_id, lead(event_id) OVER w AS nxt, first_value(event_id) OVER w AS fst, nth_value(event_id, 2) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS snd,
count(*) OVER (PARTITION BY user_id ORDER BY event_id RANGE BETWEEN 500 PRECEDING AND CURRENT ROW) AS near FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)""")
def window_frames(spark, d):
    w = "OVER (PARTITION BY user_id ORDER BY event_id"
    q = database(spark, d).select("events").column("event_id").column_expr(f"lead(event_id) {w}) AS nxt").column_expr(f"first_value(event_id) {w}) AS fst")
    return q.column_expr(f"nth_value(event_id, 2) {w} ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS snd").column_expr(f"count(*) {w} RANGE BETWEEN 500 PRECEDING AND CURRENT ROW) AS near").df()


@query("sel_exists_in", "SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_nationkey = 2) AND EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity > 40)")
def exists_in(spark, d):
    return database(spark, d).sql("SELECT o_orderkey FROM {orders} WHERE o_custkey IN (SELECT c_custkey FROM {customer} WHERE c_nationkey = ?) AND EXISTS (SELECT 1 FROM {lineitem} WHERE l_orderkey = o_orderkey AND l_quantity > ?)", 2, 40)


@query("sel_cte", "WITH t AS (SELECT o_custkey, sum(o_totalprice) AS s FROM orders GROUP BY o_custkey) SELECT o_custkey, round(s, 2) AS s FROM t WHERE s > (SELECT avg(s) * 1.5 FROM t)")
def cte(spark, d):
    return database(spark, d).sql("WITH t AS (SELECT o_custkey, sum(o_totalprice) AS s FROM {orders} GROUP BY o_custkey) SELECT o_custkey, round(s, 2) AS s FROM t WHERE s > (SELECT avg(s) * ? FROM t)", 1.5)


@query("sel_join_range", "SELECT e.event_id, count(f.event_id) AS n FROM events e LEFT JOIN events f ON f.user_id = e.user_id AND f.ts > e.ts AND f.ts <= e.ts + INTERVAL 1 HOUR GROUP BY e.event_id")
def join_range(spark, d):
    """Events of the same user within the hour after each: a range join within a key, as a count over a frame."""
    e = _t(spark, d, "events").withColumn("at", F.unix_micros(F.col("ts").cast("timestamp")))
    return database(spark, d).select(frame=e, alias="e").column("event_id").column_expr("count(*) OVER (PARTITION BY user_id ORDER BY at RANGE BETWEEN 1 FOLLOWING AND 3600000000 FOLLOWING) AS n").df()


@query("join_interval", """
WITH w AS (SELECT o_custkey, arg_max(o_orderdate, (o_totalprice, o_orderkey)) AS t FROM orders GROUP BY o_custkey)
SELECT o_custkey, count(*) AS n, CAST(sum(l_linenumber) AS BIGINT) AS s FROM w JOIN lineitem ON l_shipdate >= t AND l_shipdate <= t + INTERVAL 1 DAY GROUP BY o_custkey""")
def join_interval(spark, d):
    """What was shipped within a day of each customer's dearest order: a join on dates alone."""
    best = F.max_by("o_orderdate", F.struct("o_totalprice", "o_orderkey"))
    windows = _t(spark, d, "orders").groupBy("o_custkey").agg(best.alias("t")).withColumn("until", F.col("t") + F.expr("interval 1 day"))
    items = _t(spark, d, "lineitem").select("l_shipdate", "l_linenumber")
    day = ("l_shipdate", "l_shipdate")
    met = joins.interval(windows, joins.per_span(items, day, s="l_linenumber"), ("t", "until"), day)
    return met.groupBy("l.o_custkey").agg(F.sum("r.n").alias("n"), F.sum("r.s").alias("s"))


@query("join_interval_key", """
WITH s AS (SELECT user_id, ts AS a, ts + to_seconds(CAST(round(value * value) AS BIGINT) * 20) AS z, event_id FROM events WHERE event_type = 'view')
SELECT s.event_id, count(*) AS n FROM s JOIN events e ON e.user_id = s.user_id AND e.ts >= s.a AND e.ts <= s.z AND e.event_id <> s.event_id GROUP BY s.event_id""")
def join_interval_key(spark, d):
    """Events of the same user within views of very different lengths: bins by key and length, so that a user with most events is many keys."""
    e = _t(spark, d, "events")
    views = e.where("event_type = 'view'").select("user_id", F.col("ts").alias("a"), F.expr("ts + make_interval(0, 0, 0, 0, 0, 0, cast(round(value * value) as bigint) * 20)").alias("z"), "event_id")
    met = joins.interval(views, e.select("user_id", "ts", "event_id"), ("a", "z"), ("ts", "ts"), ("user_id",), F.col("l.event_id") != F.col("r.event_id"))
    return met.groupBy("l.event_id").agg(F.count(F.lit(1)).alias("n"))


@query("fn_regexp", "SELECT p_partkey, regexp_extract(p_brand, '#(\\d)', 1) AS first, regexp_replace(p_type, '[AEIOU]', '', 'g') AS rest, p_type LIKE '%STEEL%' AS steel, p_type ILIKE 'promo%' AS promo FROM part")
def fn_regexp(spark, d):
    p = _t(spark, d, "part")
    return p.select("p_partkey", F.regexp_extract("p_brand", r"#(\d)", 1).alias("first"), F.regexp_replace("p_type", "[AEIOU]", "").alias("rest"), F.col("p_type").like("%STEEL%").alias("steel"), F.col("p_type").ilike("promo%").alias("promo"))


@query("fn_date_arithmetic", "SELECT o_orderkey, o_orderdate + INTERVAL 30 DAY AS later, date_diff('day', o_orderdate, TIMESTAMP '2000-01-01') AS days, CAST(strftime(o_orderdate, '%Y-%m') AS VARCHAR) AS ym FROM orders")
def fn_dates(spark, d):
    o = _t(spark, d, "orders")
    return o.select("o_orderkey", (F.col("o_orderdate") + F.expr("interval 30 days")).alias("later"), F.datediff(F.lit("2000-01-01").cast("date"), "o_orderdate").cast("long").alias("days"), F.date_format("o_orderdate", "yyyy-MM").alias("ym"))


@query("fn_map", "SELECT user_id, count(DISTINCT event_type) AS kinds, count(*) FILTER (event_type = 'view') AS views FROM events GROUP BY user_id")
def fn_map(spark, d):
    per = _t(spark, d, "events").groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"))
    m = per.groupBy("user_id").agg(F.map_from_entries(F.collect_list(F.struct("event_type", "n"))).alias("m"))
    return m.select("user_id", F.size(F.map_keys("m")).cast("long").alias("kinds"), F.coalesce(F.try_element_at("m", F.lit("view")), F.lit(0)).alias("views"))


@query("fn_higher_order", "SELECT conv_id, count(*) AS turns, CAST(sum(length(text)) AS BIGINT) AS chars, max(length(text)) AS longest FROM conversations GROUP BY conv_id")
def fn_higher_order(spark, d):
    g = _t(spark, d, "conversations").groupBy("conv_id").agg(F.collect_list(F.length("text").cast("long")).alias("a"))
    return g.select("conv_id", F.size("a").cast("long").alias("turns"), F.aggregate("a", F.lit(0).cast("long"), lambda t, x: t + x).alias("chars"), F.array_max("a").alias("longest"))


@query("fn_try_cast", "SELECT c_custkey, TRY_CAST(substring(c_name, 10, 3) AS BIGINT) AS n FROM customer")
def fn_try_cast(spark, d):
    return _t(spark, d, "customer").select("c_custkey", scalars.to_long(F.substring("c_name", 10, 3)).alias("n"))


@query("doc_unwind_group", "SELECT event_type AS _id, list_aggregate(list_sort(list(DISTINCT user_id % 10)), 'string_agg', ',') AS digits FROM events GROUP BY event_type")
def unwind_group(spark, d):
    rows = _t(spark, d, "events").withColumn("digit", (F.col("user_id") % 10).cast("string"))
    return documents.pipeline(rows, [{"$group": {"_id": "$event_type", "d": {"$addToSet": "$digit"}}}]).select("_id", F.array_join("d", ",").alias("digits"))


@query("kv_expire", "SELECT count(*) AS n FROM events WHERE user_id <> 1")
def kv_expire(spark, d):
    store = _t(spark, d, "events").select(F.concat_ws(":", "user_id", "event_id").alias("k"), F.col("props").alias("v"), F.lit(None).cast("timestamp").alias("expires_at"))
    keys = store.where("k like '1:%'").select("k")
    past = F.lit("2000-01-01 00:00:00").cast("timestamp")
    return kv.live(kv.expire(store, keys, past), F.lit("2024-01-01 00:00:00").cast("timestamp")).agg(F.count(F.lit(1)).alias("n"))


@query("mut_transaction", "SELECT (SELECT count(*) FROM supplier WHERE NOT s_acctbal < 0) AS suppliers, (SELECT count(*) FROM nation) + 1 AS nations")
def transaction(spark, d):
    """Two tables changed together: the names stand for both new tables, or for neither."""
    db = database(spark, d)
    suppliers, _ = mutate.delete(db.raw_rows("supplier"), "s_acctbal < 0")
    nation = db.raw_rows("nation").select(F.col("n_nationkey").cast("int").alias("n_nationkey"), "n_name")
    nations, _ = mutate.insert(nation, spark.createDataFrame([(99, "NOWHERE")], "n_nationkey int, n_name string"))
    db.together(supplier=suppliers, nation=nations)
    a, b = (db.raw_rows(t).agg(F.count(F.lit(1)).alias(n)) for t, n in (("supplier", "suppliers"), ("nation", "nations")))
    return a.crossJoin(F.broadcast(b))  # one row each


@query("mut_rewrite", "SELECT c_custkey, c_nationkey, CASE WHEN c_nationkey IN (5, 7) AND c_acctbal > 0 THEN c_acctbal * 2 ELSE c_acctbal END AS c_acctbal FROM customer WHERE c_nationkey <> 3")
def rewrite_partitions(spark, d):
    """A stored table's update and deletion touch the partitions alone that hold such rows; one of them ends empty."""
    path = f"{shared_dir(spark)}/customer"
    rows = _t(spark, d, "customer").select("c_custkey", "c_nationkey", "c_acctbal")
    rows.repartition("c_nationkey").write.partitionBy("c_nationkey").parquet(path)
    rewrite(spark, path, "c_nationkey", "c_nationkey IN (5, 7) AND c_acctbal > 0", mutate.update, {"c_acctbal": "c_acctbal * 2"})
    rewrite(spark, path, "c_nationkey", "c_nationkey = 3", mutate.delete)
    return spark.read.parquet(path).select("c_custkey", F.col("c_nationkey").cast(rows.schema["c_nationkey"].dataType).alias("c_nationkey"), "c_acctbal")


@query("st_rooms", "SELECT o_custkey AS room, o_orderkey AS node, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) <= 3 AS admitted FROM orders")
def rooms(spark, d):
    """Nobody leaves: each room takes the first three that come."""
    moves = _t(spark, d, "orders").select(F.col("o_custkey").alias("room"), F.col("o_orderkey").alias("node"), F.lit(False).alias("leave"), F.col("o_orderkey").alias("seq"))
    return state.admissions(moves, 3).select("room", "node", "admitted")
