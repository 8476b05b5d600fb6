"""Registered queries: select builder, relations, functions, hooks and mutations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.database import Database
from tidewater.functions import scalars
from tidewater.operators import hooks, joins, mutate, relations
from tidewater.plans.registry import query
from tidewater.schema import Field, Relation, TableDef


def database(spark: SparkSession, d: str) -> Database:
    """The sample tables with their keys and relations."""
    db = Database(spark, d)
    db.register(TableDef("customer", (Field.parse("c_custkey", "int64", "pk"),), relations=(Relation("orders", "has_many", "orders", "c_custkey", "o_custkey"), Relation("first_order", "has_one", "orders", "c_custkey", "o_custkey"), Relation("nation", "belongs_to", "nation", "c_nationkey", "n_nationkey"))))
    db.register(TableDef("part", (Field.parse("p_partkey", "int64", "pk"),), relations=(Relation("suppliers", "many_to_many", "supplier", "p_partkey", "s_suppkey", "lineitem", "l_partkey", "l_suppkey"),)))
    db.register(TableDef("nation", (Field.parse("n_nationkey", "int32", "pk"),), relations=(Relation("customers", "has_many", "customer", "n_nationkey", "c_nationkey"),)))
    db.register(TableDef("orders", (Field.parse("o_orderkey", "int64", "pk"),), alias="o"))
    db.register(TableDef("lineitem", alias="l"))
    db.register(TableDef("events", (Field.parse("event_id", "int64", "pk"),), engine="replacing", sort_key=("user_id", "event_type"), version="ts"))
    return db


def users(db: Database) -> Database:
    """Customers with a simulated soft deletion: those in debt are deleted."""
    rows = db.raw_rows("customer").withColumn("deleted_at", F.when(F.col("c_acctbal") < 0, F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")))
    return db.register(TableDef("users", (Field.parse("c_custkey", "int64", "pk"), Field.parse("deleted_at", "time", "soft_delete"))), rows)


@query("rel_revenue_by_nation", """
SELECT n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, count(*) AS n_items
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
WHERE l_shipdate >= TIMESTAMP '1995-01-01' GROUP BY n_name HAVING count(*) > 5 ORDER BY revenue DESC, n_name LIMIT 10""")
def revenue_by_nation(spark: SparkSession, d: str) -> DataFrame:
    q = database(spark, d).select("lineitem").join("JOIN", "orders", "l.l_orderkey = o.o_orderkey").join("JOIN", "customer", "o.o_custkey = customer.c_custkey").join("JOIN", "nation", "customer.c_nationkey = nation.n_nationkey")
    q.column("n_name").column_expr("round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue").column_expr("count(*) AS n_items")
    return q.where("l_shipdate >= CAST(? AS TIMESTAMP_NTZ)", "1995-01-01").group("n_name").having("count(*) > ?", 5).order("revenue DESC", "n_name").limit(10).df()


@query("sel_where_or", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 100000 OR o_orderpriority = '1-URGENT' AND o_totalprice < 20000")
def where_or(spark, d):
    return database(spark, d).select("orders").column("o_orderkey", "o_totalprice").where("o_orderstatus = ?", "F").where("o_totalprice > ?", 100000).where_or("o_orderpriority = ?", "1-URGENT").where("o_totalprice < ?", 20000).df()


@query("sel_where_array", "SELECT o_orderkey FROM orders WHERE o_orderstatus IN ('F', 'P') AND o_orderpriority NOT IN ('1-URGENT', '2-HIGH')")
def where_array(spark, d):
    return database(spark, d).select("orders").column("o_orderkey").where_array("o_orderstatus", "= ANY", ["F", "P"]).where_array("o_orderpriority", "<> ALL", ["1-URGENT", "2-HIGH"]).df()


@query("sel_where_pk", "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey = 7")
def where_pk(spark, d):
    return database(spark, d).select("orders").column("o_orderkey", "o_custkey").where_pk(7).df()


@query("sel_soft_delete", "SELECT c_custkey FROM customer WHERE (c_nationkey = 1 OR c_mktsegment = 'BUILDING') AND NOT c_acctbal < 0")
def soft_delete(spark, d):
    return users(database(spark, d)).select("users").column("c_custkey").where("c_nationkey = ?", 1).where_or("c_mktsegment = ?", "BUILDING").df()


@query("sel_with_deleted", "SELECT count(*) AS n FROM customer")
def with_deleted(spark, d):
    return users(database(spark, d)).select("users").with_deleted().count()


for _kind, _sql in (("left", "LEFT JOIN"), ("right", "RIGHT JOIN"), ("full", "FULL JOIN"), ("inner", "JOIN")):
    @query(f"sel_join_{_kind}", f"SELECT c_custkey, o_orderkey FROM (SELECT * FROM customer WHERE c_nationkey < 12) c {_sql} (SELECT * FROM orders WHERE o_totalprice > 50000) o ON c_custkey = o_custkey")
    def join_kind(spark, d, kind=_sql):
        db = database(spark, d)
        return db.select(frame=db.rows("customer").where("c_nationkey < 12"), alias="c").join(kind, db.rows("orders").where("o_totalprice > 50000"), "c.c_custkey = o.o_custkey", alias="o").column("c_custkey", "o_orderkey").df()

for _kind, _sql, _where in (("semi", "LEFT SEMI JOIN", "EXISTS"), ("anti", "LEFT ANTI JOIN", "NOT EXISTS")):
    @query(f"sel_join_{_kind}", f"SELECT c_custkey, c_name FROM customer WHERE {_where} (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 150000)")
    def join_exists(spark, d, kind=_sql):
        return database(spark, d).select("customer").join(kind, "orders", "customer.c_custkey = o.o_custkey AND o.o_totalprice > ?", 150000).column("c_custkey", "c_name").df()


@query("sel_join_theta", "SELECT l_orderkey, l_linenumber FROM lineitem, orders WHERE l_orderkey = o_orderkey AND l_extendedprice * 3 > o_totalprice AND l_shipdate < o_orderdate")
def join_theta(spark, d):
    return database(spark, d).select("lineitem").join("JOIN", "orders", "l.l_orderkey = o.o_orderkey AND l_extendedprice * ? > o_totalprice AND l_shipdate < o_orderdate", 3).column("l_orderkey", "l_linenumber").df()


@query("sel_join_cross", "SELECT r_name, n_name FROM region CROSS JOIN nation")
def join_cross(spark, d):
    return database(spark, d).select("region").join("CROSS JOIN", "nation").column("r_name", "n_name").df()


@query("sel_join_asof", """
SELECT e.event_id, max(p.event_id) AS last_purchase FROM events e LEFT JOIN events p
ON p.user_id = e.user_id AND p.event_type = 'purchase' AND p.ts <= e.ts
AND NOT EXISTS (SELECT 1 FROM events q WHERE q.user_id = e.user_id AND q.event_type = 'purchase' AND q.ts <= e.ts AND (q.ts > p.ts OR q.ts = p.ts AND q.event_id > p.event_id))
WHERE e.event_type = 'error' GROUP BY e.event_id""")
def join_asof(spark, d):
    """The last purchase at or before each error."""
    e = database(spark, d).rows("events")
    bought = e.where("event_type = 'purchase'").withColumn("last_purchase", F.col("event_id"))
    return joins.asof(e.where("event_type = 'error'"), bought, ["user_id"], "ts", ["last_purchase"], tie="event_id").select("event_id", "last_purchase")


@query("sel_lateral_top1", "SELECT c_custkey, t.o_orderkey, t.o_totalprice FROM customer, LATERAL (SELECT o_orderkey, o_totalprice FROM orders WHERE o_custkey = c_custkey ORDER BY o_totalprice DESC, o_orderkey LIMIT 1) t")
def lateral(spark, d):
    db = database(spark, d)
    return db.select("customer").lateral("SELECT o_orderkey, o_totalprice FROM {orders} WHERE o_custkey = customer.c_custkey ORDER BY o_totalprice DESC, o_orderkey LIMIT 1", "t", orders=db.rows("orders")).column("c_custkey", "t.o_orderkey", "t.o_totalprice").df()


@query("sel_group_having", "SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS qty, round(avg(l_discount), 6) AS disc FROM lineitem GROUP BY l_returnflag, l_linestatus HAVING count(*) > 10 AND sum(l_quantity) > 100")
def group_having(spark, d):
    q = database(spark, d).select("lineitem").column("l_returnflag", "l_linestatus").column_expr("count(*) AS n").column_expr("round(sum(l_quantity), 2) AS qty").column_expr("round(avg(l_discount), 6) AS disc")
    return q.group("l_returnflag", "l_linestatus").having("count(*) > ?", 10).having("sum(l_quantity) > ?", 100).df()


@query("sel_rollup", "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)")
def rollup(spark, d):
    return database(spark, d).select("lineitem").column("l_returnflag", "l_linestatus").column_expr("count(*) AS n").group("ROLLUP (l_returnflag, l_linestatus)").df()


@query("sel_distinct_on", "SELECT DISTINCT ON (o_custkey) o_custkey, o_orderkey, o_orderdate FROM orders ORDER BY o_custkey, o_orderdate DESC, o_orderkey")
def distinct_on(spark, d):
    return database(spark, d).select("orders").column("o_custkey", "o_orderkey", "o_orderdate").distinct_on("o_custkey").order("o_custkey", "o_orderdate DESC", "o_orderkey").df()


@query("sel_limit_offset", "SELECT p_partkey, p_retailprice FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 20 OFFSET 15")
def limit_offset(spark, d):
    return database(spark, d).select("part").column("p_partkey", "p_retailprice").order("p_retailprice DESC", "p_partkey").limit(20).offset(15).df()


@query("sel_search_after", "SELECT o_totalprice, o_orderkey FROM orders WHERE (o_totalprice, o_orderkey) > (100000.0, 50) ORDER BY o_totalprice, o_orderkey LIMIT 25")
def search_after(spark, d):
    return database(spark, d).select("orders").column("o_totalprice", "o_orderkey").search_after(["o_totalprice", "o_orderkey"], [100000.0, 50]).order("o_totalprice", "o_orderkey").limit(25).df()


@query("sel_final_replacing", "SELECT user_id, event_type, event_id, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC) = 1")
def final_replacing(spark, d):
    return database(spark, d).select("events").final().column("user_id", "event_type", "event_id", "value").df()


@query("sel_final_prewhere", "SELECT user_id, event_type, event_id FROM (SELECT * FROM events WHERE value < 50 QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC) = 1) WHERE event_type <> 'view'")
def final_prewhere(spark, d):
    return database(spark, d).select("events").prewhere("value < ?", 50).final().where("event_type <> ?", "view").column("user_id", "event_type", "event_id").df()


@query("sel_final_summing", "SELECT l_partkey, round(sum(l_quantity), 2) AS l_quantity, round(sum(l_extendedprice), 2) AS l_extendedprice FROM lineitem GROUP BY l_partkey")
def final_summing(spark, d):
    db = database(spark, d)
    db.register(TableDef("totals", engine="summing", sort_key=("l_partkey",)), db.rows("lineitem").select("l_partkey", "l_quantity", "l_extendedprice"))
    return db.select("totals").final().column("l_partkey").column_expr("round(l_quantity, 2) AS l_quantity").column_expr("round(l_extendedprice, 2) AS l_extendedprice").df()


@query("sel_final_collapsing", "SELECT o_custkey, CAST(1 AS INT) AS sign FROM (SELECT o_custkey, sum(CASE WHEN o_orderstatus = 'F' THEN -1 ELSE 1 END) s FROM orders GROUP BY o_custkey) WHERE s > 0")
def final_collapsing(spark, d):
    db = database(spark, d)
    db.register(TableDef("signed", engine="collapsing", sort_key=("o_custkey",), version="sign"), db.rows("orders").select("o_custkey", F.when(F.col("o_orderstatus") == "F", -1).otherwise(1).alias("sign")))
    return db.select("signed").final().df()


@query("sel_count_group", "SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY o_orderstatus")
def count_group(spark, d):
    return database(spark, d).select("orders").group("o_orderstatus").count()


@query("sel_sample", None)
def sample(spark, d):
    return database(spark, d).select("orders").sample(0.1, "o_orderkey").column("o_orderkey").df()


for _name, _op in (("union", "UNION"), ("intersect", "INTERSECT"), ("except", "EXCEPT"), ("union_all", "UNION ALL"), ("except_all", "EXCEPT ALL"), ("intersect_all", "INTERSECT ALL")):
    @query(f"sel_{_name}", f"SELECT c_nationkey AS k FROM customer {_op} SELECT s_nationkey AS k FROM supplier")
    def set_op(spark, d, name=_name):
        db = database(spark, d)
        a, b = db.select("customer").column_expr("c_nationkey AS k"), db.select("supplier").column_expr("s_nationkey AS k")
        kind, _, rest = name.partition("_")
        return getattr(a, {"union": "union", "intersect": "intersect", "except": "except_"}[kind])(b, bool(rest)).df()


@query("sel_window", """
SELECT o_orderkey, row_number() OVER w AS rn, rank() OVER (PARTITION BY o_custkey ORDER BY o_orderstatus) AS rk, round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 2) AS s3, lag(o_orderkey) OVER w AS prev
FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)""")
def window(spark, d):
    w = "OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey"
    q = database(spark, d).select("orders").column("o_orderkey").column_expr(f"CAST(row_number() {w}) AS BIGINT) AS rn").column_expr("CAST(rank() OVER (PARTITION BY o_custkey ORDER BY o_orderstatus) AS BIGINT) AS rk")
    return q.column_expr(f"round(sum(o_totalprice) {w} ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 2) AS s3").column_expr(f"lag(o_orderkey) {w}) AS prev").df()


@query("sel_raw", "SELECT o_orderpriority, count(*) AS n FROM orders WHERE o_totalprice BETWEEN 1000 AND 90000 GROUP BY o_orderpriority")
def raw(spark, d):
    return database(spark, d).sql("SELECT o_orderpriority, count(*) AS n FROM {orders} WHERE o_totalprice BETWEEN ? AND ? GROUP BY o_orderpriority", 1000, 90000)


@query("sel_series", "SELECT CAST(i AS INT) AS i FROM range(1, 11) t(i)")
def series(spark, d):
    return database(spark, d).sql("SELECT i FROM (SELECT explode(sequence(1, ?)) AS i)", 10)


@query("rel_has_many", "SELECT n_nationkey, count(c_custkey) AS n, coalesce(string_agg(c_custkey, ',' ORDER BY c_custkey), '') AS keys FROM nation LEFT JOIN customer ON n_nationkey = c_nationkey GROUP BY n_nationkey")
def has_many(spark, d):
    df = database(spark, d).select("nation").relation("customers").df()
    return df.select("n_nationkey", F.size("customers").cast("long").alias("n"), F.array_join(F.transform("customers", lambda c: c.c_custkey.cast("string")), ",").alias("keys"))


@query("rel_has_one", "SELECT c_custkey, min(o_orderkey) AS o_orderkey FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey")
def has_one(spark, d):
    return database(spark, d).select("customer").relation("first_order").df().select("c_custkey", F.col("first_order.o_orderkey").alias("o_orderkey"))


@query("rel_belongs_to", "SELECT c_custkey, n_name FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey")
def belongs_to(spark, d):
    return database(spark, d).select("customer").relation("nation").df().select("c_custkey", "nation.n_name")


@query("rel_many_to_many", "SELECT p_partkey, count(DISTINCT l_suppkey) AS n, coalesce(round(sum(DISTINCT l_suppkey), 0), 0) AS s FROM part LEFT JOIN lineitem ON l_partkey = p_partkey GROUP BY p_partkey")
def many_to_many(spark, d):
    df = database(spark, d).select("part").relation("suppliers").df()
    return df.select("p_partkey", F.size("suppliers").cast("long").alias("n"), F.aggregate("suppliers", F.lit(0).cast("long"), lambda t, s: t + s.s_suppkey).cast("double").alias("s"))


@query("fn_text", "SELECT c_custkey, lower(c_name) AS low, upper(c_mktsegment) AS up, substring(c_name, 1, 4) AS part, length(c_name) AS len, replace(c_name, '#', '-') AS rep, concat(c_mktsegment, ':', c_custkey) AS k FROM customer")
def fn_text(spark, d):
    c = database(spark, d).rows("customer")
    return c.select("c_custkey", F.lower("c_name").alias("low"), F.upper("c_mktsegment").alias("up"), F.substring("c_name", 1, 4).alias("part"), F.length("c_name").cast("long").alias("len"), F.replace("c_name", F.lit("#"), F.lit("-")).alias("rep"), scalars.compose_key(":", F.col("c_mktsegment"), F.col("c_custkey")).alias("k"))


@query("fn_time", "SELECT o_orderkey, date_trunc('month', o_orderdate)::TIMESTAMP AS m, year(o_orderdate) AS y, quarter(o_orderdate) AS q, dayofyear(o_orderdate) AS doy FROM orders")
def fn_time(spark, d):
    o = database(spark, d).rows("orders")
    return o.select("o_orderkey", F.date_trunc("month", "o_orderdate").cast("timestamp_ntz").alias("m"), *[f("o_orderdate").cast("long").alias(n) for f, n in ((F.year, "y"), (F.quarter, "q"), (F.dayofyear, "doy"))])


@query("fn_math", "SELECT p_partkey, round(sqrt(p_retailprice), 6) AS r, floor(p_retailprice) AS f, ceil(p_retailprice) AS c, greatest(p_size, 10) AS g, p_size % 7 AS m, round(ln(p_retailprice), 6) AS l FROM part")
def fn_math(spark, d):
    p = database(spark, d).rows("part")
    return p.select("p_partkey", F.round(F.sqrt("p_retailprice"), 6).alias("r"), F.floor("p_retailprice").cast("double").alias("f"), F.ceil("p_retailprice").cast("double").alias("c"), F.greatest("p_size", F.lit(10)).alias("g"), (F.col("p_size") % 7).alias("m"), F.round(F.ln("p_retailprice"), 6).alias("l"))


@query("fn_json", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def fn_json(spark, d):
    return database(spark, d).rows("events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))


@query("fn_conditional", "SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 'debt' WHEN c_acctbal < 5000 THEN 'mid' ELSE 'high' END AS band, coalesce(nullif(c_mktsegment, 'BUILDING'), 'none') AS seg FROM customer")
def fn_conditional(spark, d):
    c = database(spark, d).rows("customer")
    return c.select("c_custkey", F.when(F.col("c_acctbal") < 0, "debt").when(F.col("c_acctbal") < 5000, "mid").otherwise("high").alias("band"), F.coalesce(F.nullif("c_mktsegment", F.lit("BUILDING")), F.lit("none")).alias("seg"))


@query("fn_array", "SELECT o_custkey, len(list(o_orderkey)) AS n, list_sort(list(o_orderkey))[1] AS first, len(list_distinct(list(o_orderstatus))) AS kinds FROM orders GROUP BY o_custkey")
def fn_array(spark, d):
    g = database(spark, d).rows("orders").groupBy("o_custkey").agg(F.sort_array(F.collect_list("o_orderkey")).alias("a"), F.collect_list("o_orderstatus").alias("s"))
    return g.select("o_custkey", F.size("a").cast("long").alias("n"), F.element_at("a", 1).alias("first"), F.size(F.array_distinct("s")).cast("long").alias("kinds"))


@query("fn_array_text", "SELECT p_partkey, '{\"' || p_brand || '\",\"' || p_type || '\"}' AS lit, p_type AS second FROM part")
def fn_array_text(spark, d):
    p = database(spark, d).rows("part").select("p_partkey", scalars.array_text(F.array("p_brand", "p_type")).alias("lit"))
    return p.select("p_partkey", "lit", F.get(scalars.array_of_text("lit"), 1).alias("second"))


@query("fn_hstore", "SELECT p_partkey, '\"brand\"=>\"' || p_brand || '\", \"size\"=>\"' || p_size || '\"' AS lit, CAST(p_size AS VARCHAR) AS size FROM part")
def fn_hstore(spark, d):
    p = database(spark, d).rows("part").select("p_partkey", scalars.map_text(F.create_map(F.lit("size"), F.col("p_size").cast("string"), F.lit("brand"), F.col("p_brand"))).alias("lit"))
    return p.select("p_partkey", "lit", scalars.map_of_text("lit")["size"].alias("size"))


@query("fn_crypto", "SELECT c_custkey, md5(c_name) AS m, sha256(c_name) AS s, c_name AS plain FROM customer")
def fn_crypto(spark, d):
    c = database(spark, d).rows("customer")
    key = F.lit("0123456789abcdef")
    return c.select("c_custkey", F.md5("c_name").alias("m"), F.sha2("c_name", 256).alias("s"), scalars.decrypt(scalars.encrypt(F.col("c_name"), key), key).cast("string").alias("plain"))


@query("fn_compress", "SELECT doc_id, text FROM documents")
def fn_compress(spark, d):
    rows = database(spark, d).rows("documents")
    return rows.select("doc_id", scalars.compress(F.col("text").cast("binary")).alias("z")).select("doc_id", scalars.decompress("z").cast("string").alias("text"))


@query("hook_rls", "SELECT o_orderkey FROM orders WHERE (o_orderstatus = 'F' OR o_totalprice > 100000) AND o_custkey % 4 = 1")
def rls(spark, d):
    db = database(spark, d)
    db.hooks.add(hooks.RowFilter("o_custkey % 4 = 1"), tables=("orders",))
    return db.select("orders").column("o_orderkey").where("o_orderstatus = ?", "F").where_or("o_totalprice > ?", 100000).df()


@query("hook_rls_count", "SELECT count(*) AS n FROM orders WHERE o_custkey % 4 = 1")
def rls_count(spark, d):
    db = database(spark, d)
    db.hooks.add(hooks.RowFilter("o_custkey % 4 = 1"), tables=("orders",))
    return db.select("orders").count()


@query("hook_mask", "SELECT c_custkey, substring(c_name, 1, 3) || '***' AS c_name FROM customer WHERE c_nationkey = 3")
def mask(spark, d):
    db = database(spark, d)
    db.hooks.add(hooks.Mask({"c_name": "concat(substring(c_name, 1, 3), '***')"}), tables=("customer",))
    return db.select("customer").column("c_custkey", "c_name").where("c_nationkey = ?", 3).df()


@query("hook_audit", "SELECT 'update' AS operation, 'supplier' AS \"table\", count(*) AS n FROM supplier WHERE s_acctbal < 0")
def audit(spark, d):
    db, log = database(spark, d), hooks.Audit()
    db.hooks.add(log)
    db.update("supplier", {"s_acctbal": "0.0"}, "s_acctbal < 0")
    return log.entries()


@query("hook_mask_alias", "SELECT substring(c_name, 1, 9) || '***' AS x, count(*) AS n FROM customer GROUP BY 1")
def mask_alias(spark, d):
    """A masked column stays masked under another name and as a group."""
    db = database(spark, d)
    db.hooks.add(hooks.Mask({"c_name": "concat(substring(c_name, 1, 9), '***')"}), tables=("customer",))
    return db.select("customer").column_expr("c_name AS x").column_expr("count(*) AS n").group("c_name").df()


@query("hook_mask_sql", "SELECT o_orderkey, substring(c_name, 1, 3) || '***' AS c_name FROM orders JOIN customer ON o_custkey = c_custkey")
def mask_sql(spark, d):
    db = database(spark, d)
    db.hooks.add(hooks.Mask({"c_name": "concat(substring(c_name, 1, 3), '***')"}), tables=("customer",))
    return db.sql("SELECT o_orderkey, c_name FROM {orders} JOIN {customer} ON o_custkey = c_custkey")


@query("mut_rls_update", "SELECT c_custkey, CASE WHEN c_nationkey % 4 = 1 AND c_acctbal < 1000 THEN 0.0 ELSE c_acctbal END AS c_acctbal FROM customer")
def rls_update(spark, d):
    """An update changes just the rows that row-level security lets its caller change."""
    db = database(spark, d)
    db.hooks.add(hooks.RowFilter("c_nationkey % 4 = 1"), tables=("customer",))
    db.update("customer", {"c_acctbal": "0.0"}, "c_acctbal < 1000")
    return db.raw_rows("customer").select("c_custkey", "c_acctbal")


@query("mut_rls_delete", "SELECT c_custkey FROM customer WHERE NOT (c_nationkey % 4 = 1 AND c_acctbal < 1000)")
def rls_delete(spark, d):
    db = database(spark, d)
    db.hooks.add(hooks.RowFilter("c_nationkey % 4 = 1"), tables=("customer",))
    db.delete("customer", "c_acctbal < 1000")
    return db.raw_rows("customer").select("c_custkey")


@query("mut_db_soft_delete", "SELECT count(*) AS n FROM customer WHERE c_acctbal >= 0 AND c_nationkey <> 2")
def db_soft_delete(spark, d):
    """A table's own flag makes its deletions soft, and queries don't see the rows."""
    db = users(database(spark, d))
    db.delete("users", "c_nationkey = 2", now=F.lit("2024-02-02 00:00:00").cast("timestamp_ntz"))
    return db.select("users").count()


@query("mut_upsert_duplicates", "SELECT o_custkey AS c_custkey, max(o_totalprice) AS c_acctbal FROM orders GROUP BY o_custkey UNION ALL SELECT c_custkey, c_acctbal FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def upsert_duplicates(spark, d):
    """Of many incoming rows of one key the largest counts."""
    db = database(spark, d)
    db.frames["customer"] = db.raw_rows("customer").select("c_custkey", "c_acctbal")
    db.upsert("customer", db.rows("orders").select(F.col("o_custkey").alias("c_custkey"), F.col("o_totalprice").alias("c_acctbal")))
    return db.raw_rows("customer")


@query("mut_insert_default", "SELECT s_suppkey, s_name, s_acctbal FROM supplier UNION ALL SELECT (SELECT max(s_suppkey) FROM supplier) + row_number() OVER (ORDER BY n_name), n_name, 5.0 FROM nation")
def insert_default(spark, d):
    """A table's definition numbers new rows and fills in what they lack."""
    db = database(spark, d)
    db.register(TableDef("supplier", (Field.parse("s_suppkey", "int64", "pk,autoincrement"), Field.parse("s_name", "string", "notnull"), Field.parse("s_acctbal", "float64", "default:5.0"))))
    db.frames["supplier"] = db.raw_rows("supplier").select("s_suppkey", "s_name", "s_acctbal")
    db.insert("supplier", db.rows("nation").select(F.col("n_name").alias("s_name")))
    return db.raw_rows("supplier")


@query("mut_insert", "SELECT s_suppkey, s_name FROM supplier UNION ALL SELECT (SELECT max(s_suppkey) FROM supplier) + row_number() OVER (ORDER BY n_name), n_name FROM nation WHERE n_regionkey = 1")
def insert(spark, d):
    db = database(spark, d)
    new = db.rows("nation").where("n_regionkey = 1").select(F.col("n_name").alias("s_name"))
    return mutate.insert(db.rows("supplier").select("s_suppkey", "s_name"), new, autoincrement="s_suppkey")[0]


@query("mut_update", "SELECT s_suppkey, CASE WHEN s_nationkey = 5 THEN s_acctbal * 2 ELSE s_acctbal END AS s_acctbal FROM supplier")
def update(spark, d):
    return mutate.update(database(spark, d).rows("supplier"), {"s_acctbal": "s_acctbal * 2"}, "s_nationkey = 5")[0].select("s_suppkey", "s_acctbal")


@query("mut_update_limit", "SELECT s_suppkey, CASE WHEN row_number() OVER (ORDER BY s_acctbal, s_suppkey) <= 3 THEN 0.0 ELSE s_acctbal END AS s_acctbal FROM supplier")
def update_limit(spark, d):
    return mutate.update(database(spark, d).rows("supplier"), {"s_acctbal": "0.0"}, None, [F.col("s_acctbal")], 3, ["s_suppkey"])[0].select("s_suppkey", "s_acctbal")


@query("mut_delete_returning", "SELECT c_custkey, c_acctbal FROM customer WHERE c_acctbal < 0")
def delete_returning(spark, d):
    return mutate.delete(database(spark, d).rows("customer"), "c_acctbal < 0")[1].select("c_custkey", "c_acctbal")


@query("mut_delete", "SELECT c_custkey FROM customer WHERE NOT c_acctbal < 0")
def delete(spark, d):
    return mutate.delete(database(spark, d).rows("customer"), "c_acctbal < 0")[0].select("c_custkey")


@query("mut_soft_delete", "SELECT c_custkey, c_acctbal < 0 OR c_nationkey = 2 AS deleted FROM customer")
def soft(spark, d):
    db = users(database(spark, d))
    out, _ = mutate.delete(db.raw_rows("users"), "c_nationkey = 2", soft="deleted_at", now=F.lit("2024-02-02 00:00:00").cast("timestamp_ntz"))
    return out.select("c_custkey", F.col("deleted_at").isNotNull().alias("deleted"))


@query("mut_upsert", """
SELECT coalesce(s.s_suppkey, c.c_custkey) AS s_suppkey, CASE WHEN s.s_suppkey IS NULL THEN c.c_acctbal WHEN c.c_custkey IS NOT NULL THEN s.s_acctbal + c.c_acctbal ELSE s.s_acctbal END AS s_acctbal
FROM supplier s FULL JOIN customer c ON s_suppkey = c_custkey""")
def upsert(spark, d):
    db = database(spark, d)
    new = db.rows("customer").select(F.col("c_custkey").alias("s_suppkey"), F.col("c_acctbal").alias("s_acctbal"))
    return mutate.upsert(db.rows("supplier").select("s_suppkey", "s_acctbal"), new, ["s_suppkey"], {"s_acctbal": "old.s_acctbal + new.s_acctbal"})[0]


@query("mut_insert_ignore", "SELECT s_suppkey, s_name FROM supplier UNION ALL SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT s_suppkey FROM supplier)")
def insert_ignore(spark, d):
    db = database(spark, d)
    new = db.rows("customer").select(F.col("c_custkey").alias("s_suppkey"), F.col("c_name").alias("s_name"))
    return mutate.upsert(db.rows("supplier").select("s_suppkey", "s_name"), new, ["s_suppkey"], nothing=True)[0]


@query("mut_bulk", """
WITH log AS (SELECT event_id AS seq, user_id AS id, CASE event_type WHEN 'view' THEN 'index' WHEN 'purchase' THEN 'create' WHEN 'click' THEN 'update' ELSE 'delete' END AS action, value FROM events),
last AS (SELECT id, arg_max(action, seq) AS action, arg_max(value, seq) AS value FROM log GROUP BY id), base AS (SELECT c_custkey AS id, c_acctbal AS value FROM customer)
SELECT coalesce(b.id, l.id) AS id, CASE WHEN l.action = 'index' OR (l.action = 'create' AND b.id IS NULL) OR (l.action = 'update' AND b.id IS NOT NULL) THEN l.value ELSE b.value END AS value
FROM base b FULL JOIN last l ON b.id = l.id WHERE coalesce(l.action <> 'delete', true) AND (b.id IS NOT NULL OR l.action IN ('index', 'create'))""")
def bulk(spark, d):
    db = database(spark, d)
    kind = F.when(F.col("event_type") == "view", "index").when(F.col("event_type") == "purchase", "create").when(F.col("event_type") == "click", "update").otherwise("delete")
    log = db.rows("events").select(F.col("event_id").alias("seq"), kind.alias("action"), F.col("user_id").alias("id"), "value")
    base = db.rows("customer").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("value"))
    return mutate.bulk(base, log, "id")[0]


@query("doc_relation_lookup", "SELECT c_custkey, count(o_orderkey) AS n, coalesce(sum(o_orderkey), 0) AS s FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey")
def lookup(spark, d):
    db = database(spark, d)
    df = relations.lookup(db.rows("customer"), db.rows("orders").select("o_custkey", "o_orderkey"), "c_custkey", "o_custkey", "orders")
    return df.select("c_custkey", F.size("orders").cast("long").alias("n"), F.aggregate("orders", F.lit(0).cast("long"), lambda t, o: t + o.o_orderkey).alias("s"))
