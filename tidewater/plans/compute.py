"""Registered queries: documents, search, streams, replicated state, key-value and migrations."""

from __future__ import annotations

import datetime
from functools import reduce

from pyspark.errors import StreamingQueryException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewater.database import Database
from tidewater.operators import crdt, documents, hooks, kv, migrate, mutate, search
from tidewater.plans.registry import query
from tidewater.plans.relational import database
from tidewater.runtime import shared_dir
from tidewater.sources import broker, store
from tidewater.sources.tables import stream
from tidewater.streaming import state, transforms


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _store(spark: SparkSession, d: str) -> DataFrame:
    """Events as entries; every third expires at its own time plus a day."""
    e = _t(spark, d, "events")
    ends = F.when(F.col("event_id") % 3 == 0, (F.col("ts") + F.expr("interval 1 day")).cast("timestamp"))
    return e.select(F.concat_ws(":", F.col("user_id"), F.col("event_id")).alias("k"), F.col("props").alias("v"), ends.alias("expires_at"))


_NOW = "2024-01-15 00:00:00"
_KV = "(SELECT user_id || ':' || event_id AS k, props AS v, CASE WHEN event_id % 3 = 0 THEN ts + INTERVAL 1 DAY END AS e FROM events)"
_LIVE = f"(SELECT k, v, e FROM {_KV} WHERE e IS NULL OR e > TIMESTAMP '{_NOW}')"


def _now():
    return F.lit(_NOW).cast("timestamp")


@query("doc_match_group_sort", "SELECT o_custkey AS _id, count(*) AS n, round(sum(o_totalprice), 2) AS total, max(o_totalprice) AS top FROM orders WHERE o_orderstatus = 'F' AND o_totalprice >= 1000 GROUP BY o_custkey ORDER BY total DESC, _id LIMIT 15")
def match_group(spark, d):
    stages = [
        {"$match": {"o_orderstatus": "F", "o_totalprice": {"$gte": 1000}}},
        {"$group": {"_id": "$o_custkey", "n": {"$count": {}}, "t": {"$sum": "$o_totalprice"}, "top": {"$max": "$o_totalprice"}}},
        {"$sort": {"t": -1, "_id": 1}},
        {"$limit": 15},
    ]
    return documents.pipeline(_t(spark, d, "orders"), stages).select("_id", "n", F.round("t", 2).alias("total"), "top")


@query("doc_filter_operators", "SELECT o_orderkey FROM orders WHERE (o_orderstatus IN ('F', 'O') OR o_totalprice < 5000) AND NOT (o_orderpriority = '1-URGENT') AND o_orderpriority NOT IN ('5-LOW') AND regexp_matches(o_orderpriority, '^[2-4]')")
def doc_filter(spark, d):
    spec = {"$or": [{"o_orderstatus": {"$in": ["F", "O"]}}, {"o_totalprice": {"$lt": 5000}}], "o_orderpriority": {"$not": {"$eq": "1-URGENT"}, "$nin": ["5-LOW"], "$regex": "^[2-4]"}}
    return _t(spark, d, "orders").where(documents.match(spec)).select("o_orderkey")


@query("doc_project_unwind", "SELECT c_custkey, o_orderkey FROM customer JOIN orders ON c_custkey = o_custkey WHERE c_nationkey = 4")
def project_unwind(spark, d):
    stages = [{"$match": {"c_nationkey": 4}}, {"$lookup": {"from": "orders", "localField": "c_custkey", "foreignField": "o_custkey", "as": "orders"}}, {"$unwind": "$orders"}, {"$project": {"c_custkey": 1, "o_orderkey": "$orders.o_orderkey"}}]
    return documents.pipeline(_t(spark, d, "customer"), stages, {"orders": _t(spark, d, "orders")})


@query("doc_add_fields", "SELECT l_orderkey, l_linenumber, round(l_extendedprice * (1 - l_discount), 4) AS net FROM lineitem WHERE l_quantity > 45")
def add_fields(spark, d):
    stages = [{"$match": {"l_quantity": {"$gt": 45}}}, {"$addFields": {"net": {"$multiply": ["$l_extendedprice", {"$subtract": [1, "$l_discount"]}]}}}, {"$project": {"l_orderkey": 1, "l_linenumber": 1, "net": 1}}]
    return documents.pipeline(_t(spark, d, "lineitem"), stages).withColumn("net", F.round("net", 4))


@query("doc_count", "SELECT count(*) AS n FROM events WHERE event_type = 'error'")
def doc_count(spark, d):
    return documents.pipeline(_t(spark, d, "events"), [{"$match": {"event_type": "error"}}, {"$count": "n"}])


@query("doc_update_many", "SELECT s_suppkey, CASE WHEN s_nationkey = 3 THEN s_acctbal + 10 ELSE s_acctbal END AS s_acctbal, CASE WHEN s_nationkey = 3 THEN 'x' ELSE s_name END AS s_name FROM supplier")
def update_many(spark, d):
    return documents.update(_t(spark, d, "supplier"), {"s_nationkey": 3}, {"$inc": {"s_acctbal": 10}, "$set": {"s_name": "x"}}, many=True).select("s_suppkey", "s_acctbal", "s_name")


@query("doc_update_first", "SELECT s_suppkey, CASE WHEN s_suppkey = (SELECT min(s_suppkey) FROM supplier WHERE s_acctbal > 0) THEN 'x' ELSE s_name END AS s_name FROM supplier")
def update_first(spark, d):
    return documents.update(_t(spark, d, "supplier"), {"s_acctbal": {"$gt": 0}}, {"$set": {"s_name": "x"}}, order=["s_suppkey"]).select("s_suppkey", "s_name")


@query("doc_delete_first", "SELECT s_suppkey FROM supplier WHERE s_suppkey <> (SELECT min(s_suppkey) FROM supplier WHERE s_acctbal > 0)")
def delete_first(spark, d):
    return documents.delete(_t(spark, d, "supplier"), {"s_acctbal": {"$gt": 0}}, order=["s_suppkey"]).select("s_suppkey")


@query("es_bool_msm", """
SELECT p_partkey FROM part WHERE p_size > 5 AND NOT p_brand = 'Brand#11'
AND (CASE WHEN p_retailprice < 1200 THEN 1 ELSE 0 END) + (CASE WHEN p_size BETWEEN 10 AND 30 THEN 1 ELSE 0 END) + (CASE WHEN p_type LIKE 'S%' THEN 1 ELSE 0 END) >= 2""")
def bool_msm(spark, d):
    s = search.Search(_t(spark, d, "part")).bool(
        filter=[{"range": {"p_size": {"gt": 5}}}],
        must_not=[{"term": {"p_brand": "Brand#11"}}],
        should=[{"range": {"p_retailprice": {"lt": 1200}}}, {"range": {"p_size": {"gte": 10, "lte": 30}}}, {"prefix": {"p_type": "S"}}],
        minimum_should_match=2,
    )
    return s.hits().select("p_partkey")


_TOKENS = r"list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}_]+'), lambda w: w <> '')"


@query("es_match", f"SELECT doc_id, CAST(len(list_intersect({_TOKENS}, ['the', 'of', 'der'])) AS DOUBLE) AS score FROM documents WHERE len(list_intersect({_TOKENS}, ['the', 'of', 'der'])) >= 1")
def es_match(spark, d):
    return search.Search(_t(spark, d, "documents")).match("text", "The of DER").hits().select("doc_id", F.col("_score").alias("score"))


@query("es_match_phrase", f"SELECT doc_id FROM documents WHERE contains(' ' || array_to_string({_TOKENS}, ' ') || ' ', ' of the ')")
def es_phrase(spark, d):
    return search.Search(_t(spark, d, "documents")).match_phrase("text", "of the").hits().select("doc_id")


@query("es_sort_page", "SELECT event_id, value FROM events WHERE event_type IN ('view', 'click') ORDER BY value DESC, event_id LIMIT 12 OFFSET 6")
def es_page(spark, d):
    return search.Search(_t(spark, d, "events")).terms("event_type", "view", "click").sort("value", "desc").sort("event_id").page(6, 12).source("event_id", "value").df()


@query("es_count", "SELECT count(*) AS n FROM events WHERE event_type = 'purchase' AND value >= 10")
def es_count(spark, d):
    return search.Search(_t(spark, d, "events")).term("event_type", "purchase").range("value", gte=10).count()


@query("es_highlight", "SELECT p_partkey, regexp_replace(p_type, '\\b(STANDARD|PROMO)\\b', '<em>\\1</em>', 'gi') AS p_type_highlight FROM part")
def es_highlight(spark, d):
    return search.Search(_t(spark, d, "part")).highlight("p_type", "standard promo").page(0, -1).source("p_partkey").df()


@query("es_terms", "SELECT event_type AS key, count(*) AS doc_count, round(avg(value), 4) AS mean FROM events GROUP BY event_type ORDER BY doc_count DESC, key LIMIT 10")
def es_terms(spark, d):
    return search.terms(_t(spark, d, "events"), "event_type", sub={"mean": {"avg": {"field": "value"}}}).withColumn("mean", F.round("mean", 4))


@query("es_date_histogram", """
WITH k AS (SELECT date_trunc('hour', ts) AS h FROM events), b AS (SELECT h, count(*) AS n FROM k GROUP BY h)
SELECT s.h AS key, coalesce(b.n, 0) AS doc_count FROM (SELECT unnest(generate_series((SELECT min(h) FROM k), (SELECT max(h) FROM k), INTERVAL 1 HOUR)) AS h) s LEFT JOIN b ON b.h = s.h""")
def es_dates(spark, d):
    return search.date_histogram(_t(spark, d, "events"), "ts", "hour")


@query("es_cardinality", "SELECT count(DISTINCT user_id) AS users, round(sum(value), 2) AS total, max(value) AS top FROM events")
def es_cardinality(spark, d):
    got = search.metrics({"users": {"cardinality": {"field": "user_id", "exact": True}}, "total": {"sum": {"field": "value"}}, "top": {"max": {"field": "value"}}})
    return _t(spark, d, "events").agg(*got).withColumn("total", F.round("total", 2))


@query("es_subagg", "SELECT event_type, user_id, count(*) AS n FROM events GROUP BY event_type, user_id")
def es_subagg(spark, d):
    return _t(spark, d, "events").groupBy("event_type", "user_id").agg(*search.metrics({"n": {"value_count": {"field": "event_id"}}}))


@query("st_chunk", "SELECT chunk, count(*) AS n, CAST(sum(event_id) AS BIGINT) AS s FROM (SELECT event_id, (row_number() OVER (ORDER BY event_id) - 1) // 64 AS chunk FROM events) GROUP BY chunk")
def st_chunk(spark, d):
    return transforms.chunk(_t(spark, d, "events"), 64, "event_id").groupBy("chunk").agg(F.count(F.lit(1)).alias("n"), F.sum("event_id").alias("s"))


@query("st_chunk_wide", "SELECT doc_id, text, lang, source, n_chars, (row_number() OVER (ORDER BY doc_id) - 1) // 100 AS chunk FROM documents")
def st_chunk_wide(spark, d):
    """Chunks of whole rows, long texts among them."""
    return transforms.chunk(_t(spark, d, "documents").select("doc_id", "text", "lang", "source", "n_chars"), 100, "doc_id")


@query("st_map_filter_take", "SELECT event_id, value * 2 AS v FROM events WHERE event_type = 'click' ORDER BY event_id LIMIT 40")
def st_pipeline(spark, d):
    rows = transforms.filter_rows(_t(spark, d, "events"), "event_type = 'click'")
    return transforms.take(transforms.map_rows(rows, event_id="event_id", v="value * 2"), 40, "event_id")


@query("st_reduce", "SELECT user_id, round(sum(value), 2) AS total FROM events GROUP BY user_id")
def st_reduce(spark, d):
    return _t(spark, d, "events").groupBy("user_id").agg(F.round(F.sum("value"), 2).alias("total"))


@query("st_apply_changes", """
WITH e AS (SELECT user_id AS id, arg_max(event_type, event_id) AS op, arg_max(value, event_id) AS v FROM events GROUP BY user_id)
SELECT c_custkey AS id, c_acctbal AS v FROM customer WHERE c_custkey NOT IN (SELECT id FROM e) UNION ALL SELECT id, v FROM e WHERE op <> 'error'""")
def st_cdc(spark, d):
    table = _t(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("v"))
    op = F.when(F.col("event_type") == "error", "DELETE").otherwise("UPDATE")
    return transforms.apply_changes(table, _t(spark, d, "events").select(F.col("event_id").alias("seq"), op.alias("op"), F.col("user_id").alias("id"), F.col("value").alias("v")), "id")


@query("st_tumbling", "SELECT event_type, time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '1970-01-01') AS window_start, time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '1970-01-01') + INTERVAL 6 HOUR AS window_end, count(*) AS n FROM events GROUP BY 1, 2, 3")
def st_tumbling(spark, d):
    return transforms.tumbling(_t(spark, d, "events"), "ts", "6 hours", "event_type", aggs=[F.count(F.lit(1)).alias("n")])


@query("st_sessions", """
WITH m AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 2 HOUR THEN 0 ELSE 1 END AS new FROM events),
g AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM m)
SELECT user_id, min(ts) AS session_start, max(ts) + INTERVAL 2 HOUR AS session_end, count(*) AS n FROM g GROUP BY user_id, s""")
def st_sessions(spark, d):
    return transforms.sessions(_t(spark, d, "events"), "ts", "2 hours", "user_id", aggs=[F.count(F.lit(1)).alias("n")])


def _session_ops(spark: SparkSession, d: str) -> DataFrame:
    kind = F.col("event_type")
    op = F.when(kind == "signup", "create").when(kind == "purchase", "update").when(kind == "error", "delete").otherwise("touch")
    return _t(spark, d, "events").select(F.col("user_id").alias("id"), op.alias("op"), F.col("props").alias("data"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("seq"))


_SESSIONS = """
WITH o AS (SELECT user_id AS id, CASE event_type WHEN 'signup' THEN 'create' WHEN 'purchase' THEN 'update' WHEN 'error' THEN 'delete' ELSE 'touch' END AS op, props AS data, ts, event_id AS seq FROM events),
p AS (SELECT *, count(*) FILTER (op <> 'touch') OVER (PARTITION BY id ORDER BY ts, seq) AS part, lead(ts) OVER (PARTITION BY id ORDER BY ts, seq) AS next FROM o),
g AS (SELECT *, coalesce(ts - lag(ts) OVER q >= INTERVAL 6 HOUR, false) AS late, first_value(op) OVER q AS setter, first_value(data) OVER q AS held FROM p WINDOW q AS (PARTITION BY id, part ORDER BY ts, seq)),
l AS (SELECT *, setter IN ('create', 'update') AND NOT bool_or(late) OVER (PARTITION BY id, part ORDER BY ts, seq) AS live FROM g),
x AS (SELECT *, lag(live) OVER r AS was, lag(held) OVER r AS of, lag(ts) OVER r AS prev FROM l WINDOW r AS (PARTITION BY id ORDER BY ts, seq))
SELECT id, op AS event, held AS data, ts AS at FROM x WHERE live
UNION ALL SELECT id, 'delete', of, ts FROM x WHERE op = 'delete' AND was AND prev + INTERVAL 6 HOUR > ts
UNION ALL SELECT id, 'expire', held, ts + INTERVAL 6 HOUR FROM x WHERE live AND (next IS NULL OR ts + INTERVAL 6 HOUR <= next)"""


@query("st_session_store", _SESSIONS)
def session_store(spark, d):
    """A session store from events: created, updated, touched, deleted, and ended where they are not renewed within six hours."""
    return state.session_events(_session_ops(spark, d), 6 * 3600).withColumn("at", F.col("at").cast("timestamp_ntz"))


@query("st_session_stream", _SESSIONS)
def session_stream(spark, d):
    """The same as a stream of files in the order of time, with state and timers; two operations of no one, long after, let all sessions end."""
    path, ops = shared_dir(spark), _session_ops(spark, d)
    last = ops.agg(F.max("ts")).first()[0]
    cuts = [last - datetime.timedelta(days=x) for x in (20, 10)]
    for low, high in zip([None, *cuts], [*cuts, None], strict=True):
        part = ops.where(F.col("ts") > low) if low else ops
        (part.where(F.col("ts") <= high) if high else part).coalesce(1).write.mode("append").parquet(f"{path}/in")
    for days in (40, 41):
        spark.createDataFrame([(-1, "delete", None, last + datetime.timedelta(days=days), -1)], ops.schema).coalesce(1).write.mode("append").parquet(f"{path}/in")
    made = state.session_stream(stream(spark, f"{path}/in", ops.schema, 1), 6 * 3600)
    state.fold_batches(made, f"{path}/out", lambda b: b, f"{path}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{path}/out").select("id", "event", "data", F.col("at").cast("timestamp_ntz").alias("at"))


def _topic(spark: SparkSession, d: str, path: str) -> None:
    """Events as messages in three publications; every fiftieth is cut off."""
    e = _t(spark, d, "events").withColumn("value", F.to_json(F.struct("event_id", "user_id", "event_type", "value")))
    e = e.withColumn("value", F.when(F.col("event_id") % 50 == 7, F.substring("value", 1, 12)).otherwise(F.col("value")))
    for k in range(3):
        broker.publish(path, e.where(F.col("event_id") % 3 == k), "user_id", "value", 4, ("event_id",))


@query("broker_once", """
SELECT event_id, user_id, value, NULL AS bad, 1 AS times FROM events WHERE event_id % 50 <> 7
UNION ALL SELECT NULL, NULL, NULL, bad, CAST(count(*) AS INT) FROM (SELECT left('{"event_id":' || event_id, 12) AS bad FROM events WHERE event_id % 50 = 7) GROUP BY bad""")
def broker_once(spark, d):
    """A topic read by a sink that fails between writing and committing its second batch, and is started again: each message once, cut ones apart."""
    path = shared_dir(spark)
    _topic(spark, d, f"{path}/topic")
    failed = []

    def fail(n: int) -> None:
        if n == 1 and not failed:
            failed.append(n)
            raise RuntimeError("the sink fails once")

    for _ in range(2):
        messages = broker.subscribe(spark, f"{path}/topic", "event_id long, user_id long, event_type string, value double", files_per_trigger=2)
        running = broker.deliver(messages, f"{path}/sink", f"{path}/checkpoint", fail)
        try:
            running.awaitTermination()
        except StreamingQueryException:
            if not failed:
                raise
    good = broker.delivered(spark, f"{path}/sink").groupBy("data.event_id", "data.user_id", "data.value").agg(F.count(F.lit(1)).cast("int").alias("times"))
    bad = broker.delivered(spark, f"{path}/sink", ok=False).groupBy("bad").agg(F.count(F.lit(1)).cast("int").alias("times"))
    return good.unionByName(bad, allowMissingColumns=True).select("event_id", "user_id", "value", "bad", "times")


@query("broker_offsets", """SELECT CAST(user_id AS VARCHAR) AS key, left('{"event_id":' || event_id, 12) AS text, row_number() OVER (PARTITION BY user_id ORDER BY event_id % 3, event_id) AS place FROM events""")
def broker_offsets(spark, d):
    """A key's messages in the order of their offsets: publications one after another, each in its own order."""
    path = shared_dir(spark)
    _topic(spark, d, path)
    rows = broker.messages(spark.read.schema(broker.MESSAGE).parquet(f"{path}/data/*"), "event_id long")
    text = F.coalesce("bad", F.concat(F.lit('{"event_id":'), F.col("data.event_id").cast("string")))
    place = F.row_number().over(Window.partitionBy("key").orderBy("offset"))
    return rows.select("key", F.substring(text, 1, 12).alias("text"), place.cast("long").alias("place"))


@query("mut_stored_transaction", """
SELECT 'customer' AS tbl, c_custkey AS id, c_acctbal + CASE WHEN c_mktsegment = 'BUILDING' THEN 10 ELSE 0 END AS amount FROM customer
UNION ALL SELECT 'orders', o_orderkey, CASE WHEN o_orderstatus = 'P' THEN 0 ELSE o_totalprice END FROM orders WHERE NOT (o_orderstatus = 'F' AND o_totalprice < 100000)""")
def stored_transaction(spark, d):
    """Two stored tables that change together, by partitions, after a transaction that failed between them and left both as they were."""
    s = store.Store(spark, shared_dir(spark))
    with s.transaction() as t:
        t.put("customer", _t(spark, d, "customer"), "c_mktsegment")
        t.put("orders", _t(spark, d, "orders"), "o_orderstatus")
    try:
        with s.transaction() as t:
            t.change("customer", mutate.update, {"c_acctbal": "0"}, where="c_acctbal < 0")
            raise RuntimeError("fails between the tables")
    except RuntimeError:
        pass
    with s.transaction() as t:
        t.change("customer", mutate.update, {"c_acctbal": "c_acctbal + 10"}, where="c_mktsegment = 'BUILDING'")
        t.change("orders", mutate.delete, where="o_orderstatus = 'F' AND o_totalprice < 100000")
        t.change("orders", mutate.update, {"o_totalprice": "0"}, where="o_orderstatus = 'P'")
    c, o = s.read("customer"), s.read("orders")
    return c.select(F.lit("customer").alias("tbl"), F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("amount")).unionByName(o.select(F.lit("orders").alias("tbl"), F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("amount")))


@query("st_chunk_key", "SELECT event_id, user_id, (row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1) // 10 AS chunk FROM events")
def st_chunk_key(spark, d):
    """Chunks of each user's events."""
    return transforms.chunk(_t(spark, d, "events"), 10, "event_id", by="user_id").select("event_id", "user_id", "chunk")


@query("es_scroll", "SELECT CAST((row_number() OVER (ORDER BY value DESC, event_id) - 1) // (SELECT count(*) // 3 + 1 FROM events) AS INT) AS page, event_id, value FROM events")
def es_scroll(spark, d):
    """All events by value, in three pages of one snapshot."""
    hits = search.Search(_t(spark, d, "events")).hits().select("event_id", "value")
    size = hits.count() // 3 + 1
    pages = [p.select(F.lit(k).alias("page"), "event_id", "value") for k, p in enumerate(transforms.scroll(hits, size, F.desc("value"), "event_id"))]
    return reduce(DataFrame.unionByName, pages)


@query("doc_validate", """
SELECT o_orderkey, list_filter([CASE WHEN o_orderstatus NOT IN ('F', 'O') THEN 'o_orderstatus: enum' END, CASE WHEN o_totalprice < 1000 THEN 'o_totalprice: minimum' END, CASE WHEN o_totalprice > 300000 THEN 'o_totalprice: maximum' END,
CASE WHEN NOT regexp_matches(o_orderpriority, '^[1-4]') THEN 'o_orderpriority: pattern' END, 'clerk: required'], lambda x: x IS NOT NULL) AS violations FROM orders""")
def doc_validate(spark, d):
    """Which rules of a validator each order breaks; none of them has a clerk."""
    rules = {"required": ["o_orderkey", "clerk"], "properties": {"o_orderstatus": {"bsonType": "string", "enum": ["F", "O"]}, "o_totalprice": {"bsonType": ["double", "int"], "minimum": 1000, "maximum": 300_000}, "o_orderpriority": {"pattern": "^[1-4]"}, "none": {"bsonType": "int"}}}
    bad = documents.validated(_t(spark, d, "orders"), rules)[1]
    # DuckDB keeps the order of the list above: required fields come last there.
    return bad.select("o_orderkey", F.concat(F.filter("violations", lambda v: ~v.endswith("required")), F.filter("violations", lambda v: v.endswith("required"))).alias("violations"))


@query("crdt_shadow_since", "SELECT event_id AS c, event_type = 'error' AS tombstone FROM events WHERE ts >= TIMESTAMP '2024-01-20'")
def crdt_shadow(spark, d):
    """Changes from a time on of a stored shadow table, two appends of which are in one log."""
    path, log = f"{shared_dir(spark)}/shadow", _log(spark, d)
    for k in range(2):
        crdt.shadow_write(log.where(F.col("hlc.c") % 2 == k), path)
    return crdt.shadow_read(spark, path, _micros(spark, "2024-01-20")).select(F.col("hlc.c").alias("c"), "tombstone")


@query("kv_batch", f"""
WITH s AS (SELECT k, v FROM {_LIVE}), o AS (SELECT CASE WHEN event_id % 5 = 0 THEN 'del' WHEN event_id % 2 = 0 THEN 'set' ELSE 'get' END AS op, user_id || ':' || (event_id // 2) AS k, 'v' || event_id AS v FROM events),
n AS (SELECT k, max(v) AS v FROM o WHERE op = 'set' GROUP BY k), a AS (SELECT k, v FROM n UNION ALL SELECT k, v FROM s WHERE k NOT IN (SELECT k FROM n))
SELECT 'store' AS part, k, v FROM a WHERE k NOT IN (SELECT k FROM o WHERE op = 'del') UNION ALL SELECT 'read', k, v FROM s WHERE k IN (SELECT k FROM o WHERE op = 'get')
UNION ALL SELECT 'written', CAST((SELECT count(*) FROM n) AS VARCHAR), NULL UNION ALL SELECT 'deleted', CAST((SELECT count(*) FROM a WHERE k IN (SELECT k FROM o WHERE op = 'del')) AS VARCHAR), NULL""")
def kv_batch(spark, d):
    """Reads, writes and deletions in one batch, and what it reports."""
    key = F.col("event_id")
    op = F.when(key % 5 == 0, "del").when(key % 2 == 0, "set").otherwise("get")
    ops = _t(spark, d, "events").select(op.alias("op"), F.concat_ws(":", "user_id", F.floor(key / 2).cast("long")).alias("k"), F.concat(F.lit("v"), key).alias("v"), F.lit(None).cast("timestamp").alias("expires_at"))
    after, values, counts = kv.batch(_store(spark, d), ops, _now())
    told = counts.select(F.explode(F.array(F.struct(F.lit("written").alias("part"), F.col("written").cast("string").alias("k")), F.struct(F.lit("deleted").alias("part"), F.col("deleted").cast("string").alias("k")))).alias("x")).select("x.part", "x.k", F.lit(None).cast("string").alias("v"))
    return after.select(F.lit("store").alias("part"), "k", "v").unionByName(values.select(F.lit("read").alias("part"), "k", "v")).unionByName(told)


class _Stamps:
    """Trims names that are written and marks what came."""

    def before_write(self, ctx, rows):
        return rows.withColumn("c_name", F.concat(F.lit(f"{ctx.operation}:"), F.substring("c_name", -3, 3)))


@query("hook_metrics", """
SELECT 'update' AS operation, 'customer' AS tbl, 1 AS calls, (SELECT count(*) FROM customer WHERE c_acctbal < 0) AS n UNION ALL SELECT 'upsert', 'customer', 1, (SELECT count(*) FROM supplier)
UNION ALL SELECT 'select', 'orders', 2, 2 * (SELECT count(*) FROM orders WHERE o_totalprice > 100000)""")
def hook_metrics(spark, d):
    """Operations and the rows they gave, observed on the plans that read them."""
    db, m = database(spark, d), hooks.Metrics()
    db.hooks.add(m)
    new = _t(spark, d, "supplier").select((F.col("s_suppkey") + 10_000_000).alias("c_custkey"), F.col("s_name").alias("c_name"), F.col("s_nationkey").alias("c_nationkey"), F.col("s_acctbal").alias("c_acctbal"), F.lit("NEW").alias("c_mktsegment"))
    for rows in (db.update("customer", {"c_acctbal": "0"}, "c_acctbal < 0"), db.upsert("customer", new), *[db.select("orders").where("o_totalprice > ?", 100_000).df() for _ in range(2)]):
        rows.write.format("noop").mode("overwrite").save()
    return spark.createDataFrame([(o, t, n, rows) for o, t, n, _, rows in m.snapshot() if rows], "operation string, tbl string, calls int, n long")


@query("hook_before_write", "SELECT s_suppkey AS c_custkey, 'upsert:' || right(s_name, 3) AS c_name FROM supplier")
def hook_before_write(spark, d):
    """Suppliers upserted as customers, through a hook that changes what is written."""
    db = database(spark, d)
    db.hooks.add(_Stamps(), tables=("customer",), operations=("upsert",))
    new = _t(spark, d, "supplier").select(F.col("s_suppkey").alias("c_custkey"), F.col("s_name").alias("c_name"), F.col("s_nationkey").alias("c_nationkey"), F.col("s_acctbal").alias("c_acctbal"), F.lit("NEW").alias("c_mktsegment"))
    return db.upsert("customer", new).select("c_custkey", "c_name")


@query("st_presence", "SELECT event_type AS topic, user_id AS node, arg_max(event_id, ts) AS data FROM events GROUP BY 1, 2 HAVING max(ts) + INTERVAL 1 DAY > TIMESTAMP '2024-01-30'")
def st_presence(spark, d):
    updates = _t(spark, d, "events").select(F.col("event_type").alias("topic"), F.col("user_id").alias("node"), F.col("event_id").alias("data"), F.lit(False).alias("leave"), "ts")
    return transforms.presence(updates, F.lit("2024-01-30 00:00:00").cast("timestamp_ntz"), 86_400)


@query("st_occupancy", "SELECT event_id, CAST(sum(CASE WHEN event_type = 'signup' THEN 1 ELSE -1 END) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS inside FROM events WHERE event_type IN ('signup', 'error')")
def st_occupancy(spark, d):
    moves = _t(spark, d, "events").where("event_type in ('signup', 'error')").withColumn("delta", F.when(F.col("event_type") == "signup", 1).otherwise(-1))
    return transforms.occupancy(moves, "user_id", "event_id").select("event_id", "inside")


def _log(spark: SparkSession, d: str) -> DataFrame:
    """Events as a change log: pk user, field event type, clock (time, event, node), errors as tombstones of the record."""
    clock = crdt.hlc(F.unix_micros(F.col("ts").cast("timestamp")), F.col("event_id"), F.concat(F.lit("n"), (F.col("event_id") % 3).cast("string")))
    dead = F.col("event_type") == "error"
    return _t(spark, d, "events").select(F.lit("t").alias("tbl"), F.col("user_id").alias("pk"), F.when(~dead, F.col("event_type")).alias("field"), clock.alias("hlc"), F.col("value").cast("string").alias("value"), dead.alias("tombstone"))


@query("crdt_lww", "SELECT user_id AS pk, event_type AS field, arg_max(event_id, (ts, event_id)) AS c FROM events WHERE event_type <> 'error' GROUP BY 1, 2")
def crdt_lww(spark, d):
    return crdt.latest(_log(spark, d).where("not tombstone")).select("pk", "field", F.col("hlc.c").alias("c"))


@query("crdt_counter", """
WITH d AS (SELECT user_id AS pk, event_type AS field, event_id % 3 AS node, sum(greatest(CAST(round(value) AS BIGINT) - 25, 0)) AS inc, sum(greatest(25 - CAST(round(value) AS BIGINT), 0)) AS dec FROM events GROUP BY 1, 2, 3)
SELECT pk, field, CAST(sum(inc) - sum(dec) AS BIGINT) AS value FROM d GROUP BY 1, 2""")
def crdt_counter(spark, d):
    deltas = _t(spark, d, "events").select(F.col("user_id").alias("pk"), F.col("event_type").alias("field"), (F.col("event_id") % 3).alias("node"), (F.round("value").cast("long") - 25).alias("delta"))
    facts = crdt.counter_facts(deltas)
    # Both replicas hold all facts, one of them twice: merging changes nothing.
    return crdt.counter(facts.unionByName(facts).unionByName(facts.where("node = 1")))


@query("crdt_orset", """
WITH tags AS (SELECT user_id AS pk, event_type AS field, CAST(event_id % 5 AS VARCHAR) AS elem, event_id FROM events WHERE event_type <> 'error'),
rm AS (SELECT user_id AS pk, CAST(event_id % 5 AS VARCHAR) AS elem, event_id FROM events WHERE event_type = 'error')
SELECT pk, field, string_agg(DISTINCT elem, ',' ORDER BY elem) AS elems FROM tags t WHERE NOT EXISTS (SELECT 1 FROM rm WHERE rm.pk = t.pk AND rm.elem = t.elem AND rm.event_id > t.event_id) GROUP BY 1, 2""")
def crdt_orset(spark, d):
    e = _t(spark, d, "events").select(F.col("user_id").alias("pk"), F.col("event_type").alias("field"), (F.col("event_id") % 5).cast("string").alias("elem"), F.lit("n").alias("node"), crdt.hlc(F.col("event_id"), F.lit(0), F.lit("n")).alias("hlc"))
    tags = e.where("field <> 'error'")
    fields = tags.select("pk", "field").distinct()
    ops = e.where("field = 'error'").drop("field").join(fields, "pk")
    live = crdt.set_elements(tags, crdt.set_remove(tags, ops))
    return live.groupBy("pk", "field").agg(F.array_join(F.sort_array(F.collect_set("elem")), ",").alias("elems"))


@query("crdt_tombstone", """
WITH w AS (SELECT user_id AS pk, event_type AS field, max((ts, event_id)) AS h FROM events WHERE event_type <> 'error' GROUP BY 1, 2),
x AS (SELECT user_id AS pk, max((ts, event_id)) AS h FROM events WHERE event_type = 'error' GROUP BY 1), l AS (SELECT pk, max(h) AS h FROM w GROUP BY 1)
SELECT w.pk, count(*) AS fields FROM w JOIN l ON l.pk = w.pk LEFT JOIN x ON x.pk = w.pk WHERE x.h IS NULL OR l.h > x.h GROUP BY w.pk""")
def crdt_tombstone(spark, d):
    return crdt.record_state(_log(spark, d)).groupBy("pk").agg(F.count(F.lit(1)).alias("fields"))


@query("crdt_time_travel", """
WITH e AS (SELECT * FROM events WHERE ts <= TIMESTAMP '2024-01-10'), w AS (SELECT user_id AS pk, event_type AS field, arg_max(value, (ts, event_id)) AS v, max((ts, event_id)) AS h FROM e WHERE event_type <> 'error' GROUP BY 1, 2),
x AS (SELECT user_id AS pk, max((ts, event_id)) AS h FROM e WHERE event_type = 'error' GROUP BY 1), l AS (SELECT pk, max(h) AS h FROM w GROUP BY 1)
SELECT w.pk, w.field, w.v AS value FROM w JOIN l ON l.pk = w.pk LEFT JOIN x ON x.pk = w.pk WHERE x.h IS NULL OR l.h > x.h""")
def crdt_time_travel(spark, d):
    at = F.struct(F.unix_micros(F.lit("2024-01-10 00:00:00").cast("timestamp")).alias("ts"), F.lit(2**62).alias("c"), F.lit("~").alias("node"))
    return crdt.record_state(_log(spark, d), at).withColumn("value", F.col("value").cast("double"))


@query("crdt_changes_since", "SELECT event_id AS c FROM events WHERE ts > TIMESTAMP '2024-01-20' ORDER BY ts, event_id LIMIT 50")
def crdt_changes(spark, d):
    since = F.struct(F.unix_micros(F.lit("2024-01-20 00:00:00").cast("timestamp")).alias("ts"), F.lit(2**62).alias("c"), F.lit("~").alias("node"))
    return crdt.changes_since(_log(spark, d), since, 50).select(F.col("hlc.c").alias("c"))


@query("crdt_history", "SELECT event_id AS c, value FROM events WHERE user_id = 2 AND event_type = 'view' ORDER BY ts DESC, event_id DESC LIMIT 20")
def crdt_history(spark, d):
    return crdt.field_history(_log(spark, d), 2, "view", 20).select(F.col("hlc.c").alias("c"), F.col("value").cast("double").alias("value"))


@query("crdt_rga_order", "SELECT conv_id AS pk, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS pos, turn FROM (SELECT DISTINCT conv_id, turn FROM conversations) c WHERE NOT EXISTS (SELECT 1 FROM generate_series(CAST(0 AS BIGINT), c.turn) g(i) WHERE g.i NOT IN (SELECT turn FROM conversations x WHERE x.conv_id = c.conv_id))")
def crdt_list(spark, d):
    """Turns as list nodes, each after the turn before it; turns that hang from no first turn are not reached."""
    c = _t(spark, d, "conversations").select(F.col("conv_id").alias("pk"), F.lit("turns").alias("field"), crdt.hlc(F.col("turn"), F.lit(0), F.lit("n")).alias("id"), F.when(F.col("turn") > 0, crdt.hlc(F.col("turn") - 1, F.lit(0), F.lit("n"))).alias("parent"), F.col("text").alias("value"), F.lit(False).alias("tombstone"))
    return crdt.list_order(c).select("pk", "pos", F.col("id.ts").alias("turn"))


_CHAIN = """SELECT DISTINCT conv_id AS pk, turn FROM conversations c WHERE NOT EXISTS (SELECT 1 FROM generate_series(CAST(0 AS BIGINT), c.turn) g(i) WHERE g.i NOT IN (SELECT turn FROM conversations x WHERE x.conv_id = c.conv_id))"""


@query("crdt_list_edit", f"""
WITH base AS ({_CHAIN}), edited AS (SELECT pk, turn, turn * 2.0 AS place FROM base WHERE turn NOT IN (1, 2) UNION ALL SELECT DISTINCT conv_id, 1000000, -1.0 FROM conversations
UNION ALL SELECT DISTINCT conv_id, 2000000, 0.5 FROM conversations WHERE turn = 2 AND conv_id IN (SELECT conv_id FROM conversations WHERE turn = 0))
SELECT pk, row_number() OVER (PARTITION BY pk ORDER BY place) AS pos, turn FROM edited""")
def crdt_list_edit(spark, d):
    """In each list: a new head, the second element deleted, and the third moved to right after the first."""
    at = lambda ts: crdt.hlc(F.lit(ts) if isinstance(ts, int) else ts, F.lit(0), F.lit("n"))
    c = _t(spark, d, "conversations").select(F.col("conv_id").alias("pk"), F.lit("turns").alias("field"), at(F.col("turn")).alias("id"), F.when(F.col("turn") > 0, at(F.col("turn") - 1)).alias("parent"), F.col("text").alias("value"), F.lit(False).alias("tombstone"))
    lists = c.select("pk", "field").distinct()
    head = crdt.list_insert(lists.select("pk", "field", F.lit(None).cast(c.schema["id"].dataType).alias("after"), at(1_000_000).alias("hlc"), F.lit("new").alias("value")))
    gone = crdt.list_delete(c, lists.withColumn("id", at(1)))
    moved = crdt.list_move(c, lists.withColumns({"id": at(2), "after": at(0), "hlc": at(2_000_000)}))
    nodes = c.unionByName(head).unionByName(gone).unionByName(moved)
    return crdt.list_order(nodes).select("pk", "pos", F.col("id.ts").alias("turn"))


@query("crdt_merge_fields", """
SELECT user_id AS pk, event_type AS field, 'lww' AS crdt_type, arg_max(props, event_id) AS value FROM events WHERE event_type = 'view' GROUP BY 1, 2
UNION ALL SELECT user_id, event_type, 'counter', CAST(CAST(sum(event_id % 7) - sum(event_id % 3) AS BIGINT) AS VARCHAR) FROM events WHERE event_type = 'purchase' GROUP BY 1, 2
UNION ALL SELECT DISTINCT user_id, event_type, 'set', CAST(event_id % 11 AS VARCHAR) FROM events WHERE event_type = 'click' AND event_id % 2 = 0""")
def crdt_merge_fields(spark, d):
    """Each field by the rules of its type; those under two types are left out."""
    e, kind = _t(spark, d, "events"), F.col("event_type")
    typed = F.when(kind == "view", "lww").when(kind == "purchase", "counter").when(kind == "click", "set").otherwise(F.when(F.col("event_id") % 2 == 0, "lww").otherwise("counter"))
    log = e.select(F.col("user_id").alias("pk"), kind.alias("field"), typed.alias("crdt_type"), crdt.hlc(F.col("event_id"), F.lit(0), F.lit("n")).alias("hlc"), F.col("event_id").cast("string").alias("node"), F.col("props").alias("value"), (F.col("event_id") % 7).alias("inc"), (F.col("event_id") % 3).alias("dec"), F.lit("add").alias("set_op"), (F.col("event_id") % 11).cast("string").alias("elem"))
    removed = log.where("crdt_type = 'set' AND hlc.ts % 2 = 1").withColumn("set_op", F.lit("remove"))
    merged, _ = crdt.merge_fields(log.unionByName(removed))
    return merged.where(F.col("field").isin("view", "purchase", "click"))


@query("crdt_field_conflicts", "SELECT user_id AS pk, event_type AS field FROM events GROUP BY 1, 2 HAVING min(event_id % 2) <> max(event_id % 2)")
def crdt_conflicts(spark, d):
    """Fields written under two types."""
    e = _t(spark, d, "events")
    log = e.select(F.col("user_id").alias("pk"), F.col("event_type").alias("field"), F.when(F.col("event_id") % 2 == 0, "lww").otherwise("counter").alias("crdt_type"), crdt.hlc(F.col("event_id"), F.lit(0), F.lit("n")).alias("hlc"), F.lit("n").alias("node"), F.col("props").alias("value"), F.lit(1).alias("inc"), F.lit(0).alias("dec"), F.lit("add").alias("set_op"), F.lit("e").alias("elem"))
    return crdt.merge_fields(log)[1]


class _NoPurchases:
    """Lets no purchase in, and nothing of odd records out."""

    def before_inbound(self, changes):
        return changes.where("field IS DISTINCT FROM 'purchase'")

    def before_outbound(self, changes):
        return changes.where("pk % 2 = 0")


@query("crdt_sync_hooks", """
SELECT 'local' AS side, count(*) AS n FROM events WHERE event_id % 2 = 0 OR event_type <> 'purchase'
UNION ALL SELECT 'remote', count(*) FROM events WHERE event_id % 2 = 1 OR user_id % 2 = 0""")
def crdt_sync_hooks(spark, d):
    """What each side holds after an exchange in which the local one's hooks refuse some changes either way."""
    log = _log(spark, d)
    sides = crdt.exchange(log.where("hlc.c % 2 = 0"), log.where("hlc.c % 2 = 1"), (_NoPurchases(),))
    counts = [x.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("side"), "n") for name, x in zip(("local", "remote"), sides, strict=True)]
    return counts[0].unionByName(counts[1])


_RECORDS = "SELECT user_id, max((ts, event_id)) FILTER (event_type = 'error') AS dead, max((ts, event_id)) FILTER (event_type <> 'error') AS live FROM events GROUP BY user_id"


@query("crdt_clean_tombstones", f"""
SELECT count(*) AS n FROM events JOIN ({_RECORDS}) USING (user_id)
WHERE NOT (event_type = 'error' AND ts < TIMESTAMP '2024-01-15') AND NOT (dead IS NOT NULL AND dead < (TIMESTAMP '2024-01-15', 0) AND NOT coalesce(live > dead, false))""")
def crdt_clean(spark, d):
    """The log without tombstones from before a time and without the records that they killed."""
    return crdt.clean_tombstones(_log(spark, d), _micros(spark, "2024-01-15")).agg(F.count(F.lit(1)).alias("n"))


def _micros(spark: SparkSession, at: str) -> int:
    return spark.sql(f"SELECT unix_micros(TIMESTAMP '{at} 00:00:00') AS t").first().t


def _short_records(spark: SparkSession, d: str) -> DataFrame:
    """The log with three events a record, so that many are dead."""
    return _log(spark, d).withColumn("pk", F.floor(F.col("hlc.c") / 3).cast("long"))


@query("crdt_clean_state", """
WITH e AS (SELECT *, event_id // 3 AS pk FROM events), r AS (SELECT pk, max((ts, event_id)) FILTER (event_type = 'error') AS dead, max((ts, event_id)) FILTER (event_type <> 'error') AS live FROM e GROUP BY pk)
SELECT pk, event_type AS field, arg_max(value, (ts, event_id)) AS value FROM e JOIN r USING (pk) WHERE event_type <> 'error' AND (dead IS NULL OR live > dead) GROUP BY pk, event_type""")
def crdt_clean_state(spark, d):
    """The state of a cleaned log, after it has met a replica that was not cleaned: no deleted record comes back."""
    log, horizon = _short_records(spark, d), _micros(spark, "2024-01-20")
    local, _ = crdt.exchange(crdt.clean_tombstones(log, horizon), log, horizon=horizon)
    return crdt.record_state(local).withColumn("value", F.col("value").cast("double"))


@query("crdt_sync_report", """
WITH l AS (SELECT user_id AS pk, event_type AS field, arg_max(CAST(value AS VARCHAR), (ts, event_id)) AS v, max((ts, event_id)) AS h FROM events WHERE event_id % 2 = 0 AND event_type <> 'error' GROUP BY 1, 2),
c AS (SELECT e.*, l.v, l.h FROM events e LEFT JOIN l ON l.pk = e.user_id AND l.field = e.event_type WHERE event_id % 2 = 1)
SELECT count(*) AS pulled, (SELECT count(*) FROM events WHERE event_id % 2 = 0) AS pushed, count(*) FILTER (event_type = 'error') AS tombstones,
count(*) FILTER (event_type <> 'error' AND h IS NOT NULL AND CAST(value AS VARCHAR) <> v) AS conflicts, count(*) FILTER (event_type <> 'error' AND (h IS NULL OR (ts, event_id) > h)) AS merged FROM c""")
def crdt_report(spark, d):
    """What an exchange moved, merged and found in conflict, counted while both logs are written."""
    log = _log(spark, d)
    _, _, report = crdt.reported(log.where("hlc.c % 2 = 0"), log.where("hlc.c % 2 = 1"))
    return spark.createDataFrame([{k: int(v) for k, v in report.items()}], "pulled long, pushed long, tombstones long, conflicts long, merged long")


@query("crdt_long_list", """
WITH o AS (SELECT o_orderkey, o_custkey % 7 AS up FROM orders) SELECT row_number() OVER (ORDER BY CASE WHEN o_orderkey < 7 THEN o_orderkey ELSE up END, o_orderkey >= 7, o_orderkey DESC) AS pos, o_orderkey FROM o WHERE o_orderkey < 7 OR o_orderkey % 5 <> 0""")
def crdt_long_list(spark, d):
    """All orders as one list, ordered by joins: seven heads, and after each of them, newest first, its share of the others, a fifth of which are deleted."""
    at = lambda c: crdt.hlc(c, F.lit(0), F.lit("n"))
    key, first = F.col("o_orderkey"), F.col("o_orderkey") < 7
    up = F.when(first, F.lit(None)).otherwise(F.col("o_custkey") % 7)
    nodes = _t(spark, d, "orders").select(F.lit(1).alias("pk"), F.lit("orders").alias("field"), at(F.when(first, -key).otherwise(key)).alias("id"), F.when(up.isNotNull(), at(-up)).alias("parent"), key.alias("value"), (~first & (key % 5 == 0)).alias("tombstone"))
    return crdt.list_order(nodes, walk=0).select("pos", F.col("value").alias("o_orderkey"))


@query("crdt_merge_types", """
SELECT user_id AS pk, event_type AS field, 'lww' AS crdt_type, CAST(NULL AS VARCHAR) AS place, arg_max(props, event_id) AS value FROM events WHERE event_type = 'view' GROUP BY 1, 2
UNION ALL SELECT user_id, event_type, 'list', CAST(row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS VARCHAR), props FROM events WHERE event_type = 'click' AND event_id % 3 <> 0
UNION ALL SELECT user_id, event_type, 'document', 'a.' || (event_id % 4), arg_max(props, event_id) FROM events WHERE event_type = 'purchase' GROUP BY user_id, event_type, event_id % 4
HAVING max(event_id) > (SELECT coalesce(max(event_id), -1) FROM events x WHERE x.user_id = events.user_id AND x.event_type = 'error')""")
def crdt_merge_types(spark, d):
    """Single values, lists and documents of one log; errors delete what is below a document's ``a``."""
    e, kind, key = _t(spark, d, "events"), F.col("event_type"), F.col("event_id")
    at = crdt.hlc(key, F.lit(0), F.lit("n"))
    dead = (kind == "error") | (kind == "click") & (key % 3 == 0)
    typed = F.when(kind == "view", "lww").when(kind == "click", "list").when(kind.isin("purchase", "error"), "document")
    path = F.when(kind == "error", "a").when(kind == "purchase", F.concat(F.lit("a."), (key % 4).cast("string")))
    none = lambda t: F.lit(None).cast(t)
    log = e.where(typed.isNotNull()).select(F.col("user_id").alias("pk"), F.when(kind == "error", "purchase").otherwise(kind).alias("field"), typed.alias("crdt_type"), at.alias("hlc"), F.col("props").alias("value"), dead.alias("tombstone"), none("struct<ts:bigint,c:bigint,node:string>").alias("parent"), path.alias("path"), none("string").alias("node"), none("long").alias("inc"), none("long").alias("dec"), none("string").alias("set_op"), none("string").alias("elem"))
    return crdt.merge_types(log)[0]


class _Guard:
    """Vetoes purchases below what is known, caps views, and writes nothing of user 3."""

    def __init__(self):
        self.merged = []

    def before_merge(self, met):
        kept = met.where("NOT coalesce(field = 'purchase' AND CAST(value AS DOUBLE) < CAST(old_value AS DOUBLE), false)")
        return kept.withColumn("value", F.when(F.col("field") == "view", F.least(F.col("value").cast("double"), F.lit(20.0)).cast("string")).otherwise(F.col("value")))

    def before_write(self, new):
        return new.where("pk <> 3")

    def after_merge(self, new):
        self.merged.append(new)


@query("crdt_plugin_merge", """
WITH s AS (SELECT user_id AS pk, event_type AS field, arg_max(value, event_id) AS v, max(event_id) AS h FROM events WHERE event_id % 2 = 0 GROUP BY 1, 2),
c AS (SELECT user_id AS pk, event_type AS field, CASE WHEN event_type = 'view' THEN least(value, 20.0) ELSE value END AS v, event_id AS h FROM events LEFT JOIN s ON s.pk = user_id AND s.field = event_type WHERE event_id % 2 = 1 AND NOT coalesce(event_type = 'purchase' AND value < s.v, false)),
n AS (SELECT pk, field, arg_max(v, h) AS v, max(h) AS h FROM c WHERE pk <> 3 GROUP BY 1, 2)
SELECT coalesce(s.pk, n.pk) AS pk, coalesce(s.field, n.field) AS field, CASE WHEN s.h IS NULL OR n.h > s.h THEN n.v ELSE s.v END AS value, CASE WHEN s.h IS NULL OR n.h > s.h THEN n.h IS NOT NULL ELSE false END AS came FROM s FULL JOIN n ON n.pk = s.pk AND n.field = s.field""")
def crdt_plugin_merge(spark, d):
    """A merge under a plugin that vetoes, replaces and sees what was written."""
    e = _t(spark, d, "events").select(F.lit("t").alias("tbl"), F.col("user_id").alias("pk"), F.col("event_type").alias("field"), crdt.hlc(F.col("event_id"), F.lit(0), F.lit("n")).alias("hlc"), F.col("value").cast("string").alias("value"))
    guard = _Guard()
    merged = crdt.merge_into(crdt.latest(e.where("hlc.ts % 2 = 0"), ("tbl", "pk", "field")), e.where("hlc.ts % 2 = 1"), (guard,))
    came = guard.merged[0].select("pk", "field", F.lit(True).alias("came"))
    return merged.join(came, ["pk", "field"], "left").select("pk", "field", F.col("value").cast("double").alias("value"), F.coalesce("came", F.lit(False)).alias("came"))


class _Skips:
    """Skips searches, and denies events without a user."""

    def on_stream_row(self, ctx):
        return "CASE WHEN user_id IS NULL THEN 'deny' WHEN event_type = 'search' OR value < 1 THEN 'skip' END"


@query("hook_stream_row", "SELECT event_id, CAST(floor(value) AS BIGINT) AS value FROM events WHERE event_type <> 'search' AND value >= 1 AND user_id % 2 = 1")
def hook_stream_row(spark, d):
    """A stream of new files under a filter, a mask, which the decision on rows sees, and that decision, which skips some."""
    path = shared_dir(spark)
    _t(spark, d, "events").select("event_id", "user_id", "event_type", "value").repartition(3).write.parquet(f"{path}/in")
    db = database(spark, d)
    db.hooks.add(hooks.RowFilter("user_id % 2 = 1"), tables=("events",))
    db.hooks.add(hooks.Mask({"value": "floor(value)"}), tables=("events",))
    db.hooks.add(_Skips(), operations=("stream",))
    rows = db.stream("events", stream(spark, f"{path}/in", "event_id long, user_id long, event_type string, value double", 1))
    state.fold_batches(rows, f"{path}/out", lambda b: b.select("event_id", F.col("value").cast("long").alias("value")), f"{path}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{path}/out").select("event_id", "value")


@query("crdt_document_json", """
SELECT user_id AS pk, CAST(json_object('last', json_object(event_type, CAST(max(event_id) AS VARCHAR))) AS VARCHAR) AS doc FROM events WHERE event_type = 'view' GROUP BY user_id, event_type""")
def crdt_json(spark, d):
    """Nested documents of paths."""
    e = _t(spark, d, "events").where("event_type = 'view'")
    facts = e.select(F.col("user_id").alias("pk"), F.lit("doc").alias("field"), F.concat(F.lit("last."), "event_type").alias("path"), crdt.hlc(F.col("event_id"), F.lit(0), F.lit("n")).alias("hlc"), F.col("event_id").cast("string").alias("value"), F.lit(False).alias("tombstone"))
    docs = crdt.document_json(crdt.document_fields(facts))
    return docs.select("pk", F.regexp_replace("doc", ": ", ":").alias("doc"))


@query("st_change_stream", "SELECT user_id, event_type, max(event_id) AS event_id, count(*) AS n FROM events GROUP BY user_id, event_type")
def st_change_stream(spark, d):
    """A stream of new files, folded batch by batch, and the folds folded once more."""
    path = shared_dir(spark)
    _t(spark, d, "events").select("event_id", "user_id", "event_type").repartition(3).write.parquet(f"{path}/in")
    changes = stream(spark, f"{path}/in", "event_id long, user_id long, event_type string", 1)
    fold = lambda b: b.groupBy("user_id", "event_type").agg(F.max("event_id").alias("event_id"), F.count(F.lit(1)).alias("n"))
    state.fold_batches(changes, f"{path}/out", fold, f"{path}/checkpoint").awaitTermination()
    parts = spark.read.parquet(f"{path}/out")
    return parts.groupBy("user_id", "event_type").agg(F.max("event_id").alias("event_id"), F.sum("n").cast("long").alias("n"))


@query("crdt_sync", "SELECT count(*) AS n, count(DISTINCT user_id) AS records FROM events")
def crdt_sync(spark, d):
    log = _log(spark, d)
    both = crdt.sync(log.where("hlc.c % 2 = 0"), log.where("hlc.c % 3 <> 1"), log.where("hlc.c % 2 = 1"))
    return both.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("pk").alias("records"))


@query("crdt_document", """
WITH w AS (SELECT user_id AS pk, event_type || '.' || (event_id % 2) AS path, event_type AS top, arg_max(event_id, event_id) AS v FROM events WHERE event_type <> 'error' GROUP BY 1, 2, 3),
x AS (SELECT user_id AS pk, max(event_id) AS h FROM events WHERE event_type = 'error' GROUP BY 1)
SELECT w.pk, w.path, CAST(w.v AS VARCHAR) AS value FROM w LEFT JOIN x ON x.pk = w.pk WHERE w.top <> 'view' OR x.h IS NULL OR w.v > x.h""")
def crdt_document(spark, d):
    """Two paths below each event type; errors delete the path ``view`` and all below it."""
    dead = F.col("event_type") == "error"
    path = F.when(dead, "view").otherwise(F.concat("event_type", F.lit("."), (F.col("event_id") % 2).cast("string")))
    facts = _t(spark, d, "events").select(F.col("user_id").alias("pk"), F.lit("doc").alias("field"), path.alias("path"), crdt.hlc(F.col("event_id"), F.lit(0), F.lit("n")).alias("hlc"), F.col("event_id").cast("string").alias("value"), dead.alias("tombstone"))
    return crdt.document_fields(facts).select("pk", "path", "value")


@query("crdt_capture", "SELECT c_custkey AS pk, CASE WHEN c_acctbal < 0 THEN NULL ELSE 'c_acctbal' END AS field, c_acctbal < 0 AS tombstone FROM customer WHERE c_acctbal < 0 OR c_nationkey = 6")
def crdt_capture(spark, d):
    before = _t(spark, d, "customer")
    after = before.where("c_acctbal >= 0").withColumn("c_acctbal", F.when(F.col("c_nationkey") == 6, F.col("c_acctbal") + 1).otherwise(F.col("c_acctbal")))
    return crdt.capture(before, after, "c_custkey", ["c_name", "c_acctbal"], crdt.hlc(F.lit(1), F.lit(0), F.lit("n")), "customer").select("pk", "field", "tombstone")


@query("kv_mget", f"SELECT k, v FROM {_LIVE} WHERE k IN ('1:1', '2:2', '3:3', 'none') OR k LIKE '%:9'")
def kv_mget(spark, d):
    store = _store(spark, d)
    keys = store.where(F.col("k").like("%:9")).select("k").unionAll(spark.createDataFrame([(k,) for k in ("1:1", "2:2", "3:3", "none")], "k string"))
    return kv.mget(store, keys, _now()).select("k", "v")


@query("kv_scan_prefix", f"SELECT k FROM {_LIVE} WHERE k LIKE '4:%'")
def kv_prefix(spark, d):
    return kv.prefix_scan(_store(spark, d), "4:", _now()).select("k")


@query("kv_scan_glob", f"SELECT k FROM {_LIVE} WHERE k LIKE '_:1%5'")
def kv_glob(spark, d):
    return kv.scan(_store(spark, d), "?:1*5", _now()).select("k")


@query("kv_range", f"SELECT k FROM {_LIVE} WHERE k >= '2:' AND k < '3:' ORDER BY k")
def kv_range(spark, d):
    return kv.range_scan(_store(spark, d), "2:", "3:", _now()).select("k")


for _mode in (None, "nx", "xx"):
    @query(f"kv_set{'_' + _mode if _mode else ''}", f"""
WITH s AS (SELECT k, v FROM {_LIVE}), n AS (SELECT '1:' || c_custkey AS k, c_name AS v FROM customer)
""" + {None: "SELECT k, v FROM n UNION ALL SELECT k, v FROM s WHERE k NOT IN (SELECT k FROM n)", "nx": "SELECT k, v FROM s UNION ALL SELECT k, v FROM n WHERE k NOT IN (SELECT k FROM s)", "xx": "SELECT k, v FROM n WHERE k IN (SELECT k FROM s) UNION ALL SELECT k, v FROM s WHERE k NOT IN (SELECT k FROM n)"}[_mode])
    def kv_set(spark, d, mode=_mode):
        new = _t(spark, d, "customer").select(F.concat(F.lit("1:"), F.col("c_custkey")).alias("k"), F.col("c_name").alias("v"), F.lit(None).cast("timestamp").alias("expires_at"))
        return kv.put(_store(spark, d), new, mode, _now()).select("k", "v")


@query("kv_ttl", f"SELECT k, CAST(epoch_us(e) - epoch_us(TIMESTAMP '{_NOW}') AS DOUBLE) / 1000000 AS seconds FROM {_LIVE}")
def kv_ttl(spark, d):
    return kv.ttl(_store(spark, d), _now()).withColumn("seconds", F.round("seconds", 6))


@query("kv_exists_delete", f"SELECT count(*) AS n FROM {_LIVE} WHERE k LIKE '%7' AND k <> '1:7'")
def kv_exists(spark, d):
    store = _store(spark, d)
    asked = store.where(F.col("k").like("%7")).select("k").unionAll(store.limit(0).select("k"))
    return kv.exists(kv.remove(store, ["1:7"]), asked, _now())


@query("kv_get", f"SELECT k, v FROM {_LIVE} WHERE k = '3:3' OR k = (SELECT min(k) FROM {_LIVE})")
def kv_get(spark, d):
    store = _store(spark, d)
    first = kv.live(store, _now()).agg(F.min("k")).first()[0]
    return kv.get(store, first, _now()).unionByName(kv.get(store, "3:3", _now())).select("k", "v").distinct()


@query("kv_compare_and_set", f"""
WITH s AS (SELECT k, v FROM {_LIVE}), n AS (SELECT user_id || ':' || event_id AS k, 'new' AS v, CASE WHEN event_id % 2 = 0 THEN props ELSE 'other' END AS expected FROM events UNION ALL SELECT 'fresh', 'new', NULL),
w AS (SELECT n.k, n.v FROM n LEFT JOIN s ON s.k = n.k WHERE n.expected IS NOT DISTINCT FROM s.v) SELECT k, v FROM w UNION ALL SELECT k, v FROM s WHERE k NOT IN (SELECT k FROM w)""")
def kv_cas(spark, d):
    """Entries whose value is as expected get a new one; one expected to be absent is made."""
    store = _store(spark, d)
    new = _t(spark, d, "events").select(F.concat_ws(":", "user_id", "event_id").alias("k"), F.lit("new").alias("v"), F.lit(None).cast("timestamp").alias("expires_at"), F.when(F.col("event_id") % 2 == 0, F.col("props")).otherwise("other").alias("expected"))
    fresh = spark.createDataFrame([("fresh", "new", None, None)], "k string, v string, expires_at timestamp, expected string")
    return kv.compare_and_set(store, new.unionByName(fresh), _now())[0].select("k", "v")


@query("kv_update_items", "SELECT c_custkey, CASE WHEN t IS NOT NULL AND c_acctbal >= 0 THEN c_acctbal + t ELSE c_acctbal END AS c_acctbal FROM customer LEFT JOIN (SELECT o_custkey, max(o_totalprice) AS t FROM orders GROUP BY o_custkey) ON o_custkey = c_custkey")
def kv_update_items(spark, d):
    """An update expression with a condition, for each item that a change names."""
    changes = _t(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("o_totalprice").alias("t"))
    return kv.update_items(_t(spark, d, "customer"), ["c_custkey"], changes, "item.c_acctbal >= 0", c_acctbal="item.c_acctbal + change.t").select("c_custkey", "c_acctbal")


@query("kv_query_page", "SELECT event_id, value FROM (SELECT * FROM events WHERE user_id = 5 AND event_id > 100 ORDER BY event_id LIMIT 30) WHERE value > 20")
def kv_page(spark, d):
    return kv.query(_t(spark, d, "events"), "user_id = 5", "event_id", 100, 30, True, "value > 20", ["event_id", "value"])


@query("plug_leaderboard_rank", "SELECT user_id AS member, round(sum(value), 2) AS score, rank() OVER (ORDER BY round(sum(value), 2) DESC) AS rank FROM events GROUP BY user_id")
def leaderboard(spark, d):
    return kv.leaderboard(_t(spark, d, "events").groupBy(F.col("user_id").alias("member")).agg(F.round(F.sum("value"), 2).alias("score")))


@query("plug_leaderboard_top", "SELECT user_id AS member, arg_max(value, event_id) AS score FROM events GROUP BY user_id ORDER BY score DESC, member LIMIT 5")
def leaderboard_top(spark, d):
    scores = _t(spark, d, "events").select(F.col("user_id").alias("member"), F.col("value").alias("score"), "event_id")
    return kv.top(kv.leaderboard(scores, "event_id"), 5).select("member", "score")


@query("plug_ratelimit", "SELECT user_id, date_trunc('hour', ts)::TIMESTAMP AS window_start, count(*) AS hits, least(count(*), 2) AS allowed FROM events GROUP BY 1, 2")
def ratelimit(spark, d):
    return kv.rate_limit(_t(spark, d, "events"), "user_id", "ts", 3600, 2)


@query("plug_ratelimit_sliding", "SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN 3599999999 PRECEDING AND CURRENT ROW) AS recent FROM events")
def ratelimit_sliding(spark, d):
    return kv.sliding_rate(_t(spark, d, "events"), "user_id", "ts", 3600, 2).select("event_id", "recent")


@query("plug_counter", "SELECT event_type, CAST(sum(CAST(round(value) AS BIGINT)) AS BIGINT) AS n FROM events GROUP BY event_type")
def plug_counter(spark, d):
    store = spark.createDataFrame([("view", "0", None)], "k string, v string, expires_at timestamp")
    deltas = _t(spark, d, "events").select(F.col("event_type").alias("k"), F.round("value").cast("long").alias("n"))
    return kv.increment(store, deltas, _now()).select(F.col("k").alias("event_type"), F.col("v").cast("long").alias("n"))


@query("plug_queue", "SELECT event_id AS id FROM events WHERE event_type = 'signup' AND event_id NOT IN (SELECT o_orderkey FROM orders WHERE o_totalprice > 50000) ORDER BY ts, event_id LIMIT 10")
def plug_queue(spark, d):
    jobs = _t(spark, d, "events").where("event_type = 'signup'").select(F.col("event_id").alias("id"), F.col("ts").alias("enqueued_at"))
    return kv.queue_next(jobs, _t(spark, d, "orders").where("o_totalprice > 50000").select(F.col("o_orderkey").alias("id")), 10).select("id")


def _migrated(spark: SparkSession, d: str) -> tuple[Database, migrate.Migrator]:
    """Customers after migrations that add columns to them, the last of which is undone."""

    def change(sql):
        def run(db):
            db.frames["customer"] = db.sql(sql)

        return run

    base = migrate.Group("base").register(
        migrate.Migration("002", change("SELECT c.*, coalesce(o.n, 0) AS n_orders FROM {customer} c LEFT JOIN (SELECT o_custkey, count(*) AS n FROM {orders} GROUP BY o_custkey) o ON c_custkey = o_custkey")),
        migrate.Migration("001", change("SELECT c_custkey, c_acctbal >= 0 AS solvent FROM {customer}"), change("SELECT c_custkey FROM {customer}")),
    )
    app = migrate.Group("app", ("base",)).register(migrate.Migration("001", change("SELECT *, solvent AND n_orders > 9 AS regular FROM {customer}"), change("SELECT * EXCEPT (regular) FROM {customer}")))
    db = database(spark, d)
    for t in ("customer", "orders"):
        db.frames[t] = db.raw_rows(t)
    m = migrate.Migrator(spark, [app, base])
    m.migrate(db)
    m.rollback(db)
    return db, m


@query("migrate_status", "SELECT * FROM (VALUES ('base', '001', true), ('base', '002', true), ('app', '001', false)) t(grp, version, applied)")
def migrate_status(spark, d):
    return _migrated(spark, d)[1].status()


@query("migrate_tables", "SELECT c_custkey, c_acctbal >= 0 AS solvent, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey) AS n_orders FROM customer")
def migrate_tables(spark, d):
    return _migrated(spark, d)[0].rows("customer")
