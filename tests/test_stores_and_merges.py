"""Row numbers, stored transactions, topics, sessions, interval joins and merges, odd cases included."""

from __future__ import annotations

import random
from datetime import UTC, datetime, timedelta

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tidewater.database import Database
from tidewater.operators import crdt, hooks, joins, mutate
from tidewater.runtime import shared_dir
from tidewater.schema import Field, TableDef
from tidewater.sources import broker, store
from tidewater.sources.tables import stream
from tidewater.streaming import state, transforms


# Row numbers.
def test_numbers_of_wide_rows_are_whole_under_adaptive_execution(spark):
    rows = spark.range(60_000).select((F.col("id") * 7919 % 60_000).alias("k"), F.expr("repeat(cast(id % 97 as string), 200)").alias("wide"))
    got = transforms.number(rows, "k")
    assert got.agg(F.count("*"), F.min(F.col("_n") - F.col("k")), F.max(F.col("_n") - F.col("k")), F.max(F.length("wide"))).first()[:] == (60_000, 1, 1, 400)
    # Used by pieces, each of which prunes other columns.
    assert got.select("wide").count() == got.where("_n > 0").count() == 60_000
    assert transforms.chunk(rows, 100, "k").groupBy("chunk").count().where("count <> 100").count() == 0
    assert transforms.number(rows.limit(0), "k").count() == 0


def test_numbers_of_ties_and_descending_order(spark):
    rows = spark.createDataFrame([(k % 3, k) for k in range(100)] + [(None, -1)] * 2, "a int, b int")
    got = transforms.number(rows, F.desc("a"), "b").orderBy("_n").collect()
    assert [r["_n"] for r in got] == list(range(1, 103)) and [(r.a, r.b) for r in got] == sorted(((k % 3, k) for k in range(100)), key=lambda x: (-x[0], x[1])) + [(None, -1)] * 2


def test_sums_before_each_row(spark):
    rows = [(k * 31 % 1000, k % 5 if k % 7 else None) for k in range(1000)]
    got = {r.k: r["_b"] for r in transforms.before(spark.createDataFrame(rows, "k int, v int"), "v", "k").collect()}
    total, want = 0, {}
    for k, v in sorted(rows, key=lambda x: x[0]):
        want[k], total = total, total + (v or 0)
    assert got == want


def test_insert_with_a_wide_default_and_numbers_loses_nothing(spark):
    table = spark.createDataFrame([(41, "x", "y")], "id long, name string, wide string")
    after, rows = mutate.insert(table, spark.range(30_000).select(F.col("id").cast("string").alias("name")), {"wide": "repeat('d', 256)"}, "id")
    assert rows.agg(F.min("id"), F.max("id"), F.count_distinct("id"), F.min(F.length("wide"))).first()[:] == (42, 30_041, 30_000, 256)
    assert after.count() == 30_001


# Mutations in a row.
def test_updates_in_a_row_read_one_level_deep(spark):
    db = Database(spark).register(TableDef("t", (Field.parse("id", "int64", "pk"), Field.parse("gone", "time", "soft_delete"))), spark.range(50).select("id", F.lit(0).alias("n"), F.lit(None).cast("timestamp").alias("gone")))
    for k in range(10):
        db.update("t", {"n": "n + 1"}, f"id >= {k}")
    plan = db.raw_rows("t")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("+ 1") == 1 and {r.id: r.n for r in db.raw_rows("t").collect()} == {i: min(i + 1, 10) for i in range(50)}
    affected = db.delete("t", "id < 3")
    assert {r.gone for r in affected.collect()} == {r.gone for r in db.raw_rows("t").where("gone IS NOT NULL").collect()}
    assert db.rows("t").count() == 47


# Stored transactions.
@pytest.fixture
def stored(spark):
    s = store.Store(spark, shared_dir(spark))
    with s.transaction() as t:
        t.put("a", spark.createDataFrame([(1, "x"), (2, "x"), (3, "y"), (4, None), (5, "")], "id int, p string"), "p")
        t.put("b", spark.createDataFrame([(7,)], "id int"))
    return s


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_a_failure_between_tables_leaves_both(stored, spark):
    before = rows(stored.read("a")), rows(stored.read("b"))
    with pytest.raises(ZeroDivisionError), stored.transaction() as t:
        t.change("a", mutate.update, {"id": "id + 100"}, where="p = 'x'")
        assert rows(t.read("a")) != before[0]
        t.put("b", spark.createDataFrame([(8,)], "id int"))
        raise ZeroDivisionError
    assert (rows(stored.read("a")), rows(stored.read("b"))) == before


def test_changes_rewrite_their_partitions_alone(stored):
    folders = {r["part"]: r["folder"] for r in stored.manifest() if r["table"] == "a"}
    assert set(folders) == {"x", "y", None, ""}
    with stored.transaction() as t:
        affected = t.change("a", mutate.delete, where="id = 3")
        assert rows(t.change("a", mutate.update, {"id": "40"}, where="p IS NULL")) == [(40, None)]
    now = {r["part"]: r["folder"] for r in stored.manifest() if r["table"] == "a"}
    assert rows(affected) == [(3, "y")] and set(now) == {"x", None, ""} and now["x"] == folders["x"] and now[None] != folders[None]
    assert rows(stored.read("a")) == [(1, "x"), (2, "x"), (40, None), (5, "")]
    assert rows(stored.read("a", version=0, parts=["y", None])) == [(3, "y"), (4, None)]  # what was read before is still there
    with pytest.raises(ValueError), stored.transaction() as t:
        t.change("a", mutate.update, {"p": "'z'"}, where="id = 1")


def test_emptied_dropped_and_unchanged_tables(stored):
    with stored.transaction() as t:
        t.change("a", mutate.delete, where="true")
        t.change("b", mutate.update, {"id": "0"}, where="false")
    assert stored.read("a").count() == 0 and stored.read("a").columns == ["id", "p"] and rows(stored.read("b")) == [(7,)]
    with stored.transaction() as t:
        t.drop("a")
    assert stored.versions() == [0, 1, 2] and stored.read("a", version=0).count() == 5
    with pytest.raises(KeyError):
        stored.read("a")


def test_of_two_writers_one_is_told(stored, spark):
    one, two = stored.transaction(), stored.transaction()
    for t, v in ((one, 1), (two, 2)):
        t.put("b", spark.createDataFrame([(v,)], "id int"))
    one.commit()
    with pytest.raises(store.Conflict):
        two.commit()
    assert rows(stored.read("b")) == [(1,)]


# Topics.
def test_offsets_follow_on_and_bad_messages_stand_apart(spark):
    path = shared_dir(spark)
    texts = ['{"a": 1}', '{"a": "x"}', "junk", None, '{"a": null}', '{"a": 2, "b": 3}']
    df = spark.createDataFrame([(k % 2, t, k) for k, t in enumerate(texts)], "k int, v string, at int")
    assert [broker.publish(f"{path}/t", df, "k", "v", 3, ("at",)) for _ in range(2)] == [0, 1]
    stored = spark.read.schema(broker.MESSAGE).parquet(f"{path}/t/data/*")
    by = {}
    for r in sorted(stored.collect(), key=lambda r: (r.partition, r.offset)):
        by.setdefault(r.partition, []).append((r.offset, r.value))
    assert all([o for o, _ in x] == list(range(len(x))) for x in by.values()) and sum(map(len, by.values())) == 12
    end = {r.partition: r.end for r in broker.ends(spark, f"{path}/t").collect()}
    assert end == {p: len(x) for p, x in by.items()}
    rest = {p: n // 2 for p, n in end.items()}
    broker.deliver(broker.subscribe(spark, f"{path}/t", "a int", rest), f"{path}/s", f"{path}/c").awaitTermination()
    good = sorted((r.data.a for r in broker.delivered(spark, f"{path}/s").collect()), key=str)
    bad = sorted(r.bad for r in broker.delivered(spark, f"{path}/s", ok=False).collect())
    assert good == [1, 2, None] and bad == ["", "junk", '{"a": "x"}']
    assert {r.lag for r in broker.lag(spark, f"{path}/t", f"{path}/s").collect()} == {0}
    broker.publish(f"{path}/t", df.limit(1), "k", "v", 3)
    assert sum(r.lag for r in broker.lag(spark, f"{path}/t", f"{path}/s").collect()) == 1
    broker.deliver(broker.subscribe(spark, f"{path}/t", "a int", rest), f"{path}/s", f"{path}/c").awaitTermination()
    assert broker.delivered(spark, f"{path}/s").count() == 4 and broker.ends(spark, f"{path}/none").count() == 0


# Sessions.
def test_session_streams_and_tables_agree_with_a_plain_store(spark):
    rng, t0 = random.Random(3), datetime(2024, 1, 1, tzinfo=UTC)
    ops, at = [], t0
    for k in range(400):
        at += timedelta(seconds=rng.choice([0, 1, 10, 30]), microseconds=rng.randint(1, 999))
        ops.append((rng.randint(0, 7), rng.choice(["create", "update", "touch", "touch", "touch", "delete"]), f"d{k}" if rng.random() < 0.9 else None, at, k))
    want, live = [], {}

    def expire(i, now):
        if i in live and live[i][1] <= now:
            data, ends = live.pop(i)
            want.append((i, "expire", data, ends))

    for i, op, data, at, _ in ops:
        expire(i, at)
        if op == "delete":
            if i in live:
                want.append((i, op, live.pop(i)[0], at))
        elif op != "touch" or i in live:
            live[i] = (live[i][0] if op == "touch" else data), at + timedelta(seconds=60)
            want.append((i, op, live[i][0], at))
    for i in list(live):
        expire(i, at + timedelta(days=1))
    df = spark.createDataFrame(ops, "id long, op string, data string, ts timestamp, seq int")
    show = lambda x: sorted(((r.id, r.event, r.data, r.at.replace(tzinfo=UTC)) for r in x.collect()), key=repr)
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert show(state.session_events(df, 60).withColumn("at", F.col("at").cast("timestamp_ntz"))) == sorted(want, key=repr)
    path = shared_dir(spark)
    for k in range(3):
        df.where(F.floor(F.col("seq") / 140) == k).coalesce(1).write.mode("append").parquet(f"{path}/in")
    for k in (2, 3):
        spark.createDataFrame([(-1, "delete", None, t0 + timedelta(days=k), 0)], df.schema).coalesce(1).write.mode("append").parquet(f"{path}/in")
    made = state.session_stream(stream(spark, f"{path}/in", df.schema, 1), 60)
    state.fold_batches(made, f"{path}/out", lambda b: b, f"{path}/c").awaitTermination()
    assert show(spark.read.parquet(f"{path}/out").withColumn("at", F.col("at").cast("timestamp_ntz"))) == sorted(want, key=repr)


# Interval joins.
@pytest.mark.parametrize("whole", [True, False])
def test_interval_joins_are_the_brute_force_ones(spark, whole):
    rng = random.Random(5)

    def side(n):
        out = []
        for k in range(n):
            a = rng.choice([rng.randint(-50, 50), rng.uniform(-5, 5), 0.0, 1e6])
            z = a + rng.choice([0, 0, 0.25, 1, rng.uniform(0, 9), rng.randint(0, 2000), -1])
            out.append((k, rng.choice(["p", "q", "q", None]), *((int(a), int(z)) if whole else (float(a), float(z)))))
        return [*out, (n, "q", None, out[0][3]), (n + 1, "q", out[0][2], None)]

    kind = "long" if whole else "double"
    l, r = side(90), side(120)
    left, right = spark.createDataFrame(l, f"id int, k string, a {kind}, z {kind}"), spark.createDataFrame(r, f"id int, k string, s {kind}, e {kind}")
    ok = lambda x, y: None not in (x[2], x[3], y[2], y[3]) and x[2] <= x[3] and y[2] <= y[3] and x[2] <= y[3] and y[2] <= x[3]
    got = joins.interval(left, right, ("a", "z"), ("s", "e"))
    assert "NestedLoop" not in got._jdf.queryExecution().toString() and "Cartesian" not in got._jdf.queryExecution().toString()
    pairs = sorted((x.l.id, x.r.id) for x in got.collect())
    assert pairs == sorted((x[0], y[0]) for x in l for y in r if ok(x, y)) and len(pairs) > 500
    keyed = joins.interval(left, right, ("a", "z"), ("s", "e"), ("k",), F.col("l.id") < F.col("r.id"))
    assert sorted((x.l.id, x.r.id) for x in keyed.collect()) == sorted((x[0], y[0]) for x in l for y in r if ok(x, y) and x[1] == y[1] is not None and x[0] < y[0])
    assert joins.interval(left.limit(0), right, ("a", "z"), ("s", "e")).count() == 0


# Stream rows.
def test_a_denied_row_ends_a_stream_and_a_skipped_one_does_not(spark):
    class Decides:
        def on_stream_row(self, ctx):
            return "CASE WHEN v > 8 THEN 'deny' WHEN v % 2 = 0 THEN 'skip' END"

    e = hooks.Engine()
    e.add(Decides(), tables=("t",))
    rows = spark.range(9).select(F.col("id").alias("v"))
    assert [r.v for r in e.stream(hooks.Context("stream", "t"), rows).orderBy("v").collect()] == [1, 3, 5, 7]
    assert e.stream(hooks.Context("stream", "other"), rows).count() == 9
    with pytest.raises(PySparkException, match="denied"):
        e.stream(hooks.Context("stream", "t"), spark.range(12).select(F.col("id").alias("v"))).collect()


# Logs.
HLC = "struct<ts:bigint,c:bigint,node:string>"


def log(spark, rng, n=300):
    out = []
    for k in range(n):
        dead = rng.random() < 0.25
        out.append(("t", rng.randint(0, 30), None if dead else rng.choice("ab"), (rng.randint(0, 100), k, "n"), None if dead else str(k), dead))
    return spark.createDataFrame(out, f"tbl string, pk int, field string, hlc {HLC}, value string, tombstone boolean")


@pytest.mark.parametrize("seed", range(3))
def test_cleaned_logs_have_the_same_state_and_stay_so(spark, seed):
    full = log(spark, random.Random(seed)).cache()
    for before in (0, 40, 101):
        clean = crdt.clean_tombstones(full, before)
        assert rows(crdt.record_state(clean)) == rows(crdt.record_state(full))
        assert clean.where(F.col("tombstone") & (F.col("hlc.ts") < before)).count() == 0
        again, _ = crdt.exchange(clean, full, horizon=before)  # the old changes come again
        assert rows(crdt.record_state(again)) == rows(crdt.record_state(full))
        taken, late = crdt.accepted(full, before)
        assert taken.count() + late.count() == 300 and late.where(F.col("hlc.ts") >= before).count() == 0


def test_a_deleted_record_does_not_come_back(spark):
    rows_ = [("t", 1, "a", (1, 0, "n"), "v", False), ("t", 1, None, (2, 0, "n"), None, True), ("t", 2, "a", (1, 0, "n"), "w", False)]
    full = spark.createDataFrame(rows_, log(spark, random.Random(0), 1).schema)
    assert rows(crdt.record_state(crdt.clean_tombstones(full, 3))) == [(2, "a", "w")]


def test_equal_logs_exchange_nothing(spark):
    full = log(spark, random.Random(1))
    assert crdt.missing(full, full).count() == 0
    here, there, report = crdt.reported(full, full)
    assert report == {"pulled": 0, "tombstones": 0, "conflicts": 0, "merged": 0, "pushed": 0} and here.count() == there.count() == 300
    here, there, report = crdt.reported(full.where("hlc.c < 100"), full.where("hlc.c >= 50"))
    assert (report["pulled"], report["pushed"]) == (200, 50) and rows(here) == rows(there) == rows(full)


def forest(rng, keys):
    out = []
    for key in keys:
        ids = [(rng.randint(0, 5), k, rng.choice("mn")) for k in range(rng.randint(1, 60))]
        rng.shuffle(ids)
        for k, i in enumerate(ids):
            up = None if not k or rng.random() < 0.1 else rng.choice(ids[max(0, k - 3) : k]) if rng.random() < 0.9 else (99, 99, "lost")
            out.append((key, "f", i, up, str(k), rng.random() < 0.2))
        if len(ids) > 5:  # a circle, and what hangs from it
            out += [(key, "f", (7, 1, "o"), (7, 2, "o"), "x", False), (key, "f", (7, 2, "o"), (7, 1, "o"), "y", False), (key, "f", (7, 3, "o"), (7, 2, "o"), "z", False)]
    return out + out[:9]  # some nodes are given twice


@pytest.mark.parametrize("seed", range(2))
def test_lists_ordered_by_joins_are_those_of_the_walk(spark, seed):
    df = spark.createDataFrame(forest(random.Random(seed), range(12)), f"pk int, field string, id {HLC}, parent {HLC}, value string, tombstone boolean")
    want = rows(crdt.list_order(df))
    assert rows(crdt.list_order(df, walk=0)) == want and len(want) > 100
    assert rows(crdt.list_order(df, walk=30)) == want  # some by one way, some by the other


def test_a_long_chain_and_a_wide_node(spark):
    at = lambda c: F.struct(c.cast("long").alias("ts"), F.lit(0).cast("long").alias("c"), F.lit("n").alias("node"))
    n = 3000
    chain = spark.range(n).select(F.lit(1).alias("pk"), F.lit("f").alias("field"), at(F.col("id")).alias("id"), F.when(F.col("id") > 0, at(F.col("id") - 1)).alias("parent"), F.col("id").alias("value"), (F.col("id") == 5).alias("tombstone"))
    wide = spark.range(n).select(F.lit(2).alias("pk"), F.lit("f").alias("field"), at(F.col("id")).alias("id"), F.when(F.col("id") > 0, at(F.lit(0))).alias("parent"), F.col("id").alias("value"), F.lit(False).alias("tombstone"))
    got = crdt.list_order(chain.unionByName(wide), walk=10).collect()
    assert [r.value for r in sorted((r for r in got if r.pk == 1), key=lambda r: r.pos)] == [k for k in range(n) if k != 5]
    assert [r.value for r in sorted((r for r in got if r.pk == 2), key=lambda r: r.pos)] == [0, *range(n - 1, 0, -1)]


def test_a_change_behind_a_vetoed_one_wins(spark):
    class NoNines:
        seen = None

        def before_merge(self, met):
            return met.where("value <> '9'")

        def after_merge(self, new):
            self.seen = new.count()

    cols = f"tbl string, pk int, field string, hlc {HLC}, value string"
    now = spark.createDataFrame([("t", 1, "a", (1, 0, "n"), "1"), ("t", 2, "a", (8, 0, "n"), "2")], cols)
    new = spark.createDataFrame([("t", 1, "a", (3, 0, "n"), "3"), ("t", 1, "a", (4, 0, "n"), "9"), ("t", 2, "a", (5, 0, "n"), "5"), ("t", 3, "a", (1, 0, "n"), "6")], cols)
    p = NoNines()
    assert sorted((r.pk, r.value) for r in crdt.merge_into(now, new, (p,)).collect()) == [(1, "3"), (2, "2"), (3, "6")] and p.seen == 2
    assert sorted((r.pk, r.value) for r in crdt.merge_into(now, new).collect()) == [(1, "9"), (2, "2"), (3, "6")]
    assert rows(crdt.merge_into(now, new.limit(0))) == rows(now)


# Chunks and rooms by key.
def test_chunks_and_rooms_of_a_hot_key_are_those_of_windows(spark):
    rng = random.Random(6)
    moves = [(rng.choice(["hot"] * 5 + ["a", "b", None]), k, rng.choice([1, -1])) for k in range(500)]
    df = spark.createDataFrame(moves, "room string, at int, delta int")
    inside, seen, want = {}, {}, {}
    for room, at, delta in moves:
        inside[room], seen[room] = inside.get(room, 0) + delta, seen.get(room, -1) + 1
        want[at] = room, inside[room], seen[room] // 7
    got = transforms.chunk(transforms.occupancy(df, "room", "at"), 7, "at", by="room")
    assert {r.at: (r.room, r.inside, r.chunk) for r in got.collect()} == want


def test_a_scroll_reads_one_snapshot(spark):
    df = spark.range(10).select(F.col("id").alias("v"), F.rand().alias("x"))  # other values each time it is read
    pages = [p.collect() for p in transforms.scroll(df, 4, F.desc("v"))]
    assert [[r.v for r in p] for p in pages] == [[9, 8, 7, 6], [5, 4, 3, 2], [1, 0]]
    assert list(transforms.scroll(df.limit(0), 4, "v")) == []
    with pytest.raises(ValueError):
        next(transforms.scroll(df, 0, "v"))


# Validators, shadow tables, plugins.
def test_validators_let_nulls_pass_but_for_required_fields(spark):
    from tidewater.operators import documents

    df = spark.createDataFrame([(1, "ab", 5.0), (2, None, None), (None, "abcd", -1.0)], "id int, name string, x double")
    rules = {"required": ["id"], "properties": {"name": {"bsonType": "string", "minLength": 2, "maxLength": 3}, "x": {"bsonType": "int", "minimum": 0}}}
    got = {r.id: list(r.violations) for r in df.select("id", documents.violations(df, rules).alias("violations")).collect()}
    assert got == {1: ["x: bsonType"], 2: [], None: ["id: required", "name: maxLength", "x: bsonType", "x: minimum"]}
    assert documents.validated(df, {})[1].count() == 0


def test_shadow_tables_are_read_by_their_days(spark):
    path = shared_dir(spark)
    days = [("t", 1, "a", (d * crdt.DAY + 5, 0, "n"), str(d), False) for d in range(-2, 6)]
    crdt.shadow_write(spark.createDataFrame(days, f"tbl string, pk int, field string, hlc {HLC}, value string, tombstone boolean"), path)
    late = crdt.shadow_read(spark, path, 3 * crdt.DAY + 6)
    assert sorted(r.value for r in late.collect()) == ["4", "5"] and crdt.shadow_read(spark, path).count() == 8
    assert "PartitionFilters: [isnotnull(day" in late._jdf.queryExecution().toString()


def test_plugins_are_used_once_and_bring_hooks_and_migrations(spark):
    class Plugin:
        name = "audit"

        def init(self, db):
            self.db = db

        def hooks(self, engine):
            engine.add(hooks.RowFilter("id > 1"), tables=("t",))

        def migrations(self):
            return "group"

    db = Database(spark).register(TableDef("t"), spark.range(4))
    p = Plugin()
    assert db.use(p) is db and p.db is db and db.migrations() == ["group"] and db.rows("t").count() == 2
    with pytest.raises(ValueError):
        db.use(Plugin())


def test_a_batch_reads_before_it_writes(spark):
    from tidewater.operators import kv

    cols = "k string, v string, expires_at timestamp"
    now = spark.createDataFrame([("a", "1", None), ("b", "2", None), ("old", "3", datetime(2000, 1, 1))], cols)
    ops = spark.createDataFrame([("get", "a", None, None), ("get", "old", None, None), ("set", "a", "8", None), ("set", "a", "9", None), ("set", "n", "7", None), ("del", "b", None, None), ("del", "n", None, None), ("del", "none", None, None)], f"op string, {cols}")
    after, values, counts = kv.batch(now, ops)
    assert rows(after.select("k", "v")) == [("a", "9")] and rows(values) == [("a", "1")] and counts.first()[:] == (2, 2)
