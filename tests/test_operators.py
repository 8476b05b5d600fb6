from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from tidewater.database import Database
from tidewater.functions import scalars
from tidewater.operators import crdt, documents, hooks, joins, kv, migrate, mutate, search
from tidewater.schema import Field, Relation, TableDef, split_tag, to_snake_case
from tidewater.sources.tables import documents as read_documents, fixtures, rewrite
from tidewater.streaming import state, transforms


@pytest.fixture
def db(spark):
    users = spark.createDataFrame([(1, "Ann", None, 1), (2, "Bob", "x", 1), (3, "O'Neil", None, 2), (4, None, None, 2)], "id long, name string, deleted string, tenant int")
    posts = spark.createDataFrame([(10, 1, "a"), (11, 1, "b"), (12, 3, "c"), (13, None, "d")], "id long, user_id long, title string")
    db = Database(spark)
    db.register(TableDef("users", (Field.parse("id", "int64", "pk"), Field.parse("deleted", "string", "soft_delete")), alias="u", relations=(Relation("posts", "has_many", "posts", "id", "user_id"),)), users)
    return db.register(TableDef("posts", (Field.parse("id", "int64", "pk"),), alias="p"), posts)


def ids(df):
    return sorted(r.id for r in df.collect())


def test_names_and_tags():
    assert [to_snake_case(x) for x in ("HTMLParser", "UserID", "a", "CreatedAt")] == ["html_parser", "user_id", "a", "created_at"]
    assert split_tag("name,type:'decimal(10,2)',pk") == [("name", None), ("type", "decimal(10,2)"), ("pk", None)]
    f = Field.parse("Total", "float64", "total,type:'decimal(10,2)',notnull")
    assert (f.name, f.type.simpleString(), f.struct().nullable) == ("total", "decimal(10,2)", False)
    t = TableDef.model("BlogPost", [Field.parse("ID", "int64", "id,pk"), [Field.parse("CreatedAt", "time"), Field.parse("DeletedAt", "time", "deleted_at,soft_delete")]])
    assert (t.name, t.pk, t.soft_delete, len(t.struct())) == ("blog_posts", ["id"], "deleted_at", 3)
    with pytest.raises(KeyError):
        t.relation("none")


def test_arguments_are_bound_not_pasted(db):
    assert ids(db.select("users").where("u.name = ?", "O'Neil").df()) == [3]
    assert ids(db.select("users").where("u.name = ?", "x' OR '1'='1").df()) == []


def test_or_does_not_go_round_soft_deletion_or_row_filters(db):
    assert ids(db.select("users").where("id = 1").where_or("id = 2").df()) == [1]
    db.hooks.add(hooks.RowFilter("tenant = 2"), tables=("users",))
    assert ids(db.select("users").where("id = 1").where_or("id = 3").df()) == [3]
    assert db.select("users").count().first().n == 2
    assert ids(db.sql("SELECT * FROM {users} WHERE id < ?", 9)) == [3, 4]


def test_limits_and_pages(db):
    assert len(ids(db.select("users").limit(0).df())) == 3
    assert [r.id for r in db.select("users").order("id DESC").limit(1).offset(1).df().collect()] == [3]
    assert ids(db.select("users").search_after(["tenant", "id"], [1, 1]).df()) == [3, 4]
    with pytest.raises(ValueError):
        db.select("users").where_pk(1, 2)


def test_array_conditions_with_null_and_without_values(db):
    assert ids(db.select("users").where_array("name", "= ANY", []).df()) == []
    assert ids(db.select("users").where_array("name", "<> ALL", ["Ann"]).df()) == [3]
    assert ids(db.select("users").where_array("name", "<> ALL", ["Ann", None]).df()) == []


def test_relation_of_rows_without_related_ones(db):
    got = {r.id: [p.id for p in r.posts] for r in db.select("users").relation("posts").df().collect()}
    assert got == {1: [10, 11], 3: [12], 4: []}


def test_hooks_run_in_order_and_deny(db):
    seen = []

    class H:
        def __init__(self, n):
            self.n = n

        def before_query(self, ctx):
            seen.append(self.n)

    class No:
        def before_query(self, ctx):
            raise hooks.Denied(ctx.table)

    db.hooks.add(H(2), priority=50)
    db.hooks.add(H(3), priority=50)
    db.hooks.add(H(1), priority=1)
    db.select("users").df()
    assert seen == [1, 2, 3]
    db.hooks.add(No(), tables=("posts",))
    with pytest.raises(hooks.Denied):
        db.select("posts").df()
    db.select("users").df()


def test_mutations(spark):
    t = spark.createDataFrame([(1, "a", 5), (2, "b", None)], "id long, name string, n int")
    new, added = mutate.insert(t, spark.createDataFrame([("c",), ("d",)], "name string"), {"n": "7"}, "id")
    assert sorted((r.id, r.name, r.n) for r in added.collect()) == [(3, "c", 7), (4, "d", 7)] and new.count() == 4
    after, hit = mutate.update(t, {"n": "n + 1"}, "n > 1")
    assert sorted((r.id, r.n) for r in after.collect()) == [(1, 6), (2, None)] and ids(hit) == [1]
    assert ids(mutate.delete(t, "n > 1")[0]) == [2]  # unknown is not true: such rows stay
    assert ids(mutate.delete(t)[0]) == []
    with pytest.raises(ValueError):
        mutate.update(t, {})
    with pytest.raises(ValueError):
        mutate.alter_update(t, {"n": "1"}, "")
    assert set(mutate.set_of({"a": 0, "b": 2, "id": 1}, True, ("id",))) == {"b"}
    up, _ = mutate.upsert(t, spark.createDataFrame([(2, "z", 1), (9, "y", 2)], "id long, name string, n int"), ["id"])
    assert sorted((r.id, r.name) for r in up.collect()) == [(1, "a"), (2, "z"), (9, "y")]
    log = spark.createDataFrame([(1, "create", 1, "x", 0), (2, "update", 8, "x", 0), (3, "index", 9, "q", 1), (4, "delete", 2, None, None)], "seq long, action string, id long, name string, n int")
    rows, failed = mutate.bulk(t, log, "id")
    assert sorted((r.id, r.name) for r in rows.collect()) == [(1, "a"), (9, "q")]
    assert sorted((r.id, r.action) for r in failed.collect()) == [(1, "create"), (8, "update")]


def test_rewrite(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    rows = [(1, "a", "x+y z"), (2, "b", "x+y z"), (3, "c", "50%/q:r"), (4, "d", None), (5, "e", "plain")]
    spark.createDataFrame(rows, "id long, name string, p string").repartition("p").write.partitionBy("p").parquet(path)

    def now():
        return sorted((r.id, r.name, r.p) for r in spark.read.parquet(path).collect())

    before = set(spark.read.parquet(path).inputFiles())
    hit = rewrite(spark, path, "p", "id IN (2, 4)", mutate.update, {"name": "upper(name)"})
    assert sorted((r.id, r.name) for r in hit.collect()) == [(2, "B"), (4, "D")]
    assert now() == [(1, "a", "x+y z"), (2, "B", "x+y z"), (3, "c", "50%/q:r"), (4, "D", None), (5, "e", "plain")]
    assert len(before & set(spark.read.parquet(path).inputFiles())) == 2  # of the partitions without such a row
    for where, left in (("id IN (1, 3)", [2, 4, 5]), ("p IS NULL OR id = 2", [5]), ("id = 77", [5])):
        rewrite(spark, path, "p", where, mutate.delete)
        assert [r[0] for r in now()] == left
    with pytest.raises(ValueError):
        rewrite(spark, path, "p", "id = 5", mutate.update, {"p": "'elsewhere'"})
    assert now() == [(5, "e", "plain")]


def test_together(spark):
    db = Database(spark)
    db.frames["a"], db.frames["b"] = spark.range(1, 3), spark.range(3, 4)
    with pytest.raises(Exception, match="not so"):
        db.together(a=spark.range(9, 10), b=spark.range(1).select(F.raise_error(F.lit("not so")).cast("long").alias("id")))
    assert ids(db.frames["a"]) == [1, 2]
    db.together(a=spark.range(9, 10), b=spark.range(8, 9))
    assert ids(db.frames["a"]) == [9] and ids(db.frames["b"]) == [8]


def test_readers(spark, tmp_path):
    (tmp_path / "f.json").write_text(json.dumps([{"table": "u", "records": [{"id": 1, "n": "x"}, {"id": 2}]}, {"table": "p", "records": [{"k": 1.5}]}]))
    got = fixtures(spark, str(tmp_path / "f.json"))
    assert set(got) == {"u", "p"} and sorted(r.id for r in got["u"].collect()) == [1, 2]
    (tmp_path / "d.json").write_text('{"id": 1}\nnot json\n{"id": 2}\n')
    good, bad = read_documents(spark, str(tmp_path / "d.json"), "id long")
    assert ids(good) == [1, 2] and bad.count() == 1


def test_documents(spark):
    t = spark.createDataFrame([(1, "a", [1, 2]), (2, None, []), (3, "c", None)], "id long, s string, xs array<int>")
    m = lambda spec: ids(t.where(documents.match(spec)))
    assert m({}) == [1, 2, 3] and m({"s": None}) == [2] and m({"s": {"$ne": "a"}}) == [2, 3] and m({"s": {"$exists": True}}) == [1, 3]
    assert m({"s": {"$in": ["a", None]}}) == [1, 2] and m({"$nor": [{"s": "a"}, {"id": 3}]}) == [2] and m({"xs": {"$size": 2}}) == [1]
    assert m({"xs": {"$elemMatch": {"$gt": 1}}}) == [1] and ids(t.where(documents.all_of({"id": {"$gt": 1}}, {"id": {"$lt": 3}}))) == [2]
    assert ids(documents.pipeline(t, [{"$unwind": "$xs"}])) == [1, 1]
    with pytest.raises(ValueError):
        documents.match({"id": {"$bad": 1}})
    assert documents.pipeline(t, [{"$group": {"_id": None, "n": {"$sum": 1}}}]).first().n == 3


def test_search(spark):
    t = spark.createDataFrame([(1, "The quick fox"), (2, "quick, the"), (3, None)], "id long, text string")
    s = lambda: search.Search(t)
    assert ids(s().match("text", "QUICK fox").hits()) == [1, 2] and ids(s().match_phrase("text", "the quick").hits()) == [1]
    edges = spark.createDataFrame([(1, "foxes"), (2, "über_fox"), (3, "fÜr, FOX."), (4, "fox-für"), (5, "fürs fox")], "id long, text string")
    assert ids(search.Search(edges).match("text", {"query": "Für fox", "operator": "and"}).hits()) == [3, 4]
    assert sorted((r.id, r._score) for r in search.Search(edges).match("text", "für fox").hits().collect()) == [(3, 2.0), (4, 2.0), (5, 1.0)]
    assert ids(s().bool(must_not=[{"exists": {"field": "text"}}]).hits()) == [3]
    assert ids(s().match("text", "quick").term("id", 2).hits()) == [2]
    assert [r.id for r in s().match("text", "quick fox").df().collect()] == [1, 2]
    assert ids(s().page(0, -1).df()) == [1, 2, 3]
    assert s().match("text", "fox").highlight("text", "fox").df().first().text_highlight == "The quick <em>fox</em>"


def clock(ts, c=0, n="a"):
    return F.struct(F.lit(ts).cast("long").alias("ts"), F.lit(c).cast("long").alias("c"), F.lit(n).alias("node"))


HLC = "struct<ts:long,c:long,node:string>"


def test_clock_orders_and_clamps():
    now = [10]
    c = crdt.Clock("a", lambda: now[0], 100)
    assert [c.tick(), c.tick()] == [(10, 0, "a"), (10, 1, "a")]
    assert c.receive(1_000_000, 7)[:2] == (110, 1)
    now[0] = 500
    assert c.tick() == (500, 0, "a")


def test_merges_do_not_depend_on_order_or_repetition(spark):
    rows = [(1, "f", (t, c, n), v, False) for t, c, n, v in [(5, 0, "a", "x"), (5, 1, "a", "y"), (5, 1, "b", "z"), (4, 9, "z", "w")]]
    log = spark.createDataFrame(rows, f"pk long, field string, hlc {HLC}, value string, tombstone boolean")
    for mixed in (log, log.unionAll(log), log.orderBy(F.desc("value"))):
        assert [r.value for r in crdt.latest(mixed).collect()] == ["z"]
    facts = spark.createDataFrame([(1, "f", "n1", 10, 2), (1, "f", "n2", 5, 0), (1, "f", "n1", 8, 0)], "pk long, field string, node string, inc long, dec long")
    assert crdt.counter(facts.unionAll(facts)).first().value == 13


def test_add_wins_over_a_concurrent_removal(spark):
    tags = spark.createDataFrame([(1, "f", "x", "a", (1, 0, "a")), (1, "f", "x", "b", (2, 0, "b")), (1, "f", "y", "a", (1, 1, "a"))], f"pk long, field string, elem string, node string, hlc {HLC}")
    removed = spark.createDataFrame([(1, "f", "a", (1, 0, "a")), (1, "f", "a", (1, 1, "a"))], f"pk long, field string, node string, hlc {HLC}")
    assert [r.elem for r in crdt.set_elements(tags, removed).collect()] == ["x"]


def test_lists_documents_and_tombstones(spark):
    nodes = [((1, 0, "n1"), None, "A", False), ((1, 0, "n2"), None, "B", False), ((2, 0, "n1"), (1, 0, "n1"), "C", False), ((3, 0, "n1"), (1, 0, "n1"), "D", True), ((4, 0, "n1"), (3, 0, "n1"), "E", False), ((9, 0, "n"), (8, 8, "q"), "lost", False)]
    nodes += [((i, 0, "n"), (i - 1, 0, "n") if i > 10 else None, f"v{i}", False) for i in range(10, 300)]
    t = spark.createDataFrame([(1, "f", *x) for x in nodes], f"pk long, field string, id {HLC}, parent {HLC}, value string, tombstone boolean")
    got = [r.value for r in crdt.list_order(t.unionAll(t)).orderBy("pos").collect()]
    assert got == [f"v{i}" for i in range(10, 300)] + ["B", "A", "E", "C"]
    facts = spark.createDataFrame([(1, "d", "a.b", (1, 0, "n"), "1", False), (1, "d", "a", (2, 0, "n"), None, True), (1, "d", "a.c", (3, 0, "n"), "2", False)], f"pk long, field string, path string, hlc {HLC}, value string, tombstone boolean")
    assert json.loads(crdt.document_json(crdt.document_fields(facts)).first().doc) == {"a": {"c": "2"}}
    log = spark.createDataFrame([("t", 1, "f", (6, 0, "n"), "new", False), ("t", 1, None, (5, 0, "n"), None, True), ("t", 2, "f", (3, 0, "n"), "x", False), ("t", 2, None, (5, 0, "n"), None, True)], f"tbl string, pk long, field string, hlc {HLC}, value string, tombstone boolean")
    assert [r.pk for r in crdt.record_state(log).collect()] == [1]
    assert [r.pk for r in crdt.record_state(log, clock(3, 9)).collect()] == [2]
    cleaned = crdt.clean_tombstones(log, 6)  # the second record goes with its tombstone, so that it does not come back
    assert [r.pk for r in cleaned.collect()] == [1] and [r.pk for r in crdt.record_state(cleaned).collect()] == [1]
    assert [d.count() for d in crdt.valid_changes(log.unionAll(log.limit(1).withColumn("pk", F.lit(None).cast("long"))))] == [4, 1]
    assert crdt.sync_filter(log, [1], ["g"]).count() == 1


def test_key_value(spark):
    now = F.lit("2024-01-01 00:00:10").cast("timestamp")
    s = spark.createDataFrame([("a:1", "x", None), ("a:2", "y", "2024-01-01 00:00:05"), ("b", "z", "2024-01-01 00:00:20")], "k string, v string, e string").select("k", "v", F.col("e").cast("timestamp").alias("expires_at"))
    keys = lambda df: sorted(r.k for r in df.collect())
    assert keys(kv.live(s, now)) == ["a:1", "b"] and keys(kv.scan(s, "a:*", now)) == ["a:1"] and kv.exists(s, ["b", "a:2"], now).first().n == 1
    assert {r.k: r.seconds for r in kv.ttl(s, now).collect()} == {"a:1": None, "b": 10.0}
    new = s.where("k <> 'b'").withColumn("expires_at", F.lit(None).cast("timestamp"))
    assert keys(kv.put(s, new, "nx", now)) == ["a:1", "a:2", "b"] and keys(kv.put(s, new, "xx", now)) == ["a:1", "b"]
    assert keys(kv.namespaced(s, "n")) == ["n:a:1", "n:a:2", "n:b"]


def test_migrations(spark):
    a = migrate.Group("a", ("b",)).register(migrate.Migration("1", lambda c: c.append("a1"), lambda c: c.append("-a1")))
    b = migrate.Group("b").register(migrate.Migration("2", lambda c: c.append("b2")), migrate.Migration("1", lambda c: c.append("b1")))
    done: list[str] = []
    m = migrate.Migrator(spark, [a, b])
    assert m.migrate(done) == ["1", "2", "1"] and done == ["b1", "b2", "a1"] and m.migrate(done) == []
    assert m.rollback(done) == "1" and done[-1] == "-a1" and m.migrate(done) == ["1"]
    with pytest.raises(ValueError, match="cycle"):
        migrate.plan([migrate.Group("x", ("y",)), migrate.Group("y", ("x",))])
    with pytest.raises(ValueError, match="unknown"):
        migrate.plan([migrate.Group("x", ("z",))])
    with pytest.raises(ValueError):
        b.register(migrate.Migration("1", print))


def test_scalars(spark):
    assert scalars.parse_array_text('{a,"b, \\"c\\"",NULL}') == ["a", 'b, "c"', None]
    assert scalars.parse_hstore_text('"a"=>"1", "b"=>NULL') == {"a": "1", "b": None}
    t = spark.createDataFrame([("HTMLParserTest", "65a1f2c3d4e5f60718293a4b")], "s string, o string")
    r = t.select(scalars.snake_case(F.col("s")).alias("s"), scalars.is_object_id(F.col("o")).alias("o"), scalars.parse_key(".", F.lit("a.b")).alias("k"), scalars.hlc_text(clock(3, 4)).alias("h")).first()
    assert (r.s, r.o, r.k, r.h) == ("html_parser_test", True, ["a", "b"], "3.4@a")


def test_streams(spark, tmp_path):
    t = spark.range(10).withColumn("v", F.col("id") * 2)
    assert transforms.fold(t, 0, lambda a, r: a * 2 + r.v, "id") == sum(2 * i * 2 ** (9 - i) for i in range(10))
    assert [p.count() for p in transforms.pages(t, "id", 4)] == [4, 4, 2]
    assert sorted((r.chunk, r.id) for r in transforms.chunk(t, 4, "id").collect()) == [(i // 4, i) for i in range(10)]
    with pytest.raises(Exception, match="too large"):
        transforms.checked(t, "id < 9", "too large").collect()


def test_presence_events(spark):
    u = spark.createDataFrame([("r", "a", "2024-01-01 00:00:00", False), ("r", "a", "2024-01-01 00:00:10", False), ("r", "a", "2024-01-01 00:02:00", False), ("r", "a", "2024-01-01 00:02:05", True)], "topic string, node string, ts string, leave boolean").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    got = [r.event for r in transforms.presence_events(u).orderBy("ts").collect()]
    assert got == ["join", "update", "leave", "join", "leave"]


def test_streaming_fold_and_presence(spark, tmp_path):
    src, out = tmp_path / "src", tmp_path / "out"
    rows = spark.createDataFrame([(1, "f", (i, 0, "n"), str(i), False) for i in range(20)], f"pk long, field string, hlc {HLC}, value string, tombstone boolean")
    rows.repartition(4).write.parquet(str(src))
    q = state.fold_batches(spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(str(src)), str(out), crdt.latest, str(tmp_path / "cp"))
    q.awaitTermination(120)
    assert crdt.latest(spark.read.parquet(str(out))).first().value == "19"

    events = spark.createDataFrame([("r", "a", "2024-01-01 00:00:00"), ("r", "b", "2024-01-01 00:05:00"), ("r", "b", "2024-01-01 00:10:00")], "topic string, node string, ts string").withColumn("ts", F.col("ts").cast("timestamp"))
    for i, t in enumerate(["00:00:00", "00:05:00", "00:10:00"]):
        events.where(F.col("ts") == F.lit(f"2024-01-01 {t}").cast("timestamp")).coalesce(1).write.mode("append").parquet(str(tmp_path / "ev"))
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "ev"))
    q = state.presence_stream(stream).writeStream.format("memory").queryName("presence").outputMode("append").option("checkpointLocation", str(tmp_path / "cp2")).trigger(availableNow=True).start()
    q.awaitTermination(180)
    got = {(r.node, r.event) for r in spark.table("presence").collect()}
    assert ("a", "join") in got and ("b", "join") in got and ("a", "leave") in got


def test_writes_meet_row_filters_defaults_and_required_fields(db, spark):
    db.hooks.add(hooks.RowFilter("tenant = 2"), tables=("users",))
    assert db.update("users", {"name": "'x'"}, "id < 9").count() == 2
    assert {r.id: r.name for r in db.raw_rows("users").collect()} == {1: "Ann", 2: "Bob", 3: "x", 4: "x"}
    db.delete("users", "id <= 3", force=True)
    assert ids(db.raw_rows("users")) == [1, 2, 4]
    kept = db.frames["users"]
    with pytest.raises(Exception, match="may not be written"):
        db.insert("users", spark.createDataFrame([(9, "Eve", None, 1)], "id long, name string, deleted string, tenant int")).collect()
    db.frames["users"] = kept
    with pytest.raises(Exception, match="may not be written"):
        db.insert("users", spark.createDataFrame([(None, "Eve", None, 2)], "id long, name string, deleted string, tenant int")).collect()
    db.frames["users"] = kept
    hidden = spark.createDataFrame([(1, "taken over", None, 2), (4, "Dan", None, 2), (5, "new", None, 2)], "id long, name string, deleted string, tenant int")
    assert ids(db.upsert("users", hidden)) == [4, 5]
    assert {r.id: r.name for r in db.raw_rows("users").collect()} == {1: "Ann", 2: "Bob", 4: "Dan", 5: "new"}


def test_a_hook_may_refuse_a_mutation_and_others_see_it(db):
    class ReadOnly:
        def before_mutation(self, ctx):
            raise hooks.Denied(ctx.operation)

    log = hooks.Audit()
    db.hooks.add(log)
    db.update("posts", {"title": "'z'"}, "id > 11")
    assert [tuple(r) for r in log.entries().collect()] == [("update", "posts", 2)]
    db.hooks.add(ReadOnly(), tables=("posts",))
    for change in (lambda: db.update("posts", {"title": "'z'"}), lambda: db.delete("posts")):
        with pytest.raises(hooks.Denied):
            change()


def test_masks_hold_under_any_name(db, spark):
    db.hooks.add(hooks.Mask({"name": "'***'"}), tables=("users",))
    assert {r.x for r in db.select("users").column_expr("name AS x").df().collect()} == {"***"}
    assert {r.name for r in db.sql("SELECT name FROM {users}").collect()} == {"***"}
    assert db.select("posts").join("JOIN", "users", "p.user_id = u.id").column("u.name").df().distinct().collect()[0].name == "***"


def test_one_row_for_each_conflicting_key(spark):
    table = spark.createDataFrame([(1, "a")], "id long, v string")
    new = spark.createDataFrame([(2, "x", 1), (2, "b", 2), (1, "y", 1), (1, "c", 5), (None, "n", 1), (None, "n", 1)], "id long, v string, seq int")
    got = lambda out: sorted((r.id or 0, r.v) for r in out.collect())
    assert got(mutate.upsert(table, new, ["id"], order="seq")[0]) == [(0, "n"), (0, "n"), (1, "c"), (2, "b")]
    assert got(mutate.upsert(table, new, ["id"], nothing=True)[0]) == [(0, "n"), (0, "n"), (1, "a"), (2, "x")]
    store = spark.createDataFrame([("k", "1", None)], "k string, v string, expires_at timestamp")
    twice = spark.createDataFrame([("k", "2", None), ("k", "3", None), ("j", "4", None), ("j", "5", None)], "k string, v string, expires_at timestamp")
    assert sorted((r.k, r.v) for r in kv.put(store, twice, "nx").collect()) == [("j", "5"), ("k", "1")]
    assert sorted((r.k, r.v) for r in kv.put(store, twice).collect()) == [("j", "5"), ("k", "3")]


def test_first_rows_are_known_by_their_key(spark):
    rows = spark.createDataFrame([(i, i // 4, "v") for i in range(12)], "id long, rank int, v string")
    after, hit = mutate.update(rows, {"v": "'w'"}, "id > 0", [F.col("rank")], 2, ["id"])
    assert ids(hit) == [1, 2] and ids(after.where("v = 'w'")) == [1, 2]
    assert ids(mutate.delete(rows, None, order=[F.desc("rank")], limit=1, key=["id"])[1]) == [8]
    assert ids(documents.update(rows, {"rank": 1}, {"$set": {"v": "w"}}, key=["id"]).where("v = 'w'")) == [4]
    maps = rows.withColumn("m", F.create_map("v", "id"))
    assert ids(documents.delete(maps, {"rank": 1}, order=["rank"], key=["id"])) == [0, 1, 2, 3, 5, 6, 7, 8, 9, 10, 11]


def test_asof_against_brute_force(spark):
    import random

    r = random.Random(2)
    left = [(i, r.randrange(3), r.choice([None, *range(40)])) for i in range(120)]
    right = [(i, r.randrange(3), r.randrange(40)) for i in range(60)]
    a = spark.createDataFrame(left, "id long, k int, t long")
    b = spark.createDataFrame(right, "rid long, k int, t long")
    for width in (1, 7, 1000):
        got = {x.id: x.rid for x in joins.asof(a, b, ["k"], "t", ["rid"], "rid", width).collect()}
        want = {i: max(((u, j) for j, q, u in right if q == k and t is not None and u <= t), default=(0, None))[1] for i, k, t in left}
        assert got == want


def test_ranks_and_counters_and_compare_and_set(spark):
    scores = spark.createDataFrame([(m, float(s)) for m, s in zip("abcdef", [5, 9, 9, 1, 5, 7], strict=True)], "member string, score double")
    assert {r.member: r["rank"] for r in kv.leaderboard(scores).collect()} == {"b": 1, "c": 1, "f": 3, "a": 4, "e": 4, "d": 6}
    store = spark.createDataFrame([("a", "1", None), ("b", "x", None)], "k string, v string, expires_at timestamp")
    new = spark.createDataFrame([("a", "2", None, "1"), ("b", "y", None, "z"), ("c", "n", None, None), ("d", "n", None, "o")], "k string, v string, expires_at timestamp, expected string")
    after, won = kv.compare_and_set(store, new)
    assert sorted((r.k, r.v) for r in after.collect()) == [("a", "2"), ("b", "x"), ("c", "n")] and sorted(r.k for r in won.collect()) == ["a", "c"]
    moves = spark.createDataFrame([("r", n, leave, i) for i, (n, leave) in enumerate([("x", False), ("y", False), ("z", False), ("x", True), ("z", False), ("q", True)])] + [("s", "x", False, 0)], "room string, node string, leave boolean, seq int")
    assert [r.admitted for r in state.admissions(moves, 2).where("room = 'r'").orderBy("seq").collect()] == [True, True, False, True, True, False]
