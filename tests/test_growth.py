"""What larger tables cost: rows that are copied, sorted and passed on the way to a result."""

from __future__ import annotations

from datetime import UTC, datetime, timedelta

import pandas as pd
from pyspark.sql import functions as F

from tests.compare import assert_same, views
from tidewater.operators import crdt, joins
from tidewater.plans import catalog
from tidewater.streaming import state


def test_an_interval_join_broadcasts_neither_side(spark):
    points = spark.range(2000).select((F.col("id") % 7).alias("k"), (F.col("id") * 3).alias("t"))
    spans = points.select("k", F.col("t").alias("a"), (F.col("t") + F.pow(F.lit(2), F.col("t") % 12).cast("long")).alias("z"))
    met = joins.interval(spans, points, ("a", "z"), ("t", "t"), ("k",))
    assert "BroadcastHashJoin" not in met._jdf.queryExecution().executedPlan().toString()
    assert met.count() == spans.join(F.broadcast(points.withColumnRenamed("k", "q")), (F.col("k") == F.col("q")) & F.col("t").between(F.col("a"), F.col("z"))).count()


def test_levels_share_bins_where_that_copies_fewer_rows():
    assert joins._bins({30: 1, 31: 1, 32: 1, 36: 1}, {0: 1000}) == {0: 0, 30: 30, 31: 30, 32: 30, 36: 30}
    assert joins._bins({3: 1000, 9: 1000}, {0: 10}) == {0: 0, 3: 3, 9: 9}
    assert joins._bins({}, {}) == {}


def test_a_count_meets_each_day_once(spark, sf_dir, monkeypatch):
    met, whole = [], joins.interval
    monkeypatch.setattr(joins, "interval", lambda left, right, *a, **b: met.append(right) or whole(left, right, *a, **b))
    df = catalog.QUERIES["join_interval"](spark, sf_dir)
    days = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_shipdate").distinct().count()
    assert met[0].count() == days
    assert_same(df, views(sf_dir), catalog.ORACLE_SQL["join_interval"])


def test_a_long_list_is_joined_by_what_leaves_its_blocks(spark, monkeypatch):
    tours, write = [], crdt.materialize
    monkeypatch.setattr(crdt, "materialize", lambda df, path, name, *a: tours.append(name) or write(df, path, name, *a))
    at = lambda c: crdt.hlc(c, F.lit(0), F.lit("n"))
    node = lambda parent, dead: spark.range(1, 5000).select(F.lit(1).alias("pk"), F.lit("f").alias("field"), at(F.col("id")).alias("id"), at(parent).alias("parent"), F.col("id").alias("value"), dead.alias("tombstone"))
    wide = node(F.when(F.col("id") > 1, F.lit(1)), F.col("id") % 3 == 0).withColumn("parent", F.when(F.col("value") > 1, F.col("parent")))
    chain = node(F.col("id") - 1, F.lit(False)).withColumn("parent", F.when(F.col("value") > 1, F.col("parent")))
    for df, want in ((wide, [1, *(k for k in range(4999, 1, -1) if k % 3)]), (chain, list(range(1, 5000)))):
        tours.clear()
        assert [r.value for r in crdt.list_order(df, walk=0).orderBy("pos").collect()] == want
        assert sum(n.startswith("tour-") for n in tours) <= 2


def test_blocks_of_a_long_list_meet_and_circles_end(spark, monkeypatch):
    rows = [(1, "f", (k, 0, "n"), (k * 7 % 300, 0, "n") if k % 300 else None, str(k), k % 4 == 0) for k in range(1, 301)]
    rows += [(1, "f", (1000 + k, 0, "n"), (1000 + (k + 1) % 3, 0, "n"), "c", False) for k in range(3)]
    h = "struct<ts:bigint,c:bigint,node:string>"
    df = spark.createDataFrame(rows, f"pk int, field string, id {h}, parent {h}, value string, tombstone boolean")
    want = sorted(map(tuple, crdt.list_order(df).collect()))
    for block in (2, 16, 1 << 16):
        monkeypatch.setattr(crdt, "BLOCK", block)
        for few in (0, 1 << 16):
            monkeypatch.setattr(crdt, "FEW", few)
            assert sorted(map(tuple, crdt.list_order(df, walk=0).collect())) == want


def test_session_events_sort_once(spark):
    ops = spark.createDataFrame([(1, "create", "d", datetime(2024, 1, 1, tzinfo=UTC), 1)], "id long, op string, data string, ts timestamp, seq long")
    plan = state.session_events(ops, 60)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Sort [") == 1 and "Union" not in plan


class _Handle:
    """A session's state and timers, with the calls counted that would go to the JVM."""

    def __init__(self):
        self.calls, self.value, self.timers = 0, None, set()

    def getValueState(self, *a):  # noqa: N802
        return self

    def exists(self):
        self.calls += 1
        return self.value is not None

    def get(self):
        self.calls += 1
        return self.value

    def update(self, value):
        self.calls += 1
        self.value = value

    def clear(self):
        self.calls += 1
        self.value = None

    def registerTimer(self, at):  # noqa: N802
        self.calls += 1
        self.timers.add(at)

    def deleteTimer(self, at):  # noqa: N802
        self.calls += 1
        self.timers.discard(at)


def test_a_session_reads_and_writes_its_state_once_for_many_rows():
    handle, sessions, t0 = _Handle(), state._Sessions(60), pd.Timestamp("2024-01-01")
    sessions.init(handle)
    rows = pd.DataFrame([("create" if k == 0 else "touch", f"d{k}", t0 + timedelta(seconds=k), k) for k in range(100)], columns=["op", "data", "ts", "seq"])
    out = pd.concat(sessions.handleInputRows((5,), iter([rows[50:], rows[:50]]), None))
    assert out["event"].tolist() == ["create", *["touch"] * 99] and set(out["data"]) == {"d0"}
    ends = int((t0 + timedelta(seconds=159)).timestamp()) * 1000
    assert handle.calls <= 5 and handle.timers == {ends} and handle.value == ("d0", ends * 1000)
    list(sessions.handleInputRows((5,), iter([rows[:1].assign(op="delete", ts=t0 + timedelta(seconds=120))]), None))
    assert handle.value is None and not handle.timers
