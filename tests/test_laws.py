"""Merges on random logs: any split, repetition and order gives what a plain loop gives."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from tidewater.operators import crdt
from tidewater.streaming import transforms

HLC = "struct<ts:long,c:long,node:string>"


@pytest.fixture(scope="module")
def log():
    r = random.Random(5)
    rows = []
    for _ in range(600):
        dead = r.random() < 0.1
        clock = (r.randrange(40), r.randrange(3), r.choice("abc"))
        rows.append(("t", r.randrange(8), None if dead else r.choice("xyz"), clock, None if dead else str(r.randrange(9)), dead))
    return rows


def state_of(rows):
    fields, dead, live = {}, {}, {}
    for _, pk, field, clock, value, tombstone in rows:
        if tombstone:
            dead[pk] = max(dead.get(pk, clock), clock)
        else:
            fields[pk, field] = max(fields.get((pk, field), (clock, value)), (clock, value))
            live[pk] = max(live.get(pk, clock), clock)
    return {(pk, f, v) for (pk, f), (_, v) in fields.items() if pk not in dead or live[pk] > dead[pk]}


def test_record_state(spark, log):
    schema = f"tbl string, pk long, field string, hlc {HLC}, value string, tombstone boolean"
    a, b = spark.createDataFrame(log[:400], schema), spark.createDataFrame(log[250:], schema)
    want = state_of(log)
    for merged in (a.unionAll(b), b.unionAll(a), crdt.sync(a, b), a.unionAll(a).unionAll(b).repartition(7)):
        assert {(r.pk, r.field, r.value) for r in crdt.record_state(merged).collect()} == want
    at = F.struct(F.lit(20).cast("long").alias("ts"), F.lit(9).cast("long").alias("c"), F.lit("z").alias("node"))
    assert {(r.pk, r.field, r.value) for r in crdt.record_state(a.unionAll(b), at).collect()} == state_of([x for x in log if x[3] <= (20, 9, "z")])


def test_partial_merges_merge_to_the_same(spark, log):
    schema = f"tbl string, pk long, field string, hlc {HLC}, value string, tombstone boolean"
    rows = spark.createDataFrame([x for x in log if not x[5]], schema)
    parts = [crdt.latest(rows.where(F.pmod(F.xxhash64("hlc"), F.lit(3)) == k)) for k in range(3)]
    again = crdt.latest(parts[2].unionByName(parts[0]).unionByName(parts[1]))
    assert {tuple(r) for r in again.collect()} == {tuple(r) for r in crdt.latest(rows).collect()}


def test_counters(spark):
    r = random.Random(6)
    deltas = [(r.randrange(5), "f", r.choice("abc"), r.randrange(-5, 9)) for _ in range(300)]
    want: dict[int, int] = {}
    for pk, _, _, d in deltas:
        want[pk] = want.get(pk, 0) + d
    facts = crdt.counter_facts(spark.createDataFrame(deltas, "pk long, field string, node string, delta long"))
    older = facts.withColumns({"inc": F.greatest(F.col("inc") - 3, F.lit(0)), "dec": F.greatest(F.col("dec") - 3, F.lit(0))})
    for merged in (facts, facts.unionByName(facts), older.unionByName(facts)):
        assert {r.pk: r.value for r in crdt.counter(merged).collect()} == want


def test_changes_apply_as_a_loop_does(spark):
    r = random.Random(7)
    table = {i: i for i in range(50)}
    events = [(s, r.choice(["INSERT", "UPDATE", "DELETE"]), r.randrange(80), r.randrange(1000)) for s in range(300)]
    want = dict(table)
    for _, op, k, v in events:
        if op == "DELETE":
            want.pop(k, None)
        else:
            want[k] = v
    out = transforms.apply_changes(spark.createDataFrame(list(table.items()), "k long, v long"), spark.createDataFrame(events, "seq long, op string, k long, v long"), "k")
    assert {r.k: r.v for r in out.collect()} == want
