"""Replicated state as folds over an append-only change log.

State is kept in long form, a row per fact, so that each merge is a grouping that does not
depend on order, repetition or partition:

- log:        tbl, pk, field, hlc, value, tombstone
- counters:   pk, field, node, inc, dec
- set tags:   pk, field, elem, node, hlc;   removals: pk, field, node, hlc
- list nodes: pk, field, id, parent, value, tombstone
- documents:  pk, field, path, hlc, value, tombstone

A clock ``hlc`` is struct<ts: bigint, c: bigint, node: string>; Spark compares structs field by
field, which is the clock's order. A record is deleted if its newest tombstone is
newer than every write to its fields.
"""

from __future__ import annotations

import json
import time
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from tidewater.runtime import materialize, shared_dir
from tidewater.streaming.transforms import number


def hlc(ts: Column, c: Column, node: Column) -> Column:
    return F.struct(ts.cast("long").alias("ts"), c.cast("long").alias("c"), node.cast("string").alias("node"))


class Clock:
    """A hybrid logical clock on the driver; remote times beyond the drift bound are clamped to it."""

    def __init__(self, node: str, now=lambda: time.time_ns(), drift_ns: int = 5_000_000_000):
        self.node, self.now, self.drift, self.ts, self.c = node, now, drift_ns, 0, 0

    def tick(self) -> tuple[int, int, str]:
        wall = self.now()
        self.ts, self.c = (wall, 0) if wall > self.ts else (self.ts, self.c + 1)
        return self.ts, self.c, self.node

    def receive(self, ts: int, c: int) -> tuple[int, int, str]:
        wall = self.now()
        if ts > wall + self.drift:
            ts, c = wall + self.drift, 0
        top = max(wall, self.ts, ts)
        self.c = max([x for t, x in ((self.ts, self.c), (ts, c)) if t == top], default=-1) + 1
        self.ts = top
        return self.ts, self.c, self.node


def latest(log: DataFrame, keys: tuple[str, ...] = ("pk", "field"), clock: str = "hlc", value: str = "value") -> DataFrame:
    """Last writer wins: keys, value and clock of the newest write; one clock with two values gives the larger."""
    best = F.max(F.struct(F.col(clock).alias("h"), F.col(value).alias("v")))
    return log.groupBy(*keys).agg(best.alias("_b")).select(*keys, F.col("_b.v").alias(value), F.col("_b.h").alias(clock))


def counter(facts: DataFrame, keys: tuple[str, ...] = ("pk", "field")) -> DataFrame:
    """keys and ``value``: each node's largest count up and down, then their sums."""
    per_node = facts.groupBy(*keys, "node").agg(F.max("inc").alias("inc"), F.max("dec").alias("dec"))
    return per_node.groupBy(*keys).agg((F.sum("inc") - F.sum("dec")).alias("value"))


def counter_facts(deltas: DataFrame, keys: tuple[str, ...] = ("pk", "field")) -> DataFrame:
    """Facts of a log of (keys, node, delta): what each node counted up and down; deltas of 0 count for nothing."""
    up, down = F.when(F.col("delta") > 0, F.col("delta")).otherwise(0), F.when(F.col("delta") < 0, -F.col("delta")).otherwise(0)
    return deltas.groupBy(*keys, "node").agg(F.sum(up).alias("inc"), F.sum(down).alias("dec"))


def set_elements(tags: DataFrame, removed: DataFrame, keys: tuple[str, ...] = ("pk", "field")) -> DataFrame:
    """(keys, elem): elements with a tag that is not removed; of a concurrent add and removal, the add wins."""
    return tags.join(removed.select(*keys, "node", "hlc").distinct(), [*keys, "node", "hlc"], "left_anti").select(*keys, "elem").distinct()


def set_remove(tags: DataFrame, ops: DataFrame, keys: tuple[str, ...] = ("pk", "field")) -> DataFrame:
    """Removals that operations (keys, elem, hlc) make: of all tags of the element that are older."""
    seen = tags.join(ops.select(*keys, "elem", F.col("hlc").alias("_at")), [*keys, "elem"]).where(F.col("hlc") < F.col("_at"))
    return seen.select(*keys, "node", "hlc").distinct()


def list_insert(ops: DataFrame, keys: tuple[str, ...] = ("pk", "field")) -> DataFrame:
    """List nodes that operations (keys, after, hlc, value) add: each right after a node, or at the head where ``after`` is null."""
    return ops.select(*keys, F.col("hlc").alias("id"), F.col("after").alias("parent"), "value", F.lit(False).alias("tombstone"))


def list_delete(nodes: DataFrame, ops: DataFrame, keys: tuple[str, ...] = ("pk", "field")) -> DataFrame:
    """Tombstones that operations (keys, id) add; one for a node that there is not adds none."""
    return list_merge(nodes, keys).join(ops.select(*keys, "id").distinct(), [*keys, "id"], "left_semi").select(*keys, "id", "parent", "value", F.lit(True).alias("tombstone"))


def list_move(nodes: DataFrame, ops: DataFrame, keys: tuple[str, ...] = ("pk", "field")) -> DataFrame:
    """Nodes that operations (keys, id, after, hlc) add: a tombstone at the old place, and the value under a new id at the new one."""
    known = list_merge(nodes, keys).select(*keys, "id", "value")
    return list_delete(nodes, ops, keys).unionByName(list_insert(ops.join(known, [*keys, "id"]), keys))


def list_merge(nodes: DataFrame, keys: tuple[str, ...] = ("pk", "field")) -> DataFrame:
    """One row per list node; once a tombstone, always one."""
    return nodes.groupBy(*keys, "id").agg(F.min("parent").alias("parent"), F.min("value").alias("value"), F.bool_or("tombstone").alias("tombstone"))


#: Nodes of a long list whose pointers one task follows, a power of two; rows of numbers up to which a table of them is broadcast.
BLOCK, FEW = 1 << 16, 250_000


def list_order(nodes: DataFrame, keys: tuple[str, ...] = ("pk", "field"), walk: int = 100_000) -> DataFrame:
    """(keys, pos, id, value): visible nodes from the head, siblings newest first; what hangs from no head is not reached.

    A list of up to ``walk`` nodes is walked by one task. Longer ones are ordered together by ``_order_by_joins``, in which no task holds a list.
    """
    path = shared_dir(nodes.sparkSession)
    merged = materialize(list_merge(nodes, keys), path, "merged")
    long = materialize(merged.groupBy(*keys).count().where(F.col("count") > walk).drop("count"), path, "long")
    if not long.limit(1).count():
        return _order_by_walks(merged, keys)
    # There is one long list for each ``walk`` nodes at most.
    short, rest = merged.join(long, [*keys], "left_anti"), merged.join(long, [*keys], "left_semi")
    return _order_by_walks(short, keys).unionByName(_order_by_joins(rest, keys, path))


def _order_by_walks(merged: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    schema = merged.select(*keys, F.lit(0).cast("long").alias("pos"), "id", "value").schema
    flat = merged.select(*keys, F.to_json("id").alias("_i"), F.to_json("parent").alias("_p"), F.col("id.ts").alias("_t"), F.col("id.c").alias("_c"), F.col("id.node").alias("_n"), "value", "tombstone")
    id_type = merged.schema["id"].dataType
    made = flat.select(*keys, F.lit(0).cast("long").alias("pos"), F.col("_i").alias("id"), "value").schema

    def walk(group: pd.DataFrame) -> pd.DataFrame:
        ids, parents, dead = group["_i"].tolist(), group["_p"].tolist(), group["tombstone"].tolist()
        clocks = list(zip(group["_t"], group["_c"], group["_n"], strict=True))
        below: dict[str | None, list[int]] = {}
        for k in sorted(range(len(ids)), key=clocks.__getitem__):
            below.setdefault(parents[k] if isinstance(parents[k], str) else None, []).append(k)
        stack, out = list(below.get(None, [])), []
        while stack:  # the newest sibling is last, and so comes first
            k = stack.pop()
            if not dead[k]:
                out.append(k)
            stack += below.get(ids[k], [])
        got = group.iloc[out]
        return pd.DataFrame({**{x: got[x] for x in keys}, "pos": range(1, len(out) + 1), "id": got["_i"], "value": got["value"]})[made.names]

    ordered = flat.groupBy(*keys).applyInPandas(walk, made)
    return ordered.select(*keys, "pos", F.from_json("id", id_type).alias("id"), "value").select(schema.names)


def _order_by_joins(merged: DataFrame, keys: tuple[str, ...], path: str) -> DataFrame:
    """The same order from the Euler tour of the trees: each node is entered (2n) and left (2n + 1), and a place in the list is how many
    visible nodes are entered before. Pointers to what comes before, with the visible nodes passed on the way, are first followed within
    blocks of ``BLOCK`` nodes, a task each. Of what they then refer to outside their block, most often little, they are doubled by a join
    a round, until they are at the start of a tour, so that the rounds are the logarithm of that, however deep the list is.

    Nodes are numbered by parent, newest first, so that siblings have consecutive numbers and a node with very many
    children is no hot key: only its first and last child refer to it. Tours that do not start at a head, below a node that there is not, end at -1, and
    circles at no start: neither is reached.
    """
    numbered = materialize(number(merged, *keys, F.asc_nulls_first("parent"), F.desc("id")), path, "numbered")
    groups = materialize(numbered.groupBy(*keys, "parent").agg(F.min("_n").alias("first"), F.max("_n").alias("last")), path, "groups")
    owners = numbered.select(*keys, F.col("id").alias("parent"), F.col("_n").alias("over"), (~F.col("tombstone")).cast("long").alias("w"))
    below = materialize(owners.join(_few(groups), [*keys, "parent"]).select("first", "last", "over", "w"), path, "below")
    starts = groups.join(_few(below.select("first")), "first", "left_anti")
    step = lambda df, n, kind, prev, s: df.select(n.cast("long").alias("n"), F.lit(kind).alias("kind"), prev.cast("long").alias("prev"), s.cast("long").alias("s"))
    none = F.lit(0)
    tour = step(numbered, F.col("_n"), 0, none, ~F.col("tombstone"))
    tour = tour.unionByName(step(below, F.col("first"), 1, 2 * F.col("over"), F.col("w")))  # into the first child
    tour = tour.unionByName(step(starts, F.col("first"), 1, F.when(F.col("parent").isNull(), 0).otherwise(-1), none))
    tour = tour.unionByName(step(below, F.col("over"), 2, 2 * F.col("last") + 1, none))  # out of the last one
    nodes = tour.groupBy(F.shiftright("n", BLOCK.bit_length() - 1).alias("_block")).applyInPandas(_follow, "n long, into long, s long, out long, t long")
    nodes = materialize(nodes, path, "blocks")
    ends = materialize(nodes.select(F.explode(F.array("into", "out")).alias("e")).where(F.col("e") > 0).distinct(), path, "ends")
    even = F.col("e") % 2 == 0
    state = nodes.join(_few(ends.withColumn("n", F.shiftright("e", 1))), "n").select("e", F.when(even, F.col("into")).otherwise(F.col("out")).alias("prev"), F.when(even, F.col("s")).otherwise(F.col("t")).alias("s"))
    state = materialize(state, path, "tour-0")
    rounds = (2 * numbered.count() + 2).bit_length() + 1
    for k in range(1, rounds + 1):
        going = state.where(F.col("prev") > 0)
        if not going.limit(1).count():
            break
        on = state.select(F.col("e").alias("prev"), F.col("prev").alias("far"), F.col("s").alias("more"))
        moved = going.join(on, "prev").select("e", F.col("far").alias("prev"), (F.col("s") + F.col("more")).alias("s"))
        state = materialize(moved.unionByName(state.where(F.col("prev") <= 0)), path, f"tour-{k}")
    before = state.where(F.col("prev") == 0).select(F.col("e").alias("into"), F.col("s").alias("more"))
    places = nodes.join(_few(before), "into", "left").where((F.col("into") == 0) | F.col("more").isNotNull())
    places = places.select(F.col("n").alias("_n"), (F.col("s") + F.coalesce("more", F.lit(0)) + 1).alias("pos"))
    return numbered.where(~F.col("tombstone")).join(places, "_n").select(*keys, "pos", "id", "value")


def _follow(rows: pd.DataFrame) -> pd.DataFrame:
    """Of each node of a block, entered (into, s) and left (out, t): what comes before outside the block, 0 and -1 at the start of a tour, and the visible nodes on the way.

    A row of kind 0 is a node, with its visibility; what comes before it is its sibling, and before it is left itself, unless
    a row of kind 1 or 2 says otherwise. What is not out of the block after so many steps as it has nodes is in a circle.
    """
    kind, at = rows["kind"].to_numpy(), rows["n"].to_numpy()
    n = np.sort(at[kind == 0])
    first = 2 * n[0]
    prev, s = np.stack([2 * n - 1, 2 * n], 1).ravel(), np.zeros(2 * len(n), np.int64)
    s[2 * (at[kind == 0] - n[0]) + 1] = rows["s"].to_numpy()[kind == 0]
    for k in (1, 2):
        e = 2 * (at[kind == k] - n[0]) + k - 1
        prev[e], s[e] = rows["prev"].to_numpy()[kind == k], rows["s"].to_numpy()[kind == k]
    for _ in range(len(s).bit_length() + 1):
        inside = np.flatnonzero((prev >= first) & (prev < first + len(prev)))
        if not len(inside):
            break
        far = prev[inside] - first
        s[inside] += s[far]
        prev[inside] = prev[far]
    prev[(prev >= first) & (prev < first + len(prev))] = -1
    return pd.DataFrame({"n": n, "into": prev[::2], "s": s[::2], "out": prev[1::2], "t": s[1::2]})


def _few(rows: DataFrame) -> DataFrame:
    """Broadcast if a count shows that the rows, stored ones, are few, else as they are."""
    return F.broadcast(rows) if rows.count() <= FEW else rows


def document_fields(facts: DataFrame, keys: tuple[str, ...] = ("pk", "field")) -> DataFrame:
    """(keys, path, value): the newest write of each path that is newer than any deletion of it or of a path above."""
    new = latest(facts.where(~F.col("tombstone")), (*keys, "path"))
    gone = facts.where("tombstone").groupBy(*keys, "path").agg(F.max("hlc").alias("_gone")).withColumnRenamed("path", "_path")
    above = F.transform(F.sequence(F.lit(1), F.size(F.split("path", r"\."))), lambda k: F.array_join(F.slice(F.split("path", r"\."), F.lit(1), k), "."))
    up = new.select(*keys, "path", F.explode(above).alias("_path"))
    killed = up.join(gone, [*keys, "_path"]).groupBy(*keys, "path").agg(F.max("_gone").alias("_gone"))
    return new.join(killed, [*keys, "path"], "left").where(F.col("_gone").isNull() | (F.col("hlc") > F.col("_gone"))).select(*keys, "path", "value")


def document_json(fields: DataFrame, keys: tuple[str, ...] = ("pk", "field")) -> DataFrame:
    """(keys, doc): nested JSON of the paths in sorted order; a leaf that is also a parent gives way to what is below it."""
    schema = fields.select(*keys).schema.add("doc", "string")

    def build(group: pd.DataFrame) -> pd.DataFrame:
        root: dict = {}
        for path, value in sorted(zip(group["path"], group["value"], strict=True)):
            at = root
            *above, leaf = path.split(".")
            for p in above:
                if not isinstance(at.get(p), dict):
                    at[p] = {}
                at = at[p]
            at[leaf] = value
        return pd.DataFrame([[*(group[k].iloc[0] for k in keys), json.dumps(root, ensure_ascii=False, sort_keys=True)]], columns=schema.names)

    return fields.groupBy(*keys).applyInPandas(build, schema)


def merge_fields(log: DataFrame, keys: tuple[str, ...] = ("pk", "field")) -> tuple[DataFrame, DataFrame]:
    """(keys, crdt_type, value) of a log whose rows carry their field's type, each merged by its own rules, and the keys in conflict.

    lww rows have hlc and value; counter rows node, inc and dec; set rows elem, node, hlc and set_op (add, or remove
    with the removed tag's node and hlc). A set has a row per element. A field written under two types is in
    conflict and has no value.
    """
    kinds = log.groupBy(*keys).agg(F.min("crdt_type").alias("_a"), F.max("crdt_type").alias("_z"))
    conflicts = kinds.where(F.col("_a") != F.col("_z")).select(*keys)
    good = log.join(kinds.where(F.col("_a") == F.col("_z")).select(*keys), [*keys], "left_semi")
    of = lambda kind: good.where(F.col("crdt_type") == kind)
    single = latest(of("lww"), keys).select(*keys, F.lit("lww").alias("crdt_type"), "value")
    counted = counter(of("counter"), keys).select(*keys, F.lit("counter").alias("crdt_type"), F.col("value").cast("string").alias("value"))
    elements = set_elements(of("set").where("set_op = 'add'"), of("set").where("set_op = 'remove'"), keys).select(*keys, F.lit("set").alias("crdt_type"), F.col("elem").alias("value"))
    return single.unionByName(counted).unionByName(elements), conflicts


def merge_types(log: DataFrame, keys: tuple[str, ...] = ("pk", "field")) -> tuple[DataFrame, DataFrame]:
    """(keys, crdt_type, place, value) of a log of all five types, and the keys in conflict: ``merge_fields`` with lists and documents.

    list rows have hlc as their id, parent, value and tombstone; document rows path, hlc, value and tombstone. A list has a row
    for each visible element, whose place is its position, a document one for each path, which is its place; so no
    value is gathered in one row, however long.
    """
    base, conflicts = merge_fields(log, keys)
    good = log.join(conflicts, [*keys], "left_anti")
    of = lambda kind: good.where(F.col("crdt_type") == kind)
    nodes = of("list").select(*keys, F.col("hlc").alias("id"), "parent", "value", F.coalesce("tombstone", F.lit(False)).alias("tombstone"))
    lists = list_order(nodes, keys).select(*keys, F.lit("list").alias("crdt_type"), F.col("pos").cast("string").alias("place"), "value")
    facts = of("document").select(*keys, "path", "hlc", "value", F.coalesce("tombstone", F.lit(False)).alias("tombstone"))
    docs = document_fields(facts, keys).select(*keys, F.lit("document").alias("crdt_type"), F.col("path").alias("place"), "value")
    return base.select(*keys, "crdt_type", F.lit(None).cast("string").alias("place"), "value").unionByName(lists).unionByName(docs), conflicts


def merge_into(state: DataFrame, changes: DataFrame, plugins: tuple = ()) -> DataFrame:
    """Field states (tbl, pk, field, hlc, value) after changes of the same columns, which plugins may veto or replace.

    A plugin may have ``before_merge``, which gets every change beside the state that it meets (old_hlc, old_value, null for none),
    ``before_write``, which gets the states that would be written in the same way, both of which return the rows that stay, changed or not,
    and ``after_merge``, which sees what is written. Plugins run in order, each on what those before it have left; of the changes that
    pass, the newest of a field counts, so that one behind a vetoed one may win.
    """
    where, names = ("tbl", "pk", "field"), ("tbl", "pk", "field", "hlc", "value")
    old = state.select(*[F.col(c).alias(f"_{c}") for c in where], F.col("hlc").alias("old_hlc"), F.col("value").alias("old_value"))
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in where]
    met = changes.select(*names).join(old, same, "left").select(*names, "old_hlc", "old_value")
    for p in plugins:
        met = p.before_merge(met) if hasattr(p, "before_merge") else met
    new = latest(met, where).join(old, same, "left").select(*names, "old_hlc", "old_value")
    new = new.where(F.col("old_hlc").isNull() | (F.col("hlc") > F.col("old_hlc")))
    for p in plugins:
        new = p.before_write(new) if hasattr(p, "before_write") else new
    if plugins:
        new = materialize(new, shared_dir(state.sparkSession), "merged")
    for p in plugins:
        if hasattr(p, "after_merge"):
            p.after_merge(new)
    written = new.select(*[F.col(c).alias(f"_{c}") for c in where])
    return state.select(*names).join(written, same, "left_anti").unionByName(new.select(*names))


def record_state(log: DataFrame, at: Column | None = None) -> DataFrame:
    """(pk, field, value) of records that are not deleted, from all of the log or from what was written up to a clock."""
    log = log.where(F.col("hlc") <= at) if at is not None else log
    writes = latest(log.where(~F.col("tombstone")))
    alive = _newest(log).where(_alive()).select("pk")
    return writes.join(alive, "pk", "left_semi").select("pk", "field", "value")


def changes_since(log: DataFrame, since: Column | None, limit: int = 0) -> DataFrame:
    """Changes after a clock, in its order; the whole clock counts, so that a page never parts equal times."""
    rows = (log.where(F.col("hlc") > since) if since is not None else log).orderBy("hlc", "pk", "field")
    return rows.limit(limit) if limit > 0 else rows


#: Microseconds of a day, by which shadow tables are partitioned.
DAY = 86_400_000_000


def shadow_write(log: DataFrame, folder: str) -> None:
    """Append changes to a shadow table, the stored log beside a table: Parquet, partitioned by the day of the clock, as syncs read by clock."""
    log.withColumn("day", F.floor(F.col("hlc.ts") / DAY).cast("long")).write.mode("append").partitionBy("day").parquet(folder)


def shadow_read(spark: SparkSession, folder: str, since: int | None = None) -> DataFrame:
    """A shadow table's changes, or those from a clock's time on, for which only the days from then on are read."""
    rows = spark.read.parquet(folder)
    if since is not None:
        rows = rows.where((F.col("day") >= since // DAY) & (F.col("hlc.ts") >= since))
    return rows.drop("day")


def field_history(log: DataFrame, pk, field: str, limit: int = 100) -> DataFrame:
    return log.where((F.col("pk") == pk) & (F.col("field") == field)).orderBy(F.desc("hlc")).limit(limit)


def clean_tombstones(log: DataFrame, before_ts: int) -> DataFrame:
    """The log without tombstones from before a time, and without what they killed: ``record_state`` stays as it was.

    A record whose newest tombstone is that old and newer than all its writes goes as a whole; of all others just old tombstones go, which
    a newer write or tombstone outdoes. From then on changes older than the time must be refused (``accepted``, ``exchange``),
    as what would tell that they are dead is gone. A record written again later begins anew, and states before the time cannot be read any more.
    """
    old = F.col("tombstone") & (F.col("hlc.ts") < before_ts)
    last = _newest(log).where((F.col("_dead.ts") < before_ts) & ~_alive())
    return log.where(~old).join(last.select("pk"), "pk", "left_anti").select(*log.columns)


def accepted(changes: DataFrame, horizon: int | None) -> tuple[DataFrame, DataFrame]:
    """(changes that may still be merged, those older than the time up to which tombstones were cleaned)."""
    late = F.coalesce(F.col("hlc.ts") < F.lit(horizon), F.lit(False)) if horizon is not None else F.lit(False)
    return changes.where(~late), changes.where(late)


def _newest(log: DataFrame) -> DataFrame:
    """Of each record the newest tombstone and the newest write."""
    return log.groupBy("pk").agg(F.max(F.when(F.col("tombstone"), F.col("hlc"))).alias("_dead"), F.max(F.when(~F.col("tombstone"), F.col("hlc"))).alias("_live"))


def _alive() -> Column:
    return F.coalesce(F.col("_dead").isNull() | (F.col("_live") > F.col("_dead")), F.lit(False))


def valid_changes(log: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(changes that can be merged, the others): a table, key and clock must be there, and a field unless it is a tombstone."""
    ok = F.col("tbl").isNotNull() & F.col("pk").isNotNull() & F.col("hlc").isNotNull() & (F.col("tombstone") | F.col("field").isNotNull())
    ok = F.coalesce(ok, F.lit(False))
    return log.where(ok), log.where(~ok)


def sync(*logs: DataFrame) -> DataFrame:
    """The log that all replicas hold after they have exchanged theirs."""
    out = logs[0]
    for x in logs[1:]:
        out = out.unionByName(x)
    return out.distinct()


def missing(there: DataFrame, here: DataFrame) -> DataFrame:
    """Changes of one log that another lacks; a field that is null, as that of a record's tombstone, is a field like others."""
    known = here.select(*[F.col(c).alias(f"_{c}") for c in _CHANGE])
    return there.join(known, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in _CHANGE], "left_anti")


def exchange(local: DataFrame, remote: DataFrame, hooks: tuple = (), horizon: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Both logs after an exchange that the local side's hooks watch over.

    A hook may have ``before_inbound`` and ``before_outbound``, which get the changes that come or go and return
    those that pass, changed or left out, or raise to stop the exchange; and ``after_inbound``, which sees what came.
    Changes older than ``horizon``, up to which the local log was cleaned, do not come in.
    """
    coming, going = _passing(local, remote, hooks, horizon)
    return sync(local, coming), sync(remote, going)


def _passing(local: DataFrame, remote: DataFrame, hooks: tuple, horizon: int | None) -> tuple[DataFrame, DataFrame]:
    coming, going = accepted(missing(remote, local), horizon)[0], missing(local, remote)
    for h in hooks:
        coming = h.before_inbound(coming) if hasattr(h, "before_inbound") else coming
        going = h.before_outbound(going) if hasattr(h, "before_outbound") else going
    for h in hooks:
        if hasattr(h, "after_inbound"):
            h.after_inbound(coming)
    return coming, going


def reported(local: DataFrame, remote: DataFrame, hooks: tuple = (), horizon: int | None = None) -> tuple[DataFrame, DataFrame, dict[str, int]]:
    """Both logs after an ``exchange``, stored, and its report, which is counted while they are written: no job reads them for it.

    pulled and pushed: changes that came and went; tombstones: those among what came; merged: writes that came and are now the newest of
    their field; conflicts: writes that came for a field for which this side had another value.
    """
    path = shared_dir(local.sparkSession)
    coming, going = _passing(local, remote, hooks, horizon)
    had = latest(local.where(~F.col("tombstone")), ("tbl", "pk", "field")).select(*[F.col(c).alias(f"_{c}") for c in ("tbl", "pk", "field", "hlc", "value")])
    met = coming.join(had, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in ("tbl", "pk", "field")], "left")
    write, known = ~F.col("tombstone"), F.col("_hlc").isNotNull()
    pulled, pushed = Observation("pulled"), Observation("pushed")
    count = lambda c, name: F.coalesce(F.sum(c.cast("long")), F.lit(0)).alias(name)
    met = met.observe(pulled, F.count(F.lit(1)).alias("pulled"), count(F.col("tombstone"), "tombstones"), count(write & known & ~F.col("value").eqNullSafe(F.col("_value")), "conflicts"), count(write & (~known | (F.col("hlc") > F.col("_hlc"))), "merged"))
    going = going.observe(pushed, F.count(F.lit(1)).alias("pushed"))
    here = materialize(local.unionByName(met.select(*local.columns)), path, "local")
    there = materialize(remote.unionByName(going.select(*remote.columns)), path, "remote")
    return here, there, {**pulled.get, **pushed.get}


#: What tells one change from another.
_CHANGE = ["tbl", "pk", "field", "hlc"]


def sync_filter(log: DataFrame, pks: list | None = None, fields: list[str] | None = None) -> DataFrame:
    """Changes of some keys and fields; tombstones of a whole record pass any filter of fields."""
    if pks is not None:
        log = log.where(F.col("pk").isin(pks))
    if fields is not None:
        log = log.where(F.col("field").isin(fields) | F.col("field").isNull() | (F.col("field") == ""))
    return log


def capture(before: DataFrame, after: DataFrame, pk: str, fields: list[str], clock: Column, table: str) -> DataFrame:
    """The log of what differs between two states of a table, with one clock: writes and tombstones."""
    both = before.select(F.col(pk).alias("_b"), F.struct(*fields).alias("b")).join(after.select(F.col(pk).alias("_a"), F.struct(*fields).alias("a")), F.col("_b") == F.col("_a"), "full")
    name = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"a.{f}").cast("string").alias("value"), (~F.col(f"a.{f}").eqNullSafe(F.col(f"b.{f}")) | F.col("_b").isNull()).alias("new")) for f in fields])
    written = both.where(F.col("_a").isNotNull()).select(F.col("_a").alias("pk"), F.explode(name).alias("x")).where(F.col("x.new")).select("pk", "x.field", "x.value", F.lit(False).alias("tombstone"))
    dead = both.where(F.col("_a").isNull()).select(F.col("_b").alias("pk"), F.lit(None).cast("string").alias("field"), F.lit(None).cast("string").alias("value"), F.lit(True).alias("tombstone"))
    return written.unionByName(dead).select(F.lit(table).alias("tbl"), "pk", "field", clock.alias("hlc"), "value", "tombstone")


def inspect(state: DataFrame) -> DataFrame:
    """A row per record with its fields as a map."""
    return state.groupBy("pk").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("field", "value")))).alias("fields"))


def running(deltas: DataFrame, key: str, order: str) -> DataFrame:
    """Each key's running total of deltas."""
    w = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return deltas.withColumn("total", F.sum("delta").over(w))


def iterate(log: DataFrame) -> Iterator:
    """Changes in the order of their clocks, one partition at a time."""
    return log.orderBy("hlc").toLocalIterator(prefetchPartitions=True)
