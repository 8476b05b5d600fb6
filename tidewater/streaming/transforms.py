"""Row streams as DataFrames: the same functions serve batch and streaming where Spark can do both."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewater.runtime import materialize, shared_dir


def map_rows(df: DataFrame, **columns: Column | str) -> DataFrame:
    return df.select(*[(F.expr(c) if isinstance(c, str) else c).alias(n) for n, c in columns.items()])


def filter_rows(df: DataFrame, condition: str | Column) -> DataFrame:
    return df.where(F.expr(condition) if isinstance(condition, str) else condition)


def take(df: DataFrame, n: int, *order: str) -> DataFrame:
    return (df.orderBy(*order) if order else df).limit(n)


def chunk(df: DataFrame, size: int, *order: str, by: str | None = None) -> DataFrame:
    """Adds ``chunk``, from 0: each holds ``size`` rows in order, the last of a stream the rest.

    With ``by`` every key is a stream of its own. Rows are stored in order by ranges and numbered from
    the ranges' counts, so that no one task sorts them all, or all of one key.
    """
    if by is None:
        return number(df, *order).withColumn("chunk", F.floor((F.col("_n") - 1) / size).cast("long")).drop("_n")
    rows = number(df, by, *order)
    first = rows.groupBy(F.col(by).alias("_by")).agg(F.min("_n").alias("_first"))
    rows = rows.join(first, F.col(by).eqNullSafe(F.col("_by")))
    return rows.withColumn("chunk", F.floor((F.col("_n") - F.col("_first")) / size).cast("long")).drop("_n", "_by", "_first")


def ordered(df: DataFrame, *order) -> tuple[DataFrame, Callable[..., DataFrame]]:
    """The rows, stored once in order by ranges, with ``_m``: the range in its high bits and the place in it, from 0, in the low 33.

    Also a function from a sum over each range's rows to (_p, _a): what it is over all ranges before. Numbers, counts and sums are
    all read from the same files, so that ranges cannot be drawn or merged differently between them.
    """
    parts = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_m", F.monotonically_increasing_id())
    stored = materialize(parts, shared_dir(df.sparkSession), "ordered")

    def ahead(amount: Column) -> DataFrame:
        """A row for each range, so that one window over them is short."""
        size = stored.groupBy(F.shiftright("_m", 33).alias("_p")).agg(amount.alias("_s"))
        return size.select("_p", F.coalesce(F.sum("_s").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_a"))

    return stored, ahead


def number(df: DataFrame, *order) -> DataFrame:
    """Adds ``_n``, from 1 in order: a row's place in its range, on from the rows of the ranges before."""
    stored, ahead = ordered(df, *order)
    place = F.col("_m").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    return stored.join(F.broadcast(ahead(F.count(F.lit(1)))), F.shiftright("_m", 33) == F.col("_p")).withColumn("_n", place + F.col("_a")).drop("_m", "_p", "_a")


def before(df: DataFrame, amount: str, *order) -> DataFrame:
    """Adds ``_b``: the sum of ``amount`` over all rows before each in order, by the ranges of ``ordered``."""
    stored, ahead = ordered(df, *order)
    rows = Window.partitionBy("_p").orderBy("_m").rowsBetween(Window.unboundedPreceding, -1)
    local = stored.withColumn("_p", F.shiftright("_m", 33)).withColumn("_l", F.coalesce(F.sum(amount).over(rows), F.lit(0)))
    return local.join(F.broadcast(ahead(F.sum(amount))), "_p").withColumn("_b", F.col("_l") + F.col("_a")).drop("_m", "_p", "_l", "_a")


def fold(df: DataFrame, initial: Any, step: Callable[[Any, Any], Any], *order: str) -> Any:
    """A fold that needs its order, on the driver, a partition at a time; for what no aggregate expresses."""
    for row in df.orderBy(*order).toLocalIterator(prefetchPartitions=True):
        initial = step(initial, row)
    return initial


def pages(df: DataFrame, key: str, size: int) -> Iterator[DataFrame]:
    """Pages of rows in the order of a unique key, each from the last key of the page before."""
    last = None
    while True:
        page = (df if last is None else df.where(F.col(key) > last)).orderBy(key).limit(size)
        top = page.agg(F.max(key)).first()[0]
        if top is None:
            return
        yield page
        last = top


def scroll(df: DataFrame, size: int, *order) -> Iterator[DataFrame]:
    """Pages of a stable snapshot: the rows are stored once, in order, and each page reads its own numbers of them, whatever happens to the source meanwhile."""
    if size < 1:
        raise ValueError("a page has at least one row")
    stored = materialize(number(df, *order), shared_dir(df.sparkSession), "snapshot")
    total = stored.agg(F.max("_n")).first()[0] or 0
    for first in range(1, total + 1, size):
        yield stored.where((F.col("_n") >= first) & (F.col("_n") < first + size)).orderBy("_n").drop("_n")


def each(df: DataFrame, f: Callable) -> None:
    for row in df.toLocalIterator():
        f(row)


def checked(df: DataFrame, condition: str, message: str) -> DataFrame:
    """Fails at the first row that does not meet the condition."""
    ok = F.coalesce(F.expr(condition), F.lit(False))
    return df.where(F.when(ok, F.lit(True)).otherwise(F.raise_error(F.lit(message)).cast("boolean")))


def apply_changes(table: DataFrame, events: DataFrame, key: str, order: str = "seq") -> DataFrame:
    """The table after change events (op, key, ``order``, other columns): the last event of each key decides."""
    rest = [c for c in table.columns if c != key]
    last = events.groupBy(key).agg(F.max_by(F.struct("op", *rest), order).alias("e"))
    kept = table.join(last.select(key), key, "left_anti")
    new = last.where(F.upper("e.op") != "DELETE").select(key, *[F.col(f"e.{c}").alias(c) for c in rest])
    return kept.select(*table.columns).unionByName(new.select(*table.columns))


def tumbling(events: DataFrame, ts: str, width: str, *keys: str, aggs: list[Column], late: str | None = None) -> DataFrame:
    """Windows of one width; ``late`` bounds how far behind the newest event a streaming one may be."""
    rows = events.withWatermark(ts, late) if late else events
    return rows.groupBy(*keys, F.window(ts, width).alias("w")).agg(*aggs).select(*keys, F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *[c for c in _names(aggs)])


def sliding(events: DataFrame, ts: str, width: str, step: str, *keys: str, aggs: list[Column], late: str | None = None) -> DataFrame:
    rows = events.withWatermark(ts, late) if late else events
    return rows.groupBy(*keys, F.window(ts, width, step).alias("w")).agg(*aggs).select(*keys, F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *_names(aggs))


def sessions(events: DataFrame, ts: str, gap: str, *keys: str, aggs: list[Column], late: str | None = None) -> DataFrame:
    """Runs of events of a key with less than the gap between them."""
    rows = events.withWatermark(ts, late) if late else events
    return rows.groupBy(*keys, F.session_window(ts, gap).alias("w")).agg(*aggs).select(*keys, F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), *_names(aggs))


def _names(aggs: list[Column]) -> list[str]:
    return [a._jc.toString().rsplit(" AS ", 1)[-1].strip("`") for a in aggs]


def distinct_within(events: DataFrame, ts: str, late: str, *keys: str) -> DataFrame:
    """The first event of each key, of those within the bound for late ones."""
    return events.withWatermark(ts, late).dropDuplicatesWithinWatermark(list(keys))


def presence(updates: DataFrame, now: Column, seconds: int = 30) -> DataFrame:
    """(topic, node, data): the last update of each node of a topic, unless it left or its time ran out."""
    last = updates.groupBy("topic", "node").agg(F.max_by(F.struct("data", "leave", "ts"), "ts").alias("u"))
    return last.where(~F.col("u.leave") & (F.col("u.ts") + F.make_interval(secs=F.lit(seconds)) > now)).select("topic", "node", "u.data")


def presence_events(updates: DataFrame, seconds: int = 30) -> DataFrame:
    """Each update as join or update, and a leave where a node left or was not heard of in time."""
    w = Window.partitionBy("topic", "node").orderBy("ts")
    gap = F.make_interval(secs=F.lit(seconds))
    rows = updates.withColumn("_prev", F.lag("ts").over(w)).withColumn("_left", F.lag("leave").over(w)).withColumn("_next", F.lead("ts").over(w))
    fresh = F.col("_prev").isNull() | F.col("_left") | (F.col("_prev") + gap <= F.col("ts"))
    said = rows.select("topic", "node", "ts", F.when(F.col("leave"), "leave").when(fresh, "join").otherwise("update").alias("event"))
    timed = rows.where(~F.col("leave") & F.col("_next").isNotNull() & (F.col("ts") + gap <= F.col("_next"))).select("topic", "node", (F.col("ts") + gap).alias("ts"), F.lit("leave").alias("event"))
    return said.unionByName(timed)


def occupancy(moves: DataFrame, room: str, ts: str) -> DataFrame:
    """Each move (delta +1 or -1) with the number in the room after it.

    Sums run over all moves by ranges of room and time, less what was before a room's first, so that a room with most
    of them is no single task. Moves of one room at one time are ordered by their delta, arrivals last.
    """
    rows = before(moves, "delta", room, ts, "delta")
    first = rows.groupBy(F.col(room).alias("_room")).agg(F.min_by("_b", F.struct(ts, "delta")).alias("_first"))
    rows = rows.join(first, F.col(room).eqNullSafe(F.col("_room")))
    return rows.withColumn("inside", F.col("_b") + F.col("delta") - F.col("_first")).drop("_b", "_room", "_first")
