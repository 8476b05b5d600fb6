"""Structured Streaming: change logs folded into tables, and per-key presence with timeouts."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle


def fold_batches(changes: DataFrame, path: str, fold: Callable[[DataFrame], DataFrame], checkpoint: str, available_now: bool = True):
    """Append each micro-batch, folded, to Parquet by batch number: a batch that is run again replaces its own files.

    The fold must not depend on order or repetition, so that reading all and folding once more
    gives the state.
    """

    def write(batch: DataFrame, number: int) -> None:
        fold(batch).write.mode("overwrite").parquet(f"{path}/batch={number}")

    query = changes.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (query.trigger(availableNow=True) if available_now else query).start()


def presence_stream(updates: DataFrame, seconds: int = 30) -> DataFrame:
    """(topic, node, event, at) from a stream of (topic, node, ts): join, update, and leave after the timeout in event time."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        topic, node = key
        if state.hasTimedOut:
            (last,) = state.get
            state.remove()
            yield pd.DataFrame([[topic, node, "leave", pd.Timestamp(last, unit="ms") + pd.Timedelta(seconds=seconds)]], columns=["topic", "node", "event", "at"])
            return
        times = sorted(int(t.timestamp() * 1000) for b in batches for t in b["ts"])
        last, out = (state.get[0] if state.exists else None), []
        for t in times:
            if last is not None and t - last >= seconds * 1000:
                out.append([topic, node, "leave", pd.Timestamp(last + seconds * 1000, unit="ms")])
                last = None
            out.append([topic, node, "join" if last is None else "update", pd.Timestamp(t, unit="ms")])
            last = t if last is None else max(last, t)
        state.update((last,))
        state.setTimeoutTimestamp(max(last + seconds * 1000, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=["topic", "node", "event", "at"])

    rows = updates.withWatermark("ts", "0 seconds").select("topic", "node", F.col("ts"))
    return rows.groupBy("topic", "node").applyInPandasWithState(step, "topic string, node string, event string, at timestamp", "last long", "append", GroupStateTimeout.EventTimeTimeout)


def admissions(moves: DataFrame, capacity: int) -> DataFrame:
    """Moves (room, node, leave, seq) with ``admitted``: a node is let in while fewer than ``capacity`` are inside.

    Who is inside depends on all who came before: a room's moves go through one task in order, which sorts on
    disk if it must and keeps just those inside, ``capacity`` at most.
    """
    schema = moves.select("room", "node", "leave", "seq").schema.add("admitted", "boolean", False)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        room, inside = object(), set()
        for b in batches:
            out = []
            for at, node, leave in zip(b["room"], b["node"], b["leave"], strict=True):
                if at != room:
                    room, inside = at, set()
                if leave:
                    out.append(node in inside)
                    inside.discard(node)
                else:
                    out.append(node in inside or len(inside) < capacity)
                    if out[-1]:
                        inside.add(node)
            yield b.assign(admitted=out)[schema.names]

    return moves.select("room", "node", "leave", "seq").repartition("room").sortWithinPartitions("room", "seq").mapInPandas(run, schema)


def notify(stream: DataFrame, handlers: dict[str, Callable[[DataFrame], None]], checkpoint: str, channel: str = "channel"):
    """Each micro-batch's rows of a channel go to its handler; offsets are kept in the checkpoint, so that none is lost."""

    def route(batch: DataFrame, number: int) -> None:
        batch.persist()
        for name, handle in handlers.items():
            handle(batch.where(F.col(channel) == name))
        batch.unpersist()

    return stream.writeStream.foreachBatch(route).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


SESSION = "id long, event string, data string, at timestamp"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class _Sessions(StatefulProcessor):
    """A session's data and when it ends, in microseconds; a timer in event time for its end."""

    def __init__(self, seconds: int):
        self.ttl = seconds * 1_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("session", "data string, ends long")

    def _rows(self, key: tuple, out: list) -> Iterator[pd.DataFrame]:
        if out:
            event, data, at = zip(*out, strict=True)
            yield pd.DataFrame({"id": [key[0]] * len(out), "event": event, "data": data, "at": np.array(at, "datetime64[us]")})

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        """State and timer are read once and written once for a key's rows, not for each row: every such call goes to the JVM and back."""
        got = list(rows)
        got = got[0] if len(got) == 1 else pd.concat(got)
        ts = got["ts"].to_numpy("datetime64[us]")
        order = np.lexsort((got["seq"].to_numpy(), ts))
        ops, datas, times = got["op"].to_numpy()[order], got["data"].to_numpy()[order], ts.astype("int64")[order].tolist()
        was = tuple(self.state.get()) if self.state.exists() else None
        live, out = was, []
        for op, data, at in zip(ops, datas, times, strict=True):
            if live and live[1] <= at:
                out.append(("expire", *live))
                live = None
            if op == "delete":
                if live:
                    out.append((op, live[0], at))
                    live = None
                continue
            if op == "touch" and not live:
                continue
            live = (live[0] if op == "touch" else data), at + self.ttl
            out.append((op, live[0], at))
        if was and was != live:
            self.handle.deleteTimer(-(-was[1] // 1000))
        if live and was != live:
            self.state.update(live)
            self.handle.registerTimer(-(-live[1] // 1000))
        elif was and not live:
            self.state.clear()
        yield from self._rows(key, out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        live = tuple(self.state.get()) if self.state.exists() else None
        if live and -(-live[1] // 1000) <= expiredTimerInfo.getExpiryTimeInMs():
            self.state.clear()
            yield from self._rows(key, [("expire", *live)])

    def close(self) -> None:
        pass


def session_stream(ops: DataFrame, seconds: int, late: str = "0 seconds") -> DataFrame:
    """(id, event, data, at) from a stream of (id, op, data, ts, seq): a session store whose sessions end ``seconds`` after they were last renewed.

    create and update set the data, touch renews a session that there is, delete ends it; a session that is not renewed in time gives
    ``expire`` at its end, by a timer in event time, or before the next operation that finds it ended. State is in RocksDB, with checkpoints.
    """
    spark = ops.sparkSession
    if "RocksDB" not in spark.conf.get("spark.sql.streaming.stateStore.providerClass", ""):
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    rows = ops.select("id", "op", "data", "ts", "seq").withWatermark("ts", late)
    return rows.groupBy("id").transformWithStateInPandas(statefulProcessor=_Sessions(seconds), outputStructType=SESSION, outputMode="Append", timeMode="eventTime")


def session_events(ops: DataFrame, seconds: int) -> DataFrame:
    """The same of a table of operations, all ends included.

    Between two settings or deletions a session lives on as long as no gap reaches its time to live: of the last setting and the last such gap
    the later one tells. All windows are of one order, so that a task sorts its rows once, and what a row gives, three events at most, is
    made from it at one time.
    """
    w = Window.partitionBy("id").orderBy("ts", "seq")
    gap = F.make_interval(secs=F.lit(seconds))
    last = lambda c: F.last(c, ignorenulls=True).over(w)
    rows = ops.select("id", "op", "data", "ts", "seq").withColumns({"_prev": F.lag("ts").over(w), "_next": F.lead("ts").over(w), "_set": last(F.when(F.col("op") != "touch", F.struct("op", "data")))})
    late = F.coalesce(F.col("_prev") + gap <= F.col("ts"), F.lit(False))
    dead = last(F.when(F.col("op") != "touch", F.lit(False)).when(late, F.lit(True)))
    rows = rows.withColumn("_live", F.coalesce(F.col("_set.op").isin("create", "update") & ~dead, F.lit(False)))
    # A deletion says what it ends: the row before it, if that is not over by then.
    rows = rows.withColumns({"_was": F.lag("_live").over(w), "_of": F.lag("_set.data").over(w)})
    event = lambda when, name, data, at: F.when(when, F.struct(name.alias("event"), F.col(data).alias("data"), at.alias("at")))
    said = event(F.col("_live"), F.col("op"), "_set.data", F.col("ts"))
    gone = event((F.col("op") == "delete") & F.col("_was") & (F.col("_prev") + gap > F.col("ts")), F.lit("delete"), "_of", F.col("ts"))
    over = event(F.col("_live") & F.coalesce(F.col("ts") + gap <= F.col("_next"), F.lit(True)), F.lit("expire"), "_set.data", F.col("ts") + gap)
    made = rows.select("id", F.explode(F.array(said, gone, over)).alias("e")).where(F.col("e").isNotNull())
    return made.select("id", "e.event", "e.data", "e.at")
