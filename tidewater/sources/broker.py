"""Topics: append-only logs of messages with offsets by partition, in a shared folder.

A topic holds ``data/publish=N`` (partition, offset, key, value, at) and, written after it, ``ends/publish=N`` (partition, end): the
offset after the last of each partition. A sink holds ``data/batch=N/ok=...`` and, written after it,
``commits/batch=N`` with what the batch held. What has no end or commit was not finished, and no reader sees it; whoever
does it again replaces it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from tidewater.streaming.transforms import number

MESSAGE = "partition int, offset long, key string, value string, at timestamp"


def _read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def ends(spark: SparkSession, topic: str) -> DataFrame:
    """(partition, end) of a topic."""
    return _read(spark, f"{topic}/ends", "partition int, end long, publish long").groupBy("partition").agg(F.max("end").alias("end"))


def publish(topic: str, rows: DataFrame, key: str, value: str, partitions: int = 8, order: tuple[str, ...] = ()) -> int:
    """Append messages, and return the number of this publication. A key's messages are in one partition, in ``order`` (key and value by default).

    Offsets follow on from those there are. Rows are numbered by ranges of partition and order, so that
    a partition with most of them is many tasks. One publisher at a time: a second that takes the same number fails.
    """
    spark = rows.sparkSession
    made = rows.select(F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(partitions)).cast("int").alias("partition"), F.col(key).cast("string").alias("key"), F.col(value).cast("string").alias("value"), F.struct(*(order or (key, value))).alias("_order"))
    numbered = number(made, "partition", "_order")
    first = numbered.groupBy("partition").agg(F.min("_n").alias("_first")).join(ends(spark, topic), "partition", "left")  # a row for each partition
    placed = numbered.join(F.broadcast(first), "partition").select("partition", (F.coalesce("end", F.lit(0)) + F.col("_n") - F.col("_first")).alias("offset"), "key", "value", F.current_timestamp().alias("at"))
    done = _read(spark, f"{topic}/ends", "partition int, end long, publish long").agg(F.max("publish")).first()[0]
    n = 0 if done is None else done + 1
    folder = f"{topic}/data/publish={n}"
    placed.write.mode("overwrite").parquet(folder)
    spark.read.schema(MESSAGE).parquet(folder).groupBy("partition").agg((F.max("offset") + 1).alias("end")).coalesce(1).write.mode("errorifexists").parquet(f"{topic}/ends/publish={n}")
    return n


def messages(source: DataFrame, schema: str, starting: dict[int, int] | None = None) -> DataFrame:
    """(partition, offset, key, at, data, bad): messages from the ``starting`` offsets on, parsed by a schema; ``bad`` is the text of one that does not fit."""
    if starting:
        at = F.create_map(*[F.lit(x) for kv in starting.items() for x in kv])
        source = source.where(F.col("offset") >= F.coalesce(at[F.col("partition")], F.lit(0)))
    parsed = F.from_json("value", f"{schema}, _bad string", {"columnNameOfCorruptRecord": "_bad"})
    rows = source.withColumn("_data", parsed)
    names = [f.name for f in source.sparkSession.createDataFrame([], schema).schema]
    return rows.select("partition", "offset", "key", "at", F.struct(*[F.col(f"_data.{c}").alias(c) for c in names]).alias("data"), F.when(F.col("value").isNull() | F.col("_data._bad").isNotNull(), F.coalesce("value", F.lit(""))).alias("bad"))


def subscribe(spark: SparkSession, topic: str, schema: str, starting: dict[int, int] | None = None, files_per_trigger: int = 100) -> DataFrame:
    """A stream of ``messages``, publications as they come."""
    source = spark.readStream.schema(MESSAGE).option("maxFilesPerTrigger", files_per_trigger).parquet(f"{topic}/data/*")
    return messages(source, schema, starting)


def deliver(stream: DataFrame, path: str, checkpoint: str, before_commit: Callable[[int], None] | None = None):
    """Write a stream of ``messages`` so that each is read once, whatever fails.

    A batch, good and bad messages in one pass, is written under its number, then committed with its counts and
    offsets, which are observed while it is written. A batch that failed before its commit runs again with the same messages and replaces
    what it had written.
    """

    def write(batch: DataFrame, n: int) -> None:
        seen = Observation(f"batch-{n}")
        rows = batch.withColumn("ok", F.col("bad").isNull())
        rows = rows.observe(seen, F.count(F.lit(1)).alias("n"), F.count("bad").alias("n_bad"))
        rows.write.mode("overwrite").partitionBy("ok").parquet(f"{path}/data/batch={n}")
        if before_commit:
            before_commit(n)
        spark = batch.sparkSession
        got = seen.get
        read = spark.read.parquet(f"{path}/data/batch={n}") if got["n"] else batch
        at = read.groupBy("partition").agg((F.max("offset") + 1).alias("end"), F.count(F.lit(1)).alias("n"))
        at.withColumn("n_bad", F.lit(got["n_bad"])).coalesce(1).write.mode("overwrite").parquet(f"{path}/commits/batch={n}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def commits(spark: SparkSession, path: str) -> DataFrame:
    """(partition, end, n, n_bad, batch): of each committed batch the messages and the offset after the last by partition; n_bad is that of the whole batch."""
    return _read(spark, f"{path}/commits", "partition int, end long, n long, n_bad long, batch long")


def delivered(spark: SparkSession, path: str, ok: bool = True) -> DataFrame:
    """The messages of committed batches that fit their schema, or those that do not. Of a batch without messages nothing is read."""
    known = [r.batch for r in commits(spark, path).select("batch").distinct().collect()]  # as many as folders
    rows = spark.read.option("basePath", f"{path}/data").parquet(*[f"{path}/data/batch={n}" for n in known])
    return rows.where(F.col("ok") == ok).drop("ok", "batch")


def lag(spark: SparkSession, topic: str, path: str) -> DataFrame:
    """(partition, lag): messages of a topic that a sink has not committed."""
    done = commits(spark, path).groupBy("partition").agg(F.max("end").alias("done"))
    return ends(spark, topic).join(done, "partition", "left").select("partition", (F.col("end") - F.coalesce("done", F.lit(0))).alias("lag"))
