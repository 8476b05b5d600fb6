"""Parquet tables changed by whole partitions, fixtures, paged scans and change sources."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.runtime import materialize, shared_dir


def rewrite(spark: SparkSession, path: str, partition: str, where: str, change: Callable[..., tuple[DataFrame, DataFrame]], *args, **kwargs) -> DataFrame:
    """Change a Parquet folder that is partitioned by a column, in place, and return the affected rows.

    Just the partitions with a row for which ``where`` holds are read and written; the files of all others stay.
    change: a function of ``operators.mutate`` that takes the rows, what follows here, and ``where``; it must leave
    rows in these partitions. The new rows are written to the shared folder before they replace the old.
    The driver knows partitions alone, as it does for any such folder. One writer at a time: the
    partitions are not swapped all at once, and a failure amid that leaves some of them changed.
    """
    rows = spark.read.parquet(path)
    # File paths are those of URLs, in which a plus is no space.
    folder = F.url_decode(F.replace(F.regexp_replace("_metadata.file_path", "/[^/]*$", ""), F.lit("+"), F.lit("%2B")))
    hit = {r.p: r.folder for r in rows.where(where).groupBy(F.col(partition).alias("p")).agg(F.min(folder).alias("folder")).collect()}
    mine = F.coalesce(F.col(partition).isin([v for v in hit if v is not None]), F.lit(None in hit))
    after, affected = change(rows.where(mine), *args, where=where, **kwargs)
    staged = shared_dir(spark)
    after, affected = materialize(after, staged, "after"), materialize(affected, staged, "affected")
    left = {r[0] for r in after.select(partition).distinct().collect()}
    if left - hit.keys():
        raise ValueError(f"rows would leave their partitions for {sorted(left - hit.keys(), key=str)[:5]}")
    after.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(partition).parquet(path)
    for gone in hit.keys() - left:  # no rows, and so nothing that would overwrite these
        after.drop(partition).limit(0).write.mode("overwrite").parquet(hit[gone])
    return affected


def fixtures(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """Tables of a JSON file ``[{"table": name, "records": [...]}]``; columns are inferred for each table by itself."""
    raw = spark.read.text(path, wholetext=True).select(F.from_json("value", "array<struct<table:string,records:array<variant>>>").alias("t"))
    rows = raw.select(F.explode("t").alias("t")).select("t.table", F.explode("t.records").alias("r")).select("table", F.to_json("r").alias("j"))
    folder = f"{shared_dir(spark)}/fixtures"
    rows.write.partitionBy("table").text(folder)  # one pass; each table's lines are then read as JSON by themselves
    names = [r.table for r in rows.select("table").distinct().collect()]
    return {n: spark.read.json(f"{folder}/table={n}") for n in names}


def cursor(df: DataFrame) -> Iterator:
    """Rows one at a time, with the next partition fetched ahead."""
    return df.toLocalIterator(prefetchPartitions=True)


def documents(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """(JSON lines that fit a schema, the lines that don't)."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    rows = lines.select(F.from_json("value", schema + ", _bad string", {"columnNameOfCorruptRecord": "_bad"}).alias("r")).select("r.*")
    return rows.where(F.col("_bad").isNull()).drop("_bad"), rows.where(F.col("_bad").isNotNull()).select("_bad")


def stream(spark: SparkSession, path: str, schema, files_per_trigger: int = 100) -> DataFrame:
    """New Parquet files of a folder as they come."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)
