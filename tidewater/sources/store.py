"""Stored tables that change together: a manifest, written last, names the folders of every table's partitions.

A transaction writes new folders beside the old ones and then one manifest file, ``manifest/version=N``. Readers take the
largest version: they see all of a transaction or nothing of it, and what they read stays, as no file is ever
changed. A partition that a transaction leaves alone keeps its folder. The driver holds a row for each partition, as a catalog does.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

ROW = "table string, by string, part string, folder string, schema string, writer string"


class Conflict(Exception):
    """Another writer has made the version that a transaction was about to make."""


class Store:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def versions(self) -> list[int]:
        try:
            rows = self.spark.read.schema(f"{ROW}, version long").parquet(f"{self.root}/manifest")
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return []
        return sorted(r.version for r in rows.select("version").distinct().collect())

    def manifest(self, version: int | None = None) -> list[dict]:
        """A row for each partition of each table; one without partition column has a single row, an empty one a row without folder."""
        if version is None:
            known = self.versions()
            if not known:
                return []
            version = known[-1]
        return [r.asDict() for r in self.spark.read.schema(ROW).parquet(f"{self.root}/manifest/version={version}").collect()]

    def read(self, name: str, version: int | None = None, parts: list | None = None) -> DataFrame:
        """A table as of a version, by default the newest; of some partitions, if named."""
        return self._rows([r for r in self.manifest(version) if r["table"] == name], name, parts)

    def _rows(self, rows: list[dict], name: str, parts: list | None = None) -> DataFrame:
        if not rows:
            raise KeyError(name)
        schema = StructType.fromJson(json.loads(rows[0]["schema"]))
        folders = [r["folder"] for r in rows if r["folder"] and (parts is None or r["part"] in parts)]
        return self.spark.read.schema(schema).parquet(*folders) if folders else self.spark.createDataFrame([], schema)

    def transaction(self) -> Transaction:
        return Transaction(self)


class Transaction:
    """Changes that hold together: ``with store.transaction() as t``. An error before the end leaves every table as it was."""

    def __init__(self, store: Store):
        self.store, self.spark = store, store.spark
        known = store.versions()
        self.base = known[-1] if known else -1
        self.rows = store.manifest(self.base) if known else []
        self.writer = uuid.uuid4().hex

    def __enter__(self) -> Transaction:
        return self

    def __exit__(self, kind, *_) -> None:
        if kind is None:
            self.commit()

    def read(self, name: str, parts: list | None = None) -> DataFrame:
        """A table as this transaction sees it."""
        return self.store._rows([r for r in self.rows if r["table"] == name], name, parts)

    def put(self, name: str, df: DataFrame, by: str | None = None) -> None:
        """A whole table, new or in place of the old, partitioned by a column."""
        self._replace(name, df, by, None)

    def drop(self, name: str) -> None:
        """Without a table from the next version on; older versions keep it."""
        self.rows = [r for r in self.rows if r["table"] != name]

    def change(self, name: str, change: Callable[..., tuple[DataFrame, DataFrame]], *args, where: str, **kwargs) -> DataFrame:
        """Apply a function of ``operators.mutate`` to a table and return the affected rows. Just partitions with a row for which ``where`` holds are read and written."""
        by = next((r["by"] for r in self.rows if r["table"] == name), None)
        rows = self.read(name)
        hit = None
        if by is not None:
            hit = [r.p for r in rows.where(where).select(F.col(by).cast("string").alias("p")).distinct().collect()]
            rows = self.read(name, hit)
        after, affected = change(rows, *args, where=where, **kwargs)
        affected = self._write(f"{name}/affected", affected)
        self._replace(name, after, by, hit)
        return affected

    def _write(self, name: str, df: DataFrame) -> DataFrame:
        folder = f"{self.store.root}/data/{name}-{self.writer}-{uuid.uuid4().hex[:8]}"
        df.write.parquet(folder)
        return self.spark.read.schema(df.schema).parquet(folder)

    def _replace(self, name: str, df: DataFrame, by: str | None, parts: list | None) -> None:
        folder = f"{self.store.root}/data/{name}-{self.writer}-{uuid.uuid4().hex[:8]}"
        schema = df.schema.json()
        if by is None:
            df.write.parquet(folder)
            made = [{"part": None, "folder": folder}]
        else:
            # The column stays in the files, so that its type and values do not depend on the folders' names.
            named = df.withColumn("_null", F.col(by).isNull()).withColumn("_part", F.sha2(F.coalesce(F.col(by).cast("string"), F.lit("")), 256))
            named.write.partitionBy("_null", "_part").parquet(folder)
            left = self.spark.read.schema(named.schema).parquet(folder).select("_null", "_part", F.col(by).cast("string").alias("p")).distinct().collect()
            made = [{"part": r.p, "folder": f"{folder}/_null={str(r['_null']).lower()}/_part={r['_part']}"} for r in left]
            outside = {r["part"] for r in made} - set(parts) if parts is not None else set()
            if outside:
                raise ValueError(f"rows would leave their partitions for {sorted(map(str, outside))[:5]}")
        stay = [r for r in self.rows if r["table"] != name or parts is not None and r["folder"] and r["part"] not in parts]
        made = made or [{"part": None, "folder": None}] * (not any(r["table"] == name for r in stay))
        self.rows = stay + [{"table": name, "by": by, "schema": schema, **m} for m in made]

    def commit(self) -> int:
        """The number of the new version."""
        n = self.base + 1
        rows = [{**r, "writer": self.writer} for r in self.rows] or [{"writer": self.writer}]
        order = [c.split()[0] for c in ROW.split(", ")]
        target = f"{self.store.root}/manifest/version={n}"
        try:
            self.spark.createDataFrame([tuple(r.get(c) for c in order) for r in rows], ROW).coalesce(1).write.mode("errorifexists").parquet(target)
        except AnalysisException as e:
            if e.getCondition() != "PATH_ALREADY_EXISTS":
                raise
            raise Conflict(f"version {n} is there") from e
        writers = {r.writer for r in self.spark.read.schema(ROW).parquet(target).select("writer").distinct().collect()}
        if writers != {self.writer}:
            raise Conflict(f"version {n} has been written twice")
        return n

