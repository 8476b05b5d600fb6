"""A handle on tables: definitions, where their rows are, and the one hook engine that all paths use."""

from __future__ import annotations

from datetime import UTC, datetime
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.operators import mutate
from tidewater.operators.hooks import Context, Engine
from tidewater.runtime import materialize, shared_dir
from tidewater.schema import TableDef


class Database:
    def __init__(self, spark: SparkSession, folder: str | None = None):
        self.spark, self.folder, self.hooks = spark, folder, Engine()
        self.tables: dict[str, TableDef] = {}
        self.frames: dict[str, DataFrame] = {}
        self.changed: set[str] = set()
        self.plugins: dict[str, object] = {}

    def register(self, table: TableDef, frame: DataFrame | None = None) -> Database:
        self.tables[table.name] = table
        if frame is not None:
            self.frames[table.name] = frame
        return self

    def table(self, name: str) -> TableDef:
        return self.tables.get(name) or TableDef(name)

    def raw_rows(self, name: str) -> DataFrame:
        """All stored rows; those past the table's time to live are not read."""
        df = self.frames[name] if name in self.frames else self.spark.read.parquet(f"{self.folder}/{name}.parquet")
        ttl = self.table(name).ttl
        return df.where(F.expr(f"({ttl}) IS NULL OR ({ttl}) > current_timestamp()")) if ttl else df

    def rows(self, name: str, with_deleted: bool = False, operation: str = "select") -> DataFrame:
        """What queries may see: without soft-deleted rows, and through the hooks."""
        df, sd = self.raw_rows(name), self.table(name).soft_delete
        if sd and not with_deleted:
            df = df.where(F.col(sd).isNull())
        return self.hooks.scan(Context(operation, name), df)

    def stream(self, name: str, source: DataFrame) -> DataFrame:
        """A stream of a table's rows as its hooks let them be seen: filters, masks and decisions on single rows."""
        sd = self.table(name).soft_delete
        return self.hooks.stream(Context("stream", name), source.where(F.col(sd).isNull()) if sd else source)

    def use(self, plugin) -> Database:
        """Add a plugin, an object with a ``name`` and any of ``init(db)``, ``hooks(engine)`` and ``migrations()``, a group for a ``Migrator``; each name once."""
        if plugin.name in self.plugins:
            raise ValueError(f"plugin {plugin.name} is in use")
        for method, arg in (("init", self), ("hooks", self.hooks)):
            if hasattr(plugin, method):
                getattr(plugin, method)(arg)
        self.plugins[plugin.name] = plugin
        return self

    def migrations(self) -> list:
        """The migration groups of all plugins, in the order of their use."""
        return [p.migrations() for p in self.plugins.values() if hasattr(p, "migrations")]

    def create(self, table: TableDef, folder: str | None = None, partition_by: list[str] | None = None) -> DataFrame:
        """An empty table of the definition's types and flags; with a folder, stored there as Parquet, partitioned."""
        empty = self.spark.createDataFrame([], table.struct())
        if folder is not None:
            w = empty.write.mode("errorifexists")
            (w.partitionBy(*partition_by) if partition_by else w).parquet(f"{folder}/{table.name}")
            empty = self.spark.read.schema(table.struct()).parquet(f"{folder}/{table.name}")
        self.register(table, empty)
        return empty

    def drop(self, name: str) -> None:
        """Forget a table; stored files stay."""
        self.tables.pop(name, None)
        self.frames.pop(name, None)

    # Mutations. Each gives the affected rows, as RETURNING does, and the table's rows are from then on those after it.
    def _allowed(self, name: str, operation: str) -> Column:
        """Which rows every hook lets the operation change; a hook may refuse it altogether."""
        filters = self.hooks.filters(Context(operation, name), "before_mutation")
        return F.coalesce(reduce(Column.__and__, [F.expr(f"({f})") for f in filters], F.lit(True)), F.lit(False))

    def _before(self, name: str) -> DataFrame:
        """All stored rows, as a mutation reads them: what an earlier one made is written first, so that plans of many do not stack up."""
        if name in self.changed:
            self.frames[name] = materialize(self.frames[name], shared_dir(self.spark), name)
            self.changed.discard(name)
        return self.raw_rows(name)

    def _done(self, name: str, operation: str, after: DataFrame, affected: DataFrame) -> DataFrame:
        self.frames[name] = after
        self.changed.add(name)
        return self.hooks.mutated(Context(operation, name), affected)

    def _checked(self, name: str, operation: str, rows: DataFrame) -> DataFrame:
        """New rows as they may be written: with defaults; one without a required field, or that the hooks' filters don't let through, fails the job."""
        t = self.table(name)
        for f in t.fields:
            if f.flags.get("default") and f.name in rows.columns:
                rows = rows.withColumn(f.name, F.coalesce(f.name, F.expr(f.flags["default"])).cast(rows.schema[f.name].dataType))
        rows = self.hooks.written(Context(operation, name), rows).select(*rows.columns)
        need = [f.name for f in t.fields if f.name in rows.columns and ("notnull" in f.flags or "pk" in f.flags)]
        ok = reduce(Column.__and__, [F.col(c).isNotNull() for c in need], self._allowed(name, operation))
        return rows.where(F.when(ok, F.lit(True)).otherwise(F.raise_error(F.lit(f"a row may not be written to {name}")).cast("boolean")))

    def insert(self, name: str, new: DataFrame) -> DataFrame:
        t, stored = self.table(name), self._before(name)
        defaults = {f.name: f.flags["default"] for f in t.fields if f.flags.get("default")}
        number = next((f.name for f in t.fields if "autoincrement" in f.flags and f.name not in new.columns), None)
        _, rows = mutate.insert(stored, new, defaults, number)
        rows = self._checked(name, "insert", rows)
        return self._done(name, "insert", stored.unionByName(rows), rows)

    def upsert(self, name: str, new: DataFrame, update: dict[str, str] | None = None, nothing: bool = False, keys: list[str] | None = None, order: str | None = None) -> DataFrame:
        """On a conflict of the key (or ``keys``): nothing, or the columns set; rows that the hooks hide are not changed."""
        stored, ok = self._before(name), self._allowed(name, "upsert")
        keys = keys or self.table(name).pk
        own, hidden = stored.where(ok), stored.where(~ok)
        new = self._checked(name, "upsert", new).join(hidden.select(*keys), keys, "left_anti")
        after, affected = mutate.upsert(own, new, keys, update, nothing, order)
        return self._done(name, "upsert", after.unionByName(hidden), affected)

    def update(self, name: str, changes: dict[str, str | Column], where: str | Column | None = None, order: list[Column] | None = None, limit: int = 0) -> DataFrame:
        after, affected = mutate.update(self._before(name), changes, self._where(name, "update", where), order, limit, self.table(name).pk or None)
        return self._done(name, "update", after, affected)

    def delete(self, name: str, where: str | Column | None = None, force: bool = False, order: list[Column] | None = None, limit: int = 0, now: Column | None = None) -> DataFrame:
        """Softly where the table has a column for that, unless forced."""
        t = self.table(name)
        now = now if now is not None else F.lit(datetime.now(UTC))  # one time, for the table and for what is returned
        after, affected = mutate.delete(self._before(name), self._where(name, "delete", where, force), None if force else t.soft_delete, order, limit, now, t.pk or None)
        return self._done(name, "delete", after, affected)

    def together(self, **after: DataFrame) -> None:
        """Tables that change together: all are written to the shared folder, and only then do their names stand for the new rows.

        An error before leaves every table as it was.
        """
        path = shared_dir(self.spark)
        self.frames.update({name: materialize(df, path, name) for name, df in after.items()})
        self.changed -= after.keys()

    def _where(self, name: str, operation: str, where: str | Column | None, deleted: bool = False) -> Column:
        sd = self.table(name).soft_delete
        c = mutate._cond(where) & self._allowed(name, operation)
        return c & F.col(sd).isNull() if sd and not deleted else c

    def select(self, name: str | None = None, frame: DataFrame | None = None, alias: str | None = None):
        from tidewater.operators.select import Select

        return Select(self, name, frame, alias)

    def sql(self, query: str, *args, **tables: DataFrame) -> DataFrame:
        """A raw query with ``?`` arguments, over registered tables in braces: ``select * from {orders}``; hooks apply to each."""
        named = {n: self.rows(n) for n in {*self.tables, *self.frames} if "{" + n + "}" in query}
        return self.spark.sql(query, args=list(args) or None, **named, **tables)
