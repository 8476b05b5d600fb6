"""The select builder: clauses are gathered and become one Spark SQL statement with bound arguments.

User conditions keep SQL's precedence among themselves; soft deletion and row-level
security are applied at the scan, so that no OR can go round them.
"""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewater.operators.hooks import Context


class Select:
    def __init__(self, db, name: str | None = None, frame: DataFrame | None = None, alias: str | None = None):
        self.db, self.name, self.frame = db, name, frame
        self.alias = alias or (db.table(name).alias if name else None) or (name or "t")
        self.columns: list[tuple[str, tuple]] = []
        self.wheres: list[tuple[str, str, tuple]] = []
        self.prewheres: list[tuple[str, tuple]] = []
        self.joins: list[tuple[str, tuple, dict]] = []
        self.groups: list[str] = []
        self.havings: list[tuple[str, tuple]] = []
        self.orders: list[str] = []
        self.relations: list[str] = []
        self.set_ops: list[tuple[str, DataFrame]] = []
        self.distinct_keys: list[str] = []
        self.n = self.skip = 0
        self.deleted = self.merged = False
        self.fraction: tuple[float, str] | None = None

    # Projection
    def column(self, *names: str) -> Select:
        self.columns += [(n, ()) for n in names]
        return self

    def column_expr(self, expr: str, *args: Any) -> Select:
        self.columns.append((expr, args))
        return self

    # Conditions
    def where(self, condition: str, *args: Any) -> Select:
        self.wheres.append(("AND", condition, args))
        return self

    def where_or(self, condition: str, *args: Any) -> Select:
        self.wheres.append(("OR", condition, args))
        return self

    def where_array(self, column: str, op: str, values: list) -> Select:
        """``= ANY`` or ``<> ALL`` of the values; as in SQL, a null among them makes the latter never true."""
        marks = ", ".join("?" * len(values))
        known = {"= ANY": f"{column} IN ({marks})", "<> ALL": f"{column} NOT IN ({marks})"}
        if not values:
            return self.where("false" if op == "= ANY" else "true")
        return self.where(known[op.upper()], *values)

    def where_pk(self, *values: Any) -> Select:
        pk = self.db.table(self.name).pk
        if not pk or len(pk) != len(values):
            raise ValueError(f"{self.name}: {len(values)} values for the primary key {pk}")
        for k, v in zip(pk, values, strict=True):
            self.where(f"{self.alias}.{k} = ?", v)
        return self

    def prewhere(self, condition: str, *args: Any) -> Select:
        """A condition that holds before versions are merged."""
        self.prewheres.append((condition, args))
        return self

    def search_after(self, columns: list[str], values: list) -> Select:
        """Rows strictly after the values in ascending order of the columns."""
        steps, args = [], []
        for k, c in enumerate(columns):
            steps.append("(" + " AND ".join([f"{e} = ?" for e in columns[:k]] + [f"{c} > ?"]) + ")")
            args += values[: k + 1]
        return self.where("(" + " OR ".join(steps) + ")", *args)

    def with_deleted(self) -> Select:
        self.deleted = True
        return self

    def final(self) -> Select:
        """One row per sort key, by the table's engine."""
        self.merged = True
        return self

    def sample(self, n: float, key: str) -> Select:
        """A fixed share of rows by the hash of a key; of one or more, about that many rows."""
        self.fraction = (n, key)
        return self

    # Joins
    def join(self, kind: str, table: str | DataFrame, on: str = "", *args: Any, alias: str | None = None) -> Select:
        """kind: any join of Spark SQL (JOIN, LEFT JOIN, FULL JOIN, LEFT SEMI JOIN, CROSS JOIN ...)."""
        key = f"j{len(self.joins)}"
        df = self.db.rows(table) if isinstance(table, str) else table
        name = alias or (self.db.table(table).alias or table if isinstance(table, str) else key)
        self.joins.append((f"{kind} {{{key}}} AS {name}" + (f" ON {on}" if on else ""), args, {key: df}))
        return self

    def lateral(self, query: str, alias: str, *args: Any, left: bool = False, **tables: DataFrame) -> Select:
        self.joins.append((f"{'LEFT' if left else 'INNER'} JOIN LATERAL ({query}) AS {alias}" + (" ON true" if left else ""), args, tables))
        return self

    # Groups, order, pages
    def group(self, *exprs: str) -> Select:
        self.groups += exprs
        return self

    def having(self, condition: str, *args: Any) -> Select:
        self.havings.append((condition, args))
        return self

    def order(self, *exprs: str) -> Select:
        self.orders += exprs
        return self

    def limit(self, n: int) -> Select:
        """0 or less: no limit."""
        self.n = n
        return self

    def offset(self, n: int) -> Select:
        self.skip = n
        return self

    def distinct_on(self, *columns: str) -> Select:
        """The first row of each key in the stated order."""
        self.distinct_keys += columns
        return self

    def for_update(self, *tables: str) -> Select:
        """Nothing to lock: reads are of snapshots."""
        return self

    for_share = for_update

    def union(self, other: Select | DataFrame, all_rows: bool = False) -> Select:
        return self._set("UNION ALL" if all_rows else "UNION", other)

    def intersect(self, other: Select | DataFrame, all_rows: bool = False) -> Select:
        return self._set("INTERSECT ALL" if all_rows else "INTERSECT", other)

    def except_(self, other: Select | DataFrame, all_rows: bool = False) -> Select:
        return self._set("EXCEPT ALL" if all_rows else "EXCEPT", other)

    def _set(self, op: str, other: Select | DataFrame) -> Select:
        self.set_ops.append((op, other.df() if isinstance(other, Select) else other))
        return self

    def relation(self, name: str) -> Select:
        self.relations.append(name)
        return self

    # Running
    def source(self) -> DataFrame:
        """The scanned rows: prewhere, merging, then what hooks and soft deletion leave, then the sample."""
        if self.frame is not None:
            df, table = self.frame, None
        else:
            df, table = self.db.raw_rows(self.name), self.db.table(self.name)
        for c, args in self.prewheres:
            df = self.db.spark.sql(f"SELECT * FROM {{t}} AS {self.alias} WHERE {c}", args=list(args) or None, t=df)
        if self.merged and table is not None:
            df = merge_versions(df, table)
        if table is not None:
            if table.soft_delete and not self.deleted:
                df = df.where(F.col(table.soft_delete).isNull())
            df = self.db.hooks.scan(Context("select", self.name), df)
        if self.fraction:
            n, key = self.fraction
            share = n if n < 1 else min(1.0, n / max(1, df.count()))
            df = df.where(F.pmod(F.xxhash64(key), F.lit(1_000_000)) < int(share * 1_000_000))
        return df

    def _condition(self) -> tuple[str, list]:
        text, args = "", []
        for k, (op, c, a) in enumerate(self.wheres):
            text += f" {op} {c}" if k else c
            args += a
        return text, args

    def _statement(self, columns: list[tuple[str, tuple]], paged: bool) -> DataFrame:
        args: list = [a for _, given in columns for a in given]
        text = f"SELECT {', '.join(c for c, _ in columns) or '*'} FROM {{base}} AS {self.alias}"
        frames = {"base": self.source()}
        for clause, given, tables in self.joins:
            text += f" {clause}"
            args += given
            frames |= tables
        where, given = self._condition()
        if where:
            text += f" WHERE ({where})"
            args += given
        if self.groups:
            text += f" GROUP BY {', '.join(self.groups)}"
        if self.havings:
            text += " HAVING " + " AND ".join(f"({c})" for c, _ in self.havings)
            args += [a for _, given in self.havings for a in given]
        if paged and not self.distinct_keys and not self.set_ops:
            text += self._page()
        return self.db.spark.sql(text, args=args or None, **frames)

    def _page(self) -> str:
        text = f" ORDER BY {', '.join(self.orders)}" if self.orders else ""
        text += f" LIMIT {int(self.n)}" if self.n > 0 else ""
        return text + (f" OFFSET {int(self.skip)}" if self.skip > 0 else "")

    def df(self) -> DataFrame:
        df = self._statement(self.columns, True)
        if self.distinct_keys:
            order = [F.expr(o) if not o.split()[1:] else _order(o) for o in self.orders] or [F.lit(1)]
            df = df.withColumn("_n", F.row_number().over(Window.partitionBy(*self.distinct_keys).orderBy(*order))).where(F.col("_n") == 1).drop("_n")
        for op, other in self.set_ops:
            df = self.db.spark.sql(f"SELECT * FROM {{a}} {op} SELECT * FROM {{b}}", a=df, b=other)
        if self.distinct_keys or self.set_ops:
            df = self.db.spark.sql("SELECT * FROM {t}" + self._page(), t=df)
        if self.relations:
            from tidewater.operators.relations import load

            for r in self.relations:
                df = load(self.db, df, self.name, r)
        return self.db.hooks.result(Context("select", self.name or self.alias), df) if self.name else df

    def count(self) -> DataFrame:
        """``n``, after conditions; with groups a row per group, with the group's columns."""
        columns = [(g, ()) for g in self.groups] + [("count(*) AS n", ())]
        return self._statement(columns, False)


def _order(text: str):
    """A column with its direction: ``name DESC NULLS LAST``."""
    words = text.split()
    tail = [w.upper() for w in words[1:]]
    c = F.col(words[0])
    last = "LAST" in tail if "NULLS" in tail else "DESC" in tail
    if "DESC" in tail:
        return c.desc_nulls_last() if last else c.desc_nulls_first()
    return c.asc_nulls_last() if last else c.asc_nulls_first()


def merge_versions(df: DataFrame, table) -> DataFrame:
    """FINAL: replacing keeps the last version of a key, summing adds up numbers, collapsing cancels signs."""
    key = list(table.sort_key or table.pk)
    if table.engine == "replacing":
        # A limit of one row per key works before the shuffle too, and columns nobody asks for are not read.
        order = [F.desc(table.version)] if table.version else []
        order += [F.desc(c) for c in table.pk if c not in key] or [F.xxhash64(*[c for c in df.columns if c not in key])]
        w = Window.partitionBy(*key).orderBy(*order)
        return df.withColumn("_n", F.row_number().over(w)).where(F.col("_n") == 1).drop("_n")
    if table.engine == "summing":
        numeric = {f.name for f in df.schema if f.dataType.typeName() in ("byte", "short", "integer", "long", "float", "double") or f.dataType.typeName().startswith("decimal")}
        aggs = [(F.sum(c) if c in numeric else F.min(c)).alias(c) for c in df.columns if c not in key]
        return df.groupBy(*key).agg(*aggs).select(*df.columns)
    if table.engine == "collapsing":
        rest = [c for c in df.columns if c not in key and c != table.version]
        left = df.groupBy(*key, *rest).agg(F.sum(table.version).alias("_s")).where(F.col("_s") > 0)
        return left.withColumn(table.version, F.lit(1)).drop("_s").select(*df.columns)
    return df
