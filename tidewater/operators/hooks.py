"""Hooks: row-level security, masking, audit and metrics, by table and operation, in order of priority.

A hook is an object with any of these methods, each of which gets the context first:
``before_query`` and ``before_mutation`` return None (allow), a string or list of strings
(filters, SQL, all of which rows must meet) or raise ``Denied``; ``at_scan`` returns the rows that
all of a query works on; ``after_query`` returns the result that callers get; ``after_mutation`` sees the affected rows;
``before_write`` gets the rows that an insert or upsert would write, defaults set, and returns them as they shall be;
``on_stream_row`` gives SQL that decides on each row of a stream: ``'allow'`` or null, ``'skip'``, or ``'deny'``, which ends it with an error.
"""

from __future__ import annotations

import time
from collections import Counter
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F


class Denied(Exception):
    """A hook refused the operation."""


@dataclass
class Context:
    operation: str
    table: str
    values: dict = field(default_factory=dict)


class Engine:
    def __init__(self) -> None:
        self.hooks: list[tuple[int, int, object, frozenset, frozenset]] = []

    def add(self, hook: object, tables: tuple[str, ...] = (), operations: tuple[str, ...] = (), priority: int = 100) -> None:
        """Smaller priorities run first, equal ones as added; no tables or operations means all."""
        self.hooks.append((priority, len(self.hooks), hook, frozenset(tables), frozenset(operations)))
        self.hooks.sort(key=lambda x: x[:2])

    def _for(self, ctx: Context, method: str):
        for _, _, hook, tables, operations in self.hooks:
            if (not tables or ctx.table in tables) and (not operations or ctx.operation in operations) and hasattr(hook, method):
                yield getattr(hook, method)

    def filters(self, ctx: Context, method: str = "before_query") -> list[str]:
        out: list[str] = []
        for f in self._for(ctx, method):
            got = f(ctx)
            out += [got] if isinstance(got, str) else list(got or ())
        return out

    def scan(self, ctx: Context, df: DataFrame) -> DataFrame:
        """The rows that every matching hook lets through, as it lets them be seen, whatever else the query says."""
        for f in self.filters(ctx):
            df = df.where(F.expr(f))
        for f in self._for(ctx, "at_scan"):
            df = f(ctx, df)
        return df

    def stream(self, ctx: Context, df: DataFrame) -> DataFrame:
        """The rows of a stream that the hooks let through. Each hook decides on what those before it have left, as part of the stream's own plan."""
        df = self.scan(ctx, df)
        for f in self._for(ctx, "on_stream_row"):
            said = F.coalesce(F.expr(f(ctx)), F.lit("allow"))
            denied = F.raise_error(F.lit(f"a row of {ctx.table} is denied")).cast("boolean")
            df = df.where(F.when(said == "deny", denied).otherwise(said != "skip"))
        return df

    def result(self, ctx: Context, df: DataFrame) -> DataFrame:
        for f in self._for(ctx, "after_query"):
            df = f(ctx, df)
        return df

    def written(self, ctx: Context, rows: DataFrame) -> DataFrame:
        for f in self._for(ctx, "before_write"):
            rows = f(ctx, rows)
        return rows

    def mutated(self, ctx: Context, affected: DataFrame) -> DataFrame:
        """The affected rows; a hook that returns rows, such as the same ones observed, stands for those that callers get."""
        for f in self._for(ctx, "after_mutation"):
            got = f(ctx, affected)
            affected = got if isinstance(got, DataFrame) else affected
        return affected


class RowFilter:
    """Row-level security by a SQL condition, for reads and writes alike."""

    def __init__(self, condition: str):
        self.condition = condition

    def before_query(self, ctx: Context) -> str:
        return self.condition

    before_mutation = before_query


class Mask:
    """Replaces columns by expressions of themselves where a table is scanned: no alias, group, join, relation or raw query shows the others."""

    def __init__(self, columns: dict[str, str]):
        self.columns = columns

    def at_scan(self, ctx: Context, df: DataFrame) -> DataFrame:
        return df.withColumns({c: F.expr(e) for c, e in self.columns.items() if c in df.columns})


class Audit:
    """Keeps a DataFrame of (operation, table, n) per mutation; ``entries`` unions them."""

    def __init__(self) -> None:
        self.parts: list[DataFrame] = []

    def after_mutation(self, ctx: Context, affected: DataFrame) -> None:
        self.parts.append(affected.agg(F.count(F.lit(1)).alias("n")).select(F.lit(ctx.operation).alias("operation"), F.lit(ctx.table).alias("table"), "n"))

    def entries(self) -> DataFrame:
        out = self.parts[0]
        for p in self.parts[1:]:
            out = out.unionAll(p)
        return out


class Metrics:
    """Counts operations, the seconds between their start and end on the driver, and the rows that they gave.

    Rows are observed on the plans that callers run, so that no job runs for them; they count once a result has been
    read whole.
    """

    def __init__(self) -> None:
        self.count: Counter = Counter()
        self.seconds: Counter = Counter()
        self.seen: list[tuple[str, str, Observation]] = []

    def before_query(self, ctx: Context) -> None:
        self.count[ctx.operation, ctx.table] += 1
        ctx.values["began"] = time.monotonic()

    def after_query(self, ctx: Context, df: DataFrame) -> DataFrame:
        self.seconds[ctx.operation, ctx.table] += time.monotonic() - ctx.values.get("began", time.monotonic())
        return self._observed(ctx, df)

    def after_mutation(self, ctx: Context, affected: DataFrame) -> DataFrame:
        self.count[ctx.operation, ctx.table] += 1
        return self._observed(ctx, affected)

    def _observed(self, ctx: Context, df: DataFrame) -> DataFrame:
        if df.isStreaming:
            return df
        seen = Observation()
        self.seen.append((ctx.operation, ctx.table, seen))
        return df.observe(seen, F.count(F.lit(1)).alias("n"))

    def snapshot(self) -> list[tuple[str, str, int, float, int]]:
        """(operation, table, operations, seconds, rows) so far."""
        rows: Counter = Counter()
        for operation, table, seen in self.seen:
            if seen._jo is not None and seen._jo.future().isCompleted():
                rows[operation, table] += seen.get["n"]
        return [(*k, n, self.seconds[k], rows[k]) for k, n in sorted(self.count.items())]
