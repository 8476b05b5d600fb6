"""Ordered migrations: groups with dependencies, a plan over them, and a history table."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Migration:
    version: str
    up: Callable
    down: Callable | None = None
    group: str = ""


@dataclass
class Group:
    name: str
    after: tuple[str, ...] = ()
    migrations: list[Migration] = field(default_factory=list)

    def register(self, *found: Migration) -> Group:
        for m in found:
            if any(x.version == m.version for x in self.migrations):
                raise ValueError(f"{self.name} has version {m.version} twice")
            self.migrations.append(Migration(m.version, m.up, m.down, self.name))
        return self


def plan(groups: list[Group]) -> list[Migration]:
    """Groups after those that they depend on, and versions ascending within each; a cycle or an unknown name is an error."""
    named, done, out, under = {g.name: g for g in groups}, set(), [], []

    def visit(name: str) -> None:
        if name in done:
            return
        if name in under:
            raise ValueError("cycle: " + " -> ".join([*under, name]))
        if name not in named:
            raise ValueError(f"unknown group {name}")
        under.append(name)
        for d in named[name].after:
            visit(d)
        under.pop()
        done.add(name)
        out.extend(sorted(named[name].migrations, key=lambda m: m.version))

    for g in groups:
        visit(g.name)
    return out


class Migrator:
    """Runs a plan against a context and keeps (id, grp, version) of what was applied as a table."""

    SCHEMA = "id long, grp string, version string"

    def __init__(self, spark: SparkSession, groups: list[Group], history: DataFrame | None = None):
        self.spark, self.plan = spark, plan(groups)
        self.history = history if history is not None else spark.createDataFrame([], self.SCHEMA)

    def _known(self) -> DataFrame:
        return self.spark.createDataFrame([(i, m.group, m.version) for i, m in enumerate(self.plan)], "place int, grp string, version string")

    def status(self) -> DataFrame:
        """(grp, version, applied) in the order of the plan."""
        seen = self.history.select("grp", "version", F.lit(True).alias("applied")).distinct()
        return self._known().join(seen, ["grp", "version"], "left").orderBy("place").select("grp", "version", F.coalesce("applied", F.lit(False)).alias("applied"))

    def migrate(self, context) -> list[str]:
        """Apply what is pending; after a failure, what was applied before it stays recorded."""
        pending = {(r.grp, r.version) for r in self.status().where(~F.col("applied")).collect()}
        top, done = self.history.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0], []
        try:
            for m in self.plan:
                if (m.group, m.version) in pending:
                    m.up(context)
                    done.append(m)
        finally:
            if done:
                rows = [(top + i, m.group, m.version) for i, m in enumerate(done, 1)]
                self.history = self.history.unionAll(self.spark.createDataFrame(rows, self.SCHEMA))
        return [m.version for m in done]

    def rollback(self, context) -> str | None:
        """Undo the last that was applied."""
        last = self.history.orderBy(F.desc("id")).first()
        if last is None:
            return None
        m = next(m for m in self.plan if (m.group, m.version) == (last.grp, last.version))
        if m.down is None:
            raise ValueError(f"{m.group} {m.version} cannot be undone")
        m.down(context)
        self.history = self.history.where(F.col("id") != last.id)
        return m.version
