"""Mutations as functions from DataFrames to DataFrames, and a table that swaps its folder.

Each returns (the table after, the affected rows): the latter is what RETURNING gives.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewater.streaming.transforms import number

Pair = tuple[DataFrame, DataFrame]


#: Keys of first rows up to which they are broadcast.
MOST = 100_000


def _cond(where: str | Column | None) -> Column:
    c = F.lit(True) if where is None else F.expr(where) if isinstance(where, str) else where
    return F.coalesce(c, F.lit(False))


def insert(table: DataFrame, new: DataFrame, defaults: dict[str, str] | None = None, autoincrement: str | None = None) -> Pair:
    """Columns that are absent get their default or null; the key, if asked for, goes on from the largest.

    Numbering needs each row's rank among the new ones, which are sorted by ranges.
    """
    rows = new
    for c in table.columns:
        if c not in rows.columns:
            rows = rows.withColumn(c, F.expr((defaults or {}).get(c, "null")).cast(table.schema[c].dataType))
        elif defaults and c in defaults:
            rows = rows.withColumn(c, F.coalesce(c, F.expr(defaults[c])))
    if autoincrement:
        top = table.agg(F.coalesce(F.max(autoincrement), F.lit(0)).alias("_top"))
        order = [c for c in new.columns if c != autoincrement]
        rows = number(rows, *order).crossJoin(F.broadcast(top))  # one row
        rows = rows.withColumn(autoincrement, (F.col("_top") + F.col("_n")).cast(table.schema[autoincrement].dataType))
    rows = rows.select(*[F.col(c).cast(table.schema[c].dataType).alias(c) for c in table.columns])
    return table.unionByName(rows), rows


def one_per_key(rows: DataFrame, keys: list[str], order: str | None = None) -> DataFrame:
    """Of the rows of a key the one that is largest by ``order`` and then by all other columns; null keys are not equal to one another."""
    rest = [c for c in rows.columns if c not in keys]
    known = reduce(Column.__and__, [F.col(k).isNotNull() for k in keys])
    best = F.max(F.struct(*([F.col(order).alias("_o")] if order else []), *rest)) if rest else F.lit(None)
    one = rows.where(known).groupBy(*keys).agg(best.alias("_r")).select(*[F.col(c) if c in keys else F.col(f"_r.{c}") for c in rows.columns])
    return one.unionByName(rows.where(~known))


def upsert(table: DataFrame, new: DataFrame, keys: list[str], update: dict[str, str] | None = None, nothing: bool = False, order: str | None = None) -> Pair:
    """ON CONFLICT on the keys: DO NOTHING, or set columns by SQL over ``old.`` and ``new.`` (by default all take the new value).

    Of new rows with one key just one counts: the largest by ``order``, a column of ``new``, and then by its other columns.
    """
    new = one_per_key(new.select(*{c: 0 for c in [*table.columns, *([order] if order else [])]}), keys, order).select(*table.columns)
    if nothing:
        fresh = new.join(table.select(*keys), keys, "left_anti")
        return table.unionByName(fresh), fresh
    old, fresh = table.alias("old"), new.select(*table.columns).withColumn("_new", F.lit(True)).alias("new")
    same = reduce(Column.__and__, [F.col(f"old.{k}") == F.col(f"new.{k}") for k in keys])
    both = old.withColumn("_old", F.lit(True)).alias("old").join(fresh, same, "full")
    hit, added = F.col("_new").isNotNull() & F.col("_old").isNotNull(), F.col("_old").isNull()
    change = update if update is not None else {c: f"new.{c}" for c in table.columns if c not in keys}
    cols = [F.when(added, F.col(f"new.{c}")).when(hit, F.expr(change.get(c, f"old.{c}"))).otherwise(F.col(f"old.{c}")).cast(table.schema[c].dataType).alias(c) for c in table.columns]
    out = both.select(*cols, F.col("_new"))
    return out.drop("_new"), out.where(F.col("_new").isNotNull()).drop("_new")


def _marked(table: DataFrame, where: str | Column | None, order: list[Column] | None, limit: int, key: list[str] | None) -> DataFrame:
    """The table with ``_hit``: the condition, or with a limit just the first rows for which it holds.

    The first rows are a top-k, which each task makes of its own rows; their keys mark them. ``key`` must be
    unique; without one, rows that are equal in all columns stand or fall together.
    """
    hit = _cond(where)
    if limit <= 0:
        return table.withColumn("_hit", hit)
    key = key or table.columns
    first = table.where(hit).orderBy(*(order or []), *key).limit(limit).select(*[F.col(k).alias(f"_{i}") for i, k in enumerate(key)]).withColumn("_hit", F.lit(True)).distinct()
    same = reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"_{i}")) for i, k in enumerate(key)])
    first = F.broadcast(first) if limit <= MOST else first
    return table.join(first, same, "left").select(*table.columns, F.coalesce("_hit", F.lit(False)).alias("_hit"))


def update(table: DataFrame, changes: dict[str, str | Column], where: str | Column | None = None, order: list[Column] | None = None, limit: int = 0, key: list[str] | None = None) -> Pair:
    """Set columns by SQL where the condition holds; with order and limit, only the first rows that it holds for, by a unique key."""
    if not changes:
        raise ValueError("nothing to set")
    df = _marked(table, where, order, limit, key)
    made = {c: F.when(F.col("_hit"), F.expr(e) if isinstance(e, str) else e).otherwise(F.col(c)).cast(table.schema[c].dataType) for c, e in changes.items()}
    out = df.withColumns(made)
    return out.drop("_hit"), out.where("_hit").drop("_hit")


def set_of(model: dict, omit_zero: bool = False, skip: tuple[str, ...] = ()) -> dict[str, Column]:
    """Assignments from a row's values; with omit_zero, without its zero values."""
    return {k: F.lit(v) for k, v in model.items() if k not in skip and not (omit_zero and v in (None, 0, "", False))}


def delete(table: DataFrame, where: str | Column | None = None, soft: str | None = None, order: list[Column] | None = None, limit: int = 0, now: Column | None = None, key: list[str] | None = None) -> Pair:
    """Without the rows that the condition holds for, or, softly, with a time set in them."""
    if soft:
        return update(table, {soft: now if now is not None else F.current_timestamp()}, _cond(where) & F.col(soft).isNull(), order, limit, key)
    df = _marked(table, where, order, limit, key)
    return df.where(~F.col("_hit")).drop("_hit"), df.where("_hit").drop("_hit")


def alter_update(table: DataFrame, changes: dict[str, str], where: str) -> Pair:
    """An update that must state its condition."""
    if not where:
        raise ValueError("a condition is needed")
    return update(table, changes, where)


def bulk(table: DataFrame, actions: DataFrame, key: str) -> Pair:
    """Apply a log of (seq, action, key, other columns), the last action of each key deciding.

    index writes, create writes unless the key was there, update changes what is there, delete
    removes. The second result holds the keys that failed: created though there, or updated
    though not.
    """
    rest = [c for c in table.columns if c != key]
    last = actions.groupBy(key).agg(F.max_by(F.struct("action", *rest), "seq").alias("a")).select(F.col(key).alias("_k"), "a")
    both = table.join(last, table[key] == last["_k"], "full")
    there, act = F.col(key).isNotNull(), F.col("a.action")
    failed = both.where((act == "create") & there | (act == "update") & ~there).select(F.coalesce(key, "_k").alias(key), act.alias("action"))
    write = act.isin("index", "create", "update") & ~((act == "create") & there) & ~((act == "update") & ~there)
    kept = both.where(F.coalesce(act != "delete", F.lit(True)) & (there | F.coalesce(write, F.lit(False))))
    cols = [F.when(F.coalesce(write, F.lit(False)), F.when(act == "update", F.coalesce(F.col(f"a.{c}"), F.col(c))).otherwise(F.col(f"a.{c}"))).otherwise(F.col(c)).alias(c) for c in rest]
    return kept.select(F.coalesce(key, "_k").alias(key), *cols).select(*table.columns), failed


def validate(df: DataFrame, table) -> Pair:
    """(rows that meet the table's required fields, the others)."""
    need = [f.name for f in table.fields if "pk" in f.flags or "notnull" in f.flags]
    ok = reduce(Column.__and__, [F.col(c).isNotNull() for c in need], F.lit(True))
    return df.where(ok), df.where(~ok)
