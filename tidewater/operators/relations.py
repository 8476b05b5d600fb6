"""Relations as joins: each row of the result holds a struct (one) or an array of structs (many), set-wise for any number of rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def load(db, base: DataFrame, table: str, name: str, order: str | None = None) -> DataFrame:
    """Adds the column ``name``. Related rows are read through the hooks and without soft-deleted ones.

    A row without related ones gets null (one) or an empty array (many); of several for
    has_one or belongs_to, the least in the order of the related table's columns.
    """
    r = db.table(table).relation(name)
    other = db.rows(r.table)
    row = F.struct(*[F.col(f"o.{c}").alias(c) for c in other.columns])
    if r.kind == "many_to_many":
        link = db.rows(r.through).select(F.col(r.through_base).alias("_base"), F.col(r.through_key).alias("_key")).distinct()
        related = link.join(other.alias("o"), F.col("_key") == F.col(f"o.{r.key}"))
    else:
        related = other.alias("o").withColumn("_base", F.col(f"o.{r.key}"))
    if r.kind in ("has_one", "belongs_to"):
        found = related.where(F.col("_base").isNotNull()).groupBy("_base").agg(F.min(row).alias(name))
        return base.join(found, base[r.base] == found["_base"], "left").drop("_base")
    found = related.where(F.col("_base").isNotNull()).groupBy("_base").agg(F.sort_array(F.collect_list(row)).alias(name))
    joined = base.join(found, base[r.base] == found["_base"], "left").drop("_base")
    return joined.withColumn(name, F.coalesce(name, F.array().cast(found.schema[name].dataType)))


def lookup(base: DataFrame, other: DataFrame, local: str, foreign: str, as_: str) -> DataFrame:
    """Left outer equi-join into an array; null matches null or missing, as documents do."""
    found = other.groupBy(F.col(foreign).alias("_f")).agg(F.sort_array(F.collect_list(F.struct(*other.columns))).alias(as_))
    joined = base.join(found, base[local].eqNullSafe(found["_f"]), "left").drop("_f")
    return joined.withColumn(as_, F.coalesce(as_, F.array().cast(found.schema[as_].dataType)))
