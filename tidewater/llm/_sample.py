"""Bounded, repeatable samples of labelled rows, for fits only."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Up to this many rows a group Spark limits a window's groups in each task, before they meet.
GROUP_LIMIT = 1000
#: Groups of tasks whose rows of a label meet first.
SALTS = 256


def per_label(labels: DataFrame, key: str, label: str | Column, most: int, extra: Column | None = None) -> DataFrame:
    """(k, y) of at most ``most`` rows of each label, those of the smallest hash of the key; a key given twice counts once.

    Few rows a label come from one pass over the rows: every task keeps the first of its own, groups of tasks
    theirs, and the last step meets at most ``SALTS`` times ``most`` rows of a label. Beyond ``GROUP_LIMIT``
    each label's rows are a top-k by itself.
    """
    y = F.col(label) if isinstance(label, str) else label
    rows = labels.select(F.col(key).alias("k"), y.alias("y"), *([extra.alias("x")] if extra is not None else [])).where(F.col("k").isNotNull() & F.col("y").isNotNull())
    if most <= GROUP_LIMIT:
        got = rows.withColumns({"_h": F.xxhash64("k"), "_salt": F.spark_partition_id() % SALTS})
        for group in (["y", "_salt"], ["y"]):
            got = got.withColumn("_n", F.row_number().over(Window.partitionBy(*group).orderBy("_h", "k"))).where(F.col("_n") <= most)
        return got.select(*rows.columns).dropDuplicates(["k"])
    found = [r.y for r in rows.select("y").distinct().orderBy("y").collect()]
    parts = [rows.where(F.col("y") == v).orderBy(F.xxhash64("k"), "k").limit(most) for v in found]
    return (reduce(DataFrame.unionAll, parts) if parts else rows.limit(0)).dropDuplicates(["k"])
