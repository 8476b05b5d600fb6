"""Joins that SQL's clauses have no short form for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _place(c: Column, kind: str) -> Column:
    return F.unix_micros(c.cast("timestamp")) / 1e6 if kind in ("timestamp", "timestamp_ntz", "date") else c.cast("double")


def asof(left: DataFrame, right: DataFrame, by: list[str], on: str, take: list[str], tie: str | None = None, width: float = 86_400.0) -> DataFrame:
    """The left rows, each with the columns ``take`` of the last right row of its key ``by`` at or before ``on`` (nulls where there is none).

    Of right rows at one time the largest by ``tie`` counts. Both sides go in one stream through windows of ``width``
    (seconds, or units of a number) of each key, not of the whole key: a key with a third of all
    rows is many windows, and what a window inherits is found among one row a window.
    """
    kind = left.schema[on].dataType.typeName()
    taken = F.struct(*[F.col(c) for c in take])
    rows = left.select(*by, F.col(on).alias("_t"), F.lit(1).alias("_side"), F.lit(None).cast(right.schema[tie].dataType if tie else "int").alias("_tie"), F.struct("*").alias("_l"))
    seen = right.where(F.col(on).isNotNull()).select(*by, F.col(on).alias("_t"), F.lit(0).alias("_side"), (F.col(tie) if tie else F.lit(0)).alias("_tie"), taken.alias("_r"))
    both = rows.unionByName(seen, allowMissingColumns=True).withColumn("_w", F.floor(_place(F.col("_t"), kind) / F.lit(width)))
    inside = Window.partitionBy(*by, "_w").orderBy("_t", "_side", "_tie").rowsBetween(Window.unboundedPreceding, 0)
    found = both.withColumn("_own", F.last("_r", ignorenulls=True).over(inside)).where(F.col("_side") == 1)
    last = both.groupBy(*by, "_w").agg(F.max_by("_r", F.when(F.col("_side") == 0, F.struct("_t", "_tie"))).alias("_e"))
    ahead = Window.partitionBy(*by).orderBy("_w").rowsBetween(Window.unboundedPreceding, -1)
    inherited = last.withColumn("_i", F.last("_e", ignorenulls=True).over(ahead)).where(F.col("_i").isNotNull()).select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(by)], F.col("_w").alias("_x"), "_i")
    same = F.col("_w") == F.col("_x")
    for i, k in enumerate(by):
        same &= F.col(k) == F.col(f"_k{i}")
    joined = found.join(inherited, same, "left").withColumn("_r", F.when(F.col("_t").isNotNull(), F.coalesce("_own", "_i")))
    return joined.select("_l.*", *[F.col(f"_r.{c}").alias(c if c not in left.columns else f"{c}_asof") for c in take])


def per_span(rows: DataFrame, span: tuple[str, str], by: tuple[str, ...] = (), **sums: str) -> DataFrame:
    """``by``, the span, ``n`` and the sums of columns: the rows of one key and span as one, so that who counts or sums what it overlaps meets each span once, however many rows have it."""
    return rows.groupBy(*dict.fromkeys((*by, *span))).agg(F.count(F.lit(1)).alias("n"), *[F.sum(c).alias(name) for name, c in sums.items()])


def _bins(left: dict[int, int], right: dict[int, int]) -> dict[int, int]:
    """The level of the bins for spans of each level, given the rows of each level of both sides, so that the fewest rows are joined.

    Neighbouring levels may share the bins of the lowest, of which a longer span touches more; in turn rows of lower levels are in bins of
    one level less. Bins are never wider than those of a span's own level, so that no more pairs are compared.
    """
    levels = sorted({*left, *right})
    best: list[tuple[float, dict[int, int]]] = [(0.0, {})]
    for z in range(1, len(levels) + 1):
        ways = []
        for a in range(z):
            low, group = levels[a], levels[a:z]
            cost = sum((left.get(k, 0) + right.get(k, 0)) * (2.0 ** min(k - low, 60) + 1) for k in group)
            for own, other in ((left, right), (right, left)):
                if any(k in own for k in group):
                    cost += sum(n for k, n in other.items() if k < low)
            ways.append((best[a][0] + cost, {**best[a][1], **dict.fromkeys(group, low)}))
        best.append(min(ways, key=lambda w: w[0]))
    return best[-1][1]


def interval(left: DataFrame, right: DataFrame, left_span: tuple[str, str], right_span: tuple[str, str], by: tuple[str, ...] = (), where: Column | None = None) -> DataFrame:
    """Rows of both whose closed spans (start, end: two columns, or one twice for a point) overlap, and that agree in ``by``, as structs ``l`` and ``r``.

    An inequality alone would compare every row with every other. A span of a length of up to 2**k touches two bins of that width
    at most, so k is its level; ``_bins`` lets some levels share narrower bins. Two spans meet at the larger of their bins' levels, in the first bin that both touch: a row is
    in the bins of its own level and in those of larger levels that the other side has, however long some spans are,
    and the join is by level and bin. It sorts both sides: they are far larger than the tables whose sizes Spark knows, so that neither may be
    broadcast. ``where`` is a further condition on ``l`` and ``r``. Spans with a null, or whose end is before their start, meet nothing.
    """
    kind = left.schema[left_span[0]].dataType.typeName()
    least = 0 if kind in ("timestamp", "timestamp_ntz", "date") else -8

    def spans(df: DataFrame, span: tuple[str, str]) -> DataFrame:
        scale = 1e6 if not least else 1.0
        rows = df.select(*[F.col(c).alias(f"_by{i}") for i, c in enumerate(by)], *[(_place(F.col(c), kind) * scale).alias(n) for c, n in zip(span, ("_a", "_b"), strict=True)], F.struct("*").alias("_row"))
        return rows.where("_a <= _b").withColumn("_k", F.greatest(F.ceil(F.log2(F.greatest(F.col("_b") - F.col("_a"), F.lit(2.0**least)))), F.lit(least)).cast("int"))

    l, r = spans(left, left_span), spans(right, right_span)
    levels = [{x[0]: x[1] for x in rows.groupBy("_k").count().collect()} for rows in (l, r)]  # one a power of two
    bins = _bins(*levels)

    def binned(rows: DataFrame, side: int, name: str) -> DataFrame:
        others = sorted({bins[k] for k in levels[1 - side]})
        places = {k: [j for j in others if j > bins[k]] + [bins[k]] * (not others or others[0] <= bins[k]) for k in levels[side]}
        at = F.create_map(*[x for k, js in places.items() for x in (F.lit(k), F.array(*map(F.lit, js)).cast("array<int>"))]) if places else F.lit(None).cast("map<int,array<int>>")
        own = F.create_map(*[F.lit(x) for k in places for x in (k, bins[k])]) if places else F.lit(None).cast("map<int,int>")
        rows = rows.withColumn("_own", own[F.col("_k")]).withColumn("_j", F.explode(at[F.col("_k")]))
        width = F.pow(F.lit(2.0), F.col("_j"))
        rows = rows.withColumn("_first", F.floor(F.col("_a") / width)).withColumn("_bin", F.explode(F.sequence("_first", F.floor(F.col("_b") / width))))
        return rows.select(*[f"_by{i}" for i in range(len(by))], "_j", "_bin", F.struct("_row", "_a", "_b", "_first", (F.col("_own") == F.col("_j")).alias("own")).alias(name))

    met = binned(l, 0, "l").join(binned(r, 1, "r").hint("merge"), [*[f"_by{i}" for i in range(len(by))], "_j", "_bin"])
    met = met.where((F.col("l.own") | F.col("r.own")) & (F.greatest("l._first", "r._first") == F.col("_bin")) & (F.col("l._a") <= F.col("r._b")) & (F.col("r._a") <= F.col("l._b")))
    met = met.select(F.col("l._row").alias("l"), F.col("r._row").alias("r"))
    return met.where(where) if where is not None else met
