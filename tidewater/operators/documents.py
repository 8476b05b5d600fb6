"""Document-style queries: filters as dicts become Columns, pipelines become DataFrame operations."""

from __future__ import annotations

from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewater.operators import mutate, relations


def match(spec: dict) -> Column:
    """All conditions of a filter; a missing condition is no condition. Never null: what is unknown doesn't match."""
    parts = [_entry(k, v) for k, v in spec.items()]
    return reduce(Column.__and__, parts, F.lit(True))


def all_of(*specs: dict) -> Column:
    """Several filters at once, though they may name the same fields."""
    return reduce(Column.__and__, map(match, specs), F.lit(True))


def _entry(key: str, value: Any) -> Column:
    if key == "$and":
        return reduce(Column.__and__, map(match, value))
    if key == "$or":
        return reduce(Column.__or__, map(match, value))
    if key == "$nor":
        return ~reduce(Column.__or__, map(match, value))
    c = F.col(key)
    if not (isinstance(value, dict) and any(k.startswith("$") for k in value)):
        return c.isNull() if value is None else F.coalesce(c == F.lit(value), F.lit(False))
    return reduce(Column.__and__, [_operator(c, op, x, value) for op, x in value.items() if op != "$options"])


def _operator(c: Column, op: str, x: Any, around: dict) -> Column:
    sure = lambda p: F.coalesce(p, F.lit(False))
    if op == "$eq":
        return c.isNull() if x is None else sure(c == F.lit(x))
    if op == "$ne":
        return c.isNotNull() if x is None else ~sure(c == F.lit(x))
    if op in ("$gt", "$gte", "$lt", "$lte"):
        v = F.lit(x)
        return sure({"$gt": c > v, "$gte": c >= v, "$lt": c < v, "$lte": c <= v}[op])
    if op in ("$in", "$nin"):
        found = sure(c.isin(*[v for v in x if v is not None])) if any(v is not None for v in x) else F.lit(False)
        found = found | c.isNull() if None in x else found
        return found if op == "$in" else ~found
    if op == "$exists":
        return c.isNotNull() if x else c.isNull()
    if op == "$regex":
        flags = "".join(f for f in around.get("$options", "") if f in "ims")
        return sure(c.rlike(f"(?{flags}){x}" if flags else x))
    if op == "$size":
        return sure(F.size(c) == x)
    if op == "$elemMatch":
        return sure(F.exists(c, lambda e: _element(e, x)))
    if op == "$not":
        return ~reduce(Column.__and__, [_operator(c, o, v, x) for o, v in x.items() if o != "$options"])
    raise ValueError(f"unknown operator {op}")


def _element(e: Column, spec: dict) -> Column:
    parts = [_operator(e, k, v, spec) if k.startswith("$") else (_operator(e[k], "$eq", v, {}) if not isinstance(v, dict) else reduce(Column.__and__, [_operator(e[k], o, x, v) for o, x in v.items()])) for k, v in spec.items()]
    return reduce(Column.__and__, parts)


def value(expr: Any) -> Column:
    """A field ("$name"), a literal, or one of the arithmetic and string expressions."""
    if isinstance(expr, str) and expr.startswith("$"):
        return F.col(expr[1:])
    if isinstance(expr, dict) and len(expr) == 1 and next(iter(expr)).startswith("$"):
        op, x = next(iter(expr.items()))
        args = [value(v) for v in (x if isinstance(x, list) else [x])]
        fold = lambda f: reduce(f, args)
        known = {
            "$add": lambda: fold(Column.__add__),
            "$subtract": lambda: args[0] - args[1],
            "$multiply": lambda: fold(Column.__mul__),
            "$divide": lambda: args[0] / args[1],
            "$concat": lambda: F.concat(*args),
            "$toLower": lambda: F.lower(args[0]),
            "$toUpper": lambda: F.upper(args[0]),
            "$ifNull": lambda: F.coalesce(*args),
            "$size": lambda: F.size(args[0]),
            "$year": lambda: F.year(args[0]),
            "$month": lambda: F.month(args[0]),
        }
        if op not in known:
            raise ValueError(f"unknown expression {op}")
        return known[op]()
    if isinstance(expr, dict):
        return F.struct(*[value(v).alias(k) for k, v in expr.items()])
    return F.lit(expr)


def accumulator(spec: dict) -> Column:
    op, x = next(iter(spec.items()))
    v = value(x) if op != "$count" else F.lit(1)
    known = {"$sum": lambda: F.coalesce(F.sum(v), F.lit(0)), "$avg": lambda: F.avg(v), "$min": lambda: F.min(v), "$max": lambda: F.max(v), "$first": lambda: F.first(v), "$last": lambda: F.last(v), "$push": lambda: F.collect_list(v), "$addToSet": lambda: F.sort_array(F.collect_set(v)), "$count": lambda: F.count(v)}
    return known[op]()


def project(df: DataFrame, spec: dict) -> DataFrame:
    """Keep (1), drop (0) or compute columns; ``_id`` stays unless it is dropped."""
    if all(v in (0, False) for v in spec.values()):
        return df.drop(*spec)
    keep = ["_id"] if "_id" in df.columns and "_id" not in spec else []
    return df.select(*keep, *[F.col(k) if v in (1, True) and not isinstance(v, str) else value(v).alias(k) for k, v in spec.items() if v not in (0, False)])


def pipeline(df: DataFrame, stages: list[dict], tables: dict[str, DataFrame] | None = None) -> DataFrame:
    """Stages in order: $match, $group, $sort, $project, $unwind, $lookup, $limit, $skip, $count, $addFields."""
    for stage in stages:
        op, x = next(iter(stage.items()))
        if op == "$match":
            df = df.where(match(x))
        elif op == "$group":
            key = x["_id"]
            cols = [accumulator(v).alias(k) for k, v in x.items() if k != "_id"]
            df = df.groupBy(value(key).alias("_id")).agg(*cols) if key is not None else df.agg(*cols).withColumn("_id", F.lit(None).cast("string"))
        elif op == "$sort":
            df = df.orderBy(*[F.col(k).asc_nulls_first() if d > 0 else F.col(k).desc_nulls_last() for k, d in x.items()])
        elif op == "$project":
            df = project(df, x)
        elif op == "$addFields":
            df = df.withColumns({k: value(v) for k, v in x.items()})
        elif op == "$unwind":
            name = (x if isinstance(x, str) else x["path"])[1:]
            keep = not isinstance(x, str) and x.get("preserveNullAndEmptyArrays")
            df = df.withColumn(name, (F.explode_outer if keep else F.explode)(name))
        elif op == "$lookup":
            df = relations.lookup(df, tables[x["from"]], x["localField"], x["foreignField"], x["as"])
        elif op == "$limit":
            df = df.limit(x)
        elif op == "$skip":
            df = df.offset(x)
        elif op == "$count":
            df = df.agg(F.count(F.lit(1)).alias(x))
        else:
            raise ValueError(f"unknown stage {op}")
    return df


def _first(df: DataFrame, spec: dict, order: list[str] | None, key: list[str] | None) -> DataFrame:
    """The documents with ``_hit``: the first match by ``order`` and the unique ``key`` (all of a document where there is none)."""
    return mutate._marked(df, match(spec), [F.col(c) for c in order or []], 1, key or order)


def update(df: DataFrame, spec: dict, changes: dict, many: bool = False, order: list[str] | None = None, key: list[str] | None = None) -> DataFrame:
    """All documents, those that match changed: $set, $inc, $mul, $unset, $push, $min, $max. Only the first in order, known by a unique key, unless many."""
    hit = F.coalesce(match(spec), F.lit(False))
    if not many:
        df, hit = _first(df, spec, order, key), F.col("_hit")
    new: dict[str, Column] = {}
    for op, fields in changes.items():
        for k, v in fields.items():
            c = F.col(k) if k in df.columns else F.lit(None)
            made = {"$set": lambda v=v: F.lit(v), "$inc": lambda c=c, v=v: F.coalesce(c, F.lit(0)) + F.lit(v), "$mul": lambda c=c, v=v: F.coalesce(c, F.lit(0)) * F.lit(v), "$unset": lambda: F.lit(None), "$push": lambda c=c, v=v: F.array_append(c, F.lit(v)), "$min": lambda c=c, v=v: F.least(c, F.lit(v)), "$max": lambda c=c, v=v: F.greatest(c, F.lit(v))}[op]()
            new[k] = F.when(hit, made).otherwise(c)
    return df.withColumns(new).drop("_hit")


def delete(df: DataFrame, spec: dict, many: bool = False, order: list[str] | None = None, key: list[str] | None = None) -> DataFrame:
    """The documents that stay; without ``many`` only the first match in order, known by a unique key, goes."""
    if many:
        return df.where(~F.coalesce(match(spec), F.lit(False)))
    return _first(df, spec, order, key).where(~F.col("_hit")).drop("_hit")


#: Types of a validator and the test of a string column or of any other that holds such values.
KINDS = {"string": ("string", "varchar", "char"), "int": ("integer", "short", "byte"), "long": ("long", "integer", "short", "byte"), "double": ("double", "float"), "number": ("double", "float", "long", "integer", "short", "byte", "decimal"), "bool": ("boolean",), "date": ("timestamp", "timestamp_ntz", "date"), "object": ("struct", "map", "variant"), "array": ("array",)}


def violations(df: DataFrame, schema: dict) -> Column:
    """The rules of a collection's validator that each row breaks, as texts ``field: rule``; of a row that is valid none.

    A validator has ``required`` and, by field, ``properties`` with bsonType, enum, minimum, maximum, minLength, maxLength and pattern. A rule on a
    field that is absent or null holds, but for required.
    """
    known = {f.name: f.dataType.typeName() for f in df.schema}
    broken: list[Column] = []

    def rule(field: str, name: str, ok: Column) -> None:
        broken.append(F.when(~F.coalesce(ok, F.lit(False)), F.lit(f"{field}: {name}")))

    for field in schema.get("required", ()):
        rule(field, "required", F.col(field).isNotNull() if field in known else F.lit(False))
    for field, want in schema.get("properties", {}).items():
        if field not in known:
            continue
        c = F.col(field)
        kinds = want.get("bsonType")
        if kinds is not None:
            fits = any(known[field] in KINDS[k] for k in ([kinds] if isinstance(kinds, str) else kinds))
            rule(field, "bsonType", c.isNull() | F.lit(fits))
        tests = {"enum": lambda x: c.isin(list(x)), "minimum": lambda x: c >= x, "maximum": lambda x: c <= x, "minLength": lambda x: F.length(c) >= x, "maxLength": lambda x: F.length(c) <= x, "pattern": lambda x: c.rlike(x)}
        for name, test in tests.items():
            if name in want:
                rule(field, name, c.isNull() | test(want[name]))
    return F.array_compact(F.array(*broken)) if broken else F.array().cast("array<string>")


def validated(df: DataFrame, schema: dict) -> tuple[DataFrame, DataFrame]:
    """(rows that a validator accepts, the others with ``violations``)."""
    rows = df.withColumn("violations", violations(df, schema))
    return rows.where(F.size("violations") == 0).drop("violations"), rows.where(F.size("violations") > 0)
