"""Table definitions: fields with flags, relations, soft deletion, and the types behind them."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import types as S

#: Type names of field declarations. Unsigned 64-bit needs a decimal; other unsigned types the next wider signed one.
TYPES = {
    "bool": S.BooleanType(),
    "int8": S.ByteType(),
    "int16": S.ShortType(),
    "int32": S.IntegerType(),
    "int": S.LongType(),
    "int64": S.LongType(),
    "uint8": S.ShortType(),
    "uint16": S.IntegerType(),
    "uint32": S.LongType(),
    "uint64": S.DecimalType(20, 0),
    "float32": S.FloatType(),
    "float64": S.DoubleType(),
    "string": S.StringType(),
    "uuid": S.StringType(),
    "time": S.TimestampType(),
    "bytes": S.BinaryType(),
    "json": S.VariantType(),
    "strings": S.ArrayType(S.StringType()),
    "ints": S.ArrayType(S.LongType()),
    "hstore": S.MapType(S.StringType(), S.StringType(), True),
}


def to_snake_case(name: str) -> str:
    """Lower snake case, with runs of capitals as one word: HTMLParser becomes html_parser."""
    return re.sub(r"(?<=[a-z0-9])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])", "_", name).lower()


def sanitize(ident: str) -> str:
    """Only letters, digits, underscores and dots."""
    return re.sub(r"[^A-Za-z0-9_.]", "", ident)


def split_tag(text: str) -> list[tuple[str, str | None]]:
    """Options of a tag: (key, value or None), cut at commas that stand outside single quotes."""
    out = []
    for part in re.findall(r"((?:'[^']*'|[^,'])+)", text):
        key, colon, value = part.strip().partition(":")
        if key:
            out.append((key, value.strip("'") if colon else None))
    return out


@dataclass(frozen=True)
class Field:
    name: str
    type: S.DataType
    flags: dict[str, str | None] = field(default_factory=dict)

    @classmethod
    def parse(cls, name: str, kind: str, tag: str = "") -> Field:
        """A field from its declared type and tag; ``type:`` in the tag wins over the declared type."""
        options = split_tag(tag)
        own = options[0][0] if options and options[0][1] is None and options[0][0] not in FLAGS else to_snake_case(name)
        flags = {k: v for k, v in options if k != own}
        stated = flags.get("type")
        return cls(own, parse_type(stated) if stated else TYPES.get(kind, S.StringType()), flags)

    def struct(self) -> S.StructField:
        return S.StructField(self.name, self.type, not ({"pk", "notnull"} & set(self.flags)), {k: v or True for k, v in self.flags.items()})


FLAGS = frozenset("pk autoincrement notnull unique default soft_delete scanonly privacy crdt type nullzero driver index composite".split())


def parse_type(text: str) -> S.DataType:
    """A stated database type; decimals keep their precision."""
    m = re.fullmatch(r"(?:decimal|numeric)\((\d+)\s*(?:,\s*(\d+))?\)", text.strip().lower())
    if m:
        return S.DecimalType(int(m[1]), int(m[2] or 0))
    names = {"bigint": S.LongType(), "integer": S.IntegerType(), "smallint": S.ShortType(), "boolean": S.BooleanType(), "double precision": S.DoubleType(), "real": S.FloatType(), "bytea": S.BinaryType(), "jsonb": S.VariantType(), "timestamptz": S.TimestampType(), "timestamp": S.TimestampNTZType(), "date": S.DateType()}
    return names.get(text.strip().lower(), S.StringType())


@dataclass(frozen=True)
class Relation:
    """How rows of one table belong to another's: kind is has_one, has_many, belongs_to or many_to_many."""

    name: str
    kind: str
    table: str
    base: str
    key: str
    through: str | None = None
    through_base: str | None = None
    through_key: str | None = None


@dataclass(frozen=True)
class TableDef:
    name: str
    fields: tuple[Field, ...] = ()
    alias: str | None = None
    relations: tuple[Relation, ...] = ()
    engine: str = "plain"  # plain, replacing, summing or collapsing: what FINAL does
    sort_key: tuple[str, ...] = ()
    version: str | None = None
    ttl: str | None = None  # SQL expression of a timestamp after which rows are not read

    @classmethod
    def model(cls, type_name: str, fields: list[Field | list[Field]], **rest) -> TableDef:
        """From a type's name and fields; lists of fields are embedded and are flattened."""
        flat = [f for x in fields for f in (x if isinstance(x, list) else [x]) if f.name != "-"]
        return cls(rest.pop("name", None) or to_snake_case(type_name) + "s", tuple(flat), **rest)

    def with_flag(self, flag: str) -> list[str]:
        return [f.name for f in self.fields if flag in f.flags]

    @property
    def pk(self) -> list[str]:
        return self.with_flag("pk")

    @property
    def soft_delete(self) -> str | None:
        return next(iter(self.with_flag("soft_delete")), None)

    def struct(self) -> S.StructType:
        return S.StructType([f.struct() for f in self.fields])

    def relation(self, name: str) -> Relation:
        for r in self.relations:
            if r.name == name:
                return r
        raise KeyError(f"{self.name} has no relation {name}")
