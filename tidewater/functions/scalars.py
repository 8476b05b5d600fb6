"""Scalar functions over columns: literals of arrays and maps, keys, ids, clocks and payloads."""

from __future__ import annotations

import gzip
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, MapType, StringType


def parse_array_text(text: str | None) -> list[str | None] | None:
    """``{a,"b c",NULL}`` as a list; a bare NULL is null."""
    if text is None:
        return None
    body = text.strip()[1:-1]
    out: list[str | None] = []
    for m in re.finditer(r'"((?:[^"\\]|\\.)*)"|([^,]+)', body, re.S):
        out.append(re.sub(r"\\(.)", r"\1", m[1], flags=re.S) if m[1] is not None else None if m[2].strip().upper() == "NULL" else m[2].strip())
    return out


def parse_hstore_text(text: str | None) -> dict[str, str | None] | None:
    """``"k"=>"v", "n"=>NULL`` as a map."""
    if text is None:
        return None
    pair = r'"((?:[^"\\]|\\.)*)"\s*=>\s*(?:"((?:[^"\\]|\\.)*)"|NULL)'
    plain = lambda s: None if s is None else re.sub(r"\\(.)", r"\1", s, flags=re.S)
    return {plain(m[1]): plain(m[2]) for m in re.finditer(pair, text, re.S | re.I)}


@F.pandas_udf(ArrayType(StringType()))
def array_of_text(s: pd.Series) -> pd.Series:
    return s.map(parse_array_text, na_action="ignore")


@F.pandas_udf(MapType(StringType(), StringType()))
def map_of_text(s: pd.Series) -> pd.Series:
    return s.map(parse_hstore_text, na_action="ignore")


def _quoted(x: Column) -> Column:
    return F.concat(F.lit('"'), F.regexp_replace(x, r'(["\\])', r"\\$1"), F.lit('"'))


def array_text(a: Column) -> Column:
    """An array of strings as its literal."""
    return F.concat(F.lit("{"), F.array_join(F.transform(a, lambda x: F.coalesce(_quoted(x), F.lit("NULL"))), ","), F.lit("}"))


def map_text(m: Column) -> Column:
    """A map of strings as its literal, keys in order."""
    return F.array_join(F.transform(F.array_sort(F.map_entries(m)), lambda e: F.concat(_quoted(e.key), F.lit("=>"), F.coalesce(_quoted(e["value"]), F.lit("NULL")))), ", ")


def snake_case(c: Column) -> Column:
    return F.lower(F.regexp_replace(F.regexp_replace(c, "([A-Z]+)([A-Z][a-z])", "$1_$2"), "([a-z0-9])([A-Z])", "$1_$2"))


def compose_key(separator: str, *parts: Column) -> Column:
    return F.concat_ws(separator, *parts)


def parse_key(separator: str, key: Column) -> Column:
    return F.split(key, re.escape(separator))


def is_object_id(c: Column) -> Column:
    return c.rlike("^[0-9a-fA-F]{24}$")


def object_id_time(c: Column) -> Column:
    """The time in an object id's first four bytes."""
    return F.timestamp_seconds(F.conv(F.substring(c, 1, 8), 16, 10).cast("long"))


def to_millis(ts: Column) -> Column:
    return F.date_trunc("MILLISECOND", ts)


def hlc_text(h: Column) -> Column:
    return F.format_string("%d.%d@%s", h.ts, h.c, h.node)


@F.pandas_udf(BinaryType())
def compress(s: pd.Series) -> pd.Series:
    """A marker byte and the data, compressed from 256 bytes on."""
    return s.map(lambda b: b"\x01" + gzip.compress(bytes(b), mtime=0) if len(b) >= 256 else b"\x00" + bytes(b), na_action="ignore")


@F.pandas_udf(BinaryType())
def decompress(s: pd.Series) -> pd.Series:
    return s.map(lambda b: gzip.decompress(b[1:]) if b[0] == 1 else bytes(b[1:]), na_action="ignore")


def encrypt(data: Column, key: Column) -> Column:
    return F.aes_encrypt(data, key, F.lit("GCM"))


def decrypt(data: Column, key: Column) -> Column:
    return F.aes_decrypt(data, key, F.lit("GCM"))


def to_long(c: Column) -> Column:
    return c.try_cast("long")
