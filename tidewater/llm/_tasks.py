"""What Python tasks keep between batches and tasks, and when it goes."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType

_KEPT: dict[str, Any] = {}


def kept(key: str, make: Callable[[], Any]) -> Any:
    """What ``make`` gives, made once in a Python process for tasks of the same ``key``; what making it took besides goes back to the system."""
    if key not in _KEPT:
        _KEPT[key] = make()
        _trim()
    return _KEPT[key]


def in_arrow(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: StructType | str, key: str = "") -> DataFrame:
    """``mapInArrow`` whose tasks first drop what tasks of other keys have kept: processes serve one stage after another,
    and with all that these keep they would outgrow a small executor."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drop_others(key)
        yield from run(batches)

    return df.mapInArrow(task, schema)


def drop_others(key: str) -> None:
    """Drop what is kept under other keys, and return its memory to the system."""
    others = [k for k in _KEPT if k != key]
    if not others:
        return
    for k in others:
        del _KEPT[k]
    _trim()


def _trim() -> None:
    """Return free memory to the system, where the C library can."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)
