"""Python functions over Arrow batches."""

from __future__ import annotations

import ctypes
import os
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType

_PACKAGE = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
_sent: set[str] = set()


def extended(schema: StructType, ddl: str) -> StructType:
    """A new schema with further columns; ``StructType.add`` would change the given one."""
    return StructType([*schema.fields, *StructType.fromDDL(ddl).fields])


def _tidied(fn: Callable, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A worker that is used again gives back what a task has freed."""
    for out in fn(batches):
        yield out
        pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def map_batches(df: DataFrame, fn: Callable, schema: StructType | str) -> DataFrame:
    """``mapInArrow``; a local session's workers are given the package's folder.

    On a cluster the package is installed, on the Python path, or sent with ``--py-files``.
    """
    context = df.sparkSession.sparkContext
    if context.master.startswith("local[") and context.applicationId not in _sent:
        context.addFile(_PACKAGE, recursive=True)
        _sent.add(context.applicationId)

    return df.mapInArrow(lambda batches: _tidied(fn, batches), schema)
