"""Binding of a value within an expression, and of a Python function to Arrow arrays."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value evaluated once a row, however often body uses it:
    the optimizer may inline a projected column into every place that reads it, a
    lambda's variable it may not."""
    return F.transform(F.array(value), body)[0]


def in_slices(f: Callable, kind: pa.DataType, *columns: pa.Array, rows: int = 256) -> pa.Array:
    """f of each row of columns as an array of kind. Python objects of so many rows are held at once, however
    many a batch has."""
    parts = [pa.array([f(*x) for x in zip(*(c.slice(at, rows).to_pylist() for c in columns))], kind) for at in range(0, len(columns[0]), rows)]
    return pa.concat_arrays(parts) if parts else pa.array([], kind)
