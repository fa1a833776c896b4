"""Named transforms: small Column -> Column steps chosen by name in a plan."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tableferry.functions.text import TEMPORAL, is_text, iso_text, strip_space, value_text

Step = Callable[[Column], Column]


def named_transform(name: str, c: Column, dtype: T.DataType, **params: Any) -> Column:
    """Apply one transform by name; unknown names leave the value unchanged.

    The first five only touch the kind of value they are meant for.  The rule
    names (``uppercase``, ``lowercase``, ``strip``, ``date_format``, ``custom``)
    turn any value into text first and let NULL through.
    """
    if name == "toUpperCase":
        return F.upper(c) if is_text(dtype) else c
    if name == "toLowerCase":
        return F.lower(c) if is_text(dtype) else c
    if name == "trim":
        return strip_space(c) if is_text(dtype) else c
    if name == "dateToISO":
        return iso_text(c) if isinstance(dtype, TEMPORAL) else c
    if name == "nullToEmpty":
        return F.coalesce(value_text(c, dtype), F.lit(""))
    if name == "uppercase":
        return F.upper(value_text(c, dtype))
    if name == "lowercase":
        return F.lower(value_text(c, dtype))
    if name == "strip":
        return strip_space(value_text(c, dtype))
    if name == "date_format":
        return F.date_format(c, params.get("format", "yyyy-MM-dd"))
    if name == "custom":
        return params["function"](c)
    return c


def transform_columns(df: DataFrame, steps: Iterable[tuple]) -> DataFrame:
    """Run ``(column, name[, params])`` steps in order as one projection.

    Columns the table does not have are ignored.  Steps on the same column are
    chained, so all of them land in a single ``select``.
    """
    types = {f.name: f.dataType for f in df.schema}
    exprs = {name: F.col(f"`{name}`") for name in types}
    touched = False
    for step in steps:
        column, name, params = (*step, {})[:3]
        if column not in exprs:
            continue
        before = exprs[column]
        exprs[column] = named_transform(name, before, types[column], **params)
        if name in ("uppercase", "lowercase", "strip", "date_format", "nullToEmpty", "dateToISO") and (
            exprs[column] is not before
        ):
            types[column] = T.StringType()
        touched = True
    if not touched:
        return df
    return df.select([e.alias(n) for n, e in exprs.items()])
