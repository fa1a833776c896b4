"""Validation and coercion of values by the rules of each database dialect."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tableferry.functions.text import (
    FRACTIONAL,
    TEMPORAL,
    is_number,
    is_text,
    leading_integer,
    leading_number,
    number_from_text,
    parse_iso,
    strip_space,
    truthy,
    value_text,
)

# Which type names each dialect checks, by family.
FAMILIES = {
    "firebird": {
        "integer": ["BIGINT", "INTEGER", "SMALLINT"],
        "number": ["DECIMAL", "DOUBLE PRECISION", "FLOAT", "NUMERIC"],
        "text": ["CHAR", "VARCHAR"],
        "date": ["DATE", "TIME", "TIMESTAMP"],
        "boolean": ["BOOLEAN"],
    },
    "mysql": {
        "integer": ["BIGINT", "INTEGER", "MEDIUMINT", "SMALLINT", "TINYINT"],
        "number": ["DECIMAL", "DOUBLE", "FLOAT", "NUMERIC"],
        "text": ["CHAR", "TEXT", "VARCHAR"],
        "date": ["DATE", "DATETIME", "TIMESTAMP"],
        "boolean": ["BOOLEAN"],
    },
    "paradox": {
        "integer": ["INTEGER", "SMALLINT"],
        "number": ["DECIMAL", "DOUBLE", "FLOAT", "NUMERIC", "REAL"],
        "text": ["CHAR", "TEXT", "VARCHAR"],
        "date": ["DATE", "TIME", "TIMESTAMP"],
        "boolean": ["BOOLEAN"],
    },
    "sqlite": {"integer": ["INTEGER"], "number": ["REAL"], "text": ["TEXT"]},
}

# The ranges Firebird integers must fit.
FIREBIRD_RANGES = {"INTEGER": (-2147483648, 2147483647), "SMALLINT": (-32768, 32767)}


@dataclass(frozen=True)
class ColumnSpec:
    """Metadata of a target column, as far as the checks need it."""

    name: str
    type: str
    nullable: bool = True
    max_length: int | None = None


def family_of(dialect: str, type_name: str) -> str | None:
    wanted = type_name.upper()
    return next((f for f, names in FAMILIES[dialect].items() if wanted in names), None)


def _number(c: Column, dtype: T.DataType) -> Column:
    return number_from_text(c) if is_text(dtype) else c.cast("double")


def _parsed(dialect: str, c: Column, dtype: T.DataType, spec: ColumnSpec) -> Column | None:
    """The number or date a check looks at, where reading it takes work."""
    family = family_of(dialect, spec.type)
    if family in ("integer", "number"):
        if is_text(dtype):
            return number_from_text(c)
        readable = is_number(dtype) or isinstance(dtype, T.BooleanType)
        return c.cast("double") if readable else F.lit(None).cast("double")
    if family == "date" and not isinstance(dtype, TEMPORAL):
        return parse_iso(value_text(c, dtype))
    return None


def validate(dialect: str, c: Column, dtype: T.DataType, spec: ColumnSpec, parsed: Column | None = None) -> Column:
    """True where the value may be stored; NULL only in a nullable column."""
    family = family_of(dialect, spec.type)
    if parsed is None:
        parsed = _parsed(dialect, c, dtype, spec)
    if family == "integer":
        ok = parsed == F.floor(parsed)
        if dialect == "firebird" and spec.type.upper() in FIREBIRD_RANGES:
            ok = ok & parsed.between(*FIREBIRD_RANGES[spec.type.upper()])
    elif family == "number":
        ok = parsed.isNotNull() & ~F.isnan(parsed)
    elif family == "text":
        ok = F.lit(is_text(dtype))
        if dialect == "firebird" and spec.max_length and is_text(dtype):
            ok = F.char_length(c) <= spec.max_length
    elif family == "date":
        ok = F.lit(True) if parsed is None else parsed.isNotNull()
    elif family == "boolean":
        ok = F.lit(isinstance(dtype, T.BooleanType))
        if dialect in ("firebird", "mysql") and is_number(dtype):
            ok = c.isin(0, 1)
        if dialect == "firebird" and is_text(dtype):
            ok = c.isin("T", "F")
    else:
        ok = F.lit(True)
    return F.when(c.isNull(), F.lit(spec.nullable)).otherwise(F.coalesce(ok, F.lit(False)))


def coerce(dialect: str, c: Column, dtype: T.DataType, spec: ColumnSpec) -> Column:
    """The value as the dialect stores it; NULL stays NULL, hopeless text is NULL."""
    family = family_of(dialect, spec.type)
    if family == "integer":
        if is_text(dtype):
            return leading_integer(c)
        if isinstance(dtype, FRACTIONAL + (T.DecimalType,)):
            return c.try_cast("bigint")
        return c.cast("bigint") if is_number(dtype) else F.lit(None).cast("bigint")
    if family == "number":
        if is_text(dtype):
            return leading_number(c)
        return c.cast("double") if is_number(dtype) else F.lit(None).cast("double")
    if family == "text":
        text = value_text(c, dtype)
        if dialect == "paradox":
            return strip_space(text)
        if dialect == "firebird" and spec.max_length:
            return F.substring(text, 1, spec.max_length)
        return text
    if family == "date":
        return c if isinstance(dtype, TEMPORAL) else parse_iso(value_text(c, dtype))
    if family == "boolean":
        if dialect == "firebird" and is_text(dtype):
            return F.when(c == "T", F.lit(True)).when(c == "F", F.lit(False)).otherwise(c != "")
        return truthy(c, dtype)
    return c


def _typed(df: DataFrame, name: str) -> tuple[Column, T.DataType]:
    return F.col(f"`{name}`"), df.schema[name].dataType


def validate_table(df: DataFrame, dialect: str, specs: Iterable[ColumnSpec], keep: Iterable[str]) -> DataFrame:
    """The kept columns plus one ``<name>_ok`` verdict per checked column.

    Numbers and dates are read once per row, ahead of the verdicts.
    """
    specs = list(specs)
    read = {f"__{s.name}": _parsed(dialect, *_typed(df, s.name), s) for s in specs}
    read = {n: c for n, c in read.items() if c is not None}
    wide = df.withColumns(read) if read else df
    checks = [
        validate(dialect, *_typed(df, s.name), s, F.col(f"`__{s.name}`") if f"__{s.name}" in read else None).alias(f"{s.name}_ok")
        for s in specs
    ]
    return wide.select([F.col(k) for k in keep] + checks)


def coerce_table(df: DataFrame, dialect: str, specs: Iterable[ColumnSpec], keep: Iterable[str]) -> DataFrame:
    """The kept columns plus every listed column coerced."""
    out = [coerce(dialect, *_typed(df, s.name), s).alias(s.name) for s in specs]
    return df.select([F.col(k) for k in keep] + out)


@dataclass(frozen=True)
class Rule:
    """A declared check: required, length, range, pattern or custom.

    ``expression`` is the boolean SQL text of a custom rule.
    """

    column: str
    kind: str
    min: float | None = None
    max: float | None = None
    pattern: str | None = None
    expression: str | None = None
    message: str | None = None


# Fixed value: the pattern attached to text that is cast to a number.
NUMERIC_TEXT = r"^[0-9.,-]+$"


def automatic_rules(column: str, source_type: str, target_type: str, max_length: int | None = None) -> list[Rule]:
    """Rules a column pair gets without being asked: text length, numeric shape."""
    s, t = source_type.upper(), target_type.upper()
    if s in ("A", "ALPHA") or (s == "TEXT" and "VARCHAR" in t):
        return [Rule(column, "length", max=max_length or 255, message="text is too long for the target column")]
    if s in ("VARCHAR", "CHAR", "TEXT") and t in ("INTEGER", "DECIMAL", "NUMERIC"):
        return [Rule(column, "pattern", pattern=NUMERIC_TEXT, message="value must be numeric")]
    return []


def rule_passes(rule: Rule, dtype: T.DataType) -> Column:
    """Whether a value satisfies a rule; only ``required`` rejects NULL."""
    c = F.col(f"`{rule.column}`")
    if rule.kind == "required":
        return (c.isNotNull() & (c != "")) if is_text(dtype) else c.isNotNull()
    if rule.kind == "length":
        size = F.char_length(value_text(c, dtype))
        ok = (size >= (rule.min or 0)) & (size <= rule.max if rule.max is not None else F.lit(True))
    elif rule.kind == "range":
        n = _number(c, dtype)
        ok = n.isNotNull()
        ok = ok & (n >= rule.min) if rule.min is not None else ok
        ok = ok & (n <= rule.max) if rule.max is not None else ok
    elif rule.kind == "pattern":
        ok = value_text(c, dtype).rlike(rule.pattern)
    elif rule.kind == "custom":
        ok = F.expr(rule.expression)
    else:
        raise ValueError(f"unknown rule kind {rule.kind!r}")
    return c.isNull() | F.coalesce(ok, F.lit(False))


def broken_rules(df: DataFrame, rules: Iterable[Rule]) -> Column:
    """The messages of the rules a row breaks, in rule order, joined by ``; ``."""
    found = [
        F.when(
            ~rule_passes(r, df.schema[r.column].dataType),
            F.lit(f"{r.column}: {r.message or r.kind}"),
        )
        for r in rules
    ]
    return F.concat_ws("; ", *found)


def split_by_rules(df: DataFrame, rules: Iterable[Rule]) -> tuple[DataFrame, DataFrame]:
    """Good rows, and rejected rows with a ``reject_reason``; nothing is lost."""
    marked = df.withColumn("reject_reason", broken_rules(df, list(rules)))
    good = marked.where(F.col("reject_reason") == "").drop("reject_reason")
    return good, marked.where(F.col("reject_reason") != "")
