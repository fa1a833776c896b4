"""Value conversion between type families, with a verdict per value.

``convert`` yields ``struct(value, success, conversion_type, error)``.  NULL
passes through, equal types pass through as ``DIRECT``, and a value that cannot
be converted keeps its original text and carries an error.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tableferry.functions.text import (
    drop_space,
    is_text,
    number_from_text,
    parse_iso,
    plain_number,
    present,
    round_half_up,
    strip_space,
    value_text,
)

# The type families that decide how a value is converted.
TEXT_TYPES = ["VARCHAR", "TEXT", "CHAR", "STRING", "CSTRING"]
NUMBER_TYPES = ["INTEGER", "BIGINT", "SMALLINT", "NUMERIC", "REAL", "DOUBLE", "FLOAT"]
DATE_TYPES = ["DATE", "TIMESTAMP", "DATETIME", "TIME"]
INTEGER_TYPES = ["INTEGER", "BIGINT", "SMALLINT"]

# Date layouts.  Separated days and year-first digits are put in
# ISO order first; eight digits that are no such date are then read day-first.
DAY_FIRST = r"^(\d{2})([/-])(\d{2})\2(\d{4})$"
YEAR_DIGITS = r"^(\d{4})(\d{2})(\d{2})$"
DAY_DIGITS = r"^(\d{2})(\d{2})(\d{4})$"
ISO_DAY = r"^((?!00)\d{4}-\d{2}-\d{2})$"


def normalize_type(t: Column) -> Column:
    """Upper-case a type name and drop its ``(n)`` or ``(n,m)`` parameters."""
    name = F.regexp_replace(F.upper(t), r"\(\d+\)|\(\d+,\d+\)", "")
    name = strip_space(F.regexp_replace(name, r"FB_TYPE_\d+", "VARCHAR"))
    return F.when(F.coalesce(t, F.lit("")) == "", F.lit("VARCHAR")).otherwise(name)


def classify_conversion(source: Column, target: Column) -> Column:
    """Name the conversion between two type columns."""
    s, t = normalize_type(source), normalize_type(target)
    return (
        F.when(s == t, "DIRECT")
        .when(s.isin(TEXT_TYPES) & t.isin(DATE_TYPES), "TEXT_TO_DATE")
        .when(s.isin(TEXT_TYPES) & t.isin(NUMBER_TYPES), "TEXT_TO_NUMBER")
        .when(s.isin(NUMBER_TYPES) & t.isin(TEXT_TYPES), "NUMBER_TO_TEXT")
        .when(s.isin(DATE_TYPES) & t.isin(TEXT_TYPES), "DATE_TO_TEXT")
        .when(s.isin(NUMBER_TYPES) & t.isin(NUMBER_TYPES), "NUMBER_TO_NUMBER")
        .when(s.isin(TEXT_TYPES) & t.isin(TEXT_TYPES), "TEXT_TO_TEXT")
        .otherwise("CUSTOM_CONVERSION")
    )


def _plain_name(name: str | None) -> str:
    if not name:
        return "VARCHAR"
    bare = re.sub(r"\(\d+\)|\(\d+,\d+\)", "", name.upper())
    return re.sub(r"FB_TYPE_\d+", "VARCHAR", bare).strip()


def conversion_kind(source: str | None, target: str | None) -> str:
    """``classify_conversion`` for two names known while the plan is built."""
    s, t = _plain_name(source), _plain_name(target)
    if s == t:
        return "DIRECT"
    family = {n: f for f, names in (("TEXT", TEXT_TYPES), ("NUMBER", NUMBER_TYPES), ("DATE", DATE_TYPES)) for n in names}
    pair = (family.get(s), family.get(t))
    known = {("TEXT", "DATE"), ("TEXT", "NUMBER"), ("NUMBER", "TEXT"), ("DATE", "TEXT"), ("NUMBER", "NUMBER"), ("TEXT", "TEXT")}
    return f"{pair[0]}_TO_{pair[1]}" if pair in known else "CUSTOM_CONVERSION"


def _calendar_day(c: Column) -> Column:
    t = strip_space(c)

    def day(iso: Column) -> Column:
        return F.regexp_extract(iso, ISO_DAY, 1).try_cast("date")

    ordered = F.regexp_replace(F.regexp_replace(t, DAY_FIRST, "$4-$3-$1"), YEAR_DIGITS, "$1-$2-$3")
    return F.coalesce(day(ordered), day(F.regexp_replace(t, DAY_DIGITS, "$3-$2-$1")))


def text_to_date(c: Column) -> Column:
    """Dirty text to a date.

    ``YYYY-MM-DD``, ``DD/MM/YYYY``, ``DD-MM-YYYY``, ``YYYYMMDD`` and ``DDMMYYYY``
    are tried in this order and must be real calendar dates from year 100 on.
    ISO date-times are accepted last.  Anything else is NULL.
    """
    return F.coalesce(_calendar_day(c), parse_iso(c).cast("date"))


def text_to_timestamp(c: Column) -> Column:
    """Like ``text_to_date`` but keeps the time of day an ISO date-time carries."""
    return F.coalesce(_calendar_day(c).cast("timestamp_ntz"), parse_iso(c))


def clean_number_text(c: Column) -> Column:
    """Drop white space and thousands commas; a lone comma becomes the point."""
    bare = F.regexp_replace(drop_space(c), r",(?=\d{3})", "")
    return F.regexp_replace(bare, r"^([^,.]*),([^,.]*)$", "$1.$2")


def text_to_number(c: Column) -> Column:
    """Dirty text to a double; empty text and junk are NULL, blank text is 0."""
    return plain_number(F.regexp_replace(clean_number_text(present(c)), "^$", "0"))


def text_to_integer(c: Column) -> Column:
    return round_half_up(text_to_number(c)).try_cast("bigint")


def number_to_number(c: Column, target: str) -> Column:
    """Integer targets are rounded half up, other targets keep the value."""
    if any(n in _plain_name(target) for n in INTEGER_TYPES):
        return round_half_up(c.cast("double")).try_cast("bigint")
    return c.cast("double")


def date_to_text(c: Column, dtype: T.DataType) -> Column:
    return c if is_text(dtype) else F.date_format(c, "yyyy-MM-dd")


def typed_value(c: Column, dtype: T.DataType, source: str, target: str) -> tuple[Column, T.DataType]:
    """The converted value in its natural Spark type, NULL when it cannot be."""
    kind = conversion_kind(source, target)
    name = _plain_name(target)
    if kind == "DIRECT":
        return c, dtype
    if kind == "TEXT_TO_DATE":
        text = c.cast("string")
        if name == "TIME":
            clock = F.date_format(text_to_timestamp(text), "HH:mm:ss")
            return clock, T.StringType()
        if name in ("TIMESTAMP", "DATETIME"):
            return text_to_timestamp(text), T.TimestampNTZType()
        return text_to_date(text), T.DateType()
    if kind == "TEXT_TO_NUMBER":
        text = c.cast("string")
        if name in INTEGER_TYPES:
            return text_to_integer(text), T.LongType()
        return text_to_number(text), T.DoubleType()
    if kind == "NUMBER_TO_NUMBER":
        number = number_from_text(c) if is_text(dtype) else c
        integral = name in INTEGER_TYPES
        return number_to_number(number, name), T.LongType() if integral else T.DoubleType()
    if kind == "DATE_TO_TEXT":
        return date_to_text(c, dtype), T.StringType()
    return value_text(c, dtype), T.StringType()


def _verdict(value: Column, value_type: T.DataType, original: Column, kind: str) -> Column:
    """``struct(value, success, conversion_type, error)`` of a parsed value."""
    what = {"TEXT_TO_DATE": "date", "TEXT_TO_NUMBER": "number", "NUMBER_TO_NUMBER": "number"}.get(kind)
    shown = F.date_format(value, "yyyy-MM-dd") if isinstance(value_type, T.DateType) else value_text(value, value_type)
    error = F.lit(None).cast("string")
    success = F.lit(True)
    if what:
        success = original.isNull() | value.isNotNull()
        message = F.when(original == "", F.lit(f"empty text is not a {what}")).otherwise(
            F.concat(F.lit("cannot convert '"), original, F.lit(f"' to a {what}"))
        )
        error = F.when(~success, message)
    return F.struct(
        F.coalesce(shown, original).alias("value"),
        success.alias("success"),
        F.lit(kind).alias("conversion_type"),
        error.alias("error"),
    )


def convert(c: Column, dtype: T.DataType, source: str, target: str) -> Column:
    """Convert one column and say how each value fared."""
    value, value_type = typed_value(c, dtype, source, target)
    return _verdict(value, value_type, value_text(c, dtype), conversion_kind(source, target))


@dataclass(frozen=True)
class Conversion:
    """One column to convert: where it comes from, where it goes, and the types."""

    source: str
    target: str
    source_type: str
    target_type: str
    convert: bool = True


def _source_column(df: DataFrame, name: str) -> tuple[Column, T.DataType]:
    if name in df.columns:
        return F.col(f"`{name}`"), df.schema[name].dataType
    return F.lit(None).cast("string"), T.StringType()


def _parsed(df: DataFrame, conversions: Iterable[Conversion]) -> tuple[DataFrame, list]:
    """Parse every converted column once, ahead of whatever looks at the result.

    Returns the wider table and ``(conversion, value, type, original text)``.
    """
    values, parts = {}, []
    for i, cv in enumerate(conversions):
        c, dtype = _source_column(df, cv.source)
        if not cv.convert:
            parts.append((cv, c, dtype, value_text(c, dtype)))
            continue
        value, value_type = typed_value(c, dtype, cv.source_type, cv.target_type)
        values[f"__v{i}"] = value
        parts.append((cv, F.col(f"__v{i}"), value_type, value_text(c, dtype)))
    return df.withColumns(values) if values else df, parts


def convert_table(df: DataFrame, conversions: Iterable[Conversion]) -> DataFrame:
    """Convert the listed columns and drop all others.

    Failed values keep their original text, so converted columns are text; use
    ``typed_table`` where failures should be NULL in typed columns.
    """
    wide, parts = _parsed(df, conversions)
    return wide.select(
        [
            (_verdict(v, t, original, conversion_kind(cv.source_type, cv.target_type))["value"] if cv.convert else v).alias(cv.target)
            for cv, v, t, original in parts
        ]
    )


def typed_table(df: DataFrame, conversions: Iterable[Conversion], keep: Iterable[str] = ()) -> DataFrame:
    """Convert the listed columns into typed ones; failures are NULL."""
    out = [F.col(f"`{k}`") for k in keep]
    for cv in conversions:
        c, dtype = _source_column(df, cv.source)
        value = typed_value(c, dtype, cv.source_type, cv.target_type)[0] if cv.convert else c
        out.append(value.alias(cv.target))
    return df.select(out)


def conversion_report(df: DataFrame, conversions: Iterable[Conversion], key: str) -> DataFrame:
    """One row per value that could not be converted, named by the row's key.

    All columns are checked in one pass over the table.
    """
    wide, parts = _parsed(df, [cv for cv in conversions if cv.convert])
    checks = []
    for cv, value, value_type, original in parts:
        verdict = _verdict(value, value_type, original, conversion_kind(cv.source_type, cv.target_type))
        failed = F.struct(
            F.lit(cv.source).alias("source_column"),
            F.lit(cv.target).alias("target_column"),
            F.lit(cv.source_type).alias("source_type"),
            F.lit(cv.target_type).alias("target_type"),
            original.alias("original_value"),
            F.lit(conversion_kind(cv.source_type, cv.target_type)).alias("conversion_type"),
            verdict["error"].alias("error"),
        )
        checks.append(F.when(verdict["error"].isNotNull(), failed))
    return wide.select(F.col(key), F.inline(F.array(*checks))).where(F.col("source_column").isNotNull())


def conversion_summary(df: DataFrame, conversions: Iterable[Conversion]) -> DataFrame:
    """Values checked and failed per column pair and conversion, in one pass."""
    wide, parts = _parsed(df, [cv for cv in conversions if cv.convert])
    totals = wide.agg(
        F.count(F.lit(1)).alias("n"),
        *[
            F.count_if(~_verdict(v, t, original, conversion_kind(cv.source_type, cv.target_type))["success"]).alias(f"f{i}")
            for i, (cv, v, t, original) in enumerate(parts)
        ],
    )
    rows = F.array(
        *[
            F.struct(
                F.lit(cv.source).alias("source_column"),
                F.lit(cv.source_type).alias("source_type"),
                F.lit(cv.target_type).alias("target_type"),
                F.lit(conversion_kind(cv.source_type, cv.target_type)).alias("conversion_type"),
                F.col("n").alias("checked"),
                F.col(f"f{i}").alias("failed"),
            )
            for i, (cv, *_) in enumerate(parts)
        ]
    )
    return totals.select(F.inline(rows))


def apply_value_rule(
    c: Column, dtype: T.DataType, source_type: str, target_type: str, source_db: str, target_db: str
) -> Column:
    """Dialect value rules: flags to 0/1 numbers, timestamp text to timestamps.

    Text that holds no timestamp is NULL; what no rule is about is passed through unchanged.
    """
    pair = (source_type.upper(), target_type.upper())
    dbs = (source_db.lower(), target_db.lower())
    if pair == ("BOOLEAN", "NUMBER(1,0)") and dbs == ("mysql", "oracle") and isinstance(dtype, T.BooleanType):
        return c.cast("int")
    if pair == ("TIMESTAMP", "TIMESTAMP") and is_text(dtype):
        return text_to_timestamp(c)
    return c

