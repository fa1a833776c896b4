"""Column rules for legacy types: what each source column becomes."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tableferry.functions.convert import text_to_date
from tableferry.functions.similarity import types_alike
from tableferry.functions.text import NUMBER_SHAPE, is_text, parse_iso, present, strip_space, value_text
from tableferry.functions.type_rules import spark_type

# One-letter codes of the legacy types, and the target each gets.
LEGACY_CODES = {
    "#": "AUTOINCREMENT", "+": "AUTOINCREMENT", "@": "TIMESTAMP", "A": "ALPHA", "C": "CURRENCY", "D": "DATE",
    "L": "LOGICAL", "M": "MEMO", "N": "NUMBER", "T": "TIME",
}
LEGACY_TARGETS = {
    "ALPHA": "VARCHAR", "AUTOINCREMENT": "INTEGER", "CURRENCY": "NUMERIC", "DATE": "DATE",
    "LOGICAL": "BOOLEAN", "MEMO": "BLOB SUB_TYPE TEXT", "NUMBER": "NUMERIC", "TIME": "TIME",
    "TIMESTAMP": "TIMESTAMP",
}
ONE_LETTER_TYPES = ["#", "+", "@", "A", "B", "C", "D", "F", "G", "L", "M", "N", "O", "T", "Y"]
SQLITE_TYPES = ["BLOB", "INTEGER", "NUMERIC", "REAL", "TEXT"]
# Text forms of true and false a legacy flag may use.
BOOLEAN_FORMS = {"1/0": ("1", "0"), "T/F": ("T", "F"), "true/false": ("true", "false")}


def legacy_kind(name: str) -> str | None:
    """The legacy type a column declares, NULL when it is not a legacy type."""
    upper = name.upper()
    kind = LEGACY_CODES.get(upper, upper)
    return kind if kind in LEGACY_TARGETS else None


def is_legacy_type(type_name: Column, original: Column) -> Column:
    """Whether a catalog column comes from the legacy source."""
    return F.coalesce(type_name.isin(ONE_LETTER_TYPES) | (F.char_length(original) == 1), F.lit(False))


def is_sqlite_type(type_name: Column) -> Column:
    return F.upper(type_name).isin(SQLITE_TYPES)


def trimmed_text(c: Column) -> Column:
    """ALPHA: padding blanks removed."""
    return F.trim(c)


def exact_number(c: Column, dtype: T.DataType, precision: int = 15, scale: int = 2) -> Column:
    """NUMBER and CURRENCY: an exact decimal, NULL when it does not fit."""
    if is_text(dtype):
        c = present(F.regexp_extract(strip_space(c), NUMBER_SHAPE, 1))
    return c.try_cast(f"decimal({precision},{scale})")


def logical(c: Column, strict: bool = False) -> Column:
    """LOGICAL: ``T`` is true, ``F`` is false; other text is NULL, or false if strict."""
    if strict:
        return F.when(c == "T", F.lit(True)).otherwise(F.lit(False))
    return F.when(c == "T", F.lit(True)).when(c == "F", F.lit(False))


def time_of_day(c: Column, dtype: T.DataType) -> Column:
    """TIME: carried as ``HH:mm:ss`` text."""
    return F.date_format(parse_iso(c) if is_text(dtype) else c, "HH:mm:ss")


def legacy_column(
    c: Column, dtype: T.DataType, source_type: str, target_type: str, precision: int = 15, scale: int = 2
) -> Column:
    """The rule for a legacy source column; others are cast to the target type.

    AUTOINCREMENT keeps the stored number: new keys come from
    ``operators.numbering``.
    """
    kind = legacy_kind(source_type)
    if kind == "ALPHA":
        return trimmed_text(value_text(c, dtype))
    if kind == "NUMBER":
        return exact_number(c, dtype, precision, scale)
    if kind == "CURRENCY":
        return exact_number(c, dtype)
    if kind == "DATE":
        return text_to_date(c) if is_text(dtype) else c.try_cast("date")
    if kind == "TIME":
        return time_of_day(c, dtype)
    if kind == "TIMESTAMP":
        return parse_iso(c) if is_text(dtype) else c.try_cast("timestamp_ntz")
    if kind == "LOGICAL":
        return logical(c)
    if kind == "MEMO":
        return c.cast("string")
    return c.try_cast(spark_type(target_type))


def sqlite_column(
    c: Column, source_type: str, target_type: str, max_length: int | None = None, precision: int = 15, scale: int = 2
) -> Column:
    """The rule for a SQLite source column; text is cut only to a length that the caller gives."""
    s, t = source_type.upper(), target_type.upper()
    if s == "TEXT" and "VARCHAR" in t:
        return c.cast("string") if max_length is None else F.substring(c.cast("string"), 1, max_length)
    if s == "INTEGER" and t == "INTEGER":
        return c
    if s == "REAL" and "NUMERIC" in t:
        return exact_number(c, T.DoubleType(), precision, scale)
    if s == "DATETIME" and t == "TIMESTAMP":
        return parse_iso(c.cast("string"))
    if s == "BLOB" and "BLOB" in t:
        return c.cast("binary")
    return c.try_cast(spark_type(target_type))


def generic_column(c: Column, dtype: T.DataType, source_type: str, target_type: str) -> tuple[str, Column]:
    """The rule for any other column: its name and the resulting Column."""
    s, t = source_type.upper(), target_type.upper()
    if types_alike(s, t) >= 0.8:
        return "direct", c
    if s in ("VARCHAR", "CHAR", "TEXT") and t in ("INTEGER", "DECIMAL", "NUMERIC"):
        return "text_to_number", c.try_cast(spark_type(t))
    if s in ("INTEGER", "DECIMAL", "NUMERIC") and t in ("VARCHAR", "CHAR", "TEXT"):
        return "number_to_text", value_text(c, dtype)
    if "DATE" in s and "DATE" in t:
        return "date_format", F.date_format(c, "yyyy-MM-dd HH:mm:ss")
    return "cast", c.try_cast(spark_type(t))


def fill_default(c: Column, default, nullable: bool = False) -> Column:
    """Fill a missing value of a NOT NULL column with its default."""
    return c if nullable or default is None else F.coalesce(c, F.lit(default))


def legacy_options(c: Column, options: Mapping) -> Column:
    """Declared options for legacy text.

    ``trim`` strips blanks, ``empty_to_null`` drops empty text,
    ``boolean`` names a pair of text forms, ``dates`` parses dates,
    ``currency`` makes a decimal(15,2), ``timestamp_precision`` truncates.
    """
    if options.get("trim"):
        c = F.trim(c)
    if options.get("empty_to_null"):
        c = F.nullif(F.trim(c), F.lit(""))
    if options.get("boolean"):
        yes, no = BOOLEAN_FORMS[options["boolean"]]
        return F.when(c == yes, F.lit(True)).when(c == no, F.lit(False))
    if options.get("dates"):
        return text_to_date(c)
    if options.get("currency"):
        return exact_number(c, T.StringType())
    if options.get("timestamp_precision"):
        return F.date_trunc(options["timestamp_precision"], c).cast("timestamp_ntz")
    return c


def split_text(c: Column, separator: str, names: list[str]) -> list[Column]:
    """One text column to several, by a literal separator."""
    return [F.nullif(F.split_part(c, F.lit(separator), F.lit(i + 1)), F.lit("")).alias(n) for i, n in enumerate(names)]


def merge_text(columns: list[Column], separator: str) -> Column:
    """Several columns to one text column; NULL parts are skipped."""
    return F.concat_ws(separator, *columns)


def calculated(expression: str, precision: int | None = None, scale: int | None = None) -> Column:
    """A free SQL expression, rounded to a decimal when a precision is given."""
    value = F.expr(expression)
    return value if precision is None else value.cast(f"decimal({precision},{scale or 0})")

