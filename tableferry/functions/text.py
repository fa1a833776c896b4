"""Text and number helpers shared by transforms, conversions and dialect rules.

The source systems compare and print values by JavaScript rules; the helpers
here spell out those rules with built-in Spark functions only.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The characters that count as white space when text is trimmed.
SPACE = (
    "\t\n\x0b\x0c\r \u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006"
    "\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"
)

# The shapes of a plain number and of the dates that parse freely.
NUMBER_SHAPE = r"^([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)$"
NUMBER_PREFIX = r"^\s*([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)"
INTEGER_PREFIX = r"^\s*([+-]?\d+)"
ISO_LOCAL = r"^\d{4}-\d{2}-\d{2}(?:[T ]\d{2}:\d{2}(?::\d{2}(?:\.\d{1,9})?)?)?$"
ISO_ZONED = r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}(?::\d{2}(?:\.\d{1,9})?)?(?:Z|[+-]\d{2}:?\d{2})$"

INTEGRAL = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
FRACTIONAL = (T.FloatType, T.DoubleType)
TEMPORAL = (T.DateType, T.TimestampType, T.TimestampNTZType)


def is_text(dtype: T.DataType) -> bool:
    return isinstance(dtype, (T.StringType, T.VarcharType, T.CharType))


def is_number(dtype: T.DataType) -> bool:
    return isinstance(dtype, T.NumericType)


def strip_space(c: Column) -> Column:
    """Trim every kind of white space, not just blanks."""
    return F.btrim(c, F.lit(SPACE))


def drop_space(c: Column) -> Column:
    return F.translate(c, SPACE, "")


def round_half_up(c: Column) -> Column:
    """Round to the nearest integer, halves towards plus infinity (-2.5 -> -2).

    NULL beyond the range of a bigint.  Written without a condition so that
    Spark evaluates ``c`` only once.
    """
    inside = c.try_cast("bigint") * 0
    return F.try_add(F.try_add(F.floor(c), (c - F.floor(c) >= 0.5).cast("bigint")), inside)


def number_from_text(c: Column) -> Column:
    """The number a piece of text spells, NULL when it spells none; blank is 0."""
    return plain_number(F.regexp_replace(strip_space(c), "^$", "0"))


def present(c: Column) -> Column:
    """NULL for empty text: a cast that fails on text is slow, one on NULL is not."""
    return F.nullif(c, F.lit(""))


def plain_number(c: Column) -> Column:
    """A number written plainly, NULL for anything else."""
    return present(F.regexp_extract(c, NUMBER_SHAPE, 1)).try_cast("double")


def leading_integer(c: Column) -> Column:
    return present(F.regexp_extract(c, INTEGER_PREFIX, 1)).try_cast("bigint")


def leading_number(c: Column) -> Column:
    return present(F.regexp_extract(c, NUMBER_PREFIX, 1)).try_cast("double")


def number_to_text(c: Column, dtype: T.DataType) -> Column:
    """Shortest form of a number: ``1`` rather than ``1.0``, exponents as ``1e+21``."""
    if isinstance(dtype, T.DecimalType):
        text = c.cast("string")
        return F.when(text.contains("."), F.regexp_replace(text, r"\.?0+$", "")).otherwise(text)
    if not isinstance(dtype, FRACTIONAL):
        return c.cast("string")
    size = F.abs(c)
    raw = c.cast("string")
    plain = F.regexp_replace(raw.try_cast("decimal(38,17)").cast("string"), r"\.?0+$", "")
    exponent = F.regexp_replace(F.regexp_replace(raw, r"(\.0)?E(\d)", "e+$2"), r"(\.0)?E-", "e-")
    return (
        F.when((size < 2.0**53) & (c == F.floor(c)), c.cast("bigint").cast("string"))
        .when((size >= 1e-3) & (size < 1e7), raw)
        .when((size >= 1e-6) & (size < 1e21), plain)
        .otherwise(exponent)
    )


def iso_text(c: Column) -> Column:
    """A timestamp as ``yyyy-MM-ddTHH:mm:ss.SSSZ``; the value is taken as UTC."""
    return F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def value_text(c: Column, dtype: T.DataType) -> Column:
    """Any value as text."""
    if is_text(dtype):
        return c
    if is_number(dtype):
        return number_to_text(c, dtype)
    if isinstance(dtype, (T.TimestampType, T.TimestampNTZType)):
        return iso_text(c)
    return c.cast("string")


def parse_iso(c: Column) -> Column:
    """ISO date or date-time text to a zone-free UTC timestamp, NULL otherwise."""
    t = strip_space(c)
    local = F.regexp_extract(t, ISO_LOCAL, 0).try_cast("timestamp_ntz")
    instant = F.regexp_extract(t, ISO_ZONED, 0).try_cast("timestamp")
    return F.coalesce(local, F.to_utc_timestamp(instant, F.current_timezone()).cast("timestamp_ntz"))


def truthy(c: Column, dtype: T.DataType) -> Column:
    """JavaScript truth: empty text and zero are false, everything else true."""
    if isinstance(dtype, T.BooleanType):
        return c
    if is_text(dtype):
        return c != ""
    if isinstance(dtype, FRACTIONAL):
        return ~((c == 0) | F.isnan(c))
    if is_number(dtype):
        return c != 0
    return F.when(c.isNotNull(), F.lit(True))
