"""Name and type similarity, as Columns and at plan time."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tableferry.functions.text import strip_space

# Types that count as close to each other.
TYPE_GROUPS = {
    "text": ["CHAR", "STRING", "TEXT", "VARCHAR"],
    "integer": ["BIGINT", "INT", "INTEGER", "NUMBER", "SMALLINT"],
    "decimal": ["DECIMAL", "DOUBLE", "FLOAT", "NUMERIC", "REAL"],
    "date": ["DATE", "DATETIME", "TIMESTAMP"],
    "boolean": ["BIT", "BOOLEAN", "LOGICAL"],
    "binary": ["BINARY", "BLOB", "VARBINARY"],
}
GROUP_OF = {name: group for group, names in TYPE_GROUPS.items() for name in names}

# The weights and thresholds of the scores.
NAME_WEIGHT, TYPE_WEIGHT = 0.7, 0.3
CONTAINED, SAME_GROUP = 0.8, 0.8
TABLE_NAME_WEIGHT, COUNT_WEIGHT, STRUCTURE_WEIGHT = 0.4, 0.2, 0.4
COLUMN_THRESHOLD, SUGGESTION_THRESHOLD, AUTO_MAP_THRESHOLD = 0.5, 0.3, 0.7

# Which target types a source type may be copied into as it is.
COMPATIBLE = {
    "BLOB": ["TEXT", "VARCHAR"],
    "INTEGER": ["BIGINT", "NUMERIC", "SMALLINT"],
    "REAL": ["DOUBLE", "FLOAT", "NUMERIC"],
    "TEXT": ["BLOB", "CHAR", "VARCHAR"],
    "VARCHAR": ["CHAR", "STRING", "TEXT"],
}


def six_digits(c: Column) -> Column:
    """A score at six digits, halves up, by plain arithmetic.

    Every engine and NumPy give the same result, so equal scores stay ties.
    """
    return F.floor(c * 1e6 + 0.5) / 1e6


def plain_name(c: Column) -> Column:
    """The form in which names are compared."""
    return strip_space(F.lower(c))


def plain_similarity(x: Column, y: Column) -> Column:
    """Similarity of two names already in plain form."""
    longest = F.greatest(F.char_length(x), F.char_length(y))
    return (
        F.when(x == y, 1.0)
        .when((x == "") | (y == ""), 0.0)
        .when(x.contains(y) | y.contains(x), CONTAINED)
        .otherwise((longest - F.levenshtein(x, y)) / longest)
    )


def string_similarity(a: Column, b: Column) -> Column:
    """1 for equal names, 0.8 when one contains the other, else by edit distance."""
    return plain_similarity(plain_name(a), plain_name(b))


def with_similarity(df: DataFrame, a: str, b: str, out: str) -> DataFrame:
    """Add the similarity of two columns; each name is put in plain form once."""
    plain = df.withColumns({"__x": plain_name(F.col(a)), "__y": plain_name(F.col(b))})
    return plain.withColumn(out, plain_similarity(F.col("__x"), F.col("__y"))).drop("__x", "__y")


def type_group(c: Column) -> Column:
    groups = F.create_map(*[F.lit(v) for v in chain.from_iterable(GROUP_OF.items())])
    return F.try_element_at(groups, F.upper(c))


def type_similarity(a: Column, b: Column) -> Column:
    """1 for the same type name, 0.8 within a group, else 0.

    Names are compared as written: ``VARCHAR(20)`` is only like itself.
    """
    close = F.coalesce(type_group(a) == type_group(b), F.lit(False))
    return F.when(F.upper(a) == F.upper(b), 1.0).when(close, SAME_GROUP).otherwise(0.0)


def types_alike(a: str, b: str) -> float:
    """``type_similarity`` for two names known while the plan is built."""
    x, y = a.upper(), b.upper()
    if x == y:
        return 1.0
    return SAME_GROUP if x in GROUP_OF and GROUP_OF[x] == GROUP_OF.get(y) else 0.0


def types_compatible(a: Column, b: Column) -> Column:
    """Whether the source type may be copied into the target type; directional."""
    allowed = F.create_map(
        *[v for k, names in COMPATIBLE.items() for v in (F.lit(k), F.array(*[F.lit(n) for n in names]))]
    )
    return F.coalesce(F.array_contains(F.try_element_at(allowed, F.upper(a)), F.upper(b)), F.lit(False))


def compatibility_score(
    source_type: Column, target_type: Column, source_precision: Column, target_precision: Column
) -> Column:
    """Score of a name match: base, plus type and precision agreement, at most 1."""
    by_type = F.when(source_type == target_type, 0.4).when(types_compatible(source_type, target_type), 0.2).otherwise(0.0)
    same = (source_precision != 0) & (source_precision == target_precision)
    return F.least(F.lit(1.0), F.lit(0.5) + by_type + F.when(same, 0.1).otherwise(0.0))


def similarity_reason(score: Column) -> Column:
    return (
        F.when(score > 0.9, "name very similar and structure compatible")
        .when(score > 0.7, "column structure compatible")
        .when(score > 0.5, "some similar columns")
        .otherwise("possible match by structure")
    )
