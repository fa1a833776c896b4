"""The schema catalog: one row per column, with what the data says about it.

Files declare no lengths, nullability or keys, so those come from one profiling
pass per table: nulls seen, longest text, largest precision and uniqueness.
"""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tableferry.functions.type_rules import catalog_name


def declared_columns(df: DataFrame, table: str) -> list[tuple]:
    """Catalog facts known from the schema alone; runs no job."""
    rows = []
    for i, f in enumerate(df.schema):
        decimal = isinstance(f.dataType, T.DecimalType)
        rows.append(
            (
                table,
                i + 1,
                f.name,
                catalog_name(f.dataType),
                f.metadata.get("original_type", f.dataType.simpleString()),
                f.dataType.precision if decimal else None,
                f.dataType.scale if decimal else None,
            )
        )
    return rows


def _text(value) -> str:
    """A SQL literal."""
    return "NULL" if value is None else str(value) if isinstance(value, int) else "'" + str(value).replace("'", "\\'") + "'"


def table_catalog(df: DataFrame, table: str) -> DataFrame:
    """Profile one table in a single aggregate and unfold it to one row per column."""
    schema = df.schema
    aggs, facts = ["count(1) AS n"], []
    for i, row in enumerate(declared_columns(df, table)):
        _, ordinal, column, type_name, original, precision, scale = row
        aggs.append(f"count(`{column}`) AS v{i}")
        longest = "NULL"
        if isinstance(schema[i].dataType, T.StringType):
            aggs.append(f"max(char_length(`{column}`)) AS m{i}")
            longest = f"m{i}"
        facts.append(
            f"struct({_text(table)} AS table_name, {ordinal} AS ordinal, {_text(column)} AS column_name, {_text(type_name)} AS type, "
            f"{_text(original)} AS original_type, v{i} < n AS nullable, CAST({longest} AS INT) AS max_length, "
            f"CAST({_text(precision)} AS INT) AS precision, CAST({_text(scale)} AS INT) AS scale, n AS row_count)"
        )
    return df.selectExpr(*aggs).selectExpr(f"inline(array({', '.join(facts)}))")


def schema_catalog(tables: Mapping[str, DataFrame]) -> DataFrame:
    """The catalog of several tables."""
    return reduce(DataFrame.unionByName, [table_catalog(df, name) for name, df in tables.items()])


def list_tables(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Table names with their row counts."""
    counts = [
        df.agg(F.count(F.lit(1)).alias("row_count")).select(F.lit(name).alias("table_name"), "row_count")
        for name, df in sorted(tables.items())
    ]
    return reduce(DataFrame.unionByName, counts)


def schema_summary(catalog: DataFrame) -> DataFrame:
    """Columns and rows per table, plus a line for all tables."""
    per_table = catalog.groupBy("table_name").agg(
        F.count(F.lit(1)).alias("column_count"), F.max("row_count").alias("row_count")
    )
    lines = per_table.rollup("table_name").agg(
        F.grouping("table_name").alias("all"), F.sum("column_count").alias("column_count"), F.sum("row_count").alias("row_count")
    )
    name = F.when(F.col("all") == 1, "(all tables)").otherwise(F.col("table_name"))
    return lines.select(name.alias("table_name"), "column_count", "row_count")


def key_candidates(tables: Mapping[str, DataFrame], digest: Mapping[str, tuple[str, ...]] | None = None) -> DataFrame:
    """Columns that could be a primary key: no nulls and as many values as rows.

    Counts are exact.  Every column is read alone and counted alone, so partial
    aggregation collapses its repeated values before the shuffle.  Long text
    listed in ``digest`` is compared by its SHA-256 so that whole documents are
    not shuffled.
    """
    digest = digest or {}
    out = []
    for name, df in tables.items():
        for f in df.schema:
            if isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType)):
                continue
            value = f"sha2(`{f.name}`, 256)" if f.name in digest.get(name, ()) else f"`{f.name}`"
            out.append(
                df.selectExpr("count(1) AS n", f"count(`{f.name}`) AS v", f"count(DISTINCT {value}) AS d").selectExpr(
                    f"{_text(name)} AS table_name",
                    f"{_text(f.name)} AS column_name",
                    "n AS row_count",
                    "d AS distinct_count",
                    "n > 0 AND v = n AND d = n AS is_candidate",
                )
            )
    return reduce(DataFrame.unionByName, out)
