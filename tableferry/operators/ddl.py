"""Target structure: DDL text per table, and creating or dropping tables."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _quoted(c: Column) -> Column:
    return F.concat(F.lit('"'), c, F.lit('"'))


def target_ddl(catalog: DataFrame) -> DataFrame:
    """DDL statements per distinct table, in the order they should run.

    ``catalog`` needs ``table_name, ordinal, column_name, type, nullable,
    default_value, auto_increment, is_pk``.  A table's columns are gathered in
    position order; they are as many as the table has columns.
    """
    definition = F.concat(
        F.lit("  "),
        _quoted(F.col("column_name")),
        F.lit(" "),
        F.col("type"),
        F.when(F.col("nullable"), "").otherwise(" NOT NULL"),
        F.when(F.col("default_value").isNull(), "").otherwise(F.concat(F.lit(" DEFAULT '"), F.col("default_value"), F.lit("'"))),
    )
    per_table = (
        catalog.dropDuplicates(["table_name", "ordinal", "column_name"])
        .groupBy("table_name")
        .agg(
            F.array_sort(F.collect_list(F.struct("ordinal", definition.alias("def")))).alias("defs"),
            F.array_sort(F.collect_list(F.when(F.col("is_pk"), F.struct("ordinal", "column_name")))).alias("keys"),
            F.array_sort(F.collect_list(F.when(F.col("auto_increment"), F.struct("ordinal", "column_name")))).alias("autos"),
        )
    )
    keys = F.array_join(F.transform("keys", lambda k: _quoted(k["column_name"])), ", ")
    has_key = F.size("keys") > 0
    create = F.concat(
        F.lit("CREATE TABLE "),
        _quoted(F.col("table_name")),
        F.lit(" (\n"),
        F.array_join(F.transform("defs", lambda d: d["def"]), ",\n"),
        F.when(has_key, F.concat(F.lit(",\n  PRIMARY KEY ("), keys, F.lit(")"))).otherwise(""),
        F.lit("\n);"),
    )
    generators = F.flatten(
        F.transform(
            "autos",
            lambda a: F.array(
                F.concat(F.lit("CREATE GENERATOR GEN_"), F.upper(a["column_name"]), F.lit(";")),
                F.concat(F.lit("SET GENERATOR GEN_"), F.upper(a["column_name"]), F.lit(" TO 0;")),
            ),
        )
    )
    index = F.concat(
        F.lit("CREATE UNIQUE INDEX PK_"), F.upper("table_name"), F.lit(" ON "), _quoted(F.col("table_name")), F.lit(" ("), keys, F.lit(");")
    )
    statements = F.concat(F.array(create), generators, F.when(has_key, F.array(index)).otherwise(F.array().cast("array<string>")))
    return per_table.select("table_name", F.posexplode(statements).alias("statement_no", "statement"))


def create_table(spark: SparkSession, name: str, structure: DataFrame, if_absent: bool = True) -> bool:
    """Create an empty table with a DataFrame's structure; False if it was there."""
    if spark.catalog.tableExists(name):
        if not if_absent:
            raise ValueError(f"table {name} already exists")
        return False
    structure.limit(0).write.saveAsTable(name)
    return True


def drop_table(spark: SparkSession, name: str, strict: bool = False) -> None:
    """Drop a table; a strict drop fails when there is none."""
    spark.sql(f"DROP TABLE {'' if strict else 'IF EXISTS '}{name}")


def jdbc_column_types(columns: Iterable[tuple[str, str]]) -> str:
    """The ``createTableColumnTypes`` option for ``(name, type)`` pairs."""
    return ", ".join(f"{name} {type_name}" for name, type_name in columns)
