"""Legacy-looking views over the test tables.

Each view is a projection or a small aggregate of a driver table, so its size
grows with the table it comes from.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
    "embeddings", "pages", "benchmark", "labels", "conversations",
)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def all_tables(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    return {name: table(spark, folder, name) for name in TABLES}


def legacy_orders(spark: SparkSession, folder: str) -> DataFrame:
    """Orders with mixed date and number formats, padded text and a T/F flag."""
    return table(spark, folder, "orders").selectExpr(
        "lpad(CAST(o_orderkey AS STRING), 10, '0') AS order_no",
        "CAST(o_custkey AS STRING) AS cust_no",
        """CASE CAST(o_orderkey % 6 AS INT)
             WHEN 0 THEN date_format(o_orderdate, 'yyyy-MM-dd')
             WHEN 1 THEN date_format(o_orderdate, 'dd/MM/yyyy')
             WHEN 2 THEN date_format(o_orderdate, 'dd-MM-yyyy')
             WHEN 3 THEN date_format(o_orderdate, 'yyyyMMdd')
             WHEN 4 THEN date_format(o_orderdate, 'ddMMyyyy')
             ELSE 'n/a' END AS order_date_txt""",
        """CASE CAST(o_orderkey % 5 AS INT)
             WHEN 0 THEN format_number(CAST(o_totalprice AS DECIMAL(18,2)), 2)
             WHEN 1 THEN replace(CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS STRING), '.', ',')
             WHEN 2 THEN concat('  ', CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS STRING), ' ')
             WHEN 3 THEN CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS STRING)
             ELSE CASE WHEN o_orderkey % 2 = 0 THEN 'abc' ELSE '' END END AS total_txt""",
        "o_orderstatus AS status",
        "concat(char(9), o_orderpriority, '  ', char(10)) AS priority_pad",
        "CASE CAST(o_orderkey % 3 AS INT) WHEN 0 THEN 'T' WHEN 1 THEN 'F' ELSE '?' END AS paid_flag",
        """CASE CAST(o_orderkey % 7 AS INT) WHEN 0 THEN NULL WHEN 1 THEN ''
             ELSE concat('N', CAST(o_orderkey AS STRING)) END AS note""",
    )


def legacy_customer(spark: SparkSession, folder: str) -> DataFrame:
    """Customers with padded names, halves to round and an out-of-range code."""
    return table(spark, folder, "customer").selectExpr(
        "CAST(c_custkey AS STRING) AS cust_no",
        "rpad(c_name, 30, ' ') AS name_alpha",
        "CAST(CAST(c_acctbal AS DECIMAL(15,2)) AS STRING) AS balance_txt",
        "CASE WHEN c_custkey % 10 = 0 THEN NULL ELSE c_mktsegment END AS segment",
        "c_nationkey AS nation_no",
        "CAST(c_custkey AS DOUBLE) / 2 - 100 AS credit_score",
        "CASE WHEN c_custkey % 20 = 0 THEN 40000 ELSE CAST(c_custkey % 1000 AS INT) END AS small_code",
    )


def batch_log(spark: SparkSession, folder: str) -> DataFrame:
    """One row per loaded batch: events of one type, a thousand ids at a time."""
    return table(spark, folder, "events").groupBy(
        F.col("event_type").alias("table_name"), F.expr("event_id DIV 1000").alias("batch_no")
    ).agg(
        F.count(F.lit(1)).alias("row_count"),
        F.min("ts").alias("started_at"),
        F.max("ts").alias("ended_at"),
        F.count_if(F.col("value") < 1).alias("error_count"),
    )


def migrated_orders(spark: SparkSession, folder: str) -> DataFrame:
    """A load target that lost some rows, to be found by reconciliation."""
    return table(spark, folder, "orders").where("o_orderkey % 100 <> 0")


def _catalog(spark: SparkSession, folder: str, table_name: str, column_name: str, types: list[str]) -> DataFrame:
    """Column catalog over all parts: a table per brand, a column per name and size."""
    picked = "CASE p_size % 6 " + " ".join(f"WHEN {i} THEN '{t}'" for i, t in enumerate(types[:-1])) + f" ELSE '{types[-1]}' END"
    columns = (
        table(spark, folder, "part")
        .selectExpr("substring(p_brand, 7) AS brand_no", "p_name", "p_size")
        .distinct()
        .selectExpr(
            f"{table_name} AS table_name",
            f"{column_name} AS column_name",
            f"{picked} AS type",
            "p_name",
            "p_size",
        )
    )
    order = F.row_number().over(Window.partitionBy("table_name").orderBy("p_name", "p_size"))
    return columns.withColumn("ordinal", order).select(
        "table_name",
        "ordinal",
        "column_name",
        "type",
        F.when(F.col("type").isin("VARCHAR", "TEXT"), F.col("p_size") * 5).cast("int").alias("max_length"),
        F.when(F.col("type").isin("DECIMAL", "NUMERIC"), 10 + F.col("p_size") % 5).cast("int").alias("precision"),
        (F.col("ordinal") % 3 == 0).alias("nullable"),
        (F.col("ordinal") == 1).alias("is_pk"),
    )


def catalog_src(spark: SparkSession, folder: str) -> DataFrame:
    """Source column catalog for schema matching."""
    return _catalog(
        spark,
        folder,
        "concat('T_', brand_no)",
        "concat(replace(p_name, ' ', '_'), '_', CAST(p_size AS STRING))",
        ["VARCHAR", "INTEGER", "DECIMAL", "DATE", "BOOLEAN", "BLOB"],
    )


def catalog_tgt(spark: SparkSession, folder: str) -> DataFrame:
    """Target column catalog: the same columns under altered names and types."""
    return _catalog(
        spark,
        folder,
        "concat('NEW_T_', brand_no)",
        """CASE p_size % 4
             WHEN 0 THEN upper(concat(replace(p_name, ' ', '_'), '_', CAST(p_size AS STRING)))
             WHEN 1 THEN concat('new_', replace(p_name, ' ', '_'), '_', CAST(p_size AS STRING))
             WHEN 2 THEN concat(replace(p_name, ' ', ''), CAST(p_size AS STRING))
             ELSE concat(reverse(p_name), CAST(p_size AS STRING)) END""",
        ["TEXT", "INTEGER", "NUMERIC", "TIMESTAMP", "BIT", "BLOB"],
    )


def catalog_fk_src(spark: SparkSession, folder: str) -> DataFrame:
    """Columns that name other tables: one ``..._ID`` column per part name and brand."""
    return (
        table(spark, folder, "part")
        .groupBy(F.expr("concat('T_', substring(p_brand, 7))").alias("table_name"), "p_name")
        .agg(F.min("p_size").alias("s"))
        .select(
            "table_name",
            F.expr("concat(replace(p_name, ' ', '_'), CASE WHEN s % 4 = 0 THEN '_CODE' ELSE '_ID' END)").alias("column_name"),
            F.expr("CASE s % 3 WHEN 0 THEN 'VARCHAR' WHEN 1 THEN 'INTEGER' ELSE 'BIGINT' END").alias("type"),
            F.lit(False).alias("is_pk"),
        )
    )


def catalog_fk_tgt(spark: SparkSession, folder: str) -> DataFrame:
    """One table per kind of part, with a key column and a text column."""
    kinds = table(spark, folder, "part").select(F.expr("split_part(p_name, ' ', 2)").alias("table_name")).distinct()
    return kinds.select(
        "table_name",
        F.inline(
            F.array(
                F.struct(F.expr("concat(upper(table_name), '_ID')").alias("column_name"), F.lit("INTEGER").alias("type"), F.lit(True).alias("is_pk")),
                F.struct(F.expr("concat(upper(table_name), '_NAME')").alias("column_name"), F.lit("VARCHAR").alias("type"), F.lit(False).alias("is_pk")),
            )
        ),
    )
