"""Stored mappings: keeping them, checking them and attaching relationships."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAPPING_SCHEMA = (
    "id string, source_table string, target_table string, enabled boolean, confidence double, "
    "columns array<struct<source_column: string, target_column: string>>"
)


def encode_mappings(mappings: DataFrame) -> DataFrame:
    """Export: one JSON document per mapping, keyed by ``id``."""
    return mappings.select("id", F.to_json(F.struct("*")).alias("doc"))


def decode_mappings(docs: DataFrame, schema: str = MAPPING_SCHEMA) -> DataFrame:
    """Import: the mappings a set of JSON documents holds."""
    return docs.select(F.from_json("doc", schema).alias("m")).select("m.*")


def latest_mappings(log: DataFrame, key: str = "id", order: str = "seq", op: str = "op") -> DataFrame:
    """State of the mapping store after all changes: the last one per id wins.

    A ``delete`` removes the mapping.  The last change is an aggregate, so a
    mapping that changes very often is reduced before the shuffle.
    """
    rest = [c for c in log.columns if c != key]
    last = log.groupBy(key).agg(F.max_by(F.struct(*rest), F.col(order)).alias("last"))
    return last.where(F.col(f"last.{op}") != "delete").select(key, *[F.col(f"last.{c}").alias(c) for c in rest if c != op])


def merge_updates(log: DataFrame, key: str = "id", order: str = "seq", op: str = "op") -> DataFrame:
    """State of the store when changes may be partial.

    ``put`` replaces a mapping, ``update`` overwrites the fields it gives (the
    ones that are not NULL) of a mapping that exists, ``delete`` removes it.
    Only the last ``put`` or ``delete`` per id matters, so it is found by a
    small aggregate, and the changes since then are folded field by field.
    """
    fields = [c for c in log.columns if c not in (key, order, op)]
    resets = (
        log.where(F.col(op) != "update")
        .groupBy(key)
        .agg(F.max(order).alias("__from"), F.max_by(op, order).alias("__last"))
        .where(F.col("__last") == "put")
    )
    since = log.join(resets, key).where(F.col(order) >= F.col("__from"))
    given = [F.max_by(F.col(c), F.when(F.col(c).isNotNull(), F.col(order))).alias(c) for c in fields]
    return since.groupBy(key).agg(F.max(order).alias(order), *given)


def mapping_errors(tables: DataFrame, columns: DataFrame, src: DataFrame, tgt: DataFrame) -> DataFrame:
    """Tables and columns that mappings name but the catalogs do not have.

    ``tables`` holds ``mapping_id, source_table, target_table``; a source may be
    a comma-joined list.  ``columns`` holds ``mapping_id, source_table,
    source_column, target_table, target_column``.  Columns are only checked in
    tables that exist.
    """
    src_tables = src.select(F.col("table_name").alias("source_table")).distinct()
    tgt_tables = tgt.select(F.col("table_name").alias("target_table")).distinct()
    src_columns = src.select(F.col("table_name").alias("source_table"), F.col("column_name").alias("source_column")).distinct()
    tgt_columns = tgt.select(F.col("table_name").alias("target_table"), F.col("column_name").alias("target_column")).distinct()
    named_sources = tables.select(
        "mapping_id", F.explode(F.split("source_table", r"\s*,\s*")).alias("source_table")
    )

    def missing(df: DataFrame, have: DataFrame, on: list[str], kind: str) -> DataFrame:
        return df.join(have, on, "left_anti").select(
            "mapping_id", F.lit(kind).alias("error"), F.concat_ws(".", *on).alias("item")
        )

    parts = [
        missing(named_sources, src_tables, ["source_table"], "source table not found"),
        missing(tables.select("mapping_id", "target_table"), tgt_tables, ["target_table"], "target table not found"),
        missing(
            columns.select("mapping_id", "source_table", "source_column").join(src_tables, "source_table", "left_semi"),
            src_columns,
            ["source_table", "source_column"],
            "source column not found",
        ),
        missing(
            columns.select("mapping_id", "target_table", "target_column").join(tgt_tables, "target_table", "left_semi"),
            tgt_columns,
            ["target_table", "target_column"],
            "target column not found",
        ),
    ]
    return reduce(DataFrame.unionByName, parts)


def apply_relationships(mappings: DataFrame, relationships: DataFrame) -> DataFrame:
    """One row per mapping and relationship that touches either of its tables.

    The two halves of the condition are two equi-joins; a relationship that
    matches both ways is kept once.  Rows are not collected per mapping, so a
    table with very many relationships stays spread out.
    """
    by_source = mappings.join(relationships.withColumnRenamed("target_table", "to_table"), "source_table").select(
        "mapping_id", F.col("source_table").alias("from_table"), "source_column", "to_table", "target_column", "join_type"
    )
    by_target = mappings.select("mapping_id", "target_table").join(
        relationships.withColumnRenamed("source_table", "from_table"), "target_table"
    ).select("mapping_id", "from_table", "source_column", F.col("target_table").alias("to_table"), "target_column", "join_type")
    return by_source.unionByName(by_target).distinct()
