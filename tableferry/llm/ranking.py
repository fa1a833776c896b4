"""Gapless numbers and running totals inside groups of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BLOCKS = 1024


def numbered(df: DataFrame, group: list[str], order: list[str], weight: str | None = None, blocks: int = BLOCKS) -> DataFrame:
    """Identical rows as one, with ``copies`` and ``before``: the weight that stands before them in their group.

    ``weight`` names a long column (1 if absent).  A group is cut into ``blocks``
    hash blocks of its ``order`` columns; sums run inside a block, and block
    totals are added up one level above, so no task holds a group.  Identical
    rows are counted before the shuffle, so even a row repeated very often
    takes one place in its block.  The order is the same on every run.  NULL
    group values form a group.
    """
    each = F.col(weight) if weight else F.lit(1)
    rows = df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias("copies"))
    rows = rows.withColumn("_block", F.pmod(F.xxhash64(*order, F.lit("block")), F.lit(blocks)).cast("int"))
    rows = rows.withColumn("_mass", F.col("copies") * each)
    inside = Window.partitionBy(*group, "_block").orderBy(*order, *[c for c in df.columns if c not in order])
    rows_before = F.coalesce(F.sum("_mass").over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    totals = rows.groupBy(*group, "_block").agg(F.sum("_mass").alias("_total"))
    over = Window.partitionBy(*group).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select(
        *[F.col(c).alias(f"_g_{c}") for c in group],
        F.col("_block").alias("_b"),
        F.coalesce(F.sum("_total").over(over), F.lit(0)).alias("_base"),
    )
    rows = rows.withColumn("_inside", rows_before)
    match = F.col("_block") == F.col("_b")
    for c in group:
        match = match & F.col(c).eqNullSafe(F.col(f"_g_{c}"))
    return rows.join(bases, match).select(*df.columns, "copies", (F.col("_base") + F.col("_inside")).alias("before"))


def expanded(df: DataFrame) -> DataFrame:
    """One row per copy again, with its number ``copy`` from 0."""
    return df.withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)))
