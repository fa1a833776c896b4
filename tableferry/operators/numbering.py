"""Running totals, dense row numbers and batches without a single-task window.

A window over a whole table, or over one hot key, would put all its rows into
one task.  The helpers here number and add up in blocks: each block is small by
construction, and only one total per block travels to the next level.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tableferry.session import ensure_checkpoints

BLOCK_ROWS = 1 << 16
BLOCK_FAN = 1 << 12


def block_of(position: Column, size: int) -> Column:
    """The block of ``size`` positions, a power of two, that a position falls into."""
    bits = size.bit_length() - 1
    if size != 1 << bits:
        raise ValueError("block sizes are powers of two")
    return F.shiftright(position.cast("bigint"), bits)


def _join(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Inner join that also matches NULL keys; the right keys are dropped."""
    renamed = right.withColumnsRenamed({k: f"__r_{k}" for k in keys})
    on = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"__r_{k}")) for k in keys])
    return left.join(renamed, on).drop(*[f"__r_{k}" for k in keys])


def running_total(
    df: DataFrame, position: str, value: str, out: str, keys: Sequence[str] = (), fan: int = BLOCK_FAN
) -> DataFrame:
    """Add ``out``: the total of ``value`` up to and including each row.

    ``position`` is an integer that orders the rows and is unique within
    ``keys``.  Rows are added up inside blocks of ``fan`` positions; the block
    totals are added up the same way and joined back.
    """
    keys = list(keys)
    before = (Window.unboundedPreceding, -1)
    block = df.withColumn("__block", block_of(F.col(position), fan))
    upper = (
        block.groupBy(*keys, "__block").agg(F.sum(value).alias("__total")).withColumn("__upper", block_of(F.col("__block"), fan))
    )
    outer = Window.partitionBy(*keys, F.lit(0)).orderBy("__upper").rowsBetween(*before)
    tops = (
        upper.groupBy(*keys, "__upper")
        .agg(F.sum("__total").alias("__top"))
        .select(*keys, "__upper", F.coalesce(F.sum("__top").over(outer), F.lit(0)).alias("__t"))
    )
    inner = Window.partitionBy(*keys, "__upper").orderBy("__block").rowsBetween(*before)
    starts = _join(upper.withColumn("__b", F.coalesce(F.sum("__total").over(inner), F.lit(0))), tops, [*keys, "__upper"]).select(
        *keys, "__block", (F.col("__b") + F.col("__t")).alias("__start")
    )
    within = Window.partitionBy(*keys, "__block").orderBy(position).rowsBetween(Window.unboundedPreceding, 0)
    return (
        _join(block, starts, [*keys, "__block"])
        .withColumn(out, F.sum(value).over(within) + F.col("__start"))
        .drop("__block", "__start")
    )


def _starts(sizes: DataFrame, block: str) -> DataFrame:
    """Where each block's numbers start, from one row count per block.

    The counts are written to the shared folder first, so the rows behind them
    are read once however often the counts are added up.
    """
    ensure_checkpoints(sizes.sparkSession)
    return running_total(sizes.checkpoint(), block, "__n", "__end").select(block, (F.col("__end") - F.col("__n")).alias("__from"))


def number_by_key(df: DataFrame, key: str, out: str, start: int = 1, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Dense numbers in the order of an integer key, rows without a key last.

    Rows are counted per key (partial aggregation collapses repeats before the
    shuffle), and each key's first number is a running total over the
    distinct keys.  A key with more than ``block_rows`` rows, and the rows
    without a key, are cut into parts of about ``block_rows`` rows by a hash
    of the row, as many as they need; parts are numbered one after the other,
    so no window holds much more than ``block_rows`` rows however often a key
    repeats.  Equal keys are numbered in an order fixed by the rows' values.
    """
    plain = [c for c, kind in df.dtypes if not kind.startswith(("map", "variant")) and "map<" not in kind]
    k = F.col(f"`{key}`")
    # keys in order, NULL last at a position after every key
    slot = F.when(k.isNull(), F.lit(1 << 62)).otherwise(k.cast("bigint"))
    marked = df.withColumn("__slot", slot)
    counts = marked.groupBy("__slot").agg(F.count(F.lit(1)).alias("__n"))
    ensure_checkpoints(df.sparkSession)
    key_from = running_total(counts.checkpoint(), "__slot", "__n", "__end").select(
        "__slot", (F.col("__end") - F.col("__n")).alias("__kf"), F.ceil(F.col("__n") / block_rows).cast("bigint").alias("__parts")
    )
    parted = marked.join(key_from, "__slot").withColumn("__part", F.pmod(F.xxhash64(*plain), F.col("__parts")))
    sizes = parted.groupBy("__slot", "__part").agg(F.count(F.lit(1)).alias("__n"))
    part_from = running_total(sizes, "__part", "__n", "__end", keys=["__slot"]).select(
        "__slot", "__part", (F.col("__end") - F.col("__n")).alias("__pf")
    )
    order = Window.partitionBy("__slot", "__part").orderBy(*[F.col(f"`{c}`").asc_nulls_first() for c in plain])
    return (
        parted.join(part_from, ["__slot", "__part"])
        .withColumn(out, F.row_number().over(order) - 1 + F.col("__kf") + F.col("__pf") + start)
        .drop("__slot", "__part", "__kf", "__pf", "__parts")
    )


def number_by_order(df: DataFrame, order: Sequence[str], out: str, start: int = 1, partitions: int | None = None) -> DataFrame:
    """Dense numbers in any total order.

    Rows are range-partitioned and sorted once and written to the shared
    checkpoint folder, so partition ids cannot change between counting and
    numbering even if executors are lost.  Only one count per partition is
    joined back.
    """
    spark = df.sparkSession
    ensure_checkpoints(spark)
    ranged = df.repartitionByRange(partitions, *order) if partitions else df.repartitionByRange(*order)
    fixed = ranged.sortWithinPartitions(*order).checkpoint()
    placed = fixed.withColumn("__mid", F.monotonically_increasing_id()).select(
        "*",
        F.shiftright("__mid", 33).alias("__pid"),
        F.col("__mid").bitwiseAND(F.lit((1 << 33) - 1)).alias("__row"),
    )
    sizes = placed.groupBy("__pid").agg(F.count(F.lit(1)).alias("__n"))
    starts = _starts(sizes, "__pid")
    return (
        placed.join(F.broadcast(starts), "__pid")
        .withColumn(out, F.col("__from") + F.col("__row") + start)
        .drop("__mid", "__pid", "__row", "__from")
    )


def assign_batches(df: DataFrame, key: str, size: int, out: str = "batch_no", block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Put rows into batches of ``size`` in key order, counted from 0."""
    numbered = number_by_key(df, key, "__seq", start=0, block_rows=block_rows)
    return numbered.withColumn(out, F.expr(f"__seq DIV {int(size)}")).drop("__seq")
