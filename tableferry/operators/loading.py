"""Loading and what is known about it: writes, reconciliation, statistics."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from tableferry.functions.dialects import Rule, broken_rules
from tableferry.functions.type_rules import spark_type
from tableferry.operators.numbering import running_total


def observed(df: DataFrame, label: str, *extra: Column):
    """The DataFrame with a row counter that fills in while it is written."""
    seen = Observation(label)
    return df.observe(seen, F.count(F.lit(1)).alias("row_count"), *extra), seen


def append_files(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "append") -> None:
    df.write.mode(mode).format(fmt).save(path)


def append_jdbc(
    df: DataFrame, url: str, table: str, batch_size: int = 1000, options: Mapping[str, str] | None = None, mode: str = "append"
) -> None:
    """Bulk insert through a JDBC driver; the first error fails the task."""
    df.write.format("jdbc").mode(mode).options(**(options or {})).option("url", url).option("dbtable", table).option(
        "batchsize", str(batch_size)
    ).save()


def dry_run(tables: Mapping[str, tuple[DataFrame, DataFrame]]) -> DataFrame:
    """Read, transform and count without writing.

    ``tables`` maps a target to its (source, marked) DataFrames, where the
    marked one carries a boolean ``is_good``.  Each target is run once to the
    ``noop`` sink and its counters come back as one row.
    """
    rows = []
    spark = None
    for target, (source, marked) in tables.items():
        spark = source.sparkSession
        run, seen = observed(
            marked,
            f"dry-run-{target}",
            F.count_if(F.col("is_good")).alias("good"),
            F.count_if(~F.col("is_good")).alias("rejected"),
        )
        run.write.format("noop").mode("overwrite").save()
        got = seen.get
        rows.append((target, got["row_count"], got["good"], got["rejected"]))
    return spark.createDataFrame(rows, "target_table string, rows_read bigint, rows_good bigint, rows_rejected bigint")


def reconcile_counts(source: DataFrame, target: DataFrame) -> DataFrame:
    """Row counts per table on both sides, and whether they agree."""
    s = source.select("table_name", F.col("row_count").alias("source_rows"))
    t = target.select("table_name", F.col("row_count").alias("target_rows"))
    joined = s.join(t, "table_name", "full")
    src, tgt = F.coalesce("source_rows", F.lit(0)), F.coalesce("target_rows", F.lit(0))
    return joined.select(
        "table_name",
        src.alias("source_rows"),
        tgt.alias("target_rows"),
        (src - tgt).alias("difference"),
        F.when(src == tgt, "ok").otherwise("warning").alias("status"),
    )


def largest_table(counts: DataFrame) -> DataFrame:
    """The table with most rows; the first by name wins a tie; none if all are empty."""
    top = counts.where(F.col("row_count") > 0).agg(F.min(F.struct((-F.col("row_count")).alias("neg"), "table_name")).alias("t"))
    return top.select(F.col("t.table_name").alias("table_name"), (-F.col("t.neg")).alias("row_count"))


def seconds_between(start: Column, end: Column) -> Column:
    """Seconds between two timestamps, with their fraction."""
    return F.timestamp_diff("MICROSECOND", start, end) / F.lit(1000000.0)


def migration_stats(log: DataFrame, total_tables: int | None = None, error_limit: int = 0) -> DataFrame:
    """One row of statistics over a batch log.

    Tables with more than ``error_limit`` errors are listed as problematic;
    the list is NULL when there are none.
    """
    per_table = log.groupBy("table_name").agg(
        F.sum("row_count").alias("records"),
        F.sum("error_count").alias("errors"),
        F.min("started_at").alias("started_at"),
        F.max("ended_at").alias("ended_at"),
    )
    duration = seconds_between(F.min("started_at"), F.max("ended_at"))
    bad = F.when(F.col("errors") > error_limit, F.col("table_name"))
    return per_table.agg(
        (F.lit(total_tables) if total_tables is not None else F.count(F.lit(1))).cast("bigint").alias("total_tables"),
        F.count(F.lit(1)).alias("tables_processed"),
        F.sum("records").cast("bigint").alias("records_processed"),
        F.sum("errors").cast("bigint").alias("errors"),
        F.round(duration, 3).alias("duration_seconds"),
        F.round(F.try_divide(F.sum("records"), duration), 4).alias("average_throughput"),
        F.max_by("table_name", F.struct("records", "table_name")).alias("largest_table"),
        F.nullif(F.array_join(F.array_sort(F.collect_list(bad)), ","), F.lit("")).alias("problem_tables"),
    )


def batch_progress(log: DataFrame) -> DataFrame:
    """Progress after every batch: rows so far, percent, throughput and time left.

    ``batch_no`` is an integer, unique within a table.
    """
    totals = log.groupBy("table_name").agg(F.sum("row_count").alias("total"), F.min("started_at").alias("start"))
    run = running_total(log, "batch_no", "row_count", "processed", keys=["table_name"]).join(totals, "table_name")
    elapsed = seconds_between(F.col("start"), F.col("ended_at"))
    speed = F.try_divide(F.col("processed"), elapsed)
    return run.select(
        "table_name",
        "batch_no",
        F.col("row_count").alias("batch_rows"),
        F.col("processed").cast("bigint").alias("processed"),
        F.col("total").cast("bigint").alias("total"),
        F.floor(F.col("processed") * 100 / F.col("total") + 0.5).cast("int").alias("percent"),
        F.round(speed, 4).alias("throughput"),
        F.round(F.try_divide(F.col("total") - F.col("processed"), speed), 3).alias("eta_seconds"),
    )


def write_quarantined(df: DataFrame, rules: Iterable[Rule], path: str) -> tuple[DataFrame, DataFrame]:
    """Check and write a table in one pass, good and rejected rows side by side.

    Returns both halves as read back; each reads only its own files.
    """
    marked = df.withColumn("reject_reason", broken_rules(df, list(rules))).withColumn("is_good", F.col("reject_reason") == "")
    marked.write.mode("errorifexists").partitionBy("is_good").parquet(path)
    back = df.sparkSession.read.schema(marked.schema).parquet(path)
    return back.where("is_good").drop("is_good", "reject_reason"), back.where("NOT is_good").drop("is_good")


def reject_unfit(df: DataFrame, targets: Mapping[str, str]) -> tuple[DataFrame, DataFrame]:
    """Insert with per-row errors: rows whose values do not fit the target types
    go to the second DataFrame with the offending columns named.
    """
    casts = {c: F.col(f"`{c}`").try_cast(spark_type(t)) for c, t in targets.items()}
    unfit = [F.when(F.col(f"`{c}`").isNotNull() & v.isNull(), F.lit(c)) for c, v in casts.items()]
    marked = df.withColumn("unfit_columns", F.concat_ws(",", *unfit))
    good = marked.where(F.col("unfit_columns") == "").select([casts.get(c, F.col(f"`{c}`")).alias(c) for c in df.columns])
    return good, marked.where(F.col("unfit_columns") != "")

