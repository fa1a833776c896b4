"""Running a migration plan: choose, transform, rename, load, reconcile."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tableferry.functions.transforms import transform_columns
from tableferry.functions.type_rules import spark_type
from tableferry.operators.loading import observed
from tableferry.operators.restructure import rename_columns
from tableferry.plans.model import MigrationPlan
from tableferry.sources.tables import ScanRequest, apply_scan

RUN_LOG_SCHEMA = (
    "table_name string, target_table string, status string, row_count bigint, error string, "
    "started_at timestamp_ntz, ended_at timestamp_ntz, rejected_count bigint"
)
RUN, OUTCOME, REJECTED, VALUES = "migration_run", "row_outcome", "reject_columns", "source_values"


def compile_table(df: DataFrame, table: str, plan: MigrationPlan) -> DataFrame:
    """One table of a plan as a single lazy projection over a filtered scan.

    Transforms see source names and run before the rename; type overrides are
    looked up by the source column's Spark type name.  A value that does not
    fit its new type becomes NULL; :func:`checked_table` reports such rows instead.
    """
    return checked_table(df, table, plan).drop(REJECTED, VALUES)


def checked_table(df: DataFrame, table: str, plan: MigrationPlan) -> DataFrame:
    """:func:`compile_table` with ``reject_columns`` (the source columns whose non-NULL value did not fit
    its new type, comma-separated, NULL for a good row) and ``source_values`` (those values as JSON)."""
    df = apply_scan(df, plan.filters.get(table, ScanRequest()))
    df = transform_columns(df, [(t.column, t.function, dict(t.params)) for t in plan.transforms if t.table == table])
    casts = {f.name: plan.type_names[f.dataType.simpleString()] for f in df.schema if f.dataType.simpleString() in plan.type_names}
    cast = {c: F.col(f"`{c}`").try_cast(spark_type(t)) for c, t in casts.items()}
    unfit = [F.when(F.col(f"`{c}`").isNotNull() & v.isNull(), F.lit(c)) for c, v in cast.items()]
    bad = F.nullif(F.concat_ws(",", *unfit), F.lit("")) if unfit else F.lit(None).cast("string")
    values = F.to_json(F.struct(*[F.col(f"`{c}`") for c in casts])) if casts else F.lit(None).cast("string")
    marked = df.select(
        [cast[c].alias(c) if c in cast else F.col(f"`{c}`") for c in df.columns]
        + [bad.alias(REJECTED), F.when(bad.isNotNull(), values).alias(VALUES)]
    )
    return rename_columns(marked, plan.column_names.get(table, {}))


def compile_plan(spark: SparkSession, source, plan: MigrationPlan) -> dict[str, DataFrame]:
    """Every chosen table of a plan, keyed by its target name."""
    return {
        plan.target_name(t): compile_table(source.read(spark, t), t, plan) for t in plan.choose(source.list_tables())
    }


@dataclass(frozen=True)
class FolderTarget:
    """A target that keeps each table as files under one folder, one subfolder per run.

    Good and rejected rows of a run are written together, told apart by
    ``row_outcome``; writing a run again replaces that run's folder only.
    """

    folder: str
    fmt: str = "parquet"
    read_only: bool = False

    def path(self, table: str) -> str:
        return f"{self.folder.rstrip('/')}/{table}"

    def write(self, df: DataFrame, table: str, run: str = "0") -> None:
        (
            df.withColumn(RUN, F.lit(run))
            .write.mode("overwrite")
            .option("partitionOverwriteMode", "dynamic")
            .partitionBy(RUN)
            .format(self.fmt)
            .save(self.path(table))
        )

    def _all(self, spark: SparkSession, table: str) -> DataFrame:
        return spark.read.format(self.fmt).load(self.path(table))

    def read(self, spark: SparkSession, table: str) -> DataFrame:
        """The good rows of every run, in the table's own columns."""
        df = self._all(spark, table)
        return df.where(F.col(OUTCOME) == "good").drop(OUTCOME, REJECTED, VALUES, RUN)

    def rejects(self, spark: SparkSession, table: str) -> DataFrame:
        """The rejected rows of every run: the table's columns (unfit values NULL), the run, the columns and their source values."""
        return self._all(spark, table).where(F.col(OUTCOME) == "rejected").drop(OUTCOME)


def migrate(spark: SparkSession, source, target: FolderTarget, plan: MigrationPlan, run: str | None = None) -> DataFrame:
    """Run a plan and return its run log, one row per table.

    Tables are loaded ``parallel_tables`` at a time by independent Spark jobs, each
    in a scheduler pool of its own.  Every table is checked and written in one
    pass: rows whose values do not fit their new types are kept beside the good
    ones as rejects, with the columns and values that failed, and both counts
    come from that pass (``row_count`` counts good rows, ``rejected_count`` the
    rest).  ``run`` names the run (a new name by default); running the same name
    again replaces what it wrote, so a retried run doubles nothing.
    A failing table stops the run unless ``skip_errors`` is set.  A dry run
    computes and counts every row but writes nothing.
    """
    if target.read_only:
        raise PermissionError(f"{target.folder} is a read-only target")
    chosen = plan.choose(source.list_tables())
    run = run or datetime.now(timezone.utc).strftime("%Y%m%dT%H%M%S%f")

    def load(table: str) -> tuple:
        name = plan.target_name(table)
        started = datetime.now(timezone.utc).replace(tzinfo=None)
        rows, rejected, status, error = 0, 0, "completed", None
        spark.sparkContext.setLocalProperty("spark.scheduler.pool", f"load-{name}")
        try:
            marked = checked_table(source.read(spark, table), table, plan)
            marked = marked.withColumn(OUTCOME, F.when(F.col(REJECTED).isNull(), "good").otherwise("rejected"))
            df, seen = observed(marked, f"load-{name}-{run}", F.count(F.col(REJECTED)).alias("rejected"))
            if plan.dry_run:
                df.write.format("noop").mode("overwrite").save()
            else:
                target.write(df, name, run)
            rejected = seen.get["rejected"]
            rows = seen.get["row_count"] - rejected
        except Exception as problem:
            if not plan.skip_errors:
                raise
            status, error = "failed", str(problem)
        ended = datetime.now(timezone.utc).replace(tzinfo=None)
        return table, name, status, rows, error, started, ended, rejected

    with ThreadPoolExecutor(max_workers=max(plan.parallel_tables, 1)) as pool:
        log = list(pool.map(load, chosen))
    return spark.createDataFrame(log, RUN_LOG_SCHEMA)
