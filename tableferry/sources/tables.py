"""Sources: a set of named tables that can be scanned, counted and listed."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class ScanRequest:
    """What to read from a table: predicate, order, offset and limit as SQL text."""

    where: str | None = None
    order_by: tuple[str, ...] = ()
    offset: int = 0
    limit: int | None = None


def apply_scan(df: DataFrame, request: ScanRequest) -> DataFrame:
    """Filter, order and page a table.

    The predicate reaches the reader through Catalyst.  Offset and limit are
    only meaningful after a total order, so they come last.
    """
    if request.where:
        df = df.where(F.expr(request.where))
    if request.order_by:
        df = df.orderBy(*[_order(text) for text in request.order_by])
    if request.offset:
        df = df.offset(request.offset)
    if request.limit:
        df = df.limit(request.limit)
    return df


def _order(text: str):
    name, _, direction = text.strip().rpartition(" ")
    if direction.lower() in ("asc", "desc") and name:
        return F.expr(name).desc() if direction.lower() == "desc" else F.expr(name).asc()
    return F.expr(text).asc()


class ReadOnlySource(Exception):
    """Raised before any job when something tries to write to a read-only source."""


@dataclass(frozen=True)
class TableSource:
    """Tables kept as files under one folder, read by any Spark file format.

    ``names`` fixes which tables exist; ``system_prefixes`` hides system tables
    from listings.  A read-only source refuses writes.
    """

    folder: str
    names: tuple[str, ...]
    fmt: str = "parquet"
    options: Mapping[str, str] = field(default_factory=dict)
    suffix: str = ".parquet"
    read_only: bool = False
    system_prefixes: tuple[str, ...] = ("sqlite_", "RDB$", "MON$")

    def list_tables(self) -> list[str]:
        return sorted(n for n in self.names if not n.startswith(self.system_prefixes))

    def path(self, table: str) -> str:
        return f"{self.folder.rstrip('/')}/{table}{self.suffix}"

    def read(self, spark: SparkSession, table: str) -> DataFrame:
        return spark.read.format(self.fmt).options(**self.options).load(self.path(table))

    def scan(self, spark: SparkSession, table: str, request: ScanRequest = ScanRequest()) -> DataFrame:
        return apply_scan(self.read(spark, table), request)

    def check_writable(self) -> None:
        if self.read_only:
            raise ReadOnlySource(f"{self.folder} is a read-only source")


@dataclass(frozen=True)
class JdbcSource:
    """The same scans through a JDBC driver that the session provides.

    Give ``partition_column`` with its bounds to read a table in parallel; the
    bounds only shape the partitions, no row is left out.
    """

    url: str
    names: tuple[str, ...]
    options: Mapping[str, str] = field(default_factory=dict)
    partition_column: Mapping[str, tuple[str, str, str]] = field(default_factory=dict)
    partitions: int = 32
    read_only: bool = False

    def list_tables(self) -> list[str]:
        return sorted(self.names)

    def read(self, spark: SparkSession, table: str) -> DataFrame:
        reader = spark.read.format("jdbc").option("url", self.url).option("dbtable", table).options(**self.options)
        if table in self.partition_column:
            column, low, high = self.partition_column[table]
            reader = reader.options(
                partitionColumn=column, lowerBound=low, upperBound=high, numPartitions=str(self.partitions)
            )
        return reader.load()

    def scan(self, spark: SparkSession, table: str, request: ScanRequest = ScanRequest()) -> DataFrame:
        return apply_scan(self.read(spark, table), request)

    def check_writable(self) -> None:
        if self.read_only:
            raise ReadOnlySource(f"{self.url} is a read-only source")


def count_rows(df: DataFrame, where: str | None = None) -> DataFrame:
    """``row_count`` of a table, with an optional predicate."""
    if where:
        df = df.where(F.expr(where))
    return df.agg(F.count(F.lit(1)).alias("row_count"))


def count_per_table(tables: Mapping[str, DataFrame], filters: Mapping[str, str] | None = None) -> DataFrame:
    """``(table_name, row_count)`` over several tables, each with its predicate.

    A limit never applies to the count, only the predicate does.
    """
    filters = filters or {}
    counts = [
        count_rows(df, filters.get(name)).select(F.lit(name).alias("table_name"), "row_count")
        for name, df in tables.items()
    ]
    return reduce(DataFrame.unionByName, counts)


def total_rows(tables: Mapping[str, DataFrame], filters: Mapping[str, str] | None = None) -> DataFrame:
    return count_per_table(tables, filters).agg(F.sum("row_count").alias("total_rows"))


def run_query(spark: SparkSession, sql: str, tables: Mapping[str, DataFrame], args: list | dict | None = None) -> DataFrame:
    """A parameterised query; tables are passed by name as ``{name}`` fields."""
    return spark.sql(sql, args=args, **tables)


def choose_tables(catalog_tables: DataFrame, wanted: Iterable[str] | str) -> DataFrame:
    """``all`` tables, or those requested names that exist."""
    return catalog_tables if wanted == "all" else catalog_tables.where(F.col("table_name").isin(list(wanted)))


def include_exclude(catalog_tables: DataFrame, include: Iterable[str] = (), exclude: Iterable[str] = ()) -> DataFrame:
    """Keep the included names (all when none is given), then drop the excluded."""
    include, exclude = list(include), list(exclude)
    if include:
        catalog_tables = catalog_tables.where(F.col("table_name").isin(include))
    if exclude:
        catalog_tables = catalog_tables.where(~F.col("table_name").isin(exclude))
    return catalog_tables
