"""Projection, renaming, joining, splitting and looking up: tables into tables."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tableferry.functions.legacy_columns import fill_default
from tableferry.functions.type_rules import spark_type
from tableferry.plans.model import ColumnMapping, JoinCondition, TableMapping

# Join words and how Spark names them.
JOIN_KINDS = {"FULL": "full", "INNER": "inner", "LEFT": "left", "RIGHT": "right"}


def rename_columns(df: DataFrame, names: Mapping[str, str]) -> DataFrame:
    """Mapped columns first, in mapping order, then the rest in table order.

    When a rest column carries the name of a mapped target, the mapped column
    wins and the other is dropped.
    """
    mapped = {t: s for s, t in names.items() if s in df.columns}
    rest = [c for c in df.columns if c not in names and c not in mapped]
    return df.select([F.col(f"`{s}`").alias(t) for t, s in mapped.items()] + [F.col(f"`{c}`") for c in rest])


def map_structure(
    df: DataFrame, names: Mapping[str, str], types: Mapping[str, str], type_of: Mapping[str, str] | None = None
) -> DataFrame:
    """Rename and cast in one projection, keeping the table's column order.

    ``types`` overrides by original Spark type name; ``type_of`` overrides
    single columns.  Values that do not fit become NULL.
    """
    out = []
    for f in df.schema:
        c = F.col(f"`{f.name}`")
        wanted = (type_of or {}).get(f.name) or types.get(f.dataType.simpleString())
        if wanted:
            c = c.try_cast(spark_type(wanted))
        out.append(c.alias(names.get(f.name, f.name)))
    return df.select(out)


def keep_computed(df: DataFrame, condition: Column) -> DataFrame:
    """Keep the rows where a condition on computed columns holds.

    A plain filter would be pushed below the projection and compute those
    columns a second time; here each row is computed once and then kept or not.
    """
    row = F.struct(*[F.col(f"`{c}`") for c in df.columns])
    return df.select(F.inline(F.when(condition, F.array(row))))


def mapped_column(m: ColumnMapping, source: Column) -> Column:
    """One target column: direct, by expression, or cast to the target type."""
    if m.expression:
        value = F.expr(m.expression)
    elif m.direct:
        value = source
    else:
        value = source.try_cast(spark_type(m.target_type))
    return fill_default(value, m.default, m.nullable).alias(m.target)


def insert_select(df: DataFrame, mapping: TableMapping) -> DataFrame:
    """A one-to-one mapping: filter, then project the mapped columns."""
    for text in mapping.filters:
        df = df.where(F.expr(text))
    out = df.select([mapped_column(m, F.col(f"`{m.source}`")) for m in mapping.columns])
    return out.distinct() if mapping.distinct else out


def join_chain(tables: Mapping[str, DataFrame], mapping: TableMapping) -> DataFrame:
    """A many-to-one mapping: equi-joins from the first table, then a projection.

    Columns are addressed as ``table.column``.  Conditions between the same
    pair of tables are combined into one join, whichever way round they are
    written, and must be of one kind.  No join strategy is forced: Spark
    broadcasts a side only when its size allows.
    """
    if len(mapping.sources) < 2:
        raise ValueError("a many-to-one mapping needs at least two source tables")
    pairs: dict[tuple[str, str], list[JoinCondition]] = {}
    for j in mapping.joins:
        pair, turned = (j.source_table, j.target_table), (j.target_table, j.source_table)
        pairs.setdefault(turned if turned in pairs else pair, []).append(j)
    first = mapping.sources[0]
    joined = tables[first].alias(first)
    for (left, right), conditions in pairs.items():
        if len({j.kind.upper() for j in conditions}) > 1:
            raise ValueError(f"{left} and {right} are joined in different ways")
        on = reduce(
            lambda a, b: a & b,
            [F.col(f"{j.source_table}.{j.source_column}") == F.col(f"{j.target_table}.{j.target_column}") for j in conditions],
        )
        joined = joined.join(tables[right].alias(right), on, JOIN_KINDS[conditions[0].kind.upper()])
    for text in mapping.filters:
        joined = joined.where(F.expr(text))
    return joined.select([mapped_column(m, F.col(m.source)) for m in mapping.columns])


def split_table(df: DataFrame, rules: Mapping[str, Sequence[str]], distinct: Iterable[str] = ()) -> dict[str, DataFrame]:
    """A one-to-many mapping: one projection of the same scan per target.

    Targets listed in ``distinct`` are lookup tables and lose repeated rows.
    """
    if len(rules) < 2:
        raise ValueError("a one-to-many mapping needs at least two targets")
    lookups = set(distinct)
    out = {}
    for target, columns in rules.items():
        part = df.select([F.col(c) for c in columns if c in df.columns])
        out[target] = part.distinct() if target in lookups else part
    return out


def aggregate_mapping(df: DataFrame, mapping: TableMapping) -> DataFrame:
    """A mapping that groups: keys first, then every expression as an aggregate."""
    for text in mapping.filters:
        df = df.where(F.expr(text))
    aggs = [F.expr(m.expression).alias(m.target) for m in mapping.columns if m.expression]
    return df.groupBy(*mapping.group_by).agg(*aggs)


def lookup_values(c: Column, values: Mapping[Any, Any], default: Any = None) -> Column:
    """Replace a value by a small literal table; misses get the default."""
    entries = F.create_map(*[F.lit(v) for pair in values.items() for v in pair])
    return F.coalesce(F.try_element_at(entries, c), F.lit(default))


def lookup_table(df: DataFrame, key: str, lookup: DataFrame, lookup_key: str, value: str, out: str, default: Any = None) -> DataFrame:
    """Replace a key by a value from another table; misses get the default.

    The lookup is reduced to one row per key first, so rows never multiply.
    """
    unique = lookup.groupBy(F.col(lookup_key).alias("__k")).agg(F.min(value).alias("__v"))
    joined = df.join(unique, F.col(key) == F.col("__k"), "left")
    return joined.withColumn(out, F.coalesce(F.col("__v"), F.lit(default))).drop("__k", "__v")


def compile_mapping(tables: Mapping[str, DataFrame], mapping: TableMapping) -> DataFrame:
    """The DataFrame a mapping describes, by its kind.

    A one-to-many mapping is one of several targets of one source; alone it is
    its own projection.  :func:`load_mappings` loads such a group from one scan.
    """
    if not mapping.enabled:
        raise ValueError(f"mapping {mapping.id} is disabled")
    if mapping.group_by:
        return aggregate_mapping(tables[mapping.sources[0]], mapping)
    if mapping.kind == "many-to-one":
        return join_chain(tables, mapping)
    return insert_select(tables[mapping.sources[0]], mapping)


def fan_out(
    df: DataFrame, parts: Mapping[str, Sequence[tuple[str, Column]]], filters: Mapping[str, Column] | None = None, tag: str = "target_table"
) -> DataFrame:
    """Rows of every target of one source as one DataFrame, from a single scan of ``df``.

    ``parts`` gives each target's (name, expression) columns, ``filters`` the
    condition a source row must meet to reach a target.  Each source row
    becomes an array of one struct per target it reaches, exploded: columns of
    all targets lie side by side under a common schema (missing ones NULL),
    tagged by target.
    """
    filters = dict(filters or {})
    names: list[str] = []
    types: dict[str, Any] = {}
    for cols in parts.values():
        for f in df.select(*[c.alias(n) for n, c in cols]).schema.fields:
            if f.name not in types:
                names.append(f.name)
                types[f.name] = f.dataType
    entries = []
    for target, cols in parts.items():
        given = dict(cols)
        fields = [(given[n] if n in given else F.lit(None)).cast(types[n]).alias(n) for n in names]
        entries.append(F.struct(F.lit(target).alias(tag), filters.get(target, F.lit(True)).alias("__keep"), *fields))
    reached = F.filter(F.array(*entries), lambda e: F.coalesce(e["__keep"], F.lit(False)))
    return df.select(F.explode(reached).alias("__e")).select(F.col(f"__e.{tag}").alias(tag), *[F.col("__e").getField(n).alias(n) for n in names])


def split_load(
    df: DataFrame,
    parts: Mapping[str, Sequence[tuple[str, Column]]],
    path: str,
    lookups: Mapping[str, Sequence[str]] | None = None,
    filters: Mapping[str, Column] | None = None,
) -> dict[str, DataFrame]:
    """Load several targets of one source: one scan, one write partitioned by target, lookup targets reduced by key.

    Every target's rows (see :func:`fan_out`) are written in one job under
    ``{path}/rows/target_table=...``; a lookup target (``lookups``: target ->
    key columns) is then reduced to one row per key, the smallest of each
    other column, from its own written folder, and written to
    ``{path}/lookups/<target>``; nothing reads the source again.  Returns each
    target as read back, in its own columns.
    """
    lookups = dict(lookups or {})
    if len(parts) < 2:
        raise ValueError("a one-to-many load needs at least two targets")
    spark = df.sparkSession
    tagged = fan_out(df, parts, filters)
    tagged.write.mode("overwrite").partitionBy("target_table").parquet(f"{path}/rows")
    out = {}
    for target, cols in parts.items():
        names = [n for n, _ in cols]
        rows = spark.read.schema(tagged.schema).parquet(f"{path}/rows").where(F.col("target_table") == target).select(*names)
        if target in lookups:
            keys = list(lookups[target])
            rest = [c for c in names if c not in keys]
            reduced = rows.groupBy(*keys).agg(*[F.min(c).alias(c) for c in rest]) if rest else rows.select(*keys).distinct()
            reduced.select(*names).write.mode("overwrite").parquet(f"{path}/lookups/{target}")
            rows = spark.read.parquet(f"{path}/lookups/{target}")
        out[target] = rows
    return out


def load_mappings(tables: Mapping[str, DataFrame], mappings: Iterable[TableMapping], path: str) -> dict[str, DataFrame]:
    """Every enabled mapping, by target; one-to-many mappings of one source are loaded together by :func:`split_load`.

    A one-to-many mapping marked ``distinct`` is a lookup reduced by its first column.
    """
    live = [m for m in mappings if m.enabled]
    groups: dict[str, list[TableMapping]] = {}
    for m in live:
        if m.kind == "one-to-many" and not m.group_by:
            groups.setdefault(m.sources[0], []).append(m)
    out = {}
    for m in live:
        if m.kind != "one-to-many" or m.group_by or len(groups[m.sources[0]]) < 2:
            out[m.target] = compile_mapping(tables, m)
    for source, ms in groups.items():
        if len(ms) < 2:
            continue
        parts = {m.target: [(c.target, mapped_column(c, F.col(f"`{c.source}`"))) for c in m.columns] for m in ms}
        filters = {m.target: reduce(lambda a, b: a & b, [F.expr(t) for t in m.filters]) for m in ms if m.filters}
        lookups = {m.target: [m.columns[0].target] for m in ms if m.distinct}
        out.update(split_load(tables[source], parts, f"{path.rstrip('/')}/{source}", lookups, filters))
    return out
