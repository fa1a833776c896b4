"""What a migration is: plans, table and column mappings, as plain data."""

from __future__ import annotations

import json
from collections.abc import Mapping
from dataclasses import dataclass, field
from typing import Any

from tableferry.sources.tables import ScanRequest


@dataclass(frozen=True)
class ColumnMapping:
    """One target column and how it is made.

    With an ``expression`` the column is that SQL text; with ``direct`` it is
    the source column as it is; otherwise the source is cast to the target type.
    """

    source: str
    target: str
    source_type: str = "VARCHAR"
    target_type: str = "VARCHAR"
    direct: bool = False
    expression: str | None = None
    nullable: bool = True
    default: Any = None
    confidence: float = 100.0


@dataclass(frozen=True)
class JoinCondition:
    """An equality between two tables; ``kind`` is INNER, LEFT, RIGHT or FULL."""

    source_table: str
    source_column: str
    target_table: str
    target_column: str
    kind: str = "INNER"


@dataclass(frozen=True)
class TableMapping:
    """How one target table is made from one or several source tables."""

    id: str
    sources: tuple[str, ...]
    target: str
    columns: tuple[ColumnMapping, ...]
    kind: str = "one-to-one"
    joins: tuple[JoinCondition, ...] = ()
    filters: tuple[str, ...] = ()
    group_by: tuple[str, ...] = ()
    distinct: bool = False
    enabled: bool = True
    confidence: float = 100.0

    @staticmethod
    def from_dict(doc: Mapping[str, Any]) -> "TableMapping":
        """Read a mapping document; several sources may be comma-joined."""
        return TableMapping(
            id=doc["id"],
            sources=tuple(s.strip() for s in doc["sourceTable"].split(",")),
            target=doc["targetTable"],
            columns=tuple(
                ColumnMapping(
                    source=c["sourceColumn"],
                    target=c["targetColumn"],
                    source_type=c.get("sourceType", "VARCHAR"),
                    target_type=c.get("targetType", "VARCHAR"),
                    direct=(c.get("transformation") or {}).get("type") == "direct",
                    expression=(c.get("transformation") or {}).get("expression"),
                    nullable=c.get("nullable", True),
                    default=c.get("defaultValue"),
                    confidence=c.get("confidence", 100.0),
                )
                for c in doc.get("columnMappings", [])
            ),
            kind=doc.get("mappingType", "one-to-one"),
            joins=tuple(
                JoinCondition(j["sourceTable"], j["sourceColumn"], j["targetTable"], j["targetColumn"], j.get("joinType", "INNER"))
                for j in doc.get("joinConditions") or []
            ),
            filters=tuple(doc.get("filterConditions") or []),
            enabled=doc.get("enabled", True),
            confidence=doc.get("confidence", 100.0),
        )


@dataclass(frozen=True)
class Transform:
    """A named transform of one column of one table."""

    table: str
    column: str
    function: str
    params: Mapping[str, Any] = field(default_factory=dict)


@dataclass(frozen=True)
class MigrationPlan:
    """A whole migration: which tables, how they are renamed, filtered and changed."""

    tables: tuple[str, ...] | str = "all"
    table_names: Mapping[str, str] = field(default_factory=dict)
    column_names: Mapping[str, Mapping[str, str]] = field(default_factory=dict)
    type_names: Mapping[str, str] = field(default_factory=dict)
    filters: Mapping[str, ScanRequest] = field(default_factory=dict)
    transforms: tuple[Transform, ...] = ()
    exclude: tuple[str, ...] = ()
    parallel_tables: int = 1
    batch_size: int = 1000
    dry_run: bool = False
    skip_errors: bool = False

    @staticmethod
    def from_dict(doc: Mapping[str, Any]) -> "MigrationPlan":
        mapping = doc.get("mapping") or {}
        filters = {}
        for name, f in (doc.get("filters") or {}).items():
            order = f.get("orderBy")
            filters[name] = ScanRequest(
                where=f.get("where"),
                order_by=tuple(part.strip() for part in order.split(",")) if order else (),
                offset=f.get("offset", 0),
                limit=f.get("limit"),
            )
        tables = doc.get("tables", "all")
        return MigrationPlan(
            tables=tables if tables == "all" else tuple(tables),
            table_names=mapping.get("tables") or {},
            column_names=mapping.get("columns") or {},
            type_names=mapping.get("types") or {},
            filters=filters,
            transforms=tuple(
                Transform(t["table"], t["column"], t["function"], t.get("params") or {}) for t in doc.get("transforms") or []
            ),
            exclude=tuple(doc.get("excludeTables") or ()),
            parallel_tables=doc.get("parallelTables", 1),
            batch_size=doc.get("batchSize", 1000),
            dry_run=doc.get("dryRun", False),
            skip_errors=doc.get("skipErrors", False),
        )

    @staticmethod
    def from_json(text: str) -> "MigrationPlan":
        return MigrationPlan.from_dict(json.loads(text))

    def choose(self, existing: list[str]) -> list[str]:
        """The tables to migrate: requested ones that exist, minus the excluded."""
        wanted = existing if self.tables == "all" else [t for t in self.tables if t in existing]
        return [t for t in wanted if t not in self.exclude]

    def target_name(self, table: str) -> str:
        return self.table_names.get(table) or table
