"""Type translation between dialects and from code tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tableferry.functions import type_rules as tr
from tableferry.sources import legacy
from tableferry.suite.registry import query
from tableferry.suite.sqltext import case_of
from tableferry.suite.values import sql_list, typed_parts

UNKNOWN = ["GEOMETRY", "POINT", "NVARCHAR2", "MONEY", "SERIAL", "BOOL", "SMALLDATETIME", "NUMBER", "TINYBLOB", "XML", "DOUBLE UNSIGNED"]


def dealt(spark, d, names):
    """Type texts dealt out over the part table: bare, lower with a length, with precision."""
    df = typed_parts(spark, d, names)
    return df.select(
        "p_partkey",
        F.expr(
            """CASE CAST(p_size % 3 AS INT) WHEN 0 THEN t WHEN 1 THEN concat(lower(t), '(', p_size, ')') ELSE concat(t, '(', p_size, ',2)') END"""
        ).alias("t"),
    )


def dealt_sql(names):
    return (
        f"(SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN t WHEN 1 THEN concat(lower(t), '(', p_size, ')') ELSE concat(t, '(', p_size, ',2)') END AS t "
        f"FROM (SELECT p_partkey, p_size, {sql_list(names)}[CAST(p_partkey % {len(names)} AS INTEGER) + 1] AS t FROM part))"
    )


BASE = "trim(split_part(upper(t), '(', 1))"
PARAMS = r"regexp_extract(upper(t), '(\([^)]+\))', 1)"


def generic_sql(target, base=BASE):
    def pick(values):
        return values.get(target, values["default"])

    tests = " ".join(f"WHEN regexp_matches({base}, '{p}') THEN '{pick(v)}'" for p, v in tr.GENERIC_RULES)
    return f"CASE {tests} ELSE '{tr.GENERIC_FALLBACK}' END"


def mapped_sql(rules, target):
    m = case_of(BASE, rules)
    return (
        f"coalesce(CASE WHEN regexp_matches({m}, '{tr.PARAMETER_TYPES}') THEN concat({m}, {PARAMS}) ELSE {m} END, {generic_sql(target)})"
    )


MYSQL_TYPES = sorted(tr.MYSQL_TO_POSTGRESQL) + UNKNOWN
POSTGRES_TYPES = sorted(tr.POSTGRESQL_TO_MYSQL) + UNKNOWN


@query(
    f"""SELECT p_partkey, t AS source_type, {mapped_sql(tr.MYSQL_TO_POSTGRESQL, 'postgresql')} AS postgresql_type,
        {mapped_sql(tr.MYSQL_TO_SQLSERVER, 'sqlserver')} AS sqlserver_type, {mapped_sql(tr.MYSQL_TO_ORACLE, 'oracle')} AS oracle_type
        FROM {dealt_sql(MYSQL_TYPES)}"""
)
def type_map_mysql(spark, d):
    t = F.col("t")
    return dealt(spark, d, MYSQL_TYPES).select(
        "p_partkey",
        t.alias("source_type"),
        tr.map_type(t, "mysql", "postgresql").alias("postgresql_type"),
        tr.map_type(t, "mysql", "sqlserver").alias("sqlserver_type"),
        tr.map_type(t, "mysql", "oracle").alias("oracle_type"),
    )


@query(
    f"""SELECT p_partkey, t AS source_type, {mapped_sql(tr.POSTGRESQL_TO_MYSQL, 'mysql')} AS mysql_type,
        {mapped_sql(tr.POSTGRESQL_TO_SQLSERVER, 'sqlserver')} AS sqlserver_type FROM {dealt_sql(POSTGRES_TYPES)}"""
)
def type_map_postgres(spark, d):
    t = F.col("t")
    return dealt(spark, d, POSTGRES_TYPES).select(
        "p_partkey",
        t.alias("source_type"),
        tr.map_type(t, "postgres", "mysql").alias("mysql_type"),
        tr.map_type(t, "postgresql", "sqlserver").alias("sqlserver_type"),
    )


TARGETS = ["mysql", "postgresql", "sqlserver", "oracle", "firebird"]


@query(f"SELECT p_partkey, {', '.join(f'{generic_sql(t)} AS {t}_type' for t in TARGETS)} FROM {dealt_sql(POSTGRES_TYPES)}")
def type_map_generic(spark, d):
    """No rules exist for these source dialects, so the fallback decides."""
    t = F.col("t")
    return dealt(spark, d, POSTGRES_TYPES).select("p_partkey", *[tr.map_type(t, "sqlite", x).alias(f"{x}_type") for x in TARGETS])


@query(
    f"SELECT p_partkey, coalesce({case_of(f'lower({BASE})', tr.MYSQL_NAMES)}, upper(t)) AS type_name FROM {dealt_sql(MYSQL_TYPES)}"
)
def type_map_mysql_names(spark, d):
    return dealt(spark, d, MYSQL_TYPES).select("p_partkey", tr.mysql_type_name(F.col("t")).alias("type_name"))


FIREBIRD_TYPES = sorted(tr.FIREBIRD_NAMES) + UNKNOWN


@query(f"SELECT p_partkey, coalesce({case_of(BASE, tr.FIREBIRD_NAMES)}, upper(t)) AS type_name FROM {dealt_sql(FIREBIRD_TYPES)}")
def firebird_type_names(spark, d):
    return dealt(spark, d, FIREBIRD_TYPES).select("p_partkey", tr.firebird_type_name(F.col("t")).alias("type_name"))


PARADOX_TYPES = sorted(tr.PARADOX_NAMES) + ["a", "n", "Z", "LONGVARBINARY"]


@query(
    f"""SELECT p_partkey, {case_of('upper(t)', tr.PARADOX_NAMES, "'VARCHAR'")} AS type_name FROM (SELECT p_partkey,
        {sql_list(PARADOX_TYPES)}[CAST(p_partkey % {len(PARADOX_TYPES)} AS INTEGER) + 1] AS t FROM part)"""
)
def paradox_type_codes(spark, d):
    return typed_parts(spark, d, PARADOX_TYPES).select("p_partkey", tr.paradox_type_name(F.col("t")).alias("type_name"))


LONG_NAMES = sorted(tr.PARADOX_TO_FIREBIRD) + ["ALPHA", "alpha", "NUMBER", "BYTES", "CURRENCY"]


@query(
    f"""SELECT p_partkey, CASE upper(t) WHEN 'ALPHA' THEN CASE WHEN coalesce(n, 0) = 0 THEN 'VARCHAR(255)' ELSE concat('VARCHAR(', least(n, 32765), ')') END
        WHEN 'NUMBER' THEN CASE WHEN p = 0 THEN 'NUMERIC(18,4)' ELSE concat('NUMERIC(18,', p, ')') END
        WHEN 'BYTES' THEN CASE WHEN coalesce(n, 0) = 0 THEN 'CHAR(255)' ELSE concat('CHAR(', n, ')') END
        ELSE coalesce({case_of('upper(t)', tr.PARADOX_TO_FIREBIRD)}, 'VARCHAR(255)') END AS type_text FROM (SELECT p_partkey,
        {sql_list(LONG_NAMES)}[CAST(p_partkey % {len(LONG_NAMES)} AS INTEGER) + 1] AS t,
        CASE WHEN p_size % 7 = 0 THEN NULL WHEN p_size % 7 = 1 THEN 0 ELSE p_size * 1000 END AS n, p_size % 5 AS p FROM part)"""
)
def paradox_to_firebird_types(spark, d):
    df = typed_parts(spark, d, LONG_NAMES)
    length = F.expr("CASE WHEN p_size % 7 = 0 THEN NULL WHEN p_size % 7 = 1 THEN 0 ELSE p_size * 1000 END")
    return df.select("p_partkey", tr.paradox_to_firebird(F.col("t"), length, F.col("p_size") % 5).alias("type_text"))


# Field codes both readers know, one unknown code per known range, and one beyond.
CODES = sorted({*tr.FIREBIRD_CODES, *tr.FIREBIRD_CODES_V2, tr.BLOB_CODE, 36, 38, 39, 50})


def codes(spark, d):
    picks = F.array(*[F.lit(c) for c in CODES])
    return legacy.table(spark, d, "part").select(
        "p_partkey",
        F.try_element_at(picks, (F.col("p_partkey") % len(CODES) + 1).cast("int")).alias("code"),
        F.expr("CAST(p_partkey DIV 50 % 4 AS INT)").alias("sub"),
        F.expr("p_size * 4 - 4").alias("len"),
        F.expr("CASE WHEN p_size % 4 = 0 THEN NULL ELSE p_size % 19 END").alias("prec"),
        F.expr("p_size % 6 - 3").alias("scale"),
    )


_CODES = (
    f"(SELECT p_partkey, [{', '.join(map(str, CODES))}][CAST(p_partkey % {len(CODES)} AS INTEGER) + 1] AS code, CAST(p_partkey // 50 % 4 AS INTEGER) AS sub, "
    "p_size * 4 - 4 AS len, CASE WHEN p_size % 4 = 0 THEN NULL ELSE p_size % 19 END AS prec, p_size % 6 - 3 AS scale FROM part)"
)
_NAME = f"""CASE WHEN code = 26 AND coalesce(prec, 0) <> 0 AND scale >= 0 THEN concat('NUMERIC(', prec, ',', scale, ')')
    WHEN code IN (7, 8, 16, 26, 267) AND sub = 1 THEN 'NUMERIC' WHEN code IN (7, 8, 16, 26, 267) AND sub = 2 THEN 'DECIMAL'
    WHEN code = 261 AND sub = 1 THEN 'BLOB SUB_TYPE TEXT' ELSE coalesce({case_of('code', tr.FIREBIRD_CODES)}, 'VARCHAR') END"""
_PREC = "coalesce(prec, 0) <> 0"


@query(f"SELECT p_partkey, code, {_NAME} AS type_name FROM {_CODES}")
def firebird_type_codes(spark, d):
    name = tr.firebird_type(F.col("code"), F.col("sub"), F.col("prec"), F.col("scale"))
    return codes(spark, d).select("p_partkey", "code", name.alias("type_name"))


@query(
    f"""SELECT p_partkey, code, CASE WHEN code = 14 THEN concat('CHAR(', CASE WHEN len = 0 THEN 1 ELSE len END, ')')
        WHEN code = 37 THEN concat('VARCHAR(', CASE WHEN len = 0 THEN 1 ELSE len END, ')')
        WHEN code = 26 THEN CASE WHEN {_PREC} THEN concat('NUMERIC(', prec, ',', abs(scale), ')') ELSE 'NUMERIC' END
        WHEN code IN (7, 8, 16, 267) AND sub IN (1, 2) AND {_PREC} THEN concat(CASE sub WHEN 1 THEN 'NUMERIC(' ELSE 'DECIMAL(' END, prec, ',', abs(scale), ')')
        WHEN code IN (7, 8, 16, 267) THEN {case_of('code', tr.FIREBIRD_CODES)}
        WHEN code = 261 THEN CASE sub WHEN 0 THEN 'BLOB' WHEN 1 THEN 'BLOB SUB_TYPE TEXT' ELSE concat('BLOB SUB_TYPE ', sub) END
        WHEN code = 24 THEN 'DECFLOAT(16)' WHEN code = 25 THEN 'DECFLOAT(34)'
        WHEN {_NAME} IN ('CHAR', 'VARCHAR') AND len <> 0 THEN concat({_NAME}, '(', len, ')') ELSE {_NAME} END AS type_text FROM {_CODES}"""
)
def firebird_type_text(spark, d):
    text = tr.firebird_type_text(F.col("code"), F.col("sub"), F.col("len"), F.col("prec"), F.col("scale"))
    return codes(spark, d).select("p_partkey", "code", text.alias("type_text"))


_LEN = "concat('(', CASE WHEN len = 0 THEN 1 ELSE len END, ')')"


@query(
    f"""SELECT p_partkey, code, CASE WHEN code IN (7, 8, 16) AND scale < 0 THEN concat('NUMERIC(', CASE WHEN {_PREC} THEN prec WHEN code = 7 THEN 15 ELSE 18 END, ',', abs(scale), ')')
        WHEN code IN (14, 37, 40) THEN concat({case_of('code', tr.FIREBIRD_CODES_V2)}, {_LEN})
        WHEN code = 261 THEN {case_of('sub', tr.BLOB_KINDS)}
        WHEN {case_of('code', tr.FIREBIRD_CODES_V2)} IS NOT NULL THEN {case_of('code', tr.FIREBIRD_CODES_V2)}
        WHEN code = 15 THEN concat('CHAR', {_LEN}) WHEN code = 36 THEN 'TIMESTAMP' WHEN code IN (38, 39) THEN concat('VARCHAR', {_LEN})
        ELSE concat('UNKNOWN_TYPE_', code, CASE WHEN sub = 0 THEN '' ELSE concat('_SUB', sub) END) END AS type_text FROM {_CODES}"""
)
def firebird_type_codes_v2(spark, d):
    text = tr.firebird_type_v2(F.col("code"), F.col("sub"), F.col("len"), F.col("scale"), F.col("prec"))
    return codes(spark, d).select("p_partkey", "code", text.alias("type_text"))


def _fragments(table, otherwise):
    return "CASE " + " ".join(f"WHEN regexp_matches(upper(t), '{p}') THEN '{v}'" for p, v in table) + f" ELSE {otherwise} END"


@query(
    f"""SELECT p_partkey, {_fragments(tr.SQLITE_SCHEMA_FRAGMENTS, 'upper(t)')} AS schema_type,
        {_fragments(tr.SQLITE_MAPPED_FRAGMENTS, "'TEXT'")} AS mapped_type FROM {dealt_sql(MYSQL_TYPES)}"""
)
def sqlite_affinity(spark, d):
    t = F.col("t")
    return dealt(spark, d, MYSQL_TYPES).select(
        "p_partkey", tr.sqlite_schema_type(t).alias("schema_type"), tr.sqlite_mapped_type(t).alias("mapped_type")
    )
