"""SQL text shared by the reference queries (DuckDB dialect)."""

from __future__ import annotations

LEGACY_ORDERS = """legacy_orders AS (
SELECT lpad(CAST(o_orderkey AS VARCHAR), 10, '0') AS order_no,
       CAST(o_custkey AS VARCHAR) AS cust_no,
       CASE o_orderkey % 6
         WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%d')
         WHEN 1 THEN strftime(o_orderdate, '%d/%m/%Y')
         WHEN 2 THEN strftime(o_orderdate, '%d-%m-%Y')
         WHEN 3 THEN strftime(o_orderdate, '%Y%m%d')
         WHEN 4 THEN strftime(o_orderdate, '%d%m%Y')
         ELSE 'n/a' END AS order_date_txt,
       CASE o_orderkey % 5
         WHEN 0 THEN format('{:,.2f}', o_totalprice)
         WHEN 1 THEN replace(CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS VARCHAR), '.', ',')
         WHEN 2 THEN concat('  ', CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS VARCHAR), ' ')
         WHEN 3 THEN CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS VARCHAR)
         ELSE CASE WHEN o_orderkey % 2 = 0 THEN 'abc' ELSE '' END END AS total_txt,
       o_orderstatus AS status,
       concat(chr(9), o_orderpriority, '  ', chr(10)) AS priority_pad,
       CASE o_orderkey % 3 WHEN 0 THEN 'T' WHEN 1 THEN 'F' ELSE '?' END AS paid_flag,
       CASE o_orderkey % 7 WHEN 0 THEN NULL WHEN 1 THEN '' ELSE concat('N', CAST(o_orderkey AS VARCHAR)) END AS note
FROM orders)"""

LEGACY_CUSTOMER = """legacy_customer AS (
SELECT CAST(c_custkey AS VARCHAR) AS cust_no,
       rpad(c_name, 30, ' ') AS name_alpha,
       CAST(CAST(c_acctbal AS DECIMAL(15,2)) AS VARCHAR) AS balance_txt,
       CASE WHEN c_custkey % 10 = 0 THEN NULL ELSE c_mktsegment END AS segment,
       c_nationkey AS nation_no,
       CAST(c_custkey AS DOUBLE) / 2 - 100 AS credit_score,
       CASE WHEN c_custkey % 20 = 0 THEN 40000 ELSE CAST(c_custkey % 1000 AS INTEGER) END AS small_code
FROM customer)"""

BATCH_LOG = """batch_log AS (
SELECT event_type AS table_name, event_id // 1000 AS batch_no, count(*) AS row_count,
       min(ts) AS started_at, max(ts) AS ended_at,
       CAST(count(*) FILTER (WHERE value < 1) AS BIGINT) AS error_count
FROM events GROUP BY 1, 2)"""

_PARTS = """parts AS (SELECT DISTINCT substring(p_brand, 7) AS brand_no, p_name, p_size FROM part)"""


def _catalog(name: str, table: str, column: str, types: list[str]) -> str:
    picked = "CASE p_size % 6 " + " ".join(f"WHEN {i} THEN '{t}'" for i, t in enumerate(types[:-1])) + f" ELSE '{types[-1]}' END"
    return f"""{name} AS (
SELECT table_name, CAST(row_number() OVER (PARTITION BY table_name ORDER BY p_name, p_size) AS INTEGER) AS ordinal,
       column_name, type,
       CASE WHEN type IN ('VARCHAR','TEXT') THEN p_size * 5 END AS max_length,
       CASE WHEN type IN ('DECIMAL','NUMERIC') THEN 10 + p_size % 5 END AS precision,
       row_number() OVER (PARTITION BY table_name ORDER BY p_name, p_size) % 3 = 0 AS nullable,
       row_number() OVER (PARTITION BY table_name ORDER BY p_name, p_size) = 1 AS is_pk
FROM (SELECT {table} AS table_name, {column} AS column_name, {picked} AS type, p_name, p_size FROM parts))"""


CATALOG_SRC = _PARTS + ", " + _catalog(
    "catalog_src", "concat('T_', brand_no)", "concat(replace(p_name, ' ', '_'), '_', CAST(p_size AS VARCHAR))",
    ["VARCHAR", "INTEGER", "DECIMAL", "DATE", "BOOLEAN", "BLOB"],
)
CATALOG_TGT = _catalog(
    "catalog_tgt", "concat('NEW_T_', brand_no)",
    """CASE p_size % 4
             WHEN 0 THEN upper(concat(replace(p_name, ' ', '_'), '_', CAST(p_size AS VARCHAR)))
             WHEN 1 THEN concat('new_', replace(p_name, ' ', '_'), '_', CAST(p_size AS VARCHAR))
             WHEN 2 THEN concat(replace(p_name, ' ', ''), CAST(p_size AS VARCHAR))
             ELSE concat(reverse(p_name), CAST(p_size AS VARCHAR)) END""",
    ["TEXT", "INTEGER", "NUMERIC", "TIMESTAMP", "BIT", "BLOB"],
)
CATALOGS = CATALOG_SRC + ", " + CATALOG_TGT
TARGET_CATALOG = _PARTS + ", " + CATALOG_TGT

FK_CATALOGS = """fk_src AS (
SELECT concat('T_', substring(p_brand, 7)) AS table_name,
       concat(replace(p_name, ' ', '_'), CASE WHEN min(p_size) % 4 = 0 THEN '_CODE' ELSE '_ID' END) AS column_name,
       CASE min(p_size) % 3 WHEN 0 THEN 'VARCHAR' WHEN 1 THEN 'INTEGER' ELSE 'BIGINT' END AS type
FROM part GROUP BY p_brand, p_name),
kinds AS (SELECT DISTINCT split_part(p_name, ' ', 2) AS table_name FROM part),
fk_tgt AS (
SELECT table_name, concat(upper(table_name), '_ID') AS column_name, 'INTEGER' AS type, true AS is_pk FROM kinds
UNION ALL SELECT table_name, concat(upper(table_name), '_NAME'), 'VARCHAR', false FROM kinds),
relationships AS (
SELECT s.table_name AS source_table, s.column_name AS source_column, t.table_name AS target_table,
       t.column_name AS target_column, 'INNER' AS join_type
FROM fk_src s, fk_tgt t
WHERE upper(s.column_name) LIKE '%ID' AND contains(lower(s.column_name), lower(t.table_name)) AND t.is_pk
  AND (s.type = t.type OR (s.type IN ('INTEGER','INT','SMALLINT','BIGINT','NUMBER') AND t.type IN ('INTEGER','INT','SMALLINT','BIGINT','NUMBER'))))"""


def with_(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"


def trimmed(x: str) -> str:
    return f"trim({x}, concat(chr(9), chr(10), chr(11), chr(12), chr(13), ' '))"


def to_date(x: str) -> str:
    t = trimmed(x)
    tries = []
    for shape, layout in [
        (r"\d{4}-\d{2}-\d{2}", "%Y-%m-%d"), (r"\d{2}/\d{2}/\d{4}", "%d/%m/%Y"), (r"\d{2}-\d{2}-\d{4}", "%d-%m-%Y"),
        (r"\d{8}", "%Y%m%d"), (r"\d{8}", "%d%m%Y"),
    ]:
        parsed = f"try_strptime({t}, '{layout}')"
        tries.append(f"CASE WHEN regexp_full_match({t}, '{shape}') AND year({parsed}) >= 100 THEN {parsed} END")
    return f"CAST(coalesce({', '.join(tries)}) AS DATE)"


NUMBER = r"[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?"


def to_number(x: str) -> str:
    bare = rf"regexp_replace(regexp_replace({x}, '\s', '', 'g'), ',(\d{{3}})', '\1', 'g')"
    clean = f"CASE WHEN contains({bare}, ',') AND NOT contains({bare}, '.') THEN replace({bare}, ',', '.') ELSE {bare} END"
    return f"CASE WHEN {x} = '' THEN NULL WHEN ({clean}) = '' THEN 0.0 WHEN regexp_full_match({clean}, '{NUMBER}') THEN TRY_CAST(({clean}) AS DOUBLE) END"


def js_number(x: str) -> str:
    t = trimmed(x)
    return f"CASE WHEN {t} = '' THEN 0.0 WHEN regexp_full_match({t}, '{NUMBER}') THEN TRY_CAST({t} AS DOUBLE) END"


def half_up(x: str) -> str:
    return f"CAST(floor({x} + 0.5) AS BIGINT)"


def case_of(x: str, table: dict, otherwise: str = "NULL") -> str:
    def lit(v):
        return str(v) if isinstance(v, int) else f"'{v}'"

    return f"CASE {x} " + " ".join(f"WHEN {lit(k)} THEN {lit(v)}" for k, v in table.items()) + f" ELSE {otherwise} END"


def name_score(a: str, b: str) -> str:
    x, y = f"trim(lower({a}))", f"trim(lower({b}))"
    longest = f"greatest(length({x}), length({y}))"
    return (
        f"CASE WHEN {x} = {y} THEN 1.0 WHEN {x} = '' OR {y} = '' THEN 0.0 WHEN contains({x}, {y}) OR contains({y}, {x}) THEN 0.8 "
        f"ELSE CAST({longest} - levenshtein({x}, {y}) AS DOUBLE) / {longest} END"
    )


def type_group(a: str) -> str:
    return (
        f"CASE WHEN upper({a}) IN ('VARCHAR','CHAR','TEXT','STRING') THEN 1 WHEN upper({a}) IN ('INTEGER','INT','SMALLINT','BIGINT','NUMBER') THEN 2 "
        f"WHEN upper({a}) IN ('DECIMAL','NUMERIC','FLOAT','DOUBLE','REAL') THEN 3 WHEN upper({a}) IN ('DATE','DATETIME','TIMESTAMP') THEN 4 "
        f"WHEN upper({a}) IN ('BOOLEAN','BIT','LOGICAL') THEN 5 WHEN upper({a}) IN ('BLOB','BINARY','VARBINARY') THEN 6 END"
    )


def type_score(a: str, b: str) -> str:
    return f"CASE WHEN upper({a}) = upper({b}) THEN 1.0 WHEN {type_group(a)} = {type_group(b)} THEN 0.8 ELSE 0.0 END"
