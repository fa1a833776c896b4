"""Scans, counts, catalogs, projections, sinks and whole migrations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tableferry.functions.convert import Conversion, typed_table
from tableferry.functions.dialects import Rule, rule_passes, split_by_rules
from tableferry.functions.legacy_columns import logical
from tableferry.functions.text import strip_space
from tableferry.functions.type_rules import adapt_long_varchar as adapt
from tableferry.functions.type_rules import clean_default
from tableferry.operators import loading, numbering, restructure
from tableferry.operators.ddl import target_ddl as ddl
from tableferry.operators.restructure import keep_computed
from tableferry.plans.migrate import FolderTarget, compile_plan, migrate
from tableferry.plans.model import ColumnMapping, MigrationPlan, TableMapping
from tableferry.session import fresh_path
from tableferry.sources import catalog, legacy, tables
from tableferry.streaming.replay import replay, replayed
from tableferry.suite import sqltext as q
from tableferry.suite.registry import query


def source(folder: str, read_only: bool = True) -> tables.TableSource:
    return tables.TableSource(folder=folder, names=legacy.TABLES, read_only=read_only)


@query(
    """SELECT l_orderkey, l_linenumber, l_partkey, l_quantity, l_shipdate FROM lineitem
       WHERE l_shipdate >= TIMESTAMP '1998-09-01 00:00:00' AND l_quantity > 45"""
)
def scan_filter(spark, d):
    request = tables.ScanRequest(where="l_shipdate >= TIMESTAMP_NTZ '1998-09-01 00:00:00' AND l_quantity > 45")
    return source(d).scan(spark, "lineitem", request).select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_shipdate")


@query(
    """SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderstatus <> 'P'
       ORDER BY o_totalprice DESC, o_orderkey LIMIT 50 OFFSET 100"""
)
def scan_ordered_page(spark, d):
    request = tables.ScanRequest("o_orderstatus <> 'P'", ("o_totalprice DESC", "o_orderkey"), 100, 50)
    return source(d).scan(spark, "orders", request).select("o_orderkey", "o_custkey", "o_totalprice")


@query("SELECT count(*) AS row_count FROM lineitem")
def count_all(spark, d):
    return tables.count_rows(source(d).read(spark, "lineitem"))


@query("SELECT count(*) AS row_count FROM lineitem WHERE l_discount > 0.05 AND l_returnflag = 'R'")
def count_where(spark, d):
    return tables.count_rows(source(d).read(spark, "lineitem"), "l_discount > 0.05 AND l_returnflag = 'R'")


@query(
    """SELECT CAST((SELECT count(*) FROM orders WHERE o_totalprice > 100000) + (SELECT count(*) FROM lineitem WHERE l_tax > 0.02)
       + (SELECT count(*) FROM customer) AS BIGINT) AS total_rows"""
)
def total_rows(spark, d):
    chosen = {n: source(d).read(spark, n) for n in ("orders", "lineitem", "customer")}
    return tables.total_rows(chosen, {"orders": "o_totalprice > 100000", "lineitem": "l_tax > 0.02"})


@query(
    """SELECT n_name, count(*) AS orders, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DECIMAL(28,2)) AS revenue
       FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
       WHERE o_orderdate >= TIMESTAMP '1996-01-01 00:00:00' AND c_mktsegment = 'MACHINERY' GROUP BY n_name"""
)
def sql_param_query(spark, d):
    names = {n: source(d).read(spark, n) for n in ("orders", "customer", "nation")}
    return tables.run_query(
        spark,
        """SELECT n_name, count(*) AS orders, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DECIMAL(28,2)) AS revenue
           FROM {orders} JOIN {customer} ON o_custkey = c_custkey JOIN {nation} ON c_nationkey = n_nationkey
           WHERE o_orderdate >= CAST(:since AS TIMESTAMP_NTZ) AND c_mktsegment = :segment GROUP BY n_name""",
        names,
        {"since": "1996-01-01", "segment": "MACHINERY"},
    )


_COUNTS = "\nUNION ALL ".join(f"SELECT '{t}' AS table_name, count(*) AS row_count FROM {t}" for t in legacy.TABLES)


@query(_COUNTS)
def list_tables(spark, d):
    return catalog.list_tables(legacy.all_tables(spark, d))


# Columns of the test tables, for the reference SQL only: (name, Spark type).
COLUMNS = {
    "region": "r_regionkey:int r_name:string",
    "nation": "n_nationkey:int n_name:string n_regionkey:int",
    "customer": "c_custkey:bigint c_name:string c_nationkey:int c_acctbal:double c_mktsegment:string",
    "supplier": "s_suppkey:bigint s_name:string s_nationkey:int s_acctbal:double",
    "part": "p_partkey:bigint p_name:string p_brand:string p_type:string p_size:int p_retailprice:double",
    "orders": "o_orderkey:bigint o_custkey:bigint o_orderstatus:string o_totalprice:double o_orderdate:timestamp_ntz o_orderpriority:string",
    "lineitem": "l_orderkey:bigint l_partkey:bigint l_suppkey:bigint l_linenumber:int l_quantity:double l_extendedprice:double "
    "l_discount:double l_tax:double l_returnflag:string l_linestatus:string l_shipdate:timestamp_ntz",
    "events": "event_id:bigint ts:timestamp_ntz user_id:bigint event_type:string value:double props:string",
    "documents": "doc_id:bigint text:string lang:string source:string n_chars:bigint",
    "embeddings": "vec_id:bigint embedding:array<float> label:int",
    "pages": "page_id:bigint url:string html:string",
    "benchmark": "item_id:bigint text:string",
    "labels": "doc_id:bigint quality:int toxic:int",
    "conversations": "conv_id:bigint turn:bigint role:string text:string",
}
_KIND = {"int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR", "timestamp_ntz": "TIMESTAMP", "array<float>": "ARRAY"}


def _columns(table: str) -> list[tuple[str, str]]:
    return [tuple(c.split(":")) for c in COLUMNS[table].split(" ")]


def _profile(table: str) -> str:
    return "\nUNION ALL ".join(
        f"SELECT '{table}' AS table_name, CAST({i} AS INTEGER) AS ordinal, '{c}' AS column_name, '{_KIND[t]}' AS type, '{t}' AS original_type, "
        f"count(\"{c}\") < count(*) AS nullable, CAST({f'max(length({c}))' if t == 'string' else 'NULL'} AS INTEGER) AS max_length, "
        f"CAST(NULL AS INTEGER) AS precision, CAST(NULL AS INTEGER) AS scale, count(*) AS row_count FROM {table}"
        for i, (c, t) in enumerate(_columns(table), 1)
    )


_CATALOG = "\nUNION ALL ".join(_profile(t) for t in legacy.TABLES)


@query(_CATALOG)
def schema_catalog(spark, d):
    return catalog.schema_catalog(legacy.all_tables(spark, d))


@query(_profile("lineitem"))
def table_columns(spark, d):
    return catalog.table_catalog(legacy.table(spark, d, "lineitem"), "lineitem")


@query(
    f"""WITH c AS ({_CATALOG}), s AS (SELECT table_name, count(*) AS column_count, max(row_count) AS row_count FROM c GROUP BY 1)
        SELECT * FROM s UNION ALL SELECT '(all tables)', CAST(sum(column_count) AS BIGINT), CAST(sum(row_count) AS BIGINT) FROM s"""
)
def schema_summary(spark, d):
    return catalog.schema_summary(catalog.schema_catalog(legacy.all_tables(spark, d)))


LONG_TEXT = {"documents": ("text",), "pages": ("html", "url"), "benchmark": ("text",), "conversations": ("text",)}


@query(
    "\nUNION ALL ".join(
        f"SELECT '{t}' AS table_name, '{c}' AS column_name, count(*) AS row_count, count(DISTINCT \"{c}\") AS distinct_count, "
        f"count(*) > 0 AND count(\"{c}\") = count(*) AND count(DISTINCT \"{c}\") = count(*) AS is_candidate FROM {t}"
        for t in legacy.TABLES
        for c, k in _columns(t)
        if not k.startswith("array")
    )
)
def key_candidates(spark, d):
    return catalog.key_candidates(legacy.all_tables(spark, d), LONG_TEXT)


@query(f"SELECT * FROM ({_COUNTS}) WHERE table_name IN ('orders', 'lineitem', 'customer')")
def table_select(spark, d):
    found = catalog.list_tables(legacy.all_tables(spark, d))
    return tables.choose_tables(found, ["orders", "lineitem", "customer", "no_such_table"])


@query(f"SELECT * FROM ({_COUNTS}) WHERE table_name IN ('orders', 'lineitem', 'customer', 'events') AND table_name NOT IN ('events', 'part')")
def table_include_exclude(spark, d):
    found = catalog.list_tables(legacy.all_tables(spark, d))
    return tables.include_exclude(found, ["orders", "lineitem", "customer", "events"], ["events", "part"])


@query(f"SELECT * FROM ({_COUNTS}) ORDER BY row_count DESC, table_name LIMIT 1")
def largest_table(spark, d):
    return loading.largest_table(catalog.list_tables(legacy.all_tables(spark, d)))


@query(
    """SELECT o_orderkey AS order_id, o_orderdate AS placed_on, o_custkey, o_orderstatus, o_totalprice, o_orderpriority FROM orders"""
)
def rename_columns(spark, d):
    return restructure.rename_columns(legacy.table(spark, d, "orders"), {"o_orderkey": "order_id", "o_orderdate": "placed_on"})


@query("SELECT c_name AS c_mktsegment, c_custkey, c_nationkey, c_acctbal FROM customer")
def rename_collision(spark, d):
    return restructure.rename_columns(legacy.table(spark, d, "customer"), {"c_name": "c_mktsegment"})


@query(
    """SELECT CAST(p_partkey AS INTEGER) AS part_id, p_name AS part_name, p_brand, p_type, CAST(p_size AS SMALLINT) AS p_size,
       CAST(p_retailprice AS DECIMAL(12,2)) AS price FROM part"""
)
def map_structure(spark, d):
    return restructure.map_structure(
        legacy.table(spark, d, "part"),
        {"p_partkey": "part_id", "p_name": "part_name", "p_retailprice": "price"},
        {"bigint": "INTEGER", "double": "NUMERIC(12,2)"},
        {"p_size": "SMALLINT"},
    )


@query(
    q.with_(q.TARGET_CATALOG)
    + """SELECT table_name, column_name, CASE WHEN max_length * 50 > 8191 THEN 'BLOB SUB_TYPE 1'
           ELSE concat('VARCHAR(', max_length * 50, ')') END AS adapted_type
         FROM catalog_tgt WHERE type = 'TEXT'"""
)
def adapt_long_varchar(spark, d):
    columns = legacy.catalog_tgt(spark, d).where("type = 'TEXT'")
    declared = F.concat(F.lit("VARCHAR("), F.col("max_length") * 50, F.lit(")"))
    return columns.select("table_name", "column_name", adapt(declared, F.lit("ALPHA")).alias("adapted_type"))


@query(
    """SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN CAST(p_size AS VARCHAR) WHEN 1 THEN concat('''', p_name, '''')
         WHEN 2 THEN 'CURRENT_DATE' END AS default_value FROM part"""
)
def clean_defaults(spark, d):
    declared = """CASE CAST(p_partkey % 4 AS INT) WHEN 0 THEN concat('DEFAULT ', p_size) WHEN 1 THEN concat("  DEFAULT '", p_name, "' ")
                  WHEN 2 THEN 'CURRENT_DATE' END"""
    return legacy.table(spark, d, "part").select("p_partkey", clean_default(F.expr(declared)).alias("default_value"))


@query(
    """SELECT o_orderkey AS order_id, CAST(o_totalprice AS DECIMAL(15,2)) AS total FROM orders
       WHERE o_orderstatus = 'F' AND o_totalprice > 250000"""
)
def mapping_filter(spark, d):
    mapping = TableMapping(
        "orders_to_big",
        ("orders",),
        "big_orders",
        (ColumnMapping("o_orderkey", "order_id", direct=True), ColumnMapping("o_totalprice", "total", "DOUBLE", "NUMERIC(15,2)")),
        filters=("o_orderstatus = 'F'", "o_totalprice > 250000"),
    )
    return restructure.insert_select(legacy.table(spark, d, "orders"), mapping)


ORDER_CONVERSIONS = [
    Conversion("order_no", "order_id", "VARCHAR", "BIGINT"),
    Conversion("cust_no", "customer_id", "VARCHAR", "BIGINT"),
    Conversion("order_date_txt", "order_date", "VARCHAR", "DATE"),
    Conversion("total_txt", "total", "VARCHAR", "DOUBLE"),
    Conversion("status", "status", "CHAR(1)", "CHAR", convert=False),
]


def marked_orders(spark: SparkSession, d: str) -> DataFrame:
    """Legacy orders typed and marked good when date and total both convert."""
    raw = legacy.legacy_orders(spark, d)
    typed = typed_table(
        raw.withColumns({"priority": strip_space(F.col("priority_pad")), "paid": logical(F.col("paid_flag"))}),
        ORDER_CONVERSIONS,
        keep=("priority", "paid"),
    )
    return typed.withColumn("is_good", F.col("order_date").isNotNull() & F.col("total").isNotNull())


@query(
    q.with_(q.LEGACY_ORDERS)
    + f"""SELECT * FROM (SELECT CAST(order_no AS BIGINT) AS order_id, CAST(cust_no AS BIGINT) AS customer_id,
          {q.to_date('order_date_txt')} AS order_date, CAST({q.to_number('total_txt')} AS DECIMAL(15,2)) AS total, status,
          {q.trimmed('priority_pad')} AS priority,
          CASE paid_flag WHEN 'T' THEN true WHEN 'F' THEN false END AS paid FROM legacy_orders WHERE status <> 'P')
          WHERE order_date IS NOT NULL AND total IS NOT NULL"""
)
def migrate_orders(spark, d):
    """Flagship: filter, trim, convert, map flags, rename, keep the good rows."""
    good = keep_computed(marked_orders(spark, d).where("status <> 'P'"), F.col("is_good"))
    return good.select(
        "order_id", "customer_id", "order_date", F.col("total").cast("decimal(15,2)").alias("total"), "status", "priority", "paid"
    )


ORDER_RULES = [
    Rule("order_date_txt", "pattern", pattern=r"\d", message="no digits in the date"),
    Rule("total_txt", "required", message="total is missing"),
    Rule("total_txt", "pattern", pattern=r"^[\s0-9.,-]*$", message="total is not numeric"),
    Rule("note", "length", max=5, message="note is too long"),
]
_BROKEN = """concat_ws('; ',
    CASE WHEN NOT regexp_matches(order_date_txt, '\\d') THEN 'order_date_txt: no digits in the date' END,
    CASE WHEN total_txt = '' THEN 'total_txt: total is missing' END,
    CASE WHEN NOT regexp_full_match(total_txt, '[\\s0-9.,-]*') THEN 'total_txt: total is not numeric' END,
    CASE WHEN length(note) > 5 THEN 'note: note is too long' END)"""


@query(q.with_(q.LEGACY_ORDERS) + f"SELECT * FROM legacy_orders WHERE coalesce({_BROKEN}, '') = ''")
def quarantine_good(spark, d):
    return split_by_rules(legacy.legacy_orders(spark, d), ORDER_RULES)[0]


@query(q.with_(q.LEGACY_ORDERS) + f"SELECT *, {_BROKEN} AS reject_reason FROM legacy_orders WHERE coalesce({_BROKEN}, '') <> ''")
def quarantine_rejected(spark, d):
    return split_by_rules(legacy.legacy_orders(spark, d), ORDER_RULES)[1]


@query(
    q.with_(q.LEGACY_ORDERS)
    + f"""SELECT CASE WHEN coalesce({_BROKEN}, '') = '' THEN 'good' ELSE {_BROKEN} END AS outcome, count(*) AS row_count FROM legacy_orders GROUP BY 1"""
)
def quarantine_load(spark, d):
    """Write good and rejected rows in one pass, then count both by reason."""
    good, bad = loading.write_quarantined(legacy.legacy_orders(spark, d), ORDER_RULES, fresh_path(spark, "quarantine"))
    kept = good.agg(F.lit("good").alias("outcome"), F.count(F.lit(1)).alias("row_count"))
    return kept.unionByName(bad.groupBy(F.col("reject_reason").alias("outcome")).agg(F.count(F.lit(1)).alias("row_count")))


@query(
    q.with_(q.LEGACY_CUSTOMER)
    + """SELECT cust_no, CASE WHEN small_code > 32767 THEN 'small_code' ELSE '' END AS unfit_columns FROM legacy_customer WHERE small_code > 32767"""
)
def insert_errors(spark, d):
    customers = legacy.legacy_customer(spark, d)
    _, unfit = loading.reject_unfit(customers, {"small_code": "SMALLINT", "balance_txt": "NUMERIC(15,2)"})
    return unfit.select("cust_no", "unfit_columns")


@query(q.with_(q.LEGACY_ORDERS) + """SELECT *, total_txt <> '' AS required_ok, coalesce(length(note) <= 5, true) AS length_ok,
    coalesce(CAST(cust_no AS DOUBLE) BETWEEN 10 AND 1000, false) AS range_ok, regexp_matches(total_txt, '^[0-9.,-]+$') AS pattern_ok,
    status IN ('O', 'F') AS custom_ok FROM legacy_orders""")
def validation_rules(spark, d):
    raw = legacy.legacy_orders(spark, d)
    rules = {
        "required_ok": Rule("total_txt", "required"),
        "length_ok": Rule("note", "length", max=5),
        "range_ok": Rule("cust_no", "range", min=10, max=1000),
        "pattern_ok": Rule("total_txt", "pattern", pattern="^[0-9.,-]+$"),
        "custom_ok": Rule("status", "custom", expression="status IN ('O', 'F')"),
    }
    return raw.withColumns({n: rule_passes(r, raw.schema[r.column].dataType) for n, r in rules.items()})


@query(
    """SELECT l_orderkey AS order_id, l_linenumber AS line_no, l_partkey AS part_id, CAST(l_extendedprice AS DECIMAL(15,2)) AS price,
       lower(l_returnflag) AS l_returnflag, l_shipdate FROM lineitem WHERE l_quantity >= 10"""
)
def sink_roundtrip(spark, d):
    """Write a mapped table to the shared folder and read it back."""
    mapping = TableMapping(
        "lineitem_to_lines",
        ("lineitem",),
        "lines",
        (
            ColumnMapping("l_orderkey", "order_id", direct=True),
            ColumnMapping("l_linenumber", "line_no", direct=True),
            ColumnMapping("l_partkey", "part_id", direct=True),
            ColumnMapping("l_extendedprice", "price", "DOUBLE", "NUMERIC(15,2)"),
            ColumnMapping("l_returnflag", "l_returnflag", expression="lower(l_returnflag)"),
            ColumnMapping("l_shipdate", "l_shipdate", direct=True),
        ),
        filters=("l_quantity >= 10",),
    )
    path = fresh_path(spark, "lines")
    loading.append_files(restructure.insert_select(legacy.table(spark, d, "lineitem"), mapping), path)
    return spark.read.parquet(path)


@query(
    q.with_(q.LEGACY_ORDERS, q.LEGACY_CUSTOMER)
    + f"""SELECT 'orders_clean' AS target_table, count(*) AS rows_read,
            count(*) FILTER (WHERE {q.to_date('order_date_txt')} IS NOT NULL AND ({q.to_number('total_txt')}) IS NOT NULL) AS rows_good,
            count(*) FILTER (WHERE NOT ({q.to_date('order_date_txt')} IS NOT NULL AND ({q.to_number('total_txt')}) IS NOT NULL)) AS rows_rejected FROM legacy_orders
          UNION ALL SELECT 'customers_clean', count(*), count(*) FILTER (WHERE segment IS NOT NULL), count(*) FILTER (WHERE segment IS NULL) FROM legacy_customer"""
)
def dry_run_counts(spark, d):
    customers = legacy.legacy_customer(spark, d)
    return loading.dry_run(
        {
            "orders_clean": (legacy.legacy_orders(spark, d), marked_orders(spark, d)),
            "customers_clean": (customers, customers.withColumn("is_good", F.col("segment").isNotNull())),
        }
    )


PLAN = MigrationPlan.from_dict(
    {
        "tables": ["orders", "customer", "lineitem", "missing"],
        "parallelTables": 3,
        "mapping": {
            "tables": {"orders": "sales_orders", "customer": "clients"},
            "columns": {"orders": {"o_orderkey": "order_id"}, "customer": {"c_custkey": "client_id", "c_name": "client_name"}},
            "types": {"double": "NUMERIC(15,2)"},
        },
        "filters": {"orders": {"where": "o_orderkey % 100 <> 0"}, "lineitem": {"where": "l_linenumber <= 5"}},
        "transforms": [
            {"table": "customer", "column": "c_name", "function": "toUpperCase"},
            {"table": "orders", "column": "o_orderpriority", "function": "toLowerCase"},
        ],
    }
)


@query(
    """SELECT t AS table_name, s AS source_rows, g AS target_rows, s - g AS difference, CASE WHEN s = g THEN 'ok' ELSE 'warning' END AS status FROM (
       SELECT 'orders' AS t, (SELECT count(*) FROM orders) AS s, (SELECT count(*) FROM orders WHERE o_orderkey % 100 <> 0) AS g
       UNION ALL SELECT 'customer', (SELECT count(*) FROM customer), (SELECT count(*) FROM customer)
       UNION ALL SELECT 'lineitem', (SELECT count(*) FROM lineitem), (SELECT count(*) FROM lineitem WHERE l_linenumber <= 5))"""
)
def migration_run(spark, d):
    """A whole run: load three tables at once, then reconcile both sides."""
    target = FolderTarget(fresh_path(spark, "migration"))
    migrate(spark, source(d), target, PLAN)
    names = ("orders", "customer", "lineitem")
    src = catalog.list_tables({n: source(d).read(spark, n) for n in names})
    return loading.reconcile_counts(src, catalog.list_tables({n: target.read(spark, PLAN.target_name(n)) for n in names}))


@query(
    """SELECT c_custkey AS client_id, upper(c_name) AS client_name, c_nationkey, CAST(c_acctbal AS DECIMAL(15,2)) AS c_acctbal, c_mktsegment FROM customer"""
)
def plan_table(spark, d):
    return compile_plan(spark, source(d), PLAN)["clients"]


@query(
    """SELECT 'orders' AS table_name, (SELECT count(*) FROM orders) AS source_rows, (SELECT count(*) FROM orders WHERE o_orderkey % 100 <> 0) AS target_rows,
       (SELECT count(*) FROM orders WHERE o_orderkey % 100 = 0) AS difference, 'warning' AS status
       UNION ALL SELECT 'lineitem', (SELECT count(*) FROM lineitem), (SELECT count(*) FROM lineitem), 0, 'ok'"""
)
def reconcile_counts(spark, d):
    items = legacy.table(spark, d, "lineitem")
    src = tables.count_per_table({"orders": legacy.table(spark, d, "orders"), "lineitem": items})
    tgt = tables.count_per_table({"orders": legacy.migrated_orders(spark, d), "lineitem": items})
    return loading.reconcile_counts(src, tgt)


_SECONDS = "(epoch_us({b}) - epoch_us({a})) / 1000000.0"


@query(
    q.with_(q.BATCH_LOG)
    + f"""SELECT count(*) AS total_tables, count(*) AS tables_processed, CAST(sum(records) AS BIGINT) AS records_processed, CAST(sum(errors) AS BIGINT) AS errors,
          round({_SECONDS.format(a='min(s)', b='max(e)')}, 3) AS duration_seconds,
          round(sum(records) / ({_SECONDS.format(a='min(s)', b='max(e)')}), 4) AS average_throughput,
          arg_max(table_name, (records, table_name)) AS largest_table,
          string_agg(CASE WHEN errors > 40 THEN table_name END, ',' ORDER BY table_name) AS problem_tables
          FROM (SELECT table_name, sum(row_count) AS records, sum(error_count) AS errors, min(started_at) AS s, max(ended_at) AS e FROM batch_log GROUP BY 1)"""
)
def migration_stats(spark, d):
    return loading.migration_stats(legacy.batch_log(spark, d), error_limit=40)


@query(
    q.with_(q.BATCH_LOG)
    + f""", w AS (SELECT *, sum(row_count) OVER (PARTITION BY table_name ORDER BY batch_no) AS processed, sum(row_count) OVER (PARTITION BY table_name) AS total,
            {_SECONDS.format(a='min(started_at) OVER (PARTITION BY table_name)', b='ended_at')} AS elapsed FROM batch_log)
          SELECT table_name, batch_no, row_count AS batch_rows, CAST(processed AS BIGINT) AS processed, CAST(total AS BIGINT) AS total,
          CAST(floor(processed * 100.0 / total + 0.5) AS INTEGER) AS percent, round(processed / elapsed, 4) AS throughput,
          round((total - processed) / (processed / elapsed), 3) AS eta_seconds FROM w"""
)
def batch_progress(spark, d):
    return loading.batch_progress(legacy.batch_log(spark, d))


@query("SELECT o_orderkey, o_custkey, CAST((row_number() OVER (ORDER BY o_orderkey) - 1) // 1000 AS BIGINT) AS batch_no FROM orders")
def batch_assignment(spark, d):
    orders = legacy.table(spark, d, "orders").select("o_orderkey", "o_custkey")
    return numbering.assign_batches(orders, "o_orderkey", 1000)


@query(
    """SELECT o_orderkey, o_orderdate, row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS surrogate_id FROM orders"""
)
def surrogate_key(spark, d):
    orders = legacy.table(spark, d, "orders").select("o_orderkey", "o_orderdate")
    return numbering.number_by_order(orders, ["o_orderdate", "o_orderkey"], "surrogate_id")


@query("""SELECT event_id, ts AS happened_at, upper(event_type) AS kind, CAST(value AS DECIMAL(12,2)) AS amount FROM events WHERE value >= 1""")
def stream_replay(spark, d):
    """Replay the events files through a mapping, then read what was loaded."""

    def mapping(events: DataFrame) -> DataFrame:
        return events.where("value >= 1").selectExpr(
            "event_id", "ts AS happened_at", "upper(event_type) AS kind", "CAST(value AS DECIMAL(12,2)) AS amount"
        )

    target = fresh_path(spark, "replay")
    replay(spark, f"{d}/events.parquet*", legacy.table(spark, d, "events").schema, mapping, target)
    return replayed(spark, target).drop("batch_id")


_DDL = q.with_(q.TARGET_CATALOG) + """, cols AS (
  SELECT *, ordinal = 2 AS auto_increment, CASE WHEN type = 'INTEGER' THEN '0' END AS default_value FROM catalog_tgt),
per AS (SELECT table_name,
  string_agg(concat('  "', column_name, '" ', type, CASE WHEN nullable THEN '' ELSE ' NOT NULL' END,
     CASE WHEN default_value IS NULL THEN '' ELSE concat(' DEFAULT ''', default_value, '''') END), concat(',', chr(10)) ORDER BY ordinal) AS defs,
  string_agg(CASE WHEN is_pk THEN concat('"', column_name, '"') END, ', ' ORDER BY ordinal) AS keys,
  max(CASE WHEN auto_increment THEN upper(column_name) END) AS auto FROM cols GROUP BY 1),
st AS (
  SELECT table_name, 0 AS k, concat('CREATE TABLE "', table_name, '" (', chr(10), defs, ',', chr(10), '  PRIMARY KEY (', keys, ')', chr(10), ');') AS statement FROM per
  UNION ALL SELECT table_name, 1, concat('CREATE GENERATOR GEN_', auto, ';') FROM per WHERE auto IS NOT NULL
  UNION ALL SELECT table_name, 2, concat('SET GENERATOR GEN_', auto, ' TO 0;') FROM per WHERE auto IS NOT NULL
  UNION ALL SELECT table_name, 3, concat('CREATE UNIQUE INDEX PK_', upper(table_name), ' ON "', table_name, '" (', keys, ');') FROM per)
SELECT table_name, CAST(row_number() OVER (PARTITION BY table_name ORDER BY k) - 1 AS INTEGER) AS statement_no, statement FROM st"""


@query(_DDL)
def target_ddl(spark, d):
    columns = legacy.catalog_tgt(spark, d).withColumns(
        {"auto_increment": F.col("ordinal") == 2, "default_value": F.when(F.col("type") == "INTEGER", "0")}
    )
    return ddl(columns)


@query(
    q.with_(q.CATALOGS)
    + """SELECT concat(table_name, '.', column_name) AS column_name, type, ordinal FROM (SELECT * FROM catalog_src UNION ALL SELECT * FROM catalog_tgt)"""
)
def combined_columns(spark, d):
    from tableferry.operators.matching import combined_columns as combine

    sides = [legacy.catalog_src(spark, d), legacy.catalog_tgt(spark, d)]
    return combine(reduce(DataFrame.unionByName, sides))


REJECT_PLAN = MigrationPlan.from_dict(
    {
        "tables": ["orders", "customer"],
        "parallelTables": 2,
        "mapping": {"tables": {"orders": "sales_orders"}, "columns": {"orders": {"o_orderkey": "order_id"}}, "types": {"bigint": "SMALLINT"}},
    }
)

_UNFIT = "CASE WHEN {c} IS NOT NULL AND TRY_CAST({c} AS SMALLINT) IS NULL THEN '{c}' END"
_REJECTS = """SELECT '{t}' AS target_table, nullif(concat_ws(',', {cols}), '') AS reject_columns FROM {src}"""


@query(
    "WITH m AS ("
    + _REJECTS.format(t="sales_orders", cols=", ".join(_UNFIT.format(c=c) for c in ("o_orderkey", "o_custkey")), src="orders")
    + " UNION ALL "
    + _REJECTS.format(t="customer", cols=_UNFIT.format(c="c_custkey"), src="customer")
    + """), g AS (SELECT target_table, CASE WHEN reject_columns IS NULL THEN 'good' ELSE 'rejected' END AS row_outcome, reject_columns, count(*) AS row_count FROM m GROUP BY ALL)
    SELECT target_table, row_outcome, reject_columns, row_count, sum(row_count) OVER (PARTITION BY target_table, row_outcome) AS logged_rows FROM g"""
)
def migration_rejects(spark, d):
    """A run whose new types do not hold every value: good and rejected rows are written in one pass, per table and run.

    Returns, per target table, outcome and set of failing columns, the rows
    written, and the count the run log took from the same pass (for all sets of
    that outcome).  Run twice under one name, so that the second run replaces the first.
    """
    target = FolderTarget(fresh_path(spark, "migration"))
    migrate(spark, source(d), target, REJECT_PLAN, run="nightly")
    log = migrate(spark, source(d), target, REJECT_PLAN, run="nightly")
    counted = log.select(
        "target_table",
        F.explode(F.array(F.struct(F.lit("good").alias("o"), F.col("row_count").alias("n")), F.struct(F.lit("rejected").alias("o"), F.col("rejected_count").alias("n")))).alias("c"),
    ).select("target_table", F.col("c.o").alias("row_outcome"), F.col("c.n").alias("logged_rows"))
    written = reduce(
        DataFrame.unionByName,
        [
            target._all(spark, REJECT_PLAN.target_name(t)).groupBy(F.lit(REJECT_PLAN.target_name(t)).alias("target_table"), "row_outcome", "reject_columns").agg(F.count(F.lit(1)).alias("row_count"))
            for t in ("orders", "customer")
        ],
    )
    return written.join(counted, ["target_table", "row_outcome"])
