"""Joins, splits, lookups and column rules."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tableferry.functions import legacy_columns as lc
from tableferry.operators import restructure as rs
from tableferry.plans.model import ColumnMapping as Col
from tableferry.plans.model import JoinCondition, TableMapping
from tableferry.sources import legacy
from tableferry.suite import sqltext as q
from tableferry.suite.registry import query

ORDERS, CUSTOMERS = q.with_(q.LEGACY_ORDERS), q.with_(q.LEGACY_CUSTOMER)


def _tables(spark, d, *names):
    return {n: legacy.table(spark, d, n) for n in names}


def _direct(source, target):
    return Col(source, target, direct=True)


@query("SELECT o_orderkey AS order_id, o_totalprice AS total, c_name AS customer FROM orders JOIN customer ON o_custkey = c_custkey")
def join_inner(spark, d):
    mapping = TableMapping(
        "orders_customer_to_sales",
        ("orders", "customer"),
        "sales",
        (_direct("orders.o_orderkey", "order_id"), _direct("orders.o_totalprice", "total"), _direct("customer.c_name", "customer")),
        "many-to-one",
        (JoinCondition("orders", "o_custkey", "customer", "c_custkey"),),
    )
    return rs.compile_mapping(_tables(spark, d, "orders", "customer"), mapping)


@query(
    """SELECT l_orderkey AS order_id, l_linenumber AS line_no, CAST(l_extendedprice AS DECIMAL(15,2)) AS price, c_name AS customer, n_name AS nation, r_name AS region,
       upper(p_name) AS part FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
       JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey JOIN part ON l_partkey = p_partkey WHERE l_quantity > 30"""
)
def join_chain(spark, d):
    names = ("lineitem", "orders", "customer", "nation", "region", "part")
    mapping = TableMapping(
        "lineitem_wide",
        names,
        "wide_lines",
        (
            _direct("lineitem.l_orderkey", "order_id"),
            _direct("lineitem.l_linenumber", "line_no"),
            Col("lineitem.l_extendedprice", "price", "DOUBLE", "NUMERIC(15,2)"),
            _direct("customer.c_name", "customer"),
            _direct("nation.n_name", "nation"),
            _direct("region.r_name", "region"),
            Col("part.p_name", "part", expression="upper(part.p_name)"),
        ),
        "many-to-one",
        (
            JoinCondition("lineitem", "l_orderkey", "orders", "o_orderkey"),
            JoinCondition("orders", "o_custkey", "customer", "c_custkey"),
            JoinCondition("customer", "c_nationkey", "nation", "n_nationkey"),
            JoinCondition("nation", "n_regionkey", "region", "r_regionkey"),
            JoinCondition("lineitem", "l_partkey", "part", "p_partkey"),
        ),
        filters=("lineitem.l_quantity > 30",),
    )
    return rs.compile_mapping(_tables(spark, d, *names), mapping)


def _outer(kind, spark, d):
    """Orders above a price against customers in two segments, so both sides have misses."""
    tables = {
        "orders": legacy.table(spark, d, "orders").where("o_totalprice > 300000"),
        "customer": legacy.table(spark, d, "customer").where("c_mktsegment IN ('BUILDING', 'MACHINERY')"),
    }
    mapping = TableMapping(
        "outer",
        ("orders", "customer"),
        "sales",
        (_direct("orders.o_orderkey", "order_id"), _direct("customer.c_custkey", "customer_id"), _direct("customer.c_mktsegment", "segment")),
        "many-to-one",
        (JoinCondition("orders", "o_custkey", "customer", "c_custkey", kind),),
    )
    return rs.compile_mapping(tables, mapping)


_OUTER = """SELECT o_orderkey AS order_id, c_custkey AS customer_id, c_mktsegment AS segment FROM (SELECT * FROM orders WHERE o_totalprice > 300000)
            {kind} JOIN (SELECT * FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY')) ON o_custkey = c_custkey"""


@query(_OUTER.format(kind="LEFT"))
def join_left(spark, d):
    return _outer("LEFT", spark, d)


@query(_OUTER.format(kind="RIGHT"))
def join_right(spark, d):
    return _outer("RIGHT", spark, d)


@query(_OUTER.format(kind="FULL"))
def join_full(spark, d):
    return _outer("FULL", spark, d)


@query(
    """SELECT l_orderkey AS order_id, l_linenumber AS line_no, o_orderdate AS order_date FROM lineitem
       JOIN orders ON l_orderkey = o_orderkey AND l_shipdate = o_orderdate"""
)
def join_multi_key(spark, d):
    """Two conditions on one pair of tables make one join on both keys."""
    mapping = TableMapping(
        "same_day",
        ("lineitem", "orders"),
        "same_day_lines",
        (_direct("lineitem.l_orderkey", "order_id"), _direct("lineitem.l_linenumber", "line_no"), _direct("orders.o_orderdate", "order_date")),
        "many-to-one",
        (JoinCondition("lineitem", "l_orderkey", "orders", "o_orderkey"), JoinCondition("lineitem", "l_shipdate", "orders", "o_orderdate")),
    )
    return rs.compile_mapping(_tables(spark, d, "lineitem", "orders"), mapping)


SPLIT = {"header": ["o_orderkey", "o_custkey", "o_orderdate"], "detail": ["o_orderkey", "o_totalprice"], "status": ["o_orderstatus", "o_orderpriority"]}


@query("SELECT o_orderkey, o_custkey, o_orderdate FROM orders")
def split_header(spark, d):
    return rs.split_table(legacy.table(spark, d, "orders"), SPLIT, ["status"])["header"]


@query("SELECT o_orderkey, o_totalprice FROM orders")
def split_detail(spark, d):
    return rs.split_table(legacy.table(spark, d, "orders"), SPLIT, ["status"])["detail"]


@query("SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders")
def split_lookup(spark, d):
    return rs.split_table(legacy.table(spark, d, "orders"), SPLIT, ["status"])["status"]


@query(
    ORDERS
    + """SELECT CAST(order_no AS BIGINT) AS order_id, status AS state, trim(priority_pad, concat(chr(9), chr(10), ' ')) AS priority,
         coalesce(note, 'none') AS note FROM legacy_orders"""
)
def insert_select(spark, d):
    mapping = TableMapping(
        "legacy_orders_to_orders",
        ("legacy_orders",),
        "orders",
        (
            Col("order_no", "order_id", "VARCHAR", "BIGINT"),
            _direct("status", "state"),
            Col("priority_pad", "priority", expression="btrim(priority_pad, ' \\t\\n')"),
            Col("note", "note", direct=True, nullable=False, default="none"),
        ),
    )
    return rs.compile_mapping({"legacy_orders": legacy.legacy_orders(spark, d)}, mapping)


@query(
    """SELECT c_custkey, coalesce(n_name, 'unknown') AS nation, CASE c_mktsegment WHEN 'BUILDING' THEN 'B' WHEN 'MACHINERY' THEN 'M' ELSE '-' END AS segment
       FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey"""
)
def lookup_transform(spark, d):
    """A lookup in another table and one in a literal table."""
    looked = rs.lookup_table(legacy.table(spark, d, "customer"), "c_nationkey", legacy.table(spark, d, "nation"), "n_nationkey", "n_name", "nation", "unknown")
    segment = rs.lookup_values(F.col("c_mktsegment"), {"BUILDING": "B", "MACHINERY": "M"}, "-")
    return looked.select("c_custkey", "nation", segment.alias("segment"))


@query(
    """SELECT l_returnflag, l_linestatus, count(*) AS line_count, CAST(sum(CAST(l_extendedprice AS DECIMAL(15,2))) AS DECIMAL(25,2)) AS revenue,
       max(l_shipdate) AS last_shipped FROM lineitem WHERE l_quantity > 5 GROUP BY 1, 2"""
)
def aggregate_mapping(spark, d):
    mapping = TableMapping(
        "lineitem_summary",
        ("lineitem",),
        "line_summary",
        (
            Col("", "line_count", expression="count(*)"),
            Col("", "revenue", expression="CAST(sum(CAST(l_extendedprice AS DECIMAL(15,2))) AS DECIMAL(25,2))"),
            Col("", "last_shipped", expression="max(l_shipdate)"),
        ),
        filters=("l_quantity > 5",),
        group_by=("l_returnflag", "l_linestatus"),
    )
    return rs.compile_mapping(_tables(spark, d, "lineitem"), mapping)


# -- column rules -----------------------------------------------------------


@query(CUSTOMERS + "SELECT cust_no, trim(name_alpha) AS name, length(trim(name_alpha)) <= 18 AS fits FROM legacy_customer")
def legacy_alpha(spark, d):
    name = lc.legacy_column(F.col("name_alpha"), T.StringType(), "A", "VARCHAR(18)")
    return legacy.legacy_customer(spark, d).select("cust_no", name.alias("name"), (F.char_length(name) <= 18).alias("fits"))


@query(CUSTOMERS + "SELECT cust_no, TRY_CAST(credit_score AS DECIMAL(12,3)) AS score, CAST(balance_txt AS DECIMAL(15,2)) AS balance FROM legacy_customer")
def legacy_number(spark, d):
    return legacy.legacy_customer(spark, d).select(
        "cust_no",
        lc.legacy_column(F.col("credit_score"), T.DoubleType(), "NUMBER", "NUMERIC", 12, 3).alias("score"),
        lc.legacy_column(F.col("balance_txt"), T.StringType(), "N", "NUMERIC").alias("balance"),
    )


@query("SELECT p_partkey, CASE WHEN p_partkey % 9 = 0 THEN NULL ELSE CAST(p_retailprice AS DECIMAL(15,2)) END AS price FROM part")
def legacy_currency(spark, d):
    """Amounts that overflow numeric(15,2) become NULL instead of failing."""
    amount = F.expr("CASE WHEN p_partkey % 9 = 0 THEN p_retailprice * 1e13 ELSE p_retailprice END")
    return legacy.table(spark, d, "part").select("p_partkey", lc.legacy_column(amount, T.DoubleType(), "C", "NUMERIC").alias("price"))


@query(
    """SELECT event_id, CAST(ts AS DATE) AS day, strftime(ts, '%H:%M:%S') AS clock, date_trunc('second', ts) AS stamp FROM events"""
)
def legacy_datetime(spark, d):
    text = F.date_format("ts", "yyyy-MM-dd HH:mm:ss")
    return legacy.table(spark, d, "events").select(
        "event_id",
        lc.legacy_column(F.date_format("ts", "yyyy-MM-dd"), T.StringType(), "D", "DATE").alias("day"),
        lc.legacy_column(F.col("ts"), T.TimestampNTZType(), "T", "TIME").alias("clock"),
        lc.legacy_column(text, T.StringType(), "@", "TIMESTAMP").alias("stamp"),
    )


@query(ORDERS + "SELECT order_no, CASE paid_flag WHEN 'T' THEN true WHEN 'F' THEN false END AS paid FROM legacy_orders")
def legacy_logical(spark, d):
    return legacy.legacy_orders(spark, d).select("order_no", lc.legacy_column(F.col("paid_flag"), T.StringType(), "L", "BOOLEAN").alias("paid"))


@query(ORDERS + "SELECT order_no, paid_flag = 'T' AS paid FROM legacy_orders")
def legacy_logical_strict(spark, d):
    return legacy.legacy_orders(spark, d).select("order_no", lc.logical(F.col("paid_flag"), strict=True).alias("paid"))


@query("SELECT doc_id, text AS memo FROM documents")
def legacy_memo(spark, d):
    return legacy.table(spark, d, "documents").select("doc_id", lc.legacy_column(F.col("text"), T.StringType(), "M", "BLOB SUB_TYPE TEXT").alias("memo"))


@query(CUSTOMERS + "SELECT cust_no, coalesce(segment, 'NONE') AS segment, segment AS segment_nullable FROM legacy_customer")
def default_fill(spark, d):
    c = F.col("segment")
    return legacy.legacy_customer(spark, d).select(
        "cust_no", lc.fill_default(c, "NONE").alias("segment"), lc.fill_default(c, "NONE", nullable=True).alias("segment_nullable")
    )


@query(
    ORDERS
    + f"""SELECT order_no, nullif(trim(note), '') AS note, CASE paid_flag WHEN 'T' THEN true WHEN 'F' THEN false END AS paid,
          {q.to_date('order_date_txt')} AS order_date, TRY_CAST(CASE WHEN regexp_full_match(trim(total_txt), '[0-9.]+') THEN trim(total_txt) END AS DECIMAL(15,2)) AS total
          FROM legacy_orders"""
)
def legacy_options(spark, d):
    return legacy.legacy_orders(spark, d).select(
        "order_no",
        lc.legacy_options(F.col("note"), {"trim": True, "empty_to_null": True}).alias("note"),
        lc.legacy_options(F.col("paid_flag"), {"boolean": "T/F"}).alias("paid"),
        lc.legacy_options(F.col("order_date_txt"), {"dates": True}).alias("order_date"),
        lc.legacy_options(F.col("total_txt"), {"trim": True, "currency": True}).alias("total"),
    )


@query("SELECT event_id, date_trunc('hour', ts) AS hour FROM events")
def legacy_timestamp_precision(spark, d):
    return legacy.table(spark, d, "events").select("event_id", lc.legacy_options(F.col("ts"), {"timestamp_precision": "HOUR"}).alias("hour"))


@query(
    """SELECT o_orderkey, substring(o_orderpriority, 1, 6) AS priority, o_orderkey AS order_id, CAST(o_totalprice AS DECIMAL(12,1)) AS total,
       o_orderdate AS placed, CAST(o_custkey AS VARCHAR) AS customer FROM orders"""
)
def sqlite_column_rules(spark, d):
    return legacy.table(spark, d, "orders").select(
        "o_orderkey",
        lc.sqlite_column(F.col("o_orderpriority"), "TEXT", "VARCHAR(6)", max_length=6).alias("priority"),
        lc.sqlite_column(F.col("o_orderkey"), "INTEGER", "INTEGER").alias("order_id"),
        lc.sqlite_column(F.col("o_totalprice"), "REAL", "NUMERIC(12,1)", precision=12, scale=1).alias("total"),
        lc.sqlite_column(F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss"), "DATETIME", "TIMESTAMP").alias("placed"),
        lc.sqlite_column(F.col("o_custkey"), "INTEGER", "VARCHAR(20)").alias("customer"),
    )


@query(
    CUSTOMERS
    + """SELECT cust_no, segment AS direct_value, CAST(balance_txt AS DECIMAL(38,10)) AS number_value, CAST(small_code AS VARCHAR) AS text_value,
         CAST(credit_score AS BIGINT) > -1000 AS cast_value, 'direct,text_to_number,number_to_text,cast' AS rules FROM legacy_customer"""
)
def generic_column_rules(spark, d):
    df = legacy.legacy_customer(spark, d)
    parts = {
        "direct_value": lc.generic_column(F.col("segment"), T.StringType(), "VARCHAR", "TEXT"),
        "number_value": lc.generic_column(F.col("balance_txt"), T.StringType(), "VARCHAR", "DECIMAL"),
        "text_value": lc.generic_column(F.col("small_code"), T.IntegerType(), "INTEGER", "VARCHAR"),
        "cast_value": lc.generic_column(F.col("credit_score") > -1000, T.BooleanType(), "LOGICAL_FLAG", "BOOLEAN"),
    }
    rules = F.lit(",".join(rule for rule, _ in parts.values())).alias("rules")
    return df.select("cust_no", *[c.alias(n) for n, (_, c) in parts.items()], rules)


@query("SELECT p_partkey, split_part(p_name, ' ', 1) AS adjective, split_part(p_name, ' ', 2) AS noun, nullif(split_part(p_name, ' ', 3), '') AS rest FROM part")
def split_column(spark, d):
    return legacy.table(spark, d, "part").select("p_partkey", *lc.split_text(F.col("p_name"), " ", ["adjective", "noun", "rest"]))


@query(CUSTOMERS + "SELECT cust_no, concat_ws(' / ', trim(name_alpha), segment, balance_txt) AS label FROM legacy_customer")
def merge_columns(spark, d):
    label = lc.merge_text([F.trim("name_alpha"), F.col("segment"), F.col("balance_txt")], " / ")
    return legacy.legacy_customer(spark, d).select("cust_no", label.alias("label"))


@query(
    """SELECT l_orderkey, l_linenumber, CAST(CAST(l_extendedprice AS DECIMAL(12,2)) * CAST(1 - l_discount AS DECIMAL(4,2)) AS DECIMAL(15,2)) AS net,
       CAST(l_quantity AS INTEGER) % 7 AS lot FROM lineitem"""
)
def calculate_column(spark, d):
    return legacy.table(spark, d, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        lc.calculated("CAST(l_extendedprice AS DECIMAL(12,2)) * CAST(1 - l_discount AS DECIMAL(4,2))", 15, 2).alias("net"),
        lc.calculated("CAST(l_quantity AS INT) % 7").alias("lot"),
    )


def _one_to_many(target, columns, **extra):
    return TableMapping.from_dict(
        {
            "id": f"orders_to_{target}",
            "sourceTable": "orders",
            "targetTable": target,
            "mappingType": "one-to-many",
            "columnMappings": [{"sourceColumn": s, "targetColumn": t, "transformation": {"type": "direct"}} for s, t in columns],
            **extra,
        }
    )


FAN_OUT = [
    _one_to_many("order_headers", [("o_orderkey", "order_id"), ("o_custkey", "customer_id"), ("o_totalprice", "total")]),
    _one_to_many("open_orders", [("o_orderkey", "order_id"), ("o_orderstatus", "status")], filterConditions=["o_orderstatus <> 'F'"]),
    _one_to_many("archived", [("o_orderkey", "order_id")], enabled=False),
]
PRIORITIES = TableMapping(**{**_one_to_many("priorities", [("o_orderpriority", "priority"), ("o_orderdate", "first_date")]).__dict__, "distinct": True})


@query(
    """SELECT 'order_headers' AS target_table, count(*) AS row_count, sum(o_orderkey) AS key_sum, count(DISTINCT o_orderkey) AS keys FROM orders
       UNION ALL SELECT 'open_orders', count(*), sum(o_orderkey), count(DISTINCT o_orderkey) FROM orders WHERE o_orderstatus <> 'F'
       UNION ALL SELECT 'priorities', count(*), NULL, count(DISTINCT priority) FROM (SELECT o_orderpriority AS priority, min(o_orderdate) FROM orders GROUP BY 1)"""
)
def split_load(spark, d):
    """One scan of ``orders`` feeds three targets in one partitioned write; the lookup of priorities is reduced by key; a disabled mapping loads nothing."""
    from tableferry.session import fresh_path

    loaded = rs.load_mappings(_tables(spark, d, "orders"), [*FAN_OUT, PRIORITIES], fresh_path(spark, "split"))
    key = {"order_headers": "order_id", "open_orders": "order_id", "priorities": "priority"}
    return reduce(
        DataFrame.unionByName,
        [
            df.agg(
                F.lit(t).alias("target_table"),
                F.count(F.lit(1)).alias("row_count"),
                (F.sum(key[t]) if key[t] == "order_id" else F.lit(None).cast("decimal(38,0)")).cast("decimal(38,0)").alias("key_sum"),
                F.count_distinct(key[t]).alias("keys"),
            )
            for t, df in sorted(loaded.items())
        ],
    )
