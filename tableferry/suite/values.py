"""Transforms, conversions, validation and coercion of values."""

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tableferry.functions import convert as cv
from tableferry.functions.dialects import ColumnSpec, coerce_table, validate_table
from tableferry.functions.text import number_to_text as shortest
from tableferry.functions.transforms import transform_columns
from tableferry.functions.convert import Conversion
from tableferry.sources import legacy
from tableferry.suite import sqltext as q
from tableferry.suite.registry import query

ORDERS, CUSTOMERS = q.with_(q.LEGACY_ORDERS), q.with_(q.LEGACY_CUSTOMER)


# -- named transforms -------------------------------------------------------


@query("SELECT c_custkey, upper(c_name) AS c_name, lower(c_mktsegment) AS c_mktsegment, c_acctbal FROM customer")
def transform_case(spark, d):
    df = legacy.table(spark, d, "customer").drop("c_nationkey")
    steps = [("c_name", "toUpperCase"), ("c_mktsegment", "toLowerCase"), ("c_acctbal", "toUpperCase"), ("absent", "toUpperCase")]
    return transform_columns(df, steps).select("c_custkey", "c_name", "c_mktsegment", "c_acctbal")


@query(ORDERS + f"SELECT order_no, {q.trimmed('priority_pad')} AS priority_pad, {q.trimmed('total_txt')} AS total_txt FROM legacy_orders")
def transform_trim(spark, d):
    df = legacy.legacy_orders(spark, d).select("order_no", "priority_pad", "total_txt")
    return transform_columns(df, [("priority_pad", "trim"), ("total_txt", "trim")])


@query("SELECT event_id, strftime(date_trunc('millisecond', ts), '%Y-%m-%dT%H:%M:%S.%g') || 'Z' AS ts FROM events")
def transform_date_iso(spark, d):
    return transform_columns(legacy.table(spark, d, "events").select("event_id", "ts"), [("ts", "dateToISO")])


@query(ORDERS + "SELECT order_no, coalesce(note, '') AS note FROM legacy_orders")
def transform_null_empty(spark, d):
    return transform_columns(legacy.legacy_orders(spark, d).select("order_no", "note"), [("note", "nullToEmpty")])


@query(
    CUSTOMERS
    + "SELECT cust_no, trim(name_alpha) AS name_alpha, lower(segment) AS segment, CAST(nation_no AS VARCHAR) AS nation_no FROM legacy_customer"
)
def transform_rules(spark, d):
    df = legacy.legacy_customer(spark, d).select("cust_no", "name_alpha", "segment", "nation_no")
    return transform_columns(df, [("name_alpha", "strip"), ("segment", "lowercase"), ("nation_no", "uppercase")])


@query("SELECT l_orderkey, l_linenumber, strftime(l_shipdate, '%d/%m/%Y') AS l_shipdate FROM lineitem")
def transform_date_format(spark, d):
    df = legacy.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_shipdate")
    return transform_columns(df, [("l_shipdate", "date_format", {"format": "dd/MM/yyyy"})])


@query(ORDERS + f"SELECT order_no, lower({q.trimmed('priority_pad')}) AS priority_pad, upper(coalesce(note, '')) AS note FROM legacy_orders")
def transform_chain(spark, d):
    df = legacy.legacy_orders(spark, d).select("order_no", "priority_pad", "note")
    steps = [("priority_pad", "trim"), ("note", "nullToEmpty"), ("priority_pad", "toLowerCase"), ("note", "toUpperCase"), ("note", "nope")]
    return transform_columns(df, steps)


@query(
    """SELECT o_orderkey, CAST(list_sum(CAST(string_split(CAST(o_custkey AS VARCHAR), '') AS INTEGER[])) % 10 AS BIGINT) AS check_digit,
       concat(o_orderstatus, '!') AS o_orderstatus FROM orders"""
)
def udf_custom(spark, d):
    """A caller's own functions: one as a Column, one vectorised over Arrow."""

    def digit_sum(keys: pd.Series) -> pd.Series:
        left, total = keys.abs(), keys * 0
        while (left > 0).any():
            total, left = total + left % 10, left // 10
        return total % 10

    check = F.pandas_udf(digit_sum, "bigint")
    df = legacy.table(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("check_digit"), "o_orderstatus")
    steps = [
        ("check_digit", "custom", {"function": check}),
        ("o_orderstatus", "custom", {"function": lambda c: F.concat(c, F.lit("!"))}),
    ]
    return transform_columns(df, steps)


# -- conversions ------------------------------------------------------------

# Type names a legacy catalog may hold, dealt out over the part table.
TYPE_PAIRS = [
    ("varchar", "DATE"), ("CHAR(10)", "integer"), ("NUMERIC(18,2)", "TEXT"), ("timestamp", "VARCHAR(30)"), ("INTEGER", "BIGINT"),
    ("TEXT", "CSTRING(8)"), ("DECIMAL(10,2)", "VARCHAR"), ("FB_TYPE_37", "TIME"), ("DOUBLE PRECISION", "FLOAT"), ("DATE", "TIMESTAMP"),
    ("VARCHAR(20)", "varchar(255)"), ("BLOB", "TEXT"), ("", "REAL"), ("NUMERIC(18, 2)", "CHAR"),
]


def typed_parts(spark, d, names):
    """Part keys with a type text dealt out by key; reads the whole table."""
    picks = F.array(*[F.lit(n) for n in names])
    return legacy.table(spark, d, "part").select(
        "p_partkey", "p_size", F.try_element_at(picks, (F.col("p_partkey") % len(names) + 1).cast("int")).alias("t")
    )


def sql_list(names):
    return "[" + ", ".join("'" + n.replace("'", "''") + "'" for n in names) + "]"


_NORM = r"""CASE WHEN {t} = '' THEN 'VARCHAR' ELSE trim(regexp_replace(regexp_replace(regexp_replace(upper({t}), '\(\d+\)', '', 'g'),
            '\(\d+,\d+\)', '', 'g'), 'FB_TYPE_\d+', 'VARCHAR', 'g')) END"""


@query(
    f"SELECT p_partkey, t AS source_type, {_NORM.format(t='t')} AS normal_type FROM (SELECT p_partkey, "
    f"{sql_list([a for a, _ in TYPE_PAIRS])}[CAST(p_partkey % {len(TYPE_PAIRS)} AS INTEGER) + 1] AS t FROM part)"
)
def normalize_type(spark, d):
    df = typed_parts(spark, d, [a for a, _ in TYPE_PAIRS])
    return df.select("p_partkey", F.col("t").alias("source_type"), cv.normalize_type(F.col("t")).alias("normal_type"))


_TEXTS, _NUMS = "('VARCHAR','TEXT','CHAR','STRING','CSTRING')", "('INTEGER','BIGINT','SMALLINT','NUMERIC','REAL','DOUBLE','FLOAT')"
_DATES = "('DATE','TIMESTAMP','DATETIME','TIME')"


@query(
    f"""SELECT p_partkey, CASE WHEN s = t THEN 'DIRECT' WHEN s IN {_TEXTS} AND t IN {_DATES} THEN 'TEXT_TO_DATE'
        WHEN s IN {_TEXTS} AND t IN {_NUMS} THEN 'TEXT_TO_NUMBER' WHEN s IN {_NUMS} AND t IN {_TEXTS} THEN 'NUMBER_TO_TEXT'
        WHEN s IN {_DATES} AND t IN {_TEXTS} THEN 'DATE_TO_TEXT' WHEN s IN {_NUMS} AND t IN {_NUMS} THEN 'NUMBER_TO_NUMBER'
        WHEN s IN {_TEXTS} AND t IN {_TEXTS} THEN 'TEXT_TO_TEXT' ELSE 'CUSTOM_CONVERSION' END AS conversion_type
        FROM (SELECT p_partkey, {_NORM.format(t='a')} AS s, {_NORM.format(t='b')} AS t FROM (SELECT p_partkey,
        {sql_list([a for a, _ in TYPE_PAIRS])}[CAST(p_partkey % {len(TYPE_PAIRS)} AS INTEGER) + 1] AS a,
        {sql_list([b for _, b in TYPE_PAIRS])}[p_size % {len(TYPE_PAIRS)} + 1] AS b FROM part))"""
)
def classify_conversion(spark, d):
    df = typed_parts(spark, d, [a for a, _ in TYPE_PAIRS])
    targets = F.array(*[F.lit(b) for _, b in TYPE_PAIRS])
    target = F.try_element_at(targets, F.col("p_size") % len(TYPE_PAIRS) + 1)
    return df.select("p_partkey", cv.classify_conversion(F.col("t"), target).alias("conversion_type"))


@query(ORDERS + f"SELECT order_no, order_date_txt, {q.to_date('order_date_txt')} AS order_date FROM legacy_orders")
def text_to_date(spark, d):
    df = legacy.legacy_orders(spark, d)
    return df.select("order_no", "order_date_txt", cv.text_to_date(F.col("order_date_txt")).alias("order_date"))


@query(
    f"""SELECT event_id, strftime(date_trunc('second', ts), '%Y-%m-%dT%H:%M:%S') || '.000Z' AS iso, CAST(date_trunc('second', ts) AS TIMESTAMP) AS stamp FROM events"""
)
def text_to_timestamp(spark, d):
    """Date-time text in two ISO spellings, to a timestamp and to ISO text."""
    text = F.when(F.col("event_id") % 2 == 0, F.date_format("ts", "yyyy-MM-dd HH:mm:ss")).otherwise(
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    )
    df = legacy.table(spark, d, "events").select("event_id", text.alias("txt"))
    return df.select(
        "event_id",
        cv.convert(F.col("txt"), T.StringType(), "VARCHAR", "TIMESTAMP")["value"].alias("iso"),
        cv.text_to_timestamp(F.col("txt")).alias("stamp"),
    )


@query(
    ORDERS
    + f"SELECT order_no, CASE WHEN {q.to_date('order_date_txt')} IS NULL THEN order_date_txt ELSE '00:00:00' END AS value, {q.to_date('order_date_txt')} IS NOT NULL AS success FROM legacy_orders"
)
def text_to_time(spark, d):
    verdict = cv.convert(F.col("order_date_txt"), T.StringType(), "VARCHAR", "TIME")
    return legacy.legacy_orders(spark, d).select("order_no", verdict["value"].alias("value"), verdict["success"].alias("success"))


@query(ORDERS + f"SELECT order_no, total_txt, {q.to_number('total_txt')} AS total FROM legacy_orders")
def text_to_number(spark, d):
    return legacy.legacy_orders(spark, d).select("order_no", "total_txt", cv.text_to_number(F.col("total_txt")).alias("total"))


@query(ORDERS + f"SELECT order_no, {q.half_up('(' + q.to_number('total_txt') + ')')} AS total FROM legacy_orders")
def text_to_integer(spark, d):
    return legacy.legacy_orders(spark, d).select("order_no", cv.text_to_integer(F.col("total_txt")).alias("total"))


@query(
    CUSTOMERS
    + """SELECT cust_no, CASE WHEN credit_score = floor(credit_score) THEN CAST(CAST(credit_score AS BIGINT) AS VARCHAR)
         ELSE CAST(credit_score AS VARCHAR) END AS score_txt, CAST(small_code AS VARCHAR) AS code_txt FROM legacy_customer"""
)
def number_to_text(spark, d):
    df = legacy.legacy_customer(spark, d)
    return df.select(
        "cust_no",
        shortest(F.col("credit_score"), T.DoubleType()).alias("score_txt"),
        shortest(F.col("small_code"), T.IntegerType()).alias("code_txt"),
    )


@query("SELECT l_orderkey, l_linenumber, strftime(l_shipdate, '%Y-%m-%d') AS ship_txt FROM lineitem")
def date_to_text(spark, d):
    df = legacy.table(spark, d, "lineitem")
    return df.select("l_orderkey", "l_linenumber", cv.date_to_text(F.col("l_shipdate"), T.TimestampNTZType()).alias("ship_txt"))


@query(CUSTOMERS + f"SELECT cust_no, {q.half_up('credit_score')} AS as_integer, credit_score AS as_real FROM legacy_customer")
def number_to_number(spark, d):
    df = legacy.legacy_customer(spark, d)
    return df.select(
        "cust_no",
        cv.number_to_number(F.col("credit_score"), "INTEGER").alias("as_integer"),
        cv.number_to_number(F.col("credit_score"), "NUMERIC(15,2)").alias("as_real"),
    )


@query(CUSTOMERS + "SELECT cust_no, CAST(nation_no AS VARCHAR) AS nation_txt, 'CUSTOM_CONVERSION' AS kind, name_alpha FROM legacy_customer")
def custom_conversion(spark, d):
    df = legacy.legacy_customer(spark, d)
    a = cv.convert(F.col("nation_no"), T.IntegerType(), "DECIMAL(10,0)", "VARCHAR")
    b = cv.convert(F.col("name_alpha"), T.StringType(), "CHAR(30)", "TEXT")
    return df.select("cust_no", a["value"].alias("nation_txt"), a["conversion_type"].alias("kind"), b["value"].alias("name_alpha"))


MAPPED = [
    Conversion("order_no", "order_id", "VARCHAR(10)", "INTEGER"),
    Conversion("order_date_txt", "order_date", "VARCHAR(10)", "DATE"),
    Conversion("total_txt", "total", "TEXT", "NUMERIC"),
    Conversion("status", "status", "CHAR(1)", "VARCHAR"),
    Conversion("paid_flag", "paid_flag", "CHAR(1)", "CHAR(1)", convert=False),
    Conversion("not_there", "extra", "VARCHAR", "DATE"),
]


def _shown(x):
    return f"CASE WHEN {x} = floor({x}) THEN CAST(CAST({x} AS BIGINT) AS VARCHAR) ELSE CAST({x} AS VARCHAR) END"


_D, _N = q.to_date("order_date_txt"), f"({q.to_number('total_txt')})"


@query(
    ORDERS
    + f"""SELECT CAST(CAST(order_no AS BIGINT) AS VARCHAR) AS order_id, coalesce(strftime({_D}, '%Y-%m-%d'), order_date_txt) AS order_date,
          coalesce({_shown(_N)}, total_txt) AS total, status, paid_flag, CAST(NULL AS VARCHAR) AS extra FROM legacy_orders"""
)
def convert_table(spark, d):
    return cv.convert_table(legacy.legacy_orders(spark, d), MAPPED)


@query(
    ORDERS
    + f"""SELECT order_no, 'order_date_txt' AS source_column, 'order_date' AS target_column, 'VARCHAR(10)' AS source_type, 'DATE' AS target_type,
          order_date_txt AS original_value, 'TEXT_TO_DATE' AS conversion_type, concat('cannot convert ''', order_date_txt, ''' to a date') AS error
          FROM legacy_orders WHERE {_D} IS NULL
          UNION ALL SELECT order_no, 'total_txt', 'total', 'TEXT', 'NUMERIC', total_txt, 'TEXT_TO_NUMBER',
          CASE WHEN total_txt = '' THEN 'empty text is not a number' ELSE concat('cannot convert ''', total_txt, ''' to a number') END
          FROM legacy_orders WHERE {_N} IS NULL"""
)
def conversion_report(spark, d):
    return cv.conversion_report(legacy.legacy_orders(spark, d), MAPPED, "order_no")


@query(
    ORDERS
    + f"""SELECT 'order_no' AS source_column, 'VARCHAR(10)' AS source_type, 'INTEGER' AS target_type, 'TEXT_TO_NUMBER' AS conversion_type, count(*) AS checked, 0 AS failed FROM legacy_orders
          UNION ALL SELECT 'order_date_txt', 'VARCHAR(10)', 'DATE', 'TEXT_TO_DATE', count(*), count(*) FILTER (WHERE {_D} IS NULL) FROM legacy_orders
          UNION ALL SELECT 'total_txt', 'TEXT', 'NUMERIC', 'TEXT_TO_NUMBER', count(*), count(*) FILTER (WHERE {_N} IS NULL) FROM legacy_orders
          UNION ALL SELECT 'status', 'CHAR(1)', 'VARCHAR', 'TEXT_TO_TEXT', count(*), 0 FROM legacy_orders"""
)
def conversion_summary(spark, d):
    return cv.conversion_summary(legacy.legacy_orders(spark, d), [m for m in MAPPED if m.source != "not_there"])


@query(
    """SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS flag, o_orderstatus = 'F' AS same_flag,
       CASE WHEN o_orderkey % 6 = 5 THEN NULL ELSE o_orderdate END AS stamp FROM orders"""
)
def value_rules(spark, d):
    flag = F.col("o_orderstatus") == "F"
    text = F.when(F.col("o_orderkey") % 6 == 5, "n/a").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd"))
    df = legacy.table(spark, d, "orders").select("o_orderkey", flag.alias("f"), text.alias("t"))
    return df.select(
        "o_orderkey",
        cv.apply_value_rule(F.col("f"), T.BooleanType(), "BOOLEAN", "NUMBER(1,0)", "mysql", "oracle").alias("flag"),
        cv.apply_value_rule(F.col("f"), T.BooleanType(), "BOOLEAN", "BOOLEAN", "postgresql", "mysql").alias("same_flag"),
        cv.apply_value_rule(F.col("t"), T.StringType(), "TIMESTAMP", "TIMESTAMP", "mysql", "oracle").alias("stamp"),
    )


# -- validation and coercion ------------------------------------------------

_N_DATE = r"regexp_full_match(order_date_txt, '\d{4}-\d{2}-\d{2}') AND try_strptime(order_date_txt, '%Y-%m-%d') IS NOT NULL"
_N_TOTAL = f"({q.js_number('total_txt')})"
_INT_PREFIX = r"TRY_CAST(regexp_extract({x}, '^\s*([+-]?\d+)', 1) AS BIGINT)"
_NUM_PREFIX = r"TRY_CAST(regexp_extract({x}, '^\s*([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)', 1) AS DOUBLE)"


def order_specs(text_length=None):
    return [
        ColumnSpec("cust_no", "INTEGER", False),
        ColumnSpec("total_txt", "DECIMAL", False),
        ColumnSpec("order_date_txt", "DATE"),
        ColumnSpec("note", "VARCHAR", True, text_length),
        ColumnSpec("paid_flag", "BOOLEAN"),
        ColumnSpec("status", "ENUM"),
    ]


def _validated(text_ok, flag_ok):
    return (
        ORDERS
        + f"""SELECT order_no, true AS cust_no_ok, {_N_TOTAL} IS NOT NULL AS total_txt_ok, {_N_DATE} AS order_date_txt_ok,
              {text_ok} AS note_ok, {flag_ok} AS paid_flag_ok, true AS status_ok FROM legacy_orders"""
    )


@query(_validated("true", "false"))
def validate_mysql(spark, d):
    return validate_table(legacy.legacy_orders(spark, d), "mysql", order_specs(), ["order_no"])


@query(_validated("coalesce(length(note) <= 5, true)", "paid_flag IN ('T', 'F')"))
def validate_firebird(spark, d):
    return validate_table(legacy.legacy_orders(spark, d), "firebird", order_specs(5), ["order_no"])


@query(_validated("true", "false"))
def validate_paradox(spark, d):
    return validate_table(legacy.legacy_orders(spark, d), "paradox", order_specs(), ["order_no"])


@query(
    CUSTOMERS
    + f"""SELECT cust_no, credit_score = floor(credit_score) AS credit_score_ok, true AS balance_txt_ok, segment IS NOT NULL AS segment_ok,
          true AS name_alpha_ok, small_code BETWEEN -32768 AND 32767 AS small_code_ok FROM legacy_customer"""
)
def validate_ranges(spark, d):
    """Typed columns: halves are no integers and Firebird's SMALLINT has a range."""
    specs = [
        ColumnSpec("credit_score", "INTEGER"),
        ColumnSpec("balance_txt", "NUMERIC"),
        ColumnSpec("segment", "VARCHAR", False),
        ColumnSpec("name_alpha", "VARCHAR", True, 30),
        ColumnSpec("small_code", "SMALLINT"),
    ]
    return validate_table(legacy.legacy_customer(spark, d), "firebird", specs, ["cust_no"])


SQLITE_SPECS = [ColumnSpec("order_no", "INTEGER", False), ColumnSpec("total_txt", "REAL"), ColumnSpec("note", "TEXT", False), ColumnSpec("paid_flag", "BOOLEAN")]


@query(
    ORDERS
    + f"""SELECT cust_no, true AS order_no_ok, {_N_TOTAL} IS NOT NULL AS total_txt_ok, note IS NOT NULL AS note_ok, true AS paid_flag_ok FROM legacy_orders"""
)
def validate_sqlite(spark, d):
    return validate_table(legacy.legacy_orders(spark, d), "sqlite", SQLITE_SPECS, ["cust_no"])


def _coerced(note, flag):
    return (
        ORDERS
        + f"""SELECT order_no, {_INT_PREFIX.format(x='cust_no')} AS cust_no, {_NUM_PREFIX.format(x='total_txt')} AS total_txt,
              CASE WHEN regexp_full_match(order_date_txt, '\\d{{4}}-\\d{{2}}-\\d{{2}}') THEN try_strptime(order_date_txt, '%Y-%m-%d') END AS order_date_txt,
              {note} AS note, {flag} AS paid_flag, status FROM legacy_orders"""
    )


@query(_coerced("note", "paid_flag <> ''"))
def coerce_mysql(spark, d):
    return coerce_table(legacy.legacy_orders(spark, d), "mysql", order_specs(), ["order_no"])


@query(_coerced("substring(note, 1, 5)", "CASE paid_flag WHEN 'T' THEN true WHEN 'F' THEN false ELSE paid_flag <> '' END"))
def coerce_firebird(spark, d):
    return coerce_table(legacy.legacy_orders(spark, d), "firebird", order_specs(5), ["order_no"])


@query(
    CUSTOMERS
    + """SELECT cust_no, trim(name_alpha) AS name_alpha, CAST(trunc(credit_score) AS BIGINT) AS credit_score, CAST(nation_no AS VARCHAR) AS nation_no,
         nation_no <> 0 AS small_code FROM (SELECT * REPLACE (small_code AS small_code) FROM legacy_customer)"""
)
def coerce_paradox(spark, d):
    specs = [
        ColumnSpec("name_alpha", "VARCHAR"),
        ColumnSpec("credit_score", "INTEGER"),
        ColumnSpec("nation_no", "CHAR"),
        ColumnSpec("small_code", "BOOLEAN"),
    ]
    df = legacy.legacy_customer(spark, d).withColumn("small_code", F.col("nation_no"))
    return coerce_table(df, "paradox", specs, ["cust_no"])


@query(
    ORDERS
    + f"SELECT cust_no, {_INT_PREFIX.format(x='order_no')} AS order_no, {_NUM_PREFIX.format(x='total_txt')} AS total_txt, note, paid_flag FROM legacy_orders"
)
def coerce_sqlite(spark, d):
    return coerce_table(legacy.legacy_orders(spark, d), "sqlite", SQLITE_SPECS, ["cust_no"])
