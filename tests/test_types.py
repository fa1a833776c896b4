import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tableferry.functions import legacy_columns as lc
from tableferry.functions import type_rules as tr
from tableferry.functions.transforms import named_transform, transform_columns

MAPPED = [
    ("varchar(255)", "mysql", "postgresql", "VARCHAR(255)"),
    ("TEXT", "mysql", "sqlserver", "NVARCHAR(MAX)"),
    ("decimal(10,2)", "MySQL", "Oracle", "NUMBER(10,2)"),
    ("INT(11)", "mysql", "oracle", "NUMBER(10,0)(11)"),
    ("tinyint(1)", "mysql", "postgresql", "SMALLINT"),
    ("VARCHAR(20)", "mysql", "oracle", "VARCHAR2(20)"),
    ("double precision", "postgres", "mysql", "DOUBLE"),
    ("uuid", "postgresql", "sqlserver", "UNIQUEIDENTIFIER"),
    ("POINT", "mysql", "oracle", "NUMBER(10,0)"),
    ("NUMBER(5)", "oracle", "mysql", "INTEGER"),
    ("BFILE", "oracle", "mysql", "VARCHAR(255)"),
    ("BOOL", "sqlite", "sqlserver", "BIT"),
    ("NVARCHAR2(5)", "oracle", "sqlserver", "NVARCHAR(255)"),
    ("SMALLDATETIME", "sqlserver", "mysql", "DATETIME"),
]


@pytest.mark.parametrize("source,a,b,want", MAPPED)
def test_map_type(rows, source, a, b, want):
    assert rows([(source,)], "t string", tr.map_type(F.col("t"), a, b)) == [(want,)]


CODES = [
    ((8, 1, 4, 9, -2), "NUMERIC", "NUMERIC(9,2)", "NUMERIC(9,2)"),
    ((8, 0, 4, 0, 0), "INTEGER", "INTEGER", "INTEGER"),
    ((26, 0, 8, 18, 2), "NUMERIC(18,2)", "NUMERIC(18,2)", "INT128"),
    ((26, 0, 8, 18, -2), "BIGINT", "NUMERIC(18,2)", "INT128"),
    ((37, 0, 0, None, None), "VARCHAR", "VARCHAR(1)", "VARCHAR(1)"),
    ((15, 0, 12, None, None), "VARCHAR", "VARCHAR(12)", "CHAR(12)"),
    ((17, 0, 3, None, None), "CHAR", "CHAR(3)", "BOOLEAN"),
    ((261, 1, 8, None, None), "BLOB SUB_TYPE TEXT", "BLOB SUB_TYPE TEXT", "BLOB TEXT"),
    ((261, 9, 8, None, None), "BLOB", "BLOB SUB_TYPE 9", "BLOB(9)"),
    ((24, 0, 8, None, None), "DECFLOAT", "DECFLOAT(16)", "DECFLOAT(16)"),
    ((266, 0, 8, None, None), "TIME WITH TIME ZONE", "TIME WITH TIME ZONE", "EXTENDED"),
    ((999, 2, 0, None, None), "VARCHAR", "VARCHAR", "UNKNOWN_TYPE_999_SUB2"),
    ((7, 0, 2, None, -1), "SMALLINT", "SMALLINT", "NUMERIC(15,1)"),
    ((39, 0, 7, None, None), "VARCHAR", "VARCHAR(7)", "VARCHAR(7)"),
]


@pytest.mark.parametrize("code,name,text,second", CODES)
def test_firebird_codes(rows, code, name, text, second):
    c, s, n, p, k = (F.col(x) for x in "csnpk")
    got = rows(
        [code], "c int, s int, n int, p int, k int", tr.firebird_type(c, s, p, k), tr.firebird_type_text(c, s, n, p, k), tr.firebird_type_v2(c, s, n, k, p)
    )
    assert got == [(name, text, second)]


def test_reader_names(rows):
    t = F.col("t")
    assert rows([("int(11)",), ("geometry",)], "t string", tr.mysql_type_name(t)) == [("INTEGER",), ("GEOMETRY",)]
    assert rows([("TEXT",), ("double",), ("x(3)",)], "t string", tr.firebird_type_name(t)) == [("BLOB SUB_TYPE TEXT",), ("DOUBLE PRECISION",), ("X(3)",)]
    assert rows([("a",), ("#",), ("?",)], "t string", tr.paradox_type_name(t)) == [("VARCHAR",), ("INTEGER",), ("VARCHAR",)]
    got = rows([("DATETIME",), ("FLOATY",), ("BOOL",), ("POINT",)], "t string", tr.sqlite_schema_type(t), tr.sqlite_mapped_type(t))
    assert got == [("DATETIME", "DATE"), ("REAL", "REAL"), ("BOOL", "BOOLEAN"), ("INTEGER", "INTEGER")]


def test_paradox_to_firebird(rows):
    t, n, p = F.col("t"), F.col("n"), F.col("p")
    data = [("ALPHA", 40000, 0), ("alpha", None, None), ("NUMBER", 0, 3), ("NUMBER", 0, 0), ("BYTES", 9, 0), ("MEMO", 1, 1), ("?", 1, 1)]
    want = ["VARCHAR(32765)", "VARCHAR(255)", "NUMERIC(18,3)", "NUMERIC(18,4)", "CHAR(9)", "BLOB SUB_TYPE 1", "VARCHAR(255)"]
    assert [r[0] for r in rows(data, "t string, n int, p int", tr.paradox_to_firebird(t, n, p))] == want


def test_adapt_and_defaults(rows):
    data = [("VARCHAR(8192)", "ALPHA"), ("VARCHAR(8191)", "ALPHA"), ("VARCHAR(9000)", "MEMO")]
    got = rows(data, "t string, o string", tr.adapt_long_varchar(F.col("t"), F.col("o")))
    assert [r[0] for r in got] == ["BLOB SUB_TYPE 1", "VARCHAR(8191)", "VARCHAR(9000)"]
    assert rows([(" DEFAULT 'x' ",)], "d string", tr.clean_default(F.col("d"))) == [("'x'",)]


def test_spark_types():
    assert tr.spark_type("NUMERIC(15,2)") == "decimal(15,2)"
    assert tr.spark_type("varchar(9)") == "string"
    assert tr.spark_type("BLOB SUB_TYPE TEXT") == "string"
    assert tr.spark_type("BLOB SUB_TYPE 0") == "binary"
    assert tr.spark_type("Double Precision") == "double"


def test_legacy_columns(rows):
    c, s = F.col("v"), T.StringType()
    assert rows([("T",), ("F",), ("?",), (None,)], "v string", lc.logical(c), lc.logical(c, True)) == [
        (True, True), (False, False), (None, False), (None, False),
    ]
    assert rows([("99999999999999.99",), ("x",), ("1.005",)], "v string", lc.legacy_column(c, s, "C", "NUMERIC").cast("string")) == [(None,), (None,), ("1.01",)]
    assert lc.legacy_kind("#") == "AUTOINCREMENT" and lc.legacy_kind("VARCHAR") is None
    assert rows([("  a ",), ("",)], "v string", lc.legacy_options(c, {"empty_to_null": True})) == [("a",), (None,)]
    assert rows([("1",), ("0",), ("2",)], "v string", lc.legacy_options(c, {"boolean": "1/0"})) == [(True,), (False,), (None,)]
    assert rows([("x",)], "v string", lc.generic_column(c, s, "VARCHAR", "TEXT")[1]) == [("x",)]


def test_transforms_before_rename_and_unknown_names(spark):
    df = spark.createDataFrame([(" Ab ", 5, None)], "a string, n int, z string")
    out = transform_columns(df, [("a", "trim"), ("n", "toUpperCase"), ("a", "toUpperCase"), ("z", "nullToEmpty"), ("a", "unknown"), ("gone", "trim")])
    assert [tuple(r) for r in out.collect()] == [("AB", 5, "")]
    assert out.schema["n"].dataType == T.IntegerType()
    assert transform_columns(df, [("gone", "trim")]) is df
    c = F.col("a")
    assert named_transform("nothing", c, T.StringType()) is c
