import datetime as dt

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tableferry.functions.dialects import ColumnSpec, Rule, automatic_rules, coerce, split_by_rules, validate

S = T.StringType()
CHECKS = [
    ("mysql", "12", S, ColumnSpec("v", "INTEGER"), True),
    ("mysql", "1e3", S, ColumnSpec("v", "INTEGER"), True),
    ("mysql", "12.5", S, ColumnSpec("v", "BIGINT"), False),
    ("mysql", "", S, ColumnSpec("v", "INTEGER"), True),
    ("mysql", "12d", S, ColumnSpec("v", "DECIMAL"), False),
    ("mysql", None, S, ColumnSpec("v", "DECIMAL", nullable=False), False),
    ("mysql", None, S, ColumnSpec("v", "DECIMAL"), True),
    ("mysql", "x", S, ColumnSpec("v", "TEXT"), True),
    ("mysql", "1", S, ColumnSpec("v", "BOOLEAN"), False),
    ("mysql", "2023-01-05", S, ColumnSpec("v", "DATETIME"), True),
    ("mysql", "soon", S, ColumnSpec("v", "DATETIME"), False),
    ("mysql", "anything", S, ColumnSpec("v", "JSON"), True),
    ("firebird", "32768", S, ColumnSpec("v", "SMALLINT"), False),
    ("firebird", "-32768", S, ColumnSpec("v", "SMALLINT"), True),
    ("firebird", "2147483648", S, ColumnSpec("v", "INTEGER"), False),
    ("firebird", "2147483648", S, ColumnSpec("v", "BIGINT"), True),
    ("firebird", "abcdef", S, ColumnSpec("v", "VARCHAR", max_length=5), False),
    ("firebird", "T", S, ColumnSpec("v", "BOOLEAN"), True),
    ("firebird", "t", S, ColumnSpec("v", "BOOLEAN"), False),
    ("paradox", "T", S, ColumnSpec("v", "BOOLEAN"), False),
    ("paradox", "1.5", S, ColumnSpec("v", "REAL"), True),
    ("sqlite", "1.5", S, ColumnSpec("v", "INTEGER"), False),
    ("sqlite", "whatever", S, ColumnSpec("v", "DATE"), True),
    ("mysql", 1, T.IntegerType(), ColumnSpec("v", "BOOLEAN"), True),
    ("mysql", 2, T.IntegerType(), ColumnSpec("v", "BOOLEAN"), False),
    ("mysql", 2, T.IntegerType(), ColumnSpec("v", "VARCHAR"), False),
    ("paradox", True, T.BooleanType(), ColumnSpec("v", "BOOLEAN"), True),
]


@pytest.mark.parametrize("dialect,value,dtype,spec,want", CHECKS)
def test_validate(rows, dialect, value, dtype, spec, want):
    schema = T.StructType([T.StructField("v", dtype)])
    assert rows([(value,)], schema, validate(dialect, F.col("v"), dtype, spec)) == [(want,)]


COERCED = [
    ("mysql", "12.9abc", S, ColumnSpec("v", "INTEGER"), 12),
    ("mysql", "abc", S, ColumnSpec("v", "INTEGER"), None),
    ("mysql", " -1.5e2x", S, ColumnSpec("v", "DOUBLE"), -150.0),
    ("mysql", -3.7, T.DoubleType(), ColumnSpec("v", "INTEGER"), -3),
    ("mysql", 4.0, T.DoubleType(), ColumnSpec("v", "VARCHAR"), "4"),
    ("mysql", "F", S, ColumnSpec("v", "BOOLEAN"), True),
    ("mysql", "", S, ColumnSpec("v", "BOOLEAN"), False),
    ("firebird", "F", S, ColumnSpec("v", "BOOLEAN"), False),
    ("firebird", "abcdef", S, ColumnSpec("v", "CHAR", max_length=3), "abc"),
    ("paradox", "  x\t", S, ColumnSpec("v", "CHAR"), "x"),
    ("sqlite", "7up", S, ColumnSpec("v", "INTEGER"), 7),
    ("sqlite", "x", S, ColumnSpec("v", "BLOB"), "x"),
    ("firebird", "2023-01-05T01:02:03Z", S, ColumnSpec("v", "TIMESTAMP"), dt.datetime(2023, 1, 5, 1, 2, 3)),
    ("firebird", None, S, ColumnSpec("v", "TIMESTAMP"), None),
]


@pytest.mark.parametrize("dialect,value,dtype,spec,want", COERCED)
def test_coerce(rows, dialect, value, dtype, spec, want):
    schema = T.StructType([T.StructField("v", dtype)])
    assert rows([(value,)], schema, coerce(dialect, F.col("v"), dtype, spec)) == [(want,)]


def test_rules_split_loses_nothing(spark):
    df = spark.createDataFrame([(1, "a"), (2, None), (3, ""), (4, "toolong"), (5, "12")], "id int, v string")
    rules = [Rule("v", "required", message="missing"), Rule("v", "length", max=4, message="long"), Rule("id", "range", min=1, max=4)]
    good, bad = split_by_rules(df, rules)
    reasons = {r.id: r.reject_reason for r in bad.collect()}
    assert reasons == {2: "v: missing", 3: "v: missing", 4: "v: long", 5: "id: range"}
    assert {r.id for r in good.collect()} == {1}


def test_automatic_rules():
    assert automatic_rules("c", "A", "VARCHAR", 10)[0].max == 10
    assert automatic_rules("c", "TEXT", "VARCHAR(20)")[0].kind == "length"
    assert automatic_rules("c", "VARCHAR", "NUMERIC")[0].kind == "pattern"
    assert automatic_rules("c", "DATE", "DATE") == []
