import datetime as dt

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tableferry.functions import convert as cv
from tableferry.functions.text import number_to_text, parse_iso, round_half_up, strip_space


def one(rows, values, fn, schema="v string"):
    return [r[0] for r in rows([(v,) for v in values], schema, fn(F.col("v")))]


DATES = {
    "2023-01-05": dt.date(2023, 1, 5),
    "05/01/2023": dt.date(2023, 1, 5),
    "05-01-2023": dt.date(2023, 1, 5),
    "20230105": dt.date(2023, 1, 5),
    "25122023": dt.date(2023, 12, 25),
    "01022023": dt.date(2023, 2, 1),
    "10101010": dt.date(1010, 10, 10),
    " 2023-01-05\n": dt.date(2023, 1, 5),
    "31/02/2023": None,
    "2023-02-31": None,
    "00120101": None,
    "05/01-2023": None,
    "2023-1-5": None,
    "n/a": None,
    "": None,
    None: None,
    "2023-01-05T10:20:30Z": dt.date(2023, 1, 5),
    "2023-01-05T23:30:00-02:00": dt.date(2023, 1, 6),
}


def test_text_to_date(rows):
    assert one(rows, DATES, cv.text_to_date) == list(DATES.values())


def test_parse_iso_offsets(rows):
    got = one(rows, ["2023-01-05 10:20", "2023-01-05T10:20:30.25+0530", "2023-01-05T10:20:30Z", "2023-01-05", "10:20", None], parse_iso)
    assert got == [
        dt.datetime(2023, 1, 5, 10, 20),
        dt.datetime(2023, 1, 5, 4, 50, 30, 250000),
        dt.datetime(2023, 1, 5, 10, 20, 30),
        dt.datetime(2023, 1, 5),
        None,
        None,
    ]


NUMBERS = {
    "1,234.50": 1234.5, "1234,56": 1234.56, "3,141": 3141.0, "1.234,56": None, "1,234,567": 1234567.0, "  12 345 ": 12345.0,
    "-7": -7.0, "+.5": 0.5, "1e3": 1000.0, "12d": None, "0x10": None, "Infinity": None, "NaN": None, "abc": None, "": None,
    "  ": 0.0, None: None, "1,2,3": None, "12.": 12.0,
}


def test_text_to_number(rows):
    assert one(rows, NUMBERS, cv.text_to_number) == list(NUMBERS.values())


@pytest.mark.parametrize("value,want", [(2.5, 3), (-2.5, -2), (0.49999999999999994, 0), (-0.5, 0), (7.0, 7), (-3.6, -4)])
def test_round_half_up(rows, value, want):
    assert rows([(value,)], "v double", round_half_up(F.col("v"))) == [(want,)]


def test_number_to_text(rows):
    values = [1.0, -2.5, 123456789.0, 12345678.25, 1e21, 1.5e-7, 0.000001, 0.1, 1e300]
    want = ["1", "-2.5", "123456789", "12345678.25", "1e+21", "1.5e-7", "0.000001", "0.1", "1e+300"]
    assert one(rows, values, lambda c: number_to_text(c, T.DoubleType()), "v double") == want
    assert one(rows, [7], lambda c: number_to_text(c, T.IntegerType()), "v int") == ["7"]


def test_strip_space_takes_every_kind(rows):
    assert one(rows, ["\t a b \n", " x　", "﻿y "], strip_space) == ["a b", "x", "y"]


CASES = [
    ("5", "VARCHAR(10)", "varchar(20)", "5", True, "DIRECT"),
    ("05/01/2023", "VARCHAR", "DATE", "2023-01-05", True, "TEXT_TO_DATE"),
    ("05/01/2023", "TEXT", "TIMESTAMP", "2023-01-05T00:00:00.000Z", True, "TEXT_TO_DATE"),
    ("05/01/2023", "TEXT", "DATETIME", "2023-01-05T00:00:00.000Z", True, "TEXT_TO_DATE"),
    ("05/01/2023", "CHAR", "TIME", "00:00:00", True, "TEXT_TO_DATE"),
    ("31/02/2023", "CHAR", "DATE", "31/02/2023", False, "TEXT_TO_DATE"),
    ("2.5", "VARCHAR", "INTEGER", "3", True, "TEXT_TO_NUMBER"),
    ("-2.5", "VARCHAR", "SMALLINT", "-2", True, "TEXT_TO_NUMBER"),
    ("1.234,56", "VARCHAR", "REAL", "1.234,56", False, "TEXT_TO_NUMBER"),
    ("", "VARCHAR", "REAL", "", False, "TEXT_TO_NUMBER"),
    ("x", "VARCHAR", "TEXT", "x", True, "TEXT_TO_TEXT"),
    ("x", "BLOB", "TEXT", "x", True, "CUSTOM_CONVERSION"),
    ("7", "FB_TYPE_37", "BIGINT", "7", True, "TEXT_TO_NUMBER"),
    (None, "VARCHAR", "DATE", None, True, "TEXT_TO_DATE"),
    ("12", "NUMERIC", "INTEGER", "12", True, "NUMBER_TO_NUMBER"),
    ("zz", "NUMERIC", "INTEGER", "zz", False, "NUMBER_TO_NUMBER"),
    ("5", "DECIMAL(10,2)", "VARCHAR", "5", True, "CUSTOM_CONVERSION"),
]


@pytest.mark.parametrize("value,source,target,want,ok,kind", CASES)
def test_convert(rows, value, source, target, want, ok, kind):
    verdict = cv.convert(F.col("v"), T.StringType(), source, target)
    (got,) = rows([(value,)], "v string", verdict["value"], verdict["success"], verdict["conversion_type"], verdict["error"].isNotNull())
    assert got == (want, ok, kind, not ok)
    assert rows([(source, target)], "s string, t string", cv.classify_conversion(F.col("s"), F.col("t"))) == [(kind,)]


def test_report_keeps_every_failure_and_good_plus_bad_is_all(spark):
    df = spark.createDataFrame([(1, "x", "1"), (2, "2023-01-01", "y"), (3, "z", "w"), (4, None, None)], "id int, d string, n string")
    conversions = [cv.Conversion("d", "day", "VARCHAR", "DATE"), cv.Conversion("n", "num", "VARCHAR", "REAL")]
    report = cv.conversion_report(df, conversions, "id").collect()
    assert sorted((r.id, r.source_column) for r in report) == [(1, "d"), (2, "n"), (3, "d"), (3, "n")]
    summary = {r.source_column: (r.checked, r.failed) for r in cv.conversion_summary(df, conversions).collect()}
    assert summary == {"d": (4, 2), "n": (4, 2)}
    kept = [tuple(r) for r in cv.convert_table(df, conversions).orderBy("day").collect()]
    assert (None, None) in kept and ("x", "1") in kept and ("2023-01-01", "y") in kept


def test_round_trip_of_dates(spark):
    days = spark.range(0, 40000, 37).select(F.date_add(F.lit(dt.date(1900, 1, 1)), F.col("id").cast("int")).alias("day"))
    for layout in ("yyyy-MM-dd", "dd/MM/yyyy", "dd-MM-yyyy", "yyyyMMdd"):
        back = days.select("day", cv.text_to_date(F.date_format("day", layout)).alias("back"))
        assert back.where("NOT day <=> back").count() == 0


def test_value_rules_pass_other_values_through(rows):
    flag = cv.apply_value_rule(F.col("v"), T.BooleanType(), "boolean", "number(1,0)", "mysql", "oracle")
    assert rows([(True,), (None,)], "v boolean", flag) == [(1,), (None,)]
    same = cv.apply_value_rule(F.col("v"), T.StringType(), "BOOLEAN", "NUMBER(1,0)", "mysql", "oracle")
    assert rows([("yes",)], "v string", same) == [("yes",)]
