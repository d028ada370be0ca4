"""Rendering and parsing of single values."""

import datetime as dt
from decimal import Decimal

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bough.functions.parse import parse_text
from bough.functions.render import csv_field, json_members, json_value, text, xml_clean, xml_element


def one(spark, value, dtype, make):
    kind = T.DataType.fromDDL(dtype)
    df = spark.createDataFrame([(value,)], T.StructType([T.StructField("v", kind)]))
    return df.select(make(F.col("v"), kind)).first()[0]


@pytest.mark.parametrize(
    "value, dtype, expected",
    [
        (None, "int", None),
        ("as is", "string", "as is"),
        (True, "boolean", "true"),
        (False, "boolean", "false"),
        (-42, "int", "-42"),
        (2**62, "bigint", str(2**62)),
        (Decimal("512.25"), "decimal(18,2)", "512.25"),
        (Decimal("42.00"), "decimal(18,2)", "42.00"),
        (Decimal("0"), "decimal(20,9)", "0.000000000"),
        (Decimal("-0.000000012"), "decimal(20,9)", "-0.000000012"),
        (bytearray([1, 2, 3]), "binary", "AQID"),
        (dt.datetime(2026, 6, 10), "timestamp_ntz", "2026-06-10T00:00:00.0000000"),
        (dt.datetime(2026, 6, 10, 1, 2, 3, 45), "timestamp_ntz", "2026-06-10T01:02:03.0000450"),
        (dt.date(2026, 6, 10), "date", "2026-06-10T00:00:00.0000000"),
    ],
)
def test_text(spark, value, dtype, expected):
    assert one(spark, value, dtype, text) == expected


@pytest.mark.parametrize(
    "value, expected",
    [
        (42.0, "42"),
        (-0.5, "-0.5"),
        (0.0, "0"),
        (512.25, "512.25"),
        (12345678.0, "12345678"),
        (123456789.125, "123456789.125"),
        (1e14, "100000000000000"),
        (1e15, "1E+15"),
        (1234567890123456.0, "1234567890123456"),
        (1.5e300, "1.5E+300"),
        (-1e16, "-1E+16"),
        (0.00012, "0.00012"),
        (0.0001, "0.0001"),
        (0.00001, "1E-05"),
        (1.25e-7, "1.25E-07"),
        (float("nan"), "NaN"),
        (float("-inf"), "-Infinity"),
        (None, None),
    ],
)
def test_floating(spark, value, expected):
    assert one(spark, value, "double", text) == expected


def test_decimal_outside_ansi(spark):
    spark.conf.set("spark.sql.ansi.enabled", "false")
    try:
        assert one(spark, Decimal("0"), "decimal(20,9)", text) == "0.000000000"
        assert one(spark, Decimal("-0.000000012"), "decimal(20,9)", text) == "-0.000000012"
    finally:
        spark.conf.unset("spark.sql.ansi.enabled")


@pytest.mark.parametrize("dtype", ["timestamp_ntz", "timestamp", "date"])
def test_declared_date(spark, dtype):
    value = dt.date(2026, 6, 10) if dtype == "date" else dt.datetime(2026, 6, 10, 12)
    assert one(spark, value, dtype, lambda c, t: text(c, t, "Date")) == "2026-06-10"


@pytest.mark.parametrize(
    "value, expected",
    [
        (None, ""),
        ("", ""),
        ("plain", "plain"),
        (' #a;"', '" #a;"""'),
        ('Acme, Inc. "the best"', '"Acme, Inc. ""the best"""'),
        ("a\nb", '"a\nb"'),
        ("a\rb", '"a\rb"'),
        ("=1+1", "=1+1"),
    ],
)
def test_csv_field(spark, value, expected):
    assert one(spark, value, "string", lambda c, t: csv_field(c)) == expected


@pytest.mark.parametrize(
    "value, expected",
    [
        ("a\x0bb\x1bc", "a�b�c"),
        ("a\tb\nc\rd\U0001f30a", "a\tb\nc\rd\U0001f30a"),
        ("\x00￾￿", "���"),
    ],
)
def test_xml_clean(spark, value, expected):
    assert one(spark, value, "string", lambda c, t: xml_clean(c)) == expected


@pytest.mark.parametrize(
    "value, expected",
    [
        (None, '<n nil="true" />'),
        ("", "<n />"),
        ("a<b>&\"'", "<n>a&lt;b&gt;&amp;\"'</n>"),
        ("\x01", "<n>�</n>"),
    ],
)
def test_xml_element(spark, value, expected):
    assert one(spark, value, "string", lambda c, t: xml_element("n", c)) == expected


@pytest.mark.parametrize(
    "value, dtype, expected",
    [
        (None, "string", "null"),
        (None, "double", "null"),
        (None, "boolean", "null"),
        ("[x]\"\\\n}", "string", '"[x]\\"\\\\\\n}"'),
        ("", "string", '""'),
        (True, "boolean", "true"),
        (5, "smallint", "5"),
        (5, "tinyint", '"5"'),
        (Decimal("42.00"), "decimal(18,2)", "42.00"),
        (42.0, "double", "42"),
        (1.5e16, "double", "1.5E+16"),
        (dt.datetime(2026, 6, 10), "timestamp_ntz", '"2026-06-10T00:00:00"'),
        (dt.datetime(2026, 6, 10, 10, 20, 30), "timestamp_ntz", '"2026-06-10T10:20:30"'),
        (dt.datetime(2026, 6, 10, 1, 2, 3, 450000), "timestamp_ntz", '"2026-06-10T01:02:03.45"'),
        (bytearray([1, 2, 3]), "binary", '"AQID"'),
    ],
)
def test_json_value(spark, value, dtype, expected):
    assert one(spark, value, dtype, json_value) == expected


def test_time_zone_offsets(spark):
    stamp = F.lit("2026-06-10 01:02:03.5+02:00").cast("timestamp")
    kind = T.TimestampType()
    row = spark.range(1).select(text(stamp, kind), json_value(stamp, kind)).first()
    assert row[0] == "2026-06-09T23:02:03.5000000Z"
    assert row[1] == '"2026-06-09T23:02:03.5Z"'


def test_hours_that_a_zone_skips(spark):
    """A value without a zone keeps its clock reading whatever the session's zone."""
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        stamp = F.lit("2026-03-08 02:30:00").cast("timestamp_ntz")
        kind = T.TimestampNTZType()
        row = spark.range(1).select(text(stamp, kind), json_value(stamp, kind)).first()
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert tuple(row) == ("2026-03-08T02:30:00.0000000", '"2026-03-08T02:30:00"')


def test_json_members_mix_runs_and_single_values(spark):
    df = spark.createDataFrame([("}", 1.0, None, 45, "hit")], "a string, b double, c string, d int, e string")
    found = F.when(F.col("d") == 45, F.col("e"))
    kinds = df.schema
    members = json_members(
        [(n, F.col(n), kinds[n].dataType, "String", found if n == "d" else None) for n in "abcd"]
    )
    assert df.select(members).first()[0] == '"a":"}","b":1,"c":null,"d":"hit"'
    missed = json_members([("d", F.col("d"), T.IntegerType(), "String", F.lit(None).cast("string"))])
    assert df.select(missed).first()[0] == '"d":45'


@pytest.mark.parametrize(
    "raw, declared, expected",
    [
        ("42", "Int32", 42),
        (" +42\t", "Int32", 42),
        ("2147483648", "Int32", None),
        ("not-a-number", "Int32", None),
        ("1,000", "Int32", None),
        ("4.0", "Int64", None),
        ("-9223372036854775808", "Int64", -(2**63)),
        ("512.25", "Decimal", Decimal("512.25")),
        ("-1.5E2", "Decimal", Decimal("-150")),
        (".5", "Decimal", Decimal("0.5")),
        ("1,000.5", "Decimal", None),
        ("False", "Boolean", False),
        (" TRUE ", "Boolean", True),
        ("yes", "Boolean", None),
        ("1", "Boolean", None),
        ("2026-06-10", "Date", dt.datetime(2026, 6, 10)),
        ("2026-02-30", "Date", None),
        ("2026-06-10T00:00", "Date", None),
        ("2026-06-10", "DateTime", dt.datetime(2026, 6, 10)),
        ("2026-06-10T01:02:03.1234567", "DateTime", dt.datetime(2026, 6, 10, 1, 2, 3, 123456)),
        ("2026-06-10T01:02:03Z", "DateTime", dt.datetime(2026, 6, 10, 1, 2, 3)),
        ("2026-06-10T01:02:03+02:00", "DateTime", dt.datetime(2026, 6, 9, 23, 2, 3)),
        ("2026-06-10T25:00", "DateTime", None),
        ("now", "DateTime", None),
        ("6F9619FF8B86D011B42D00C04FC964FF", "Guid", "6f9619ff-8b86-d011-b42d-00c04fc964ff"),
        ("6f9619ff", "Guid", None),
        ("any", "String", "any"),
    ],
)
def test_parse(spark, raw, declared, expected):
    parsed = one(spark, raw, "string", lambda c, t: parse_text(c, declared))
    assert parsed.ok is (expected is not None)
    assert parsed.value == expected


def test_parse_null(spark):
    parsed = one(spark, None, "string", lambda c, t: parse_text(c, "Int32"))
    assert parsed.ok is True and parsed.value is None
