"""Scalar rules against hand-worked values and short Python statements of them."""

import re

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tablewright.functions import dates, derive, naming, numbers, text

PROPERTY = settings(max_examples=15, deadline=None, suppress_health_check=list(HealthCheck))


def values(spark, cells, *exprs):
    df = spark.createDataFrame([(i, c) for i, c in enumerate(cells)], "i int, c string").repartition(1)
    return [tuple(r)[1:] for r in df.select("i", *exprs).orderBy("i").collect()]


def one(spark, cells, expr):
    return [r[0] for r in values(spark, cells, expr)]


C = F.col("c")


@PROPERTY
@given(st.lists(st.text(alphabet=" \t\n\x1c\x85\xa0  aÉz-.", max_size=6), min_size=1, max_size=40))
def test_strip_is_pythons(spark, cells):
    assert one(spark, cells, text.strip(C)) == [c.strip() for c in cells]


def test_three_kinds_of_missing(spark):
    cells = [None, "", "  ", "N/A", " null ", "-", "nan", "x", "none!"]
    got = values(spark, cells, text.is_blank(C), text.is_empty(C), text.is_void(C))
    assert [g[0] for g in got] == [True] * 7 + [False] * 2
    assert [g[1] for g in got] == [True] * 3 + [False] * 6
    assert [g[2] for g in got] == [True] * 2 + [False] * 7


def as_number(s):
    clean = s.replace(",", "").strip()
    if re.search(r"[_a-df-zA-DF-Z]", clean):  # no underscores, inf or nan
        return None
    try:
        return float(clean) if "." in clean else float(int(clean))
    except ValueError:
        return None


@PROPERTY
@given(st.lists(st.text(alphabet="0123456789.,+-eE ", max_size=8), min_size=1, max_size=40))
def test_number_is_pythons(spark, cells):
    assert one(spark, cells, numbers.number(C)) == [as_number(c) for c in cells]


def test_number_cases(spark):
    cells = ["1,234.50", "1e5", "1.0e5", "1d", "inf", "1_000", "", "-", "5.", ".5", "+7", "--7", None]
    assert one(spark, cells, numbers.number(C)) == [
        1234.5, None, 1e5, None, None, None, None, None, 5.0, 0.5, 7.0, None, None]


def test_title_case(spark):
    cells = ["o'brien", "mary-ann", "foo_bar", "3rd", "ÉCOLE normale"]
    assert one(spark, cells, text.title(C)) == [c.title() for c in cells]


@PROPERTY
@given(st.lists(st.floats(allow_nan=False, allow_infinity=False), min_size=1, max_size=20))
def test_float_text_reads_back(spark, xs):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(xs)], "i int, x double").repartition(1)
    got = [r[1] for r in df.select("i", numbers.float_text(F.col("x"))).orderBy("i").collect()]
    assert [float(g) for g in got] == xs


def test_float_text_form(spark):
    cells = ["4512.33", "100.0", "12345678.9", "1e+16", "0.0001", "1e-05", "0.0", "-2.5"]
    assert one(spark, cells, numbers.float_text(C.cast("double"))) == cells


def test_dates(spark):
    cells = ["2020-01-05", "5/1/2020", "13/1/2020", "1/13/2020", "31/02/2020", "05.01.2020", "2020/1/5", "20-01-05", "x", ""]
    assert one(spark, cells, dates.zone_date(C)) == [
        "2020-01-05", "2020-01-05", "2020-01-13", "2020-01-13", "31/02/2020", "05.01.2020", "2020/1/5", "20-01-05", "x", ""]
    assert one(spark, cells, dates.any_file_date(C))[5:7] == ["2020-01-05", "2020-01-05"]


def test_profile_dates(spark):
    cells = ["2020-01-05 10:11:12", "5 Jan 2020", "JAN 5, 2020", "1/2/2020", "1/13/2020", "2020-13-01", "2020-01-05T00:00"]
    stripped = text.strip(C)
    got = values(spark, cells, dates.tagged_stamp(dates.tagged_date(stripped)), dates.tagged_format(dates.tagged_date(stripped)))
    assert got == [
        ("2020-01-05 10:11:12", "%Y-%m-%d %H:%M:%S"), ("2020-01-05 00:00:00", "%d %b %Y"),
        ("2020-01-05 00:00:00", "%b %d, %Y"), ("2020-02-01 00:00:00", "%d/%m/%Y"),
        ("2020-01-13 00:00:00", "%m/%d/%Y"), (None, None), (None, None)]


def test_age_and_tenure(spark):
    cells = ["2007-06-01", "1999-01-01", "1984-12-31", "1964-01-01", "1950-01-01", "soon", None, "2030-01-01"]
    assert one(spark, cells, derive.age_group(C, "2025-01-01")) == [
        "Under 18", "26-40", "26-40", "60+", "60+", "Unknown", "Unknown", "Under 18"]
    assert one(spark, ["2020-01-01", "2026-01-01", "x"], derive.tenure_years(C, "2025-01-01")) == [5.0, -1.0, None]


def test_amounts(spark):
    rows = [("100", "eur", 109.0), ("100", None, 100.0), ("", "EUR", 0.0), (None, "EUR", 0.0), ("abc", "EUR", None),
            ("0.125", "USD", 0.13), ("-50", "XXX", -50.0), ("1e30", "USD", 1e30)]
    df = spark.createDataFrame([(i, a, c) for i, (a, c, _) in enumerate(rows)], "i int, a string, c string")
    got = df.select("i", derive.amount_usd(F.col("a"), F.col("c")).alias("u")).orderBy("i").collect()
    assert [r["u"] for r in got] == [r[2] for r in rows]


def test_ip_and_anomaly(spark):
    assert one(spark, ["192.168.1.1", "8.8.8.8", None, "178.62.0.1"], derive.ip_country(C)) == ["US", "Unknown", "Unknown", "FR"]
    assert one(spark, ["81", "80", "-11", "abc", None], derive.is_anomaly(C)) == [1, 0, 1, 0, 0]


def test_names():
    assert naming.sensitivity("product_name") == "PII"
    assert naming.sensitivity("description", naming.ANY_FILE_KEYWORDS) == "PII"  # contains "ip"
    assert naming.sensitivity("department") == "Public"
    assert naming.sensitivity("department", naming.ANY_FILE_KEYWORDS) == "Internal"
    assert naming.is_zone_date("created_at") and not naming.is_zone_date("dates")
    assert [naming.safe_table_name(n) for n in ("/x/My File.csv", "2020.csv", "__.csv")] == [
        "my_file", "t_2020", "custom_table"]


@pytest.mark.parametrize("n,total,digits,want", [(1, 3, 2, 33.33), (1, 8, 2, 12.5), (1, 800, 2, 0.13), (0, 0, 2, 0.0), (2, 3, 1, 66.7)])
def test_ratio(spark, n, total, digits, want):
    df = spark.range(1).select(F.lit(n).cast("bigint").alias("n"), F.lit(total).cast("bigint").alias("t"))
    assert df.select(numbers.ratio(F.col("n"), F.col("t"), digits)).first()[0] == want
