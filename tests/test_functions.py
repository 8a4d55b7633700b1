from __future__ import annotations

from decimal import Decimal

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from helpers import column, tuples
from mercato.functions.numbers import exact_average, percent, rounded_to_whole, to_number, to_whole, to_wide
from mercato.functions.text import MISSING_TOKENS, WHITE_SPACE, strip, without_missing_tokens, zero_fill
from mercato.functions.times import day_name, day_of_week, days_between, month_name, to_utc
from mercato.session import configure_tables

TEXT = T.StringType()


def texts(spark, values):
    return spark.createDataFrame([(v,) for v in values], "v string").coalesce(1)


def test_numbers_from_text(spark):
    given = ["12", " 12 ", "4.0", "4.5", "abc", "1,5", "12f", "NaN", "", None, "1e3", "-.5", "+7.", "inf", "0x10"]
    got = column(texts(spark, given).select(to_number(F.col("v"), TEXT, "decimal(10,2)")))
    want = ["12", "12", "4", "4.5", None, None, None, None, None, None, "1000", "-0.5", "7", None, None]
    assert got == [None if w is None else Decimal(w) for w in want]


def test_a_number_too_large_for_its_type_is_not_one(spark):
    assert column(texts(spark, ["123456789"]).select(to_number(F.col("v"), TEXT, "decimal(6,2)"))) == [None]
    assert column(texts(spark, ["40000"]).select(to_whole(F.col("v"), TEXT, "smallint"))) == [None]


def test_whole_numbers(spark):
    df = texts(spark, ["4.0", "4.5", "-3", "x", None])
    assert column(df.select(to_whole(F.col("v"), TEXT))) == [4, None, -3, None, None]
    assert column(df.select(rounded_to_whole(F.col("v"), TEXT))) == [4, 5, -3, None, None]


def test_numeric_sources_keep_their_type_and_lose_nan(spark):
    df = spark.createDataFrame([(1.5,), (float("nan"),)], "v double").coalesce(1)
    assert column(df.select(to_number(F.col("v"), T.DoubleType(), "decimal(10,2)"))) == [Decimal("1.50"), None]
    df = spark.createDataFrame([(Decimal("123456789.12"),)], "v decimal(12,2)")
    assert df.select(to_number(F.col("v"), df.schema["v"].dataType, "decimal(6,2)")).dtypes[0][1] == "decimal(12,2)"


def test_timestamps_from_text(spark):
    given = ["2017-10-02 10:56:33", "2017-10-02", "bad", "", None, "10:56:33", "2017-13-02", "2017-10-02T10:56:33Z"]
    got = column(texts(spark, given).select(F.date_format(to_utc(F.col("v"), TEXT), "yyyy-MM-dd HH:mm:ss")))
    full = "2017-10-02 10:56:33"
    assert got == [full, "2017-10-02 00:00:00", None, None, None, None, None, full]


def test_zero_fill_never_cuts(spark):
    got = column(texts(spark, ["1037", "01037", "123456", "", None]).select(zero_fill(F.col("v"), 5)))
    assert got == ["01037", "01037", "123456", "00000", None]


def test_strip_cuts_all_white_space_at_the_ends(spark):
    given = ["\t a b \n", " x　", "\x1fy ", "", None]
    assert column(texts(spark, given).select(strip(F.col("v")))) == ["a b", "x", "y", "", None]
    assert all(c.isspace() for c in WHITE_SPACE)


def test_missing_tokens(spark):
    df = spark.createDataFrame([(t, 1) for t in (*MISSING_TOKENS, "x", "Na")], "v string, n int").coalesce(1)
    got = without_missing_tokens(df)
    assert column(got, "v") == [None] * len(MISSING_TOKENS) + ["x", "Na"]
    assert got.dtypes == df.dtypes


def test_exact_average_rounds_once(spark):
    cents = spark.range(10_001).select(
        F.when(F.col("id") < 5_000, Decimal("0.02")).otherwise(Decimal("0.01")).cast("decimal(11,2)").alias("v")
    )
    exact, doubly = cents.agg(F.round(exact_average("v"), 2), F.round(F.avg("v"), 2)).first()
    assert (exact, doubly) == (Decimal("0.01"), Decimal("0.02"))


@pytest.mark.parametrize(
    ("part", "whole", "want"), [(1, 8, "12.50"), (1, 3, "33.33"), (-1, 16, "-6.25"), (1, 0, None), (1, 800, "0.13")]
)
def test_percent(spark, part, whole, want):
    df = spark.createDataFrame([(part, whole)], "part bigint, whole bigint")
    got = df.select(percent(F.col("part"), F.col("whole"))).first()[0]
    assert got == (None if want is None else Decimal(want))


def test_calendar(spark):
    days = texts(spark, ["2017-10-01 23:30:00", "2017-10-07 00:00:00", "2017-05-01 12:00:00"])
    day = F.col("v").cast("timestamp")
    assert tuples(days.select(day_of_week(day), month_name(day), day_name(day))) == [
        (0, "October  ", "Sunday   "),
        (6, "October  ", "Saturday "),
        (1, "May      ", "Monday   "),
    ]


def test_days_between_keeps_the_fraction(spark):
    df = spark.sql("select timestamp'2017-01-01 12:00:00' as a, timestamp'2017-01-03 00:00:00' as b")
    assert df.select(days_between(F.col("a"), F.col("b")), days_between(F.col("b"), F.col("a"))).first() == (-1.5, 1.5)


def test_numbers_beyond_the_type_keep_size_and_sign(spark):
    most, least = Decimal("9" * 28 + "." + "9" * 10), Decimal("1e-10")
    given = {
        "1e40": most, "-1e40": most.copy_negate(), "1e-12": least, "-1e-12": -least, "-0.00000000004": -least, "0e99999": 0,
        "-0.0": 0, "7e-99999999": least, "-7E+99999999": most.copy_negate(), "1e3": 1000, " -4.5 ": Decimal("-4.5"),
        "12f": None, "": None, "1e": None, "e5": None,
    }
    got = column(texts(spark, list(given)).select(to_wide(F.col("v"), TEXT)))
    assert got == list(given.values())
    numbers = [1e40, -1e300, 1e-12, -1e-12, 0.0, 2.5, float("nan"), float("inf"), float("-inf"), None]
    lowest = most.copy_negate()
    want = [most, lowest, least, -least, 0, Decimal("2.5"), None, most, lowest, None]
    doubles = spark.createDataFrame([(n,) for n in numbers], "v double").coalesce(1)
    assert column(doubles.select(to_wide(F.col("v"), T.DoubleType()))) == want
    assert column(texts(spark, ["1e-12", "1e30"]).select(to_whole(F.col("v"), TEXT))) == [None, None]
    assert column(texts(spark, ["1e30"]).select(rounded_to_whole(F.col("v"), TEXT, "decimal(38,0)"))) == [10**28]


def test_blanks_that_a_cast_cuts_or_leaves(spark):
    """Texts that are read at once and texts that are not give the same."""
    given = ["\x017", "\x01 7", "7\xa0", "\xa07", "7\x01\xa0", "\xa0\x017", "\x7f7", "٣7", "٠", "-0", "0.00000000001"]
    df = texts(spark, given).select(to_whole(F.col("v"), TEXT).alias("n"), to_wide(F.col("v"), TEXT).alias("w"))
    assert column(df.select("n")) == [7, 7, 7, 7, 7, 7, None, 37, None, 0, None]
    assert column(df.select("w"))[-2:] == [Decimal(0), Decimal("0.0000000001")]
    dates = [" 2017-10-02", "2017-10-02 ", "2017-10-02\xa0", "\xa02017-10-02 10:56", "\x012017-10-02", "2017-10-02\x7f"]
    got = column(texts(spark, dates).select(F.date_format(to_utc(F.col("v"), TEXT), "yyyy-MM-dd HH:mm")))
    assert got == ["2017-10-02 00:00"] * 3 + ["2017-10-02 10:56", None, "2017-10-02 00:00"]


def test_methods_are_short_enough_to_be_compiled(spark):
    """The JVM interprets a method of more than 8,000 bytes for ever."""
    configure_tables(spark)
    assert int(spark.conf.get("spark.sql.codegen.hugeMethodLimit")) == 8000
