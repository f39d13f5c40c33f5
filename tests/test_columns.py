"""Column expressions on dirty cells."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from gridledger.functions import dates, numbers, text


def values(spark, cells, expression, kind="string"):
    frame = spark.createDataFrame([(i, c) for i, c in enumerate(cells)], f"i int, c {kind}")
    return [r[0] for r in frame.orderBy("i").select(expression).collect()]


def test_numbers(spark):
    cells = ["1,234.5", " -7 ", "n/a", "", None, "nan", "1,000,000", "5D", "3f", "1e3", "-Infinity"]
    parsed = [1234.5, -7.0, None, None, None, None, 1000000.0, None, None, 1000.0, float("-inf")]
    assert values(spark, cells, numbers.parse_number("c")) == parsed
    assert values(spark, cells, numbers.parse_number_fill0("c")) == [v or 0.0 for v in parsed]
    junk = values(spark, cells, F.coalesce(numbers.is_junk_number("c"), F.lit(False)))
    assert junk == [False, False, True, False, False, False, False, True, True, False, False]


def test_exact_totals(spark):
    cells = [0.1, 0.2, -0.3, 12345678901.2345, -12345678901.2345, 0.0001]
    frame = spark.createDataFrame([(c,) for c in cells], "c double")
    assert frame.agg(numbers.total("c")).first()[0] == 0.0001
    big = spark.range(1000).select(F.lit(90000000000000.25).alias("c"))
    assert big.agg(numbers.total("c")).first()[0] == 9.000000000000025e16
    tiny = spark.range(3).select(F.lit(0.00004).alias("c"))
    assert tiny.agg(numbers.total("c")).first()[0] == 0.00012
    wild = spark.createDataFrame([(1e15,), (float("inf"),), (1e300,)], "c double")
    assert wild.agg(numbers.total("c")).first()[0] == float("inf")
    assert wild.filter("c < 1e20").agg(numbers.total("c")).first()[0] == 1e15
    both = wild.agg(numbers.parts("c").alias("a")).select(numbers.difference(F.col("a"), F.col("a")))
    assert both.first()[0] != both.first()[0]  # inf - inf
    nothing = frame.filter("c > 1e12")
    assert nothing.agg(numbers.total("c"), numbers.total_or_0("c")).first()[:] == (None, 0.0)


def test_rounding_and_text(spark):
    cells = [1234.565, -0.125, 0.0, 12345.6]
    assert values(spark, cells, numbers.rounded("c"), "double") == [1234.57, -0.13, 0.0, 12345.6]
    assert values(spark, cells, numbers.signed_text("c"), "double") == [
        "+1234.57", "-0.13", "0.0", "+12345.6",
    ]
    assert values(spark, cells, numbers.grouped_digits("c"), "double") == ["1,235", "-0", "0", "12,346"]
    assert values(spark, cells, numbers.sign_label("c"), "double") == ["+", "-", "", "+"]


def test_report_dates(spark):
    cells = [
        "05Nov24", "05NOV24", "05-11-2024", "2024-11-05", "05–11–2024", " 5/11/2024 ",
        "2024-11-05 00:00:00", "31-02-2024", "junk", None,
    ]
    day = dt.date(2024, 11, 5)
    assert values(spark, cells, dates.parse_report_date("c")) == [day] * 7 + [None] * 3
    assert values(spark, cells[2:4] + ["junk"], dates.parse_date_dayfirst("c")) == [day, day, None]


def test_short_years(spark):
    cells = ["05Nov68", "05Nov69", "29Feb96"]
    assert values(spark, cells, dates.parse_report_date("c")) == [
        dt.date(2068, 11, 5), dt.date(1969, 11, 5), dt.date(1996, 2, 29),
    ]


def test_question_dates(spark):
    cells = ["nop on 05-11-2024?", "for 05/11/2024 and 06/11/2024", "31-02-2024", "no date", None]
    day = dt.date(2024, 11, 5)
    assert values(spark, cells, dates.extract_date("c")) == [day, day, None, None, None]


@pytest.mark.parametrize(
    "cell, expected",
    [
        ("at 5/11/24", dt.date(2024, 11, 5)),
        ("at 5-11-1998", dt.date(1998, 11, 5)),
        ("at 5-11-98", dt.date(1998, 11, 5)),
        ("at 5Nov24", dt.date(2024, 11, 5)),
        ("at 05NOV2024", dt.date(2024, 11, 5)),
        ("99/99/2024 or 5nov24", dt.date(2024, 11, 5)),
        ("5-11-202", None),
        ("nothing", None),
        (None, None),
    ],
)
def test_loose_dates(spark, cell, expected):
    assert values(spark, [cell], dates.extract_date_loose("c")) == [expected]


def test_routing(spark):
    cells = ["nop_co2_1.csv", "X_NOP_NG.csv", "NOP_PW_1.csv", "other_d.csv", "co2_schema.csv"]
    assert values(spark, cells, text.route_feed("c")) == ["CO2", "NG", "PW", None, None]
    assert values(spark, cells, text.route_object_key("c")) == [
        "CO2/nop_co2_1.csv", "NG/X_NOP_NG.csv", "PW/NOP_PW_1.csv", "misc/other_d.csv",
        "misc/co2_schema.csv",
    ]
    assert values(spark, cells, text.route_object_key("c", "metadata"))[3:] == [
        "misc/other_d.csv", "CO2/metadata/co2_schema.csv",
    ]
    assert values(spark, ["NOP_PW_1.csv", "plain.csv"], text.feed_of_name("c")) == ["PW", "OTHER"]


def test_questions(spark):
    cells = ["Net Open Position today", "open position in DOLLAR", "volume by book"]
    assert values(spark, cells, text.nop_measure("c")) == ["VOLUME_BL", "MKT_VAL_BL", None]
    asked = ["power", "CO2", "Natural Gas", "ng", "coal", None]
    assert values(spark, asked, text.resolve_feed("c")) == ["PW", "CO2", "NG", "NG", "PW", "PW"]


def test_confidence(spark):
    frame = spark.createDataFrame([(0, 0), (3, 0), (0, 5), (20, 0)], "n int, d int")
    scores = [r[0] for r in frame.select(F.round(numbers.confidence(0.7, "n", "d"), 4)).collect()]
    assert scores == [0.7, 0.55, 0.99, 0.1]
