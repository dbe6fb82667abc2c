"""Column functions on hand-made values (FIXTURES section 4)."""

import datetime as dt


from loanscope.functions.arith import avg0, avg2, avg_hundredths, pct, scaled_ratio
from loanscope.functions.bands import AMOUNT_BANDS, INCOME_BANDS, UNKNOWN
from loanscope.functions.months import month_year_code, months_between_whole, normalise_month, parse_month, term_months
from loanscope.functions.text import fmt_int, present


def test_month_text(spark):
    df = spark.createDataFrame(
        [("Dec-2011",), ("Dec-99",), ("Mar-05",), ("Jan-70",), ("Foo-2011",), ("",), (None,)], "t string"
    )
    got = df.select(parse_month("t").alias("d"), normalise_month("t").alias("n")).collect()
    assert [r.d for r in got] == [
        dt.date(2011, 12, 1), dt.date(1999, 12, 1), dt.date(2005, 3, 1), dt.date(1970, 1, 1), None, None, None,
    ]
    assert [r.n for r in got] == ["Dec-2011", "Dec-1999", "Mar-2005", "Jan-1970", None, None, None]


def test_months_between(spark):
    df = spark.createDataFrame([("Jan-2010", "Feb-2013"), ("Mar-2010", "Jan-2010"), ("Jan-2010", None)], "a string, b string")
    got = [r.m for r in df.select(months_between_whole(parse_month("a"), parse_month("b")).alias("m")).collect()]
    assert got == [37, -2, None]


def test_term_months(spark):
    df = spark.createDataFrame([("36 months",), (" 60 months",), ("n/a",), (None,)], "t string")
    assert [r.m for r in df.select(term_months("t").alias("m")).collect()] == [36, 60, None, None]


def test_exact_half_up_percent(spark):
    rows = [(1, 8), (1, 3), (2, 3), (201, 20000), (0, 5), (5, 0), (None, 5), (-1, 8), (1, -8), (1005, 100000)]
    df = spark.createDataFrame(rows, "n long, d long")
    got = [r.p for r in df.select(pct("n", "d").alias("p")).collect()]
    # 1/8 = 12.5 %, 201/20000 = 1.005 % -> 1.01 (half up), 1005/100000 = 1.005 %
    assert got == [12.5, 33.33, 66.67, 1.01, 0.0, None, None, -12.5, -12.5, 1.01]


def test_averages(spark):
    df = spark.createDataFrame([(2501, 2), (-2501, 2), (10, 0)], "s long, c long")
    got = df.select(
        avg2("s", "c").alias("a2"), avg0("s", "c").alias("a0"), avg_hundredths("s", "c").alias("ah"),
        scaled_ratio("s", "c", 1).alias("r"),
    ).collect()
    assert [(r.a2, r.a0, r.ah, r.r) for r in got] == [
        (1250.5, 1251, 12.51, 1251), (-1250.5, -1251, -12.51, -1251), (None, None, None, None),
    ]


def test_band_edges(spark):
    vals = [30000, 30001, 50000, 80000, 160000, 160001, 360000, 360001, None]
    df = spark.createDataFrame([(v,) for v in vals], "x long")
    got = [r.b for r in df.select(INCOME_BANDS.label("x").alias("b")).collect()]
    assert got == [
        "Under $30K", "From $30K - $50K", "From $30K - $50K", "From $50K - $80K", "From $80K - $160K",
        "From $160K - $360K", "From $160K - $360K", "Higher than $360k", UNKNOWN,
    ]
    df2 = spark.createDataFrame([(5000.0,), (5000.01,), (30000.0,), (30000.01,), (None,)], "x double")
    got2 = df2.select(AMOUNT_BANDS.label("x").alias("b"), AMOUNT_BANDS.ordinal("x").alias("o")).collect()
    assert [(r.b, r.o) for r in got2] == [
        ("Less than $5K", 1), ("From $5K - $10K", 2), ("From $25K - $30K", 6), ("More than $30K", 7), (UNKNOWN, 8),
    ]


def test_comma_text(spark):
    df = spark.createDataFrame([(1234567, 2.5), (0, 1234.49)], "a long, b double")
    got = df.select(fmt_int("a").alias("a"), fmt_int("b").alias("b")).collect()
    assert [(r.a, r.b) for r in got] == [("1,234,567", "3"), ("0", "1,234")]
    assert present(df, ["a"]).columns == ["a", "b"]


def test_month_year_code(spark):
    df = spark.createDataFrame([("Dec-1999",), ("Mar-2005",), ("Foo-2011",), ("dec-99",), ("Jan-0",), ("Jan-201",), (None,)],
                               "t string")
    assert [r.c for r in df.select(month_year_code("t").alias("c")).collect()] == [
        "1299", "0305", None, "1299", None, None, None]


def test_ratios_do_not_overflow_on_large_sums(spark):
    # sums of a very large table: num * 20000 exceeds bigint, the decimal widening keeps it exact
    df = spark.createDataFrame([(900_000_000_000_000_000, 1_000_000_000_000_000_000)], "n long, d long")
    assert df.select(pct("n", "d").alias("p")).collect()[0].p == 90.0


def test_scale_conf():
    from loanscope.session import scale_conf

    conf = scale_conf(shuffle_bytes=100 << 40, total_cores=8000)
    assert int(conf["spark.sql.shuffle.partitions"]) == 409600
    assert int(scale_conf(1 << 20, 8)["spark.sql.shuffle.partitions"]) == 16


def test_ratios_of_fractional_money(spark):
    # sums with cents: 1.005 / 100 -> 1.005 % -> 1.01 (half up); 2.675 / 1 -> 267.5 %
    df = spark.createDataFrame([("1.005", "100"), ("2.675", "1"), ("-0.125", "1")], "n string, d string")
    df = df.selectExpr("CAST(n AS DECIMAL(14,3)) AS n", "CAST(d AS DECIMAL(14,3)) AS d")
    got = df.select(pct("n", "d").alias("p"), avg2("n", "d").alias("a")).collect()
    assert [(r.p, r.a) for r in got] == [(1.01, 0.01), (267.5, 2.68), (-12.5, -0.13)]
