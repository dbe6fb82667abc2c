"""Column profiles from Parquet footers."""

import datetime
import tempfile

from pyspark.sql import functions as F

from loanscope.operators.profile import constant_columns, constant_columns_of_files, footer_profile
from loanscope.plans.wrangling import w_constant_columns
from loanscope.sources.store import written_path


def _write(df, **options):
    path = f"{tempfile.mkdtemp(prefix='loanscope-footer-')}/t"
    df.write.options(**options).parquet(path)
    return path


def _mixed(spark):
    day = datetime.date(2011, 5, 1)
    rows = [(1, 7, None, 1.5, day, "a", True, 3), (2, 7, None, -2.5, day, "b", True, None), (None, 7, None, 0.0, day, "b", None, 3)]
    return spark.createDataFrame(
        rows, "i int, same bigint, nothing bigint, d double, day date, t string, b boolean, holes bigint").repartition(3)


def test_footers_say_what_the_rows_say(spark):
    df = _mixed(spark)
    path = _write(df)
    got = sorted(map(tuple, constant_columns_of_files(spark, path).collect()))
    assert got == sorted(map(tuple, constant_columns(df).collect()))
    assert {r[0] for r in got if r[4]} == {"same", "day", "b", "holes"}
    # a file without any value has no least one: that column's rows are read
    whole = _write(df.coalesce(1))
    assert {c for c, *_ in footer_profile(spark, whole, ["i", "same", "nothing", "d", "day", "b"])} == {
        "i", "same", "nothing", "d", "day", "b"}
    assert {c for c, *_ in footer_profile(spark, path, ["same", "holes", "nothing"])} == {"same", "nothing"}


def test_rows_are_read_where_statistics_are_missing(spark):
    df = _mixed(spark).drop("b")
    path = _write(df, **{"parquet.column.statistics.enabled#same": "false", "parquet.column.statistics.enabled#d": "false"})
    got = sorted(map(tuple, constant_columns_of_files(spark, path).collect()))
    assert got == sorted(map(tuple, constant_columns(df).collect()))
    assert not footer_profile(spark, path, ["same"])


def test_empty_table_and_chosen_columns(spark):
    path = _write(_mixed(spark).filter(F.lit(False)))
    got = {r["column_name"]: r["is_constant"] for r in constant_columns_of_files(spark, path, ["i", "t"]).collect()}
    assert not any(got.values()) and set(got) == {"i", "t"}


def test_report_on_the_written_table_scans_text_only(spark, small_loans):
    assert written_path(small_loans) and written_path(small_loans.select("*")) is None
    found = w_constant_columns(small_loans)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "loan_amnt:" not in plan and "term:string" in plan
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, w_constant_columns(small_loans.select("*")).collect()))
