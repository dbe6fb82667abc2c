"""Staged exports, ids that continue over imports, lasting views."""

import tempfile
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from loanscope.operators.row_id import with_row_id
from loanscope.sources import commits
from loanscope.sources.files import save_report
from loanscope.sources.published import (
    append_with_ids, current, high_water_mark, publish, publish_views, read_appended, read_published,
)
from loanscope.sources.store import CLEANED_COLUMNS


def _dir():
    return tempfile.mkdtemp(prefix="loanscope-pub-")


def _failing(spark, n=100):
    """A report whose last task fails after others have written."""
    bad = F.when(F.col("id") == n - 1, F.raise_error(F.lit("export breaks")).cast("bigint")).otherwise(F.col("id"))
    return spark.range(n).repartition(4).select(bad.alias("id"))


@pytest.mark.parametrize("fmt", ["parquet", "csv"])
def test_a_failing_export_leaves_the_old_report(spark, fmt):
    path = f"{_dir()}/report"
    save_report(spark.range(5), path, fmt)
    with pytest.raises(Exception, match="export breaks"):
        save_report(_failing(spark), path, fmt)
    read = spark.read.option("header", True).format(fmt)
    assert read.load(path).count() == 5
    save_report(spark.range(7), path, fmt)
    assert read.load(path).count() == 7
    assert [p.name for p in Path(path).parent.iterdir()] == ["report"]


def test_a_report_may_be_computed_from_its_old_version(spark):
    path = f"{_dir()}/report"
    save_report(spark.range(5), path)
    save_report(spark.read.parquet(path).filter("id > 2"), path)
    assert sorted(r["id"] for r in spark.read.parquet(path).collect()) == [3, 4]


@pytest.mark.parametrize("fmt", ["parquet", "csv"])
def test_published_versions(spark, fmt):
    path = f"{_dir()}/report"
    assert current(spark, path) is None
    with pytest.raises(FileNotFoundError):
        read_published(spark, path)
    publish(spark.range(5), path, fmt)
    reading = read_published(spark, path)
    with pytest.raises(Exception, match="export breaks"):
        publish(_failing(spark), path, fmt)
    assert read_published(spark, path).count() == 5
    publish(read_published(spark, path).filter("id < 3"), path, fmt)
    assert reading.count() == 5                     # the version before stays for its readers
    assert read_published(spark, path).dtypes == [("id", "bigint")]
    for n in range(3):
        publish(spark.range(n), path, fmt)
    assert read_published(spark, path).count() == 2
    assert len(list(Path(path).glob("version-*"))) == 2


def test_only_one_of_two_writers_commits(spark, monkeypatch):
    path = f"{_dir()}/report"
    publish(spark.range(1), path)
    seen = commits.entries(spark, path)
    publish(spark.range(2), path)
    monkeypatch.setattr(commits, "entries", lambda *a: seen)  # a writer that looked before the other committed
    with pytest.raises(commits.ConcurrentCommit):
        publish(spark.range(3), path)
    monkeypatch.undo()
    assert read_published(spark, path).count() == 2


def test_ids_continue_over_appends(spark):
    path = f"{_dir()}/loans"
    assert high_water_mark(spark, path) == 0
    rows = lambda *ks: spark.createDataFrame([(k, i, 1, 2) for i, k in enumerate(ks)], "k string, _pid int, _pos int, _off int")
    assert append_with_ids(rows("b", "a", "c"), path, "k") == 3
    first = {(r["loan_id"], r["k"]) for r in read_appended(spark, path).collect()}
    assert first == {(1, "a"), (2, "b"), (3, "c")}
    assert append_with_ids(rows("a", "z").repartition(5), path, "k") == 5
    assert append_with_ids(rows("q").filter("false"), path, "k") == 5
    assert append_with_ids(rows("m").withColumn("extra", F.lit("x")), path, ["k"]) == 6
    got = read_appended(spark, path)
    assert got.columns == ["loan_id", "k", "_pid", "_pos", "_off", "extra"]
    assert {(r["loan_id"], r["k"], r["extra"]) for r in got.collect()} == {
        *((i, k, None) for i, k in first), (4, "a", None), (5, "z", None), (6, "m", "x")}
    assert high_water_mark(spark, path) == 6
    assert not list(Path(path).glob("_work*"))


def test_a_failing_append_gives_no_ids(spark):
    path = f"{_dir()}/loans"
    append_with_ids(spark.range(4), path, "id")
    with pytest.raises(Exception, match="export breaks"):
        append_with_ids(_failing(spark), path, "id")
    assert append_with_ids(spark.range(2), path, "id") == 6
    assert sorted(r["loan_id"] for r in read_appended(spark, path).collect()) == [1, 2, 3, 4, 5, 6]


def test_row_ids_keep_columns_of_any_name(spark):
    df = spark.createDataFrame([(3, "x", "y", "z", 9)], "k int, _pid string, _pos string, __off string, row_id int")
    assert with_row_id(df, "k").collect()[0].asDict() == {"k": 3, "_pid": "x", "_pos": "y", "__off": "z", "row_id": 1}


def test_views_are_read_by_a_second_session(spark, small_loans):
    root = f"{_dir()}/loans"
    publish_views(spark, root, small_loans.filter("loan_id % 2 = 0"), database="kept")
    other = spark.newSession()
    half = other.sql("SELECT count(*) AS n FROM kept.loans").first()["n"]
    assert half == small_loans.filter("loan_id % 2 = 0").count()
    assert other.table("kept.loans_clean").columns == CLEANED_COLUMNS
    publish(small_loans, root)
    assert other.table("kept.loans").count() == half          # until the refresh
    publish_views(spark, root, database="kept")
    assert other.table("kept.loans").count() == small_loans.count()
    with pytest.raises(FileNotFoundError):
        publish_views(spark, f"{root}-none", database="kept")
