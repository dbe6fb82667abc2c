"""CSV import, report sink, SQL views, and the streaming form of the
additive reports."""

import tempfile

from pyspark.sql import functions as F

from conftest import SMALL, TESTDATA

from loanscope.operators.shares import share_of
from loanscope.plans import portfolio
from loanscope.sources.files import read_loans, register_views, save_report
from loanscope.sources.loan_view import RAW_COLUMNS
from loanscope.sources.store import loans
from loanscope.streaming.incremental import start_aggregate, start_share


def test_csv_import_nulls_and_blanks(spark):
    d = tempfile.mkdtemp(prefix="loanscope-csv-")
    header = ",".join(RAW_COLUMNS)
    row1 = ["1"] * len(RAW_COLUMNS)
    row2 = ["2"] + ["NULL"] * (len(RAW_COLUMNS) - 1)
    row3 = ["3"] + [""] * (len(RAW_COLUMNS) - 1)
    i = RAW_COLUMNS.index("purpose")
    row1[i] = "car"
    row3[i] = "  "
    with open(f"{d}/loans.csv", "w") as fh:
        fh.write("\n".join([header] + [",".join(r) for r in (row1, row2, row3)]) + "\n")
    df = read_loans(spark, f"{d}/loans.csv")
    got = {r.loan_id: (r.purpose, r.loan_amnt) for r in df.collect()}
    assert got == {1: ("car", 1), 2: (None, None), 3: (None, None)}


def test_save_report_and_views(spark, small_loans):
    out = tempfile.mkdtemp(prefix="loanscope-out-")
    rep = portfolio.a06_money_by_year(small_loans)
    save_report(rep, f"{out}/a06")
    save_report(rep, f"{out}/a06csv", fmt="csv")
    assert spark.read.parquet(f"{out}/a06").count() == rep.count()
    register_views(spark, SMALL)
    n = spark.sql("SELECT count(*) AS n FROM loans_clean").collect()[0].n
    assert n == small_loans.count()


def test_streaming_reports_match_batch(spark):
    """An additive report resumes from its checkpoint: after new files
    arrive, the next run folds them into the kept state."""
    src = tempfile.mkdtemp(prefix="loanscope-stream-")
    ckpt = tempfile.mkdtemp(prefix="loanscope-stream-ckpt-")
    full = loans(spark, SMALL)
    first = full.filter(F.col("issue_year") <= 1995)
    rest = full.filter(F.col("issue_year") > 1995)
    first.write.mode("append").parquet(src)

    got = {}

    def keep(name):
        def sink(batch, _id):
            got[name] = {tuple(r) for r in batch.collect()}
        return sink

    def money(df):
        return portfolio.money_by(df, "issue_year")

    start_aggregate(spark, src, full.schema, money, keep("money"), checkpoint=ckpt).awaitTermination()
    assert got["money"] == {tuple(r) for r in money(first).collect()}

    rest.write.mode("append").parquet(src)
    start_aggregate(spark, src, full.schema, money, keep("money"), checkpoint=ckpt).awaitTermination()
    assert got["money"] == {tuple(r) for r in money(full).collect()}

    start_share(spark, src, full.schema, ["term"], ["loan_status"], keep("share")).awaitTermination()
    expect = share_of(full, "term", "loan_status").select(
        "term", "loan_status", "number_of_loans", "total_loans", "percentage")
    assert got["share"] == {tuple(r) for r in expect.collect()}


def test_streaming_cleaning_appends_new_files_once(spark):
    from loanscope.operators.cleaning import with_derived
    from loanscope.sources.loan_view import RAW_COLUMNS, loan_view
    from loanscope.streaming.incremental import start_cleaning

    raw = loan_view(spark, SMALL)
    src = tempfile.mkdtemp(prefix="loanscope-raw-")
    out = tempfile.mkdtemp(prefix="loanscope-clean-")
    ckpt = tempfile.mkdtemp(prefix="loanscope-clean-ckpt-")
    first, rest = raw.filter("loan_id % 2 = 0"), raw.filter("loan_id % 2 = 1")
    first.write.mode("append").parquet(src)
    start_cleaning(spark, src, raw.schema, out, checkpoint=ckpt).awaitTermination()
    rest.write.mode("append").parquet(src)
    start_cleaning(spark, src, raw.schema, out, checkpoint=ckpt).awaitTermination()
    got = spark.read.parquet(out)
    expect = with_derived(raw)
    assert got.count() == raw.count()
    cols = RAW_COLUMNS + ["issue_year", "payment_timing"]
    assert got.select(*cols).exceptAll(expect.select(*cols)).count() == 0


def test_csv_import_to_report_end_to_end(spark, small_loans):
    """The import path of the original analysis: a loan CSV with a header
    and NULL cells -> cleaning job -> report, equal to the Parquet path."""
    from loanscope.operators.cleaning import with_derived
    from loanscope.sources.loan_view import loan_view

    d = tempfile.mkdtemp(prefix="loanscope-csv-e2e-")
    loan_view(spark, SMALL).write.option("header", True).option("nullValue", "NULL").csv(f"{d}/loans")
    from_csv = with_derived(read_loans(spark, f"{d}/loans"))
    a = {tuple(r) for r in portfolio.a06_money_by_year(from_csv).collect()}
    b = {tuple(r) for r in portfolio.a06_money_by_year(small_loans).collect()}
    assert a == b


def test_command_line_export(spark):
    from loanscope.__main__ import main

    out = tempfile.mkdtemp(prefix="loanscope-cli-")
    assert main([SMALL, out, "a06_money_by_year", "a43_segment_risk", "--csv"]) == 0
    assert spark.read.option("header", True).csv(f"{out}/a06_money_by_year").count() > 0
    assert spark.read.option("header", True).csv(f"{out}/a43_segment_risk").count() > 0


def test_loan_table_rewritten_when_its_folder_is_cleared(spark):
    """If the written copy is gone, the next read writes it again (simulated
    by pointing the record at a folder that does not exist)."""
    from loanscope.sources import store

    sf = str(TESTDATA / "sf0.001")
    store.materialise(spark, sf)
    key = store._key(spark, sf)
    store._written[key] = store._written[key] + "-gone"
    df = store.loans(spark, sf)
    assert df.count() == 1500
    assert not store._written[key].endswith("-gone")
