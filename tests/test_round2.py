"""Import by header, NULL groups, orders, changed sources, restarts."""

import tempfile

import pytest
from conftest import SMALL, TESTDATA, make_loans

from loanscope.operators.cleaning import with_derived
from loanscope.operators.profile import duplicate_keys, with_composite_key
from loanscope.plans import pnl, portfolio
from loanscope.plans.wrangling import reimported
from loanscope.sources import store
from loanscope.sources.files import raw_schema, read_loans
from loanscope.sources.loan_view import loan_view


def _folder():
    return tempfile.mkdtemp(prefix="loanscope-test-")


def test_csv_columns_are_found_by_name(spark, small_loans):
    d = _folder()
    raw = loan_view(spark, SMALL)
    raw.select(*reversed(raw.columns)).write.option("header", True).option("nullValue", "NULL").csv(f"{d}/loans")
    back = with_derived(read_loans(spark, f"{d}/loans"))
    for report in (portfolio.a06_money_by_year, pnl.a30_pnl_full_term):
        assert sorted(map(str, report(back).collect())) == sorted(map(str, report(small_loans).collect()))


@pytest.mark.parametrize("cell", ["5863.16", "abc"])
def test_csv_cell_of_another_type_is_an_error(spark, cell):
    d = _folder()
    names = raw_schema().names
    row = {c: "1" for c in names} | {"total_pymnt": cell}
    spark.createDataFrame([tuple(row[c] for c in names)], names).write.option("header", True).csv(f"{d}/loans")
    with pytest.raises(Exception, match="total_pymnt"):
        read_loans(spark, f"{d}/loans").select("total_pymnt").collect()


def test_profit_gap_leaves_the_null_purpose_out(spark):
    df = make_loans(spark, [{}, {"purpose": None}, {"purpose": "house"}])
    want = sorted(map(tuple, pnl.op_join_profit_gap(df).collect()))
    assert sorted(map(tuple, pnl.a42_profit_gap(df).collect())) == want
    assert [r[0] for r in want] == ["car", "house"]


def test_loss_report_begins_with_the_worst(spark):
    off = {"loan_status": "Charged Off"}
    df = make_loans(spark, [off | {"purpose": "a", "total_pymnt": 9000}, off | {"purpose": "b", "total_pymnt": 1000}])
    rows = pnl.a38_loss_by_purpose(df).collect()
    assert [r["purpose"] for r in rows] == ["b", "a"]


def test_profit_reports_begin_with_the_best(spark):
    df = make_loans(spark, [{"purpose": "a", "total_pymnt": 10100}, {"purpose": "b", "total_pymnt": 19000}])
    for report in (pnl.a39_profit_by_purpose_paid, pnl.a41_profit_by_purpose_all):
        assert [r["purpose"] for r in report(df).collect()] == ["b", "a"]


def test_all_recovered_loans_without_a_limit(spark):
    df = make_loans(spark, [{"loan_status": "Charged Off"}] * 12)
    assert pnl.a33_recovered_loans(df).count() == 10 and pnl.a33_recovered_loans(df, limit=None).count() == 12


def test_reimported_keys_and_month_case(spark, small_loans):
    keyed = with_composite_key(reimported(small_loans))
    assert duplicate_keys(keyed, "primkey").count() == small_loans.filter("loan_id % 100 = 3").count()
    df = make_loans(spark, [{"issue_d": "Jan-2010"}, {"issue_d": "JAN-2010"}])
    assert [r["occurrences"] for r in duplicate_keys(with_composite_key(df), "primkey").collect()] == [2]


def test_two_digit_years_in_all_months(spark):
    df = make_loans(spark, [{"issue_d": "Jan-10", "last_pymnt_d": "Feb-13"}]).drop(*store.DERIVED_COLUMNS)
    row = with_derived(df).first()
    assert row["issue_year"] == 2010 and row["months_made_payment"] == 37 and row["payment_timing"] != "unknown"


def test_a_changed_source_is_built_again(spark):
    d = _folder()
    for t in store.INPUT_TABLES:
        spark.read.parquet(f"{TESTDATA}/sf0.001/{t}.parquet").write.parquet(f"{d}/{t}.parquet")
    assert store.loans(spark, d).count() == 1500
    orders = spark.read.parquet(f"{TESTDATA}/sf0.001/orders.parquet").limit(500)
    orders.write.mode("overwrite").parquet(f"{d}/orders.parquet")
    assert store.loans(spark, d).count() == 500


def test_all_constant_columns_are_found_and_dropped(spark, small_loans):
    from loanscope.operators.cleaning import FIRST_DROP, SECOND_DROP
    from loanscope.plans.wrangling import w_clean, w_constant_columns

    found = {r["column_name"] for r in w_constant_columns(small_loans).collect() if r["is_constant"]}
    assert set(FIRST_DROP) <= found
    assert not set(FIRST_DROP + SECOND_DROP) & set(w_clean(small_loans).columns)
    assert set(FIRST_DROP + SECOND_DROP) <= set(small_loans.columns)


def test_an_id_reads_few_row_groups(spark, small_loans):
    path = f"{_folder()}/loans"
    store.write_loans(small_loans.repartition(8, "purpose", "addr_state"), path)
    one = spark.read.parquet(path).filter("loan_id = 707")
    assert [r["loan_id"] for r in one.collect()] == [707]
    node = one._jdf.queryExecution().executedPlan()
    while node.children().size():
        node = node.children().head()
    read = node.metrics().get("numOutputRows").get().value()
    assert 0 < read < small_loans.count() / 2


def test_profit_gap_by_a_wide_key_stays_distributed(spark, small_loans):
    got = pnl.pnl_gap(small_loans, "zip_code")
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan and "RoundRobin" not in plan and "rangepartitioning" in plan
    zips = [r["zip_code"] for r in got.collect()]
    assert zips == sorted(zips) and len(zips) > 50


@pytest.mark.parametrize("edge", [5000, 10000, 15000, 20000, 25000, 30000])
def test_amount_edges_belong_to_the_band_below(spark, edge):
    from loanscope.functions.bands import AMOUNT_BANDS

    df = make_loans(spark, [{"funded_amnt": edge}, {"funded_amnt": edge + 1}])
    got = [r[0] for r in df.orderBy("loan_id").select(AMOUNT_BANDS.ordinal("funded_amnt")).collect()]
    assert got == [edge // 5000, edge // 5000 + 1]


def test_loan_write_keeps_generated_methods_compilable(spark, small_loans):
    limit, seen = "spark.sql.codegen.hugeMethodLimit", []
    before = spark.conf.get(limit)

    class Watched:
        sparkSession = spark

        @property
        def write(self):
            seen.append(int(spark.conf.get(limit)))
            return small_loans.write

    path = f"{_folder()}/loans"
    store.write_loans(Watched(), path)
    assert seen == [8000] and spark.conf.get(limit) == before
    assert spark.read.parquet(path).exceptAll(small_loans).count() == 0
