"""Cross-report invariants on the driver data."""

from conftest import SMALL

from loanscope.plans import registry as E


def q(spark, key):
    return E.queries()[key](spark, SMALL)


def test_charged_off_split(spark, small_loans):
    co = small_loans.filter("loan_status = 'Charged Off'").count()
    short = q(spark, "a34_count_shortfall").collect()[0].number_of_loans
    covered = q(spark, "a35_pnl_recovered").collect()[0].number_of_loans
    assert short + covered == co


def test_fully_paid_timing_split(spark, small_loans):
    fp = small_loans.filter("loan_status = 'Fully Paid'")
    by = {r.payment_timing: r["count"] for r in fp.groupBy("payment_timing").count().collect()}
    full = q(spark, "a30_pnl_full_term").collect()[0].number_of_loans
    early = q(spark, "a31_pnl_early").collect()[0].number_of_loans
    assert (full, early) == (by.get("full", 0), by.get("early", 0))
    assert sum(by.values()) == fp.count()


def test_yearly_profit_adds_up(spark):
    total = q(spark, "a28_profit_total").collect()[0]
    years = q(spark, "a29_profit_by_year").collect()
    assert sum(r.loans for r in years) == total.loans
    assert sum(r.profit for r in years) == total.profit


def test_purpose_profit_adds_up(spark):
    co = {r.purpose: r.profit_net_fee for r in q(spark, "a38_loss_by_purpose").collect()}
    fp = {r.purpose: r.profit_net_fee for r in q(spark, "a39_profit_by_purpose_paid").collect()}
    allp = {r.purpose: r.profit_net_fee for r in q(spark, "a41_profit_by_purpose_all").collect()}
    for p, v in allp.items():
        assert co.get(p, 0) + fp.get(p, 0) == v


def test_status_by_year_adds_up(spark):
    per = {}
    for r in q(spark, "r01_status_by_year").collect():
        per[r.issue_year] = per.get(r.issue_year, 0) + r.total_loans
    assert per == {r.issue_year: r.total_loans for r in q(spark, "a06_money_by_year").collect()}


def test_shares_sum_to_100(spark):
    sums = {}
    for r in q(spark, "a23_status_by_purpose").collect():
        sums[r.purpose] = sums.get(r.purpose, 0) + r.percentage
    assert all(abs(v - 100) < 0.02 for v in sums.values())
