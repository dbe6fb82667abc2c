"""Report semantics the order-insensitive oracle check cannot see:
ordering, limits, tie-breaks, join side effects, zero denominators."""

from conftest import make_loans

from loanscope.plans import pnl, portfolio, risk, segments


def test_top_and_bottom_amounts_are_sorted(small_loans):
    top = [r[0] for r in portfolio.a01_top5_amounts(small_loans).collect()]
    bottom = [r[0] for r in portfolio.a02_bottom5_amounts(small_loans).collect()]
    amounts = sorted({r.loan_amnt for r in small_loans.select("loan_amnt").collect()})
    assert top == amounts[::-1][:5]
    assert bottom == amounts[:5]


def test_top_rate_tie_goes_to_lowest_id(spark):
    df = make_loans(spark, [dict(int_rate_bp=2440), dict(int_rate_bp=2440), dict(int_rate_bp=900)])
    row = portfolio.a16_top_rate_loan(df).collect()
    assert [(r.loan_id, r.int_rate_bp) for r in row] == [(1, 2440)]
    assert portfolio.a16_top_rate_loan(df).columns[0] == "loan_id"


def test_recovered_loans_first_ten_by_id(small_loans):
    got = [r.loan_id for r in pnl.a33_recovered_loans(small_loans).collect()]
    expect = sorted(
        r.loan_id for r in small_loans.filter("loan_status = 'Charged Off' AND total_pymnt > funded_amnt").collect()
    )[:10]
    assert got == expect


def test_money_by_state_sorted_numerically(small_loans):
    funded = [r.money_funded for r in portfolio.a17_money_by_state(small_loans).collect()]
    assert funded == sorted(funded, reverse=True)


def test_yoy_first_year_has_no_previous(small_loans):
    rows = portfolio.a05_yoy_funded(small_loans).collect()
    assert rows[0].amount_funded_last_year is None and rows[0].percent_of_last_year is None
    assert [r.issue_year for r in rows] == sorted(r.issue_year for r in rows)


def test_segment_band_without_owner_vanishes(spark):
    rows = (
        [dict(funded_amnt=3000, loan_status="Charged Off", home_ownership="OWN", grade="A")]
        + [dict(funded_amnt=3000, loan_status="Charged Off", home_ownership="RENT", grade="B")] * 2
        + [dict(funded_amnt=3000, loan_status="Fully Paid", grade="C")]
        + [dict(funded_amnt=7000, loan_status="Charged Off", home_ownership="RENT", grade="D")]
        + [dict(funded_amnt=12000, loan_status="Fully Paid", home_ownership="OWN")]
    )
    df = make_loans(spark, rows)
    for fn in (risk.a43_segment_risk, risk.op_segment_join):
        out = [r.asDict() for r in fn(df).collect()]
        assert [r["range_of_loan"] for r in out] == ["Less than $5K"]
        r = out[0]
        assert (r["total_loans"], r["loan_status"], r["percentage_of_status"]) == (4, "Charged Off", 75.0)
        assert (r["most_grade_charged_off"], r["percent_of_the_most_grade_get_co"]) == ("B", 66.67)
        assert r["percent_house_owner_get_co"] == 33.33


def test_top_grade_tie_goes_to_first_grade(spark):
    rows = [dict(funded_amnt=3000, loan_status="Charged Off", grade=g, home_ownership="OWN") for g in "DBBD"]
    df = make_loans(spark, rows)
    assert [r.most_grade_charged_off for r in risk.a43_segment_risk(df).collect()] == ["B"]
    assert [r.grade for r in risk.op_top_grade_per_band(df).collect()] == ["B"]


def test_profit_gap_zero_denominator(spark):
    # Fully Paid profit of 'car' is exactly 0 -> gap percentages are NULL
    rows = [
        dict(purpose="car", loan_status="Fully Paid", total_pymnt=10000, funded_amnt=10000),
        dict(purpose="car", loan_status="Charged Off", total_pymnt=5000, funded_amnt=10000),
        dict(purpose="boat", loan_status="Charged Off", total_pymnt=0, funded_amnt=10000),
    ]
    df = make_loans(spark, rows)
    for fn in (pnl.a42_profit_gap, pnl.op_join_profit_gap):
        out = {r.purpose: r for r in fn(df).collect()}
        assert set(out) == {"car"}  # no Fully Paid 'boat' loan: inner-join semantics
        car = out["car"]
        assert car.total_profit_all_status == -5000 and car.total_profit_of_fully_paid_loans == 0
        assert car.difference_percent_in_profit is None
        assert car.avg_profit_per_loan_all_status == -2500.0


def test_income_band_null_is_unknown(spark):
    df = make_loans(spark, [dict(annual_inc=None), dict(annual_inc=400000), dict(annual_inc=20000)])
    got = {r.group_of_income for r in segments.a20_income_bands(df).collect()}
    assert got == {"Unknown", "Higher than $360k", "Under $30K"}


def test_owner_filter_keeps_denominators(spark):
    df = make_loans(spark, [dict(addr_state="TX", home_ownership="OWN")] + [dict(addr_state="TX")] * 3)
    got = [(r.addr_state, r.number_of_loans, r.total_loans, r.percentage) for r in segments.a25_owner_share_by_state(df).collect()]
    assert got == [("TX", 1, 4, 25.0)]
