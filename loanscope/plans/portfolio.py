"""Overall, term, grade, year and state reports.

Each report is a function of the loan table (sources.store.loans) and has
its DuckDB oracle text in ORACLE under the same key.  Money stays numeric
(whole dollars); percentages and averages use exact integer rounding
(functions.arith).  Final ORDER BYs are kept: they sort the few
aggregated rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loanscope.functions.arith import avg0, avg2, avg_hundredths, hundredths, pct
from loanscope.functions.text import present
from loanscope.operators.cleaning import FULLY_PAID
from loanscope.operators.median import medians_of_counts, value_counts
from loanscope.operators.shares import in_order, lag_ratio, share_of, two_grain_avg
from loanscope.plans.oracle_base import CLEANED_SELECT, avg_h, pct as sql_pct, ratio, share_sql, with_loans
from loanscope.sources.store import cleaned


def money_by(df: DataFrame, *by: str, with_count: bool = True) -> DataFrame:
    """Requested vs funded money per group (one hash aggregate)."""
    aggs = ["count(1) AS total_loans"] if with_count else []
    aggs += [
        "sum(loan_amnt) AS money_inquiries",
        "sum(funded_amnt) AS money_funded",
        "sum(funded_amnt_inv) AS money_funded_by_investor",
    ]
    return df.groupBy(*by).agg(*[F.expr(e) for e in aggs]).withColumn(
        "percent_money_funded", pct("money_funded", "money_inquiries")
    )


def _money_sql(by: str, select_by: str, with_count: bool = True) -> str:
    cnt = "count(*) AS total_loans, " if with_count else ""
    return (
        f"SELECT {select_by}, {cnt}"
        "CAST(sum(loan_amnt) AS BIGINT) AS money_inquiries, "
        "CAST(sum(funded_amnt) AS BIGINT) AS money_funded, "
        "CAST(sum(funded_amnt_inv) AS BIGINT) AS money_funded_by_investor, "
        f"{sql_pct('sum(funded_amnt)', 'sum(loan_amnt)')} AS percent_money_funded "
        f"FROM loans GROUP BY {by}"
    )


def a01_top5_amounts(df: DataFrame) -> DataFrame:
    """Five largest distinct requested amounts (a top-k report)."""
    c = "top_5_max_amount_for_personal_loans"
    return df.select(F.col("loan_amnt").alias(c)).distinct().orderBy(F.desc(c)).limit(5)


def a02_bottom5_amounts(df: DataFrame) -> DataFrame:
    """Five smallest distinct requested amounts (a top-k report)."""
    c = "top_5_min_amount_for_personal_loans"
    return df.select(F.col("loan_amnt").alias(c)).distinct().orderBy(F.asc(c)).limit(5)


def a03_max_funded(df: DataFrame) -> DataFrame:
    """Largest funded amount."""
    return df.agg(F.max("funded_amnt").alias("max_funded_amount"))


def a04_min_rate_by_grade(df: DataFrame) -> DataFrame:
    """Lowest interest rate per grade."""
    return (
        df.groupBy("grade")
        .agg(hundredths("min(int_rate_bp)").alias("lowest_int_rate"))
        .transform(in_order("grade"))
    )


def a05_yoy_funded(df: DataFrame) -> DataFrame:
    """Funded money per year beside the previous year's (LAG by row)."""
    per_year = df.groupBy("issue_year").agg(F.sum("funded_amnt").alias("total_amount_funded"))
    return lag_ratio(
        per_year, "issue_year", "total_amount_funded", "amount_funded_last_year", "percent_of_last_year"
    ).transform(in_order("issue_year"))


def a06_money_by_year(df: DataFrame) -> DataFrame:
    """Loans, requested, funded and investor-funded money per issue year."""
    return money_by(df, "issue_year").transform(in_order("issue_year"))


def a07_loans_by_term(df: DataFrame) -> DataFrame:
    """Number of loans per term."""
    return df.groupBy("term").agg(F.count(F.lit(1)).alias("total_loans")).transform(in_order("term"))


def a08_loans_by_term_status(df: DataFrame) -> DataFrame:
    """Number of loans per term and status."""
    return (
        df.groupBy("term", "loan_status")
        .agg(F.count(F.lit(1)).alias("total_loans"))
        .transform(in_order("term", "loan_status"))
    )


def a09_rate_by_term_status(df: DataFrame) -> DataFrame:
    """Average interest rate per term and status."""
    return (
        df.groupBy("term", "loan_status")
        .agg(avg_hundredths("sum(int_rate_bp)", "count(int_rate_bp)").alias("avg_int_rate"))
        .transform(in_order("term", "loan_status"))
    )


def a10_money_by_term(df: DataFrame) -> DataFrame:
    """Requested, funded and investor-funded money per term."""
    return money_by(df, "term", with_count=False).transform(in_order("term"))


def a11_paid_rate_by_term(df: DataFrame) -> DataFrame:
    """Paid-off rate per term: Fully Paid share of each term's loans."""
    s = share_of(df, "term", "loan_status", n_col="_n", pct_col="paid_off_rate")
    return (
        s.filter(F.col("loan_status") == FULLY_PAID)
        .select("term", "loan_status", "total_loans", "paid_off_rate")
        .transform(in_order("term"))
    )


def a12_money_by_grade(df: DataFrame) -> DataFrame:
    """Loans and money per grade."""
    return money_by(df, "grade").transform(in_order("grade"))


def a13_paid_rate_by_grade(df: DataFrame) -> DataFrame:
    """Paid-off rate per grade: Fully Paid share of each grade's loans."""
    s = share_of(df, "grade", "loan_status", n_col="_n", pct_col="paid_off_rate")
    return (
        s.filter(F.col("loan_status") == FULLY_PAID)
        .select("grade", "loan_status", "total_loans", "paid_off_rate")
        .transform(in_order("grade"))
    )


def a14_income_by_grade(df: DataFrame) -> DataFrame:
    """Average annual income per grade (NULL incomes ignored, as AVG does)."""
    return (
        df.groupBy("grade")
        .agg(avg2("sum(annual_inc)", "count(annual_inc)").alias("average_income"))
        .transform(in_order("grade"))
    )


def a16_top_rate_loan(df: DataFrame) -> DataFrame:
    """The whole row of the highest-rate loan; ties go to the lowest loan_id.

    The ranking reads two columns (rate, id) with a per-task top-1; the
    winning id is a scalar subquery that the wide scan receives as a
    runtime filter, so the other columns are read only in row groups whose
    bloom filter on loan_id may hold it (``store.write_loans``).
    """
    top_id = (
        df.select("loan_id", "int_rate_bp")
        .orderBy(F.desc("int_rate_bp"), F.asc("loan_id"))
        .limit(1)
        .select("loan_id")
        .scalar()
    )
    return cleaned(df).filter(F.col("loan_id") == top_id)


def a17_money_by_state(df: DataFrame) -> DataFrame:
    """Loans and money per state, most money funded first."""
    return (
        money_by(df.withColumnRenamed("addr_state", "state"), "state")
        .transform(in_order(F.desc("money_funded"), F.asc("state")))
    )


def a18_rate_by_state_status(df: DataFrame) -> DataFrame:
    """State average rate beside the state x status average rate."""
    return two_grain_avg(
        df.withColumnRenamed("addr_state", "state"),
        "state", "loan_status", "int_rate_bp", "state_avg_int_rate", "avg_int_rate",
    ).transform(in_order("state_avg_int_rate", "state", "loan_status"))


def a19_income_by_state(df: DataFrame) -> DataFrame:
    """Average annual income per state, rounded to whole dollars, beside the
    exact median; lowest average first.

    Both come from one count per (state, income): the average adds up
    income x rows, the median picks the middle ranks (operators.median).
    """
    counts = value_counts(df.withColumnRenamed("addr_state", "state"), "state", "annual_inc")
    paid = "CAST(annual_inc AS DECIMAL(38,6)) * n"
    averages = counts.groupBy("state").agg(
        avg0(f"sum({paid})", "sum(CASE WHEN annual_inc IS NOT NULL THEN n END)").alias("avg_income"))
    medians = medians_of_counts(counts, "state", "annual_inc", "median_income").withColumnRenamed("state", "of_state")
    return (
        averages.join(medians, F.col("state").eqNullSafe(F.col("of_state")), "left").drop("of_state")
        .transform(in_order("avg_income", "state"))
    )


def present_money_by_year(df: DataFrame) -> DataFrame:
    """a06 with the money columns as comma text (presentation layer)."""
    return present(
        a06_money_by_year(df), ["money_inquiries", "money_funded", "money_funded_by_investor"]
    )


REPORTS = {
    "a01_top5_amounts": a01_top5_amounts,
    "a02_bottom5_amounts": a02_bottom5_amounts,
    "a03_max_funded": a03_max_funded,
    "a04_min_rate_by_grade": a04_min_rate_by_grade,
    "a05_yoy_funded": a05_yoy_funded,
    "a06_money_by_year": a06_money_by_year,
    "a07_loans_by_term": a07_loans_by_term,
    "a08_loans_by_term_status": a08_loans_by_term_status,
    "a09_rate_by_term_status": a09_rate_by_term_status,
    "a10_money_by_term": a10_money_by_term,
    "a11_paid_rate_by_term": a11_paid_rate_by_term,
    "a12_money_by_grade": a12_money_by_grade,
    "a13_paid_rate_by_grade": a13_paid_rate_by_grade,
    "a14_income_by_grade": a14_income_by_grade,
    "a16_top_rate_loan": a16_top_rate_loan,
    "a17_money_by_state": a17_money_by_state,
    "a18_rate_by_state_status": a18_rate_by_state_status,
    "a19_income_by_state": a19_income_by_state,
    "present_money_by_year": present_money_by_year,
}

def _paid_share_sql(k: str) -> str:
    return share_sql(
        k, "loan_status",
        f"{k}, loan_status, total_loans, {sql_pct('number_of_loans', 'total_loans')} AS paid_off_rate",
        where="loan_status = 'Fully Paid'",
    )


ORACLE = {
    "a01_top5_amounts": with_loans(
        "SELECT loan_amnt AS top_5_max_amount_for_personal_loans FROM loans GROUP BY loan_amnt "
        "ORDER BY loan_amnt DESC LIMIT 5"),
    "a02_bottom5_amounts": with_loans(
        "SELECT loan_amnt AS top_5_min_amount_for_personal_loans FROM loans GROUP BY loan_amnt "
        "ORDER BY loan_amnt LIMIT 5"),
    "a03_max_funded": with_loans("SELECT max(funded_amnt) AS max_funded_amount FROM loans"),
    "a04_min_rate_by_grade": with_loans(
        "SELECT grade, CAST(min(int_rate_bp) AS DOUBLE) / 100 AS lowest_int_rate FROM loans GROUP BY grade"),
    "a05_yoy_funded": with_loans(
        "WITH yearly AS (SELECT issue_year, CAST(sum(funded_amnt) AS BIGINT) AS total_amount_funded"
        " FROM loans GROUP BY issue_year),"
        " with_prev AS (SELECT *, lag(total_amount_funded) OVER (ORDER BY issue_year) AS amount_funded_last_year"
        " FROM yearly)"
        " SELECT issue_year, total_amount_funded, amount_funded_last_year, "
        f"{sql_pct('total_amount_funded', 'amount_funded_last_year')} AS percent_of_last_year FROM with_prev"),
    "a06_money_by_year": with_loans(_money_sql("issue_year", "issue_year")),
    "a07_loans_by_term": with_loans("SELECT term, count(loan_id) AS total_loans FROM loans GROUP BY term"),
    "a08_loans_by_term_status": with_loans(
        "SELECT term, loan_status, count(loan_id) AS total_loans FROM loans GROUP BY loan_status, term"),
    "a09_rate_by_term_status": with_loans(
        f"SELECT term, loan_status, {avg_h('sum(int_rate_bp)', 'count(int_rate_bp)')} AS avg_int_rate "
        "FROM loans GROUP BY term, loan_status"),
    "a10_money_by_term": with_loans(_money_sql("term", "term", with_count=False)),
    "a11_paid_rate_by_term": with_loans(_paid_share_sql("term")),
    "a12_money_by_grade": with_loans(_money_sql("grade", "grade")),
    "a13_paid_rate_by_grade": with_loans(_paid_share_sql("grade")),
    "a14_income_by_grade": with_loans(
        f"SELECT grade, CAST({ratio('sum(annual_inc)', 'count(annual_inc)', 100)} AS DOUBLE) / 100"
        " AS average_income FROM loans GROUP BY grade"),
    "a16_top_rate_loan": with_loans(
        f"SELECT {CLEANED_SELECT} FROM loans ORDER BY int_rate_bp DESC, loan_id LIMIT 1"),
    "a17_money_by_state": with_loans(_money_sql("addr_state", "addr_state AS state")),
    "a18_rate_by_state_status": with_loans(
        "WITH by_status AS (SELECT addr_state, loan_status, sum(int_rate_bp) AS s, count(int_rate_bp) AS c"
        " FROM loans GROUP BY addr_state, loan_status),"
        " by_state AS (SELECT addr_state, sum(int_rate_bp) AS s, count(int_rate_bp) AS c"
        " FROM loans GROUP BY addr_state)"
        " SELECT by_status.addr_state AS state, loan_status, "
        f"{avg_h('by_state.s', 'by_state.c')} AS state_avg_int_rate, "
        f"{avg_h('by_status.s', 'by_status.c')} AS avg_int_rate "
        "FROM by_status JOIN by_state ON by_status.addr_state = by_state.addr_state"),
    "a19_income_by_state": with_loans(
        f"SELECT addr_state AS state, {ratio('sum(annual_inc)', 'count(annual_inc)', 1)} AS avg_income, "
        "CAST(median(annual_inc) AS DOUBLE) AS median_income FROM loans GROUP BY addr_state"),
    "present_money_by_year": with_loans(
        "SELECT issue_year, count(*) AS total_loans, "
        "format('{:,}', CAST(sum(loan_amnt) AS BIGINT)) AS money_inquiries, "
        "format('{:,}', CAST(sum(funded_amnt) AS BIGINT)) AS money_funded, "
        "format('{:,}', CAST(sum(funded_amnt_inv) AS BIGINT)) AS money_funded_by_investor, "
        f"{sql_pct('sum(funded_amnt)', 'sum(loan_amnt)')} AS percent_money_funded "
        "FROM loans GROUP BY issue_year"),
}

