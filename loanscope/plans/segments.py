"""Customer segments: income bands, purpose, home ownership, credit
history, and the yearly status reports.

Share reports aggregate at the finest grain, then window over the
aggregated rows (operators.shares); filters on a non-partition column of
those windows run after the window, so denominators keep every row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loanscope.functions.arith import avg2, avg_hundredths, pct
from loanscope.functions.bands import INCOME_BANDS
from loanscope.operators.cleaning import CHARGED_OFF
from loanscope.operators.shares import in_order, share_of
from loanscope.plans.oracle_base import avg_h, pct as sql_pct, ratio, share_sql, with_loans


def a20_income_bands(df: DataFrame) -> DataFrame:
    """Status share inside each income band (NULL income -> Unknown band)."""
    banded = df.select(INCOME_BANDS.label("annual_inc").alias("group_of_income"), "loan_status")
    return (
        share_of(banded, "group_of_income", "loan_status", n_col="_n", pct_col="percent_to_total_loans")
        .select("group_of_income", "loan_status", "total_loans", "percent_to_total_loans")
        .transform(in_order(F.desc("total_loans"), "group_of_income", "loan_status"))
    )


def a21_loans_by_purpose(df: DataFrame) -> DataFrame:
    """Number of loans per purpose, most first."""
    return (
        df.groupBy("purpose").agg(F.count(F.lit(1)).alias("number_of_loans"))
        .transform(in_order(F.desc("number_of_loans"), "purpose"))
    )


def a22_avg_by_purpose(df: DataFrame) -> DataFrame:
    """Average funded amount and interest rate per purpose."""
    return (
        df.groupBy("purpose")
        .agg(
            avg2("sum(funded_amnt)", "count(funded_amnt)").alias("avg_amount_of_money_funded"),
            avg_hundredths("sum(int_rate_bp)", "count(int_rate_bp)").alias("avg_int_rate"),
        )
        .transform(in_order(F.desc("avg_int_rate"), "purpose"))
    )


def a23_status_by_purpose(df: DataFrame) -> DataFrame:
    """Status share inside each purpose."""
    return (
        share_of(df, "purpose", "loan_status")
        .select("purpose", "loan_status", "number_of_loans", "total_loans", "percentage")
        .transform(in_order("loan_status", F.desc("percentage"), "purpose"))
    )


def a24_home_ownership(df: DataFrame) -> DataFrame:
    """Loans per home ownership, share of all loans, average rate."""
    g = df.groupBy("home_ownership").agg(
        F.count(F.lit(1)).alias("number_of_loans"),
        F.sum("int_rate_bp").alias("_s"),
        F.count("int_rate_bp").alias("_n"),
    )
    return g.select(
        "home_ownership",
        "number_of_loans",
        pct("number_of_loans", "sum(number_of_loans) OVER ()").alias("percentage_to_total_loans"),
        avg_hundredths("_s", "_n").alias("avg_int_rate"),
    ).transform(in_order("home_ownership"))


def a25_owner_share_by_state(df: DataFrame) -> DataFrame:
    """Share of home owners among each state's loans (filter after the window)."""
    return (
        share_of(df, "addr_state", "home_ownership")
        .filter(F.col("home_ownership") == "OWN")
        .select("addr_state", "home_ownership", "total_loans", "number_of_loans", "percentage")
        .transform(in_order(F.desc("percentage"), "addr_state"))
    )


def a26_status_by_ownership(df: DataFrame) -> DataFrame:
    """Status share inside each home-ownership type."""
    return (
        share_of(df, "home_ownership", "loan_status")
        .select("home_ownership", "loan_status", "number_of_loans", "percentage")
        .transform(in_order("loan_status", F.desc("percentage"), "home_ownership"))
    )


def a27_credit_history(df: DataFrame) -> DataFrame:
    """Credit-history columns of every Charged Off loan (no shuffle)."""
    return df.filter(F.col("loan_status") == CHARGED_OFF).select(
        "loan_id", "loan_status", "delinq_2yrs", "pub_rec", "mths_since_last_delinq",
        "inq_last_6mths", "debt_settlement_flag", "total_acc",
    )


def r01_status_by_year(df: DataFrame) -> DataFrame:
    """Loans per issue year and status."""
    return (
        df.groupBy("issue_year", "loan_status").agg(F.count(F.lit(1)).alias("total_loans"))
        .transform(in_order("issue_year", "loan_status"))
    )


def r02_status_rate_by_year(df: DataFrame) -> DataFrame:
    """Status share inside each issue year."""
    return (
        share_of(df, "issue_year", "loan_status")
        .select("issue_year", "loan_status", "number_of_loans", "total_loans", "percentage")
        .transform(in_order("issue_year", "loan_status"))
    )


def r03_recovery_rate_by_year(df: DataFrame) -> DataFrame:
    """Recoveries as a share of funded money of Charged Off loans, per year."""
    return (
        df.filter(F.col("loan_status") == CHARGED_OFF)
        .groupBy("issue_year")
        .agg(
            F.count(F.lit(1)).alias("charged_off_loans"),
            F.sum("funded_amnt").alias("money_funded"),
            F.sum("recoveries").alias("recoveries"),
        )
        .withColumn("recovery_rate", pct("recoveries", "money_funded"))
        .transform(in_order("issue_year"))
    )


REPORTS = {
    "a20_income_bands": a20_income_bands,
    "a21_loans_by_purpose": a21_loans_by_purpose,
    "a22_avg_by_purpose": a22_avg_by_purpose,
    "a23_status_by_purpose": a23_status_by_purpose,
    "a24_home_ownership": a24_home_ownership,
    "a25_owner_share_by_state": a25_owner_share_by_state,
    "a26_status_by_ownership": a26_status_by_ownership,
    "a27_credit_history": a27_credit_history,
    "r01_status_by_year": r01_status_by_year,
    "r02_status_rate_by_year": r02_status_rate_by_year,
    "r03_recovery_rate_by_year": r03_recovery_rate_by_year,
}


def _income_case() -> str:
    # edges and labels written out, apart from functions.bands
    return (
        "CASE WHEN annual_inc IS NULL THEN 'Unknown' WHEN annual_inc > 360000 THEN 'Higher than $360k'"
        " WHEN annual_inc > 160000 THEN 'From $160K - $360K' WHEN annual_inc > 80000 THEN 'From $80K - $160K'"
        " WHEN annual_inc > 50000 THEN 'From $50K - $80K' WHEN annual_inc > 30000 THEN 'From $30K - $50K'"
        " ELSE 'Under $30K' END"
    )


def _share(group: str, sub: str, cols: str, where: str = "") -> str:
    return share_sql(group, sub, f"{cols}, {sql_pct('number_of_loans', 'total_loans')} AS percentage", where=where)


ORACLE = {
    "a20_income_bands": with_loans(
        share_sql(
            "group_of_income", "loan_status",
            "group_of_income, loan_status, total_loans, "
            f"{sql_pct('number_of_loans', 'total_loans')} AS percent_to_total_loans",
            source=f"(SELECT loan_status, {_income_case()} AS group_of_income FROM loans) AS income_banded",
        )),
    "a21_loans_by_purpose": with_loans(
        "SELECT purpose, count(*) AS number_of_loans FROM loans GROUP BY purpose"),
    "a22_avg_by_purpose": with_loans(
        "SELECT purpose, "
        f"CAST({ratio('sum(funded_amnt)', 'count(funded_amnt)', 100)} AS DOUBLE) / 100 AS avg_amount_of_money_funded, "
        f"{avg_h('sum(int_rate_bp)', 'count(int_rate_bp)')} AS avg_int_rate FROM loans GROUP BY purpose"),
    "a23_status_by_purpose": with_loans(_share(
        "purpose", "loan_status", "purpose, loan_status, number_of_loans, total_loans")),
    "a24_home_ownership": with_loans(
        "SELECT home_ownership, count(*) AS number_of_loans, "
        + sql_pct("count(*)", "(SELECT count(*) FROM loans)")
        + " AS percentage_to_total_loans, "
        + avg_h("sum(int_rate_bp)", "count(int_rate_bp)")
        + " AS avg_int_rate FROM loans GROUP BY home_ownership"),
    "a25_owner_share_by_state": with_loans(_share(
        "addr_state", "home_ownership", "addr_state, home_ownership, total_loans, number_of_loans",
        where="home_ownership = 'OWN'")),
    "a26_status_by_ownership": with_loans(_share(
        "home_ownership", "loan_status", "home_ownership, loan_status, number_of_loans")),
    "a27_credit_history": with_loans(
        "SELECT loan_id, loan_status, delinq_2yrs, pub_rec, mths_since_last_delinq, inq_last_6mths,"
        " debt_settlement_flag, total_acc FROM loans WHERE loan_status = 'Charged Off'"),
    "r01_status_by_year": with_loans(
        "SELECT issue_year, loan_status, count(*) AS total_loans FROM loans GROUP BY issue_year, loan_status"),
    "r02_status_rate_by_year": with_loans(_share(
        "issue_year", "loan_status", "issue_year, loan_status, number_of_loans, total_loans")),
    "r03_recovery_rate_by_year": with_loans(
        "SELECT issue_year, count(*) AS charged_off_loans, CAST(sum(funded_amnt) AS BIGINT) AS money_funded,"
        " CAST(sum(recoveries) AS BIGINT) AS recoveries, "
        f"{sql_pct('sum(recoveries)', 'sum(funded_amnt)')} AS recovery_rate"
        " FROM loans WHERE loan_status = 'Charged Off' GROUP BY issue_year"),
}
