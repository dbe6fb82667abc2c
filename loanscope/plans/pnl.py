"""Revenue, profit and loss reports (a28-a42).

Every P&L slice is ``operators.pnl.pnl`` over a filtered loan table: one
hash aggregate whose filter reaches the Parquet scan.  The per-purpose
reports replace the source's repeated ``SUM(..) OVER (PARTITION BY
purpose)`` windows by one aggregate.  The profit-gap report (a42) compares
all loans with Fully Paid loans per purpose in one pass with conditional
sums instead of joining two summaries of the same table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loanscope.functions.arith import hundredths, pct, scaled_ratio
from loanscope.operators.cleaning import CHARGED_OFF, EARLY, FULL, FULLY_PAID
from loanscope.operators.pnl import pnl
from loanscope.operators.shares import in_order
from loanscope.plans.oracle_base import CLEANED_SELECT, pct as sql_pct, ratio, with_loans
from loanscope.sources.store import cleaned



def a28_profit_total(df: DataFrame) -> DataFrame:
    """Money lent, payments received and profit over all loans."""
    return df.agg(
        F.sum("funded_amnt").alias("loans"),
        F.sum("total_pymnt").alias("revenue"),
        (F.sum("total_pymnt") - F.sum("funded_amnt")).alias("profit"),
    )


def a29_profit_by_year(df: DataFrame) -> DataFrame:
    """Money lent, payments and profit per issue year (with and without the
    collection fee)."""
    return (
        df.groupBy(F.col("issue_year").alias("year"))
        .agg(
            F.sum("funded_amnt").alias("loans"),
            F.sum("total_pymnt").alias("revenue"),
            (F.sum("total_pymnt") - F.sum("funded_amnt")).alias("profit"),
            (F.sum("total_pymnt") - F.sum("funded_amnt") - F.sum("collection_recovery_fee")).alias("profit_net_fee"),
        )
        .transform(in_order("year"))
    )


def a30_pnl_full_term(df: DataFrame) -> DataFrame:
    """Fully Paid loans that paid exactly their term (months = term + 1)."""
    return pnl(df.filter((F.col("loan_status") == FULLY_PAID) & (F.col("payment_timing") == FULL)))


def a31_pnl_early(df: DataFrame) -> DataFrame:
    """Fully Paid loans that paid before the term ended (months < term + 1)."""
    return pnl(df.filter((F.col("loan_status") == FULLY_PAID) & (F.col("payment_timing") == EARLY)))


def a32_short_lived(df: DataFrame) -> DataFrame:
    """Every loan with fewer than 3 months of payments: whole rows plus the
    month count (a filter on a stored column; no shuffle)."""
    rows = df.filter(F.col("months_made_payment") < 3)
    return rows.select(*cleaned(rows).columns, "months_made_payment")


def a33_recovered_loans(df: DataFrame, limit: int | None = 10) -> DataFrame:
    """The first ``limit`` (by loan_id; None: all) Charged Off loans that paid
    back more than funded."""
    rows = cleaned(
        df.filter((F.col("loan_status") == CHARGED_OFF) & (F.col("total_pymnt") > F.col("funded_amnt")))
    ).orderBy("loan_id")
    return rows if limit is None else rows.limit(limit)


def a34_count_shortfall(df: DataFrame) -> DataFrame:
    """Number of Charged Off loans that paid back less than was funded."""
    return df.filter((F.col("loan_status") == CHARGED_OFF) & (F.col("total_pymnt") < F.col("funded_amnt"))).agg(
        F.count(F.lit(1)).alias("number_of_loans")
    )


def a35_pnl_recovered(df: DataFrame) -> DataFrame:
    """P&L of Charged Off loans that paid back at least the funded amount."""
    return pnl(df.filter((F.col("loan_status") == CHARGED_OFF) & (F.col("total_pymnt") >= F.col("funded_amnt"))))


def a36_pnl_never_paid(df: DataFrame) -> DataFrame:
    """P&L of Charged Off loans without any payment."""
    return pnl(df.filter((F.col("loan_status") == CHARGED_OFF) & (F.col("total_pymnt") == 0)))


def a37_pnl_shortfall(df: DataFrame) -> DataFrame:
    """P&L of Charged Off loans that paid back less than was funded."""
    return pnl(df.filter((F.col("loan_status") == CHARGED_OFF) & (F.col("total_pymnt") < F.col("funded_amnt"))))


def a38_loss_by_purpose(df: DataFrame) -> DataFrame:
    """P&L of Charged Off loans per purpose, worst loss per loan first."""
    by_profit = in_order("avg_profit_per_loan", "purpose")
    return pnl(df.filter(F.col("loan_status") == CHARGED_OFF), "purpose").transform(by_profit)


def a39_profit_by_purpose_paid(df: DataFrame) -> DataFrame:
    """P&L of Fully Paid loans per purpose, best profit per loan first."""
    by_profit = in_order(F.desc("avg_profit_per_loan"), "purpose")
    return pnl(df.filter(F.col("loan_status") == FULLY_PAID), "purpose").transform(by_profit)


def a40_purpose_mix(df: DataFrame) -> DataFrame:
    """Purpose share inside each status beside the purpose share of all loans.

    One aggregate at (status, purpose); the three denominators are windows
    over those few rows.
    """
    g = df.groupBy("loan_status", "purpose").agg(F.count(F.lit(1)).alias("_n"))
    return g.select(
        "loan_status",
        "purpose",
        pct("_n", "sum(_n) OVER (PARTITION BY loan_status)").alias("percent_of_purpose_in_status"),
        pct("sum(_n) OVER (PARTITION BY purpose)", "sum(_n) OVER ()").alias("percent_of_purpose_in_total_loans"),
    ).transform(in_order("loan_status", "purpose"))


def a41_profit_by_purpose_all(df: DataFrame) -> DataFrame:
    """P&L of all loans per purpose, best profit per loan first."""
    return pnl(df, "purpose").transform(in_order(F.desc("avg_profit_per_loan"), "purpose"))


def _gap_columns(g: DataFrame) -> DataFrame:
    """Final columns of the profit-gap report from per-purpose sums."""
    cents = g.select(
        "purpose",
        "total_profit_all_status",
        "total_profit_of_fully_paid_loans",
        scaled_ratio("total_profit_all_status", "_n_all", 100).alias("_avg_all_c"),
        scaled_ratio("total_profit_of_fully_paid_loans", "_n_fp", 100).alias("_avg_fp_c"),
    )
    return cents.select(
        "purpose",
        "total_profit_all_status",
        hundredths("_avg_all_c").alias("avg_profit_per_loan_all_status"),
        "total_profit_of_fully_paid_loans",
        hundredths("_avg_fp_c").alias("avg_profit_per_loan_of_fully_paid_loans"),
        pct("total_profit_of_fully_paid_loans - total_profit_all_status", "total_profit_of_fully_paid_loans")
        .alias("difference_percent_in_profit"),
        pct("_avg_fp_c - _avg_all_c", "_avg_fp_c").alias("difference_percent_in_avg_profit_per_loan"),
    )


def pnl_gap(df: DataFrame, by: str = "purpose") -> DataFrame:
    """a42 for any grouping column: all loans vs Fully Paid loans, ordered by
    a range sort (the column may have very many values)."""
    measures = ["total_pymnt", "funded_amnt", "collection_recovery_fee", "loan_status"]
    keyed = df.select(F.col(by).alias("purpose"), *measures)
    return _gap(keyed).orderBy("purpose").withColumnRenamed("purpose", by)


def a42_profit_gap(df: DataFrame) -> DataFrame:
    """Profit of all loans vs Fully Paid loans per purpose, and the gap in %.

    One aggregate with conditional sums.  Averages per loan are rounded to
    cents first (the source rounds them to 2 decimals before comparing), so
    the gap is exact integer arithmetic.  Purposes without Fully Paid loans
    and the NULL purpose are left out, as the source's inner join leaves them
    out.
    """
    return _gap(df).transform(in_order("purpose"))


def _gap(df: DataFrame) -> DataFrame:
    net = F.col("total_pymnt") - F.col("funded_amnt") - F.col("collection_recovery_fee")
    fp = F.col("loan_status") == FULLY_PAID
    g = df.filter(F.col("purpose").isNotNull()).groupBy("purpose").agg(
        F.sum(net).alias("total_profit_all_status"),
        F.count(F.lit(1)).alias("_n_all"),
        F.sum(F.when(fp, net)).alias("total_profit_of_fully_paid_loans"),
        F.count(F.when(fp, F.lit(1))).alias("_n_fp"),
    )
    return _gap_columns(g.filter(F.col("_n_fp") > 0))


def op_join_profit_gap(df: DataFrame) -> DataFrame:
    """a42 as the source writes it: two per-purpose summaries joined on
    purpose (J01).  Both sides are aggregates with one row per purpose, so
    AQE turns the join into a broadcast from the measured sizes."""
    net = F.col("total_pymnt") - F.col("funded_amnt") - F.col("collection_recovery_fee")
    all_s = df.groupBy("purpose").agg(
        F.sum(net).alias("total_profit_all_status"), F.count(F.lit(1)).alias("_n_all")
    )
    fp_s = df.filter(F.col("loan_status") == FULLY_PAID).groupBy("purpose").agg(
        F.sum(net).alias("total_profit_of_fully_paid_loans"), F.count(F.lit(1)).alias("_n_fp")
    )
    return _gap_columns(all_s.join(fp_s, "purpose")).transform(in_order("purpose"))


REPORTS = {
    "a28_profit_total": a28_profit_total,
    "a29_profit_by_year": a29_profit_by_year,
    "a30_pnl_full_term": a30_pnl_full_term,
    "a31_pnl_early": a31_pnl_early,
    "a32_short_lived": a32_short_lived,
    "a33_recovered_loans": a33_recovered_loans,
    "a34_count_shortfall": a34_count_shortfall,
    "a35_pnl_recovered": a35_pnl_recovered,
    "a36_pnl_never_paid": a36_pnl_never_paid,
    "a37_pnl_shortfall": a37_pnl_shortfall,
    "a38_loss_by_purpose": a38_loss_by_purpose,
    "a39_profit_by_purpose_paid": a39_profit_by_purpose_paid,
    "a40_purpose_mix": a40_purpose_mix,
    "a41_profit_by_purpose_all": a41_profit_by_purpose_all,
    "a42_profit_gap": a42_profit_gap,
    "op_join_profit_gap": op_join_profit_gap,
}


def _pnl_sql(where: str = "", by: str = "") -> str:
    sel_by = f"{by}, " if by else ""
    grp = f" GROUP BY {by}" if by else ""
    w = f" WHERE {where}" if where else ""
    net = "sum(total_pymnt) - sum(funded_amnt) - sum(collection_recovery_fee)"
    return with_loans(
        f"SELECT {sel_by}count(loan_id) AS number_of_loans,"
        " CAST(sum(funded_amnt) AS BIGINT) AS loans_amount,"
        " CAST(sum(term_months * installment_c) AS DOUBLE) / 100 AS supposed_revenue,"
        " CAST(sum(total_pymnt) AS BIGINT) AS payment,"
        " CAST(sum(total_rec_prncp) AS BIGINT) AS principal,"
        " CAST(sum(total_rec_int) AS BIGINT) AS interests,"
        " CAST(sum(total_rec_late_fee) AS BIGINT) AS late_fee,"
        " CAST(sum(recoveries) AS BIGINT) AS recoveries,"
        " CAST(sum(collection_recovery_fee) AS BIGINT) AS recoveries_fee,"
        " CAST(sum(total_pymnt) - sum(funded_amnt) AS BIGINT) AS profit,"
        f" CAST({net} AS BIGINT) AS profit_net_fee,"
        f" CAST({ratio(net, 'count(loan_id)', 100)} AS DOUBLE) / 100 AS avg_profit_per_loan"
        f" FROM loans{w}{grp}"
    )


_GAP_CTES = """
WITH every_loan AS (
  SELECT purpose,
         sum(total_pymnt) - sum(funded_amnt) - sum(collection_recovery_fee) AS total_profit_all_status,
         count(*) AS n_all
  FROM loans GROUP BY purpose),
paid_loan AS (
  SELECT purpose,
         sum(total_pymnt) - sum(funded_amnt) - sum(collection_recovery_fee) AS total_profit,
         count(*) AS n_fp
  FROM loans WHERE loan_status = 'Fully Paid' GROUP BY purpose),
gap AS (
  SELECT every_loan.purpose, total_profit_all_status, total_profit,
         {avg_all} AS avg_all_c, {avg_fp} AS avg_fp_c
  FROM every_loan JOIN paid_loan ON every_loan.purpose = paid_loan.purpose)
SELECT purpose,
       CAST(total_profit_all_status AS BIGINT) AS total_profit_all_status,
       CAST(avg_all_c AS DOUBLE) / 100 AS avg_profit_per_loan_all_status,
       CAST(total_profit AS BIGINT) AS total_profit_of_fully_paid_loans,
       CAST(avg_fp_c AS DOUBLE) / 100 AS avg_profit_per_loan_of_fully_paid_loans,
       {d_profit} AS difference_percent_in_profit,
       {d_avg} AS difference_percent_in_avg_profit_per_loan
FROM gap
""".format(
    avg_all=ratio("total_profit_all_status", "n_all", 100),
    avg_fp=ratio("total_profit", "n_fp", 100),
    d_profit=sql_pct("total_profit - total_profit_all_status", "total_profit"),
    d_avg=sql_pct("avg_fp_c - avg_all_c", "avg_fp_c"),
)

ORACLE = {
    "a28_profit_total": with_loans(
        "SELECT CAST(sum(funded_amnt) AS BIGINT) AS loans, CAST(sum(total_pymnt) AS BIGINT) AS revenue,"
        " CAST(sum(total_pymnt) - sum(funded_amnt) AS BIGINT) AS profit FROM loans"),
    "a29_profit_by_year": with_loans(
        "SELECT issue_year AS year, CAST(sum(funded_amnt) AS BIGINT) AS loans,"
        " CAST(sum(total_pymnt) AS BIGINT) AS revenue,"
        " CAST(sum(total_pymnt) - sum(funded_amnt) AS BIGINT) AS profit,"
        " CAST(sum(total_pymnt) - sum(funded_amnt) - sum(collection_recovery_fee) AS BIGINT) AS profit_net_fee"
        " FROM loans GROUP BY issue_year"),
    "a30_pnl_full_term": _pnl_sql("term_months + 1 = months_made_payment AND loan_status = 'Fully Paid'"),
    "a31_pnl_early": _pnl_sql("term_months + 1 > months_made_payment AND loan_status = 'Fully Paid'"),
    "a32_short_lived": with_loans(
        f"SELECT {CLEANED_SELECT}, months_made_payment FROM loans WHERE months_made_payment < 3"),
    "a33_recovered_loans": with_loans(
        f"SELECT {CLEANED_SELECT} FROM loans WHERE loan_status = 'Charged Off' AND total_pymnt > funded_amnt"
        " ORDER BY loan_id LIMIT 10"),
    "a34_count_shortfall": with_loans(
        "SELECT count(loan_id) AS number_of_loans FROM loans"
        " WHERE loan_status = 'Charged Off' AND total_pymnt < funded_amnt"),
    "a35_pnl_recovered": _pnl_sql("loan_status = 'Charged Off' AND total_pymnt >= funded_amnt"),
    "a36_pnl_never_paid": _pnl_sql("loan_status = 'Charged Off' AND total_pymnt = 0"),
    "a37_pnl_shortfall": _pnl_sql("loan_status = 'Charged Off' AND total_pymnt < funded_amnt"),
    "a38_loss_by_purpose": _pnl_sql("loan_status = 'Charged Off'", "purpose"),
    "a39_profit_by_purpose_paid": _pnl_sql("loan_status = 'Fully Paid'", "purpose"),
    "a40_purpose_mix": with_loans(
        "WITH cell AS (SELECT loan_status, purpose, count(*) AS n FROM loans GROUP BY loan_status, purpose),"
        " per_status AS (SELECT loan_status, sum(n) AS n FROM cell GROUP BY loan_status),"
        " per_purpose AS (SELECT purpose, sum(n) AS n FROM cell GROUP BY purpose)"
        " SELECT cell.loan_status, cell.purpose, "
        + sql_pct("cell.n", "per_status.n") + " AS percent_of_purpose_in_status, "
        + sql_pct("per_purpose.n", "(SELECT count(*) FROM loans)") + " AS percent_of_purpose_in_total_loans"
        " FROM cell JOIN per_status ON cell.loan_status = per_status.loan_status"
        " JOIN per_purpose ON cell.purpose = per_purpose.purpose"),
    "a41_profit_by_purpose_all": _pnl_sql("", "purpose"),
    "a42_profit_gap": with_loans(_GAP_CTES),
    "op_join_profit_gap": with_loans(_GAP_CTES),
}

