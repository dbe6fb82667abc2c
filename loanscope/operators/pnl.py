"""Profit-and-loss measures over any slice of the loan table.

All measures are sums, so ``pnl(df, *by)`` is one hash aggregate with
partial aggregation.  Two profit definitions exist in the source: payments
minus funded amount, and the same net of the collection-recovery fee; both
are returned (``profit``, ``profit_net_fee``).  ``supposed_revenue`` is
SUM(term * installment): installments are in cents, so it is exact.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loanscope.functions.arith import avg2, hundredths

PNL_COLUMNS = [
    "number_of_loans", "loans_amount", "supposed_revenue", "payment", "principal",
    "interests", "late_fee", "recoveries", "recoveries_fee", "profit",
    "profit_net_fee", "avg_profit_per_loan",
]


def pnl(df: DataFrame, *by: str) -> DataFrame:
    """P&L measures (PNL_COLUMNS) per group of ``by`` (one global row without
    keys)."""
    g = df.groupBy(*by) if by else df.groupBy()
    sums = g.agg(*[F.expr(e) for e in [
        "count(1) AS number_of_loans",
        "sum(funded_amnt) AS loans_amount",
        "sum(term_months * installment_c) AS _supposed_c",
        "sum(total_pymnt) AS payment",
        "sum(total_rec_prncp) AS principal",
        "sum(total_rec_int) AS interests",
        "sum(total_rec_late_fee) AS late_fee",
        "sum(recoveries) AS recoveries",
        "sum(collection_recovery_fee) AS recoveries_fee",
    ]])
    out = sums.select(
        *by,
        "number_of_loans",
        "loans_amount",
        hundredths("_supposed_c").alias("supposed_revenue"),
        "payment",
        "principal",
        "interests",
        "late_fee",
        "recoveries",
        "recoveries_fee",
        F.expr("payment - loans_amount").alias("profit"),
        F.expr("payment - loans_amount - recoveries_fee").alias("profit_net_fee"),
        avg2("payment - loans_amount - recoveries_fee", "number_of_loans").alias("avg_profit_per_loan"),
    )
    return out
