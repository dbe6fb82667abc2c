"""The loan table built from the driver's order tables.

The reports run on one wide loan table (one row per loan).  On the test
data that table is derived from the order schema: one order is one loan,
its line items are the payments, its customer the borrower.  Amounts are
whole dollars, rates and dti integer basis points, installments integer
cents, so every engine computes the same numbers exactly.

Plan shape:
  lineitem --partial agg by l_orderkey--> Exchange --final agg--> pay
  orders LEFT JOIN pay ON orderkey          (sort-merge, hinted: pay keeps
                                             its hash partitioning on the key,
                                             only orders is shuffled to it)
  ... JOIN (customer JOIN nation) ON custkey (sort-merge, hinted: customers
                                             grow with the data too; nation is
                                             25 rows and the planner's size
                                             check broadcasts it)
Column pruning keeps the scans to the columns used.  Partial aggregation
collapses an order with very many line items before the shuffle; AQE's
skew-join split covers a customer holding a large share of the orders.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loanscope.functions.arith import idiv

# Columns of the raw loan table, in order (the imported file's layout).
RAW_COLUMNS = [
    "loan_id", "loan_amnt", "funded_amnt", "funded_amnt_inv", "term",
    "int_rate_bp", "grade", "sub_grade", "loan_status", "purpose",
    "home_ownership", "addr_state", "annual_inc", "dti_bp", "issue_d",
    "last_pymnt_d", "earliest_cr_line", "installment_c", "total_pymnt",
    "total_rec_prncp", "total_rec_int", "total_rec_late_fee", "recoveries",
    "collection_recovery_fee", "zip_code", "delinq_2yrs", "pub_rec",
    "mths_since_last_delinq", "inq_last_6mths", "debt_settlement_flag",
    "total_acc", "pymnt_plan", "tax_liens", "policy_code", "acc_now_delinq",
    "hardship_flag", "delinq_amnt", "disbursement_method", "initial_list_status",
    "collections_12_mths_ex_med", "out_prncp", "out_prncp_inv", "application_type",
    "emp_title",
]

# The columns that hold one value in the whole source file.
CONSTANTS = {
    "policy_code": 1,
    "acc_now_delinq": 0,
    "hardship_flag": "N",
    "delinq_amnt": 0,
    "disbursement_method": "Cash",
    "initial_list_status": "f",
    "collections_12_mths_ex_med": 0,
    "out_prncp": 0,
    "out_prncp_inv": 0,
    "application_type": "Individual",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One driver table of the scale-factor folder."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def loan_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw loan table (RAW_COLUMNS) over the driver tables at ``sf_dir``."""
    lineitem = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_extendedprice")
    orders = table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"
    )
    customer = table(spark, sf_dir, "customer").select(
        "c_custkey", "c_nationkey", "c_acctbal", "c_mktsegment"
    )
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")

    # Payments per loan: exact cents per line item (decimal rounding of the
    # price), summed as bigint - a fixed-width buffer, so the partial sums
    # stay in the generated hash aggregate - then whole dollars scaled 14x.
    cents = F.sum((F.col("l_extendedprice").cast("decimal(12,2)") * 100).cast("bigint"))
    pay = lineitem.groupBy("l_orderkey").agg(idiv(cents, F.lit(1400)).alias("paid"))

    borrower = customer.join(nation, customer.c_nationkey == nation.n_nationkey)

    # Both joins have sides that grow with the data (one pay row per order,
    # one customer per borrower), so they are sort-merge joins even when a
    # small input would fit a broadcast: the plan is the same at every
    # scale, and the wide per-loan projection after the joins runs in the
    # shuffle partitions instead of in the few tasks of one small scan.
    a = (
        orders.join(pay.hint("merge"), orders.o_orderkey == pay.l_orderkey, "left")
        .join(borrower.hint("merge"), orders.o_custkey == borrower.c_custkey)
    )

    # Per-loan columns as SQL expressions (one parser call per projection).
    a = a.selectExpr(
        "o_orderkey AS loan_id",
        "o_custkey",
        "CAST(o_orderdate AS DATE) AS od",
        "CAST(floor(o_totalprice / 14) AS BIGINT) AS loan_amnt",
        "542 + (o_orderkey * 37) % 1899 AS int_rate_bp",
        "CASE WHEN o_orderkey % 4 = 0 THEN '60 months' ELSE '36 months' END AS term",
        "CAST(CASE WHEN o_orderkey % 4 = 0 THEN 60 ELSE 36 END AS BIGINT) AS tn",
        "CASE WHEN o_orderstatus = 'F' THEN 'Charged Off' ELSE 'Fully Paid' END AS loan_status",
        "c_mktsegment AS purpose",
        "CASE o_orderpriority WHEN '2-HIGH' THEN 'MORTGAGE' WHEN '3-MEDIUM' THEN 'OWN'"
        " WHEN '4-NOT SPECIFIED' THEN 'OTHER' ELSE 'RENT' END AS home_ownership",
        "n_name AS addr_state",
        "CASE WHEN o_custkey % 97 = 0 THEN NULL"
        " ELSE CAST(floor((c_acctbal + 1000) * 40) AS BIGINT) END AS annual_inc",
        "coalesce(paid, CAST(0 AS BIGINT)) AS total_pymnt",
    )
    b = a.selectExpr(
        "*",
        "loan_amnt - CASE WHEN loan_id % 20 = 0 THEN loan_amnt div 4 ELSE 0 END AS funded_amnt",
        "substr('ABCDEFG', CAST(1 + (int_rate_bp - 542) div 272 AS INT), 1) AS grade",
        "CASE WHEN loan_id % 50 = 7 THEN NULL"
        " WHEN loan_status = 'Charged Off' THEN loan_id % tn"
        " WHEN loan_id % 101 = 0 THEN tn + 4"
        " WHEN loan_id % 3 = 0 THEN tn + 1"
        " ELSE tn + 1 - loan_id % 11 END AS mp",
    )
    out = b.selectExpr(
        "loan_id", "loan_amnt", "funded_amnt",
        "funded_amnt - CASE WHEN loan_id % 10 = 0 THEN funded_amnt div 10 ELSE 0 END AS funded_amnt_inv",
        "term", "int_rate_bp", "grade",
        "concat(grade, CAST(1 + loan_id % 5 AS STRING)) AS sub_grade",
        "loan_status", "purpose", "home_ownership", "addr_state", "annual_inc",
        "loan_id % 3000 AS dti_bp",
        "date_format(od, 'MMM-yyyy') AS issue_d",
        "date_format(add_months(od, CAST(mp AS INT)), 'MMM-yyyy') AS last_pymnt_d",
        "date_format(add_months(od, CAST(-12 * (3 + o_custkey % 30) AS INT)), 'MMM-yyyy') AS earliest_cr_line",
        "(funded_amnt * 100 * (10000 + int_rate_bp)) div (10000 * tn) AS installment_c",
        "total_pymnt",
        "least(total_pymnt, funded_amnt) AS total_rec_prncp",
        "greatest(total_pymnt - funded_amnt, 0) AS total_rec_int",
        "CAST(CASE WHEN loan_id % 15 = 0 THEN 15 ELSE 0 END AS BIGINT) AS total_rec_late_fee",
        "CASE WHEN loan_status = 'Charged Off' THEN total_pymnt div 10 ELSE 0 END AS recoveries",
        "CASE WHEN loan_status = 'Charged Off' THEN total_pymnt div 50 ELSE 0 END AS collection_recovery_fee",
        "concat(lpad(CAST(o_custkey % 1000 AS STRING), 3, '0'), 'xx') AS zip_code",
        "loan_id % 4 AS delinq_2yrs",
        "loan_id % 2 AS pub_rec",
        "CASE WHEN loan_id % 3 = 0 THEN NULL ELSE loan_id % 120 END AS mths_since_last_delinq",
        "loan_id % 9 AS inq_last_6mths",
        "CASE WHEN loan_id % 200 = 0 THEN 'Y' ELSE 'N' END AS debt_settlement_flag",
        "2 + loan_id % 80 AS total_acc",
        "'n' AS pymnt_plan",
        "CAST(CASE WHEN loan_id % 2 = 0 THEN 0 END AS BIGINT) AS tax_liens",
        *[f"'{v}' AS {c}" if isinstance(v, str) else f"{v}L AS {c}" for c, v in CONSTANTS.items()],
        "CASE WHEN o_custkey % 13 <> 0 THEN concat('employer ', CAST(o_custkey % 400 AS STRING)) END AS emp_title",
    )
    return out.select(*RAW_COLUMNS)
