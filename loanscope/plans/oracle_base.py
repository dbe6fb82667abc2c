"""DuckDB text of the loan table, the base of every oracle query.

Same numbers as sources.loan_view + operators.cleaning.with_derived, in
DuckDB dialect: ``//`` for integer division, ``strftime``/``try_strptime``
for month text, ``d + to_months(n)`` for month arithmetic, ``||`` for
NULL-propagating concatenation.  Sums are HUGEINT in DuckDB, so reports
cast them to BIGINT; ratios round by quotient and remainder, a route of
their own beside functions.arith.
"""

from __future__ import annotations

LOANS_CTES = """
lv_pay AS (
  SELECT l_orderkey,
         CAST(SUM(CAST(l_extendedprice AS DECIMAL(12,2))) * 100 AS BIGINT) // 1400 AS paid
  FROM lineitem GROUP BY l_orderkey),
lv_a AS (
  SELECT o_orderkey AS loan_id, o_custkey, CAST(o_orderdate AS DATE) AS od,
         CAST(floor(o_totalprice / 14) AS BIGINT) AS loan_amnt,
         542 + (o_orderkey * 37) % 1899 AS int_rate_bp,
         CASE WHEN o_orderkey % 4 = 0 THEN '60 months' ELSE '36 months' END AS term,
         CAST(CASE WHEN o_orderkey % 4 = 0 THEN 60 ELSE 36 END AS BIGINT) AS tn,
         CASE WHEN o_orderstatus = 'F' THEN 'Charged Off' ELSE 'Fully Paid' END AS loan_status,
         c_mktsegment AS purpose,
         CASE o_orderpriority WHEN '2-HIGH' THEN 'MORTGAGE' WHEN '3-MEDIUM' THEN 'OWN'
              WHEN '4-NOT SPECIFIED' THEN 'OTHER' ELSE 'RENT' END AS home_ownership,
         n_name AS addr_state,
         CASE WHEN o_custkey % 97 = 0 THEN NULL
              ELSE CAST(floor((c_acctbal + 1000) * 40) AS BIGINT) END AS annual_inc,
         coalesce(paid, 0) AS total_pymnt
  FROM orders
  LEFT JOIN lv_pay ON l_orderkey = o_orderkey
  JOIN customer ON o_custkey = c_custkey
  JOIN nation ON c_nationkey = n_nationkey),
lv_b AS (
  SELECT *,
         loan_amnt - CASE WHEN loan_id % 20 = 0 THEN loan_amnt // 4 ELSE 0 END AS funded_amnt,
         substr('ABCDEFG', CAST(1 + (int_rate_bp - 542) // 272 AS INT), 1) AS grade,
         CASE WHEN loan_id % 50 = 7 THEN NULL
              WHEN loan_status = 'Charged Off' THEN loan_id % tn
              WHEN loan_id % 101 = 0 THEN tn + 4
              WHEN loan_id % 3 = 0 THEN tn + 1
              ELSE tn + 1 - loan_id % 11 END AS mp
  FROM lv_a),
raw_loans AS (
  SELECT loan_id, loan_amnt, funded_amnt,
         funded_amnt - CASE WHEN loan_id % 10 = 0 THEN funded_amnt // 10 ELSE 0 END AS funded_amnt_inv,
         term, int_rate_bp, grade, grade || CAST(1 + loan_id % 5 AS VARCHAR) AS sub_grade,
         loan_status, purpose, home_ownership, addr_state, annual_inc,
         loan_id % 3000 AS dti_bp,
         strftime(od, '%b-%Y') AS issue_d,
         strftime(od + to_months(CAST(mp AS INT)), '%b-%Y') AS last_pymnt_d,
         strftime(od + to_months(CAST(-12 * (3 + o_custkey % 30) AS INT)), '%b-%Y') AS earliest_cr_line,
         (funded_amnt * 100 * (10000 + int_rate_bp)) // (10000 * tn) AS installment_c,
         total_pymnt,
         least(total_pymnt, funded_amnt) AS total_rec_prncp,
         greatest(total_pymnt - funded_amnt, 0) AS total_rec_int,
         CAST(CASE WHEN loan_id % 15 = 0 THEN 15 ELSE 0 END AS BIGINT) AS total_rec_late_fee,
         CASE WHEN loan_status = 'Charged Off' THEN total_pymnt // 10 ELSE 0 END AS recoveries,
         CASE WHEN loan_status = 'Charged Off' THEN total_pymnt // 50 ELSE 0 END AS collection_recovery_fee,
         lpad(CAST(o_custkey % 1000 AS VARCHAR), 3, '0') || 'xx' AS zip_code,
         loan_id % 4 AS delinq_2yrs, loan_id % 2 AS pub_rec,
         CASE WHEN loan_id % 3 = 0 THEN NULL ELSE loan_id % 120 END AS mths_since_last_delinq,
         loan_id % 9 AS inq_last_6mths,
         CASE WHEN loan_id % 200 = 0 THEN 'Y' ELSE 'N' END AS debt_settlement_flag,
         2 + loan_id % 80 AS total_acc,
         'n' AS pymnt_plan,
         CAST(CASE WHEN loan_id % 2 = 0 THEN 0 ELSE NULL END AS BIGINT) AS tax_liens,
         CAST(1 AS BIGINT) AS policy_code, CAST(0 AS BIGINT) AS acc_now_delinq, 'N' AS hardship_flag,
         CAST(0 AS BIGINT) AS delinq_amnt, 'Cash' AS disbursement_method, 'f' AS initial_list_status,
         CAST(0 AS BIGINT) AS collections_12_mths_ex_med, CAST(0 AS BIGINT) AS out_prncp,
         CAST(0 AS BIGINT) AS out_prncp_inv, 'Individual' AS application_type,
         CASE WHEN o_custkey % 13 = 0 THEN NULL
              ELSE 'employer ' || CAST(o_custkey % 400 AS VARCHAR) END AS emp_title
  FROM lv_b),
lv_d AS (
  SELECT *,
         CAST(try_strptime(issue_d, '%b-%Y') AS DATE) AS issue_date,
         CAST(try_strptime(last_pymnt_d, '%b-%Y') AS DATE) AS last_date,
         CAST(try_strptime(earliest_cr_line, '%b-%Y') AS DATE) AS cr_date,
         CASE WHEN regexp_extract(term, '(\\d+)', 1) <> ''
              THEN TRY_CAST(regexp_extract(term, '(\\d+)', 1) AS BIGINT) END AS term_months
  FROM raw_loans),
loans AS (
  SELECT loan_id, loan_amnt, funded_amnt, funded_amnt_inv, term, int_rate_bp, grade, sub_grade,
         loan_status, purpose, home_ownership, addr_state, annual_inc, dti_bp, issue_d, last_pymnt_d,
         strftime(cr_date, '%b-%Y') AS earliest_cr_line,
         installment_c, total_pymnt, total_rec_prncp, total_rec_int, total_rec_late_fee, recoveries,
         collection_recovery_fee, zip_code, delinq_2yrs, pub_rec, mths_since_last_delinq,
         inq_last_6mths, debt_settlement_flag, total_acc, pymnt_plan, tax_liens,
         policy_code, acc_now_delinq, hardship_flag, delinq_amnt, disbursement_method, initial_list_status,
         collections_12_mths_ex_med, out_prncp, out_prncp_inv, application_type, emp_title,
         CAST(year(issue_date) AS BIGINT) AS issue_year,
         CAST(year(cr_date) AS BIGINT) AS credit_opened_year,
         term_months,
         (year(last_date) * 12 + month(last_date)) - (year(issue_date) * 12 + month(issue_date)) AS months_made_payment,
         CASE WHEN term_months IS NULL OR last_date IS NULL THEN 'unknown'
              WHEN term_months + 1 = (year(last_date) * 12 + month(last_date)) - (year(issue_date) * 12 + month(issue_date)) THEN 'full'
              WHEN term_months + 1 > (year(last_date) * 12 + month(last_date)) - (year(issue_date) * 12 + month(issue_date)) THEN 'early'
              ELSE 'late' END AS payment_timing
  FROM lv_d)
"""

# Column list of the cleaned table (store.cleaned), for SELECT * reports.
CLEANED_SELECT = (
    "loan_id, loan_amnt, funded_amnt, funded_amnt_inv, term, int_rate_bp, grade, sub_grade, "
    "loan_status, purpose, home_ownership, addr_state, annual_inc, dti_bp, issue_d, issue_year, "
    "last_pymnt_d, earliest_cr_line, credit_opened_year, installment_c, total_pymnt, "
    "total_rec_prncp, total_rec_int, total_rec_late_fee, recoveries, collection_recovery_fee, "
    "delinq_2yrs, pub_rec, mths_since_last_delinq, inq_last_6mths, debt_settlement_flag, total_acc"
)


def ratio(num: str, den: str, scale: int) -> str:
    """round_half_up(num*scale/den), signed: quotient, and one more when the
    remainder is at least half the divisor."""
    n, d = f"CAST({num} AS HUGEINT)", f"CAST({den} AS HUGEINT)"
    top = f"(abs({n}) * {scale})"
    mag = f"({top} // abs({d}) + CASE WHEN 2 * ({top} % abs({d})) >= abs({d}) THEN 1 ELSE 0 END)"
    return (
        f"CASE WHEN {d} <> 0 THEN CAST(CASE WHEN ({n} < 0) <> ({d} < 0) "
        f"THEN -{mag} ELSE {mag} END AS BIGINT) END"
    )


def pct(num: str, den: str) -> str:
    """SQL of functions.arith.pct."""
    return f"CAST({ratio(num, den, 10000)} AS DOUBLE) / 100"


def avg_h(total: str, count: str) -> str:
    """SQL of functions.arith.avg_hundredths."""
    return f"CAST({ratio(total, count, 1)} AS DOUBLE) / 100"


def share_sql(group: str, sub: str, select: str, source: str = "loans", where: str = "") -> str:
    """Grouped share query: rows per (group, sub) as number_of_loans, rows
    per group as total_loans; ``select`` picks the output columns."""
    w = f" WHERE {where}" if where else ""
    return (
        f"WITH sub_counts AS (SELECT {group}, {sub}, count(*) AS number_of_loans FROM {source}"
        f" GROUP BY {group}, {sub}),"
        f" group_counts AS (SELECT {group}, CAST(sum(number_of_loans) AS BIGINT) AS total_loans"
        f" FROM sub_counts GROUP BY {group})"
        f" SELECT {select} FROM sub_counts JOIN group_counts USING ({group}){w}"
    )


def with_loans(sql: str) -> str:
    """Prefix a report with the loan CTEs; a report's own WITH is merged."""
    body = sql.strip()
    if body[:5].upper() == "WITH ":
        return "WITH " + LOANS_CTES.strip() + ",\n" + body[5:]
    return "WITH " + LOANS_CTES.strip() + "\n" + body
