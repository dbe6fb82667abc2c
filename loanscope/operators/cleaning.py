"""Cleaning job: the wrangling statements of the source as column operations.

The source alters its one table in place (generated year columns, an
UPDATE that re-prints a month column, two rounds of DROP COLUMN, a new key
column moved first).  Here each step is a pure DataFrame -> DataFrame
function; the cleaned table is written once (sources.store) and read by
every report.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loanscope.functions.months import format_month, months_between_whole, parse_month, term_months

# The columns the source drops, in its order.  The first
# list holds constant (or redundant) columns, the second free text and zip.
FIRST_DROP = [
    "policy_code", "acc_now_delinq", "hardship_flag", "tax_liens",
    "delinq_amnt", "disbursement_method", "pymnt_plan", "initial_list_status",
    "collections_12_mths_ex_med", "out_prncp", "out_prncp_inv",
    "application_type",
]
SECOND_DROP = ["emp_title", "zip_code"]

# Loan status literals.
FULLY_PAID = "Fully Paid"
CHARGED_OFF = "Charged Off"

# Payment timing of a loan, from months of payment against its term:
# months == term + 1 is a full-term loan, fewer is early, more is late.
FULL, EARLY, LATE, UNKNOWN = "full", "early", "late", "unknown"


def blank_to_null(df: DataFrame, cols) -> DataFrame:
    """Empty or all-blank text becomes NULL; the row is kept."""
    return df.withColumns({
        c: F.when(F.trim(F.col(c)) == "", F.lit(None).cast("string")).otherwise(F.col(c))
        for c in cols
    })


def _with_dates(df: DataFrame, *texts: str) -> DataFrame:
    """Parse month-text columns into ``_<name>_date`` columns.

    Each text is parsed once into a column that the derived columns then
    reference (an attribute, so the parse is not repeated in every
    expression that uses it).  All month texts follow one rule: four-digit
    years, or two digits widened by the pivot.
    """
    return df.withColumns({f"_{t}_date": parse_month(t) for t in texts})


def _year_columns() -> dict:
    return {
        "issue_year": F.year("_issue_d_date").cast("bigint"),
        "earliest_cr_line": format_month("_earliest_cr_line_date"),
        "credit_opened_year": F.year("_earliest_cr_line_date").cast("bigint"),
    }


def with_years(df: DataFrame) -> DataFrame:
    """issue_year, normalised earliest_cr_line and credit_opened_year."""
    dated = _with_dates(df, "issue_d", "earliest_cr_line")
    return dated.withColumns(_year_columns()).drop("_issue_d_date", "_earliest_cr_line_date")


def payment_timing(term_m: Column, months_paid: Column) -> Column:
    """full / early / late / unknown from term months and months of payment."""
    return (
        F.when(term_m.isNull() | months_paid.isNull(), F.lit(UNKNOWN))
        .when(term_m + 1 == months_paid, F.lit(FULL))
        .when(term_m + 1 > months_paid, F.lit(EARLY))
        .otherwise(F.lit(LATE))
    )


def with_derived(df: DataFrame) -> DataFrame:
    """All columns the reports derive from the raw table, computed once:
    issue_year, credit_opened_year (with earliest_cr_line normalised),
    term_months, months_made_payment and payment_timing."""
    dated = _with_dates(df, "issue_d", "last_pymnt_d", "earliest_cr_line")
    out = dated.withColumns({
        **_year_columns(),
        "term_months": term_months("term"),
        "months_made_payment": months_between_whole("_issue_d_date", "_last_pymnt_d_date"),
    })
    return out.withColumn(
        "payment_timing", payment_timing(F.col("term_months"), F.col("months_made_payment"))
    ).drop("_issue_d_date", "_last_pymnt_d_date", "_earliest_cr_line_date")


def standardise_units(df: DataFrame) -> DataFrame:
    """A loan file in its original units -> the loan table's units.

    ``int_rate`` (``'10.65%'`` or 10.65) becomes ``int_rate_bp`` (1065),
    ``dti`` (27.65) becomes ``dti_bp`` (2765) and ``installment`` (162.87
    dollars) becomes ``installment_c`` (16287 cents), each rounded half-up
    from its decimal text; columns that are absent are left alone.  A blank
    cell is NULL; any other text that is no number (``12,5``) fails the job.
    Money columns may keep cents (decimal): the reports' ratios are exact for
    fractional sums too.
    """
    targets = {"int_rate": "int_rate_bp", "dti": "dti_bp", "installment": "installment_c"}
    out = df
    for src, dst in targets.items():
        if src in df.columns:
            text = F.trim(F.col(src).cast("string"))
            number = (F.regexp_replace(text, "%$", "") if src == "int_rate" else text).try_cast("decimal(18,4)")
            bad = F.raise_error(F.concat(F.lit(f"column {src}: not a number: "), text)).cast("decimal(18,4)")
            exact = F.when(number.isNull() & (text != ""), bad).otherwise(number)
            out = out.withColumn(dst, F.round(exact * 100, 0).cast("bigint")).drop(src)
    return out


def drop_columns(df: DataFrame, names) -> DataFrame:
    """DROP COLUMN for the names present (absent names are ignored)."""
    return df.drop(*names)


def id_first(df: DataFrame, id_col: str = "loan_id") -> DataFrame:
    """Move the id column first."""
    return df.select(id_col, *[c for c in df.columns if c != id_col])


def place_after(df: DataFrame, col: str, after: str) -> DataFrame:
    """Move ``col`` right after ``after`` (ALTER ... AFTER)."""
    rest = [c for c in df.columns if c != col]
    i = rest.index(after) + 1
    return df.select(*rest[:i], col, *rest[i:])
