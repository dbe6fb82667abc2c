"""The cleaning statements as reports over the whole loan table.

The loan view has clean text, so two keys first derive dirty input with a
deterministic rule over every row (the same rule appears in the oracle):
w_blank_to_null blanks out some purposes, w_years cuts some issue and
credit-line months to two-digit years.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loanscope.operators.cleaning import FULLY_PAID, blank_to_null, with_years
from loanscope.operators.profile import composite_key, constant_columns, constant_columns_of_files, duplicate_keys
from loanscope.operators.row_id import with_row_id
from loanscope.operators.shares import in_order
from loanscope.plans.oracle_base import CLEANED_SELECT, with_loans
from loanscope.session import require_shared_dir
from loanscope.sources.loan_csv import import_loans
from loanscope.sources.published import append_with_ids, publish, read_appended, read_published
from loanscope.sources.loan_view import RAW_COLUMNS
from loanscope.sources.store import cleaned, written_path


def dirty_purpose(df: DataFrame) -> DataFrame:
    """Blank-cell input: '' for loan_id % 9 = 0, '  ' for loan_id % 9 = 1."""
    r = F.col("loan_id") % 9
    return df.withColumn(
        "purpose", F.when(r == 0, F.lit("")).when(r == 1, F.lit("  ")).otherwise(F.col("purpose"))
    )


def dirty_credit_line(df: DataFrame) -> DataFrame:
    """Two-digit-year input: 'Dec-1999' -> 'Dec-99' for loan_id % 13 = 0."""
    t = F.col("earliest_cr_line")
    return df.withColumn(
        "earliest_cr_line",
        F.when(F.col("loan_id") % 13 == 0, F.concat(F.substring(t, 1, 4), F.substring(t, 7, 2))).otherwise(t),
    )


def dirty_issue(df: DataFrame) -> DataFrame:
    """Two-digit issue years for loan_id % 17 = 0."""
    t = F.col("issue_d")
    return df.withColumn(
        "issue_d",
        F.when(F.col("loan_id") % 17 == 0, F.concat(F.substring(t, 1, 4), F.substring(t, 7, 2))).otherwise(t),
    )


def w_blank_to_null(df: DataFrame) -> DataFrame:
    """Blank purposes become NULL; every row is kept."""
    return blank_to_null(dirty_purpose(df), ["purpose"]).select("loan_id", "purpose")


def w_years(df: DataFrame) -> DataFrame:
    """issue_year, normalised earliest_cr_line, credit_opened_year."""
    raw = dirty_issue(dirty_credit_line(df.select("loan_id", "issue_d", "earliest_cr_line")))
    return with_years(raw).select("loan_id", "issue_d", "issue_year", "earliest_cr_line", "credit_opened_year")


def w_constant_columns(df: DataFrame) -> DataFrame:
    """Profile of every raw column: which ones hold a single value.  Of the
    written loan table, number columns are profiled from the file footers."""
    path = written_path(df)
    if path is None:
        found = constant_columns(df.select(*RAW_COLUMNS))
    else:
        found = constant_columns_of_files(df.sparkSession, path, RAW_COLUMNS)
    return found.transform(in_order("column_name"))


def w_clean(df: DataFrame) -> DataFrame:
    """The cleaned table: 12 + 2 columns dropped, loan_id first."""
    return cleaned(df)


def w_duplicate_keys(df: DataFrame) -> DataFrame:
    """Composite keys occurring more than once (the source found none)."""
    return duplicate_keys(df.select(composite_key().alias("primkey")), "primkey")


def reimported(df: DataFrame) -> DataFrame:
    """The table after an import that ran again for loan_id % 100 = 3."""
    return df.unionByName(df.filter(F.col("loan_id") % 100 == 3))


def w_duplicate_keys_reimport(df: DataFrame) -> DataFrame:
    """Composite keys occurring more than once after a partial re-import."""
    return w_duplicate_keys(reimported(df))


def w_duplicate_keys_two_digit(df: DataFrame) -> DataFrame:
    """Composite keys occurring more than once when the second import spells
    issue and credit-line months with two-digit years (loan_id % 17 = 0 and
    % 13 = 0): another spelling of a month is the same key."""
    again = dirty_issue(dirty_credit_line(df.filter(F.col("loan_id") % 100 == 3)))
    return w_duplicate_keys(df.unionByName(again))


IMPORT_HEADER = "loan_id,purpose,emp_title,annual_inc"


def dirty_file(df: DataFrame) -> DataFrame:
    """Lines of a loan file (one text column), some of them bad: by loan_id % 40
    a cell is missing (1), the income is no number (2), the title holds a
    separator, quotes and a line break inside quotes (3), the purpose is quoted
    (4) or a cell is too many (5)."""
    r = F.col("loan_id") % 40
    income = F.coalesce(F.col("annual_inc").cast("string"), F.lit("NULL"))
    cells = [
        F.col("loan_id").cast("string"),
        F.when(r == 4, F.concat(F.lit('"'), F.coalesce("purpose", F.lit("")), F.lit('"')))
        .otherwise(F.coalesce("purpose", F.lit("NULL"))),
        F.when(r == 3, F.lit('"chief, ""night""\nshift"')).otherwise(F.coalesce("emp_title", F.lit("NULL"))),
        F.when(r == 1, None).when(r == 2, F.concat(income, F.lit("O"))).otherwise(income),
        F.when(r == 5, F.lit("extra")),
    ]
    line = F.concat_ws(",", *cells)  # leaves out what is null
    # one file per task, each beginning with the header
    first = F.shiftleft(F.spark_partition_id().cast("bigint"), 33) == F.monotonically_increasing_id()
    return df.select(line.alias("line")).select(
        F.when(first, F.concat(F.lit(IMPORT_HEADER + "\n"), "line")).otherwise(F.col("line")).alias("line"))


def w_import(df: DataFrame) -> DataFrame:
    """The loan table written as a file with bad records and imported again:
    every record is loaded or rejected with a column and a reason."""
    path = f"{require_shared_dir(df.sparkSession).rstrip('/')}/loanscope-import-{uuid.uuid4().hex}"
    dirty_file(df).write.text(path)
    schema = T.StructType([T.StructField("loan_id", T.LongType()), T.StructField("purpose", T.StringType()),
                           T.StructField("emp_title", T.StringType()), T.StructField("annual_inc", T.LongType())])
    loaded, rejects = import_loans(df.sparkSession, path, schema)
    none = F.lit(None).cast("string")
    given = F.substring_index("text", ",", 1).cast("bigint").alias("loan_id")
    loaded = loaded.withColumn("annual_inc", F.col("annual_inc").cast("double"))
    return loaded.select("*", F.lit(False).alias("rejected"), none.alias("bad_column"), none.alias("reason")).unionByName(
        rejects.select(given, none.alias("purpose"), none.alias("emp_title"), none.cast("double").alias("annual_inc"),
                       F.lit(True).alias("rejected"), F.col("column").alias("bad_column"), "reason"))


def w_row_id(df: DataFrame) -> DataFrame:
    """Dense loan ids 1..N in loan_id order, without a single partition."""
    return with_row_id(df.select("loan_id"), "loan_id", id_col="row_id")


def w_appended_ids(df: DataFrame) -> DataFrame:
    """Ids of a table that grows: the loans with loan_id % 3 > 0 are appended
    first, then the others; ids continue from the stored mark."""
    path = f"{require_shared_dir(df.sparkSession).rstrip('/')}/loanscope-appended-{uuid.uuid4().hex}"
    rows = df.select(F.col("loan_id").alias("source_id"), "issue_year", "funded_amnt")
    for part in (rows.filter("source_id % 3 > 0"), rows.filter("source_id % 3 = 0")):
        append_with_ids(part, path, "source_id")
    return read_appended(df.sparkSession, path)


def w_published(df: DataFrame) -> DataFrame:
    """The clean table after two exports to one published table: first the
    Fully Paid loans, then all; readers see the last version only."""
    path = f"{require_shared_dir(df.sparkSession).rstrip('/')}/loanscope-published-{uuid.uuid4().hex}"
    rows = df.select("loan_id", "loan_status", "funded_amnt")
    publish(rows.filter(F.col("loan_status") == FULLY_PAID), path)
    publish(rows, path)
    return read_published(df.sparkSession, path)


REPORTS = {
    "w_years": w_years,
    "w_blank_to_null": w_blank_to_null,
    "w_constant_columns": w_constant_columns,
    "w_clean": w_clean,
    "w_duplicate_keys": w_duplicate_keys,
    "w_duplicate_keys_reimport": w_duplicate_keys_reimport,
    "w_duplicate_keys_two_digit": w_duplicate_keys_two_digit,
    "w_import": w_import,
    "w_row_id": w_row_id,
    "w_appended_ids": w_appended_ids,
    "w_published": w_published,
}


def _constant_sql() -> str:
    parts = [
        f"SELECT '{c}' AS column_name, count({c}) AS non_null,"
        f" CAST(min({c}) AS VARCHAR) AS min_value, CAST(max({c}) AS VARCHAR) AS max_value FROM loans"
        for c in RAW_COLUMNS
    ]
    return with_loans(
        "SELECT *, (non_null > 0 AND min_value = max_value) AS is_constant FROM ("
        + " UNION ALL ".join(parts) + ") t"
    )


def _two_digit_text(col: str, every: int) -> str:
    return f"CASE WHEN loan_id % {every} = 0 THEN left({col}, 4) || substr({col}, 7, 2) ELSE {col} END"


def _month_date(e: str) -> str:
    wide = (
        f"CASE WHEN regexp_full_match({e}, '[A-Za-z]{{3}}-[0-9]{{2}}')"
        f" THEN left({e}, 4) || CAST(CASE WHEN CAST(right({e}, 2) AS INT) >= 70 THEN 1900 ELSE 2000 END"
        f" + CAST(right({e}, 2) AS INT) AS VARCHAR) ELSE {e} END"
    )
    return f"CAST(try_strptime({wide}, '%b-%Y') AS DATE)"


_ROUND_DTI = "(dti_bp + 50) // 100"


def _duplicates_sql(source: str, month=lambda c: f"CAST(try_strptime({c}, '%b-%Y') AS DATE)") -> str:
    return with_loans(
        "SELECT primkey, count(primkey) AS occurrences FROM ("
        f" SELECT left(zip_code, 3) || '-' || strftime({month('earliest_cr_line')}, '%m%y')"
        " || '-' || left(home_ownership, 1) || '-' || sub_grade || '-' || upper(left(purpose, 3)) || '-'"
        f" || CAST({_ROUND_DTI} AS VARCHAR) || '-' || CAST(funded_amnt AS VARCHAR) || '-'"
        f" || strftime({month('issue_d')}, '%m%y') AS primkey FROM {source}) keyed"
        " GROUP BY primkey HAVING count(primkey) > 1")


ORACLE = {
    "w_blank_to_null": with_loans(
        "SELECT loan_id, CASE WHEN trim(p) = '' THEN NULL ELSE p END AS purpose FROM ("
        " SELECT loan_id, CASE WHEN loan_id % 9 = 0 THEN '' WHEN loan_id % 9 = 1 THEN '  ' ELSE purpose END AS p"
        " FROM loans) t"),
    "w_years": with_loans(
        "SELECT loan_id, i AS issue_d, CAST(year(di) AS BIGINT) AS issue_year,"
        " strftime(d, '%b-%Y') AS earliest_cr_line, CAST(year(d) AS BIGINT) AS credit_opened_year FROM ("
        f" SELECT loan_id, i, {_month_date('i')} AS di, {_month_date('e')} AS d FROM ("
        f"  SELECT loan_id, {_two_digit_text('issue_d', 17)} AS i,"
        f" {_two_digit_text('earliest_cr_line', 13)} AS e FROM loans) t1) t2"),
    "w_constant_columns": _constant_sql(),
    "w_clean": with_loans(f"SELECT {CLEANED_SELECT} FROM loans"),
    "w_duplicate_keys": _duplicates_sql("loans"),
    "w_duplicate_keys_reimport": _duplicates_sql(
        "(SELECT * FROM loans UNION ALL SELECT * FROM loans WHERE loan_id % 100 = 3) again"),
    "w_duplicate_keys_two_digit": _duplicates_sql(
        "(SELECT * FROM loans UNION ALL SELECT * REPLACE ("
        f"{_two_digit_text('issue_d', 17)} AS issue_d, {_two_digit_text('earliest_cr_line', 13)} AS earliest_cr_line)"
        " FROM loans WHERE loan_id % 100 = 3) again", _month_date),
    "w_import": with_loans(
        "SELECT loan_id, CASE WHEN NOT bad THEN purpose END AS purpose,"
        " CASE WHEN NOT bad THEN CASE WHEN r = 3 THEN 'chief, \"night\"' || chr(10) || 'shift' ELSE emp_title END END"
        " AS emp_title, CAST(CASE WHEN NOT bad THEN annual_inc END AS DOUBLE) AS annual_inc, bad AS rejected,"
        " CASE WHEN r = 2 THEN 'annual_inc' END AS bad_column,"
        " CASE WHEN r IN (1, 5) THEN 'not 4 cells'"
        " WHEN r = 2 THEN 'not a bigint: ' || coalesce(CAST(annual_inc AS VARCHAR), 'NULL') || 'O' END AS reason"
        " FROM (SELECT *, loan_id % 40 AS r, loan_id % 40 IN (1, 2, 5) AS bad FROM loans) t"),
    "w_row_id": with_loans("SELECT loan_id, row_number() OVER (ORDER BY loan_id) AS row_id FROM loans"),
    "w_appended_ids": with_loans(
        "SELECT row_number() OVER (ORDER BY loan_id % 3 = 0, loan_id) AS loan_id, loan_id AS source_id, issue_year,"
        " funded_amnt FROM loans"),
    "w_published": with_loans("SELECT loan_id, loan_status, funded_amnt FROM loans"),
}
