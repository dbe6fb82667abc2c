"""Reading the loan file and writing reports.

``read_loans`` is the import step of the source: a CSV with a header
where missing cells hold the text NULL.  The schema is always given
explicitly (no ``inferSchema`` pass over the data); rows with blank cells
are kept (blank text becomes NULL in the cleaning job, not a dropped row).

``save_report`` is the export step: every report is a DataFrame and is
written by Spark's own writers in parallel, never collected to the driver.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loanscope.sources import commits
from loanscope.sources.loan_csv import checked
from loanscope.sources.loan_view import RAW_COLUMNS

_TEXT = {
    "term", "grade", "sub_grade", "loan_status", "purpose", "home_ownership", "addr_state",
    "issue_d", "last_pymnt_d", "earliest_cr_line", "zip_code", "debt_settlement_flag", "pymnt_plan",
    "hardship_flag", "disbursement_method", "initial_list_status", "application_type", "emp_title",
}


def raw_schema() -> T.StructType:
    """Schema of the raw loan file (RAW_COLUMNS): text and whole numbers."""
    return T.StructType([
        T.StructField(c, T.StringType() if c in _TEXT else T.LongType(), True) for c in RAW_COLUMNS
    ])


def read_loans(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """Raw loans from CSV, columns found by their header names in any order.

    'NULL' and blank cells become NULL.  A record with a cell that is no value
    of its column's type (give money columns a decimal type when the file has
    cents), with too few or too many cells or an open quote fails the job with
    its line and reason; ``loan_csv.import_loans`` returns such records as a
    second table instead.  Cells in quotes may hold separators and line breaks.
    A missing column is an error; columns outside the schema are not read.
    """
    rows = checked(spark, path, schema or raw_schema())
    said = F.concat_ws(" ", F.concat(F.lit("line "), F.col("line"), F.lit(" of "), F.col("file")),
                       F.concat(F.lit("column "), F.col("column"), F.lit(":")), F.col("reason"))
    # in the filter, so that no selection of columns leaves the check out
    good = F.when(F.col("reason").isNotNull(), F.raise_error(said).cast("boolean")).otherwise(F.lit(True))
    return rows.filter(good).select("row.*")


def save_report(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite") -> None:
    """Write a report (``fmt`` parquet or csv with a header) to the folder
    ``path``.

    Overwriting is staged: the report is written beside the old one and takes
    its place by renaming once it is complete, so an export that fails leaves
    the old report as it was.  Between the two renames the folder is missing
    for a moment; ``published.publish`` has no such moment (versions behind a
    pointer, read with ``read_published``)."""
    spark, path = df.sparkSession, path.rstrip("/")

    def write(target: str, mode: str) -> None:
        w = df.write.mode(mode)
        if fmt == "csv":
            w = w.option("header", True)
        w.format(fmt).save(target)

    if mode != "overwrite" or not commits.exists(spark, path):
        write(path, mode)
        return
    tag = uuid.uuid4().hex
    fresh, old = f"{path}.new-{tag}", f"{path}.old-{tag}"
    try:
        write(fresh, "errorifexists")
    except BaseException:
        commits.remove(spark, fresh)
        raise
    commits.move(spark, path, old)
    try:
        commits.move(spark, fresh, path)
    except BaseException:
        commits.move(spark, old, path)
        raise
    commits.remove(spark, old)


def register_views(spark: SparkSession, sf_dir: str) -> None:
    """Temp views for SQL use: ``loans`` (raw + derived columns) and
    ``loans_clean`` (the cleaned layout)."""
    from loanscope.sources.store import cleaned, loans

    df = loans(spark, sf_dir)
    df.createOrReplaceTempView("loans")
    cleaned(df).createOrReplaceTempView("loans_clean")
