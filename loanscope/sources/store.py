"""The loan table as the reports read it.

``loans(spark, sf_dir)`` returns the raw loan view plus the derived
columns of the cleaning job.  Like the source (clean the table once, then
query it many times), the table is written once per application into the
session's shared checkpoint folder as Parquet, and every report scans
that: column pruning and predicate pushdown (row-group min/max statistics)
then reach a columnar file instead of re-running the order joins.  The
write also cuts the lineage: a lost executor costs a re-read of the
written files, not a re-run of the joins.

The table is not partitioned by a column: no report filters on a
low-cardinality column (they group by year, not select a year), and
``partitionBy`` would multiply the file count by the number of years.

Without a shared folder (a cluster session with no ``spark.checkpoint.dir``)
the same plan is returned lazily instead.

``cleaned(df)`` is the table after the source's DROP COLUMN steps, with
loan_id first: what ``SELECT *`` returns in the reports.
"""

from __future__ import annotations

import os
import threading
import uuid
from contextlib import contextmanager

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

from loanscope.operators.cleaning import FIRST_DROP, SECOND_DROP, with_derived
from loanscope.session import app_id, shared_dir
from loanscope.sources.loan_view import RAW_COLUMNS, loan_view

DERIVED_COLUMNS = ["issue_year", "credit_opened_year", "term_months", "months_made_payment", "payment_timing"]
LOAN_COLUMNS = RAW_COLUMNS + DERIVED_COLUMNS

INPUT_TABLES = ["orders", "lineitem", "customer", "nation"]

_written: dict = {}
_read: dict = {}
_lock = threading.Lock()


def _inputs(spark: SparkSession, path: str) -> tuple:
    """Name, size and modification time of the input files (one listing per
    table, no data is read): a changed source gives another key."""
    sc = spark.sparkContext
    conf = sc._jsc.hadoopConfiguration()
    out = []
    for name in INPUT_TABLES:
        table = sc._jvm.org.apache.hadoop.fs.Path(f"{path}/{name}.parquet")
        out += sorted(
            (str(f.getPath()), f.getLen(), f.getModificationTime())
            for f in table.getFileSystem(conf).listStatus(table)
        )
    return tuple(out)


def _key(spark: SparkSession, sf_dir: str):
    path = (sf_dir if "://" in sf_dir else os.path.abspath(sf_dir)).rstrip("/")
    return (app_id(spark), path, _inputs(spark, path))


def build_loans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lazy plan: raw view + derived columns."""
    return with_derived(loan_view(spark, sf_dir)).select(*LOAN_COLUMNS)


# Fixed value: bytes of a method that the JVM still compiles.
_COMPILED_BYTES = 8000
_METHOD_LIMIT = "spark.sql.codegen.hugeMethodLimit"


@contextmanager
def _compiled_methods(spark: SparkSession):
    """The joins and the projection of some fifty columns become one generated
    method of over 12,000 bytes, which the JVM only interprets.  With the limit
    that Spark's documentation names for HotSpot, such a stage runs operator by
    operator, in methods that are compiled."""
    before = spark.conf.get(_METHOD_LIMIT)
    spark.conf.set(_METHOD_LIMIT, str(min(int(before), _COMPILED_BYTES)))
    try:
        yield
    finally:
        spark.conf.set(_METHOD_LIMIT, before)


def write_loans(df: DataFrame, path: str) -> None:
    """Write a loan table with a bloom filter on loan_id: the rows lie in the
    order of the joins, so min/max statistics of the id never rule a row
    group out, and the filter does."""
    with _compiled_methods(df.sparkSession):
        (
            df.write.mode("overwrite")
            .option("parquet.bloom.filter.enabled#loan_id", "true")
            .option("parquet.bloom.filter.adaptive.enabled", "true")
            .option("parquet.enable.dictionary#loan_id", "false")
            .parquet(path)
        )


def materialise(spark: SparkSession, sf_dir: str) -> str | None:
    """Write the loan table once per application; return its path."""
    key = _key(spark, sf_dir)
    with _lock:
        if key in _written:
            return _written[key]
        base = shared_dir(spark)
        if base is None:
            return None
        path = f"{base.rstrip('/')}/loanscope-loans-{uuid.uuid4().hex}"
        write_loans(build_loans(spark, sf_dir), path)
        _written[key] = path
        return path


def loans(spark: SparkSession, sf_dir: str, materialised: bool = True) -> DataFrame:
    """The loan table (LOAN_COLUMNS), read from its written copy."""
    path = materialise(spark, sf_dir) if materialised else None
    if path is None:
        return build_loans(spark, sf_dir)
    df = _read.get(path)
    if df is None:
        try:
            # one DataFrame per written table: the file listing is done once
            df = _read[path] = spark.read.parquet(path).select(*LOAN_COLUMNS)
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            # the written copy is gone (folder cleared): write it again
            with _lock:
                _written.pop(_key(spark, sf_dir), None)
            path = materialise(spark, sf_dir)
            df = _read[path] = spark.read.parquet(path).select(*LOAN_COLUMNS)
    return df


def written_path(df: DataFrame) -> str | None:
    """Folder of the written table that ``df`` is, as returned by ``loans``;
    None for any other DataFrame."""
    return next((path for path, known in _read.items() if known is df), None)


def _cleaned_columns() -> list:
    cols = [c for c in RAW_COLUMNS if c not in set(FIRST_DROP + SECOND_DROP)]
    cols.insert(cols.index("issue_d") + 1, "issue_year")
    cols.insert(cols.index("earliest_cr_line") + 1, "credit_opened_year")
    return ["loan_id"] + [c for c in cols if c != "loan_id"]


# The source's final table layout: constant/free-text columns dropped,
# loan_id first, generated year columns right after their source columns.
CLEANED_COLUMNS = _cleaned_columns()


def cleaned(df: DataFrame) -> DataFrame:
    """The cleaned table (CLEANED_COLUMNS): what ``SELECT *`` returns in
    the reports.  One projection; drop_columns / id_first / place_after
    are the step-by-step forms of the same layout."""
    return df.select(*CLEANED_COLUMNS)
