"""Data profiling of the raw loan table: constant columns, composite keys,
duplicate keys.

All three are single passes with partial aggregation: the constant-column
profile is one global aggregate (min, max, count per column) whose one
output row is unpivoted (over files, number columns come from the footers); the duplicate check is a group-by on the key where
map-side combining collapses repeated keys before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loanscope.functions.months import month_year_code

# Columns profiled per aggregate: 3 buffers each, kept under Spark's
# whole-stage-codegen field limit (spark.sql.codegen.maxFields, 100).
PROFILE_CHUNK = 30


def _profile_chunk(df: DataFrame, names: list) -> DataFrame:
    aggs = []
    for i, c in enumerate(names):
        aggs += [
            f"count(`{c}`) AS n{i}",
            f"CAST(min(`{c}`) AS STRING) AS lo{i}",
            f"CAST(max(`{c}`) AS STRING) AS hi{i}",
        ]
    rows = ", ".join(
        f"struct('{c}' AS column_name, n{i} AS non_null, lo{i} AS min_value, hi{i} AS max_value)"
        for i, c in enumerate(names)
    )
    # aggregate functions in a projection: one global aggregate
    return df.selectExpr(*aggs).selectExpr(f"inline(array({rows}))")


def constant_columns(df: DataFrame, cols=None, chunk: int = PROFILE_CHUNK) -> DataFrame:
    """One row per column: column_name, non_null, min_value, max_value,
    is_constant.

    A column is constant when its non-null values are all equal (NULLs are
    ignored, so a column of 0 and NULL counts as constant) and it has at
    least one value.  min/max are computed on the column's own type and
    shown as text.

    Global aggregates over chunks of ``chunk`` columns (code generation has
    a field limit; a wider table takes more aggregates); each chunk reads only its own
    columns, so the table is still read once in total.  Fixed-width columns
    (numbers, dates) and text columns go to separate chunks: min/max over
    text needs a sort-based aggregate, and mixing would pull the numeric
    columns out of the generated-code hash aggregate too.
    """
    names = list(cols) if cols is not None else df.columns
    types = dict(df.dtypes)
    text = [c for c in names if types[c] in ("string", "binary")]
    fixed = [c for c in names if c not in set(text)]
    parts = [
        _profile_chunk(df, group[i:i + chunk])
        for group in (fixed, text)
        for i in range(0, len(group), chunk)
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.withColumn(
        "is_constant", (F.col("non_null") > 0) & (F.col("min_value") == F.col("max_value"))
    )


# Types whose least and largest value Parquet footers hold exactly (text is cut
# there, decimals and timestamps have several encodings).
FOOTER_TYPES = {"boolean", "tinyint", "smallint", "int", "bigint", "float", "double", "date"}


def _footer_session(spark: SparkSession) -> SparkSession:
    """A session of the same application in which min, max and count of Parquet
    columns are answered from file footers (the data source v2 reader)."""
    own = spark.newSession()
    own.conf.set("spark.sql.sources.useV1SourceList", "avro,csv,json,kafka,orc,text")
    own.conf.set("spark.sql.parquet.aggregatePushdown", "true")
    return own


def _footer_row(table: DataFrame, names: list, functions: tuple) -> dict | None:
    """{(function, column): text} from the footers; None if one of them lacks
    the statistics (Spark fails the job then)."""
    aggs = [f"{f}(`{c}`) AS {f}{i}" for i, c in enumerate(names) for f in functions]
    texts = [f"CAST({f}{i} AS STRING) AS {f}{i}" for i in range(len(names)) for f in functions]
    try:
        row = table.selectExpr(*aggs).selectExpr(*texts).first()
    except Exception as e:
        if "aggregatePushdown" not in str(e):
            raise
        return None
    return {(f, c): row[f"{f}{i}"] for i, c in enumerate(names) for f in functions}


def footer_profile(spark: SparkSession, path: str, names: list) -> list[tuple]:
    """(column_name, non_null, min_value, max_value) of columns of FOOTER_TYPES
    from the footers of the Parquet files at ``path``: no row group is read.
    Columns are left out if a footer lacks their statistics, as is the case for
    a file in which all values of a column are null."""
    table = _footer_session(spark).read.parquet(path)
    counts = _footer_row(table, names, ("count",)) if names else {}
    if counts is None:
        return []
    n = {c: int(counts["count", c] or 0) for c in names}

    def ranges(group: list) -> dict:
        found = _footer_row(table, group, ("min", "max")) if group else {}
        if found is not None or len(group) == 1:
            return found or {}
        half = len(group) // 2
        return ranges(group[:half]) | ranges(group[half:])

    known = ranges([c for c in names if n[c]])
    return [(c, n[c], known.get(("min", c)), known.get(("max", c))) for c in names if not n[c] or ("min", c) in known]


def constant_columns_of_files(spark: SparkSession, path: str, cols=None) -> DataFrame:
    """``constant_columns`` of a table in Parquet files.  Numbers and dates are
    profiled from the footers (one small job when this is called; a row per
    column passes the driver); rows are read only for text columns and for
    columns without statistics."""
    table = spark.read.parquet(path)
    names, types = list(cols) if cols is not None else table.columns, dict(table.dtypes)
    known = footer_profile(spark, path, [c for c in names if types[c] in FOOTER_TYPES])
    found = spark.createDataFrame(known, "column_name string, non_null bigint, min_value string, max_value string")
    found = found.withColumn("is_constant", (F.col("non_null") > 0) & (F.col("min_value") == F.col("max_value")))
    rest = [c for c in names if c not in {k[0] for k in known}]
    return found.unionByName(constant_columns(table, rest)) if rest else found


# dti rounded half up to whole percents, from basis points
ROUNDED_DTI = "(dti_bp + 50) div 100"


def composite_key(
    zip_code: str = "zip_code",
    earliest: str = "earliest_cr_line",
    home: str = "home_ownership",
    sub_grade: str = "sub_grade",
    purpose: str = "purpose",
    dti: str = ROUNDED_DTI,
    funded: str = "funded_amnt",
    issue: str = "issue_d",
) -> Column:
    """The source's candidate key: zip prefix, credit-line month (MMyy),
    home-ownership initial, sub grade, purpose prefix, rounded dti, funded
    amount and issue month (MMyy) joined by '-'.  NULL if any part is NULL
    (CONCAT semantics).  Arguments are SQL expressions (column names)."""
    parts = [
        F.expr(f"left({zip_code}, 3)"),
        month_year_code(earliest),
        F.expr(f"left({home}, 1)"),
        F.expr(sub_grade),
        F.expr(f"upper(left({purpose}, 3))"),
        F.expr(f"CAST({dti} AS STRING)"),
        F.expr(f"CAST({funded} AS STRING)"),
        month_year_code(issue),
    ]
    # concat, not concat_ws: a NULL part makes the whole key NULL
    return F.concat(*_interleave(parts, F.lit("-")))


def with_composite_key(df: DataFrame, name: str = "primkey", dti: str = ROUNDED_DTI) -> DataFrame:
    """Add the candidate key column (see composite_key)."""
    return df.withColumn(name, composite_key(dti=dti))


def _interleave(cols: list, sep: Column) -> list:
    out = []
    for i, c in enumerate(cols):
        if i:
            out.append(sep)
        out.append(c)
    return out


def duplicate_keys(df: DataFrame, key: str, n_col: str = "occurrences") -> DataFrame:
    """Keys seen more than once (GROUP BY key HAVING COUNT(key) > 1).

    COUNT(key) skips NULL keys, so a NULL key is never reported.  One scan
    and one hash exchange; the partial aggregate collapses a repeated key in
    each task before the shuffle.
    """
    return (
        df.select(key).filter(F.col(key).isNotNull()).groupBy(key)
        .agg(F.count(F.col(key)).alias(n_col))
        .filter(F.col(n_col) > 1)
    )
