"""Exact medians per group, without sorting a group in one task.

``percentile(x, 0.5)`` keeps a map of all values of a group in one aggregation
buffer, and a window ordered by the value sorts a group in one task; a group
that holds a third of the table then decides the run time.  Here rows are
counted first, and the middle is found digit by digit:

1. one hash aggregate counts the rows per (group, value); equal values collapse
   in each task before the shuffle;
2. the counts are added up per bucket of ``WIDTHS[0]`` values; a window over a
   group's buckets (not its rows) tells which bucket holds the middle ranks;
3. inside that bucket the same happens with ``WIDTHS[1]``, and so on down to
   single values.

A window sees at most WIDTHS[i - 1] / WIDTHS[i] rows of a group (1024); only
the first one grows, with the range of the values divided by 2**20.  With an
even number of rows there are two middle ranks, which may lie in two buckets;
both are followed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Values per bucket, level by level; after the last one single values remain.
WIDTHS = (1 << 20, 1 << 10)


def value_counts(df: DataFrame, by: str, value: str) -> DataFrame:
    """(by, value, n): rows per group and value, NULL values included."""
    return df.groupBy(by, value).agg(F.count(F.lit(1)).alias("n"))


def _bucket(width: int | None):
    """Least value of a value's bucket (the value itself without a width)."""
    return F.col("v") if width is None else F.col("v") - F.pmod(F.col("v"), F.lit(width))


def _middle(rows: DataFrame, scope: list[str], width: int | None) -> DataFrame:
    """The buckets of ``width`` that hold a middle rank of their group: group,
    bucket, the group's rows before it (``before``) and in total, and which of
    the two middle ranks it holds.  ``rows`` are (scope, before, total, v, n)."""
    filled = rows.groupBy(*scope, "before", "total", _bucket(width).alias("b")).agg(F.sum("n").alias("n"))
    running = F.sum("n").over(Window.partitionBy(*scope).orderBy("b"))
    placed = filled.withColumn("upto", F.col("before") + running)
    placed = placed.withColumn("before", F.col("upto") - F.col("n"))
    low, high = F.expr("(total + 1) div 2"), F.expr("total div 2 + 1")
    holds = {name: (rank > F.col("before")) & (rank <= F.col("upto")) for name, rank in (("low", low), ("high", high))}
    return placed.select("g", F.col("b").alias("bucket"), "before", "total", *[c.alias(n) for n, c in holds.items()]) \
        .filter("low OR high")


def medians_of_counts(counts: DataFrame, by: str, value: str, out: str) -> DataFrame:
    """(by, out) from ``value_counts``: the exact median (double; the mean of
    the two middle values when their number is even).  NULL values do not
    count; a group without a value has no row; rows with a NULL group are a
    group of their own.  ``value`` has a whole or a decimal type."""
    # the group inside a struct: as a join key it is never NULL itself
    known = counts.filter(F.col(value).isNotNull()).select(
        F.struct(F.col(by).alias("k")).alias("g"), F.col(value).alias("v"), "n")
    found = known.groupBy("g").agg(F.sum("n").alias("total")).withColumn("before", F.lit(0).cast("bigint"))
    scope, rows = ["g"], known
    for width in (*WIDTHS, None):
        found = _middle(rows.join(found.select(*scope, "before", "total"), scope), scope, width)
        scope, rows = ["g", "bucket"], known.withColumn("bucket", _bucket(width))
    middle = [F.max(F.when(F.col(side), F.col("bucket"))).cast("double") for side in ("low", "high")]
    return found.groupBy("g").agg(((middle[0] + middle[1]) / 2).alias(out)).select(F.col("g.k").alias(by), out)


def group_medians(df: DataFrame, by: str, value: str, out: str) -> DataFrame:
    """(by, out): the exact median of ``value`` per group."""
    return medians_of_counts(value_counts(df, by, value), by, value, out)
