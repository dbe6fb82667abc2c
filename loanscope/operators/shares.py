"""Group reports built "aggregate first, window after".

The source writes these as ``SELECT DISTINCT ... COUNT(..) OVER (PARTITION
BY ..)`` over every raw row.  In Spark that form shuffles and sorts the
whole table into window partitions (and ``OVER ()`` moves it all into one
partition).  The operators here aggregate at the finest grain first -
partial aggregation on the map side, so only one row per group and task
crosses the shuffle - and run any window over the handful of aggregated
rows.  Output rows equal the DISTINCT-over-window form because every
measure involved (count, sum, sum/count) is additive.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loanscope.functions.arith import avg_hundredths, pct


def _list(x) -> list:
    return [x] if isinstance(x, str) else list(x)


def share_of(
    df: DataFrame,
    group,
    sub,
    n_col: str = "number_of_loans",
    total_col: str = "total_loans",
    pct_col: str = "percentage",
) -> DataFrame:
    """Rows per (group, sub), rows per group, and sub's share of its group.

    One row per (group..., sub...) present in the data.
    """
    g, s = _list(group), _list(sub)
    counts = df.groupBy(*g, *s).agg(F.count(F.lit(1)).alias(n_col))
    w = Window.partitionBy(*g) if g else Window.partitionBy()
    return counts.withColumn(total_col, F.sum(n_col).over(w)).withColumn(
        pct_col, pct(n_col, total_col)
    )


def share_of_total(df: DataFrame, by, n_col: str = "number_of_loans", pct_col: str = "percentage_to_total_loans") -> DataFrame:
    """Rows per group and the group's share of all rows.

    The grand total is a window over the aggregated rows (one per group),
    never over the raw table.
    """
    b = _list(by)
    counts = df.groupBy(*b).agg(F.count(F.lit(1)).alias(n_col))
    return counts.withColumn(pct_col, pct(n_col, f"sum({n_col}) OVER ()"))


def two_grain_avg(
    df: DataFrame,
    coarse,
    fine,
    value: str,
    coarse_col: str,
    fine_col: str,
) -> DataFrame:
    """Average of a hundredths-unit value at two grains side by side.

    Aggregates sum and count at the fine grain, re-sums them over the coarse
    key with a window on the aggregated rows; avg = sum(sums) / sum(counts).
    """
    c, f = _list(coarse), _list(fine)
    g = df.groupBy(*c, *f).agg(
        F.sum(value).alias("_s"), F.count(value).alias("_n")
    )
    w = f"OVER (PARTITION BY {', '.join(c)})"
    return g.select(
        *c,
        *f,
        avg_hundredths(f"sum(_s) {w}", f"sum(_n) {w}").alias(coarse_col),
        avg_hundredths("_s", "_n").alias(fine_col),
    )


def lag_ratio(df: DataFrame, order: str, value: str, prev_col: str, ratio_col: str) -> DataFrame:
    """Previous row's value (by ``order``) and this / previous * 100.

    By row, not by calendar: a missing year makes the next year compare
    with the one before the gap.  Meant for an already aggregated frame
    (one row per ``order`` value): the window has no partition key.
    """
    prev = F.lag(value).over(Window.orderBy(order))
    return df.withColumn(prev_col, prev).withColumn(ratio_col, pct(value, prev_col))


def top_per_group(df: DataFrame, group, order_by: list, rank_col: str = "_rank") -> DataFrame:
    """First row of each group under ``order_by`` (ROW_NUMBER() = 1).

    ``order_by`` must end in a unique tie-break so the pick is
    deterministic.  Catalyst plans a WindowGroupLimit below the window, so
    each task keeps only its current best row per group before the shuffle.
    """
    w = Window.partitionBy(*_list(group)).orderBy(*order_by)
    return df.withColumn(rank_col, F.row_number().over(w)).filter(F.col(rank_col) == 1).drop(rank_col)


def in_order(*cols):
    """Final ordering of a report whose size is bounded by its group keys
    (not by the data): ``df.transform(in_order("a", F.desc("b")))``.

    The few aggregated rows are moved into one partition and sorted there.
    ``orderBy`` would plan a range exchange, whose bounds need an extra
    sampling job; for a result of a few hundred rows that job costs more
    than the sort.  Not for row-level outputs.
    """

    def apply(df: DataFrame) -> DataFrame:
        return df.repartition(1).sortWithinPartitions(*cols)

    return apply
