"""Exact rounding of ratios.

Every percentage and average in the reports is a ratio of two integer
aggregates (counts, whole-dollar sums, basis points, cents).  Rounding a
double quotient gives engine-dependent answers on halves (``round(1.005, 2)``
is 1.01 in Spark, 1.0 elsewhere), so the ratio is rounded in integer
arithmetic instead: ``round_half_up(num * scale / den)`` equals
``(2 * num * scale + den) div (2 * den)`` for ``num >= 0, den > 0``; the
sign is restored afterwards so negative values round symmetrically.

The operands are widened to ``decimal(38,6)`` first: sums over a very
large table cannot overflow ``bigint`` when multiplied by the scale, and
money with cents (or any value with up to 6 decimals) is rounded exactly
too, since the identity holds for rational operands.  ``div`` on decimals
returns ``bigint``.

Arguments are SQL expression text (a column name, an aggregate such as
``sum(x)``, or a window such as ``sum(n) OVER (PARTITION BY g)``), and each
helper returns one ``F.expr`` column: the expression tree is built by
Spark's parser in a single call rather than node by node from Python.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_WIDE = "DECIMAL(38,6)"


def ratio_sql(num: str, den: str, scale: int) -> str:
    """SQL text of round_half_up(num * scale / den) as BIGINT; NULL when
    den is 0 or NULL."""
    n = f"CAST(({num}) AS {_WIDE})"
    d = f"CAST(({den}) AS {_WIDE})"
    mag = f"((abs({n}) * {2 * scale} + abs({d})) div (abs({d}) * 2))"
    return (
        f"(CASE WHEN {d} <> 0 THEN CAST(CASE WHEN ({n} < 0) <> ({d} < 0) "
        f"THEN -{mag} ELSE {mag} END AS BIGINT) END)"
    )


def scaled_ratio(num: str, den: str, scale: int) -> Column:
    """round_half_up(num * scale / den) as a bigint column."""
    return F.expr(ratio_sql(num, den, scale))


def pct(num: str, den: str) -> Column:
    """num / den * 100 rounded half-up to 2 decimals (double)."""
    return F.expr(f"CAST({ratio_sql(num, den, 10000)} AS DOUBLE) / 100")


def avg2(total: str, count: str) -> Column:
    """total / count rounded half-up to 2 decimals (double)."""
    return F.expr(f"CAST({ratio_sql(total, count, 100)} AS DOUBLE) / 100")


def avg_hundredths(total_hundredths: str, count: str) -> Column:
    """Average of values stored in hundredths (basis points of a percent,
    cents of a dollar), returned in whole units with 2 decimals."""
    return F.expr(f"CAST({ratio_sql(total_hundredths, count, 1)} AS DOUBLE) / 100")


def avg0(total: str, count: str) -> Column:
    """total / count rounded half-up to an integer (bigint)."""
    return F.expr(ratio_sql(total, count, 1))


def hundredths(x: str) -> Column:
    """A hundredths-unit integer (basis points, cents) as a 2-decimal double."""
    return F.expr(f"CAST(({x}) AS DOUBLE) / 100")


def idiv(a, b) -> Column:
    """Integer division truncating toward zero (SQL ``div``) of two columns."""
    a = F.col(a) if isinstance(a, str) else a
    b = F.col(b) if isinstance(b, str) else b
    return F.call_function("div", a, b)
