"""Presentation text: whole numbers with thousands separators.

The source reports return money as ``FORMAT(x, '#,#')`` text, which then
sorts as text ('9,000' above '42,000').  Reports here keep numbers numeric
and sort numerically; ``present`` adds the text form as the last step.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fmt_int(x) -> Column:
    """Whole number with comma separators, half-up rounding of fractions.

    ``format_number(2.5, 0)`` rounds half-even, so fractional input is
    rounded half-up with ``round`` first; integral input is exact.
    """
    c = F.col(x) if isinstance(x, str) else x
    return F.format_number(F.round(c, 0), 0)


def present(df: DataFrame, money_cols) -> DataFrame:
    """Replace the given numeric columns by their comma text, in place."""
    return df.select(
        *[fmt_int(c).alias(c) if c in money_cols else F.col(c) for c in df.columns]
    )
