"""Banding of a numeric column into labelled ranges.

Bands are upper-inclusive (``x <= edge``) like the CASE expressions of the
source reports; values above the last edge go to the top band.  A NULL
value goes to a separate ``Unknown`` band rather than silently into the top
band (a CASE without a NULL branch would do the latter).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

UNKNOWN = "Unknown"


@dataclass(frozen=True)
class Banding:
    edges: tuple  # ascending upper bounds, inclusive
    labels: tuple  # len(edges) + 1 labels; last one is "above the last edge"

    def __post_init__(self):
        if len(self.labels) != len(self.edges) + 1:
            raise ValueError("need one label per edge plus a top label")
        if list(self.edges) != sorted(self.edges):
            raise ValueError("edges must ascend")

    def label_sql(self, col: str) -> str:
        """SQL CASE text of the band label of column ``col``."""
        whens = " ".join(f"WHEN {col} <= {e} THEN '{lab}'" for e, lab in zip(self.edges, self.labels))
        return f"CASE WHEN {col} IS NULL THEN '{UNKNOWN}' {whens} ELSE '{self.labels[-1]}' END"

    def ordinal_sql(self, col: str) -> str:
        """SQL CASE text of the band position, 1..len(labels); Unknown last."""
        whens = " ".join(f"WHEN {col} <= {e} THEN {i}" for i, e in enumerate(self.edges, start=1))
        return f"CASE WHEN {col} IS NULL THEN {len(self.labels) + 1} {whens} ELSE {len(self.labels)} END"

    def label(self, col: str) -> Column:
        return F.expr(self.label_sql(col))

    def ordinal(self, col: str) -> Column:
        """1..len(labels) in band order; Unknown sorts last."""
        return F.expr(self.ordinal_sql(col))


# Band bounds and labels of the source reports.
# Income bands (annual_inc, dollars).  The source labels the fifth band
# "From $165K - $360K" although its lower bound is 160,000; the label here
# follows the bound.
INCOME_BANDS = Banding(
    edges=(30000, 50000, 80000, 160000, 360000),
    labels=(
        "Under $30K",
        "From $30K - $50K",
        "From $50K - $80K",
        "From $80K - $160K",
        "From $160K - $360K",
        "Higher than $360k",
    ),
)

# Funded-amount bands (funded_amnt, dollars).
AMOUNT_BANDS = Banding(
    edges=(5000, 10000, 15000, 20000, 25000, 30000),
    labels=(
        "Less than $5K",
        "From $5K - $10K",
        "From $10K - $15K",
        "From $15K - $20K",
        "From $20K - $25K",
        "From $25K - $30K",
        "More than $30K",
    ),
)


def band(col: str, edges, labels) -> Column:
    """Label column for upper-inclusive bands given as data (see Banding)."""
    return Banding(tuple(edges), tuple(labels)).label(col)
