"""Registry of every report: key -> (spark, sf_dir) -> DataFrame, and the
DuckDB oracle text per key."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from loanscope.plans import pnl, portfolio, risk, segments, wrangling
from loanscope.sources.store import loans

_MODULES = [wrangling, portfolio, segments, pnl, risk]


def _bind(fn):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return fn(loans(spark, sf_dir))

    run.__name__ = fn.__name__
    run.__doc__ = fn.__doc__
    return run


def reports() -> dict[str, Callable[[DataFrame], DataFrame]]:
    """Every report as a function of the loan table."""
    out = {}
    for m in _MODULES:
        out.update(m.REPORTS)
    return out


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """Every report as a function of (spark, sf_dir)."""
    return {k: _bind(fn) for k, fn in reports().items()}


def oracle_sql() -> dict[str, str]:
    """DuckDB SQL per report key."""
    out = {}
    for m in _MODULES:
        out.update({k: v for k, v in m.ORACLE.items() if v})
    return out
