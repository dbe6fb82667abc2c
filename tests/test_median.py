"""Exact medians per group against Python's own."""

import random
import statistics
from decimal import Decimal

import pytest

from conftest import make_loans
from loanscope.operators.median import WIDTHS, group_medians
from loanscope.plans.portfolio import a19_income_by_state


def _want(rows):
    by = {}
    for k, v in rows:
        if v is not None:
            by.setdefault(k, []).append(v)
    return {k: float(statistics.median(v)) for k, v in by.items()}


def _got(spark, rows, kind):
    df = spark.createDataFrame(rows, f"k string, v {kind}").repartition(3)
    return {r["k"]: r["m"] for r in group_medians(df, "k", "v", "m").collect()}


@pytest.mark.parametrize("seed", range(3))
def test_medians_of_whole_numbers(spark, seed):
    rng = random.Random(seed)
    rows = [(rng.choice("abc"), rng.randint(-4_000_000, 4_000_000)) for _ in range(301)]
    rows += [("hot", rng.randint(0, 3000)) for _ in range(700)]          # most rows, many equal
    rows += [("one", 5), ("two", -3_000_001), ("two", 9_000_000), ("same", 7), ("same", 7)]
    rows += [("none", None), (None, 4), (None, 9), ("abc", None), ("abc", 2**40), ("abc", -2**40)]
    assert _got(spark, rows, "bigint") == _want(rows)


def test_middle_ranks_in_two_buckets(spark):
    for gap in (1, WIDTHS[1], WIDTHS[0], 5 * WIDTHS[0] + 3):
        rows = [("a", 0), ("a", gap), ("b", -gap), ("b", 0), ("b", 0), ("b", gap)]
        assert _got(spark, rows, "bigint") == _want(rows)


def test_medians_of_cents(spark):
    rng = random.Random(9)
    rows = [(rng.choice("ab"), Decimal(rng.randint(-99999, 99999)) / 100) for _ in range(200)]
    assert _got(spark, rows, "decimal(12,2)") == pytest.approx(_want(rows), abs=1e-9)


def test_empty(spark):
    assert _got(spark, [], "bigint") == {}


def test_income_report(spark):
    df = make_loans(spark, [dict(addr_state=s, annual_inc=v) for s, v in
                            [("NY", 10), ("NY", 20), ("NY", 90), ("TX", 5), ("TX", 8), ("FL", None), (None, 3)]])
    rows = a19_income_by_state(df).collect()
    assert {r["state"]: (r["avg_income"], r["median_income"]) for r in rows} == {
        "NY": (40, 20.0), "TX": (7, 6.5), "FL": (None, None), None: (3, 3.0)}
    assert [r["state"] for r in rows if r["avg_income"]] == [None, "TX", "NY"]


def test_no_window_holds_a_whole_group(spark, small_loans):
    """Windows see buckets, every exchange of counts follows a partial sum."""
    from loanscope.operators.median import medians_of_counts, value_counts

    plan = medians_of_counts(value_counts(small_loans, "addr_state", "annual_inc"), "addr_state", "annual_inc", "m") \
        ._jdf.queryExecution().executedPlan().toString()
    assert "percentile" not in plan and "SinglePartition" not in plan
