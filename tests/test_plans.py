"""Physical-plan properties that matter at scale."""

import re
from conftest import SMALL

from loanscope.plans import registry as E
from loanscope.sources.store import build_loans


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_scans_are_pruned_and_filtered(spark):
    p = plan(E.queries()["a03_max_funded"](spark, SMALL))
    assert "ReadSchema: struct<funded_amnt:bigint>" in p
    p = plan(E.queries()["a27_credit_history"](spark, SMALL))
    assert "EqualTo(loan_status,Charged Off)" in p
    p = plan(E.queries()["a45_purpose_term_risk_band"](spark, SMALL))
    assert "GreaterThan(funded_amnt,5000)" in p and "LessThanOrEqual(funded_amnt,10000)" in p


def _fed_by_aggregate(lines, i):
    """True when, walking down from the exchange at line i, an aggregate
    comes before the first file scan (the exchange carries aggregated rows)."""
    for line in lines[i + 1:]:
        if "Aggregate" in line:
            return True
        if "Scan parquet" in line or "FileScan" in line:
            return False
    return True


def test_share_reports_aggregate_before_any_window(spark):
    """No raw-row exchange into a window or into one partition: every such
    exchange sits above an aggregate."""
    for key in ["a11_paid_rate_by_term", "a23_status_by_purpose", "a24_home_ownership", "a40_purpose_mix",
                "a18_rate_by_state_status", "a44_purpose_term_risk", "a43_segment_risk", "a05_yoy_funded"]:
        lines = plan(E.queries()[key](spark, SMALL)).split("\n")
        for i, line in enumerate(lines):
            into_window = "Exchange hashpartitioning" in line and any("Window" in x for x in lines[max(0, i - 3):i])
            if "Exchange SinglePartition" in line or into_window:
                assert _fed_by_aggregate(lines, i), (key, line)


def test_no_raw_rows_into_one_partition_anywhere(spark):
    for key, fn in E.queries().items():
        lines = plan(fn(spark, SMALL)).split("\n")
        for i, line in enumerate(lines):
            if "Exchange SinglePartition" in line:
                assert _fed_by_aggregate(lines, i), (key, line)


def test_segment_risk_scans_once_without_join(spark):
    p = plan(E.queries()["a43_segment_risk"](spark, SMALL))
    assert p.count("FileScan parquet") == 1 or p.count("Scan parquet") == 1
    assert "Join" not in p


def test_loan_view_joins(spark):
    p = plan(build_loans(spark, SMALL))
    # order-key joins are sort-merge (both sides grow with the data);
    # nation (25 rows) is broadcast
    assert "SortMergeJoin" in p
    assert "BroadcastExchange" in p
    assert p.count("partial_sum") == 1  # payments pre-aggregated before the shuffle


def test_dense_ids_read_the_written_tags(spark):
    p = plan(E.queries()["w_row_id"](spark, SMALL))
    # both passes read the stored range tags, not a recomputed range shuffle
    assert "loanscope-r" in p
    assert "rangepartitioning" not in p


def test_duplicate_check_is_one_scan_and_one_exchange(spark):
    p = plan(E.queries()["w_duplicate_keys"](spark, SMALL)).split("\n\n")[0]
    assert p.count("Scan parquet") == 1 and len(re.findall(r"\bExchange\b", p)) == 1
    assert "Broadcast" not in p and "Join" not in p


def reports_on_the_table():
    """Every key but ``w_import``, which parses text (``from_csv`` has no
    generated code) and orders lines of splits, not rows of the loan table; its
    plan is checked in test_loan_csv."""
    return {k: fn for k, fn in E.queries().items() if k != "w_import"}


def test_reports_stay_in_generated_code(spark):
    """Every projection, filter, aggregate and join of every report runs
    inside whole-stage code generation (no Python UDF, no fallback)."""
    import importlib.util
    from pathlib import Path

    spec = importlib.util.spec_from_file_location(
        "plan_report", Path(__file__).resolve().parents[1] / "scripts" / "plan_report.py")
    pr = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(pr)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        for key, fn in reports_on_the_table().items():
            assert pr.outside_codegen(plan(fn(spark, SMALL))) == [], key
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_reports_only_shuffle_aggregated_rows(spark):
    """Every hash or single-partition exchange of every report is fed by an
    aggregate (partial aggregation before the shuffle): no report moves raw
    loan rows across the network; a hot group collapses map-side."""
    for key, fn in reports_on_the_table().items():
        lines = plan(fn(spark, SMALL)).split("\n")
        for i, line in enumerate(lines):
            if "Exchange hashpartitioning" in line or "Exchange SinglePartition" in line:
                assert _fed_by_aggregate(lines, i), (key, line)
