"""DataFrame operators on small frames: shares, lag, top-per-group,
profiling, dense ids, cleaning."""

from pyspark.sql import functions as F

from loanscope.operators.cleaning import blank_to_null, drop_columns, id_first, with_derived
from loanscope.operators.profile import constant_columns, duplicate_keys
from loanscope.operators.row_id import with_row_id
from loanscope.operators.shares import lag_ratio, share_of, share_of_total, top_per_group, two_grain_avg


def test_share_of_sums_to_100(spark):
    df = spark.createDataFrame([("a", "x")] * 3 + [("a", "y")] * 1 + [("b", "x")] * 2, "g string, s string")
    got = {(r.g, r.s): (r.number_of_loans, r.total_loans, r.percentage) for r in share_of(df, "g", "s").collect()}
    assert got == {("a", "x"): (3, 4, 75.0), ("a", "y"): (1, 4, 25.0), ("b", "x"): (2, 2, 100.0)}
    tot = {r.g: (r.number_of_loans, r.percentage_to_total_loans) for r in share_of_total(df, "g").collect()}
    assert tot == {"a": (4, 66.67), "b": (2, 33.33)}


def test_two_grain_avg(spark):
    df = spark.createDataFrame([("NY", "A", 1000), ("NY", "A", 1200), ("NY", "B", 2000)], "st string, s string, r long")
    got = {(r.st, r.s): (r.c, r.f) for r in two_grain_avg(df, "st", "s", "r", "c", "f").collect()}
    assert got == {("NY", "A"): (14.0, 11.0), ("NY", "B"): (14.0, 20.0)}


def test_lag_is_by_row_not_calendar(spark):
    df = spark.createDataFrame([(2007, 100), (2009, 300), (2010, 0), (2011, 50)], "y long, v long")
    got = [(r.y, r.prev, r.ratio) for r in lag_ratio(df, "y", "v", "prev", "ratio").orderBy("y").collect()]
    # 2008 is missing: 2009 compares with 2007; 2011 over a zero year is NULL
    assert got == [(2007, None, None), (2009, 100, 300.0), (2010, 300, 0.0), (2011, 0, None)]


def test_top_per_group_tie_goes_to_first(spark):
    df = spark.createDataFrame([("b1", "C", 5), ("b1", "A", 5), ("b1", "B", 4), ("b2", "D", 1)], "band string, grade string, n long")
    got = {r.band: r.grade for r in top_per_group(df, "band", [F.desc("n"), F.asc("grade")]).collect()}
    assert got == {"b1": "A", "b2": "D"}


def test_duplicate_keys_ignore_null(spark):
    df = spark.createDataFrame([("k1",), ("k1",), ("k2",), (None,), (None,)], "k string")
    got = {(r.k, r.occurrences) for r in duplicate_keys(df, "k").collect()}
    assert got == {("k1", 2)}


def test_constant_columns(spark):
    df = spark.createDataFrame([(0, "n", 1, None), (None, "n", 2, None), (0, "n", 1, None)], "t long, p string, v long, e string")
    got = {r.column_name: (r.non_null, r.min_value, r.max_value, r.is_constant) for r in constant_columns(df).collect()}
    assert got == {
        "t": (2, "0", "0", True), "p": (3, "n", "n", True), "v": (3, "1", "2", False), "e": (0, None, None, False),
    }


def test_dense_row_ids_in_key_order(spark):
    keys = list(range(1000, 0, -7))
    df = spark.createDataFrame([(k,) for k in keys], "k long").repartition(5)
    out = with_row_id(df, "k", num_partitions=4).orderBy("k").collect()
    assert [r.row_id for r in out] == list(range(1, len(keys) + 1))
    assert [r.k for r in out] == sorted(keys)


def test_dense_row_ids_only_counts_meet_in_one_partition(spark):
    """The only single-partition exchange carries the per-partition counts
    (one row per range partition), never the rows themselves."""
    df = spark.range(100).withColumnRenamed("id", "k")
    lines = with_row_id(df, "k")._jdf.queryExecution().executedPlan().toString().split("\n")
    single = [i for i, line in enumerate(lines) if "Exchange SinglePartition" in line]
    assert single, "offsets are a window over the partition counts"
    for i in single:
        assert "HashAggregate(keys=[_pid" in lines[i + 1]


def test_blank_to_null_keeps_rows(spark):
    df = spark.createDataFrame([(1, ""), (2, "  "), (3, "car"), (4, None)], "id long, p string")
    got = [(r.id, r.p) for r in blank_to_null(df, ["p"]).orderBy("id").collect()]
    assert got == [(1, None), (2, None), (3, "car"), (4, None)]


def test_drop_and_order(spark):
    df = spark.createDataFrame([(1, 2, 3)], "a long, loan_id long, zip_code long")
    out = id_first(drop_columns(df, ["zip_code", "policy_code"]))
    assert out.columns == ["loan_id", "a"]


def test_derived_columns(spark):
    raw = spark.createDataFrame(
        [("36 months", "Jan-2010", "Feb-2013", "Dec-99"),   # 37 months = term + 1: full
         ("60 months", "Jan-2010", "Jan-2012", "Mar-2001"),  # early
         ("36 months", "Jan-2010", "Jan-2014", "Foo-1"),     # late
         ("36 months", "Jan-2010", None, None)],             # unknown
        "term string, issue_d string, last_pymnt_d string, earliest_cr_line string",
    )
    got = with_derived(raw).collect()
    assert [r.payment_timing for r in got] == ["full", "early", "late", "unknown"]
    assert [r.months_made_payment for r in got] == [37, 24, 48, None]
    assert [r.earliest_cr_line for r in got] == ["Dec-1999", "Mar-2001", None, None]
    assert [r.credit_opened_year for r in got] == [1999, 2001, None, None]
    assert [r.issue_year for r in got] == [2010] * 4


def test_cleaned_layout_matches_step_by_step(spark, small_loans):
    from loanscope.operators.cleaning import FIRST_DROP, SECOND_DROP, place_after
    from loanscope.sources.loan_view import RAW_COLUMNS
    from loanscope.sources.store import cleaned

    steps = drop_columns(small_loans.select(*RAW_COLUMNS, "issue_year", "credit_opened_year"), FIRST_DROP + SECOND_DROP)
    steps = id_first(place_after(place_after(steps, "issue_year", "issue_d"), "credit_opened_year", "earliest_cr_line"))
    assert cleaned(small_loans).columns == steps.columns
    assert "zip_code" not in steps.columns and "pymnt_plan" not in steps.columns


def test_api_wrappers(spark, small_loans):
    from loanscope.functions.bands import band
    from loanscope.operators.profile import with_composite_key
    from loanscope.plans.pnl import a42_profit_gap, pnl_gap

    df = spark.createDataFrame([(5,), (15,), (None,)], "x long")
    assert [r.b for r in df.select(band("x", [10], ["low", "high"]).alias("b")).collect()] == ["low", "high", "Unknown"]
    keyed = with_composite_key(small_loans, dti="(dti_bp + 50) div 100")
    assert keyed.filter("primkey IS NULL").count() == 0
    assert sorted(map(tuple, pnl_gap(small_loans, "purpose").collect())) == sorted(map(tuple, a42_profit_gap(small_loans).collect()))


def test_duplicate_keys_on_reimported_rows(spark, small_loans):
    """Rows imported twice are found, each key exactly twice."""
    from loanscope.operators.profile import composite_key

    twice = small_loans.filter("loan_id % 100 = 3")
    data = small_loans.unionByName(twice)
    keyed = data.select(composite_key(dti="(dti_bp + 50) div 100").alias("primkey"))
    got = duplicate_keys(keyed, "primkey").collect()
    assert len(got) == twice.count() > 0
    assert {r.occurrences for r in got} == {2}


def test_standardise_units_round_trip(spark, small_loans):
    from loanscope.operators.cleaning import standardise_units
    from loanscope.plans.portfolio import a09_rate_by_term_status

    original = small_loans.selectExpr(
        "*",
        "concat(CAST(CAST(int_rate_bp AS DECIMAL(9,2)) / 100 AS STRING), '%') AS int_rate",
        "CAST(dti_bp AS DECIMAL(9,2)) / 100 AS dti",
        "CAST(installment_c AS DECIMAL(14,2)) / 100 AS installment",
    ).drop("int_rate_bp", "dti_bp", "installment_c")
    back = standardise_units(original)
    cols = ["loan_id", "int_rate_bp", "dti_bp", "installment_c"]
    assert back.select(*cols).exceptAll(small_loans.select(*cols)).count() == 0
    assert sorted(map(tuple, a09_rate_by_term_status(back).collect())) == sorted(
        map(tuple, a09_rate_by_term_status(small_loans).collect()))
