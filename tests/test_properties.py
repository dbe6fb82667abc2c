"""Property tests: the exact ratio rounding equals rational arithmetic."""

from fractions import Fraction

from hypothesis import given, settings
from hypothesis import strategies as st

from loanscope.functions.arith import avg2, avg_hundredths, pct


def half_up(x: Fraction) -> int:
    """Round half away from zero."""
    n = abs(x)
    r = int(n + Fraction(1, 2))
    return r if x >= 0 else -r


pairs = st.lists(
    st.tuples(st.integers(-10**12, 10**12), st.integers(-10**9, 10**9)),
    min_size=1, max_size=60,
)


@settings(max_examples=8, deadline=None)
@given(pairs)
def test_ratios_match_rational_rounding(spark, rows):
    df = spark.createDataFrame(rows, "n long, d long")
    got = df.select(
        pct("n", "d").alias("p"), avg2("n", "d").alias("a"), avg_hundredths("n", "d").alias("h")
    ).collect()
    for (n, d), r in zip(rows, got):
        if d == 0:
            assert (r.p, r.a, r.h) == (None, None, None)
            continue
        q = Fraction(n, d)
        assert r.p == half_up(q * 10000) / 100
        assert r.a == half_up(q * 100) / 100
        assert r.h == half_up(q) / 100


groups = st.lists(st.tuples(st.sampled_from("abcd"), st.sampled_from("xyz")), min_size=1, max_size=80)


@settings(max_examples=6, deadline=None)
@given(groups)
def test_share_of_matches_brute_force(spark, rows):
    from collections import Counter

    from loanscope.operators.shares import share_of

    df = spark.createDataFrame(rows, "g string, s string")
    got = {(r.g, r.s): (r.number_of_loans, r.total_loans, r.percentage) for r in share_of(df, "g", "s").collect()}
    cell = Counter(rows)
    per_group = Counter(g for g, _ in rows)
    expect = {
        (g, s): (n, per_group[g], half_up(Fraction(n, per_group[g]) * 10000) / 100) for (g, s), n in cell.items()
    }
    assert got == expect


@settings(max_examples=6, deadline=None)
@given(st.lists(st.integers(0, 10**6), min_size=1, max_size=60, unique=True))
def test_dense_ids_match_sorted_order(spark, keys):
    from loanscope.operators.row_id import with_row_id

    df = spark.createDataFrame([(k,) for k in keys], "k long")
    got = {r.k: r.row_id for r in with_row_id(df, "k").collect()}
    assert got == {k: i for i, k in enumerate(sorted(keys), start=1)}


rated = st.lists(
    st.tuples(st.sampled_from("ab"), st.sampled_from("xyz"), st.integers(500, 2500)), min_size=1, max_size=60
)


@settings(max_examples=6, deadline=None)
@given(rated)
def test_two_grain_average_matches_brute_force(spark, rows):
    from loanscope.operators.shares import two_grain_avg

    df = spark.createDataFrame(rows, "st string, s string, r long")
    got = {(x.st, x.s): (x.c, x.f) for x in two_grain_avg(df, "st", "s", "r", "c", "f").collect()}
    expect = {}
    for st_, s_, _ in rows:
        coarse = [r for a, _, r in rows if a == st_]
        fine = [r for a, b, r in rows if a == st_ and b == s_]
        expect[(st_, s_)] = (half_up(Fraction(sum(coarse), len(coarse))) / 100,
                             half_up(Fraction(sum(fine), len(fine))) / 100)
    assert got == expect


@settings(max_examples=6, deadline=None)
@given(st.lists(st.tuples(st.sampled_from("pq"), st.sampled_from("ABCD")), min_size=1, max_size=60))
def test_top_per_group_matches_brute_force(spark, rows):
    from collections import Counter

    from pyspark.sql import functions as F

    from loanscope.operators.shares import top_per_group

    counts = spark.createDataFrame(rows, "band string, grade string").groupBy("band", "grade").count()
    got = {r.band: r.grade for r in top_per_group(counts, "band", [F.desc("count"), F.asc("grade")]).collect()}
    c = Counter(rows)
    expect = {}
    for band in {b for b, _ in rows}:
        expect[band] = min((-n, g) for (b, g), n in c.items() if b == band)[1]
    assert got == expect
