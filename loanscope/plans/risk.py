"""Default risk by product and customer segment (a43-a46).

a43 (segment risk per funded-amount band) is written by the source as a
CTE and two derived tables, each banding every row again, joined on
(band, status).  All its measures are additive, so here it is one
aggregate over the raw rows at (band, grade) with conditional sums, then
one more aggregate over those <= 8 x 7 rows per band: the loan table is
scanned once and nothing is joined.  The source's form is kept as
``op_segment_join`` (three-way join of aggregated frames) and its ranking
step as ``op_top_grade_per_band`` (ROW_NUMBER = 1), each with its own key.

Join side effects of the source are kept: only Charged Off rows come out,
and a band with no Charged Off home owner (OWN) disappears.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loanscope.functions.arith import avg_hundredths, pct
from loanscope.functions.bands import AMOUNT_BANDS
from loanscope.operators.cleaning import CHARGED_OFF
from loanscope.operators.shares import in_order, share_of, top_per_group
from loanscope.plans.oracle_base import avg_h, pct as sql_pct, with_loans

# Fixed output names of the report.
SEGMENT_COLUMNS = [
    "range_of_loan", "total_loans", "loan_status", "percentage_of_status",
    "most_grade_charged_off", "percent_of_the_most_grade_get_co", "average_int_rate",
    "average_dti", "average_installment", "percent_house_owner_get_co",
]

# Fixed value of the source's last report: the rate threshold (percent).
A46_MIN_RATE_BP = 1514  # int_rate > 15.14


def _banded(df: DataFrame) -> DataFrame:
    return df.withColumns({
        "range_of_loan": AMOUNT_BANDS.label("funded_amnt"),
        "_band_ord": AMOUNT_BANDS.ordinal("funded_amnt"),
    })


def a43_segment_risk(df: DataFrame) -> DataFrame:
    """Per funded-amount band: loans, Charged Off share, top Charged Off grade
    and its share, Charged Off averages of rate, dti and installment, and
    the home-owner share."""
    co = f"loan_status = '{CHARGED_OFF}'"
    measures = {"rate": "int_rate_bp", "dti": "dti_bp", "inst": "installment_c"}
    per_grade = _banded(df).groupBy("range_of_loan", "_band_ord", "grade").agg(*[F.expr(e) for e in [
        "count(1) AS n",
        f"count(CASE WHEN {co} THEN 1 END) AS co_n",
        f"count(CASE WHEN {co} AND home_ownership = 'OWN' THEN 1 END) AS own_n",
        *[f"sum(CASE WHEN {co} THEN {c} END) AS s_{k}" for k, c in measures.items()],
        *[f"count(CASE WHEN {co} THEN {c} END) AS c_{k}" for k, c in measures.items()],
    ]])
    per_band = per_grade.groupBy("range_of_loan", "_band_ord").agg(*[F.expr(e) for e in [
        "sum(n) AS total_loans",
        "sum(co_n) AS co_n",
        "sum(own_n) AS own_n",
        # most Charged Off loans; ties go to the better (alphabetically first) grade
        "min_by(grade, struct(-co_n, grade)) AS most_grade_charged_off",
        "max(co_n) AS top_n",
        *[f"sum(s_{k}) AS s_{k}" for k in measures],
        *[f"sum(c_{k}) AS c_{k}" for k in measures],
    ]])
    return (
        per_band.filter((F.col("co_n") > 0) & (F.col("own_n") > 0))
        .transform(in_order("_band_ord"))
        .select(
            "range_of_loan",
            "total_loans",
            F.lit(CHARGED_OFF).alias("loan_status"),
            pct("co_n", "total_loans").alias("percentage_of_status"),
            "most_grade_charged_off",
            pct("top_n", "co_n").alias("percent_of_the_most_grade_get_co"),
            avg_hundredths("s_rate", "c_rate").alias("average_int_rate"),
            avg_hundredths("s_dti", "c_dti").alias("average_dti"),
            avg_hundredths("s_inst", "c_inst").alias("average_installment"),
            pct("own_n", "co_n").alias("percent_house_owner_get_co"),
        )
    )


def op_top_grade_per_band(df: DataFrame) -> DataFrame:
    """Most frequent grade among Charged Off loans of each amount band
    (ROW_NUMBER() OVER (PARTITION BY band, status ORDER BY count DESC) = 1,
    ties to the first grade), with the band's average rate, dti and
    installment."""
    return _top_grade(df).transform(in_order("_band_ord")).drop("_band_ord")


def _top_grade(df: DataFrame) -> DataFrame:
    g = (
        _banded(df.filter(F.col("loan_status") == CHARGED_OFF))
        .groupBy("range_of_loan", "_band_ord", "loan_status", "grade")
        .agg(*[F.expr(e) for e in [
            "count(1) AS grade_counts",
            "sum(int_rate_bp) AS s_rate", "count(int_rate_bp) AS c_rate",
            "sum(dti_bp) AS s_dti", "count(dti_bp) AS c_dti",
            "sum(installment_c) AS s_inst", "count(installment_c) AS c_inst",
        ]])
    )
    w = "OVER (PARTITION BY range_of_loan, loan_status)"
    ranked = g.select(
        "range_of_loan", "_band_ord", "loan_status", "grade", "grade_counts",
        pct("grade_counts", f"sum(grade_counts) {w}").alias("percent_of_grade_in_co_in_range_of_loan"),
        avg_hundredths(f"sum(s_rate) {w}", f"sum(c_rate) {w}").alias("average_int_rate"),
        avg_hundredths(f"sum(s_dti) {w}", f"sum(c_dti) {w}").alias("average_dti"),
        avg_hundredths(f"sum(s_inst) {w}", f"sum(c_inst) {w}").alias("average_installment"),
    )
    return top_per_group(ranked, ["range_of_loan", "loan_status"], [F.desc("grade_counts"), F.asc("grade")])


def op_segment_join(df: DataFrame) -> DataFrame:
    """a43 in the source's shape: band x status summary JOIN top grade JOIN
    home-owner share, on (range_of_loan, loan_status).  All three inputs
    are aggregates (a few rows per band), so AQE broadcasts them; the joins
    keep only Charged Off and drop bands without an OWN row."""
    banded = _banded(df)
    status = share_of(banded, ["range_of_loan", "_band_ord"], "loan_status", n_col="_n",
                      pct_col="percentage_of_status")
    top = _top_grade(df).select(
        "range_of_loan", "loan_status",
        F.col("grade").alias("most_grade_charged_off"),
        F.col("percent_of_grade_in_co_in_range_of_loan").alias("percent_of_the_most_grade_get_co"),
        "average_int_rate", "average_dti", "average_installment",
    )
    home = (
        share_of(banded, ["range_of_loan", "loan_status"], "home_ownership", n_col="_h",
                 pct_col="percent_house_owner_get_co")
        .filter((F.col("home_ownership") == "OWN") & (F.col("loan_status") == CHARGED_OFF))
        .select("range_of_loan", "loan_status", "percent_house_owner_get_co")
    )
    keys = ["range_of_loan", "loan_status"]
    return (
        status.join(top, keys).join(home, keys)
        .transform(in_order("_band_ord"))
        .select(*SEGMENT_COLUMNS)
    )


def _purpose_term_risk(df: DataFrame) -> DataFrame:
    g = df.groupBy("purpose", "term", "loan_status").agg(
        F.expr("count(1) AS _n"), F.expr("sum(int_rate_bp) AS _s"), F.expr("count(int_rate_bp) AS _c")
    )
    w = "OVER (PARTITION BY purpose, term)"
    return (
        g.select(
            "purpose", "term",
            F.expr(f"sum(_n) {w}").alias("term_counts"),
            "loan_status",
            pct("_n", f"sum(_n) {w}").alias("percent_of_status"),
            avg_hundredths("_s", "_c").alias("average_int_rate"),
        )
        # on a window output, after the window: denominators keep all statuses
        .filter(F.col("loan_status") == CHARGED_OFF)
        .transform(in_order("purpose", "term"))
    )


def a44_purpose_term_risk(df: DataFrame) -> DataFrame:
    """Per purpose x term: loans, Charged Off share, Charged Off average rate."""
    return _purpose_term_risk(df)


def a45_purpose_term_risk_band(df: DataFrame, low: int = 5000, high: int = 10000) -> DataFrame:
    """a44 inside a funded range; the range filter runs before the windows
    (and reaches the Parquet scan)."""
    f = F.col("funded_amnt")
    return _purpose_term_risk(df.filter((f > low) & (f <= high)))


def a46_status_counts_filtered(
    df: DataFrame,
    low: int = 5000,
    high: int = 10000,
    min_rate_bp: int = A46_MIN_RATE_BP,
    purpose: str = "MACHINERY",
    term: str = "60 months",
) -> DataFrame:
    """Loans per status under four predicates.  The source asks for its
    small-business purpose; on the loan view purposes are market segments,
    so the purpose is a parameter."""
    f = F.col("funded_amnt")
    cond = (f > low) & (f <= high) & (F.col("int_rate_bp") > min_rate_bp) \
        & (F.col("purpose") == purpose) & (F.col("term") == term)
    return (
        df.filter(cond).groupBy("loan_status").agg(F.count(F.lit(1)).alias("number_of_loans"))
        .transform(in_order("loan_status"))
    )


REPORTS = {
    "a43_segment_risk": a43_segment_risk,
    "a44_purpose_term_risk": a44_purpose_term_risk,
    "a45_purpose_term_risk_band": a45_purpose_term_risk_band,
    "a46_status_counts_filtered": a46_status_counts_filtered,
    "op_top_grade_per_band": op_top_grade_per_band,
    "op_segment_join": op_segment_join,
}


# Edges and labels written out, apart from functions.bands.
_BAND_CASE = (
    "CASE WHEN funded_amnt IS NULL THEN 'Unknown' WHEN funded_amnt > 30000 THEN 'More than $30K'"
    " WHEN funded_amnt > 25000 THEN 'From $25K - $30K' WHEN funded_amnt > 20000 THEN 'From $20K - $25K'"
    " WHEN funded_amnt > 15000 THEN 'From $15K - $20K' WHEN funded_amnt > 10000 THEN 'From $10K - $15K'"
    " WHEN funded_amnt > 5000 THEN 'From $5K - $10K' ELSE 'Less than $5K' END"
)


# Oracle: grouped SQL with one summary per question, joined on the band.
_BANDED = f"banded AS (SELECT *, {_BAND_CASE} AS range_of_loan FROM loans)"
_CO_GRADES = (
    "co_grades AS (SELECT range_of_loan, grade, count(*) AS grade_counts FROM banded"
    " WHERE loan_status = 'Charged Off' GROUP BY range_of_loan, grade)"
)
_CO_BAND = (
    "co_band AS (SELECT range_of_loan, count(*) AS co_n,"
    " sum(int_rate_bp) AS s_rate, count(int_rate_bp) AS c_rate,"
    " sum(dti_bp) AS s_dti, count(dti_bp) AS c_dti,"
    " sum(installment_c) AS s_inst, count(installment_c) AS c_inst,"
    " count(*) FILTER (WHERE home_ownership = 'OWN') AS own_n"
    " FROM banded WHERE loan_status = 'Charged Off' GROUP BY range_of_loan)"
)
_LEADER = (
    "leader AS (SELECT range_of_loan, grade, grade_counts FROM ("
    " SELECT *, row_number() OVER (PARTITION BY range_of_loan ORDER BY grade_counts DESC, grade) AS pos"
    " FROM co_grades) ranked WHERE pos = 1)"
)

_TOP_GRADE_SQL = f"""
WITH {_BANDED}, {_CO_GRADES}, {_CO_BAND}, {_LEADER}
SELECT leader.range_of_loan, 'Charged Off' AS loan_status, leader.grade, leader.grade_counts,
  {sql_pct("leader.grade_counts", "co_band.co_n")} AS percent_of_grade_in_co_in_range_of_loan,
  {avg_h("s_rate", "c_rate")} AS average_int_rate,
  {avg_h("s_dti", "c_dti")} AS average_dti,
  {avg_h("s_inst", "c_inst")} AS average_installment
FROM leader JOIN co_band ON leader.range_of_loan = co_band.range_of_loan
"""

_SEGMENT_SQL = f"""
WITH {_BANDED}, {_CO_GRADES}, {_CO_BAND}, {_LEADER},
all_band AS (SELECT range_of_loan, count(*) AS total_loans FROM banded GROUP BY range_of_loan)
SELECT all_band.range_of_loan, all_band.total_loans, 'Charged Off' AS loan_status,
  {sql_pct("co_band.co_n", "all_band.total_loans")} AS percentage_of_status,
  leader.grade AS most_grade_charged_off,
  {sql_pct("leader.grade_counts", "co_band.co_n")} AS percent_of_the_most_grade_get_co,
  {avg_h("s_rate", "c_rate")} AS average_int_rate,
  {avg_h("s_dti", "c_dti")} AS average_dti,
  {avg_h("s_inst", "c_inst")} AS average_installment,
  {sql_pct("co_band.own_n", "co_band.co_n")} AS percent_house_owner_get_co
FROM all_band
JOIN co_band ON co_band.range_of_loan = all_band.range_of_loan
JOIN leader ON leader.range_of_loan = all_band.range_of_loan
WHERE co_band.own_n > 0
"""


def _purpose_term_sql(where: str = "") -> str:
    w = f" WHERE {where}" if where else ""
    return with_loans(
        "WITH per_status AS (SELECT purpose, term, loan_status, count(*) AS n,"
        f" sum(int_rate_bp) AS s, count(int_rate_bp) AS c FROM loans{w} GROUP BY purpose, term, loan_status),"
        " per_term AS (SELECT purpose, term, sum(n) AS term_counts FROM per_status GROUP BY purpose, term)"
        " SELECT p.purpose, p.term, CAST(t.term_counts AS BIGINT) AS term_counts, p.loan_status, "
        + sql_pct("p.n", "t.term_counts") + " AS percent_of_status, "
        + avg_h("p.s", "p.c") + " AS average_int_rate"
        " FROM per_status p JOIN per_term t ON p.purpose = t.purpose AND p.term = t.term"
        " WHERE p.loan_status = 'Charged Off'"
    )


ORACLE = {
    "a43_segment_risk": with_loans(_SEGMENT_SQL),
    "op_segment_join": with_loans(_SEGMENT_SQL),
    "op_top_grade_per_band": with_loans(_TOP_GRADE_SQL),
    "a44_purpose_term_risk": _purpose_term_sql(),
    "a45_purpose_term_risk_band": _purpose_term_sql("funded_amnt > 5000 AND funded_amnt <= 10000"),
    "a46_status_counts_filtered": with_loans(
        "SELECT loan_status, count(*) AS number_of_loans FROM loans"
        f" WHERE funded_amnt > 5000 AND funded_amnt <= 10000 AND int_rate_bp > 1514"
        " AND purpose = 'MACHINERY' AND term = '60 months' GROUP BY loan_status"),
}
