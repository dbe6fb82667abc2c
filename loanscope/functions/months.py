"""Month-year text (``Jun-2011``) handling.

The loan file stores dates as month-year text.  They are parsed once in
the cleaning job into first-of-month dates; unparseable text becomes NULL
instead of failing the job (a plain ``to_date`` raises under ANSI mode).

Two-digit years (``Dec-99``) are widened explicitly with the classic
MySQL pivot: 70-99 -> 19xx, 00-69 -> 20xx.  Spark's ``yy`` pattern would
read 99 as 2099, so it is not used.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The month-year text layout (English month abbreviation,
# '-', four-digit year), the month abbreviations in calendar order, and
# the two-digit-year pivot (70-99 -> 19xx).
MONTH_TEXT_FORMAT = "MMM-yyyy"
MONTH_ABBREVIATIONS = ["Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec"]
TWO_DIGIT_19XX = r"^([A-Za-z]{3})-([7-9][0-9])$"
TWO_DIGIT_20XX = r"^([A-Za-z]{3})-([0-6][0-9])$"


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def widen_year_text(text) -> Column:
    """``Dec-99`` -> ``Dec-1999``, ``Mar-05`` -> ``Mar-2005``; others unchanged.

    Written so the input appears once in the expression: when the input is
    itself an expression, Catalyst may inline it, and every extra reference
    would evaluate it again.
    """
    return F.regexp_replace(
        F.regexp_replace(_c(text), TWO_DIGIT_19XX, "$1-19$2"), TWO_DIGIT_20XX, "$1-20$2"
    )


def parse_month(text, two_digit_years: bool = True) -> Column:
    """Month-year text (``Jun-2011``, and ``Jun-11`` when
    ``two_digit_years``) -> first-of-month DATE, NULL when unparseable."""
    t = widen_year_text(text) if two_digit_years else _c(text)
    return F.try_to_date(t, MONTH_TEXT_FORMAT)


def format_month(date) -> Column:
    """DATE -> month-year text (``Jun-2011``)."""
    return F.date_format(_c(date), MONTH_TEXT_FORMAT)


def month_year_code(text: str) -> Column:
    """``Dec-1999`` and ``Dec-99`` -> ``1299`` (two-digit month, two-digit
    year: the MMyy print of the parsed month), NULL for any other text.  Case
    does not matter, as in ``parse_month``; a two-digit year is its own last
    two digits under the pivot, so both spellings of a month agree.

    String arithmetic on the text (month looked up in a 12-entry array), no
    date parsing or formatting per value.
    """
    months = ", ".join(f"'{m.lower()}'" for m in MONTH_ABBREVIATIONS)
    m = f"array_position(array({months}), lower(substring({text}, 1, 3)))"
    return F.expr(
        f"CASE WHEN {text} RLIKE '^[A-Za-z]{{3}}-([0-9]{{2}}){{1,2}}$' AND {m} > 0"
        f" THEN concat(lpad(CAST({m} AS STRING), 2, '0'), right({text}, 2)) END"
    )


def normalise_month(text) -> Column:
    """Parse and re-print: canonical ``Mon-yyyy`` text or NULL."""
    return format_month(parse_month(text))


def month_index(date) -> Column:
    """Months since year 0; differences are whole-month distances."""
    d = _c(date)
    return F.year(d).cast("bigint") * 12 + F.month(d).cast("bigint")


def months_between_whole(start, end) -> Column:
    """Signed whole months from start to end (both first-of-month); null-safe."""
    return month_index(end) - month_index(start)


def term_months(term) -> Column:
    """``'36 months'`` / ``' 60 months'`` -> 36 / 60 (bigint), NULL otherwise.

    A plain cast of the text raises CAST_INVALID_INPUT under ANSI mode, so
    the number is extracted first.
    """
    digits = F.regexp_extract(_c(term), r"(\d+)", 1)
    return F.when(digits != "", digits.try_cast("bigint"))
