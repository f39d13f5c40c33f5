"""Date column expressions. Numeric dates are read day first everywhere."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gridledger.functions.numbers import ColumnOrName, col

# Formats accepted in report-date cells, in order of preference.
REPORT_DATE_FORMATS = ("dMMMyy", "d-M-yyyy", "yyyy-M-d")
FREE_DATE_FORMATS = (
    "d/M/yyyy", "d.M.yyyy", "yyyy/M/d", "dMMMyyyy", "d MMM yyyy", "d-MMM-yyyy", "d-MMM-yy",
    "d-M-yy", "d/M/yy", "yyyyMMdd", "yyyy-M-d H:mm:ss", "d-M-yyyy H:mm:ss", "d/M/yyyy H:mm:ss",
    "d/M/yyyy H:mm",
)

# Dates written in questions.
QUESTION_DATE = r"(\d{2})[-/](\d{2})[-/](\d{4})"
LOOSE_NUMERIC_DATE = r"(\d{1,2})[-/](\d{1,2})[-/](\d{2,4})"
LOOSE_MONTH_DATE = r"(\d{1,2})([A-Za-z]{3})(\d{2,4})"
CENTURY_SPLIT = 50

# Fixed value: two-digit years in report-date cells from here on mean 19xx.
SHORT_YEAR_SPLIT = 69


def _parsed(c: Column, fmt: str) -> Column:
    day = F.try_to_timestamp(c, F.lit(fmt)).cast("date")
    if "yy" in fmt and "yyyy" not in fmt:
        # Two digits are read as 2000-2099; 69 and above belong to the last century.
        day = F.when(F.year(day) >= 2000 + SHORT_YEAR_SPLIT, F.add_months(day, -1200)).otherwise(day)
    return day


def _first_match(c: Column, formats: tuple[str, ...]) -> Column:
    return F.coalesce(*[_parsed(c, f) for f in formats])


def parse_report_date(c: ColumnOrName) -> Column:
    """Report-date text -> date; an en dash counts as a hyphen; junk -> null."""
    text = F.replace(F.trim(col(c)), F.lit("–"), F.lit("-"))
    return _first_match(text, REPORT_DATE_FORMATS + FREE_DATE_FORMATS)


def parse_date_dayfirst(c: ColumnOrName) -> Column:
    """Any supported date text, day first; junk -> null."""
    return _first_match(F.trim(col(c)), ("d-M-yyyy", "yyyy-M-d", "dMMMyy") + FREE_DATE_FORMATS)


def iso_date(c: ColumnOrName) -> Column:
    """`yyyy-MM-dd` text; null stays null."""
    return col(c).cast("date").cast("string")


def extract_date(c: ColumnOrName) -> Column:
    """First `dd-mm-yyyy` or `dd/mm/yyyy` in a text; an impossible date -> null."""
    day, month, year = (F.regexp_extract(col(c), QUESTION_DATE, i) for i in (1, 2, 3))
    return F.try_to_timestamp(F.concat_ws("-", day, month, year), F.lit("dd-MM-yyyy")).cast("date")


def _full_year(year: Column) -> Column:
    short = F.when(year.cast("int") < CENTURY_SPLIT, F.concat(F.lit("20"), year)).otherwise(
        F.concat(F.lit("19"), year)
    )
    return F.when(F.length(year) == 2, short).otherwise(year)


def _dated(c: Column, pattern: str, fmt: str) -> Column:
    day, month, year = (
        F.nullif(F.regexp_extract(c, pattern, i), F.lit("")) for i in (1, 2, 3)
    )
    text = F.concat(day, F.lit("-"), F.initcap(month), F.lit("-"), _full_year(year))
    return F.try_to_timestamp(text, F.lit(fmt)).cast("date")


def extract_date_loose(c: ColumnOrName) -> Column:
    """First loosely written date in a text: `5/11/24` style first, then `5Nov24` style.

    An impossible numeric date gives way to the month-name form.
    """
    return F.coalesce(
        _dated(col(c), LOOSE_NUMERIC_DATE, "d-M-yyyy"),
        _dated(col(c), LOOSE_MONTH_DATE, "d-MMM-yyyy"),
    )
