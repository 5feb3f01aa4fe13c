"""Dates of birth and ages.  The clock is a parameter everywhere."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column
from pyspark.sql import functions as F

from recordloom.functions.text import normalize_text

# The first three letters of an English month name, then the rest of it or nothing.
_MONTH = (
    "(jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)"
    "(?:(?<=jan)uary|(?<=feb)ruary|(?<=mar)ch|(?<=apr)il|(?<=jun)e|(?<=jul)y|(?<=aug)ust|(?<=sep)(?:t|tember)"
    "|(?<=oct)ober|(?<=nov)ember|(?<=dec)ember)?"
)
DAY_SECONDS = 86_400
# What year-month-day may look like; other text never is a date, and trying it costs an exception.
_YMD = r"^[-+]?\d+-[^-]+-[-+]?\d+$"


def _date(text: Column, pattern: str, ymd: str, form: str = "y-M-d") -> Column:
    """Midnight UTC of the date that ``pattern`` finds; ``ymd`` puts its groups in year-month-day order.

    Other text, and dates that no calendar has, give null.
    """
    ordered = F.regexp_replace(text, pattern, ymd)
    return F.try_to_timestamp(F.when(ordered.rlike(_YMD), ordered), F.lit(form))


def _free_form(text: Column) -> Column:
    """The written date formats that are accepted besides year-month-day, day before month."""
    numeric = r"^(\d{1,2})[-/. ](\d{1,2})[-/. ](\d{4})$"
    year_first = r"^(\d{4})[-/.](\d{1,2})[-/.](\d{1,2})$"
    with_time = r"^\d{4}-\d{1,2}-\d{1,2}[T ]\d{1,2}:\d{2}.*$"
    day_word = rf"^(\d{{1,2}})(?:st|nd|rd|th)?[- ,.]+{_MONTH}[- ,.]+(\d{{4}})$"
    word_day = rf"^{_MONTH}[- .]+(\d{{1,2}})(?:st|nd|rd|th)?[- ,.]+(\d{{4}})$"
    return F.coalesce(
        _date(text, numeric, "$3-$2-$1"),
        _date(text, numeric, "$3-$1-$2"),
        _date(text, year_first, "$1-$3-$2"),
        _date(text, year_first, "$1-$2-$3"),
        F.try_to_timestamp(F.regexp_extract(text, with_time, 0)),
        _date(F.lower(text), day_word, "$3-$2-$1", "y-MMM-d"),
        _date(F.lower(text), word_day, "$3-$1-$2", "y-MMM-d"),
    )


def _year_start(year: Column) -> Column:
    return F.try_to_timestamp(year, F.lit("yyyy"))


def _accept(moment: Column, as_of: datetime) -> Column:
    """Unix seconds of moments from 1900 to now."""
    seconds = F.unix_seconds(moment)
    earliest = int((datetime(1900, 1, 1) - datetime(1970, 1, 1)).total_seconds())
    return F.when((seconds >= earliest) & (seconds <= int(as_of.timestamp())), seconds)


def clean_dob(value: Column, as_of: datetime) -> Column:
    """Date of birth text -> Unix seconds; unreadable, future and pre-1900 dates -> null."""
    return dob_from_text(normalize_text(value), as_of)


def dob_from_text(text: Column, as_of: datetime) -> Column:
    """:func:`clean_dob` for text that is normalised already."""
    moment = F.coalesce(
        # A year with digits too many keeps its first four.
        _date(text, r"^(\d{4})\d*[-/](\d{1,2})[-/](\d{1,2})$", "$1-$2-$3"),
        _date(text, r"^(\d{4})$", "$1-1-1"),
        _free_form(F.regexp_replace(text, r"^(\d{4})\d+(?=[-/])", "$1")),
    )
    return _accept(moment, as_of)


def dob_from_number(value: Column, as_of: datetime) -> Column:
    """Numeric dates: milliseconds, seconds or a bare year, told apart by size."""
    n = value.cast("double")
    year = F.floor(n).cast("string")
    moment = (
        F.when(n > 1e10, F.timestamp_micros(F.floor(n * 1000).cast("bigint")))
        .when(n > 1e7, F.timestamp_seconds(n))
        .when((n >= 1900) & (n <= as_of.year), _year_start(year))
    )
    return _accept(F.when(~F.isnan(n), moment), as_of)


def estimate_age(seconds: Column, as_of: datetime) -> Column:
    """Whole days since birth / 365.25; births before 1970 and in the future give null."""
    s = seconds.try_cast("double")
    days = F.floor((F.lit(int(as_of.timestamp())) - s) / DAY_SECONDS)
    return F.when((s > 0) & (days >= 0), days / F.lit(365.25))


def dob_from_age(age: Column, as_of: datetime) -> Column:
    """1 January of (this year - age) for ages 3 to 120."""
    n = age.try_cast("double")
    years = F.when(~F.isnan(n) & (F.abs(n) < 1000), F.when(n < 0, F.ceil(n)).otherwise(F.floor(n)))
    start = _year_start((F.lit(as_of.year) - years).cast("string"))
    return F.when(years.between(3, 120), F.unix_seconds(start))


def sheet_date(value: Column) -> Column:
    """Unix seconds -> dd-MM-yyyy; zero, negative and missing -> null."""
    s = F.when(value > 10_000_000_000, value / 1000.0).otherwise(value.cast("double"))
    return F.when(s > 0, F.date_format(F.timestamp_seconds(s), "dd-MM-yyyy"))


def sheet_date_text(value: Column) -> Column:
    """Text dates in four formats -> dd-MM-yyyy; any other text unchanged, empty -> null."""
    text = F.trim(value)
    moment = F.coalesce(
        _date(text, r"^(\d{1,2})[-/](\d{1,2})[-/](\d{4})$", "$3-$2-$1"),
        _date(text, r"^(\d{4})[-/](\d{1,2})[-/](\d{1,2})$", "$1-$2-$3"),
    )
    return F.when(text != "", F.coalesce(F.date_format(moment, "dd-MM-yyyy"), text))
