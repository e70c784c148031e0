"""Dates and date ranges."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MONTHS = "jan feb mar apr may jun jul aug sep oct nov dec".split()
DAY_WINDOW = 7  # days between starts of one event in two sources
#: Shapes of a date or range whose months, days, years and dashes are written as one character each.
SHAPES = ("& #-# @", "& #-& # @", "& # @-& # @", "& # @")
_KINDS = ((r"(?<!\d)\d{4}(?!\d)", "@"), (r"(?<!\d)\d{1,2}(?!\d)", "#"), (r"(?<![A-Za-z])[A-Za-z]{3,9}\.?(?![A-Za-z.])", "&"), (r"\s*[-–—]\s*", "-"), (r"#, ?(?=@)", "# "))


def month_number(word: Column) -> Column:
    """By the first three letters; null if there is no such month."""
    place = F.array_position(F.array(*map(F.lit, MONTHS)), F.lower(F.substring(word, 1, 3))).cast("int")
    return F.when(place > 0, place)


def _date(y: Column, m: Column, d: Column) -> Column:
    return F.try_to_date(F.concat_ws("-", F.when(m.isNotNull(), F.lpad(y.cast("string"), 4, "0")), m.cast("string"), d.cast("string")), "yyyy-M-d")


def parse_date_range(raw: Column) -> Column:
    """Struct of start and end; null for anything that is no valid range.

    The text is read as months, days and years; its shape must be one of SHAPES.  The first of each kind belongs to the
    start, the last to the end, so a single date or a shared month or year serves both.  A range with one year that
    goes from a later month to an earlier one begins the year before.
    """
    s = F.trim(F.regexp_replace(F.coalesce(raw, F.lit("")), r"\s+", " "))
    shape = s
    for pattern, kind in _KINDS:
        shape = F.regexp_replace(shape, pattern, kind)
    every = lambda pattern: F.regexp_extract_all(s, F.lit(f"({pattern})"))
    years, days, months = (every(pattern) for pattern, _ in _KINDS[:3])
    end_of = lambda values: F.get(values, F.size(values) - 1)
    number = lambda value: value.try_cast("int")
    month, last_month = month_number(F.get(months, F.lit(0))), month_number(end_of(months))
    turn = F.when((F.size(years) == 1) & (month > last_month), 1).otherwise(0)
    start = _date(number(F.get(years, F.lit(0))) - turn, month, number(F.get(days, F.lit(0))))
    end = _date(number(end_of(years)), last_month, number(end_of(days)))
    return F.when(shape.isin(*SHAPES) & start.isNotNull() & end.isNotNull() & (end >= start), F.struct(start.alias("start"), end.alias("end")))


def parse_month(raw: Column) -> Column:
    """First day of "Month 2024", else null."""
    pattern = r"^\s*([A-Za-z]+)\.?\s+(\d{4})\s*$"
    m = month_number(F.regexp_extract(raw, pattern, 1))
    return F.when(raw.rlike(pattern), _date(F.regexp_extract(raw, pattern, 2), m, F.lit(1)))


def extract_us_date(text: Column) -> Column:
    """The date after "at" as MM/DD/YYYY."""
    pattern = r"\bat (\d{1,2})/(\d{1,2})/(\d{4})"
    g = lambda i: F.regexp_extract(text, pattern, i)
    return F.when(text.rlike(pattern), F.try_to_date(F.concat_ws("-", g(3), g(1), g(2)), "yyyy-M-d"))


def month_of(d: Column) -> Column:
    return F.trunc(d, "month")


def dates_compatible(a_start, a_end, a_precision, b_start, b_end, b_precision, days: int = DAY_WINDOW) -> Column:
    """D3: two events may be one, as far as their dates and precisions tell."""
    year = (a_precision == "year") | (b_precision == "year")
    month = (a_precision == "month") | (b_precision == "month")
    months = lambda s, e: F.array(month_of(s), month_of(F.coalesce(e, s)))  # noqa: E731  (S5)
    fits = F.when(year, F.year(a_start) == F.year(b_start)).when(month, F.arrays_overlap(months(a_start, a_end), months(b_start, b_end))).otherwise(F.abs(F.datediff(a_start, b_start)) <= days)
    return F.coalesce(a_start.isNotNull() & b_start.isNotNull() & fits, F.lit(False))


def is_fresh(fetched: Column, now: Column, ttl: str) -> Column:
    """Fetched less than ``ttl`` (an interval such as '24 hours') before ``now``."""
    return F.coalesce(fetched > now - F.expr(f"INTERVAL {ttl}"), F.lit(False))


def with_year(start: Column, end: Column) -> Column:
    """Struct of start, end (start if missing) and year."""
    return F.struct(start.alias("start_date"), F.coalesce(end, start).alias("end_date"), F.year(start).alias("year"))


def cutoff(today: Column, days: int) -> Column:
    """D7."""
    return F.date_sub(today, days)
