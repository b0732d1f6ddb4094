"""Calendar expressions. None needs a Python UDF."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def week_ending_friday(d: Column | str) -> Column:
    """The Friday that closes a Saturday-to-Friday week."""
    return F.next_day(F.date_sub(_c(d), 1), "FRI")


def week_index_monday(d: Column | str, anchor: str = "2019-01-01") -> Column:
    """Number of the Tuesday-to-Monday week; ``anchor`` is a Tuesday."""
    return F.floor(F.datediff(_c(d), F.lit(anchor).cast("date")) / 7).cast("int")


def week_start_tuesday(week: Column | str, anchor: str = "2019-01-01") -> Column:
    return F.date_add(F.lit(anchor).cast("date"), (_c(week) * 7).cast("int"))


def month_end(d: Column | str) -> Column:
    return F.last_day(_c(d))


def quarter_end_month(d: Column | str) -> Column:
    return (F.month(_c(d)) % 3 == 0).cast("int")


def _ordinal(d: Column) -> Column:
    """Days since Monday 1970-01-05, and business days before it follow from it."""
    return F.datediff(d, F.lit("1970-01-05").cast("date"))


def _business(n: Column) -> Column:
    """Business days in [1970-01-05, day n)."""
    return F.floor(n / 7) * 5 + F.least(F.pmod(n, F.lit(7)), F.lit(5))


def add_business_days(d: Column | str, n: int | Column) -> Column:
    """``n`` weekdays later (earlier if negative); no holidays.

    A weekend counts as its Friday going forward and as its Monday going back.
    """
    n = F.lit(n) if isinstance(n, int) else n
    o = _ordinal(_c(d))
    # Forward, a weekend day stands for Friday; back, for Monday.
    index = F.when(n >= 0, _business(o + 1) - 1).otherwise(_business(o))
    to = index + n
    day = F.floor(to / 5) * 7 + F.pmod(to, F.lit(5))
    return F.when(n == 0, _c(d)).otherwise(F.date_add(F.lit("1970-01-05").cast("date"), day.cast("int")))


def business_days_between(a: Column | str, b: Column | str) -> Column:
    """Weekdays in [a, b)."""
    return (_business(_ordinal(_c(b))) - _business(_ordinal(_c(a)))).cast("int")


def first_friday(month: Column | str) -> Column:
    """The first Friday of the month that ``month`` lies in."""
    return F.next_day(F.date_sub(F.trunc(_c(month), "MM"), 1), "FRI")
