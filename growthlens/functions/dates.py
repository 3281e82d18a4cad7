"""Date, week and age expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Day from which ages are counted unless another is given.
REFERENCE_DAY = "2026-06-14"
DAY_MICROS = 86_400_000_000


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is evaluated once, however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def monday(day: Column) -> Column:
    """The Monday of the day's week."""
    return F.trunc(day, "week")


def parse_week_start(text: Column) -> Column:
    """Date of the part before the first ``/``, read as an ISO date, moment, month or year; null where it is none.

    This is the reference pipeline's reading; ``read_week`` knows more writings.
    """
    return F.try_to_timestamp(F.trim(F.substring_index(text, "/", 1))).cast("date")


def read_week(text: Column) -> Column:
    """Monday of a week written in any of several ways, else null.

    Understood: a first (or only) date that exists in the calendar, year first with ``-``, ``/``,
    ``.`` or nothing between, or day first with dots; or an ISO year and week. Outer blanks, a
    time of day and whatever follows the first date are ignored.
    """
    dashed = F.regexp_replace(text, r"(?s)^(?U)\s*(\d{4})(?:([-/.])(\d{1,2})\2(\d{1,2})|(\d{2})(\d{2}))(?!\d).*$", "=$1-$3$5-$4$6")
    dashed = F.regexp_replace(dashed, r"(?s)^(?U)\s*(\d{1,2})\.(\d{1,2})\.(\d{4})(?!\d).*$", "=$3-$2-$1")
    dashed = F.regexp_replace(dashed, r"(?s)^(?U)\s*(\d{4})-?[Ww](\d{2})(?!\d).*$", "=$1W$2")

    def iso(week_text: Column) -> Column:
        year, week = F.substring(week_text, 2, 4), F.substring(week_text, 7, 2).try_cast("int")
        start = F.date_add(monday(F.try_to_date(F.concat(year, F.lit("-01-04")), "yyyy-MM-dd")), (week - 1) * 7)
        return let(start, lambda s: F.when(F.weekofyear(s) == week, s))

    return let(
        dashed,
        lambda d: F.when(d.rlike(r"^=\d{4}W"), iso(d)).when(d.startswith("="), monday(F.try_to_date(F.substring(d, 2, 10), "y-M-d"))),
    )


def month_key(moment: Column) -> Column:
    """``YYYY-MM`` of a date or timestamp, ``unknown`` for null."""
    return F.coalesce(F.substring(moment.cast("string"), 1, 7), F.lit("unknown"))


def to_utc(value: Column) -> Column:
    """Timestamp of ISO text or of a timestamp; null where unreadable."""
    return F.try_to_timestamp(value.cast("string"))


def age_days(moment: Column, reference: str = REFERENCE_DAY) -> Column:
    """Whole days from ``moment`` to the reference day's midnight, rounded down, not below 0; null stays null.

    Neither datediff (counts midnights) nor timestampdiff (rounds towards 0) has this meaning.
    """
    ref = F.unix_micros(F.lit(reference).cast("timestamp"))
    days = F.floor((ref - F.unix_micros(moment.cast("timestamp"))) / F.lit(float(DAY_MICROS))).cast("long")
    return F.when(days < 0, F.lit(0).cast("long")).otherwise(days)
