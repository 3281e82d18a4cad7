"""Null-safe casts, defaults, ratios and rounding."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Texts that delimited files hold for "no value" (fixed values).
NA_TOKENS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)


def drop_na_tokens(text: Column) -> Column:
    """Null for a text that stands for no value."""
    return F.when(~text.isin(*NA_TOKENS), text)


def to_number(value: Column) -> Column:
    """Double, or null where the value is no number; NaN is null."""
    number = value.try_cast("double")
    return F.when(~F.isnan(number), number)


def number_or(value: Column, default: float) -> Column:
    return F.coalesce(to_number(value), F.lit(float(default)))


def whole_or(value: Column, default: int) -> Column:
    """Whole number of 64 bits, fractions cut off; null, unreadable, endless or too large gives the default."""
    return F.coalesce(value.try_cast("bigint"), to_number(value).try_cast("bigint"), F.lit(default).cast("bigint"))


def text_or(value: Column, default: str) -> Column:
    """The default for null."""
    return F.coalesce(value, F.lit(default))


def filled_text(value: Column, default: str) -> Column:
    """The default for null and for the empty text; blanks are kept."""
    return F.when(value.isNull() | (value == ""), F.lit(default)).otherwise(value)


def is_known(value: Column) -> Column:
    """1 where there is a value (also an empty one), else 0."""
    return value.isNotNull().cast("int")


def strip(value: Column) -> Column:
    """Outer white space of any kind dropped; trim would drop blanks only."""
    return F.regexp_replace(value, r"(?U)^\s+|\s+$", "")


def clean_text(value: Column, default: str = "No Description") -> Column:
    """Outer white space of any kind dropped; the default for null and blank."""
    stripped = strip(value)
    return F.when(stripped.isNull() | (stripped == ""), F.lit(default)).otherwise(stripped)


def per(part: Column, whole: Column) -> Column:
    """part / (whole + 1), as a double; null where the denominator is 0."""
    return F.try_divide(part.cast("double"), whole.cast("double") + 1)


def percent(part: Column, whole: Column) -> Column:
    return F.try_divide(part.cast("double") * 100, whole.cast("double"))


def half_even(value: Column, digits: int = 2) -> Column:
    """Rounded with halves to the even neighbour; F.round would round them up."""
    scale = float(10**digits)
    return F.rint(value * scale) / scale
