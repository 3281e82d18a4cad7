"""Cleaning rules of the six tables. Rules of columns that a table lacks are left out."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from growthlens.functions.dates import REFERENCE_DAY, age_days, parse_week_start, to_utc
from growthlens.functions.topics import topic_count
from growthlens.functions.values import clean_text, filled_text, is_known, number_or, per, text_or, to_number, whole_or
from growthlens.operators.profile import exact_percentiles

#: Columns whose nulls become the column's median (fixed values).
REPOSITORY_NUMBERS = ["stars_count", "forks_count", "watchers_count", "open_issues_count", "repo_age_days", "days_since_update", "days_since_push", "topic_count", "description_length"]
HERD_NUMBERS = [
    "stars_count", "forks_count", "watchers_count", "open_issues_count", "early_4week_stars", "early_avg_weekly_stars",
    "early_max_weekly_stars", "later_stars", "later_avg_weekly_stars", "later_max_weekly_stars", "topic_count",
]


def where_present(df: DataFrame, rules: dict[str, tuple[str, Column]]) -> DataFrame:
    """Apply {out: (needed column, expression)} where the needed column exists, in one projection."""
    return df.withColumns({out: e for out, (needed, e) in rules.items() if needed in df.columns})


def coerce_moments(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Timestamps of the columns that exist; unreadable texts become null, row by row. Typed columns stay as they are."""
    typed = (T.TimestampType, T.TimestampNTZType)
    return where_present(df, {c: (c, to_utc(F.col(c))) for c in columns if c in df.columns and not isinstance(df.schema[c].dataType, typed)})


def impute_medians(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Columns as numbers, nulls replaced by the column's exact median (null where there is none).

    All medians come from the same two passes over the table; a handful of numbers goes through the driver.
    """
    columns = [c for c in columns if c in df.columns]
    numbers = df.withColumns({c: to_number(F.col(c)) for c in columns})
    medians = exact_percentiles(numbers, columns, [0.5])
    return numbers.withColumns({c: F.coalesce(F.col(c), F.lit(medians[c][0]).cast("double")) for c in columns})


def clean_repositories(df: DataFrame, reference: str = REFERENCE_DAY, delimiter: str = ",") -> DataFrame:
    """Repositories with defaults, counts, ages in days at the reference day, calendar parts and ratios."""
    df = coerce_moments(df, ["created_at", "updated_at", "pushed_at", "collected_at"])
    df = where_present(
        df,
        {
            "language": ("language", filled_text(F.col("language"), "Unknown")),
            "license": ("license", filled_text(F.col("license"), "No License")),
            "has_homepage": ("homepage", is_known(F.col("homepage"))),
            "homepage": ("homepage", text_or(F.col("homepage"), "No Homepage")),
            "description": ("description", clean_text(F.col("description"))),
            "topics": ("topics", text_or(F.col("topics"), "[]")),
            "repo_age_days": ("created_at", age_days(F.col("created_at"), reference)),
            "created_year": ("created_at", F.year("created_at")),
            "created_month": ("created_at", F.month("created_at")),
            "created_weekday": ("created_at", F.weekday("created_at")),
            "days_since_update": ("updated_at", age_days(F.col("updated_at"), reference)),
            "days_since_push": ("pushed_at", age_days(F.col("pushed_at"), reference)),
        },
    )
    df = where_present(df, {"description_length": ("description", F.length("description")), "topic_count": ("topics", topic_count(F.col("topics"), delimiter))})
    df = impute_medians(df, REPOSITORY_NUMBERS)
    pairs = {"stars_per_day": ("stars_count", "repo_age_days"), "forks_per_star": ("forks_count", "stars_count"), "issues_per_star": ("open_issues_count", "stars_count")}
    return df.withColumns({out: per(F.col(a), F.col(b)) for out, (a, b) in pairs.items() if a in df.columns and b in df.columns})


def clean_stars(df: DataFrame) -> DataFrame:
    df = coerce_moments(df, ["starred_at", "collected_at"])
    return where_present(
        df,
        {
            "repo_id": ("repo_id", F.col("repo_id").try_cast("bigint")),
            "user_id": ("user_id", F.col("user_id").try_cast("bigint")),
            "username": ("username", text_or(F.col("username"), "unknown_user")),
        },
    )


def clean_interactions(df: DataFrame) -> DataFrame:
    return where_present(clean_stars(df), {"interaction": ("interaction", whole_or(F.col("interaction"), 1))})


def clean_daily(df: DataFrame) -> DataFrame:
    if "date" in df.columns and not isinstance(df.schema["date"].dataType, T.DateType):
        df = df.withColumn("date", to_utc(F.col("date")).cast("date"))
    return where_present(df, {c: (c, number_or(F.col(c), 0)) for c in ("daily_new_stars", "cumulative_stars", "daily_growth_rate")})


def clean_weekly(df: DataFrame) -> DataFrame:
    df = where_present(df, {"week_start": ("week", parse_week_start(F.col("week")))})
    numbers = ("weekly_new_stars", "cumulative_stars", "previous_week_stars", "weekly_growth_rate", "herd_momentum_score")
    return where_present(df, {c: (c, number_or(F.col(c), 0)) for c in numbers})


def clean_herd(df: DataFrame, delimiter: str = ",") -> DataFrame:
    df = where_present(
        df,
        {
            "repo_id": ("repo_id", F.col("repo_id").try_cast("bigint")),
            "language": ("language", filled_text(F.col("language"), "Unknown")),
            "license": ("license", filled_text(F.col("license"), "No License")),
            "topics": ("topics", text_or(F.col("topics"), "[]")),
            "topic_count": ("topics", topic_count(text_or(F.col("topics"), "[]"), delimiter)),
            "became_high_growth": ("became_high_growth", whole_or(F.col("became_high_growth"), 0)),
        },
    )
    return impute_medians(df, HERD_NUMBERS)


CLEANERS = {
    "repositories": clean_repositories,
    "stars": clean_stars,
    "user_repo_interactions": clean_interactions,
    "daily_timeseries": clean_daily,
    "weekly_timeseries": clean_weekly,
    "herd_modeling": clean_herd,
}


def clean_all(tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    return {name: CLEANERS[name](df) for name, df in tables.items()}
