"""Feature tables: topic flags, ratios, lags, counts, categories, scaling."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from growthlens.functions.dates import parse_week_start
from growthlens.functions.topics import topic_flags
from growthlens.functions.values import number_or, per, to_number
from growthlens.operators.joins import spread_join, with_halo
from growthlens.operators.profile import numeric_columns, top_k, value_counts

TARGET, ID = "became_high_growth", "repo_id"
#: Columns that know the future, and columns that are no predictors (fixed values).
LEAKAGE = [
    "later_stars", "later_avg_weekly_stars", "later_max_weekly_stars", "stars_count", "forks_count", "watchers_count",
    "open_issues_count", "early_to_total_star_ratio", "forks_per_star", "issues_per_star",
]
NON_MODEL = [
    "full_name", "repo_full_name", "owner", "repo_name", "description", "topics", "html_url", "homepage",
    "created_at", "updated_at", "pushed_at", "collected_at", "language", "license",
]


def add_topic_flags(df: DataFrame, topics: str = "topics") -> DataFrame:
    return df.withColumns(topic_flags(F.col(topics))) if topics in df.columns else df


def add_ratios(df: DataFrame) -> DataFrame:
    """The ratios whose columns exist, each over its denominator plus 1."""
    pairs = {
        "early_to_total_star_ratio": ("early_4week_stars", "stars_count"),
        "early_peak_to_average_ratio": ("early_max_weekly_stars", "early_avg_weekly_stars"),
        "forks_per_star": ("forks_count", "stars_count"),
        "issues_per_star": ("open_issues_count", "stars_count"),
    }
    return df.withColumns({out: per(F.col(a), F.col(b)) for out, (a, b) in pairs.items() if a in df.columns and b in df.columns})


def weekly_features(df: DataFrame, key: str = ID) -> DataFrame:
    """Lags, rolling mean and sum, acceleration and lagged cumulative stars over each key's observed weeks.

    Offsets are rows, not calendar weeks. Rows without key or readable week are dropped; missing counts
    are 0 first; where there is no earlier row the feature is 0. Rows of one week are ordered by
    their counts. All features share one Window, by (key, year) with the three rows before each
    year, so that no task needs all of a hot key's rows.
    """
    if "week_start" not in df.columns:
        df = df.withColumn("week_start", parse_week_start(F.col("week")))
    numbers = [c for c in ("weekly_new_stars", "cumulative_stars", "weekly_growth_rate") if c in df.columns]
    rows = df.withColumns({c: number_or(F.col(c), 0) for c in numbers}).where(F.col("week_start").isNotNull() & F.col(key).isNotNull())
    order = ["week_start", "cumulative_stars", "weekly_new_stars", *(c for c in df.columns if c not in (key, "week_start", "cumulative_stars", "weekly_new_stars"))]
    chunked = with_halo(rows.withColumn("__year", F.trunc("week_start", "year")), key, "__year", order, 3)
    w = W.partitionBy(key, "__year").orderBy(*order)
    new, total = F.col("weekly_new_stars"), F.col("cumulative_stars")
    or_zero = lambda c: F.coalesce(c, F.lit(0.0))
    features: dict[str, Column] = {
        "lag_1_week_stars": or_zero(F.lag(new, 1).over(w)),
        "lag_2_week_stars": or_zero(F.lag(new, 2).over(w)),
        "rolling_3week_mean_stars": F.avg(new).over(w.rowsBetween(-2, 0)),
        "rolling_4week_sum_stars": F.sum(new).over(w.rowsBetween(-3, 0)),
        "weekly_growth_acceleration": or_zero(new - F.lag(new, 1).over(w)),
        "cumulative_growth_lag_1": or_zero(F.lag(total, 1).over(w)),
    }
    return chunked.withColumns(features).where(~F.col("__halo")).drop("__halo", "__year")


def key_counts(df: DataFrame, key: str, out: str) -> DataFrame:
    """Rows per key, aggregated map-side; null keys left out."""
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias(out))


def interaction_counts(interactions: DataFrame, user: str = "user_id", repo: str = ID) -> DataFrame:
    """Interactions with user_activity_count and repo_popularity_count (0 for a null key).

    The rows of busy users and popular repositories spread; only these keys' counts are copied.
    """
    activity, popularity = key_counts(interactions, user, "user_activity_count"), key_counts(interactions, repo, "repo_popularity_count")
    joined = spread_join(interactions, activity, activity, user, [repo])
    joined = spread_join(joined, popularity, popularity, repo, [user])
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return joined.select(*interactions.columns, zero("user_activity_count"), zero("repo_popularity_count"))


def recommendation_features(interactions: DataFrame, repositories: DataFrame) -> DataFrame:
    """Interactions with both counts and the repository's language, topic count, stars and forks; missing ones Unknown or 0.

    Repositories that occur several times multiply their interactions, as in a relational join. The
    repository's count and columns are put together first, so the interactions move once per key.
    """
    side = repositories.select(ID, "language", "topic_count", "stars_count", "forks_count")
    activity, popularity = key_counts(interactions, "user_id", "user_activity_count"), key_counts(interactions, ID, "repo_popularity_count")
    joined = spread_join(interactions, activity, activity, "user_id", [ID])
    joined = spread_join(joined, popularity.join(side, ID, "left"), popularity, ID, ["user_id"])
    counts = [F.coalesce(c, F.lit(0)).alias(c) for c in ("user_activity_count", "repo_popularity_count")]
    numbers = [number_or(F.col(c), 0).alias(c) for c in ("topic_count", "stars_count", "forks_count")]
    return joined.select(*interactions.columns, *counts, F.coalesce("language", F.lit("Unknown")).alias("language"), *numbers)


def frequent_values(df: DataFrame, column: str, k: int) -> list[str]:
    """The k most frequent values, null left out, ties by the value."""
    return [r[0] for r in top_k(value_counts(df, column), "n", k, [column]).collect()]


def group_rare(df: DataFrame, column: str, k: int, out: str, absent: str) -> DataFrame:
    """The column's k most frequent values kept, all others and null "Other"; a table without the column gets ``absent``."""
    if column not in df.columns:
        return df.withColumn(out, F.lit(absent))
    kept = F.col(column).isin(frequent_values(df, column, k))
    return df.withColumn(out, F.when(kept, F.col(column)).otherwise(F.lit("Other")))


def one_hot(df: DataFrame, columns: Sequence[str], most: int = 1000) -> DataFrame:
    """Each column replaced by 0/1 columns ``<column>_<value>`` at the end, values sorted; null is 0 in all.

    The values become columns, so over ``most`` of them are refused.
    """
    added: dict[str, Column] = {}
    for c in columns:
        values = [r[0] for r in df.select(c).where(F.col(c).isNotNull()).distinct().limit(most + 1).collect()]
        if len(values) > most:
            raise ValueError(f"{c} has over {most} values")
        added |= {f"{c}_{v}": F.coalesce((F.col(c) == v).cast("int"), F.lit(0)) for v in sorted(values)}
    return df.withColumns(added).drop(*columns)


def predictors(df: DataFrame) -> list[str]:
    """Numeric and boolean columns but the id and the target."""
    return [c for c in numeric_columns(df, flags=True) if c not in (ID, TARGET)]


@dataclass(frozen=True)
class Scaler:
    """Means and population standard deviations, fitted once and applied to any table."""

    means: dict[str, float | None]
    deviations: dict[str, float | None]

    @staticmethod
    def fit(df: DataFrame, columns: Sequence[str]) -> Scaler:
        """One pass over all columns; null does not count."""
        columns = list(columns)
        if not columns:
            return Scaler({}, {})
        x = [F.col(f"`{c}`").cast("double") for c in columns]
        row = df.agg(*(F.avg(v) for v in x), *(F.stddev_pop(v) for v in x)).first()
        return Scaler(dict(zip(columns, row[: len(columns)])), dict(zip(columns, row[len(columns) :])))

    def transform(self, df: DataFrame) -> DataFrame:
        """(x - mean) / deviation; 0 where a column has no spread."""

        def scaled(c: str) -> Column:
            if not self.deviations[c]:
                return F.when(F.col(f"`{c}`").isNotNull(), F.lit(0.0))
            return (F.col(f"`{c}`").cast("double") - F.lit(self.means[c])) / F.lit(self.deviations[c])

        return df.withColumns({c: scaled(c) for c in self.means})


def herd_features(herd: DataFrame) -> DataFrame:
    return add_ratios(add_topic_flags(herd))


def model_table(herd: DataFrame) -> DataFrame:
    """Herd features without leakage: categories grouped and one-hot, id, target and predictors, unscaled, nulls 0."""
    df = group_rare(herd, "language", 8, "language_grouped", "Unknown")
    df = group_rare(df, "license", 6, "license_grouped", "No License")
    df = one_hot(df, ["language_grouped", "license_grouped"]).drop(*LEAKAGE).drop(*NON_MODEL)
    as_number = lambda c: F.coalesce(to_number(F.col(f"`{c}`").cast("int") if isinstance(df.schema[c].dataType, T.BooleanType) else F.col(f"`{c}`")), F.lit(0.0))
    return df.withColumns({c: as_number(c) for c in predictors(df)})


def model_ready(herd: DataFrame) -> DataFrame:
    """The model table with standardised predictors, fitted on all rows."""
    table = model_table(herd)
    return Scaler.fit(table, predictors(table)).transform(table)
