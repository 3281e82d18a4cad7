"""Daily and weekly series, and the early/later table, from raw star events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from growthlens.functions.dates import monday
from growthlens.operators.profile import exact_percentiles


def running(series: DataFrame, key: str, period: str, new: str) -> DataFrame:
    """Add cumulative (running sum), previous (null at first) and growth_rate ((new - previous) / previous).

    One row per key and period is expected, so a key's rows are bounded by the calendar.
    """
    w = W.partitionBy(key).orderBy(period)
    previous = F.lag(new).over(w)
    return series.withColumns(
        {
            "cumulative_stars": F.sum(new).over(w.rowsBetween(W.unboundedPreceding, 0)),
            "previous": previous,
            "growth_rate": F.try_divide((F.col(new) - previous).cast("double"), previous.cast("double")),
        }
    )


def derive_daily(events: DataFrame, key: str = "repo_id", moment: str = "starred_at") -> DataFrame:
    """key, date, daily_new_stars, cumulative_stars and daily_growth_rate; only days with events. Null keys and moments are left out."""
    days = (
        events.select(key, F.col(moment).cast("date").alias("date")).dropna().groupBy(key, "date").agg(F.count(F.lit(1)).alias("daily_new_stars"))
    )
    return running(days, key, "date", "daily_new_stars").drop("previous").withColumnRenamed("growth_rate", "daily_growth_rate")


def derive_weekly(events: DataFrame, key: str = "repo_id", moment: str = "starred_at") -> DataFrame:
    """The Monday-to-Sunday series with previous_week_stars, weekly_growth_rate and herd_momentum_score; only weeks with events.

    The momentum is the previous week's stars (0 at first) times the cumulative ones.
    """
    start = monday(F.col(moment).cast("date"))
    weeks = events.select(key, start.alias("week_start")).dropna().groupBy(key, "week_start").agg(F.count(F.lit(1)).alias("weekly_new_stars"))
    return (
        running(weeks, key, "week_start", "weekly_new_stars")
        .withColumnsRenamed({"previous": "previous_week_stars", "growth_rate": "weekly_growth_rate"})
        .withColumn("week", F.concat_ws("/", F.col("week_start").cast("string"), F.date_add("week_start", 6).cast("string")))
        .withColumn("herd_momentum_score", (F.coalesce("previous_week_stars", F.lit(0)) * F.col("cumulative_stars")).cast("double"))
    )


def early_later(weekly: DataFrame, key: str = "repo_id", period: str = "week_start", new: str = "weekly_new_stars", early: int = 4) -> DataFrame:
    """Sums, means and maxima over each key's first ``early`` observed weeks and over the rest (0 where there is none)."""
    numbered = weekly.withColumn("__n", F.row_number().over(W.partitionBy(key).orderBy(period)))
    first, rest = F.when(F.col("__n") <= early, F.col(new)), F.when(F.col("__n") > early, F.col(new))
    return numbered.groupBy(key).agg(
        F.sum(first).alias("early_4week_stars"),
        F.avg(first).alias("early_avg_weekly_stars"),
        F.max(first).alias("early_max_weekly_stars"),
        F.coalesce(F.sum(rest), F.lit(0)).alias("later_stars"),
        F.coalesce(F.avg(rest), F.lit(0.0)).alias("later_avg_weekly_stars"),
    )


def growth_target(herd: DataFrame, later: str = "later_stars", threshold: float | None = None) -> DataFrame:
    """became_high_growth: 1 where the later stars reach the threshold, by default their median over all rows."""
    if threshold is None:
        threshold = exact_percentiles(herd, [later], [0.5])[later][0]
    return herd.withColumn("became_high_growth", F.coalesce((F.col(later) >= F.lit(threshold).cast("double")).cast("int"), F.lit(0)))
