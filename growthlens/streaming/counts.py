"""Daily and weekly star counts from a stream of events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_counts(events: DataFrame, key: str = "repo_id", moment: str = "starred_at", days: int = 7, late: str = "14 days", unique: list[str] | None = None) -> DataFrame:
    """key, period_start and new_stars per window of ``days`` days (weeks start on Mondays), on a stream or a table.

    Events later than ``late`` behind the newest one are dropped, which bounds the state. With ``unique``
    columns, repeats of an event within that time count once. Rows without key or moment do not count.
    """
    rows = events.where(F.col(key).isNotNull() & F.col(moment).isNotNull()).withColumn("__at", F.col(moment).cast("timestamp")).withWatermark("__at", late)
    if unique:
        rows = rows.dropDuplicates([*unique, "__at"])
    offset = "4 days" if days % 7 == 0 else "0 days"  # the epoch's first Monday is 1970-01-05
    span = F.window("__at", f"{days} days", startTime=offset)
    counted = rows.groupBy(span.alias("w"), key).agg(F.count(F.lit(1)).alias("new_stars"))
    return counted.select(key, F.col("w.start").cast("date").alias("period_start"), "new_stars")
