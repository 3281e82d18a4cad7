"""Totals over trailing periods, by binary doubling."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def trailing_totals(df: DataFrame, key: str, day: str, value: str, windows: Sequence[int] = (7, 30)) -> DataFrame:
    """Totals and averages over the last n days for every day from a key's first to its last counted day.

    Block sums of 1, 2, 4, 8, ... days are built by adding the block half as long to itself, shifted;
    a window of n days is the chain of the blocks in n's binary form. All shifts share one
    partitioning and sort, and cost log2(n) additions a row instead of n.

    Returns key, day, value (0 for a day without rows), day_no (1 at the first day) and, for each n,
    total_n and avg_n (over the n days, or as many as there are so far).

    Rows without key, day or value do not count. Of several rows of a day the largest value counts.
    An empty table gives no rows. Other columns are ignored, whatever their names.

    Scale: rows are reduced to one per (key, day) map-side before the shuffle by key, so a hot key is
    bounded by the days of the calendar. Days without rows come from the interval to the next row,
    without a join against a calendar.
    """
    if min(windows, default=0) < 1:
        raise ValueError("windows must be positive numbers of days")
    w = W.partitionBy("k").orderBy("d")
    dense = (
        df.select(F.col(key).alias("k"), F.col(day).cast("date").alias("d"), F.col(value).alias("v"))
        .where(F.col("k").isNotNull() & F.col("d").isNotNull() & F.col("v").isNotNull())
        .groupBy("k", "d")
        .agg(F.max("v").alias("v"))
        .withColumn("until", F.coalesce(F.date_sub(F.lead("d").over(w), 1), F.col("d")))
        .select("k", "v", F.posexplode(F.sequence("d", "until")).alias("i", "d"))
        .select("k", "d", F.when(F.col("i") == 0, F.col("v")).otherwise(F.lit(0).cast(df.schema[value].dataType)).alias("b1"))
    )

    def shifted(column: str, by: int) -> Column:
        return F.coalesce(F.lag(column, by).over(w), F.lit(0)) if by else F.col(column)

    blocks = dense.withColumn("n", F.row_number().over(w))
    size = 1
    while size * 2 <= max(windows):
        blocks = blocks.withColumn(f"b{2 * size}", F.col(f"b{size}") + shifted(f"b{size}", size))
        size *= 2

    out = [F.col("k").alias(key), F.col("d").alias(day), F.col("b1").alias(value), F.col("n").alias("day_no")]
    for n in windows:
        total, offset, rest = None, 0, n
        for p in (1 << b for b in reversed(range(n.bit_length()))):
            if rest & p:
                part = shifted(f"b{p}", offset)
                total = part if total is None else total + part
                offset += p
        blocks = blocks.withColumn(f"total_{n}", total)
        out += [F.col(f"total_{n}"), (F.col(f"total_{n}") / F.least("n", F.lit(n))).alias(f"avg_{n}")]
    return blocks.select(*out)
