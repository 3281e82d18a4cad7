"""Joins that keep hot keys from one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def spread_join(big: DataFrame, small: DataFrame, weights: DataFrame, key: str, by: list[str], how: str = "left", parts: int = 1024) -> DataFrame:
    """Equi-join on ``key`` in which the rows of a hot key of ``big`` are spread over several tasks by their ``by`` columns.

    ``weights`` has the key and, as its last column, the number of rows of ``big`` with it, one row per
    key. Keys that hold a ``parts``-th of all those rows or more are hot: each is cut into as many salts
    as such shares. Only their rows of ``small`` are copied, once per salt. Shares add up to 1, so there
    are at most ``parts`` hot keys (which bounds what is broadcast) and at most 2 x ``parts`` copies.
    Null keys match nothing and are spread as well. Keys without a weight count as not hot.
    """
    n = weights.columns[-1]
    total = weights.agg(F.sum(n).alias("n")).scalar()
    hot = weights.where(F.col(key).isNotNull() & (F.col(n) * parts >= total)).select(key, F.ceil(F.col(n) * parts / total).cast("int").alias("__salts"))
    hot = F.broadcast(hot)
    spread = F.pmod(F.xxhash64(*by), F.when(F.col(key).isNull(), parts).otherwise(F.coalesce("__salts", F.lit(1)))).cast("int")
    salted = big.join(hot, key, "left").withColumn("__salt", spread).drop("__salts")
    copies = small.join(hot, key, "left").withColumn("__salt", F.explode(F.sequence(F.lit(0), F.coalesce("__salts", F.lit(1)) - 1))).drop("__salts")
    return salted.join(copies, [key, "__salt"], how).drop("__salt")


def with_halo(df: DataFrame, key: str, chunk: str, order: list[str], depth: int, halo: str = "__halo") -> DataFrame:
    """The rows and, for each (key, chunk), the key's ``depth`` rows before it, marked by ``halo``.

    Row-based windows of at most that depth can then be computed by (key, chunk) instead of by key, so
    that no task needs all rows of a hot key; afterwards halo rows are dropped. ``chunk`` must grow with
    ``order``. Every chunk has a row, so the last rows of the ``depth`` chunks before are enough.
    """
    from pyspark.sql import Window as W

    rows = F.struct(*df.columns)
    back = W.partitionBy(key, chunk).orderBy(*(F.col(c).desc() for c in order))
    tails = (
        df.withColumn("__n", F.row_number().over(back))
        .where(F.col("__n") <= depth)
        .groupBy(key, chunk)
        .agg(F.sort_array(F.collect_list(F.struct((-F.col("__n")).alias("n"), rows.alias("r")))).alias("__tail"))
    )
    before = W.partitionBy(key).orderBy(chunk).rowsBetween(-depth, -1)
    carried = (
        tails.withColumn("__before", F.flatten(F.collect_list("__tail").over(before)))
        .where(F.size("__before") > 0)
        .select(F.col(chunk).alias("__to"), F.explode(F.slice("__before", F.greatest(F.size("__before") - depth + 1, F.lit(1)), depth)).alias("b"))
        .select("b.r.*", "__to")
    )
    halos = carried.withColumn(chunk, F.col("__to")).drop("__to").withColumn(halo, F.lit(True))
    return df.withColumn(halo, F.lit(False)).unionByName(halos)
