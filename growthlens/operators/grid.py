"""Irregular readings onto a regular grid, by validity intervals."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

DAY = 86_400
#: 1970-01-05, the first Monday of the epoch, in seconds.
MONDAY = 4 * DAY


def interval_grid(
    df: DataFrame,
    key: str,
    time: str,
    value: str,
    cell: int = DAY,
    anchor: int = 0,
    span: int | None = None,
    max_hold: int | None = None,
    chunk_cells: int = 4096,
) -> DataFrame:
    """A row for every grid cell from a key's first reading to the end of its last one's validity.

    A reading is a step function: it is *measured* for ``span`` seconds (one cell unless given) or
    until the key's next reading, and *held* from there to the next reading, at most ``max_hold``
    seconds after its time (no limit unless given). These intervals are cut at the cells' borders.

    Returns key, cell_start (timestamp), coverage (share of the cell that is measured), held (share that
    is held), mean_value (time-weighted over both, null if neither), filled (nothing measured).

    Rows without key, time or value are no readings. Of readings at one instant the largest value
    counts. An empty table gives no rows. Other columns are ignored, whatever their names.

    Scale: readings are reduced per (key, instant) first, so repeats of a hot key collapse map-side.
    The next reading is looked up within (key, chunk of ``chunk_cells`` cells) and, for a chunk's last
    reading, from one row per chunk, so no task sorts all of a hot key.
    """
    span = span or cell
    t = F.col(time).cast("timestamp").cast("long")
    raw = (
        df.select(F.col(key).alias("k"), t.alias("t"), F.col(value).cast("double").alias("v"))
        .where(F.col("k").isNotNull() & F.col("t").isNotNull() & F.col("v").isNotNull())
        .withColumn("chunk", F.expr(f"(t - {anchor}) div {cell * chunk_cells}"))
    )
    readings = raw.groupBy("k", "chunk", "t").agg(F.max("v").alias("v"))
    within = readings.withColumn("next_t", F.lead("t").over(W.partitionBy("k", "chunk").orderBy("t"))).where("next_t is not null").select("k", "t", "v", "next_t")
    # a chunk's first and last reading, reduced where they are read: a row per chunk is all that moves
    ends = raw.groupBy("k", "chunk").agg(F.min("t").alias("first_t"), F.max("t").alias("t"), F.max_by("v", F.struct("t", "v")).alias("v"))
    over = ends.select("k", "t", "v", F.lead("first_t").over(W.partitionBy("k").orderBy("chunk")).alias("next_t"))
    steps = within.unionByName(over)

    measured_end = F.least(F.col("t") + span, F.col("next_t"))  # least ignores null: the last reading has no next
    hold_end = F.col("next_t")  # nothing is held after the last reading
    if max_hold is not None:
        hold_end = F.when(F.col("next_t").isNotNull(), F.least(F.col("next_t"), F.col("t") + max(max_hold, span)))
    piece = lambda kind, start, end: F.struct(F.lit(kind).alias("kind"), start.alias("s"), end.alias("e"))
    pieces = F.array(
        piece("measured", F.col("t"), measured_end),
        piece("held", measured_end, F.coalesce(hold_end, measured_end)),
        piece("void", F.coalesce(hold_end, measured_end), F.coalesce("next_t", measured_end)),
    )
    cut = (
        steps.select("k", "v", F.explode(F.filter(pieces, lambda p: p["e"] > p["s"])).alias("p"))
        .select("k", "v", "p.*")
        .withColumn("lo", F.floor((F.col("s") - anchor) / cell))
        .withColumn("hi", F.floor((F.col("e") - 1 - anchor) / cell))
        .select("k", "v", "kind", "s", "e", F.explode(F.sequence("lo", "hi")).alias("c"))
        .withColumn("c0", F.col("c") * cell + anchor)
        .withColumn("part", F.least("e", F.col("c0") + cell) - F.greatest("s", "c0"))
    )
    of = lambda kind: F.sum(F.when(F.col("kind") == kind, F.col("part")).otherwise(0))
    known = F.when(F.col("kind") != "void", F.col("part"))
    return (
        cut.groupBy("k", "c0")
        .agg(
            (of("measured") / cell).alias("coverage"),
            (of("held") / cell).alias("held"),
            (F.sum(F.col("v") * known) / F.sum(known)).alias("mean_value"),
        )
        .select(
            F.col("k").alias(key),
            F.timestamp_seconds("c0").alias("cell_start"),
            "coverage",
            "held",
            "mean_value",
            (F.col("coverage") == 0).alias("filled"),
        )
    )
