"""References to records that do not exist, by bitmaps over dictionary codes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from growthlens.session import stored

#: Bits of a bitmap word.
WORD = 64
LEAST_RANGES, RANGE_ROWS = 64, 1 << 20


def bit(position: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), position)


def bits_of(word: Column) -> Column:
    """Positions of a word's set bits."""
    return F.filter(F.sequence(F.lit(0), F.lit(WORD - 1)), lambda i: word.bitwiseAND(bit(i)) != 0)


def key_dictionary(keys: DataFrame, ranges: int) -> DataFrame:
    """Distinct keys (column id) with codes: a range (by hash) and a dense rank in it, as word and bit.

    Ranks are given range by range, so no task orders more than 1/``ranges`` of the keys.
    """
    rank = F.row_number().over(W.partitionBy("range").orderBy("id")) - 1
    return (
        keys.select("id")
        .where(F.col("id").isNotNull())
        .distinct()
        .withColumn("range", F.pmod(F.xxhash64("id"), F.lit(ranges)).cast("int"))
        .withColumn("rank", rank)
        .select("id", "range", F.floor(F.col("rank") / WORD).cast("int").alias("word"), (F.col("rank") % WORD).cast("int").alias("bit"))
    )


def find_orphans(
    references: DataFrame,
    parents: DataFrame,
    removed: DataFrame,
    late_sources: tuple[str, ...] = (),
    ranges: int | None = None,
) -> DataFrame:
    """Orphan references per source and period.

    ``references``: src (string), id, period (string), seen_at (timestamp or null). ``parents``: id,
    arrived_at. ``removed``: id. Returns distinct src, id, kind, period: kind is ``missing`` (in
    neither table), ``deleted`` (only in removed) or, for ``late_sources``, ``late`` (the parent's
    earliest arrived_at is after the reference's seen_at, both known). Null ids are no references;
    null periods form a period of their own. Empty tables are allowed: without parents all
    references are orphans.

    Keys are dictionary-encoded into ranges of dense codes; references become 64-bit bitmap words per
    (source, period, range). Absent parents are ``reference AND NOT parent``. Late ones are ``reference
    AND parent AND NOT arrived``, where arrived holds the parents that came before the day on which the
    reference was seen; the survivors of this day-wise test are compared by their exact times.

    Scale: references are reduced to one row per (source, id, period) map-side before any shuffle, so
    a hot key is a few rows. These rows and the dictionary are stored, as both are used three times. Bitmaps are
    compressed: words without a set bit have no row. A word covers 64 keys, so its arrival days are at most 64;
    only the words of ``late_sources`` are kept by day. ``ranges`` is by default one for RANGE_ROWS reduced
    references, and at least LEAST_RANGES, so no range's ranking grows with the data; no row depends on it.
    """
    refs = stored(references.where(F.col("id").isNotNull()).groupBy("src", "id", "period").agg(F.min("seen_at").alias("seen_at")))
    if ranges is None:
        ranges = max(LEAST_RANGES, refs.count() // RANGE_ROWS)
    own = (
        parents.where(F.col("id").isNotNull())
        .groupBy("id")
        .agg(F.min("arrived_at").alias("arrived_at"))
        .select("id", "arrived_at", F.lit(True).alias("present"), F.lit(False).alias("gone"))
    )
    gone = removed.where(F.col("id").isNotNull()).select("id", F.lit(None).cast("timestamp_ntz").alias("arrived_at"), F.lit(False).alias("present"), F.lit(True).alias("gone"))
    known = own.withColumn("arrived_at", F.col("arrived_at").cast("timestamp_ntz")).unionByName(gone)
    codes = stored(key_dictionary(refs.select("id").union(known.select("id")), ranges))

    place = ["range", "word"]
    or_of = lambda flag: F.coalesce(F.expr(f"bit_or(case when {flag} then shiftleft(1L, bit) end)"), F.lit(0).cast("long"))
    parent_words = (
        known.join(codes, "id")
        .groupBy(*place, F.to_date("arrived_at").alias("day"))
        .agg(or_of("present").alias("present"), or_of("gone").alias("gone"))
        .groupBy(*place)
        .agg(F.expr("bit_or(present)").alias("present"), F.expr("bit_or(gone)").alias("gone"), F.collect_list(F.when(F.col("day").isNotNull(), F.struct("day", F.col("present").alias("bits")))).alias("arrivals"))
    )
    # A parent that arrived at an unknown time is never late: it counts as arrived at any day.
    undated = parent_words.withColumn(
        "undated", F.col("present").bitwiseAND(F.bitwise_not(F.aggregate("arrivals", F.lit(0).cast("long"), lambda acc, a: acc.bitwiseOR(a["bits"]))))
    )
    coded = refs.join(codes, "id")
    seen_day = F.when(F.col("src").isin(*late_sources), F.to_date("seen_at")) if late_sources else F.lit(None).cast("date")
    ref_words = coded.groupBy("src", "period", seen_day.alias("day"), *place).agg(F.expr("bit_or(shiftleft(1L, bit))").alias("bits"))
    zero = F.lit(0).cast("long")
    present, removed_bits = F.coalesce("present", zero), F.coalesce("gone", zero)
    arrived = F.aggregate(
        F.filter("arrivals", lambda a: a["day"] < F.col("day")), F.coalesce("undated", zero), lambda acc, a: acc.bitwiseOR(a["bits"])
    )
    late = F.when(F.col("src").isin(*late_sources) & F.col("day").isNotNull(), F.col("bits").bitwiseAND(present).bitwiseAND(F.bitwise_not(arrived))).otherwise(zero) if late_sources else zero
    absent = F.col("bits").bitwiseAND(F.bitwise_not(present))
    kinds = F.array(
        F.struct(F.lit("missing").alias("kind"), absent.bitwiseAND(F.bitwise_not(removed_bits)).alias("left")),
        F.struct(F.lit("deleted").alias("kind"), absent.bitwiseAND(removed_bits).alias("left")),
        F.struct(F.lit("late").alias("kind"), F.coalesce(late, zero).alias("left")),
    )
    survivors = (
        ref_words.join(undated, place, "left")
        .select("src", "period", "day", *place, F.explode(F.filter(kinds, lambda k: k["left"] != 0)).alias("k"))
        .select("src", "period", "day", *place, F.col("k.kind").alias("kind"), F.explode(bits_of(F.col("k.left"))).alias("bit"))
        .join(codes, [*place, "bit"])
        .select("src", "id", "kind", "period", "day")
    )
    absent_rows = survivors.where("kind != 'late'").select("src", "id", "kind", "period")
    if not late_sources:
        return absent_rows.distinct()
    times = known.where("present").select("id", "arrived_at")
    exact = (
        survivors.where("kind = 'late'")
        .join(refs.select("src", "id", F.col("period").alias("ref_period"), "seen_at"), ["src", "id"])
        .where(F.col("period").eqNullSafe(F.col("ref_period")))
        .join(times, "id")
        .where(F.col("arrived_at") > F.col("seen_at").cast("timestamp_ntz"))
        .select("src", "id", "kind", "period")
    )
    return absent_rows.unionByName(exact).distinct()
