"""Items that appear together, by stripes, with the significance of each pair."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from growthlens.operators.joins import spread_join
from growthlens.session import ship, stored

#: Segments, by the partner, into which an item's stripe is cut, as a power of two; and the bits of a code.
SEGMENT_BITS, CODE_BITS = 4, 32
#: An odd number whose multiples are spread evenly over 64 bits.
SPREAD = np.uint64(0x9E3779B97F4A7C15)


def log_likelihood(k: Column, a: Column, b: Column, n: Column) -> Column:
    """Dunning's ratio G2 of a 2 x 2 table: k both, a and b of each, n baskets."""

    def term(seen: Column, row: Column, column: Column) -> Column:
        return F.when(seen > 0, seen * F.log(seen.cast("double") * n / (row.cast("double") * column))).otherwise(F.lit(0.0))

    return 2 * (term(k, a, b) + term(a - k, a, n - b) + term(b - k, n - a, b) + term(n - a - b + k, n - a, n - b))


def stripes_of(items: np.ndarray, sizes: np.ndarray, sides: np.ndarray, offsets: np.ndarray, ratio: float, at_once: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """Stripes of the baskets of a batch, summed over the baskets.

    An item's partners are those of its basket that are not smaller in size, and at most ``ratio``
    times as large: with the basket ordered by size they are one stretch of it. Partners of the same
    side (unless it is below 0) do not count. A stripe belongs to the smaller of two items (of equal
    ones to the lower) and has the partners, their counts and their sizes. It is cut into segments by the partners.
    """
    names, codes = np.unique(items, return_inverse=True)
    size_of = np.zeros(len(names), np.int64)
    size_of[codes] = sizes
    mask = (1 << CODE_BITS) - 1
    segment_of = ((names.astype(np.uint64) * SPREAD) >> np.uint64(64 - SEGMENT_BITS)).astype(np.int64)
    basket = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    order = np.lexsort((codes, sizes, basket))
    codes, sizes, sides = codes[order], sizes[order], sides[order]
    any_sides = (sides >= 0).any()
    # one increasing number per (basket, size) finds the ends of all stretches at once
    step = np.int64(sizes.max(initial=0)) + 1
    most = np.minimum(np.floor(sizes * ratio + 1e-9), step - 1).astype(np.int64) if np.isfinite(ratio) else np.full(len(sizes), step - 1)
    ends = np.searchsorted(basket * step + sizes, basket * step + most, side="right")
    lengths = ends - np.arange(len(codes)) - 1
    done = np.r_[0, np.cumsum(lengths)]
    lo = 0
    while lo < len(codes):
        hi = max(lo + 1, int(np.searchsorted(done, done[lo] + at_once, side="right")) - 1)
        first = np.repeat(np.arange(lo, hi), lengths[lo:hi])
        second = first + 1 + np.arange(len(first)) - np.repeat(done[lo:hi] - done[lo], lengths[lo:hi])
        lo = hi
        if any_sides:
            other = (sides[first] != sides[second]) | (sides[first] < 0)
            first, second = first[other], second[other]
        if not len(first):
            continue
        pair, count = np.unique((((codes[first] << SEGMENT_BITS) | segment_of[codes[second]]) << CODE_BITS) | codes[second], return_counts=True)
        stripe, y = pair >> CODE_BITS, pair & mask
        x = stripe >> SEGMENT_BITS
        cuts = np.flatnonzero(np.r_[True, np.diff(stripe) != 0])
        at = pa.array(np.r_[cuts, len(pair)].astype(np.int32))
        lists = [pa.ListArray.from_arrays(at, pa.array(v)) for v in (names[y], count.astype(np.int32), size_of[y])]
        head = [pa.array(names[x[cuts]]), pa.array((stripe[cuts] & ((1 << SEGMENT_BITS) - 1)).astype(np.int32)), pa.array(size_of[x[cuts]])]
        yield pa.RecordBatch.from_arrays([*head, *lists], names=["x", "segment", "a", "y", "k", "b"])


def together(
    df: DataFrame, basket: str, item: str, min_count: int = 5, min_jaccard: float = 0.2, min_lift: float = 0.0, min_llr: float = 0.0, max_basket: int = 512
) -> DataFrame:
    """Pairs of items with the number of baskets that hold both, and how far that exceeds chance.

    Returns item_a < item_b, k (baskets with both), a and b (with each), n (baskets), lift (k n / (a b))
    and llr (log-likelihood ratio), for pairs with k >= ``min_count``, k / (a + b - k) >= ``min_jaccard``,
    lift >= ``min_lift`` and, if ``min_llr`` is above 0, llr >= ``min_llr`` and lift above 1: as many as
    that by chance are less likely than the chi-square distribution of one degree of freedom says
    (10.83 for one in a thousand). Counted are distinct (basket, item) rows with both known. Empty
    tables give no rows; other columns are ignored, whatever their names. Items must be whole numbers.

    Method: an item's stripe, the array of its neighbours with counts, is summed per input batch, cut
    by neighbours, shuffled and merged. A basket of over ``max_basket`` items is cut into blocks of
    items, and each two of its blocks are a basket of their own, in which only pairs across the two count
    (a block with itself: all its pairs). So large baskets add to the same stripes and no task holds one.
    What cannot reach the limits is left out early: items in fewer than ``min_count`` baskets, and
    partners whose sizes differ by more than the factor 1 / ``min_jaccard``.

    Scale: the distinct rows are stored once. Items' and baskets' sizes are joined so that hot ones spread
    (``spread_join``). A stripe belongs to the rarer of two items, which bounds the stripes of hot
    items; arrays hold at most the neighbours met in one batch. Nothing is collected.
    """
    if not 0 <= min_jaccard <= 1 or min_count < 1 or max_basket < 1:
        raise ValueError("min_jaccard must be from 0 to 1, min_count and max_basket at least 1")
    ratio = 1 / min_jaccard if min_jaccard > 0 else float("inf")
    rows = stored(df.select(F.col(basket).alias("u"), F.col(item).cast("long").alias("i")).where("u is not null and i is not null").distinct())
    sizes = rows.groupBy("u").agg(F.count("*").alias("u_size"))
    n = sizes.agg(F.count("*").alias("n")).scalar()
    large = sizes.where(F.col("u_size") > max_basket)
    known = rows.groupBy("i").agg(F.count("*").alias("a")).where(F.col("a") >= min_count)

    light = spread_join(spread_join(rows, known, known, "i", ["u"], "inner"), large, large, "u", ["i"])
    blocks = F.ceil(F.coalesce(F.col("u_size"), F.lit(1)) / max_basket).cast("int")
    cut = (
        light.select("u", "i", "a", blocks.alias("blocks"))
        .withColumn("own", F.pmod(F.xxhash64("i"), F.col("blocks")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select("u", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "i", "a", F.when(F.col("own") != F.col("other"), F.col("own")).otherwise(-1).alias("side"))
    )
    # rows move as they are: lists of parts of baskets would be larger
    place = ["u", "lo", "hi"]
    baskets = cut.repartition(*place).groupBy(*place).agg(*(F.collect_list(c).alias(c) for c in ("i", "a", "side"))).where(F.size("i") > 1)
    ship(df.sparkSession)

    def stripes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            items, sizes, sides = (batch.column(c).flatten().to_numpy(zero_copy_only=False) for c in ("i", "a", "side"))
            offsets = batch.column("i").offsets.to_numpy()
            yield from stripes_of(items, sizes.astype(np.int64), sides, offsets - offsets[0], ratio)

    first = F.col("x") < F.col("y")
    counted = (
        baskets.select("i", "a", "side")
        .mapInArrow(stripes, "x bigint, segment int, a bigint, y array<bigint>, k array<int>, b array<bigint>")
        .repartition("x", "segment")
        .select("x", "segment", "a", F.explode(F.arrays_zip("y", "k", "b")).alias("e"))
        .groupBy("x", "segment", F.col("e.y").alias("y"))
        .agg(F.sum("e.k").alias("k"), F.max("a").alias("a"), F.max("e.b").alias("b"))
        .select(
            F.least("x", "y").alias("item_a"), F.greatest("x", "y").alias("item_b"), "k",
            F.when(first, F.col("a")).otherwise(F.col("b")).alias("a"), F.when(first, F.col("b")).otherwise(F.col("a")).alias("b"), n.alias("n"),
        )
    )
    return measured(counted, min_count, min_jaccard, min_lift, min_llr)


def measured(counted: DataFrame, min_count: int, min_jaccard: float, min_lift: float, min_llr: float) -> DataFrame:
    """The counted pairs within the limits, with lift and llr."""
    union = F.col("a") + F.col("b") - F.col("k")
    found = (
        counted.where((F.col("k") >= min_count) & (F.col("k") / union >= min_jaccard) & (F.col("k") * F.col("n") >= F.lit(float(min_lift)) * F.col("a") * F.col("b")))
        .withColumn("lift", F.col("k") * F.col("n") / (F.col("a").cast("double") * F.col("b")))
        .withColumn("llr", log_likelihood(F.col("k"), F.col("a"), F.col("b"), F.col("n")))
    )
    return found.where((F.col("llr") >= min_llr) & (F.col("lift") > 1)) if min_llr > 0 else found
