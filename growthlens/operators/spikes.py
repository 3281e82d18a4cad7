"""Implausible values in measured series: phase-space thresholding, stuck values, bounds."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from growthlens.session import ship

#: Times the median absolute deviation that a normal distribution's standard deviation is (fixed value).
MAD_TO_SIGMA = 1.4826


def scale_of(x: np.ndarray) -> float:
    """Robust standard deviation about 0."""
    return MAD_TO_SIGMA * float(np.median(np.abs(x))) if len(x) else 0.0


def outside(x: np.ndarray, centre: float, mad: float, strictness: float) -> np.ndarray:
    """Which points of a series lie outside the robust ellipsoid of its phase space.

    Axes are the centred value u, its first difference and its second difference, each scaled by
    its own median absolute deviation. The ellipsoid is tested by its three projections, of which
    that on u and the second difference is tilted by their correlation. Its size is the universal
    threshold for n deviations, sqrt(2 s ln n) with s the strictness, in robust standard deviations. The
    shadow of each projection on the axis of u has that half-width whatever the tilt, so a value
    further off than that is always outside: with s up to 2 one over 10 median absolute deviations off in
    any series of up to 87,000 points, and a calendar of 20 years has 7,300 days.
    A point that is outside only for its differences counts if it is further out than its
    neighbours, which it pulls out with it; of equal ones in a row the first counts. Of a wide burst
    the peak is flagged first, and its shoulders when the series is fitted again without it.
    """
    n = len(x)
    u = x - centre
    d1 = np.gradient(u) if n > 1 else np.zeros(n)
    d2 = np.gradient(d1) if n > 1 else np.zeros(n)
    scales = (MAD_TO_SIGMA * mad, scale_of(d1), scale_of(d2))
    a, b, c = (axis / s if s > 0 else np.zeros(n) for axis, s in zip((u, d1, d2), scales))
    if mad == 0:  # no spread: whatever leaves the median is outside
        a = np.where(u != 0, np.inf, 0.0)
    size = 2 * strictness * np.log(max(n, 2))
    far = a * a > size
    inner = (np.abs(a) < 3) & (np.abs(c) < 3)
    norm = np.sqrt((a[inner] ** 2).sum() * (c[inner] ** 2).sum())
    rho = float(np.clip((a[inner] * c[inner]).sum() / norm, -0.95, 0.95)) if norm > 0 else 0.0
    a = np.where(np.isinf(a), 0.0, a)
    tilted = (a * a - 2 * rho * a * c + c * c) / (1 - rho * rho)
    distance = np.maximum.reduce([a * a + b * b, tilted, b * b + c * c])
    edge = np.r_[-np.inf, np.abs(u), -np.inf]
    peak = (edge[1:-1] > edge[:-2]) & (edge[1:-1] >= edge[2:])
    return far | ((distance > size) & peak)


def phase_space_spikes(x: np.ndarray, strictness: float = 1.25) -> tuple[np.ndarray, float, float]:
    """Flags of spikes, and median and MAD of the whole series.

    Flagged points are bridged in a straight line and the ellipsoid is fitted again to the others,
    until none of them is outside. Every round flags a point, so there are at most as many as points.
    """
    centre = float(np.median(x))
    mad = float(np.median(np.abs(x - centre)))
    flags = np.zeros(len(x), dtype=bool)
    bridged, c, m = x, centre, mad
    with np.errstate(over="ignore", invalid="ignore"):
        for _ in range(len(x)):
            out = outside(bridged, c, m, strictness) & ~flags
            if not out.any():
                break
            flags |= out
            kept = np.flatnonzero(~flags)
            if len(kept) < 3:
                break
            bridged = np.interp(np.arange(len(x)), kept, x[kept])
            c = float(np.median(x[kept]))
            m = float(np.median(np.abs(x[kept] - c)))
    return flags, centre, mad


def stuck_runs(x: np.ndarray, least: int) -> np.ndarray:
    """Flags of the points in runs of at least ``least`` equal values: runs of zero differences."""
    if not len(x):
        return np.zeros(0, dtype=bool)
    starts = np.flatnonzero(np.r_[True, np.diff(x) != 0])
    lengths = np.diff(np.r_[starts, len(x)])
    return np.repeat(lengths >= least, lengths)


def implausible(
    long: DataFrame,
    bounds: dict[str, tuple[float | None, float | None]],
    min_points: int = 12,
    stuck_length: int = 5,
    strictness: float = 1.25,
) -> DataFrame:
    """Judge each value of many series against its own series.

    ``long`` has field (string), key, period (date, one grid period each) and value (double). Returns
    field, key, period, value, impossible (NaN, infinite or outside the field's bounds), spike
    (outside the ellipsoids of the series' possible values), stuck (in a run of ``stuck_length``
    equal possible values, successive in time), n_points, median and mad (of the possible values;
    null for impossible ones). ``strictness`` is that of ``outside``: the lower, the more spikes. Series of fewer than ``min_points`` possible values have no spike
    and no stuck value.

    Null fields, keys, periods and values do not count. Of several values of a period the largest
    counts (NaN is larger than any). An empty table gives no rows.

    Scale: values are reduced to one per (field, key, period) before the series is put together,
    so a series is an array bounded by the calendar's periods, however hot its key. Series are
    judged batch-wise with NumPy in the same stage.
    """
    value = F.col("value")
    too_low: Column = F.lit(False)
    for field, (low, high) in bounds.items():
        here = F.lit(False)
        if low is not None:
            here = here | (value < low)
        if high is not None:
            here = here | (value > high)
        too_low = too_low | ((F.col("field") == field) & here)
    bad = F.isnan(value) | (F.abs(value) == float("inf")) | too_low
    one = (
        long.select("field", "key", F.col("period").cast("date").alias("period"), value.cast("double").alias("value"))
        .dropna(subset=["field", "key", "period"])
        .where(F.col("value").isNotNull())
        .groupBy("field", "key", "period")
        .agg(F.max("value").alias("value"))
        .withColumn("impossible", bad)
    )
    series = one.groupBy("field", "key").agg(F.sort_array(F.collect_list(F.struct("period", "value", "impossible"))).alias("s"))
    series = series.select("field", "key", F.col("s.period").alias("period"), F.col("s.value").alias("value"), F.col("s.impossible").alias("impossible"))
    key_type = long.schema["key"].dataType.simpleString()
    schema = (
        f"field string, key {key_type}, period array<date>, value array<double>, impossible array<boolean>,"
        " spike array<boolean>, stuck array<boolean>, n_points int, median double, mad double"
    )

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values, bads = batch.column("value"), batch.column("impossible")
            offsets = values.offsets.to_numpy()
            flat = values.values.to_numpy(zero_copy_only=False)
            flat_bad = bads.values.to_numpy(zero_copy_only=False).astype(bool)
            at_bad = bads.offsets.to_numpy()
            spike, stuck = np.zeros(len(flat), dtype=bool), np.zeros(len(flat), dtype=bool)
            counts, medians, mads = [], [], []
            for i in range(batch.num_rows):
                lo, hi = offsets[i], offsets[i + 1]
                good = lo + np.flatnonzero(~flat_bad[at_bad[i] : at_bad[i + 1]])
                x = flat[good]
                counts.append(len(x))
                if len(x) < min_points:
                    medians.append(None)
                    mads.append(None)
                    continue
                flags, centre, mad = phase_space_spikes(x, strictness)
                spike[good] = flags
                stuck[good] = stuck_runs(x, stuck_length)
                medians.append(centre)
                mads.append(mad)
            lists = lambda flags: pa.ListArray.from_arrays(values.offsets, pa.array(flags))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, lists(spike), lists(stuck), pa.array(counts, pa.int32()), pa.array(medians, pa.float64()), pa.array(mads, pa.float64())],
                names=[*batch.schema.names, "spike", "stuck", "n_points", "median", "mad"],
            )

    ship(long.sparkSession)
    judged = series.mapInArrow(judge, schema)
    each = F.explode(F.arrays_zip("period", "value", "impossible", "spike", "stuck")).alias("e")
    return judged.select("field", "key", "n_points", "median", "mad", each).select(
        "field", "key", "e.*", "n_points", F.when(~F.col("e.impossible"), F.col("median")).alias("median"), F.when(~F.col("e.impossible"), F.col("mad")).alias("mad")
    )
