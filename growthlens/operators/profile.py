"""Profiles of tables: nulls, exact statistics, counts, histograms, leaders."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from growthlens.functions.values import half_even, percent, to_number


def numeric_columns(df: DataFrame, flags: bool = False) -> list[str]:
    """Columns of a numeric type, with ``flags`` booleans too."""
    kinds = (T.NumericType, T.BooleanType) if flags else (T.NumericType,)
    return [f.name for f in df.schema.fields if isinstance(f.dataType, kinds)]


def null_profile(tables: dict[str, DataFrame]) -> DataFrame:
    """table, column, missing_count and missing_percent (2 digits, halves to even; null for an empty table) of all columns.

    One pass per table, all columns in one aggregate.
    """

    def one(name: str, df: DataFrame) -> DataFrame:
        counted = df.agg(F.count(F.lit(1)).alias("__rows"), *(F.count(F.when(F.col(f"`{c}`").isNull(), 1)).alias(c) for c in df.columns))
        pairs = F.array(*(F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").alias("missing_count")) for c in df.columns))
        return counted.select("__rows", F.explode(pairs).alias("p")).select(
            F.lit(name).alias("table"), "p.column", "p.missing_count", half_even(percent(F.col("p.missing_count"), F.col("__rows"))).alias("missing_percent")
        )

    return reduce(DataFrame.unionByName, [one(n, df) for n, df in tables.items()])


def null_totals(tables: dict[str, DataFrame]) -> DataFrame:
    """table and total_missing_values."""
    return null_profile(tables).groupBy("table").agg(F.sum("missing_count").alias("total_missing_values"))


def ranked(
    df: DataFrame, columns: Sequence[str], shares: Sequence[float], stats: dict[str, Callable[[Column], Column]] | None = None, accuracy: int = 10_000, at_once: int = 4_000_000
) -> tuple[dict[str, list[float | None]], dict[str, dict]]:
    """Exact percentiles with linear interpolation, and aggregates ``stats``, of each column; None without values. Null and NaN do not count.

    One pass counts, computes the aggregates and sketches two bounds around each wanted rank, which
    a four-thousandth of the values (4 / ``accuracy``) lies between. A second pass counts what is below and
    counts each value between them; these few are ordered, and the rank is read off. Where over ``at_once``
    values may be between the bounds, they are first drawn closer, among these values. Bounds that turn
    out not to hold the rank (the sketch is only approximate) are given up and the pass is repeated.
    """
    columns, stats = list(columns), stats or {}
    if not columns:
        return {}, {}
    values = df.select(*(F.when(~F.isnan(F.col(f"`{c}`").cast("double")), F.col(f"`{c}`").cast("double")).alias(f"c{i}") for i, c in enumerate(columns)))
    slack = 2 / accuracy

    def sketch(x: Column, around: Sequence[float]) -> Column:
        points = [min(max(p + d, 0.0), 1.0) for p in around for d in (-slack, slack)]
        return F.percentile_approx(x, F.array(*map(F.lit, points)), F.lit(accuracy))

    def bounds(points: Sequence[float], p: float, of: Sequence[float]) -> tuple[float | None, float | None]:
        at = 2 * of.index(p)
        return (points[at] if p > slack else None, points[at + 1] if p < 1 - slack else None)

    wanted = list(dict.fromkeys(shares))
    row = values.agg(*(F.struct(F.count(x).alias("n"), sketch(F.col(x), wanted).alias("points"), *(f(F.col(x)).alias(k) for k, f in stats.items())).alias(x) for x in values.columns)).first()
    totals = {x: row[x]["n"] for x in values.columns}
    place = {x: {p: (int((n - 1) * p), min(int((n - 1) * p) + 1, n - 1), (n - 1) * p - int((n - 1) * p)) for p in wanted} for x, n in totals.items() if n}
    between = {(x, p): bounds(row[x]["points"], p, wanted) for x in place for p in wanted} if wanted else {}
    inside = {k: totals[k[0]] for k in between}
    at: dict[tuple[str, float], dict[int, float]] = {}
    while between:
        for x, p in [k for k in between if inside[k] * 2 * slack > at_once and between[k] != (None, None)]:
            lo, hi = between[x, p]
            v = F.col(x)
            is_in = (v >= lo if lo is not None else v.isNotNull()) & (v <= hi if hi is not None else v.isNotNull())
            below, n_in = values.agg(F.count(F.when(v < lo, 1)) if lo is not None else F.lit(0), F.count(F.when(is_in, 1))).first()
            if below > place[x][p][0] or below + n_in <= place[x][p][1] or n_in >= inside[x, p]:
                inside[x, p] = 0  # no closer
                continue
            q = (place[x][p][0] - below) / n_in
            lower, upper = bounds(values.agg(sketch(F.when(is_in, v), [q])).first()[0], q, [q])
            between[x, p], inside[x, p] = (lo if lower is None else lower, hi if upper is None else upper), int(n_in * 2 * slack)
        found = _select(values, between, {k: place[k[0]][k[1]][:2] for k in between})
        at |= {k: v for k, v in found.items() if set(place[k[0]][k[1]][:2]) <= set(v)}
        between = {k: (None, None) for k in between if k not in at}

    def interpolated(x: str, p: float) -> float | None:
        if x not in place:
            return None
        lo, hi, f = place[x][p]
        return at[x, p][lo] * (1 - f) + at[x, p][hi] * f if f else at[x, p][lo]

    return {c: [interpolated(x, p) for p in shares] for c, x in zip(columns, values.columns)}, {c: {k: row[x][k] for k in ("n", *stats)} for c, x in zip(columns, values.columns)}


def _select(values: DataFrame, between: dict[tuple[str, float], tuple[float | None, float | None]], ranks: dict[tuple[str, float], tuple[int, ...]]) -> dict[tuple[str, float], dict[int, float]]:
    """The values at the ranks (from 0) of the columns, as far as they lie between the bounds."""
    keys = list(between)

    def one(i: int) -> Column:
        (x, _), (lo, hi) = keys[i], between[keys[i]]
        v = F.col(x)
        seen = v.isNotNull() if hi is None else v <= hi
        return F.when(seen, F.struct(F.lit(i).alias("i"), (v if lo is None else F.when(v >= lo, v)).alias("v")))  # null stands for all below

    counted = values.select(F.explode(F.array_compact(F.array(*map(one, range(len(keys)))))).alias("e")).groupBy("e.i", "e.v").count()
    up_to = W.partitionBy("i").orderBy(F.col("v").asc_nulls_first()).rowsBetween(W.unboundedPreceding, 0)
    need = F.create_map(*(x for i, k in enumerate(keys) for x in (F.lit(i), F.array(*(F.lit(r).cast("bigint") for r in sorted(set(ranks[k])))))))
    ends = counted.withColumn("end", F.sum("count").over(up_to)).where("v is not null")
    hits = ends.select("i", "v", "count", "end", F.explode(F.element_at(need, F.col("i"))).alias("rank")).where("rank >= end - count and rank < end")
    found: dict[tuple[str, float], dict[int, float]] = {}
    for r in hits.select("i", "rank", "v").collect():
        found.setdefault(keys[r["i"]], {})[r["rank"]] = r["v"]
    return found


def exact_percentiles(df: DataFrame, columns: Sequence[str], shares: Sequence[float]) -> dict[str, list[float | None]]:
    """Exact percentiles of each column (see ``ranked``)."""
    return ranked(df, columns, shares)[0]


def describe_numeric(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """column, count, mean, std (of the sample), min, p25, p50, p75 and max of the numeric columns.

    Exact percentiles, unlike DataFrame.summary. Null and NaN do not count; std of one value is null.
    """
    columns = list(columns or numeric_columns(df))
    quartiles, stats = ranked(df, columns, [0.25, 0.5, 0.75], {"mean": F.avg, "std": F.stddev_samp, "min": F.min, "max": F.max})
    rows = [(c, s["n"], s["mean"], s["std"], s["min"], *quartiles[c], s["max"]) for c, s in stats.items()]
    return df.sparkSession.createDataFrame(rows, "column string, count bigint, mean double, std double, min double, p25 double, p50 double, p75 double, max double")


def scalar_stats(df: DataFrame, column: str) -> DataFrame:
    """One row: minimum, maximum, mean and median of a column read as a number."""
    x = to_number(F.col(column))
    medians, stats = ranked(df.select(x.alias(column)), [column], [0.5], {"minimum": F.min, "maximum": F.max, "mean": F.avg})
    own = stats[column]
    return df.sparkSession.createDataFrame([(own["minimum"], own["maximum"], own["mean"], medians[column][0])], "minimum double, maximum double, mean double, median double")


def value_counts(df: DataFrame, column: str, out: str = "n", keep_null: bool = False) -> DataFrame:
    """Rows per value; the null group only with ``keep_null``."""
    rows = df if keep_null else df.where(F.col(column).isNotNull())
    return rows.groupBy(column).agg(F.count(F.lit(1)).alias(out))


def top_k(df: DataFrame, by: str, k: int, tiebreak: Sequence[str], last_nulls: bool = True) -> DataFrame:
    """The k rows with the largest ``by``; ties by the tiebreak columns, ascending, so that the result is defined."""
    first = F.col(by).desc_nulls_last() if last_nulls else F.col(by).desc_nulls_first()
    return df.orderBy(first, *(F.col(c).asc_nulls_last() for c in tiebreak)).limit(k)


def group_means(df: DataFrame, by: str, columns: Sequence[str], digits: int | None = None, keep_null: bool = True) -> DataFrame:
    """Means per group, rounded half to even if digits are given."""
    of = lambda c: half_even(F.avg(c), digits) if digits is not None else F.avg(c)
    rows = df if keep_null else df.where(F.col(by).isNotNull())
    return rows.groupBy(by).agg(*(of(c).alias(f"avg_{c}") for c in columns))


def histogram(df: DataFrame, column: str, bins: int = 50) -> DataFrame:
    """bin (from 0), low, high and n of equal bins between minimum and maximum; the last bin is closed on the right.

    All bins come out, also empty ones. If all values are equal, the range is half a unit to both sides.
    Without values there are no rows. Two passes: the range, then a count of at most ``bins`` groups.
    """
    x = to_number(F.col(column))
    low, high = df.agg(F.min(x), F.max(x)).first()
    spark = df.sparkSession
    if low is None:
        return spark.createDataFrame([], "bin int, low double, high double, n bigint")
    if low == high:
        low, high = low - 0.5, high + 0.5
    width = (high - low) / bins
    place = F.least(F.floor((x - low) / F.lit(width)), F.lit(bins - 1)).cast("int").alias("bin")
    counted = df.where(x.isNotNull()).groupBy(place).agg(F.count(F.lit(1)).alias("n"))
    return (
        spark.range(bins).select(F.col("id").cast("int").alias("bin")).join(counted, "bin", "left")
        .select("bin", (F.lit(low) + F.col("bin") * F.lit(width)).alias("low"), (F.lit(low) + (F.col("bin") + 1) * F.lit(width)).alias("high"), F.coalesce("n", F.lit(0).cast("long")).alias("n"))
    )


def leaders_series(df: DataFrame, key: str, time: str, value: str, k: int = 5) -> DataFrame:
    """The rows (key, time, value) of the k keys with the largest sums, null keys left out; order them when writing.

    Rows without time or value are dropped first. One semi-join against k rows instead of a scan per key.
    """
    rows: DataFrame = df.select(key, time, value).dropna(subset=[time, value])
    best = top_k(rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.coalesce(F.sum(value), F.lit(0)).alias("__sum")), "__sum", k, [key])
    return rows.join(F.broadcast(best.select(key)), key, "left_semi")  # k rows


