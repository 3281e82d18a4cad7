"""Queries p1, p2, p3, p5, p6 and p7, with their SQL for the comparison."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from growthlens.functions.dates import month_key, read_week
from growthlens.operators.grid import DAY, MONDAY, interval_grid
from growthlens.operators.heavy_keys import key_totals
from growthlens.operators.orphans import find_orphans
from growthlens.operators.packed import known_forms, split_packed
from growthlens.operators.rolling import trailing_totals
from growthlens.operators.spikes import implausible
from growthlens.sources.tables import table

#: First and last date of a daily reading.
FIRST_DAY, LAST_DAY = "2015-01-01", "2026-06-14"
BOUNDS = {"daily_growth_rate": (-1.0, None), "weekly_growth_rate": (-1.0, None), "herd_momentum_score": (0.0, None)}


def daily_readings(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "daily_timeseries")
    return rows.where(F.col("repo_id").isNotNull() & F.col("date").between(F.lit(FIRST_DAY).cast("date"), F.lit(LAST_DAY).cast("date")))


def weekly_readings(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "weekly_timeseries").where("repo_id is not null")
    return rows.withColumn("week_start", read_week(F.col("week"))).where("week_start is not null")


def daily_grid(spark: SparkSession, folder: str) -> DataFrame:
    return interval_grid(daily_readings(spark, folder), "repo_id", "date", "daily_new_stars")


def weekly_grid(spark: SparkSession, folder: str) -> DataFrame:
    return interval_grid(weekly_readings(spark, folder), "repo_id", "week_start", "weekly_new_stars", cell=7 * DAY, anchor=MONDAY)


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    """Periods between a repository's first and last counted period that have no measured part."""
    both = [g(spark, folder).select(F.lit(n).alias("series"), "repo_id", "cell_start", "filled") for n, g in (("daily", daily_grid), ("weekly", weekly_grid))]
    return both[0].unionByName(both[1]).where("filled").select("series", "repo_id", F.col("cell_start").cast("date").cast("string").alias("period_start"))


def p1_daily_grid(spark: SparkSession, folder: str) -> DataFrame:
    return daily_grid(spark, folder).select("repo_id", F.col("cell_start").cast("date").alias("day"), "coverage", "held", "mean_value", "filled")


def p1_weekly_grid(spark: SparkSession, folder: str) -> DataFrame:
    return weekly_grid(spark, folder).select("repo_id", F.col("cell_start").cast("date").alias("week_start"), "coverage", "held", "mean_value", "filled")


def rated_values(spark: SparkSession, folder: str) -> DataFrame:
    daily, weekly = daily_readings(spark, folder), weekly_readings(spark, folder)
    of = lambda df, field, day: df.select(F.lit(field).alias("field"), F.col("repo_id").alias("key"), F.col(day).alias("period"), F.col(field).alias("value"))
    parts = [
        of(daily, "daily_growth_rate", "date"),
        of(weekly, "weekly_growth_rate", "week_start"),
        of(weekly.where("previous_week_stars is not null"), "herd_momentum_score", "week_start"),
    ]
    return reduce(DataFrame.unionByName, parts)


def p2_flags(spark: SparkSession, folder: str) -> DataFrame:
    """Every value with its flags; the phase-space threshold alone decides on spikes here."""
    judged = implausible(rated_values(spark, folder), BOUNDS)
    return judged.where("impossible or spike or stuck").select("field", F.col("key").alias("repo_id"), "period", "value", "impossible", "spike", "stuck", "median", "mad")


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    """Flagged values; of the spikes those more than 10 median absolute deviations off."""
    far = F.col("spike") & (F.abs(F.col("value") - F.col("median")) > 10 * F.col("mad"))
    judged = implausible(rated_values(spark, folder), BOUNDS)
    return judged.where(F.col("impossible") | F.col("stuck") | far).select("field", F.col("key").alias("repo_id"), F.col("period").cast("string").alias("period_start"))


def p3_trailing(spark: SparkSession, folder: str) -> DataFrame:
    totals = trailing_totals(daily_readings(spark, folder), "repo_id", "date", "daily_new_stars", (7, 30))
    return totals.select("repo_id", F.col("date").alias("on_day"), "daily_new_stars", "total_7", F.round("avg_7", 6).alias("avg_7"), "total_30", F.round("avg_30", 6).alias("avg_30"))


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    """Days on which over half of the last 30 days' stars came in the last 7."""
    totals = trailing_totals(daily_readings(spark, folder), "repo_id", "date", "daily_new_stars", (7, 30))
    return totals.where("day_no >= 30 and 2 * total_7 > total_30").select("repo_id", F.col("date").cast("string").alias("on_day"))


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    """References to repositories that are absent, removed or (for stars) collected later."""
    none = F.lit(None).cast("timestamp_ntz")
    of = lambda name, moment, seen=none: table(spark, folder, name).select(F.lit(name).alias("src"), F.col("repo_id").alias("id"), month_key(moment).alias("period"), seen.alias("seen_at"))
    references = reduce(
        DataFrame.unionByName,
        [of("stars", F.col("starred_at"), F.col("collected_at")), of("weekly_timeseries", read_week(F.col("week"))), of("herd_modeling", F.col("created_at"))],
    )
    parents = table(spark, folder, "repositories").select(F.col("repo_id").alias("id"), F.col("collected_at").alias("arrived_at"))
    removed = table(spark, folder, "removed_repositories").select(F.col("repo_id").alias("id"))
    found = find_orphans(references, parents, removed, late_sources=("stars",))
    return found.select(F.col("src").alias("src_table"), F.col("id").alias("repo_id"), "kind", F.col("period").alias("month_key"))


def topic_fields(spark: SparkSession, folder: str) -> DataFrame:
    parts = [table(spark, folder, n).select(F.lit(n).alias("src_table"), "repo_id", "topics") for n in ("repositories", "herd_modeling")]
    return parts[0].unionByName(parts[1])


def packed_topics(spark: SparkSession, folder: str, protect_bare: bool) -> DataFrame:
    fields = topic_fields(spark, folder)
    return split_packed(fields, ["src_table", "repo_id"], "topics", known_forms(fields, "topics"), protect_bare).withColumnRenamed("value", "topic")


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    """The topics of each field; where quotes are stray or missing, known topics stay whole."""
    return packed_topics(spark, folder, protect_bare=False).distinct()


def p6_protected(spark: SparkSession, folder: str) -> DataFrame:
    """As p6_found, but values known from quotes are whole without quotes too."""
    return packed_topics(spark, folder, protect_bare=True).distinct()


def p7_totals(spark: SparkSession, folder: str) -> DataFrame:
    totals = key_totals(table(spark, folder, "stars"), ["repo_id", "repo_full_name"], "starred_at")
    return totals.select("key_field", "key_value", "n_rows", F.col("first_at").cast("timestamp_ntz").alias("first_at"), F.col("last_at").cast("timestamp_ntz").alias("last_at"))


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    """Keys that hold at least 2 % of all rows."""
    stars = table(spark, folder, "stars")
    n = stars.agg(F.count(F.lit(1)).alias("n")).scalar()
    return key_totals(stars, ["repo_id", "repo_full_name"]).where(F.col("key_value").isNotNull() & (F.col("n_rows") * 50 >= n)).select("key_field", "key_value")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    every = [p1_found, p1_daily_grid, p1_weekly_grid, p2_found, p2_flags, p3_found, p3_trailing, p5_found, p6_found, p6_protected, p7_found, p7_totals]
    return {q.__name__: q for q in every}


WEEK_SQL = """
week_text AS (SELECT *, regexp_replace(week, '^\\s+', '') AS wt FROM weekly_timeseries),
week_parts AS (SELECT *,
    CASE WHEN regexp_matches(wt, '^\\d{4}-\\d{1,2}-\\d{1,2}(\\D|$)') THEN regexp_extract(wt, '^(\\d{4}-\\d{1,2}-\\d{1,2})', 1)
         WHEN regexp_matches(wt, '^\\d{4}/\\d{1,2}/\\d{1,2}(\\D|$)') THEN replace(regexp_extract(wt, '^(\\d{4}/\\d{1,2}/\\d{1,2})', 1), '/', '-')
         WHEN regexp_matches(wt, '^\\d{4}\\.\\d{1,2}\\.\\d{1,2}(\\D|$)') THEN replace(regexp_extract(wt, '^(\\d{4}\\.\\d{1,2}\\.\\d{1,2})', 1), '.', '-')
         WHEN regexp_matches(wt, '^\\d{8}(\\D|$)') THEN substr(wt, 1, 4) || '-' || substr(wt, 5, 2) || '-' || substr(wt, 7, 2)
         WHEN regexp_matches(wt, '^\\d{1,2}\\.\\d{1,2}\\.\\d{4}(\\D|$)') THEN regexp_extract(wt, '^(\\d{1,2})\\.(\\d{1,2})\\.(\\d{4})', 3) || '-' || regexp_extract(wt, '^(\\d{1,2})\\.(\\d{1,2})\\.(\\d{4})', 2) || '-' || regexp_extract(wt, '^(\\d{1,2})\\.(\\d{1,2})\\.(\\d{4})', 1)
    END AS dt,
    CASE WHEN regexp_matches(wt, '^\\d{4}-?[Ww]\\d{2}(\\D|$)') THEN CAST(regexp_extract(wt, '^(\\d{4})', 1) AS INT) END AS iy,
    CASE WHEN regexp_matches(wt, '^\\d{4}-?[Ww]\\d{2}(\\D|$)') THEN CAST(regexp_extract(wt, '[Ww](\\d{2})', 1) AS INT) END AS iw
    FROM week_text),
weeks AS (SELECT *, CAST(date_trunc('week', coalesce(TRY_CAST(dt AS DATE),
    CASE WHEN iw BETWEEN 1 AND 53 AND year(CAST(date_trunc('week', make_date(iy, 1, 4)) AS DATE) + ((iw - 1) * 7 + 3)) = iy
         THEN CAST(date_trunc('week', make_date(iy, 1, 4)) AS DATE) + (iw - 1) * 7 END)) AS DATE) AS week_start FROM week_parts),
weekly AS (SELECT * FROM weeks WHERE repo_id IS NOT NULL AND week_start IS NOT NULL),
daily AS (SELECT * FROM daily_timeseries WHERE repo_id IS NOT NULL AND date BETWEEN DATE '2015-01-01' AND DATE '2026-06-14')"""

GRID_SQL = """
counted AS (SELECT repo_id, {day} AS p, CAST(max({value}) AS DOUBLE) AS v FROM {readings} WHERE {value} IS NOT NULL GROUP BY 1, 2),
cells AS (SELECT repo_id, CAST(unnest(generate_series(min(p), max(p), INTERVAL {step} DAY)) AS DATE) AS p FROM counted GROUP BY 1)
SELECT c.repo_id, c.p AS {out}, CASE WHEN k.v IS NULL THEN 0.0 ELSE 1.0 END::DOUBLE AS coverage, CASE WHEN k.v IS NULL THEN 1.0 ELSE 0.0 END::DOUBLE AS held,
    last_value(k.v IGNORE NULLS) OVER (PARTITION BY c.repo_id ORDER BY c.p) AS mean_value, k.v IS NULL AS filled
FROM cells c LEFT JOIN counted k ON c.repo_id = k.repo_id AND c.p = k.p"""

VALUES_SQL = """
vals AS (
    SELECT 'daily_growth_rate' AS field, repo_id, date AS p, max(daily_growth_rate) AS v FROM daily WHERE daily_growth_rate IS NOT NULL GROUP BY 2, 3
    UNION ALL SELECT 'weekly_growth_rate', repo_id, week_start, max(weekly_growth_rate) FROM weekly WHERE weekly_growth_rate IS NOT NULL GROUP BY 2, 3
    UNION ALL SELECT 'herd_momentum_score', repo_id, week_start, max(herd_momentum_score) FROM weekly WHERE herd_momentum_score IS NOT NULL AND previous_week_stars IS NOT NULL GROUP BY 2, 3),
flagged AS (SELECT *, isnan(v) OR isinf(v) OR v < CASE WHEN field = 'herd_momentum_score' THEN 0 ELSE -1 END AS bad FROM vals),
good AS (SELECT *, count(*) OVER (PARTITION BY field, repo_id) AS n, median(v) OVER (PARTITION BY field, repo_id) AS med,
    row_number() OVER (PARTITION BY field, repo_id ORDER BY p) - row_number() OVER (PARTITION BY field, repo_id, v ORDER BY p) AS run FROM flagged WHERE NOT bad),
spread AS (SELECT *, median(abs(v - med)) OVER (PARTITION BY field, repo_id) AS mad, count(*) OVER (PARTITION BY field, repo_id, v, run) AS run_n FROM good)"""

DENSE_SQL = """
counted AS (SELECT repo_id, date AS p, max(daily_new_stars) AS v FROM daily WHERE daily_new_stars IS NOT NULL GROUP BY 1, 2),
cells AS (SELECT repo_id, CAST(unnest(generate_series(min(p), max(p), INTERVAL 1 DAY)) AS DATE) AS p FROM counted GROUP BY 1),
dense AS (SELECT c.repo_id, c.p, coalesce(k.v, 0) AS v, row_number() OVER w AS n,
    sum(coalesce(k.v, 0)) OVER (w ROWS 6 PRECEDING) AS t7, sum(coalesce(k.v, 0)) OVER (w ROWS 29 PRECEDING) AS t30
    FROM cells c LEFT JOIN counted k ON c.repo_id = k.repo_id AND c.p = k.p WINDOW w AS (PARTITION BY c.repo_id ORDER BY c.p))"""

TOKENS_SQL = r"""regexp_extract_all({t}, '"(?:[^"]|"")*"|''[^'']*''|[\p{{L}}\p{{N}}+#._-]+')"""


def oracle_sql() -> dict[str, str]:
    grid = lambda readings, day, value, step, out: GRID_SQL.format(readings=readings, day=day, value=value, step=step, out=out)
    daily_cells, weekly_cells = grid("daily", "date", "daily_new_stars", 1, "day"), grid("weekly", "week_start", "weekly_new_stars", 7, "week_start")
    topics = TOKENS_SQL.format(t="topics")
    body = """trim(CASE WHEN length(form) > 1 AND form[1] = '"' AND form[-1] = '"' THEN replace(substr(form, 2, length(form) - 2), '""', '"')
        WHEN length(form) > 1 AND form[1] = '''' AND form[-1] = '''' THEN substr(form, 2, length(form) - 2) ELSE form END)"""
    return {
        "p1_daily_grid": f"WITH {WEEK_SQL}, {daily_cells}",
        "p1_weekly_grid": f"WITH {WEEK_SQL}, {weekly_cells}",
        "p1_found": f"""WITH {WEEK_SQL}, d AS (WITH {daily_cells}), w AS (WITH {weekly_cells})
            SELECT 'daily' AS series, repo_id, strftime(day, '%Y-%m-%d') AS period_start FROM d WHERE filled
            UNION ALL SELECT 'weekly', repo_id, strftime(week_start, '%Y-%m-%d') FROM w WHERE filled""",
        "p2_found": f"""WITH {WEEK_SQL}, {VALUES_SQL}
            SELECT field, repo_id, strftime(p, '%Y-%m-%d') AS period_start FROM flagged WHERE bad
            UNION ALL SELECT field, repo_id, strftime(p, '%Y-%m-%d') FROM spread WHERE n >= 12 AND (abs(v - med) > 10 * mad OR run_n >= 5)""",
        "p3_trailing": f"""WITH {WEEK_SQL}, {DENSE_SQL}
            SELECT repo_id, p AS on_day, v AS daily_new_stars, CAST(t7 AS BIGINT) AS total_7, round(t7 / least(n, 7), 6) AS avg_7,
                CAST(t30 AS BIGINT) AS total_30, round(t30 / least(n, 30), 6) AS avg_30 FROM dense""",
        "p3_found": f"WITH {WEEK_SQL}, {DENSE_SQL} SELECT repo_id, strftime(p, '%Y-%m-%d') AS on_day FROM dense WHERE n >= 30 AND 2 * t7 > t30",
        "p5_found": f"""WITH {WEEK_SQL},
            refs AS (
                SELECT 'stars' AS src_table, repo_id, coalesce(strftime(starred_at, '%Y-%m'), 'unknown') AS month_key, collected_at FROM stars
                UNION ALL SELECT 'weekly_timeseries', repo_id, coalesce(strftime(week_start, '%Y-%m'), 'unknown'), NULL FROM weeks
                UNION ALL SELECT 'herd_modeling', repo_id, coalesce(strftime(created_at, '%Y-%m'), 'unknown'), NULL FROM herd_modeling),
            own AS (SELECT repo_id, min(collected_at) AS first_at FROM repositories WHERE repo_id IS NOT NULL GROUP BY 1),
            gone AS (SELECT DISTINCT repo_id FROM removed_repositories WHERE repo_id IS NOT NULL),
            judged AS (SELECT r.*, CASE WHEN o.repo_id IS NULL AND g.repo_id IS NULL THEN 'missing' WHEN o.repo_id IS NULL THEN 'deleted'
                WHEN r.src_table = 'stars' AND o.first_at > r.collected_at THEN 'late' END AS kind
                FROM refs r LEFT JOIN own o ON r.repo_id = o.repo_id LEFT JOIN gone g ON r.repo_id = g.repo_id WHERE r.repo_id IS NOT NULL)
            SELECT DISTINCT src_table, repo_id, kind, month_key FROM judged WHERE kind IS NOT NULL""",
        "p6_found": f"""WITH f AS (SELECT 'repositories' AS src_table, repo_id, {topics} AS forms FROM repositories
                UNION ALL SELECT 'herd_modeling', repo_id, {topics} FROM herd_modeling),
            v AS (SELECT src_table, repo_id, list_filter(list_transform(forms, lambda form: {body}), lambda x: x <> '') AS t FROM f)
            SELECT DISTINCT src_table, repo_id, CAST(pos AS INT) AS pos, topic FROM (
                SELECT src_table, repo_id, unnest(t) AS topic, unnest(range(1, len(t) + 1)) AS pos FROM v)""",
        "p7_totals": """SELECT 'repo_id' AS key_field, CAST(repo_id AS VARCHAR) AS key_value, count(*) AS n_rows, min(starred_at) AS first_at, max(starred_at) AS last_at FROM stars GROUP BY 2
            UNION ALL SELECT 'repo_full_name', repo_full_name, count(*), min(starred_at), max(starred_at) FROM stars GROUP BY 2""",
        "p7_found": """WITH k AS (SELECT 'repo_id' AS key_field, CAST(repo_id AS VARCHAR) AS key_value FROM stars UNION ALL SELECT 'repo_full_name', repo_full_name FROM stars)
            SELECT key_field, key_value FROM k WHERE key_value IS NOT NULL GROUP BY 1, 2 HAVING count(*) * 50 >= (SELECT count(*) FROM stars)""",
    }
