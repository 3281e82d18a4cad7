"""One query per operator of the reference pipeline, over its six tables, with SQL for the comparison."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from growthlens.functions.dates import parse_week_start, to_utc
from growthlens.functions.topics import TOPIC_KEYWORDS, topic_count, topic_flags, topic_list
from growthlens.functions.values import clean_text, filled_text, is_known, number_or, percent, text_or, to_number, whole_or
from growthlens.operators import clean, derive, features, profile
from growthlens.operators.heavy_keys import key_totals
from growthlens.plans.reports import REPORT, TOP_LANGUAGES
from growthlens.sources.contracts import TABLES
from growthlens.sources.readers import read_tables, run_sql
from growthlens.sources.tables import table

Query = Callable[[SparkSession, str], DataFrame]


def even(x: Column, digits: int) -> Column:
    """A computed double at a fixed number of decimals: engines add doubles in different orders."""
    return F.rint(x * 10.0**digits) / 10.0**digits


def even_sql(x: str, digits: int) -> str:
    return f"(round_even(({x}) * {10.0**digits}::DOUBLE, 0) / {10.0**digits}::DOUBLE)"


def unzoned(df: DataFrame) -> DataFrame:
    """Moments without zone; all else as it is."""
    moments = {f.name: F.col(f"`{f.name}`").cast("timestamp_ntz") for f in df.schema.fields if isinstance(f.dataType, T.TimestampType)}
    return df.withColumns(moments) if moments else df


def sql_of(title: str) -> Query:
    text = REPORT.get(title, title)

    def query(spark: SparkSession, folder: str) -> DataFrame:
        read_tables(spark, folder, [n for n in TABLES if re.search(rf"\b{n}\b", text)])
        return unzoned(run_sql(spark, text))

    return query


def on(name: str, plan: Callable[[DataFrame], DataFrame]) -> Query:
    """A query of one table."""
    return lambda spark, folder: unzoned(plan(table(spark, folder, name)))


def with_all(plan: Callable[[dict[str, DataFrame]], DataFrame]) -> Query:
    return lambda spark, folder: unzoned(plan({n: table(spark, folder, n) for n in TABLES}))


def table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    one = lambda n, df: df.agg(F.lit(n).alias("name"), F.count(F.lit(1)).alias("n_rows"), F.lit(len(df.columns)).alias("n_columns"))
    return reduce(DataFrame.unionByName, [one(n, df) for n, df in tables.items()])


def language_filled(df: DataFrame) -> DataFrame:
    return df.withColumn("language", F.coalesce("language", F.lit("Unknown")))


def weekly_parsed(df: DataFrame) -> DataFrame:
    return df.withColumns({"week_start": parse_week_start(F.col("week")), "weekly_new_stars": to_number(F.col("weekly_new_stars"))})


def calendar(df: DataFrame) -> DataFrame:
    return df.select("repo_id", F.year("created_at").alias("created_year"), F.month("created_at").alias("created_month"), F.weekday("created_at").alias("created_weekday"))


def ages(df: DataFrame) -> DataFrame:
    from growthlens.functions.dates import age_days

    return df.select("repo_id", *(age_days(F.col(c)).alias(out) for c, out in (("created_at", "repo_age_days"), ("updated_at", "days_since_update"), ("pushed_at", "days_since_push"))))


def coerced(df: DataFrame) -> DataFrame:
    """Numbers out of texts of which some are none, and numbers that are missing."""
    mixed = F.when(F.col("repo_id") % 3 == 0, F.concat(F.lit("n"), F.col("week"))).otherwise(F.col("weekly_new_stars").cast("string"))
    return df.select("repo_id", to_number(mixed).alias("number"), whole_or(mixed, 1).alias("whole"), number_or(F.col("previous_week_stars"), 0).alias("previous_week_stars"))


def long_form(df: DataFrame, prefixes: tuple[str, ...] = ()) -> DataFrame:
    """repo_id, feature and value of a wide table whose columns depend on the data."""
    columns = [c for c in df.columns if c != "repo_id" and (not prefixes or c.startswith(prefixes))]
    pairs = F.array(*(F.struct(F.lit(c).alias("feature"), F.col(f"`{c}`").cast("double").alias("value")) for c in columns))
    return df.select("repo_id", F.explode(pairs).alias("p")).select("repo_id", "p.feature", "p.value")


def hot_shares(df: DataFrame) -> DataFrame:
    """Rows per repository as a share of all, where single keys hold much."""
    totals = key_totals(df, ["repo_id"])
    return totals.where("key_value is not null").select(F.col("key_value").cast("bigint").alias("repo_id"), "n_rows", percent(F.col("n_rows"), df.agg(F.count(F.lit(1)).alias("n")).scalar()).alias("share"))


def grouped_categories(df: DataFrame) -> DataFrame:
    out = features.group_rare(clean.clean_herd(df), "language", 8, "language_grouped", "Unknown")
    return features.group_rare(out, "license", 6, "license_grouped", "No License").select("repo_id", "language_grouped", "license_grouped")


def hot(df: DataFrame) -> DataFrame:
    wide = features.one_hot(grouped_categories(df), ["language_grouped", "license_grouped"])
    return long_form(wide).withColumn("value", F.col("value").cast("int"))


def target(df: DataFrame) -> DataFrame:
    return derive.growth_target(derive.early_later(derive.derive_weekly(df)))


def described_numbers(df: DataFrame) -> DataFrame:
    """Mean and deviation, which are computed, at fixed decimals; the other statistics are values of the column or between two."""
    found = profile.describe_numeric(df)
    of = lambda x: F.when(F.col("column").rlike(FRACTIONS.pattern), even(F.col(x), 6)).otherwise(even(F.col(x), 2))
    return found.withColumns({x: of(x) for x in ("mean", "std")})


def scaled_series(df: DataFrame) -> DataFrame:
    numbers = clean.clean_herd(df)
    return features.Scaler.fit(numbers, ["early_4week_stars", "later_stars"]).transform(numbers).select("repo_id", *(even(F.col(c), 6).alias(c) for c in ("early_4week_stars", "later_stars")))


def queries() -> dict[str, Query]:
    herd_clean = lambda df: features.herd_features(clean.clean_herd(df))
    of_all = lambda tables: clean.clean_all(tables)
    described = {f"describe_{n}": on(n, described_numbers) for n in TABLES}
    cleaned = {f"clean_{n}": on(n, clean.CLEANERS[n]) for n in TABLES}
    return {
        "count_repositories": sql_of("Total Repositories"),
        "count_stars": sql_of("Total Star Interactions"),
        "count_distinct_users": sql_of("Total Unique Users"),
        "top_categories_coalesced": sql_of("Top 10 Programming Languages"),
        "top_entities_by_measure": sql_of("Top 10 Repositories by GitHub Star Count"),
        "top_entities_by_events": sql_of("Top 10 Repositories by Collected Stargazer Interactions"),
        "class_balance": sql_of("Herd Modeling Class Balance"),
        "class_means_sql": sql_of("Average Early and Later Stars by Herd Class"),
        "weekly_sample": sql_of("Weekly Time-Series Example"),
        "top5_categories_nullable": sql_of(TOP_LANGUAGES),
        "table_counts": with_all(table_counts),
        "top_by_label": on("stars", lambda df: profile.top_k(profile.value_counts(df, "repo_full_name"), "n", 10, ["repo_full_name"])),
        "value_counts_top": on("repositories", lambda df: profile.top_k(profile.value_counts(language_filled(df), "language"), "n", 10, ["language"])),
        "class_counts": on("herd_modeling", lambda df: profile.value_counts(df, "became_high_growth")),
        "class_means_rounded": on("herd_modeling", lambda df: profile.group_means(df, "became_high_growth", ["early_4week_stars", "later_stars"], 2, keep_null=False)),
        "null_profile": with_all(profile.null_profile),
        "null_profile_missing": with_all(lambda t: profile.null_profile(t).where("missing_count > 0")),
        "null_totals": with_all(profile.null_totals),
        "null_totals_cleaned": with_all(lambda t: profile.null_totals(of_all(t))),
        **described,
        "scalar_stats": on("repositories", lambda df: reduce(DataFrame.unionByName, [profile.scalar_stats(df, c).withColumn("column", F.lit(c)) for c in ("stars_count", "forks_count")])),
        "histogram50": on("repositories", lambda df: profile.histogram(df, "stars_count").select("bin", "n")),
        "top5_weekly_series": on("weekly_timeseries", lambda df: profile.leaders_series(weekly_parsed(df), "repo_full_name", "week_start", "weekly_new_stars")),
        "dropna_any": on("herd_modeling", lambda df: df.select("repo_id", "language", "license", "created_at").dropna()),
        "dropna_subset": on("weekly_timeseries", lambda df: weekly_parsed(df).dropna(subset=["week_start", "weekly_new_stars"]).select("repo_id", "week_start", "weekly_new_stars")),
        "week_start_parse": on("weekly_timeseries", lambda df: df.select("repo_id", "week", parse_week_start(F.col("week")).alias("week_start"))),
        "timestamp_coerce": on("weekly_timeseries", lambda df: df.select("repo_id", to_utc(F.substring_index("week", "/", 1)).alias("moment")).where("moment is not null")),
        "numeric_coerce": on("weekly_timeseries", coerced),
        "age_days": on("repositories", ages),
        "calendar_parts": on("repositories", calendar),
        "string_defaults": on("repositories", lambda df: df.select("repo_id", filled_text(F.col("language"), "Unknown").alias("language"), filled_text(F.col("license"), "No License").alias("license"), text_or(F.col("homepage"), "No Homepage").alias("homepage"), is_known(F.col("homepage")).alias("has_homepage"))),
        "clean_text_length": on("repositories", lambda df: df.select("repo_id", clean_text(F.col("description")).alias("description"), F.length(clean_text(F.col("description"))).alias("description_length"))),
        "topic_count": on("repositories", lambda df: df.select("repo_id", "topics", topic_count(F.col("topics")).alias("topic_count"), topic_count(F.col("topics"), "|").alias("bar_count"))),
        "topic_list": on("repositories", lambda df: df.select("repo_id", topic_list(F.col("topics")).alias("t")).select("repo_id", F.explode("t").alias("topic"))),
        "topic_flags": on("repositories", lambda df: df.select("repo_id", *(e.alias(n) for n, e in topic_flags(F.col("topics")).items()))),
        "median_impute": on("herd_modeling", lambda df: clean.impute_medians(df, ["stars_count", "early_avg_weekly_stars", "later_stars"]).select("repo_id", "stars_count", "early_avg_weekly_stars", "later_stars")),
        "ratio_features": on("herd_modeling", lambda df: features.add_ratios(clean.clean_herd(df)).select("repo_id", "early_to_total_star_ratio", "early_peak_to_average_ratio", "forks_per_star", "issues_per_star")),
        **cleaned,
        "derive_daily": on("stars", derive.derive_daily),
        "derive_weekly": on("stars", derive.derive_weekly),
        "early_later": on("stars", lambda df: derive.early_later(derive.derive_weekly(df))),
        "growth_target": on("stars", target),
        "weekly_features": on("weekly_timeseries", lambda df: features.weekly_features(clean.clean_weekly(df)).select("repo_id", "week_start", "weekly_new_stars", "cumulative_stars", "lag_1_week_stars", "lag_2_week_stars", "rolling_3week_mean_stars", "rolling_4week_sum_stars", "weekly_growth_acceleration", "cumulative_growth_lag_1")),
        "interaction_counts": on("user_repo_interactions", features.interaction_counts),
        "recommendation_features": lambda spark, folder: unzoned(features.recommendation_features(clean.clean_interactions(table(spark, folder, "user_repo_interactions")), clean.clean_repositories(table(spark, folder, "repositories")))),
        "repository_features": on("repositories", lambda df: features.add_topic_flags(clean.clean_repositories(df))),
        "herd_features": on("herd_modeling", herd_clean),
        "hot_key_shares": on("stars", hot_shares),
        "rare_category_group": on("herd_modeling", grouped_categories),
        "one_hot": on("herd_modeling", hot),
        "standard_scale": on("herd_modeling", scaled_series),
        "model_ready": on("herd_modeling", lambda df: long_form(features.model_ready(herd_clean(df))).withColumn("value", even(F.col("value"), 6))),
    }


# --- SQL ---------------------------------------------------------------------------------------

#: Columns of fractions, whose computed statistics have six decimals; those of counts and ids have two.
FRACTIONS = re.compile("rate|avg")
NUMERIC = ("bigint", "int", "double", "boolean")


def numeric_names(name: str) -> list[str]:
    return [c.split()[0] for c in TABLES[name].ddl.split(", ") if c.split()[1] in NUMERIC]


def all_names(name: str) -> list[str]:
    return [c.split()[0] for c in TABLES[name].ddl.split(", ")]


def describe_sql(name: str) -> str:
    def one(c: str) -> str:
        x = f"CASE WHEN NOT isnan(CAST({c} AS DOUBLE)) THEN CAST({c} AS DOUBLE) END"
        endless = f"bool_or(isinf(CAST({c} AS DOUBLE)))"
        finite = f"CASE WHEN NOT isinf(CAST({c} AS DOUBLE)) THEN {x} END"
        mean = f"CASE WHEN {endless} THEN CASE WHEN max({x}) = 'inf' AND min({x}) = '-inf' THEN 'nan' WHEN max({x}) = 'inf' THEN 'inf' ELSE '-inf' END::DOUBLE ELSE avg({finite}) END"
        digits = 6 if FRACTIONS.search(c) else 2
        std = f"CASE WHEN {endless} THEN 'nan'::DOUBLE ELSE stddev_samp({finite}) END"
        numbers = {"mean": mean, "std": std, "min": f"min({x})", "p25": f"quantile_cont({x}, 0.25)", "p50": f"quantile_cont({x}, 0.5)", "p75": f"quantile_cont({x}, 0.75)", "max": f"max({x})"}
        return f"SELECT '{c}' AS \"column\", count({x}) AS \"count\", " + ", ".join(f"{even_sql(e, digits) if k in ('mean', 'std') else e} AS \"{k}\"" for k, e in numbers.items()) + f" FROM {name}"

    return " UNION ALL ".join(map(one, numeric_names(name)))


def nulls_sql(where: str = "") -> str:
    one = lambda n, c: f"SELECT '{n}' AS \"table\", '{c}' AS \"column\", count(*) - count({c}) AS missing_count, {f'round_even((count(*) - count({c})) * 100.0::DOUBLE / count(*), 2)'} AS missing_percent FROM {n}"
    body = " UNION ALL ".join(one(n, c) for n in TABLES for c in all_names(n))
    return f"SELECT * FROM ({body}) {where}"


#: A list literal of quoted texts, and its items.
LIST, ITEMS = r"""\[\s*(("[^"]*"|''[^'']*'')\s*(,\s*("[^"]*"|''[^'']*'')\s*)*)?\]""", r"""["][^"]*"|''[^'']*''"""
BLANKS = "' ' || chr(9) || chr(10) || chr(13)"
COUNT = f"""CASE WHEN {{t}} IS NULL OR trim({{t}}, {BLANKS}) IN ('', '[]') THEN 0
    WHEN regexp_full_match(trim({{t}}, {BLANKS}), '{LIST}', 's') THEN len(regexp_extract_all({{t}}, '{ITEMS}'))
    WHEN contains(trim({{t}}, {BLANKS}), '{{d}}') THEN len(list_filter(string_split(trim({{t}}, {BLANKS}), '{{d}}'), lambda x: trim(x, {BLANKS}) <> '')) ELSE 1 END"""


def count_sql(text: str, delimiter: str = ",") -> str:
    return f"CAST({COUNT.format(t=text, d=delimiter)} AS INT)"


def flags_sql(text: str) -> str:
    test = lambda words: " OR ".join(f"contains(lower({text}), '{w}')" for w in words)
    return ", ".join(f"CAST(coalesce({test(words)}, FALSE) AS INT) AS {n}" for n, words in TOPIC_KEYWORDS.items())


def or_median(column: str, source: str) -> str:
    x = lambda p: f"CASE WHEN NOT isnan(CAST({p}{column} AS DOUBLE)) THEN CAST({p}{column} AS DOUBLE) END"
    return f"coalesce({x('')}, (SELECT median({x('m.')}) FROM {source} m))"


AGE = "CAST(greatest(floor((epoch_us(TIMESTAMP '2026-06-14') - epoch_us({c})) / 86400000000.0), CASE WHEN {c} IS NOT NULL THEN 0 END) AS BIGINT)"
TEXT = "CASE WHEN description IS NULL OR regexp_replace(description, '^\\s+|\\s+$', '', 'g') = '' THEN 'No Description' ELSE regexp_replace(description, '^\\s+|\\s+$', '', 'g') END"
WEEK = """(SELECT *, CASE WHEN regexp_full_match(w1, '\\d{4}') THEN CAST(w1 || '-01-01' AS DATE) ELSE CAST(TRY_CAST(w1 AS TIMESTAMP) AS DATE) END AS week_start
    FROM (SELECT *, CASE WHEN regexp_matches(w0, '^\\d{4}-\\d{2}-\\d{2}T') THEN substr(w0, 1, 10) WHEN regexp_matches(w0, '^\\d{4}$|^\\d{4}-\\d{1,2}-\\d{1,2}$') THEN w0 END AS w1
    FROM (SELECT *, trim(string_split(week, '/')[1]) AS w0 FROM weekly_timeseries)))"""
FILLED = "CASE WHEN {c} IS NULL OR {c} = '' THEN '{d}' ELSE {c} END"


def number_sql(c: str, default: str = "0.0") -> str:
    return f"coalesce(CASE WHEN NOT isnan(CAST({c} AS DOUBLE)) THEN CAST({c} AS DOUBLE) END, {default}::DOUBLE)"


REPOSITORIES = f"""base AS (SELECT * REPLACE ({FILLED.format(c='language', d='Unknown')} AS language, {FILLED.format(c='license', d='No License')} AS license,
        coalesce(homepage, 'No Homepage') AS homepage, {TEXT} AS description, coalesce(topics, '[]') AS topics),
        CAST(homepage IS NOT NULL AS INT) AS has_homepage, {AGE.format(c='created_at')} AS age, {AGE.format(c='updated_at')} AS since_update, {AGE.format(c='pushed_at')} AS since_push,
        CAST(length({TEXT}) AS INT) AS text_length, {count_sql("coalesce(topics, '[]')")} AS n_topics FROM repositories),
    imputed AS (SELECT * EXCLUDE (age, since_update, since_push, text_length, n_topics) REPLACE ({', '.join(f"{or_median(c, 'base')} AS {c}" for c in ('stars_count', 'forks_count', 'watchers_count', 'open_issues_count'))}),
        {or_median('age', 'base')} AS repo_age_days, {or_median('since_update', 'base')} AS days_since_update, {or_median('since_push', 'base')} AS days_since_push,
        {or_median('text_length', 'base')} AS description_length, {or_median('n_topics', 'base')} AS topic_count,
        CAST(year(created_at) AS INT) AS created_year, CAST(month(created_at) AS INT) AS created_month, CAST(isodow(created_at) - 1 AS INT) AS created_weekday FROM base),
    repos AS (SELECT *, stars_count / (repo_age_days + 1) AS stars_per_day, forks_count / (stars_count + 1) AS forks_per_star, open_issues_count / (stars_count + 1) AS issues_per_star FROM imputed)"""

HERD_MEDIANS = [c for c in clean.HERD_NUMBERS if c not in ("topic_count", "later_max_weekly_stars")]
HERD = f"""base AS (SELECT * REPLACE ({FILLED.format(c='language', d='Unknown')} AS language, {FILLED.format(c='license', d='No License')} AS license, coalesce(topics, '[]') AS topics,
        CAST(coalesce(became_high_growth, 0) AS BIGINT) AS became_high_growth), {count_sql("coalesce(topics, '[]')")} AS n_topics FROM herd_modeling),
    herd AS (SELECT * EXCLUDE (n_topics) REPLACE ({', '.join(f"{or_median(c, 'base')} AS {c}" for c in HERD_MEDIANS)}), {or_median('n_topics', 'base')} AS topic_count FROM base),
    rated AS (SELECT *, {flags_sql('topics')}, early_4week_stars / (stars_count + 1) AS early_to_total_star_ratio, early_max_weekly_stars / (early_avg_weekly_stars + 1) AS early_peak_to_average_ratio,
        forks_count / (stars_count + 1) AS forks_per_star, open_issues_count / (stars_count + 1) AS issues_per_star FROM herd),
    top_languages AS (SELECT language AS v FROM herd GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 8), top_licenses AS (SELECT license AS v FROM herd GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 6),
    grouped AS (SELECT *, CASE WHEN language IN (SELECT v FROM top_languages) THEN language ELSE 'Other' END AS language_grouped,
        CASE WHEN license IN (SELECT v FROM top_licenses) THEN license ELSE 'Other' END AS license_grouped FROM rated)"""
HOT = " UNION ALL ".join(
    f"SELECT repo_id, '{c}_' || d.v AS feature, CAST(g.{c} = d.v AS INT) AS value FROM grouped g CROSS JOIN (SELECT DISTINCT {c} AS v FROM grouped WHERE {c} IS NOT NULL) d" for c in ("language_grouped", "license_grouped")
)
PREDICTORS = ["early_4week_stars", "early_avg_weekly_stars", "early_max_weekly_stars", "archived", "is_fork", "topic_count", *TOPIC_KEYWORDS, "early_peak_to_average_ratio"]
WEEKLY_NUMBERS = ("weekly_new_stars", "cumulative_stars", "previous_week_stars", "weekly_growth_rate", "herd_momentum_score")
WEEKLY = f"weekly AS (SELECT * EXCLUDE (w0, w1) REPLACE ({', '.join(f'{number_sql(c)} AS {c}' for c in WEEKLY_NUMBERS)}) FROM {WEEK})"
DERIVED = """weeks AS (SELECT repo_id, CAST(date_trunc('week', CAST(starred_at AS DATE)) AS DATE) AS week_start, count(*) AS weekly_new_stars FROM stars
        WHERE repo_id IS NOT NULL AND starred_at IS NOT NULL GROUP BY 1, 2),
    series AS (SELECT *, CAST(sum(weekly_new_stars) OVER w AS BIGINT) AS cumulative_stars, lag(weekly_new_stars) OVER w AS previous_week_stars, row_number() OVER w AS n FROM weeks WINDOW w AS (PARTITION BY repo_id ORDER BY week_start)),
    early AS (SELECT repo_id, CAST(sum(weekly_new_stars) FILTER (n <= 4) AS BIGINT) AS early_4week_stars, avg(weekly_new_stars) FILTER (n <= 4) AS early_avg_weekly_stars, max(weekly_new_stars) FILTER (n <= 4) AS early_max_weekly_stars,
        CAST(coalesce(sum(weekly_new_stars) FILTER (n > 4), 0) AS BIGINT) AS later_stars, coalesce(avg(weekly_new_stars) FILTER (n > 4), 0.0) AS later_avg_weekly_stars FROM series GROUP BY 1)"""


def all_of(sql_table: str, ctes: str) -> str:
    return f"WITH {ctes} SELECT * FROM {sql_table}"


def oracle_sql() -> dict[str, str]:
    report = {name: REPORT[title] for name, title in {
        "count_repositories": "Total Repositories", "count_stars": "Total Star Interactions", "count_distinct_users": "Total Unique Users", "top_categories_coalesced": "Top 10 Programming Languages",
        "top_entities_by_measure": "Top 10 Repositories by GitHub Star Count", "top_entities_by_events": "Top 10 Repositories by Collected Stargazer Interactions", "class_balance": "Herd Modeling Class Balance",
    }.items()}
    means = lambda digits: ", ".join((f"round_even(avg({c}), 2)" if digits else f"avg({c})") + f" AS avg_{c}" for c in ("early_4week_stars", "later_stars"))
    weekly_order = "PARTITION BY repo_id ORDER BY week_start, cumulative_stars, weekly_new_stars, repo_full_name NULLS FIRST, week, previous_week_stars, weekly_growth_rate, herd_momentum_score"
    stars_repo_counts = """user_n AS (SELECT user_id, count(*) AS n FROM user_repo_interactions WHERE user_id IS NOT NULL GROUP BY 1), repo_n AS (SELECT repo_id, count(*) AS n FROM user_repo_interactions WHERE repo_id IS NOT NULL GROUP BY 1)"""
    model = f"""WITH {HERD}, hot AS ({HOT}),
        long AS ({' UNION ALL '.join(f"SELECT repo_id, '{c}' AS feature, {number_sql(c)} AS value FROM grouped" for c in PREDICTORS)} UNION ALL SELECT repo_id, feature, CAST(value AS DOUBLE) FROM hot),
        fitted AS (SELECT feature, avg(value) AS m, stddev_pop(value) AS s FROM long GROUP BY 1)
        SELECT l.repo_id, l.feature, {even_sql('CASE WHEN f.s = 0 THEN 0.0 ELSE (l.value - f.m) / f.s END', 6)} AS value FROM long l JOIN fitted f ON l.feature = f.feature
        UNION ALL SELECT repo_id, 'became_high_growth', CAST(became_high_growth AS DOUBLE) FROM grouped"""
    interactions = "SELECT * REPLACE (coalesce(username, 'unknown_user') AS username, CAST(coalesce(interaction, 1) AS BIGINT) AS interaction) FROM user_repo_interactions"
    daily = ", ".join(f"{number_sql(c)} AS {c}" for c in ("daily_new_stars", "cumulative_stars", "daily_growth_rate"))
    texts = report | {
        "class_means_sql": f"SELECT became_high_growth, {means(False)} FROM herd_modeling GROUP BY 1",
        "weekly_sample": REPORT["Weekly Time-Series Example"],
        "top5_categories_nullable": TOP_LANGUAGES,
        "table_counts": " UNION ALL ".join(f"SELECT '{n}' AS name, count(*) AS n_rows, {len(all_names(n))} AS n_columns FROM {n}" for n in TABLES),
        "top_by_label": "SELECT repo_full_name, count(*) AS n FROM stars WHERE repo_full_name IS NOT NULL GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10",
        "value_counts_top": "SELECT coalesce(language, 'Unknown') AS language, count(*) AS n FROM repositories GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10",
        "class_counts": "SELECT became_high_growth, count(*) AS n FROM herd_modeling WHERE became_high_growth IS NOT NULL GROUP BY 1",
        "class_means_rounded": f"SELECT became_high_growth, {means(True)} FROM herd_modeling WHERE became_high_growth IS NOT NULL GROUP BY 1",
        "null_profile": nulls_sql(),
        "null_profile_missing": nulls_sql("WHERE missing_count > 0"),
        "null_totals": f"SELECT \"table\", CAST(sum(missing_count) AS BIGINT) AS total_missing_values FROM ({nulls_sql()}) GROUP BY 1",
        **{f"describe_{n}": describe_sql(n) for n in TABLES},
        "scalar_stats": " UNION ALL ".join(f"SELECT min({c})::DOUBLE AS minimum, max({c})::DOUBLE AS maximum, {f'avg({c})'} AS mean, {f'median({c})'} AS median, '{c}' AS \"column\" FROM repositories" for c in ("stars_count", "forks_count")),
        "histogram50": """WITH r AS (SELECT min(stars_count)::DOUBLE AS lo, (max(stars_count) - min(stars_count))::DOUBLE / 50 AS w FROM repositories),
            c AS (SELECT CAST(least(floor((stars_count - lo) / w), 49) AS INT) AS bin, count(*) AS n FROM repositories, r WHERE stars_count IS NOT NULL GROUP BY 1)
            SELECT CAST(b.bin AS INT) AS bin, coalesce(c.n, 0) AS n FROM range(50) b(bin) LEFT JOIN c ON b.bin = c.bin""",
        "top5_weekly_series": f"""WITH w AS (SELECT repo_full_name, week_start, CAST(weekly_new_stars AS DOUBLE) AS weekly_new_stars FROM {WEEK} WHERE week_start IS NOT NULL AND weekly_new_stars IS NOT NULL),
            t AS (SELECT repo_full_name FROM w WHERE repo_full_name IS NOT NULL GROUP BY 1 ORDER BY sum(weekly_new_stars) DESC, 1 LIMIT 5) SELECT * FROM w WHERE repo_full_name IN (SELECT * FROM t)""",
        "dropna_any": "SELECT repo_id, language, license, created_at FROM herd_modeling WHERE repo_id IS NOT NULL AND language IS NOT NULL AND license IS NOT NULL AND created_at IS NOT NULL",
        "dropna_subset": f"SELECT repo_id, week_start, CAST(weekly_new_stars AS DOUBLE) AS weekly_new_stars FROM {WEEK} WHERE week_start IS NOT NULL AND weekly_new_stars IS NOT NULL",
        "week_start_parse": f"SELECT repo_id, week, week_start FROM {WEEK}",
        "timestamp_coerce": f"SELECT repo_id, CAST(week_start AS TIMESTAMP) AS moment FROM {WEEK} WHERE week_start IS NOT NULL",
        "numeric_coerce": f"""SELECT repo_id, x AS number, CAST(coalesce(x, 1) AS BIGINT) AS whole, {number_sql('previous_week_stars')} AS previous_week_stars FROM
            (SELECT *, CASE WHEN repo_id % 3 = 0 THEN NULL ELSE CAST(weekly_new_stars AS DOUBLE) END AS x FROM weekly_timeseries)""",
        "age_days": f"SELECT repo_id, {AGE.format(c='created_at')} AS repo_age_days, {AGE.format(c='updated_at')} AS days_since_update, {AGE.format(c='pushed_at')} AS days_since_push FROM repositories",
        "calendar_parts": "SELECT repo_id, CAST(year(created_at) AS INT) AS created_year, CAST(month(created_at) AS INT) AS created_month, CAST(isodow(created_at) - 1 AS INT) AS created_weekday FROM repositories",
        "string_defaults": f"SELECT repo_id, {FILLED.format(c='language', d='Unknown')} AS language, {FILLED.format(c='license', d='No License')} AS license, coalesce(homepage, 'No Homepage') AS homepage, CAST(homepage IS NOT NULL AS INT) AS has_homepage FROM repositories",
        "clean_text_length": f"SELECT repo_id, {TEXT} AS description, CAST(length({TEXT}) AS INT) AS description_length FROM repositories",
        "topic_count": f"SELECT repo_id, topics, {count_sql('topics')} AS topic_count, {count_sql('topics', '|')} AS bar_count FROM repositories",
        "topic_list": f"""SELECT repo_id, unnest(CASE WHEN regexp_full_match(trim(topics, {BLANKS}), '{LIST}', 's')
                THEN list_transform(regexp_extract_all(topics, '{ITEMS}'), lambda x: lower(substr(x, 2, length(x) - 2)))
            ELSE list_filter(list_transform(string_split(topics, ','), lambda x: lower(trim(x, {BLANKS}))), lambda x: x <> '') END) AS topic FROM repositories WHERE topics IS NOT NULL AND trim(topics, {BLANKS}) NOT IN ('', '[]')""",
        "topic_flags": f"SELECT repo_id, {flags_sql('topics')} FROM repositories",
        "median_impute": f"SELECT repo_id, {', '.join(f'{or_median(c, 'herd_modeling')} AS {c}' for c in ('stars_count', 'early_avg_weekly_stars', 'later_stars'))} FROM herd_modeling",
        "ratio_features": f"WITH {HERD} SELECT repo_id, early_to_total_star_ratio, early_peak_to_average_ratio, forks_per_star, issues_per_star FROM rated",
        "clean_repositories": all_of("repos", REPOSITORIES),
        "clean_stars": "SELECT * REPLACE (coalesce(username, 'unknown_user') AS username) FROM stars",
        "clean_user_repo_interactions": interactions,
        "clean_daily_timeseries": f"SELECT repo_id, repo_full_name, date, {daily} FROM daily_timeseries",
        "clean_weekly_timeseries": all_of("weekly", WEEKLY),
        "clean_herd_modeling": all_of("herd", HERD),
        "derive_daily": f"""WITH days AS (SELECT repo_id, CAST(starred_at AS DATE) AS date, count(*) AS daily_new_stars FROM stars WHERE repo_id IS NOT NULL AND starred_at IS NOT NULL GROUP BY 1, 2)
            SELECT *, CAST(sum(daily_new_stars) OVER w AS BIGINT) AS cumulative_stars, (daily_new_stars - lag(daily_new_stars) OVER w) / CAST(lag(daily_new_stars) OVER w AS DOUBLE) AS daily_growth_rate FROM days WINDOW w AS (PARTITION BY repo_id ORDER BY date)""",
        "derive_weekly": f"""WITH {DERIVED} SELECT repo_id, week_start, weekly_new_stars, cumulative_stars, previous_week_stars, (weekly_new_stars - previous_week_stars) / CAST(previous_week_stars AS DOUBLE) AS weekly_growth_rate,
            strftime(week_start, '%Y-%m-%d') || '/' || strftime(week_start + 6, '%Y-%m-%d') AS week, CAST(coalesce(previous_week_stars, 0) * cumulative_stars AS DOUBLE) AS herd_momentum_score FROM series""",
        "early_later": f"WITH {DERIVED} SELECT * FROM early",
        "growth_target": f"WITH {DERIVED} SELECT *, CAST(later_stars >= (SELECT median(later_stars) FROM early) AS INT) AS became_high_growth FROM early",
        "weekly_features": f"""WITH {WEEKLY}, w AS (SELECT * FROM weekly WHERE repo_id IS NOT NULL AND week_start IS NOT NULL)
            SELECT repo_id, week_start, weekly_new_stars, cumulative_stars, coalesce(lag(weekly_new_stars) OVER o, 0) AS lag_1_week_stars, coalesce(lag(weekly_new_stars, 2) OVER o, 0) AS lag_2_week_stars,
                avg(weekly_new_stars) OVER (o ROWS 2 PRECEDING) AS rolling_3week_mean_stars, sum(weekly_new_stars) OVER (o ROWS 3 PRECEDING) AS rolling_4week_sum_stars,
                coalesce(weekly_new_stars - lag(weekly_new_stars) OVER o, 0) AS weekly_growth_acceleration, coalesce(lag(cumulative_stars) OVER o, 0) AS cumulative_growth_lag_1 FROM w WINDOW o AS ({weekly_order})""",
        "interaction_counts": f"""WITH {stars_repo_counts} SELECT i.*, coalesce(u.n, 0) AS user_activity_count, coalesce(r.n, 0) AS repo_popularity_count
            FROM user_repo_interactions i LEFT JOIN user_n u ON i.user_id = u.user_id LEFT JOIN repo_n r ON i.repo_id = r.repo_id""",
        "recommendation_features": f"""WITH {stars_repo_counts}, {REPOSITORIES}, inter AS ({interactions}) SELECT i.*, coalesce(u.n, 0) AS user_activity_count, coalesce(r.n, 0) AS repo_popularity_count,
            coalesce(p.language, 'Unknown') AS language, coalesce(p.topic_count, 0) AS topic_count, coalesce(p.stars_count, 0) AS stars_count, coalesce(p.forks_count, 0) AS forks_count
            FROM inter i LEFT JOIN user_n u ON i.user_id = u.user_id LEFT JOIN repo_n r ON i.repo_id = r.repo_id LEFT JOIN repos p ON i.repo_id = p.repo_id""",
        "repository_features": f"WITH {REPOSITORIES} SELECT *, {flags_sql('topics')} FROM repos",
        "herd_features": all_of("rated", HERD),
        "hot_key_shares": f"SELECT repo_id, count(*) AS n_rows, count(*) * 100.0::DOUBLE / (SELECT count(*) FROM stars) AS share FROM stars WHERE repo_id IS NOT NULL GROUP BY 1",
        "rare_category_group": f"WITH {HERD} SELECT repo_id, language_grouped, license_grouped FROM grouped",
        "one_hot": f"WITH {HERD} SELECT * FROM ({HOT})",
        "standard_scale": f"""WITH {HERD} SELECT repo_id, {', '.join(f'{even_sql(f"({c} - avg({c}) OVER ()) / stddev_pop({c}) OVER ()", 6)} AS {c}' for c in ('early_4week_stars', 'later_stars'))} FROM herd""",
        "model_ready": model,
    }
    nulls_of = lambda name: f"""SELECT '{name}' AS "table", CAST(sum(n) AS BIGINT) AS total_missing_values FROM (UNPIVOT (SELECT count(*) - count(COLUMNS(*)) FROM ({texts[f'clean_{name}']})) ON COLUMNS(*) INTO NAME c VALUE n)"""
    return texts | {"null_totals_cleaned": " UNION ALL ".join(map(nulls_of, TABLES))}
