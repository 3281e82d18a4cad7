"""The fixed SQL report, the profiling report and the summaries, as data and as text."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from growthlens.operators.profile import describe_numeric, group_means, null_profile, null_totals, numeric_columns, scalar_stats, top_k, value_counts
from growthlens.sources.readers import run_sql
from growthlens.sources.sinks import banner, few_rows, fixed_width, shape, write_csv, write_text

#: The report's queries by title (titles here and headings below are fixed values). Every ORDER BY ends with unique keys, so that a LIMIT's result is defined.
REPORT = {
    "Total Repositories": "SELECT count(*) AS num_repositories FROM repositories",
    "Total Star Interactions": "SELECT count(*) AS num_star_interactions FROM stars",
    "Total Unique Users": "SELECT count(DISTINCT user_id) AS num_unique_users FROM stars",
    "Top 10 Programming Languages": """SELECT coalesce(language, 'Unknown') AS language, count(*) AS repo_count
        FROM repositories GROUP BY coalesce(language, 'Unknown') ORDER BY repo_count DESC, language LIMIT 10""",
    "Top 10 Repositories by GitHub Star Count": """SELECT full_name, language, stars_count, forks_count FROM repositories
        ORDER BY stars_count DESC NULLS LAST, full_name NULLS LAST, forks_count NULLS LAST, language NULLS LAST LIMIT 10""",
    "Top 10 Repositories by Collected Stargazer Interactions": """SELECT repo_full_name, count(*) AS collected_star_events FROM stars
        GROUP BY repo_id, repo_full_name ORDER BY collected_star_events DESC, repo_id NULLS LAST, repo_full_name NULLS LAST LIMIT 10""",
    "Herd Modeling Class Balance": "SELECT became_high_growth, count(*) AS repo_count FROM herd_modeling GROUP BY became_high_growth",
    "Average Early and Later Stars by Herd Class": """SELECT became_high_growth, avg(early_4week_stars) AS avg_early_4week_stars, avg(later_stars) AS avg_later_stars
        FROM herd_modeling GROUP BY became_high_growth""",
    "Weekly Time-Series Example": """SELECT repo_full_name, week, weekly_new_stars, cumulative_stars, herd_momentum_score FROM weekly_timeseries
        ORDER BY cumulative_stars DESC NULLS LAST, repo_id NULLS LAST, week NULLS LAST, weekly_new_stars NULLS LAST, herd_momentum_score NULLS LAST, repo_full_name NULLS LAST LIMIT 20""",
}
TOP_LANGUAGES = """SELECT language, count(*) AS repo_count FROM repositories GROUP BY language
    ORDER BY repo_count DESC, language NULLS LAST LIMIT 5"""
#: The shorter suite that checks an import.
CHECKS = {
    "Total Repositories": REPORT["Total Repositories"],
    "Total Star Interactions": REPORT["Total Star Interactions"],
    "Top 5 Programming Languages": TOP_LANGUAGES,
    "Herd Modeling Target Class Balance": REPORT["Herd Modeling Class Balance"],
}


def run_report(spark: SparkSession, path: str | None = None, suite: dict[str, str] = REPORT, width: int = 80) -> str:
    """The suite over the registered tables as fixed-width text, also written to ``path``."""
    text = "".join(banner(title, fixed_width(run_sql(spark, query)), width) for title, query in suite.items())
    if path:
        write_text(text, path)
    return text


def load_summary(tables: dict[str, DataFrame]) -> str:
    return "\n".join("{}: {} rows, {} columns".format(n, *shape(df)) for n, df in tables.items())


def section(title: str, lines: list[str]) -> list[str]:
    return [title, "-" * 50, *lines, ""]


def profile_frames(tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """The profiling tables by file name; those whose columns exist."""
    repositories, stars, herd = (tables[n] for n in ("repositories", "stars", "herd_modeling"))
    frames = {"missing_values_summary": null_profile(tables)}
    if "language" in repositories.columns:
        languages = value_counts(repositories.withColumn("language", F.coalesce("language", F.lit("Unknown"))), "language", "repo_count")
        frames["top_languages"] = top_k(languages, "repo_count", 10, ["language"])
    if "became_high_growth" in herd.columns:
        frames["target_class_balance"] = value_counts(herd, "became_high_growth", "repo_count").orderBy("became_high_growth")
    if "repo_full_name" in stars.columns:
        frames["top_repositories_by_collected_interactions"] = top_k(value_counts(stars, "repo_full_name", "collected_star_interactions"), "collected_star_interactions", 10, ["repo_full_name"])
    if {"full_name", "stars_count"} <= set(repositories.columns):
        counted = repositories.select("full_name", F.col("stars_count").try_cast("double").alias("stars_count")).dropna()
        frames["top_repositories_by_github_stars"] = top_k(counted, "stars_count", 10, ["full_name"])
    if {"early_4week_stars", "later_stars", "became_high_growth"} <= set(herd.columns):
        means = group_means(herd, "became_high_growth", ["early_4week_stars", "later_stars"], 2, keep_null=False)
        frames["early_later_stars_by_class"] = means.toDF("became_high_growth", "early_4week_stars", "later_stars").orderBy("became_high_growth")
    return frames | {f"{n}_numeric_summary": describe_numeric(df) for n, df in tables.items() if numeric_columns(df)}


def distribution_lines(df: DataFrame, column: str) -> list[str]:
    """Minimum and maximum of a column, mean and median to two digits."""
    low, high, mean, median = few_rows(scalar_stats(df, column))[0]
    of = lambda x: "nan" if x is None else f"{x:.2f}"
    return [f"Minimum {column}: {low}", f"Maximum {column}: {high}", f"Mean {column}: {of(mean)}", f"Median {column}: {of(median)}"]


def profile_report(tables: dict[str, DataFrame], folder: str | None = None) -> str:
    """The profiling text; with ``folder`` also written there, with one CSV per profiling table."""
    repositories, stars = tables["repositories"], tables["stars"]
    frames = profile_frames(tables)
    sizes = {n: shape(df) for n, df in tables.items()}
    distinct = lambda df, c: df.agg(F.count_distinct(c)).first()[0]
    lines = ["Section 2 EDA Summary", "=" * 50, ""]
    lines += section("Dataset Shape Summary", [f"{n}: {r} rows, {c} columns" for n, (r, c) in sizes.items()])
    counts = {
        "repositories": distinct(repositories, "repo_id"),
        "star interactions": sizes["stars"][0],
        "unique users": distinct(stars, "user_id"),
        "recommendation interactions": sizes["user_repo_interactions"][0],
        "daily time-series rows": sizes["daily_timeseries"][0],
        "weekly time-series rows": sizes["weekly_timeseries"][0],
        "herd-modeling rows": sizes["herd_modeling"][0],
    }
    lines += section("Main Dataset Counts", [f"Number of {what}: {n}" for what, n in counts.items()])
    missing = few_rows(frames["missing_values_summary"].where("missing_count > 0"))
    lines += section("Missing Value Summary", [f"{t}.{c}: {n} missing values ({p}%)" for t, c, n, p in missing] or ["No missing values found."])
    pairs = {
        "Top 10 Programming Languages": ("top_languages", "{}: {}"),
        "Class Balance of became_high_growth": ("target_class_balance", "Class {}: {}"),
        "Top 10 Repositories by Collected Star Interactions": ("top_repositories_by_collected_interactions", "{}: {}"),
        "Top 10 Repositories by GitHub Star Count": ("top_repositories_by_github_stars", "{}: {:.0f}"),
    }
    for title, (frame, form) in pairs.items():
        if frame in frames:
            lines += section(title, [form.format(*r) for r in few_rows(frames[frame])])
    for column, title in (("stars_count", "Repository Star Count Distribution"), ("forks_count", "Repository Fork Count Distribution")):
        if column in repositories.columns:
            lines += section(title, distribution_lines(repositories, column))
    if "early_later_stars_by_class" in frames:
        lines += section("Average Early and Later Stars by Herd Class", [fixed_width(frames["early_later_stars_by_class"])])
    text = "\n".join(lines)
    if folder:
        write_text(text, os.path.join(folder, "eda_summary.txt"))
        for name, df in frames.items():
            write_csv(df, os.path.join(folder, name), one_file=True)
    return text


def cleaning_report(cleaned: dict[str, DataFrame]) -> str:
    lines = ["Section 2 Preprocessing Summary", "=" * 50, ""]
    lines += section("Generated Preprocessed Files", [f"{n}: {r} rows, {c} columns" for n, (r, c) in ((n, shape(df)) for n, df in cleaned.items())])
    totals = dict(few_rows(null_totals(cleaned)))
    lines += section("Missing values after preprocessing", [f"{n}: {totals[n]} total missing values after preprocessing" for n in cleaned])
    return "\n".join(lines)


def feature_report(features: dict[str, DataFrame], target: str = "became_high_growth") -> str:
    lines = ["Section 2 Feature Engineering Summary", "=" * 50, ""]
    lines += section("Generated Feature-Engineered Files", [f"{n}: {r} rows, {c} columns" for n, (r, c) in ((n, shape(df)) for n, df in features.items())])
    model = features["herd_model_ready"]
    classes = dict(few_rows(value_counts(model, target).orderBy(target)))
    lines += section(
        "Model-Ready Classification Dataset",
        [f"Target column: {target}", f"Number of predictors after preprocessing and encoding: {len(set(model.columns) - {'repo_id', target})}", f"Class distribution: {classes}"],
    )
    return "\n".join(lines)
