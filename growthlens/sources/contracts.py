"""The six tables: columns, keys and the files they are read from."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql.types import StructType


@dataclass(frozen=True)
class TableSpec:
    name: str
    file: str
    ddl: str
    key: tuple[str, ...]

    @property
    def schema(self) -> StructType:
        return StructType.fromDDL(self.ddl)


TABLES = {
    t.name: t
    for t in (
        TableSpec(
            "repositories",
            "repositories_enriched.csv",
            "repo_id bigint, full_name string, owner string, owner_id bigint, repo_name string, description string, language string, topics string, "
            "stars_count bigint, forks_count bigint, watchers_count bigint, subscribers_count bigint, network_count bigint, open_issues_count bigint, size bigint, "
            "created_at timestamp, updated_at timestamp, pushed_at timestamp, default_branch string, archived boolean, disabled boolean, is_fork boolean, "
            "has_issues boolean, has_projects boolean, has_downloads boolean, has_wiki boolean, license string, html_url string, homepage string, "
            "collected_at timestamp",
            ("repo_id",),
        ),
        TableSpec(
            "stars",
            "stars_raw.csv",
            "repo_id bigint, repo_full_name string, user_id bigint, username string, user_type string, starred_at timestamp, collected_at timestamp",
            ("repo_id", "user_id"),
        ),
        TableSpec(
            "user_repo_interactions",
            "user_repo_interactions.csv",
            "user_id bigint, username string, repo_id bigint, repo_full_name string, starred_at timestamp, interaction bigint",
            ("user_id", "repo_id"),
        ),
        TableSpec(
            "daily_timeseries",
            "repo_star_daily_timeseries.csv",
            "repo_id bigint, repo_full_name string, date date, daily_new_stars bigint, cumulative_stars bigint, daily_growth_rate double",
            ("repo_id", "date"),
        ),
        TableSpec(
            "weekly_timeseries",
            "repo_star_weekly_timeseries.csv",
            "repo_id bigint, repo_full_name string, week string, weekly_new_stars bigint, cumulative_stars bigint, previous_week_stars bigint, "
            "weekly_growth_rate double, herd_momentum_score double",
            ("repo_id", "week"),
        ),
        TableSpec(
            "herd_modeling",
            "repo_herd_modeling_table.csv",
            "repo_id bigint, repo_full_name string, early_4week_stars bigint, early_avg_weekly_stars double, early_max_weekly_stars bigint, later_stars bigint, "
            "later_avg_weekly_stars double, became_high_growth bigint, language string, topics string, stars_count bigint, forks_count bigint, "
            "watchers_count bigint, open_issues_count bigint, created_at timestamp, updated_at timestamp, pushed_at timestamp, archived boolean, is_fork boolean, "
            "license string, html_url string",
            ("repo_id",),
        ),
    )
}


def key_violations(spec: TableSpec) -> str:
    """SQL that lists the keys of a registered table that are null or occur more than once (keys are expected, not enforced)."""
    keys = ", ".join(spec.key)
    return f"SELECT {keys}, count(*) AS n_rows FROM {spec.name} GROUP BY {keys} HAVING count(*) > 1 OR {' OR '.join(f'{k} IS NULL' for k in spec.key)}"
