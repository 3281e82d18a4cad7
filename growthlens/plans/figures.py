"""The plot-ready data of the report's figures; drawing them is optional."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from growthlens.functions.dates import parse_week_start
from growthlens.functions.values import to_number
from growthlens.operators.profile import histogram, leaders_series
from growthlens.plans.reports import profile_frames


@dataclass(frozen=True)
class Figure:
    """kind is barh, bar, hist or line; x and y name columns of data, series the column that tells lines apart."""

    kind: str
    title: str
    data: DataFrame
    x: str
    y: str
    series: str | None = None


def figures(tables: dict[str, DataFrame]) -> dict[str, Figure]:
    """The eight figures by file name. All data are small aggregates but the five series of weeks."""
    frames = profile_frames(tables)
    weekly = tables["weekly_timeseries"].withColumns({"week_start": parse_week_start(F.col("week")), "weekly_new_stars": to_number(F.col("weekly_new_stars"))})
    label = "repo_full_name" if "repo_full_name" in weekly.columns else "repo_id"
    bars = lambda frame, x, y, title: Figure("barh", title, frames[frame].orderBy(F.col(y)), x, y)
    return {
        "top_languages": bars("top_languages", "language", "repo_count", "Top 10 Programming Languages"),
        "stars_count_distribution": Figure("hist", "Distribution of Repository GitHub Star Counts", histogram(tables["repositories"], "stars_count"), "low", "n"),
        "forks_count_distribution": Figure("hist", "Distribution of Repository Fork Counts", histogram(tables["repositories"], "forks_count"), "low", "n"),
        "target_class_balance": Figure("bar", "Class Balance of Herd-Behavior Target", frames["target_class_balance"], "became_high_growth", "repo_count"),
        "top_repositories_by_collected_interactions": bars("top_repositories_by_collected_interactions", "repo_full_name", "collected_star_interactions", "Top 10 Repositories by Collected Star Interactions"),
        "top_repositories_by_github_stars": bars("top_repositories_by_github_stars", "full_name", "stars_count", "Top 10 Repositories by GitHub Star Count"),
        "weekly_growth_top_repositories": Figure("line", "Weekly Star Growth for Top 5 Repositories", leaders_series(weekly, label, "week_start", "weekly_new_stars").orderBy(label, "week_start"), "week_start", "weekly_new_stars", label),
        "early_later_stars_by_class": Figure("bar", "Average Early and Later Stars by Herd Class", frames["early_later_stars_by_class"], "became_high_growth", "early_4week_stars"),
    }


def draw(figure: Figure, path: str, dpi: int = 300) -> bool:
    """Draw a figure to a file, if matplotlib is installed; tells whether it was."""
    try:
        import matplotlib

        matplotlib.use("Agg")
        import matplotlib.pyplot as plt
    except ImportError:
        return False
    rows = figure.data.toPandas()
    fig, ax = plt.subplots(figsize=(10, 6))
    if figure.kind == "line":
        for name, part in rows.groupby(figure.series):
            ax.plot(part[figure.x], part[figure.y], label=str(name))
        ax.legend(fontsize=8)
    elif figure.kind == "barh":
        ax.barh(rows[figure.x].astype(str), rows[figure.y])
    elif figure.kind == "hist":
        ax.bar(rows[figure.x], rows[figure.y], width=rows["high"] - rows["low"], align="edge")
    else:
        for i, column in enumerate(c for c in rows.columns if c != figure.x):
            ax.bar(rows[figure.x].astype(float) + 0.4 * i, rows[column], width=0.4, label=column)
    ax.set(title=figure.title, xlabel=figure.x, ylabel=figure.y)
    fig.tight_layout()
    fig.savefig(path, dpi=dpi)
    plt.close(fig)
    return True
