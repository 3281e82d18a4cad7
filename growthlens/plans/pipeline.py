"""The whole run: import, report, profile, clean, features; each stage named, the first failure ends it."""

from __future__ import annotations

import os
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from growthlens.operators.clean import clean_all
from growthlens.operators.features import add_topic_flags, herd_features, model_ready, recommendation_features, weekly_features
from growthlens.plans import reports
from growthlens.sources.contracts import TABLES
from growthlens.sources.readers import import_tables, read_tables
from growthlens.sources.sinks import write_csv, write_parquet, write_text


def build_features(cleaned: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """The five feature tables from the cleaned ones."""
    herd = herd_features(cleaned["herd_modeling"])
    return {
        "repositories_feature_engineered": add_topic_flags(cleaned["repositories"]),
        "weekly_timeseries_features": weekly_features(cleaned["weekly_timeseries"]),
        "recommendation_features": recommendation_features(cleaned["user_repo_interactions"], cleaned["repositories"]),
        "herd_features_unscaled": herd,
        "herd_model_ready": model_ready(herd),
    }


@dataclass
class Pipeline:
    """Stages hand typed tables on in one session; files are outputs, no stage reads another's text files.

    ``source`` holds the raw CSV files or, with ``kind="parquet"``, the tables. Outputs are Parquet under
    ``target``, with ``csv`` also as CSV, and text reports.
    """

    spark: SparkSession
    source: str
    target: str
    kind: str = "csv"
    csv: bool = False
    on_missing: str = "error"
    tables: dict[str, DataFrame] = field(default_factory=dict)
    cleaned: dict[str, DataFrame] = field(default_factory=dict)
    done: list[str] = field(default_factory=list)

    def save(self, frames: dict[str, DataFrame], stage: str) -> dict[str, DataFrame]:
        """Write a stage's tables and go on with what was written, so that later stages do not compute it again."""
        for name, df in frames.items():
            write_parquet(df, f"{self.target}/{stage}/{name}")
            if self.csv:
                write_csv(df, f"{self.target}/{stage}_csv/{name}")
        return {name: self.spark.read.parquet(f"{self.target}/{stage}/{name}") for name in frames}

    def text(self, name: str, body: str) -> None:
        write_text(body, os.path.join(self.target, "reports", name))

    def load(self) -> None:
        if self.kind == "csv":
            found = import_tables(self.spark, self.source, self.on_missing)
        else:
            found = read_tables(self.spark, self.source, TABLES)
        self.tables = self.save(found, "interim")
        for name, df in self.tables.items():
            df.createOrReplaceTempView(name)

    def report(self) -> None:
        reports.run_report(self.spark, os.path.join(self.target, "reports", "sql_query_outputs.txt"))

    def summarise(self) -> None:
        self.text("load_data_summary.txt", reports.load_summary(self.tables))

    def profile(self) -> None:
        reports.profile_report(self.tables, os.path.join(self.target, "reports"))

    def clean(self) -> None:
        self.cleaned = self.save(clean_all(self.tables), "processed")
        self.text("preprocessing_summary.txt", reports.cleaning_report(self.cleaned))

    def features(self) -> None:
        made = self.save(build_features(self.cleaned), "features")
        self.text("feature_engineering_summary.txt", reports.feature_report(made))

    def run(self, say: Callable[[str], None] = print) -> list[str]:
        """Run all stages in order; an exception ends the run at its stage."""
        for stage in (self.load, self.report, self.summarise, self.profile, self.clean, self.features):
            say(f"=== {stage.__name__} ===")
            stage()
            self.done.append(stage.__name__)
        return self.done
