"""python -m growthlens SOURCE TARGET [--parquet] [--csv] [--skip-missing]: the whole run.

"""

from __future__ import annotations

import argparse

from growthlens.plans.pipeline import Pipeline
from growthlens.session import get_session


def main(args: list[str] | None = None) -> list[str]:
    p = argparse.ArgumentParser(prog="growthlens", description="Import, report, profile, clean and build features.")
    p.add_argument("source", help="folder of the raw CSV files, or of the Parquet tables")
    p.add_argument("target", help="folder for tables and reports")
    p.add_argument("--parquet", action="store_true", help="the source holds Parquet tables")
    p.add_argument("--csv", action="store_true", help="write CSV copies of all tables too")
    p.add_argument("--skip-missing", action="store_true", help="report missing files and go on")
    p.add_argument("--master", help="Spark master, unless spark-submit sets it")
    a = p.parse_args(args)
    spark = get_session("growthlens", a.master)
    return Pipeline(spark, a.source, a.target, "parquet" if a.parquet else "csv", a.csv, "skip" if a.skip_missing else "error").run()


if __name__ == "__main__":
    main()
