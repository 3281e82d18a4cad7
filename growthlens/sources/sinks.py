"""Tables, files and text reports out."""

from __future__ import annotations

import decimal
import os
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession


def replace_table(df: DataFrame, name: str, bucket_by: tuple[str, ...] = (), buckets: int = 64) -> None:
    """Create or replace a table. Bucketing by the join keys lets later joins on them go without shuffle."""
    writer = df.write.mode("overwrite")
    (writer.bucketBy(buckets, *bucket_by).sortBy(*bucket_by) if bucket_by else writer).saveAsTable(name)


def write_parquet(df: DataFrame, path: str, partition_by: Iterable[str] = ()) -> None:
    df.write.mode("overwrite").partitionBy(*partition_by).parquet(path)


#: Moments in text, to the microsecond.
MOMENT = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"


def write_csv(df: DataFrame, path: str, one_file: bool = False) -> None:
    """CSV with header; ``one_file`` is for results of a known small size. Empty texts and nulls are the same there."""
    writer = (df.coalesce(1) if one_file else df).write.mode("overwrite").options(timestampFormat=f"{MOMENT}XXX", timestampNTZFormat=MOMENT)
    writer.csv(path, header=True, escape='"', emptyValue="", nullValue="", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)


def few_rows(df: DataFrame, most: int = 10_000) -> list[tuple]:
    """The rows of a small result; over ``most`` are refused rather than cut."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"over {most} rows are no report")
    return [tuple(r) for r in rows]


def shown(value: object) -> str:
    if value is None:
        return "None"
    if isinstance(value, float):
        return f"{value:.6f}"
    if isinstance(value, decimal.Decimal):
        return f"{value:f}"
    return str(value)


def fixed_width(df: DataFrame) -> str:
    """A small result as text: columns right-aligned, one blank between, no row numbers."""
    rows = [[shown(v) for v in r] for r in few_rows(df)]
    if not rows:
        return "Empty DataFrame\nColumns: [" + ", ".join(df.columns) + "]\nIndex: []"
    widths = [max(len(x) for x in column) for column in zip(df.columns, *rows)]
    return "\n".join(" ".join(x.rjust(w) for x, w in zip(r, widths)) for r in [df.columns, *rows])


def write_text(text: str, path: str) -> None:
    """A text file, locally or, for paths with a scheme, on any file system that Spark writes."""
    if "://" in path:
        spark = SparkSession.active()
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        stream = place.getFileSystem(spark._jsc.hadoopConfiguration()).create(place, True)
        stream.write(bytearray(text.encode()))
        stream.close()
        return
    os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
    with open(path, "w", encoding="utf-8") as f:
        f.write(text)


def banner(title: str, body: str, width: int = 80) -> str:
    line = "=" * width
    return f"{line}\n{title}\n{line}\n{body}\n\n"


def shape(df: DataFrame) -> tuple[int, int]:
    """Rows and columns."""
    return df.count(), len(df.columns)
