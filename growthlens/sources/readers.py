"""Delimited files, tables and SQL as DataFrames."""

from __future__ import annotations

import warnings
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from growthlens.functions.values import drop_na_tokens, to_number
from growthlens.sources.contracts import TABLES, TableSpec

TRUE_TEXTS, FALSE_TEXTS = ("true", "1", "1.0"), ("false", "0", "0.0")


def exists(spark: SparkSession, path: str) -> bool:
    """Whether anything lies at a path of any file system that Spark reads."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop)


def read_csv(spark: SparkSession, path: str, schema: T.StructType | None = None, multi_line: bool = True) -> DataFrame:
    """A delimited file with header, quoted line breaks and doubled quotes.

    All columns are read as text, texts that stand for no value become null, then columns get the
    types of ``schema`` by name, row by row: what cannot be read is null. Flags become 0 or 1, as
    they are after a hop through a database without booleans. Columns that the schema does not
    name stay text; columns missing in the file are not made up. Without schema all stay text.

    Values with line breaks make a file one task: keep files small (many files are read in parallel), or
    pass ``multi_line=False`` for data without line breaks in values, whose files are split.
    """
    raw = spark.read.csv(path, header=True, multiLine=multi_line, escape='"', inferSchema=False)
    types = {f.name: f.dataType for f in schema.fields} if schema else {}
    return raw.select(*(_typed(drop_na_tokens(F.col(f"`{c}`")), types.get(c)).alias(c) for c in raw.columns))


def _typed(text, kind: T.DataType | None):
    if kind is None or isinstance(kind, T.StringType):
        return text
    if isinstance(kind, T.BooleanType):
        lowered = F.lower(F.trim(text))
        return F.when(lowered.isin(*TRUE_TEXTS), 1).when(lowered.isin(*FALSE_TEXTS), 0).cast("int")
    if isinstance(kind, T.IntegralType):
        return F.coalesce(text.try_cast(kind), to_number(text).try_cast(kind))  # 3.0 is a whole number too
    if isinstance(kind, T.DateType):
        return F.try_to_timestamp(text).cast("date")
    if isinstance(kind, T.TimestampType):
        return F.try_to_timestamp(text)
    return text.try_cast(kind)


def import_tables(
    spark: SparkSession, folder: str, on_missing: str = "error", tables: Iterable[str] | None = None, save: bool = False, keep_flags: bool = False
) -> dict[str, DataFrame]:
    """The known files of a folder as temporary views (or, with ``save``, as tables that replace older ones).

    Other files are ignored. A missing file raises FileNotFoundError before anything is read, or with
    ``on_missing="skip"`` is reported and left out.
    """
    if on_missing not in ("error", "skip"):
        raise ValueError("on_missing is error or skip")
    specs = [TABLES[n] for n in tables or TABLES]
    missing = [s for s in specs if not exists(spark, f"{folder}/{s.file}")]
    if missing and on_missing == "error":
        raise FileNotFoundError(f"missing file: {folder}/{missing[0].file}")
    for s in missing:
        warnings.warn(f"{s.file} not found in {folder}; skipped", stacklevel=2)
    found = {s.name: read_csv(spark, f"{folder}/{s.file}", s.schema) for s in specs if s not in missing}
    for name, df in found.items():
        if save:
            df.write.mode("overwrite").saveAsTable(name)
        else:
            df.createOrReplaceTempView(name)
    return {name: spark.table(name) for name in found} if save else found


def read_tables(spark: SparkSession, folder: str, tables: Iterable[str] | None = None) -> dict[str, DataFrame]:
    """The tables from Parquet, registered as temporary views."""
    found = {n: spark.read.parquet(f"{folder}/{n}.parquet") for n in tables or TABLES}
    for name, df in found.items():
        df.createOrReplaceTempView(name)
    return found


def read_jdbc(spark: SparkSession, url: str, spec: TableSpec, partition: str | None = None, **options: str) -> DataFrame:
    """A table of a database. With a numeric ``partition`` column and lowerBound, upperBound and numPartitions, in parallel."""
    reader = spark.read.format("jdbc").option("url", url).option("dbtable", spec.name).options(**options)
    return (reader.option("partitionColumn", partition) if partition else reader).load()


def run_sql(spark: SparkSession, query: str) -> DataFrame:
    """Any query over the registered tables; a closing semicolon may stay."""
    return spark.sql(query.strip().rstrip(";"))


def read_processed(spark: SparkSession, path: str) -> DataFrame:
    """A stage's CSV output read again: types inferred, no-value texts null, moments as text."""
    raw = read_csv(spark, path)
    probe = spark.read.csv(path, header=True, multiLine=True, escape='"', inferSchema=True, nullValue="NA")
    kinds = {f.name: f.dataType for f in probe.schema.fields if isinstance(f.dataType, T.NumericType)}
    return raw.select(*(F.col(f"`{c}`").try_cast(kinds[c]).alias(c) if c in kinds else F.col(f"`{c}`") for c in raw.columns))
