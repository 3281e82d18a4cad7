"""Session factory and the shared folder for checkpoints."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import zipfile
from collections.abc import Iterable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def get_session(app: str = "growthlens", master: str | None = None, **conf: str) -> SparkSession:
    """A session with UTC time and AQE. ANSI mode stays on: expressions use try_ functions.

    ``conf`` keys may use ``__`` for dots. ``master`` is left to spark-submit when None.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in (DEFAULTS | {k.replace("__", "."): v for k, v in conf.items()}).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, from spark.checkpoint.dir.

    Only with a local master may that be unset: then a temporary folder is made and set.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="growthlens-")
        spark.conf.set("spark.checkpoint.dir", found)
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(found)
    return found


#: Places of the stored frames that have not been dropped, and their sessions.
_stored: dict[str, SparkSession] = {}


def place(spark: SparkSession) -> str:
    """A new path in the shared folder, dropped with the stored frames."""
    path = f"{shared_dir(spark)}/growthlens-{uuid.uuid4().hex}"
    _stored[path] = spark
    return path


def stored(df: DataFrame, partitions_by: tuple[str, ...] = ()) -> DataFrame:
    """The frame, written once as a table in the shared folder and read from there.

    Cuts the lineage for frames that are used several times: a lost executor costs a read, not a
    computation. The files stay until ``drop_stored``, the end of a ``scratch`` block, or the end of the driver's process.
    """
    spark = df.sparkSession
    path = place(spark)
    df.write.partitionBy(*partitions_by).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_stored(paths: Iterable[str] | None = None) -> None:
    """Delete the files of stored frames: those at the paths, or all. Frames that read them are of no use afterwards."""
    for path in list(_stored if paths is None else paths):
        _forget(_stored.pop(path), path)


@contextmanager
def scratch() -> Iterator[None]:
    """What is stored within the block is deleted at its end, so a query's action belongs into the block too."""
    before = set(_stored)
    try:
        yield
    finally:
        drop_stored([p for p in _stored if p not in before])


atexit.register(drop_stored)


def _forget(spark: SparkSession, path: str) -> None:
    try:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # the session may have ended before
        if path.startswith("file:"):
            shutil.rmtree(path.removeprefix("file://").removeprefix("file:"), ignore_errors=True)


def ship(spark: SparkSession) -> SparkSession:
    """Make this package importable in the Python workers, once per context, wherever they run.

    Operators with Python parts call it: the driver may have found the package by a path of its own.
    """
    context = spark.sparkContext
    if not getattr(context, "_growthlens_shipped", False):
        root = os.path.dirname(os.path.abspath(__file__))
        archive = os.path.join(tempfile.mkdtemp(prefix="growthlens-"), "growthlens_package.zip")
        with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
            for folder, _, files in os.walk(root):
                for name in (f for f in files if f.endswith(".py")):
                    path = os.path.join(folder, name)
                    z.write(path, os.path.join("growthlens", os.path.relpath(path, root)))
        context.addPyFile(archive)
        context._growthlens_shipped = True
    return spark
