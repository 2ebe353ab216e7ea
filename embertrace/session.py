"""Session settings and the shared scratch folder."""

from __future__ import annotations

import pathlib
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "embertrace", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators are written for.

    Sizes that depend on the cluster (memory, shuffle partitions) are left to the
    caller; adaptive execution coalesces and splits partitions at run time.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
        **{key.replace("__", "."): value for key, value in conf.items()},
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can reach, named by ``spark.checkpoint.dir``.

    Only a local-mode session may fall back to a temporary folder of this machine.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    context = spark.sparkContext
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    folder = tempfile.mkdtemp(prefix="embertrace-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new, unused path inside the shared folder."""
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Compute ``df`` once into the reliable checkpoint folder and read it from there."""
    spark = df.sparkSession
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(spark))
    return df.checkpoint(eager=True)


@contextmanager
def setting(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    """A session setting for the length of a block; a stream started inside keeps it."""
    before = spark.conf.get(key)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.set(key, before)


def spread(df: DataFrame) -> DataFrame:
    """Rows of a scan or a computed table over all cores, when it has fewer partitions than that.

    A small table in one file would keep all but one core idle in costly per-row work; a
    table of many partitions stays as it is.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


#: Costly work on a row is dealt out in tasks of about this many rows.
TASK_ROWS = 100_000


def even(table: DataFrame) -> DataFrame:
    """The rows of a stored table in tasks of about ``TASK_ROWS``, if its files come in larger parts.

    A scan is cut by bytes, and columns that pack well leave a few tasks with most of the rows.
    """
    rows = table.count()
    return table.repartition(-(-rows // TASK_ROWS)) if rows > TASK_ROWS * table.rdd.getNumPartitions() else table


def ship_package(spark: SparkSession) -> None:
    """Hand this package to the Python workers, once per Spark context."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    root = pathlib.Path(__file__).resolve().parent
    archive = shutil.make_archive(
        str(pathlib.Path(tempfile.mkdtemp(prefix="embertrace-py-")) / "embertrace_package"), "zip", root.parent, root.name
    )
    context.addPyFile(archive)
    _shipped.add(context.applicationId)


_shipped: set[str] = set()
