"""Cut lineage by writing a table to the cluster's shared folder."""

from __future__ import annotations

import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir`` (or set on the context).

    Only a local session (as in tests) may fall back to a temporary folder; on a
    cluster such a folder would be lost with its machine, so that is an error.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    configured = configured or spark.sparkContext.getCheckpointDir()
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    folder = tempfile.mkdtemp(prefix="seriesmend-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


# Staged tables hold whole texts and rows of few columns alike: a task buffers one row group.
ROW_GROUP_BYTES = 32 << 20
# Set while a table is staged: its shuffle files go when it is written, not at some later collection.
FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

# folders written by this process and not dropped yet
_written: list[str] = []
# where tables are staged at present, innermost last; else in the shared folder
_homes: list[str] = []


@contextlib.contextmanager
def staged_in(folder: str):
    """Stage tables under a folder that somebody else deletes."""
    _homes.append(folder)
    try:
        yield
    finally:
        _homes.pop()


def stage(df: DataFrame, folder: str | None = None) -> DataFrame:
    """Write ``df`` once and read it back, so that later jobs see fixed rows.

    The table belongs to the ``staging_scope`` around the call; without one, it stays
    until ``drop_staged``.
    """
    spark = df.sparkSession
    home = folder or (_homes[-1] if _homes else shared_folder(spark))
    path = f"{home}/stage-{uuid.uuid4().hex}"
    _written.append(path)
    before = spark.conf.get(FREE_SHUFFLES, None)
    spark.conf.set(FREE_SHUFFLES, "true")
    try:
        df.write.option("parquet.block.size", ROW_GROUP_BYTES).parquet(path)
    finally:
        if before is None:
            spark.conf.unset(FREE_SHUFFLES)
        else:
            spark.conf.set(FREE_SHUFFLES, before)
    return spark.read.schema(df.schema).parquet(path)


def delete_folder(spark: SparkSession, path: str) -> None:
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop_path, True)


def staged_tables() -> int:
    """How many tables this process has staged and not dropped."""
    return len(_written)


def drop_staged(spark: SparkSession, since: int = 0, until: int | None = None) -> None:
    """Delete what this process has staged; frames that still read it are then void."""
    for path in _written[since:until]:
        delete_folder(spark, path)
    del _written[since:until]


@contextlib.contextmanager
def staging_scope(spark: SparkSession):
    """Own what is staged inside: write the results before the end, it is deleted there."""
    since = len(_written)
    try:
        yield
    finally:
        drop_staged(spark, since)
