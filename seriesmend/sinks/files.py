"""Where outputs go and how they replace older ones."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

# What each save mode adds to the name of the source table.
SUFFIXES = {"diff": "_corrected", "series": "_corrected_serie", "full": "_corrected_full"}
FORMATS = ("parquet", "csv")


def output_path(source: str, mode: str, fmt: str = "parquet", folder: str | None = None) -> str:
    """``<folder>/<stem><suffix>.<fmt>``; the folder is the source's, which is never
    written itself, unless another one is given."""
    if mode not in SUFFIXES:
        raise ValueError(f"no such way to save: {mode}; there are {', '.join(SUFFIXES)}")
    if fmt not in FORMATS:
        raise ValueError(f"outputs are written as {' or '.join(FORMATS)}, not as {fmt}")
    own, slash, name = str(source).rstrip("/").rpartition("/")
    stem = name.rpartition(".")[0] or name
    if folder is not None:
        own, slash = folder.rstrip("/"), "/"
    return f"{own}{slash}{stem}{SUFFIXES[mode]}.{fmt}"


def _file_system(spark: SparkSession, path: str):
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop_path, hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration())


def qualified(spark: SparkSession, path: str) -> str:
    """The path as the readers report it: with its file system, percent-encoded."""
    hadoop_path, fs = _file_system(spark, path)
    return fs.makeQualified(hadoop_path).toUri().toString()


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether there is an output; one that a broken swap set aside is put back first."""
    target, fs = _file_system(spark, path)
    if fs.exists(target):
        return True
    aside = fs.globStatus(_file_system(spark, f"{path}.replaced-*")[0]) or []
    if not len(aside):
        return False
    newest = max(aside, key=lambda status: status.getModificationTime())
    return fs.rename(newest.getPath(), target)


def write_output(df: DataFrame, path: str, fmt: str = "parquet") -> str:
    """Write beside ``path``, then swap.

    The output may have been a source of ``df``, so it stays until the new one is
    complete.  The swap is two renames: between them there is no output at ``path``,
    and a driver that is lost just then leaves the old one as ``.replaced-*``, which
    the next ``path_exists`` or ``write_output`` puts back.
    """
    if fmt not in FORMATS:
        raise ValueError(f"outputs are written as {' or '.join(FORMATS)}, not as {fmt}")
    spark = df.sparkSession
    tag = uuid.uuid4().hex
    fresh = f"{path}.writing-{tag}"
    if fmt == "parquet":
        df.write.parquet(fresh)
    else:
        df.write.csv(fresh, header=True)
    target, fs = _file_system(spark, path)
    written, _ = _file_system(spark, fresh)
    old, _ = _file_system(spark, f"{path}.replaced-{tag}")
    replacing = path_exists(spark, path)
    if replacing and not fs.rename(target, old):
        raise OSError(f"could not set the previous output aside: {path}")
    if not fs.rename(written, target):
        if replacing:
            fs.rename(old, target)
        raise OSError(f"could not put the new output in place: {path}")
    if replacing:
        fs.delete(old, True)
    return path
