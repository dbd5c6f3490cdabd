"""Open csv and parquet tables and name their columns."""

from __future__ import annotations

from pathlib import PurePosixPath

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

# Column names taken as the time axis, in order of preference.
TIME_COLUMN_NAMES = (
    "TIMESTAMP_LOCAL",
    "TIMESTAMP",
    "DATETIME",
    "DATE_TIME",
    "DATE",
    "TIME",
)

TEMPORAL_TYPES = (T.TimestampType, T.TimestampNTZType, T.DateType)


def table_format(path: str) -> str:
    suffix = PurePosixPath(str(path).rstrip("/")).suffix.lower()
    if suffix not in (".parquet", ".csv"):
        raise ValueError(f"tables are read from .parquet and .csv, not {suffix or 'without a suffix'}")
    return suffix[1:]


def table_name(path: str) -> str:
    return PurePosixPath(str(path).rstrip("/")).stem


def read_table(
    spark: SparkSession,
    path: str,
    schema: T.StructType | None = None,
    infer: bool = True,
) -> DataFrame:
    """Scan a parquet or csv table by its suffix.

    Give csv a ``schema`` at scale: inference (numbers, dates, times) reads the
    file once more.  Without either every csv column is text.
    """
    fmt = table_format(path)
    if fmt == "parquet":
        return spark.read.parquet(str(path))
    reader = spark.read.option("header", True)
    if schema is not None:
        return reader.schema(schema).csv(str(path))
    return reader.options(inferSchema=infer, preferDate=True).csv(str(path))


def find_time_column(schema: T.StructType) -> str:
    """A known name (any case), else the first temporal column, else the first."""
    by_name = {f.name.lower(): f.name for f in schema.fields}
    for known in TIME_COLUMN_NAMES:
        if known.lower() in by_name:
            return by_name[known.lower()]
    temporal = [f.name for f in schema.fields if isinstance(f.dataType, TEMPORAL_TYPES)]
    return temporal[0] if temporal else schema.fields[0].name


def variable_names(df: DataFrame, time_column: str) -> list[str]:
    return [c for c in df.columns if c != time_column]


def table_summary(df: DataFrame, time_column: str) -> DataFrame:
    """One row: number of rows and of variables."""
    return df.agg(F.count(F.lit(1)).alias("rows")).withColumn(
        "variables", F.lit(len(variable_names(df, time_column)))
    )
