"""Annotation tables: instants and periods that apply to one table or to all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from seriesmend.sources.tables import TEMPORAL_TYPES, read_table
from seriesmend.sources.timeaxis import parse_time_text
from seriesmend.sources.timeshapes import TimeShapes, shapes_of, time_by_shapes

EVERY_TABLE = "*"

# columns that put loaded annotations into file order, also when a file is read in parts
FILE_ORDER = ("event_file", "event_block", "event_no")


def annotation_time(df: DataFrame, name: str) -> Column:
    """Temporal columns are cast; everything else is read as text, numbers too."""
    if isinstance(df.schema[name].dataType, TEMPORAL_TYPES):
        return F.col(name).cast("timestamp_ntz")
    return parse_time_text(F.col(name).cast("string"))


def annotation_shapes(df: DataFrame) -> TimeShapes:
    """The order of numeric dates in an annotation table, decided on all starts and ends."""
    return shapes_of(df, *[c for c in ("start", "end") if c in df.columns])


def unread_annotation_times(df: DataFrame) -> int:
    """Starts and ends of a normalized table that hold a text and yet no time."""
    counts = [
        F.count_if((F.trim(F.col(c).cast("string")) != "") & F.col(f"{c}_dt").isNull())
        for c in ("start", "end") if c in df.columns
    ]
    return sum(df.agg(*counts).first()) if counts else 0


def normalize_annotations(df: DataFrame, shapes: TimeShapes | None = None) -> DataFrame:
    """Add ``start_dt``, ``end_dt`` and ``is_punctual`` (no end, or end = start).

    ``shapes`` (see ``annotation_shapes``) is how dates in texts are read; without it, ISO
    layouts and those with the day first.
    """
    if "start" not in df.columns:
        raise ValueError("an annotation table needs a column start")
    read = annotation_time if shapes is None else lambda df, name: time_by_shapes(df, name, shapes)
    end = read(df, "end") if "end" in df.columns else F.lit(None).cast("timestamp_ntz")
    timed = df.withColumn("start_dt", read(df, "start")).withColumn("end_dt", end)
    return timed.withColumn(
        "is_punctual", F.col("end_dt").isNull() | (F.col("end_dt") == F.col("start_dt"))
    )


def load_annotations(spark: SparkSession, path: str) -> DataFrame:
    """Read and normalize; ``FILE_ORDER`` columns keep the order of the file.

    The layout of its times is found from all of them.  ``event_no`` orders the rows of a
    part of a file and is no lasting identity: another split of the file numbers anew.
    """
    read = read_table(spark, path, infer=False)
    placed = read.select(
        "*",
        F.col("_metadata.file_path").alias("event_file"),
        F.col("_metadata.file_block_start").alias("event_block"),
        F.monotonically_increasing_id().alias("event_no"),
    )
    return normalize_annotations(placed, annotation_shapes(read))


def annotations_for_table(df: DataFrame, table: str) -> DataFrame:
    """Annotations for ``table`` or for every table; all if there is no such column."""
    if "table" not in df.columns:
        return df
    return df.filter(F.col("table").isin(EVERY_TABLE, table))


def annotation_geometry(df: DataFrame) -> DataFrame:
    """Drop annotations without a start; ``lo`` / ``hi`` bounds, texts never NULL."""
    instant = F.coalesce(F.col("is_punctual"), F.lit(False)) | F.col("end_dt").isNull()
    texts = {
        name: F.coalesce(F.col(name), F.lit("")) if name in df.columns else F.lit("")
        for name in ("label", "category", "description")
    }
    drawn = df.filter(F.col("start_dt").isNotNull())
    return drawn.withColumns(
        {
            "shape": F.when(instant, "instant").otherwise("period"),
            "lo": F.when(instant, F.col("start_dt")).otherwise(F.least("start_dt", "end_dt")),
            "hi": F.when(instant, F.col("start_dt")).otherwise(F.greatest("start_dt", "end_dt")),
            **texts,
        }
    )


def annotation_text(label: Column, category: Column, description: Column) -> Column:
    """``label  [category]`` and the description on a second line, where given."""
    return F.concat(
        label,
        F.when(category != "", F.concat(F.lit("  ["), category, F.lit("]"))).otherwise(""),
        F.when(description != "", F.concat(F.lit("\n"), description)).otherwise(""),
    )
