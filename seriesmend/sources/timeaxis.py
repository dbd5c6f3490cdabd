"""Turn any column into the time axis: ``ts`` (microseconds, no zone) and epoch seconds."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F, types as T

from seriesmend.model import named
from seriesmend.sources.tables import TEMPORAL_TYPES

# Accepted text layouts, tried in this order; text in none of them has no time.
ISO_FORMATS = (
    "yyyy-MM-dd HH:mm:ss[.SSSSSSSSS][XXX]",
    "yyyy-MM-dd'T'HH:mm:ss[.SSSSSSSSS][XXX]",
    "yyyy-MM-dd HH:mm[XXX]",
    "yyyy-MM-dd'T'HH:mm[XXX]",
    "yyyy-MM-dd",
    "yyyy/MM/dd HH:mm[:ss]",
    "yyyy/MM/dd",
    "yyyyMMdd",
)
CLOCKS = (" HH:mm:ss", " HH:mm", "")
DAY_FIRST = tuple(f"dd{s}MM{s}yyyy{clock}" for s in "/-." for clock in CLOCKS)
MONTH_FIRST = tuple(f"MM{s}dd{s}yyyy{clock}" for s in "/-" for clock in CLOCKS)
TIME_FORMATS = (*ISO_FORMATS, *DAY_FIRST)

# Seconds that a timestamp of microseconds in 64 bits can hold.
LARGEST_EPOCH = 9.2e12


def parse_time_text(text: Column, formats: tuple[str, ...] = TIME_FORMATS) -> Column:
    tries = [F.try_to_timestamp(text, F.lit(f)) for f in formats]
    return reduce(lambda a, b: F.coalesce(a, b), tries).cast("timestamp_ntz")


def time_axis(column: Column, dtype: T.DataType, formats=TIME_FORMATS) -> Column:
    """Temporal columns are cast, text is parsed, numbers are Unix epoch seconds."""
    if isinstance(dtype, TEMPORAL_TYPES):
        return column.cast("timestamp_ntz")
    if isinstance(dtype, (T.StringType, T.VarcharType, T.CharType)):
        return parse_time_text(column, formats)
    if not isinstance(dtype, (T.NumericType, T.BooleanType)):
        return F.lit(None).cast("timestamp_ntz")
    seconds = column.cast("double")
    micros = F.when(F.abs(seconds) < LARGEST_EPOCH, seconds * 1e6).cast("bigint")
    return F.timestamp_micros(micros).cast("timestamp_ntz")


def formats_for(df: DataFrame, column: str) -> tuple[str, ...]:
    """The layouts to read a text column by: day first, unless more of its texts are
    dates with the month first.  One aggregate; the choice holds for the whole column.
    """
    if not isinstance(df.schema[column].dataType, (T.StringType, T.VarcharType, T.CharType)):
        return TIME_FORMATS
    hits = df.agg(*[
        F.count(parse_time_text(named(column), formats)).alias(name)
        for name, formats in (("day", DAY_FIRST), ("month", MONTH_FIRST))
    ]).first()
    return TIME_FORMATS if hits["day"] >= hits["month"] else (*ISO_FORMATS, *MONTH_FIRST)


def unread_times(df: DataFrame, column: str, formats: tuple[str, ...] = TIME_FORMATS) -> Column:
    """How many texts of a column are not empty, and yet no time (an aggregate)."""
    text = F.trim(named(column).cast("string"))
    return F.count_if((text != "") & time_axis(named(column), df.schema[column].dataType, formats).isNull())


def epoch_micros(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp"))


def epoch_seconds(ts: Column) -> Column:
    return epoch_micros(ts) / F.lit(1e6)


def with_time_axis(
    df: DataFrame,
    time_column: str,
    name: str = "ts",
    epoch_name: str = "x_epoch",
    formats=TIME_FORMATS,
) -> DataFrame:
    """Add the parsed time ``name`` and its epoch seconds; the session zone must be UTC."""
    ts = time_axis(named(time_column), df.schema[time_column].dataType, formats)
    return df.withColumn(name, ts).withColumn(epoch_name, epoch_seconds(F.col(name)))
