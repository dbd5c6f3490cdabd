"""Zooming into long series: a pyramid of lowest and highest readings.

Level 0 has the two peaks of every fixed time bucket of a series, each level above those
of ``fan`` buckets of the one below, up to a level with few buckets a series.  All are
written once, in order of series and bucket, so that a view reads the buckets it shows of
one level, whatever lies under them.  A level is made from the one below it, so the
readings are read once and all levels above the first cost a ``fan``-th part of it.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from seriesmend.model import SeriesSpec
from seriesmend.operators.view import SHOWN_POINTS
from seriesmend.plans.staging import stage
from seriesmend.sources.timeaxis import epoch_seconds

FAN = 16
TOP_BUCKETS = 16   # at most, in the highest level of a series


def level_for(x0: float, x1: float, points: int, base_seconds: float, fan: int = FAN) -> int:
    """The finest level that shows a range (epoch seconds) in at most ``points`` buckets,
    not counting those that the range only begins or ends in."""
    level = 0
    while (x1 - x0) / (base_seconds * fan**level) > points:
        level += 1
    return level


@dataclass(frozen=True)
class PeakPyramid:
    """The written levels: series keys, ``bucket``, ``n`` readings, ``low`` and ``high`` rows."""

    spec: SeriesSpec
    base_seconds: float
    levels: tuple[DataFrame, ...]
    fan: int = FAN

    @classmethod
    def build(
        cls, df: DataFrame, spec: SeriesSpec, x: str, base_seconds: float, value: str | None = None,
        fan: int = FAN, folder: str | None = None,
    ) -> "PeakPyramid":
        """From readings with a time ``x``; missing readings and rows without a time are left out.

        Of equal peaks the first in series order counts, as in ``downsample_peak``.
        """
        if base_seconds <= 0 or fan < 2:
            raise ValueError("a pyramid needs positive buckets and a fan of 2 at least")
        y = F.col(value or spec.value).cast("double")
        place = [F.col(c) for c in (*spec.order_by, *spec.tiebreak)]
        row = F.struct(*place, y.alias("y"))
        present = df.filter(y.isNotNull() & ~F.isnan(y) & F.col(x).isNotNull())
        bucket = F.floor(epoch_seconds(F.col(x)) / F.lit(float(base_seconds)))
        readings = present.select(*spec.keys, bucket.alias("bucket"), F.lit(1).alias("n"), row.alias("low"), row.alias("high"))
        levels = [_written(_peaks(readings, spec), spec, folder)]
        while True:
            ends = levels[-1].agg(F.min("bucket").alias("first"), F.max("bucket").alias("last")).first()
            if ends["first"] is None or ends["last"] - ends["first"] < TOP_BUCKETS:
                return cls(spec, float(base_seconds), tuple(levels), fan)
            wider = levels[-1].withColumn("bucket", F.floor(F.col("bucket") / fan))
            levels.append(_written(_peaks(wider, spec), spec, folder))

    def width(self, level: int) -> float:
        """Seconds in a bucket."""
        return self.base_seconds * self.fan**level

    def view(self, x0: float, x1: float, points: int = SHOWN_POINTS) -> DataFrame:
        """The peaks of the buckets that meet the range, as rows of ``downsample_peak``.

        The level is the finest one with at most ``points`` buckets, or the highest.  The
        first and last bucket are shown whole.  Columns: keys, ``level``, ``bucket``,
        ``peak``, the peak's place and its value ``y``.
        """
        low, high = min(x0, x1), max(x0, x1)
        level = min(level_for(low, high, points, self.base_seconds, self.fan), len(self.levels) - 1)
        width = self.width(level)
        shown = self.levels[level].filter(
            F.col("bucket").between(math.floor(low / width), math.floor(high / width)))
        both = F.array(
            F.struct(F.lit("min").alias("peak"), F.col("low").alias("_r")),
            F.struct(F.lit("max").alias("peak"), F.col("high").alias("_r")),
        )
        return shown.select(*self.spec.keys, F.lit(level).alias("level"), "bucket", F.inline(both)).select(
            *self.spec.keys, "level", "bucket", "peak", "_r.*")

    def counts(self, level: int) -> DataFrame:
        """How many readings every bucket of a level has."""
        return self.levels[level].select(*self.spec.keys, "bucket", "n")


def _peaks(df: DataFrame, spec: SeriesSpec) -> DataFrame:
    def rank(name: str, sign: int) -> Column:
        place = F.struct(*[F.col(f"{name}.{c}") for c in (*spec.order_by, *spec.tiebreak)])
        return F.struct((F.col(f"{name}.y") * sign).alias("y"), place.alias("place"))

    return df.groupBy(*spec.keys, "bucket").agg(
        F.sum("n").cast("long").alias("n"),
        F.min_by("low", rank("low", 1)).alias("low"),
        F.min_by("high", rank("high", -1)).alias("high"),
    )


def _written(level: DataFrame, spec: SeriesSpec, folder: str | None) -> DataFrame:
    """Sorted by series and bucket, so that files and row groups are skipped by both."""
    order = [F.col(k).asc_nulls_last() for k in spec.keys] + [F.col("bucket")]
    return stage(level.repartitionByRange(*order).sortWithinPartitions(*order), folder)


def peak_pyramid(df: DataFrame, spec: SeriesSpec, x: str, base_seconds: float, **more) -> PeakPyramid:
    return PeakPyramid.build(df, spec, x, base_seconds, **more)
