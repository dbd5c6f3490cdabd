"""Tables behind a plot: extents, thinned series, raw / corrected projection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from seriesmend.functions import ieee
from seriesmend.model import SeriesSpec, join_on_key
from seriesmend.plans.blocks import ROW_NUMBER, Layout, as_blocks
from seriesmend.sources.timeaxis import epoch_seconds

# Fixed value: most points of a selection that are shown.
SHOWN_POINTS = 3000

DISPLAY_COLUMNS = {"raw": ("raw",), "corrected": ("corrected",), "both": ("raw", "corrected")}


def display(df: DataFrame, mode: str, columns: tuple[str, ...]) -> DataFrame:
    """Long form of what is shown: ``columns``, ``curve``, ``y``."""
    shown = DISPLAY_COLUMNS[mode]
    curves = F.array(*[F.struct(F.lit(c).alias("curve"), F.col(c).alias("y")) for c in shown])
    return df.select(*columns, F.inline(curves))


def series_extent(df: DataFrame, spec: SeriesSpec, x: str, mode: str = "both") -> DataFrame:
    """Per series: time of the first and last row, finite value range of what is shown."""
    finite = [F.when(ieee.is_finite(F.col(c)), F.col(c)) for c in DISPLAY_COLUMNS[mode]]
    low = F.least(*finite) if len(finite) > 1 else finite[0]
    high = F.greatest(*finite) if len(finite) > 1 else finite[0]
    if x == spec.order_by[0]:
        # rows are in time order, so the first and last row have the extreme times
        first, last = F.min(x), F.max(x)
    else:
        place = F.struct(*[F.col(c) for c in (*spec.order_by, *spec.tiebreak)])
        timed = F.when(F.col(x).isNotNull(), place)
        first, last = F.min_by(x, timed), F.max_by(x, timed)
    return df.groupBy(*spec.keys).agg(
        first.alias("x_first"),
        last.alias("x_last"),
        F.min(low).alias("y_min"),
        F.max(high).alias("y_max"),
    )


def downsample_peak(
    df: DataFrame, spec: SeriesSpec, x: str, bucket_seconds: float, value: str | None = None
) -> DataFrame:
    """The lowest and highest reading of every time bucket (the first of equals)."""
    y = F.col(value or spec.value)
    bucket = F.floor(epoch_seconds(F.col(x)) / F.lit(float(bucket_seconds))).alias("bucket")
    place = F.struct(*[F.col(c) for c in (*spec.order_by, *spec.tiebreak)])
    row = F.struct(*[F.col(c) for c in (*spec.order_by, *spec.tiebreak)], y.alias("y"))
    present = df.filter(y.isNotNull() & ~F.isnan(y) & F.col(x).isNotNull())
    lowest = F.struct(y.alias("y"), place.alias("place"))
    highest = F.struct((-y).alias("y"), place.alias("place"))
    peaks = present.groupBy(*spec.keys, bucket).agg(
        F.min_by(row, lowest).alias("_low"), F.min_by(row, highest).alias("_high")
    )
    both = F.array(
        F.struct(F.lit("min").alias("peak"), F.col("_low").alias("_r")),
        F.struct(F.lit("max").alias("peak"), F.col("_high").alias("_r")),
    )
    return peaks.select(*spec.keys, "bucket", F.inline(both)).select(
        *spec.keys, "bucket", "peak", "_r.*"
    )


def downsample_stride(
    df: DataFrame,
    spec: SeriesSpec,
    where: Column | None = None,
    shown: int = SHOWN_POINTS,
    layout: Layout = Layout(),
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """Every k-th selected row of a series, k = n div shown + 1, if there are more than ``shown``."""
    selected = (df if where is None else df.filter(where)).select(*spec.row_key, *keep)
    blocks = as_blocks(selected, spec, layout=layout)
    if blocks.blocked:
        sizes = blocks.df.groupBy(*spec.keys).agg(
            F.min(ROW_NUMBER).alias("_first"), F.count(F.lit(1)).alias("_n")
        )
        if blocks.small_summary:
            sizes = F.broadcast(sizes)
        numbered = join_on_key(blocks.df, sizes, spec.keys)
    else:
        numbered = blocks.df.withColumns(
            {"_first": F.lit(1), "_n": F.count(F.lit(1)).over(blocks.whole())}
        )
    step = F.when(
        F.col("_n") > shown, F.floor(F.col("_n") / F.lit(shown)) + 1
    ).otherwise(F.lit(1))
    return numbered.filter((F.col(ROW_NUMBER) - F.col("_first")) % step == 0).select(
        *spec.row_key, *keep
    )
