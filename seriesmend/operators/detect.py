"""Spike and stuck-value detectors.

``score_*`` gives every row its score; ``detect_*`` keeps the candidates (row key,
score, kind).  Nothing is changed.  A missing reading may be NULL or NaN.  Each
runs as one window pass per series, or per block of a long series (see
``plans.blocks``), and a correction of the candidates needs no join back.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from seriesmend.functions import ieee
from seriesmend.functions.binding import let, once
from seriesmend.model import SeriesSpec, join_on_key
from seriesmend.operators.orderstats import moving_median_mad
from seriesmend.plans.blocks import CORE, ROW_NUMBER, Blocks, Layout, as_blocks, carried

# Fixed values of the score: consistency factor of the MAD and its floor.
MAD_TO_SIGMA = 1.4826
MAD_FLOOR = 1e-9


def _readings(df: DataFrame, spec: SeriesSpec, keep: tuple[str, ...] = ()) -> DataFrame:
    """Only the columns a detector needs: they may be shuffled and written."""
    return df.select(
        *spec.row_key, *keep, ieee.to_missing(F.col(spec.value).cast("double")).alias("_v")
    )


def first_difference(
    df: DataFrame,
    spec: SeriesSpec,
    layout: Layout = Layout(),
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """Row key and ``diff`` = reading - previous reading.

    NULL on the first row of a series and next to a gap.
    """
    blocks = as_blocks(_readings(df, spec, keep), spec, halo=1, layout=layout)
    step = F.col("_v") - F.lag("_v").over(blocks.window())
    stepped = blocks.core(blocks.df.withColumn("diff", ieee.to_missing(step)))
    return stepped.select(*spec.row_key, *keep, "diff")


# --- rolling median and median absolute deviation ---------------------------


# Up to this half width a frame is a sorted array, and the deviation of a full one is
# written out term by term, which stays in generated code.  Wider frames are never
# written: see ``orderstats``.
WRITTEN_OUT = 40


def _middle(ordered: Column) -> Column:
    """Median of a sorted array; NULL if empty."""
    n = F.size(ordered)
    low = F.get(ordered, ((n - 1) / 2).cast("int"))
    high = F.get(ordered, (n / 2).cast("int"))
    return F.when(n > 0, (low + high) / 2)


def _kth_deviation(ordered: Column, centre: Column, k: Column) -> Column:
    """k-th smallest distance to ``centre``.

    The k nearest values are neighbours in the sorted array, so it is enough to
    look at the two ends of every stretch of k values: no second sort.
    """
    stretches = F.size(ordered) - k + 1
    return F.array_min(
        F.zip_with(
            F.slice(ordered, F.lit(1), stretches),
            F.slice(ordered, k, stretches),
            lambda lo, hi: F.greatest(centre - lo, hi - centre),
        )
    )


def _full_frame_deviation(ordered: Column, centre: Column, half: int) -> Column:
    """The same for a frame of ``2 * half + 1`` values, k = half + 1."""
    at = lambda i: F.get(ordered, F.lit(i))
    return F.least(
        *[F.greatest(centre - at(i), at(i + half) - centre) for i in range(half + 1)]
    )


def _any_deviation(ordered: Column, centre: Column) -> Column:
    n = F.size(ordered)
    k = ((n + 1) / 2).cast("int")
    nearest = _kth_deviation(ordered, centre, k)
    return F.when(n % 2 == 1, nearest).otherwise(
        (nearest + _kth_deviation(ordered, centre, k + 1)) / 2
    )


def _with_deviation(frames: DataFrame, half: int) -> DataFrame:
    """Add ``_med`` and ``_mad`` of the sorted frame ``_s`` (NULL if it is empty)."""
    ordered, centre = F.col("_s"), F.col("_med")
    centred = once(frames, "_med", _middle(ordered))
    full = (F.size(ordered) == 2 * half + 1) & ieee.is_finite(centre)
    centred = once(centred, "_full", F.when(full, _full_frame_deviation(ordered, centre, half)))
    # distances to an infinite centre may be undefined; those are left out
    defined = F.sort_array(
        F.filter(F.transform(ordered, lambda v: F.abs(v - centre)), lambda v: ~F.isnan(v))
    )
    rest = (
        F.when(centre.isNull(), F.lit(None).cast("double"))
        .when(ieee.is_finite(centre), _any_deviation(ordered, centre))
        .otherwise(let(defined, _middle))
    )
    mad = F.when(F.col("_full").isNotNull(), F.col("_full")).otherwise(rest)
    return centred.withColumn("_mad", mad).drop("_full")


def _half(window: int) -> int:
    return max(max(int(window), 2) // 2, 1)


def _difference_frames(
    df: DataFrame, spec: SeriesSpec, window: int, layout: Layout, keep: tuple[str, ...] = ()
):
    """Differences ``_d`` with ``_s``, the sorted, edge-padded frame around each.

    The frame is ``2 * half + 1`` differences; past either end of the series the
    first / last difference is repeated.  How many are missing follows from the
    position, since the collected list leaves gaps out.
    """
    half = _half(window)
    blocks = as_blocks(_readings(df, spec, keep), spec, halo=half + 1, layout=layout)
    w = blocks.window()
    # In the window partition of a core row, fewer than ``half`` differences on a
    # side means that the series ends there.
    steps = blocks.df.select(
        "*",
        ieee.to_missing(F.col("_v") - F.lag("_v").over(w)).alias("_d"),
        F.row_number().over(w).alias("_place"),
        F.count(F.lit(1)).over(blocks.whole()).cast("int").alias("_size"),
    )
    everything = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    frames = steps.select(
        "*",
        F.collect_list("_d").over(w.rowsBetween(-half, half)).alias("_frame"),
        F.nth_value("_d", 2).over(everything).alias("_first_d"),
        F.last("_d").over(everything).alias("_last_d"),
    )
    short_left = F.lit(half) - F.least(F.col("_place") - 2, F.lit(half))
    short_right = F.lit(half) - F.least(F.col("_size") - F.col("_place"), F.lit(half))

    def repeated(edge: str, times: Column) -> Column:
        present = F.when(F.col(edge).isNotNull(), times).otherwise(F.lit(0))
        return F.array_repeat(F.coalesce(F.col(edge), F.lit(0.0)), present)

    padded = F.when(short_left + short_right == 0, F.col("_frame")).otherwise(
        F.concat(
            F.col("_frame"), repeated("_first_d", short_left), repeated("_last_d", short_right)
        )
    )
    framed = blocks.core(frames).select(
        *spec.row_key, *keep, "_d", "_place", "_size", padded.alias("_padded")
    )
    return once(framed, "_s", F.sort_array("_padded")).drop("_padded")


def _wide_frames(
    df: DataFrame, spec: SeriesSpec, window: int, layout: Layout, keep: tuple[str, ...] = ()
) -> DataFrame:
    """``_d``, ``_med``, ``_mad``, ``_place`` and ``_size`` of every row, for any width.

    A series, or a block of a long one with ``half + 1`` rows on either side, is one group
    of Arrow columns; it holds one running count per row and bit, and no frames.
    """
    half = _half(window)
    blocks = as_blocks(_readings(df, spec, keep), spec, halo=half + 1, layout=layout)
    carry, blocked = [*spec.row_key, *keep], blocks.blocked
    kinds = blocks.df.select(*carry).schema.fields
    found = [StructField(n, DoubleType()) for n in ("_d", "_med", "_mad")]
    found += [StructField(n, LongType()) for n in ("_place", "_size")]

    def measure(block: pa.Table) -> pa.Table:
        block = block.sort_by(ROW_NUMBER)
        n = block.num_rows
        v = block.column("_v").to_numpy()   # missing readings become NaN
        with np.errstate(invalid="ignore"):
            steps = np.diff(v)
        median, mad, known = moving_median_mad(steps, half)
        out, first = block.select(carry), np.zeros(min(n, 1))   # which has no difference
        for name, values, has in (("_d", steps, ~np.isnan(steps)), ("_med", median, known), ("_mad", mad, ~np.isnan(mad))):
            empty = ~np.concatenate([first.astype(bool), has])
            out = out.append_column(name, pa.array(np.concatenate([first, values]), pa.float64(), mask=empty))
        out = out.append_column("_place", pa.array(np.arange(1, n + 1)))
        out = out.append_column("_size", pa.array(np.full(n, n)))
        return out.filter(block.column(CORE)) if blocked else out

    return blocks.df.groupBy(*blocks.parts).applyInArrow(measure, StructType([*kinds, *found]))


# the first row of a series has no difference, and two rows are no series
_SCORABLE = "_place > 1 AND _size >= 3"


def _measured(
    df: DataFrame, spec: SeriesSpec, window: int, layout: Layout, keep: tuple[str, ...], kernel: str
) -> DataFrame:
    """Differences with the median and MAD around them: ``kernel`` "arrays", "counts", or
    "auto", which takes arrays for narrow frames only.  All give the same values."""
    if kernel == "auto":
        kernel = "arrays" if _half(window) <= WRITTEN_OUT else "counts"
    if kernel == "counts":
        return _wide_frames(df, spec, window, layout, keep)
    return _with_deviation(_difference_frames(df, spec, window, layout, keep), _half(window))


def rolling_median_mad(
    df: DataFrame, spec: SeriesSpec, window: int = 24, layout: Layout = Layout(), kernel: str = "auto"
) -> DataFrame:
    """Row key, ``diff``, and the median and MAD of the differences around it."""
    return _measured(df, spec, window, layout, (), kernel).filter(_SCORABLE).select(
        *spec.row_key,
        F.col("_d").alias("diff"),
        F.col("_med").alias("med"),
        F.col("_mad").alias("mad"),
    )


def score_spikes(
    df: DataFrame,
    spec: SeriesSpec,
    window: int = 24,
    layout: Layout = Layout(),
    keep: tuple[str, ...] = (),
    name: str = "score",
    kernel: str = "auto",
) -> DataFrame:
    """Every row with the score (column ``name``) of its step from the previous reading.

    score = |d - median| / (1.4826 * MAD + 1e-9) over the differences around it;
    an undefined or infinite score counts as 0.  NULL on the first row of a series
    and in series of fewer than three rows.  Any ``window`` is taken.
    """
    frames = _measured(df, spec, window, layout, keep, kernel)
    ratio = F.abs(F.col("_d") - F.col("_med")) / (F.col("_mad") * MAD_TO_SIGMA + MAD_FLOOR)
    # undefined and infinite ratios, and missing differences, count as 0
    score = F.when(F.expr(_SCORABLE), F.when(ratio < ieee.INF, ratio).otherwise(F.lit(0.0)))
    return frames.select(*spec.row_key, *keep, score.alias(name))


def detect_spikes(
    df: DataFrame,
    spec: SeriesSpec,
    window: int = 24,
    z_thresh: float = 4.0,
    layout: Layout = Layout(),
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """Rows whose step is an outlier among its neighbours (score above ``z_thresh``).

    The later row of the pair is flagged, so an isolated spike gives two candidates.
    """
    scored = score_spikes(df, spec, window, layout, keep)
    return scored.filter(F.col("score") > float(z_thresh)).withColumn("kind", F.lit("spike"))


# --- runs -------------------------------------------------------------------


def _label_runs(blocks: Blocks, df: DataFrame) -> DataFrame:
    """Add ``_run`` (row number of the run's first row) and ``_length``.

    ``df`` has ``_break``, true where a row does not continue the previous one.
    In blocked mode row numbers are dense, so a summary of the outermost breaks of
    every block and series tells where its first run began and its last run ends.
    """
    here = F.when(F.col("_break"), F.col(ROW_NUMBER))
    running = blocks.window().rowsBetween(Window.unboundedPreceding, Window.currentRow)
    begun = df.withColumn("_run", F.max(here).over(running))
    local = begun.withColumn(
        "_length", F.count(F.lit(1)).over(Window.partitionBy(*blocks.parts, "_run"))
    )
    if not blocks.blocked:
        return local
    edges = df.groupBy(*blocks.parts).agg(
        F.min(here).alias("_first_break"),
        F.max(here).alias("_last_break"),
        F.max(ROW_NUMBER).alias("_last_row"),
    )
    keys = blocks.spec.keys
    ends = edges.groupBy(*keys).agg((F.max("_last_row") + 1).alias("_end"))
    begun_before = carried(edges, keys, "_last_break", "_begun_before")
    both = carried(begun_before, keys, "_first_break", "_following", backwards=True)
    summary = join_on_key(both, ends, keys).select(
        *blocks.parts, "_first_break", "_last_break", "_begun_before",
        F.coalesce("_following", "_end").alias("_next_break"),
    )
    merged = blocks.join_summary(local, summary)
    head_end = F.coalesce(F.col("_first_break"), F.col("_next_break"))
    # no local break yet: the run comes from an earlier block
    length = (
        F.when(F.col("_run").isNull(), head_end - F.col("_begun_before"))
        .when(F.col("_run") == F.col("_last_break"), F.col("_next_break") - F.col("_run"))
        .otherwise(F.col("_length"))
    )
    return (
        merged.withColumn("_length", length)
        .withColumn("_run", F.coalesce("_run", "_begun_before"))
        .drop("_first_break", "_last_break", "_begun_before", "_next_break")
    )


def find_runs(
    df: DataFrame, spec: SeriesSpec, flag: Column, layout: Layout = Layout()
) -> DataFrame:
    """Maximal runs of consecutive rows where ``flag`` holds: one row per run.

    Columns: series keys, ``start_*`` / ``end_*`` (order and tiebreak columns of
    the first and last row), ``points``.
    """
    marked = df.select(*spec.row_key, F.coalesce(flag, F.lit(False)).alias("_flag"))
    blocks = as_blocks(marked, spec, halo=1, layout=layout)
    previous = F.lag("_flag").over(blocks.window())
    broken = blocks.core(
        blocks.df.withColumn(
            "_break", ~(F.col("_flag") & F.coalesce(previous, F.lit(False)))
        )
    )
    runs = _label_runs(blocks, broken).filter("_flag")
    return _one_row_per_run(runs, spec)


def _one_row_per_run(runs: DataFrame, spec: SeriesSpec) -> DataFrame:
    """Only the first and last row of a run travel: its length is known already."""
    place = tuple(dict.fromkeys((*spec.order_by, *spec.tiebreak)))
    first = F.col(ROW_NUMBER) == F.col("_run")
    last = F.col(ROW_NUMBER) == F.col("_run") + F.col("_length") - 1
    return runs.filter(first | last).groupBy(*spec.keys, "_run").agg(
        *[F.max(F.when(first, F.col(c))).alias(f"start_{c}") for c in place],
        *[F.max(F.when(last, F.col(c))).alias(f"end_{c}") for c in place],
        F.max("_length").alias("points"),
    ).drop("_run")


def _stuck_runs(
    df: DataFrame,
    spec: SeriesSpec,
    tolerance: float,
    layout: Layout,
    keep: tuple[str, ...] = (),
) -> DataFrame:
    blocks = as_blocks(_readings(df, spec, keep), spec, halo=1, layout=layout)
    gap = F.abs(F.col("_v") - F.lag("_v").over(blocks.window()))
    same = F.coalesce(gap <= float(tolerance), F.lit(False))
    return _label_runs(blocks, blocks.core(blocks.df.withColumn("_break", ~same)))


def _least_run(min_run_length: int) -> int:
    return max(int(min_run_length), 2)


def score_frozen(
    df: DataFrame,
    spec: SeriesSpec,
    tolerance: float = 0.0,
    layout: Layout = Layout(),
    keep: tuple[str, ...] = (),
    name: str = "score",
) -> DataFrame:
    """Every row with the length (column ``name``) of the run of near-equal readings it is in.

    Neighbours are equal when they differ by at most ``tolerance``, so a slow
    drift is one run.  A missing reading is a run of its own.
    """
    runs = _stuck_runs(df, spec, tolerance, layout, keep)
    return runs.select(*spec.row_key, *keep, F.col("_length").cast("double").alias(name))


def detect_frozen(
    df: DataFrame,
    spec: SeriesSpec,
    min_run_length: int = 6,
    tolerance: float = 0.0,
    layout: Layout = Layout(),
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """All rows of the runs of at least ``min_run_length`` (and two) readings."""
    scored = score_frozen(df, spec, tolerance, layout, keep)
    return scored.filter(F.col("score") >= _least_run(min_run_length)).withColumn(
        "kind", F.lit("freeze")
    )


def frozen_runs(
    df: DataFrame,
    spec: SeriesSpec,
    min_run_length: int = 6,
    tolerance: float = 0.0,
    layout: Layout = Layout(),
) -> DataFrame:
    """The stuck runs themselves, one row each (first and last row, points)."""
    runs = _stuck_runs(df, spec, tolerance, layout)
    kept = runs.filter(F.col("_length") >= _least_run(min_run_length))
    return _one_row_per_run(kept, spec)


def detection_summary(candidates: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Number of candidates per kind (and series)."""
    return candidates.groupBy(*keys, "kind").agg(F.count(F.lit(1)).alias("candidates"))


def candidates_as_selection(df: DataFrame, spec: SeriesSpec, candidates: DataFrame) -> DataFrame:
    """The rows of ``df`` that a detector proposed."""
    return join_on_key(df, candidates.select(*spec.row_key), spec.row_key, "left_semi")
