"""Windows over long series, split into equal blocks.

A window partitioned by the series key puts a whole series on one task.  That is
fine while every series is small, which ``profile`` checks with one grouped
count.  Otherwise the rows are laid out by a range shuffle on the full sort key,
written once, and numbered densely; ``block = row number div block_rows`` then
gives equal blocks however the readings are spread over series or time.  A row
near a block edge is also copied to the neighbour block (the halo) when the
operator looks ahead or back.  What has to cross more than one block (a running
"last seen" value, a run of equal values) travels through a summary with one row
per block and series.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window, WindowSpec, functions as F

from seriesmend.model import SeriesSpec, join_on_key
from seriesmend.plans.staging import stage

LARGEST_PLAIN_SERIES = 2_000_000   # rows one task may hold in a window
BLOCK_ROWS = 100_000               # rows per block beyond that
BLOCKS_PER_GROUP = 10_000          # blocks whose summary one task orders
ROWS_PER_RANGE = 20_000_000        # rows one range partition may sort
BROADCAST_ROWS = 500_000           # rows a broadcast table may have ...
BROADCAST_BYTES = 64 * 2**20       # ... and bytes of their keys

ROW_NUMBER, BLOCK, CORE = "_rn", "_block", "_core"
WHOLE = -1   # the block of a series that was not cut


@dataclass(frozen=True)
class Profile:
    rows: int
    series: int
    largest: int
    key_bytes: int = 0   # of the widest key

    def plus(self, other: "Profile") -> "Profile":
        """At most what two tables have together."""
        return Profile(
            self.rows + other.rows, self.series + other.series, self.largest + other.largest,
            max(self.key_bytes, other.key_bytes),
        )

    def may_broadcast(self, rows: int) -> bool:
        """Whether a table with one row per series, ``rows`` in all, may be broadcast."""
        return rows <= BROADCAST_ROWS and rows * self.key_bytes <= BROADCAST_BYTES


def profile(df: DataFrame, keys) -> Profile:
    """Row count, series count and longest series: one row on the driver."""
    if not keys:
        n = df.count()
        return Profile(n, min(n, 1), n)
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    width = F.octet_length(F.to_json(F.struct(*keys)))
    row = sizes.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("rows"),
        F.count(F.lit(1)).alias("series"),
        F.coalesce(F.max("n"), F.lit(0)).alias("largest"),
        F.coalesce(F.max(width), F.lit(0)).alias("bytes"),
    ).first()
    return Profile(row["rows"], row["series"], row["largest"], row["bytes"])


@dataclass(frozen=True)
class Layout:
    """``mode``: "plain" (window per series), "blocked", or "auto" (by profile)."""

    mode: str = "auto"
    block_rows: int | None = None
    largest_plain: int = LARGEST_PLAIN_SERIES

    def rows_per_block(self, halo: int) -> int:
        return max(self.block_rows or BLOCK_ROWS, halo, 1)


@dataclass(frozen=True)
class Blocks:
    """Rows ready for windows: ``parts`` are the window keys, ``order`` the order."""

    df: DataFrame
    spec: SeriesSpec
    parts: tuple[str, ...]
    order: tuple[Column, ...]
    blocked: bool
    small_summary: bool   # one row per block and series may be broadcast

    def window(self) -> WindowSpec:
        return Window.partitionBy(*self.parts).orderBy(*self.order)

    def whole(self) -> WindowSpec:
        return Window.partitionBy(*self.parts)

    def core(self, df: DataFrame) -> DataFrame:
        """Drop the halo copies."""
        return df.filter(F.col(CORE)) if self.blocked else df

    def join_summary(self, df: DataFrame, summary: DataFrame) -> DataFrame:
        """Attach a table that has one row per block and series."""
        if self.small_summary:
            summary = F.broadcast(summary)
        return join_on_key(df, summary, self.parts)

    def with_df(self, df: DataFrame) -> "Blocks":
        return replace(self, df=df)


def number_rows(df: DataFrame, spec: SeriesSpec, partitions: int) -> DataFrame:
    """Dense, 0-based ``_rn`` over (keys, order, tiebreak), without a global window.

    The range shuffle spreads rows by the full sort key, so a long series or a
    repeated time is split too.  The layout is written before it is counted:
    sampled range bounds could differ if it were computed twice.
    """
    sort_key = [*[F.col(k).asc_nulls_last() for k in spec.keys], *spec.ordering]
    laid = stage(
        df.repartitionByRange(partitions, *sort_key)
        .sortWithinPartitions(*sort_key)
        .withColumn("_place", F.monotonically_increasing_id())
    )
    slice_of = F.shiftright("_place", 33)
    sizes = laid.groupBy(slice_of.alias("_slice")).agg(F.count(F.lit(1)).alias("_n"))
    # at most one row per range partition
    before = Window.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(
        "_slice", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start")
    )
    place_in_slice = F.col("_place").bitwiseAND(F.lit((1 << 33) - 1))
    return (
        laid.withColumn("_slice", slice_of)
        .join(F.broadcast(starts), "_slice")
        .withColumn(ROW_NUMBER, F.col("_start") + place_in_slice)
        .drop("_slice", "_start", "_place")
    )


def as_blocks(
    df: DataFrame,
    spec: SeriesSpec,
    halo: int = 0,
    layout: Layout = Layout(),
    sizes: Profile | None = None,
) -> Blocks:
    """Prepare ``df`` for windows ordered by the spec.

    Adds ``_rn``, increasing in series order (dense in blocked mode).  In blocked
    mode every core row sees ``halo`` rows of its series on either side.  In auto
    mode only the long series are cut; each short one is a block of its own, which
    takes one hash shuffle.  ``sizes`` saves counting, if the caller knows them.
    """
    if layout.mode == "plain":
        return _plain(df, spec)
    sizes = sizes or profile(df, spec.keys)
    short = None
    if layout.mode == "auto":
        if sizes.largest <= layout.largest_plain:
            return _plain(df, spec)
        if spec.keys:
            df, short = _long_and_short(df, spec, sizes, layout.largest_plain)
    block_rows = layout.rows_per_block(halo)
    shuffles = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    partitions = max(shuffles, math.ceil(sizes.rows / ROWS_PER_RANGE))
    numbered = number_rows(df, spec, partitions)
    offset = F.col(ROW_NUMBER) % block_rows
    own = ((F.col(ROW_NUMBER) - offset) / block_rows).cast("long")
    if halo == 0:
        placed = numbered.withColumn(BLOCK, own).withColumn(CORE, F.lit(True))
    else:
        targets = F.array_compact(
            F.array(
                own,
                F.when(offset < halo, own - 1),
                F.when(offset >= block_rows - halo, own + 1),
            )
        )
        placed = numbered.withColumn(BLOCK, F.explode(targets)).withColumn(
            CORE, F.col(BLOCK) == own
        )
    if short is not None:
        whole = _plain(short, spec).df.withColumn(BLOCK, F.lit(WHOLE).cast("long"))
        placed = placed.unionByName(whole.withColumn(CORE, F.lit(True)))
    return Blocks(
        placed,
        spec,
        (BLOCK, *spec.keys),
        (F.col(ROW_NUMBER).asc(),),
        True,
        sizes.may_broadcast(math.ceil(sizes.rows / block_rows) + sizes.series),
    )


def _long_and_short(df: DataFrame, spec: SeriesSpec, sizes: Profile, most: int):
    """The rows of series with more than ``most`` rows, and those of all others."""
    counts = df.groupBy(*spec.keys).agg(F.count(F.lit(1)).alias("_n"))
    # at most rows / most of them
    listed = stage(counts.filter(F.col("_n") > most)).select(*spec.keys, F.lit(True).alias("_long"))
    if sizes.may_broadcast(sizes.rows // max(most, 1)):
        listed = F.broadcast(listed)
    marked = join_on_key(df, listed, spec.keys)
    return marked.filter("_long").drop("_long"), marked.filter(F.col("_long").isNull()).drop("_long")


def carried(summary: DataFrame, keys, value: str, name: str, backwards: bool = False) -> DataFrame:
    """Add ``name``: the last ``value`` of the earlier blocks of a series (of the later
    ones if ``backwards``) that has one.

    In two levels, so that the blocks of one endless series are not one window:
    within groups of blocks, then over the groups.
    """
    group = F.floor(F.col(BLOCK) / BLOCKS_PER_GROUP)
    along = lambda c: F.desc(c) if backwards else F.asc(c)
    last = lambda c: F.last(c, ignorenulls=True)
    grouped = summary.withColumn("_group", group)
    inside = Window.partitionBy(*keys, "_group").orderBy(along(BLOCK)).rowsBetween(Window.unboundedPreceding, -1)
    outermost = F.min_by if backwards else F.max_by
    per_group = grouped.filter(F.col(value).isNotNull()).groupBy(*keys, "_group").agg(
        outermost(value, BLOCK).alias("_of_group"))
    per_group = join_on_key(grouped.select(*keys, "_group").distinct(), per_group, (*keys, "_group"))
    before = Window.partitionBy(*keys).orderBy(along("_group")).rowsBetween(Window.unboundedPreceding, -1)
    per_group = per_group.select(*keys, "_group", last("_of_group").over(before).alias("_before"))
    joined = join_on_key(grouped.withColumn("_inside", last(value).over(inside)), per_group, (*keys, "_group"))
    return joined.withColumn(name, F.coalesce("_inside", "_before")).drop("_group", "_inside", "_before")


def _plain(df: DataFrame, spec: SeriesSpec) -> Blocks:
    order = tuple(spec.ordering)
    numbered = df.withColumn(
        ROW_NUMBER, F.row_number().over(Window.partitionBy(*spec.keys).orderBy(*order)).cast("long")
    )
    return Blocks(numbered, spec, spec.keys, order, False, True)


def last_seen(blocks: Blocks, value: str, name: str, backwards: bool = False) -> DataFrame:
    """Running last non-NULL ``value`` in series order (next one if ``backwards``).

    The current row counts.  Blocked mode carries the value into a block from the
    nearest earlier (later) block of the same series that has one.
    """
    order = [c.desc() if backwards else c for c in (F.col(ROW_NUMBER),)]
    running = Window.partitionBy(*blocks.parts).orderBy(*order).rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    seen = blocks.df.withColumn(name, F.last(value, ignorenulls=True).over(running))
    if not blocks.blocked:
        return seen
    # the outermost row with a value in every block: its number first, then its value
    outermost = F.min if backwards else F.max
    places = blocks.df.filter(F.col(value).isNotNull()).groupBy(*blocks.parts).agg(
        outermost(ROW_NUMBER).alias("_at")
    )
    if blocks.small_summary:
        places = F.broadcast(places)
    edge_rows = blocks.df.select(*blocks.parts, ROW_NUMBER, F.col(value).alias("_edge"))
    per_block = edge_rows.join(places.select("_at"), F.col(ROW_NUMBER) == F.col("_at")).select(
        *blocks.parts, "_edge"
    )
    # every block needs a carried value, also one that has none of its own
    all_blocks = blocks.df.select(*blocks.parts).distinct()
    summary = carried(
        join_on_key(all_blocks, per_block, blocks.parts), blocks.spec.keys, "_edge", "_carried", backwards
    ).select(*blocks.parts, "_carried")
    joined = blocks.join_summary(seen, summary)
    return joined.withColumn(name, F.coalesce(name, "_carried")).drop("_carried")
