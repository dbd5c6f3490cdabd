"""Selections: predicates on time and value, point lookup, frozen row sets."""

from __future__ import annotations

import datetime

from pyspark.sql import Column, DataFrame, functions as F

from seriesmend.functions import ieee
from seriesmend.model import SeriesSpec, join_on_key
from seriesmend.plans.blocks import BROADCAST_BYTES, BROADCAST_ROWS, Layout, as_blocks, last_seen, profile
from seriesmend.plans.staging import stage


def _bound(value) -> Column:
    """A constant of the axis' own type, so that the range reaches the scan."""
    if isinstance(value, datetime.date):
        return F.to_timestamp_ntz(F.lit(value.isoformat()))
    return F.lit(value)


def x_range(x: Column, x0, x1) -> Column:
    """Inclusive; a row without a time is never selected."""
    return x.between(_bound(x0), _bound(x1))


def y_range(y: Column, y0: float, y1: float) -> Column:
    """Inclusive; a missing reading is never selected (NaN sorts above ``y1``)."""
    return (y >= float(y0)) & (y <= float(y1)) & ~F.isnan(y)


def xy_rectangle(x: Column, y: Column, corner, opposite) -> Column:
    """Rectangle between two corners ``(x, y)`` given in any order."""
    (xa, ya), (xb, yb) = corner, opposite
    return x_range(x, min(xa, xb), max(xa, xb)) & y_range(y, min(ya, yb), max(ya, yb))


def selection_count(df: DataFrame, where: Column, keys: tuple[str, ...] = ()) -> DataFrame:
    return df.groupBy(*keys).agg(F.count_if(F.coalesce(where, F.lit(False))).alias("selected"))


def freeze_selection(df: DataFrame, where: Column, spec: SeriesSpec) -> DataFrame:
    """Row keys selected now, written once: later corrections do not change them."""
    return stage(df.filter(where).select(*spec.row_key))


def nearest_points(
    readings: DataFrame,
    probes: DataFrame,
    spec: SeriesSpec,
    x: str,
    probe_x: str,
    layout: Layout = Layout(),
) -> DataFrame:
    """For every probe the reading of its series nearest in time.

    ``probes`` has the series keys and ``probe_x``, plus columns to keep.  Equally
    near: the later reading.  Among readings with one time: the first when they
    lie at or after the probe, the last when before.  Probes and readings are
    merged in time order and each probe looks at the reading just before and just
    after it, so no pair is built.
    """
    shown = tuple(c for c in (*spec.order_by, *spec.tiebreak) if c not in (x, *spec.keys))
    extra = [c for c in probes.columns if c not in (*spec.keys, probe_x)]
    payload = F.struct(
        F.col(x).alias("x"), *[F.col(c) for c in shown], F.col(spec.value).alias("reading")
    )
    points = readings.filter(F.col(x).isNotNull()).select(
        *spec.keys,
        F.col(x).alias("_x"),
        F.lit(1).alias("_kind"),
        *[F.col(c).alias(f"_tie_{c}") for c in spec.tiebreak],
        payload.alias("_point"),
    )
    asked = probes.filter(F.col(probe_x).isNotNull()).select(
        *spec.keys,
        F.col(probe_x).alias("_x"),
        F.lit(0).alias("_kind"),
        F.monotonically_increasing_id().alias("_no"),
        F.struct(*extra).alias("_asked") if extra else F.lit(True).alias("_asked"),
    )
    merged = points.unionByName(asked, allowMissingColumns=True)
    # a probe sorts before the readings of its own time; equal probes get an order too
    ties = [f"_tie_{c}" for c in spec.tiebreak]
    order = SeriesSpec(spec.keys, ("_x",), ("_kind", *ties, "_no"))
    sizes = None
    if layout.mode != "plain":
        # each side is counted on its own keys, not the merged rows
        sizes = profile(readings, spec.keys).plus(profile(probes, spec.keys))
    blocks = as_blocks(merged, order, layout=layout, sizes=sizes)
    before = last_seen(blocks, "_point", "_before")
    both = last_seen(blocks.with_df(before), "_point", "_after", backwards=True)
    left, right, at = F.col("_before.x"), F.col("_after.x"), F.col("_x")
    earlier = F.col("_after").isNull() | (
        F.col("_before").isNotNull() & ((at - left) < (right - at))
    )
    found = both.filter(F.col("_kind") == 0).withColumn(
        "_hit", F.when(earlier, F.col("_before")).otherwise(F.col("_after"))
    )
    return found.filter(F.col("_hit").isNotNull()).select(
        *spec.keys,
        F.col("_x").alias(probe_x),
        *[F.col(f"_asked.{c}").alias(c) for c in extra],
        F.col("_hit.x").alias(x),
        *[F.col(f"_hit.{c}").alias(c) for c in shown],
        F.col("_hit.reading").alias(spec.value),
    )


def nearest_point(readings: DataFrame, spec: SeriesSpec, x: str, probe) -> DataFrame:
    """One probe for all series.

    A first pass finds the two neighbouring times of every series (a hash
    aggregate over the key and time columns).  The second reads only the time
    range those cover, which reaches the scan, to settle repeated times.
    """
    shown = tuple(c for c in (*spec.order_by, *spec.tiebreak) if c not in (x, *spec.keys))
    at = _bound(probe)
    sides = stage(
        readings.filter(F.col(x).isNotNull()).groupBy(*spec.keys).agg(
            F.max(F.when(F.col(x) < at, F.col(x))).alias("_left"),
            F.min(F.when(F.col(x) >= at, F.col(x))).alias("_right"),
        )
    )
    left, right = F.col("_left"), F.col("_right")
    earlier = right.isNull() | (left.isNotNull() & ((at - left) < (right - at)))
    chosen = sides.select(
        *spec.keys, F.when(earlier, left).otherwise(right).alias("_nearest_x"), earlier.alias("_earlier")
    )
    reach = chosen.agg(
        F.min("_nearest_x").alias("low"), F.max("_nearest_x").alias("high"), F.count(F.lit(1)).alias("n"),
        F.coalesce(F.sum(F.octet_length(F.to_json(F.struct(*spec.keys, "_nearest_x")))), F.lit(0)).alias("bytes"),
    ).first()
    if reach["n"] <= BROADCAST_ROWS and reach["bytes"] <= BROADCAST_BYTES:
        chosen = F.broadcast(chosen)
    near = readings
    if reach["low"] is not None:
        near = near.filter(F.col(x).between(_bound(reach["low"]), _bound(reach["high"])))
    tied = join_on_key(near, chosen, spec.keys, "inner").filter(F.col(x) == F.col("_nearest_x"))
    row = F.struct(F.col(x), *[F.col(c) for c in shown], F.col(spec.value))
    rank = F.struct(*[F.col(c) for c in (x, *spec.tiebreak)])
    # before the probe the last of equal times, at or after it the first
    hits = tied.groupBy(*spec.keys, "_earlier").agg(
        F.max_by(row, rank).alias("_last"), F.min_by(row, rank).alias("_first")
    )
    hit = F.when(F.col("_earlier"), F.col("_last")).otherwise(F.col("_first"))
    return hits.select(*spec.keys, hit.alias("_hit")).select(*spec.keys, "_hit.*")


def finite_reading(value: Column) -> Column:
    """The reading if it is finite, else NULL."""
    return F.when(ieee.is_finite(value), value)
