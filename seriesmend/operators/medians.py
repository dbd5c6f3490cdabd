"""Exact medians per series that hold up for very long series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from seriesmend.model import join_on_key
from seriesmend.plans.blocks import LARGEST_PLAIN_SERIES, Profile
from seriesmend.plans.staging import stage

GRID = 1_000               # quantiles per sketch
SKETCH_ACCURACY = 20_000   # rank error of the sketch is at most rows / accuracy
WIDER = 4                  # how much wider a bracket gets after one that did not help


def exact_median(
    df: DataFrame,
    keys: tuple[str, ...],
    value: str,
    sizes: Profile,
    largest_plain: int = LARGEST_PLAIN_SERIES,
) -> DataFrame:
    """One row per key with the exact median of the non-NULL ``value``s.

    Short series use the built-in exact percentile.  Its buffer holds every
    distinct value of a group, so long series are narrowed first.
    """
    values = df.select(*keys, F.col(value).alias("_v"))
    percentile = F.percentile("_v", F.lit(0.5)).alias(value)
    if sizes.largest <= largest_plain:
        return values.groupBy(*keys).agg(percentile)
    counts = values.groupBy(*keys).agg(F.count("_v").alias("_n"))
    # at most rows / largest_plain long series
    long_ones = stage(counts.filter(F.col("_n") > largest_plain))
    few = sizes.may_broadcast(sizes.rows // largest_plain)
    if not keys:
        rest = values.filter(F.col("_v").isNotNull())
        return _narrowed_median(rest, long_ones, keys, few, largest_plain).withColumnRenamed("_v", value)
    listed = long_ones.select(*keys, F.lit(True).alias("_long"))
    marked = join_on_key(values, F.broadcast(listed) if few else listed, keys)
    short = marked.filter(F.col("_long").isNull()).groupBy(*keys).agg(percentile)
    rest = marked.filter(F.col("_long") & F.col("_v").isNotNull()).select(*keys, "_v")
    return short.unionByName(_narrowed_median(rest, long_ones, keys, few, largest_plain).withColumnRenamed("_v", value))


def _narrowed_median(
    rest: DataFrame, sizes: DataFrame, keys: tuple[str, ...], few: bool, most: int
) -> DataFrame:
    """Cut the values down around the middle ranks, then rank what is left.

    A pass takes quantiles from a mergeable sketch, brackets the wanted ranks a grid
    step wider than needed, counts exactly what lies below and checks that the
    bracket holds the ranks; if it missed, the next one is wider.  Passes go on until
    no series has more than ``most`` values left, those that are all equal aside.
    A pass leaves about one value in 300.
    """

    def attach(df: DataFrame, per_series: DataFrame) -> DataFrame:
        return join_on_key(df, F.broadcast(per_series) if few else per_series, keys)

    v = F.col("_v")
    state = sizes.select(
        *keys,
        "_n",
        F.floor((F.col("_n") + 1) / 2).cast("long").alias("_low"),
        (F.floor(F.col("_n") / 2) + 1).cast("long").alias("_high"),
    )
    steps = F.array(*[F.lit(i / GRID) for i in range(GRID + 1)])
    margin, left = 1, None
    while margin <= GRID:
        grid = rest.groupBy(*keys).agg(
            F.percentile_approx("_v", steps, F.lit(SKETCH_ACCURACY)).alias("_grid")
        )
        at_low = F.floor(F.col("_low") / F.col("_n") * GRID).cast("int") - margin
        at_high = F.ceil(F.col("_high") / F.col("_n") * GRID).cast("int") + margin
        bracket = attach(state, grid).select(
            *keys, "_n", "_low", "_high",
            F.when(at_low >= 0, F.get("_grid", at_low)).alias("_from"),
            F.when(at_high <= GRID, F.get("_grid", at_high)).alias("_to"),
        )
        counted = attach(rest, bracket).groupBy(*keys, "_n", "_low", "_high", "_from", "_to").agg(
            F.count_if(F.coalesce(v < F.col("_from"), F.lit(False))).alias("_below"),
            F.count_if(F.coalesce(v > F.col("_to"), F.lit(False))).alias("_above"),
        )
        upto = F.col("_n") - F.col("_above")
        hit = (F.col("_below") < F.col("_low")) & (F.col("_high") <= upto)
        cut = F.when(hit, F.col("_below")).otherwise(0)
        state = stage(
            counted.select(
                *keys,
                F.when(hit, upto - F.col("_below")).otherwise(F.col("_n")).alias("_n"),
                (F.col("_low") - cut).alias("_low"),
                (F.col("_high") - cut).alias("_high"),
                F.when(hit, F.col("_from")).alias("_from"),
                F.when(hit, F.col("_to")).alias("_to"),
            )
        )
        bounded = attach(rest, state.select(*keys, "_from", "_to"))
        inside = _at_least(v, F.col("_from")) & _at_most(v, F.col("_to"))
        rest = stage(bounded.filter(inside).select(*keys, "_v"))
        one_value = F.coalesce(F.col("_from") == F.col("_to"), F.lit(False))
        before = left
        left = state.agg(F.coalesce(F.max(F.when(~one_value, F.col("_n"))), F.lit(0))).first()[0]
        if left <= most:
            break
        if before is not None and left >= before:
            margin *= WIDER
    # a value repeated many times is one row in the last ordering
    repeated = rest.groupBy(*keys, "_v").agg(F.count(F.lit(1)).alias("_times"))
    running = Window.partitionBy(*keys).orderBy("_v").rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    ranked = attach(
        repeated.withColumn("_upto", F.sum("_times").over(running)),
        state.select(*keys, "_low", "_high"),
    )
    low = F.min(F.when(F.col("_upto") >= F.col("_low"), v))
    high = F.min(F.when(F.col("_upto") >= F.col("_high"), v))
    return ranked.groupBy(*keys).agg((0.5 * low + 0.5 * high).alias("_v"))  # as the built-in percentile


def _at_least(v: Column, bound: Column) -> Column:
    return bound.isNull() | (v >= bound)


def _at_most(v: Column, bound: Column) -> Column:
    return bound.isNull() | (v <= bound)
