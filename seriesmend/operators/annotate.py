"""Which annotation covers a reading: the first one in file order.

Readings never meet every annotation.  The annotations are first swept into
disjoint stretches of time, each with its first covering annotation, so that a
reading matches at most one stretch.  For the sweep the time axis is cut into
ranges with about equally many ends of annotations.  An annotation goes to the
range it begins in and the one it ends in; of those that cover a whole range only
the first one is kept, so long and nested periods do not multiply.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import LongType, StructField, StructType

from seriesmend.model import SeriesSpec
from seriesmend.plans.blocks import ROW_NUMBER, ROWS_PER_RANGE, Layout, as_blocks, last_seen, number_rows
from seriesmend.plans.staging import stage
from seriesmend.sources.timeaxis import epoch_micros

FEW_STRETCHES = 100_000    # stretches that may be broadcast
FEW_BYTES = 16 * 2**20     # and the size of what they carry, which the driver holds several times
SEGMENTS = 16              # parts of the time axis with equally many stretches
ENDS_PER_RANGE = 50_000    # ends of annotations that one range of the sweep holds

NONE = np.iinfo(np.int64).max   # the number of no annotation


def covered_stretches(
    annotations: DataFrame,
    order: tuple[str, ...],
    payload: tuple[str, ...],
    tolerance_s: float = 0.0,
    ends_per_range: int = ENDS_PER_RANGE,
) -> DataFrame:
    """``at`` (microseconds) and ``hit``: the first annotation from there on, or NULL.

    ``annotations`` comes from ``annotation_geometry``.  An instant covers
    ``tolerance_s`` on both sides, a period its bounds; all inclusive.
    """
    slack = F.when(F.col("shape") == "instant", F.lit(int(tolerance_s * 1e6))).otherwise(0)
    # written once: times may be parsed from texts
    spans = stage(annotations.select(
        (epoch_micros(F.col("lo")) - slack).cast("long").alias("_from"),
        (epoch_micros(F.col("hi")) + slack + 1).cast("long").alias("_to"),
        F.struct(
            F.struct(*order).alias("rank"), F.struct(*payload).alias("what")
        ).alias("_candidate"),
    )).filter(F.col("_from") < F.col("_to"))
    what = spans.schema["_candidate"].dataType["what"].dataType
    out = StructType([StructField("at", LongType()), StructField("hit", what)])
    count = spans.count()
    if count == 0:
        return spans.sparkSession.createDataFrame([], out)
    bounds = _range_bounds(spans, math.ceil(2 * count / ends_per_range))
    ranges = len(bounds) - 1
    shuffles = int(spans.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # numbers in the order of the candidates, which all that follows compares
    numbered = number_rows(
        spans, SeriesSpec((), ("_candidate",)), max(shuffles, math.ceil(count / ROWS_PER_RANGE))
    ).select("_from", "_to", F.col(ROW_NUMBER).alias("_no"), F.col("_candidate.what").alias("hit"))
    longs = [StructField(n, LongType()) for n in ("_range", "_from", "_to", "_no")]
    dealt_schema = StructType([*longs, StructField("hit", what)])

    def deal(batches):
        best = np.full(ranges, NONE)
        for batch in batches:
            yield from _dealt(pa.Table.from_batches([batch]), bounds, best)

    def sweep(group: pa.Table) -> pa.Table:
        return _swept(group, bounds)

    dealt = numbered.mapInArrow(deal, dealt_schema)
    # every range says what it begins with, also one without annotations
    every = spans.sparkSession.range(ranges).select(
        F.col("id").alias("_range"), *[F.lit(None).cast(f.dataType).alias(f.name) for f in dealt_schema[1:]])
    return dealt.unionByName(every).groupBy("_range").applyInArrow(sweep, out)


def _range_bounds(spans: DataFrame, ranges: int) -> np.ndarray:
    """Bounds of ranges with about equally many ends of spans, first and last end included.

    A crowded time is a range of its own, which whatever begins or ends there covers
    as a whole or not at all.
    """
    steps = F.array(*[F.lit(i / ranges) for i in range(ranges + 1)])
    ends = spans.select(F.explode(F.array("_from", "_to")).alias("at"))
    row = ends.agg(
        F.min("at"), F.max("at"), F.percentile_approx("at", steps, F.lit(max(20 * ranges, 1000)))
    ).first()
    low, high, places = row
    crowded = [a + 1 for a, b in zip(places, places[1:]) if a == b and a < high]
    return np.unique(np.array([low, high, *places, *crowded], dtype=np.int64))


def _lowest(first: np.ndarray, end: np.ndarray, numbers: np.ndarray, places: int) -> np.ndarray:
    """The lowest number over each of so many places; ``numbers[i]`` lies on [first, end) of them.

    Every stretch is covered by two of a power of two, which overlap; those are handed
    down from the longest to single places.
    """
    some = end > first
    first, end, numbers = first[some], end[some], numbers[some]
    level = np.frexp((end - first).astype(np.float64))[1] - 1   # floor(log2(length))
    lowest = np.full(places, NONE)
    for k in range(int(level.max(initial=0)), -1, -1):
        here = level == k
        np.minimum.at(lowest, first[here], numbers[here])
        np.minimum.at(lowest, end[here] - (1 << k), numbers[here])
        if k:   # from stretches of 2**k to their two halves
            half = 1 << (k - 1)
            halves = lowest.copy()
            np.minimum(halves[half:], lowest[:-half], out=halves[half:])
            lowest = halves
    return lowest


def _dealt(spans: pa.Table, bounds: np.ndarray, best: np.ndarray):
    """Rows of the ranges in which spans begin or end, and of ranges covered as a whole by
    a span before the ``best`` one so far, which is updated."""
    start, end, number = (spans.column(c).to_numpy() for c in ("_from", "_to", "_no"))
    first = np.searchsorted(bounds, start, "right") - 1
    last = np.searchsorted(bounds, end - 1, "right") - 1
    from_low, to_high = start == bounds[first], end == bounds[last + 1]
    begins = ~from_low | ((first == last) & ~to_high)
    ends = (first < last) & ~to_high
    lowest = _lowest(first + ~from_low, last + to_high, number, len(best))
    better = np.flatnonzero(lowest < best)
    best[better] = lowest[better]
    # numbers are unique: the row that has one
    by_number = np.argsort(number, kind="stable")
    whole = by_number[np.searchsorted(number[by_number], lowest[better])]
    row = np.concatenate([np.flatnonzero(begins), np.flatnonzero(ends), whole])
    place = np.concatenate([first[begins], last[ends], better])
    columns = [
        place, np.maximum(start[row], bounds[place]), np.minimum(end[row], bounds[place + 1]), number[row],
    ]
    hits = spans.column("hit").combine_chunks().take(pa.array(row))
    dealt = pa.table([*map(pa.array, columns), hits], names=["_range", "_from", "_to", "_no", "hit"])
    yield from dealt.to_batches()


def _swept(group: pa.Table, bounds: np.ndarray) -> pa.Table:
    """The stretches of one range, each with its first annotation."""
    place = group.column("_range")[0].as_py()
    low, high = bounds[place], bounds[place + 1]
    spans = group.filter(group.column("_no").is_valid())
    start, end, number = (spans.column(c).to_numpy() for c in ("_from", "_to", "_no"))
    at = np.unique(np.concatenate([[low], start, end]))
    at = at[at < high]
    # the places of the spans in the order of their numbers
    order = np.argsort(number, kind="stable")
    lowest = _lowest(
        np.searchsorted(at, start[order]), np.searchsorted(at, end[order]), np.arange(len(order)), len(at))
    changes = np.concatenate([[True], lowest[1:] != lowest[:-1]])
    at, lowest = at[changes], lowest[changes]
    if place == len(bounds) - 2:   # nothing is covered behind the last range
        at, lowest = np.append(at, high), np.append(lowest, NONE)
    none = lowest == NONE
    row = np.zeros(len(at), dtype=np.int64)
    row[~none] = order[lowest[~none]]
    hits = spans.column("hit").combine_chunks().take(pa.array(row, mask=none))
    return pa.table([pa.array(at), hits], names=["at", "hit"])


def annotate_first(
    readings: DataFrame,
    annotations: DataFrame,
    x: str,
    order: tuple[str, ...],
    payload: tuple[str, ...],
    tolerance_s: float = 0.0,
    keep: tuple[str, ...] | None = None,
    layout: Layout = Layout(),
    few: int = FEW_STRETCHES,
) -> DataFrame:
    """``keep`` columns of every reading (default: all), plus ``payload`` of its annotation.

    Few stretches: broadcast them, found by time slot.  Otherwise readings and
    stretches are merged in time order and the current stretch is carried along.
    """
    shown = tuple(readings.columns) if keep is None else keep
    stretches = stage(covered_stretches(annotations, order, payload, tolerance_s))
    size = stretches.agg(
        F.count(F.lit(1)).alias("n"),
        F.min("at").alias("low"),
        F.max("at").alias("high"),
        F.coalesce(F.sum(F.octet_length(F.to_json("hit"))), F.lit(0)).alias("bytes"),
    ).first()
    if size["n"] == 0:
        kinds = stretches.schema["hit"].dataType
        return readings.select(*shown, *[F.lit(None).cast(kinds[p].dataType).alias(p) for p in payload])
    timed = readings.select(*shown, epoch_micros(F.col(x)).alias("_at"))
    if size["n"] <= few and size["bytes"] <= FEW_BYTES:
        slot = _slots(stretches, size["n"])
        matched = timed.withColumn("_slot", slot("_at")).join(
            F.broadcast(_by_slot(stretches, slot)),
            (F.col("_slot") == F.col("_s"))
            & (F.col("_at") >= F.col("at"))
            & (F.col("_at") < F.col("_until")),
            "left",
        )
        return matched.select(*shown, *[F.col(f"hit.{p}").alias(p) for p in payload])
    return _carried_along(timed, stretches, shown, payload, layout)


def _slots(stretches: DataFrame, count: int):
    """A function from time to slot number, increasing with time.

    The axis is cut into segments with equally many stretches, and each segment into
    slots of equal width, about as many as it has stretches.  A few stretches far
    away from the others only widen the slots of their own segment.
    """
    steps = F.array(*[F.lit(i / SEGMENTS) for i in range(SEGMENTS + 1)])
    bounds = sorted(set(stretches.agg(F.percentile_approx("at", steps, F.lit(20 * SEGMENTS))).first()[0]))
    per_segment = max(math.ceil(count / SEGMENTS), 1)
    segments, first = [], 0   # (from, width, slots, number of the first slot)
    for low, high in zip(bounds, bounds[1:] + [bounds[-1] + 1]):
        width = max((high - low) // per_segment, 1)
        slots = max(math.ceil((high - low) / width), 1)
        segments.append((low, width, slots, first))
        first += slots

    def slot(at: str) -> Column:
        def within(some: list) -> str:   # a balanced tree of comparisons
            if len(some) == 1:
                low, width, slots, begin = some[0]
                return f"least(greatest(floor(({at} - {low}L) / {width}L), 0), {slots - 1}) + {begin}"
            middle = len(some) // 2
            return f"CASE WHEN {at} < {some[middle][0]}L THEN {within(some[:middle])} ELSE {within(some[middle:])} END"

        return F.expr(within(segments)).cast("long")

    return slot


def _by_slot(stretches: DataFrame, slot) -> DataFrame:
    """Covered stretches with their end, repeated for every slot ``_s`` they touch.

    They are disjoint and slots about as many as they are, so the rows about double.
    """
    bounded = stretches.withColumn("_until", F.lead("at").over(Window.orderBy("at")))
    return bounded.filter(F.col("hit").isNotNull()).withColumn(
        "_s", F.explode(F.sequence(slot("at"), slot("(_until - 1)")))
    )


def _carried_along(timed, stretches, shown, payload, layout: Layout) -> DataFrame:
    marks = stretches.select(
        F.col("at").alias("_at"), F.lit(0).alias("_kind"), F.struct("hit").alias("_mark")
    )
    rows = timed.select(
        "_at",
        F.lit(1).alias("_kind"),
        F.monotonically_increasing_id().alias("_no"),
        F.struct(*shown).alias("_row"),
    )
    merged = marks.unionByName(rows, allowMissingColumns=True)
    # The mark comes first; readings of one time may come in any order, but they
    # need one so that a crowded time can be split.
    order = SeriesSpec((), ("_at",), ("_kind", "_no"))
    blocks = as_blocks(merged, order, layout=layout)
    carried = last_seen(blocks, "_mark", "_current").filter(F.col("_kind") == 1)
    covered = F.when(F.col("_at").isNotNull(), F.col("_current.hit"))
    return carried.withColumn("_hit", covered).select(
        "_row.*", *[F.col(f"_hit.{p}").alias(p) for p in payload]
    )
