"""Stretches in which several variables are stuck at once: a sweep over the ends of runs.

Every run of a variable leaves two marks on the common row numbers, +1 where it starts and
-1 behind its end.  The running total of the marks is the number of variables stuck at a
place, so the stretches with ``least_variables`` or more are found between marks.  Runs are
never compared with each other, and a run costs two rows however long it is.

Long tables are sorted and numbered once.  Runs are found in each batch of the sorted rows,
and only the outermost of a batch are stitched to their neighbours.  The sweep is done in
blocks of row numbers, where a run is cut at the blocks' bounds; again only the stretches
at a bound are stitched.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.types import BooleanType, DoubleType, LongType, StructField, StructType

from seriesmend.model import SeriesSpec, join_on_key
from seriesmend.operators.detect import _least_run, _readings, _stuck_runs
from seriesmend.plans.blocks import BLOCK, ROW_NUMBER, ROWS_PER_RANGE, Layout, number_rows, profile
from seriesmend.plans.staging import stage

POSITION = "_sm_at"
LEAST = "_sm_least"
FIRST, LAST = "_sm_first_", "_sm_last_"   # prefixes of the places of a run's first and last row


def coincident_runs(
    df: DataFrame,
    spec: SeriesSpec,
    least_variables: int,
    min_run_length: int = 6,
    tolerance: float = 0.0,
    across: tuple[str, ...] = ("variable",),
    layout: Layout = Layout(),
) -> DataFrame:
    """Maximal stretches of rows in which at least so many variables are stuck.

    ``df`` is the long form: ``across`` are the key columns that name a variable, and every
    variable has the same rows.  Columns: the other keys, ``start_*`` / ``end_*`` (order
    and tiebreak columns of the first and last row), ``points``.
    """
    return coincident_runs_each(df, spec, (least_variables,), min_run_length, tolerance, across, layout).drop("variables")


def coincident_runs_each(
    df: DataFrame,
    spec: SeriesSpec,
    least_variables: tuple[int, ...],
    min_run_length: int = 6,
    tolerance: float = 0.0,
    across: tuple[str, ...] = ("variable",),
    layout: Layout = Layout(),
) -> DataFrame:
    """The stretches for each of several numbers of variables, told apart by ``variables``;
    the runs are found once."""
    rest = tuple(k for k in spec.keys if k not in across)
    sizes = None if layout.mode == "plain" else profile(df, spec.keys)
    if sizes is None or (layout.mode == "auto" and sizes.largest <= layout.largest_plain):
        found = _between_marks(_runs(df, spec, min_run_length, tolerance), rest, least_variables)
    else:
        block_rows = layout.rows_per_block(0)
        found = _over_blocks(
            _runs_of_sorted(df, spec, min_run_length, tolerance, sizes.rows), rest, least_variables, block_rows)
    shown = tuple(dict.fromkeys((*spec.order_by, *spec.tiebreak)))
    return found.select(
        F.col(LEAST).alias("variables"),
        *rest,
        *[F.col(f"begin.{c}").alias(f"start_{c}") for c in shown],
        *[F.col(f"end.{c}").alias(f"end_{c}") for c in shown],
        (F.col("until") - F.col("from")).alias("points"),
    )


def _runs(df: DataFrame, spec: SeriesSpec, min_run_length: int, tolerance: float) -> DataFrame:
    """Keys, ``first`` and ``last`` row number within the series, ``begin`` and ``end`` place."""
    rows = _stuck_runs(df, spec, tolerance, Layout("plain"))
    place = F.struct(*[F.col(c) for c in dict.fromkeys((*spec.order_by, *spec.tiebreak))])
    at, length = F.col(ROW_NUMBER), F.col("_length")
    is_first, is_last = at == F.col("_run"), at == F.col("_run") + length - 1
    runs = rows.filter((length >= _least_run(min_run_length)) & (is_first | is_last)).groupBy(*spec.keys, "_run").agg(
        F.max("_length").alias("_length"), F.max(F.when(is_first, place)).alias("begin"), F.max(F.when(is_last, place)).alias("end"))
    first = F.col("_run") - 1
    return runs.select(*spec.keys, first.alias("first"), (first + F.col("_length") - 1).alias("last"), "begin", "end")


def _between_marks(runs: DataFrame, parts: tuple[str, ...], least_variables: tuple[int, ...]) -> DataFrame:
    """``parts``, the number of variables, ``from`` and ``until`` position, ``begin`` and ``end`` place."""
    marks = runs.select(*parts, F.inline(F.array(
        F.struct(F.col("first").alias(POSITION), F.lit(1).alias("step"), F.col("begin").alias("place")),
        F.struct((F.col("last") + 1).alias(POSITION), F.lit(-1).alias("step"), F.col("end").alias("place")),
    )))
    place = lambda sign: F.max(F.when(F.col("step") == sign, F.col("place")))
    if parts:   # one shuffle for the sums and the windows
        marks = marks.repartition(*parts)
    per_position = marks.groupBy(*parts, POSITION).agg(
        F.sum("step").alias("step"), place(1).alias("begin"), place(-1).alias("end")).filter("step <> 0")
    upto = Window.partitionBy(*parts).orderBy(POSITION).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    totals = per_position.withColumn("total", F.sum("step").over(upto))
    before, total = F.col("total") - F.col("step"), F.col("total")
    # an opening and the closing behind it take turns
    crossed = F.array_compact(F.array(*[
        F.when((before < k) != (total < k), F.lit(k)) for k in dict.fromkeys(least_variables)]))
    edges = totals.select("*", F.explode(crossed).alias(LEAST))
    following = lambda c: F.lead(c).over(Window.partitionBy(*parts, LEAST).orderBy(POSITION))
    both = edges.withColumns({"until": following(POSITION), "_sm_end": following("end")})
    return both.filter(total >= F.col(LEAST)).select(
        *parts, LEAST, F.col(POSITION).alias("from"), "until", "begin", F.col("_sm_end").alias("end"))


# --- long tables ---------------------------------------------------------------


def _runs_of_sorted(df: DataFrame, spec: SeriesSpec, min_run_length: int, tolerance: float, rows: int) -> DataFrame:
    """As ``_runs``, from batches of the sorted rows."""
    least, tolerance = _least_run(min_run_length), float(tolerance)
    shown = list(dict.fromkeys((*spec.order_by, *spec.tiebreak)))
    shuffles = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    numbered = number_rows(_readings(df, spec), spec, max(shuffles, math.ceil(rows / ROWS_PER_RANGE)))
    keys, kinds = list(spec.keys), numbered.schema
    longs, doubles = [("first", LongType()), ("last", LongType())], [("v_first", DoubleType()), ("v_last", DoubleType())]
    schema = StructType([
        *[kinds[k] for k in keys],
        *[StructField(n, t) for n, t in (*longs, *doubles, ("outer", BooleanType()))],
        *[StructField(f"{end}{c}", kinds[c].dataType) for end in (FIRST, LAST) for c in shown],
    ])

    def find(batches):
        for batch in batches:
            if batch.num_rows:
                yield from _segments(batch, keys, shown, least, tolerance).to_batches()

    segments = stage(numbered.select(*dict.fromkeys((*keys, *shown)), ROW_NUMBER, "_v").mapInArrow(find, schema))
    place = lambda end: F.struct(*[F.col(f"{end}{c}").alias(c) for c in shown])
    segments = segments.select(*keys, *[n for n, _ in (*longs, *doubles)], "outer", place(FIRST).alias("begin"), place(LAST).alias("end"))
    outer = segments.filter("outer")
    along = Window.partitionBy(*keys).orderBy("first")
    goes_on = (F.col("first") == F.lag("last").over(along) + 1) & (
        F.abs(F.col("v_first") - F.lag("v_last").over(along)) <= tolerance)
    begun = outer.withColumn("_sm_run", F.when(F.coalesce(goes_on, F.lit(False)), None).otherwise(F.col("first")))
    stitched = begun.withColumn("_sm_run", F.max("_sm_run").over(along.rowsBetween(Window.unboundedPreceding, 0))).groupBy(
        *keys, "_sm_run").agg(
        F.min("first").alias("first"), F.max("last").alias("last"),
        F.min_by("begin", "first").alias("begin"), F.max_by("end", "last").alias("end"),
    ).filter(F.col("last") - F.col("first") + 1 >= least).drop("_sm_run")
    whole = segments.filter("NOT outer").select(*keys, "first", "last", "begin", "end")
    # row numbers run through all series: a series' own begin where its first batch does
    offsets = outer.groupBy(*keys).agg(F.min("first").alias("_sm_offset"))
    runs = join_on_key(whole.unionByName(stitched), offsets, spec.keys)
    return runs.select(
        *keys, *[(F.col(c) - F.col("_sm_offset")).alias(c) for c in ("first", "last")], "begin", "end")


def _segments(batch: pa.RecordBatch, keys: list[str], shown: list[str], least: int, tolerance: float) -> pa.Table:
    """The runs inside a batch, of ``least`` rows and more; all that touch either end of the
    rows of a series in it, which may go on in another batch, are kept and marked ``outer``."""
    rows = pa.Table.from_batches([batch])
    at = rows.column(ROW_NUMBER).to_numpy()
    if (np.diff(at) < 0).any():
        order = np.argsort(at, kind="stable")
        rows, at = rows.take(pa.array(order)), at[order]
    v = rows.column("_v").to_numpy()   # missing readings become NaN
    apart = np.diff(at) != 1
    for k in keys:
        apart |= ~_same_as_before(rows.column(k).combine_chunks())
    with np.errstate(invalid="ignore"):
        same = (np.abs(np.diff(v)) <= tolerance) & ~apart
    first = np.flatnonzero(np.concatenate([[True], ~same]))
    last = np.append(first[1:], len(at)) - 1
    begins, ends = np.concatenate([[True], apart])[first], np.concatenate([apart, [True]])[last]
    outer = begins | ends
    kept = outer | (last - first + 1 >= least)
    first, last, outer = first[kept], last[kept], outer[kept]
    heads, tails = rows.take(pa.array(first)), rows.take(pa.array(last))
    columns = {k: heads.column(k) for k in keys}
    columns |= {"first": pa.array(at[first]), "last": pa.array(at[last])}
    columns |= {"v_first": heads.column("_v"), "v_last": tails.column("_v"), "outer": pa.array(outer)}
    columns |= {f"{FIRST}{c}": heads.column(c) for c in shown} | {f"{LAST}{c}": tails.column(c) for c in shown}
    return pa.table(columns)


def _same_as_before(values: pa.Array) -> np.ndarray:
    """Whether each value but the first is the one before it; missing ones are equal, as are NaNs."""
    if pa.types.is_nested(values.type) or pa.types.is_floating(values.type):
        plain = [repr(x + 0.0) if isinstance(x, float) else x for x in values.to_pylist()]
        return np.array([a == b for a, b in zip(plain, plain[1:])], dtype=bool)
    missing = values.is_null().to_numpy(zero_copy_only=False)
    equal = pc.fill_null(pc.equal(values[1:], values[:-1]), False).to_numpy(zero_copy_only=False)
    return equal | (missing[1:] & missing[:-1])


def _over_blocks(runs: DataFrame, rest: tuple[str, ...], least_variables: tuple[int, ...], block_rows: int) -> DataFrame:
    """As ``_between_marks``, in blocks of row numbers.

    The runs of a variable do not meet, so cutting adds at most one of each to a block.
    """
    block = lambda c: F.expr(f"{c} DIV {block_rows}")
    cut = runs.select("*", F.explode(F.sequence(block("first"), block("last"))).alias(BLOCK))
    low, high = F.col(BLOCK) * block_rows, (F.col(BLOCK) + 1) * block_rows
    cut = cut.select(
        *rest, BLOCK, F.greatest("first", low).alias("first"), F.least(F.col("last"), high - 1).alias("last"),
        F.when(F.col("first") >= low, F.col("begin")).alias("begin"), F.when(F.col("last") < high, F.col("end")).alias("end"))
    found = stage(_between_marks(cut, (*rest, BLOCK), least_variables)).drop(BLOCK)
    at_bound = (F.col("from") % block_rows == 0) | (F.col("until") % block_rows == 0)
    along = Window.partitionBy(*rest, LEAST).orderBy("from")
    goes_on = F.coalesce(F.col("from") == F.lag("until").over(along), F.lit(False))
    begun = found.filter(at_bound).withColumn("_sm_run", F.when(~goes_on, F.col("from")))
    stitched = begun.withColumn("_sm_run", F.max("_sm_run").over(along.rowsBetween(Window.unboundedPreceding, 0))).groupBy(
        *rest, LEAST, "_sm_run").agg(
        F.min("from").alias("from"), F.max("until").alias("until"),
        F.min_by("begin", "from").alias("begin"), F.max_by("end", "until").alias("end"),
    ).drop("_sm_run")
    return found.filter(~at_bound).unionByName(stitched)
