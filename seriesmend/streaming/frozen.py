"""Stuck values on a stream: what ``frozen_runs`` finds, kept up to date as readings arrive.

Readings may come late by up to ``delay``.  Per series, the state holds the run that is
open at the watermark and the readings behind it, which can still be joined by late ones.
When the watermark passes readings, they enter the run for good; a run that ends there is
written as closed.  What the readings behind the watermark amount to is written as well,
as *provisional* runs with the version of their series; a later version replaces them.
``current_runs`` reads the closed runs and the newest provisional ones, which together are
the runs of all readings seen so far.

The state is bounded by the readings of one delay and series.  It lives in the query's
checkpoint, so a restarted query goes on where it was.  Readings later than the delay are
left out by the engine.  Corrections (but for those that summarise a selection) are plain
projections and can be applied to the stream before.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupStateTimeout

from seriesmend.functions import ieee
from seriesmend.model import SeriesSpec
from seriesmend.operators.detect import _least_run

RUN_STATE = (
    "version long, start_at long, start_tie long, last_at long, last_tie long, last_value double, length long, "
    "times array<long>, ties array<long>, readings array<double>"
)
RUNS = "version long, closed boolean, start_at long, start_tie long, end_at long, end_tie long, points long"


class _Run:
    """The run a series is in; ``add`` gives the run that ended, if one did."""

    def __init__(self, tolerance: float, fields=None):
        self.tolerance = tolerance
        self.start = self.last = self.value = None
        self.length = 0
        if fields and fields[5]:
            self.start, self.last, self.value, self.length = fields[:2], fields[2:4], fields[4], fields[5]

    def copy(self) -> "_Run":
        other = _Run(self.tolerance)
        other.start, other.last, other.value, other.length = self.start, self.last, self.value, self.length
        return other

    def add(self, at: int, tie: int, value: float | None) -> tuple | None:
        same = (
            self.length and self.value is not None and value is not None
            and abs(value - self.value) <= self.tolerance
        )
        ended = None if same or not self.length else self.row()
        if not same:
            self.start, self.length = (at, tie), 0
        self.last, self.value, self.length = (at, tie), value, self.length + 1
        return ended

    def row(self) -> tuple:
        return (*self.start, *self.last, self.length)


def stream_runs(
    readings: DataFrame, spec: SeriesSpec, delay: str, min_run_length: int = 6, tolerance: float = 0.0
) -> DataFrame:
    """Closed and provisional runs of a streaming frame, to append to a table.

    ``spec`` orders by one time column and at most one whole-number tiebreak.  Readings
    without a time are left out.  ``delay`` is how late a reading may be ("2 hours").
    """
    if len(spec.order_by) != 1 or len(spec.tiebreak) > 1:
        raise ValueError("a stream is ordered by a time and at most one tiebreak")
    least, keys = _least_run(min_run_length), list(spec.keys)
    tie = F.col(spec.tiebreak[0]) if spec.tiebreak else F.lit(0)
    time = F.col(spec.order_by[0]).cast("timestamp")
    rows = readings.select(
        *keys, time.alias("at"), tie.cast("long").alias("tie"),
        ieee.to_missing(F.col(spec.value).cast("double")).alias("value"),
    ).filter("at IS NOT NULL").withWatermark("at", delay).withColumn("micros", F.unix_micros("at"))
    output = T.StructType([readings.schema[k] for k in keys])
    for field in _fields(readings.sparkSession, RUNS):
        output.add(field)

    def advance(key, frames, state):
        fields = state.get if state.exists else (0, 0, 0, 0, 0, None, 0, [], [], [])
        version = fields[0] + 1
        run = _Run(tolerance, fields[1:7])
        held = list(zip(fields[7], fields[8], fields[9]))
        for frame in frames:
            values = (None if v is None or math.isnan(v) else v for v in frame["value"])
            held += zip(frame["micros"].tolist(), frame["tie"].tolist(), values)
        held.sort(key=lambda r: r[:2])
        watermark = state.getCurrentWatermarkMs() * 1000
        settled = [r for r in held if r[0] <= watermark]
        held = held[len(settled):]
        found = [(True, ended) for r in settled if (ended := run.add(*r)) and ended[4] >= least]
        ahead = run.copy()
        open_ = [ended for r in held if (ended := ahead.add(*r))] + ([ahead.row()] if ahead.length else [])
        provisional = [(False, r) for r in open_ if r[4] >= least]
        found += provisional or [(False, (None, None, None, None, 0))]   # that there is none
        start, last = run.start or (0, 0), run.last or (0, 0)
        state.update((
            version, *start, *last, run.value, run.length,
            [r[0] for r in held], [r[1] for r in held], [r[2] for r in held],
        ))
        if held:
            state.setTimeoutTimestamp(max(held[0][0] // 1000 + 1, state.getCurrentWatermarkMs() + 1))
        columns = list(zip(*[(*key, version, closed, *row) for closed, row in found]))
        yield pd.DataFrame({f.name: pd.Series(c, dtype=_pandas(f.dataType)) for f, c in zip(output.fields, columns)})

    return rows.groupBy(*keys).applyInPandasWithState(
        advance, output, T.StructType(_fields(readings.sparkSession, RUN_STATE)), "append",
        GroupStateTimeout.EventTimeTimeout)


def _fields(spark: SparkSession, ddl: str) -> list[T.StructField]:
    return spark.createDataFrame([], ddl).schema.fields


def _pandas(kind: T.DataType) -> str:
    return {"bigint": "Int64", "boolean": "boolean"}.get(kind.simpleString(), "object")


def run_stream(runs: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append all that has arrived to the parquet table at ``path``, and stop.

    Both folders belong to the query: a later call with the same ones goes on from there.
    """
    query = runs.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint).trigger(
        availableNow=True).start(path)
    query.awaitTermination()
    return query


def current_runs(written: DataFrame, spec: SeriesSpec) -> DataFrame:
    """The runs of all readings the stream has seen, as ``frozen_runs`` gives them."""
    newest = written.groupBy(*spec.keys).agg(F.max("version").alias("newest"))
    joined = written.alias("w").join(
        newest.alias("n"), [F.col(f"w.{k}").eqNullSafe(F.col(f"n.{k}")) for k in spec.keys])
    kept = joined.filter("points > 0 AND (closed OR version = newest)")
    at = lambda c: F.timestamp_micros(c).cast("timestamp_ntz")
    places = []
    for edge in ("start", "end"):
        places.append(at(f"{edge}_at").alias(f"{edge}_{spec.order_by[0]}"))
        places += [F.col(f"{edge}_tie").alias(f"{edge}_{t}") for t in spec.tiebreak]
    return kept.select(*[F.col(f"w.{k}") for k in spec.keys], *places, "points")
