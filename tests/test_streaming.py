import datetime
import random

import pytest

from seriesmend.model import SeriesSpec
from seriesmend.operators.correct import correct
from seriesmend.operators.detect import frozen_runs
from seriesmend.streaming.frozen import _Run, current_runs, run_stream, stream_runs

SPEC = SeriesSpec(("s",), ("ts",), ("i",), "v")
START = datetime.datetime(2024, 1, 1)
SCHEMA = "s string, ts timestamp_ntz, i long, v double"


def rows(df):
    return sorted(map(str, df.collect()))


def some_rows(first, last, seed, late=0):
    """Readings of minutes [first, last), some with gaps, in any order."""
    rng = random.Random(seed)
    out = []
    for i in range(first, last):
        v = rng.choices([1.0, 2.0, None, float("nan")], [8, 3, 1, 1])[0]
        out.append((rng.choice(["a", None]), START + datetime.timedelta(minutes=i - late * (i % 3 == 0)), i, v))
    rng.shuffle(out)
    return out


class Feed:
    """A folder of arriving files and a query over it."""

    def __init__(self, spark, folder):
        self.spark, self.folder, self.seen = spark, str(folder), []

    def arrive(self, some):
        self.spark.createDataFrame(some, SCHEMA).coalesce(1).write.mode("append").parquet(f"{self.folder}/in")
        self.seen += some

    def run(self, change=lambda df: df):
        stream = self.spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{self.folder}/in")
        runs = stream_runs(change(stream), SPEC, "30 minutes", 2, 0.0)
        run_stream(runs, f"{self.folder}/out", f"{self.folder}/state")
        return current_runs(self.spark.read.parquet(f"{self.folder}/out"), SPEC)

    def batch(self, change=lambda df: df):
        return frozen_runs(change(self.spark.createDataFrame(self.seen, SCHEMA)), SPEC, 2, 0.0)


def test_the_stream_equals_the_batch_with_late_rows_and_after_a_restart(spark, tmp_path):
    feed = Feed(spark, tmp_path)
    feed.arrive(some_rows(0, 60, 1))
    feed.arrive(some_rows(60, 100, 2, late=20))      # into stretches that had been seen
    assert rows(feed.run()) == rows(feed.batch())
    feed.arrive(some_rows(100, 160, 3, late=25))
    assert rows(feed.run()) == rows(feed.batch())    # from the checkpoint
    assert rows(feed.run()) == rows(feed.batch())    # nothing new
    written = spark.read.parquet(f"{tmp_path}/out")
    assert written.filter("closed").count() > 0
    # a run that ends before the watermark is written as closed once
    closed = written.filter("closed")
    assert closed.count() == closed.select("s", "start_at", "start_tie").distinct().count()


def test_rows_later_than_the_delay_are_left_out(spark, tmp_path):
    feed = Feed(spark, tmp_path)
    feed.arrive([("a", START + datetime.timedelta(minutes=m), m, 1.0) for m in range(200)])
    feed.arrive([("a", START + datetime.timedelta(minutes=300), 300, 2.0)])
    before = rows(feed.run())
    seen = list(feed.seen)
    feed.arrive([("a", START + datetime.timedelta(minutes=5, seconds=1), 999, 7.0)])   # would split a run
    assert rows(feed.run()) == before
    feed.seen = seen
    assert before == rows(feed.batch())


def test_a_correction_runs_on_the_stream(spark, tmp_path):
    change = lambda df: correct(df, SPEC, "threshold", {"max": 1.5, "action": "replace", "replace_value": 1.0})
    feed = Feed(spark, tmp_path)
    feed.arrive(some_rows(0, 40, 5))
    feed.arrive(some_rows(40, 80, 6))
    assert rows(feed.run(change)) == rows(feed.batch(change))


def test_runs_go_on_from_stored_fields():
    run = _Run(0.5)
    assert [run.add(n, 0, v) for n, v in enumerate([1.0, 1.4, 1.8, 3.0, None, None])] == [
        None, None, None, (0, 0, 2, 0, 3), (3, 0, 3, 0, 1), (4, 0, 4, 0, 1)]
    again = _Run(0.5, (*run.start, *run.last, run.value, run.length))
    assert again.add(6, 0, 2.0) == run.copy().add(6, 0, 2.0) == (5, 0, 5, 0, 1)


def test_orders_a_stream_cannot_have(spark):
    with pytest.raises(ValueError, match="at most one"):
        stream_runs(spark.createDataFrame([], SCHEMA), SeriesSpec((), ("ts",), ("i", "s"), "v"), "1 hour")
