import datetime
import math
import random

import pytest
from pyspark.sql import functions as F

from seriesmend.model import SeriesSpec
from seriesmend.operators.pyramid import FAN, PeakPyramid, level_for, peak_pyramid
from seriesmend.operators.view import downsample_peak

SPEC = SeriesSpec(("s",), ("ts",), ("i",), "v")
START = datetime.datetime(2024, 1, 1)
EPOCH = 1704067200.0


@pytest.fixture(scope="module")
def readings(spark):
    rng = random.Random(3)
    rows = []
    for i in range(3000):
        v = rng.choices([round(rng.gauss(0, 3), 1), None, math.nan, math.inf, -math.inf], [50, 1, 1, 1, 1])[0]
        at = START + datetime.timedelta(seconds=rng.randrange(400_000)) if rng.random() > 0.01 else None
        rows.append((rng.choice(["a", "b", None]), at, i, v))
    return spark.createDataFrame(rows, "s string, ts timestamp_ntz, i long, v double").cache()


@pytest.fixture(scope="module")
def pyramid(readings):
    return peak_pyramid(readings, SPEC, "ts", 60.0)


def rows(df):
    return sorted(map(str, df.collect()))


def test_every_level_has_the_peaks_of_its_buckets(readings, pyramid):
    assert len(pyramid.levels) == 4
    for level in range(len(pyramid.levels)):
        shown = pyramid.view(0, 4e9, 0 if level else 1) if level == 3 else None
        plain = downsample_peak(readings, SPEC, "ts", pyramid.width(level))
        whole = PeakPyramid(SPEC, pyramid.base_seconds, pyramid.levels[level: level + 1])
        assert rows(whole.view(0, 4e9).drop("level")) == rows(plain)
        if shown is not None:
            assert rows(shown.drop("level")) == rows(plain)
        there = readings.filter("ts IS NOT NULL AND v IS NOT NULL AND NOT isnan(v)").count()
        assert pyramid.counts(level).agg(F.sum("n")).first()[0] == there


@pytest.mark.parametrize("x0, x1, points", [(EPOCH, EPOCH + 400_000, 50), (EPOCH + 5000, EPOCH + 9000, 100), (EPOCH + 90_000, EPOCH + 30_000, 1200)])
def test_a_view_reads_one_level_and_few_rows(pyramid, x0, x1, points):
    view = pyramid.view(x0, x1, points)
    level = level_for(min(x0, x1), max(x0, x1), points, 60.0)
    of_level = set(pyramid.levels[level].inputFiles())
    assert set(view.inputFiles()) <= of_level and {r["level"] for r in view.collect()} == {level}
    for r in view.groupBy("s").count().collect():
        assert r["count"] <= 2 * (points + 2)
    plan = view._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters" in plan and "GreaterThanOrEqual(bucket" in plan and "Exchange" not in plan
    width = pyramid.width(level)
    assert all(math.floor(min(x0, x1) / width) <= r["bucket"] <= math.floor(max(x0, x1) / width) for r in view.collect())


def test_levels_are_the_finest_that_fit():
    assert level_for(0, 6000, 100, 60.0) == 0
    assert level_for(0, 6001, 100, 60.0) == 1
    assert level_for(0, 60.0 * FAN**3 * 10, 10, 60.0) == 3
    assert level_for(5, 5, 1, 60.0) == 0


def test_equal_peaks_and_no_readings(spark):
    rows_ = [("a", START, i, 1.0) for i in range(5)] + [("b", START, 9, None), ("c", None, 10, 2.0)]
    df = spark.createDataFrame(rows_, "s string, ts timestamp_ntz, i long, v double")
    got = peak_pyramid(df, SPEC, "ts", 1.0).view(EPOCH - 1, EPOCH + 1).collect()
    assert [(r["s"], r["peak"], r["i"]) for r in sorted(got, key=lambda r: r["peak"])] == [("a", "max", 0), ("a", "min", 0)]
    empty = peak_pyramid(df.limit(0), SPEC, "ts", 1.0)
    assert len(empty.levels) == 1 and empty.view(0, 1e10).count() == 0
    with pytest.raises(ValueError, match="positive"):
        peak_pyramid(df, SPEC, "ts", 0.0)
