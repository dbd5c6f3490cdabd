import math
import random

import pytest

import models
from seriesmend import SeriesSpec
from seriesmend.operators.detect import (
    detect_frozen,
    detect_spikes,
    find_runs,
    first_difference,
    frozen_runs,
    rolling_median_mad,
)
from seriesmend.operators.detectors import (
    DETECTORS,
    Detector,
    detect,
    detect_and_correct,
    register_detector,
)
from seriesmend.plans import blocks
from seriesmend.plans.blocks import Layout, as_blocks
from pyspark.sql import functions as F

SPEC = SeriesSpec(("s",), ("t",), ("i",), "v")
ONE = SeriesSpec((), ("t",), ("i",), "v")
N = None
RISE = [10.0, 10.1, 10.2, 10.1, 25.0, 10.2, 10.3, 10.2, N, 10.4, 10.3, 10.5]
STUCK = [1.0, 1, 1, 2, 2, N, 2, 2, 2, 2, 3, 3.05, 3.1, 3.15]


def frame(spark, values, series="a"):
    rows = [(series, i, i, None if v is None else float(v)) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "s string, t long, i long, v double")


def scores(df):
    return {r["i"]: r["score"] for r in df.collect()}


@pytest.mark.parametrize(
    "values, window, expected",
    [
        (RISE, 4, {4: 49.912316, 5: 49.575071, 10: 3.0e8}),
        (RISE, 24, {3: 2.0e8, 4: 1.48e10, 5: 100.499122, 10: 3.0e8}),
        ([5, 5, 5, 5, 6, 6, 6, 6], 4, {4: 1.0e9}),
        ([1, 2, 100, 101, 102], 4, {2: 9.7e10}),
        ([1, 900], 4, {}),
        ([], 4, {}),
    ],
)
def test_known_spikes(spark, values, window, expected):
    found = scores(detect_spikes(frame(spark, values), SPEC, window, 4.0))
    assert found.keys() == expected.keys()
    for i, score in expected.items():
        assert found[i] == pytest.approx(score, rel=1e-2 if score > 1e6 else 1e-6)


@pytest.mark.parametrize(
    "values, least, tolerance, expected",
    [
        (STUCK, 3, 0.0, {**dict.fromkeys(range(3), 3), **dict.fromkeys(range(6, 10), 4)}),
        (STUCK, 4, 0.06, {**dict.fromkeys(range(6, 10), 4), **dict.fromkeys(range(10, 14), 4)}),
        ([1, 1, 2], 1, 0.0, {0: 2, 1: 2}),
        ([], 2, 0.0, {}),
    ],
)
def test_known_runs(spark, values, least, tolerance, expected):
    assert scores(detect_frozen(frame(spark, values), SPEC, least, tolerance)) == expected


def random_series(rng, n):
    steps = [0.0, 0.0, 0.1, -0.1, 1.0, 30.0]
    out, level = [], 10.0
    for _ in range(n):
        level += rng.choice(steps)
        out.append(rng.choices([level, None, math.nan, math.inf, -math.inf], [20, 1, 1, 1, 1])[0])
    return out


@pytest.fixture(scope="module")
def many(spark):
    """Series of length 0 to 40 with gaps and infinities, one of them long."""
    rng = random.Random(7)
    series = {f"s{n:02d}": random_series(rng, n) for n in [*range(0, 12), 25, 40, 150]}
    rows = [
        (s, i // 2, i, v) for s, values in series.items() for i, v in enumerate(values)
    ]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "s string, t long, i long, v double").cache()
    return series, df


LAYOUTS = [Layout("plain")] + [Layout("blocked", block_rows=b) for b in (1, 3, 7, 40, 10_000)]
# only series of more than 30 rows are cut
LAYOUTS.append(Layout(largest_plain=30, block_rows=4))


@pytest.mark.parametrize("layout", LAYOUTS, ids=str)
@pytest.mark.parametrize("window", [2, 9, 100])
def test_spikes_follow_the_definition(many, layout, window):
    series, df = many
    found = {
        (r["s"], r["i"]): r["score"] for r in detect_spikes(df, SPEC, window, 3.0, layout).collect()
    }
    expected = {
        (s, i): z for s, values in series.items() for i, z in models.spikes(values, window, 3.0).items()
    }
    assert found == pytest.approx(expected, rel=1e-12)


@pytest.mark.parametrize("layout", LAYOUTS, ids=str)
def test_runs_follow_the_definition(many, layout):
    series, df = many
    found = {(r["s"], r["i"]): r["score"] for r in detect_frozen(df, SPEC, 2, 0.1, layout).collect()}
    expected = {
        (s, i): n for s, values in series.items() for i, n in models.frozen(values, 2, 0.1).items()
    }
    assert found == expected


@pytest.mark.parametrize("layout", LAYOUTS, ids=str)
def test_one_run_through_many_blocks(spark, layout):
    values = [1.0] * 60 + [2.0] * 5 + [3.0] + [4.0] * 30
    df = frame(spark, values)
    runs = {
        (r["start_i"], r["end_i"]): r["points"] for r in frozen_runs(df, ONE, 2, 0.0, layout).collect()
    }
    assert runs == {(0, 59): 60, (60, 64): 5, (66, 95): 30}
    flagged = find_runs(df, ONE, F.col("v") >= 2, layout).collect()
    assert [(r["start_i"], r["end_i"], r["points"]) for r in flagged] == [(60, 95, 36)]


def rows(df):
    return sorted(map(str, df.collect()))


@pytest.mark.parametrize("layout", LAYOUTS[1:], ids=str)
def test_blocks_give_the_plain_result(many, layout):
    _, df = many
    for build in (
        lambda lay: first_difference(df, SPEC, lay),
        lambda lay: rolling_median_mad(df, SPEC, 6, lay),
        lambda lay: frozen_runs(df, SPEC, 2, 0.1, lay),
        lambda lay: find_runs(df, SPEC, F.col("v") > 20, lay),
        lambda lay: detect_and_correct(df, SPEC, "spike", "delete", {"window": 6}, layout=lay),
    ):
        assert rows(build(layout)) == rows(build(Layout("plain")))


def test_summaries_in_two_levels(many, monkeypatch):
    """Groups of two blocks: what is carried crosses groups, not only blocks."""
    monkeypatch.setattr(blocks, "BLOCKS_PER_GROUP", 2)
    test_blocks_give_the_plain_result(many, Layout("blocked", block_rows=3))
    test_blocks_give_the_plain_result(many, LAYOUTS[-1])


def test_short_series_are_not_sorted_by_range(spark):
    df = frame(spark, range(100)).unionAll(frame(spark, range(5), "b"))
    cut = as_blocks(df, SPEC, layout=Layout(largest_plain=50, block_rows=30))
    sizes = {(r["s"], r["_block"]): r["count"] for r in cut.df.groupBy("s", "_block").count().collect()}
    assert sizes == {("a", 0): 30, ("a", 1): 30, ("a", 2): 30, ("a", 3): 10, ("b", blocks.WHOLE): 5}


def test_null_times_come_last_in_both_layouts(spark):
    data = [("a", None, 1, 5.0), ("a", 2, 2, 1.0), ("a", 1, 3, 3.0), (None, 1, 4, 9.0)]
    df = spark.createDataFrame(data, "s string, t long, i long, v double")
    for layout in (Layout("plain"), Layout("blocked", block_rows=2)):
        found = {r["i"]: r["diff"] for r in first_difference(df, SPEC, layout).collect()}
        assert found == {3: None, 2: -2.0, 1: 4.0, 4: None}


def test_a_long_series_is_split_without_being_asked(spark):
    df = frame(spark, range(100))
    assert not as_blocks(df, SPEC).blocked
    split = as_blocks(df, SPEC, layout=Layout(largest_plain=50, block_rows=30))
    assert split.blocked
    sizes = {r["_block"]: r["count"] for r in split.df.groupBy("_block").count().collect()}
    assert sizes == {0: 30, 1: 30, 2: 30, 3: 10}


def test_detector_registry(spark):
    df = frame(spark, [1, 1, 1, 50])
    assert set(DETECTORS) >= {"spike", "freeze"}
    with pytest.raises(ValueError):
        detect(df, SPEC, "nothing")
    with pytest.raises(ValueError):
        detect(df, SPEC, "spike", {"windw": 3})
    assert DETECTORS["spike"].settings({}) == {"window": 24, "z_thresh": 4.0}
    assert DETECTORS["freeze"].settings({}) == {"min_run_length": 6, "tolerance": 0.0}

    def high(df, spec, layout, keep=()):
        return df.filter(F.col(spec.value) > 40).select(*spec.row_key)

    register_detector(Detector("high", high))
    try:
        fixed = detect_and_correct(df, SPEC, "high", "replace", params={"value": 2})
        assert [r["v"] for r in fixed.orderBy("i").collect()] == [1, 1, 1, 2]
    finally:
        del DETECTORS["high"]


@pytest.mark.parametrize("op", ["spike", "freeze"])
def test_cleaning_keeps_other_columns(spark, op):
    df = frame(spark, [1, 1, 1, 1, 1, 1, 50, 2]).withColumns(
        {"score": F.lit("kept"), "kind": F.col("i") * 2}
    )
    fixed = detect_and_correct(df, SPEC, op, "expression", params={"expr": "x - np.mean(x)"})
    assert fixed.columns == df.columns
    rows = fixed.orderBy("i").collect()
    assert {r["score"] for r in rows} == {"kept"} and [r["kind"] for r in rows] == list(range(0, 16, 2))
    if op == "freeze":
        assert [r["v"] for r in rows] == [0.0] * 6 + [50.0, 2.0]
