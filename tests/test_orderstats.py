import math
import random

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

import models
from seriesmend.model import SeriesSpec
from seriesmend.operators import orderstats
from seriesmend.operators.detect import detect_spikes, rolling_median_mad, score_spikes
from seriesmend.operators.detectors import detect_and_correct
from seriesmend.plans.blocks import Layout

SPEC = SeriesSpec(("s",), ("t",), ("i",), "v")
LAYOUTS = [Layout("plain"), Layout("blocked", block_rows=1), Layout("blocked", block_rows=40), Layout(largest_plain=30, block_rows=4)]

number = st.one_of(
    st.integers(-5, 5).map(float), st.sampled_from([math.nan, math.inf, -math.inf, -0.0, 1e300, -1e300, 0.1]), st.floats(-2, 2))


def plain(steps, half):
    out = []
    for i in range(len(steps)):
        frame = [steps[min(max(j, 0), len(steps) - 1)] for j in range(i - half, i + half + 1)]
        centre = models.median(frame)
        out.append((centre, models.median([abs(v - centre) for v in frame])))
    return out


@settings(max_examples=300, deadline=None)
@given(st.lists(number, max_size=30), st.integers(1, 45))
def test_moving_median_and_mad_follow_the_definition(steps, half):
    with np.errstate(invalid="ignore"):
        median, mad, known = orderstats.moving_median_mad(np.array(steps, float), half)
    assert (known | (np.isnan(median) & np.isnan(mad))).all()
    for got, want in zip(zip(median, mad), plain(steps, half)):
        assert [str(abs(x)) for x in got] == [str(abs(x)) for x in want]


def test_many_frames_are_looked_up_in_parts(monkeypatch):
    rng = np.random.default_rng(5)
    steps = np.round(rng.normal(size=500), 1)
    steps[rng.integers(0, 500, 40)] = np.nan
    whole = orderstats.moving_median_mad(steps, 33)
    monkeypatch.setattr(orderstats, "AT_ONCE", 7)
    assert all(np.array_equal(a, b, equal_nan=True) for a, b in zip(whole, orderstats.moving_median_mad(steps, 33)))


@given(st.lists(st.integers(0, 20), min_size=1, max_size=60), st.data())
@settings(max_examples=200, deadline=None)
def test_kth_of_any_range_with_weights(ranks, data):
    start = data.draw(st.integers(0, len(ranks)))
    end = data.draw(st.integers(start, len(ranks)))
    weight, copies = data.draw(st.integers(0, 20)), data.draw(st.integers(0, 5))
    inside = sorted(ranks[start:end] + [weight] * copies)
    counts = orderstats.RunningCounts(np.array(ranks), 21)
    for k, want in enumerate(inside):
        one = lambda x: np.array([x])
        assert counts.kth(one(start), one(end), one(k), [(weight, one(copies))])[0] == want


@pytest.fixture(scope="module")
def many(spark):
    rng = random.Random(11)
    rows = []
    for n in [0, 1, 2, 3, 4, 9, 40, 170]:
        level = 10.0
        for i in range(n):
            level += rng.choice([0.0, 0.0, 0.1, -0.1, 1.0, 30.0])
            v = rng.choices([level, None, math.nan, math.inf, -math.inf], [20, 1, 1, 1, 1])[0]
            rows.append((f"s{n}" if n != 9 else None, i // 2, i, v, f"kept {i}"))
    rng.shuffle(rows)
    return spark.createDataFrame(rows, "s string, t long, i long, v double, kept string").cache()


def rows(df):
    return sorted(map(str, df.collect()))


@pytest.mark.parametrize("layout", LAYOUTS, ids=str)
@pytest.mark.parametrize("window", [2, 3, 8, 24, 101])
def test_counts_give_what_arrays_give(many, layout, window):
    arrays = rolling_median_mad(many, SPEC, window, Layout("plain"), "arrays")
    assert rows(rolling_median_mad(many, SPEC, window, layout, "counts")) == rows(arrays)
    scored = [score_spikes(many, SPEC, window, lay, ("kept",), "z", k) for lay, k in ((layout, "counts"), (Layout("plain"), "arrays"))]
    assert rows(scored[0]) == rows(scored[1])


def test_wide_frames_are_never_written(many):
    wide = detect_spikes(many, SPEC, 5001)
    plan = wide._jdf.queryExecution().executedPlan().toString()
    assert "collect_list" not in plan and "array" not in plan.lower().replace("arrow", "")
    assert "FlatMapGroupsInArrow" in plan


@pytest.mark.parametrize("layout", LAYOUTS, ids=str)
def test_frames_wider_than_the_series(many, layout):
    plain_rows = rows(detect_spikes(many, SPEC, 5001, 1.0, Layout("plain")))
    assert rows(detect_spikes(many, SPEC, 5001, 1.0, layout)) == plain_rows
    series = {}
    for r in sorted(many.collect(), key=lambda r: (str(r["s"]), r["t"], r["i"])):
        series.setdefault(r["s"], []).append(r["v"])
    want = sum(len(models.spikes(values, 5001, 1.0)) for values in series.values())
    assert len(plain_rows) == want > 0


def test_correction_with_a_wide_window_needs_no_join(many):
    clean = detect_and_correct(many, SPEC, "spike", "delete", {"window": 501, "z_thresh": 1.0})
    assert "Join" not in clean._jdf.queryExecution().executedPlan().toString()
    flagged = detect_spikes(many, SPEC, 501, 1.0).count()
    assert clean.filter("v IS NULL").count() >= flagged > 0


def test_one_series_without_keys_and_an_empty_table(spark, many):
    spec = SeriesSpec((), ("t",), ("s", "i"), "v")
    assert rows(rolling_median_mad(many, spec, 201)) == rows(rolling_median_mad(many, spec, 201, Layout("blocked", block_rows=50)))
    assert detect_spikes(many.limit(0), SPEC, 201).count() == 0
    assert detect_spikes(many.limit(0), spec, 201).count() == 0
