import math

import pytest
from pyspark.sql import functions as F

from seriesmend import SeriesSpec
from seriesmend.operators.correct import (
    CORRECTIONS,
    Correction,
    Param,
    correct,
    correction_patch,
    register_correction,
)
from seriesmend.operators.view import downsample_peak, downsample_stride, series_extent, display
from seriesmend.plans.blocks import Layout
from seriesmend.sinks.exports import changed

SPEC = SeriesSpec((), ("i",), (), "v")


@pytest.fixture(scope="module")
def df(spark):
    return spark.createDataFrame([(0, 1.0), (1, 5.0), (2, 9.0), (3, None)], "i int, v double").cache()


def values(frame):
    return [r["v"] for r in frame.orderBy("i").collect()]


@pytest.mark.parametrize(
    "params, rows",
    [
        (dict(min=2, max=8), {0, 2}),
        (dict(min=2, max=8, mode="inside"), {1}),
        (dict(min=2), {0}),
        (dict(max=8), {2}),
        (dict(), set()),
        (dict(mode="inside"), {0, 1, 2}),
        (dict(min=8, max=2), {0, 1, 2}),
        (dict(min=8, max=2, mode="inside"), set()),
    ],
)
def test_threshold_rows(df, params, rows):
    patch = correction_patch(df, SPEC, "threshold", params)
    assert {r["i"] for r in patch.collect()} == rows


@pytest.mark.parametrize(
    "op, params, expected",
    [
        ("delete", {}, [None, 5.0, 9.0, None]),
        ("replace", {"value": 2}, [2.0, 5.0, 9.0, 2.0]),
        ("offset", {"amount": -1}, [0.0, 5.0, 9.0, None]),
        ("multiply", {"factor": 3}, [3.0, 5.0, 9.0, None]),
        ("expression", {"expr": "x - np.nanmean(x)"}, [0.0, 5.0, 9.0, None]),
        ("replace", {}, [0.0, 5.0, 9.0, 0.0]),
        ("offset", {}, [1.0, 5.0, 9.0, None]),
        ("multiply", {}, [1.0, 5.0, 9.0, None]),
        ("expression", {}, [1.0, 5.0, 9.0, None]),
    ],
)
def test_selected_rows(df, op, params, expected):
    assert values(correct(df, SPEC, op, params, F.col("i").isin(0, 3))) == expected


def test_refusals(df):
    with pytest.raises(ValueError, match="Unknown correction"):
        correct(df, SPEC, "smooth")
    with pytest.raises(ValueError, match="needs a selection"):
        correct(df, SPEC, "delete")
    with pytest.raises(ValueError, match="unknown action"):
        correct(df, SPEC, "threshold", {"action": "hide"})
    with pytest.raises(ValueError, match="unknown parameter"):
        correct(df, SPEC, "offset", {"value": 1}, F.lit(True))
    with pytest.raises(ValueError, match="Invalid expression"):
        correct(df, SPEC, "expression", {"expr": "y"}, F.lit(True))


def test_own_correction(df):
    register_correction(
        Correction("cap", lambda v, p: F.least(v, F.lit(p["at"])), (Param("at", "float", 6.0),))
    )
    try:
        assert values(correct(df, SPEC, "cap", None, F.lit(True)))[:3] == [1.0, 5.0, 6.0]
    finally:
        del CORRECTIONS["cap"]
    assert set(CORRECTIONS) == {"delete", "replace", "offset", "multiply", "expression", "threshold"}
    assert not CORRECTIONS["threshold"].needs_selection


def test_changed_cells(spark):
    inf, nan = math.inf, math.nan
    cases = [
        (1, 1.0000009, False), (1, 1.0000011, True), (0, 1e-9, False), (0, 1.1e-9, True),
        (5, None, True), (None, 5, True), (None, None, False), (nan, None, False), (nan, 5, True),
        (1, 1.000001001, False), (inf, inf, False), (inf, -inf, True), (inf, 5, True), (5, inf, True),
    ]
    rows = [(None if a is None else float(a), None if b is None else float(b), w) for a, b, w in cases]
    df = spark.createDataFrame(rows, "raw double, corrected double, want boolean")
    got = df.withColumn("got", changed(F.col("raw"), F.col("corrected"))).collect()
    assert [r for r in got if r["got"] != r["want"]] == []


def test_views(spark):
    rows = [("a", i, i, float(v)) for i, v in enumerate([3, 1, 1, 9, 9, 2, 4])]
    rows += [("b", 0, 9, None), ("b", 1, 10, math.inf)]
    spec = SeriesSpec(("s",), ("t",), ("i",), "raw")
    df = spark.createDataFrame(rows, "s string, t long, i long, raw double").withColumns(
        {"ts": F.timestamp_seconds("t").cast("timestamp_ntz"), "corrected": F.col("raw") * 2}
    )
    extent = {r["s"]: (r["y_min"], r["y_max"]) for r in series_extent(df, spec, "ts").collect()}
    assert extent == {"a": (1.0, 18.0), "b": (None, None)}
    raw_only = {r["s"]: r["y_max"] for r in series_extent(df, spec, "ts", "raw").collect()}
    assert raw_only["a"] == 9.0
    peaks = downsample_peak(df.filter("s = 'a'"), spec, "ts", 4)
    assert sorted((r["bucket"], r["peak"], r["i"]) for r in peaks.collect()) == [
        (0, "max", 3), (0, "min", 1), (1, "max", 4), (1, "min", 5),
    ]
    assert display(df, "raw", ("i",)).count() == 9 and display(df, "both", ("i",)).count() == 18
    for layout in (Layout("plain"), Layout("blocked", block_rows=2)):
        thin = downsample_stride(df, spec, shown=3, layout=layout)
        assert sorted((r["s"], r["i"]) for r in thin.collect()) == [
            ("a", 0), ("a", 3), ("a", 6), ("b", 9), ("b", 10),
        ]


def test_corrections_run_on_a_stream(spark, small):
    """They are plain projections, so a streaming table takes them unchanged."""
    path = f"{small}/events.parquet"
    batch = spark.read.parquet(path)
    spec = SeriesSpec(("event_type",), ("ts",), ("event_id",))
    fixed = lambda df: correct(
        df, spec, "threshold", {"max": 100, "action": "expression", "expr": "np.sqrt(x)"}
    ).select("event_id", "value")
    stream = spark.readStream.schema(batch.schema).parquet(path + "*")
    run = fixed(stream).writeStream.format("memory").queryName("fixed").trigger(availableNow=True).start()
    run.awaitTermination(60)
    assert sorted(spark.table("fixed").collect()) == sorted(fixed(batch).collect())
