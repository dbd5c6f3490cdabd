import random

import pytest

import models
from seriesmend.model import SeriesSpec
from seriesmend.operators import coincide
from seriesmend.operators.coincide import coincident_runs, coincident_runs_each
from seriesmend.plans.blocks import Layout

SPEC = SeriesSpec(("s", "variable"), ("t",), ("i",), "v")
LAYOUTS = [Layout("plain"), Layout("blocked", block_rows=1), Layout("blocked", block_rows=9), Layout(largest_plain=25, block_rows=4)]


@pytest.fixture(scope="module")
def tables(spark):
    rng = random.Random(21)
    series, rows = {}, []
    for s, n in (("a", 60), ("b", 25), (None, 9), ("e", 0), ("one", 1)):
        for variable in "xyz":
            values = [rng.choices([1.0, 2.0, None], [6, 3, 1])[0] for _ in range(n)]
            series.setdefault(s, {})[variable] = values
            rows += [(s, variable, i // 2, i, v) for i, v in enumerate(values)]
    rng.shuffle(rows)
    return series, spark.createDataFrame(rows, "s string, variable string, t long, i long, v double").cache()


def plain(series, k, least):
    out = []
    for s, variables in series.items():
        stuck = [models.frozen(values, least, 0.0) for values in variables.values()]
        n, start = len(next(iter(variables.values()))), None
        for i in range(n + 1):
            together = i < n and sum(i in found for found in stuck) >= k
            if together and start is None:
                start = i
            if not together and start is not None:
                out.append((s, start, i - 1, i - start))
                start = None
    return sorted(out, key=str)


@pytest.mark.parametrize("layout, k, least", [(LAYOUTS[0], 1, 3), (LAYOUTS[0], 3, 2), *[(lay, 2, 2) for lay in LAYOUTS]], ids=str)
def test_stretches_follow_the_definition(tables, layout, k, least):
    series, df = tables
    found = coincident_runs(df, SPEC, k, least, 0.0, layout=layout)
    assert found.columns == ["s", "start_t", "start_i", "end_t", "end_i", "points"]
    got = sorted(((r["s"], r["start_i"], r["end_i"], r["points"]) for r in found.collect()), key=str)
    assert got == plain(series, k, least) and got


def test_runs_are_never_paired(tables):
    plan = coincident_runs(tables[1], SPEC, 2, 2)._jdf.queryExecution().optimizedPlan().toString()
    assert "Cross" not in plan and "Inner" not in plan


def test_variables_without_other_keys(spark):
    spec = SeriesSpec(("variable",), ("i",), (), "v")
    rows = [(name, i, float(i // step)) for name, step in (("x", 4), ("y", 6)) for i in range(12)]
    got = coincident_runs(spark.createDataFrame(rows, "variable string, i long, v double"), spec, 2, 4).collect()
    assert [(r["start_i"], r["end_i"], r["points"]) for r in got] == [(0, 11, 12)]
    empty = spark.createDataFrame([], "variable string, i long, v double")
    assert coincident_runs(empty, spec, 1).count() == 0


@pytest.mark.parametrize("batch", ["1", "4", "1000"])
@pytest.mark.parametrize("rows", [1, 7, 50])
def test_several_numbers_of_variables_over_batches_and_blocks(spark, tables, batch, rows):
    """Runs and stretches go on over the ends of batches and blocks, whatever they are."""
    series, df = tables
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, batch)
    try:
        found = coincident_runs_each(df, SPEC, (1, 2, 3), 3, 0.0, layout=Layout("blocked", block_rows=rows)).collect()
    finally:
        spark.conf.set(name, before)
    for k in (1, 2, 3):
        got = sorted(((r["s"], r["start_i"], r["end_i"], r["points"]) for r in found if r["variables"] == k), key=str)
        assert got == plain(series, k, 3)


def test_runs_of_long_series_are_sorted_and_searched_once(spark, tables, monkeypatch):
    """One stretch of rows through all blocks, for two numbers of variables."""
    sorts = []
    number_rows = coincide.number_rows
    monkeypatch.setattr(coincide, "number_rows", lambda *a: sorts.append(1) or number_rows(*a))
    spec = SeriesSpec(("variable",), ("i",), (), "v")
    rows = [(name, i, 1.0) for name in "xy" for i in range(50)]
    df = spark.createDataFrame(rows, "variable string, i long, v double")
    found = coincident_runs_each(df, spec, (1, 2, 3), 2, 0.0, layout=Layout(largest_plain=20, block_rows=6)).collect()
    assert sorted((r["variables"], r["start_i"], r["end_i"], r["points"]) for r in found) == [(1, 0, 49, 50), (2, 0, 49, 50)]
    assert len(sorts) == 1
