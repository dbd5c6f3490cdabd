import datetime
import random

import pytest
from pyspark.sql import functions as F

import models
from seriesmend import SeriesSpec
from seriesmend.operators import select
from seriesmend.plans.blocks import Layout

SPEC = SeriesSpec(("s",), ("x",), ("i",), "v")
ONE = SeriesSpec((), ("x",), ("i",), "v")
LAYOUTS = [Layout("plain"), *(Layout("blocked", block_rows=b) for b in (1, 3, 50)), Layout(largest_plain=25, block_rows=4)]


@pytest.mark.parametrize(
    "probe, row", [(5, 1), (4, 0), (14, 1), (16, 2), (20, 2), (24, 3), (99, 4), (-5, 0)]
)
def test_known_nearest(spark, probe, row):
    df = spark.createDataFrame(
        [(x, i, float(i)) for i, x in enumerate([0, 10, 20, 20, 30])], "x long, i long, v double"
    )
    assert select.nearest_point(df, ONE, "x", probe).first()["i"] == row
    asked = spark.createDataFrame([(probe,)], "p long")
    assert select.nearest_points(df, asked, ONE, "x", "p").first()["i"] == row


@pytest.mark.parametrize("layout", LAYOUTS, ids=str)
def test_many_probes(spark, layout):
    rng = random.Random(3)
    series = {f"s{k}": sorted(rng.randint(0, 60) for _ in range(n)) for k, n in enumerate([1, 2, 30, 80])}
    readings = [(s, x, i, float(i)) for s, xs in series.items() for i, x in enumerate(xs)]
    readings += [("s1", None, 99, 1.0)]
    probes = [(s, p, f"{s}-{p}") for s in [*series, "none"] for p in range(-3, 65, 4)]
    found = select.nearest_points(
        spark.createDataFrame(readings, "s string, x long, i long, v double"),
        spark.createDataFrame(probes, "s string, p long, tag string"),
        SPEC, "x", "p", layout,
    ).collect()
    assert {(r["s"], r["p"]): r["i"] for r in found} == {
        (s, p): models.nearest(series[s], p) for s, p, _ in probes if s in series
    }
    assert all(r["tag"] == f"{r['s']}-{r['p']}" for r in found)


def test_ranges_reach_the_scan(spark, small):
    events = spark.read.parquet(f"{small}/events.parquet")
    day = datetime.datetime(2024, 1, 10), datetime.datetime(2024, 1, 11)
    chosen = events.filter(select.x_range(F.col("ts"), *day) & select.y_range(F.col("value"), 5, 60))
    spark.conf.set("spark.sql.maxMetadataStringLength", "1000")
    plan = chosen.select("event_id")._jdf.queryExecution().executedPlan().toString()
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    pushed = plan[plan.index("PushedFilters"):]
    assert "GreaterThanOrEqual(ts" in pushed and "GreaterThanOrEqual(value" in pushed
    assert "props" not in plan


def test_missing_is_never_selected(spark):
    df = spark.createDataFrame(
        [(1, float("nan")), (2, None), (3, 5.0), (4, float("inf"))], "i int, v double"
    )
    inside = df.filter(select.y_range(F.col("v"), 0, float("inf")))
    assert sorted(r["i"] for r in inside.collect()) == [3, 4]
    box = select.xy_rectangle(F.col("i"), F.col("v"), (4, 9.0), (1, 0.0))
    assert [r["i"] for r in df.filter(box).collect()] == [3]
    counted = select.selection_count(df, select.y_range(F.col("v"), 0, 9))
    assert counted.first()["selected"] == 1
    finite = df.select(select.finite_reading(F.col("v")).alias("v")).collect()
    assert [r["v"] for r in finite] == [None, None, 5.0, None]
