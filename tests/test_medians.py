import random
import statistics

import pytest

from seriesmend.operators import medians
from seriesmend.plans.blocks import profile


@pytest.mark.parametrize("grid, accuracy", [(1000, 20000), (8, 50)])
def test_narrowed_medians_are_exact(spark, monkeypatch, grid, accuracy):
    """Also with a coarse sketch, whose brackets are wide or may miss."""
    monkeypatch.setattr(medians, "GRID", grid)
    monkeypatch.setattr(medians, "SKETCH_ACCURACY", accuracy)
    rng = random.Random(5)
    groups = {
        "normal": [rng.gauss(0, 1) for _ in range(4001)],
        "even": [rng.random() for _ in range(3000)],
        "equal": [7.0] * 2500,
        "two": [1.0] * 1500 + [2.0] * 1500,
        "skewed": [float(int(rng.expovariate(0.2))) for _ in range(3500)],
        "infinite": [float("inf")] * 900 + [float("-inf")] * 900 + [rng.random() for _ in range(1000)],
        "short": [3.0, 1.0, 2.0],
        "one": [4.0],
        None: [float(i) for i in range(2001)],
    }
    rows = [(k, v) for k, values in groups.items() for v in values] + [("short", None)] * 9
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "k string, v double")
    sizes = profile(df, ("k",))
    found = medians.exact_median(df, ("k",), "v", sizes, largest_plain=1000)
    assert {r["k"]: r["v"] for r in found.collect()} == pytest.approx(
        {k: statistics.median(v) for k, v in groups.items()}
    )
    whole = medians.exact_median(df, (), "v", profile(df, ()), largest_plain=1000)
    every = [v for values in groups.values() for v in values]
    assert [r["v"] for r in whole.collect()] == [pytest.approx(statistics.median(every))]


def test_narrowing_goes_on_until_little_is_left(spark, monkeypatch):
    """A coarse grid needs several passes; equal values end them at once."""
    monkeypatch.setattr(medians, "GRID", 8)
    passes = []
    staged = medians.stage
    monkeypatch.setattr(medians, "stage", lambda df: passes.append(1) or staged(df))
    values = [float(i) for i in range(4001)]
    df = spark.createDataFrame([("a", v) for v in values] + [("b", 5.0)] * 4000, "k string, v double")
    found = medians.exact_median(df, ("k",), "v", profile(df, ("k",)), largest_plain=40)
    assert {r["k"]: r["v"] for r in found.collect()} == {"a": 2000.0, "b": 5.0}
    assert len(passes) >= 1 + 2 * 3


def test_huge_values_have_one_formula(spark):
    df = spark.createDataFrame([("a", v) for v in (1e308, 1.2e308)] * 3, "k string, v double")
    sizes = profile(df, ("k",))
    short, long = (medians.exact_median(df, ("k",), "v", sizes, largest_plain=n).first()["v"] for n in (100, 2))
    assert short == long == 1.1e308
