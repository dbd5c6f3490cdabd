import os
import random

import pytest
from pyspark.sql import functions as F

from seriesmend.model import SeriesSpec
from seriesmend.operators.bitmaps import BITS, RowIndex

SPEC = SeriesSpec(("s",), ("t",), ("i",), "v")


def ids(selection):
    return sorted(r["i"] for r in selection.rows().collect())


@pytest.fixture(scope="module")
def table(spark):
    rng = random.Random(9)
    rows = [(rng.choice(["a", "b", None]), rng.randrange(50) or None, i, rng.choice([1.0, 2.0, 3.0, None])) for i in range(500)]
    return rows, spark.createDataFrame(rows, "s string, t long, i long, v double").cache()


@pytest.fixture(scope="module")
def index(table):
    return RowIndex.build(table[1], SPEC, ("v",))


def test_set_operations_are_those_of_sets(table, index):
    rows, _ = table
    every = {r[2] for r in rows}
    a, b = {r[2] for r in rows if r[3] is not None and r[3] > 1}, {r[2] for r in rows if r[0] == "a"}
    x, y = index.select(F.col("v") > 1), index.select(F.col("s") == "a")
    for got, want in (
        (x, a), (y, b), (x.union(y), a | b), (x.intersection(y), a & b), (x.difference(y), a - b),
        (y.difference(x), b - a), (x.inverted(), every - a), (x.inverted().inverted(), a), (index.everything(), every),
        (x.union(y).difference(x.intersection(y)), a ^ b), (x.difference(x), set()), (index.nothing(), set()),
        (index.nothing().inverted(), every), (x.union(index.nothing()), a), (x.intersection(index.nothing()), set()),
    ):
        assert ids(got) == sorted(want)
        assert got.count() == len(want) == got.counts().first()["selected"]


def test_rows_of_a_table_of_keys(table, index):
    rows, df = table
    picked = df.filter("i % 7 = 0")
    assert ids(index.select_rows(picked)) == [i for i in range(500) if i % 7 == 0]
    # repeated keys are selected once, unknown ones not at all
    twice = picked.unionAll(picked).withColumn("i", F.when(F.col("i") == 0, 9999).otherwise(F.col("i")))
    assert index.select_rows(twice).count() == picked.count() - 1


def test_a_frozen_selection_stays(spark, index):
    frozen = index.select(F.col("v") > 1).frozen()
    assert ids(frozen) == ids(index.select(F.col("v") > 1))
    assert frozen.bits.inputFiles()


def test_many_buckets_and_size_on_disk(spark):
    n = 40 * BITS + 17
    df = spark.range(n).select(F.lit("x").alias("s"), F.col("id").alias("t"), F.col("id").alias("i"), (F.xxhash64("id") % 1000 / 10).alias("v"))
    index = RowIndex.build(df, SPEC, ("v",))
    one = index.select(F.abs("v") < 1).frozen()      # about 1 % of all rows, everywhere
    want = df.filter("abs(v) < 1")
    assert one.count() == want.count() > n / 200
    assert one.bits.count() == 40   # none of the last 17 rows
    size = sum(os.path.getsize(f.removeprefix("file://")) for f in one.bits.inputFiles())
    assert 8 * size < n
    assert one.rows().join(want, "i", "left_anti").count() == 0 and one.rows().count() == want.count()
    tail = index.select(F.col("t") >= n - 3)
    assert ids(tail) == [n - 3, n - 2, n - 1] and tail.inverted().count() == n - 3


def test_selections_of_other_indexes_are_refused(table, index):
    other = RowIndex.build(table[1], SPEC)
    with pytest.raises(ValueError, match="row indexes"):
        index.everything().union(other.everything())
    with pytest.raises(ValueError, match="row indexes"):
        index.everything().difference(other.everything())


def test_an_empty_table(table):
    empty = RowIndex.build(table[1].limit(0), SPEC)
    assert empty.everything().count() == 0 and ids(empty.nothing().inverted()) == []
