import pytest
from pyspark.sql import functions as F

from seriesmend.sources import footers


def found(spark, path, *names):
    return {r["variable"]: tuple(r)[1:] for r in footers.ranges_from_footers(spark, path, list(names)).collect()}


def test_counts_and_ranges_come_from_footers(spark, tmp_path, monkeypatch):
    path = f"{tmp_path}/t.parquet"
    spark.range(100).select(
        F.timestamp_seconds("id").alias("TIME"), (F.col("id") - 3.5).alias("a"), F.when(F.col("id") > 9, F.col("id").cast("int")).alias("b"),
        F.lit(None).cast("double").alias("c"), F.col("id").cast("string").alias("d")).repartition(4).write.parquet(path)
    assert tuple(footers.summary_from_footers(spark, path).first()) == (100, 4)
    with footers.footer_reader(spark):
        df = spark.read.parquet(path).agg(F.count(F.lit(1)), F.min("a"), F.max("b"))
        assert footers.pushed(df)
    assert not footers.pushed(spark.read.parquet(path).agg(F.min("a")))     # settings are back
    answers = []
    real = footers._answered
    monkeypatch.setattr(footers, "_answered", lambda *a: answers.append(real(*a)) or answers[-1])
    assert found(spark, path, "a", "b") == {"a": (-3.5, 95.5, 100), "b": (10, 99, 90)}
    assert answers[0] is not None
    assert found(spark, path, "c", "d") == {"c": (None, None, 0), "d": (0, 99, 100)}


@pytest.mark.parametrize("odd", ["NaN", "Infinity", "-Infinity"])
def test_other_values_are_read(spark, tmp_path, odd):
    path = f"{tmp_path}/t.parquet"
    spark.range(10).select(F.when(F.col("id") == 5, F.lit(odd).cast("double")).otherwise(F.col("id")).alias("v")).write.parquet(path)
    assert found(spark, path, "v") == {"v": (0, 9, 10)}


def test_an_empty_table(spark, tmp_path):
    path = f"{tmp_path}/t.parquet"
    spark.range(0).select(F.col("id").cast("double").alias("v")).write.parquet(path)
    assert footers.count_rows(spark, path) == 0 and found(spark, path, "v") == {"v": (None, None, 0)}
