import datetime
import glob
import hashlib
import os

import pytest
from pyspark.sql import functions as F

from seriesmend.sinks import rewrite
from seriesmend.sinks.files import write_output
from seriesmend.sinks.rewrite import finish_rewrite, rewrite_changed
from seriesmend.workbench import Workbench

START = datetime.datetime(2024, 5, 1)


def digests(path):
    return {os.path.basename(f): hashlib.sha256(open(f, "rb").read()).hexdigest() for f in glob.glob(f"{path}/*.parquet")}


def make_output(spark, path, files=8, rows=800):
    df = spark.range(rows).select(
        "id", F.col("id").cast("double").alias("air"), (F.col("id") * 10.0).alias("water"), F.lit("x y").alias("note"))
    df.repartitionByRange(files, "id").sortWithinPartitions(F.desc("id")).write.parquet(path)
    assert len(digests(path)) == files
    return df


def rows(spark, path):
    return [tuple(r) for r in spark.read.parquet(path).orderBy("id").collect()]


def test_seven_of_eight_files_stay(spark, tmp_path):
    path = f"{tmp_path}/a b/out%20.parquet"
    df = make_output(spark, path)
    before = digests(path)
    fixed = df.select("id", F.when(F.col("id") == 5, -1.0).otherwise(F.col("air")).alias("air"))
    changed = rewrite_changed(spark, path, fixed, ("id",), ["air"])
    after = digests(path)
    assert len(changed) == 1 and before.keys() == after.keys()
    assert {f for f in before if before[f] != after[f]} == set(changed)
    assert rows(spark, path) == [(i, -1.0 if i == 5 else float(i), i * 10.0, "x y") for i in range(800)]
    # the rows of the new file are in their old order
    ids = [r["id"] for r in spark.read.parquet(f"{path}/{changed[0]}").collect()]
    assert ids == sorted(ids, reverse=True)
    assert not [f for f in os.listdir(path) if f.startswith("_sm_")]
    # nothing differs now
    assert rewrite_changed(spark, path, fixed, ("id",), ["air"]) == [] and digests(path) == after


def test_missing_values_and_rows_without_a_partner(spark, tmp_path):
    path = f"{tmp_path}/out.parquet"
    make_output(spark, path, 4, 40)
    fixed = spark.createDataFrame([(0, None, 1.0), (39, 7.0, None), (99, 1.0, 1.0)], "id long, air double, water double")
    assert len(rewrite_changed(spark, path, fixed, ("id",), ["air", "water"])) == 2
    got = {r[0]: r[1:3] for r in rows(spark, path)}
    assert got[0] == (None, 1.0) and got[39] == (7.0, None) and got[1] == (1.0, 10.0) and len(got) == 40


def test_what_cannot_be_rewritten(spark, tmp_path):
    path = f"{tmp_path}/out.parquet"
    make_output(spark, path, 2, 20)
    fixed = spark.createDataFrame([(0, 1.0)], "id long, note double")
    assert rewrite_changed(spark, path, fixed, ("id",), ["note"]) is None      # a text column
    assert rewrite_changed(spark, path, fixed.toDF("id", "new"), ("id",), ["new"]) is None
    parts = f"{tmp_path}/parts.parquet"
    spark.range(6).select("id", F.col("id").cast("double").alias("air"), (F.col("id") % 2).alias("p")).write.partitionBy("p").parquet(parts)
    assert rewrite_changed(spark, parts, fixed.toDF("id", "air"), ("id",), ["air"]) is None
    assert spark.read.parquet(parts).filter("air = id").count() == 6


@pytest.mark.parametrize("done", [0, 1, 2])
def test_a_lost_driver_leaves_no_mixture(spark, tmp_path, monkeypatch, done):
    path = f"{tmp_path}/out.parquet"
    df = make_output(spark, path, 4, 40)
    fixed = df.select("id", (F.col("air") + 100).alias("air")).filter("id < 30")
    real, moved = rewrite._file_context, []

    class Lost(Exception):
        pass

    def context(session, where):
        inner, option = real(session, where)

        class Context:
            def util(self):
                return inner.util()

            def rename(self, *args):
                if len(moved) == done:
                    raise Lost
                moved.append(args)
                inner.rename(*args)

        return Context(), option

    monkeypatch.setattr(rewrite, "_file_context", context)
    with pytest.raises(Lost):
        rewrite_changed(spark, path, fixed, ("id",), ["air"])
    monkeypatch.undo()
    assert spark.read.parquet(path).count() == 40      # readers pass over what is beside
    finish_rewrite(spark, path)
    finish_rewrite(spark, path)
    assert [r[1] for r in rows(spark, path)] == [i + 100.0 if i < 30 else float(i) for i in range(40)]
    assert not [f for f in os.listdir(path) if f.startswith("_sm_")]


def test_a_session_saves_what_changed(spark, tmp_path):
    source = f"{tmp_path}/station.parquet"
    data = [(START + datetime.timedelta(minutes=i), i, float(i), 10.0 * i) for i in range(80)]
    spark.createDataFrame(data, "TIMESTAMP timestamp_ntz, id long, air double, water double").repartitionByRange(8, "id").write.parquet(source)
    with Workbench(spark, source, row_id=("id",)) as bench:
        bench.apply("air", "offset", {"amount": 5}, F.col("raw") < 40)
        path = bench.save("full")
    write_output(spark.read.parquet(path).repartitionByRange(8, "id"), path)   # small ones are one file
    before = digests(path)
    with Workbench(spark, source, row_id=("id",)) as bench:
        bench.apply("water", "delete", {}, F.col("raw") == 790)
        assert bench.save("full") == path and bench.dirty_variables == []
    after = digests(path)
    assert len(before) == 8 and before.keys() == after.keys()
    assert sum(before[f] != after[f] for f in before) == 1
    got = spark.read.parquet(path).orderBy("id").collect()
    assert [r["air"] for r in got] == [i + 5.0 if i < 40 else float(i) for i in range(80)]
    assert got[79]["water"] is None and got[78]["water"] == 780.0
