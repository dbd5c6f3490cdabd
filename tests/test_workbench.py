import datetime
import os

import pytest
from pyspark.sql import functions as F

from seriesmend.sinks.files import output_path, write_output
from seriesmend.workbench import Workbench

START = datetime.datetime(2024, 5, 1)


def make_table(spark, folder, fmt="parquet", rows=6):
    data = [
        (str(START + datetime.timedelta(minutes=i)), i, float(i), 10.0 * i, f"c{i}") for i in range(rows)
    ]
    df = spark.createDataFrame(data, "TIMESTAMP string, id int, air double, water double, note string")
    path = f"{folder}/station.{fmt}"
    writer = df.coalesce(2).write
    writer.parquet(path) if fmt == "parquet" else writer.csv(path, header=True)
    return path


def corrected(bench, name):
    return [r["corrected"] for r in bench.readings(name).orderBy("_time").collect()]


@pytest.mark.parametrize("row_id", [(), ("id",)], ids=["position", "id"])
def test_edit_and_save(spark, tmp_path, row_id):
    path = make_table(spark, tmp_path)
    bench = Workbench(spark, path, row_id=row_id)
    assert bench.time_column == "TIMESTAMP" and bench.name == "station"
    assert bench.variable_names == ["id", "air", "water", "note"]
    assert bench.save("diff") is None and bench.save_all() == {}

    picked = bench.select("air", F.col("raw") >= 4)
    first = bench.apply("air", "offset", {"amount": 100}, picked, "shift")
    assert first.points == 2
    # the frozen rows, although 104 and 105 no longer satisfy other conditions
    bench.apply("air", "multiply", {"factor": 2}, picked)
    assert corrected(bench, "air") == [0, 1, 2, 3, 208, 210]
    assert bench.apply("air", "delete", {}, F.col("corrected") > 999) is None
    assert [e.op_id for e in bench.history("air")] == ["offset", "multiply"]
    bench.remove_edit("air", 0)
    assert corrected(bench, "air") == [0, 1, 2, 3, 208, 210]
    bench.undo("air")
    assert corrected(bench, "air") == [0, 1, 2, 3, 104, 105]
    bench.restore_edit("air")
    bench.apply("air", "delete", {}, F.col("corrected") == 1)
    assert bench.deleted("air").count() == 1
    assert corrected(bench, "air") == [0, None, 2, 3, 104, 105]
    assert bench.dirty_variables == ["air"]

    paths = bench.save_all()
    assert [os.path.basename(p) for p in paths.values()] == [
        "station_corrected.parquet", "station_corrected_serie.parquet", "station_corrected_full.parquet",
    ]
    assert bench.dirty_variables == []
    diff = spark.read.parquet(paths["diff"]).orderBy("TIMESTAMP")
    assert diff.columns == ["TIMESTAMP", "air"]
    assert [tuple(r) for r in diff.collect()] == [
        (START + datetime.timedelta(minutes=m), v) for m, v in ((1, None), (4, 104.0), (5, 105.0))
    ]
    assert spark.read.parquet(paths["series"]).count() == 6
    full = spark.read.parquet(paths["full"]).orderBy("id")
    assert full.columns[:5] == bench.column_names
    assert [r["air"] for r in full.collect()] == [0, None, 2, 3, 104, 105]
    assert full.first()["TIMESTAMP"] == str(START)  # as it was read

    # a new session starts from raw; the full output keeps the earlier variable
    again = Workbench(spark, path, row_id=row_id)
    assert corrected(again, "air") == [0, 1, 2, 3, 4, 5]
    again.apply("water", "threshold", {"max": 25, "action": "replace", "replace_value": -1})
    again.save("full")
    merged = spark.read.parquet(paths["full"]).orderBy("id").collect()
    assert [r["air"] for r in merged] == [0, None, 2, 3, 104, 105]
    assert [r["water"] for r in merged] == [0, 10, 20, -1, -1, -1]
    assert spark.read.parquet(path).filter("air = 4").count() == 1  # the source is untouched


def test_csv(spark, tmp_path):
    bench = Workbench(spark, make_table(spark, tmp_path, "csv"))
    bench.apply("air", "expression", {"expr": "x * 2"}, F.col("raw") > 3)
    bench.apply("note", "replace", {"value": 1}, F.col("_x").isNotNull())  # text opens as missing
    path = bench.save("diff", "csv")
    rows = spark.read.csv(path, header=True, inferSchema=True).orderBy("TIMESTAMP").collect()
    assert [(r["air"], r["note"]) for r in rows] == [
        (None, 1), (None, 1), (None, 1), (None, 1), (8, 1), (10, 1),
    ]
    with pytest.raises(ValueError, match="no such way"):
        bench.save("delta")
    with pytest.raises(ValueError, match="written as"):
        bench.save("diff", "xlsx")


def test_row_count_is_checked(spark, tmp_path):
    path = make_table(spark, tmp_path)
    bench = Workbench(spark, path, row_id=("id",))
    bench.apply("air", "delete", {}, F.col("raw") > 3)
    shorter = spark.read.parquet(path).limit(3)
    write_output(shorter, output_path(path, "full"))
    with pytest.raises(ValueError, match="3 row keys"):
        bench.save("full")
    assert bench.dirty_variables == ["air"]


def test_time_column_and_reset(spark, tmp_path):
    bench = Workbench(spark, make_table(spark, tmp_path), row_id=("id",))
    bench.apply("air", "delete", {}, F.col("raw") > 3)
    bench.set_time_column("TIMESTAMP")
    assert bench.history("air")
    bench.set_time_column("water")
    assert bench.variables == {} and "TIMESTAMP" in bench.variable_names
    assert [r["_x"] for r in bench.readings("air").orderBy("_x").collect()] == [0, 10, 20, 30, 40, 50]
    bench.apply("air", "delete", {}, F.col("raw") > 3)
    bench.reset("air")
    assert corrected(bench, "air") == [0, 1, 2, 3, 4, 5] and bench.dirty_variables == ["air"]


def test_detect_and_events(spark, tmp_path):
    bench = Workbench(spark, make_table(spark, tmp_path, rows=9), row_id=("id",))
    bench.apply("air", "replace", {"value": 7}, F.col("raw").between(2, 5))
    stuck = bench.detect("air", "freeze", {"min_run_length": 3})
    assert stuck.count() == 4
    bench.apply("air", "delete", {}, stuck)
    assert corrected(bench, "air") == [0, 1, None, None, None, None, 6, 7, 8]
    notes = str(tmp_path / "notes.csv")
    with open(notes, "w") as f:
        f.write("start,end,table,label\n2024-05-01 00:02:00,2024-05-01 00:04:00,station,work\n")
        f.write("2024-05-01 00:03:00,,other,never\n2024-05-01 00:03:00,,*,late\n")
    bench.load_events(notes)
    assert bench.events.count() == 3 and bench.events_for_table.count() == 2
    noted = bench.annotate("air").orderBy("_time").collect()
    assert [r["event"] for r in noted] == [None, None, "work", "work", "work", *[None] * 4]
    near = bench.select_point("air", bench.readings("air").agg(F.max("_x")).first()[0] - 61)
    assert [(r["id"], r["corrected"]) for r in near.collect()] == [(7, 7.0)]


def test_overwriting_what_is_read(spark, tmp_path):
    path = str(tmp_path / "t.parquet")
    write_output(spark.range(3).withColumn("v", F.lit(1)), path)
    write_output(spark.read.parquet(path).withColumn("v", F.col("v") + 1), path)
    assert [r["v"] for r in spark.read.parquet(path).collect()] == [2, 2, 2]
    assert os.listdir(tmp_path) == ["t.parquet"]


def test_positions_in_partitioned_folders(spark, tmp_path):
    """Part files of different folders share their names; rows must not."""
    path = str(tmp_path / "daily.parquet")
    days = spark.range(6).select(
        F.timestamp_seconds("id").alias("TIME"), F.col("id").cast("double").alias("v"), (F.col("id") % 3).alias("day")
    )
    days.coalesce(1).write.partitionBy("day").parquet(path)
    bench = Workbench(spark, path)
    bench.apply("v", "offset", {"amount": 10}, F.col("raw") == 4)
    assert corrected(bench, "v") == [0, 1, 2, 3, 14, 5]


def test_session_zone_is_checked(spark, tmp_path):
    path = make_table(spark, tmp_path)
    spark.conf.set("spark.sql.session.timeZone", "Asia/Tokyo")
    try:
        with pytest.raises(ValueError, match="UTC"):
            Workbench(spark, path)
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
