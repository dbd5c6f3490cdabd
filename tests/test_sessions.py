"""Saving, reopening and saving again: no correction may be lost on the way."""

import os
import shutil

import pytest
from pyspark.sql import functions as F, types as T

from seriesmend.plans import patches
from seriesmend.plans.staging import drop_staged, shared_folder, stage, staging_scope
from seriesmend.sinks.files import path_exists, write_output
from seriesmend.workbench import SessionConflict, Workbench


def table(spark, path, rows=6, **columns):
    df = spark.range(rows).select(
        F.date_format(F.timestamp_seconds("id"), "yyyy-MM-dd HH:mm:ss").alias("TIMESTAMP"),
        F.col("id"), F.col("id").cast("double").alias("air"), (F.col("id") * 10.0).alias("water"),
        *[c.alias(n) for n, c in columns.items()],
    )
    df.coalesce(2).write.parquet(str(path)) if str(path).endswith("parquet") else df.write.csv(str(path), header=True)
    return str(path)


def fix(spark, path, name, row_id=(), fmt="parquet", amount=100, **more):
    with Workbench(spark, path, row_id=row_id, **more) as bench:
        bench.apply(name, "offset", {"amount": amount}, F.col("raw") >= 4 * (10 if name == "water" else 1))
        return bench.save("full", fmt)


def values(spark, path, *names, order="TIMESTAMP"):
    return [tuple(r) for r in spark.read.parquet(path).orderBy(order).select(*names).collect()]


def test_outputs_without_row_id_survive_a_move(spark, tmp_path):
    path = table(spark, tmp_path / "a" / "t.parquet")
    out = fix(spark, path, "air")
    assert spark.read.parquet(out).columns == ["TIMESTAMP", "id", "air", "water"]
    shutil.copytree(tmp_path / "a", tmp_path / "b")
    again = fix(spark, str(tmp_path / "b" / "t.parquet"), "water")
    assert values(spark, again, "air", "water") == [
        (i + 100 * (i >= 4), i * 10 + 100 * (i >= 4)) for i in range(6)]
    third = fix(spark, str(tmp_path / "b" / "t.parquet"), "air", amount=1)   # the same variable anew
    assert values(spark, third, "air", "water") == [(i + (i >= 4), i * 10 + 100 * (i >= 4)) for i in range(6)]


def test_unknown_rows_are_refused(spark, tmp_path):
    path = table(spark, tmp_path / "t.csv")
    out = fix(spark, path, "air")
    before = values(spark, out, "air")
    with pytest.raises(ValueError, match="nothing was saved"):
        fix(spark, path, "water")
    assert values(spark, out, "air") == before


def test_repeated_row_ids_are_refused(spark, tmp_path):
    path = table(spark, tmp_path / "t.parquet", twice=F.floor(F.col("id") / 2))
    fix(spark, path, "air", row_id=("twice",))
    with pytest.raises(ValueError, match="not exactly once"):
        fix(spark, path, "water", row_id=("twice",))


def test_unmatched_rows_are_refused(spark, tmp_path):
    path = table(spark, tmp_path / "t.parquet")
    out = fix(spark, path, "air", row_id=("id",))
    moved = spark.read.parquet(out).withColumn("id", F.col("id") + 1)
    write_output(moved, out)   # as many rows, other keys
    with pytest.raises(ValueError, match="2 row keys"):
        fix(spark, path, "water", row_id=("id",))


def test_row_id_called_seq_and_columns_called_as_ours(spark, tmp_path):
    path = table(spark, tmp_path / "t.parquet", seq=F.col("id") + 50, layer=F.col("id") * 2.0, patched=F.lit("p"))
    with Workbench(spark, path, row_id=("seq",)) as bench:
        bench.apply("air", "offset", {"amount": 7}, F.col("seq") >= 54)
        bench.apply("layer", "multiply", {"factor": 2}, F.col("raw") > 6)
        assert [r.corrected for r in bench.readings("air").orderBy("seq").collect()] == [0, 1, 2, 3, 11, 12]
        assert [r.corrected for r in bench.readings("layer").orderBy("seq").collect()] == [0, 2, 4, 6, 16, 20]
        assert bench.save("full")


def test_names_with_dots_and_reserved_names(spark, tmp_path):
    path = table(spark, tmp_path / "t.parquet", **{"air.temp": F.col("id") * 3.0, "tick`s": F.col("id") * 1.0})
    with Workbench(spark, path, row_id=("id",)) as bench:
        bench.apply("air.temp", "replace", {"value": -1}, F.col("raw") == 6)
        bench.apply("tick`s", "delete", {}, F.col("raw") == 2)
        paths = bench.save_all()
        full = spark.read.parquet(paths["full"]).orderBy("id").collect()
        assert [r["air.temp"] for r in full] == [0, 3, -1, 9, 12, 15]
        assert [r["tick`s"] for r in full] == [0, 1, None, 3, 4, 5]
    odd = table(spark, tmp_path / "odd.parquet", _sm_row=F.lit(1))
    with pytest.raises(ValueError, match="_sm_"):
        Workbench(spark, odd)


def test_csv_outputs_keep_the_types_of_the_table(spark, tmp_path):
    schema = T.StructType([T.StructField("TIMESTAMP", T.StringType()), T.StructField("id", T.StringType()),
                           T.StructField("air", T.DoubleType()), T.StructField("water", T.DoubleType())])
    path = str(tmp_path / "t.csv")
    spark.createDataFrame([(f"2024-01-01 00:00:0{i}", f"00{i}", float(i), 1.0) for i in range(4)], schema).write.csv(path, header=True)
    for name in ("air", "water"):
        with Workbench(spark, path, row_id=("id",), schema=schema) as bench:
            bench.apply(name, "offset", {"amount": 5}, F.col("id") == "003")
            out = bench.save("full", "csv")
    got = spark.read.schema(schema).csv(out, header=True).orderBy("id").collect()
    assert [tuple(r) for r in got] == [
        (f"2024-01-01 00:00:0{i}", f"00{i}", i + 5 * (i == 3), 1 + 5 * (i == 3)) for i in range(4)]


def test_output_folder(spark, tmp_path):
    path = table(spark, tmp_path / "in" / "t.parquet")
    out = fix(spark, path, "air", output_folder=str(tmp_path / "out"))
    assert os.path.dirname(out) == str(tmp_path / "out") and os.listdir(tmp_path / "in") == ["t.parquet"]


def test_a_swap_that_broke_is_mended(spark, tmp_path):
    path = str(tmp_path / "x.parquet")
    write_output(spark.range(3), path)
    os.rename(path, path + ".replaced-abc")   # where a lost driver leaves it
    assert path_exists(spark, path) and spark.read.parquet(path).count() == 3
    os.rename(path, path + ".replaced-abc")
    write_output(spark.range(5), path)
    assert spark.read.parquet(path).count() == 5 and os.listdir(tmp_path) == ["x.parquet"]


def test_sessions_and_scopes_leave_nothing(spark, tmp_path):
    drop_staged(spark)
    folder = shared_folder(spark).removeprefix("file:")
    before = set(os.listdir(folder))
    path = table(spark, tmp_path / "t.csv")
    with staging_scope(spark):
        fix(spark, path, "air")
        with Workbench(spark, path) as bench:
            bench.apply("air", "expression", {"expr": "x - np.median(x)"}, F.col("raw") > 1)
            assert bench.readings("air").count() == 6
            assert set(os.listdir(folder)) != before
        assert stage(spark.range(2)).count() == 2
    assert set(os.listdir(folder)) == before


def test_times_are_read_by_one_layout(spark, tmp_path):
    path = str(tmp_path / "t.parquet")
    rows = [("01/02/2024 10:00", 1.0), ("12/31/2024 10:00", 2.0), ("soon", 3.0), (" ", 4.0)]
    spark.createDataFrame(rows, "TIME string, v double").write.parquet(path)
    with Workbench(spark, path) as bench:
        assert bench.unread_times() == 1
        read = {r.raw: r._time for r in bench.readings("v").collect()}
        assert (read[1.0].month, read[1.0].day, read[2.0].month) == (1, 2, 12) and read[3.0] is None


@pytest.mark.parametrize("suffix", ["parquet", "csv"])
def test_a_session_goes_on_from_its_folder(spark, tmp_path, suffix):
    path = table(spark, tmp_path / f"t.{suffix}")
    lost = Workbench(spark, path)
    lost.apply("air", "offset", {"amount": 10}, F.col("raw") > 3, "up")
    lost.apply("air", "delete", {}, F.col("raw") == 1)
    lost.apply("water", "multiply", {"factor": 2}, F.col("raw") > 30)
    lost.apply("air", "multiply", {"factor": 3}, F.col("raw") == 5)
    lost.remove_edit("air", 0)
    lost.undo("air")
    want = {n: sorted(map(str, lost.readings(n).collect())) for n in ("air", "water")}
    found = Workbench(spark, path, session=lost.session_folder)
    assert {n: sorted(map(str, found.readings(n).collect())) for n in ("air", "water")} == want
    assert found.history("air") == lost.history("air") and found.dirty_variables == ["air", "water"]
    assert found.deleted("air").count() == lost.deleted("air").count() == 1
    assert found.restore_edit("air") == lost.restore_edit("air")
    found.close()
    assert not path_exists(spark, lost.session_folder)


def test_views_of_a_session(spark, tmp_path):
    with Workbench(spark, table(spark, tmp_path / "t.parquet"), row_id=("id",)) as bench:
        bench.apply("air", "offset", {"amount": 10}, F.col("raw") == 5)
        rows = bench.select_range("air", x0=2, y1=4)
        assert bench.selection_count(rows) == 3
        assert bench.selection_count(bench.select_range("air", y0=14)) == 1
        assert tuple(bench.extent("air").first()) == (0, 5, 0, 15)
        assert bench.display("air").count() == 12 and bench.display("air", "raw").count() == 6
        assert bench.thin_peaks("air", 3.0).count() == 4
        assert bench.thin_selection("air", rows, 1).count() == 1


def test_of_two_drivers_one_wins_and_one_is_told(spark, tmp_path):
    path = table(spark, tmp_path / "t.parquet")
    first = Workbench(spark, path, row_id=("id",), guarded=True)
    first.apply("air", "offset", {"amount": 10}, F.col("raw") > 3)
    second = Workbench(spark, path, row_id=("id",), session=first.session_folder, guarded=True)
    second.apply("air", "delete", {}, F.col("raw") == 1)
    with pytest.raises(SessionConflict):
        first.apply("air", "replace", {"value": 7}, F.col("raw") == 2)
    with pytest.raises(SessionConflict):
        first.undo("air")
    again = Workbench(spark, path, row_id=("id",), session=first.session_folder, guarded=True)
    assert [e.op_id for e in again.history("air")] == ["offset", "delete"]
    assert [r.corrected for r in again.readings("air").orderBy("id").collect()] == [0, None, 2, 3, 14, 15]
    again.undo("air")
    assert [r.corrected for r in again.readings("air").orderBy("id").collect()] == [0, 1, 2, 3, 14, 15]
    again.close()


def test_a_saved_session_is_clean_when_it_is_opened_again(spark, tmp_path):
    path = table(spark, tmp_path / "t.parquet")
    bench = Workbench(spark, path, row_id=("id",))
    bench.apply("air", "offset", {"amount": 10}, F.col("raw") > 3)
    bench.apply("water", "offset", {"amount": 1}, F.col("raw") > 3)
    bench.save("diff")
    again = Workbench(spark, path, row_id=("id",), session=bench.session_folder)
    assert again.dirty_variables == [] and again.save("full") is None
    again.undo("water")
    assert Workbench(spark, path, row_id=("id",), session=bench.session_folder).dirty_variables == ["water"]
    again.close()


def test_the_time_column_is_remembered(spark, tmp_path):
    path = table(spark, tmp_path / "t.parquet")
    bench = Workbench(spark, path, row_id=("id",))
    bench.apply("air", "offset", {"amount": 10}, F.col("raw") > 3)
    bench.set_time_column("water")
    again = Workbench(spark, path, row_id=("id",), session=bench.session_folder)
    assert again.time_column == "water" and again.variables == {}
    again.apply("air", "offset", {"amount": 1}, F.col("raw") > 3)
    third = Workbench(spark, path, row_id=("id",), session=bench.session_folder)
    assert third.time_column == "water" and [e.op_id for e in third.history("air")] == ["offset"]
    assert [r._x for r in third.readings("air").orderBy("id").collect()] == [0, 10, 20, 30, 40, 50]
    third.close()


def test_many_edits_are_compacted_in_a_session(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(patches, "LEAST_TAIL", 3)
    path = table(spark, tmp_path / "t.parquet", rows=20)
    bench = Workbench(spark, path, row_id=("id",))
    want = {i: float(i) for i in range(20)}
    for k in range(8):
        bench.apply("air", "offset", {"amount": k}, F.col("id") % 4 == k % 4)
        want = {i: v + k * (i % 4 == k % 4) for i, v in want.items()}
    store = bench.variables["air"].store
    assert len(store.snapshots) >= 2
    read = lambda b: {r.id: r.corrected for r in b.readings("air").collect()}
    assert read(bench) == want
    bench.remove_edit("air", 7)
    bench.undo("air")
    again = Workbench(spark, path, row_id=("id",), session=bench.session_folder)
    assert len(again.variables["air"].store.snapshots) == len(store.snapshots)
    # the edits 6 and 7 are gone
    assert read(again) == read(bench) == {i: v - 6 * (i % 4 == 2) - 7 * (i % 4 == 3) for i, v in want.items()}
    again.close()


def test_a_closed_session_leaves_only_its_outputs(spark, tmp_path):
    folder = shared_folder(spark).removeprefix("file:")
    path = table(spark, tmp_path / "t.parquet")
    before = set(os.listdir(folder))
    with Workbench(spark, path, row_id=("id",)) as bench:
        rows = bench.select("air", F.col("raw") > 2)
        bench.apply("air", "expression", {"expr": "x - np.median(x)"}, rows)
        bench.apply("air", "delete", {}, bench.detect("air", "spike", {"z_thresh": 1.0}))
        assert bench.select_point("air", 3.0).count() == 1
        bench.save_all()
        assert len(os.listdir(folder)) == len(before) + 1
    assert set(os.listdir(folder)) == before
