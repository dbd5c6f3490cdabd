import datetime

import pytest

from seriesmend.sources.annotations import load_annotations, unread_annotation_times
from seriesmend.sources.timeshapes import TimeShapes, shapes_of
from seriesmend.workbench import Workbench

D = datetime.datetime


def read(spark, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    shapes = shapes_of(df, "t")
    return shapes, [r[0] for r in df.select("i", shapes.parse(df["t"]).alias("x")).orderBy("i").select("x").collect()]


@pytest.mark.parametrize("texts, want", [
    (["12/31/2024 10:00", "01/02/2024 11:00"], [D(2024, 12, 31, 10), D(2024, 1, 2, 11)]),
    (["31/12/2024 10:00", "01/02/2024 11:00"], [D(2024, 12, 31, 10), D(2024, 2, 1, 11)]),
    (["01/02/2024", "3.4.2024"], [D(2024, 2, 1), D(2024, 4, 3)]),                      # both fit: day first
    (["13/12/2024", "12/13/2024", "12/14/2024"], [None, D(2024, 12, 13), D(2024, 12, 14)]),   # most win
    (["5 Jan 24", "Sept. 3rd, 1999", "dec 31 69", "1-may-68"], [D(2024, 1, 5), D(1999, 9, 3), D(1969, 12, 31), D(2068, 5, 1)]),
    (["Tue, 02 Jan 2024 03:04:05", "Wednesday 3 January 2024"], [D(2024, 1, 2, 3, 4, 5), D(2024, 1, 3)]),
    (["1/2/2024 12:05 AM", "1/2/2024 12:05 p.m.", "1/2/2024 3:05:06 pm", "1/2/2024 13:05 PM", "1/2/2024 0:05 am"],
     [D(2024, 2, 1, 0, 5), D(2024, 2, 1, 12, 5), D(2024, 2, 1, 15, 5, 6), None, None]),
    (["2024-31-12 10:00", "2024-05-06 10:00"], [D(2024, 12, 31, 10), D(2024, 5, 6, 10)]),
    (["2024/1/2 03:04:05.123456789", "2024-01-02T03:04:05+02:00"], [D(2024, 1, 2, 3, 4, 5, 123456), D(2024, 1, 2, 1, 4, 5)]),
    (["30/02/2024", "29/02/2023", "1/2/2024 25:00", "99/99/9999", "soon", "", None, "1/2", "12 foo 2024", "20240102"],
     [None, None, None, None, None, None, None, None, None, D(2024, 1, 2)]),
    (["x" * 100_000, "1/" * 50_000, "1 " * 50_000], [None, None, None]),
])
def test_times_are_read_by_their_fields(spark, texts, want):
    assert read(spark, texts)[1] == want


def test_times_at_the_edges(spark):
    texts = ["1/2/2024 23:59:59", "1/2/2024 10:00:60", "1/2/2024 24:00", "1/2/0001", "0/2/2024", "1/0/2024",
             "1/2/2024 10:60", "Mon", "a|b|c|d|e|f|g|h", "1|2|2024|||||", "June 3 2024", "2024 June 3", "3 June 2024", "+2024-01-02", " 2024-01-02", "2024-1-2"]
    want = [D(2024, 2, 1, 23, 59, 59), None, None, D(1, 2, 1), None, None,
            None, None, None, None, D(2024, 6, 3), D(2024, 6, 3), D(2024, 6, 3), None, D(2024, 1, 2), D(2024, 1, 2)]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    assert [r["x"] for r in df.select("i", TimeShapes().parse(df["t"]).alias("x")).orderBy("i").collect()] == want


def test_a_text_is_cut_once_and_tried_by_iso_layouts_only_where_a_year_leads(spark):
    df = spark.createDataFrame([("01/02/2024",)], "t string").repartition(1)
    seen = []
    frame = type(df)
    chosen = frame.agg
    try:
        frame.agg = lambda self, *a: seen.append(self._jdf.queryExecution().optimizedPlan().toString()) or chosen(self, *a)
        shapes_of(df, "t")
    finally:
        frame.agg = chosen
    assert len(seen) == 1 and seen[0].count("regexp_replace") == 2
    plan = df.select(TimeShapes().parse(df["t"]).alias("x"))._jdf.queryExecution().optimizedPlan().toString()
    assert "[+-]?" in plan and plan.count("regexp_replace") == 2 and "format_string" not in plan


def test_an_order_is_decided_once_over_several_columns(spark):
    df = spark.createDataFrame([("01/02/2024", "12/31/2024"), ("03/04/2024", None)], "start string, end string")
    assert shapes_of(df, "start") == TimeShapes() and shapes_of(df, "start", "end") == TimeShapes(month_first=True)
    assert shapes_of(df.limit(0), "start") == TimeShapes()
    assert shapes_of(spark.range(1), "id") == TimeShapes()


def test_events_with_the_month_first_are_kept_and_unread_ones_counted(spark, tmp_path):
    path = f"{tmp_path}/events.csv"
    rows = [("12/31/2024 10:00", "", "a"), ("01/13/2025 11:00", "01/14/2025 09:30 PM", "b"), ("later", "never", "c"), ("", "", "d")]
    spark.createDataFrame(rows, "start string, end string, label string").coalesce(1).write.csv(path, header=True)
    got = {r["label"]: (r["start_dt"], r["end_dt"], r["is_punctual"]) for r in load_annotations(spark, path).collect()}
    assert got["a"] == (D(2024, 12, 31, 10), None, True)
    assert got["b"] == (D(2025, 1, 13, 11), D(2025, 1, 14, 21, 30), False)
    assert got["c"][:2] == got["d"][:2] == (None, None)
    assert unread_annotation_times(load_annotations(spark, path)) == 2
    table = f"{tmp_path}/t.parquet"
    spark.createDataFrame([(D(2025, 1, 14, 8), 1.0)], "TIME timestamp_ntz, v double").write.parquet(table)
    with Workbench(spark, table) as bench:
        assert bench.unread_event_times() == 0
        bench.load_events(path)
        assert bench.unread_event_times() == 2
        assert [r["event"] for r in bench.annotate("v").collect()] == ["b"]
