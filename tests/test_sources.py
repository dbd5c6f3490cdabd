import datetime
import math

import pytest
from pyspark.sql import functions as F, types as T

from seriesmend.sources.tables import (
    find_time_column,
    read_table,
    table_name,
    table_summary,
    variable_names,
)
from seriesmend.sources.timeaxis import with_time_axis
from seriesmend.sources.variables import open_variable, unpivot_variables


def schema(**kinds):
    return T.StructType([T.StructField(n, k) for n, k in kinds.items()])


S, D, TS = T.StringType(), T.DoubleType(), T.TimestampNTZType()


@pytest.mark.parametrize(
    "fields, expected",
    [
        (dict(a=D, time=S, Date=S), "Date"),
        (dict(a=D, timestamp_local=D, TIMESTAMP=TS), "timestamp_local"),
        (dict(a=D, Time=D), "Time"),
        (dict(a=D, day=T.DateType(), when=TS), "day"),
        (dict(a=D, when=T.TimestampType()), "when"),
        (dict(first=D, second=S), "first"),
    ],
)
def test_time_column(fields, expected):
    assert find_time_column(schema(**fields)) == expected


def test_formats(spark, tmp_path):
    df = spark.createDataFrame([("2024-01-01 00:00:00", 1.5)], "TIMESTAMP string, v double")
    for fmt, path in (("parquet", "t.PARQUET"), ("csv", "t.csv")):
        target = str(tmp_path / path)
        writer = df.write.option("header", True)
        getattr(writer, fmt)(target)
        loaded = read_table(spark, target)
        assert loaded.columns == ["TIMESTAMP", "v"] and loaded.first()["v"] == 1.5
        assert table_name(target) == "t"
    typed = read_table(spark, str(tmp_path / "t.csv"), schema(TIMESTAMP=S, v=S))
    assert typed.first()["TIMESTAMP"] == "2024-01-01 00:00:00"
    inferred = read_table(spark, str(tmp_path / "t.csv"))
    assert isinstance(inferred.schema["TIMESTAMP"].dataType, (T.TimestampType, T.TimestampNTZType))
    with pytest.raises(ValueError, match="not .xml"):
        read_table(spark, "t.xml")
    assert variable_names(typed, "TIMESTAMP") == ["v"]
    assert tuple(table_summary(typed, "TIMESTAMP").first()) == (1, 1)


def axis(spark, values, kind):
    df = spark.createDataFrame([(v,) for v in values], f"t {kind}")
    return [(r["ts"], r["x_epoch"]) for r in with_time_axis(df, "t").collect()]


def test_time_axis(spark):
    noon = datetime.datetime(2024, 1, 1, 12)
    x = 1704110400.0
    assert axis(spark, [noon, None], "timestamp_ntz") == [(noon, x), (None, None)]
    assert axis(spark, [noon.date()], "date") == [(datetime.datetime(2024, 1, 1), x - 43200)]
    assert axis(spark, ["2024-01-01T12:00:00", "2024-01-01 12:00:00.5", "01/01/2024 12:00", "?"], "string") == [
        (noon, x), (noon.replace(microsecond=500000), x + 0.5), (noon, x), (None, None),
    ]
    assert axis(spark, [x, x + 0.25, -1.5], "double") == [
        (noon, x), (noon.replace(microsecond=250000), x + 0.25),
        (datetime.datetime(1969, 12, 31, 23, 59, 58, 500000), -1.5),
    ]
    assert axis(spark, [1704110400], "int") == [(noon, x)]
    assert axis(spark, [math.nan, math.inf, 1e300], "double") == [(None, None)] * 3


def test_variables(spark):
    df = spark.createDataFrame(
        [(1, "1.5", True, math.nan, 3), (2, "n/a", False, math.inf, None)],
        "i int, text string, flag boolean, v double, n int",
    )
    raw = lambda name: [r["raw"] for r in open_variable(df, name, ("i",)).orderBy("i").collect()]
    assert raw("text") == [1.5, None]
    assert raw("flag") == [1.0, 0.0]
    assert raw("v") == [None, math.inf]
    assert raw("n") == [3.0, None]
    timed = df.withColumn("t", F.lit("1970-01-01 00:00:01").cast("timestamp_ntz"))
    assert open_variable(timed, "t", ("i",)).first()["raw"] == 1e6
    long = unpivot_variables(df, ["text", "n"], ("i",))
    assert sorted(map(tuple, long.select("i", "variable", "raw").collect()), key=str) == [
        (1, "n", 3.0), (1, "text", 1.5), (2, "n", None), (2, "text", None),
    ]
