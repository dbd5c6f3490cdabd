"""Whole sessions over the given tables: corrections, outputs that are read again, csv."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from seriesmend.model import SeriesSpec
from seriesmend.operators.coincide import coincident_runs_each
from seriesmend.operators.detect import detect_frozen
from seriesmend.plans.staging import shared_folder
from seriesmend.sinks.files import output_path
from seriesmend.sources.footers import ranges_from_footers, summary_from_footers
from seriesmend.sources.tables import read_table
from seriesmend.streaming.frozen import current_runs, run_stream, stream_runs
from seriesmend.sources.variables import unpivot_variables
from seriesmend.workbench import Workbench
from seriesmend.workload.registry import GAPPED_SQL, LINE_KEY, READINGS, gapped, query, table
from seriesmend.workload.sources_and_selection import LINE_VARIABLES


def _output_folder(spark) -> str:
    return f"{shared_folder(spark)}/outputs-{uuid.uuid4().hex}"


def _session(spark, folder, output) -> Workbench:
    return Workbench(
        spark, f"{folder}/events.parquet", keys=("event_type",), row_id=("event_id",), output_folder=output
    )


@query(
    "session_full_merge",
    """SELECT event_id, event_type, ts, props,
         CASE WHEN event_type = 'click' THEN value + 10 ELSE value END AS value,
         CASE WHEN user_id % 2 = 0 THEN user_id * 2 ELSE user_id END::DOUBLE AS user_id
       FROM events""",
)
def session_full_merge(spark, folder):
    """A second session corrects another variable; its full output keeps the first one's fixes."""
    output = _output_folder(spark)
    with _session(spark, folder, output) as first:
        first.apply("value", "offset", {"amount": 10}, F.col("event_type") == "click")
        first.save("full")
    with _session(spark, folder, output) as second:
        second.apply("user_id", "multiply", {"factor": 2}, F.col("raw") % 2 == 0)
        path = second.save("full")
    return spark.read.parquet(path)


@query(
    "save_full_changed_files",
    """SELECT event_id, event_type, user_id, ts, props,
         CASE WHEN event_id BETWEEN 500 AND 620 THEN value - 3 ELSE value END AS value
       FROM events""",
)
def save_full_changed_files(spark, folder):
    """Eight output files; a second session's edit lies in some of them, the others stay."""
    output = _output_folder(spark)
    whole = table(spark, folder, "events")
    path = output_path(f"{folder}/events.parquet", "full", folder=output)
    whole.repartitionByRange(8, "event_id").write.parquet(path)
    with _session(spark, folder, output) as bench:
        bench.apply("value", "offset", {"amount": -3}, F.col("event_id").between(500, 620))
        bench.save("full")
    return spark.read.parquet(path)


@query(
    "session_edit_replay",
    """SELECT event_id, CASE WHEN event_type = 'error' AND value > 300 THEN NULL
         WHEN value > 90 THEN value + 10 ELSE value END AS corrected FROM events""",
)
def session_edit_replay(spark, folder):
    """Frozen selection, offset, multiply, remove, undo, delete: the values that are left."""
    bench = _session(spark, folder, None)
    picked = bench.select("value", F.col("raw") > 50)
    bench.apply("value", "offset", {"amount": 10}, picked)
    bench.apply("value", "multiply", {"factor": 2}, F.col("corrected") > 100)
    bench.remove_edit("value", 0)
    bench.undo("value")   # writes back what the multiplication found, the offset included
    bench.apply("value", "delete", {}, (F.col("event_type") == "error") & (F.col("raw") > 300))
    return bench.readings("value").select("event_id", "corrected")


@query(
    "csv_table",
    """SELECT o_orderstatus, count(*) AS orders, sum(o_orderkey)::BIGINT AS keys,
         min(o_orderpriority) AS first_priority, max(epoch_us(o_orderdate)) AS last_us
       FROM orders GROUP BY o_orderstatus""",
)
def csv_table(spark, folder):
    """Orders written as csv and read with the schema they had."""
    orders = table(spark, folder, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority", "o_orderdate")
    path = f"{_output_folder(spark)}/orders.csv"
    orders.write.csv(path, header=True)
    read = read_table(spark, path, orders.schema)
    return read.groupBy("o_orderstatus").agg(
        F.count(F.lit(1)).alias("orders"), F.sum("o_orderkey").alias("keys"),
        F.min("o_orderpriority").alias("first_priority"),
        F.max(F.unix_micros(F.col("o_orderdate").cast("timestamp"))).alias("last_us"),
    )


LINE_SERIES = SeriesSpec(("variable",), ("l_shipdate",), LINE_KEY[:-1], "corrected")

FROZEN_LINES_SQL = f"""
  WITH long AS ({" UNION ALL ".join(f"SELECT {', '.join(LINE_KEY)}, '{v}' AS variable, {v} AS reading FROM lineitem" for v in LINE_VARIABLES)}),
  steps AS (
    SELECT *, CASE WHEN abs(reading - lag(reading) OVER w) <= 0 THEN 0 ELSE 1 END AS brk FROM long
    WINDOW w AS (PARTITION BY variable ORDER BY l_shipdate, {', '.join(LINE_KEY[:-1])})),
  runs AS (SELECT *, sum(brk) OVER (PARTITION BY variable ORDER BY l_shipdate, {', '.join(LINE_KEY[:-1])}) AS run FROM steps),
  sized AS (SELECT *, count(*) OVER (PARTITION BY variable, run) AS n FROM runs)
  SELECT variable, l_orderkey, l_linenumber, n AS length FROM sized WHERE n >= 3
"""


@query("detect_frozen_variables", FROZEN_LINES_SQL)
def detect_frozen_variables(spark, folder):
    """Stuck values of four variables at once, each a series of its own."""
    long = unpivot_variables(table(spark, folder, "lineitem"), LINE_VARIABLES, LINE_KEY)
    found = detect_frozen(long, LINE_SERIES, 3, 0.0)
    return found.select("variable", "l_orderkey", "l_linenumber", F.col("score").cast("long").alias("length"))


def coincident_sql(k: int) -> str:
    order = f"l_shipdate, {', '.join(LINE_KEY[:-1])}"
    flags = []
    for v in LINE_VARIABLES:
        flags.append(f"""SELECT *, count(*) OVER (PARTITION BY run) >= 2 AS stuck FROM (
          SELECT *, sum(brk) OVER (ORDER BY {order}) AS run FROM (
            SELECT {', '.join(LINE_KEY)}, CASE WHEN abs({v} - lag({v}) OVER w) <= 0.03 THEN 0 ELSE 1 END AS brk
            FROM lineitem WINDOW w AS (ORDER BY {order})))""")
    return f"""SELECT {k} AS variables, min(l_shipdate) AS start_l_shipdate, max(l_shipdate) AS end_l_shipdate,
        arg_min(l_orderkey, place) AS start_l_orderkey, arg_max(l_orderkey, place) AS end_l_orderkey, count(*) AS points
      FROM (SELECT *, place - row_number() OVER (ORDER BY place) AS island FROM (
        SELECT *, row_number() OVER (ORDER BY {order}) AS place FROM (
          SELECT {', '.join(LINE_KEY)}, sum(stuck::INT) AS together FROM ({" UNION ALL ".join(f"({f})" for f in flags)})
          GROUP BY {', '.join(LINE_KEY)})) WHERE together >= {k})
      GROUP BY island"""


@query("coincident_runs", " UNION ALL ".join(f"({coincident_sql(k)})" for k in (2, 3)))
def q_coincident_runs(spark, folder):
    """Where two or three of the variables of the lines hardly move at the same time."""
    long = unpivot_variables(table(spark, folder, "lineitem"), LINE_VARIABLES, LINE_KEY)
    shown = ("start_l_shipdate", "end_l_shipdate", "start_l_orderkey", "end_l_orderkey", "points")
    return coincident_runs_each(long, LINE_SERIES, (2, 3), 2, 0.03).select("variables", *shown)


STREAM_SQL = f"""
  WITH steps AS (
    SELECT *, CASE WHEN abs(value - lag(value) OVER w) <= 5 THEN 0 ELSE 1 END AS brk
    FROM (SELECT event_id, event_type, ts, {GAPPED_SQL} AS value FROM events)
    WINDOW w AS (PARTITION BY event_type ORDER BY ts, event_id)),
  runs AS (SELECT *, sum(brk) OVER (PARTITION BY event_type ORDER BY ts, event_id) AS run FROM steps)
  SELECT event_type, min(ts) AS start_ts, max(ts) AS end_ts, arg_min(event_id, (ts, event_id)) AS start_event_id,
    arg_max(event_id, (ts, event_id)) AS end_event_id, count(*) AS points
  FROM runs GROUP BY event_type, run HAVING count(*) >= 2
"""


@query("stream_frozen", STREAM_SQL)
def stream_frozen(spark, folder):
    """The readings arrive in four files, some up to an hour late; the stream is restarted once."""
    root = _output_folder(spark)
    arrival = F.unix_micros(F.col("ts").cast("timestamp")) + F.pmod(F.xxhash64("event_id"), F.lit(3_600_000_000))
    events = gapped(spark, folder).select("event_id", "event_type", "ts", "value", arrival.alias("arrival"))
    ends = events.agg(F.min("arrival").alias("low"), F.max("arrival").alias("high")).first()
    step = ((ends["high"] - ends["low"]) // 4 + 1) if ends["low"] is not None else 1
    part = F.floor((F.col("arrival") - (ends["low"] or 0)) / step)
    for n in range(4):
        events.filter(part == n).drop("arrival").coalesce(1).write.mode("append").parquet(f"{root}/in")
        if n % 2:
            stream = spark.readStream.schema(events.drop("arrival").schema).option("maxFilesPerTrigger", 1).parquet(f"{root}/in")
            run_stream(stream_runs(stream, READINGS, "2 hours", 2, 5.0), f"{root}/out", f"{root}/state")
    return current_runs(spark.read.parquet(f"{root}/out"), READINGS)


@query("table_summary_metadata", "SELECT count(*) AS rows, (SELECT count(*) - 1 FROM (DESCRIBE SELECT * FROM lineitem))::INT AS variables FROM lineitem")
def table_summary_metadata(spark, folder):
    """Rows and variables of the lines, from footers."""
    return summary_from_footers(spark, f"{folder}/lineitem.parquet")


@query("series_extent_metadata", " UNION ALL ".join(
    f"SELECT '{v}' AS variable, min({v})::DOUBLE AS y_min, max({v})::DOUBLE AS y_max, count({v}) AS present FROM lineitem"
    for v in (*LINE_VARIABLES, "l_linenumber")))
def series_extent_metadata(spark, folder):
    """The ranges of five columns of the lines, from footers."""
    return ranges_from_footers(spark, f"{folder}/lineitem.parquet", [*LINE_VARIABLES, "l_linenumber"])
