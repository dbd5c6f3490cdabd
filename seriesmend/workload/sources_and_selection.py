"""Time axis, variables, annotations tables and selections."""

from __future__ import annotations

import datetime

from pyspark.sql import functions as F

from seriesmend.operators import select
from seriesmend.operators.bitmaps import RowIndex
from seriesmend.operators.correct import correct
from seriesmend.operators.detect import candidates_as_selection, detect_frozen
from seriesmend.sources.annotations import (
    annotation_shapes,
    annotation_geometry,
    annotation_text,
    annotations_for_table,
    normalize_annotations,
)
from seriesmend.sources.tables import find_time_column, table_summary
from seriesmend.sources.timeshapes import shapes_of, time_by_shapes
from seriesmend.sources.timeaxis import epoch_micros, epoch_seconds, formats_for, unread_times, with_time_axis
from seriesmend.sources.variables import open_variable, unpivot_variables
from seriesmend.workload.registry import (
    GAPPED_SQL,
    LINE_KEY,
    PRICES,
    READINGS,
    gapped,
    query,
    readings,
    table,
)


@query("time_axis_epoch", "SELECT event_id, epoch_us(ts) / 1e6 AS x_epoch FROM events")
def time_axis_epoch(spark, folder):
    events = readings(spark, folder)
    return with_time_axis(events, find_time_column(events.schema)).select("event_id", "x_epoch")


@query(
    "time_axis_numeric",
    "SELECT o_orderkey, epoch_us(o_orderdate) / 1e6 + 0.25 AS x_epoch FROM orders",
)
def time_axis_numeric(spark, folder):
    seconds = epoch_micros(F.col("o_orderdate")) / 1e6 + 0.25
    orders = table(spark, folder, "orders").select("o_orderkey", seconds.alias("time"))
    return with_time_axis(orders, "time").select("o_orderkey", "x_epoch")


# one layout for each of six kinds of orders
TEXT_LAYOUTS = (
    "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss'Z'", "yyyy-MM-dd'T'HH:mm:ss'+02:00'",
    "yyyy-MM-dd HH:mm:ss.SSSSSS'789'", "dd.MM.yyyy HH:mm", "dd/MM/yyyy",
)


@query(
    "time_axis_text",
    """SELECT o_orderkey, CASE WHEN o_orderstatus <> 'P' THEN
         epoch_us(o_orderdate) / 1e6 - CASE WHEN o_orderkey % 6 = 2 THEN 7200 ELSE 0 END END AS x_epoch
       FROM orders""",
)
def time_axis_text(spark, folder):
    text = F.col("o_orderpriority")   # no time
    for n, layout in enumerate(TEXT_LAYOUTS):
        this = (F.col("o_orderstatus") != "P") & (F.col("o_orderkey") % len(TEXT_LAYOUTS) == n)
        text = F.when(this, F.date_format("o_orderdate", layout)).otherwise(text)
    orders = table(spark, folder, "orders").select("o_orderkey", text.alias("time"))
    return with_time_axis(orders, "time").select("o_orderkey", "x_epoch")


@query(
    "time_axis_month_first",
    """SELECT count(*) FILTER (WHERE o_orderstatus <> 'P') AS times,
         count(*) FILTER (WHERE o_orderstatus = 'P') AS unread,
         sum(epoch_us(o_orderdate) // 1000000) FILTER (WHERE o_orderstatus <> 'P')::BIGINT AS seconds FROM orders""",
)
def time_axis_month_first(spark, folder):
    """A column with the month first is recognised as such, for all its rows."""
    text = F.when(F.col("o_orderstatus") != "P", F.date_format("o_orderdate", "MM/dd/yyyy HH:mm")).otherwise("soon")
    orders = table(spark, folder, "orders").select(text.alias("time"))
    formats = formats_for(orders, "time")
    timed = with_time_axis(orders, "time", formats=formats)
    return timed.agg(
        F.count("x_epoch").alias("times"), unread_times(orders, "time", formats).alias("unread"),
        F.sum(F.col("x_epoch").cast("long")).alias("seconds"),
    )


@query(
    "variable_cast",
    """SELECT event_id, TRY_CAST(reading AS DOUBLE) AS raw, TRY_CAST(reading AS DOUBLE) AS corrected
       FROM (SELECT event_id, CASE WHEN event_type = 'view' THEN event_type
                                   ELSE CAST(value AS VARCHAR) END AS reading FROM events)""",
)
def variable_cast(spark, folder):
    text = F.when(F.col("event_type") == "view", F.col("event_type")).otherwise(
        F.col("value").cast("string")
    )
    return open_variable(readings(spark, folder).withColumn("reading", text), "reading", ("event_id",))


LINE_VARIABLES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query(
    "unpivot_variables",
    " UNION ALL ".join(
        f"SELECT {', '.join(LINE_KEY)}, '{v}' AS variable, {v} AS raw, {v} AS corrected FROM lineitem"
        for v in LINE_VARIABLES
    ),
)
def unpivot(spark, folder):
    return unpivot_variables(table(spark, folder, "lineitem"), LINE_VARIABLES, LINE_KEY)


@query(
    "table_summary",
    "SELECT count(*) AS rows, 5 AS variables FROM events",
)
def summary(spark, folder):
    events = readings(spark, folder)
    return table_summary(events, find_time_column(events.schema))


# --- annotations derived from the readings: every reading is remarked ---

ANNOTATIONS_SQL = """
  SELECT event_id AS event_no, ts AS start_dt,
         CASE event_type
           WHEN 'error' THEN make_timestamp(epoch_us(ts) + CAST(round(value * 100) AS BIGINT) * 600000)
           WHEN 'view' THEN make_timestamp(epoch_us(ts) - CAST(round(value * 100) AS BIGINT) * 300000)
           WHEN 'click' THEN ts END AS end_dt,
         CASE event_type WHEN 'error' THEN '*' WHEN 'purchase' THEN 'billing'
                         WHEN 'signup' THEN NULL ELSE 'events' END AS "table",
         event_type AS label,
         CASE WHEN value > 250 THEN 'severe' END AS category,
         CASE WHEN event_type = 'view' THEN props END AS description
  FROM events
"""

GEOMETRY_SQL = f"""
  SELECT event_no, "table", label, coalesce(category, '') AS category,
         coalesce(description, '') AS description,
         CASE WHEN end_dt IS NULL OR end_dt = start_dt THEN 'instant' ELSE 'period' END AS shape,
         least(start_dt, coalesce(end_dt, start_dt)) AS lo,
         greatest(start_dt, coalesce(end_dt, start_dt)) AS hi
  FROM ({ANNOTATIONS_SQL})
"""


def annotations(spark, folder):
    """An annotations table as a user would write it: start (as text), end, table, texts."""
    kind, value = F.col("event_type"), F.col("value")
    hundredths = F.round(value * 100).cast("long")
    end = (
        F.when(kind == "error", epoch_micros(F.col("ts")) + hundredths * 600000)
        .when(kind == "view", epoch_micros(F.col("ts")) - hundredths * 300000)
        .when(kind == "click", epoch_micros(F.col("ts")))
    )
    applies = (
        F.when(kind == "error", "*")
        .when(kind == "purchase", "billing")
        .when(kind == "signup", F.lit(None))
        .otherwise("events")
    )
    return readings(spark, folder).select(
        F.col("event_id").alias("event_no"),
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("start"),
        F.timestamp_micros(end).cast("timestamp_ntz").alias("end"),
        applies.alias("table"),
        kind.alias("label"),
        F.when(value > 250, "severe").alias("category"),
        F.when(kind == "view", F.col("props")).alias("description"),
    )


@query(
    "events_normalize",
    f"""SELECT event_no, start_dt, end_dt, (end_dt IS NULL OR end_dt = start_dt) AS is_punctual
        FROM ({ANNOTATIONS_SQL})""",
)
def events_normalize(spark, folder):
    return normalize_annotations(annotations(spark, folder)).select(
        "event_no", "start_dt", "end_dt", "is_punctual"
    )


@query(
    "events_for_table",
    f"""SELECT event_no, "table", label FROM ({ANNOTATIONS_SQL})
        WHERE "table" = '*' OR "table" = 'events'""",
)
def events_for_table(spark, folder):
    return annotations_for_table(annotations(spark, folder), "events").select(
        "event_no", "table", "label"
    )


@query(
    "event_geometry",
    f"SELECT event_no, shape, lo, hi, label, category, description FROM ({GEOMETRY_SQL})",
)
def event_geometry(spark, folder):
    return annotation_geometry(normalize_annotations(annotations(spark, folder))).select(
        "event_no", "shape", "lo", "hi", "label", "category", "description"
    )


@query(
    "event_label",
    f"""SELECT event_no, label || CASE WHEN category <> '' THEN '  [' || category || ']' ELSE '' END
               || CASE WHEN description <> '' THEN chr(10) || description ELSE '' END AS text
        FROM ({GEOMETRY_SQL})""",
)
def event_label(spark, folder):
    shown = annotation_geometry(normalize_annotations(annotations(spark, folder)))
    text = annotation_text(F.col("label"), F.col("category"), F.col("description"))
    return shown.select("event_no", text.alias("text"))


# --- selections ---------------------------------------------------------------

X0, X1 = datetime.datetime(2024, 1, 10), datetime.datetime(2024, 1, 12, 12)
X_SQL = "ts BETWEEN TIMESTAMP '2024-01-10 00:00:00' AND TIMESTAMP '2024-01-12 12:00:00'"


@query("select_x_range", f"SELECT event_id, value FROM events WHERE {X_SQL}")
def select_x_range(spark, folder):
    return readings(spark, folder).filter(select.x_range(F.col("ts"), X0, X1)).select(
        "event_id", "value"
    )


@query(
    "select_y_range",
    """SELECT event_id, value FROM (
         SELECT event_id, CASE WHEN event_type = 'view' THEN value * 2 ELSE value END AS value
         FROM events) WHERE value BETWEEN 100 AND 120""",
)
def select_y_range(spark, folder):
    doubled = correct(
        readings(spark, folder), READINGS, "multiply", {"factor": 2}, F.col("event_type") == "view"
    )
    return doubled.filter(select.y_range(F.col("value"), 100, 120)).select("event_id", "value")


@query(
    "select_xy_rect",
    f"SELECT event_id, value FROM events WHERE {X_SQL} AND value BETWEEN 20 AND 75.5",
)
def select_xy_rect(spark, folder):
    box = select.xy_rectangle(F.col("ts"), F.col("value"), (X1, 20.0), (X0, 75.5))
    return readings(spark, folder).filter(box).select("event_id", "value")


@query(
    "selection_count",
    """SELECT event_type, CAST(count(*) FILTER (WHERE value BETWEEN 20 AND 75.5) AS BIGINT) AS selected
       FROM events GROUP BY event_type""",
)
def selection_count(spark, folder):
    return select.selection_count(
        readings(spark, folder), select.y_range(F.col("value"), 20.0, 75.5), ("event_type",)
    )


NEAREST_SQL = """
  SELECT {keys}, {shown} FROM (
    SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY
        abs(epoch_us({x}) - {probe}), epoch_us({x}) < {probe},
        CASE WHEN epoch_us({x}) < {probe} THEN -{tie} ELSE {tie} END) AS place
    FROM {source}) WHERE place = 1
"""


@query(
    "select_nearest_point",
    NEAREST_SQL.format(
        keys="o_orderpriority", shown="o_orderdate, o_orderkey, o_totalprice", x="o_orderdate",
        probe="epoch_us(TIMESTAMP '1998-06-15 12:00:00')", tie="o_orderkey", source="orders",
    ),
)
def select_nearest_point(spark, folder):
    orders = table(spark, folder, "orders")
    return select.nearest_point(
        orders, PRICES, "o_orderdate", datetime.datetime(1998, 6, 15, 12)
    )


@query(
    "select_nearest_points",
    """WITH days AS (
         SELECT o_orderpriority, o_orderdate, min(o_orderkey) AS first_key, max(o_orderkey) AS last_key
         FROM orders GROUP BY ALL),
       probes AS (SELECT DISTINCT o_orderpriority, l_shipdate FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
       before AS (
         SELECT p.*, d.o_orderdate AS b_date, d.last_key AS b_key FROM probes p ASOF LEFT JOIN days d
         ON p.o_orderpriority = d.o_orderpriority AND p.l_shipdate > d.o_orderdate),
       both_sides AS (
         SELECT p.*, d.o_orderdate AS a_date, d.first_key AS a_key FROM before p ASOF LEFT JOIN days d
         ON p.o_orderpriority = d.o_orderpriority AND p.l_shipdate <= d.o_orderdate),
       hits AS (
         SELECT o_orderpriority, l_shipdate,
                CASE WHEN a_date IS NULL OR (b_date IS NOT NULL AND l_shipdate - b_date < a_date - l_shipdate)
                     THEN b_key ELSE a_key END AS o_orderkey
         FROM both_sides)
       SELECT h.o_orderpriority, h.l_shipdate, h.o_orderkey, o.o_orderdate, o.o_totalprice
       FROM hits h JOIN orders o USING (o_orderkey)""",
)
def select_nearest_points(spark, folder):
    """For every ship date of a priority, the order of that priority nearest to it."""
    orders = table(spark, folder, "orders")
    lines = table(spark, folder, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_shipdate")
    probes = lines.join(orders.select("o_orderkey", "o_orderpriority"), "o_orderkey").select(
        "o_orderpriority", "l_shipdate"
    ).distinct()
    return select.nearest_points(orders, probes, PRICES, "o_orderdate", "l_shipdate")


@query(
    "nearest_point_value",
    f"""WITH readings AS (SELECT event_id, event_type, ts, {GAPPED_SQL} AS value FROM events),
        times AS (SELECT event_type, ts, min(event_id) AS first_id, max(event_id) AS last_id FROM events GROUP BY ALL),
        probes AS (SELECT event_id AS probe_id, event_type, ts + INTERVAL 37 SECOND AS asked FROM events),
        before AS (SELECT p.*, t.ts AS b_ts, t.last_id AS b_id
                   FROM probes p ASOF LEFT JOIN times t ON p.event_type = t.event_type AND p.asked > t.ts),
        both_sides AS (SELECT p.*, t.ts AS a_ts, t.first_id AS a_id
                       FROM before p ASOF LEFT JOIN times t ON p.event_type = t.event_type AND p.asked <= t.ts),
        hits AS (SELECT probe_id, CASE WHEN a_ts IS NULL OR (b_ts IS NOT NULL AND asked - b_ts < a_ts - asked)
                                       THEN b_id ELSE a_id END AS event_id FROM both_sides)
        SELECT probe_id, event_id, value FROM hits JOIN readings USING (event_id)""",
)
def nearest_point_value(spark, folder):
    """For a time just after every reading, the nearest reading of its type, if it is finite."""
    events = gapped(spark, folder)
    probes = events.select(
        "event_type", (F.col("ts") + F.expr("INTERVAL 37 SECONDS")).alias("asked"), F.col("event_id").alias("probe_id")
    )
    found = select.nearest_points(events, probes, READINGS, "ts", "asked")
    return found.select("probe_id", "event_id", select.finite_reading(F.col("value")).alias("value"))


@query(
    "select_detected",
    """WITH steps AS (
         SELECT *, CASE WHEN abs(value - lag(value) OVER w) <= 5.0 THEN 0 ELSE 1 END AS brk
         FROM events WINDOW w AS (PARTITION BY event_type ORDER BY ts, event_id)),
       runs AS (SELECT *, sum(brk) OVER (PARTITION BY event_type ORDER BY ts, event_id) AS run FROM steps),
       sized AS (SELECT *, count(*) OVER (PARTITION BY event_type, run) AS n FROM runs)
       SELECT event_id, user_id, value FROM sized WHERE n >= 3""",
)
def select_detected(spark, folder):
    events = readings(spark, folder)
    found = detect_frozen(events, READINGS, 3, 5.0)
    return candidates_as_selection(events, READINGS, found).select("event_id", "user_id", "value")


# what is selected: high readings, two kinds of event, stuck readings
HIGH, TWO_KINDS = "value > 50", "event_type IN ('click', 'view')"
ALGEBRA_SQL = f"""
  WITH steps AS (
    SELECT *, CASE WHEN abs(value - lag(value) OVER w) <= 5 THEN 0 ELSE 1 END AS brk
    FROM (SELECT event_id, event_type, ts, {GAPPED_SQL} AS value FROM events)
    WINDOW w AS (PARTITION BY event_type ORDER BY ts, event_id)),
  runs AS (SELECT *, sum(brk) OVER (PARTITION BY event_type ORDER BY ts, event_id) AS run FROM steps),
  marked AS (SELECT event_id, coalesce({HIGH}, false) AS a, {TWO_KINDS} AS b,
               count(*) OVER (PARTITION BY event_type, run) >= 3 AS c FROM runs)
  SELECT 'union' AS op, event_id FROM marked WHERE a OR b
  UNION ALL SELECT 'intersection', event_id FROM marked WHERE a AND b
  UNION ALL SELECT 'difference', event_id FROM marked WHERE a AND NOT b
  UNION ALL SELECT 'inverted', event_id FROM marked WHERE NOT a
  UNION ALL SELECT 'stuck outside', event_id FROM marked WHERE c AND NOT (a OR b)
  UNION ALL SELECT 'counted', count(*) FROM marked WHERE (a OR c) AND NOT (a AND c)
"""


@query("select_bitmap_algebra", ALGEBRA_SQL)
def select_bitmap_algebra(spark, folder):
    """Set operations on selections, back as rows; the last one is only counted."""
    events = gapped(spark, folder)
    index = RowIndex.build(events, READINGS, ("value",))
    a, b = index.select(F.expr(HIGH)).frozen(), index.select(F.expr(TWO_KINDS)).frozen()
    c = index.select_rows(detect_frozen(events, READINGS, 3, 5.0)).frozen()
    sets = {
        "union": a.union(b), "intersection": a.intersection(b), "difference": a.difference(b),
        "inverted": a.inverted(), "stuck outside": c.difference(a.union(b)),
    }
    counted = a.union(c).difference(a.intersection(c)).counts()
    out = counted.select(F.lit("counted").alias("op"), F.col("selected").alias("event_id"))
    for op, chosen in sets.items():
        out = out.unionByName(chosen.rows().select(F.lit(op).alias("op"), "event_id"))
    return out


# layouts a column may have, and how exact they are in seconds
LAYOUTS = {
    "MM/dd/yyyy hh:mm a": 60, "dd.MM.yy HH:mm:ss": 1, "MMM d, yyyy": 86400, "d MMMM yyyy h:mm:ss a": 1,
    "yyyy/MM/dd HH:mm": 60, "EEE, dd-MMM-yy HH:mm": 60,
}
DAY_SECONDS = "(o_orderkey * 7919) % 86400"


@query("time_axis_shapes", " UNION ALL ".join(
    f"""SELECT {i} AS layout, o_orderkey, floor((epoch_us(o_orderdate) / 1000000 + {DAY_SECONDS}) / {exact}) * {exact}::DOUBLE AS x_epoch
        FROM orders""" for i, exact in enumerate(LAYOUTS.values())))
def time_axis_shapes(spark, folder):
    """Dates of orders written in six layouts, each column read by what its fields tell."""
    at = F.timestamp_seconds(F.unix_micros(F.col("o_orderdate").cast("timestamp")) / 1_000_000 + F.expr(DAY_SECONDS))
    orders = table(spark, folder, "orders").select("o_orderkey", *[
        F.date_format(at, layout).alias(f"t{i}") for i, layout in enumerate(LAYOUTS)])
    out = None
    for i in range(len(LAYOUTS)):
        x = epoch_seconds(time_by_shapes(orders, f"t{i}", shapes_of(orders, f"t{i}")))
        part = orders.select(F.lit(i).alias("layout"), "o_orderkey", x.alias("x_epoch"))
        out = part if out is None else out.unionByName(part)
    return out


@query(
    "events_month_first",
    """SELECT o_orderkey, date_trunc('minute', o_orderdate) AS start_dt,
         CASE WHEN o_orderkey % 3 > 0 THEN date_trunc('minute', o_orderdate + INTERVAL 1 DAY * (o_orderkey % 3 - 1)) END AS end_dt,
         o_orderkey % 3 < 2 AS is_punctual
       FROM orders""",
)
def events_month_first(spark, folder):
    """Annotations whose times are texts with the month first, AM and PM."""
    text = lambda c: F.date_format(c, "MM/dd/yyyy hh:mm a")
    day = F.col("o_orderkey") % 3
    end = F.when(day > 0, text(F.col("o_orderdate") + F.make_dt_interval(days=(day - 1).cast("int"))))
    noted = table(spark, folder, "orders").select("o_orderkey", text(F.col("o_orderdate")).alias("start"), end.alias("end"))
    return normalize_annotations(noted, annotation_shapes(noted)).select("o_orderkey", "start_dt", "end_dt", "is_punctual")
