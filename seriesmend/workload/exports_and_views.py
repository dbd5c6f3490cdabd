"""Save outputs, annotation of readings and the tables behind a plot."""

from __future__ import annotations

from pyspark.sql import functions as F

from seriesmend.operators import pyramid, select, view
from seriesmend.operators.annotate import annotate_first
from seriesmend.operators.correct import correct
from seriesmend.sinks.exports import (
    changed_cells,
    diff_output,
    diff_output_long,
    full_output,
    merged_output,
    series_output,
)
from seriesmend.sources.annotations import (
    annotation_geometry,
    annotations_for_table,
    normalize_annotations,
)
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
from seriesmend.workload.sources_and_selection import GEOMETRY_SQL, annotations


# --- outputs --------------------------------------------------------------------

SHIFTED_SQL = f"""
  SELECT event_id, event_type, ts, value AS raw,
         CASE WHEN event_type = 'click' THEN value * 1.0000005
              WHEN event_type = 'view' AND value > 20 THEN value + 1
              WHEN event_type = 'error' AND value > 100 THEN NULL
              WHEN event_type = 'signup' AND value IS NULL THEN 5
              ELSE value END AS corrected
  FROM (SELECT event_id, event_type, ts, {GAPPED_SQL} AS value FROM events)
"""

CHANGED_SQL = """(CASE WHEN {raw} IS NULL OR {new} IS NULL THEN NOT ({raw} IS NULL AND {new} IS NULL)
                       ELSE NOT (abs({raw} - {new}) <= 1e-9 + 1e-6 * abs({new})) END)"""


def shifted(spark, folder):
    """Readings with a raw and a corrected column; clicks differ by rounding only."""
    kind, v = F.col("event_type"), F.col("value")
    corrected = (
        F.when(kind == "click", v * 1.0000005)
        .when((kind == "view") & (v > 20), v + 1)
        .when((kind == "error") & (v > 100), F.lit(None))
        .when((kind == "signup") & v.isNull(), F.lit(5.0))
        .otherwise(v)
    )
    return gapped(spark, folder).select(
        "event_id", "event_type", "ts", v.alias("raw"), corrected.alias("corrected")
    )


@query(
    "changed_cells",
    f"""SELECT event_id, raw, corrected FROM ({SHIFTED_SQL})
        WHERE {CHANGED_SQL.format(raw='raw', new='corrected')}""",
)
def q_changed_cells(spark, folder):
    return changed_cells(shifted(spark, folder)).select("event_id", "raw", "corrected")


@query(
    "save_diff",
    f"""SELECT ts, event_type, event_id, corrected AS value FROM ({SHIFTED_SQL})
        WHERE {CHANGED_SQL.format(raw='raw', new='corrected')}""",
)
def save_diff(spark, folder):
    return diff_output(
        shifted(spark, folder), ("ts", "event_type", "event_id"), {"value": ("raw", "corrected")}
    )


@query("save_series", f"SELECT ts, event_id, corrected AS value FROM ({SHIFTED_SQL})")
def save_series(spark, folder):
    return series_output(shifted(spark, folder), ("ts", "event_id"), {"value": "corrected"})


LINES_SQL = """
  SELECT l_shipdate, l_orderkey, l_partkey, l_suppkey, l_linenumber,
         l_quantity, CASE WHEN l_quantity > 45 THEN 45 ELSE l_quantity END AS new_quantity,
         l_discount, CASE WHEN l_discount < 0.02 THEN NULL ELSE l_discount END AS new_discount,
         l_tax, l_tax * 1.0000001 AS new_tax FROM lineitem
"""
QUANTITY_CHANGED = CHANGED_SQL.format(raw="l_quantity", new="new_quantity")
DISCOUNT_CHANGED = CHANGED_SQL.format(raw="l_discount", new="new_discount")


def corrected_lines(spark, folder):
    lines = table(spark, folder, "lineitem")
    quantity, discount = F.col("l_quantity"), F.col("l_discount")
    return lines.withColumns(
        {
            "new_quantity": F.when(quantity > 45, F.lit(45.0)).otherwise(quantity),
            "new_discount": F.when(discount >= 0.02, discount),
            "new_tax": F.col("l_tax") * 1.0000001,
        }
    )


MULTI_SQL = f"""
  SELECT {', '.join(LINE_KEY)},
         CASE WHEN {QUANTITY_CHANGED} THEN new_quantity END AS l_quantity,
         CASE WHEN {DISCOUNT_CHANGED} THEN new_discount END AS l_discount,
         CAST(NULL AS DOUBLE) AS l_tax
  FROM ({LINES_SQL}) WHERE {QUANTITY_CHANGED} OR {DISCOUNT_CHANGED}
"""


@query("save_diff_multi", MULTI_SQL)
def save_diff_multi(spark, folder):
    touched = {v: (v, f"new_{v[2:]}") for v in ("l_quantity", "l_discount", "l_tax")}
    return diff_output(corrected_lines(spark, folder), LINE_KEY, touched)


@query("save_diff_long", MULTI_SQL)
def save_diff_long(spark, folder):
    """The same output from long form: one row per changed cell, then pivoted."""
    names = ["l_quantity", "l_discount", "l_tax"]
    lines = corrected_lines(spark, folder)
    fixed = F.array(
        *[
            F.struct(
                F.lit(v).alias("variable"), F.col(v).alias("raw"), F.col(f"new_{v[2:]}").alias("corrected")
            )
            for v in names
        ]
    )
    return diff_output_long(lines.select(*LINE_KEY, F.inline(fixed)), LINE_KEY, names)


FULL_COLUMNS = "o_orderkey, o_custkey, o_orderstatus, o_orderdate, o_orderpriority"


def _capped_prices(spark, folder):
    orders = table(spark, folder, "orders")
    return orders, correct(orders, PRICES, "threshold", {"max": 400000, "action": "multiply", "factor": 0.5})


@query(
    "save_full",
    f"""SELECT {FULL_COLUMNS}, CASE WHEN o_totalprice > 400000 THEN o_totalprice * 0.5 ELSE o_totalprice END
        AS o_totalprice FROM orders""",
)
def save_full(spark, folder):
    orders, fixed = _capped_prices(spark, folder)
    return full_output(fixed, orders.columns, {"o_totalprice": "o_totalprice"})


@query(
    "save_full_merge",
    f"""SELECT {FULL_COLUMNS.replace('o_custkey', 'CAST(CASE WHEN o_custkey < 100 THEN NULL ELSE o_custkey END AS DOUBLE) AS o_custkey')},
               CASE WHEN o_totalprice > 400000 THEN o_totalprice * 0.5 ELSE o_totalprice END AS o_totalprice
        FROM orders""",
)
def save_full_merge(spark, folder):
    """A second variable saved over an earlier full output keeps the first one's fixes."""
    orders, fixed = _capped_prices(spark, folder)
    earlier = full_output(fixed, orders.columns, {"o_totalprice": "o_totalprice"})
    second = orders.select("o_orderkey", F.when(F.col("o_custkey") >= 100, F.col("o_custkey")).alias("o_custkey"))
    return merged_output(earlier, second, ("o_orderkey",), ["o_custkey"])


# --- annotation -------------------------------------------------------------------

def first_annotation_sql(where: str, tolerance_us: int) -> str:
    return f"""
      WITH a AS (SELECT *, CASE WHEN shape = 'instant' THEN {tolerance_us} ELSE 0 END AS slack
                 FROM ({GEOMETRY_SQL}) {where}),
           hits AS (SELECT e.event_id, min(a.event_no) AS event_no FROM events e JOIN a
                    ON epoch_us(e.ts) BETWEEN epoch_us(a.lo) - a.slack AND epoch_us(a.hi) + a.slack
                    GROUP BY e.event_id)
      SELECT e.event_id, h.event_no, a.label FROM events e
      LEFT JOIN hits h USING (event_id) LEFT JOIN a ON a.event_no = h.event_no"""


@query(
    "annotate_events",
    first_annotation_sql("""WHERE "table" = '*' OR "table" = 'events'""", 0),
)
def annotate_events(spark, folder):
    noted = normalize_annotations(annotations_for_table(annotations(spark, folder), "events"))
    return annotate_first(
        readings(spark, folder), annotation_geometry(noted), "ts",
        order=("event_no",), payload=("event_no", "label"), keep=("event_id",),
    )


@query("annotate_all_events", first_annotation_sql("", 90_000_000))
def annotate_all_events(spark, folder):
    """Annotations of every table; an instant covers 90 seconds on both sides."""
    shown = annotation_geometry(normalize_annotations(annotations(spark, folder)))
    return annotate_first(
        readings(spark, folder), shown, "ts",
        order=("event_no",), payload=("event_no", "label"), tolerance_s=90.0, keep=("event_id",),
    )


# --- views ------------------------------------------------------------------------


@query(
    "series_extent",
    f"""SELECT event_type, min(ts) AS x_first, max(ts) AS x_last,
               min(least(coalesce(raw, corrected), coalesce(corrected, raw))) AS y_min,
               max(greatest(coalesce(raw, corrected), coalesce(corrected, raw))) AS y_max
        FROM ({SHIFTED_SQL}) GROUP BY event_type""",
)
def q_series_extent(spark, folder):
    return view.series_extent(shifted(spark, folder), READINGS, "ts")


def _peak_sql(name: str, direction: str) -> str:
    return f"""SELECT event_type, bucket, '{name}' AS peak, event_id, y FROM (
                 SELECT *, row_number() OVER (PARTITION BY event_type, bucket
                                              ORDER BY y {direction}, ts, event_id) AS place FROM points)
               WHERE place = 1"""


@query(
    "downsample_peak",
    f"""WITH points AS (
          SELECT event_type, event_id, ts, value AS y, CAST(floor(epoch_us(ts) / 1e6 / 3600) AS BIGINT) AS bucket
          FROM (SELECT event_type, event_id, ts, {GAPPED_SQL} AS value FROM events) WHERE value IS NOT NULL)
        {_peak_sql('min', 'ASC')} UNION ALL {_peak_sql('max', 'DESC')}""",
)
def q_downsample_peak(spark, folder):
    return view.downsample_peak(gapped(spark, folder), READINGS, "ts", 3600).select(
        "event_type", "bucket", "peak", "event_id", "y"
    )


@query(
    "downsample_stride",
    """SELECT event_type, event_id FROM (
         SELECT event_type, event_id,
                row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) - 1 AS i,
                count(*) OVER (PARTITION BY event_type) AS n
         FROM events WHERE value BETWEEN 10 AND 90)
       WHERE i % CASE WHEN n > 500 THEN n // 500 + 1 ELSE 1 END = 0""",
)
def q_downsample_stride(spark, folder):
    chosen = select.y_range(F.col("value"), 10, 90)
    return view.downsample_stride(readings(spark, folder), READINGS, chosen, shown=500).select(
        "event_type", "event_id"
    )


@query(
    "display_both",
    f"""SELECT event_id, 'raw' AS curve, raw AS y FROM ({SHIFTED_SQL})
        UNION ALL SELECT event_id, 'corrected', corrected FROM ({SHIFTED_SQL})""",
)
def q_display_both(spark, folder):
    return view.display(shifted(spark, folder), "both", ("event_id",))


# epoch seconds of 2024-01-01; a range of all readings, of eight days, and of six hours
START = 1704067200.0
ZOOMS = ((START, START + 40 * 86400.0, 100), (START + 3 * 86400.0, START + 11 * 86400.0, 800),
         (START + 5 * 86400.0, START + 5 * 86400.0 + 21600.0, 400))
BASE_SECONDS = 60.0


GAPPED_SOURCE = f"SELECT event_id, event_type, ts, {GAPPED_SQL} AS value FROM events"


def zoom_sql(x0: float, x1: float, points: int) -> str:
    level = pyramid.level_for(x0, x1, points, BASE_SECONDS)
    width = BASE_SECONDS * pyramid.FAN**level

    def row(name: str, way: str) -> str:
        return f"""
          SELECT event_type, {level} AS level, bucket, '{name}' AS peak, event_id, ts, y FROM (
            SELECT *, row_number() OVER (PARTITION BY event_type, bucket ORDER BY y {way}, ts, event_id) AS place FROM p)
          WHERE place = 1"""

    return f"""SELECT * FROM (WITH p AS (
        SELECT event_type, event_id, ts, value AS y, floor(epoch_us(ts) / 1e6 / {width})::BIGINT AS bucket
        FROM ({GAPPED_SOURCE}) WHERE value IS NOT NULL
          AND floor(epoch_us(ts) / 1e6 / {width}) BETWEEN floor({x0} / {width}) AND floor({x1} / {width}))
      {row('min', 'ASC')} UNION ALL {row('max', 'DESC')})"""


@query("peak_pyramid_zoom", " UNION ALL ".join(f"SELECT {i} AS view, * FROM ({zoom_sql(*z)})" for i, z in enumerate(ZOOMS)))
def peak_pyramid_zoom(spark, folder):
    """Three ranges of one pyramid, each from the level that shows it in few points."""
    peaks = pyramid.peak_pyramid(gapped(spark, folder), READINGS, "ts", BASE_SECONDS)
    views = [peaks.view(*z).select(F.lit(i).alias("view"), "*") for i, z in enumerate(ZOOMS)]
    return views[0].unionByName(views[1]).unionByName(views[2])
