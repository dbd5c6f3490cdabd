"""Detectors and what follows from them."""

from __future__ import annotations

from pyspark.sql import functions as F

from seriesmend.operators.detect import (
    detect_frozen,
    detect_spikes,
    detection_summary,
    find_runs,
    first_difference,
    frozen_runs,
    rolling_median_mad,
)
from seriesmend.operators.detectors import detect_and_correct
from seriesmend.workload.registry import BY_USER, GAPPED_SQL, READINGS, gapped, query, readings

PLAIN_SOURCE = "SELECT event_id, event_type, user_id, ts, value FROM events"
GAPPED_SOURCE = f"SELECT event_id, event_type, user_id, ts, {GAPPED_SQL} AS value FROM events"


def frames_sql(source: str, window: int, key: str = "event_type") -> str:
    """Differences with the median and MAD of their edge-padded frame."""
    half = max(max(window, 2) // 2, 1)
    middle = "(s[(len(s) + 1) // 2] + s[len(s) // 2 + 1]) / 2"
    return f"""
      steps AS (
        SELECT *, value - lag(value) OVER w AS d, row_number() OVER w AS place,
               count(*) OVER (PARTITION BY {key}) AS size
        FROM ({source}) WINDOW w AS (PARTITION BY {key} ORDER BY ts, event_id)),
      diffs AS (
        SELECT *, first_value(d) OVER (PARTITION BY {key} ORDER BY ts, event_id
                    ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS first_d,
                  last_value(d) OVER (PARTITION BY {key} ORDER BY ts, event_id
                    ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS last_d
        FROM steps WHERE place > 1 AND size >= 3),
      framed AS (
        SELECT *, list_sort(list_filter(list_concat(
            list(d) OVER (PARTITION BY {key} ORDER BY ts, event_id
                          ROWS BETWEEN {half} PRECEDING AND {half} FOLLOWING),
            [first_d for i in range(CAST(greatest({half} - (place - 2), 0) AS BIGINT))],
            [last_d for i in range(CAST(greatest({half} - (size - place), 0) AS BIGINT))]),
            lambda v: v IS NOT NULL)) AS s
        FROM diffs),
      centred AS (SELECT *, CASE WHEN len(s) > 0 THEN {middle} END AS med FROM framed),
      spread AS (SELECT *, list_sort(list_transform(s, lambda v: abs(v - med))) AS dev FROM centred),
      scored AS (
        SELECT *, CASE WHEN len(dev) > 0 THEN {middle.replace('s[', 'dev[').replace('len(s)', 'len(dev)')} END AS mad
        FROM spread)"""


def spikes_sql(source: str, window: int, z: float, key: str = "event_type") -> str:
    return f"""WITH {frames_sql(source, window, key)}
      SELECT event_id, abs(d - med) / (mad * 1.4826 + 1e-9) AS score, 'spike' AS kind
      FROM scored WHERE abs(d - med) / (mad * 1.4826 + 1e-9) > {z}"""


def runs_sql(source: str, tolerance: float, key: str = "event_type") -> str:
    return f"""
      steps AS (
        SELECT *, CASE WHEN abs(value - lag(value) OVER w) <= {tolerance} THEN 0 ELSE 1 END AS brk
        FROM ({source}) WINDOW w AS (PARTITION BY {key} ORDER BY ts, event_id)),
      numbered AS (SELECT *, sum(brk) OVER (PARTITION BY {key} ORDER BY ts, event_id) AS run FROM steps),
      sized AS (SELECT *, count(*) OVER (PARTITION BY {key}, run) AS n FROM numbered)"""


def frozen_sql(source: str, least: int, tolerance: float, key: str = "event_type") -> str:
    return f"""WITH {runs_sql(source, tolerance, key)}
      SELECT event_id, CAST(n AS DOUBLE) AS score, 'freeze' AS kind FROM sized WHERE n >= {least}"""


CANDIDATE = ("event_id", "score", "kind")


@query(
    "first_difference",
    f"""SELECT event_id, value - lag(value) OVER (PARTITION BY event_type ORDER BY ts, event_id) AS diff
        FROM ({GAPPED_SOURCE})""",
)
def q_first_difference(spark, folder):
    return first_difference(gapped(spark, folder), READINGS).select("event_id", "diff")


@query(
    "rolling_median_mad",
    f"WITH {frames_sql(GAPPED_SOURCE, 8)} SELECT event_id, d AS diff, med, mad FROM scored",
)
def q_rolling(spark, folder):
    return rolling_median_mad(gapped(spark, folder), READINGS, 8).select(
        "event_id", "diff", "med", "mad"
    )


@query("detect_spikes", spikes_sql(PLAIN_SOURCE, 24, 4.0))
def q_spikes(spark, folder):
    return detect_spikes(readings(spark, folder), READINGS).select(*CANDIDATE)


@query("detect_spikes_window", spikes_sql(PLAIN_SOURCE, 7, 5.5, "user_id"))
def q_spikes_window(spark, folder):
    return detect_spikes(readings(spark, folder), BY_USER, 7, 5.5).select(*CANDIDATE)


@query("detect_spikes_with_gaps", spikes_sql(GAPPED_SOURCE, 24, 4.0))
def q_spikes_gaps(spark, folder):
    return detect_spikes(gapped(spark, folder), READINGS).select(*CANDIDATE)


# wider than any series of the small tables
WIDE = 5001


@query("detect_spikes_wide", spikes_sql(GAPPED_SOURCE, WIDE, 4.0))
def q_spikes_wide(spark, folder):
    return detect_spikes(gapped(spark, folder), READINGS, WIDE).select(*CANDIDATE)


@query(
    "rolling_median_mad_wide",
    f"WITH {frames_sql(PLAIN_SOURCE, 301)} SELECT event_id, d AS diff, med, mad FROM scored",
)
def q_rolling_wide(spark, folder):
    return rolling_median_mad(readings(spark, folder), READINGS, 301).select("event_id", "diff", "med", "mad")


@query(
    "find_runs",
    f"""WITH steps AS (
          SELECT *, coalesce(value > 60, false) AS f,
                 coalesce(lag(value > 60) OVER (PARTITION BY event_type ORDER BY ts, event_id), false) AS p
          FROM ({GAPPED_SOURCE})),
        numbered AS (
          SELECT *, sum(CASE WHEN f AND p THEN 0 ELSE 1 END) OVER (PARTITION BY event_type ORDER BY ts, event_id) AS run
          FROM steps)
        SELECT event_type, min(event_id) AS start_event_id, max(event_id) AS end_event_id, count(*) AS points
        FROM numbered WHERE f GROUP BY event_type, run""",
)
def q_find_runs(spark, folder):
    return find_runs(gapped(spark, folder), READINGS, F.col("value") > 60).select(
        "event_type", "start_event_id", "end_event_id", "points"
    )


@query("detect_frozen", frozen_sql(GAPPED_SOURCE, 3, 5.0))
def q_frozen(spark, folder):
    return detect_frozen(gapped(spark, folder), READINGS, 3, 5.0).select(*CANDIDATE)


@query("detect_frozen_tolerance", frozen_sql(PLAIN_SOURCE, 2, 0.5, "user_id"))
def q_frozen_tolerance(spark, folder):
    return detect_frozen(readings(spark, folder), BY_USER, 1, 0.5).select(*CANDIDATE)


@query(
    "detect_frozen_runs",
    f"""WITH {runs_sql(PLAIN_SOURCE, 5.0)}
        SELECT event_type, min(ts) AS start_ts, max(ts) AS end_ts, count(*) AS points
        FROM sized WHERE n >= 3 GROUP BY event_type, run""",
)
def q_frozen_runs(spark, folder):
    return frozen_runs(readings(spark, folder), READINGS, 3, 5.0).select(
        "event_type", "start_ts", "end_ts", "points"
    )


@query(
    "detection_summary",
    f"""SELECT event_type, kind, count(*) AS candidates FROM (
          ({spikes_sql(PLAIN_SOURCE, 24, 4.0)}) UNION ALL ({frozen_sql(PLAIN_SOURCE, 3, 5.0)})
        ) JOIN events USING (event_id) GROUP BY event_type, kind""",
)
def q_summary(spark, folder):
    events = readings(spark, folder)
    found = detect_spikes(events, READINGS).unionByName(detect_frozen(events, READINGS, 3, 5.0))
    return detection_summary(found, ("event_type",))


@query(
    "clean_spikes",
    f"""SELECT e.event_id, CASE WHEN s.event_id IS NULL THEN e.value END AS corrected
        FROM events e LEFT JOIN ({spikes_sql(PLAIN_SOURCE, 24, 4.0)}) s ON e.event_id = s.event_id""",
)
def q_clean_spikes(spark, folder):
    return detect_and_correct(readings(spark, folder), READINGS, "spike", "delete").select(
        "event_id", F.col("value").alias("corrected")
    )


@query(
    "clean_frozen",
    f"""WITH hit AS ({frozen_sql(PLAIN_SOURCE, 3, 5.0)}),
        marked AS (SELECT e.*, h.event_id IS NOT NULL AS picked
                   FROM events e LEFT JOIN hit h ON e.event_id = h.event_id)
        SELECT event_id, CASE WHEN picked THEN
                 round(value - median(CASE WHEN picked THEN value END) OVER (PARTITION BY event_type), 9)
               ELSE value END AS corrected
        FROM marked""",
)
def q_clean_frozen(spark, folder):
    cleaned = detect_and_correct(
        readings(spark, folder),
        READINGS,
        "freeze",
        "expression",
        {"min_run_length": 3, "tolerance": 5.0},
        {"expr": "np.round(x - np.median(x), 9)"},
    )
    return cleaned.select("event_id", F.col("value").alias("corrected"))
