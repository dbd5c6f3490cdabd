"""A correction history on the readings: four edits, then each kind of log action."""

from __future__ import annotations

import datetime
import uuid
from functools import reduce

from pyspark.sql import functions as F

from seriesmend.operators.correct import corrected_values
from seriesmend.plans.history import EditLog, deleted_rows, history_listing, log_patch, replay
from seriesmend.plans.patches import PatchStore, replay_stored
from seriesmend.plans.staging import shared_folder
from seriesmend.workload.registry import READINGS, query, readings

EDITS = [
    ("offset", {"amount": 10.0}, "value BETWEEN 20 AND 60"),
    ("multiply", {"factor": 2.0}, "value > 50"),
    ("delete", {}, "event_type = 'error' AND value > 300"),
    ("replace", {"value": 1.5}, "event_type = 'click' AND coalesce(value, 0) < 12"),
]

# the same edits as columns: c0 is raw, c1..c4 the value after each edit
CHAIN_SQL = """
  chain AS (
    SELECT *, CASE WHEN s3 THEN 1.5 ELSE c3 END AS c4 FROM (
    SELECT *, event_type = 'click' AND coalesce(c3, 0) < 12 AS s3 FROM (
    SELECT *, CASE WHEN s2 THEN NULL ELSE c2 END AS c3 FROM (
    SELECT *, event_type = 'error' AND c2 > 300 AS s2 FROM (
    SELECT *, CASE WHEN s1 THEN c1 * 2 ELSE c1 END AS c2 FROM (
    SELECT *, c1 > 50 AS s1 FROM (
    SELECT *, CASE WHEN s0 THEN c0 + 10 ELSE c0 END AS c1 FROM (
    SELECT event_id, event_type, value AS c0, value BETWEEN 20 AND 60 AS s0 FROM events))))))))
"""


def edited(spark, folder):
    """``(raw readings, patch rows, edit log)`` after the four edits.

    Every patch is taken from the values its predecessors left, in a scan of its own.
    """
    frame = readings(spark, folder).withColumn("raw", F.col("value"))
    log, patches = EditLog(), []
    for op, params, condition in EDITS:
        frame, where, new = corrected_values(frame, READINGS, op, params, F.expr(condition))
        at = datetime.datetime(2024, 1, 1, 12, log.next_seq, tzinfo=datetime.timezone.utc)
        edit = log.apply(op, f"{op} where {condition}", applied_at=at)
        patch = frame.filter(where).select(
            *READINGS.row_key, F.col("value").alias("old_value"), new.alias("new_value")
        )
        patches.append(log_patch(patch, edit.seq))
        frame = frame.withColumn("value", F.when(where, new).otherwise(F.col("value")))
    raw = readings(spark, folder).select(*READINGS.row_key, F.col("value").alias("raw"))
    return raw, reduce(lambda a, b: a.unionByName(b), patches), log


def _replayed(*actions):
    def build(spark, folder):
        raw, patches, log = edited(spark, folder)
        for action in actions:
            action(log)
        return replay(raw, patches, log.layers, READINGS).select("event_id", "corrected")

    return build


@query(
    "log_apply",
    f"WITH {CHAIN_SQL} " + " UNION ALL ".join(
        f"SELECT {i} AS seq, event_id, c{i} AS old_value, c{i + 1} AS new_value FROM chain WHERE s{i}"
        for i in range(4)
    ),
)
def log_apply(spark, folder):
    return edited(spark, folder)[1].select(
        F.col("_sm_seq").alias("seq"), "event_id", "old_value", "new_value"
    )


query("log_replay", f"WITH {CHAIN_SQL} SELECT event_id, c4 AS corrected FROM chain")(_replayed())

query("log_undo", f"WITH {CHAIN_SQL} SELECT event_id, c3 AS corrected FROM chain")(
    _replayed(EditLog.undo)
)

# the stored values of the later edits stay, they are not computed again
REMOVED_SQL = """CASE WHEN s3 THEN c4 WHEN s2 THEN c3 WHEN s1 THEN c2 ELSE c0 END"""
query("log_remove_entry", f"WITH {CHAIN_SQL} SELECT event_id, {REMOVED_SQL} AS corrected FROM chain")(
    _replayed(lambda log: log.remove(0))
)

query(
    "log_undo_after_remove",
    f"""WITH {CHAIN_SQL} SELECT event_id, CASE WHEN s3 THEN c3 ELSE {REMOVED_SQL} END AS corrected
        FROM chain""",
)(_replayed(lambda log: log.remove(0), EditLog.undo))

query("log_restore_entry", f"WITH {CHAIN_SQL} SELECT event_id, c4 AS corrected FROM chain")(
    _replayed(lambda log: log.remove(1), EditLog.restore)
)

query("log_reset", "SELECT event_id, value AS corrected FROM events")(_replayed(EditLog.reset))


@query(
    "log_summary",
    f"WITH {CHAIN_SQL} " + " UNION ALL ".join(
        f"""SELECT {i} AS position, '{EDITS[i][0]}' AS op_id,
            '{EDITS[i][0]} where {EDITS[i][2].replace("'", "''")}' AS label,
            TIMESTAMP '2024-01-01 12:0{i}:00' AS applied_at, count(*) AS points
            FROM chain WHERE s{i}"""
        for i in range(4)
    ),
)
def log_summary(spark, folder):
    _, patches, log = edited(spark, folder)
    return history_listing(patches, log.edits).select(
        "position", "op_id", "label", F.col("applied_at").cast("timestamp_ntz").alias("applied_at"), "points"
    )


@query(
    "deleted_mask",
    f"WITH {CHAIN_SQL} SELECT event_id FROM chain WHERE s2 AND NOT s3",
)
def deleted_mask(spark, folder):
    _, patches, log = edited(spark, folder)
    marks = log.deleting_layers({e.seq: e.op_id for e in log.edits})
    return deleted_rows(patches, marks, READINGS).select("event_id")


# a long history: edit k adds k to the readings it touches, of which it is the (k div 100)-th edit
MANY, STEP = 500, 100
STORED_SQL = f"""
  SELECT event_id, value + CASE WHEN event_id % {STEP} = 99 THEN 399
                                WHEN event_id % {STEP} = 50 THEN 350
                                ELSE 400 + event_id % {STEP} END AS corrected FROM events"""


@query("log_compacted_replay", STORED_SQL)
def log_compacted_replay(spark, folder):
    """500 edits with snapshots in between; then one is removed, and the last one undone."""
    raw = readings(spark, folder).select(*READINGS.row_key, F.col("value").alias("raw"))
    store, log = PatchStore(spark, f"{shared_folder(spark)}/session-{uuid.uuid4().hex}", READINGS), EditLog()
    edits = F.sequence(F.col("event_id") % STEP, F.lit(MANY - 1), F.lit(STEP).cast("long"))
    touched = raw.select("*", F.explode(edits.cast("array<int>")).alias("_sm_seq"))
    before = F.when(F.col("_sm_seq") < STEP, F.col("raw")).otherwise(F.col("raw") + (F.col("_sm_seq") - STEP))
    points = store.write_all(touched.select(
        *READINGS.row_key, "_sm_seq", before.alias("old_value"), (F.col("raw") + F.col("_sm_seq")).alias("new_value")))
    for k in range(MANY):
        log.apply("offset", f"edit {k}", points.get(k, 0))
        if k in (249, 449):   # as a session does when they are due
            store.compact(log.layers)
    store.compact(log.layers)
    log.remove(450)           # a snapshot before it still counts
    log.undo()
    return replay_stored(raw, READINGS, [(store, log.layers, "raw", "corrected")]).select("event_id", "corrected")
