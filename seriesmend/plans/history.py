"""The correction log: patch rows on Spark, the list of edits on the driver.

Every applied correction leaves patch rows ``(seq, row key, old_value,
new_value)``.  Which of them count is decided by a few records about the edits
actions (``EditLog``): they fold into *layers*, each naming one edit and whether its new
or its old values were written.  The corrected value of a row is then that of the
last layer touching it, else the raw value - one grouped ``max_by`` over the
patches and one join.
"""

from __future__ import annotations

import datetime
from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import DataFrame, functions as F

from seriesmend.model import SeriesSpec, join_on_key, named

NEW, OLD = "new", "old"


@dataclass(frozen=True)
class Edit:
    seq: int
    op_id: str
    label: str = ""
    applied_at: datetime.datetime | None = None
    points: int = 0


@dataclass(frozen=True)
class Action:
    """One line of the stored log.  ``target`` is an edit (apply) or a position (remove)."""

    kind: str
    target: int = -1


@dataclass(frozen=True)
class LogState:
    """What a log of actions amounts to: edits in force, parked ones, layers.

    ``parked`` has the position each removed edit had.  A layer names an edit and
    which of its stored values were written.
    """

    in_force: tuple[int, ...] = ()
    parked: tuple[tuple[int, int], ...] = ()
    layers: tuple[tuple[int, str], ...] = ()

    def rewritten(self) -> "LogState":
        """Raw values, then the new values of all edits in force."""
        return replace(self, layers=tuple((seq, NEW) for seq in self.in_force))


def _applied(s: LogState, seq: int) -> LogState:
    return replace(s, in_force=(*s.in_force, seq), layers=(*s.layers, (seq, NEW)))


def _undone(s: LogState, _: int) -> LogState:
    # a layer of its own: an edit removed earlier may have changed what lies below
    *kept, last = s.in_force
    return replace(s, in_force=tuple(kept), layers=(*s.layers, (last, OLD)))


def _removed(s: LogState, position: int) -> LogState:
    kept = s.in_force[:position] + s.in_force[position + 1:]
    return LogState(kept, (*s.parked, (position, s.in_force[position]))).rewritten()


def _restored(s: LogState, _: int) -> LogState:
    *parked, (position, seq) = s.parked
    return LogState((*s.in_force[:position], seq, *s.in_force[position:]), tuple(parked)).rewritten()


STEPS = {
    "apply": _applied, "undo": _undone, "remove": _removed, "restore": _restored,
    "reset": lambda s, _: LogState(),
    "save": lambda s, _: s,
}


def fold(actions) -> LogState:
    """The state after a log of actions."""
    return reduce(lambda s, action: STEPS[action.kind](s, action.target), actions, LogState())


@dataclass
class EditLog:
    """The log of one variable: the actions in order, and the edits they name.

    An undone edit is gone; a removed one can be restored at its place.
    """

    known: dict[int, Edit] = field(default_factory=dict)
    actions: tuple[Action, ...] = ()
    dirty: bool = False

    @property
    def state(self) -> LogState:
        return fold(self.actions)

    @property
    def edits(self) -> list[Edit]:
        return [self.known[seq] for seq in self.state.in_force]

    @property
    def removed(self) -> list[tuple[int, Edit]]:
        return [(position, self.known[seq]) for position, seq in self.state.parked]

    @property
    def layers(self) -> list[tuple[int, str]]:
        return list(self.state.layers)

    @property
    def next_seq(self) -> int:
        return len(self.known)

    def act(self, action: Action) -> None:
        self.actions = (*self.actions, action)
        self.dirty = action.kind != "save"

    def _add(self, kind: str, target: int = -1) -> None:
        self.act(Action(kind, target))

    def apply(self, op_id: str, label: str = "", points: int = 0, applied_at=None) -> Edit:
        edit = Edit(self.next_seq, op_id, label, applied_at, points)
        self.known[edit.seq] = edit
        self._add("apply", edit.seq)
        return edit

    def undo(self) -> Edit | None:
        """Write the last edit's old values back; None if there is no edit."""
        in_force = self.state.in_force
        if in_force:
            self._add("undo")
        return self.known[in_force[-1]] if in_force else None

    def remove(self, position: int) -> Edit | None:
        """Take an edit out and replay the others; None if there is no such position."""
        in_force = self.state.in_force
        if not 0 <= position < len(in_force):
            return None
        self._add("remove", position)
        return self.known[in_force[position]]

    def restore(self) -> Edit | None:
        """Put the edit removed last back to its place; None if nothing is removed."""
        parked = self.state.parked
        if parked:
            self._add("restore")
        return self.known[parked[-1][1]] if parked else None

    def reset(self) -> None:
        """Forget all edits."""
        self._add("reset")

    def saved(self) -> None:
        """An output has been written: nothing is dirty until the next change."""
        if self.dirty:
            self._add("save")

    def deleting_layers(self, ops: dict[int, str]) -> list[tuple[int, bool]]:
        """``(seq, was a delete)`` in layer order; undo leaves the mark alone."""
        return [(seq, ops[seq] == "delete") for seq, side in self.layers if side == NEW]


def log_patch(patch: DataFrame, seq: int) -> DataFrame:
    """Patch rows as they are stored: with the number of their edit."""
    return patch.select(F.lit(seq).alias("_sm_seq"), *patch.columns)


def _layer_table(spark, rows, schema: str) -> DataFrame:
    # as long as the edit list on the driver
    return F.broadcast(spark.createDataFrame(rows, schema))


def latest_patch(patches: DataFrame, layers: list[tuple[int, str]], spec: SeriesSpec) -> DataFrame:
    """Row key, its last ``_sm_layer`` and the value ``_sm_patched`` there (may be missing)."""
    rows = [(i, seq, side == NEW) for i, (seq, side) in enumerate(layers)]
    table = _layer_table(patches.sparkSession, rows, "_sm_layer int, _sm_seq int, _sm_new boolean")
    written = F.when(F.col("_sm_new"), F.col("new_value")).otherwise(F.col("old_value"))
    return (
        patches.join(table, "_sm_seq")
        .groupBy(*spec.row_key)
        .agg(F.max("_sm_layer").alias("_sm_layer"), F.max_by(written, "_sm_layer").alias("_sm_patched"))
    )


def patched_values(
    df: DataFrame, latest: DataFrame, spec: SeriesSpec, column: str, name: str
) -> DataFrame:
    """Add ``name``: the patched value of a row, else that of ``column``."""
    joined = join_on_key(df, latest, spec.row_key)
    value = F.when(F.col("_sm_layer").isNotNull(), F.col("_sm_patched")).otherwise(named(column))
    return joined.withColumn(name, value).drop("_sm_layer", "_sm_patched")


def replay(
    raw: DataFrame,
    patches: DataFrame | None,
    layers: list[tuple[int, str]],
    spec: SeriesSpec,
    column: str = "raw",
    name: str = "corrected",
) -> DataFrame:
    """``raw`` plus the corrected value of every row."""
    if patches is None or not layers:
        return raw.withColumn(name, named(column))
    return patched_values(raw, latest_patch(patches, layers, spec), spec, column, name)


def deleted_rows(
    patches: DataFrame, marks: list[tuple[int, bool]], spec: SeriesSpec
) -> DataFrame:
    """Row keys whose last edit in force was an explicit delete."""
    rows = [(i, seq, gone) for i, (seq, gone) in enumerate(marks)]
    table = _layer_table(patches.sparkSession, rows, "_sm_layer int, _sm_seq int, _sm_gone boolean")
    return (
        patches.join(table, "_sm_seq")
        .groupBy(*spec.row_key)
        .agg(F.max_by("_sm_gone", "_sm_layer").alias("_sm_deleted"))
        .filter("_sm_deleted")
    )


def history_listing(patches: DataFrame, edits: list[Edit]) -> DataFrame:
    """One row per edit in force: position, operation, label, time, number of points."""
    rows = [(i, e.seq, e.op_id, e.label, e.applied_at) for i, e in enumerate(edits)]
    table = _layer_table(
        patches.sparkSession, rows,
        "position int, _sm_seq int, op_id string, label string, applied_at timestamp",
    )
    return (
        patches.join(table, "_sm_seq")
        .groupBy("position", "_sm_seq", "op_id", "label", "applied_at")
        .agg(F.count(F.lit(1)).alias("points"))
    )
