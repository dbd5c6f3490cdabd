"""A correction session over one table: open, select, correct, undo, save.

The driver keeps names and the edit lists.  Readings stay in the table, patches
are written under the shared folder as they are applied, and every view is a
DataFrame computed from both.
"""

from __future__ import annotations

import datetime
import functools
import uuid
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from seriesmend.model import SeriesSpec, join_on_key, named, refuse_reserved
from seriesmend.operators.annotate import annotate_first
from seriesmend.operators.correct import correction_patch, mark_rows
from seriesmend.operators.detectors import detect
from seriesmend.operators.select import freeze_selection, nearest_point, x_range, y_range
from seriesmend.operators.view import SHOWN_POINTS, display, downsample_peak, downsample_stride, series_extent
from seriesmend.plans.blocks import Layout
from seriesmend.plans.history import Action, Edit, EditLog, deleted_rows
from seriesmend.plans.patches import PatchStore, replay_stored
from seriesmend.plans.staging import delete_folder, shared_folder, stage, staged_in
from seriesmend.session import require_utc
from seriesmend.sinks.exports import check_same_rows, diff_output, full_output, merged_output, series_output
from seriesmend.sinks.files import SUFFIXES, output_path, path_exists, qualified, write_output
from seriesmend.sinks.rewrite import finish_rewrite, rewrite_changed
from seriesmend.sources.annotations import (
    FILE_ORDER,
    annotation_geometry,
    annotation_text,
    annotations_for_table,
    load_annotations,
    unread_annotation_times,
)
from seriesmend.sources.tables import (
    find_time_column,
    read_table,
    table_format,
    table_name,
)
from seriesmend.sources.timeaxis import formats_for, unread_times, with_time_axis
from seriesmend.sources.variables import reading

TIME, EPOCH = "_time", "_x"
FAR = 1.7e308   # an open end of a range

TIME_SWITCH = "time column"   # a stored action that isn't a variable's: its name is the column

# a stored action; the last four belong to an applied edit
LOG = (
    "variable string, folder string, number int, kind string, target int, "
    "op_id string, label string, applied_at timestamp, points long"
)


def _owned(method):
    """What a method stages belongs to the session."""

    @functools.wraps(method)
    def run(self, *args, **more):
        with staged_in(self.session_folder):
            return method(self, *args, **more)

    return run


class SessionConflict(RuntimeError):
    """Another driver has changed the session; open it again to go on from there."""


@dataclass
class Variable:
    name: str
    folder: str
    store: PatchStore
    log: EditLog = field(default_factory=EditLog)
    ops: dict[int, str] = field(default_factory=dict)


class Workbench:
    """One table, its variables and their corrections.

    ``keys`` split the table into series.  ``row_id`` names columns that identify
    a row; without it the position in the source does.  Outputs go beside the source
    or to ``output_folder``.  ``close`` (or leaving a ``with`` block) deletes what the
    session has written for itself.  Until then ``session_folder`` holds the patches
    and the log of actions, saves and switches of the time column included: a new
    Workbench with ``session=`` that folder goes on where a lost driver left off.  With
    ``guarded``, of two drivers that change one session one wins and the other gets
    ``SessionConflict``, before anything of its change is written; without, the last wins.
    """

    def __init__(
        self,
        spark: SparkSession,
        path: str,
        keys: tuple[str, ...] = (),
        row_id: tuple[str, ...] = (),
        schema=None,
        output_folder: str | None = None,
        session: str | None = None,
        guarded: bool = False,
    ):
        require_utc(spark)
        self.spark = spark
        self.source = str(path)
        self.name = table_name(path)
        self.keys = tuple(keys)
        self.output_folder = output_folder
        self._folder = session or f"{shared_folder(spark)}/session-{uuid.uuid4().hex}"
        table = read_table(spark, self.source, schema)
        refuse_reserved(table.columns)
        self._kinds = {f.name: f.dataType for f in table.schema.fields}
        odd = [c for c in (*self.keys, *row_id) if "." in c or c in (TIME, EPOCH, "raw", "corrected")]
        if odd:
            raise ValueError(f"columns that identify rows or series may not be called {odd}")
        self.time_column = find_time_column(table.schema)
        self._formats: dict[str, tuple[str, ...]] = {}
        self._columns = table.columns
        if row_id:
            self.row_id = tuple(row_id)
            self.table = table
        else:
            self.table, self.row_id = self._with_positions(table)
        self.has_row_id = bool(row_id)
        self.variables: dict[str, Variable] = {}
        self.events: DataFrame | None = None
        self._version, self._switched, self._guarded = 0, False, guarded
        if session:
            self._read_log()

    @property
    def session_folder(self) -> str:
        return self._folder

    def __enter__(self) -> "Workbench":
        return self

    def __exit__(self, *_) -> None:
        self.close()

    def close(self) -> None:
        """Delete the session's patches and numbered rows; its frames are then void."""
        for variable in self.variables.values():
            variable.store.drop()
        delete_folder(self.spark, self._folder)

    def _with_positions(self, table: DataFrame) -> tuple[DataFrame, tuple[str, ...]]:
        if table_format(self.source) == "parquet":
            # relative to the table, so that a copy elsewhere has the same rows
            root = qualified(self.spark, self.source)
            placed = table.select(
                "*",
                F.col("_metadata.file_path").substr(F.lit(len(root) + 1), F.lit(1 << 20)).alias("_sm_file"),
                F.col("_metadata.row_index").alias("_sm_row"),
            )
            return placed, ("_sm_file", "_sm_row")
        # csv has no row index: number the rows of every split once and keep that
        numbered = table.select(
            "*",
            F.col("_metadata.file_path").alias("_sm_file"),
            F.col("_metadata.file_block_start").alias("_sm_start"),
            F.monotonically_increasing_id().alias("_sm_row"),
        )
        path = f"{self._folder}/rows"
        if not path_exists(self.spark, path):
            numbered.write.parquet(path)
        return self.spark.read.parquet(path), ("_sm_file", "_sm_start", "_sm_row")

    # --- what is there ---------------------------------------------------------

    @property
    def spec(self) -> SeriesSpec:
        return SeriesSpec(self.keys, (TIME,), self.row_id, "corrected")

    @property
    def column_names(self) -> list[str]:
        return list(self._columns)

    @property
    def variable_names(self) -> list[str]:
        return [c for c in self._columns if c != self.time_column]

    @property
    def time_formats(self) -> tuple[str, ...]:
        """The layouts of the time column, chosen once for the whole column."""
        if self.time_column not in self._formats:
            self._formats[self.time_column] = formats_for(self.table, self.time_column)
        return self._formats[self.time_column]

    def unread_times(self) -> int:
        """Rows whose time is a text in no known layout: no X range finds them."""
        return self.table.agg(unread_times(self.table, self.time_column, self.time_formats)).first()[0]

    def set_time_column(self, name: str) -> None:
        """Use another column as the time axis; open variables are dropped."""
        if name == self.time_column:
            return
        if name not in self._columns:
            raise ValueError(f"no column {name}")
        self._claim()
        self.time_column, self._switched = name, True
        self.variables.clear()
        self._write_log()

    def load_events(self, path: str) -> None:
        self.events = load_annotations(self.spark, path)

    def unread_event_times(self) -> int:
        """Starts and ends of the loaded events that are in no known layout."""
        return 0 if self.events is None else unread_annotation_times(self.events)

    @property
    def events_for_table(self) -> DataFrame | None:
        return None if self.events is None else annotations_for_table(self.events, self.name)

    def open_variable(self, name: str) -> Variable:
        if name not in self._columns:
            raise ValueError(f"no column {name}")
        if name not in self.variables:
            folder = f"{self._folder}/{len(self.variables)}-{uuid.uuid4().hex[:8]}"
            self.variables[name] = Variable(name, folder, PatchStore(self.spark, folder, self.spec))
        return self.variables[name]

    # --- the stored log ----------------------------------------------------------

    def _claim(self) -> None:
        """Take the next version of the log, before anything of it is written."""
        if not self._guarded:
            self._version += 1
            return
        where = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self._folder}/claims/{self._version + 1}")
        system = where.getFileSystem(self.spark._jsc.hadoopConfiguration())
        try:
            system.create(where, False).close()   # fails if it is there
        except Exception as e:
            if not system.exists(where):
                raise
            raise SessionConflict(f"another driver has changed {self._folder}; open it again") from e
        self._version += 1

    def _write_log(self) -> None:
        """All actions of all variables, one small table per claimed version."""
        rows = [(self.time_column, None, -1, TIME_SWITCH, -1, None, None, None, None)] if self._switched else []
        for v in self.variables.values():
            for n, action in enumerate(v.log.actions):
                edit = v.log.known[action.target] if action.kind == "apply" else None
                told = (edit.op_id, edit.label, edit.applied_at, edit.points) if edit else (None,) * 4
                rows.append((v.name, v.folder, n, action.kind, action.target, *told))
        log = self.spark.createDataFrame(rows, LOG).coalesce(1)
        log.write.mode("overwrite").parquet(f"{self._folder}/log/version={self._version}")

    def _read_log(self) -> None:
        path = f"{self._folder}/log"
        # a version that was claimed and not written belongs to a lost driver
        self._version = max((int(n) for n in self._listed("claims")), default=0)
        if not path_exists(self.spark, path):
            return
        stored = self.spark.read.schema(f"{LOG}, version int").parquet(path)
        last = stored.agg(F.max("version")).first()[0]
        self._version = max(self._version, last or 0)
        # as many rows as there were actions
        for r in stored.filter(F.col("version") == last).orderBy("number", "variable").collect():
            if r.kind == TIME_SWITCH:
                self.time_column, self._switched = r.variable, True
                continue
            store = PatchStore(self.spark, r.folder, self.spec)
            variable = self.variables.setdefault(r.variable, Variable(r.variable, r.folder, store))
            if r.kind == "apply":
                variable.log.apply(r.op_id, r.label, r.points, r.applied_at)
                variable.ops[r.target] = r.op_id
            else:
                variable.log.act(Action(r.kind, r.target))

    def _listed(self, name: str) -> list[str]:
        where = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self._folder}/{name}")
        system = where.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not system.exists(where):
            return []
        return [n for n in (s.getPath().getName() for s in system.listStatus(where)) if n.isdigit()]

    # --- frames ----------------------------------------------------------------

    def _base(self, names: list[str]) -> DataFrame:
        """The table with its row key, ``_x`` and ``_sm_raw_<i>`` of each variable.

        Columns that are not used later never leave the scan.
        """
        timed = with_time_axis(self.table, self.time_column, TIME, EPOCH, self.time_formats)
        kinds = self.table.schema
        return timed.select(
            "*",
            *[reading(named(n), kinds[n].dataType).alias(f"_sm_raw_{i}") for i, n in enumerate(names)],
        )

    def _frame(self, names: list[str]) -> DataFrame:
        """``_base`` plus ``_sm_new_<i>``, the corrected value of each variable."""
        stores = [
            (self.variables[n].store, self.variables[n].log.layers, f"_sm_raw_{i}", f"_sm_new_{i}")
            for i, n in enumerate(names)
        ]
        return replay_stored(self._base(names), self.spec, stores)

    def readings(self, name: str) -> DataFrame:
        """Row key, ``_x`` (epoch seconds), ``raw`` and ``corrected`` of one variable."""
        self.open_variable(name)
        frame = self._frame([name])
        return frame.select(
            *self.spec.row_key, EPOCH, F.col("_sm_raw_0").alias("raw"), F.col("_sm_new_0").alias("corrected")
        )

    def deleted(self, name: str) -> DataFrame:
        """Row keys that were deleted on purpose (not missing from the start)."""
        variable = self.open_variable(name)
        patches = variable.store.patches([seq for seq, _ in variable.log.layers])
        marks = variable.log.deleting_layers(variable.ops)
        if patches is None or not marks:
            return self._base([]).select(*self.spec.row_key).limit(0)
        return deleted_rows(patches, marks, self.spec).select(*self.spec.row_key)

    # --- selecting, detecting, correcting ----------------------------------------

    @_owned
    def select(self, name: str, where: Column) -> DataFrame:
        """Row keys selected by the values as they are now."""
        return freeze_selection(self.readings(name), where, self.spec)

    def select_range(self, name: str, x0: float | None = None, x1: float | None = None,
                     y0: float | None = None, y1: float | None = None) -> DataFrame:
        """Row keys in a range of times (epoch seconds), of values as they are now, or both."""
        where = F.lit(True)
        if x0 is not None or x1 is not None:
            where = where & x_range(F.col(EPOCH), -FAR if x0 is None else float(x0), FAR if x1 is None else float(x1))
        if y0 is not None or y1 is not None:
            where = where & y_range(F.col("corrected"), -FAR if y0 is None else y0, FAR if y1 is None else y1)
        return self.select(name, where)

    def selection_count(self, rows: DataFrame) -> int:
        return rows.count()

    @_owned
    def extent(self, name: str, mode: str = "both") -> DataFrame:
        """Per series: first and last time, and the range of the finite values shown."""
        return series_extent(self.readings(name), self.spec, EPOCH, mode)

    def display(self, name: str, mode: str = "both") -> DataFrame:
        """The curves to draw: raw, corrected or both, in long form."""
        return display(self.readings(name), mode, (*self.spec.row_key, EPOCH))

    @_owned
    def thin_peaks(self, name: str, bucket_seconds: float) -> DataFrame:
        """The lowest and highest corrected reading of every time bucket."""
        return downsample_peak(self.readings(name), self.spec, TIME, bucket_seconds)

    @_owned
    def thin_selection(self, name: str, rows: DataFrame, shown: int = SHOWN_POINTS) -> DataFrame:
        """Every k-th selected row, so that at most about ``shown`` of a series are drawn."""
        marked = mark_rows(self.readings(name), self.spec, rows)
        return downsample_stride(marked, self.spec, F.col("_picked"), shown)

    @_owned
    def select_point(self, name: str, x: float) -> DataFrame:
        """The row nearest to ``x`` (epoch seconds) in every series, with its value."""
        return nearest_point(self.readings(name), self.spec, EPOCH, float(x))

    @_owned
    def annotate(self, name: str, tolerance_s: float = 0.0) -> DataFrame:
        """Readings with the text of the first loaded event that covers them."""
        if self.events is None:
            raise ValueError("no events are loaded")
        shown = annotation_geometry(self.events_for_table).withColumn(
            "event", annotation_text(F.col("label"), F.col("category"), F.col("description"))
        )
        return annotate_first(
            self.readings(name), shown, TIME, FILE_ORDER, ("event",), tolerance_s
        )

    @_owned
    def detect(
        self, name: str, detector: str, params: dict | None = None, layout: Layout = Layout()
    ) -> DataFrame:
        return detect(self.readings(name), self.spec, detector, params, layout)

    @_owned
    def apply(
        self,
        name: str,
        op: str,
        params: dict | None = None,
        where: Column | DataFrame | None = None,
        label: str | None = None,
    ) -> Edit | None:
        """Correct the selected rows; returns the edit, or None if there were none.

        ``where`` is a condition on ``readings(name)`` or a table of row keys.
        """
        variable = self.open_variable(name)
        frame = self.readings(name)
        if isinstance(where, DataFrame):
            frame = mark_rows(frame, self.spec, where)
            where = F.col("_picked")
        patch = correction_patch(frame, self.spec, op, params, where, costly=True)
        self._claim()
        points = variable.store.write(patch, variable.log.next_seq)
        if points == 0:
            return None
        edit = variable.log.apply(op, label or op, points, datetime.datetime.now())
        variable.ops[edit.seq] = op
        self._write_log()
        if variable.store.due(variable.log.layers, {e.seq: e.points for e in variable.log.known.values()}):
            variable.store.compact(variable.log.layers)
        return edit

    def _change(self, name: str, action: str, *args) -> Edit | None:
        variable = self.open_variable(name)
        self._claim()
        edit = getattr(variable.log, action)(*args)
        self._write_log()
        return edit

    def undo(self, name: str) -> Edit | None:
        return self._change(name, "undo")

    def remove_edit(self, name: str, position: int) -> Edit | None:
        return self._change(name, "remove", position)

    def restore_edit(self, name: str) -> Edit | None:
        return self._change(name, "restore")

    def reset(self, name: str) -> None:
        self._change(name, "reset")

    def history(self, name: str) -> list[Edit]:
        return list(self.open_variable(name).log.edits)

    # --- saving ------------------------------------------------------------------

    @property
    def dirty_variables(self) -> list[str]:
        return [n for n, v in self.variables.items() if v.log.dirty]

    def _save_one(self, mode: str, fmt: str, frame: DataFrame, names: list[str]) -> str:
        path = output_path(self.source, mode, fmt, self.output_folder)
        shown = (F.col(TIME).alias(self.time_column), *[k for k in self.keys if k != self.time_column])
        if mode == "diff":
            touched = {n: (f"_sm_raw_{i}", f"_sm_new_{i}") for i, n in enumerate(names)}
            return write_output(diff_output(frame, shown, touched), path, fmt)
        new = {n: f"_sm_new_{i}" for i, n in enumerate(names)}
        if mode == "series":
            return write_output(series_output(frame, shown, new), path, fmt)
        earlier = path_exists(self.spark, path)
        if not self.has_row_id:
            return self._save_by_position(frame, new, path, fmt, earlier)
        if not earlier:
            return write_output(full_output(frame, self._columns, new), path, fmt)
        # an earlier full output is the source, so fixes of other variables stay
        if fmt == "parquet":
            finish_rewrite(self.spark, path)
        table = read_table(self.spark, path, self._output_schema(path, names))
        fixed = frame.select(*self.row_id, *[named(c).alias(n) for n, c in new.items()])
        check_same_rows(table, fixed, self.row_id)
        if fmt == "parquet" and rewrite_changed(self.spark, path, fixed, self.row_id, names) is not None:
            return path
        return write_output(merged_output(table, fixed, self.row_id, names), path, fmt)

    def _output_schema(self, path: str, names: list[str]) -> T.StructType | None:
        """A csv output is read with the types of the table, corrected columns as doubles."""
        if table_format(path) == "parquet":
            return None
        header = self.spark.read.option("header", True).csv(path).columns
        corrected = set(names) | {c for c in header if isinstance(self._kinds.get(c), T.NumericType)}
        return T.StructType([
            T.StructField(c, T.DoubleType() if c in corrected else self._kinds.get(c, T.StringType())) for c in header
        ])

    def _save_by_position(self, frame: DataFrame, new: dict, path: str, fmt: str, earlier: bool) -> str:
        """A full output of a table without row ids, and beside it what a later one needs.

        ``<output>.rows`` has the position of every row and the corrected variables so
        far; the output itself has the columns of the table and nothing else.
        """
        beside, key = f"{path}.rows", self.row_id
        kept = {}
        if earlier:
            if table_format(self.source) != "parquet" or not path_exists(self.spark, beside):
                raise ValueError(
                    f"{path} cannot be merged: its rows are not known without row_id; nothing was saved"
                )
            # the table beside the output is replaced before the output is written
            rows = stage(self.spark.read.parquet(beside), self._folder)
            check_same_rows(rows, frame, key)
            others = [c for c in rows.columns if c not in key and c not in new]
            kept = {v: f"_sm_kept_{i}" for i, v in enumerate(others)}
            frame = join_on_key(frame, rows.select(*key, *[named(v).alias(c) for v, c in kept.items()]), key)
        full = {**kept, **new}
        if table_format(self.source) == "parquet":
            write_output(frame.select(*key, *[named(c).cast("double").alias(v) for v, c in full.items()]), beside)
        return write_output(full_output(frame, self._columns, full), path, fmt)

    @_owned
    def save(self, mode: str = "full", fmt: str = "parquet") -> str | None:
        """Write one output of all dirty variables; None if nothing is dirty."""
        output_path(self.source, mode, fmt, self.output_folder)
        names = self.dirty_variables
        if not names:
            return None
        path = self._save_one(mode, fmt, self._frame(names), names)
        self._mark_clean()
        return path

    @_owned
    def save_all(self, fmt: str = "parquet") -> dict[str, str]:
        """All three outputs from one snapshot of the corrected values."""
        names = self.dirty_variables
        if not names:
            return {}
        # the three outputs must agree: the corrected values are fixed, the table is not copied
        frame = self._frame(names)
        new = [f"_sm_new_{i}" for i in range(len(names))]
        fixed = stage(frame.select(*self.row_id, *new), self._folder)
        snapshot = join_on_key(self._base(names), fixed, self.row_id)
        paths = {mode: self._save_one(mode, fmt, snapshot, names) for mode in SUFFIXES}
        self._mark_clean()
        return paths

    def _mark_clean(self) -> None:
        """Any save clears all variables, also for whoever opens the session again."""
        self._claim()
        for variable in self.variables.values():
            variable.log.saved()
        self._write_log()
