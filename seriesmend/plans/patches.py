"""Stored patches of one variable: a tail of edits and compacted snapshots.

Every edit leaves its rows in a folder of its own.  With many edits a replay would read
them all, so from time to time the state they amount to is written as a *snapshot*: the
last layer touching each row, and the value there.  A snapshot stands for a list of layers.
It counts as long as that list is a prefix of the layers in force, whatever came after, so
undo and removal stay exact: an undo adds a layer behind it, a removal makes an older
snapshot (or none) the longest that fits, and a restored edit brings the newer one back.

A snapshot is due when the rows behind the last one outgrow a share of it.  Each is thus
some times larger than the one before, and a row is rewritten a logarithmic number of times.

Snapshots are bucketed by one text that tells rows apart, in tables whose folder is the
session's: a replay joins them without moving them.
"""

from __future__ import annotations

import json
import math
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from seriesmend.model import SeriesSpec, named
from seriesmend.plans.history import NEW
from seriesmend.plans.staging import delete_folder
from seriesmend.sinks.files import path_exists

KEY = "_sm_key"
TAIL_SHARE = 0.5       # rows behind a snapshot, as a share of its own, that make a new one due
LEAST_TAIL = 64        # ... or so many layers
SNAPSHOT_COLUMNS = (KEY, "_sm_layer", "_sm_value")
ROWS_PER_BUCKET = 5_000_000


def row_text(spec: SeriesSpec) -> Column:
    """One non-null text per row key: every column's text behind its length."""
    parts = []
    for c in spec.row_key:
        text = named(c).cast("string")
        parts.append(F.coalesce(F.concat(F.length(text).cast("string"), F.lit(":"), text), F.lit("-")))
    return F.concat(*parts)


@dataclass(frozen=True)
class Snapshot:
    """``table`` has the last of ``layers`` for every row one of them touches."""

    table: str
    layers: tuple[tuple[int, str], ...]
    rows: int

    def fits(self, layers: list[tuple[int, str]]) -> bool:
        return tuple(layers[: len(self.layers)]) == self.layers


class PatchStore:
    """The patches of one variable under ``folder``.

    ``patch`` rows are the row key, ``old_value`` and ``new_value``; a layer names an edit
    and which of its values were written (see ``history``).
    """

    def __init__(self, spark, folder: str, spec: SeriesSpec):
        self.spark, self.folder, self.spec = spark, folder, spec
        self._snapshots: list[Snapshot] | None = None

    # --- edits -------------------------------------------------------------------

    def path(self, seq: int) -> str:
        return f"{self.folder}/_sm_seq={seq}"

    def write(self, patch: DataFrame, seq: int) -> int:
        """Store one edit; the number of its rows."""
        patch.write.mode("overwrite").parquet(self.path(seq))
        return self.spark.read.parquet(self.path(seq)).count()

    def write_all(self, patches: DataFrame) -> dict[int, int]:
        """Store many edits told apart by ``_sm_seq``; the number of rows of each."""
        patches.repartition(F.col("_sm_seq")).write.mode("append").partitionBy("_sm_seq").parquet(self.folder)
        # one row per edit
        counted = self.spark.read.parquet(self.folder).groupBy("_sm_seq").count().collect()
        return {int(r["_sm_seq"]): r["count"] for r in counted}

    def patches(self, seqs) -> DataFrame | None:
        """The stored rows of some edits, with ``_sm_seq``; an edit without rows has no folder."""
        there = self._edits_there() if seqs else set()
        seqs = sorted(set(seqs) & there)
        if not seqs:
            return None
        stored = self.spark.read.option("basePath", self.folder).parquet(*[self.path(n) for n in seqs])
        return stored.withColumn("_sm_seq", F.col("_sm_seq").cast("int"))

    def _edits_there(self) -> set[int]:
        where = self.spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        system = where.getFileSystem(self.spark._jsc.hadoopConfiguration())
        names = [s.getPath().getName() for s in system.listStatus(where)] if system.exists(where) else []
        return {int(n.rpartition("=")[2]) for n in names if n.startswith("_sm_seq=")}

    # --- snapshots ---------------------------------------------------------------

    @property
    def snapshots(self) -> list[Snapshot]:
        """Those of this session, and on reopening those its folder lists."""
        if self._snapshots is None:
            self._snapshots = []
            listed = f"{self.folder}/_snapshots"
            if path_exists(self.spark, listed):
                # as many rows as there are snapshots
                for r in self.spark.read.json(listed, "place string, layers string, rows long").collect():
                    layers = tuple((seq, side) for seq, side in json.loads(r["layers"]))
                    self._snapshots.append(Snapshot(self._attached(r["place"]), layers, r["rows"]))
        return self._snapshots

    def _attached(self, place: str) -> str:
        """The name of a table over a snapshot's folder, bucketed as it was written."""
        name = f"_sm_snapshot_{uuid.uuid4().hex}"
        buckets = int(place.rpartition("-")[2])
        self.spark.sql(
            f"CREATE TABLE {name} ({KEY} STRING, _sm_layer INT, _sm_value DOUBLE) USING parquet "
            f"CLUSTERED BY ({KEY}) SORTED BY ({KEY}) INTO {buckets} BUCKETS LOCATION '{self.folder}/{place}'"
        )
        return name

    def best(self, layers: list[tuple[int, str]]) -> Snapshot | None:
        """The snapshot that stands for most of the first layers."""
        return max((s for s in self.snapshots if s.fits(layers)), key=lambda s: len(s.layers), default=None)

    def due(self, layers: list[tuple[int, str]], points: dict[int, int]) -> bool:
        """Whether the rows behind the best snapshot (``points`` of each edit) ask for a new one."""
        base = self.best(layers)
        behind = layers[len(base.layers) if base else 0:]
        if len(behind) >= LEAST_TAIL:
            return True
        rows = sum(points.get(seq, 0) for seq, _ in behind)
        return base is not None and rows > TAIL_SHARE * base.rows and len(behind) > 1

    def compact(self, layers: list[tuple[int, str]]) -> Snapshot | None:
        """Write what the layers amount to; None without layers.

        The snapshot is listed once it is complete: a lost driver leaves a folder that
        nothing reads.
        """
        state = self.latest(layers)
        if state is None:
            return None
        rows = state.count()
        shuffles = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        buckets = max(shuffles, math.ceil(rows / ROWS_PER_BUCKET))
        place = f"_snapshot-{uuid.uuid4().hex[:12]}-{buckets}"
        table = self._attached(place)
        dealt = state.select(*SNAPSHOT_COLUMNS).repartition(buckets, KEY).sortWithinPartitions(KEY)
        dealt.write.insertInto(table)
        record = [(place, json.dumps(layers), rows)]
        self.spark.createDataFrame(record, "place string, layers string, rows long").coalesce(1).write.mode(
            "append").json(f"{self.folder}/_snapshots")
        known = self.snapshots
        snapshot = Snapshot(table, tuple(layers), rows)
        if not any(s.layers == snapshot.layers for s in known):
            known.append(snapshot)
        return snapshot

    # --- what the layers amount to -------------------------------------------------

    def tail(self, layers: list[tuple[int, str]], first: int) -> DataFrame | None:
        """Rows (key, layer, value) of the layers from the ``first`` one on, not yet reduced."""
        numbered = [(i, seq, side == NEW) for i, (seq, side) in enumerate(layers) if i >= first]
        stored = self.patches([seq for _, seq, _ in numbered])
        if stored is None:
            return None
        # as long as the list of edits on the driver
        table = F.broadcast(self.spark.createDataFrame(numbered, "_sm_layer int, _sm_seq int, _sm_new boolean"))
        value = F.when(F.col("_sm_new"), F.col("new_value")).otherwise(F.col("old_value"))
        return stored.join(table, "_sm_seq").select(
            row_text(self.spec).alias(KEY), "_sm_layer", value.cast("double").alias("_sm_value"))

    def latest(self, layers: list[tuple[int, str]]) -> DataFrame | None:
        """For every row a layer touches: its key, the last such layer and the value there."""
        base = self.best(layers)
        rows = self.tail(layers, len(base.layers) if base else 0)
        if base:
            kept = self.spark.table(base.table)
            rows = kept if rows is None else kept.unionAll(rows)
        if rows is None:
            return None
        return rows.groupBy(KEY).agg(
            F.max_by("_sm_value", "_sm_layer").alias("_sm_value"), F.max("_sm_layer").alias("_sm_layer"))

    def drop(self) -> None:
        """Forget the tables; the folder is the session's."""
        for s in self._snapshots or []:
            self.spark.sql(f"DROP TABLE IF EXISTS {s.table}")
        delete_folder(self.spark, self.folder)


def replay_stored(frame: DataFrame, spec: SeriesSpec, stores: list[tuple[PatchStore, list, str, str]]) -> DataFrame:
    """``frame`` with the corrected values of several variables at once.

    ``stores`` are (patches, layers, raw column, name of the corrected one).  The tails of
    all variables are one grouped table and one join; a snapshot is joined bucket by bucket,
    on the key the frame is then already dealt by.
    """
    columns, tails, tailed, bases = frame.columns, [], [], []
    for i, (store, layers, _, _) in enumerate(stores):
        base = store.best(layers)
        bases.append(base)
        tail = store.tail(layers, len(base.layers) if base else 0)
        if tail is not None:
            tails.append(tail.withColumn("_sm_of", F.lit(i)))
            tailed.append(i)
    value = {i: named(raw) for i, (_, _, raw, _) in enumerate(stores)}
    if any(bases) or tails:
        frame = frame.withColumn(KEY, row_text(spec))
    for i, base in enumerate(bases):
        if base:
            kept = stores[i][0].spark.table(base.table).select(
                KEY, F.col("_sm_layer").isNotNull().alias(f"_sm_there_{i}"), F.col("_sm_value").alias(f"_sm_base_{i}"))
            frame = frame.join(kept, KEY, "left")
            value[i] = F.when(F.col(f"_sm_there_{i}"), F.col(f"_sm_base_{i}")).otherwise(value[i])
    if tails:
        rows = tails[0]
        for other in tails[1:]:
            rows = rows.unionAll(other)
        wanted = sorted(tailed)
        last = []
        for i in wanted:
            own = F.col("_sm_of") == i
            layer = F.when(own, F.col("_sm_layer"))
            # wrapped, so that a value patched to missing differs from no patch
            last.append(F.max_by(F.struct(F.col("_sm_value").alias("v")), layer).alias(f"_sm_tail_{i}"))
        frame = frame.join(rows.groupBy(KEY).agg(*last), KEY, "left")
        for i in wanted:
            value[i] = F.when(F.col(f"_sm_tail_{i}").isNotNull(), F.col(f"_sm_tail_{i}.v")).otherwise(value[i])
    return frame.select(
        *[named(c) for c in columns], *[value[i].alias(name) for i, (_, _, _, name) in enumerate(stores)])
