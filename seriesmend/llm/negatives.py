"""Hard negatives by exact integer scores, looked up in subset-sum tables.

Components are whole numbers, floor(scale * x).  A score, the inner product of an anchor
and a candidate, is found without multiplying (the method of the Four Russians):

1. Every row is packed once into bit planes: plane p holds bit p of its components (two's
   complement), eight dimensions to a byte.
2. For every group of eight dimensions, an anchor's table holds the sums of all 256
   subsets of its components there.  A byte of a plane is an index into it.
3. A score is the sum of the looked-up subset sums of a plane, shifted by the plane's
   place and added over the planes; the sign plane counts negatively.

Anchors (a stated query set) meet all rows in blocks of bounded size: a cell is a block of
anchors and a block of rows, both dealt by a row number's hash, so neither labels nor
repeated vectors make a cell large.  Cells return an anchor's best few; a window per
anchor merges those.  First come the positives, against the rows of the anchor's label
only, then the negatives within each positive's band.

Nulls and ties: rows with a null label, a null vector or a null or non-finite component
take no part; a row without a vec_id does and comes last among equal scores, but is no
anchor.  Equal scores go by vec_id.  Repeated rows count each: as candidates, and as
anchors that return their rows once each.  A shorter vector counts as filled up with
zeros, an empty one scores 0.  An empty table, or one without anchors, gives no rows.
Other columns, whatever their names, are not read.  Scores must fit 63 bits; if vectors
could exceed that, the job stops with a message that says so.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F

from seriesmend.llm.common import quoted
from seriesmend.plans.staging import stage

SCALE = 256
POSITIVES, NEGATIVES = 5, 10
BAND = (30, 90, 100)        # low * positive <= of * negative <= high * positive
ANCHORS_PER_CELL = 32_768
ROWS_PER_CELL = 16_384
AT_ONCE = (128, 1024)       # anchors and rows scored together
VALUES_AT_ONCE = 1 << 20    # components packed together

PACKED = "row long, vec_id long, label long, planes int, bits binary"


# ---- packing -----------------------------------------------------------------

def planes_for(least: int, most: int) -> int:
    """Bits of the two's complement that holds both."""
    return max(most, -least - 1, 0).bit_length() + 1


def pack(values: np.ndarray) -> np.ndarray:
    """(rows, planes, bytes): the bit planes of whole numbers, eight dimensions to a byte."""
    n, dims = values.shape
    planes = planes_for(int(values.min(initial=0)), int(values.max(initial=0)))
    out = np.zeros((n, planes, (dims + 7) // 8), np.uint8)
    for p in range(planes):
        out[:, p] = np.packbits((values >> p & 1).astype(np.uint8), axis=1, bitorder="little")
    return out


def unpack(bits: np.ndarray) -> np.ndarray:
    """The whole numbers of packed rows, as many dimensions as the bytes hold."""
    n, planes, width = bits.shape
    out = np.zeros((n, width * 8), np.int64)
    for p in range(planes):
        plane = np.unpackbits(bits[:, p], axis=1, bitorder="little").astype(np.int64)
        out += plane * ((1 << p) if p < planes - 1 else -(1 << p))
    return out


def _packing(scale: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = batch.column("vector")
            lengths = np.diff(np.asarray(vectors.offsets))
            at, longest = 0, int(lengths.max(initial=1))
            step = max(1, VALUES_AT_ONCE // max(longest, 1))
            while at < len(lengths):
                yield _pack_some(batch.slice(at, step), lengths[at: at + step], scale)
                at += step

    return rows


def _pack_some(batch: pa.RecordBatch, lengths: np.ndarray, scale: int) -> pa.RecordBatch:
    flat = batch.column("vector").flatten().to_numpy(zero_copy_only=False)   # null becomes NaN
    dims = max(int(lengths.max(initial=0)), 1)
    values = np.zeros((len(lengths), dims))
    values[np.arange(dims) < lengths[:, None]] = flat
    sound = np.isfinite(values).all(axis=1)
    values = np.floor(values[sound] * scale)
    if np.abs(values).max(initial=0) >= 2.0**62:
        raise ValueError(f"components times {scale} must stay below 2^62")
    bits = pack(values.astype(np.int64))
    n, planes, width = bits.shape
    ends = np.arange(n + 1, dtype=np.int32) * (planes * width)
    data = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(bits))])
    kept = batch.filter(pa.array(sound))
    return pa.RecordBatch.from_arrays(
        [kept.column("row"), kept.column("vec_id"), kept.column("label"),
         pa.array(np.full(n, planes, np.int32)), data],
        ["row", "vec_id", "label", "planes", "bits"],
    )


def packed_rows(vectors: DataFrame, vec_id: str, embedding: str, label: Column, scale: int = SCALE) -> DataFrame:
    """The rows that take part, as bit planes and with a row number, written once."""
    named = vectors.select(
        F.monotonically_increasing_id().alias("row"), quoted(vec_id).cast("long").alias("vec_id"),
        label.cast("long").alias("label"), quoted(embedding).cast("array<double>").alias("vector"),
    )
    known = named.filter(F.col("label").isNotNull() & F.col("vector").isNotNull())
    return stage(known.mapInArrow(_packing(scale), PACKED))


# ---- scoring -----------------------------------------------------------------

class Rows:
    """Unpacked columns of one side of a cell, ordered by vec_id (missing ones last)."""

    def __init__(self, table: pa.Table):
        ids = table.column("vec_id")
        table = table.take(pc.sort_indices(ids, null_placement="at_end"))
        self.vec_id = table.column("vec_id").to_pylist()
        self.row = table.column("row").to_numpy()
        self.label = table.column("label").to_numpy()
        planes, bits = table.column("planes").to_pylist(), table.column("bits").to_pylist()
        self.width = max((len(b) // p for b, p in zip(bits, planes)), default=0)
        self.planes = max(planes, default=1)
        # missing high planes repeat the sign plane, missing dimensions are zero
        self.bits = np.zeros((len(bits), self.planes, self.width), np.uint8)
        for i, (p, b) in enumerate(zip(planes, bits)):
            one = np.frombuffer(b, np.uint8).reshape(p, -1)
            self.bits[i, :p, : one.shape[1]] = one
            self.bits[i, p:, : one.shape[1]] = one[-1]
        self.table = table

    def __len__(self):
        return len(self.row)


def subset_sums(values: np.ndarray, groups: int) -> np.ndarray:
    """(group, subset, anchor): sums of every subset of eight components."""
    n = len(values)
    padded = np.zeros((n, groups * 8), np.int64)
    padded[:, : min(values.shape[1], groups * 8)] = values[:, : groups * 8]
    most = int(np.abs(padded).sum(axis=1).max(initial=0))   # of any subset, also over groups
    kind = np.int16 if most < 1 << 15 else np.int32 if most < 1 << 31 else np.int64
    parts = padded.reshape(n, groups, 8).transpose(1, 2, 0).astype(kind)
    sums = np.zeros((groups, 256, n), kind)
    for j in range(8):
        sums[:, 1 << j: 2 << j] = sums[:, : 1 << j] + parts[:, j, None]
    return sums


def scores(sums: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """(row, anchor) exact inner products; ``bits`` is (plane, group, row)."""
    groups, _, anchors = sums.shape
    planes, _, n = bits.shape
    plane, found = np.empty((n, anchors), sums.dtype), np.empty((n, anchors), sums.dtype)
    total = np.zeros((n, anchors), np.int64)
    for p in reversed(range(planes)):
        plane[:] = 0
        for g in range(groups):
            np.take(sums[g], bits[p, g], axis=0, out=found, mode="clip")
            plane += found
        total <<= 1
        if p == planes - 1:
            total -= plane
        else:
            total += plane
    return total


LEAST = np.iinfo(np.int64).min


class Best:
    """The k best rows of every anchor seen so far; rows must come in vec_id order."""

    def __init__(self, k: int, anchors: int):
        self.score = np.full((k, anchors), LEAST, np.int64)
        self.place = np.full((k, anchors), -1, np.int64)
        self.k = k

    def offer(self, total: np.ndarray, places: np.ndarray, low: np.ndarray | None = None, high: np.ndarray | None = None) -> None:
        """Scores (row, anchor) of the rows at ``places``; the least score is never taken."""
        above = self.score[-1] if low is None else np.maximum(self.score[-1], low - 1)
        hits = total > above
        if high is not None:
            hits &= total <= high
        many = np.count_nonzero(hits)
        if not many:
            return
        n, anchors = total.shape
        if many > 4 * self.k * anchors and n > self.k:
            only = np.where(hits, total, LEAST)
            hits &= total >= np.partition(only, n - self.k, axis=0)[n - self.k]
        rows, columns = np.nonzero(hits)
        old_rank, old = np.nonzero(self.place >= 0)
        column = np.concatenate([old, columns])
        score = np.concatenate([self.score[old_rank, old], total[rows, columns]])
        place = np.concatenate([self.place[old_rank, old], places[rows]])
        order = np.lexsort((place, -score, column))
        column, score, place = column[order], score[order], place[order]
        first = np.searchsorted(column, np.arange(anchors))
        rank = np.arange(len(column)) - first[column]
        kept = rank < self.k
        self.score[rank[kept], column[kept]] = score[kept]
        self.place[rank[kept], column[kept]] = place[kept]


def _check_range(anchors: np.ndarray, rows: Rows) -> None:
    if np.abs(anchors.astype(float)).sum(axis=1).max(initial=0) * 2.0**rows.planes >= 2.0**62:
        raise ValueError("scores of these vectors don't fit 63 bits")


def _pieces(n: int, size: int):
    return (slice(at, min(at + size, n)) for at in range(0, n, size))


def _positives(k: int):
    """One cell: every anchor's best other rows of its label."""

    def cell(anchors: pa.Table, rows: pa.Table) -> pa.Table:
        a, r = Rows(anchors), Rows(rows)
        out: list[tuple] = []
        by_label = np.argsort(r.label, kind="stable")
        labels = r.label[by_label]
        values = unpack(a.bits)
        _check_range(values, r)
        groups = min(a.width, r.width)
        for label in np.unique(a.label):
            mine = np.flatnonzero(a.label == label)
            same = by_label[np.searchsorted(labels, label): np.searchsorted(labels, label, "right")]
            for some in _pieces(len(mine), AT_ONCE[0]):
                who = mine[some]
                sums, best = subset_sums(values[who], groups), Best(k, len(who))
                for piece in _pieces(len(same), AT_ONCE[1]):
                    at = same[piece]
                    total = scores(sums, r.bits[at].transpose(1, 2, 0))
                    total[r.row[at][:, None] == a.row[who]] = LEAST   # the anchor itself
                    best.offer(total, at)
                for rank, column in zip(*np.nonzero(best.place >= 0)):
                    place = best.place[rank, column]
                    out.append((int(a.row[who[column]]), r.vec_id[place], int(best.score[rank, column])))
        return _table(out, ("anchor_row", "vec_id", "score"))

    return cell


def _negatives(k: int, band: tuple[int, int, int]):
    """One cell: for every anchor and positive, the best rows of other labels in its band."""
    low, high, of = band

    def cell(anchors: pa.Table, rows: pa.Table) -> pa.Table:
        a, r = Rows(anchors), Rows(rows)
        out: list[tuple] = []
        values = unpack(a.bits)
        _check_range(values, r)
        groups = min(a.width, r.width)
        positives = a.table.column("positives").to_pylist()
        slots = max((len(p) for p in positives), default=0)
        # slots an anchor hasn't got have an empty band
        lows, highs = np.ones((slots, len(a)), np.int64), np.zeros((slots, len(a)), np.int64)
        for i, mine in enumerate(positives):
            for s, positive in enumerate(mine):
                lows[s, i] = -(-low * positive["score"] // of)
                highs[s, i] = high * positive["score"] // of
        for who in _pieces(len(a), AT_ONCE[0]):
            sums = subset_sums(values[who], groups)
            best = [Best(k, who.stop - who.start) for _ in range(slots)]
            for piece in _pieces(len(r), AT_ONCE[1]):
                total = scores(sums, r.bits[piece].transpose(1, 2, 0))
                total[r.label[piece][:, None] == a.label[who]] = LEAST
                places = np.arange(piece.start, piece.stop)
                for s in range(slots):
                    best[s].offer(total, places, lows[s, who], highs[s, who])
            for s in range(slots):
                for rank, column in zip(*np.nonzero(best[s].place >= 0)):
                    place = best[s].place[rank, column]
                    out.append((int(a.row[who.start + column]), s, r.vec_id[place], int(best[s].score[rank, column])))
        return _table(out, ("anchor_row", "slot", "vec_id", "score"))

    return cell


def _table(rows: list[tuple], names: tuple[str, ...]) -> pa.Table:
    columns = list(zip(*rows)) or [()] * len(names)
    kinds = {"slot": pa.int32()}
    return pa.table({n: pa.array(c, kinds.get(n, pa.int64())) for n, c in zip(names, columns)})


# ---- cells -------------------------------------------------------------------

def _in_cells(anchors: DataFrame, rows: DataFrame, grid: tuple[int, int], cell, schema: str) -> DataFrame:
    """Apply ``cell`` to every block of anchors with every block of rows."""
    blocks = lambda n: F.pmod(F.xxhash64("row"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = anchors.withColumn("block_a", blocks(grid[0])).withColumn("block_r", every(grid[1]))
    right = rows.withColumn("block_r", blocks(grid[1])).withColumn("block_a", every(grid[0]))
    return left.groupBy("block_a", "block_r").cogroup(right.groupBy("block_a", "block_r")).applyInArrow(cell, schema)


def _first(df: DataFrame, keys: list[str], k: int) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), F.asc_nulls_last("vec_id"))
    return df.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def mine(
    vectors: DataFrame,
    is_anchor: Column,
    vec_id: str = "vec_id",
    embedding: str = "embedding",
    label: Column | None = None,
    scale: int = SCALE,
    positives: int = POSITIVES,
    negatives: int = NEGATIVES,
    band: tuple[int, int, int] = BAND,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    ``is_anchor`` is a condition on vec_id (so named); ``label`` defaults to the column.
    """
    rows = packed_rows(vectors, vec_id, embedding, quoted("label") if label is None else label, scale)
    anchors = rows.filter(is_anchor & F.col("vec_id").isNotNull())
    n_rows, n_anchors = rows.count(), anchors.count()
    grid = (max(1, math.ceil(n_anchors / ANCHORS_PER_CELL)), max(1, math.ceil(n_rows / ROWS_PER_CELL)))
    found = _in_cells(anchors, rows, grid, _positives(positives), "anchor_row long, vec_id long, score long")
    of_anchor = stage(_first(found, ["anchor_row"], positives).drop("rank"))
    lists = of_anchor.groupBy("anchor_row").agg(F.sort_array(F.collect_list(F.struct("score", "vec_id"))).alias("positives"))
    # a row number names one row, so no key is hot here
    with_lists = stage(anchors.join(lists, F.col("row") == F.col("anchor_row")).drop("anchor_row"))
    near = _in_cells(
        with_lists, rows, grid, _negatives(negatives, band), "anchor_row long, slot int, vec_id long, score long")
    ranked = _first(near, ["anchor_row", "slot"], negatives)
    known = with_lists.select(F.col("row").alias("anchor_row"), F.col("vec_id").alias("anchor_id"),
                              F.posexplode("positives").alias("slot", "positive"))
    return ranked.join(known, ["anchor_row", "slot"]).select(
        "anchor_id", F.col("positive.vec_id").alias("positive_id"), "rank", F.col("vec_id").alias("negative_id"),
        F.col("positive.score").alias("positive_score"), F.col("score").alias("negative_score"))
