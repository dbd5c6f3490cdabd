"""How filters overlap, in every order: wide packed counters.

Five filters applied one after another remove the same documents in another order each
time.  Which step removes a document depends on nothing but the set of filters it fails
(a mask) and the order.  So every mask is one big integer that holds the outcome of every
step of every order: for 120 orders of five steps, 600 fields per measure.  Adding a
document to a part is adding its integer; a field is 64 bits wide and counts rows, of
which a table has fewer than 2^63, so no sum carries into the next field.

1. One pass over the texts gives each document its mask and the digest of its text.
2. Whether the same text has a smaller doc_id is settled by a join with the least doc_id
   of every repeated digest, which is written first, so that a text that a third of all
   rows share is an ordinary skewed join; so is a hot or missing doc_id at the labels.
3. Every task adds integers per part, then partial sums meet per part and salt, then per
   part; all three read sorted rows one by one and hold one sum (the first a bounded
   number of them).  The sums are unpacked where they end.

Nulls: a null text is empty, a null source the part ``''``.  A row without a doc_id isn't
identical to any smaller one, makes no other row fail and has no labels.  Repeated rows
count each; rows of the same doc_id and text don't make each other fail.  A doc_id with
several label rows is good (toxic) if one of them says so.  An empty table has no parts.
Long texts are split as bytes, one text at a time.  Other columns, whatever their names,
are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from seriesmend.llm.common import UPPER, partitions_for, quoted, text_of
from seriesmend.plans.staging import stage

NAMES = "ABCDE"
SAME_TEXT = NAMES.index("E")
LEAST_WORDS = 200
SYMBOLS = b"#$%&*|"
MEASURES = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")
WIDTH = 8            # bytes of a field
PARTS_HELD = 500     # sums one task holds before it hands them on
SALTS = 64


# ---- masks -------------------------------------------------------------------

def text_mask(text: bytes, n_chars: int) -> int:
    """The conditions a text fails on its own: bits 0 to 3 for A to D."""
    words = text.split()   # of bytes: at space and tab to carriage return
    capitals = len(text) - len(text.translate(None, UPPER.encode()))
    return (
        (len(words) < LEAST_WORDS)
        | (100 * len(set(words)) < 50 * len(words)) << 1
        | (100 * capitals > 2 * n_chars) << 2
        | (len(text.translate(None, SYMBOLS)) < len(text)) << 3
    )


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts, sizes = batch.column("text"), batch.column("n_chars").to_pylist()
        masks, digests = [], []
        for text, n in zip(texts, sizes):   # one text at a time as Python bytes
            data = text.as_py()
            masks.append(text_mask(data, n))
            digests.append(hashlib.sha256(data).digest())
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("part"), pa.array(masks, pa.int32()), pa.array(digests, pa.binary())],
            ["doc_id", "part", "mask", "digest"],
        )


def masks(
    docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source"
) -> DataFrame:
    """part, mask (bits A to E), good and toxic of every row of ``docs``."""
    whole = text_of(text)
    narrow = docs.select(
        quoted(doc_id).alias("doc_id"),
        F.coalesce(quoted(source).cast("string"), F.lit("")).alias("part"),
        whole.cast("binary").alias("text"),
        F.length(whole).alias("n_chars"),
    )
    kind = narrow.schema["doc_id"].dataType
    schema = T.StructType([
        T.StructField("doc_id", kind), T.StructField("part", T.StringType()),
        T.StructField("mask", T.IntegerType()), T.StructField("digest", T.BinaryType()),
    ])
    rows = stage(narrow.mapInArrow(_read, schema))
    # written before they are joined: adaptive execution can then split a hot digest or id
    firsts = stage(
        rows.groupBy("digest").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n"))
        .filter("n > 1").select("digest", "first")
    )
    is_one = lambda c: F.coalesce(F.max(quoted(c) == 1), F.lit(False))
    known = stage(
        labels.filter(quoted("doc_id").isNotNull()).groupBy(quoted("doc_id").alias("doc_id"))
        .agg(is_one("quality").alias("good"), is_one("toxic").alias("toxic"))
    )
    again = F.coalesce(F.col("doc_id") > F.col("first"), F.lit(False)).cast("int")
    judged = rows.join(firsts, "digest", "left").select(
        "doc_id", "part", F.col("mask").bitwiseOR(F.shiftleft(again, SAME_TEXT)).alias("mask"))
    return judged.join(known, "doc_id", "left").select(
        "part", "mask", F.coalesce("good", F.lit(False)).alias("good"), F.coalesce("toxic", F.lit(False)).alias("toxic"))


# ---- packed counters ---------------------------------------------------------

def orders(names: str = NAMES) -> list[str]:
    return ["".join(p) for p in permutations(names)]


def packed(mask: int, good: bool, toxic: bool, names: str = NAMES) -> int:
    """All step outcomes of a document as one integer: measures, then orders, then steps."""
    fields = np.zeros((len(MEASURES), len(orders(names)), len(names)), np.int64)
    for o, order in enumerate(orders(names)):
        gone = False
        for s, name in enumerate(order):
            fails = bool(mask >> names.index(name) & 1)
            removed = fails and not gone
            gone = gone or fails
            fields[:, o, s] = (
                not gone, removed, fails and not removed, mask == 1 << names.index(name),
                removed and good, removed and toxic,
            )
    return int.from_bytes(fields.astype("<i8").tobytes(), "little")


def unpacked(total: int, names: str = NAMES) -> np.ndarray:
    """The fields of a sum: (measure, order, step)."""
    shape = (len(MEASURES), len(orders(names)), len(names))
    return np.frombuffer(total.to_bytes(WIDTH * int(np.prod(shape)), "little"), "<i8").reshape(shape)


def _as_bytes(total: int, names: str) -> bytes:
    return total.to_bytes(WIDTH * len(MEASURES) * len(orders(names)) * len(names), "little")


def _sums(names: str):
    """Rows with a part and a mask to partial sums: what a task adds up before a shuffle."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[tuple, int] = {}
        sums: dict[str, int] = {}

        def out():
            rows = [list(sums), [_as_bytes(v, names) for v in sums.values()]]
            sums.clear()
            return pa.RecordBatch.from_arrays([pa.array(rows[0], pa.string()), pa.array(rows[1], pa.binary())], ["part", "sum"])

        for batch in batches:
            table = pa.Table.from_batches([batch]).group_by(["part", "mask", "good", "toxic"]).aggregate([([], "count_all")])
            for row in table.to_pylist():
                key = (row["mask"], row["good"], row["toxic"])
                if key not in known:
                    known[key] = packed(*key, names)
                sums[row["part"]] = sums.get(row["part"], 0) + known[key] * row["count_all"]
                if len(sums) >= PARTS_HELD:
                    yield out()
        if sums:
            yield out()

    return add


def _merged(finish):
    """Sorted (part, sum) rows to one result per part; only the running sum is held."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, total = None, 0
        for batch in batches:
            for name, value in zip(batch.column("part").to_pylist(), batch.column("sum")):
                if part is not None and name != part:
                    yield finish(part, total)
                    total = 0
                part, total = name, total + int.from_bytes(value.as_py(), "little")
        if part is not None:
            yield finish(part, total)

    return add


def _report(names: str):
    def rows(part: str, total: int) -> pa.RecordBatch:
        fields = unpacked(total, names)
        every = orders(names)
        removed = fields[MEASURES.index("removed")]
        letters = np.array([list(o) for o in every])
        shapley = np.zeros_like(removed)
        for name in names:
            shapley[letters == name] = removed[letters == name].sum()
        n = removed.size
        columns = {
            "part": pa.array([part] * n, pa.string()),
            "filter_order": pa.array([o for o in every for _ in names], pa.string()),
            "step": pa.array(np.tile(np.arange(1, len(names) + 1, dtype=np.int32), len(every))),
        }
        for measure, values in zip(MEASURES, fields):
            columns[measure] = pa.array(values.reshape(-1), pa.int64())
        columns["shapley"] = pa.array(shapley.reshape(-1), pa.int64())
        return pa.RecordBatch.from_pydict(columns)

    return rows


REPORT = "part string, filter_order string, step int, " + ", ".join(f"{m} long" for m in (*MEASURES, "shapley"))


def interactions(masked: DataFrame, names: str = NAMES) -> DataFrame:
    """For every part, order and step: what the step's filter keeps, removes and repeats.

    ``masked`` has part (string), mask (int, bit i for the i-th name), good and toxic
    (boolean), none of them null.  ``shapley`` is what a filter removes over all orders.
    """
    half = "part string, sum binary"
    partial = masked.select("part", "mask", "good", "toxic").mapInArrow(_sums(names), half)
    again = _merged(lambda part, total: pa.RecordBatch.from_pydict(
        {"part": pa.array([part], pa.string()), "sum": pa.array([_as_bytes(total, names)], pa.binary())}))
    n = partitions_for(masked)
    salted = partial.withColumn("salt", F.spark_partition_id() % SALTS)
    fewer = (
        salted.repartition(n, "part", "salt").sortWithinPartitions("part").select("part", "sum").mapInArrow(again, half)
    )
    return fewer.repartition(n, "part").sortWithinPartitions("part").mapInArrow(_merged(_report(names)), REPORT)


def audit(docs: DataFrame, labels: DataFrame, **columns: str) -> DataFrame:
    """The interactions of the five filters over ``docs``, part by part."""
    return interactions(masks(docs, labels, **columns))
