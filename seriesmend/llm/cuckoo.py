"""Exact deduplication on a sharded cuckoo-filter index of text digests.

Texts are equal when nothing but white space tells them apart.  Their digests are
spread over shards of bounded size.  A shard is a cuckoo filter (two candidate
buckets of four 16-bit fingerprints) beside the digests it stands for, kept in the
same buckets: a digest the filter rejects is new without a look at the content; a
possible hit is verified against the content of its bucket.  A filter that
overflows is resized and filled again from the stored keys.  Verified deletion
takes out one fingerprint, so live digests of other texts stay found.

Copies are merged before the shards see them (per digest and salt), so a text that
a third of all rows share does not make one shard large.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from seriesmend.llm.common import fresh, partitions_for, quoted, squeezed, text_of
from seriesmend.plans.staging import stage

DIGESTS_PER_SHARD = 100_000   # what one task holds in memory
SALTS = 32                    # partial groups a digest may have before the shards
SLOTS, KICKS = 4, 400


class CuckooShard:
    """A cuckoo filter and the digests (hexadecimal) it stands for, with a value each."""

    def __init__(self, buckets: int = 64, table: np.ndarray | None = None):
        self.buckets = buckets
        self.table = np.zeros((buckets, SLOTS), np.uint16) if table is None else table
        self.content: dict[int, dict[str, tuple]] = {}
        self.live = 0

    def _places(self, digest: str) -> tuple[int, int, int]:
        mark = (int(digest[16:20], 16) % 65535) + 1   # 0 is an empty slot
        first = int(digest[:16], 16) & (self.buckets - 1)
        return mark, first, self._other(first, mark)

    def _other(self, bucket: int, mark: int) -> int:
        return bucket ^ ((mark * 0x5BD1E995) & (self.buckets - 1))

    def may_hold(self, digest: str) -> bool:
        mark, a, b = self._places(digest)
        return mark in self.table[a].tolist() or mark in self.table[b].tolist()

    def get(self, digest: str) -> tuple | None:
        """The value of a live digest: filter first, then the content of its bucket."""
        if not self.may_hold(digest):
            return None
        return self.content.get(self._places(digest)[1], {}).get(digest)

    def put(self, digest: str, value: tuple) -> None:
        """Store or replace the value of a digest."""
        bucket = self._places(digest)[1]
        known = digest in self.content.get(bucket, {}) if self.may_hold(digest) else False
        self.content.setdefault(bucket, {})[digest] = value
        if not known:
            self.live += 1
            if self.live > 0.9 * SLOTS * self.buckets or not self._place(digest):
                self._resize()

    def restore(self, digest: str, value: tuple) -> None:
        """A stored digest whose fingerprint the given table already has."""
        self.content.setdefault(self._places(digest)[1], {})[digest] = value
        self.live += 1

    def delete(self, digest: str) -> bool:
        """Remove a live digest; any other is left alone, as its fingerprint is not its own."""
        if self.get(digest) is None:
            return False
        mark, a, b = self._places(digest)
        for bucket in (a, b):
            slots = np.flatnonzero(self.table[bucket] == mark)
            if len(slots):
                self.table[bucket, slots[0]] = 0
                break
        del self.content[a][digest]
        self.live -= 1
        return True

    def items(self) -> Iterator[tuple[str, tuple]]:
        for held in self.content.values():
            yield from held.items()

    def _place(self, digest: str) -> bool:
        mark, a, b = self._places(digest)
        for bucket in (a, b):
            slots = np.flatnonzero(self.table[bucket] == 0)
            if len(slots):
                self.table[bucket, slots[0]] = mark
                return True
        bucket = a
        for n in range(KICKS):
            slot = (n * 7 + bucket) % SLOTS
            mark, self.table[bucket, slot] = int(self.table[bucket, slot]), mark
            bucket = self._other(bucket, mark)
            slots = np.flatnonzero(self.table[bucket] == 0)
            if len(slots):
                self.table[bucket, slots[0]] = mark
                return True
        return False

    def _resize(self) -> None:
        """Twice the buckets, filled again from the stored keys, until all find a place."""
        stored = dict(self.items())
        while True:
            self.buckets *= 2
            self.table = np.zeros((self.buckets, SLOTS), np.uint16)
            self.content = {}
            for digest, value in stored.items():
                self.content.setdefault(self._places(digest)[1], {})[digest] = value
            if all(self._place(digest) for digest in stored):
                return


# what happens to a shard, in this order
FILTER, STORED, DELETED, ADDED = range(4)
ENTRY = (
    "shard int, step int, digest string, length long, has_id boolean, anti_id long, "
    "anti_row long, members long, filter binary"
)


def _run_shards(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows come sorted by shard and step; every shard goes out whole."""
    names = [c.split()[0] for c in ENTRY.split(", ")]
    shard, current = None, None

    def out() -> pd.DataFrame:
        rows = [(current, STORED, d, *v, None) for d, v in shard.items()]
        rows.append((current, FILTER, None, None, None, None, None, None, shard.table.tobytes()))
        frame = pd.DataFrame(rows, columns=names)
        for c in ("length", "anti_id", "anti_row", "members"):
            frame[c] = frame[c].astype("Int64")
        return frame

    for batch in batches:
        columns = [batch[c].tolist() for c in names]
        for key, step, digest, length, has_id, anti_id, anti_row, members, table in zip(*columns):
            if key != current:
                if shard is not None:
                    yield out()
                shard, current = CuckooShard(), key
            if step == FILTER:
                shard.table = np.frombuffer(table, np.uint16).reshape(-1, SLOTS).copy()
                shard.buckets = len(shard.table)
            elif step == DELETED:
                shard.delete(digest)
            else:
                value = (int(length), bool(has_id), int(anti_id), int(anti_row), int(members))
                if step == STORED:
                    shard.restore(digest, value)
                    continue
                known = shard.get(digest)
                if known is not None:
                    value = (*max(known[:4], value[:4]), known[4] + value[4])
                shard.put(digest, value)
    if shard is not None:
        yield out()


def digests(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: doc_id, digest of the text without white space, length in code points.

    A null text counts as an empty one.
    """
    whole = text_of(text)
    return docs.select(
        quoted(doc_id).cast("long").alias("doc_id"),
        F.sha2(squeezed(whole), 256).alias("digest"),
        F.length(whole).cast("long").alias("length"),
    )


@dataclass(frozen=True)
class CuckooIndex:
    """The live digests, one row each, and one filter row per shard.

    ``entries()`` has per digest the row that stays: the longest text, then the
    smallest doc_id (null last), then the first row.
    """

    table: DataFrame
    shards: int

    @staticmethod
    def build(rows: DataFrame, count: int) -> "CuckooIndex":
        """An index over ``rows`` (doc_id, digest, length, row), ``count`` of them."""
        shards = max(partitions_for(rows), math.ceil(count / DIGESTS_PER_SHARD))
        return CuckooIndex(None, shards).insert(rows)

    def _shard(self) -> Column:
        return F.pmod(F.xxhash64("digest"), F.lit(self.shards)).cast("int")

    def _run(self, changes: DataFrame) -> "CuckooIndex":
        steps = changes if self.table is None else self.table.unionByName(changes)
        table = (
            steps.repartition(self.shards, "shard").sortWithinPartitions("shard", "step")
            .mapInPandas(_run_shards, ENTRY)
        )
        return CuckooIndex(stage(table), self.shards)

    def insert(self, rows: DataFrame) -> "CuckooIndex":
        """With the rows added; copies of live digests are merged into their entries."""
        salt = F.pmod(F.xxhash64("row"), F.lit(SALTS))
        # complements turn "smallest" into "largest" without overflow
        best = F.max(F.struct(
            F.col("length"),
            F.col("doc_id").isNotNull().alias("has_id"),
            F.bitwise_not(F.coalesce("doc_id", F.lit(0))).alias("anti_id"),
            F.bitwise_not("row").alias("anti_row"),
        ))
        merged = rows.groupBy("digest", salt.alias("salt")).agg(
            best.alias("best"), F.count(F.lit(1)).alias("members")
        )
        return self._run(merged.select(
            self._shard().alias("shard"), F.lit(ADDED).alias("step"), "digest", "best.*",
            "members", F.lit(None).cast("binary").alias("filter"),
        ))

    def delete(self, gone: DataFrame) -> "CuckooIndex":
        """Without the digests of ``gone`` (digest); those not live are ignored."""
        nothing = F.lit(None)
        return self._run(gone.select("digest").distinct().select(
            self._shard().alias("shard"), F.lit(DELETED).alias("step"), "digest",
            nothing.cast("long").alias("length"), nothing.cast("boolean").alias("has_id"),
            nothing.cast("long").alias("anti_id"), nothing.cast("long").alias("anti_row"),
            nothing.cast("long").alias("members"), nothing.cast("binary").alias("filter"),
        ))

    def entries(self) -> DataFrame:
        """digest, keep_length, keep_id, keep_row, group_size."""
        return self.table.filter(F.col("step") == STORED).select(
            "digest",
            F.col("length").alias("keep_length"),
            F.when(F.col("has_id"), F.bitwise_not("anti_id")).alias("keep_id"),
            F.bitwise_not("anti_row").alias("keep_row"),
            F.col("members").alias("group_size"),
        )


def numbered_digests(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``digests`` written once, with a number per row that later reads agree on."""
    return stage(digests(docs, doc_id, text).withColumn("row", F.monotonically_increasing_id()))


def groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, digest, keep_id, group_size, kept.

    Exactly one row of a group is kept, also where rows repeat with their doc_id.
    Documents without a text form one group; an empty table gives no rows.
    """
    rows = numbered_digests(docs, doc_id, text)
    entries = CuckooIndex.build(rows, rows.count()).entries()
    return rows.join(entries, "digest").select(
        "doc_id", "digest", "keep_id", "group_size",
        (F.col("row") == F.col("keep_row")).alias("kept"),
    )


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The document that stays of every group, with its own columns.

    Of repeated rows (same doc_id, same text) one stays, whichever comes first.
    """
    rows = numbered_digests(docs, doc_id, text)
    entries = CuckooIndex.build(rows, rows.count()).entries()
    repeated = rows.groupBy("digest", "length", "doc_id").count().filter("count > 1")
    names = {n: fresh(docs, n) for n in ("digest_", "length_", "keep_length_", "keep_id_", "again_")}
    whole = text_of(text)
    keyed = docs.withColumns({
        names["digest_"]: F.sha2(squeezed(whole), 256), names["length_"]: F.length(whole).cast("long"),
    })
    keepers = entries.select(
        F.col("digest").alias(names["digest_"]), F.col("keep_length").alias(names["keep_length_"]),
        F.col("keep_id").alias(names["keep_id_"]),
    )
    again = repeated.select(
        F.col("digest").alias(names["digest_"]), F.lit(True).alias(names["again_"])
    ).distinct()
    kept = (
        keyed.join(keepers, names["digest_"])
        .filter((quoted(names["length_"]) == quoted(names["keep_length_"]))
                & quoted(doc_id).cast("long").eqNullSafe(quoted(names["keep_id_"])))
    )
    if not repeated.isEmpty():
        marked = kept.join(again, names["digest_"], "left")
        sole = marked.filter(quoted(names["again_"]).isNull())
        one = marked.filter(quoted(names["again_"])).dropDuplicates([names["digest_"]])
        kept = sole.unionByName(one)
    return kept.select(*[quoted(c) for c in docs.columns])
