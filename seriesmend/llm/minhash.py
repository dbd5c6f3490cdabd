"""Near-duplicate documents by b-bit MinHash, confirmed on whole shingle sets.

1. One pass over the texts makes a sketch per document: the number of distinct
   shingles, a digest of the set, 32 band keys of four minima each, and the low four
   bits of all 128 minima packed into eight longs.
2. Documents with equal sets are one class; only classes go on.
3. In every band bucket, each class is paired with the bucket's leader, which is
   another one in every bucket.  Pairs pass if the sizes allow the similarity and if
   the bit count of the packed signatures, corrected for chance agreement, doesn't
   rule it out (six standard deviations).
4. What passes is confirmed on the sets: first each class with its likeliest leader,
   then the likeliest pair of every two components.  A large group of near copies
   costs about one pair per member.
5. In buckets that still hold several components, the members outside the largest
   one are compared with all members of that component, and with each other, in
   blocks of bounded size that hold the sets themselves: no pairs are written, only
   confirmed links, and one at most per member, component and block.

Two sets of similarity 0.75 share no band with probability (1 - 0.75^4)^32 < 6e-6.
Shingles are compared by 64-bit hashes.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from seriesmend.llm.common import fresh, quoted, text_of
from seriesmend.llm.components import between, components, joined
from seriesmend.plans.staging import stage

WORDS, BANDS, PER_BAND, BITS = 5, 32, 4, 4
HASHES = BANDS * PER_BAND
SIMILAR = (75, 100)      # intersection * 100 >= union * 75
SLACK = 6.0              # standard deviations below the bound
BLOCK_ROWS = 500         # members of either side compared at a time, at most ...
BLOCK_SHINGLES = 1 << 19 # ... and about so many shingles of theirs
PIECE = 1 << 20          # bytes of a text hashed at a time

_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_SEEDS = np.random.Generator(np.random.PCG64(20240531))
_TIMES = _SEEDS.integers(0, 1 << 63, HASHES, np.uint64) * np.uint64(2) + np.uint64(1)
_PLUS = _SEEDS.integers(0, 1 << 63, HASHES, np.uint64)
_MIX = _SEEDS.integers(0, 1 << 63, max(WORDS, PER_BAND), np.uint64) * np.uint64(2) + np.uint64(1)
_BAND = _SEEDS.integers(0, 1 << 63, BANDS, np.uint64)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class WordHasher:
    """64-bit hashes of the words of a text, lower-cased in A-Z, a piece at a time.

    A word's hash is a difference of prefix sums of byte * base^place, moved to place
    0 by the inverse power, so that no word is looked at on its own.
    """

    def __init__(self):
        self.powers = self.inverse = np.ones(0, np.uint64)

    def _tables(self, n: int) -> None:
        if n > len(self.powers):
            size = max(n, 1 << 16)
            for name, base in (("powers", _BASE), ("inverse", _INVERSE)):
                table = np.full(size, base, np.uint64)
                table[0] = 1
                setattr(self, name, np.cumprod(table, dtype=np.uint64))

    def words(self, text: bytes) -> np.ndarray:
        text = text.lower()   # of bytes: A-Z only
        parts, start = [], 0
        while start < len(text):
            end = min(start + PIECE, len(text))
            while end < len(text) and not _SPACE[text[end]]:
                end += 1
            parts.append(self._piece(np.frombuffer(text, np.uint8, end - start, start)))
            start = end
        return np.concatenate(parts) if parts else np.zeros(0, np.uint64)

    def _piece(self, data: np.ndarray) -> np.ndarray:
        word = np.zeros(len(data) + 2, np.int8)
        word[1:-1] = ~_SPACE[data]
        edge = np.diff(word)
        starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        self._tables(len(data) + 1)
        sums = np.zeros(len(data) + 1, np.uint64)
        # bytes count from 1, so that leading zero bytes tell words apart
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * self.powers[: len(data)], out=sums[1:])
        return mixed((sums[ends] - sums[starts]) * self.inverse[starts])

    def shingles(self, text: bytes) -> np.ndarray:
        """The distinct shingles, sorted: of five words, or of all if there are fewer."""
        words = self.words(text)
        if not len(words):
            return words
        k = min(WORDS, len(words))
        total = np.zeros(len(words) - k + 1, np.uint64)
        for j in range(k):
            total += words[j: j + len(total)] * _MIX[j]
        return np.unique(mixed(total + np.uint64(k)))


def minima(shingles: np.ndarray) -> np.ndarray:
    least = np.full(HASHES, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(shingles), 256):
        some = shingles[at: at + 256, None] * _TIMES
        some += _PLUS
        np.minimum(least, some.min(axis=0), out=least)
    return least


def packed(least: np.ndarray) -> np.ndarray:
    """The low bits of the minima, sixteen to a long."""
    per_long = 64 // BITS
    low = (least & np.uint64((1 << BITS) - 1)).reshape(-1, per_long)
    return np.bitwise_or.reduce(low << (np.uint64(BITS) * np.arange(per_long, dtype=np.uint64)), axis=1)


def band_keys(least: np.ndarray) -> np.ndarray:
    return mixed((least.reshape(BANDS, PER_BAND) * _MIX[:PER_BAND]).sum(axis=1, dtype=np.uint64) + _BAND)


SKETCH = "doc_id long, text_hash long, n long, cls binary, sig array<long>, bands array<long>"
SETS = "cls binary, shingles binary"


def _sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hasher = WordHasher()
    for batch in batches:
        sizes, classes, sigs, bands = [], [], [], []
        for text in batch.column("text"):
            shingles = hasher.shingles(text.as_py().encode())
            sizes.append(len(shingles))
            if not len(shingles):
                classes.append(None), sigs.append(None), bands.append(None)
                continue
            classes.append(hashlib.blake2b(shingles, digest_size=16).digest())
            least = minima(shingles)
            sigs.append(packed(least).view(np.int64))
            bands.append(band_keys(least).view(np.int64))
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("text_hash"), pa.array(sizes, pa.int64()),
             pa.array(classes, pa.binary()), pa.array(sigs, pa.list_(pa.int64())),
             pa.array(bands, pa.list_(pa.int64()))],
            names=["doc_id", "text_hash", "n", "cls", "sig", "bands"],
        )


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hasher = WordHasher()
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            sets = [hasher.shingles(t.as_py().encode()) for t in batch.column("text")[at: at + 256]]
            yield pa.RecordBatch.from_arrays(
                [pa.array([hashlib.blake2b(s, digest_size=16).digest() for s in sets], pa.binary()),
                 pa.array([s.tobytes() for s in sets], pa.binary())],
                names=["cls", "shingles"],
            )


def _similar(x: np.ndarray, y: np.ndarray) -> bool:
    part, whole = SIMILAR
    common = len(np.intersect1d(x, y, assume_unique=True))
    return whole * common >= part * (len(x) + len(y) - common)


def _overlaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b) of the pairs whose sets are similar."""
    for batch in batches:
        linked = []
        for left, right in zip(batch.column("set_a"), batch.column("set_b")):
            x, y = np.frombuffer(left.as_py(), np.uint64), np.frombuffer(right.as_py(), np.uint64)
            linked.append(_similar(x, y))
        yield batch.select(["a", "b"]).filter(pa.array(linked, pa.bool_()))


def text_hash(text: Column) -> Column:
    return F.xxhash64(text)


def sketches(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One sketch per row, written once.  Without words: n = 0 and the rest null."""
    whole = text_of(text)
    rows = docs.select(
        quoted(doc_id).cast("long").alias("doc_id"), text_hash(whole).alias("text_hash"), whole.alias("text")
    )
    return stage(rows.mapInArrow(_sketches, SKETCH))


def _most_differing() -> int:
    """Minima in which similar sets can differ, chance agreement counted in."""
    bound, chance = SIMILAR[0] / SIMILAR[1], 2.0 ** -BITS
    agree = bound + (1 - bound) * chance
    fewest = agree - SLACK * math.sqrt(agree * (1 - agree) / HASHES)
    return math.floor(HASHES * (1 - fewest))


def _differing(sig_a: Column, sig_b: Column) -> Column:
    """In how many of the packed minima two signatures differ."""
    total = F.lit(0)
    for i in range(HASHES * BITS // 64):
        x = sig_a[i].bitwiseXOR(sig_b[i])
        x = x.bitwiseOR(F.shiftrightunsigned(x, 1))
        x = x.bitwiseOR(F.shiftrightunsigned(x, 2))
        total = total + F.bit_count(x.bitwiseAND(F.lit(0x1111111111111111)))
    return total


def _sizes_allow(n_a: Column, n_b: Column) -> Column:
    return SIMILAR[1] * F.least(n_a, n_b) >= SIMILAR[0] * F.greatest(n_a, n_b)


@dataclass(frozen=True)
class Classes:
    """Documents with equal sets: cls, n, sig, bands, and the row that stands for them."""

    table: DataFrame
    docs: DataFrame

    def sets_of(self, members: DataFrame) -> DataFrame:
        """The sets of the classes in ``members`` (cls).

        The texts meet the wanted rows by row key, so that only those are parsed.
        """
        wanted = self.table.join(members.select("cls").distinct(), "cls").select(
            F.col("rep.doc_id").alias("doc_id"), F.col("rep.text_hash").alias("text_hash")
        )
        key = [F.coalesce("doc_id", F.lit(0)).alias("id_"), F.col("doc_id").isNull().alias("no_id"), "text_hash"]
        found = self.docs.select(*key, "text").join(wanted.select(*key).distinct(), ["id_", "no_id", "text_hash"], "left_semi")
        sets = found.select("text").mapInArrow(_sets, SETS)
        # repeated rows give their set twice
        return sets.groupBy("cls").agg(F.first("shingles").alias("shingles"))


def _links_in_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by block: minor members against the other members of the block.

    A block has at most about ``BLOCK_ROWS`` of either and ``BLOCK_SHINGLES`` of theirs (or
    a larger set alone), whatever the size of its bucket or component.
    """
    part, whole = SIMILAR
    most = _most_differing()

    def links(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        minor, major = [r for r in rows if r[1]], [r for r in rows if not r[1]]
        if not minor or not major:
            return
        sig_a, sig_b = (np.array([r[4] for r in side], np.int64).view(np.uint64) for side in (minor, major))
        sets = [np.frombuffer(r[5], np.uint64) for r in major]
        n_b = np.array([len(x) for x in sets], np.float64)
        found = []
        for row, sig in zip(minor, sig_a):
            own = np.frombuffer(row[5], np.uint64)
            x = sig_b ^ sig
            x |= x >> np.uint64(1)
            x |= x >> np.uint64(2)
            differing = np.bitwise_count(x & np.uint64(0x1111111111111111)).sum(axis=1)
            fit = (differing <= most) & (whole * np.minimum(n_b, len(own)) >= part * np.maximum(n_b, len(own)))
            done = {row[3]}   # one link with a component is enough
            for j in np.flatnonzero(fit)[np.argsort(differing[fit], kind="stable")].tolist():
                other = major[j]
                if other[3] not in done and _similar(own, sets[j]):
                    done.add(other[3])
                    found.append((row[2], other[2]))
        if found:
            yield pa.RecordBatch.from_arrays(
                [pa.array([f[i] for f in found], pa.binary()) for i in (0, 1)], names=["x", "y"])

    block, rows = None, []
    for batch in batches:
        for at in range(0, batch.num_rows, 100):   # few sets are held twice
            some = batch.slice(at, 100)
            for row in zip(*[some.column(c).to_pylist() for c in ("block", "minor", "cls", "component", "sig", "shingles")]):
                if row[0] != block:
                    yield from links(rows)
                    block, rows = row[0], []
                rows.append(row)
    yield from links(rows)


def _dealt(members: DataFrame, minors: DataFrame, group: str) -> DataFrame:
    """Blocks (block, minor, cls, component) of the two sides of each ``group``, from rows
    with ``n``, the size of their set.

    Every member goes to one block for each block of minors, and the other way round.
    """
    def blocks_of(side: DataFrame, name: str) -> DataFrame:
        needed = F.greatest(F.count(F.lit(1)) / BLOCK_ROWS, F.sum("n") / BLOCK_SHINGLES)
        return side.groupBy(group).agg(F.ceil(needed).cast("int").alias(name))

    shape = blocks_of(members, "of_members").join(blocks_of(minors, "of_minors"), group)
    place = F.xxhash64("cls", F.lit(7))
    rows = lambda side: side.join(shape, group)
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = rows(members).select(group, F.lit(False).alias("minor"), "cls", "component",
                                F.pmod(place, "of_members").cast("int").alias("i"), every("of_minors").alias("j"))
    right = rows(minors).select(group, F.lit(True).alias("minor"), "cls", "component",
                                every("of_members").alias("i"), F.pmod(place, "of_minors").cast("int").alias("j"))
    return left.unionAll(right).select(
        F.xxhash64(F.col(group), "i", "j").alias("block"), "minor", "cls", "component")


def _open_links(buckets: DataFrame, sets: DataFrame, found: DataFrame) -> DataFrame:
    """Confirmed links (a, b) between different components that share a bucket.

    ``buckets`` (key, cls, and n if it is known), ``sets`` (cls, sig, shingles), ``found``
    (node, component).
    """
    if "n" not in buckets.columns:
        buckets = buckets.join(sets.select("cls", (F.octet_length("shingles") / 8).alias("n")), "cls")
    labelled = stage(buckets.join(found.withColumnRenamed("node", "cls"), "cls", "left").withColumn(
        "component", F.coalesce("component", "cls")))
    per = labelled.groupBy("key", "component").agg(F.count(F.lit(1)).alias("rows"))
    shape = per.groupBy("key").agg(
        F.max(F.struct("rows", "component")).alias("top"), F.count(F.lit(1)).alias("parts")
    ).filter("parts > 1").select("key", F.col("top.component").alias("largest"), "parts")
    minors = stage(labelled.join(shape, "key").filter("component <> largest"))
    # with the largest component of the bucket, as a whole
    asks = minors.select("cls", "component", "largest", "n").distinct()
    members = labelled.select("cls", "component", "n").distinct().join(
        asks.select(F.col("largest").alias("component")).distinct(), "component").withColumn("largest", F.col("component"))
    with_largest = _dealt(members, asks, "largest")
    # and with each other; a bucket of two components has no others
    others = minors.filter("parts > 2").select("key", "cls", "component", "n")
    blocks = with_largest.unionAll(_dealt(others, others, "key"))
    links = (
        blocks.join(sets, "cls").repartition("block").sortWithinPartitions("block")
        .mapInArrow(_links_in_blocks, "x binary, y binary")
    )
    return links.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def _confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    left = sets.select(F.col("cls").alias("a"), F.col("shingles").alias("set_a"))
    right = sets.select(F.col("cls").alias("b"), F.col("shingles").alias("set_b"))
    return pairs.select("a", "b").join(left, "a").join(right, "b").select("a", "b", "set_a", "set_b").mapInArrow(
        _overlaps, "a binary, b binary")


def _star_components(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(node, component) by confirmed links among ``pairs`` (a, b, differing): the
    likeliest pair of each class, then of every two components.  What these leave apart
    is for the blocks."""
    def best(some: DataFrame, *by) -> DataFrame:
        return some.groupBy(*by).agg(F.min(F.struct("differing", "a", "b")).alias("p")).select("p.a", "p.b")

    found = components(_confirmed(best(pairs, "b"), sets))
    across = between(found, pairs)
    return joined(found, _confirmed(best(across, F.least("of_a", "of_b"), F.greatest("of_a", "of_b")), sets))


def near_components(classes: Classes) -> DataFrame:
    """(node, component) of the classes that confirmed links connect with others."""
    table = classes.table
    members = table.select("cls", "sig", "n")
    banded = table.select("cls", "n", F.explode("bands").alias("key"))
    leaders = banded.groupBy("key").agg(
        F.min_by("cls", F.xxhash64("cls", "key")).alias("leader"), F.count(F.lit(1)).alias("rows")).filter("rows > 1")
    buckets = stage(banded.join(leaders.select("key", "leader"), "key"))
    sets = stage(classes.sets_of(buckets.select("cls")).join(members.select("cls", "sig"), "cls"))
    star = buckets.filter("cls <> leader").select(
        F.least("leader", "cls").alias("a"), F.greatest("leader", "cls").alias("b")).distinct()
    pairs = stage(
        star.join(members.toDF("a", "sig_a", "n_a"), "a").join(members.toDF("b", "sig_b", "n_b"), "b")
        .filter(_sizes_allow(F.col("n_a"), F.col("n_b")))
        .select("a", "b", _differing(F.col("sig_a"), F.col("sig_b")).alias("differing"))
        .filter(F.col("differing") <= _most_differing())
    )
    found = _star_components(pairs, sets)
    return joined(found, _open_links(buckets.select("key", "cls", "n"), sets, found))


def near_groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """The sketches, and (cls, component_id, sole_text) of every class.

    ``component_id`` is the smallest doc_id reachable over links.  ``sole_text`` is
    the text_hash that stands for a component without any doc_id, else null.
    """
    sketched = sketches(docs, doc_id, text)
    table = stage(
        sketched.filter("cls IS NOT NULL").groupBy("cls").agg(
            F.first("n").alias("n"), F.first("sig").alias("sig"), F.first("bands").alias("bands"),
            F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash")).alias("rep"),
        )
    )
    whole = text_of(text)
    rows = docs.select(
        quoted(doc_id).cast("long").alias("doc_id"), text_hash(whole).alias("text_hash"), whole.alias("text"))
    found = near_components(Classes(table, rows))
    labelled = table.select("cls", F.col("rep.doc_id").alias("doc_id"), F.col("rep.text_hash").alias("text_hash")).join(
        found.withColumnRenamed("node", "cls"), "cls", "left"
    ).withColumn("component", F.coalesce("component", "cls"))
    least = labelled.groupBy("component").agg(F.min("doc_id").alias("component_id"), F.min("text_hash").alias("least_text"))
    sole = F.when(F.col("component_id").isNull(), F.col("least_text")).alias("sole_text")
    return sketched, labelled.join(least, "component").select("cls", "component_id", sole)


def label(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept.

    A document without words is linked with nothing.  Rows that repeat a doc_id are
    labelled alike; a null doc_id never names a component, and is kept only where
    its component has no other.
    """
    return _labelled(*near_groups(docs, doc_id, text)).drop("text_hash", "sole_text")


def _labelled(sketched: DataFrame, groups: DataFrame) -> DataFrame:
    joined = sketched.select("doc_id", "text_hash", "n", "cls").join(groups, "cls", "left")
    component = F.when(F.col("cls").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return joined.select(
        "doc_id", "text_hash", F.col("n").alias("n_shingles"), component.alias("component_id"),
        F.col("doc_id").eqNullSafe(component).alias("kept"), "sole_text",
    )


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The kept documents, with their own columns.

    Of a group whose doc_ids are all null, one row stays.
    """
    # a null doc_id names no row: the text tells it from others
    key, of, sole = fresh(docs, "kept_id"), fresh(docs, "kept_text"), fresh(docs, "sole_text")
    sketched, groups = near_groups(docs, doc_id, text)
    kept = _labelled(sketched, groups).filter("kept AND (sole_text IS NULL OR sole_text = text_hash)")
    named = kept.select(F.col("doc_id").alias(key), F.col("text_hash").alias(of), F.col("sole_text").alias(sole)).distinct()
    same = quoted(doc_id).cast("long").eqNullSafe(quoted(key)) & (text_hash(text_of(text)) == quoted(of))
    if groups.filter("sole_text IS NOT NULL").isEmpty():
        return docs.join(named, same, "left_semi")
    others = docs.join(named.filter(quoted(sole).isNull()), same, "left_semi")
    ones = docs.filter(quoted(doc_id).cast("long").isNull()).join(named.filter(quoted(sole).isNotNull()), same)
    # copies of the text that stays
    return others.unionAll(ones.dropDuplicates([of]).select(*[quoted(c) for c in docs.columns]))
