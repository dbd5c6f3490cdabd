"""Remove every byte that a 200-byte string found elsewhere covers, by suffix sorting.

Suffixes are sorted only where a repeat can be.  Every window of 200 bytes has an
anchor, the 32-byte string of least hash in it (the leftmost of equals); equal
windows have equal anchors at equal offsets.  The windows of one anchor place lie
side by side, and the bytes they cover are its context.

* Anchors that occur once in the corpus settle their windows: they are unique.
* Equal contexts settle theirs: all windows in them repeat.
* Other contexts of an anchor are compared by sorting the suffixes that start at the
  anchor, and the reversed prefixes that end at it, deep-shallow: multikey quicksort
  on eight-byte characters to a shallow depth, then a blind trie for each group that
  is still equal there.  The sort gives the longest common extension of neighbours,
  so at any depth the contexts fall into classes; two windows are equal if their
  contexts are in one class to the right and in one class to the left.
* An anchor with very many different contexts (a frequent line) is spread out: its
  windows are counted one by one instead of being sorted in one task.

Texts are known by their digest, so copies of a text are one; no occurrence list of
the corpus, and no text, is ever gathered.  Strings are told apart by 64-bit hashes
until they are sorted by their bytes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from seriesmend.llm.common import quoted, text_of
from seriesmend.llm.minhash import mixed
from seriesmend.plans.staging import stage

LENGTH, ANCHOR = 200, 32
SPREAD = LENGTH - ANCHOR + 1          # anchor places in a window
SHALLOW = 32                          # bytes sorted before blind tries take over
PIECE = 1 << 20                       # window starts of a text looked at together
MOST_SORTED = 100_000                 # contexts of an anchor that one task sorts (some 400 bytes each)
BATCH = 20_000                        # contexts sorted at a time

_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


class Windows:
    """Anchors and contexts of a text's windows."""

    def __init__(self):
        self.powers = self.inverse = np.ones(0, np.uint64)

    def _prefix_sums(self, data: np.ndarray) -> np.ndarray:
        n = len(data) + 1
        if n > len(self.powers):
            for name, base in (("powers", _BASE), ("inverse", _INVERSE)):
                table = np.full(max(n, 1 << 15), base, np.uint64)
                table[0] = 1
                setattr(self, name, np.cumprod(table, dtype=np.uint64))
        sums = np.zeros(n, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * self.powers[: n - 1], out=sums[1:])
        return sums

    def anchors(self, text: bytes, piece: int) -> Iterator[tuple[np.ndarray, ...]]:
        """(hash, context hash, anchor place, first and last window start), piece by piece.

        An anchor whose windows lie on both sides of a piece's end comes in both pieces,
        with the windows of each.
        """
        whole = np.frombuffer(text, np.uint8)
        for start in range(0, len(whole) - LENGTH + 1, piece):
            data = whole[start: start + piece + LENGTH - 1]
            sums, inverse = self._prefix_sums(data), self.inverse
            n = len(data) - ANCHOR + 1
            hashes = mixed((sums[ANCHOR:] - sums[:n]) * inverse[:n])
            # the place in the low bits makes the leftmost of equals the least
            low = np.uint64(21)
            least = (hashes >> low << low) | np.arange(n, dtype=np.uint64)
            width = 1
            while 2 * width <= SPREAD:
                least = np.minimum(least[:-width], least[width:])
                width *= 2
            least = np.minimum(least[: n - SPREAD + 1], least[SPREAD - width:][: n - SPREAD + 1])
            place = (least & np.uint64((1 << 21) - 1)).astype(np.int64)
            first = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
            last = np.append(first[1:] - 1, len(place) - 1)
            at = place[first]
            inside = mixed((sums[last + LENGTH] - sums[first]) * inverse[first])
            shape = ((at - first) * LENGTH + (last - first)).astype(np.uint64)
            yield (hashes[at].view(np.int64), mixed(inside + shape * np.uint64(_BASE)).view(np.int64),
                   at + start, first + start, last + start)

    def windows(self, text: bytes) -> np.ndarray:
        """Hashes of all windows (two columns), for few starts at a time."""
        data = np.frombuffer(text, np.uint8)
        sums, n = self._prefix_sums(data), len(data) - LENGTH + 1
        one = mixed((sums[LENGTH:] - sums[:n]) * self.inverse[:n])
        other = self._prefix_sums(data ^ np.uint8(0x55))
        return np.stack([one, mixed((other[LENGTH:] - other[:n]) * self.inverse[:n] + np.uint64(1))], axis=1).view(np.int64)


def common(a: bytes, b: bytes, known: int = 0) -> int:
    """Length of the longest common prefix, which is at least ``known``."""
    low, high = known, min(len(a), len(b))
    if a[low:high] == b[low:high]:
        return high
    while low < high:
        middle = (low + high + 1) // 2
        if a[low:middle] == b[low:middle]:
            low = middle
        else:
            high = middle - 1
    return low


def blind_trie(strings: list[bytes], depth: int) -> tuple[list[int], list[int]]:
    """Order of strings that agree on their first ``depth`` bytes, and common prefix
    lengths with the one before (the first: ``depth``).

    A node keeps only the depth at which its strings part and the byte each branch
    goes on with.  A string is first led down blindly to some leaf; comparing with
    that leaf tells where it belongs.
    """
    root: list = [0]   # a leaf is a list of equal strings' numbers
    leaf, node = 0, 1
    tree = (leaf, root)
    for number in range(1, len(strings)):
        s = strings[number]
        kind, at = tree
        while kind == node:
            branches = at[1]
            byte = s[at[0]] if at[0] < len(s) else -1
            kind, at = branches[byte] if byte in branches else next(iter(branches.values()))
        other = strings[at[0]]
        shared = common(s, other, depth)
        if shared == len(s) == len(other):
            at.append(number)
            continue
        parent, byte = None, None
        kind, at = tree
        while kind == node and at[0] < shared:
            parent, byte = at, (s[at[0]] if at[0] < len(s) else -1)
            kind, at = at[1][byte]
        own = s[shared] if shared < len(s) else -1
        if kind == node and at[0] == shared:
            at[1][own] = (leaf, [number])
            continue
        split = (node, (shared, {(other[shared] if shared < len(other) else -1): (kind, at), own: (leaf, [number])}))
        if parent is None:
            tree = split
        else:
            parent[1][byte] = split
    order, shares = [], []
    stack = [(tree, depth)]
    while stack:
        (kind, at), with_last = stack.pop()
        if kind == leaf:
            order += at
            shares += [with_last, *[len(strings[at[0]])] * (len(at) - 1)]
        else:
            for i, byte in enumerate(sorted(at[1], reverse=True)):
                stack.append((at[1][byte], with_last if i == len(at[1]) - 1 else at[0]))
    return order, shares


def deep_shallow(groups: np.ndarray, strings: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Order by (group, string), and common prefix lengths with the one before.

    -1 where a group begins.  ``groups`` are sorted numbers.
    """
    n = len(strings)
    padded = b"".join(s[:SHALLOW].ljust(SHALLOW, b"\0") for s in strings)
    chars = np.frombuffer(padded, ">u8").reshape(n, SHALLOW // 8)
    lengths = np.array([len(s) for s in strings])
    order, part = np.arange(n), groups.copy()
    shares = np.where(np.concatenate([[True], groups[1:] != groups[:-1]]), -1, SHALLOW)
    for depth in range(SHALLOW // 8):
        # quicksort's equal parts are sorted by the next character, all at once
        own = chars[order, depth]
        size = np.minimum(lengths[order], 8 * depth + 8)   # zero bytes are not the end
        moved = np.lexsort((size, own, part))
        order, own, size = order[moved], own[moved], size[moved]
        parted = np.concatenate([[True], (own[1:] != own[:-1]) | (size[1:] != size[:-1])])
        inner = np.concatenate([[False], part[1:] == part[:-1]])   # parts keep their places
        new = inner & parted
        if new.any():
            at = np.flatnonzero(new)
            differing = own[at] ^ own[at - 1]
            zeros = np.full(len(at), 8)
            for k in range(7, -1, -1):
                zeros[(differing >> np.uint64(8 * (7 - k)) & np.uint64(255)) != 0] = k
            shares[at] = np.minimum(8 * depth + zeros, np.minimum(lengths[order[at]], lengths[order[at - 1]]))
        part = np.cumsum(parted | ~inner)
    ends = np.append(np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]])), n)
    for a, b in zip(ends[:-1].tolist(), ends[1:].tolist()):
        if b - a > 1:
            own = order[a:b].tolist()
            least = min(SHALLOW, *(len(strings[i]) for i in own))
            inner, found = blind_trie([strings[i] for i in own], least)
            order[a:b] = [own[i] for i in inner]
            shares[a + 1: b] = found[1:]
    return order, shares


def repeated_windows(groups: np.ndarray, left: list[bytes], right: list[bytes],
                     nearest: np.ndarray, farthest: np.ndarray) -> np.ndarray:
    """For each context and each distance from window start to anchor (0 .. SPREAD - 1):
    whether another context of its group has the same window.

    ``left`` are the bytes before the anchor, last first; ``right`` those from the
    anchor on; a context has the distances from ``nearest`` to ``farthest``.
    """
    n = len(left)
    sides = []
    for strings in (left, right):
        order, shares = deep_shallow(groups, strings)
        place = np.empty(n, np.int64)
        place[order] = np.arange(n)
        sides.append((place, shares))
    (left_place, left_shares), (right_place, right_shares) = sides
    found = np.zeros((SPREAD, n), bool)
    for distance in range(SPREAD):
        has = np.flatnonzero((nearest <= distance) & (distance <= farthest))
        if len(has) < 2:
            continue
        before = np.cumsum(left_shares < distance)[left_place[has]]
        after = np.cumsum(right_shares < LENGTH - distance)[right_place[has]]
        pair = before * (n + 1) + after   # classes are numbered across groups
        order = np.argsort(pair, kind="stable")
        same = pair[order][1:] == pair[order][:-1]
        twice = np.concatenate([[False], same]) | np.concatenate([same, [False]])
        found[distance, has[order[twice]]] = True
    return found


ANCHORS = "hash long, context long, key binary, place int, first int, last int"
CONTEXTS = "hash long, key binary, place int, first int, last int, before binary, after binary"
SPANS = "key binary, start int, stop int"
WINDOWS = "one long, two long, key binary, start int, n long"


def _anchors(batches: Iterator[pa.RecordBatch], piece: int) -> Iterator[pa.RecordBatch]:
    windows = Windows()
    for batch in batches:
        parts, keys, counts = [], [], []
        for key, text in zip(batch.column("key"), batch.column("text")):
            for found in windows.anchors(text.as_py().encode(), piece):
                parts.append(found)
                keys.append(key.as_py())
                counts.append(len(found[0]))
            if sum(counts) > 100_000:
                yield _anchor_rows(parts, keys, counts)
                parts, keys, counts = [], [], []
        if parts:
            yield _anchor_rows(parts, keys, counts)


def _anchor_rows(parts, keys, counts) -> pa.RecordBatch:
    columns = [np.concatenate(c) for c in zip(*parts)]
    key = pa.array(keys, pa.binary()).take(pa.array(np.repeat(np.arange(len(keys)), counts)))
    return pa.RecordBatch.from_arrays(
        [pa.array(columns[0]), pa.array(columns[1]), key, *[pa.array(c.astype(np.int32)) for c in columns[2:]]],
        names=["hash", "context", "key", "place", "first", "last"])


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bytes around each wanted anchor of a text."""
    for batch in batches:
        out = []
        for key, text, wanted in zip(*[batch.column(c).to_pylist() for c in ("key", "text", "wanted")]):
            data = text.encode()
            for w in wanted:
                place, first, last = w["place"], w["first"], w["last"]
                out.append((w["hash"], key, place, first, last, data[first:place][::-1], data[place: last + LENGTH]))
            if len(out) > 20_000:
                yield _rows(out, CONTEXTS)
                out = []
        if out:
            yield _rows(out, CONTEXTS)


_KINDS = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "string": pa.string()}


def _rows(rows: list[tuple], schema: str) -> pa.RecordBatch:
    fields = [c.split() for c in schema.split(", ")]
    return pa.RecordBatch.from_arrays(
        [pa.array([r[i] for r in rows], _KINDS[kind]) for i, (_, kind) in enumerate(fields)],
        names=[name for name, _ in fields])


def _sorted_contexts(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """Contexts in the order of their anchors -> the spans whose windows repeat."""
    rows: list[tuple] = []

    def settled(some: list[tuple]) -> Iterator[pa.RecordBatch]:
        groups = np.cumsum(np.concatenate([[0], np.diff(np.array([r[0] for r in some], np.int64)) != 0]))
        place, first, last = (np.array([r[i] for r in some], np.int64) for i in (2, 3, 4))
        found = repeated_windows(groups, [r[5] for r in some], [r[6] for r in some], place - last, place - first)
        edge = np.diff(np.pad(found, ((1, 1), (0, 0))).astype(np.int8), axis=0)
        opens, closes = np.nonzero(edge.T == 1), np.nonzero(edge.T == -1)   # per context, by distance
        out = [(some[i][1], int(place[i] - b + 1), int(place[i] - a + LENGTH))
               for i, a, b in zip(opens[0].tolist(), opens[1].tolist(), closes[1].tolist())]
        if out:
            yield _rows(out, SPANS)

    for batch in batches:
        for row in zip(*[batch.column(c).to_pylist() for c in ("hash", "key", "place", "first", "last", "before", "after")]):
            if len(rows) >= most and row[0] != rows[-1][0]:
                yield from settled(rows)
                rows = []
            rows.append(row)
    if rows:
        yield from settled(rows)


def _single_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    windows = Windows()
    for batch in batches:
        for key, first, before, after, n in zip(*[batch.column(c).to_pylist() for c in ("key", "first", "before", "after", "n")]):
            hashes = windows.windows(before[::-1] + after)
            count = len(hashes)
            yield pa.RecordBatch.from_arrays(
                [pa.array(hashes[:, 0]), pa.array(hashes[:, 1]), pa.array([key] * count, pa.binary()),
                 pa.array(np.arange(first, first + count, dtype=np.int32)), pa.array([n] * count, pa.int64())],
                names=[c.split()[0] for c in WINDOWS.split(", ")])


def merged_spans(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for start, stop in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1][1] = max(out[-1][1], stop)
        else:
            out.append([start, stop])
    return [(a, b) for a, b in out]


def key_of(text: Column) -> Column:
    return F.unhex(F.md5(text))


def repeated_spans(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, start, stop): byte ranges of a text whose windows occur elsewhere.

    Ranges may overlap.  Texts that occur in several rows are not in it as copies;
    see ``remove``.
    """
    piece, batch = PIECE, BATCH   # workers get the values of now
    whole = text_of(text)
    rows = docs.select(quoted(doc_id).cast("long").alias("doc_id"), key_of(whole).alias("key"), whole.alias("text"))
    long_enough = rows.filter(F.octet_length("text") >= LENGTH)
    anchors = long_enough.select("key", "text").mapInArrow(lambda rows: _anchors(rows, piece), ANCHORS)
    # most anchors occur once; only the others are kept
    often = anchors.groupBy("hash").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("hash")
    repeated = stage(anchors.join(often, "hash"))
    contexts = stage(repeated.groupBy("hash", "context").agg(
        F.count(F.lit(1)).alias("n"), F.min(F.struct("key", "place", "first", "last")).alias("at")))
    spans = repeated.join(contexts.filter("n > 1").select("hash", "context"), ["hash", "context"]).select(
        "key", F.col("first").alias("start"), (F.col("last") + LENGTH).alias("stop")).distinct()

    several = contexts.groupBy("hash").agg(F.count(F.lit(1)).alias("kinds")).filter("kinds > 1")
    compared = contexts.join(several, "hash")
    # one row of the texts that a compared context was found in
    wanted = compared.groupBy("at.key").agg(F.collect_list(F.struct(
        "hash", "at.place", "at.first", "at.last", "n", "kinds")).alias("wanted"))
    holders = long_enough.groupBy("key").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id")).alias("holder"))
    wanted = wanted.join(holders, "key").select(
        "key", "holder.no_id", F.coalesce("holder.doc_id", F.lit(0)).alias("some_id"), "wanted")
    held = long_enough.select(
        "key", F.col("doc_id").isNull().alias("no_id"), F.coalesce("doc_id", F.lit(0)).alias("some_id"), "text"
    ).join(wanted, ["key", "no_id", "some_id"])
    found = held.select("key", "text", "wanted").mapInArrow(_contexts, CONTEXTS)
    # an anchor at the end of a piece has two contexts at its place, told apart by first and last
    one = ["hash", "key", "place", "first", "last"]
    found = stage(found.join(compared.select("hash", "at.key", "at.place", "at.first", "at.last", "n", "kinds"), one)
                  .dropDuplicates(one))   # repeated rows hold a text twice
    few = found.filter(F.col("kinds") <= MOST_SORTED).select(*[c.split()[0] for c in CONTEXTS.split(", ")])
    by_sorting = few.repartition("hash").sortWithinPartitions("hash").mapInArrow(
        lambda rows: _sorted_contexts(rows, batch), SPANS)
    many = found.filter(F.col("kinds") > MOST_SORTED).select("key", "first", "before", "after", "n")
    windows = many.mapInArrow(_single_windows, WINDOWS)
    twice = windows.groupBy("one", "two").agg(F.sum("n").alias("n")).filter("n > 1").select("one", "two")
    by_counting = windows.join(twice, ["one", "two"]).select("key", "start", (F.col("start") + LENGTH).alias("stop"))
    return spans.unionAll(by_sorting).unionAll(by_counting)


KEPT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary"


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 512):
            out = []
            some = batch.slice(at, 512)
            for doc_id, text, spans, copied in zip(*[some.column(c).to_pylist() for c in ("doc_id", "text", "spans", "copied")]):
                data = text.encode()
                if copied and len(data) >= LENGTH:
                    gone = [(0, len(data))]
                else:
                    gone = merged_spans([(s["start"], s["stop"]) for s in spans or []])
                kept, end = [], 0
                for start, stop in gone:
                    kept.append(data[end:start])
                    end = stop
                kept.append(data[end:])
                out.append((doc_id, len(data), sum(b - a for a, b in gone), len(gone), b"".join(kept)))
            yield _rows(out, KEPT)


def _digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in _cut(batches):
        digests = [hashlib.sha256(x.as_py()).hexdigest() for x in batch.column("kept")]
        yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(digests)], names=[*batch.schema.names[:4], "kept_sha256"])


def remove(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", digests: bool = False) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept (bytes), or
    kept_sha256 instead of kept with ``digests``.

    A text of 200 bytes or more that is in two rows loses all its bytes.  A null text
    is empty; shorter texts are kept whole.  The cut may fall inside a character.
    """
    whole = text_of(text)
    rows = docs.select(quoted(doc_id).cast("long").alias("doc_id"), key_of(whole).alias("key"), whole.alias("text"))
    copies = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("key", F.lit(True).alias("copied"))
    spans = repeated_spans(docs, doc_id, text).groupBy("key").agg(
        F.collect_set(F.struct("start", "stop")).alias("spans"))
    known = spans.join(copies, "key", "full_outer")
    joined = rows.join(known, "key", "left").select("doc_id", "text", "spans", "copied")
    if digests:
        return joined.mapInArrow(_digested, KEPT.replace("kept binary", "kept_sha256 string"))
    return joined.mapInArrow(_cut, KEPT)
