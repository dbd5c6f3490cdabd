"""SentencePiece encoding and decoding as shortest paths of a weighted transducer.

Only the pieces are compiled to a transducer (a trie whose final states emit a piece).
The normaliser (white space to its mark, a mark in front) is string replacement before
it, and the byte fallback (a character that starts no piece emits its bytes) a branch
of the search.  A normalised text, composed with the pieces, is a lattice, and its
encoding the shortest path in the tropical semiring.  For unigram models an arc costs the negated score of its piece.  For
merge (BPE) models the scores only rank merges; there an arc after another costs
nothing if merging their joined text gives back the two pieces, and infinity
otherwise: a sequence whose neighbours all pass is the one that merging the whole
text gives, so the one finite path is the encoding.

Where no piece can cross (before a white space mark, around a line end), the text
is cut, and the paths of short cuts are remembered, up to ``REMEMBERED`` bytes per worker:
in two halves, of which the one filled first is dropped when the other is full, so that
frequent cuts stay.
"""

from __future__ import annotations

import math
import re
import struct
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import StructType

from seriesmend.llm.common import fresh, quoted, text_of

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
REMEMBERED = 56 << 20    # bytes a worker keeps of cuts and their paths, about
LONGEST_REMEMBERED = 100 # characters of such a cut
JOINS = 250_000          # pairs of pieces a worker keeps, in the same way
MARK = "▁"   # stands for a space in pieces
# fixed values of the model format
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2
UNKNOWN_COST = 1e3   # of a character that is no piece, in a unigram model


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(field number, value) of a protocol-buffer message; sub-messages stay bytes."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            value = varint()
        else:
            size = {1: 8, 5: 4}.get(kind) or varint()
            value = data[at: at + size]
            at += size
        yield tag >> 3, value


class PieceModel:
    """A model file, compiled.  ``encode`` gives ids, ``decode`` the text of ids."""

    def __init__(self, data: bytes):
        self.pieces: list[tuple[str, float, int]] = []
        kind, normaliser = UNIGRAM, {}
        for number, value in _fields(data):
            if number == 1:
                own = dict(_fields(value))
                score = struct.unpack("<f", own[2])[0] if 2 in own else 0.0
                self.pieces.append((own[1].decode(), score, own.get(3, NORMAL)))
            elif number == 2:
                kind = dict(_fields(value)).get(3, UNIGRAM)
            elif number == 3:
                normaliser = dict(_fields(value))
        if normaliser.get(2):
            raise ValueError("only models without a character map are supported")
        if kind not in (UNIGRAM, BPE):
            raise ValueError(f"model type {kind} is not supported")
        self.merging = kind == BPE
        self.dummy_prefix = bool(normaliser.get(3, 1))
        self.squeeze = bool(normaliser.get(4, 1))
        self.ids = {p: i for i, (p, _, t) in enumerate(self.pieces) if t in (NORMAL, USER_DEFINED)}
        self.scores = {p: self.pieces[i][1] for p, i in self.ids.items()}
        self.bytes = {int(p[3:5], 16): i for i, (p, _, t) in enumerate(self.pieces) if t == BYTE}
        self.unknown = next((i for i, p in enumerate(self.pieces) if p[2] == UNKNOWN), 0)
        # a branch is its final piece, if any, and the node behind it
        self.trie: dict[str, list] = {}
        for piece, i in self.ids.items():
            node, branch = self.trie, [None, {}]
            for c in piece:
                branch = node.setdefault(c, [None, {}])
                node = branch[1]
            branch[0] = i
        self.single = {c for c, (piece, _) in self.trie.items() if piece is not None}
        self._joins: dict[int, bool] = {}   # of two pieces, by one number
        self._older_joins: dict[int, bool] = {}
        self._paths: dict[str, bytes] = {}
        self._older_paths: dict[str, bytes] = {}
        self._room = REMEMBERED // 2
        crossing = any(MARK in p.lstrip(MARK) for p in self.ids)
        ends = any("\n" in p for p in self.ids)
        plain = rf"[^{MARK}]" if ends else rf"[^{MARK}\n]"
        self.cuts = re.compile(r"(?s).+" if crossing else rf"(?s){MARK}*{plain}+|{MARK}+|.")
        self._compile_decoder()

    # the normaliser
    def normalised(self, text: str) -> str:
        if self.squeeze:
            text = re.sub(" +", " ", text).strip(" ")
        if not text:
            return ""
        return (MARK if self.dummy_prefix else "") + text.replace(" ", MARK)

    # the encoder
    def encode(self, text: str) -> np.ndarray:
        """The ids (int32) of a text."""
        paths, path = self._paths, self._path
        found = [paths.get(c) or path(c) for c in self.cuts.findall(self.normalised(text))]
        return np.frombuffer(b"".join(found), np.int32)

    def _path(self, cut: str) -> bytes:
        """The shortest path through a cut, remembered if it is short."""
        path = self._older_paths.get(cut)
        if path is None:
            path = array("i", self.shortest_path(cut)).tobytes()
        if len(cut) <= LONGEST_REMEMBERED:
            self._room -= 4 * len(cut) + len(path) + 200   # with what Python adds
            if self._room < 0:
                self._older_paths, self._paths = self._paths, {}
                self._room = REMEMBERED // 2
            self._paths[cut] = path
        return path

    def shortest_path(self, text: str) -> list[int]:
        """Ids along the cheapest path through a text."""
        last, start = (self._merging_arcs if self.merging else self._scored_arcs)(text)
        path, at = [], len(text)
        while at:
            if last[at] >= 0:
                path.append(last[at])
            else:
                raw = text[start[at]: at].encode("utf-8", "surrogatepass")
                path.extend(self.bytes[b] for b in reversed(raw)) if self.bytes else path.append(self.unknown)
            at = start[at]
        return path[::-1]

    def _merging_arcs(self, text: str) -> tuple[list, list]:
        """The last arc (piece, start) of the path to each place that has a finite one.

        An arc costs 0 or infinity, so the first finite path to a place is its cheapest,
        and there is no other: the search may go on from the furthest place, and ends
        with a path through the text.  Where characters can fall back to bytes, it goes
        from place to place, as those arcs stand back behind all others.
        """
        n = len(text)
        last, start = [None] * (n + 1), [0] * (n + 1)
        last[0] = -1
        trie, joins, size = self.trie, self._joins, len(self.pieces)
        plain = self.single.issuperset(text)
        waiting = [0] if plain else list(range(n - 1, -1, -1))
        while waiting and last[n] is None:
            i = waiting.pop()
            before = last[i]
            if before is None:
                continue
            node = trie
            key = before * size if before >= 0 else -1
            for j in range(i, n):
                branch = node.get(text[j])
                if branch is None:
                    break
                piece, node = branch
                if piece is None or last[j + 1] is not None:
                    continue
                if key >= 0:
                    fits = joins.get(key + piece)
                    if not (self._join(before, piece) if fits is None else fits):
                        continue
                last[j + 1], start[j + 1] = piece, i
                if plain:
                    waiting.append(j + 1)
            if last[i + 1] is None and text[i] not in self.single:
                last[i + 1], start[i + 1] = -2, i   # byte fallback: nothing merges with it
        if last[n] is None:
            raise ValueError("no path through the text")
        return last, start

    def _scored_arcs(self, text: str) -> tuple[list, list]:
        """The same where an arc costs the negated score of its piece."""
        n = len(text)
        cost, last, start = [math.inf] * (n + 1), [-1] * (n + 1), [0] * (n + 1)
        cost[0] = 0.0
        for i in range(n):
            node, known = self.trie, False
            for j in range(i, n):
                branch = node.get(text[j])
                if branch is None:
                    break
                piece, node = branch
                if piece is not None:
                    known = known or j == i
                    arc = cost[i] - self.pieces[piece][1]
                    if arc < cost[j + 1]:
                        cost[j + 1], last[j + 1], start[j + 1] = arc, piece, i
            if not known and cost[i] + UNKNOWN_COST < cost[i + 1]:
                cost[i + 1], last[i + 1], start[i + 1] = cost[i] + UNKNOWN_COST, -2, i
        return last, start

    def _join(self, a: int, b: int) -> bool:
        """Whether merging the text of two pieces stops at exactly these two."""
        key = a * len(self.pieces) + b
        known = self._older_joins.get(key)
        if known is None:
            first, second = self.pieces[a][0], self.pieces[b][0]
            # a piece of both would be merged too
            known = first + second not in self.ids and self.merged(first + second) == [first, second]
        if len(self._joins) >= JOINS // 2:
            self._older_joins, self._joins = self._joins, {}
        self._joins[key] = known
        return known

    def merged(self, text: str) -> list[str]:
        """Highest score first, leftmost of equals: what a merge model defines."""
        parts, score, none = list(text), self.scores.get, -math.inf
        pairs = [score(a + b, none) for a, b in zip(parts, parts[1:])]
        while pairs:
            best = max(pairs)
            if best == none:
                break
            at = pairs.index(best)
            parts[at: at + 2] = [parts[at] + parts[at + 1]]
            del pairs[at]
            if at < len(pairs):
                pairs[at] = score(parts[at] + parts[at + 1], none)
            if at:
                pairs[at - 1] = score(parts[at - 1] + parts[at], none)
        return parts

    # the decoder
    def _compile_decoder(self) -> None:
        outputs = []
        for piece, _, kind in self.pieces:
            if kind == BYTE:
                outputs.append(bytes([int(piece[3:5], 16)]))
            elif kind in (NORMAL, USER_DEFINED, UNUSED):
                outputs.append(piece.replace(MARK, " ").encode())
            else:
                outputs.append(b"" if kind == CONTROL else " ⁇ ".encode())
        self._lengths = np.array([len(o) for o in outputs], np.int64)
        self._offsets = np.concatenate([[0], np.cumsum(self._lengths)[:-1]])
        self._outputs = np.frombuffer(b"".join(outputs), np.uint8)

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids; bytes that are no UTF-8 become replacement characters."""
        lengths = self._lengths[ids]
        ends = np.cumsum(lengths)
        shift = self._offsets[ids] - (ends - lengths)
        out = self._outputs[np.repeat(shift, lengths) + np.arange(ends[-1] if len(ends) else 0)]
        text = out.tobytes().decode("utf-8", "replace")
        return text[1:] if self.dummy_prefix and text.startswith(" ") else text

    def restored(self, text: str) -> str:
        """What decoding an encoded text gives: the text, but for marks and squeezed spaces."""
        plain = self.normalised(text).replace(MARK, " ")
        return plain[1:] if self.dummy_prefix and plain.startswith(" ") else plain


_MODELS: dict[int, PieceModel] = {}


def _model(broadcast) -> PieceModel:
    """Compiled once per worker and broadcast model."""
    if broadcast.id not in _MODELS:
        _MODELS.clear()
        _MODELS[broadcast.id] = PieceModel(broadcast.value)
    return _MODELS[broadcast.id]


class _Shared:
    """A broadcast value with an id that workers can tell apart."""

    def __init__(self, spark, data: bytes):
        self.of = spark.sparkContext.broadcast(data)
        self.id = hash(data)

    @property
    def value(self) -> bytes:
        return self.of.value


def encode(docs: DataFrame, model: str = MODEL, text: str = "text", into: str = "ids") -> DataFrame:
    """Add array<int> ``into``, the ids of the text, and drop the text.

    A null or empty text has no ids.  Other columns are kept.  The model file (a few
    hundred kB) is read by the driver and broadcast.
    """
    return _apply(docs, model, text, {into: "array<int>"}, lambda m, t, ids: [ids])


def encode_checked(docs: DataFrame, model: str = MODEL, text: str = "text") -> DataFrame:
    """As ``encode``, with ``round_trip``: decoding the ids gives the normalised text back."""
    kinds = {fresh(docs, "ids"): "array<int>", fresh(docs, "round_trip"): "boolean"}
    return _apply(docs, model, text, kinds, lambda m, t, ids: [ids, m.decode(ids) == m.restored(t)])


def _apply(docs: DataFrame, model: str, text: str, kinds: dict[str, str], values) -> DataFrame:
    spark = docs.sparkSession
    with open(model, "rb") as file:
        shared = _Shared(spark, file.read())
    others = [c for c in docs.columns if c != text]
    spare = fresh(docs, "whole_text")
    added = docs.limit(0).select(*[F.lit(None).cast(k).alias(n) for n, k in kinds.items()])
    fields = docs.select(*[quoted(c) for c in others]).schema.fields + added.schema.fields
    arrow = {"array<int>": pa.list_(pa.int32()), "boolean": pa.bool_()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compiled = _model(shared)
        for batch in batches:
            for at in range(0, batch.num_rows, 128):   # ids take more room than texts
                some = batch.slice(at, 128)
                made = []
                for t in some.column(spare).to_pylist():
                    made.append(values(compiled, t, compiled.encode(t)))
                columns = [some.column(c) for c in others]
                columns += [pa.array([row[i] for row in made], arrow[k]) for i, k in enumerate(kinds.values())]
                yield pa.RecordBatch.from_arrays(columns, names=[*others, *kinds])

    rows = docs.select(*[quoted(c) for c in others], text_of(text).alias(spare))
    return rows.mapInArrow(run, StructType(fields))


def decode(rows: DataFrame, model: str = MODEL, ids: str = "ids", into: str = "text") -> DataFrame:
    """Add string ``into``, the text of the ids (null ids: empty), and drop the ids."""
    spark = rows.sparkSession
    with open(model, "rb") as file:
        shared = _Shared(spark, file.read())
    others = [c for c in rows.columns if c != ids]
    kept = rows.select(*[quoted(c) for c in others])
    schema = kept.withColumn(into, F.lit("")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compiled = _model(shared)
        for batch in batches:
            texts = [compiled.decode(np.array(x or [], np.int32)) for x in batch.column(ids).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in others], pa.array(texts, pa.string())], names=[*others, into])

    return rows.select(*[quoted(c) for c in [*others, ids]]).mapInArrow(run, schema)
