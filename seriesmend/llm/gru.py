"""Log-likelihood of whole documents under a gated recurrent language model.

Words are counted over all training documents.  The most frequent ones (and the end
of a document) have an id each; all others are dealt by a hash to buckets, whose
number grows with the square root of the vocabulary.  Ids of words and buckets are
grouped into classes of equal size.  A gated recurrent unit reads a document id by id;
its state predicts the class of the next word and the word or bucket in its class
(class-factored softmax).  In a bucket, a word has its smoothed share of the counts.

The model learns from every training document: each task runs truncated
backpropagation over its own documents, and the parameters of all tasks are averaged
in a tree after each of ``ROUNDS`` disjoint parts of the corpus.  Scoring carries the
state across windows, so that a document is scored as a whole however long it is.

Texts are split into words once, in chunks of bounded size that number the words they
have.  A chunk asks for its words and gets their counts and ids; its documents are then
written as ids, which learning and scoring read.  The vocabulary is never held in one place.
"""

from __future__ import annotations

import heapq
import itertools
import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from seriesmend.llm.common import partitions_for, quoted, text_of
from seriesmend.plans.staging import drop_staged, stage, staged_tables

CLASSES, PER_CLASS = 32, 32           # classes of frequent words, and ids in each class
FREQUENT = CLASSES * PER_CLASS        # the end of a document is the first of them
HIDDEN = 16
LANES, WINDOW = 512, 32               # documents read side by side, steps of backpropagation
STEPS = 24                            # windows that a batch of documents should have at least
AT_ONCE = 2048                        # places whose classes are scored at once: stays in a processor's cache
KEPT_BYTES = 30 << 20                 # see keep_freed_memory; the C library's limit is 32 MB
ROUNDS = 2
RATE = 0.05
CHUNK_BYTES = 16 << 20                # text that shares one table of counts
ROWS_AT_ONCE = 500                    # documents split into words at once
TOKENS_AT_ONCE = 4_000_000            # read in one batch; 20 bytes each
END, RARE = 0, FREQUENT               # ids; those of buckets begin at RARE
BUCKETS_PER_ROOT = 2                  # buckets of other words, by the square root of the vocabulary
AVERAGED_BYTES = 64 << 20             # of models that one task averages, if these are more than two
UNSEEN = b""                          # stands for all words that no training document has

SHAPES = {   # by the number of classes
    "embed": lambda n: (n * PER_CLASS, HIDDEN), "into": lambda n: (HIDDEN, 3 * HIDDEN), "bias": lambda n: (3 * HIDDEN,),
    "again": lambda n: (HIDDEN, 3 * HIDDEN), "to_class": lambda n: (HIDDEN, n), "class_bias": lambda n: (n,),
    "to_word": lambda n: (n, HIDDEN, PER_CLASS), "word_bias": lambda n: (n, PER_CLASS),
}


def buckets_for(distinct: int) -> int:
    """The number of buckets, whole classes of them."""
    return PER_CLASS * math.ceil(max(BUCKETS_PER_ROOT * math.sqrt(distinct), 1) / PER_CLASS)


@dataclass(frozen=True)
class Vocabulary:
    """The frequent words with their counts, and totals of the training tokens and buckets."""

    words: tuple[bytes, ...]      # ids 1, 2, ...
    counts: tuple[int, ...]       # of ids 0 (end), 1, 2, ...
    tokens: int                   # N
    distinct: int                 # V
    buckets: tuple[float, ...] = ()   # what the shares of each bucket add up to; empty: all in the first

    def ids(self) -> Ids:
        return Ids({w: i + 1 for i, w in enumerate(self.words)}, len(self.totals))

    @property
    def rare_total(self) -> float:
        """What the shares of rare words add up to, one unseen word included."""
        known = sum(1 for c in self.counts if c)
        return self.tokens - sum(self.counts) + 0.5 * (self.distinct - known + 1)

    @property
    def totals(self) -> tuple[float, ...]:
        return self.buckets or (self.rare_total, *[0.0] * (PER_CLASS - 1))

    @property
    def id_type(self) -> type:
        return np.uint16 if RARE + len(self.totals) <= 1 << 16 else np.int32

    def start(self) -> dict[str, np.ndarray]:
        """Parameters before learning: the shares of classes and words, and no memory."""
        rng = np.random.Generator(np.random.PCG64(7))
        shares = np.full(FREQUENT, 1e-9)
        shares[: len(self.counts)] = np.array(self.counts) + 0.5
        shares = np.append(shares, np.maximum(self.totals, 1e-9)).reshape(-1, PER_CLASS)
        p = {n: np.zeros(s(len(shares)), np.float32) for n, s in SHAPES.items()}
        for name in ("embed", "into", "again"):
            p[name] = rng.normal(0, 0.3, p[name].shape).astype(np.float32)
        totals = shares.sum(axis=1)
        p["class_bias"] = np.log(totals / totals.sum()).astype(np.float32)
        p["word_bias"] = np.log(shares / shares.sum(axis=1, keepdims=True)).astype(np.float32)
        return p


class Ids(dict):
    """Ids of frequent words; of any other, that of its bucket (not stored)."""

    def __init__(self, words: dict[bytes, int], buckets: int):
        super().__init__(words)
        self.buckets = buckets

    def __missing__(self, word: bytes) -> int:
        return RARE + zlib.crc32(word) % self.buckets

    def __reduce__(self):
        return Ids, (dict(self), self.buckets)


def packed(p: dict[str, np.ndarray]) -> np.ndarray:
    return np.concatenate([p[n].ravel() for n in SHAPES])


def unpacked(flat: np.ndarray) -> dict[str, np.ndarray]:
    one, two = (sum(math.prod(s(n)) for s in SHAPES.values()) for n in (1, 2))
    classes = 1 + (len(flat) - one) // (two - one)   # sizes are linear in it
    out, at = {}, 0
    for name, of in SHAPES.items():
        shape = of(classes)
        size = math.prod(shape)
        out[name] = flat[at: at + size].reshape(shape).astype(np.float32, copy=False)
        at += size
    return out


def _exps(scores: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """e to the scores, and its sums by row; rows are moved to a maximum of 0 (in place) only
    where e to them would leave the floats' range."""
    ones = np.ones(scores.shape[1], scores.dtype)
    with np.errstate(over="ignore"):
        found = np.exp(scores)
        sums = found @ ones
    if not (sums.min() > 1e-30 and sums.max() < 1e30):
        scores -= scores.max(axis=1, keepdims=True)
        found = np.exp(scores)
        sums = found @ ones
    return found, sums


class Lanes:
    """Documents laid end to end in lanes that are read side by side."""

    def __init__(self, docs: list[np.ndarray], most: int = LANES):
        # no more lanes than the longest document leaves full
        full = sum(map(len, docs)) // max(map(len, docs), default=1)
        lanes = [(0, i, []) for i in range(max(1, min(most, LANES, len(docs), max(full, 8))))]
        for d in sorted(range(len(docs)), key=lambda d: -len(docs[d])):
            size, i, held = heapq.heappop(lanes)   # the shortest lane
            held.append(d)
            heapq.heappush(lanes, (size + len(docs[d]), i, held))
        lanes = sorted((x for x in lanes if x[2]), key=lambda x: (-x[0], x[1]))
        self.steps = lanes[0][0] if lanes else 0
        shape = (self.steps, len(lanes))
        self.inputs, self.targets = np.full(shape, END, np.int32), np.full(shape, END, np.int32)
        self.doc, self.starts = np.full(shape, -1, np.int32), np.zeros(shape, bool)
        for lane, (_, _, held) in enumerate(lanes):
            at = 0
            for d in held:
                end = at + len(docs[d])
                self.targets[at:end, lane] = docs[d]
                self.inputs[at + 1: end, lane] = docs[d][:-1]
                self.doc[at:end, lane] = d
                self.starts[at, lane] = True
                at = end
        self.active = (self.doc >= 0).sum(axis=1)   # lanes are sorted, so these are the first
        self.begins = self.starts.any(axis=1)

    def flat(self, what: np.ndarray, first: int, last: int) -> np.ndarray:
        """The places of a window (step, lane) that belong to documents, step by step."""
        width = self.targets.shape[1]
        if self.active[last - 1] == width:   # never more than before
            return what.reshape(-1, *what.shape[2:])
        return what[np.arange(width) < self.active[first:last, None]]


def _read(p, lanes: Lanes, first: int, last: int, state: np.ndarray, traced: bool = False) -> tuple:
    """States (step, hidden, lane) in a window, and after it; with ``traced`` also what the
    steps made: embeddings of the inputs, states before, gates and new states, and the
    memory that the second gate lets through.  Lanes lie side by side in memory."""
    n, width, kind = HIDDEN, lanes.targets.shape[1], p["embed"].dtype
    embedded = p["embed"][lanes.inputs[first:last]]
    read = p["into"].T @ embedded.swapaxes(1, 2)
    read += p["bias"][:, None]
    read[:, : 2 * n] *= 0.5   # sigmoid(x) is 0.5 * tanh(0.5 * x) + 0.5
    again = p["again"].T.copy()
    again[: 2 * n] *= 0.5
    # places without a document stay 0
    afters, befores, memories = (np.zeros((last - first, n, width), kind) if x else None for x in (True, traced, traced))
    state = np.array(state.T, kind, order="C")
    for i, t in enumerate(range(first, last)):
        k = lanes.active[t]
        before, own, after = state[:, :k], read[i, :, :k], afters[i, :, :k]
        if lanes.begins[t]:
            before[:, lanes.starts[t, :k]] = 0
        u = again @ before
        gates, new, memory = own[: 2 * n], own[2 * n:], u[2 * n:]
        gates += u[: 2 * n]
        np.tanh(gates, out=gates)
        gates *= 0.5
        gates += 0.5
        if traced:
            befores[i, :, :k], memories[i, :, :k] = before, memory
        new += gates[n:] * memory
        np.tanh(new, out=new)
        np.subtract(before, new, out=after)
        after *= gates[:n]
        after += new
        before[...] = after
    return afters, state.T, (embedded, befores, read, memories)


class _Grouped:
    """Places sorted by class.  Classes with few of them are multiplied at once, each
    filled up to as many rows; the others one by one."""

    def __init__(self, classes: np.ndarray, sizes: np.ndarray):
        most = max(8, 2 * len(classes) // len(sizes))
        ends = np.cumsum(sizes)
        self.few = np.flatnonzero((sizes > 0) & (sizes <= most))
        self.many = [(c, slice(ends[c] - sizes[c], ends[c])) for c in np.flatnonzero(sizes > most).tolist()]
        self.shape = len(self.few), int(sizes[self.few].max(initial=1))
        begins = np.full(len(sizes), -1)
        begins[self.few] = np.arange(len(self.few)) * self.shape[1] - (ends - sizes)[self.few]
        self.places = np.flatnonzero((sizes <= most)[classes])
        self.at = begins[classes[self.places]] + self.places

    def filled(self, rows: np.ndarray) -> np.ndarray:
        out = np.zeros((self.shape[0] * self.shape[1], rows.shape[1]), rows.dtype)
        out[self.at] = rows[self.places]
        return out.reshape(*self.shape, rows.shape[1])

    def times(self, rows: np.ndarray, filled: np.ndarray, by: np.ndarray) -> np.ndarray:
        """Each row times the matrix of its class."""
        out = np.empty((len(rows), by.shape[2]), rows.dtype)
        out[self.places] = (filled @ by[self.few]).reshape(-1, by.shape[2])[self.at]
        for c, at in self.many:
            np.matmul(rows[at], by[c], out=out[at])
        return out


def _predict(p, states: np.ndarray, targets: np.ndarray, grads: dict | None = None):
    """Log-probabilities (base e) of the targets, rare words up to their bucket; with
    ``grads``, also the gradient of their negated sum by the states."""
    classes = targets // PER_CLASS   # those of buckets come after those of words
    sizes = np.bincount(classes, minlength=len(p["to_word"]))
    order = np.argsort(classes.astype(np.uint16) if len(sizes) < 1 << 16 else classes, kind="stable")
    own, words, classes = np.ones((len(order), HIDDEN + 1), states.dtype), targets[order] % PER_CLASS, classes[order]
    own[:, :HIDDEN] = states[order]   # and 1 for the biases of classes
    rows, grouped = np.arange(len(order)), _Grouped(classes, sizes)
    filled = grouped.filled(own[:, :HIDDEN])
    scores = grouped.times(own[:, :HIDDEN], filled, p["to_word"])
    scores += np.repeat(p["word_bias"], sizes, axis=0)
    err, sums = _exps(scores)
    found = scores[rows, words] - np.log(sums)
    if grads is not None:
        present = np.flatnonzero(sizes)
        firsts = (np.cumsum(sizes) - sizes)[present]
        err *= (1 / sums)[:, None]
        err[rows, words] -= 1
        wrong = grouped.filled(err)
        back = grouped.times(err, wrong, p["to_word"].swapaxes(1, 2))
        grads["to_word"][grouped.few] += filled.swapaxes(1, 2) @ wrong
        for c, at in grouped.many:
            grads["to_word"][c] += own[at, :HIDDEN].T @ err[at]
        grads["word_bias"][present] += np.add.reduceat(err, firsts, axis=0)
        # the chosen classes; what is expected of all follows
        chosen = np.add.reduceat(own, firsts, axis=0)
        grads["to_class"][:, present] -= chosen[:, :HIDDEN].T
        grads["class_bias"][present] -= chosen[:, HIDDEN]
        back -= p["to_class"].T[classes]
    to_class = np.append(p["to_class"], p["class_bias"][None], axis=0)
    for first in range(0, len(order), AT_ONCE):   # classes are as many as the words of several
        at = slice(first, first + AT_ONCE)
        scores = own[at] @ to_class
        shares, sums = _exps(scores)
        found[at] += scores[rows[: len(scores)], classes[at]] - np.log(sums)
        if grads is not None:
            inverse = (1 / sums)[:, None]
            expected = (own[at] * inverse).T @ shares
            grads["to_class"] += expected[:HIDDEN]
            grads["class_bias"] += expected[HIDDEN]
            back[at] += (shares @ p["to_class"].T) * inverse
    out = np.empty(len(order))
    out[order] = found
    if grads is None:
        return out
    unsorted = np.empty_like(back)
    unsorted[order] = back
    return out, unsorted


def gradients(p, lanes: Lanes, first: int, last: int, state: np.ndarray, grads: dict | None = None):
    """Loss, gradients and state of one window (backpropagation stops at its start);
    ``grads``, if given, are zeros to add them to."""
    if grads is None:
        grads = {n: np.zeros(v.shape, v.dtype) for n, v in p.items()}
    n, width = HIDDEN, lanes.targets.shape[1]
    afters, state, (embedded, before, read, memory) = _read(p, lanes, first, last, state, True)
    targets = lanes.flat(lanes.targets[first:last], first, last)
    found, by_state = _predict(p, lanes.flat(afters.swapaxes(1, 2), first, last), targets, grads)
    back = np.zeros_like(afters)
    if len(by_state) == (last - first) * width:
        back[...] = by_state.reshape(-1, width, n).swapaxes(1, 2)
    else:
        back.swapaxes(1, 2)[np.arange(width) < lanes.active[first:last, None]] = by_state
    # what an error of the state becomes in the three parts of a step: both gates and the new state
    z, r, new = read[:, :n], read[:, n: 2 * n], read[:, 2 * n:]
    by_new = (1 - z) * (1 - new * new)
    parts = np.empty((last - first, 3, n, width), back.dtype)
    np.multiply((before - new) * z, 1 - z, out=parts[:, 0])
    np.multiply(by_new * memory * r, 1 - r, out=parts[:, 1])
    np.multiply(by_new, r, out=parts[:, 2])
    errors, later = parts.reshape(-1, 3 * n, width), None
    for i in range(last - first - 1, -1, -1):
        k = lanes.active[first + i]
        dh = back[i, :, :k]
        if later is not None:
            dh[:, : later.shape[1]] += later
        parts[i, :, :, :k] *= dh
        parts[i, :, :, k:] = 0
        later = p["again"] @ errors[i, :, :k]
        later += dh * z[i, :, :k]
        if lanes.begins[first + i]:
            later[:, lanes.starts[first + i, :k]] = 0
    grads["again"] += (before @ errors.swapaxes(1, 2)).sum(axis=0)
    np.multiply(back, by_new, out=parts[:, 2])
    grads["bias"] += errors.sum(axis=(0, 2))
    grads["into"] += (embedded.swapaxes(1, 2) @ errors.swapaxes(1, 2)).sum(axis=0)
    words = lanes.flat(lanes.inputs[first:last], first, last)
    by_word = lanes.flat(errors.swapaxes(1, 2) @ p["into"].T, first, last)
    order = np.argsort(words.astype(np.uint16) if len(p["embed"]) < 1 << 16 else words, kind="stable")
    words = words[order]
    firsts = np.flatnonzero(np.append(True, words[1:] != words[:-1]))
    grads["embed"][words[firsts]] += np.add.reduceat(by_word[order], firsts, axis=0)
    return -found.sum(), grads, state


def keep_freed_memory() -> None:
    """Let the C library keep the memory of a window's arrays for the next window: it gives back
    what exceeds twice the largest block freed so far, and taking it anew costs a quarter of the time."""
    block = np.empty(KEPT_BYTES, np.uint8)
    del block


def learn(p: dict, docs: list[np.ndarray], squares: dict) -> None:
    """One pass over the documents, a step per window; changes ``p`` and ``squares``."""
    keep_freed_memory()
    # few tokens are read in fewer lanes, so that there are steps to learn from
    lanes = Lanes(docs, max(16, sum(map(len, docs)) // (STEPS * WINDOW)))
    state = np.zeros((lanes.targets.shape[1], HIDDEN), np.float32)
    flat = np.zeros(sum(v.size for v in p.values()), np.float32)
    grads = unpacked(flat)   # parts of it
    change, own, total = np.empty_like(flat), packed(p), packed(squares)
    p.update(unpacked(own))
    squares.update(unpacked(total))
    for first in range(0, lanes.steps, WINDOW):
        last = min(first + WINDOW, lanes.steps)
        flat[:] = 0
        _, _, state = gradients(p, lanes, first, last, state, grads)
        flat *= np.float32(1 / lanes.active[first:last].sum())
        np.multiply(flat, flat, out=change)
        total += change
        np.sqrt(total, out=change)
        change += 1e-6
        np.divide(flat, change, out=change)
        change *= RATE
        own -= change


def likelihoods(p: dict, docs: list[np.ndarray]) -> np.ndarray:
    """Per document, the sum of its log-probabilities (base 10), rare words by bucket."""
    keep_freed_memory()
    lanes = Lanes(docs, LANES)
    state = np.zeros((lanes.targets.shape[1], HIDDEN), np.float32)
    total = np.zeros(len(docs))
    for first in range(0, lanes.steps, WINDOW):
        last = min(first + WINDOW, lanes.steps)
        states, state, _ = _read(p, lanes, first, last, state)
        states, targets, owners = (
            lanes.flat(x, first, last) for x in (states.swapaxes(1, 2), lanes.targets[first:last], lanes.doc[first:last]))
        total += np.bincount(owners, _predict(p, states, targets), len(docs))
    return total / math.log(10)


def planes(numbers: np.ndarray) -> bytes:
    """Numbers of 32 bits, first all lowest bytes, then the next: the high ones are mostly zeros."""
    return numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()


def from_planes(data: bytes) -> np.ndarray:
    return np.frombuffer(data, np.uint8).reshape(4, -1).T.copy().view("<u4")[:, 0]


CODED = "chunk long, doc_id long, held_out boolean, codes binary, code int, word binary, n long"


def _chunks(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[list[pa.RecordBatch]]:
    """Rows whose texts, and a byte for each, are no more than ``most``; or a single row."""
    held, size = [], 0
    for batch in batches:
        ends, first = np.append(0, np.cumsum(pc.binary_length(batch.column("text")).to_numpy() + np.int64(1))), 0
        while first < batch.num_rows:
            last = int(np.searchsorted(ends, ends[first] + most - size, "right")) - 1
            last = max(last, first if held else first + 1)
            if last > first:
                held.append(batch.slice(first, last - first))
                size, first = size + int(ends[last] - ends[first]), last
            if first < batch.num_rows:
                yield held
                held, size = [], 0
    if held:
        yield held


def _coded(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """Chunks of documents; within a chunk, words are numbered as they come.  A chunk has a
    row per document with its words' numbers, and one per word: its number, and its count
    in training documents (0: only held out)."""
    names = [c.split()[0] for c in CODED.split(", ")]
    for number, held in enumerate(_chunks(batches, most)):
        doc_id, held_out = (pa.concat_arrays([b.column(c) for b in held]) for c in ("doc_id", "held_out"))
        chunk = (held[0].column("part")[0].as_py() << 32) + number
        ends, found = [np.zeros(1, np.int64)], []
        for text in (b.column("text").slice(i, ROWS_AT_ONCE) for b in held for i in range(0, len(b), ROWS_AT_ONCE)):
            lists = pc.ascii_split_whitespace(pc.ascii_lower(text))   # of ASCII only, as the rule has it
            real = pc.not_equal(lists.flatten(), "")   # there are empty ones at the ends of texts
            inner = lists.offsets.to_numpy()
            ends.append(np.append(0, np.cumsum(real.to_numpy(zero_copy_only=False)))[inner[1:] - inner[0]] + ends[-1][-1])
            found.append(lists.flatten().filter(real).dictionary_encode())
        found = pa.chunked_array(found).unify_dictionaries()
        known = found.chunk(0).dictionary.cast(pa.binary())   # all share it
        codes, ends = np.concatenate([x.indices.to_numpy() for x in found.chunks]), np.concatenate(ends)
        trained = np.repeat(~held_out.to_numpy(zero_copy_only=False), np.diff(ends))
        counts = np.bincount(codes[trained], minlength=len(known))
        ends = ends.tolist()
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.full(len(doc_id), chunk)), doc_id, held_out,
             pa.array([planes(codes[i:j]) for i, j in itertools.pairwise(ends)], pa.binary()),
             *[pa.nulls(len(doc_id), kind) for kind in (pa.int32(), pa.binary(), pa.int64())]], names=names)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.full(len(known), chunk)),
             *[pa.nulls(len(known), kind) for kind in (pa.int64(), pa.bool_(), pa.binary())],
             pa.array(np.arange(len(known), dtype=np.int32)), known, pa.array(counts)], names=names)
    pa.default_memory_pool().release_unused()   # the worker goes on to other tasks


def chunked(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents in chunks, their words as numbers, and the words of each chunk; written once.

    Held out is what crc32 of the doc_id as text puts in class 1 of 5; a null doc_id
    counts as empty.  A null text is empty.  Rows of words have no held_out.
    """
    named = F.coalesce(quoted(doc_id).cast("string"), F.lit(""))
    rows = docs.select(
        F.spark_partition_id().alias("part"), quoted(doc_id).cast("long").alias("doc_id"),
        (F.crc32(named.cast("binary")) % 5 == 1).alias("held_out"), text_of(text).alias("text"))
    most = CHUNK_BYTES
    return stage(rows.mapInArrow(lambda batches: _coded(batches, most), CODED))


def word_counts(rows: DataFrame) -> DataFrame:
    """chunk, code, word, c (its count in all training documents), one (true once per word)."""
    asked = rows.filter("code IS NOT NULL").select("chunk", "code", "word", "n")
    return stage(asked.select(
        "chunk", "code", "word", F.expr("sum(n) OVER (PARTITION BY word)").alias("c"),
        F.expr("chunk = min(chunk) OVER (PARTITION BY word)").alias("one")))


def vocabulary(rows: DataFrame, counted: DataFrame) -> Vocabulary:
    """Totals, the most frequent words (a fixed number of them) and the shares of each
    bucket (about the square root of the vocabulary) on the driver."""
    trained = rows.filter("NOT held_out").count()
    once = counted.filter("one AND c > 0")
    totals = once.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count(F.lit(1)).alias("v")).first()
    top = once.orderBy(F.desc("c"), "word").limit(FREQUENT - 1).select("word", "c").collect()
    count = buckets_for(totals.v)
    shares = [0.0] * count
    for r in once.groupBy((F.crc32("word") % count).alias("bucket")).agg((F.sum("c") + 0.5 * F.count(F.lit(1))).alias("share")).collect():
        shares[r.bucket] = r.share
    for r in top:   # these have ids of their own
        shares[zlib.crc32(r.word) % count] -= r.c + 0.5
    shares[zlib.crc32(UNSEEN) % count] += 0.5
    return Vocabulary(
        tuple(bytes(r.word) for r in top), (trained, *[r.c for r in top]),
        totals.n + trained, totals.v + (trained > 0), tuple(shares))


ENCODED = (
    "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, inside double, ids binary"
)


def encoded(rows: DataFrame, counted: DataFrame, words: Vocabulary) -> DataFrame:
    """Every document with its ids, its base score, and what its rare words have inside their
    buckets; written once.

    The base is the smoothed share of each token: log10((c + 0.5) / (N + 0.5 (V + 1))).
    """
    spark, kind = rows.sparkSession, words.id_type
    ids = words.ids()
    frequent = spark.createDataFrame([(w, ids[w]) for w in words.words], "word binary, id int")
    rare = (F.lit(RARE) + F.crc32("word") % ids.buckets).cast("int")
    counts = counted.join(F.broadcast(frequent), "word", "left").select(
        (2 * F.col("chunk")).alias("key"), "code", "c",
        F.when(F.col("c") == 0, ids[UNSEEN]).otherwise(F.coalesce("id", rare)).alias("id"),
        *[F.lit(None).cast(k).alias(n) for n, k in (("doc_id", "long"), ("held_out", "boolean"), ("codes", "binary"))])
    documents = rows.filter("codes IS NOT NULL").select(
        (2 * F.col("chunk") + 1).alias("key"), F.lit(0).alias("code"), F.lit(0).cast("long").alias("c"),
        F.lit(0).alias("id"), "doc_id", "held_out", "codes")
    totals, end_count = words.totals, words.counts[0]
    base_total = math.log10(words.tokens + 0.5 * (words.distinct + 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_id = np.append(np.zeros(RARE), np.log10(np.maximum(totals, 1e-9)))
        end_share = math.log10(end_count + 0.5)
        chunk, parts, logs, inside, own_ids, seen = None, [], *[np.zeros(0)] * 4
        for batch in batches:
            keys, *columns = (batch.column(c).to_numpy() for c in ("key", "code", "c", "id"))
            cuts = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])).tolist()
            for first, last in zip(cuts, [*cuts[1:], len(keys)]):
                if keys[first] >> 1 != chunk:   # a chunk's words come before its documents
                    chunk, parts, logs = keys[first] >> 1, [], np.zeros(0)
                if keys[first] % 2 == 0:
                    parts.append([x[first:last] for x in columns])
                    continue
                if parts:
                    code, c, at = (np.concatenate(x) for x in zip(*parts))
                    order, parts = np.argsort(code), []
                    own_ids, seen, logs = at[order].astype(kind), c[order] > 0, np.log10(c[order] + 0.5)
                    inside = np.where(own_ids >= RARE, logs - by_id[own_ids], 0)
                docs = batch.slice(first, last - first)
                found = []
                for data in docs.column("codes"):
                    codes = from_planes(data.as_py())
                    base = float(logs[codes].sum()) + end_share - base_total * (len(codes) + 1)
                    known = int(np.count_nonzero(seen[codes])) if len(codes) else 0
                    within = float(inside[codes].sum()) if len(codes) else 0.0
                    own = np.append(own_ids[codes], END) if len(codes) else np.array([END])
                    found.append((len(codes) + 1, known + (end_count > 0), base, within, own.astype(kind).tobytes()))
                yield pa.RecordBatch.from_arrays(
                    [docs.column("doc_id"), docs.column("held_out"),
                     *[pa.array(x, k) for x, k in zip(zip(*found), (
                         pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.binary()))]],
                    names=[c.split()[0] for c in ENCODED.split(", ")])

    parts = max(partitions_for(rows), rows.select("chunk").distinct().count())
    return stage(counts.unionAll(documents).repartition(parts, F.shiftright("key", 1))
                 .sortWithinPartitions("key").mapInArrow(run, ENCODED))


def _packs(batches: Iterator[pa.RecordBatch], kind: type) -> Iterator[tuple[list[np.ndarray], list[pa.RecordBatch]]]:
    """The documents' ids and rows, so many documents at a time that their tokens stay few."""
    docs, rows, held = [], [], 0
    for batch in batches:
        first = 0
        for i, data in enumerate(batch.column("ids")):
            docs.append(np.frombuffer(data.as_buffer(), kind))
            held += len(docs[-1])
            if held >= TOKENS_AT_ONCE:
                yield docs, [*rows, batch.slice(first, i + 1 - first)]
                docs, rows, held, first = [], [], 0, i + 1
        rows.append(batch.slice(first))
    if docs:
        yield docs, rows


def _averaged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total, weight = None, 0.0
    for batch in batches:
        for flat, w in zip(batch.column("flat"), batch.column("weight")):
            own = np.frombuffer(flat.as_py(), np.float32).astype(np.float64) * w.as_py()
            total, weight = own if total is None else total + own, weight + w.as_py()
    if total is not None:
        yield _model_row(total / weight, weight)


def _model_row(flat: np.ndarray, weight: float) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([flat.astype(np.float32).tobytes()], pa.binary()), pa.array([float(weight)], pa.float64())],
        names=["flat", "weight"])


MODEL_ROW = "flat binary, weight double"


def train(rows: DataFrame, words: Vocabulary) -> dict[str, np.ndarray]:
    """Learn from all encoded rows that are not held out; the parameters grow with the buckets."""
    spark, p = rows.sparkSession, words.start()
    for n in range(ROUNDS):
        shared, kind = spark.sparkContext.broadcast(packed(p)), words.id_type

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own = unpacked(shared.value)
            squares = {name: np.full(v.shape, 1e-4, np.float32) for name, v in own.items()}
            seen = 0
            for docs, _ in _packs(batches, kind):
                learn(own, docs, squares)
                seen += sum(map(len, docs))
            if seen:
                yield _model_row(packed(own), seen)

        part = rows.filter(~F.col("held_out") & (F.pmod(F.xxhash64("doc_id"), F.lit(ROUNDS)) == n))
        models = stage(part.select("ids").mapInArrow(run, MODEL_ROW))
        count = models.count()
        most = min(256, max(2, AVERAGED_BYTES // packed(p).nbytes))
        while count > 1:   # a tree: no task averages more than a few hundred models
            models = stage(models.repartition(math.ceil(count / most)).mapInArrow(_averaged, MODEL_ROW))
            count = models.count()
        row = models.first()
        if row is not None:
            p = unpacked(np.frombuffer(bytes(row.flat), np.float32))
        shared.unpersist()
    return p


SCORED = (
    "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"
)


def score(rows: DataFrame, words: Vocabulary, p: dict[str, np.ndarray]) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, base_score, score of every encoded row."""
    shared, kind = rows.sparkSession.sparkContext.broadcast(packed(p)), words.id_type
    names = [c.split()[0] for c in SCORED.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = unpacked(shared.value)
        for docs, own in _packs(batches, kind):
            likely, at = likelihoods(model, docs), 0
            for batch in own:
                total = pc.add(batch.column("inside"), pa.array(likely[at: at + batch.num_rows]))
                at += batch.num_rows
                yield pa.RecordBatch.from_arrays([*[batch.column(n) for n in names[:-1]], total], names=names)

    return rows.mapInArrow(run, SCORED)


def log_likelihoods(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Train on the documents not held out, and score all of them.

    Adds train_tokens to the columns of ``score``.  An empty text is its end alone.
    Without training documents, every document has the base's probability of unseen
    words.  Parameters are averages of floats over tasks: scores of two runs agree
    to about five digits.
    """
    spark, first = docs.sparkSession, staged_tables()
    coded = chunked(docs, doc_id, text)
    counted = word_counts(coded)
    words = vocabulary(coded, counted)
    last = staged_tables()
    rows = encoded(coded, counted, words)
    drop_staged(spark, first, last)   # all that is needed of them is in the encoded rows
    scored = score(rows, words, train(rows, words))
    return scored.withColumn("train_tokens", F.lit(words.tokens).cast("long"))
