import hashlib
import random
import time
from collections import Counter
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from seriesmend.llm import substrings
from seriesmend.llm.queries import QUERIES
from seriesmend.plans.staging import FREE_SHUFFLES

L = substrings.LENGTH


def brute(texts):
    data = [(t or "").encode() for t in texts]
    counts = Counter(d[i:i + L] for d in data for i in range(len(d) - L + 1))
    out = []
    for d in data:
        gone = np.zeros(len(d) + 2, np.int8)
        for i in range(len(d) - L + 1):
            if counts[d[i:i + L]] > 1:
                gone[i + 1: i + L + 1] = 1
        kept = bytes(b for b, g in zip(d, gone[1:]) if not g)
        out.append((len(d), int(gone.sum()), int((np.diff(gone) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return out


def corpus(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randrange(1, 8)))
    passages = [" ".join(word() for _ in range(n)) for n in (30, 45, 60, 90, 200)]
    line = "x" * 20 + " a line that is everywhere in this corpus, and a hundred and fifty bytes long or so, " + "y" * 60
    texts = [None, "", "short", "a" * 199, "a" * 200, "b" * 201, "c" * 450, "ab" * 300, "z" * 199]
    for i in range(60):
        parts = [" ".join(word() for _ in range(rng.randrange(5, 80)))]
        for _ in range(rng.randrange(3)):
            p = rng.choice(passages)
            a = rng.randrange(len(p) // 3)
            parts += [p[a: len(p) - rng.randrange(len(p) // 3 + 1)], " ".join(word() for _ in range(rng.randrange(30)))]
        if rng.random() < 0.5:
            parts.insert(rng.randrange(len(parts) + 1), line)
        texts.append(" ".join(parts))
    for _ in range(8):   # near copies, and a few exact ones
        words = texts[20].split()
        words[rng.randrange(len(words))] = "changed"
        texts.append(" ".join(words))
    return texts + [texts[30], texts[31], texts[31], texts[40] * 3]


@pytest.mark.parametrize("most,piece,batch", [(100_000, 1 << 20, 20000), (1, 1 << 20, 20000), (6, 97, 10)])
def test_removed_bytes_equal_brute_force(spark, docs_of, monkeypatch, most, piece, batch):
    monkeypatch.setattr(substrings, "MOST_SORTED", most)
    monkeypatch.setattr(substrings, "PIECE", piece)
    monkeypatch.setattr(substrings, "BATCH", batch)
    texts = corpus(min(most, 7))
    docs = docs_of(list(enumerate(texts))).withColumns({"key": F.lit(1), "spans": F.lit("s")})
    got = substrings.remove(docs, digests=True).collect()
    found = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got}
    assert len(got) == len(texts)
    assert found == dict(enumerate(brute(texts)))


def around(edges, seed):
    """A text that spans pieces with the given ends, and texts that repeat passages of it
    which begin, end and lie at the ends."""
    rng = random.Random(seed)
    fill = lambda n: "".join(rng.choices("abcdefgh", k=n))
    long, others = fill(edges[-1] + 700), []
    for edge in edges:
        for before, after in ((0, 260), (260, 0), (199, 1), (1, 199), (130, 150), (400, 500), (-150, 420), (420, -150)):
            others.append(fill(90) + long[edge - before: edge + after] + fill(90))
    return long, others


@pytest.mark.parametrize("most", [100_000, 1])
def test_passages_at_the_ends_of_small_pieces(spark, docs_of, monkeypatch, most):
    monkeypatch.setattr(substrings, "MOST_SORTED", most)
    monkeypatch.setattr(substrings, "PIECE", 1000)
    texts = []
    for kind in range(8):   # each kind of passage in a text of its own, so that none hides another
        long, others = around((1000, 2000, 3000), kind)
        texts += [long, *others[kind::8]]
    got = substrings.remove(docs_of(list(enumerate(texts))), digests=True).collect()
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got} == dict(enumerate(brute(texts)))


def test_passages_at_the_ends_of_whole_pieces(spark, docs_of):
    end = substrings.PIECE
    for n, (before, after) in enumerate(((0, 260), (260, 0), (130, 150))):
        rng = random.Random(n)
        fill = lambda k: "".join(rng.choices("abcdefgh", k=k))
        long = fill(end + 900)
        a, b = end - before, end + after
        # bytes beside the passage differ
        other = "0" * 90 + long[a:b] + "1" * 90
        got = {r.doc_id: r for r in substrings.remove(docs_of([(1, long), (2, other)])).collect()}
        assert [(got[i].n_removed, got[i].n_spans) for i in (1, 2)] == [(b - a, 1)] * 2
        assert bytes(got[1].kept).decode() == long[:a] + long[b:] and bytes(got[2].kept) == b"0" * 90 + b"1" * 90


def test_repeated_rows_null_ids_and_empty_table(spark, docs_of, folder_of):
    text = " ".join(f"w{i}" for i in range(100))
    rows = [(1, text), (1, text), (None, text + " tail of its own"), (4, "u" * 10 + text[50:])]
    got = substrings.remove(docs_of(rows)).collect()
    want = brute([t for _, t in rows])
    assert sorted((r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(bytes(r.kept)).hexdigest()) for r in got) == sorted(want)
    assert QUERIES["op5_suffix_dedup"](spark, folder_of(documents=docs_of([]))).count() == 0


def shares_of(strings):
    def share(a, b):
        n = 0
        while n < min(len(a), len(b)) and a[n] == b[n]:
            n += 1
        return n
    return [share(a, b) for a, b in zip(strings, strings[1:])]


def test_deep_shallow_sorts_and_measures():
    rng = random.Random(9)
    for _ in range(60):
        base = bytes(rng.choice(b"\0ab") for _ in range(90))
        strings, groups = [], []
        for g in range(rng.randrange(1, 5)):
            for _ in range(rng.randrange(1, 12)):
                s = bytearray(base[: rng.randrange(91)])
                for _ in range(rng.randrange(3)):
                    if s:
                        s[rng.randrange(len(s))] = rng.choice(b"\0abc")
                strings.append(bytes(s))
                groups.append(g)
        order, shares = substrings.deep_shallow(np.array(groups), strings)
        assert sorted(order.tolist()) == list(range(len(strings)))
        keyed = [(groups[i], strings[i]) for i in order]
        assert keyed == sorted(keyed)
        measured = shares_of([s for _, s in keyed])
        for i in range(1, len(keyed)):
            assert shares[i] == (measured[i - 1] if keyed[i][0] == keyed[i - 1][0] else -1)


def test_blind_trie_alone():
    rng = random.Random(2)
    for _ in range(200):
        strings = [b"pre" + bytes(rng.choice(b"ab") for _ in range(rng.randrange(12))) for _ in range(rng.randrange(1, 15))]
        order, shares = substrings.blind_trie(strings, 3)
        ordered = [strings[i] for i in order]
        assert ordered == sorted(strings) and shares[1:] == shares_of(ordered)


def test_shuffles_of_staged_tables_are_freed(spark, docs_of):
    folders = list(spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString())
    files = lambda: {f for d in folders for f in Path(d).rglob("shuffle_*.data")}
    docs = docs_of(list(enumerate(corpus(3))))
    before = files()
    substrings.repeated_spans(docs)   # a plan over staged tables, not run
    deadline = time.time() + 20
    while files() - before and time.time() < deadline:
        time.sleep(0.2)
    assert not files() - before
    assert spark.conf.get(FREE_SHUFFLES, None) is None
