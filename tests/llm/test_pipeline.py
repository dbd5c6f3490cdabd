import hashlib
import random
from collections import Counter

import pytest
import sentencepiece
from pyspark.sql import functions as F

import corpus_pipeline
from seriesmend.llm import pieces

from test_minhash import brute as near_groups
from test_mixing_and_pieces import filled
from test_quality_and_copies import brute_repeats

LIBRARY = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)


def corpus():
    rng = random.Random(8)
    rows = [(1, None, "a"), (2, "", "a"), (3, "too short", None), (4, "same words again and again " * 9, "b")]
    for i in range(60):
        words = [f"w{rng.randrange(3000)}" for _ in range(rng.randrange(25, 90))]
        source = rng.choice(["a", "b", "c", None, "a", "a"])
        rows.append((10 * i + 10, " ".join(words), source))
        if i % 4 == 0:    # another spacing, a longer original
            rows.append((10 * i + 11, "  ".join(words), source))
        if i % 5 == 0:    # a near copy
            rows.append((10 * i + 12, " ".join([*words[:-1], "changed"]), rng.choice(["a", "c"])))
    return rows


def expected(rows):
    good = [(i, t, s) for i, t, s in rows
            if len((t or "").split()) >= 20 and 100 * brute_repeats(t) <= 30 * len(t.split())]
    best = {}
    for i, t, s in good:
        key = "".join(t.split())
        if key not in best or (-len(t), i) < (-len(best[key][1]), best[key][0]):
            best[key] = (i, t, s)
    one = list(best.values())
    groups = near_groups([(i, t) for i, t, _ in one])
    kept = [r for r in one if groups[r[0]][1] == r[0]]
    names = sorted({s for _, _, s in kept if s is not None}) + ([None] if any(s is None for _, _, s in kept) else [])
    sizes = [sum(len(t.split()) for _, t, s in kept if s == n) for n in names]
    out = Counter()
    for name, size, target in zip(names, sizes, filled(sizes, [(5, 2, 1)[k % 3] for k in range(len(names))], 1.5, 2)):
        epochs = int(target // size)
        left = int(target - epochs * size)
        own = sorted((hashlib.md5(str(i).encode()).hexdigest(), i, t) for i, t, s in kept if s == name)
        for _, i, t in own:
            n = len(t.split())
            for _ in range(epochs):
                out[i, tuple(LIBRARY.encode(t))] += 1
            if left >= n:
                out[i, tuple(LIBRARY.encode(t))] += 1
            elif left > 0:
                words, at = 0, 0
                for word in t.split():
                    at = t.index(word, at) + len(word)
                    words += 1
                    if words == left:
                        break
                out[i, tuple(LIBRARY.encode(t[:at]))] += 1
            left = max(left - n, 0)
    return out


def test_run_equals_brute_force(spark, docs_of, folder_of):
    rows = corpus()
    got = corpus_pipeline.run(spark, folder_of(documents=docs_of(rows))).collect()
    assert Counter((r.doc_id, tuple(r.ids)) for r in got) == expected(rows)
    assert all(r.round_trip and r.n_ids == len(r.ids) for r in got)


def test_stages_take_odd_tables(spark, docs_of):
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert len(names) == 5
    words = " ".join(f"v{i}" for i in range(30))
    odd = docs_of([(None, words, None), (None, words, None), (7, "x " * 50, "s"), (None, None, None)])
    for docs in (docs_of([]), odd, odd.withColumn("mix", F.lit(1)).withColumn("ids", F.lit("i"))):
        for k, (_, step) in enumerate(corpus_pipeline.STAGES):
            out = step(spark, docs, "")
            assert out.count() <= 2 * max(docs.count(), 1)
            if k < len(names) - 1:
                assert out.columns == docs.columns
