import math
import random
import sys
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from seriesmend.llm import gru


def words_of(text):
    return (text or "").encode().lower().split()


def grammar_docs(n, seed=1):
    """Each word says what follows, so a model with a state can beat the counts."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        at, out = rng.randrange(40), []
        for _ in range(rng.randrange(1, 60)):
            out.append(f"W{at}" if rng.random() < 0.95 else f"rare{rng.randrange(500)}")
            at = (at * 7 + 3) % 40
        rows.append((i, "\n".join(out)))
    return rows


def vocabulary_of(rows):
    counts = Counter()
    for i, t in rows:
        if zlib.crc32(str(i).encode()) % 5 != 1:
            counts.update([*words_of(t), None])
    return counts


def test_gradients_match_differences(monkeypatch):
    rng = np.random.default_rng(2)
    vocab = gru.Vocabulary(tuple(b"w%d" % i for i in range(80)), tuple([9] + [5] * 80), 900, 300)
    p = {n: v.astype(np.float64) for n, v in vocab.start().items()}
    for n in ("to_class", "to_word"):
        p[n] = rng.normal(0, 0.3, p[n].shape)
    docs = [rng.choice([0, 1, 5, 40, 79, gru.RARE], k).astype(np.int32) for k in (5, 2, 3, 1)]
    monkeypatch.setattr(gru, "LANES", 2)
    lanes = gru.Lanes(docs)
    state = np.zeros((lanes.targets.shape[1], gru.HIDDEN))
    loss, grads, _ = gru.gradients(p, lanes, 0, lanes.steps, state)
    for name in gru.SHAPES:
        for _ in range(12):
            at = np.unravel_index(int(np.argmax(np.abs(grads[name]) * rng.random(grads[name].shape))), grads[name].shape)
            kept = p[name][at]
            p[name][at] = kept + 1e-5
            up = gru.gradients(p, lanes, 0, lanes.steps, state)[0]
            p[name][at] = kept - 1e-5
            down = gru.gradients(p, lanes, 0, lanes.steps, state)[0]
            p[name][at] = kept
            assert grads[name][at] == pytest.approx((up - down) / 2e-5, rel=1e-3, abs=1e-5)


def test_state_is_carried_and_documents_do_not_mix(monkeypatch):
    rng = np.random.default_rng(3)
    vocab = gru.Vocabulary(tuple(b"w%d" % i for i in range(80)), tuple([9] + [5] * 80), 900, 300)
    p = vocab.start()
    p["to_word"] = rng.normal(0, 0.5, p["to_word"].shape).astype(np.float32)
    docs = [np.append(rng.integers(1, 81, k), 0).astype(np.int32) for k in (0, 3, 100, 17, 16, 200, 1)]
    alone = [gru.likelihoods(p, [d])[0] for d in docs]
    for lanes, window in ((1, 16), (3, 5), (512, 7)):
        monkeypatch.setattr(gru, "LANES", lanes)
        monkeypatch.setattr(gru, "WINDOW", window)
        assert gru.likelihoods(p, docs) == pytest.approx(alone, rel=1e-4)


def test_probabilities_sum_to_one():
    vocab = gru.Vocabulary(tuple(b"w%d" % i for i in range(50)), tuple([4] + [3] * 50), 200, 80)
    states = np.zeros((gru.RARE + 1, gru.HIDDEN), np.float32)
    p = vocab.start()
    total = np.exp(gru._predict(p, states, np.arange(gru.RARE + 1))).sum()
    assert total == pytest.approx(1, rel=1e-4)
    # the class of rare words is shared out whole: 29 known ones and one unseen
    counts_of_rare = 200 - sum(vocab.counts)
    assert vocab.rare_total == counts_of_rare + 0.5 * 29 + 0.5


@pytest.mark.parametrize("limit", [1 << 24, 500])
def test_scores(spark, docs_of, monkeypatch, limit):
    monkeypatch.setattr(gru, "CHUNK_BYTES", limit)
    rows = [*grammar_docs(1500), (5001, None), (5002, ""), (5003, " \n"), (5004, "unseenword"), (None, "W1 W2")]
    got = {r.doc_id: r for r in gru.log_likelihoods(docs_of(rows).withColumn("chunk", F.lit(1))).collect()}
    counts = Counter()
    held = {i: zlib.crc32(("" if i is None else str(i)).encode()) % 5 == 1 for i, _ in rows}
    for i, t in rows:
        if not held[i]:
            counts.update([*words_of(t), None])
    n, v = sum(counts.values()), len(counts)
    base = model = 0.0
    for i, t in rows:
        toks = [*words_of(t), None]
        r = got[i]
        assert (r.held_out, r.n_tokens, r.train_tokens) == (held[i], len(toks), n)
        assert r.n_known == sum(counts[w] > 0 for w in toks)
        want = sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in toks)
        assert r.base_score == pytest.approx(want, rel=1e-9)
        if held[i]:
            base, model = base + want, model + r.score
    assert model > base * 0.8   # both negative: the model is far ahead on what it has not seen


def test_buckets_grow_and_hold_every_word(spark, docs_of):
    sizes = []
    for words in (1100, 6000):
        rows = gru.chunked(docs_of([(i, " ".join(f"w{j}" for j in range(i, words, 10))) for i in range(10)]))
        counted = gru.word_counts(rows)
        vocab = gru.vocabulary(rows, counted)
        sizes.append(len(vocab.buckets))
        ids, shares = vocab.ids(), [0.0] * len(vocab.buckets)
        for r in counted.filter("one AND c > 0").collect():
            if ids[bytes(r.word)] >= gru.RARE:
                shares[ids[bytes(r.word)] - gru.RARE] += r.c + 0.5
        shares[ids[gru.UNSEEN] - gru.RARE] += 0.5
        assert shares == pytest.approx(vocab.buckets) and sum(shares) == pytest.approx(vocab.rare_total)
        # before learning, every word and the unseen one has its share of the counts
        p = vocab.start()
        every = np.arange(gru.RARE + len(shares))
        found = np.exp(gru._predict(p, np.zeros((len(every), gru.HIDDEN), np.float32), every))
        assert found.sum() == pytest.approx(1, rel=1e-4)
        total = vocab.tokens + 0.5 * (vocab.distinct + 1)
        assert found[gru.RARE:] == pytest.approx(np.array(shares) / total, rel=1e-3, abs=1e-8)
        assert {n: v.shape for n, v in gru.unpacked(gru.packed(p)).items()} == {n: v.shape for n, v in p.items()}
    assert sizes[0] < sizes[1]


def test_state_tells_words_outside_the_frequent_ones_apart(spark, docs_of):
    # every id of a frequent word is taken by words that the other documents don't have
    rng, buckets = random.Random(6), 96
    groups = [[] for _ in range(8)]   # words in eight buckets; a group says which one follows
    for i in range(100_000):
        at = zlib.crc32(b"w%d" % i) % buckets
        if at % 12 == 0 and len(groups[at // 12]) < 50:
            groups[at // 12].append(f"w{i}")
    rows = [(i, " ".join(rng.choice(groups[(i + k) % 8]) for k in range(40))) for i in range(1000)]
    common = " ".join(f"common{i}" for i in range(gru.FREQUENT - 1))
    rows += [(i, common) for i in range(10_000, 10_200) if zlib.crc32(str(i).encode()) % 5 != 1]
    top = vocabulary_of(rows).most_common(gru.FREQUENT)
    assert all(w is None or w.startswith(b"common") for w, _ in top) and gru.buckets_for(1023 + 400) == buckets
    held = [r for r in gru.log_likelihoods(docs_of(rows).repartition(2)).collect() if r.held_out and r.doc_id < 10_000]
    tokens = sum(r.n_tokens for r in held)
    # 400 words as frequent as each other: knowing only that none is frequent gives 1 / 400
    assert sum(r.score for r in held) > -0.85 * math.log10(400) * tokens


def test_empty_and_untrained(spark, docs_of):
    assert gru.log_likelihoods(docs_of([])).count() == 0
    only = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 5 == 1)
    r = gru.log_likelihoods(docs_of([(only, "a b")])).first()
    assert r.held_out and r.train_tokens == 0 and r.n_known == 0 and r.base_score == pytest.approx(0)


def skewed_window(buckets, seed=4):
    """Parameters, states and targets of which half are of one class."""
    rng = np.random.default_rng(seed)
    vocab = gru.Vocabulary(tuple(b"w%d" % i for i in range(1023)), (5,) * 1024, 9000, 5000, (3.0,) * buckets)
    p = {n: rng.normal(0, 0.3, v.shape) for n, v in vocab.start().items()}
    targets = rng.integers(0, gru.RARE + buckets, 2048).astype(np.int32)
    targets[::2] %= gru.PER_CLASS
    return p, np.tanh(rng.normal(0, 1, (len(targets), gru.HIDDEN))), targets


@pytest.mark.parametrize("scale", [1, 400])   # e to the larger scores is beyond the floats' range
def test_predictions_equal_the_plain_formula(scale):
    p, states, targets = skewed_window(320)
    p = {n: v * scale for n, v in p.items()}
    grads = {n: np.zeros_like(v) for n, v in p.items()}
    found, back = gru._predict(p, states, targets, grads)
    log_softmax = lambda x: x - x.max() - np.log(np.exp(x - x.max()).sum())
    want, errors = [], {n: np.zeros_like(v) for n, v in p.items()}
    for h, target, own in zip(states, targets, back):
        c, w = divmod(int(target), gru.PER_CLASS)
        a, b = log_softmax(h @ p["to_class"] + p["class_bias"]), log_softmax(h @ p["to_word"][c] + p["word_bias"][c])
        want.append(a[c] + b[w])
        a, b = np.exp(a) - (np.arange(len(a)) == c), np.exp(b) - (np.arange(len(b)) == w)
        assert own == pytest.approx(p["to_class"] @ a + p["to_word"][c] @ b, rel=1e-6, abs=1e-6)
        errors["to_class"] += np.outer(h, a)
        errors["class_bias"] += a
        errors["to_word"][c] += np.outer(h, b)
        errors["word_bias"][c] += b
    assert found == pytest.approx(want, rel=1e-9)
    assert gru._predict(p, states, targets) == pytest.approx(want, rel=1e-9)
    for name in ("to_class", "class_bias", "to_word", "word_bias"):
        assert grads[name] == pytest.approx(errors[name], rel=1e-6, abs=1e-6)


def test_calls_do_not_grow_with_the_classes():
    # small products class by class took most of the time
    def calls(buckets):
        p, states, targets = skewed_window(buckets)
        grads, count = {n: np.zeros_like(v) for n, v in p.items()}, [0]

        def note(frame, event, arg):
            count[0] += event in ("call", "c_call")

        sys.setprofile(note)
        try:
            gru._predict(p, states, targets, grads)
        finally:
            sys.setprofile(None)
        return count[0]

    assert calls(3200) < 1.5 * calls(320)


def test_texts_are_split_once(spark, docs_of):
    scored = gru.log_likelihoods(docs_of(grammar_docs(300)))
    plan = scored._jdf.queryExecution().executedPlan().toString()
    # learning and scoring read written ids: no text goes to the counts of its words again
    assert "Exchange" not in plan and "text" not in plan and "ids" in plan
    assert scored.count() == 300


@pytest.mark.parametrize("most", [1, 5, 30, 1000])
def test_chunks_number_the_words_of_whole_texts(most, monkeypatch):
    monkeypatch.setattr(gru, "ROWS_AT_ONCE", 7)
    rng = random.Random(1)
    signs = [*"aBz \n\t\x0b\x0c\r\x1c\x85\xa0\x00", "É", "ß", "\u2003", "İ", "😀"]
    texts = ["".join(rng.choice(signs) for _ in range(rng.randrange(25))) for _ in range(300)] + ["", " "]
    batches = []
    for i in range(0, len(texts), 37):
        own = texts[i: i + 37]
        batches.append(pa.RecordBatch.from_arrays(
            [pa.array([3] * len(own), pa.int32()), pa.array(range(i, i + len(own)), pa.int64()),
             pa.array([(i + j) % 3 == 0 for j in range(len(own))]), pa.array(own)],
            names=["part", "doc_id", "held_out", "text"]))
    docs, words, got, want, sizes = {}, {}, Counter(), Counter(), Counter()
    for r in (r for b in gru._coded(iter(batches), most) for r in b.to_pylist()):
        if r["codes"] is not None:
            docs[r["doc_id"]] = (r["chunk"], gru.from_planes(r["codes"]).tolist())
        else:
            words[r["chunk"], r["code"]] = r["word"]
            got[r["chunk"], r["word"]] = r["n"]
    assert len(docs) == len(texts)
    for i, text in enumerate(texts):
        chunk, codes = docs[i]
        assert [words[chunk, c] for c in codes] == words_of(text)
        for w in words_of(text):
            want[chunk, w] += i % 3 != 0
        sizes[chunk] += len(text.encode()) + 1
    assert got == want and len(got) == len(want)
    alone = Counter(chunk for chunk, _ in docs.values())
    assert all(size <= most or alone[chunk] == 1 for chunk, size in sizes.items())
    assert gru.from_planes(gru.planes(np.array([0, 255, 256, 1 << 24, (1 << 31) - 1]))).tolist() == [0, 255, 256, 1 << 24, (1 << 31) - 1]


@pytest.mark.parametrize("kind", [np.uint16, np.int32])
def test_ids_fit_their_type(kind):
    buckets = (1 << 16) - gru.RARE + (kind is np.int32) * gru.PER_CLASS
    assert gru.Vocabulary((), (0,), 0, 0, (1.0,) * buckets).id_type is kind
