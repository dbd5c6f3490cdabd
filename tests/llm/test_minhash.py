import random
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from seriesmend.llm import components, minhash
from seriesmend.llm.queries import QUERIES


def shingles(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def roots(nodes, links):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    return {n: find(n) for n in nodes}


def brute(rows):
    sets = {i: shingles(t) for i, t in rows}
    inverse, common = defaultdict(list), Counter()
    for i, s in sets.items():
        for x in s:
            inverse[x].append(i)
    for ids in inverse.values():
        common.update(combinations(sorted(ids), 2))
    links = [(a, b) for (a, b), c in common.items() if 100 * c >= 75 * (len(sets[a]) + len(sets[b]) - c)]
    return {i: (len(sets[i]), r) for i, r in roots(sets, links).items()}


def corpus(seed):
    rng = random.Random(seed)
    rows = [None, "", " \n", "One two", "one TWO", "a b c d e", "a b c d e", "É é", "é É"]
    for _ in range(12):
        words = [f"w{rng.randrange(5000)}" for _ in range(rng.randrange(5, 300))]
        for _ in range(rng.randrange(1, 14)):   # drifting copies: links need not reach the first
            rows.append(" ".join(words))
            for _ in range(rng.randrange(1, max(2, len(words) // 50))):
                words[rng.randrange(len(words))] = f"x{rng.randrange(5000)}"
    return list(enumerate(rows))


@pytest.mark.parametrize("seed,block", [(1, 1000), (2, 2)])
def test_components_equal_brute_force(spark, docs_of, monkeypatch, seed, block):
    monkeypatch.setattr(minhash, "BLOCK_ROWS", block)
    rows = corpus(seed)
    rng = random.Random(seed)
    rng.shuffle(rows)
    docs = docs_of(rows).withColumns({"cls": F.lit(1), "component": F.lit("c")})
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.label(docs).collect()}
    assert got == brute(rows)


def test_a_link_the_leader_misses_is_found(spark):
    """Two classes far from the bucket's leader, similar to each other."""
    words = [f"w{i}" for i in range(400)]
    other = [f"v{i}" for i in range(400)]
    texts = [" ".join(words), " ".join(other), " ".join([*other[:200], "x", *other[200:]])]
    rows = [(0, 0, texts[0]), (1, 0, texts[1]), (2, 0, texts[2])]
    docs = spark.createDataFrame(rows, "doc_id long, text_hash long, text string").withColumn("text_hash", F.xxhash64("text"))
    sketched = minhash.sketches(docs)
    table = sketched.select("cls", "n", "sig", "bands", F.struct(F.lit(False).alias("no_id"), "doc_id", "text_hash").alias("rep"))
    classes = minhash.Classes(table, docs)
    buckets = table.select(F.lit(5).cast("long").alias("key"), "cls")   # all in one bucket
    sets = classes.sets_of(buckets).join(table.select("cls", "sig"), "cls")
    none = table.select(F.col("cls").alias("node"), F.col("cls").alias("component")).limit(0)
    links = minhash._open_links(buckets, sets, none).collect()
    near = {bytes(r.cls) for r in sketched.filter("doc_id > 0").collect()}
    assert {frozenset((bytes(r.a), bytes(r.b))) for r in links} == {frozenset(near)}


def test_repeated_rows_null_ids_and_empty_table(spark, docs_of, folder_of):
    text = " ".join(f"w{i}" for i in range(60))
    rows = [(None, text), (5, text + " more"), (5, text + " more"), (None, "alone in here with no id"), (9, None)]
    got = sorted((str(r.doc_id), str(r.component_id), r.kept) for r in minhash.label(docs_of(rows)).collect())
    assert got == [("5", "5", True), ("5", "5", True), ("9", "9", True), ("None", "5", False), ("None", "None", True)]
    kept = minhash.keep_one(docs_of(rows).withColumn("kept_id", F.lit(1)))
    assert kept.count() == 4 and "kept_id" in kept.columns
    assert QUERIES["op7_minhash_near_dedup"](spark, folder_of(documents=docs_of([]))).count() == 0


def test_one_of_near_copies_without_ids_is_kept(spark, docs_of):
    one, two = (" ".join(f"{c}{i}" for i in range(60)) for c in "wv")
    rows = [(None, one), (None, one + " more"), (None, one + " more"), (None, two), (None, two),
            (None, "alone in here with no id"), (None, ""), (None, ""), (7, "has an id of its own")]
    kept = [r.text for r in minhash.keep_one(docs_of(rows)).collect()]
    assert len([t for t in kept if t.startswith("w0")]) == 1 and kept.count(two) == 1
    assert sorted(t for t in kept if t[:2] not in ("w0", "v0")) == ["", "", "alone in here with no id", "has an id of its own"]


def test_estimate_keeps_what_is_similar():
    rng = np.random.default_rng(1)
    hasher = minhash.WordHasher()
    for _ in range(100):
        n = int(rng.integers(5, 500))
        same = rng.integers(0, 1 << 62, n, np.uint64)
        k = n // 7
        x, y = np.append(same, rng.integers(0, 1 << 62, k, np.uint64)), np.append(same, rng.integers(0, 1 << 62, k, np.uint64))
        a, b = minhash.packed(minhash.minima(x)), minhash.packed(minhash.minima(y))
        differ = a ^ b
        differ |= differ >> np.uint64(1)
        differ |= differ >> np.uint64(2)
        differing = int(np.bitwise_count(differ & np.uint64(0x1111111111111111)).sum())
        true = n / (n + 2 * k)
        estimate = (1 - differing / 128 - 1 / 16) / (15 / 16)
        assert abs(estimate - true) < 0.22
    assert len(hasher.shingles(b"")) == 0


def test_words_are_hashed_alike_in_pieces(monkeypatch):
    text = b"Some words \t of \n any length " * 50 + b"z" * 300
    whole = minhash.WordHasher().words(text)
    monkeypatch.setattr(minhash, "PIECE", 7)
    assert (minhash.WordHasher().words(text) == whole).all() and len(whole) == len(text.split())


@pytest.mark.parametrize("seed", range(3))
def test_components_of_random_graphs(spark, seed):
    rng = random.Random(seed)
    chain = [(i, i + 1) for i in range(100, 140)]
    hub = [(50, i) for i in range(1000, 1100)]
    links = chain + hub + [(rng.randrange(60), rng.randrange(60)) for _ in range(40)] + [(7, 7)]
    rng.shuffle(links)
    got = components.components(spark.createDataFrame(links, "a long, b long"))
    nodes = {n for a, b in links if a != b for n in (a, b)}
    assert {r.node: r.component for r in got.collect()} == roots(nodes, [x for x in links if x[0] != x[1]])
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_components_grow_by_links_between_them(spark):
    rng = random.Random(5)
    some, more = ([(rng.randrange(60), rng.randrange(60)) for _ in range(n)] for n in (25, 20))
    frame = lambda rows: spark.createDataFrame(rows, "a long, b long")
    want = {(r.node, r.component) for r in components.components(frame(some + more)).collect()}
    got = components.joined(components.components(frame(some)), frame(more)).collect()
    assert len(got) == len(want) and {(r.node, r.component) for r in got} == want


def test_near_copies_need_few_stages(spark, docs_of):
    # with hundreds of partitions, the time of small tables is that of their stages' tasks
    words = [f"w{i}" for i in range(100)]
    rows = [(i, " ".join(words[:40] + [f"x{i}"] + words[40:])) for i in range(12)]
    spark.sparkContext.setJobGroup("near copies", "")
    try:
        got = minhash.label(docs_of(rows)).collect()
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert {r.component_id for r in got} == {0}
    tracker = spark.sparkContext.statusTracker()
    stages = {s for j in tracker.getJobIdsForGroup("near copies") for s in tracker.getJobInfo(j).stageIds}
    assert len(stages) < 120
