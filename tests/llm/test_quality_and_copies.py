import hashlib
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from seriesmend.llm import cuckoo, quality
from seriesmend.llm.queries import ORACLES, QUERIES


def brute_repeats(text, k=8):
    words = (text or "").split()
    runs = {}
    for i in range(len(words) - k + 1):
        runs.setdefault(tuple(words[i:i + k]), []).append(i)
    return len({i + j for at in runs.values() if len(at) > 1 for i in at for j in range(k)})


def odd_texts():
    rng = random.Random(3)
    texts = [None, "", " \n\t ", "a", "é ü x", "a b c d e f g h " * 5, "x\ny\nx\n \n\nx", "#*$%&|<> a"]
    for n in (7, 8, 9, 15, 16, 17, 60, 3000):
        texts.append(" ".join(rng.choice("abc") for _ in range(n)))
        texts.append("\n".join(str(rng.randrange(n)) for _ in range(n)))
    return texts


def run_query(spark, folder, name):
    return {tuple(r) for r in QUERIES[name](spark, folder).collect()}


def run_sql(folder, name, columns):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet/*.parquet'")
    return set(con.execute(f"SELECT {', '.join(columns)} FROM ({ORACLES[name]})").fetchall())


@pytest.mark.parametrize("name", ["op2_quality_rules", "op8_exact_dedup"])
def test_query_equals_sql_on_odd_texts(spark, docs_of, folder_of, name):
    texts = odd_texts() + ["a b", "ab", " a\tb ", "ab"]
    folder = folder_of(documents=docs_of([(i, t, f"s{i % 3}") for i, t in enumerate(texts)]))
    columns = QUERIES[name](spark, folder).columns
    assert run_query(spark, folder, name) == run_sql(folder, name, columns)


def test_repeated_words_match_brute_force(spark, docs_of):
    texts = odd_texts()
    got = quality.features(docs_of(list(enumerate(texts))), "q").select("doc_id", "q.n_repeat_words")
    assert dict(map(tuple, got.collect())) == {i: brute_repeats(t) for i, t in enumerate(texts)}


@pytest.mark.parametrize("name", ["op2_quality_rules", "op8_exact_dedup"])
def test_empty_table(spark, docs_of, folder_of, name):
    assert run_query(spark, folder_of(documents=docs_of([])), name) == set()


def test_bad_host_is_condemned_and_a_small_one_is_not(spark, docs_of):
    good = " ".join(f"w{i}" for i in range(30))
    rows = [(i, "short", "bad") for i in range(95)] + [(100 + i, f"{good} {i}", "bad") for i in range(5)]
    for h in range(40):
        rows += [(1000 + 10 * h + i, f"{good} {h} {i}", f"h{h}") for i in range(10)]
    rows += [(5000, "short", "tiny"), (5001, "short", None), (5002, good, None)]
    kept = {r.doc_id for r in quality.keep_good(docs_of(rows)).collect()}
    assert not any(d < 105 for d in kept) and 5002 in kept and len(kept) == 401


def test_extra_columns_survive(spark, docs_of):
    good = " ".join(f"w{i}" for i in range(30))
    docs = docs_of([(1, good), (2, good)]).withColumns({"quality": F.lit(1), "kept": F.lit("k"), "digest_": F.lit(2), "a.b": F.lit(3)})
    once = quality.keep_good(docs)
    assert once.columns == docs.columns and once.count() == 2
    one = cuckoo.keep_one(docs)
    assert one.columns == docs.columns and [tuple(r)[0] for r in one.collect()] == [1]


def test_one_row_stays_of_repeated_rows(spark, docs_of):
    rows = [(7, "x y"), (7, "x y"), (None, "x y"), (3, "xy"), (None, None), (None, ""), (9, "q"), (9, "q")]
    got = cuckoo.groups(docs_of(rows)).collect()
    assert sum(r.kept for r in got) == 3
    assert {(r.keep_id, r.group_size) for r in got} == {(7, 4), (None, 2), (9, 2)}
    assert sorted(str(r.text) for r in cuckoo.keep_one(docs_of(rows)).collect()) in (
        ["", "q", "x y"], ["None", "q", "x y"])


def test_shard_inserts_deletes_and_grows():
    shard, rng, live = cuckoo.CuckooShard(2), random.Random(5), {}
    for n in range(6000):
        digest = hashlib.sha256(b"%d" % rng.randrange(3000)).hexdigest()
        if rng.random() < 0.4:
            assert shard.delete(digest) == (digest in live)
            live.pop(digest, None)
        else:
            shard.put(digest, (n,))
            live[digest] = (n,)
        assert shard.get(digest) == live.get(digest)
    assert dict(shard.items()) == live and all(shard.may_hold(d) for d in live)
    assert shard.table.astype(bool).sum() == len(live) == shard.live


def test_index_insert_delete_insert(spark, docs_of):
    def rows(*texts):
        return cuckoo.numbered_digests(docs_of(list(enumerate(texts))))

    index = cuckoo.CuckooIndex.build(rows("a", "b", "a", "c"), 4)
    index = index.delete(rows("b", "zz").select("digest")).insert(rows("a", "d d"))
    sizes = {r.digest: r.group_size for r in index.entries().collect()}
    names = {r.doc_id: r.digest for r in rows("a", "b", "c", "dd").collect()}
    assert sizes == {names[0]: 3, names[2]: 1, names[3]: 1}
