import random

import duckdb
import numpy as np
import pytest
import sentencepiece
from pyspark.sql import functions as F

from seriesmend.llm import mixing, pieces
from seriesmend.llm.queries import ORACLES, QUERIES

MODEL = pieces.PieceModel(open(pieces.MODEL, "rb").read())
LIBRARY = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)


def filled(sizes, weights, share, most):
    """Weights, cut at the caps again and again."""
    total, full = share * sum(sizes), set()
    while True:
        rest = total - sum(most * sizes[i] for i in full)
        open_ = [i for i in range(len(sizes)) if i not in full]
        level = rest / sum(weights[i] for i in open_)
        over = {i for i in open_ if level * weights[i] > most * sizes[i]}
        if not over:
            return [most * s if i in full else level * weights[i] for i, s in enumerate(sizes)]
        full |= over


def random_docs(seed, sources=7, rows=300):
    rng = random.Random(seed)
    docs = []
    for i in range(rows):
        source = rng.choice([None, *[f"s{k}" for k in range(sources) for _ in range(k + 1)]])
        docs.append((i, " ".join("w" * rng.randrange(1, 4) for _ in range(rng.randrange(40))), source))
    return docs


@pytest.mark.parametrize("per_range", [4000, 3])
def test_targets_and_budgets(spark, docs_of, monkeypatch, per_range):
    monkeypatch.setattr(mixing, "ROWS_PER_RANGE", per_range)
    monkeypatch.setattr(mixing, "RANGES_PER_GROUP", 4)
    docs = random_docs(1)
    got = mixing.mix(docs_of(docs), "mix", mixing.words_in()).select("doc_id", "source", "mix.*").collect()
    assert len(got) == len(docs)
    names = sorted({d[2] for d in docs if d[2]}) + [None]
    sizes = [sum(len(d[1].split()) for d in docs if d[2] == n) for n in names]
    want = filled(sizes, [(5, 2, 1)[i % 3] for i in range(len(names))], 1.5, 2)
    for name, size, target in zip(names, sizes, want):
        own = [r for r in got if r.source == name]
        assert {r.source_size for r in own} == {size}
        assert own[0].target == pytest.approx(target)
        assert abs(sum(r.taken for r in own) - target) <= 1
        assert all(0 <= r.taken <= 2 * r.size for r in own)


def test_query_equals_sql(spark, docs_of, folder_of, monkeypatch):
    monkeypatch.setattr(mixing, "ROWS_PER_RANGE", 5)
    folder = folder_of(documents=docs_of(random_docs(2) + [(900, None, "s1"), (901, "", None), (902, "x", "only")]))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet/*.parquet'")
    df = QUERIES["op1_source_mixing"](spark, folder)
    want = con.execute(f"SELECT {', '.join(df.columns)} FROM ({ORACLES['op1_source_mixing']})").fetchall()
    assert {tuple(r) for r in df.collect()} == set(want)


def test_mix_of_odd_tables(spark, docs_of):
    assert mixing.mix(docs_of([]), "mix", mixing.words_in()).count() == 0
    none = mixing.mix(docs_of([(1, None), (2, "")]), "mix", mixing.words_in()).select("mix.*").collect()
    assert {(r.size, r.source_size, r.taken) for r in none} == {(0, 0, 0)}
    docs = docs_of([(None, "a b", None), (None, "a b", None), (5, "c d e", "x")]).withColumn("size_", F.lit(1))
    mixed = mixing.mix(docs, "mix", mixing.words_in())
    assert mixed.columns == [*docs.columns, "mix"] and mixed.count() == 3


def test_copies_hold_the_words_taken(spark, docs_of):
    docs = docs_of([(i, f" a{i}\n\tb{i}  c{i} d{i} ", "big") for i in range(30)] + [(99, "p q r", "small")])
    mixed = mixing.mix(docs, "mix", mixing.words_in()).cache()
    taken = {r.doc_id: r.taken for r in mixed.select("doc_id", "mix.taken").collect()}
    out = mixing.copies(mixed, "mix")
    assert out.columns == docs.columns
    words = {}
    for r in out.collect():
        words[r.doc_id] = words.get(r.doc_id, 0) + len(r.text.split())
        source = next(t for t in (f" a{r.doc_id}\n\tb{r.doc_id}  c{r.doc_id} d{r.doc_id} ", "p q r") if t.startswith(r.text))
        assert source
    assert words == {d: t for d, t in taken.items() if t}


ALPHABET = " \n\tabcdethinongrst éüß中文😀▁-=*0123456789"


def test_encoding_equals_the_library():
    rng = random.Random(4)
    texts = ["", " ", "\n", "a", "▁", "<s>", "<0x0A>", "x" * 5000, " " * 70 + "y", "the " * 3000]
    texts += ["".join(rng.choice(ALPHABET) for _ in range(rng.randrange(60))) for _ in range(3000)]
    for text in texts:
        ids = MODEL.encode(text)
        assert ids.tolist() == LIBRARY.encode(text), text
        assert MODEL.decode(ids) == LIBRARY.decode(ids.tolist()) == MODEL.restored(text)


def test_path_is_what_merging_gives():
    rng = random.Random(5)
    for _ in range(2000):
        text = "".join(rng.choice("▁theandinos") for _ in range(rng.randrange(1, 14)))
        assert [MODEL.pieces[i][0] for i in MODEL.shortest_path(text)] == MODEL.merged(text)


def test_unigram_path_is_the_cheapest():
    def message(*fields):
        out = b""
        for number, value in fields:
            if isinstance(value, float):
                out += bytes([number << 3 | 5]) + np.float32(value).tobytes()
            elif isinstance(value, int):
                out += bytes([number << 3, value])
            else:
                out += bytes([number << 3 | 2, len(value)]) + value
        return out

    scores = {"a": -2.0, "b": -2.5, "ab": -3.0, "ba": -3.5, "aba": -5.9, "▁": -1.0, "▁a": -2.2}
    model = pieces.PieceModel(message(
        (1, message((1, b"<unk>"), (3, 2))),
        *[(1, message((1, p.encode()), (2, s))) for p, s in scores.items()],
        (2, message((3, 1))), (3, message((3, 1), (4, 0)))))

    def cheapest(text):
        if not text:
            return 0.0
        return min(cheapest(text[len(p):]) - s for p, s in scores.items() if text.startswith(p))

    for n in range(1, 40):
        text = "▁" + "".join("ab"[(n * 7 + i * i) % 2] for i in range(n % 12))
        path = model.shortest_path(text)
        assert "".join(model.pieces[i][0] for i in path) == text
        assert -sum(model.pieces[i][1] for i in path) == pytest.approx(cheapest(text))


def test_frames_round_trip(spark, docs_of):
    texts = [None, "", " Hello\n wörld 😀", "x" * 300]
    docs = docs_of(list(enumerate(texts))).withColumn("whole_text", F.lit("kept"))
    ids = pieces.encode(docs)
    assert "text" not in ids.columns and "whole_text" in ids.columns
    back = {r.doc_id: r.text for r in pieces.decode(ids).collect()}
    assert back == {i: t or "" for i, t in enumerate(texts)}
    assert all(r.round_trip for r in pieces.encode_checked(docs).collect())
    assert pieces.encode(docs_of([])).count() == 0


def test_search_ends_with_a_path_through_the_text():
    class Counted(dict):
        asked = 0

        def get(self, *key):
            self.asked += 1
            return super().get(*key)

    with open(pieces.MODEL, "rb") as file:
        model = pieces.PieceModel(file.read())
    word = pieces.MARK + "the"
    model.trie = Counted(model.trie)
    assert model.shortest_path(word) == [model.ids[word]]
    assert model.trie.asked == 1   # a search begins at the text's start alone
