import math
import random

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from hypothesis.extra import numpy as hn
from pyspark.sql import functions as F

from seriesmend.llm import negatives

VECTORS = "vec_id long, embedding array<float>, label int"


def plain_mine(rows, every=100, scale=256, band=(30, 90, 100), k=(5, 10)):
    """The same by plain loops over (vec_id, embedding, label)."""
    taken = [
        (i, v, label, [math.floor(scale * x) for x in v])
        for i, (v, label, v_id) in enumerate((r[1], r[2], r[0]) for r in rows)
        if v is not None and label is not None and all(x is not None and math.isfinite(x) for x in v)
    ]
    ids = [r[0] for r in rows]
    late = float("inf")
    out = []
    for i, _, label, a in taken:
        if ids[i] is None or ids[i] % every:
            continue
        scored = sorted(
            ((sum(x * y for x, y in zip(a, b)), ids[j], l2) for j, _, l2, b in taken if j != i),
            key=lambda t: (-t[0], late if t[1] is None else t[1]),
        )
        for ps, p_id, _ in [t for t in scored if t[2] == label][: k[0]]:
            inside = [t for t in scored if t[2] != label and band[0] * ps <= band[2] * t[0] <= band[1] * ps]
            for rank, (ns, n_id, _) in enumerate(inside[: k[1]], 1):
                out.append((ids[i], p_id, rank, n_id, ps, ns))
    return sorted(out, key=str)


def mined(df, **more):
    return sorted(map(tuple, negatives.mine(df, F.col("vec_id") % 100 == 0, **more).collect()), key=str)


def example(n, seed, dims=11):
    draw = random.Random(seed)
    base = [[np.float32(draw.uniform(-1, 1)).item() for _ in range(dims)] for _ in range(6)]
    return [(i, [np.float32(x + draw.gauss(0, 0.4)).item() for x in draw.choice(base)], draw.randrange(3)) for i in range(n)]


def test_equals_plain_loops(spark):
    rows = example(420, 1)
    rows += rows[:40]                                    # repeated rows, an anchor among them
    rows += [(500, rows[3][1], 1)] * 3                   # ties
    rows += [(600, None, 1), (700, rows[5][1], None), (800, [0.1] * 10 + [None], 1), (900, [math.nan] * 11, 2)]
    rows += [(1000, [math.inf] + [0.0] * 10, 0), (1100, [], 0), (1200, [0.5] * 3, 1), (None, rows[7][1], 2)]
    rows += [(1300, [9.75] * 11, 1), (-100, rows[9][1], 2)]
    df = spark.createDataFrame(rows, VECTORS).withColumn("row", F.lit("x")).withColumn("BITS", F.lit(1))
    got = mined(df.repartition(3))
    assert got == plain_mine(rows) and len(got) > 100


def test_many_small_cells_give_the_same(spark, monkeypatch):
    rows = example(900, 2)
    df = spark.createDataFrame(rows, VECTORS)
    monkeypatch.setattr(negatives, "ANCHORS_PER_CELL", 3)
    monkeypatch.setattr(negatives, "ROWS_PER_CELL", 70)
    assert mined(df) == plain_mine(rows)


def test_one_vector_for_a_third_of_all_rows(spark):
    rows = example(600, 3)
    rows += [(1000 + i, rows[0][1], i % 2) for i in range(300)]
    assert mined(spark.createDataFrame(rows, VECTORS)) == plain_mine(rows)


def test_empty_tables_and_no_anchor(spark):
    assert mined(spark.createDataFrame([], VECTORS)) == []
    assert mined(spark.createDataFrame(example(50, 4)[1:], VECTORS)) == []
    assert mined(spark.createDataFrame([(0, [0.5], 1), (1, [0.5], 1)], VECTORS)) == []


def test_scores_beyond_63_bits_stop_with_a_message(spark):
    rows = [(0, [1e12, 1e12], 1), (1, [1e12, 1e12], 1)]
    with pytest.raises(Exception, match="63 bits"):
        mined(spark.createDataFrame(rows, VECTORS))


whole = lambda rows: hn.arrays(np.int64, st.tuples(rows, st.just(13)), elements=st.integers(-(2**24), 2**24))


@settings(max_examples=60, deadline=None)
@given(whole(st.integers(1, 9)), whole(st.integers(1, 9)))
def test_table_scores_are_inner_products(a, b):
    bits = negatives.pack(b)
    assert (negatives.unpack(bits)[:, :13] == b).all()
    sums = negatives.subset_sums(negatives.unpack(negatives.pack(a)), bits.shape[2])
    assert (negatives.scores(sums, bits.transpose(1, 2, 0)) == b @ a.T).all()


@settings(max_examples=60, deadline=None)
@given(hn.arrays(np.int64, (57, 4), elements=st.integers(-4, 4)), st.integers(1, 6))
def test_best_keeps_the_first_of_equal_scores(total, k):
    best = negatives.Best(k, 4)
    for at in range(0, 57, 10):
        best.offer(total[at: at + 10], np.arange(at, min(at + 10, 57)))
    for column in range(4):
        want = sorted(range(57), key=lambda i: (-total[i, column], i))[:k]
        assert best.place[:, column].tolist() == want
