from itertools import permutations

import pytest
from hypothesis import given, settings, strategies as st

from seriesmend.llm import audit

LABELS = "doc_id long, quality int, toxic int"


def conditions(rows):
    """Failure letters of (doc_id, text, source) rows, by the contract's words."""
    out = []
    for doc_id, text, _ in rows:
        text = text or ""
        words = [w for w in text.replace("\n", " ").split(" ") if w]
        same = [r[0] for r in rows if (r[1] or "") == text and r[0] is not None]
        out.append({
            "A": len(words) < 200,
            "B": 100 * len(set(words)) < 50 * len(words),
            "C": 100 * sum("A" <= c <= "Z" for c in text) > 2 * len(text),
            "D": any(c in "#$%&*|" for c in text),
            "E": doc_id is not None and any(other < doc_id for other in same),
        })
    return out


def plain_audit(rows, labels):
    fails = conditions(rows)
    good = {d for d, q, _ in labels if d is not None and q == 1}
    toxic = {d for d, _, t in labels if d is not None and t == 1}
    out, removed_by = {}, {}
    for part in {r[2] or "" for r in rows}:
        for order in permutations("ABCDE"):
            gone = set()
            for s, name in enumerate(order):
                n = dict.fromkeys(audit.MEASURES, 0)
                for i, (doc_id, _, source) in enumerate(rows):
                    if (source or "") != part:
                        continue
                    bad = fails[i][name]
                    removed = bad and i not in gone
                    n["removed"] += removed
                    n["redundant"] += bad and not removed
                    n["unique_fails"] += bad and sum(fails[i].values()) == 1
                    n["good_lost"] += removed and doc_id in good
                    n["toxic_lost"] += removed and doc_id in toxic
                    if removed:
                        gone.add(i)
                    n["kept"] += i not in gone
                out[part, "".join(order), s + 1] = n
                removed_by[part, name] = removed_by.get((part, name), 0) + n["removed"]
    return {k: (*n.values(), removed_by[k[0], k[1][k[2] - 1]]) for k, n in out.items()}


LONG = " ".join(f"w{i}" for i in range(210))
ROWS = [
    (1, LONG, "a"), (2, LONG, "b"), (3, LONG + " #", "a"), (4, "x " * 300, "a"), (5, "SHOUT " * 3, None),
    (6, "", "b"), (7, None, ""), (8, LONG, "a"), (9, "a|B", "c"), (9, "a|B", "c"), (None, LONG, "a"),
    (None, None, "c"), (10, "é" * 99 + "A", "b"), (11, "w " * 100_000 + LONG, "a"), (12, "two\nlines", "b"),
]
KNOWN = [(1, 1, 0), (2, 1, 0), (4, 0, 1), (5, None, 1), (8, 1, None), (8, 0, 1), (None, 1, 1), (99, 1, 1)]


def measured(df):
    return {(r["part"], r["filter_order"], r["step"]): tuple(r[m] for m in (*audit.MEASURES, "shapley")) for r in df.collect()}


def test_audit_equals_plain_loops(spark, docs_of):
    docs = docs_of(ROWS).withColumnRenamed("lang", "mask").withColumnRenamed("n_chars", "Part")   # clashing names
    labels = spark.createDataFrame(KNOWN, LABELS)
    got = audit.audit(docs.repartition(5), labels)
    assert got.count() == 600 * 4
    assert measured(got) == plain_audit(ROWS, KNOWN)


def test_more_parts_than_sums_held(spark, docs_of):
    rows = [(i, "a b", f"s{i % 700}") for i in range(1400)]
    got = audit.audit(docs_of(rows).coalesce(1), spark.createDataFrame([], LABELS))
    first = got.filter("filter_order = 'AEBCD' AND step <= 2")
    assert first.count() == 1400
    # all texts are equal: only the very first isn't a copy
    got = {tuple(r) for r in first.select("removed", "redundant", "kept", "step").collect()}
    assert got == {(2, 0, 0, 1), (0, 1, 0, 2), (0, 2, 0, 2)}


def test_empty_tables(spark, docs_of):
    assert audit.audit(docs_of([]), spark.createDataFrame([], LABELS)).count() == 0


@settings(max_examples=30, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 31), st.booleans(), st.booleans(), st.integers(1, 2**40)), max_size=6))
def test_packed_sums_never_carry(rows):
    total = sum(audit.packed(m, g, t) * n for m, g, t, n in rows)
    fields = audit.unpacked(total)
    for o, order in enumerate(audit.orders()[::17]):
        for s, name in enumerate(order):
            bit, before = "ABCDE".index(name), ["ABCDE".index(x) for x in order[:s]]
            removed = [r for r in rows if r[0] >> bit & 1 and not any(r[0] >> b & 1 for b in before)]
            assert fields[1, o * 17, s] == sum(r[3] for r in removed)
            assert fields[4, o * 17, s] == sum(r[3] for r in removed if r[1])
            assert fields[0, o * 17, s] == sum(r[3] for r in rows if not any(r[0] >> b & 1 for b in (*before, bit)))


@pytest.mark.parametrize("n", [2**63 - 1, 2**62])
def test_a_field_holds_any_row_count(n):
    fields = audit.unpacked(audit.packed(0b00011, True, False) * n)
    assert fields.max() == n and set(fields.reshape(-1).tolist()) == {0, n}
