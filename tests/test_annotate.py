import datetime
import random

import pytest
from pyspark.sql import functions as F

from seriesmend.operators import annotate
from seriesmend.plans.blocks import Layout
from seriesmend.sources.annotations import (
    annotation_geometry,
    annotation_text,
    annotations_for_table,
    load_annotations,
    normalize_annotations,
)

DAY = datetime.datetime(1969, 12, 31, 12)  # around the epoch: both signs


def at(seconds):
    return DAY + datetime.timedelta(seconds=seconds)


def first_hit(x, notes, tolerance):
    for no, start, end in notes:
        if end is None or end == start:
            if abs(x - start) <= tolerance:
                return no
        elif min(start, end) <= x <= max(start, end):
            return no
    return None


def noted(spark, notes):
    rows = [(no, at(s), None if e is None else at(e), f"n{no}") for no, s, e in notes]
    schema = "event_no int, start timestamp_ntz, `end` timestamp_ntz, label string"
    return annotation_geometry(normalize_annotations(spark.createDataFrame(rows, schema)))


@pytest.mark.parametrize("few", [100_000, 0], ids=["broadcast", "carried"])
@pytest.mark.parametrize("layout", [Layout("plain"), Layout("blocked", block_rows=37)], ids=str)
@pytest.mark.parametrize("tolerance", [0.0, 40.0])
def test_first_annotation(spark, few, layout, tolerance):
    rng = random.Random(11)
    notes = [(0, 50_000, 50_300), (1, 43_100, 43_300)]
    for no in range(2, 40):
        start = rng.randint(0, 86_000)
        end = rng.choice([None, start, start + rng.randint(1, 20_000), start - rng.randint(1, 300)])
        notes.append((no, start, end))
    points = [rng.randint(-100, 90_000) for _ in range(300)]
    points += [p for _, s, e in notes for p in (s, s - 1, s + 1, (e or s), (e or s) + 1)]
    rows = [(i, at(p)) for i, p in enumerate(points)]
    readings = spark.createDataFrame([*rows, (-1, None)], "i int, ts timestamp_ntz")
    found = annotate.annotate_first(
        readings, noted(spark, notes), "ts", ("event_no",), ("event_no", "label"), tolerance,
        layout=layout, few=few,
    ).collect()
    got = {r["i"]: r["event_no"] for r in found}
    assert len(found) == len(points) + 1
    assert got.pop(-1) is None
    assert got == {i: first_hit(p, notes, tolerance) for i, p in enumerate(points)}
    assert all(r["label"] == (None if r["event_no"] is None else f"n{r['event_no']}") for r in found)


@pytest.mark.parametrize("few", [100_000, 1])
def test_only_size_decides_how_stretches_are_met(spark, monkeypatch, few):
    """Crowds of short annotations and one far away leave the broadcast as it is."""
    far = 6 * 10**11   # seconds: tens of thousands of years
    notes = [(500, 0, 80_000), (501, far, far + 5), *((k, 40_000 + 2 * k, 40_001 + 2 * k) for k in range(200))]
    used = []
    carried = annotate._carried_along
    monkeypatch.setattr(
        annotate, "_carried_along", lambda *a: used.append(1) or carried(*a)
    )
    points = list(range(39_990, 40_420))
    readings = spark.createDataFrame(list(enumerate(map(at, points))), "i int, ts timestamp_ntz")
    table = spark.createDataFrame(
        [(n, "period", float(a), float(b)) for n, a, b in notes], "event_no int, shape string, a double, b double"
    ).select("event_no", "shape", *[
        F.timestamp_micros((F.unix_micros(F.lit(DAY).cast("timestamp")) + F.col(c) * 1000000).cast("long"))
        .cast("timestamp_ntz").alias(n) for c, n in (("a", "lo"), ("b", "hi"))])
    found = annotate.annotate_first(readings, table, "ts", ("event_no",), ("event_no",), few=few)
    ranked = sorted(notes)
    assert {r["i"]: r["event_no"] for r in found.collect()} == {
        i: first_hit(p, ranked, 0) for i, p in enumerate(points)
    }
    assert bool(used) == (few == 1)


@pytest.mark.parametrize("ends", [3, 40, 100_000], ids=str)
def test_stretches_begin_where_the_first_annotation_changes(spark, ends):
    """Whatever the ranges of the sweep are; many share a time, and a long one comes early."""
    rng = random.Random(5)
    notes = [(5, 1_000, 90_000), *((n, 30_000, 30_000 + n) for n in range(100, 130)), *((n, 30_000 - n, 30_000) for n in range(60, 80))]
    notes += [(n, a := rng.randint(0, 100_000), rng.choice([None, a + rng.randint(1, 3_000)])) for n in rng.sample(range(200, 400), 60)]
    notes += [(n, a := rng.randint(0, 100_000), a + 40) for n in range(4)]
    found = annotate.covered_stretches(noted(spark, notes), ("event_no",), ("event_no", "label"), ends_per_range=ends)
    epoch = int((DAY - datetime.datetime(1970, 1, 1)).total_seconds())
    stretches = sorted((r["at"], r["hit"] and r["hit"]["event_no"]) for r in found.collect())
    moments = sorted({m for _, s, e in notes for m in (at(s), at(s) + datetime.timedelta(microseconds=1), at(e or s), at(e or s) + datetime.timedelta(microseconds=1))})
    ranked = [(no, at(s), at(s if e is None else e)) for no, s, e in sorted(notes)]
    want = []
    for m in moments:
        no = next((no for no, low, high in ranked if min(low, high) <= m <= max(low, high)), None)
        micros = (m - datetime.datetime(1970, 1, 1)) // datetime.timedelta(microseconds=1)
        if no is not None and not want or want and want[-1][1] != no:
            want.append((micros, no))
    # a range repeats what it begins with
    assert [s for i, s in enumerate(stretches) if i == 0 or stretches[i - 1][1] != s[1]] == want
    assert len({a for a, _ in stretches}) == len(stretches) and stretches[0][0] >= epoch * 10**6
    if ends == 100_000:
        assert stretches == want


@pytest.mark.parametrize("ends", [4, 100_000], ids=str)
def test_instants_that_overlap_by_their_tolerance_are_few_stretches(spark, ends):
    notes = [(n, 60 * n, None) for n in range(50)]   # each within 90 seconds of the next
    found = annotate.covered_stretches(noted(spark, notes), ("event_no",), ("event_no",), 90.0, ends).collect()
    day = (DAY - datetime.datetime(1970, 1, 1)) // datetime.timedelta(microseconds=1)
    stretches = sorted((r["at"] - day, r["hit"] and r["hit"]["event_no"]) for r in found)
    changes = [s for i, s in enumerate(stretches) if i == 0 or stretches[i - 1][1] != s[1]]
    ends_of = [(n + 1.5) * 60 * 10**6 + 1 for n in range(50)]   # each is shown to the end of the one before
    assert changes == [(-90 * 10**6, 0), *zip(ends_of, range(1, 50)), (ends_of[-1], None)]
    assert len(stretches) <= 51 + 100 / ends * 2


def test_what_the_driver_would_hold_is_bounded_by_its_size(spark, monkeypatch):
    """Twenty labels of a megabyte are not broadcast."""
    used = []
    carried = annotate._carried_along
    monkeypatch.setattr(annotate, "_carried_along", lambda *a: used.append(1) or carried(*a))
    notes = noted(spark, [(n, 10 * n, 10 * n + 5) for n in range(20)]).withColumn("label", F.repeat(F.lit("x"), 2**20))
    readings = spark.createDataFrame([(n, at(10 * n + 7 * (n % 2))) for n in range(20)], "i int, ts timestamp_ntz")
    found = annotate.annotate_first(readings, notes, "ts", ("event_no",), ("event_no", "label"), keep=("i",))
    got = {r["i"]: (r["event_no"], r["n"]) for r in found.select("i", "event_no", F.length("label").alias("n")).collect()}
    assert used and got == {n: (None, None) if n % 2 else (n, 2**20) for n in range(20)}


def test_no_annotations(spark):
    readings = spark.createDataFrame([(1, at(0))], "i int, ts timestamp_ntz")
    found = annotate.annotate_first(
        readings, noted(spark, [(0, 0, 1)]).filter("false"), "ts", ("event_no",), ("label",)
    )
    assert [tuple(r) for r in found.collect()] == [(1, at(0), None)]


def test_annotation_file(spark, tmp_path):
    path = str(tmp_path / "notes.csv")
    with open(path, "w") as f:
        f.write("start,end,table,label,category,description\n")
        f.write("2024-01-01 10:00:00,,t1,power,,\n")
        f.write("2024-01-01T11:00:00,2024-01-01T10:00:00,*,swap,check,new probe\n")
        f.write("2024-01-02,2024-01-02 00:00:00,t2,other,,\n")
        f.write("rubbish,2024-01-02,,lost,,\n")
    notes = load_annotations(spark, path)
    flags = [(r["label"], r["is_punctual"]) for r in notes.orderBy("event_no").collect()]
    # an end without a start: neither true nor false
    assert flags == [("power", True), ("swap", False), ("other", True), ("lost", None)]
    assert [r["label"] for r in annotations_for_table(notes, "t1").orderBy("event_no").collect()] == [
        "power", "swap",
    ]
    shown = annotation_geometry(notes).orderBy("event_no")
    assert [r["shape"] for r in shown.collect()] == ["instant", "period", "instant"]
    swap = shown.filter("label = 'swap'").first()
    assert swap["lo"] < swap["hi"]
    text = annotation_text(F.col("label"), F.col("category"), F.col("description"))
    assert [r[0] for r in shown.select(text).collect()] == [
        "power", "swap  [check]\nnew probe", "other",
    ]


def test_annotation_table_needs_a_start(spark):
    with pytest.raises(ValueError, match="start"):
        normalize_annotations(spark.createDataFrame([(1,)], "begin int"))
    # numbers are not times here, unlike on the time axis
    plain = normalize_annotations(spark.createDataFrame([(1704067200,)], "start int"))
    assert plain.first()["start_dt"] is None and "table" not in plain.columns
    assert annotations_for_table(plain, "any").count() == 1
