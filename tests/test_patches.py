import random

import pytest
from pyspark.sql import functions as F

import models
from seriesmend.model import SeriesSpec
from seriesmend.plans.history import EditLog
from seriesmend.plans.patches import PatchStore, replay_stored, row_text

SPEC = SeriesSpec(("s",), ("t",), ("i",), "v")
ROWS = 24


@pytest.fixture(scope="module")
def raw(spark):
    rows = [("a" if i % 3 else None, i // 2, i, float(i) if i % 5 else None) for i in range(ROWS)]
    return spark.createDataFrame(rows, "s string, t long, i long, raw double").cache()


def read(frame):
    return {r["i"]: r["new"] for r in frame.collect()}


def patch_of(spark, raw, model, changes):
    keys = {r["i"]: r for r in raw.collect()}
    rows = [(keys[i]["s"], keys[i]["t"], i, model.now[i], v) for i, v in changes.items()]
    return spark.createDataFrame(rows, "s string, t long, i long, old_value double, new_value double")


@pytest.mark.parametrize("seed", range(3))
def test_random_logs_with_snapshots_follow_the_array(spark, raw, tmp_path, seed):
    rng = random.Random(seed)
    model = models.EditedArray([r["raw"] for r in raw.orderBy("i").collect()])
    store, log = PatchStore(spark, f"{tmp_path}/v", SPEC), EditLog()
    for step in range(16):
        kind = rng.choice(["apply", "apply", "apply", "undo", "remove", "restore", "compact", "compact"])
        if kind == "apply":
            changes = {i: rng.choice([None, float(rng.randrange(100))]) for i in rng.sample(range(ROWS), rng.randint(1, 8))}
            assert store.write(patch_of(spark, raw, model, changes), log.next_seq) == len(changes)
            log.apply("replace", points=len(changes))
            model.apply("replace", changes)
        elif kind == "remove":
            at = rng.randrange(4)
            log.remove(at), model.remove(at)
        elif kind == "compact":
            store.compact(log.layers)
        else:
            getattr(log, kind)(), getattr(model, kind)()
        if step % 3 == 2 or step == 15:
            got = read(replay_stored(raw, SPEC, [(store, log.layers, "raw", "new")]))
            assert got == dict(enumerate(model.now)), (seed, step)
    log.reset(), model.reset()
    assert read(replay_stored(raw, SPEC, [(store, log.layers, "raw", "new")])) == dict(enumerate(model.now))
    # what another driver finds in the folder
    again = PatchStore(spark, f"{tmp_path}/v", SPEC)
    assert {s.layers for s in again.snapshots} == {s.layers for s in store.snapshots}
    store.drop()


def test_a_snapshot_is_not_moved_and_many_edits_are_one_join(spark, raw, tmp_path):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        store, log = PatchStore(spark, f"{tmp_path}/v", SPEC), EditLog()
        edits = raw.select("s", "t", "i", F.explode(F.sequence(F.lit(0), F.lit(499), F.lit(25))).alias("at")).select(
            "s", "t", "i", (F.col("at") + F.col("i")).cast("int").alias("_sm_seq"))
        points = store.write_all(edits.filter("_sm_seq < 500").select(
            "*", F.lit(0.0).alias("old_value"), F.col("_sm_seq").cast("double").alias("new_value")))
        for k in range(500):
            log.apply("replace", points=points.get(k, 0))
        assert store.due(log.layers, points)
        store.compact(log.layers)
        assert not store.due(log.layers, points)
        frame = replay_stored(raw, SPEC, [(store, log.layers, "raw", "new")])
        plan = frame._jdf.queryExecution().executedPlan().toString()
        assert plan.count("SortMergeJoin") == 1 and plan.count("Exchange") == 1 and "Bucketed: true" in plan
        assert read(frame) == {i: 475.0 + i for i in range(ROWS)}
        store.drop()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_several_variables_are_one_join(spark, raw, tmp_path):
    logs, stores = [], []
    for n in range(3):
        store, log = PatchStore(spark, f"{tmp_path}/{n}", SPEC), EditLog()
        for k in range(n):
            store.write(raw.filter(F.col("i") % 4 == n).select("s", "t", "i", F.col("raw").alias("old_value"), F.lit(10.0 * n + k).alias("new_value")), k)
            log.apply("replace")
        logs.append(log), stores.append((store, log.layers, "raw", f"new{n}"))
    frame = replay_stored(raw, SPEC, stores)
    assert frame._jdf.queryExecution().optimizedPlan().toString().count("Join LeftOuter") == 1
    for r in frame.collect():
        assert r["new0"] == r["raw"]
        assert r["new1"] == (10.0 if r["i"] % 4 == 1 else r["raw"])
        assert r["new2"] == (21.0 if r["i"] % 4 == 2 else r["raw"])


def test_row_texts_tell_rows_apart(spark):
    rows = [("a", 1, 23), ("a", 12, 3), (None, 1, 23), ("-", 1, 23), ("1:a", 1, 23), ("", 1, 23), (None, None, None), ("a1:1", 2, 3)]
    texts = [r[0] for r in spark.createDataFrame(rows, "s string, t long, i long").select(row_text(SPEC)).collect()]
    assert len(set(texts)) == len(rows) and None not in texts
