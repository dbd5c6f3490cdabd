import random

import pytest

import models
from seriesmend import SeriesSpec
from seriesmend.plans.history import (
    EditLog,
    deleted_rows,
    history_listing,
    log_patch,
    replay,
)

SPEC = SeriesSpec((), ("i",), (), "raw")
KEY = "i int, old_value double, new_value double"


def state(spark, raw, patches, log, ops):
    df = spark.createDataFrame(list(enumerate(raw)), "i int, raw double")
    union = None
    for seq, rows in patches:
        part = log_patch(spark.createDataFrame(rows, KEY), seq)
        union = part if union is None else union.unionByName(part)
    now = {r["i"]: r["corrected"] for r in replay(df, union, log.layers, SPEC).collect()}
    marks = log.deleting_layers(ops)
    gone = set() if union is None or not marks else {
        r["i"] for r in deleted_rows(union, marks, SPEC).collect()
    }
    return [now[i] for i in range(len(raw))], [i in gone for i in range(len(raw))]


class Both:
    """The log under test and the mutable array, driven by the same actions."""

    def __init__(self, raw):
        self.log, self.model = EditLog(), models.EditedArray(raw)
        self.patches, self.ops = [], {}

    def apply(self, op, new):
        if not new:
            return
        edit = self.log.apply(op, op, len(new))
        self.ops[edit.seq] = op
        self.patches.append((edit.seq, [(i, self.model.now[i], v) for i, v in new.items()]))
        self.model.apply(op, new)

    def __getattr__(self, name):
        def act(*args):
            getattr(self.log, name)(*args)
            getattr(self.model, name)(*args)

        return act

    def check(self, spark):
        now, gone = state(spark, self.model.raw, self.patches, self.log, self.ops)
        assert now == self.model.now
        assert gone == self.model.gone


def test_remove_then_undo_brings_back_stale_values(spark):
    both = Both([1.0, 2.0, 3.0, 4.0])
    both.apply("offset", {0: 11.0, 1: 12.0})
    both.apply("multiply", {1: 24.0, 2: 6.0})
    assert both.model.now == [11, 24, 6, 4]
    both.check(spark)
    both.remove(0)
    assert both.model.now == [1, 24, 6, 4]
    both.check(spark)
    both.undo()
    assert both.model.now == [1, 12, 3, 4]
    both.check(spark)
    both.restore()
    assert both.model.now == [11, 12, 3, 4]
    both.check(spark)
    both.reset()
    assert both.model.now == [1, 2, 3, 4]
    both.check(spark)


@pytest.mark.parametrize("seed", range(6))
def test_random_actions(spark, seed):
    rng = random.Random(seed)
    both = Both([float(i) for i in range(6)])
    for _ in range(14):
        action = rng.choice(["apply"] * 5 + ["undo", "remove", "remove", "restore", "reset"])
        if action == "apply":
            op = rng.choice(["delete", "replace"])
            picked = rng.sample(range(6), rng.randint(0, 4))
            both.apply(op, {i: None if op == "delete" else rng.random() for i in picked})
        elif action == "remove":
            both.remove(rng.randint(0, 4))
        elif action == "reset" and rng.random() < 0.7:
            continue
        else:
            getattr(both, action)()
    both.check(spark)


def test_log_records():
    log = EditLog()
    assert log.undo() is None and log.restore() is None and log.remove(0) is None
    assert not log.dirty
    log.apply("offset", "shift", 3)
    assert log.dirty and log.edits[0].points == 3
    log.dirty = False
    log.undo()
    assert log.dirty and not log.edits  # back to raw is still a change


def test_listing(spark):
    log = EditLog()
    first, second = log.apply("offset", "a"), log.apply("delete", "b")
    part = lambda seq, n: log_patch(
        spark.createDataFrame([(i, 1.0, 2.0) for i in range(n)], KEY), seq
    )
    patches = part(first.seq, 3).unionByName(part(second.seq, 2))
    log.remove(0)
    rows = history_listing(patches, log.edits).collect()
    assert [(r["position"], r["op_id"], r["label"], r["points"]) for r in rows] == [(0, "delete", "b", 2)]
