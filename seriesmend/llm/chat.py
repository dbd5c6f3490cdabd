"""Chat formatting with the cheapest repair of the roles.

Legal conversations are those an automaton accepts: at most one system turn, then
user and assistant turns in alternation, beginning with the user.  Each turn may be
kept, merged into the message before it, relabelled, or preceded by empty messages;
dynamic programming over the automaton's states picks the cheapest series of these.

Turns are numbered in one global order and cut into blocks of equal size.  What a
block does to a conversation that crosses its edges is a matrix of least costs from
state to state; the matrices of a conversation, one per block, are chained forwards
for the costs and backwards for the states at the edges.  Every block can then be
repaired on its own, so that one endless conversation is many tasks.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from seriesmend.llm.common import partitions_for, quoted
from seriesmend.model import SeriesSpec
from seriesmend.plans.blocks import number_rows
from seriesmend.plans.staging import stage

TURNS_PER_BLOCK = 512
ROLES = ("system", "user", "assistant")
OTHER = len(ROLES)                      # a role that is none of them
NAMES = {"human": "user", "prompter": "user", "bot": "assistant", "gpt": "assistant", "model": "assistant"}
START, SYSTEM, USER, ASSISTANT = range(4)   # states: the role of the last message
STATES = 4
NEXT = {START: (SYSTEM, USER), SYSTEM: (USER,), USER: (ASSISTANT,), ASSISTANT: (USER,)}
FINAL = (USER, ASSISTANT)
MERGE, INSERT, RELABEL = 1, 3, 4        # what a repair costs
NEVER = 1 << 40


@dataclass(frozen=True)
class Step:
    """How a turn moves the automaton: empty messages first, then the turn itself."""

    cost: int
    inserted: tuple[int, ...]
    state: int
    merged: bool
    relabelled: bool


def _insertions(state: int) -> dict[int, tuple[int, ...]]:
    """The states that empty messages lead to, with the shortest series of them."""
    found, edge = {state: ()}, [state]
    while edge:
        nearer = []
        for s in edge:
            for t in NEXT[s]:
                if t not in found:
                    found[t] = (*found[s], t)
                    nearer.append(t)
        edge = nearer
    return found


def _steps(state: int, role: int) -> dict[int, Step]:
    """The cheapest step to each state; of equals, the one with fewer repairs."""
    best: dict[int, Step] = {}

    def offer(step: Step) -> None:
        old = best.get(step.state)
        if old is None or (step.cost, len(step.inserted), step.relabelled, step.merged) < (
                old.cost, len(old.inserted), old.relabelled, old.merged):
            best[step.state] = step

    for between, empty in _insertions(state).items():
        paid = INSERT * len(empty)
        if between != START and not empty:   # into the message before
            other = between - 1 != role
            offer(Step(MERGE + RELABEL * other, empty, between, True, other))
        for after in NEXT[between]:
            other = after - 1 != role
            offer(Step(paid + RELABEL * other, empty, after, False, other))
    return best


STEPS = [[_steps(state, role) for state in range(STATES)] for role in range(OTHER + 1)]
COSTS = np.full((OTHER + 1, STATES, STATES), NEVER, np.int64)
for _role, _state in itertools.product(range(OTHER + 1), range(STATES)):
    for _to, _step in STEPS[_role][_state].items():
        COSTS[_role, _state, _to] = _step.cost
ENDINGS = {s: min(((INSERT * len(e), e) for t, e in _insertions(s).items() if t in FINAL), key=lambda x: x[0])
           for s in range(STATES)}
END_COST = np.array([ENDINGS[s][0] for s in range(STATES)], np.int64)


def chained(costs: np.ndarray, roles: list[int]) -> list[np.ndarray]:
    """Costs per state before the first turn and after each (tropical products)."""
    out = [costs]
    for role in roles:
        out.append((out[-1][..., :, None] + COSTS[role]).min(axis=-2))
    return out


def repaired(roles: list[int], entry: int = START, leave: int | None = None) -> list[Step]:
    """The cheapest steps from ``entry`` to ``leave`` (None: to the cheapest end)."""
    costs = np.full(STATES, NEVER, np.int64)
    costs[entry] = 0
    along = chained(costs, roles)
    state = int(np.argmin(along[-1] + END_COST)) if leave is None else leave
    steps = []
    for i in range(len(roles) - 1, -1, -1):
        before = int(np.argmin(along[i] + COSTS[roles[i]][:, state]))
        steps.append(STEPS[roles[i]][before][state])
        state = before
    return steps[::-1]


def escaped(text: str) -> str:
    """A text that cannot open or close a message."""
    return text.replace("<|im_start|>", "<|im_start |>").replace("<|im_end|>", "<|im_end |>")


def rendered(step: Step, text: str, first: bool, last: bool) -> str:
    """A turn's part of its conversation; the parts in order are the whole."""
    opened = lambda state: f"<|im_start|>{ROLES[state - 1]}\n"
    out = []
    if not (first or step.merged):
        out.append("<|im_end|>\n")
    out += [opened(s) + "<|im_end|>\n" for s in step.inserted]
    out.append("\n" if step.merged else opened(step.state))
    out.append(escaped(text))
    if last:
        out.append("<|im_end|>\n")
        out += [opened(s) + "<|im_end|>\n" for s in ENDINGS[step.state][1]]
    return "".join(out)


def _runs(batches: Iterator[pd.DataFrame], key: str) -> Iterator[pd.DataFrame]:
    """The rows of one ``key`` at a time, from batches sorted by it."""
    held: list[pd.DataFrame] = []
    for batch in batches:
        if not len(batch):
            continue
        values = batch[key].to_numpy()
        cuts = [0, *(np.flatnonzero(values[1:] != values[:-1]) + 1).tolist(), len(batch)]
        for a, b in zip(cuts, cuts[1:]):
            if held and held[-1][key].iat[0] != values[a]:
                yield pd.concat(held) if len(held) > 1 else held[0]
                held = []
            held.append(batch.iloc[a:b])
    if held:
        yield pd.concat(held) if len(held) > 1 else held[0]


MATRIX = "conv string, block long, costs array<long>"
EDGE = "conv string, block long, first boolean, last boolean, entry int, leave int"


def _edge_matrices(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Per block: what it does to its first and its last conversation."""
    for rows in _runs(batches, "block"):
        out = []
        convs = rows["conv"].to_numpy()
        for conv in dict.fromkeys((convs[0], convs[-1])):
            along = chained(np.where(np.eye(STATES, dtype=bool), 0, NEVER), rows["role_no"][convs == conv].tolist())
            out.append((conv, int(rows["block"].iat[0]), np.minimum(along[-1], NEVER).ravel()))
        yield pd.DataFrame(out, columns=["conv", "block", "costs"])


def _forward(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Adds the costs at the start of each block, conversation by conversation."""
    conv, costs = None, None
    for batch in batches:
        starts = []
        for own, matrix in zip(batch["conv"], batch["costs"]):
            if own != conv:
                conv, costs = own, np.array([0, *[NEVER] * (STATES - 1)], np.int64)
            starts.append(costs)
            costs = np.minimum((costs[:, None] + np.asarray(matrix, np.int64).reshape(STATES, STATES)).min(axis=0), NEVER)
        yield batch.assign(start=starts)


def _backward(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """From a conversation's last block to its first: the states at the edges."""
    conv, state = None, None
    for batch in batches:
        out = []
        for own, block, matrix, start in zip(batch["conv"], batch["block"], batch["costs"], batch["start"]):
            total = np.asarray(start, np.int64)[:, None] + np.asarray(matrix, np.int64).reshape(STATES, STATES)
            last = own != conv
            if last:
                conv, state = own, int(np.argmin(total.min(axis=0) + END_COST))
            entry = int(np.argmin(total[:, state]))
            out.append((own, block, entry == START, last, entry, state))
            state = entry
        yield pd.DataFrame(out, columns=["conv", "block", "first", "last", "entry", "leave"])


OUT = (
    "place long, action string, new_role string, inserted int, cost int, rendered string"
)


def _repair_blocks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Blocks of turns, each after the edge rows that concern it."""
    for rows in _runs(batches, "block"):
        is_edge = rows["is_edge"].to_numpy(bool)
        edges = {r.conv: r for r in rows[is_edge].itertuples()}
        turns = rows[~is_edge]
        out = []
        convs = turns["conv"].to_numpy()
        cuts = [0, *(np.flatnonzero(convs[1:] != convs[:-1]) + 1).tolist(), len(turns)]
        roles, texts, places = turns["role_no"].tolist(), turns["text"].tolist(), turns["place"].tolist()
        for a, b in zip(cuts, cuts[1:]):
            edge = edges.get(convs[a])
            if edge is None:
                steps, first, last = repaired(roles[a:b]), True, True
            else:
                steps = repaired(roles[a:b], int(edge.entry), int(edge.leave))
                first, last = bool(edge.first), bool(edge.last)
            for i, step in enumerate(steps):
                ends = last and a + i == b - 1
                action = "merge" if step.merged else "relabel" if step.relabelled else "keep"
                if step.merged and step.relabelled:
                    action = "relabel and merge"
                inserted = len(step.inserted) + (len(ENDINGS[step.state][1]) if ends else 0)
                cost = step.cost + (ENDINGS[step.state][0] if ends else 0)
                text = rendered(step, texts[a + i], first and i == 0, ends)
                out.append((places[a + i], action, ROLES[step.state - 1], inserted, cost, text))
        yield pd.DataFrame(out, columns=[c.split()[0] for c in OUT.split(", ")])


def repair(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role",
           text: str = "text") -> DataFrame:
    """One row per turn: conv_id, turn, role, place, action, new_role, inserted, cost, rendered.

    ``place`` orders all rows; the ``rendered`` parts of a conversation in this order
    are the repaired conversation.  ``inserted`` counts the empty messages before the
    turn (and, at the last turn, after it), ``cost`` is the turn's share of the least
    cost.  Turns are ordered by turn (null last), then role and text; a null conv_id
    is a conversation of its own; a null text is empty; a null or unknown role costs
    a relabelling.
    """
    named = F.lower(F.trim(quoted(role).cast("string")))
    for other, meant in NAMES.items():
        named = F.when(named == other, F.lit(meant)).otherwise(named)
    number = F.lit(OTHER)
    for i, known in enumerate(ROLES):
        number = F.when(named == known, F.lit(i)).otherwise(number)
    rows = turns.select(
        quoted(conv_id).alias("conv_id"), quoted(turn).alias("turn"), quoted(role).alias("role"),
        quoted(text).cast("string").alias("text"), number.cast("int").alias("role_no"),
        F.coalesce(F.concat(F.lit("="), quoted(conv_id).cast("string")), F.lit("")).alias("conv"),
    )
    spec = SeriesSpec(("conv",), ("turn",), ("role", "text"))
    placed = stage(
        number_rows(rows, spec, partitions_for(turns)).withColumnRenamed("_rn", "place")
        .withColumn("block", F.floor(F.col("place") / TURNS_PER_BLOCK)).select(
            "conv_id", "turn", "role", "role_no", "conv", "place", "block", F.coalesce("text", F.lit("")).alias("text"))
    )
    by_block = placed.select("conv", "block", "place", "role_no").repartition("block").sortWithinPartitions("block", "place")
    matrices = by_block.mapInPandas(_edge_matrices, MATRIX)
    forward = matrices.repartition("conv").sortWithinPartitions("conv", "block").mapInPandas(
        _forward, MATRIX + ", start array<long>")
    forward = stage(forward)
    edges = forward.repartition("conv").sortWithinPartitions("conv", F.desc("block")).mapInPandas(_backward, EDGE)
    nothing = lambda kind, name: F.lit(None).cast(kind).alias(name)
    mixed = placed.select(
        "block", F.lit(False).alias("is_edge"), "place", "conv", "role_no", "text", nothing("boolean", "first"),
        nothing("boolean", "last"), nothing("int", "entry"), nothing("int", "leave"),
    ).unionAll(edges.select(
        "block", F.lit(True).alias("is_edge"), nothing("long", "place"), "conv", nothing("int", "role_no"),
        nothing("string", "text"), "first", "last", "entry", "leave",
    ))
    done = (
        mixed.repartition("block").sortWithinPartitions("block", F.desc("is_edge"), "place")
        .withColumns({"place": F.coalesce("place", F.lit(-1)), "role_no": F.coalesce("role_no", F.lit(-1)),
                      "entry": F.coalesce("entry", F.lit(-1)), "leave": F.coalesce("leave", F.lit(-1))})
        .mapInPandas(_repair_blocks, OUT)
    )
    return placed.select("conv_id", "turn", "role", "place").join(done, "place")
