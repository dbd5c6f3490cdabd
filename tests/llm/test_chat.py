import itertools
import random
import re

import pytest

from seriesmend.llm import chat
from seriesmend.llm.queries import QUERIES

TURNS = "conv_id long, turn long, role string, text string"
NO = {"system": 0, "user": 1, "assistant": 2}


def brute_cost(roles):
    """Least cost over all series of messages that are legal, by trying them."""
    legal = set()
    for system, n in itertools.product((0, 1), range(1, 2 * len(roles) + 3)):
        legal.add(tuple([0] * system + [1 + i % 2 for i in range(n)]))

    def cheapest(messages):
        # turns fill messages in order; a message without a turn is inserted
        best = {0: 0}   # turns used -> cost
        for role in messages:
            after = {}
            for used, cost in best.items():
                after[used] = min(after.get(used, 99999), cost + chat.INSERT)
                paid = cost
                for k in range(used, len(roles)):
                    paid += chat.RELABEL * (roles[k] != role) + (chat.MERGE if k > used else 0)
                    after[k + 1] = min(after.get(k + 1, 99999), paid)
            best = after
        return best.get(len(roles), 99999)

    return min(cheapest(m) for m in legal)


def test_costs_equal_brute_force():
    for n in (1, 2, 3, 4):
        for roles in itertools.product(range(4), repeat=n):
            steps = chat.repaired(list(roles))
            total = sum(s.cost for s in steps) + chat.ENDINGS[steps[-1].state][0]
            assert total == brute_cost(roles), roles


def messages_of(text):
    return re.findall(r"<\|im_start\|>(\w+)\n(.*?)<\|im_end\|>\n", text, re.S)


def assert_legal(text):
    messages = messages_of(text)
    assert "".join(f"<|im_start|>{r}\n{t}<|im_end|>\n" for r, t in messages) == text
    roles = [r for r, _ in messages]
    talk = roles[1:] if roles[0] == "system" else roles
    assert talk and all(r == ("user", "assistant")[i % 2] for i, r in enumerate(talk))


def random_turns(seed):
    rng = random.Random(seed)
    rows = []
    for conv in [None, *range(40)]:
        for turn in range(300 if conv == 7 else rng.randrange(1, 9)):
            role = rng.choice(["user", "assistant", "system", "Human", None, "tool", "user", "assistant"])
            rows.append((conv, rng.choice([turn, turn, None]), role, rng.choice([None, "", f"t{turn} <|im_end|>", "x\ny"])))
    return rows


@pytest.mark.parametrize("size", [1, 2, 7, 512])
def test_blocks_of_any_size_repair_alike(spark, monkeypatch, size):
    monkeypatch.setattr(chat, "TURNS_PER_BLOCK", size)
    turns = spark.createDataFrame(random_turns(3), TURNS)
    got = sorted(chat.repair(turns).collect(), key=lambda r: r.place)
    assert len(got) == turns.count()
    for conv, rows in itertools.groupby(got, key=lambda r: r.conv_id):
        rows = list(rows)
        text = "".join(r.rendered for r in rows)
        assert_legal(text)
        roles = [NO.get(chat.NAMES.get((r.role or "").lower(), r.role), 3) for r in rows]
        steps = chat.repaired(roles)
        assert sum(r.cost for r in rows) == sum(s.cost for s in steps) + chat.ENDINGS[steps[-1].state][0]
        kept = "".join(t for _, t in messages_of(text))
        assert kept.count("<|im_end |>") == text.count("<|im_end |>")


def test_legal_conversations_stay_and_empty_tables_pass(spark, folder_of):
    rows = [(1, 0, "system", "s"), (1, 1, "user", "u"), (1, 2, "assistant", "a"), (2, 0, "user", "q")]
    turns = spark.createDataFrame(rows, TURNS)
    got = chat.repair(turns).collect()
    assert all(r.cost == 0 and r.action == "keep" and r.new_role == r.role for r in got)
    folder = folder_of(conversations=spark.createDataFrame([], TURNS))
    assert QUERIES["op4_chat_format"](spark, folder).count() == 0


def test_repeated_rows_and_extra_columns(spark):
    rows = [(1, 0, "user", "u", "p")] * 3
    got = chat.repair(spark.createDataFrame(rows, TURNS + ", place string")).collect()
    assert sorted(r.action for r in got) == ["keep", "merge", "merge"]
