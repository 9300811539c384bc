from __future__ import annotations

import random

import numpy as np
import pytest

from recordloom.operators import threads


def fold(messages, memory):
    """What a thread does, message by message."""
    history, sent = [], {}
    for turn, role, text in messages:
        if role == "system" or (role == "user" and text.strip() == ""):
            continue
        history.append((role, text))
        if role == "user":
            if len(history) > memory:
                history = history[2:]
            sent[turn] = list(history)
    return sent, history


def random_thread(rng, length):
    """User messages, at most one answer after each, some blanks."""
    rows, may_answer = [(0, "system", "sys")], False
    turn = 1
    while len(rows) < length:
        turn += rng.choice([1, 1, 2])
        if may_answer and rng.random() < 0.7:
            rows.append((turn, "assistant", f"a{turn}"))
            may_answer = False
        elif rng.random() < 0.15:
            rows.append((turn, "user", " \n "))
        else:
            rows.append((turn, "user", f"u{turn}"))
            may_answer = True
    return rows


@pytest.mark.parametrize("memory", [2, 3, 4, 5, 20, 40, 901])
def test_history_matches_the_fold(spark, monkeypatch, memory):
    monkeypatch.setattr(threads, "WINDOW_BLOCK", 24)
    rng = random.Random(memory)
    conversations = {c: random_thread(rng, rng.choice([3, 8, 60])) for c in range(25)}
    conversations[99] = random_thread(rng, 700)
    rows = [(c, *m) for c, messages in conversations.items() for m in messages]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    found = {
        (r.conv_id, r.turn): [(m.role, m.content) for m in r.history]
        for r in threads.histories(df, memory).collect()
    }
    expected = {
        (c, turn): history
        for c, messages in conversations.items()
        for turn, history in fold(messages, memory)[0].items()
    }
    assert found == expected
    snapshots = {
        r.thread_id: [(m.role, m.content) for m in r.chat_history or []]
        for r in threads.snapshots(df, "agent", memory).collect()
    }
    held = {c: fold(messages, memory)[1] for c, messages in conversations.items()}
    assert snapshots == {c: h for c, h in held.items() if h}


def test_chunks_join_in_order(spark):
    rows = [(1, 1, i, None if i == 3 else f"<{i}>") for i in range(12)]
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame(rows, "conv_id long, turn long, seq long, delta string")
    row = threads.assemble_chunks(df).first()
    assert row.text == "".join(f"<{i}>" for i in range(12) if i != 3)
    assert row.pieces == 12


def any_thread(rng, length, answers):
    """Messages in any order of roles."""
    roles = ["user", *["assistant"] * answers, "system"]
    rows = [(2 * i, rng.choice(roles)) for i in range(length)]
    return [(turn, role, rng.choice([f"m{turn}", " "]) if role == "user" else f"m{turn}") for turn, role in rows]


@pytest.mark.parametrize("memory", [1, 2, 4, 7])
def test_history_of_any_order_of_roles_matches_the_fold(spark, monkeypatch, memory):
    rng = random.Random(memory)
    conversations = {c: any_thread(rng, rng.choice([1, 6, 40]), 1 + c % 3) for c in range(20)}
    conversations[50] = random_thread(rng, 30)
    # One question, five answers, a question: the history outgrows the memory.
    conversations[51] = [(0, "user", "q"), *((i, "assistant", f"a{i}") for i in range(1, 6)), (6, "user", "r")]
    conversations[99] = any_thread(rng, 5_000, 1)
    rows = [(c, *m) for c, messages in conversations.items() for m in messages]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    found = threads.histories(df, memory).collect()
    expected = {
        (c, turn): history
        for c, messages in conversations.items()
        for turn, history in fold(messages, memory)[0].items()
    }
    assert {(r.conv_id, r.turn): [(m.role, m.content) for m in r.history] for r in found} == expected
    assert len(found) == len(expected)


def test_block_functions_are_walks():
    rng = np.random.default_rng(2)
    for size in (1, 5, 40):
        for memory in (1, 4, 9):
            users = rng.random(size) < rng.random()
            starts, added, above = threads.block_function(users, memory)
            before = np.arange(memory + 3 * size)
            after = threads.walk(users, memory, before)
            for length, want in zip(before.tolist(), after.tolist(), strict=True):
                beyond = length >= memory + size
                at = np.searchsorted(starts, length, side="right") - 1
                assert length + (above if beyond else added[at]) == want
