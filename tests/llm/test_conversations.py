import json
import random

import brute
import pytest

from logweave.llm.conversations import conversation_verdicts, conversations, read_entries

SCHEMA = "transcript_id string, generation int, seq long, at_s double, v string, type string, role string"


def entry(uuid, parent, role, at, content="hi", side=False, kind=None):
    return json.dumps({"uuid": uuid, "parentUuid": parent, "timestamp": f"2026-01-01T00:00:{at:02d}.000Z", "type": kind or role,
                       "isSidechain": side, "message": {"role": role, "content": content}})


def verdicts(spark, rows, partitions=3):
    df = spark.createDataFrame([(t, g, s, None, v, "x", "y") for t, g, s, v in rows], SCHEMA)
    return {(r[0], r[1]): r[2] for r in conversation_verdicts(read_entries(df), partitions).collect()}


def test_each_reason(spark):
    rows = [
        ("ok", 0, 1, entry("a", None, "user", 1)), ("ok", 0, 2, entry("b", "a", "assistant", 2, [{"type": "tool_use"}])), ("ok", 0, 2, entry("b", "a", "assistant", 2, [{"type": "tool_use"}])),
        ("empty", 0, 1, entry("c", None, "user", 1, " \n")), ("empty", 0, 2, entry("d", "c", "assistant", 2, [])), ("empty", 0, 3, entry("d2", "gone", "assistant", 2, [{"type": "text", "text": " "}])),
        ("broken", 0, 1, entry("e", "gone", "user", 1)), ("broken", 0, 2, entry("f", "e", "assistant", 2)),
        ("role", 0, 1, entry("g", None, "system", 1, kind="user")), ("opens", 0, 1, entry("h", None, "assistant", 1)),
        ("last", 0, 1, entry("i", None, "user", 1)), ("last", 0, 2, entry("j", "i", "assistant", 2)), ("last", 0, 3, entry("k", "j", "user", 3)),
        ("twice", 0, 1, entry("l", None, "user", 1)), ("twice", 0, 2, entry("m", "l", "user", 2)), ("twice", 0, 3, entry("n", "m", "assistant", 3)),
        ("side", 0, 1, entry("o", None, "user", 1, side="true")), ("side", 0, 2, entry("p", "o", "assistant", 2, side=True)), ("side", 0, 3, entry("q", "o", "user", 3)),
        ("torn", 0, 1, "{"), ("torn", 0, 2, None), (None, 0, 1, entry("r", None, "user", 1)),
    ]
    got = verdicts(spark, rows)
    assert got == {
        ("ok", 0): None, ("empty", 0): "empty", ("broken", 0): "broken", ("role", 0): "broken", ("opens", 0): "broken", ("last", 0): "missing_reply",
        ("twice", 0): "missing_reply", ("side", 1): None, ("side", 0): "missing_reply",
    }


@pytest.mark.parametrize("seed,partitions", [(1, 1), (2, 5), (3, 9)])
def test_one_hot_conversation_against_brute_force(spark, seed, partitions):
    rnd = random.Random(seed)
    rows, ids = [], []
    for i in range(250):
        t = rnd.choice(["hot", "hot", "hot", "a", "b", "c"])
        role = "user" if i % 2 == 0 and rnd.random() > 0.01 else "assistant"
        parent = rnd.choice([None, *[x for s, x in ids[-3:] if s == t]])
        content = rnd.choice(["hi"] * 30 + ["", None, [], [{"type": "text", "text": ""}], [{"type": "tool_result"}]])
        rows.append((t, 0, i, entry(f"u{i}", parent, role, min(i // 5, 59), content, side=rnd.choice([False, False, "true"]))))
        ids.append((t, f"u{i}"))
    rows += rows[:40]
    rnd.shuffle(rows)
    assert verdicts(spark, rows, partitions) == brute.conversations(rows)


def test_reassembled_in_order(spark):
    rows = [("t", 0, 3, entry("c", "b", "user", 3)), ("t", 0, 1, entry("a", None, "user", 1)), ("t", 0, 4, entry("d", "c", "assistant", 4)),
            ("t", 0, 2, entry("b", "a", "assistant", 2)), ("bad", 0, 1, entry("z", None, "user", 1))]
    df = spark.createDataFrame([(t, g, s, None, v, "x", "y") for t, g, s, v in rows], SCHEMA)
    got = [r["uuid"] for r in conversations(read_entries(df), 1).collect()]
    assert got == ["a", "b", "c", "d"]


def test_empty(spark):
    assert verdicts(spark, []) == {}
