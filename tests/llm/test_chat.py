"""Linking, order, validation and JSON of tool calls against brute force."""

import json

import pytest

from lodeseam.llm import chat

CONVERSATIONS = [
    (1, 0, "system", "be kind"), (1, 1, "user", 'say "hi"\n\\ é 😀 \x01'), (1, 2, "assistant", "hi"), (1, 3, "user", None), (1, 4, "assistant", None), (1, 5, "user", "last"),
    (2, 0, "user", "q"), (2, 1, "assistant", "first"), (2, 1, "assistant", "second"), (2, 0, "user", "q"), (3, 4, "assistant", "no question"), (None, 1, "user", "lost"), (4, None, "user", "x"), (5, 0, None, "odd"),
]
SCHEMA = "conv_id long, turn int, role string, text string"


def expected(rows):
    users = {}
    for c, t, role, text in rows:
        if role == "user" and c is not None and t is not None:
            users.setdefault((c, t), text or "")
    results, out = {}, []
    for c, t, role, text in rows:
        if role != "user":
            key = (c, t - 1) if role == "assistant" and c is not None and t is not None else None
            results.setdefault(key, []).append((c, t, text or ""))
        elif c is None or t is None:
            out.append((c, None, t, None, "pending", 0, None))
    for (c, t), _ in users.items():
        found = sorted(x[1:] for x in results.pop((c, t), []))
        out.append((c, f"{c}:{t}", t, sum(1 for a, b in users if a == c and b < t), "linked" if found else "pending", len(found), found[0][0] if found else None))
    for key, found in results.items():
        if key is None:
            out += [(c, None, None, None, "orphan", 1, t) for c, t, _ in found]
        else:
            out.append((key[0], f"{key[0]}:{key[1]}", None, None, "orphan", len(found), min(t for _, t, _ in found)))
    return sorted(out, key=str)


def test_conversations(spark):
    df = spark.createDataFrame(CONVERSATIONS, SCHEMA)
    got = chat.link_calls(*chat.turns_as_calls(df)).collect()
    assert sorted((tuple(r[:7]) for r in got), key=str) == expected(CONVERSATIONS)
    texts = {(c, t): x or "" for c, t, _, x in reversed(CONVERSATIONS)}
    for r in got:
        body = json.loads(r.json)
        assert list(body) == ["arguments", "id", "name", "result"] and body["id"] == r.call_id
        if r.turn is not None and r.call_id:
            assert body["arguments"]["prompt"] == texts[(r.conv_id, r.turn)] and list(body["arguments"]) == sorted(body["arguments"])
            assert r.json == json.dumps(body, separators=(",", ":"), ensure_ascii=False) or "\x01" in body["arguments"]["prompt"]
            assert r.valid
    empty = spark.createDataFrame([], SCHEMA)
    assert chat.link_calls(*chat.turns_as_calls(empty)).count() == 0


def test_order_and_validation(spark):
    calls = [
        (1, 1, "a", "reply", '{"turn": 1, "prompt": "x"}', ["c"]), (1, 2, "b", "reply", '{"prompt":"x","turn":2,"after":null}', []), (1, 3, "c", "reply", '{"prompt":"x"}', ["b"]),
        (2, 1, "d", "reply", '{"prompt":1,"turn":1}', ["e"]), (2, 2, "e", "reply", "not json", ["d"]), (2, 3, "f", "other", "{}", ["e"]), (2, 4, "g", "reply", "[1]", ["unknown"]),
        (3, 1, "h", "reply", '{"prompt":"x","turn":1,"more":2}', ["h"]),
    ]
    df = spark.createDataFrame(calls, "conv_id long, turn long, call_id string, name string, arguments string, depends_on array<string>")
    none = spark.createDataFrame([], "conv_id long, turn long, call_id string, result string")
    got = {r.call_id: r for r in chat.link_calls(df, none).collect()}
    assert [got[k].position for k in "abc"] == [2, 0, 1]
    assert [got[k].status for k in "abcdefgh"] == ["pending"] * 3 + ["cycle"] * 3 + ["pending", "cycle"]
    assert [got[k].valid for k in "abcdefgh"] == [True, True, False, False, False, False, False, False]
    assert got["a"].json == '{"arguments":{"prompt":"x","turn":1},"id":"a","name":"reply","result":null}'
    assert got["e"].json.startswith('{"arguments":null,')


@pytest.mark.parametrize("width", [1, 3])
def test_places_do_not_depend_on_ranges(spark, monkeypatch, width):
    monkeypatch.setattr(chat, "TURN_RANGE", width)
    rows = [(1, t, "user", "x") for t in range(20)] + [(2, t, "user", "y") for t in range(0, 9, 3)]
    got = chat.link_calls(*chat.turns_as_calls(spark.createDataFrame(rows, SCHEMA))).collect()
    assert sorted((r.conv_id, r.turn, r.position) for r in got) == [(1, t, t) for t in range(20)] + [(2, 3 * k, k) for k in range(3)]
