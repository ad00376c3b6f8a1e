"""Linking, order, validation and canonical JSON of tool calls."""

import json
import random

from airtally.llm import tool_calls

TOOLS = {"f": {"a": ("integer", True), "b": ("string", False), "c": ("number", False), "d": ("boolean", False), "e": ("array", False), "g": ("object", False), "h": ("null", False)}}
CALLS = "conv_id long, turn long, call_id string, name string, arguments string, needs array<string>, step int"
RESULTS = "conv_id long, turn long, call_id string, content string, json string"


def link(spark, calls, results):
    return tool_calls.link(
        spark.createDataFrame([(*c, 9) for c in calls], CALLS).repartition(3), spark.createDataFrame([(*r, "z") for r in results], RESULTS), TOOLS
    ).collect()


def test_links_and_odd_rows(spark):
    calls = [
        (1, 0, "x", "f", '{"a":1}', None), (1, 5, "x", "f", '{"a":2}', []), (1, 5, "x", "f", '{"a":2}', []), (1, 2, "y", "f", '{"a":1}', ["x", "gone", None]),
        (1, 3, None, "f", '{"a":1}', None), (None, None, "x", None, None, None), (2, 1, "x", "other", "{}", None),
    ]
    results = [(1, 1, "x", "r1"), (1, 9, "x", "r2"), (1, 4, None, "r3"), (2, 0, "lost", None), (None, 3, "x", "")]
    got = link(spark, calls, results)
    assert len(got) == len(calls) + len(results)
    found = sorted(((r.conv_id, r.turn, r.part, r.link, tuple(r.errors)) for r in got), key=str)
    assert found == sorted(
        [
            (1, 0, 0, "linked", ()), (1, 5, 0, "repeated", ()), (1, 5, 0, "repeated", ()),
            (1, 2, 0, "no result", ("needs gone, which is not there", "needs null, which is not there")), (1, 3, 0, "no result", ()),
            (None, None, 0, "linked", ("arguments are no object",)), (2, 1, 0, "no result", ("tool is unknown",)),
            (1, 1, 1, "linked", ()), (1, 9, 1, "linked", ()), (1, 4, 1, "no call", ()), (2, 0, 1, "no call", ()), (None, 3, 1, "linked", ()),
        ], key=str,
    )


def test_arguments(spark):
    cases = {
        '{"c":1.50,"b":"x\\u00e9/\\"","a":3}': [], '{"a":"3"}': ["a is no integer"], '{"a":1.5}': ["a is no integer"], "{}": ["a is missing"],
        '{"a":1,"z":2,"y":3}': ["y is unknown", "z is unknown"], '{"a":1,"b":2,"d":"no","e":{},"g":[],"h":0}': ["b is no string", "d is no boolean", "e is no array", "g is no object", "h is no null"],
        '{"a":1,"c":2,"d":true,"e":[1],"g":{"z":1,"k":[{"q":1,"b":2}]},"h":null}': [], "[1]": ["arguments are no object"], '{"a":1': ["arguments are no object"], "": ["arguments are no object"],
    }
    got = {r.turn: r for r in link(spark, [(1, i, f"c{i}", "f", a, None) for i, a in enumerate(cases)], [])}
    for i, (text, errors) in enumerate(cases.items()):
        assert sorted(got[i].errors) == sorted(errors), text
        message = json.loads(got[i].json)
        if errors == ["arguments are no object"]:
            assert message["arguments"] == text
        else:
            wanted = json.dumps({"arguments": json.loads(text), "id": f"c{i}", "name": "f", "type": "call"}, sort_keys=True, separators=(",", ":"), ensure_ascii=False)
            assert got[i].json == wanted


def test_order_is_topological(spark):
    rnd = random.Random(3)
    n = 60
    needs = {i: [f"c{j}" for j in rnd.sample(range(i), min(i, rnd.randint(0, 3)))] for i in range(n)}
    turn = {i: rnd.randrange(40) for i in range(n)}  # many calls are logged before what they need
    calls = [(1, turn[i], f"c{i}", "f", '{"a":1}', needs[i]) for i in range(n)] + [(1, 1, "p", "f", '{"a":1}', ["q"]), (1, 2, "q", "f", '{"a":1}', ["p"]), (1, 0, "tail", "f", '{"a":1}', ["q"]), (1, 0, "self", "f", '{"a":1}', ["self"])]
    got = link(spark, calls, [(1, 99, "c3", "answer")])
    key = lambda r: (r.placed_turn, r.step, r.call_id, r.part)
    place = {(r.call_id, r.part): key(r) for r in got}
    for i in range(n):
        assert all(place[need, 0] < place[f"c{i}", 0] for need in needs[i])
    order = sorted(got, key=key)
    at = next(k for k, r in enumerate(order) if r.part == 1)
    assert (order[at - 1].call_id, order[at].call_id) == ("c3", "c3")
    errors = {r.call_id: r.errors for r in got if r.part == 0}
    assert all(errors[c] == ["depends on a cycle"] for c in ("p", "q", "tail", "self"))
    assert not any(errors[f"c{i}"] for i in range(n))


def test_empty_tables(spark):
    assert link(spark, [], []) == []
