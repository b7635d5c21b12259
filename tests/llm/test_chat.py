"""Tool-call linking: explicit calls, plain turns, order, schemas and canonical JSON."""

import json

from waypoint.llm import chat

SCHEMAS = [*chat.SCHEMAS, ("add", "x", "BIGINT", True, None), ("add", "y", "BIGINT", True, None), ("add", "note", "STRING", False, 5)]


def call(**kw):
    return f"text <tool_call>{json.dumps(kw)}</tool_call> more"


def result(name, content):
    return json.dumps({"tool_call_id": name, "content": content})


ROWS = [
    (1, 0, "user", "Grüße \"you\"\n\\"), (1, 1, "assistant", call(id="c2", name="add", arguments={"y": 2, "x": 1}, needs=["c1"]) + call(id="c1", name="add", arguments={"x": 1, "y": "no"})),
    (1, 2, "tool", result("c2", "3")), (1, 3, "tool", result("c1", "again")), (1, 4, "tool", result("c1", "later")),
    (2, 0, "assistant", call(id="a", name="add", arguments={"x": 1, "y": 2, "note": "far too long", "z": {"b": [1, {"d": 0, "c": None}], "a": 1}}, needs=["lost"])),
    (2, 1, "assistant", call(id="p", name="none", arguments={}, needs=["q"]) + call(id="q", name="none", arguments={}, needs=["p"])),
    (2, 2, "assistant", "<tool_call>no json</tool_call>"), (2, 3, "assistant", call(id="a", name="add", arguments={"x": 1})),
    (3, 0, "user", None), (3, 1, "assistant", None), (3, 2, "user", "second"), (None, 0, "user", "no chat"), (4, None, "user", "no turn"), (3, 2, "user", "second"), (5, None, None, None),
]


def test_calls_meet_results_in_order(spark):
    messages = spark.createDataFrame([(*r, "x", "y") for r in ROWS], "conv_id long, turn long, role string, text string, call_id string, problems string")
    out = chat.format_chats(messages, SCHEMAS).collect()
    got = {(r.conv_id, r.call_id, r.turn): r for r in out}
    c1, c2 = got[(1, "c1", 1)], got[(1, "c2", 1)]
    assert (c1.ready_turn, c1.hops) < (c2.ready_turn, c2.hops)  # c2 stands first in the text and needs c1
    assert c2.valid and c2.json == '{"arguments":{"x":1,"y":2},"call_id":"c2","name":"add","result":"3"}'
    assert c1.problems == "type y,several results" and json.loads(c1.json)["result"] == "again"
    a = got[(2, "a", 0)]
    assert a.problems == "long note,extra z,repeated identifier,no result,missing need"
    assert '"arguments":{"note":"far too long","x":1,"y":2,"z":{"a":1,"b":[1,{"c":null,"d":0}]}}' in a.json
    assert {got[(2, k, 1)].problems for k in "pq"} == {"unknown tool,no result,cycle"}
    assert got[(2, "a", 3)].problems.startswith("missing y")
    assert got[(2, None, 2)].problems == "not json,unknown tool,no identifier,no result"
    hello = got[(1, "u0", 0)]
    assert hello.valid and json.loads(hello.json)["arguments"] == {"prompt": "Grüße \"you\"\n\\", "turn": 0}
    assert got[(3, "u0", 0)].problems == "missing prompt"
    assert [r.problems for r in out if (r.conv_id, r.call_id) == (3, "u2")] == ["repeated identifier,no result"] * 2
    assert got[(None, "u0", 0)].problems == "no identifier,no result"
    assert got[(4, None, None)].problems == "missing turn,no identifier,no result"


def test_no_messages(spark):
    assert chat.format_chats(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


def test_every_call_comes_after_what_it_needs(spark):
    rows = [(7, 40 - i, "assistant", call(id=f"k{i}", name="add", arguments={"x": i, "y": i}, needs=[f"k{i - 1}"] if i else [])) for i in range(12)]
    out = {r.call_id: (r.ready_turn, r.hops) for r in chat.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), SCHEMAS).collect()}
    assert all(out[f"k{i}"] > out[f"k{i - 1}"] for i in range(1, 12))


def test_long_chains_are_ordered_and_only_cycles_are_stuck(spark):
    rows = [(7, 500, "assistant", "".join(call(id=f"k{i}", name="add", arguments={"x": i, "y": i}, needs=[f"k{i + 1}"] if i < 99 else []) for i in range(100)))]
    rows += [(8, 1, "assistant", call(id="a", name="add", arguments={"x": 1, "y": 1}, needs=["b"]) + call(id="b", name="add", arguments={"x": 1, "y": 1}, needs=["c"]) + call(id="c", name="add", arguments={"x": 1, "y": 1}, needs=["b", "d"]) + call(id="d", name="add", arguments={"x": 1, "y": 1}))]
    rows += [(9, 1, "assistant", call(id="a", name="add", arguments={"x": 1, "y": 1}, needs=["b", "c"])), (9, 5, "assistant", call(id="b", name="add", arguments={"x": 1, "y": 1}, needs=["c"])), (9, 3, "assistant", call(id="c", name="add", arguments={"x": 1, "y": 1}))]
    out = {(r.conv_id, r.call_id): r for r in chat.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), SCHEMAS).collect() if r.name}
    for i in range(100):
        r = out[(7, f"k{i}")]
        assert (r.ready_turn, r.hops, r.problems) == (500, 99 - i, "no result")
    assert {k: "cycle" in out[(8, k)].problems for k in "abcd"} == {"a": True, "b": True, "c": True, "d": False}
    assert {k: (out[(9, k)].ready_turn, out[(9, k)].hops) for k in "abc"} == {"a": (5, 1), "b": (5, 0), "c": (3, 0)}


def test_results_without_a_call_are_reported(spark):
    rows = [(1, 0, "assistant", "hello"), (1, 1, "user", "hi"), (1, 2, "assistant", "yes"), (1, 3, "tool", result("lost", "3")), (1, 4, "tool", "no json"), (None, 5, "assistant", "no chat")]
    out = chat.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    got = sorted((r.turn, r.call_id, r.result_turn, r.problems, json.loads(r.json)["result"]) for r in out if not r.valid)
    assert got == [(0, "u-1", 0, "no call", "hello"), (3, "lost", 3, "no call", "3"), (4, None, 4, "no identifier,no call", None), (5, "u4", 5, "no identifier,no call", "no chat")]
    assert [r.call_id for r in out if r.valid] == ["u1"]


def test_every_message_is_in_a_row(spark):
    rows = [
        (1, 0, "system", "rules"), (1, 1, "user", "hi"), (1, 2, "assistant", "a"), (1, 2, "assistant", "a"), (1, 2, "assistant", "b"), (1, 2, "assistant", None),
        (1, 3, "critic", "c"), (1, 4, None, "n"), (1, 5, "system", None), (1, 6, "system", "x" * 300_000), (None, 7, "system", "lost"), (1, 0, "system", "rules"),
    ]
    out = chat.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3)).collect()
    said = []
    for r in out:
        body = json.loads(r.json)
        said += [body["arguments"]["prompt"]] if body.get("arguments") else []
        said += [body["content"]] if r.name == "message" else [body["result"]]
    assert sorted(map(str, said)) == sorted(str(t) for *_, t in rows)
    assert sorted((r.turn, r.problems) for r in out if not r.valid) == [(1, "several results"), (2, "surplus result"), (2, "surplus result"), (2, "surplus result"), (3, "unknown role"), (4, "no role"), (7, "no identifier")]
    first = next(r for r in out if r.turn == 0)
    assert first.json == '{"content":"rules","role":"system"}' and first.valid


def test_the_twin_says_the_same_of_odd_messages(spark):
    import duckdb
    import pandas as pd

    from waypoint.llm import twins

    rows = [(1, 0, "assistant", "early"), (1, 1, "user", "hi"), (1, 2, "assistant", "b"), (1, 2, "assistant", "a"), (1, 2, "assistant", None), (2, 1, "user", "é\"\\"), (2, 1, "user", "again"), (2, 2, "assistant", "x"), (2, 3, "critic", None), (2, 4, None, "n"), (None, 5, "system", "s")]
    names = ["conv_id", "turn", "role", "text"]
    got = chat.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    con = duckdb.connect()
    con.register("rows_", pd.DataFrame(rows, columns=names).astype(object))
    con.execute("CREATE VIEW conversations AS SELECT conv_id::BIGINT AS conv_id, turn::BIGINT AS turn, role::VARCHAR AS role, text::VARCHAR AS text FROM rows_")
    want = con.execute(twins.OP6)
    at = [[d[0] for d in want.description].index(c) for c in got.columns]
    assert sorted(str(tuple(r)) for r in got.collect()) == sorted(str(tuple(row[i] for i in at)) for row in want.fetchall())
