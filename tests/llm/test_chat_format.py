import hashlib
import json

from sourcewise.llm import chat_format as c

SCHEMA = '<tools>[{"name":"add","parameters":{"type":"object","required":["a","b"],"properties":{"a":{"type":"number"},"b":{"type":"number"}},"additionalProperties":false}}]</tools>'


def call(key, arguments, name="add"):
    return f"<tool_call>{json.dumps({'id': key, 'name': name, 'arguments': arguments})}</tool_call>"


def result(key, content):
    return f"<tool_result>{json.dumps({'id': key, 'content': content})}</tool_result>"


TURNS = [
    (1, 0, "system", "Use tools. " + SCHEMA),
    (1, 1, "user", "é \"quoted\" \n text"),
    (1, 2, "tool", result("k1", {"z": 1.0, "a": [True, None]})),  # stands before its call
    (1, 3, "assistant", "go " + call("k2", {"b": {"$ref": "k1"}, "a": 2}) + call("k1", {"b": 1, "a": 2.5})),
    (1, 4, "tool", result("k2", 7) + result("nobody", 1)),
    (1, 5, "assistant", call("k3", {"a": "x", "c": 1}) + call("k2", {"a": 1, "b": 2}) + call("k4", {"$ref": "lost"}, "other")),
    (1, 6, "assistant", "<tool_call>{broken</tool_call>"),
    (1, 7, "assistant", '{"content": "hi", "tool_calls": [{"id": "k5", "function": {"name": "add", "arguments": "{\\"a\\": 1, \\"b\\": 3}"}}]}'),
    (1, 8, "tool", '{"tool_call_id": "k5", "content": "4"}'),
    (2, 0, "assistant", call("p", {"x": {"$ref": "q"}}, "f") + call("q", {"x": {"$ref": "p"}}, "f")),
    (2, 1, "tool", result("p", 1) + result("q", 2)),
    (3, 0, "user", None), (3, None, None, ""), (None, 0, "user", "x"), (None, 0, "user", "x"), (1, 2, "tool", None),
]


def test_links_order_and_validation(spark):
    rows = c.linked(spark.createDataFrame([(*t, 1) for t in TURNS], "conv_id long, turn long, role string, text string, depth int").repartition(3)).collect()
    assert len(rows) == sum(len(c.units_of(t[2], t[3])) for t in TURNS)
    one = sorted((r for r in rows if r.conv_id == 1), key=lambda r: (r.at_turn, r.at_place, r.depth))
    at = {(r.kind, r.call_id, r.turn): i for i, r in enumerate(one)}
    assert at["call", "k1", 3] < at["result", "k1", 2] < at["call", "k2", 3] < at["result", "k2", 4]
    by = {(r.kind, r.call_id, r.turn): r for r in one}
    assert by["call", "k1", 3].is_linked and by["call", "k1", 3].is_valid and by["call", "k2", 3].is_valid
    assert by["call", "k3", 5].error == "call without result; arguments: $.b: required; $.a: not of type number; $.c: not allowed"
    assert by["call", "k2", 5].error == "duplicate id" and by["result", "nobody", 4].error == "result of no call"
    assert by["call", "k4", 5].error == "call without result; reference to no call" and by["call", "k4", 5].is_valid is None
    assert by["call", "k5", 7].is_linked and by["result", "k5", 8].is_linked
    assert next(r for r in one if r.turn == 6).error == "tool_call: JSONDecodeError"
    assert all("cycle" in r.error for r in rows if r.conv_id == 2 and r.kind != "message")
    assert by["result", "k1", 2].json == '{"content":{"a":[true,null],"z":1},"id":"k1","kind":"result","role":"tool"}'
    for r in rows:
        value = json.loads(r.json)
        assert r.json == json.dumps(value, ensure_ascii=False, sort_keys=True, separators=(",", ":"))


def test_plain_conversations_stay_as_they_are(spark):
    rows = c.op3_chat_format(spark, "/root/testdata/sf0.001").collect()
    turns = spark.read.parquet("/root/testdata/sf0.001/conversations.parquet").collect()
    want = sorted((t.conv_id, t.turn, hashlib.sha256(c.canonical({"content": t.text, "kind": "message", "role": t.role}).encode()).hexdigest()) for t in turns)
    assert sorted((r.conv_id, r.turn, r.json_sha256) for r in rows) == want
    assert all((r.at_turn, r.at_place, r.depth, r.error) == (r.turn, 0, 0, None) for r in rows)
    assert c.linked(spark.read.parquet("/root/testdata/sf0.001/conversations.parquet").limit(0)).count() == 0


def test_long_chain(spark):
    turns = [(5, 0, "assistant", "".join(call(f"c{i}", {"x": {"$ref": f"c{i + 1}"}} if i < 6 else {}, "f") for i in range(7)) + "".join(result(f"c{i}", i) for i in range(7)))]
    rows = c.linked(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")).where("kind <> 'message'").collect()
    order = sorted(rows, key=lambda r: (r.at_turn, r.at_place, r.depth))
    assert [r.call_id for r in order if r.kind == "call"] == [f"c{i}" for i in reversed(range(7))]


def test_every_schema_keyword_counts():
    from sourcewise.llm.chat_format import violations

    node = {"$defs": {"n": {"type": "object", "properties": {"v": {"type": "integer"}, "next": {"$ref": "#/$defs/n"}}, "required": ["v"]}}, "$ref": "#/$defs/n"}
    cases = [  # schema, a value that fits, a value that breaks it
        ({"anyOf": [{"type": "string"}, {"minimum": 5}]}, 6, 4), ({"oneOf": [{"minimum": 2}, {"maximum": 5}]}, 1, 3), ({"allOf": [{"minimum": 2}, {"maximum": 5}]}, 3, 6),
        ({"not": {"type": "string"}}, 1, "a"), (node, {"v": 1, "next": {"v": 2}}, {"v": 1, "next": {"v": "x"}}), ({"$ref": "#/$defs/a~1b", "$defs": {"a/b": {"const": 1}}}, 1, 2),
        ({"exclusiveMinimum": 3}, 4, 3), ({"exclusiveMaximum": 3}, 2.5, 3), ({"minimum": 3, "exclusiveMinimum": True}, 4, 3), ({"multipleOf": 0.01}, 19.99, 19.995),
        ({"uniqueItems": True}, [1, "1", True], [1, 2, 1.0]), ({"minProperties": 2}, {"a": 1, "b": 1}, {"a": 1}), ({"maxProperties": 1}, {"a": 1}, {"a": 1, "b": 1}),
        ({"dependentRequired": {"a": ["b"]}}, {"b": 1}, {"a": 1}), ({"dependentSchemas": {"a": {"required": ["c"]}}}, {"a": 1, "c": 2}, {"a": 1}), ({"dependencies": {"a": ["b"]}}, {}, {"a": 1}),
        ({"patternProperties": {"^x": {"type": "integer"}}, "additionalProperties": False}, {"xa": 1}, {"xa": "s"}), ({"patternProperties": {"^x": {}}, "additionalProperties": False}, {"xa": 1}, {"ya": 1}),
        ({"propertyNames": {"maxLength": 2}}, {"ab": 1}, {"abc": 1}), ({"prefixItems": [{"type": "string"}], "items": False}, ["a"], ["a", 1]), ({"items": [{"type": "string"}], "additionalItems": False}, ["a"], ["a", 1]),
        ({"contains": {"const": 1}}, [2, 1], [2]), ({"contains": {"const": 1}, "minContains": 0, "maxContains": 1}, [], [1, 1]), ({"if": {"minimum": 5}, "then": {"multipleOf": 5}, "else": {"const": 1}}, 10, 7),
    ]
    for schema, good, bad in cases:
        assert violations(good, schema) == [] and violations(bad, schema), schema
    for schema in ({"unevaluatedProperties": False}, {"not": {"new": 1}}, {"anyOf": [{"new": 1}, {}]}, {"$ref": "#/$defs/none"}, {"$ref": "http://x/y"}, {"$ref": "#"}, {"type": "odd"}, {"properties": {"a": {"new": 1}}}):
        assert violations({"a": 1}, schema), schema
    assert violations(1, {"title": "t", "x-order": 1, "format": "int32"}) == []


def test_halves_of_surrogate_pairs_and_long_texts(spark):
    half = '\\ud800'
    turns = [(1, 0, "system", SCHEMA.replace("add", "a" + half)), (1, 1, "assistant", f'<tool_call>{{"id":"k{half}","name":"a{half}","arguments":{{"a":"{half}","b":1,"x{half}":2}}}}</tool_call>'),
             (1, 2, "tool", f'<tool_result>{{"id":"k{half}","content":"\\ud83d\\ude00 {half}"}}</tool_result>'), (1, 3, "user", "long " * 400_000)]
    rows = {(r.kind, r.turn): r for r in c.linked(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")).collect()}
    assert rows["call", 1].is_linked and rows["result", 2].is_linked and rows["call", 1].is_valid is False
    assert rows["result", 2].json.startswith('{"content":"😀 \\ud800"') and len(rows["message", 3].json) > 2_000_000


def test_order_is_topological_on_random_chains(spark):
    import random

    rng = random.Random(5)
    turns, needs = [], {}
    for conv in range(6):
        for t in range(30):
            refs = sorted({rng.randrange(30) for _ in range(rng.randrange(3))} - {t})
            refs = [r for r in refs if r < t or conv % 2 == 0 and r > t and r % 7 == 0 and t % 7]
            needs[conv, t] = refs
            turns.append((conv, t, "assistant", call(f"c{t}", {f"x{r}": {"$ref": f"c{r}"} for r in refs}, "f") + (result(f"c{t}", 1) if t % 3 else "")))
    rows = c.linked(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").repartition(5)).collect()
    order = {(r.conv_id, r.kind, r.call_id): (r.at_turn, r.at_place, r.depth, r.turn, r.place) for r in rows if r.kind != "message"}
    assert len(set((k[0], v) for k, v in order.items())) == len(order)
    free = {(r.conv_id, r.call_id) for r in rows if r.kind == "call" and "cycle" not in (r.error or "")}
    assert len(free) > 100
    for (conv, t), refs in needs.items():
        if (conv, f"c{t}") in free:
            for r in refs:
                assert order.get((conv, "result", f"c{r}"), order[conv, "call", f"c{r}"]) < order[conv, "call", f"c{t}"]
            if t % 3:
                assert order[conv, "call", f"c{t}"] < order[conv, "result", f"c{t}"]


def test_long_chains_take_few_rounds(spark, monkeypatch):
    """A chain of 300 calls, each naming the one before, written backwards: every key is the first turn's, pushed on."""
    n = 300
    turns = [(7, n - t, "assistant", call(f"c{t}", {"x": {"$ref": f"c{t - 1}"}} if t else {}, "f") + result(f"c{t}", t)) for t in range(n)]
    puts = []
    plain = c.Workspace.put
    monkeypatch.setattr(c.Workspace, "put", lambda self, df, name, *used: (puts.append(name), plain(self, df, name, *used))[1])
    rows = {(r.kind, r.call_id): r for r in c.linked(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")).collect()}
    assert [(rows["call", f"c{t}"].at_turn, rows["call", f"c{t}"].depth) for t in range(n)] == [(n, max(0, 2 * t - 1)) for t in range(n)]
    assert all(rows["result", f"c{t}"].at_turn == n for t in range(n))
    assert sum(x.startswith("jumps") for x in puts) <= 12 and sum(x.startswith("state") for x in puts) <= 2
