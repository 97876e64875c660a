"""Every call, result and text of a conversation keeps a row when identifiers repeat."""

import json

from postrider.llm import chat


def test_reused_identifiers_null_ids_and_content(spark):
    calls = lambda content, *of: json.dumps({"content": content, "tool_calls": [{"id": i, "name": "f", "arguments": json.dumps(a)} for i, a in of]})
    result = lambda i, c: json.dumps({"tool_call_id": i, "content": c})
    rows = [
        (1, 0, "assistant", calls("I look it up", ("call_0", {"x": 1}), (None, {"x": 9}))), (1, 1, "tool", result("call_0", "one")),
        (1, 2, "assistant", calls(None, ("call_0", {"x": 2, "of": "${call_0}"}))), (1, 3, "tool", result("call_0", "two")), (1, 4, "tool", result("call_0", "three")),
    ]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    for read_turns in (False, True):
        got = sorted((r.turn, r.status, r.call_id or "", r.level, json.loads(r.json)) for r in chat.format_conversations(frame, {}, read_turns).collect() if r.status != "message")
        assert [(t, s, i, n) for t, s, i, n, _ in got] == [(0, "linked", "call_0", 0), (0, "unanswered", "", 0), (2, "linked", "call_0", 1), (4, "orphan", "call_0", None)]
        assert [j.get("result", j.get("content")) for *_, j in got] == ["one", None, "two", "three"]
        texts = [json.loads(r.json) for r in chat.format_conversations(frame, {}, read_turns).collect() if r.status == "message"]
        assert texts == [{"content": "I look it up", "role": "assistant"}]


def test_nested_calls_and_unknown_forms(spark):
    nested = {"tool_calls": [{"id": "call_1", "type": "function", "function": {"name": "get_weather", "arguments": json.dumps({"city": "Ulm"})}}, {"id": "call_2", "function": {"name": "get_weather", "arguments": {"city": "${call_1}"}}}]}
    mixed = {"content": "both", "tool_calls": [{"id": "a", "name": "get_weather", "arguments": {"city": "Bonn"}}, None]}
    odd = {"tool_calls": [{"id": "b", "tool": "x", "input": {"y": 1}}]}
    rows = [(1, 0, "assistant", json.dumps(nested)), (1, 1, "tool", json.dumps({"tool_call_id": "call_1", "content": "sun"})), (1, 2, "assistant", json.dumps(mixed)), (1, 3, "assistant", json.dumps(odd)), (1, 4, "assistant", json.dumps({"tool_calls": []}))]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    schemas = {"get_weather": {"type": "object", "required": ["city"], "properties": {"city": {"type": "string"}}}}
    got = chat.format_conversations(frame, schemas, False).collect()
    by_id = {r.call_id: r for r in got if r.call_id}
    assert by_id["call_1"].json == '{"arguments":{"city":"Ulm"},"id":"call_1","name":"get_weather","result":"sun"}' and by_id["call_1"].errors == ""
    assert by_id["call_2"].level == 1 and json.loads(by_id["call_2"].json)["arguments"] == {"city": "${call_1}"} and json.loads(by_id["a"].json)["arguments"] == {"city": "Bonn"}
    texts = sorted(json.loads(r.json)["content"] for r in got if r.status == "message")
    assert texts == sorted(["both", rows[3][3], rows[4][3]]) and set(by_id) == {"call_1", "call_2", "a"}
