"""Tool-call links and URL verdicts on small fixtures."""

import json

from pyspark.sql import functions as F

from postrider.llm import chat, url_filter

SCHEMA = "conv_id long, turn long, role string, text string"


def call(*calls):
    return json.dumps({"tool_calls": [{"id": i, "name": n, "arguments": json.dumps(a) if not isinstance(a, str) else a} for i, n, a in calls]})


def result(i, content):
    return json.dumps({"tool_call_id": i, "content": content})


SCHEMAS = {"add": {"type": "object", "required": ["x"], "additionalProperties": False, "properties": {"x": {"type": "integer"}, "y": {"type": "string"}}}}


def test_links_orders_validates_and_writes(spark):
    rows = [
        (1, 0, "user", "hello"),
        (1, 1, "assistant", call(("a", "add", {"x": 1}), ("b", "add", {"y": "${a}", "x": 2.5}))),
        (1, 2, "tool", result("a", "three\n\"é\"")),
        (1, 3, "assistant", call(("c", "add", {"x": 1, "y": "${b} ${a} ${nowhere}", "z": 0}))),
        (1, 4, "tool", result("ghost", "?")),
        (1, 5, "assistant", call(("d", "add", {"x": 1, "y": "${e}"}), ("e", "add", {"x": 1, "y": "${d}"}))),
        (1, 6, "assistant", call(("f", "other", "{broken"), ("g", "add", '{"x":1,"x":2}'))),
        (2, 0, "assistant", call(("a", "add", {"x": 7}))),
        (2, 1, "assistant", call(("a", "add", {"x": 8}))),
        (2, 2, "tool", result("a", "again")),
        (None, None, None, None),
    ]
    frame = spark.createDataFrame(rows, SCHEMA).withColumn("json", F.lit(1))
    got = {(r.conv_id, r.call_id or r.turn): r for r in chat.format_conversations(frame, SCHEMAS, read_turns=False).collect()}
    assert got[1, "a"].status == "linked" and got[1, "a"].errors == "" and got[1, "a"].level == 0
    assert got[1, "a"].json == '{"arguments":{"x":1},"id":"a","name":"add","result":"three\\n\\"é\\""}'
    assert got[1, "b"].status == "unanswered" and got[1, "b"].errors == "type .x" and got[1, "b"].level == 1
    assert got[1, "c"].level == 2 and got[1, "c"].errors == "additional .z"
    assert got[1, "ghost"].status == "orphan"
    assert got[1, "d"].status == got[1, "e"].status == "cycle"
    assert got[1, "f"].errors == "not JSON" and got[1, "g"].errors == "not JSON"
    assert got[2, "a"].n_calls == 2 and json.loads(got[2, "a"].json)["arguments"] == {"x": 7}
    assert got[1, 0].status == "message" and got[None, None].json == '{"content":null,"role":null}'
    assert len(got) == 11
    assert all(json.dumps(json.loads(r.json), sort_keys=True, separators=(",", ":"), ensure_ascii=False) == r.json for r in got.values())


def test_levels_of_random_graphs(spark):
    import random

    rnd = random.Random(8)
    deps = {i: sorted(rnd.sample(range(i), min(i, rnd.choice([0, 1, 1, 1, 2, 3])))) for i in range(60)} | {100 + i: [99 + i] if i else [] for i in range(70)}
    deps |= {200: [201], 201: [200], 202: [201], 203: [202, 5], 204: [0, 3]}
    want = {}
    for i in sorted(deps):
        known = [want.get(d) for d in deps[i]]
        want[i] = None if i in (200, 201, 202, 203) else max((k + 1 for k in known), default=0)
    rows = [(c, str(i), json.dumps({"d": " ".join(f"${{{d}}}" for d in ds)})) for c in (1, 2) for i, ds in deps.items()]
    got = chat.levels(spark.createDataFrame(rows, "conv_id long, call_id string, arguments string")).collect()
    assert len(got) == len(rows) and all(r.level == want[int(r.call_id)] for r in got)


def test_plain_turns(spark):
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", "yo"), (1, 2, "user", "x" * 500), (1, 3, "system", "s"), (1, 4, "assistant", "late"), (2, 0, "user", None), (1, None, "user", "lost")]
    got = {(r.conv_id, r.turn): r for r in chat.format_conversations(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got[1, 0].status == "linked" and got[1, 2].status == "unanswered" and got[1, 2].level == 1 and got[1, 2].errors == "maxLength .prompt"
    assert got[1, 4].status == "orphan" and got[2, 0].errors == "required .prompt" and got[1, None].status == "message"
    assert chat.format_conversations(spark.createDataFrame([], SCHEMA)).count() == 0


def test_url_verdicts(spark):
    urls = {
        None: ("", "", None, "allow"), "no scheme": ("", "", None, "allow"), "http://A.Example.COM/en/7?x": ("a.example.com", "/en/7", "example.com/en/7", "allow"),
        "http://x.com/en/8#": ("x.com", "/en/8", "com/en/", "block"), "http://xcom/en/8": ("xcom", "/en/8", None, "allow"), "http://example.net/de/81": ("example.net", "/de/81", "example.net/de/8", "block"),
        "http://n.net/de/": ("n.net", "/de/", "net/de/", "allow"), "http://org/es/": ("org", "/es/", "org/es/", "block"), "http://CASINO-x.io": ("casino-x.io", "", None, "block"),
        "http://casinos.io/": ("casinos.io", "/", None, "allow"), "http://cheap-things.io/": ("cheap-things.io", "/", None, "allow"), "http://cheap.io/free": ("cheap.io", "/free", None, "block"),
        "http://é.io/a?b#c": ("é.io", "/a", None, "allow"), "http://cheap-cheap.io/": ("cheap-cheap.io", "/", None, "allow"), "a://b://c/d": ("b:", "//c/d", None, "allow"),
    }
    rows = [(i, u, "x") for i, u in enumerate(urls)]
    got = url_filter.judge_urls(spark.createDataFrame(rows, "page_id long, url string, host string")).collect()
    assert {r.url: (r.host, r.path, r.rule, r.verdict) for r in got} == urls
    clashing = url_filter.judge_urls(spark.createDataFrame([(1, "http://xxx.io/", "a", "b")], "row long, url string, hits string, _host string")).collect()
    assert [(r.row, r.hits, r._host, r.host, r.verdict) for r in clashing] == [(1, "a", "b", "xxx.io", "block")]
    assert url_filter.judge_urls(spark.createDataFrame([], "page_id long, url string")).count() == 0
