import json

from marlstone.llm import chat_tools as C


def call(i, name="search", **args):
    return {"id": i, "name": name, "arguments": args}


def test_canonical_and_schema():
    assert C.canonical({"b": 2.0, "a": ["é", 1.5, None, True]}) == '{"a":["é",1.5,null,true],"b":2}'
    s = {"type": "object", "required": ["q"], "properties": {"q": {"type": "string", "pattern": "^a"}, "n": {"type": ["integer", "null"], "maximum": 3}, "l": {"type": "array", "items": {"enum": [1, 2]}}}, "additionalProperties": False}
    assert C.violations({"q": "ab", "n": None, "l": [1, 2]}, s) == []
    assert C.violations({"n": 4, "l": [3], "z": 1}, s) == ["$.q: missing", "$.l[0]: not an allowed value", "$.n: out of bounds", "$.z: unknown"]
    assert C.violations({"q": {"$result": "x"}, "n": True}, s) == ["$.n: not integer/null"]


ROWS = [
    (1, 0, "user", "find it"),
    (1, 1, "assistant", json.dumps({"content": "ok", "tool_calls": [call("c2", q=1), call("c1", query="x"), call("c3", "fetch", url={"$result": "c1"}), call("c4", "fetch", url={"$result": "c3"})]})),
    (1, 2, "tool", json.dumps({"tool_call_id": "c1", "content": {"b": 1, "a": 2}})),
    (1, 3, "tool", json.dumps({"tool_call_id": "c1", "content": "again"})),
    (1, 4, "assistant", 'text <tool_call>{"id": "c1", "name": "none", "arguments": "{}"}</tool_call><tool_call>broken</tool_call>'),
    (1, 5, "tool", '<tool_response>{"tool_call_id": "zz", "content": 1}</tool_response>'),
    (2, 0, "tool", json.dumps({"tool_call_id": "k", "content": "early"})),
    (2, 1, "assistant", json.dumps({"tool_calls": [call("k", "fetch", url={"$result": "m"}), call("m", "fetch", url={"$result": "k"})]})),
    (3, 0, None, None),
    (None, 0, "user", ""),
    (3, 1, "assistant", '{"not": "calls"'),
    (3, 1, "assistant", '{"not": "calls"'),
]


def test_links(spark):
    df = spark.createDataFrame([r + ("x",) for r in ROWS], "conv_id long, turn long, role string, text string, level string").repartition(3)
    got = C.link_tools(df).collect()
    by = {(r.conv_id, r.turn, r.part): r for r in got}
    say = lambda *k: (by[k].kind, by[k].call_id, by[k].status, by[k].other_turn, by[k].level)
    assert say(1, 0, 0) == ("message", None, None, None, None) and by[1, 0, 0].json == '{"content":"find it","role":"user"}'
    assert say(1, 1, 1) == ("call", "c2", "unanswered", None, 0) and by[1, 1, 1].errors == ["$.query: missing", "$.q: unknown"]
    assert say(1, 1, 2) == ("call", "c1", "linked", 2, 0) and by[1, 1, 2].json == '{"arguments":{"query":"x"},"id":"c1","name":"search"}'
    assert say(1, 1, 3)[-1] == 1 and say(1, 1, 4)[-1] == 2
    assert say(1, 2, 0) == ("result", "c1", "linked", 1, None) and by[1, 2, 0].json == '{"content":{"a":2,"b":1},"role":"tool","tool_call_id":"c1"}'
    assert say(1, 3, 0)[2] == "duplicate" and say(1, 4, 1)[2] == "duplicate" and say(1, 4, 2)[1:3] == (None, "none") and say(1, 5, 0)[2] == "orphan"
    assert say(2, 0, 0)[2] == "early" and say(2, 1, 0)[2] == "unanswered" and by[2, 1, 0].errors == ["$: needs itself"] and say(2, 1, 1)[-1] is None
    assert by[3, 0, 0].json == '{"content":null,"role":null}' and len(got) == 19
    assert C.link_tools(df.limit(0)).count() == 0


def test_plain_conversations(spark):
    conv = spark.read.parquet("/root/testdata/sf0.001/conversations.parquet")
    got = C.link_tools(conv).collect()
    want = sorted(C.canonical({"content": r.text, "role": r.role}) for r in conv.collect())
    assert sorted(r.json for r in got) == want and {r.kind for r in got} == {"message"}


def test_numbers_and_strings_as_the_standard_writes_them():
    """Samples of RFC 8785, appendix B, and what it leaves open."""
    samples = {-0.0: "0", 5e-324: "5e-324", 1.7976931348623157e308: "1.7976931348623157e+308", 9007199254740992.0: "9007199254740992", 295147905179352830000.0: "295147905179352830000", 1e21: "1e+21", 10**21: "1e+21", 9.999999999999997e22: "9.999999999999997e+22", 1e-6: "0.000001", 1e-7: "1e-7", 333333333.3333332: "333333333.3333332", -1.5: "-1.5", 0.1: "0.1", 100.0: "100", 10**400 + 1: str(10**400 + 1), (1 << 60) + 1: str((1 << 60) + 1)}
    assert {v: C.number(v) for v in samples} == samples
    assert C.canonical({"\u20ac": 1, "\r": 4, "a": '\x1f\x7f\\"'}) == '{"\\r":4,"a":"\\u001f\x7f\\\\\\"","\u20ac":1}'
    assert C.canonical({"\U0001f600": 2, "\ufb33": 3}) == '{"\U0001f600":2,"\ufb33":3}'
    assert C.canonical("a\ud800b") == '"a\\ud800b"'
    assert C.violations(10**400, {"type": "integer", "minimum": 1}) == [] and C.violations(True, {"enum": [1]}) == ["$: not an allowed value"]


def test_odd_messages_do_not_stop_the_job(spark):
    deep = "[" * 5000 + "]" * 5000
    odd = [
        '{"tool_calls": [{"id": "\\ud800", "name": "search", "arguments": {"query": "\\udfff", "\\ud801": 1}, "more": 1}]}',
        '{"tool_calls": [{"id": 7, "type": "function", "function": {"name": "search", "arguments": {"query": "x", "limit": 1' + "0" * 400 + "}}}]}",
        '{"tool_calls": [{"id": "d", "name": "search", "arguments": %s}]}' % deep,
        '{"tool_calls": [{"id": "e", "name": "search", "arguments": {"query": "x", "limit": ' + "9" * 5000 + "}}]}",
        '{"tool_calls": [null, 3, {"id": "f", "name": ["search"], "arguments": null}], "content": NaN}',
    ]
    df = spark.createDataFrame([(1, i, "assistant", t) for i, t in enumerate(odd)], "conv_id long, turn long, role string, text string")
    got = {(r.turn, r.part): r for r in C.link_tools(df).collect()}
    assert got[0, 0].call_id == "\\ud800" and '"more":1' in got[0, 0].json and got[0, 0].errors == ["$.\\ud801: unknown"]
    assert got[1, 0].call_id == "7" and got[1, 0].errors == [] and '"type":"function"' in got[1, 0].json
    assert {got[i, 0].kind for i in (2, 3, 4)} == {"message"}


def test_levels_equal_brute_force(spark, monkeypatch):
    import random

    rng = random.Random(3)
    calls = []
    for conv in range(30):
        ids = [f"c{i}" for i in range(rng.randint(1, 14))]
        for i, c in enumerate(ids):
            pool = ids if conv % 3 == 0 else ids[:i]
            calls.append((conv, c, rng.sample([*pool, "unknown"], min(len(pool), rng.randint(0, 2)))))

    def brute(conv):
        needs = {c: [x for x in n if x != "unknown"] for v, c, n in calls if v == conv}
        level, grown = {}, True
        while grown:
            new = {c: 1 + max((level[x] for x in n), default=-1) for c, n in needs.items() if c not in level and all(x in level for x in n)}
            level, grown = level | new, bool(new)
        return {(conv, c): level.get(c) for c in needs}

    want = {k: v for conv in range(30) for k, v in brute(conv).items()}
    assert None in want.values() and max(x or 0 for x in want.values()) >= 3
    df = spark.createDataFrame(calls, "conv_id long, call_id string, needs array<string>").repartition(4)
    for most in (0, 6, 50_000):
        monkeypatch.setattr(C, "PASS_NEEDS", most)
        assert {(r.conv_id, r.call_id): r.level for r in C.call_levels(df).collect()} == want
