"""Chat formatting: links, order, validation, canonical JSON."""

import json
import random

import pytest
import regex

from siltstone.llm import chat as C
from siltstone.llm import ordering, patterns, schema

SCHEMA = "conv_id long, turn long, role string, text string"
TOOLS = json.dumps({"content": "hi", "tools": [{"type": "function", "function": {"name": "add", "parameters": {"type": "object", "properties": {"x": {"type": "integer"}, "y": {"type": "integer", "minimum": 0}}, "required": ["x"], "additionalProperties": False}}}]})


def call(*calls):
    return json.dumps({"content": None, "tool_calls": [{"id": i, "function": {"name": n, "arguments": a}} for i, n, a in calls]})


def result(i, x=1):
    return json.dumps({"tool_call_id": i, "content": x})


def got(spark, rows):
    out = C.format_chats(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()
    return sorted(out, key=lambda r: (r.conv_id is not None, r.conv_id or 0, r.position))


def test_links_order_and_validation(spark):
    rows = [
        (1, 0, "system", TOOLS),
        (1, 1, "tool", result("b")),  # comes before its call
        (1, 2, "assistant", call(("a", "add", '{"y": 2, "x": 1}'), ("z", "none", {}))),
        (1, 3, "assistant", call(("b", "add", {"x": "$call:a", "q": 1}))),
        (1, 4, "tool", result("a", {"b": 1.0, "a": [1, 2.5]})),
        (1, 5, "tool", result("a", 2)),
        (1, 6, "tool", result("nope")),
        (1, 7, "user", "plain {text"),
    ]
    out = got(spark, rows)
    assert [r.turn for r in out] == [0, 2, 4, 3, 1, 5, 6, 7]
    by = {r.turn: r for r in out}
    assert (by[2].n_calls, by[2].n_linked, by[2].n_valid) == (2, 1, 1) and (by[3].n_linked, by[3].n_valid) == (1, 0)
    assert [by[t].status for t in (0, 1, 2, 4, 5, 6, 7)] == ["plain", "linked", "calls", "linked", "duplicate", "orphan", "plain"]
    assert by[4].json == '{"content":{"a":[1,2.5],"b":1},"role":"tool","tool_call_id":"a"}'
    assert json.loads(by[2].json)["tool_calls"][0] == {"id": "a", "name": "add", "arguments": {"x": 1, "y": 2}}
    assert by[7].json == '{"content":"plain {text","role":"user"}'


def test_cycle_keeps_turns(spark):
    rows = [(1, 0, "assistant", call(("a", "f", {"x": "$call:b"}))), (1, 1, "tool", result("a")), (1, 2, "assistant", call(("b", "f", {"x": "$call:a"}))), (1, 3, "tool", result("b")), (2, 0, "user", "x")]
    out = got(spark, rows)
    assert [r.turn for r in out if r.conv_id == 1] == [0, 1, 2, 3] and {r.status for r in out if r.conv_id == 1} == {"cycle"}


def test_deep_chains_beside_a_cycle(spark):
    rows = [(1, 0, "assistant", call(("a", "f", {"x": "$call:b"}))), (1, 1, "tool", result("a")), (1, 2, "assistant", call(("b", "f", {"x": "$call:a"}))), (1, 3, "tool", result("b"))]
    rows += [(1, -1, "assistant", call(("c", "f", {"x": "$call:b"}))), (1, 4, "tool", result("c"))]  # after the cycle, not on it
    # conversation 2: 50 calls, each of the result before, all turns reversed; conversation 3: a chain of 40 messages
    for conv, n in ((2, 50), (3, 20)):
        for i in range(n):
            rows += [(conv, -2 * i, "assistant", call((str(i), "f", {"x": f"$call:{i - 1}"} if i else {}))), (conv, -2 * i - 1, "tool", result(str(i)))]
    out = got(spark, rows)
    for conv in (2, 3):
        mine = [r for r in out if r.conv_id == conv]
        assert [r.turn for r in mine] == [-k for k in range(len(mine))] and {r.status for r in mine} == {"calls", "linked"}
    assert [(r.turn, r.status) for r in out if r.conv_id == 1] == [(0, "cycle"), (1, "cycle"), (2, "cycle"), (3, "cycle"), (-1, "calls"), (4, "linked")]


def test_plain_tables_keep_the_order_of_turns(spark, sf):
    df = spark.read.parquet(f"{sf}/conversations.parquet")
    want = {}
    for r in sorted(df.collect(), key=lambda r: (r.conv_id, r.turn)):
        want[r.conv_id, r.turn] = (sum(k[0] == r.conv_id for k in want), schema.canonical({"role": r.role, "content": r.text}))
    out = C.format_chats(df).collect()
    assert len(out) == len(want) and all(want[r.conv_id, r.turn] == (r.position, r.json) for r in out)


def test_long_conversation_spans_tasks(spark):
    rows = [(7, t, "user", f"m{t}") for t in range(3000)] + [(8, t, "user", "x") for t in range(5)]
    random.seed(1)
    random.shuffle(rows)
    assert all(r.turn == r.position for r in got(spark, rows))


def test_edges(spark):
    rows = [(None, 0, "user", "a"), (None, None, None, None), (1, 0, "user", "x"), (1, 0, "user", "x"), (1, 1, "tool", '{"tool_call_id": null}'), (1, 2, "assistant", '{"tool_calls": "no"}'), (1, 3, "assistant", "{broken")]
    out = got(spark, rows)
    assert len(out) == 7 and [(r.conv_id, r.position) for r in out] == [(None, 0), (None, 1), (1, 0), (1, 1), (1, 2), (1, 3), (1, 4)]
    assert C.format_chats(spark.createDataFrame([], SCHEMA)).count() == 0
    df = spark.createDataFrame([(1, 0, "user", "x", 5, "y")], SCHEMA + ", m int, json string")
    assert C.format_chats(df).first().json == '{"content":"x","role":"user"}'


@pytest.mark.parametrize(
    "value, rule, fine",
    [(1, {"type": "integer"}, True), (True, {"type": "integer"}, False), (1.0, {"type": "integer"}, True), ([1, "a"], {"type": "array", "items": {"type": "integer"}}, False), ("a", {"enum": ["a"]}, True), ({}, {"required": ["x"]}, False), (5, {"maximum": 4}, False), (None, {"type": ["null", "string"]}, True), (1, {"anyOf": [{"type": "string"}, {"const": 1}]}, True), ("abc", {"maxLength": 2}, False)],
)
def test_schema(value, rule, fine):
    assert schema.valid(value, rule) is fine


MORE = [
    ({"a": 1}, {"$ref": "#/$defs/x", "$defs": {"x": {"required": ["a"]}}}, True), ({"a": {"a": {}}}, {"properties": {"a": {"$ref": "#"}}, "maxProperties": 1}, True), (1, {"$ref": "#/nope"}, False), (1, {"$ref": "#"}, False), (1, {"$ref": "http://x/y"}, False),
    (4, {"multipleOf": 2}, True), (0.3, {"multipleOf": 0.1}, True), (10**400, {"multipleOf": 3, "minimum": 0}, False), (5, {"exclusiveMinimum": 5}, False), (5, {"exclusiveMaximum": 6}, True),
    ([1, 1.0], {"uniqueItems": True}, False), ([1, True], {"uniqueItems": True}, True), (1, {"enum": [True]}, False), (1, {"oneOf": [{"minimum": 0}, {"maximum": 5}]}, False), (1, {"not": {"type": "string"}}, True),
    ("ab1", {"pattern": "^[a-z]+[0-9]$"}, True), ("ab", {"pattern": "("}, False), ("a" * 5000 + "!", {"pattern": "^(a|aa)+$"}, False), ({"x_1": 2}, {"patternProperties": {"^x_": {"type": "string"}}}, False), ({"ab": 1}, {"propertyNames": {"maxLength": 1}}, False),
    ({"a": 1}, {"dependentRequired": {"a": ["b"]}}, False), ([1, "a", 2], {"prefixItems": [{"type": "integer"}, {"type": "string"}], "items": {"type": "integer"}}, True), ([1, 2], {"contains": {"const": 2}, "maxContains": 1}, True), (3, {"if": {"minimum": 2}, "then": {"maximum": 2}}, False),
    (1, False, False), (1, True, True), (1, 5, False), (1, {}, True), (1, {"title": 7, "format": []}, True),
]


@pytest.mark.parametrize("value, rule, fine", MORE)
def test_more_of_schemas(value, rule, fine):
    assert schema.valid(value, rule) is fine


BAD = [{"required": 5}, {"properties": []}, {"properties": {"x": 3}}, {"minItems": "1"}, {"enum": 4}, {"anyOf": 4}, {"anyOf": []}, {"type": [{}]}, {"type": {}}, {"type": "number "}, {"maximum": "9"}, {"items": 3}, {"allOf": {}}, {"multipleOf": 0}, {"minLength": -1}, {"additionalProperties": "no"}, {"$ref": 4}, 7, None, "x", []]


@pytest.mark.parametrize("rule", BAD)
def test_malformed_schemas_are_met_by_nothing(rule):
    for value in (None, 1, "a", [1], {"x": 1}):
        assert schema.valid(value, rule) is False


def test_schemas_of_many_ways_end():
    rule = {"anyOf": [{"allOf": [{"$ref": "#"}, {"$ref": "#/properties/a"}]}, {"type": "integer"}], "properties": {"a": {"anyOf": [{"$ref": "#"}, {"$ref": "#"}]}}}
    value: dict = {}
    for _ in range(60):
        value = {"a": value}
    assert schema.valid(value, rule) is False  # #, through allOf, leads back to itself


def test_bad_texts_do_not_end_the_job(spark):
    deep = "[" * 3000 + "]" * 3000
    rows = [(1, 0, "system", json.dumps({"tools": [{"name": "f", "parameters": {"required": 5}}, {"name": "g", "parameters": {}}]})), (1, 1, "assistant", call(("a", "f", {"x": 1}), ("b", "g", {"x": "\ud800"}), ("\udfff", "g", {})))]
    rows += [(1, 2, "tool", result("\udfff", "\ud800 x")), (1, 3, "user", '{"tool_calls": ' + deep + "}"), (1, 4, "assistant", call(("c", "g", deep))), (1, 5, "user", "{" + "x" * 2_000_000), (1, 6, "assistant", json.dumps({"tool_calls": [{"id": "d", "name": "g", "arguments": {"n": 10**400, "f": 1e308 * 10}}]}))]
    by = {r.turn: r for r in got(spark, rows)}
    assert (by[1].n_calls, by[1].n_linked, by[1].n_valid) == (3, 1, 2) and by[2].status == "linked"
    assert '"\\ud800 x"' in by[2].json and json.loads(by[2].json)["content"] == "\ud800 x"
    assert by[3].status == "plain" and by[4].n_calls == 1 and by[5].status == "plain" and by[6].n_valid == 1


def plain_places(t, links):
    """Places by reachability and recursion."""
    after = {m: [a for a, b in links if b == m] for m in t}

    def reach(m):
        seen, todo = set(), list(after[m])
        while todo:
            x = todo.pop()
            if x not in seen:
                seen.add(x)
                todo += after[x]
        return seen

    cyclic = {m for m in t if m in reach(m)}
    known = {m: (t[m], 0) for m in cyclic}

    def place(m):
        if m not in known:
            known[m] = max([(t[m], 0), *((place(a)[0], place(a)[1] + 1) for a in after[m])])
        return known[m]

    return {m: (*place(m), m in cyclic) for m in t}


@pytest.mark.parametrize("seed, n, share, local", [(1, 400, 0.6, 1 << 19), (2, 400, 1.2, 1 << 19), (3, 14, 1.1, 0), (4, 12, 1.6, 0)])
def test_places_of_random_graphs(spark, seed, n, share, local):
    rnd = random.Random(seed)
    t = {m: rnd.randrange(n) for m in range(n)}
    links = {(rnd.randrange(n), rnd.randrange(n)) for _ in range(int(n * share))}
    nodes, edges = spark.createDataFrame(list(t.items()), "m long, t long"), spark.createDataFrame(list(links), "a long, b long")
    found = {r.m: (r.et, r.level, r.cyclic) for r in ordering.places(nodes, edges, local).collect()}
    want = plain_places(t, links)
    assert {m: found.get(m, (t[m], 0, False)) for m in t} == want and any(w[2] for w in want.values())


def test_reversed_chain_of_two_hundred(spark):
    t = {m: 200 - m for m in range(200)}
    links = [(m, m + 1) for m in range(199)] + [(500, 501), (501, 500)]
    nodes = spark.createDataFrame([*t.items(), (500, 3), (501, 4)], "m long, t long")
    found = {r.m: (r.et, r.level, r.cyclic) for r in ordering.places(nodes, spark.createDataFrame(links, "a long, b long")).collect()}
    assert all(found[m] == (200, m, False) for m in t) and found[500] == (3, 0, True)


SLOW = "a" * 60 + "!"  # backtracking takes for ever on this and (a|aa)+
LONG = [
    ("a" * 5000 + "!", {"pattern": "^(a|aa)+$"}, False), (SLOW, {"not": {"pattern": "^(a|aa)+$"}}, True), (SLOW, {"pattern": "^(a|aa)+$|!$"}, True), (SLOW + "b", {"pattern": r"^((?:a|a{2})+$|(?=.*\w$).*[^!]$)"}, True),
    ({SLOW + "b": 1}, {"patternProperties": {"^((a|aa)+$|.*b$)": False}}, False), ({SLOW: 1}, {"patternProperties": {"^(a|aa)+$": False}, "additionalProperties": {"type": "integer"}}, True), ({SLOW: 1}, {"propertyNames": {"pattern": "^(a|aa)+$|!$"}}, True),
    (SLOW, {"pattern": r"^(a|aa)+\1$"}, None), (SLOW, {"not": {"pattern": r"^(a|aa)+\1$"}}, None), ("aa", {"pattern": r"^(a)\1$"}, True), ("a", {"pattern": "("}, None), ("a", {"not": {"pattern": "("}}, None), ("a", {"maxLength": "1"}, None), ("a", {"$ref": "#"}, None),
]


@pytest.mark.parametrize("value, rule, said", LONG)
def test_no_verdict_is_told_from_false(value, rule, said):
    assert schema.verdict(value, rule) is said and schema.valid(value, rule) is (said is True)


def test_nesting_within_the_bound_has_a_verdict():
    rule = {"anyOf": [{"$ref": "#/$defs/n"}], "$defs": {"n": {"properties": {"a": {"$ref": "#"}}, "required": ["a"]}}}
    value, broken = {"a": 1}, {"b": 1}
    for _ in range(120):
        value, broken = {"a": value}, {"a": broken}
    assert schema.verdict(value, rule) is True and schema.verdict(broken, rule) is False


def a_pattern(rnd, depth):
    kind = rnd.random()
    if depth == 0 or kind < 0.3:
        return rnd.choice(["a", "b", ".", "[ab]", "[^a]", "[]b-d]", r"\w", r"\b", r"\B", "^", "$", r"\.", r"\p{L}", r"\x61", "[[:alpha:]1]"])
    if kind < 0.5:
        return a_pattern(rnd, depth - 1) + a_pattern(rnd, depth - 1)
    if kind < 0.65:
        return f"({a_pattern(rnd, depth - 1)}|{a_pattern(rnd, depth - 1)})"
    if kind < 0.75:
        return rnd.choice(["(?=", "(?!", "(?<=", "(?<!"]) + a_pattern(rnd, depth - 1) + ")"
    return f"(?:{a_pattern(rnd, depth - 1)})" + rnd.choice(["*", "+", "?", "{2}", "{1,2}", "{2,}", "{,2}", "*?", "{0,3}?", "{0}"])


def test_patterns_without_backtracking_find_what_regex_finds():
    rnd, found = random.Random(4), 0
    for _ in range(4000):
        pattern, text = a_pattern(rnd, rnd.randint(1, 4)), "".join(rnd.choice("aab1 .\n-é") for _ in range(rnd.randint(0, 9)))
        want = regex.search(pattern, text) is not None
        found += want
        assert patterns.occurs(pattern, text) is want, (pattern, text)
    assert 1000 < found < 3500
    for pattern in (r"(a)\1", "(?>a+)", "a++", "(?i)a", r"(?P<x>a)(?P=x)", "(?:a){e<=1}", r"a\Gb", "(a)?(?(1)b|c)"):
        with pytest.raises(patterns.Unable):
            patterns.occurs(pattern, "a")


def test_unchecked_calls_are_counted_apart(spark):
    rules = {"slow": {"pattern": "^(a|aa)+$|!$"}, "not": {"not": {"pattern": "^(a|aa)+$|!$"}}, "back": {"not": {"pattern": r"^(a|aa)+\1$"}}, "bad": {"pattern": "("}, "off": {"required": 5}}
    rows = [(1, 0, "system", json.dumps({"tools": [{"name": n, "parameters": {"properties": {"x": r}} if n != "off" else r} for n, r in rules.items()]}))]
    rows += [(1, k, "assistant", call((str(k), n, {"x": SLOW}))) for k, n in enumerate([*rules, "none"], 1)]
    rows += [(1, 9, "assistant", call(*((n, n, {"x": SLOW}) for n in [*rules, "none"]))), (2, 0, "user", "x")]
    by = {(r.conv_id, r.turn): (r.n_calls, r.n_valid, r.n_unchecked) for r in got(spark, rows)}
    assert [by[1, k] for k in range(1, 7)] == [(1, 1, 0), (1, 0, 0), (1, 0, 1), (1, 0, 1), (1, 0, 1), (1, 0, 0)]
    assert by[1, 9] == (6, 1, 3) and by[1, 0] == by[2, 0] == (0, 0, 0)
