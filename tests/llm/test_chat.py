from __future__ import annotations

import json

from tellurix.llm import chat

SCHEMAS = {"sum": {"a": ("number", True), "b": ("integer", False), "note": ("string", False)}, "list": {"items": ("array", True), "opts": ("object", False), "deep": ("boolean", False)}}
CALLS = "conv_id long, call_id string, position long, name string, arguments string, level int, status string"
RESULTS = "conv_id long, call_id string, position long, content string, answered boolean"


def link(spark, calls, results):
    c = spark.createDataFrame([(*x, 9, "x") for x in calls], CALLS)
    r = spark.createDataFrame([(*x, True) for x in results], RESULTS)
    rows = sorted(chat.link(c, r, SCHEMAS, spark).collect(), key=lambda r: (r.conv_id, r.level, r.position, r.call_id))
    return rows, {(r.conv_id, r.call_id): r for r in rows}


def test_links_states_and_canonical_json(spark):
    calls = [
        (1, "a", 1, "sum", '{"b": 2, "a": 1.50}'), (1, "b", 3, "sum", '{"a": "x", "z": 1}'), (1, "c", 5, "none", "{}"), (1, "d", 6, "list", "not json"),
        (1, "e", 7, "list", '{"items": [1, {"k": "é", "b": null}], "opts": {"y": 1, "x": 2}, "deep": true}'), (1, "f", 9, "sum", '{"b": 1.5, "a": 2}'), (1, "g", 10, "sum", None), (1, "a", 12, "sum", '{"a": 9}'),
    ]
    results = [(1, "a", 2, "3.5"), (1, "e", 4, "too soon"), (1, "zz", 11, "nobody asked"), (1, "a", 13, "again")]
    _, by = link(spark, calls, results)
    state = {k[1]: (r.status, list(r.problems)) for k, r in by.items()}
    assert state["a"] == ("ok", []) and state["e"] == ("early", []) and state["zz"] == ("orphan", [])
    assert state["b"] == ("invalid", ["a is no number", "unknown z"]) and state["c"] == ("invalid", ["unknown tool"])
    assert state["d"][1] == state["g"][1] == ["arguments are no JSON object"] and state["f"] == ("invalid", ["b is no integer"])
    assert by["1", "a"].message == '{"call":{"arguments":{"a":1.5,"b":2},"id":"a","name":"sum"},"result":{"call_id":"a","content":"3.5"},"status":"ok"}'
    for r in by.values():
        assert r.message == json.dumps(json.loads(r.message), sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def test_order_follows_references(spark):
    ref = lambda *x: json.dumps({"items": [f"${i}" for i in x]})
    calls = [(1, "late", 1, "list", ref("mid")), (1, "mid", 2, "list", ref("last", "first")), (1, "first", 3, "list", ref()), (1, "last", 4, "list", ref("first")), (1, "free", 5, "list", ref("unknown"))]
    calls += [(2, "x", 1, "list", ref("y")), (2, "y", 2, "list", ref("x")), (2, "z", 3, "list", ref("y")), (2, "w", 4, "list", ref())] + [(3, "s", 1, "list", ref("s"))]
    calls += [(4, f"c{i}", i, "list", ref(f"c{i - 1}") if i else ref()) for i in range(30)]
    rows, by = link(spark, calls, [])
    place = {(r.conv_id, r.call_id): i for i, r in enumerate(rows)}
    for conv, before, after in (("1", "mid", "late"), ("1", "last", "mid"), ("1", "first", "mid"), ("1", "first", "last")):
        assert place[conv, before] < place[conv, after]
    assert {k[1] for k, r in by.items() if r.status == "cyclic"} == {"x", "y", "z", "s"}
    assert [place["4", f"c{i}"] for i in range(30)] == sorted(place["4", f"c{i}"] for i in range(30)) and by["4", "c29"].level == 0


def test_nulls_repeats_and_nothing(spark):
    calls = [(None, "a", 1, "sum", '{"a": 1}'), (1, None, 1, "sum", '{"a": 1}'), (1, "a", None, None, None)] + [(7, "hot", i, "sum", f'{{"a": {i}}}') for i in range(500)]
    rows, by = link(spark, calls, [(None, "a", 2, None), (1, None, 3, "x")] + [(7, "hot", i, "r") for i in range(500)])
    assert len(rows) == 3 and by["", "a"].status == "ok" and by["7", "hot"].status == "ok" and '"a":0' in by["7", "hot"].message
    assert link(spark, [], [])[0] == []


def test_levels_of_random_references(spark):
    """Levels and cycles against a plain search, and order against every reference; long chains take few rounds."""
    import random

    from tellurix.llm.common import Scratch

    r, calls = random.Random(5), []
    for conv in range(40):
        n = r.randint(1, 14)
        for i in range(n):
            to = [f"c{r.randrange(n)}" for _ in range(r.choice([0, 1, 1, 1, 2, 3]))] if conv % 3 else [f"c{r.randint(i + 1, n)}" for _ in range(r.choice([1, 1, 2]))]
            calls.append((conv, f"c{i}", i, "list", json.dumps({"items": [f"${x}" for x in to]})))
    calls += [(99, f"c{i}", i, "list", json.dumps({"items": [f"$c{i + 1}"]})) for i in range(300)] + [(98, f"c{i}", i, "list", json.dumps({"items": [f"$c{(i + 1) % 300}"]})) for i in range(300)]
    calls += [(97, f"c{i}", None, "list", json.dumps({"items": [f"$c{i + 1}"]})) for i in range(3)]
    tables, before = [], Scratch.table
    Scratch.table = lambda self, df, name: tables.append(name) or before(self, df, name)
    try:
        rows, by = link(spark, calls, [])
    finally:
        Scratch.table = before
    assert tables.count("chains") <= 11 and len(tables) < 45
    refs = {(c, i): [x for x in dict.fromkeys(json.loads(a)["items"]) if (c, x[1:]) in {k[:2] for k in calls}] for c, i, _, _, a in calls}
    at = {(c, i): -1 if p is None else p for c, i, p, _, _ in calls}

    def level(key, seen):
        if key in seen:
            return None
        below = [(level((key[0], x[1:]), seen | {key}), at[key[0], x[1:]] >= at[key] or at[key] < 0) for x in refs[key]]
        return None if any(b is None for b, _ in below) else max((b + s for b, s in below), default=0)

    for key in refs:
        if key[0] < 90 or key[0] == 97:
            want, got = level(key, frozenset()), by[str(key[0]), key[1]]
            assert (got.status == "cyclic") == (want is None) and (want is None or got.level == want), (key, want, got)
    assert [by["99", f"c{i}"].level for i in range(300)] == list(range(299, -1, -1)) and all(by["98", f"c{i}"].status == "cyclic" for i in range(300))


def test_calls_of_several_references_behind_each_other(spark, monkeypatch):
    """Chains in which each call refers to two before it in the order: tables follow the logarithm, also when all refer
    to one call as well and references are dealt in parts, and levels are the plain ones."""
    from tellurix.llm.common import Scratch

    tables, before = [], Scratch.table
    monkeypatch.setattr(Scratch, "table", lambda self, df, name: tables.append(name) or before(self, df, name))
    monkeypatch.setattr(chat, "PART", 7)
    written = []
    for n in (8, 128):
        to = {i: [j for j in dict.fromkeys((i + 1, i + 2, n)) if j <= n] for i in range(n)}
        tables.clear()
        _, by = link(spark, [(1, f"c{i}", i, "list", json.dumps({"items": [f"$c{j}" for j in to.get(i, [])]})) for i in range(n + 1)], [])
        assert [by["1", f"c{i}"].level for i in range(n + 1)] == list(range(n, -1, -1)) and all(r.status != "cyclic" for r in by.values())
        written.append(tables.count("peeled") + tables.count("dealt") + tables.count("found"))
    assert written[0] <= 6 and written[1] <= 22, written


def test_very_long_contents(spark):
    long = "é\"\n" * 6_000_000
    _, by = link(spark, [(1, "a", 1, "sum", json.dumps({"a": 1, "note": "x" * 300_000}))], [(1, "a", 2, long)])
    assert by["1", "a"].status == "ok" and json.loads(by["1", "a"].message)["result"]["content"] == long
