"""Composed traces and scenarios: enough of them, sound, the same at any partitioning, and what plain code makes."""

import hashlib
import json
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lathe.functions.numbers import calculate
from lathe.operators import compose as C
from lathe.operators import scenarios as S
from lathe.operators.mixes import grounding
from lathe.operators.ordering import numbered
from lathe.operators.traces import calls

FACTS = [("length of the nile", "6,650 km"), ("moons of mars", "2"), ("largest planet", "Jupiter"), ("height of fuji", "3776.24 m"), ("x" * 70, "1"), ("empty", "")]
MEMORY = [("version", "0.1"), ("leader", "nobody"), ("count", "12 items")]
RECORDED = [("repo_read", "Read a.", "read_file", '{"path":"a"}', "line", None), ("sandbox", "Count to 3?", "run_python", '{"code":"print(3)"}', "3", None), ("sandbox", "Count to 4?", "run_python", '{"code":"print(4)"}', "4", "It is 4.")]
CALL = re.compile(r'"tool_call":(\{"name":"\w+","arguments":.*\})\}</assistant>\n<tool name=(\w+)>(.*)</tool>')


@pytest.fixture(scope="module")
def make(spark):
    kv = lambda rows: spark.createDataFrame(rows, "key string, value string")
    recorded = spark.createDataFrame(RECORDED, "pattern string, question string, tool string, arguments string, result string, answer string")
    thoughts = spark.createDataFrame([("calc_call", 'A "quoted" thought.'), ("calc_call", "Another.")], "situation string, text string")
    phrases = spark.createDataFrame([("math", "Work out {EXPR}."), ("web", "Find {TOPIC}.")], "intent string, text string")
    return C.Composer(kv(FACTS), kv(MEMORY), "2026-01-01", recorded, thoughts, phrases, seed=5)


def u(seed, *parts):
    return int(hashlib.md5(":".join(map(str, (seed, *parts))).encode()).hexdigest()[:8], 16)


def test_alias_tables_hold_the_weights():
    for weights in (C.INSTRUCT, C.CHAT, C.MIXED, {"a": 1}, {"a": 2, "b": 2}, {"a": 1, "b": 0, "c": 99}):
        names, bounds, others = C.alias_table(weights)
        got, total = Counter(), sum(weights.values())
        for n, b, o in zip(names, bounds, others, strict=True):
            got[n] += b
            got[o] += total - b
        assert all(got[k] == w * len(weights) for k, w in weights.items())


def test_exactly_n_sound_traces(spark, make):
    got, report = C.filled(spark, make.traces, 300, max_len=520)
    rows = got.collect()
    assert len(rows) == len({r.trace_id for r in rows}) == 300 and all(len(r.trace) <= 520 for r in rows)
    assert all(r.ok for r in grounding(got, "trace_id", "trace").collect())
    values = dict(FACTS) | dict(MEMORY)
    for r in rows:
        assert r.trace.endswith("\x03") and r.trace.count("\x03") == 1
        for call, tool, result in CALL.findall(r.trace):
            c = json.loads(call)
            assert c["name"] == tool
            want = {"calc": lambda a: calculate(a["expr"]), "web_search": lambda a: values[a["query"]], "search_memory": lambda a: values[a["key"]], "now": lambda a: "2026-01-01"}.get(tool)
            assert want is None or want(c["arguments"]) == result
    r = {x.pattern: x for x in report.collect()}
    assert sum(x.kept for x in r.values()) == 300 and r["repo_symbol"].kept == 0 and r["repo_symbol"].failed > 0
    bad = {x.pattern for x in C.starved(report).collect()}
    assert bad == {p for p, x in r.items() if x.too_long > 0.2 * (x.kept + x.too_long)}
    again, _ = C.filled(spark, lambda ids: make.traces(ids.repartition(7)), 300, max_len=520, most=9)
    assert {(x.trace_id, x.trace) for x in again.collect()} == {(x.trace_id, x.trace) for x in rows}


def test_a_trace_by_hand(spark, make):
    got = {r.trace_id: (r.pattern, r.trace) for r in make.traces(spark.range(60).withColumnRenamed("id", "trace_id"), weights={"two_stage_math": 1}).collect()}
    names = {r.text for r in make.thoughts.collect()}
    for i, (pattern, trace) in got.items():
        a, b, c = u(5, i, "a") % 98 + 2, u(5, i, "b") % 98 + 2, u(5, i, "c") % 19 + 2
        thought = json.loads(re.search(r"<assistant>(.*)</assistant>", trace)[1])["thought"]
        assert pattern == "two_stage_math" and thought in names
        said = lambda t, call: "<assistant>" + json.dumps({"thought": t} | call, separators=(",", ":")) + "</assistant>"
        run = lambda e, r: ({"tool_call": {"name": "calc", "arguments": {"expr": e}}}, f"<tool name=calc>{r}</tool>")
        (c1, t1), (c2, t2) = run(f"{a} * {b}", a * b), run(f"{a * b} + {c}", a * b + c)
        assert trace == "\n".join([f"<user>Multiply {a} and {b}, then add {c}.</user>", said(thought, c1), t1, said("Now the arithmetic.", c2), t2, said("That is the final result.", {"response": str(a * b + c)})]) + "\x03"


def test_shares_follow_the_weights_and_empty_pools_fall_back(spark, make):
    n = 4000
    ids = spark.range(n).withColumnRenamed("id", "trace_id")
    got = {r.pattern: r["count"] for r in make.bound(ids, C.CHAT).groupBy("pattern").count().collect()}
    assert all(abs(got[k] / n - w / 100) < 0.03 for k, w in C.CHAT.items())
    none = spark.createDataFrame([], "key string, value string")
    poor = C.Composer(none, none, "now")
    rows = poor.traces(spark.range(40).withColumnRenamed("id", "trace_id"), chat=True, systems=("Be brief.",), system_share=1.0).collect()
    assert len(rows) == 40 and all(r.trace.startswith("<system>Be brief.</system>\n<user>") and "web_search" not in r.trace for r in rows)
    assert poor.traces(spark.range(0).withColumnRenamed("id", "trace_id")).count() == 0


def test_conversations_and_mixed_kinds(spark, make):
    ids = spark.range(120).withColumnRenamed("id", "trace_id")
    for weights, chat in ((C.CONVERSATIONS, True), (C.MIXED, False), (C.SIMPLE, False)):
        judged = C.judged(make.traces(ids, chat=chat, weights=weights), 5000).collect()
        assert {r.pattern for r in judged} <= set(weights) and all(r.reason is None for r in judged)


PLANS = [
    (0, [("Say hello.", ["time"]), ("Then?", ["compute"])]),
    (1, [("Look.", ["lookup_fact", "compute", "failing_call", "combine"]), ("More.", ["compute", "run_code", "compute"])]),
    (2, [("Nothing.", ["compute", "inspect_code"]), ("Fails.", ["failing_call"]), ("Stored.", ["lookup_memory", "compute"])]),
]


def scenarios(spark, seed=3):
    plans = spark.createDataFrame([(i, [{"user": q, "steps": [{"kind": k} for k in ks]} for q, ks in turns]) for i, turns in PLANS], "plan_id int, turns array<struct<user:string,steps:array<struct<kind:string>>>>")
    kv = lambda rows: spark.createDataFrame(rows, "key string, value string")
    sandbox = spark.createDataFrame([("Count to 3?", "run_python", '{"code":"print(3)"}', "3")], "question string, tool string, arguments string, result string")
    told = spark.createDataFrame([("Thing", "a.py:1\nclass Thing\n\n" + "d" * 400)], "name string, text string")
    return S.Scenarios(plans, kv(FACTS[:4]), kv(MEMORY), "2026-01-01", seed, sandbox, told)


def test_scenarios_are_sound_and_do_not_depend_on_partitions(spark):
    ids = spark.range(60).withColumnRenamed("id", "trace_id")
    judged = C.judged(scenarios(spark).traces(ids), 16384).collect()
    invented = lambda r: r.reason == "ungrounded" and '"10 / 0"' in r.trace  # noqa: E731  the one failing call whose numbers nobody gave
    assert len(judged) == 60 and all(r.reason is None or invented(r) for r in judged) and sum(r.reason is None for r in judged) > 40
    again = {r.trace_id: r.trace for r in scenarios(spark).traces(ids.repartition(9)).collect()}
    assert again == {r.trace_id: r.trace for r in judged}
    text = "\n".join(r.trace for r in judged)
    assert "That lookup failed, so I could not use it." in text and "d\n...</tool>" in text and "Now take " in text
    found = calls(spark.createDataFrame([(r.trace_id, r.trace) for r in judged], "id int, trace string"), "id").collect()
    values = dict(FACTS[:4]) | dict(MEMORY)
    for c in found:
        a = json.loads(c.arguments)
        if c.name == "calc" and a["expr"] != "10 / 0":
            assert calculate(a["expr"]) == c.result
        if c.name == "web_search" and a["query"] in values:
            assert values[a["query"]] == c.result


def test_a_fold_by_hand():
    step = lambda turn, kind, **more: dict.fromkeys(("key", "tool", "arguments", "result")) | {"turn": turn, "kind": kind, "asked": "Please.", "op": "*", "k": 3, "reference": "it"} | more
    steps = [step(0, "compute"), step(0, "lookup_fact", key="nile", tool="web_search", arguments='{"query":"nile"}', result="6,650 km"), step(0, "combine"), step(1, "failing_call", tool="calc", arguments='{"expr":"10 / 0"}', result="ERROR: division by zero"), step(2, "compute", op="-", k=5)]
    got = [(m["role"], m["said"] or m["arguments"]) for m in S.folded(steps)]
    assert got == [
        ("user", "Look up the nile, then multiply by 3."),
        ("assistant", '{"query":"nile"}'),
        ("tool", "6,650 km"),
        ("assistant", '{"expr":"6650 * 3"}'),
        ("tool", "19950"),
        ("assistant", "19950"),
        ("user", "Please."),
        ("assistant", '{"expr":"10 / 0"}'),
        ("tool", "ERROR: division by zero"),
        ("assistant", "That lookup failed, so I could not use it."),
        ("user", "Now take it and subtract 5."),
        ("assistant", '{"expr":"19950 - 5"}'),
        ("tool", "19945"),
        ("assistant", "19945"),
    ]
    assert S.folded([step(0, "compute")]) is None and S.folded([]) is None


def test_lookup_chains_by_hand(spark):
    from lathe.operators.generate import lookup_chains

    facts = spark.createDataFrame([(f"k{i}", f"{i} units", float(i)) for i in range(1, 8)], "key string, value string, number double")
    order = {r.number: (r.key, r.value) for r in numbered(facts, "key").collect()}
    for r in lookup_chains(spark, 40, facts, hops=5, seed=9).collect():
        at = 0.0
        for i, s in enumerate(r.steps):
            if i % 3 == 0:
                key, value = order[u(9, r.trace_id, f"fact{i}") % 7]
                at += float(value.split()[0])
                assert (s.tool, s.argument, s.result) == ("web_search", key, value)
            else:
                v, op = float(u(9, r.trace_id, f"v{i}") % 9 + 2), "+-"[u(9, r.trace_id, f"op{i}") % 2]
                assert s.argument == f"{at} {op} {v}"
                at += v if op == "+" else -v
            assert s.at == at
        assert r.value == at
    assert lookup_chains(spark, 5, facts.limit(0)).count() == 0
