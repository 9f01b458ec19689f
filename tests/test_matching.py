"""Containment, similarity, order and grounding against plain versions of the same."""

import random
from difflib import SequenceMatcher, get_close_matches

import pytest
from pyspark.sql import functions as F

from lathe.functions.numbers import NUMBER  # noqa: F401  the rule that the tests' numbers follow
from lathe.operators import matching as M
from lathe.operators import ordering as O
from lathe.operators import relational as R
from lathe.operators import toolbox as B
from lathe.sources import scratch


def words(n, rng, letters="abcde", longest=9):
    return ["".join(rng.choice(letters) for _ in range(rng.randint(1, longest))) for _ in range(n)]


def test_containing_finds_every_pattern_in_every_block(spark, monkeypatch):
    rng = random.Random(1)
    texts = [(i, " ".join(words(rng.randint(0, 30), rng))) for i in range(200)] + [(900, None), (901, ""), (901, "ab ab"), (902, "é漢\x00字")]
    patterns = [(i, w) for i, w in enumerate(words(60, rng, longest=4))] + [(100, ""), (101, None), (102, "ab"), (103, "ab"), (104, "漢\x00")]
    want = sorted((k, n) for k, t in texts for n, p in patterns if t is not None and p is not None and p in t)
    a, b = spark.createDataFrame(texts, "k long, t string").repartition(3), spark.createDataFrame(patterns, "n int, p string")
    assert sorted(map(tuple, M.containing(a, "k", "t", b, "n", "p").collect())) == want
    whole = scratch.blocks
    monkeypatch.setattr(M, "blocks", lambda df, text: whole(df, text, rows=7))
    assert sorted(map(tuple, M.containing(a, "k", "t", b, "n", "p").collect())) == want
    assert M.containing(a, "k", "t", b.limit(0), "n", "p").count() == M.containing(a.limit(0), "k", "t", b, "n", "p").count() == 0


def test_first_contained(spark, monkeypatch):
    rng = random.Random(2)
    facts = [(i, w, f"v{i}") for i, w in enumerate(words(80, rng, "ab", 6))]
    asked = sorted(set(words(150, rng, "ab", 5) + ["", "c"]))
    want = {q: next(((o, v) for o, k, v in facts if k in q or q in k), None) for q in asked}
    f, q = spark.createDataFrame(facts, "ord int, key string, value string"), spark.createDataFrame([(x,) for x in asked] + [(None,)], "q string").repartition(3)
    run = lambda: {r.q: (r.ord, r.value) for r in M.first_contained(q, "q", f).collect()}
    assert run() == {k: v for k, v in want.items() if v}
    whole = scratch.blocks
    monkeypatch.setattr(M, "blocks", lambda df, text: whole(df, text, rows=9))
    assert run() == {k: v for k, v in want.items() if v}


@pytest.mark.parametrize("cutoff", [0.7, 0.78, 0.82, 0.9])
def test_closest_is_what_comparing_all_pairs_finds(spark, cutoff):
    rng = random.Random(3)
    keys = sorted(set(words(250, rng, "abcdef", 8) + ["", "a", "ab"]))
    asked = sorted(set([k[: i % 5] + rng.choice("abx") + k[i % 5 + i % 2 :] for i, k in enumerate(keys)] + words(60, rng, "abcdef", 5) + ["ab", "axb", ""]))
    got = M.closest(spark.createDataFrame([(x,) for x in asked] + [(None,)], "query string"), spark.createDataFrame([(x,) for x in keys], "key string"), cutoff)
    want = {}
    for q in asked:
        near = [(SequenceMatcher(None, k, q).ratio(), k) for k in keys if k and q]
        if near and max(near)[0] >= cutoff:
            want[q] = max(near)[1]
    assert {r.query: r.key for r in got.collect()} == want


def test_closest_of_ten_thousand_names_verifies_few_pairs(spark):
    rng = random.Random(4)
    part = ["ka", "to", "mi", "ren", "sol", "ba", "dur", "fen", "gil", "hor", "lak", "nim", "pos", "qua", "rix", "vet", "wul", "zan"]
    keys = list({"".join(rng.choice(part) for _ in range(rng.randint(3, 6))) for _ in range(11_000)})[:10_000]
    asked = [k[:3] + "x" + k[4:] for k in keys[:40]]
    q, f = spark.createDataFrame([(x,) for x in asked], "query string"), spark.createDataFrame([(x,) for x in keys], "key string")
    n = M.like_candidates(q, f, 0.78).count()
    assert n < 0.02 * len(asked) * len(keys)
    assert {r.query: r.key for r in M.closest(q, f, 0.78).collect()} == {a: m[0] for a in asked if (m := get_close_matches(a, keys, 1, 0.78))}


def test_closest_name_and_toolbox(spark):
    calls = [(1, " clac ", '{"expr":"2+3"}'), (2, "calc", '{"expr":"2+3"}'), (3, "serch_memory", '{"key":"verson "}'), (4, "search_memory", '{"key":"budget"}'), (5, "web_search", '{"query":"What is the Largest planet??"}'), (6, "web_search", '{"query":"zzz"}'), (7, "now", "{}"), (8, "calc", "[1]"), (9, "calc", '{"x":1}'), (10, "calc", None), (11, "look", '{"at":1}'), (12, "look", '{"at":2}'), (13, "finish", "{}")]
    memory = spark.createDataFrame([("version", "0.1"), ("owner", "me")], "key string, value string")
    facts = spark.createDataFrame([(0, "largest planet", "Jupiter")], "ord int, key string, value string")
    seen = spark.createDataFrame([("look", '{"at":1}', "a tree")], "name string, arguments string, result string")
    got = {r.call_id: r.result for r in B.run_calls(spark.createDataFrame(calls, "call_id int, name string, arguments string"), memory, facts, "noon", seen).collect()}
    assert got == {1: "ERROR: unknown tool 'clac'", 2: "5", 3: "0.1", 4: "not found", 5: "Jupiter", 6: "no results found", 7: "noon", 8: "ERROR: tool args must be a JSON object", 9: "ERROR: missing required parameters ['expr']", 10: "ERROR: tool args must be a JSON object", 11: "a tree", 12: "ERROR: this call was never recorded", 13: "done"}


def test_no_nested_loops(spark):
    a, b = spark.createDataFrame([("x", "y")], "k string, t string"), spark.createDataFrame([(1, "y", "v")], "ord int, key string, value string")
    for df in (M.containing(a, "k", "t", b, "ord", "key"), R.cascading_lookup(a, b, "t")):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in plan and "Cartesian" not in plan


@pytest.mark.parametrize("partitions", [1, 5])
def test_ranks_and_numbers_across_ranges(spark, partitions):
    rng = random.Random(5)
    rows = [(i, rng.choice(["hot", "hot", "hot", "b", None]), rng.choice([None, float("nan"), *map(float, range(12))])) for i in range(3000)]
    df = spark.createDataFrame(rows, "id int, family string, score double").repartition(partitions)
    key = lambda s, down: (1, 0.0) if s is None else (0, (-1 if down else 1) * (1e9 if s != s else s))
    for down in (False, True):
        got = {r.id: r.rank for r in O.ranked(df, "family", "score", descending=down).collect()}
        for f in ("hot", "b", None):
            mine = [(i, key(s, down)) for i, g, s in rows if g == f]
            values = sorted(k for _, k in mine)
            assert all(got[i] == values.index(k) + 1 for i, k in mine)
    n = {r.id: r.number for r in O.numbered(df, "id").collect()}
    assert n == {i: i for i in range(3000)}
    assert O.numbered(df.limit(0), "id").count() == O.ranked(df.limit(0), "family", "score").count() == 0


def test_ungrounded_against_all_pairs(spark):
    rng = random.Random(6)
    base = [0.0, 1e-19, -1e-19, 3e-13, 1e-12, 1.0000001e-12, 7.0, 7.000001, 7.0000069, 7.00002, -7.0, 1e300, float("inf"), float("nan")]
    rows = [(t, pos, rng.choice(base) * rng.choice([1, 1, 1 + 4e-7, 1 - 9e-7]), rng.random() < 0.5) for t in range(30) for pos in range(60)]
    close = lambda a, b: a == b or abs(a - b) / max(abs(a), abs(b), 1e-12) <= 1e-6
    want = sorted((t, p, repr(v)) for t, p, v, use in rows if use and not any(s == t and q < p and not u and close(w, v) for s, q, w, u in rows))
    df = spark.createDataFrame(rows, "trace_id int, pos int, value double, is_use boolean").repartition(3)
    got = sorted((r.trace_id, r.pos, repr(r.value)) for r in R.ungrounded(df).collect())
    assert got == want


def test_grounding_of_a_long_trace_is_not_quadratic(spark):
    from lathe.operators.mixes import grounding

    calls = "".join(f'<assistant>{{"thought":"t","tool_call":{{"name":"calc","arguments":{{"expr":"{i} + 1"}}}}}}</assistant>\n<tool name=calc>{i + 1}</tool>\n' for i in range(20_000))
    bad = '<assistant>{"thought":"t","tool_call":{"name":"calc","arguments":{"expr":"77777777 + 1"}}}</assistant>'
    df = spark.createDataFrame([(1, f"<user>from 0 by 1</user>\n{calls}"), (2, f"<user>from 0 by 1</user>\n{calls}{bad}"), (3, None), (4, '<assistant>{"tool_call":{"name":"calc","arguments":{"expr":}}}</assistant>')], "id int, trace string")
    got = {r.id: (r.ok, r.problems) for r in grounding(df, "id", "trace").collect()}
    assert got[1] == (True, []) and got[2] == (False, ["hop 20001 (calc): value 77777777 not grounded in prior context"]) and got[3] == (True, [])


def test_scratch_tables_can_be_cleared(spark):
    df = scratch.written(spark.range(3))
    assert df.count() == 3
    where = df.inputFiles()[0]
    assert scratch.folder(spark).split("/")[-1] in where
