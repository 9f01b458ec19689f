from pyspark.sql import functions as F

from lathe.functions import numbers as N
from lathe.functions import protocol as P
from lathe.operators import evaluate as E
from lathe.operators import generate as G
from lathe.operators import pools as L


def test_salvage(spark):
    rows = [
        ('noise ["a", "b]", "c\\"d"] more', ["a", "b]", 'c"d']),
        ('see ```json { "key": "height", "value": "81 m" }, {"key":"k","value":"too short a key"}```', ['{"key":"height","value":"81 m"}']),
        ('"one more"\n  "two more" ,\n"abc"\n- "dashed"', ["one more", "two more"]),
        ('any "a": "b" pair', []),
        ("[] nothing", []),
        ("[1, 2", []),
    ]
    got = spark.createDataFrame(rows, "t string, want array<string>").select("want", L.salvage(F.col("t")).alias("got")).collect()
    assert [r.got for r in got] == [r.want for r in got]


def test_filters(spark):
    f = spark.createDataFrame([(" Rhine Length ", " 1230 km "), ("ab", "x"), ("abc", " ")], "key string, value string")
    assert [tuple(r) for r in L.facts(f).collect()] == [("rhine length", "1230 km")]
    r = spark.createDataFrame([("ok",), ("ERROR: x",), ("exit code 1\nx",), (" \n",)], "o string").select(L.sandbox_success(F.col("o")).alias("g")).collect()
    assert [x.g for x in r] == [True, False, False, False]
    r = spark.createDataFrame([("a/../b",), ("../b",), ("/r/x",), ("/q",), ("/r/..",), ("/r/a/../b",), ("/rx",)], "p string").select(L.inside(F.col("p"), "/r").alias("g")).collect()
    assert [x.g for x in r] == [True, False, True, False, False, True, False]


def test_plans(spark):
    t = "turns array<struct<user:string,steps:array<struct<kind:string>>>>"
    df = spark.createDataFrame([([("hello there", [("failing_call",)])],), ([("hi", [("compute",)])],), ([("hello", [("unknown",)])],)], t)
    r = df.select(L.valid_plan(F.col("turns")).alias("ok"), L.normalised_plan(F.col("turns")).alias("n")).collect()
    assert [x.ok for x in r] == [True, False, False] and [s.kind for s in r[0].n[0].steps] == ["failing_call", "compute"]


def test_chains_are_grounded_and_stable(spark):
    a = {r.trace_id: r for r in G.arithmetic_chains(spark, 50, 3).collect()}
    b = {r.trace_id: r.trace for r in G.arithmetic_chains(spark, 50, 3).repartition(7).collect()}
    for i, r in a.items():
        assert b[i] == r.trace and all(N.calculate(s.expr) == str(s.result) for s in r.steps) and len(r.trace) <= 768
        assert all(x.expr.split()[0] == str(y.result) for x, y in zip(r.steps[1:], r.steps, strict=False))
    calls = G.arithmetic_chains(spark, 5, 4).select(F.size(P.tool_calls(F.col("trace"))).alias("n")).collect()
    assert {r.n for r in calls} == {4}
    assert G.gated(G.arithmetic_chains(spark, 50, 3), 10, 768).count() == 10


def test_stories_and_renames(spark):
    r = G.stories(spark, 20, ["A cat sat.", "It rained all day."], 60, 80).collect()
    assert all(60 <= len(x.text) <= 80 for x in r)
    df = G.arithmetic_chains(spark, 1, 2).withColumn("u", G.used_tools(F.col("trace"), ["calc", "now"])).withColumn("r", G.rename_tools(F.col("trace"), {"calc": "evaluate"}))
    x = df.first()
    assert x.u == ["calc"] and '"name":"evaluate"' in x.r and "<tool name=calc>" not in x.r
    assert df.select(G.split_trace(F.col("trace")).alias("s")).first().s.response == str(x.steps[-1].result)


def test_evaluation(spark):
    r = spark.createDataFrame([("numeric", True), ("numeric", False), ("exact", True), ("exact", True)], "kind string, ok boolean")
    g = E.gate(r).first()
    assert not g.passed and g.reasons == ["numeric accuracy 50.00% < 60%"]
    named = spark.createDataFrame([("a", "exact", True), ("b", "exact", False)], "question string, kind string, ok boolean")
    g = E.gate(named, 0.5, 0.0, 0.5, spark.createDataFrame([("a",), ("b",), ("c",)], "question string")).first()
    assert not g.passed and g.reasons == ["required case failed: b", "required case failed: c"]
    a, b = (spark.createDataFrame([v], "x double, y double, z double") for v in ((0.1, 0.2, 0.3), (0.2, 0.3, 0.3)))
    c = E.competition(a, b, ["x", "y", "z"], 2).first()
    assert (c.wins, c.promote) == (2, True)
    old, new = (spark.createDataFrame(v, "name string, rows int, cols int") for v in ([("a", 2, 3), ("b", 2, 3), ("c", 2, 3)], [("a", 2, 3), ("b", 4, 3), ("d", 1, 1)]))
    assert {x.name: x.kind for x in E.reconcile(old, new).collect()} == {"a": "copy", "b": "grow", "c": "skip", "d": "skip"}
