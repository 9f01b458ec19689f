import json

from pyspark.sql import functions as F

from lathe.functions import numbers as N
from lathe.functions import protocol as P
from lathe.operators import evaluate as E
from lathe.operators import generate as G
from lathe.operators import kernels as K
from lathe.operators import mixes as X
from lathe.operators import pools as L
from lathe.operators import relational as R
from lathe.sources import logs


def test_number_helpers(spark):
    df = spark.createDataFrame([("6,650 km", 3.0), ("x", 0.1)], "v string, d double")
    r = df.select(N.first_number(F.col("v")).alias("n"), N.leads_with_quantity(F.col("v")).alias("q"), N.number_text("d").alias("t")).collect()
    assert [tuple(x) for x in r] == [(6650.0, True, "3"), (None, False, "0.1")]


def test_protocol_helpers(spark):
    df = spark.createDataFrame([([1, 2, 300], [0.0, 0.0, 1.0], "<user>abcdefgh</user><assistant>x")], "t array<int>, m array<double>, s string")
    r = df.select(P.has_supervision(F.col("t"), F.col("m")).alias("a"), P.within_vocabulary(F.col("t"), 273).alias("b"), P.pad(F.col("t"), F.lit(5), 0).alias("c"), P.truncate_keeping_answer(F.col("s"), 20).alias("d"), P.observation_view(F.col("s"), F.lit("obs_1"), F.lit(25), 10).alias("e")).first()
    assert (r.a, r.b, r.c, r.d) == (True, False, [1, 2, 300, 0, 0], "<user>ab<assistant>x") and r.e == "istant>x\n[obs_1: 33 bytes, showing 25-33]"


def test_history_and_kernels(spark):
    long = "<tool name=calc>" + "y" * 70 + "\n" + "x" * 100 + "</tool>"
    rows = [(1, i, long) for i in range(8)] + [(1, 8, "<assistant>a</assistant>"), (2, 0, long)]
    got = R.compact_history(spark.createDataFrame(rows, "trace_id int, pos int, content string")).orderBy("trace_id", "pos").collect()
    short = "<tool name=calc>" + "y" * 60 + "... [elided]</tool>"
    assert [r.content for r in got] == [short] * 2 + [long] * 6 + ["<assistant>a</assistant>", long]
    brief = spark.createDataFrame([(1, i, "<tool name=calc>7</tool>") for i in range(8)], "trace_id int, pos int, content string")
    assert {r.content for r in R.compact_history(brief).collect()} == {"<tool name=calc>7</tool>"}
    v = spark.createDataFrame([([1.0, -2.0],)], "v array<double>").select(K.repetition_penalty(F.col("v"), F.array(F.lit(1)), 2.0).alias("p"), K.dot(F.col("v"), F.col("v")).alias("d"), K.learning_rate(F.lit(0), 10, 100, 1.0).alias("l")).first()
    assert v.p == [1.0, -1.0] and v.d == 5.0 and v.l == 0.1
    p = spark.createDataFrame([(1, 0, 0.7), (1, 1, 0.2), (1, 2, 0.1)], "row int, token int, p double")
    assert K.min_p(p, "row", "p", 0.25).count() == 2


def test_pools_and_rewriting(spark):
    a, b = spark.createDataFrame([("k", ["b"])], "key string, values array<string>"), spark.createDataFrame([("k", ["a", "b"]), ("z", ["c"])], "key string, values array<string>")
    assert {r.key: r["values"] for r in R.merge_lists(a, b).collect()} == {"k": ["a", "b"], "z": ["c"]}
    w = spark.createDataFrame([("k", "old", 1), ("k", "new", 2)], "key string, value string, n int")
    assert L.last_writer(w, "key", "value", ["n"]).first().value == "new"
    r = spark.createDataFrame([("hELLO {X}",)], "s string").select(G.capitalise(F.col("s")).alias("a"), G.fill(F.col("s"), {"X": F.lit("y")}).alias("b"), G.context(F.lit(None).cast("string"), F.lit(None).cast("string"), F.lit("q")).alias("c"), G.to_chat_api(F.lit("assistant"), F.lit("t"), F.lit(None).cast("string"), F.lit("calc"), F.lit('{"expr":"1"}')).alias("d")).first()
    assert (r.a, r.b, r.c) == ("Hello {x}", "hELLO y", "<user>q</user>\n")
    assert json.loads(r.d)["tool_calls"][0]["function"] == {"name": "calc", "arguments": {"expr": "1"}}


def test_losses_and_comparisons(spark):
    x = spark.createDataFrame([(0, 0, 1.0, 1.0), (0, 0, 9.0, 0.0), (1, 0, 2.0, 1.0), (1, 1, 4.0, 1.0)], "batch_id int, row int, loss double, mask double")
    assert abs(E.batch_weighted_loss(x, 2).first().loss - (1 * 1 + 3 * 2) / 3) < 1e-12
    v = spark.createDataFrame([("a", 1.0, 10.0), ("b", 2.0, 20.0)], "name string, loss double, speed double")
    assert {r.name: (r.loss_pct, r.speed_ratio) for r in E.against_baseline(v, "name", "a", "loss", "speed").collect()} == {"a": (0.0, 1.0), "b": (100.0, 2.0)}


def test_result_log(spark, tmp_path):
    for i, acc in enumerate((0.5, 0.9)):
        (tmp_path / f"run_{i}.json").write_text(json.dumps({"experiment": "e", "timestamp": f"2026-01-0{i + 1}", "data": {"accuracy": acc}}, indent=1))
    (tmp_path / "other.json").write_text("{}")
    got = R.ranked_results(logs.result_log(spark, str(tmp_path), "run_"))
    assert sorted((r.file_name, r["rank"]) for r in got.collect()) == [("run_0.json", 2), ("run_1.json", 1)]
    logs.leaderboard(got, str(tmp_path / "board"))
    lines = [r.value for r in spark.read.text(str(tmp_path / "board")).collect()]
    assert lines[0] == "# Experiment Leaderboard" and lines[-2:] == ["| 2026-01-02 | e | #1 | accuracy=0.9000 | - | - | - | overall=90.0% | - | - | [run_1.json](results/run_1.json) |", "| 2026-01-01 | e | #2 | accuracy=0.5000 | - | - | - | overall=50.0% | - | - | [run_0.json](results/run_0.json) |"]
    logs.leaderboard(got.limit(0), str(tmp_path / "none"))
    assert [r.value for r in spark.read.text(str(tmp_path / "none")).collect()][-1] == "| - | - | - | No recorded results | - | - | - | - | - | - | - |"
    key = logs.cache_key({"b": 1, "a": [2]})
    assert key == logs.cache_key('{"a": [2], "b": 1}') and len(key) == 16
    assert logs.cached(got.select("experiment"), str(tmp_path / "c"), key, {"b": 1}).count() == logs.cached(got.select("experiment"), str(tmp_path / "c"), key).count() == 2
    assert spark.read.text(str(tmp_path / "c" / f"{key}.params")).first().value == '{"b": 1}'


def test_pools_and_plans_on_disk(spark, tmp_path):
    a, b = tmp_path / "pool.json", tmp_path / "sandbox.json"
    a.write_text('{"thoughts": {"t": ["x"]}}')
    b.write_text('{"sandbox": [{"task": "t", "code": "c", "output": "o"}]}')
    r = logs.pool(spark, str(a), str(b)).first()
    assert r.thoughts == {"t": ["x"]} and r.facts == {} and r.sandbox[0].output == "o"
    r = logs.pool(spark, str(tmp_path / "absent.json"), str(b)).first()
    assert r.thoughts == {} and len(r.sandbox) == 1
    a.write_text("not json")
    assert logs.pool(spark, str(a)).first().facts == {}
    logs.write_pool(logs.pool(spark, str(b), str(b)), str(tmp_path / "out"))
    assert json.loads(spark.read.text(str(tmp_path / "out")).first().value)["sandbox"] == [{"task": "t", "code": "c", "output": "o"}]
    (tmp_path / "plans.json").write_text('[{"turns":[{"user":"u","steps":[{"kind":"compute","argument":"1"}]}]},{"turns":[]}]')
    got = logs.scenarios(spark, str(tmp_path / "plans.json")).orderBy("plan_id").collect()
    assert [len(r.turns) for r in got] == [1, 0] and got[0].turns[0].steps[0].kind == "compute"
    files = spark.createDataFrame([(f"f{i:03d}",) for i in range(200)], "path string")
    assert logs.first_files(files).count() == 120 and logs.literal(spark, {"a": "1", "b": "2"}).count() == 2


def test_chat_api_both_ways(spark):
    rows = [('{"role":"assistant","thinking":"t","content":"","tool_calls":[{"function":{"name":"calc","arguments":{"expr":"1"}}}]}', {"thought": "t", "tool_call": {"name": "calc", "arguments": {"expr": "1"}}}), ('{"content":"a \\"b\\""}', {"thought": "Answering directly.", "response": 'a "b"'}), ('{"tool_calls":[{"function":{"name":"x","arguments":"nope"}}]}', {"thought": "Calling x.", "tool_call": {"name": "x", "arguments": {}}})]
    df = spark.createDataFrame([(m,) for m, _ in rows], "m string").select(G.from_chat_api(F.col("m")).alias("p"))
    assert [json.loads(r.p) for r in df.collect()] == [w for _, w in rows]
    r = spark.range(1).select(G.run_message(F.lit("42"), F.lit(None).cast("string")).alias("r")).first().r
    assert json.loads(r) == {"message": {"role": "assistant", "content": "42", "thinking": ""}, "done": True, "done_reason": "stop"}


def test_generators_hold_their_own_answers(spark):
    traces = G.one_step_traces(spark, 2000, [("owner", "nobody")], [("largest planet", "Jupiter")], "noon").collect()
    share = {k: sum(r.kind == k for r in traces) / 2000 for k in G.ONE_STEP}
    assert all(abs(share[k] - w / 100) < 0.05 for k, w in G.ONE_STEP.items())
    for r in traces[:300]:
        tool = r.trace.split("<tool name=")[1]
        result = tool.split(">", 1)[1].split("</tool>")[0]
        assert f'"response":"{result}"' in r.trace
        if r.kind == "calc":
            assert N.calculate(r.trace.split('"expr":"')[1].split('"')[0]) == result
    facts = spark.createDataFrame([("a", "5 m", 5.0), ("b", "7 m", 7.0), ("c", "none", None)], "key string, value string, number double")
    for r in G.lookup_chains(spark, 50, facts).collect():
        at = 0.0
        for i, x in enumerate(r.steps):
            if i % 3 == 0:
                at += {"a": 5.0, "b": 7.0}[x.argument]
            else:
                assert x.argument.split()[0] == str(at)
                at = float(N.calculate(x.argument))
            assert x.at == at
        assert r.value == at


def test_grounding_of_traces(spark):
    call = lambda e: '<assistant>{"thought":"t","tool_call":{"name":"calc","arguments":{"expr":"%s"}}}</assistant>' % e
    rows = [(1, "<user>4 and 5</user>" + call("4 + 5") + "<tool name=calc>9</tool>" + call("9 * 4")), (2, "<user>4</user>" + call("4 + 6") + "<tool name=calc>10</tool><user>6</user>" + call("6 + 10")), (3, "no events"), (4, None)]
    got = {r.id: (r.ok, r.problems) for r in X.grounding(spark.createDataFrame(rows, "id int, trace string"), "id", "trace").collect()}
    assert got == {1: (True, []), 2: (False, ["hop 1 (calc): value 6 not grounded in prior context"]), 3: (True, []), 4: (True, [])}


def test_schema_sampler(spark):
    pools = {"calc": ["calc", "evaluate"], "now": ["clock"], "search": ["find", "look"], "read": ["open"]}
    df = spark.createDataFrame([(i, ["calc"]) for i in range(400)], "id int, used array<string>")
    a = {r.id: r for r in X.sampled_schema(df, "used", "id", pools, 3).collect()}
    assert {r.id: r.shown for r in X.sampled_schema(df.repartition(5), "used", "id", pools, 3).collect()} == {i: r.shown for i, r in a.items()}
    assert all("calc" in r.mapping and all(s in pools[c] for c, s in r.mapping.items()) and sorted(r.shown) == sorted(r.mapping.values()) for r in a.values())
    extra = [len(r.mapping) - 1 for r in a.values()]
    assert 0.5 < sum(n > 0 for n in extra) / 400 < 0.7 and max(extra) <= 3


def test_small_functions(spark):
    one = lambda c: spark.range(1).select(c.alias("v")).first().v
    assert one(N.plain_answer(F.lit("\u00a0 a \n b.. "))) == "a b" and one(N.strip(F.lit("\u00a0a\u00a0"))) == "a"
    assert tuple(one(N.partition(F.lit("a:b:c")))) == ("a", "b:c") and tuple(one(N.partition(F.lit("abc")))) == ("abc", "")
    assert one(N.minutes(F.lit(90))) == "1.5m" and one(N.clamp(F.lit(99), 1, 60)) == 60
    assert one(N.utc_text(F.lit("2026-01-02 03:04:05").cast("timestamp"))) == "2026-01-02T03:04:05Z" and one(N.file_stamp(F.lit("2026-01-02 03:04:05").cast("timestamp"))) == "20260102_030405"
    assert tuple(one(N.attention_costs(*[F.lit(x) for x in (2, 3, 4, 5, 6, 7)]))) == (24, 10, 42)
    assert one(P.conversation_rollup(F.array(F.array(F.lit("a"), F.lit("b")), F.array().cast("array<string>"), F.array(F.lit("c"))))) == "a->b | - | c"
    assert one(X.merged(F.create_map(F.lit("a"), F.lit(1), F.lit("b"), F.lit(2)), F.create_map(F.lit("b"), F.lit(3)))) == {"a": 1, "b": 3}


def test_source_files_skip_what_the_reference_skips(spark, tmp_path):
    root = tmp_path / ".hidden" / "data"
    for name in ("a.py", "lib/b.py", "lib/c.txt", "lib/results.py", "data/d.py", "lib/results/e.py", "node_modules/x/f.py", "__pycache__/g.py", "checkpoints/h.py", ".venv/i.py", "database/j.py"):
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text("x = 1\n")
    got = sorted(r.path.split("/.hidden/data/")[1] for r in logs.source_files(spark, str(root)).collect())
    assert got == ["a.py", "database/j.py", "lib/b.py", "lib/results.py"]
