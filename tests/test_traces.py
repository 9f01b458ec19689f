import json

from pyspark.sql import functions as F

from lathe.operators import traces as X

TRACE = '<user>two plus two\nplease</user>\n<assistant>{"thought":"t","tool_call":{"name":"calc","arguments":{"expr":"2+2"}}} junk }</assistant>\n<tool name=calc>4</tool>\n<assistant>{"response":"4"}</assistant>'


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


def test_blocks_in_order(spark):
    df = spark.createDataFrame([(1, TRACE), (2, ""), (3, None)], "id int, trace string")
    got = X.blocks(df, "id").orderBy("pos").collect()
    assert [(r.kind, r.name) for r in got] == [("user", None), ("assistant", None), ("tool", "calc"), ("assistant", None)]
    assert got[0].body == "two plus two\nplease" and got[2].body == "4"


def test_salvage():
    assert X.salvage_object('{"a":{"b":1}} and }') == {"a": {"b": 1}}
    assert X.salvage_object("[1]") is None and X.salvage_object("") is None and X.salvage_object("}}") is None and X.salvage_object("{") is None


def test_calls_and_replay(spark):
    df = spark.createDataFrame([(1, TRACE), (2, TRACE.replace("<tool name=calc>4</tool>", "<tool name=calc>5</tool>")), (3, TRACE.replace("<tool name=calc>4</tool>\n", ""))], "id int, trace string")
    got = X.calls(df, "id")
    assert {r.id: (r.name, r.arguments, r.result) for r in got.collect()} == {1: ("calc", '{"expr":"2+2"}', "4"), 2: ("calc", '{"expr":"2+2"}', "5"), 3: ("calc", '{"expr":"2+2"}', None)}
    known = spark.createDataFrame([("calc", '{"expr":"2+2"}', "4")], "name string, arguments string, result string")
    assert {r.id: (r.ok, r.problems) for r in X.replay_problems(got, known, "id").collect()} == {1: (True, []), 2: (False, ["calc: other result"]), 3: (False, ["calc: no result"])}


def test_schemas(spark):
    tools = spark.createDataFrame([(1, "search", "find", ["q"], '{"type":"object"}'), (2, "finish", "end", [], "{}"), (3, "calc", "count", ["expr"], "{}")], "pos int, name string, description string, params array<string>, parameters string")
    assert X.schema_block(tools).first().schema == '<system>{"tools":[{"name":"search","description":"find","parameters":{"type":"object"}},{"name":"calc","description":"count","parameters":{}}]}</system>'
    row = json.loads(X.tool_listing(tools).where("name = 'calc'").first().row)
    assert row == {"type": "function", "function": {"name": "calc", "description": "count", "parameters": {"type": "object", "properties": {"expr": {"type": "string"}}, "required": ["expr"]}}}
    assert value(spark, X.unused_tools(F.array(F.lit("calc")), ["calc", "search"])) == ["search"]


def test_summaries(spark):
    assert value(spark, X.cut_at_line(F.lit("ab\ncd\nef"), 6)) == "ab\ncd\n..."
    assert value(spark, X.cut_at_line(F.lit("abcdef"), 3)) == "abc\n..."
    assert value(spark, X.cut(F.lit(" abc\r\nde "), 3)) == "abc\n... (truncated, 6 bytes total)"
    assert value(spark, X.run_output(F.lit("out"), F.lit("bad"), F.lit(2))) == "exit code 2\nout\nstderr:\nbad"
    assert value(spark, X.hit_summary(F.lit("a.py:3: x\nb.py:1: y"))) == "Found 2 matches, the first at a.py:3."
    assert value(spark, X.hit_summary(F.lit("nothing"))) == "nothing"
    assert value(spark, X.file_summary(F.lit("a\nb\n\nc\nd\ne"))) == "5 file(s): a, b, c and 2 more."
    assert value(spark, X.file_summary(F.lit(""))) == "No matching files."
    assert value(spark, X.read_summary(F.lit("\n a\nb\n"))) == "That section has 2 non-empty line(s), starting with: a"
    assert value(spark, X.name_filter(F.lit("Src/Main.PY"), F.lit("main.p"))) is True


def test_symbols_topics_tail(spark):
    topics = {"animals": ["cat", "dog"], "sky": ["moon"]}
    assert value(spark, X.topic(F.lit("The moon, a moon and a cat"), topics)) == "sky"
    assert value(spark, X.topic(F.lit("moon cat"), topics)) == value(spark, X.topic(F.lit("x"), topics)) == "animals"
    texts = spark.createDataFrame([("moon cat",), ("moon moon",), (None,)], "t string")
    assert {r.topic: r.n for r in X.topic_counts(texts, "t", topics | {"sea": ["fish"]}).collect()} == {"animals": 1, "sky": 1, "sea": 0}
    assert [r.id for r in X.tail_lines(spark.range(10), 3, "id").collect()] == [7, 8, 9]
    assert [r.id for r in X.pending(spark.range(4), spark.range(3), "id").collect()] == [3]


def test_leaderboard_cells(spark):
    r = value(spark, X.leaderboard_cells(F.lit(12_340_000), F.lit(1.23456), F.lit(0.876), F.lit(0.0003), F.lit(90)))
    assert tuple(r) == ("12.3M", "1.2346", "87.6%", "3e-04", "1.5")
