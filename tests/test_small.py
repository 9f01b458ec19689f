"""Small operators against plain values."""

import json
import re

import pytest
from pyspark.sql import functions as F

from lathe.functions import numbers as N
from lathe.functions import protocol as P
from lathe.operators import compose as C
from lathe.operators import mixes as X
from lathe.operators import pools as L
from lathe.operators import reports as Y
from lathe.operators import traces as V
from lathe.sources import logs


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


def test_an_unknown_token_id_is_an_error(spark):
    ids = F.array(F.lit(3), F.lit(7))
    assert value(spark, P.required_vocabulary(ids, 8)) == [3, 7]
    with pytest.raises(Exception, match="token id 7 is outside of the vocabulary of 7"):
        value(spark, P.required_vocabulary(ids, 7))


def test_token_counts_of_awkward_texts(spark):
    texts = ["aab", "", None, "é¿À漢😀\x00", "ÿĀ"]
    want = {}
    for c in "".join(t or "" for t in texts):
        want[min(ord(c), 255)] = want.get(min(ord(c), 255), 0) + 1
    df = spark.createDataFrame([(t,) for t in texts], "text string").repartition(2)
    assert {r.tok: r.n for r in P.token_counts(df, "text").collect()} == want
    assert P.token_counts(df.limit(0), "text").count() == 0


def test_nested_arguments_are_kept(spark):
    call = '{"thought":"t","tool_call":{"name":"calc","arguments":{"a":{"b":[1,{"c":"}"}]}}}}'
    text = f"<assistant>{call}</assistant>\n<tool name=calc>1</tool>\n<assistant>no json</assistant><assistant>{{\"response\":\"x\"}}</assistant>"
    assert [tuple(c) for c in value(spark, P.tool_calls(F.lit(text)))] == [("calc", '{"a":{"b":[1,{"c":"}"}]}}')]


def test_first_array_is_what_a_reader_takes():
    assert L.first_array('x [1, "]", {"a": []}] and [2]') == [1, "]", {"a": []}]
    for t in ("", "none", "[1,]", "[1", "]["):
        assert L.first_array(t) is None
    assert L.first_array("[[" * 100_000) is None


def test_usable_facts(spark):
    df = spark.createDataFrame([("a", "1"), ("", "1"), ("b", ""), ("k" * 60, "1"), ("k" * 59, "1"), (None, "1")], "key string, value string")
    assert {r.key for r in L.usable_facts(df).collect()} == {"a", "k" * 59}


def test_occurrences_do_not_overlap(spark):
    assert value(spark, V.occurrences(F.lit("aaaa aa"), "aa")) == 3 and value(spark, V.occurrences(F.lit(""), "aa")) == 0


def test_closeness_at_the_extremes(spark):
    inf = float("inf")
    for a, b, want in ((1.0, 1.0 + 9e-7, True), (1.0, 1.0 + 2e-6, False), (0.0, 5e-19, True), (0.0, 2e-18, False), (inf, 1e300, False), (inf, inf, False), (float("nan"), float("nan"), False)):
        assert value(spark, N.close_to(F.lit(a), F.lit(b))) is want


def test_number_texts(spark):
    df = spark.createDataFrame([(7.0,), (-0.0,), (1e15,), (1.6e-19,), (2.5,), (None,), (123456789.125,)], "d double")
    want = ["7", "0", "1e+15", "1.6e-19", "2.5", None, "123456789.1"]
    assert [r.t for r in df.select(N.number_text("d").alias("t")).collect()] == want


def test_leaderboard_configuration_and_kinds(spark):
    row = [("run", "t+00:00", "r.json", 1, "accuracy", 0.5, 0.5, "M", "gqa", True, 4, None, 3, True, False, 0.25, {"numeric": 0.4, "date": 1.0})]
    df = spark.createDataFrame(row, "experiment string, timestamp string, file_name string, rank int, metric_name string, metric double, accuracy double, model_size string, attention_type string, use_moe boolean, num_experts int, n_layers int, expert_layers int, curriculum boolean, math_only boolean, math_replay_fraction double, per_kind_accuracy map<string,double>")
    cells = Y.leaderboard_lines(df).first().line.split(" | ")
    assert cells[5] == "size=M, attention=gqa, MoE, experts=4, expert-layers=3, curriculum, math-replay=25%"
    assert cells[7] == "overall=50.0%, numeric=40.0%, date=100.0%"


def test_quota_union_fills_up(spark):
    a, b = (spark.range(n).withColumn("origin", F.lit(o)) for n, o in ((3, "a"), (100, "b")))
    got = X.quota_union(a, b, 20, 0.5, "id").groupBy("origin").count().collect()
    assert {r.origin: r["count"] for r in got} == {"a": 3, "b": 17}
    assert X.quota_union(a.limit(0), b.limit(0), 20, 0.5, "id").count() == 0
    assert X.quota_union(b.withColumn("origin", F.lit("a")), b, 20, 0.5, "id").groupBy("origin").count().count() == 2


def test_scenarios_of_several_lines_are_one_array(spark, tmp_path):
    plans = [{"turns": [{"user": "Hi.", "steps": [{"kind": "time", "argument": None}]}]}] * 2
    (tmp_path / "s.json").write_text(json.dumps(plans, indent=1))
    assert [(r.plan_id, r.turns[0].user) for r in logs.scenarios(spark, str(tmp_path / "s.json")).collect()] == [(0, "Hi."), (1, "Hi.")]


def test_templates_are_filled_once(spark):
    values = F.create_map(F.lit("a"), F.lit("{b}"), F.lit("b"), F.lit("2"), F.lit("none"), F.lit(None).cast("string"))
    fill = lambda t: value(spark, C.filled_in(F.lit(t), values))
    assert fill("x {a} {b} {") == "x {b} 2 {" and fill("") == "" and fill("{none}") is None and fill("{other}") is None


def test_json_text_is_what_json_writes(spark):
    for t in ('a "quoted" \\ text', "line\nend\ttab", "é漢"):
        assert json.loads(value(spark, C.json_text(F.lit(t)))) == t
    assert re.fullmatch(r'"[^"]*"', value(spark, C.json_text(F.lit("}"))))
