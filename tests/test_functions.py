from pyspark.sql import functions as F

from lathe.functions import numbers as N
from lathe.functions import protocol as P
from lathe.operators import kernels as K
from lathe.operators import relational as R


def one(spark, ddl, row, *cols):
    return spark.createDataFrame([row], ddl).select(*cols).first()


def test_calculate():
    for text, want in {"31 + 11": "42", "91 / 13": "7.0", "-19 - 4": "-23", "3^5": "243", "17 // 5": "3", "-17 // 5": "-4", "-17 % 5": "3", "six": "ERROR: invalid expression"}.items():
        assert N.calculate(text) == want
    assert N.calculate("3 / 0").startswith("ERROR") and N.calculate("8**8**8**8").startswith("ERROR") and N.calculate(None) is None


def test_number_literals(spark):
    for text, want in {"12,345.5 litres": [12345.5], "2.5e3 m": [2500.0], "8-3": [8.0, -3.0], "8 - 3": [8.0, 3.0], "no digits": []}.items():
        assert one(spark, "t string", (text,), N.number_list(F.col("t")))[0] == want


def test_encode_literal(spark):
    text = '<user>hi</user>\n<assistant>{"thought":"t","response":"20"}</assistant>\x03'
    e = one(spark, "t string", (text,), P.encode(F.col("t")).alias("e")).e
    assert e.tokens == [258, 104, 105, 259, 10, 256, 123, 266, 34, 116, 34, 44, 268, 34, 50, 48, 34, 125, 257, 3]
    assert e.mask == [0.0] * 5 + [1.0] * 15
    assert one(spark, "t string", (text,), P.detokenise(P.tokenise(F.col("t"))))[0] == text


def test_contract(spark):
    cases = {
        '{"thought":"t","response":"20"}': True,
        '{"thought":"t","tool_call":{"name":"calc","arguments":{"expr":"1"}}}': True,
        '{"response":"20"}': False,
        '{"thought":"t","response":20}': False,
        '{"thought":"t","response":"x","tool_call":{"name":"calc","arguments":{}}}': False,
        '{"thought":"t","tool_call":{"name":"calc","arguments":"x"}}': False,
        "not json": False,
    }
    rows = spark.createDataFrame(list(cases.items()), "p string, want boolean").select("want", P.contract_ok(F.col("p")).alias("got")).collect()
    assert [r.got for r in rows] == [r.want for r in rows]


def test_cascading_lookup(spark):
    facts = spark.createDataFrame([(0, "height of the tower", "81 m"), (1, "depth of the well", "12 m"), (2, "well", "a hole")], "ord int, key string, value string")
    asked = spark.createDataFrame([(" Height of the tower?? ",), ("hieght of the towers",), ("tell me the depth of the well now",), ("something else entirely",), (None,)], "query string")
    got = {r.query: r.answer for r in R.cascading_lookup(asked, facts).collect()}
    assert got == {" Height of the tower?? ": "81 m", "hieght of the towers": "81 m", "tell me the depth of the well now": "12 m", "something else entirely": "no results found", None: "no results found"}


def test_grounding_and_divergence(spark):
    n = spark.createDataFrame([(1, 0, 6650.0, False), (1, 1, 6650.0, True), (1, 2, 7.0, True), (2, 0, 3.0, True)], "trace_id int, pos int, value double, is_use boolean")
    assert {(r.trace_id, r.value) for r in R.ungrounded(n).collect()} == {(1, 7.0), (2, 3.0)}
    call = "trace_id int, pos int, name string, arguments string"
    a = spark.createDataFrame([(1, 0, "calc", "1"), (1, 1, "calc", "2"), (2, 0, "now", ""), (3, 0, "now", "")], call)
    b = spark.createDataFrame([(1, 0, "calc", "1"), (1, 1, "calc", "3"), (2, 0, "now", ""), (2, 1, "now", "")], call)
    assert {r.trace_id: r.kind for r in R.first_divergence(a, b).collect()} == {1: "wrong args", 2: "kept going", 3: "stopped early"}


def test_rank_has_gaps(spark):
    rows = [("a", f"f{i}", acc, None, None, None) for i, acc in enumerate([0.9, 0.9, 0.8, 0.7])]
    df = spark.createDataFrame(rows, "experiment string, file_name string, accuracy double, best_val_loss double, best_loss double, final_loss double")
    assert sorted(r["rank"] for r in R.ranked_results(df).collect()) == [1, 1, 3, 4]


def test_kernels(spark):
    r = one(spark, "v array<double>", ([1.0, 2.0, 3.0],), K.softmax(F.col("v")).alias("p"), K.rms(F.col("v"), 0.0).alias("r"))
    assert abs(sum(r.p) - 1) < 1e-12 and abs(r.r - (14 / 3) ** 0.5) < 1e-12
    r = one(spark, "s array<struct<f:double,i:double,o:double>>", ([(0.5, 1.0, 1.0), (0.5, 1.0, 2.0)],), K.gated_scan(F.col("s")).alias("y"))
    assert r.y == [1.0, 3.0]
    r = one(spark, "v array<double>", ([1.0, 0.0],), K.rotate(F.col("v"), F.lit(0)).alias("y"))
    assert r.y == [1.0, 0.0]
