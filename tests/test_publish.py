"""Builds that stop, resume and meet each other; logs that grow; sources that are pruned and parsed once."""

import json
import os
import threading

import pytest
from pyspark.sql import functions as F

from lathe.operators import traces as V
from lathe.sources import logs
from lathe.sources.publish import Build, built
from lathe.streaming import tail


def part(spark, i):
    return spark.range(10 * i, 10 * i + 10).select("id", F.lit(i).alias("part"))


def test_a_stopped_build_goes_on_where_it_stopped(spark, tmp_path):
    made = []

    def make(i, stop=None):
        if i == stop:
            raise RuntimeError("stopped")
        made.append(i)
        return part(spark, i)

    with pytest.raises(RuntimeError):
        built(spark, str(tmp_path), {"n": 5}, 5, lambda i: make(i, stop=3))
    b = Build(spark, str(tmp_path), {"n": 5}, 5)
    assert made == [0, 1, 2] and b.missing() == [3, 4] and b.published() is None and not b.publish()
    with pytest.raises(FileNotFoundError):
        b.read()
    got = built(spark, str(tmp_path), {"n": 5}, 5, make)
    assert made == [0, 1, 2, 3, 4] and sorted(r.id for r in got.collect()) == list(range(50))
    assert built(spark, str(tmp_path), {"n": 5}, 5, make).count() == 50 and made == [0, 1, 2, 3, 4]
    assert b.read(check=True).count() == 50 and json.loads(b.store.read("params.json/text")) == {"n": 5}
    assert Build(spark, str(tmp_path), {"n": 6}, 5).key != b.key


def test_rows_of_a_lost_attempt_are_never_read(spark, tmp_path):
    b = Build(spark, str(tmp_path), {"a": 1}, 2)
    part(spark, 7).write.parquet(f"{b.store.root}/parts/000000-lost")  # a writer that died before its line
    assert b.write_part(0, part(spark, 0)) and not b.write_part(0, part(spark, 0)) and b.write_part(1, part(spark, 1))
    assert b.publish() and not b.publish()
    assert sorted(r.id for r in b.read().collect()) == list(range(20))
    lost = b.done()[1]["attempt"]
    part(spark, 3).write.mode("append").parquet(f"{b.store.root}/{lost}")
    with pytest.raises(ValueError):
        b.read(check=True)


def test_two_writers_publish_once(spark, tmp_path):
    builds = [Build(spark, str(tmp_path), {"two": 2}, 3) for _ in range(4)]
    won = []

    def go(b):
        for i in range(3):
            b.write_part(i, part(spark, i))
        if b.publish():
            won.append(b.owner)

    threads = [threading.Thread(target=go, args=(b,)) for b in builds]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert len(won) == 1 and builds[0].published()["owner"] == won[0]
    assert builds[0].read().count() == 30 and len(builds[0].done()) == 3
    assert len(builds[0].store.names("parts")) == 3


def test_a_lease_that_ran_out_is_taken_over(spark, tmp_path):
    a, b = Build(spark, str(tmp_path), {"x": 1}, 1, lease_seconds=-1), Build(spark, str(tmp_path), {"x": 1}, 1)
    a.write_part(0, part(spark, 0))
    assert a.lease()  # and dies
    c = Build(spark, str(tmp_path), {"x": 1}, 1)
    assert b.lease() and not c.lease() and not c.publish() and b.publish()


def test_parts_of_other_schemas_are_refused(spark, tmp_path):
    b = Build(spark, str(tmp_path), {"s": 1}, 2)
    b.write_part(0, part(spark, 0))
    b.write_part(1, part(spark, 1).withColumn("more", F.lit(1)))
    with pytest.raises(ValueError):
        b.publish()


def test_a_followed_log_ends_as_one_batch_does(spark, tmp_path):
    folder, names = tmp_path / "logs", []
    folder.mkdir()

    def add(name, text):
        (folder / name).write_text(text)
        names.append(name)

    def run():
        tail.follow(spark, str(folder), str(tmp_path / "state"), str(tmp_path / "table"), 4)
        return sorted(map(tuple, tail.current(spark, str(tmp_path / "table")).collect()))

    def batch():
        files = spark.read.text(str(folder), wholetext=True)
        return sorted(map(tuple, tail.last_lines(tail.lines_of(files), 4).collect()))

    add("a.log", "1\n2\n3\n")
    add("b.log", "only")
    assert run() == batch() == [("a.log", 1, "1"), ("a.log", 2, "2"), ("a.log", 3, "3"), ("b.log", 1, "only")]
    add("a.log.0001", "4\r\n5\n\n")
    add("c.log", "\n".join(map(str, range(100))))
    assert run() == batch()
    assert run() == batch()  # nothing new
    add("a.log.0002", "6")
    assert run() == batch() and [x[2] for x in batch() if x[0] == "a.log"] == ["4", "5", "", "6"]


def test_folders_are_pruned_before_they_are_read(spark, tmp_path):
    for name in ("a.py", "src/b.py", "src/.hidden/c.py", "results/d.py", "src/data/e.py", "src/databank/f.py", "g.txt"):
        p = tmp_path / "tree" / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(f"x = '{name}'\ny = 1\n")
    df = logs.source_files(spark, str(tmp_path / "tree"))
    assert sorted(os.path.relpath(r.path.removeprefix("file:"), str(tmp_path / "tree")) for r in df.collect()) == ["a.py", "src/b.py", "src/databank/f.py"]
    scan = df._jdf.queryExecution().executedPlan().collectLeaves().head()
    scan.execute().count()
    assert scan.metrics().get("numFiles").get().value() == 3


def test_every_symbol_once(spark):
    a = 'import x\n\n\nclass A:\n    """Doc."""\n\n    def f(self, b):\n        def g():\n            pass\n\n\ndef g(c, *d):\n    """G."""\n'
    files = spark.createDataFrame([("a.py", a), ("b.py", "def g(): pass"), ("bad.py", "def ("), ("none.py", None)], "path string, text string")
    got = [(r.path, r.line, r.kind, r.name, r.arguments, r.doc) for r in V.symbols(files).orderBy("path", "line").collect()]
    assert got == [("a.py", 4, "class", "A", None, "Doc."), ("a.py", 7, "def", "f", ["self", "b"], None), ("a.py", 8, "def", "g", [], None), ("a.py", 12, "def", "g", ["c"], "G."), ("b.py", 1, "def", "g", [], None)]
    told = {r.name: r.text for r in V.described(V.symbols(files)).collect()}
    assert told["g"] == "a.py:12\ndef g(c)\n\nG." and told["A"] == "a.py:4\nclass A\n\nDoc." and told["f"] == "a.py:7\ndef f(self, b)\n\n(no docstring)"


def test_salvage_of_a_long_text_is_linear():
    text = '{"a":"' + "}" * 1_000_000 + '"} and more }'
    assert V.salvage_object(text) == {"a": "}" * 1_000_000}
    assert V.salvage_object('{"a":1' + "}" * 0 + "{" * 500_000) is None


def test_salvage_takes_what_trying_every_prefix_takes():
    def slow(t):
        for end in range(len(t), 0, -1):
            try:
                got = json.loads(t[:end])
                return got if isinstance(got, dict) else None
            except ValueError:
                continue
        return None

    for t in ('{"a":1}', '{"a":1} x', '{"a":"}"}}', "{}{}", "{", "", "[1] {", '{"a":{"b":[1,{"c":2}]}},', '{"a":1,}', "12 {}", '"{}"', 'null{"a":1}', '{"a":NaN} ]'):
        assert V.salvage_object(t) == slow(t), t
