"""Reading traces back: blocks in order, answers salvaged, schemas, grounding replay, summaries."""

from __future__ import annotations

import ast
import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lathe.functions.numbers import strip

#: The limits of shown output.
OUT_LIMIT, ERR_LIMIT, READ_LIMIT, LINE_LIMIT = 2000, 600, 4000, 260

#: Fixed value: what a block of a trace looks like.
BLOCK = r"(?s)<user>.*?</user>|<assistant>.*?</assistant>|<tool name=[^>]*>.*?</tool>"


def blocks(df: DataFrame, key: str, text: str = "trace") -> DataFrame:
    """(key, pos, kind, name, body): user, assistant and tool blocks in document order."""
    b = F.col("block")
    x = df.select(key, F.posexplode(F.regexp_extract_all(text, F.lit(BLOCK), F.lit(0))).alias("pos", "block"))
    kind = F.regexp_extract(b, r"^<(\w+)", 1)
    name = F.when(kind == "tool", F.regexp_extract(b, r"^<tool name=([^>]*)>", 1))
    return x.select(key, "pos", kind.alias("kind"), name.alias("name"), F.regexp_extract(b, r"(?s)^<[^>]*>(.*)</\w+>$", 1).alias("body"))


def salvage_object(text: str) -> dict | None:
    """The text as a JSON object, else the longest prefix of it that is one. The reader passes over an object
    once and says where it ends; a longer prefix could only add white space."""
    try:
        got = json.JSONDecoder().raw_decode(text.strip())[0]
    except (ValueError, RecursionError):
        return None
    return got if isinstance(got, dict) else None


@F.pandas_udf(T.StringType())
def answer_json(bodies: pd.Series) -> pd.Series:
    """The JSON object of an assistant's block, junk after it cut off; null where there is none."""

    def one(t):
        got = salvage_object(t) if t is not None else None
        return json.dumps(got, separators=(",", ":")) if got is not None else None

    return bodies.map(one)


def calls(df: DataFrame, key: str, text: str = "trace") -> DataFrame:
    """(key, step, name, arguments, result): every tool call with the result block after it."""
    x = blocks(df, key, text)
    a = x.where("kind = 'assistant'").select(key, "pos", answer_json("body").alias("j"))
    a = a.select(key, "pos", F.get_json_object("j", "$.tool_call.name").alias("name"), F.get_json_object("j", "$.tool_call.arguments").alias("arguments")).where("name IS NOT NULL")
    r = x.where("kind = 'tool'").select(key, (F.col("pos") - 1).alias("pos"), F.col("name").alias("result_name"), F.col("body").alias("result"))
    return a.join(r, [key, "pos"], "left").withColumnRenamed("pos", "step")


def replay_problems(found: DataFrame, recorded: DataFrame, key: str) -> DataFrame:
    """(key, ok, problems): calls without a result, under another name, or with another result
    than ``recorded`` (name, arguments, result) holds for the same call."""
    known = recorded.groupBy("name", "arguments").agg(F.min("result").alias("want"))
    x = found.join(known, ["name", "arguments"], "left")
    what = F.when(F.col("result").isNull(), "no result").when(F.col("result_name") != F.col("name"), "other tool").when(F.col("want").isNull(), "unknown call").when(F.col("want") != F.col("result"), "other result")
    x = x.withColumn("problem", F.when(what.isNotNull(), F.struct("step", F.concat_ws(": ", "name", what).alias("what"))))
    got = x.groupBy(key).agg(F.array_sort(F.collect_list("problem")).alias("p"))
    return got.select(key, (F.size("p") == 0).alias("ok"), F.transform("p", lambda z: z["what"]).alias("problems"))


def schema_block(tools: DataFrame, order: str = "pos") -> DataFrame:
    """One row, the system block of all tools (name, description, parameters as JSON text) in
    order; ``finish`` is left out."""
    head = F.to_json(F.struct("name", "description"))
    one = F.concat(F.substring(head, F.lit(1), F.length(head) - 1), F.lit(',"parameters":'), F.col("parameters"), F.lit("}"))
    all_ = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order), one.alias("j")))), lambda z: z["j"]), ",")
    return tools.where("name <> 'finish'").agg(F.concat(F.lit('<system>{"tools":['), all_, F.lit("]}</system>")).alias("schema"))


def tool_listing(tools: DataFrame) -> DataFrame:
    """Function-style rows: {"type":"function","function":{name, description, parameters}}."""
    props = F.map_from_entries(F.transform("params", lambda p: F.struct(p, F.struct(F.lit("string").alias("type")))))
    spec = F.struct("name", "description", F.struct(F.lit("object").alias("type"), props.alias("properties"), F.col("params").alias("required")).alias("parameters"))
    return tools.select("name", F.to_json(F.struct(F.lit("function").alias("type"), spec.alias("function"))).alias("row"))


def unused_tools(used: Column, names: list[str]) -> Column:
    return F.array_except(F.array(*[F.lit(n) for n in names]), used)


def cut(text: Column, limit: int) -> Column:
    """Trimmed, with plain line ends, and with a note of the whole length where it is cut."""
    plain = strip(F.replace(text, F.lit("\r\n"), F.lit("\n")))
    note = F.format_string("\n... (truncated, %d bytes total)", F.length(plain))
    return F.when(F.length(plain) <= limit, plain).otherwise(F.concat(F.substring(plain, 1, limit), note))


def cut_at_line(text: Column, limit: int = LINE_LIMIT) -> Column:
    """At most ``limit`` characters, back to the last line end within them, and dots."""
    head = F.regexp_replace(F.substring(text, 1, limit), r"\n[^\n]*\z", "")
    return F.when(F.length(text) <= limit, text).otherwise(F.concat(head, F.lit("\n...")))


def run_output(stdout: Column, stderr: Column, code: Column) -> Column:
    """What a run shows: output, errors under a heading, an exit code other than 0 first."""
    err = F.when(F.length(stderr) > 0, F.concat(F.lit("stderr:\n"), cut(stderr, ERR_LIMIT)))
    return F.concat_ws("\n", F.when(code != 0, F.format_string("exit code %d", code)), F.when(F.length(stdout) > 0, cut(stdout, OUT_LIMIT)), err)


def filled_lines(text: Column) -> Column:
    return F.filter(F.split(text, "\n"), lambda s: F.trim(s) != "")


def hit_summary(text: Column) -> Column:
    """How many lines of path:line:text there are and where the first one is."""
    hits = F.filter(F.split(text, "\n"), lambda s: s.contains(":"))
    n = F.size(hits)
    says = F.concat(F.lit("Found "), n.cast("string"), F.when(n == 1, " match").otherwise(" matches"), F.lit(", the first at "), F.substring_index(F.try_element_at(hits, F.lit(1)), ":", 2), F.lit("."))
    return F.when(n == 0, F.substring(text, 1, 120)).otherwise(says)


def file_summary(text: Column, shown: int = 3) -> Column:
    files = filled_lines(text)
    n = F.size(files)
    more = F.when(n > shown, F.concat(F.lit(" and "), (n - shown).cast("string"), F.lit(" more"))).otherwise("")
    return F.when(n == 0, "No matching files.").otherwise(F.concat(n.cast("string"), F.lit(" file(s): "), F.array_join(F.slice(files, 1, shown), ", "), more, F.lit(".")))


def read_summary(text: Column) -> Column:
    lines = filled_lines(text)
    first = F.coalesce(F.substring(F.trim(F.try_element_at(lines, F.lit(1))), 1, 90), F.lit(""))
    return F.concat(F.lit("That section has "), F.size(lines).cast("string"), F.lit(" non-empty line(s), starting with: "), first)


def name_filter(path: Column, pattern: Column) -> Column:
    """The pattern occurs in the path, whatever its case."""
    return F.contains(F.lower(path), F.lower(pattern))


@F.udtf(returnType="path string, place int, line int, kind string, name string, arguments array<string>, doc string")
class Symbols:
    """Every function and class of a Python source, outer ones before inner ones; a source that cannot be parsed has none."""

    def eval(self, path: str, source: str):
        try:
            nodes = [ast.parse(source)] if source is not None else []
        except (SyntaxError, ValueError, RecursionError):
            return
        for place, n in enumerate(nodes):  # the list grows by what each node holds
            nodes.extend(ast.iter_child_nodes(n))
            if isinstance(n, ast.ClassDef):
                yield path, place, n.lineno, "class", n.name, None, ast.get_docstring(n)
            elif isinstance(n, ast.FunctionDef | ast.AsyncFunctionDef):
                yield path, place, n.lineno, "def", n.name, [a.arg for a in n.args.args], ast.get_docstring(n)


def symbols(files: DataFrame, path: str = "path", text: str = "text") -> DataFrame:
    """(path, place, line, kind, name, arguments, doc) of all sources, each parsed once; a lookup is a filter."""
    x = files.select(F.col(path).alias("path"), F.col(text).alias("text"))
    return x.lateralJoin(Symbols(F.col("path").outer(), F.col("text").outer()).alias("s")).select("s.*")


def described(found: DataFrame, shown: int = 600) -> DataFrame:
    """(name, text): of each name the first one by path and place, with signature and documentation."""
    at = F.min(F.struct("path", "place", "line", "kind", "arguments", "doc")).alias("a")
    x = found.groupBy("name").agg(at).select("name", "a.*")
    heading = F.concat("path", F.lit(":"), F.col("line").cast("string"), F.lit("\n"), "kind", F.lit(" "), "name")
    signature = F.when(F.col("arguments").isNotNull(), F.concat(F.lit("("), F.array_join("arguments", ", "), F.lit(")"))).otherwise("")
    doc = F.when(F.coalesce("doc", F.lit("")) == "", "(no docstring)").otherwise(F.col("doc"))
    return x.select("name", F.concat(heading, signature, F.lit("\n\n"), F.substring(doc, 1, shown)).alias("text"))


def tail_lines(lines: DataFrame, n: int, order: str = "line_no") -> DataFrame:
    """The last ``n`` lines, in order: a top-n, no sort of the whole."""
    return lines.orderBy(F.desc(order)).limit(n).orderBy(order)


def occurrences(text: Column, word: str) -> Column:
    """How often a word occurs, from left to right without overlaps."""
    return ((F.length(text) - F.length(F.replace(text, F.lit(word), F.lit("")))) / len(word)).cast("bigint")


def topic(text: Column, topics: dict[str, list[str]]) -> Column:
    """The topic with most occurrences of its words, the first listed on ties (and where none occurs)."""
    scores = [F.struct(sum((occurrences(text, w) for w in ws), F.lit(0)).cast("bigint").alias("n"), F.lit(-i).alias("i"), F.lit(t).alias("t")) for i, (t, ws) in enumerate(topics.items())]
    return F.array_max(F.array(*scores))["t"]


def topic_counts(df: DataFrame, text: str, topics: dict[str, list[str]]) -> DataFrame:
    """(topic, n): how many texts have each topic; topics that none has are there with 0."""
    names = df.sparkSession.createDataFrame([(t,) for t in topics], "topic string")
    n = df.where(F.col(text).isNotNull()).groupBy(topic(F.col(text), topics).alias("topic")).agg(F.count("*").alias("n"))
    return names.join(n, "topic", "left").select("topic", F.coalesce("n", F.lit(0)).alias("n"))


def pending(todo: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """What a restart still has to do: rows whose key is in no part written so far."""
    return todo.join(done.select(key).distinct(), key, "left_anti")


def leaderboard_cells(params: Column, loss: Column, accuracy: Column, rate: Column, seconds: Column) -> Column:
    """Formatted cells: parameters in millions, loss, accuracy, learning rate, minutes."""
    d = lambda c: c.cast("double")
    return F.struct(
        F.format_string("%.1fM", d(params) / 1e6).alias("params"),
        F.format_string("%.4f", d(loss)).alias("loss"),
        F.format_string("%.1f%%", d(accuracy) * 100).alias("accuracy"),
        F.format_string("%.0e", d(rate)).alias("rate"),
        F.format_string("%.1f", d(seconds) / 60).alias("minutes"),
    )
