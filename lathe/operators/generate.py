"""Synthetic traces and stories from row ids and counter-based draws; rewriting of tool names.

A row's content depends on (seed, id) only, so the data do not change with partitioning.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lathe.functions import protocol as P
from lathe.operators.relational import draw

EOT = P.EOT


def ids(spark: SparkSession, n: int) -> DataFrame:
    return spark.range(n).withColumnRenamed("id", "trace_id")


def pick(options: list[str], u: Column) -> Column:
    return F.element_at(F.array(*[F.lit(o) for o in options]), (F.pmod(u, F.lit(len(options))) + 1).cast("int"))


def arithmetic_chains(spark: SparkSession, n: int, hops: int = 3, seed: int = 0) -> DataFrame:
    """Chains of ``hops`` calc calls, each starting from the last result: (trace_id, steps, trace)."""
    x = ids(spark, n).withColumn("start", (F.pmod(draw(seed, "trace_id", F.lit(0)), F.lit(90)) + 10).cast("bigint"))
    moves = F.array(*[F.struct(pick(["+", "-", "*"], draw(seed, "trace_id", F.lit(2 * i))).alias("op"), (F.pmod(draw(seed, "trace_id", F.lit(2 * i + 1)), F.lit(9)) + 2).cast("bigint").alias("v")) for i in range(1, hops + 1)])
    zero = F.struct(F.col("start").alias("at"), F.array().cast("array<struct<expr:string,result:bigint>>").alias("steps"))

    def go(a, m):
        r = F.when(m["op"] == "+", a["at"] + m["v"]).when(m["op"] == "-", a["at"] - m["v"]).otherwise(a["at"] * m["v"])
        expr = F.concat_ws(" ", a["at"].cast("string"), m["op"], m["v"].cast("string"))
        return F.struct(r.alias("at"), F.concat(a["steps"], F.array(F.struct(expr.alias("expr"), r.alias("result")))).alias("steps"))

    x = x.withColumn("run", F.aggregate(moves, zero, go))
    call = lambda s: F.concat(F.lit('<assistant>{"thought":"next step","tool_call":{"name":"calc","arguments":{"expr":"'), s["expr"], F.lit('"}}}</assistant>\n<tool name=calc>'), s["result"].cast("string"), F.lit("</tool>"))
    ask = F.concat(F.lit("<user>start at "), F.col("start").cast("string"), F.lit(" and work through "), F.array_join(F.transform("run.steps", lambda s: F.regexp_replace(s["expr"], r"^\S+ ", "")), ", "), F.lit("</user>"))
    end = F.concat(F.lit('<assistant>{"thought":"done","response":"'), F.col("run.at").cast("string"), F.lit('"}</assistant>'), F.lit(EOT))
    return x.select("trace_id", F.col("run.steps").alias("steps"), F.concat_ws("\n", ask, F.array_join(F.transform("run.steps", call), "\n"), end).alias("trace"))


def used_in(traces: DataFrame, key: str, text: str, tools: DataFrame, name: str = "name") -> DataFrame:
    """(key, name): the tools of a table that a trace calls or shows a result of, by one pass over each text."""
    from lathe.operators.matching import containing

    marks = tools.select(name, F.explode(F.array(F.concat(F.lit('"name":"'), name, F.lit('"')), F.concat(F.lit("<tool name="), name, F.lit(">")))).alias("__mark"))
    return containing(traces, key, text, marks, name, "__mark").distinct()


def gated(candidates: DataFrame, n: int, max_len: int, key: str = "trace_id", text: str = "trace") -> DataFrame:
    """The first ``n`` candidates by key that pass the length gate (oversample, then cut)."""
    return candidates.where(F.length(text) <= max_len).orderBy(key).limit(n)


def fill(template: Column, values: dict[str, Column]) -> Column:
    for k, v in values.items():
        template = F.replace(template, F.lit("{" + k + "}"), v)
    return template


def capitalise(s: Column) -> Column:
    return F.concat(F.upper(F.substring(s, 1, 1)), F.lower(F.substring(s, F.lit(2), F.length(s))))


def stories(spark: SparkSession, n: int, sentences: list[str], least: int, most: int, seed: int = 0) -> DataFrame:
    """Sentences drawn until a story has ``least`` characters, then cut at ``most``."""
    slots = -(-least // (min(map(len, sentences)) + 1)) + 1
    parts = F.array(*[pick(sentences, draw(seed, "trace_id", F.lit(i))) for i in range(slots)])
    text = F.aggregate(parts, F.lit(""), lambda a, s: F.when(F.length(a) >= least, a).when(a == "", s).otherwise(F.concat_ws(" ", a, s)))
    return ids(spark, n).select("trace_id", F.substring(text, 1, most).alias("text"))


def used_tools(text: Column, names: list[str]) -> Column:
    """Names that a trace calls or shows a result of."""
    flags = [F.when(text.contains(f'"name":"{n}"') | text.contains(f"<tool name={n}>"), F.lit(n)) for n in names]
    return F.array_compact(F.array(*flags))


def rename_tools(text: Column, mapping: dict[str, str]) -> Column:
    """Canonical tool names to surface names, longest first, in calls and results."""
    for old in sorted(mapping, key=lambda k: (-len(k), k)):
        text = F.replace(F.replace(text, F.lit(f'"name":"{old}"'), F.lit(f'"name":"{mapping[old]}"')), F.lit(f"<tool name={old}>"), F.lit(f"<tool name={mapping[old]}>"))
    return text


def with_schema(text: Column, schema_json: Column) -> Column:
    return F.concat(F.lit("<system>"), schema_json, F.lit("</system>\n"), text)


def context(system: Column, history: Column, user: Column) -> Column:
    """What a model is given: system block if any, history, the user's turn, a line end."""
    return F.concat(F.concat_ws("\n", F.when(system.isNotNull(), F.concat(F.lit("<system>"), system, F.lit("</system>"))), history, F.concat(F.lit("<user>"), user, F.lit("</user>"))), F.lit("\n"))


def split_trace(text: Column) -> Column:
    """struct(system, first user text, last response) of a trace."""
    answer = F.element_at(F.regexp_extract_all(text, F.lit(r'"response":"((?:[^"\\]|\\.)*)"'), F.lit(1)), -1)
    return F.struct(F.regexp_extract(text, "(?s)<system>(.*?)</system>", 1).alias("system"), F.regexp_extract(text, "(?s)<user>(.*?)</user>", 1).alias("user"), F.when(text.contains('"response":"'), answer).alias("response"))


def to_chat_api(role: Column, thought: Column, response: Column, name: Column, arguments: Column) -> Column:
    call = F.when(name.isNotNull(), F.array(F.struct(F.struct(name.alias("name"), F.coalesce(F.try_parse_json(arguments), F.parse_json(F.lit("{}"))).alias("arguments")).alias("function"))))
    return F.to_json(F.struct(role.alias("role"), F.coalesce(response, F.lit("")).alias("content"), thought.alias("thinking"), call.alias("tool_calls")))


def from_chat_api(message: Column) -> Column:
    """The payload of an assistant's API message (JSON text): a thought and either the first tool
    call or the response. Arguments that are no object, or text that is none, become ``{}``."""
    get = lambda path: F.get_json_object(message, path)
    name = F.coalesce(get("$.tool_calls[0].function.name"), F.lit(""))
    raw = get("$.tool_calls[0].function.arguments")
    arguments = F.when(F.coalesce(F.schema_of_variant(F.try_parse_json(raw)).startswith("OBJECT"), F.lit(False)), raw).otherwise("{}")
    thought, has = get("$.thinking"), get("$.tool_calls[0]").isNotNull()
    text = lambda c: F.regexp_replace(F.to_json(F.struct(c.alias("v"))), r"^\{\"v\":|\}$", "")
    said = F.when(F.coalesce(thought, F.lit("")) != "", thought).otherwise(F.when(has, F.concat(F.lit("Calling "), name, F.lit("."))).otherwise("Answering directly."))
    call = F.concat(F.lit('"tool_call":{"name":'), text(name), F.lit(',"arguments":'), arguments, F.lit("}"))
    answer = F.concat(F.lit('"response":'), text(F.coalesce(get("$.content"), F.lit(""))))
    return F.concat(F.lit('{"thought":'), text(said), F.lit(","), F.when(has, call).otherwise(answer), F.lit("}"))


def run_message(answer: Column, thinking: Column) -> Column:
    """A run's result as one API response."""
    message = F.struct(F.lit("assistant").alias("role"), F.coalesce(answer, F.lit("")).alias("content"), F.coalesce(thinking, F.lit("")).alias("thinking"))
    return F.to_json(F.struct(message.alias("message"), F.lit(True).alias("done"), F.lit("stop").alias("done_reason")))


#: The kinds of the one-step generator and their weights.
ONE_STEP = {"calc": 35, "memory": 30, "time": 20, "search": 15}


def one_step_traces(spark: SparkSession, n: int, memory: list[tuple[str, str]], facts: list[tuple[str, str]], now: str, seed: int = 0) -> DataFrame:
    """(trace_id, kind, trace): a question, one tool call, its result and the answer that repeats it."""
    u = lambda k: draw(seed, "trace_id", F.lit(k))
    total, at, kind = sum(ONE_STEP.values()), 0, F.lit(None).cast("string")
    roll = F.pmod(u("kind"), F.lit(total))
    for name, weight in reversed(ONE_STEP.items()):
        at += weight
        kind = F.when(roll >= total - at, name) if at == weight else F.when(roll < total - at + weight, name).otherwise(kind)
    a, b = ((F.pmod(u(x), F.lit(90)) + 10).cast("bigint") for x in ("a", "b"))
    op = pick(["+", "-", "*"], u("op"))
    value = F.when(op == "+", a + b).when(op == "-", a - b).otherwise(a * b)
    expr = F.concat_ws(" ", a.cast("string"), op, b.cast("string"))

    def entry(table, what):
        rows = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(v).alias("v")) for k, v in table])
        return F.element_at(rows, (F.pmod(u(what), F.lit(len(table))) + 1).cast("int"))

    m, f = entry(memory, "memory"), entry(facts, "facts")
    case = lambda c, x, y, z: F.when(F.col("kind") == "calc", c).when(F.col("kind") == "memory", x).when(F.col("kind") == "search", y).otherwise(z)
    x = ids(spark, n).withColumn("kind", kind)
    x = x.withColumn("ask", case(F.concat(F.lit("What is "), expr, F.lit("?")), F.concat(F.lit("What is the "), m["k"], F.lit("?")), F.concat(F.lit("What is the "), f["k"], F.lit("?")), F.lit("What time is it?")))
    x = x.withColumn("tool", case(F.lit("calc"), F.lit("search_memory"), F.lit("web_search"), F.lit("now")))
    x = x.withColumn("args", case(F.concat(F.lit('{"expr":"'), expr, F.lit('"}')), F.concat(F.lit('{"key":"'), m["k"], F.lit('"}')), F.concat(F.lit('{"query":"'), f["k"], F.lit('"}')), F.lit("{}")))
    x = x.withColumn("result", case(value.cast("string"), m["v"], f["v"], F.lit(now)))
    call = F.concat(F.lit('<assistant>{"thought":"use '), F.col("tool"), F.lit('","tool_call":{"name":"'), F.col("tool"), F.lit('","arguments":'), F.col("args"), F.lit("}}</assistant>"))
    shown = F.concat(F.lit("<tool name="), F.col("tool"), F.lit(">"), F.col("result"), F.lit("</tool>"))
    end = F.concat(F.lit('<assistant>{"thought":"done","response":"'), F.col("result"), F.lit('"}</assistant>'), F.lit(EOT))
    return x.select("trace_id", "kind", F.concat_ws("\n", F.concat(F.lit("<user>"), F.col("ask"), F.lit("</user>")), call, shown, end).alias("trace"))


def lookup_chains(spark: SparkSession, n: int, facts: DataFrame, hops: int = 6, seed: int = 0) -> DataFrame:
    """(trace_id, steps, value): chains in which every third step looks a quantity up (``facts``: key,
    value, number) and adds it, and the others work on with the last result.

    Facts are dealt by rank of their keys; the plan's keys are joined to them, so any number of facts will do."""
    from lathe.operators.ordering import numbered

    ranked = numbered(facts.where("number IS NOT NULL"), "key", name="rank")
    many = ranked.count()
    x = ids(spark, n if many else 0).withColumn("many", F.lit(many))
    looks = [i for i in range(hops) if i % 3 == 0]
    for i in looks:
        r = ranked.select(F.col("rank").alias("__k"), F.struct("key", "value", "number").alias(f"f{i}"))
        x = x.withColumn("__r", F.pmod(draw(seed, "trace_id", F.lit(f"fact{i}")), F.col("many"))).join(r, F.col("__r") == F.col("__k")).drop("__r", "__k")
    at, steps = F.lit(0.0), []
    for i in range(hops):
        if i in looks:
            at = at + F.col(f"f{i}.number")
            steps.append(F.struct(F.lit("web_search").alias("tool"), F.col(f"f{i}.key").alias("argument"), F.col(f"f{i}.value").alias("result"), at.alias("at")))
        else:
            v = (F.pmod(draw(seed, "trace_id", F.lit(f"v{i}")), F.lit(9)) + 2).cast("double")
            by = pick(["+", "-"], draw(seed, "trace_id", F.lit(f"op{i}")))
            expr = F.concat_ws(" ", at.cast("string"), by, v.cast("string"))
            at = F.when(by == "+", at + v).otherwise(at - v)
            steps.append(F.struct(F.lit("calc").alias("tool"), expr.alias("argument"), at.cast("string").alias("result"), at.alias("at")))
    return x.select("trace_id", F.array(*steps).alias("steps"), at.alias("value"))
