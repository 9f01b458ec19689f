"""Traces composed from patterns, pools and draws, and the loop that goes on until enough are good.

A trace's content depends on (seed, trace_id) alone. Patterns are data: lines of messages with places to
fill in, and the ranges that numbers are drawn from. A pattern comes from an alias table in two draws,
facts and phrases from numbered pools joined by a drawn number, and what a tool says from the tools
themselves: arithmetic is carried out, facts and memory are looked up, other tools answer from what was
recorded of them. Traces, pools and lines meet in joins, so a pool may be of any size.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lathe.functions.numbers import calc, first_number, leads_with_quantity, round_text
from lathe.functions.protocol import EOT, assistant_blocks, contract_ok
from lathe.operators.generate import pick
from lathe.operators.mixes import grounding
from lathe.operators.ordering import numbered, ranked
from lathe.operators.pools import usable_facts
from lathe.operators.relational import draw
from lathe.sources.scratch import written

#: The patterns and how many of 112 or of 100 traces each has.
INSTRUCT = {"math": 11, "memory": 7, "web": 11, "time": 5, "web_then_math": 11, "memory_then_math": 9, "two_stage_math": 9, "web_two_stage": 11, "cross_source": 10, "memory_two_stage": 10, "repo_symbol": 2, "repo_search": 2, "repo_read": 1, "repo_stats": 1, "repo_list": 1, "sandbox": 4}
CHAT = {"chat_math_coref": 34, "chat_topic_pair": 30, "chat_back_reference": 22, "math": 7, "web": 7}
#: Weights of the single-step mix, of the older mix and of the conversations.
SIMPLE = {"math": 35, "memory": 30, "time": 20, "web": 15}
MIXED = {"math": 15, "memory": 10, "time": 8, "web": 10, "web_then_math": 12, "memory_then_math": 12, "multi_hop": 10, "three_stage_math": 10, "web_two_stage": 7, "cross_source_product": 6}
CONVERSATIONS = {"chat_math_coref": 20, "chat_topic_pair": 14, "chat_memory_pair": 14, "chat_web_compute": 14, "chat_back_reference": 12, "chat_topic_switch": 10, "chat_clarification": 8, "chat_time_memory": 8}

MESSAGE = "struct<role:string,situation:string,fallback:string,tool:string,arguments:string,said:string>"
LINE = "role string, intent string, situation string, fallback string, tool string, argument string, given string, said array<string>"


def line(role: str, said: str | Sequence[str] | None = None, situation: str | None = None, fallback: str | None = None, tool: str | None = None, argument: str | None = None, given: str | None = None, intent: str | None = None) -> tuple:
    """A message: what is said (one of several wordings), or a tool with its argument's name and value."""
    return role, intent, situation, fallback, tool, argument, given, [said] if isinstance(said, str) else list(said or ())


def user(*said: str, intent: str | None = None) -> list[tuple]:
    return [line("user", said, intent=intent)]


def reply(situation: str, fallback: str, said: str) -> list[tuple]:
    return [line("assistant", said, situation, fallback)]


def call(situation: str, fallback: str, tool: str, argument: str | None, given: str | None, result: str) -> list[tuple]:
    """A call and what the tool says."""
    return [line("assistant", None, situation, fallback, tool, argument, given), line("tool", result, tool=tool)]


def compute(n: int, situation: str = "chain_first", fallback: str = "Now the arithmetic.") -> list[tuple]:
    return call(situation, fallback, "calc", "expr", f"{{e{n}}}", f"{{r{n}}}")


def search(of: str, fallback: str = "This has to be looked up.") -> list[tuple]:
    return call("web_call", fallback, "web_search", "query", f"{{{of}.key}}", f"{{{of}.value}}")


def recall(of: str, situation: str = "memory_call") -> list[tuple]:
    return call(situation, f"The stored {{{of}.key}} is needed.", "search_memory", "key", f"{{{of}.key}}", f"{{{of}.value}}")


def last(n: int) -> list[tuple]:
    return reply("chain_last", "That is the final result.", f"{{r{n}}}")


@dataclass(frozen=True)
class Pattern:
    """Lines of messages; signs with a wording for each; ranges of a, b, c and k; expressions, each of which may
    use the results before it; the pools that it needs; and the pattern that stands in if one is empty."""

    lines: list[list[tuple]]
    signs: dict[str, str] = field(default_factory=dict)
    ranges: dict[str, tuple[int, int]] = field(default_factory=dict)
    expressions: tuple[str, ...] = ()
    needs: tuple[str, ...] = ()
    otherwise: str = "math"


FIRST = ("calc_call", "A calculation is needed.")
DONE = ("calc_done", "The calculation is done.")
CLOCK = call("time_call", "The clock will tell.", "now", None, None, "{now}") + reply("time_done", "This is the current time.", "{now}")
STORED = ("memory_done", "The value was stored.", "{stored.value}")
TOLD = Pattern([user("{call.question}"), [line("assistant", None, "repo_call", "A tool can answer this.", "{call.tool}", None, "{call.arguments}"), line("tool", "{call.result}", tool="{call.tool}")], reply("repo_done", "This is what it says.", "{call.answer}")], needs=("call",))

#: The patterns. The ranges and signs, and what each pattern does in which order.
PATTERNS = {
    "math": Pattern([user("What is {e1}?", intent="math"), compute(1, *FIRST), reply(*DONE, "{r1}")], {"+": "", "-": "", "*": "", "/": ""}, {"a": (1, 500), "b": (1, 500)}, ("{a} {sign} {b}",)),
    "memory": Pattern([user("Look up the {stored.key}.", intent="memory"), recall("stored"), reply(*STORED)], needs=("stored",)),
    "web": Pattern([user("What is the {fact.key}?", intent="web"), search("fact"), reply("web_done", "The search gave the answer.", "{fact.value}")], needs=("fact",)),
    "time": Pattern([user("What is the current date and time?", intent="time"), CLOCK]),
    "web_then_math": Pattern([user("Look up the {quantity.key} and {word} {k}."), search("quantity"), compute(1), last(1)], {"+": "add", "-": "subtract", "*": "multiply it by"}, {"k": (2, 50)}, ("{quantity.n} {sign} {k}",), ("quantity",)),
    "memory_then_math": Pattern([user("Look up the {stored_quantity.key} and {word} {k}."), recall("stored_quantity"), compute(1), last(1)], {"+": "add", "*": "multiply by"}, {"k": (2, 40)}, ("{stored_quantity.n} {sign} {k}",), ("stored_quantity",)),
    "two_stage_math": Pattern([user("Multiply {a} and {b}, then add {c}."), compute(1, "calc_call", "The product comes first."), compute(2), last(2)], {}, {"a": (2, 99), "b": (2, 99), "c": (2, 20)}, ("{a} * {b}", "{r1} + {c}")),
    "web_two_stage": Pattern([user("Look up the {quantity.key}, add {a}, then multiply by {b}."), search("quantity"), compute(1), compute(2), last(2)], {}, {"a": (2, 40), "b": (2, 12)}, ("{quantity.n} + {a}", "{r1} * {b}"), ("quantity",), "two_stage_math"),
    "cross_source": Pattern([user("Look up the stored {stored_quantity.key}, then {word} the {quantity.key}."), recall("stored_quantity"), search("quantity"), compute(1), last(1)], {"+": "add it to", "*": "multiply it by"}, {}, ("{stored_quantity.n} {sign} {quantity.n}",), ("stored_quantity", "quantity"), "two_stage_math"),
    "memory_two_stage": Pattern([user("Multiply the sum of {a} and the stored {stored_quantity.key} by {b}.", "Look up the {stored_quantity.key}, add {a}, then multiply by {b}."), recall("stored_quantity"), compute(1), compute(2), last(2)], {}, {"a": (2, 30), "b": (2, 10)}, ("{stored_quantity.n} + {a}", "{r1} * {b}"), ("stored_quantity",), "two_stage_math"),
    "multi_hop": Pattern([user("Multiply {a} and {b}, then add the stored {stored_quantity.key}."), compute(1, "calc_call", "The product comes first."), recall("stored_quantity", "chain_first"), compute(2), last(2)], {}, {"a": (2, 50), "b": (2, 50)}, ("{a} * {b}", "{r1} + {stored_quantity.n}"), ("stored_quantity",), "two_stage_math"),
    "three_stage_math": Pattern([user("Multiply {a} by {b}, add {c} to that, then multiply the result by {k}."), compute(1, "calc_call", "The product comes first."), compute(2), compute(3), last(3)], {}, {"a": (2, 30), "b": (2, 30), "c": (1, 25), "k": (2, 10)}, ("{a} * {b}", "{r1} + {c}", "{r2} * {k}")),
    "cross_source_product": Pattern([user("Add the stored {stored_quantity.key} to the {quantity.key}, then multiply by {k}."), recall("stored_quantity"), search("quantity"), compute(1), last(1)], {}, {"k": (2, 10)}, ("({stored_quantity.n} + {quantity.n}) * {k}",), ("stored_quantity", "quantity"), "two_stage_math"),
    "chat_math_coref": Pattern([user("What is {e1}?", intent="math"), compute(1, *FIRST), reply(*DONE, "{r1}"), user("{word}"), compute(2, "coref", "The last result, {r1}, is meant."), reply(*DONE, "{r2}")], {"*": "Multiply that by {k}.", "+": "Add {k} to that.", "-": "Subtract {k} from that."}, {"a": (2, 200), "b": (2, 200), "k": (2, 12)}, ("{a} + {b}", "{r1} {sign} {k}")),
    "chat_topic_pair": Pattern([user("What is the {fact.key}?", intent="web"), search("fact"), reply("web_done", "Found it.", "{fact.value}"), user("And the {other_fact.key}?", "What about the {other_fact.key}?", "Next, the {other_fact.key}."), search("other_fact", "The topic has changed."), reply("web_done", "Found it.", "{other_fact.value}")], needs=("other_fact",), otherwise="chat_math_coref"),
    "chat_back_reference": Pattern([user("What is {e1}?"), compute(1, *FIRST), reply(*DONE, "{r1}"), user("Look up the {stored.key}."), recall("stored"), reply(*STORED), user("What was the result of my first question?", "What was the first answer again?", "Which number did we begin with?"), reply("no_tool", "The first result was {r1}; no tool is needed.", "{r1}")], {}, {"a": (10, 99), "b": (10, 99)}, ("{a} + {b}",), ("stored",), "chat_math_coref"),
    "chat_memory_pair": Pattern([user("Look up the {stored.key}."), recall("stored"), reply(*STORED), user("And the {other_stored.key}?", "What about the {other_stored.key}?", "Next, the {other_stored.key}."), recall("other_stored"), reply("memory_done", "The value was stored.", "{other_stored.value}")], needs=("other_stored",), otherwise="chat_math_coref"),
    "chat_web_compute": Pattern([user("What is the {quantity.key}?"), search("quantity"), reply("web_done", "The search gave the answer.", "{quantity.value}"), user("{word}"), compute(1, "coref", "The {quantity.key} is meant."), reply(*DONE, "{r1}")], {"*": "Multiply it by {k}.", "+": "Add {k} to it."}, {"k": (2, 5)}, ("{quantity.n} {sign} {k}",), ("quantity",), "chat_math_coref"),
    "chat_topic_switch": Pattern([user("Compute {e1}."), compute(1, *FIRST), reply(*DONE, "{r1}"), user("Something else: what is the {fact.key}?"), search("fact", "This is a new topic."), reply("web_done", "Found it.", "{fact.value}")], {}, {"a": (2, 50), "b": (2, 50)}, ("{a} * {b}",), ("fact",), "chat_math_coref"),
    "chat_clarification": Pattern([user("What tools do you have?", "What can you do?", "Which tools are there?"), reply("no_tool", "This asks what I can do; no tool is needed.", "calc does arithmetic, search_memory finds stored values, web_search finds facts, and now tells the time."), user("Good, what is {e1}?"), compute(1, *FIRST), reply(*DONE, "{r1}")], {}, {"a": (2, 60), "b": (2, 60)}, ("{a} * {b}",)),
    "chat_time_memory": Pattern([user("What time is it?"), CLOCK, user("Thanks. Now look up the {stored.key}."), recall("stored"), reply(*STORED)], needs=("stored",), otherwise="chat_math_coref"),
} | {name: TOLD for name in ("repo_symbol", "repo_search", "repo_read", "repo_stats", "repo_list", "sandbox")}


def alias_table(weights: dict[str, int]) -> tuple[list[str], list[int], list[str]]:
    """Equal columns of a weighted choice: of the total weight W each holds its first name up to a bound
    below W, and its second name above it. Exact in whole numbers."""
    total, n = sum(weights.values()), len(weights)
    left = {k: n * w for k, w in weights.items()}
    names, bounds, others = [], [], []
    while left:  # what is left always fills as many columns as there are names left
        low = min(left, key=left.__getitem__)
        bound = left.pop(low)
        high = max(left, key=left.__getitem__) if bound < total else low
        names.append(low)
        bounds.append(bound)
        others.append(high)
        if high != low:
            left[high] -= total - bound
    return names, bounds, others


def alias_choice(weights: dict[str, int], seed: int, *key: Column | str) -> Column:
    """A name by weight: one draw for the column, one for the place in it."""
    names, bounds, others = alias_table(weights)
    at = (F.pmod(draw(seed, *key, F.lit("column")), F.lit(len(names))) + 1).cast("int")
    item = lambda values: F.element_at(F.array(*[F.lit(v) for v in values]), at)
    return F.when(F.pmod(draw(seed, *key, F.lit("place")), F.lit(sum(weights.values()))) < item(bounds), item(names)).otherwise(item(others))


@dataclass(frozen=True)
class Pool:
    """Rows of a pool with dense numbers from 0, and how many there are."""

    rows: DataFrame
    many: int

    @classmethod
    def of(cls, rows: DataFrame, *order: str) -> Pool:
        x = numbered(rows, *order)
        return cls(x, x.count())

    def drawn(self, df: DataFrame, name: str, u: Column) -> DataFrame:
        """``df`` with one row of the pool as the struct ``name``; null where the pool is empty."""
        row = F.struct(*[c for c in self.rows.columns if c != "number"])
        if not self.many:
            return df.withColumn(name, F.lit(None).cast(self.rows.select(row.alias("r")).schema["r"].dataType))
        index = f"__{name}"
        return df.withColumn(index, F.pmod(u, F.lit(self.many))).join(self.rows.select(F.col("number").alias(f"{index}_n"), row.alias(name)), F.col(index) == F.col(f"{index}_n"), "left").drop(index, f"{index}_n")


def options(pool: DataFrame, group: str, value: str) -> DataFrame:
    """(group, number, many, value): the distinct values of each group, numbered from 0."""
    x = ranked(pool.select(group, value).distinct(), group, value, "number").withColumn("number", F.col("number") - 1)
    return written(x.join(x.groupBy(group).agg(F.count("*").alias("many")), group))


def with_option(df: DataFrame, table: DataFrame | None, group: Column, value: str, u: Column, fallback: Column) -> DataFrame:
    """``df`` with ``value``: a drawn option of the row's group, or the fallback where the group has none."""
    if table is None:
        return df.withColumn(value, fallback)
    name, said = table.columns[0], next(c for c in table.columns if c not in (table.columns[0], "number", "many"))
    many = table.groupBy(F.col(name).alias("__g")).agg(F.first("many").alias("__many"))
    x = df.join(many, group == F.col("__g"), "left").withColumn("__i", F.pmod(u, F.col("__many")))
    x = x.join(table.select(F.col(name).alias("__name"), F.col("number").alias("__n"), F.col(said).alias("__said")), (F.col("__g") == F.col("__name")) & (F.col("__i") == F.col("__n")), "left")
    return x.withColumn(value, F.coalesce("__said", fallback)).drop("__g", "__many", "__i", "__name", "__n", "__said")


def json_text(c: Column) -> Column:
    return F.regexp_replace(F.to_json(F.struct(c.alias("v"))), r'^\{"v":|\}$', "")


def filled_in(template: Column, values: Column) -> Column:
    """The template with each {name} replaced by the map's value, which is not looked at again; null if one is missing."""
    parts = F.transform(F.regexp_extract_all(template, F.lit(r"\{[a-z_0-9.]+\}|[^{}]+|[{}]"), F.lit(0)), lambda p: F.when(p.rlike(r"^\{[a-z_0-9.]+\}$"), F.try_element_at(values, F.substring(p, F.lit(2), F.length(p) - 2))).otherwise(p))
    return F.when(~F.exists(parts, lambda p: p.isNull()), F.array_join(parts, ""))


def serialised(messages: DataFrame, key: str = "trace_id", chat: bool = True) -> DataFrame:
    """(key, trace) of messages (key, pos, thought and the fields of MESSAGE): an end mark after each answer
    (chat), or one at the end."""
    action = F.when(F.col("tool").isNotNull(), F.concat(F.lit(',"tool_call":{"name":'), json_text(F.col("tool")), F.lit(',"arguments":'), F.col("arguments"), F.lit("}}"))).otherwise(F.concat(F.lit(',"response":'), json_text(F.col("said")), F.lit("}")))
    body = F.when(F.col("role") == "assistant", F.concat(F.lit('{"thought":'), json_text(F.col("thought")), action)).otherwise(F.col("said"))
    end = F.when((F.col("role") == "assistant") & F.col("tool").isNull(), EOT if chat else "").otherwise("")
    block = F.when(F.col("role") == "tool", F.concat(F.lit("<tool name="), "tool", F.lit(">"), "said", F.lit("</tool>"))).otherwise(F.concat(F.lit("<"), "role", F.lit(">"), body, F.lit("</"), "role", F.lit(">"), end))
    x = messages.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("pos", block.alias("b")))).alias("z"))
    text = F.array_join(F.transform("z", lambda s: s["b"]), "\n")
    return x.select(key, (text if chat else F.concat(text, F.lit(EOT))).alias("trace"))


def with_thoughts(messages: DataFrame, thoughts: DataFrame | None, seed: int, key: str = "trace_id") -> DataFrame:
    return with_option(messages, thoughts, F.col("situation"), "thought", draw(seed, key, F.lit("thought"), "pos"), F.col("fallback"))


class Composer:
    """Builds traces of given numbers. ``facts`` and ``memory`` are (key, value); ``recorded`` calls are
    (pattern, question, tool, arguments, result, answer), the answer being the result where it is null;
    ``thoughts`` (situation, text) and ``phrases`` (intent, text) give the wording, with
    {EXPR}, {KEY} and {TOPIC} filled in."""

    def __init__(self, facts: DataFrame, memory: DataFrame, now: str, recorded: DataFrame | None = None, thoughts: DataFrame | None = None, phrases: DataFrame | None = None, seed: int = 42):
        facts = usable_facts(facts).select("key", "value", F.when(leads_with_quantity(F.col("value")), round_text(first_number(F.col("value")))).alias("n"))
        memory = memory.select("key", "value", round_text(first_number(F.col("value"))).alias("n"))
        self.spark, self.now, self.seed = facts.sparkSession, now, seed
        self.pools = {"fact": Pool.of(facts, "key"), "quantity": Pool.of(facts.where("n IS NOT NULL"), "key"), "stored": Pool.of(memory, "key"), "stored_quantity": Pool.of(memory.where("n IS NOT NULL"), "key")}
        self.recorded = None if recorded is None else options(recorded.withColumn("call", F.struct("question", "tool", "arguments", "result", F.coalesce("answer", "result").alias("answer"))), "pattern", "call")
        self.thoughts = None if thoughts is None else options(thoughts, "situation", "text")
        self.phrases = None if phrases is None else options(phrases, "intent", "text")
        self.have = {k for k, p in self.pools.items() if p.many} | {f"other_{k}" for k in ("fact", "stored") if self.pools[k].many > 1} | ({"call"} if recorded is not None else set())

    def effective(self, name: str) -> str:
        """The pattern whose content a name has, with the pools that there are; calls that nothing recorded fail."""
        p = PATTERNS[name]
        return name if self.have.issuperset(p.needs) or p is TOLD and name != "sandbox" else p.otherwise

    def u(self, *what: str) -> Column:
        return draw(self.seed, "trace_id", *[F.lit(w) for w in what])

    def bound(self, ids: DataFrame, weights: dict[str, int]) -> DataFrame:
        """(trace_id, pattern, body, values): all that a trace's pattern may fill in, as a map."""
        bodies = {k: self.effective(k) for k in weights}
        kinds = F.create_map(*[F.lit(s) for kv in bodies.items() for s in kv])
        x = ids.withColumn("pattern", alias_choice(weights, self.seed, "trace_id", F.lit("pattern"))).withColumn("body", F.element_at(kinds, F.col("pattern")))
        numbers = "abck"
        rows = [(b, list(p.signs), list(p.signs.values()), *[v for c in numbers for v in p.ranges.get(c, (None, None))], *(*p.expressions, None, None, None)[:3]) for b in sorted(set(bodies.values())) for p in [PATTERNS[b]]]
        rules = self.spark.createDataFrame(rows, "body string, signs array<string>, words array<string>, " + ", ".join(f"{c}_low long, {c}_high long" for c in numbers) + ", x1 string, x2 string, x3 string")
        x = x.join(F.broadcast(rules), "body")  # a row a pattern
        for name in sorted(self.have - {"call"}):
            of = name.removeprefix("other_")
            pool, at = self.pools[of], self.u(of)
            if of != name:  # another row than the first one: some steps further on
                at = F.pmod(at, F.lit(pool.many)) + 1 + F.pmod(self.u(name), F.lit(pool.many - 1))
            users = [b for b in sorted(set(bodies.values())) if {name, f"other_{name}"} & set(PATTERNS[b].needs)]
            if users:
                x = pool.drawn(x, name, F.when(F.col("body").isin(*users), at))
        if "call" in self.have:
            x = with_option(x, self.recorded, F.col("body"), "call", self.u("call"), F.lit(None).cast(self.recorded.schema["call"].dataType))
        sign = (F.pmod(self.u("sign"), F.greatest(F.size("signs"), F.lit(1))) + 1).cast("int")
        known = {c: (F.col(f"{c}_low") + F.pmod(self.u(c), F.col(f"{c}_high") - F.col(f"{c}_low") + 1)).cast("string") for c in numbers}
        known |= {"sign": F.try_element_at("signs", sign), "now": F.lit(self.now)}
        for name in x.columns:
            if name in self.have:
                fields = ("question", "tool", "arguments", "result", "answer") if name == "call" else ("key", "value", "n")
                known |= {f"{name}.{f}": F.col(f"{name}.{f}") for f in fields}
        x = x.select("trace_id", "pattern", "body", F.try_element_at("words", sign).alias("word"), "x1", "x2", "x3", F.create_map(*[c for k, v in known.items() for c in (F.lit(k), v)]).alias("values"))
        add = lambda **more: F.map_concat("values", F.create_map(*[c for k, v in more.items() for c in (F.lit(k), v)]))
        for i in (1, 2, 3):
            x = x.withColumn("e", filled_in(F.col(f"x{i}"), F.col("values"))).withColumn("r", calc("e"))
            x = x.withColumn("r", F.when(~F.col("r").startswith("ERROR"), F.col("r"))).withColumn("values", add(**{f"e{i}": F.col("e"), f"r{i}": F.col("r")}))
        x = x.withColumn("values", add(word=filled_in(F.col("word"), F.col("values"))))
        return x.select("trace_id", "pattern", "body", "values")

    def messages(self, bound: DataFrame) -> DataFrame:
        """(trace_id, pos, fields of MESSAGE): the lines of each trace's pattern, filled in."""
        rows = [(b, pos, *row) for b, p in PATTERNS.items() for pos, row in enumerate(row for part in p.lines for row in part)]
        lines = self.spark.createDataFrame([(b if PATTERNS[b] is not TOLD else "", pos, *row) for b, pos, *row in rows if PATTERNS[b] is not TOLD or b == "sandbox"], f"at string, pos int, {LINE}")
        told = [b for b, p in PATTERNS.items() if p is TOLD]
        x = bound.withColumn("at", F.when(F.col("body").isin(*told), "").otherwise(F.col("body"))).join(F.broadcast(lines), "at")  # a few lines a pattern
        v = F.col("values")
        x = with_option(x, self.phrases, F.col("intent"), "phrase", self.u("phrase"), F.lit(None).cast("string"))
        phrase = reduce(lambda text, kv: F.replace(text, F.lit(kv[0]), F.lit(kv[1])), (("{EXPR}", "{e1}"), ("{KEY}", "{stored.key}"), ("{TOPIC}", "{fact.key}"), ("{NOW}", "")), F.col("phrase"))
        own = F.try_element_at("said", (F.pmod(draw(self.seed, "trace_id", F.lit("wording"), "pos"), F.greatest(F.size("said"), F.lit(1))) + 1).cast("int"))
        given = filled_in(F.col("given"), v)
        arguments = F.when(F.col("argument").isNotNull(), F.concat(F.lit('{"'), "argument", F.lit('":'), json_text(given), F.lit("}"))).when(F.col("given").isNotNull(), given).when(F.col("tool").isNotNull() & (F.col("role") == "assistant"), "{}")
        x = x.select("trace_id", "pos", "role", "situation", filled_in(F.col("fallback"), v).alias("fallback"), filled_in(F.col("tool"), v).alias("tool"), arguments.alias("arguments"), filled_in(F.coalesce(phrase, own), v).alias("said"))
        return x.withColumn("sound", F.coalesce(F.when((F.col("role") == "assistant") & F.col("tool").isNotNull(), F.col("arguments")).otherwise(F.col("said")).isNotNull(), F.lit(False)))

    def traces(self, ids: DataFrame, chat: bool = False, systems: Sequence[str] = (), system_share: float = 0.4, weights: dict[str, int] | None = None) -> DataFrame:
        """(trace_id, pattern, trace) of each trace_id; the trace is null where the pattern could not be carried out."""
        x = written(self.bound(ids, weights or (CHAT if chat else INSTRUCT)))
        rows = written(with_thoughts(self.messages(x), self.thoughts, self.seed))
        failed = rows.where("NOT sound").select("trace_id").distinct()
        rows = rows.drop("sound").join(failed, "trace_id", "left_anti")
        if systems:
            some = x.join(failed, "trace_id", "left_anti").where(self.u("system") < int(system_share * (1 << 32)))
            none = F.lit(None).cast("string")
            first = some.select("trace_id", F.lit(-1).alias("pos"), F.lit("system").alias("role"), *[none.alias(c) for c in ("situation", "fallback", "tool", "arguments")], pick(list(systems), self.u("which system")).alias("said"), none.alias("thought"))
            rows = rows.unionByName(first)
        return x.select("trace_id", "pattern").join(serialised(rows, chat=chat), "trace_id", "left")


def judged(candidates: DataFrame, max_len: int) -> DataFrame:
    """``candidates`` (trace_id, pattern, trace) with ``reason``: why one is not kept, null for good ones."""
    x = written(candidates)
    sound = grounding(x.where("trace IS NOT NULL").select("trace_id", "trace"), "trace_id", "trace").select("trace_id", F.col("ok").alias("grounded"))
    valid = F.forall(assistant_blocks(F.col("trace")), contract_ok)
    why = F.when(F.col("trace").isNull(), "failed").when(F.length("trace") > max_len, "too_long").when(~valid, "malformed").when(~F.col("grounded"), "ungrounded")
    return x.join(sound, "trace_id", "left").withColumn("reason", why).drop("grounded")


def filled(spark: SparkSession, make: Callable[[DataFrame], DataFrame], n: int, max_len: int = 768, most: int = 20) -> tuple[DataFrame, DataFrame]:
    """(traces, report): the first ``n`` good traces by trace_id, and by pattern how many were kept and why others were not.

    Traces are tried in rounds: draw, judge, count, and draw as many more as the share of good
    ones so far asks for, with the next numbers. Rounds change what is tried, not what is
    returned. After ``most`` times n tries there are as many as there are."""
    tried, good, rounds = 0, 0, []
    while good < n and tried < most * n:
        share = max(good / tried, 1 / most) if tried else 1.0
        more = min(math.ceil((n - good) / share * 1.05) + 8, most * n - tried)
        ids = spark.range(tried, tried + more).withColumnRenamed("id", "trace_id")
        rounds.append(written(judged(make(ids), max_len)))
        good += rounds[-1].where("reason IS NULL").count()
        tried += more
    if not rounds:
        rounds = [written(judged(make(spark.range(0).withColumnRenamed("id", "trace_id")), max_len))]
    x = reduce(DataFrame.unionByName, rounds)
    accepted = numbered(x.where("reason IS NULL"), "trace_id").where(F.col("number") < n)
    last = accepted.agg(F.max("trace_id")).first()[0]
    used = x.where(F.col("trace_id") <= last) if good >= n and last is not None else x
    count = lambda reason: F.count_if(F.col("reason").eqNullSafe(reason)).alias(reason or "kept")
    report = used.groupBy("pattern").agg(*[count(r) for r in (None, "too_long", "ungrounded", "malformed", "failed")])
    return accepted.select("trace_id", "pattern", "trace"), report


def starved(report: DataFrame, limit: float = 0.2) -> DataFrame:
    """(pattern, kept, dropped): patterns that lose more than ``limit`` of their traces to their length."""
    dropped = F.col("too_long")
    return report.where(dropped > limit * (F.col("kept") + dropped)).select("pattern", "kept", dropped.alias("dropped"))
