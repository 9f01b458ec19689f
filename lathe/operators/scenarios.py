"""Scenario plans carried out: one fold a conversation over its steps, with what came before at hand.

A plan is turns of step kinds. All that its steps may bind is drawn and joined first, a row a step; then
the steps of a conversation are folded in order. The fold decides what binds (a step that computes needs a
value), writes the user's turn so that it names all that the turn uses, carries the last number from step to
step and turn to turn, and shows calls that fail and what is said about it. A conversation's content
depends on (seed, trace_id) alone.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lathe.functions.numbers import NUMBER, calculate, leads_with_quantity
from lathe.operators.compose import MESSAGE, Pool, options, serialised, with_thoughts
from lathe.operators.generate import pick
from lathe.operators.relational import draw
from lathe.operators.toolbox import run_calls
from lathe.sources.scratch import written

#: Calls that fail for a plain reason.
FAILING = (("search_memory", '{"key":"budget"}'), ("search_memory", '{"key":"deadline"}'), ("web_search", '{"query":"the exact value I need"}'), ("calc", '{"expr":"10 / 0"}'))
SHOWN = 300
WORD = {"+": "add", "-": "subtract", "*": "multiply by"}
STEP = "struct<turn:int,step:int,asked:string,kind:string,key:string,tool:string,arguments:string,result:string,op:string,k:int,reference:string>"


def planned(ids: DataFrame, plans: Pool, seed: int) -> DataFrame:
    """(trace_id, plan_id, turn, step, asked, kind): a drawn plan (plan_id, turns) of each trace, a row a step."""
    x = plans.drawn(ids, "plan", draw(seed, "trace_id", F.lit("plan")))
    x = x.select("trace_id", F.col("plan.plan_id").alias("plan_id"), F.posexplode("plan.turns").alias("turn", "t"))
    return x.select("trace_id", "plan_id", "turn", F.col("t.user").alias("asked"), F.posexplode("t.steps").alias("step", "s")).select("trace_id", "plan_id", "turn", "step", "asked", "s.kind")


def step_pools(facts: DataFrame, memory: DataFrame, now: str, sandbox: DataFrame | None = None, described: DataFrame | None = None) -> dict[str, Pool]:
    """What steps of each kind may use: of ``facts`` and ``memory`` (key, value) what leads with a
    quantity, of ``sandbox`` (question, tool, arguments, result) and ``described`` (name, text) any row, and calls
    that fail with what the tools say to them."""
    quantity = lambda df: Pool.of(df.where(leads_with_quantity(F.col("value"))).select("key", "value"), "key")
    failing = facts.sparkSession.createDataFrame([(i, *c) for i, c in enumerate(FAILING)], "call_id int, name string, arguments string")
    failing = run_calls(failing, memory, facts.select(F.col("key").alias("ord"), "key", "value"), now)
    pools = {"lookup_fact": quantity(facts), "lookup_memory": quantity(memory), "failing_call": Pool.of(failing, "call_id")}
    if sandbox is not None:
        pools["run_code"] = Pool.of(sandbox, "question", "arguments")
    if described is not None:
        pools["inspect_code"] = Pool.of(described, "name")
    return pools


def bound_steps(steps: DataFrame, pools: dict[str, Pool], now: str, seed: int) -> DataFrame:
    """``steps`` with all that they may use, drawn from the pool of their kind; a pool that is empty binds nothing."""
    u = lambda what: draw(seed, "trace_id", "turn", "step", F.lit(what))
    x = steps
    for kind, pool in pools.items():
        x = pool.drawn(x, kind, F.when(F.col("kind") == kind, u(kind)))
    none, kind = F.lit(None).cast("string"), F.col("kind")

    def at(path: str) -> Column:
        return F.col(path) if path.split(".")[0] in pools else none

    argument = lambda name, value: F.to_json(F.struct(value.alias(name)))
    key = F.coalesce(at("lookup_fact.key"), at("lookup_memory.key"), at("run_code.question"), at("inspect_code.name"))
    tool = F.when(kind == "lookup_fact", "web_search").when(kind == "lookup_memory", "search_memory").when(kind == "time", "now").when(kind == "inspect_code", "describe_symbol").otherwise(F.coalesce(at("run_code.tool"), at("failing_call.name")))
    arguments = F.when(kind == "lookup_fact", argument("query", key)).when(kind == "lookup_memory", argument("key", key)).when(kind == "time", "{}").when(kind == "inspect_code", argument("name", key)).otherwise(F.coalesce(at("run_code.arguments"), at("failing_call.arguments")))
    result = F.when(kind == "time", now).otherwise(F.coalesce(at("lookup_fact.value"), at("lookup_memory.value"), at("run_code.result"), at("inspect_code.text"), at("failing_call.result")))
    op = pick(["+", "-", "*"], u("op"))
    k = F.when(op == "*", F.pmod(u("k"), F.lit(8)) + 2).otherwise(F.pmod(u("k"), F.lit(40)) + 1).cast("int")
    reference = pick(["that", "that result", "it"], draw(seed, "trace_id", "turn", F.lit("reference")))
    return x.select("trace_id", "plan_id", "turn", "step", "asked", "kind", key.alias("key"), tool.alias("tool"), arguments.alias("arguments"), result.alias("result"), op.alias("op"), k.alias("k"), reference.alias("reference"))


_NUMBER = re.compile(NUMBER)


def first_value(text: str) -> float | None:
    m = _NUMBER.search(text)
    return float(m[0].replace(",", "")) if m else None


def shown_number(v: float) -> str:
    return str(int(v)) if v.is_integer() and abs(v) < 1e15 else f"{v:.10g}"


def mention(s: dict) -> str | None:
    """What the user's turn says of a step."""
    match s["kind"]:
        case "lookup_fact":
            return f"look up the {s['key']}"
        case "lookup_memory":
            return f"check the stored {s['key']}"
        case "time":
            return "note the current time"
        case "run_code":
            return s["key"].rstrip(".?").lower()
        case "inspect_code":
            return f"check what {s['key']} does"
        case "compute" | "combine":
            return f"{WORD[s['op']]} {s['k']}"
    return None


#: The situation and the words of the thought before a call of each kind.
THOUGHT = {"lookup_fact": ("web_call", "The {key} is needed."), "lookup_memory": ("memory_call", "The stored {key} should be checked."), "time": ("time_call", "The current time is needed."), "run_code": ("sandbox_call", "This can be run in the sandbox."), "inspect_code": ("repo_call", "The source of {key} will tell."), "failing_call": ("repo_call", "This may work.")}


class Fold:
    """A conversation so far: its messages, and the number that the next step can work on."""

    def __init__(self):
        self.messages: list[dict] = []
        self.value: float | None = None
        self.sound = True

    def say(self, role: str, **parts) -> None:
        self.messages.append(dict.fromkeys(("situation", "fallback", "tool", "arguments", "said")) | {"role": role} | parts)

    def call(self, situation: str, thought: str, tool: str, arguments: str, result: str) -> None:
        self.say("assistant", situation=situation, fallback=thought, tool=tool, arguments=arguments)
        self.say("tool", tool=tool, said=result)

    def takes(self, result: str) -> None:
        got = first_value(result)
        self.value = self.value if got is None else got

    def bind(self, steps: list[dict]) -> list[dict]:
        """The steps that can be done: those with something to use, and computing ones once there is a value."""
        out, ready = [], self.value is not None
        for s in steps:
            if s["kind"] in ("compute", "combine"):
                if ready:
                    out.append(s)
            elif s["result"] is not None:
                out.append(s)
                ready = ready or s["kind"] in ("lookup_fact", "lookup_memory")
        return out

    def turn(self, steps: list[dict]) -> None:
        bound = self.bind(steps)
        if not bound:
            return
        wish = ", then ".join(m for m in map(mention, bound) if m)
        if not wish:
            self.say("user", said=bound[0]["asked"])
        elif self.value is None or steps[0]["turn"] == 0:
            self.say("user", said=f"{wish.capitalize()}.")
        else:
            self.say("user", said=f"Now take {bound[0]['reference']} and {wish}.")
        for s in bound:
            self.step(s)
        if self.messages[-1]["role"] == "tool":
            self.say("assistant", situation="chain_last", fallback="This step is complete.", said=self.messages[-1]["said"])

    def step(self, s: dict) -> None:
        kind, result = s["kind"], s["result"]
        if kind in ("compute", "combine"):
            if self.value is None:
                return
            expr = f"{shown_number(self.value)} {s['op']} {s['k']}"
            result = calculate(expr)
            self.sound = self.sound and not result.startswith("ERROR")
            self.call("chain_first", f"Compute {expr}.", "calc", json.dumps({"expr": expr}, separators=(",", ":")), result)
            self.takes(result)
            return
        if kind == "inspect_code" and len(result) > SHOWN:
            result = result[:SHOWN] + "\n..."
        situation, words = THOUGHT[kind]
        self.call(situation, words.format(key=s["key"]), s["tool"], s["arguments"], result)
        if kind == "failing_call":
            self.say("assistant", situation="no_tool", fallback="The call gave no usable value, so it is left out.", said="That lookup failed, so I could not use it.")
        elif kind in ("lookup_fact", "lookup_memory", "run_code"):
            if kind != "run_code":
                self.sound = self.sound and not result.startswith("ERROR") and result not in ("not found", "no results found")
            self.takes(result)


def folded(steps: list[dict]) -> list[dict] | None:
    """The messages of a conversation's steps in order; null if nothing binds or a call fails that should not."""
    fold, turns = Fold(), {}
    for s in steps:
        turns.setdefault(s["turn"], []).append(s)
    for t in sorted(turns):
        fold.turn(turns[t])
    return fold.messages if fold.messages and fold.sound else None


def conversations(steps: DataFrame) -> DataFrame:
    """(trace_id, plan_id, messages) of bound steps: a fold a conversation, whose steps are few by the rule for plans."""
    fields = re.findall(r"(\w+):", STEP)
    x = steps.groupBy("trace_id", "plan_id").agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("steps"))
    kinds = T.StructType([*x.schema.fields[:2], T.StructField("messages", T._parse_datatype_string(f"array<{MESSAGE}>"))])
    text = pa.list_(pa.struct([(f, pa.string()) for f in re.findall(r"(\w+):", MESSAGE)]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = pa.array([folded(s) for s in b.column("steps").to_pylist()], text)
            yield pa.RecordBatch.from_arrays([b.column("trace_id"), b.column("plan_id"), got], names=["trace_id", "plan_id", "messages"])

    return x.mapInArrow(run, kinds)


class Scenarios:
    """Makes traces of given numbers from plans (plan_id, turns) and pools; see ``step_pools``."""

    def __init__(self, plans: DataFrame, facts: DataFrame, memory: DataFrame, now: str, seed: int = 42, sandbox: DataFrame | None = None, described: DataFrame | None = None, thoughts: DataFrame | None = None):
        self.plans, self.now, self.seed = Pool.of(plans, "plan_id"), now, seed
        self.pools = step_pools(facts, memory, now, sandbox, described)
        self.thoughts = None if thoughts is None else options(thoughts, "situation", "text")

    def traces(self, ids: DataFrame) -> DataFrame:
        """(trace_id, pattern, trace); the trace is null where nothing could be bound or a call failed."""
        steps = bound_steps(planned(ids, self.plans, self.seed), self.pools, self.now, self.seed)
        x = written(conversations(steps))
        rows = x.select("trace_id", F.posexplode("messages").alias("pos", "m")).select("trace_id", "pos", "m.*")
        text = serialised(with_thoughts(rows, self.thoughts, self.seed))
        return ids.join(text, "trace_id", "left").select("trace_id", F.lit("scenario").alias("pattern"), "trace")
