"""Unions with quotas, name bindings, and picks along a trace."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lathe.functions.numbers import number_list, number_text
from lathe.operators.relational import draw, ungrounded


def first_rows(df: DataFrame, n: int, *order: str) -> DataFrame:
    return df.orderBy(*order).limit(max(n, 0))


def quota_union(scenarios: DataFrame, generated: DataFrame, n: int, share: float, order: str) -> DataFrame:
    """Scenario rows up to int(n share), then generated ones up to n in all. A short first source
    leaves its places to the second. One plan: both are cut to what they may fill, and the second
    learns from a count beside it how much is left."""
    some = first_rows(scenarios, int(n * share), order)
    rest = first_rows(generated, n, order)  # as many as can be wanted
    place = F.row_number().over(Window.orderBy(order))  # n rows at most
    filled = some.agg(F.count("*").alias("__filled"))  # one row
    left = rest.withColumn("__place", place).join(F.broadcast(filled), F.lit(True)).where(F.col("__place") <= F.lit(n) - F.col("__filled")).drop("__place", "__filled")
    return some.unionByName(left)


def replay_mix(mixed: DataFrame, replayed: DataFrame, n: int, share: float, order: str) -> DataFrame:
    """n - int(n share) mixed rows and int(n share) replayed ones, marked by ``replay``."""
    k = int(n * share)
    part = lambda df, m, flag: first_rows(df, m, order).withColumn("replay", F.lit(flag))
    return part(mixed, n - k, False).unionByName(part(replayed, k, True))


def with_cases(base: DataFrame, more: DataFrame, wanted: bool) -> DataFrame:
    """The base cases, and the optional ones if they are wanted."""
    return base.unionByName(more.where(F.lit(wanted)))


def bind_surfaces(schema: DataFrame, names: DataFrame, always: str = "finish") -> DataFrame:
    """(surface, canonical) of a schema's tools that have a canonical name; distractors fall away,
    ``always`` stays."""
    bound = schema.join(names.select("surface", "canonical"), "surface").select("surface", "canonical").where(F.col("surface") != always)
    return bound.unionByName(schema.sparkSession.createDataFrame([(always, always)], "surface string, canonical string"))


def renamed(tools: DataFrame, mapping: DataFrame, name: str = "name") -> DataFrame:
    """New names where ``mapping`` (old, new) has one, the old ones elsewhere."""
    x = tools.join(mapping.select(F.col("old").alias("__old"), F.col("new").alias("__new")), F.col(name) == F.col("__old"), "left")
    return x.withColumn(name, F.coalesce("__new", name)).drop("__old", "__new")


def deep_traces(traces: DataFrame, key: str, calls: Column, least: int, n: int) -> DataFrame:
    """The first ``n`` traces by key that have ``least`` calls or more."""
    return first_rows(traces.where(calls >= least), n, key)


def first_open_call(blocks: DataFrame, key: str, pos: str, call: str, offset: int | Column) -> DataFrame:
    """(key, pos, call): the first tool call at or after the offset; other blocks are skipped."""
    x = blocks.where((F.col(pos) >= offset) & F.col(call).isNotNull())
    return x.groupBy(key).agg(F.min(F.struct(F.col(pos).alias("pos"), F.col(call).alias("call"))).alias("f")).select(key, "f.pos", "f.call")


def pairs_without_replacement(df: DataFrame, group: str, value: str, seed: int) -> DataFrame:
    """Two distinct values a group, by rank of a draw; groups of fewer than two are left out."""
    x = df.select(group, value).distinct().withColumn("__r", F.row_number().over(Window.partitionBy(group).orderBy(draw(seed, group, value), value)))
    x = x.where("__r <= 2").groupBy(group).agg(F.max(F.when(F.col("__r") == 1, F.col(value))).alias("a"), F.max(F.when(F.col("__r") == 2, F.col(value))).alias("b"))
    return x.where("b IS NOT NULL")


def merged(old: Column, new: Column) -> Column:
    """A map of both; the later one's values win, new keys come last."""
    return F.map_concat(F.map_filter(old, lambda k, _: ~F.map_contains_key(new, k)), new)


#: Fixed value: the events of a trace that grounding walks through, in document order.
EVENT = r'(?s)<user>.*?</user>|<tool name=\w+>.*?</tool>|"tool_call":\{"name":"\w+","arguments":\{.*?\}\}\}</assistant>'


def grounding(traces: DataFrame, key: str, text: str, dataflow: Sequence[str] = ("calc",)) -> DataFrame:
    """(key, ok, problems): numbers in the arguments of data-flow calls that stand in no user's
    turn or tool result before. A trace without calls is grounded. ``key`` tells traces apart."""
    e, is_call = F.col("event"), F.col("event").startswith('"')
    x = traces.select(key, F.posexplode(F.regexp_extract_all(text, F.lit(EVENT), F.lit(0))).alias("pos", "event"))
    said = F.when(is_call, F.regexp_extract(e, r'(?s)"arguments":(\{.*\})\}\}</assistant>$', 1)).otherwise(F.regexp_extract(e, r"(?s)^<[^>]*>(.*)</\w+>$", 1))
    x = x.select(key, "pos", F.when(is_call, F.regexp_extract(e, r'^"tool_call":\{"name":"(\w+)"', 1)).alias("name"), said.alias("said"))
    flows = F.col("name").isin(*dataflow)
    hop = F.count("name").over(Window.partitionBy(key).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0))
    x = x.withColumn("hop", hop).where(F.col("name").isNull() | flows)
    x = x.withColumn("args", F.when(flows, F.map_values(F.from_json("said", "map<string,string>"))).otherwise(F.array("said")))
    x = x.select(key, "pos", "hop", "name", F.flatten(F.transform("args", number_list)).alias("numbers"), F.col("args").isNull().alias("bad"))
    # a call whose arguments cannot be read is a use that nothing grounds: no number, so it meets no cell
    bad = F.array(F.struct(F.lit(0).alias("i"), F.lit(float("nan")).alias("value")))
    given = F.transform("numbers", lambda n, i: F.struct(i.alias("i"), n.alias("value")))
    x = x.select(F.col(key).alias("trace_id"), "pos", "hop", "name", F.col("name").isNotNull().alias("is_use"), F.inline(F.when(F.col("bad"), bad).otherwise(given)))
    loose = ungrounded(x, "i", "hop", "name")
    says = F.when(F.isnan("value"), F.format_string("hop %d: unparseable arguments", "hop")).otherwise(F.concat(F.format_string("hop %d (%s): value ", "hop", "name"), number_text("value"), F.lit(" not grounded in prior context")))
    found = loose.groupBy(F.col("trace_id").alias("__trace")).agg(F.array_sort(F.collect_list(F.struct("pos", "i", says.alias("what")))).alias("p"))
    problems = F.coalesce(F.transform("p", lambda z: z["what"]), F.array().cast("array<string>"))
    return traces.select(key).join(found, F.col(key).eqNullSafe(F.col("__trace")), "left").select(key, F.col("p").isNull().alias("ok"), problems.alias("problems"))


def categorical_draw(probs: DataFrame, row: str, token: str, p: str, seed: int, greedy: bool = False) -> DataFrame:
    """(row, token): the token at a uniform draw's place among the cumulated probabilities, or the likeliest one, ties by token."""
    if greedy:
        return probs.groupBy(row).agg(F.min_by(token, F.struct(-F.col(p), F.col(token))).alias(token))
    w = Window.partitionBy(row).orderBy(token).rowsBetween(Window.unboundedPreceding, 0)
    x = probs.withColumn("__c", F.sum(p).over(w)).withColumn("__u", draw(seed, row) / F.lit(4294967296.0) * F.sum(p).over(Window.partitionBy(row)))
    return x.where(F.col("__c") > F.col("__u")).groupBy(row).agg(F.min(token).alias(token))


def collate(samples: DataFrame, order: str, size: int, tokens: str = "x", targets: str = "y", mask: str = "mask") -> DataFrame:
    """Batches of ``size`` samples in order (dense numbers from 0 in ``order``), padded to the longest: tokens and mask by 0, targets by -100."""
    from lathe.functions.protocol import pad

    x = samples.withColumn("batch_id", F.floor(F.col(order) / size))
    length = F.max(F.size(tokens)).over(Window.partitionBy("batch_id"))
    x = x.withColumn("__l", length)
    return x.withColumn(tokens, pad(F.col(tokens), F.col("__l"), 0)).withColumn(targets, pad(F.col(targets), F.col("__l"), -100)).withColumn(mask, pad(F.col(mask), F.col("__l"), 0.0)).drop("__l")


def sampled_schema(traces: DataFrame, used: str, key: str, pools: dict[str, list[str]], seed: int, share: float = 0.6, most: int = 4) -> DataFrame:
    """``traces`` with ``mapping``, canonical to surface names: of the tools in use (an array) and, in a
    ``share`` of the traces, of 1 to ``most`` distractors; and ``shown``, the surfaces in shuffled order."""
    u = lambda *what: draw(seed, key, *[F.lit(w) for w in what])
    names = list(pools)
    rest = F.array_except(F.array(*[F.lit(n) for n in names]), F.col(used))
    ranks = F.create_map(*[c for n in names for c in (F.lit(n), u("rank", n))])
    shuffled = F.transform(F.array_sort(F.transform(rest, lambda n: F.struct(ranks[n].alias("r"), n.alias("n")))), lambda s: s["n"])
    k = F.when(u("any") / 4294967296.0 < share, F.pmod(u("many"), F.lit(most)) + 1).otherwise(0).cast("int")
    chosen = F.concat(F.filter(F.col(used), lambda n: n.isin(*names)), F.slice(shuffled, F.lit(1), F.greatest(k, F.lit(0))))
    surface = F.create_map(*[c for n in names for c in (F.lit(n), F.element_at(F.array(*[F.lit(s) for s in pools[n]]), (F.pmod(u("name", n), F.lit(len(pools[n]))) + 1).cast("int")))])
    order = F.create_map(*[c for n in names for c in (F.lit(n), u("place", n))])
    x = traces.withColumn("mapping", F.map_from_arrays(chosen, F.transform(chosen, lambda n: surface[n])))
    shown = F.transform(F.array_sort(F.transform(F.map_entries("mapping"), lambda e: F.struct(order[e["key"]].alias("r"), e["value"].alias("s")))), lambda s: s["s"])
    return x.withColumn("shown", shown)
