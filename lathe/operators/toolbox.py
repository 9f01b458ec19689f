"""Tool calls carried out as joins: names put right, arguments checked, answers looked up or computed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lathe.functions.numbers import calc, strip
from lathe.operators.matching import closest_name
from lathe.operators.relational import cascading_lookup
from lathe.sources.scratch import written

#: The tools that are always there, and the parameters each of them needs.
TOOLS = (("calc", ["expr"]), ("now", []), ("search_memory", ["key"]), ("web_search", ["query"]), ("finish", []))
#: What a lookup says that finds nothing.
NOT_FOUND, NO_RESULTS = "not found", "no results found"


def check_call(name: Column, arguments: Column, required: Column) -> Column:
    """Null for a call that can run, else its error text. ``arguments`` is JSON text, ``required`` the
    parameters of a known tool and null for an unknown one."""
    is_object = F.coalesce(F.schema_of_variant(F.try_parse_json(arguments)).startswith("OBJECT"), F.lit(False))
    missing = F.array_except(required, F.coalesce(F.json_object_keys(arguments), F.array().cast("array<string>")))
    says = F.concat(F.lit("ERROR: missing required parameters ['"), F.array_join(missing, "', '"), F.lit("']"))
    return F.when(required.isNull(), F.concat(F.lit("ERROR: unknown tool '"), name, F.lit("'"))).when(~is_object, "ERROR: tool args must be a JSON object").when(F.size(missing) > 0, says)


def run_calls(calls: DataFrame, memory: DataFrame, facts: DataFrame, now: str, recorded: DataFrame | None = None, id: str = "call_id") -> DataFrame:
    """(id, name, arguments, result) of calls (id, name, arguments as JSON text).

    Names that are nearly right are put right (0.82), keys of ``memory`` (key, value) likewise (0.78), and
    ``facts`` (ord, key, value) are searched in steps. Other tools are known by what was ``recorded``
    of them (name, arguments, result), and answer the calls that they have answered before."""
    spark = calls.sparkSession
    tools = spark.createDataFrame([(n, list(p)) for n, p in TOOLS], "known string, required array<string>")
    if recorded is not None:
        tools = tools.unionByName(recorded.select(F.col("name").alias("known")).distinct().select("known", F.array().cast("array<string>").alias("required")))
    x = closest_name(calls.select(id, "name", "arguments"), "name", tools.select(F.col("known").alias("name")))
    x = written(x.join(tools, F.col("name") == F.col("known"), "left").withColumn("error", check_call(F.col("name"), F.col("arguments"), F.col("required"))))
    given = lambda path: F.when(F.col("error").isNull(), F.get_json_object("arguments", path))
    own = lambda tool, path: F.when(F.col("name") == tool, given(path))
    x = x.withColumn("expr", own("calc", "$.expr")).withColumn("asked", own("search_memory", "$.key")).withColumn("sought", own("web_search", "$.query"))
    keys = x.where("asked IS NOT NULL").select(F.col("asked").alias("__asked")).distinct().withColumn("stored", strip(F.col("__asked")))
    kept = memory.select(F.col("key").alias("stored"), F.col("value").alias("remembered"))
    keys = closest_name(keys, "stored", memory, 0.78, "key").join(kept, "stored", "left").select("__asked", F.coalesce("remembered", F.lit(NOT_FOUND)).alias("remembered"))
    found = cascading_lookup(x.where("sought IS NOT NULL").select(F.col("sought").alias("__sought")).distinct(), facts, "__sought", default=NO_RESULTS).select("__sought", F.col("answer").alias("read"))
    x = x.join(keys, F.col("asked") == F.col("__asked"), "left").join(found, F.col("sought") == F.col("__sought"), "left")
    if recorded is not None:
        seen = recorded.groupBy(F.col("name").alias("__tool"), F.col("arguments").alias("__args")).agg(F.min("result").alias("seen"))
        x = x.join(seen, (F.col("name") == F.col("__tool")) & (F.col("arguments") == F.col("__args")), "left")
    else:
        x = x.withColumn("seen", F.lit(None).cast("string"))
    fixed = F.when(F.col("name") == "now", now).when(F.col("name") == "finish", "done")
    result = F.coalesce("error", "seen", fixed, calc("expr"), "remembered", "read", F.lit("ERROR: this call was never recorded"))
    return x.select(id, "name", "arguments", result.alias("result"))
