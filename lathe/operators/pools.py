"""Pools from teacher output: salvage JSON, filter, normalise, deduplicate, validate plans."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lathe.functions.numbers import strip

#: The step kinds that a plan may use.
KINDS = ("lookup_fact", "lookup_memory", "compute", "combine", "time", "run_code", "inspect_code", "failing_call")


def first_array(text: str) -> list | None:
    """What the JSON reader takes from the first opening bracket on: the array there, whatever follows it; else None."""
    _, bracket, rest = text.partition("[")
    try:
        return json.JSONDecoder().raw_decode(bracket + rest)[0] if bracket else None
    except (ValueError, RecursionError):
        return None


@F.pandas_udf(T.ArrayType(T.StringType()))
def array_items(texts: pd.Series) -> pd.Series:
    """Items of the first array in each text, as text; an empty or missing array is null."""

    def items(t):
        got = first_array(t) if t is not None else None
        return [x if isinstance(x, str) else json.dumps(x) for x in got] if got else None

    return texts.map(items)


def salvage(text: Column) -> Column:
    """Array items, else the key and value objects (as compact JSON), else one quoted line each;
    code fences are dropped first."""
    bare = strip(F.regexp_replace(text, "```(?:json)?", ""))
    # The two patterns of what is picked out of broken output
    pattern = r'\{\s*"key"\s*:\s*"([^"]{2,60})"\s*,\s*"value"\s*:\s*"([^"]{1,60})"\s*\}'
    found = F.arrays_zip(F.regexp_extract_all(bare, F.lit(pattern), F.lit(1)).alias("key"), F.regexp_extract_all(bare, F.lit(pattern), F.lit(2)).alias("value"))
    pairs = F.transform(found, lambda z: F.concat(F.lit('{"key":"'), z["key"], F.lit('","value":"'), z["value"], F.lit('"}')))
    quoted = F.regexp_extract_all(bare, F.lit(r'(?m)^\s*"([^"]{4,200})"\s*,?\s*$'), F.lit(1))
    return F.coalesce(array_items(bare), F.when(F.size(pairs) > 0, pairs), quoted)


def usable_thought(s: Column) -> Column:
    return (F.length(s) > 4) & (F.length(s) < 200)


def usable_paraphrase(s: Column) -> Column:
    return F.length(s) < 200


def facts(df: DataFrame, key: str = "key", value: str = "value") -> DataFrame:
    """Keys trimmed and lower-cased, values trimmed; keys of 3 to 59 and values of 1 to 59 characters."""
    x = df.withColumn(key, F.lower(strip(F.col(key)))).withColumn(value, strip(F.col(value)))
    return x.where(F.length(key).between(3, 59) & F.length(value).between(1, 59))


def usable_facts(df: DataFrame, key: str = "key", value: str = "value") -> DataFrame:
    """Facts that a generator may use: nothing empty, keys below 60 characters."""
    return df.where((F.col(key) != "") & (F.col(value) != "") & (F.length(key) < 60))


def last_writer(df: DataFrame, key: str, value: str, order: list[str]) -> DataFrame:
    return df.groupBy(key).agg(F.max_by(value, F.struct(*order)).alias(value))


def axes_report(old: DataFrame, new: DataFrame, merged: DataFrame, axis: str) -> DataFrame:
    count = lambda df, name: df.groupBy(axis).agg(F.count("*").alias(name))
    x = count(old, "old").join(count(new, "new"), axis, "full_outer").join(count(merged, "merged"), axis, "full_outer")
    return x.na.fill(0, ["old", "new", "merged"])


def sandbox_success(output: Column) -> Column:
    return ~output.startswith("ERROR") & ~F.element_at(F.split(output, "\n"), 1).contains("exit code") & (strip(output) != "")


def is_error(result: Column) -> Column:
    return result.startswith("ERROR") | (result == "no results found")


def inside(path: Column, root: str) -> Column:
    """The path, taken from ``root`` if it is relative, stays there once ``.`` and ``..`` are resolved."""
    whole = F.when(path.startswith("/"), path).otherwise(F.concat(F.lit(root.rstrip("/") + "/"), path))
    parts = F.filter(F.split(whole, "/"), lambda p: ~p.isin("", "."))
    empty = F.array().cast("array<string>")
    real = F.aggregate(parts, empty, lambda a, p: F.when(p == "..", F.slice(a, F.lit(1), F.greatest(F.size(a) - 1, F.lit(0)))).otherwise(F.concat(a, F.array(p))))
    base = [p for p in root.split("/") if p]
    return F.slice(real, 1, max(len(base), 1)) == F.array(*[F.lit(p) for p in base]) if base else F.lit(True)


def valid_plan(turns: Column, kinds: tuple[str, ...] = KINDS) -> Column:
    """1 to 6 turns; users of 4 to 399 characters; 1 to 40 steps of known kinds."""
    ok = lambda t: F.length(t["user"]).between(4, 399) & F.size(t["steps"]).between(1, 40) & F.forall(t["steps"], lambda s: s["kind"].isin(*kinds))
    return F.size(turns).between(1, 6) & F.forall(turns, ok)


def normalised_plan(turns: Column) -> Column:
    """A turn that ends with a failing call gets a computing step after it."""
    more = F.array(F.struct(F.lit("compute").alias("kind")))
    return F.transform(turns, lambda t: F.struct(t["user"].alias("user"), F.when(F.element_at(t["steps"], -1)["kind"] == "failing_call", F.concat(t["steps"], more)).otherwise(t["steps"]).alias("steps")))
