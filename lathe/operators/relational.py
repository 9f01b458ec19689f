"""Joins, aggregates, windows, sampling and set operators over message, result and score tables.

Every output depends on keys, explicit orders and seeds, never on partitioning.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lathe.functions.numbers import close_to, strip
from lathe.operators.matching import closest, first_contained
from lathe.operators.ordering import ranked


def draw(seed: int, *parts: Column | str) -> Column:
    """A counter-based uniform draw in [0, 2^32) that SQL engines agree on."""
    cols = [F.col(p) if isinstance(p, str) else p for p in parts]
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), *[c.cast("string") for c in cols])), 1, 8), 16, 10).cast("bigint")


def exact_split(df: DataFrame, key: str, share: float = 0.05, seed: int = 42) -> DataFrame:
    """Exactly max(1, floor(n * share)) rows are validation rows, whatever the partitioning.

    Only draws near the boundary are ranked: the rank comes from counts of draw prefixes, so no
    task sorts the whole table.
    """
    d = df.withColumn("__u", draw(seed, key)).withColumn("__b", F.shiftright("__u", 20))
    counts = d.groupBy("__b").agg(F.count("*").alias("__n"))  # 4096 rows at most
    before = counts.select("__b", (F.sum("__n").over(Window.orderBy("__b")) - F.col("__n")).alias("__before"), F.sum("__n").over(Window.partitionBy()).alias("__all"))
    rank = F.row_number().over(Window.partitionBy("__b").orderBy("__u", key)) + F.col("__before")
    val = (rank <= F.greatest(F.lit(1), F.floor(F.col("__all") * F.lit(share)))).cast("int")
    return d.join(before, "__b").withColumn("is_val", val).drop("__u", "__b", "__before", "__all")


def accuracy(df: DataFrame, kind: str, ok: str) -> DataFrame:
    """Totals, hits and accuracy by kind and overall (kind null), in one pass."""
    return df.groupingSets([[F.col(kind)], []], F.col(kind)).agg(F.count("*").alias("total"), F.sum(ok).cast("bigint").alias("correct"), F.avg(ok).alias("acc"))


def bucket_accuracy(df: DataFrame, bucket: Column, ok: str, top: int = 4) -> DataFrame:
    return df.groupBy(F.least(bucket, F.lit(top)).cast("bigint").alias("bucket")).agg(F.sum(ok).cast("bigint").alias("ok"), F.count("*").alias("total"))


def index_percentiles(df: DataFrame, group: str, value: str, points: dict[str, float]) -> DataFrame:
    """The element at index floor(n p) of each group's sorted values. Equal values are counted first,
    so a group's task holds its distinct values and not its rows."""
    x = df.where(F.col(value).isNotNull()).groupBy(group, value).agg(F.count("*").alias("__c"))
    w = Window.partitionBy(group)
    x = x.withColumn("__to", F.sum("__c").over(w.orderBy(value))).withColumn("__n", F.sum("__c").over(w))
    at = lambda p: F.floor(F.col("__n") * p).between(F.col("__to") - F.col("__c"), F.col("__to") - 1)
    return x.groupBy(group).agg(*[F.max(F.when(at(p), F.col(value))).alias(k) for k, p in points.items()])


def starvation(df: DataFrame, group: str, kept: Column, limit: float = 0.2) -> DataFrame:
    """Groups of which more than ``limit`` is dropped."""
    k, d = F.count_if(kept), F.count_if(~kept)
    return df.groupBy(group).agg(k.alias("kept"), d.alias("dropped")).where(F.col("dropped") > limit * (F.col("kept") + F.col("dropped")))


def running_extremes(df: DataFrame, group: str, order: Sequence[str], value: str) -> DataFrame:
    w = Window.partitionBy(group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("best", F.max(value).over(w)).withColumn("low", F.min(value).over(w))


def patience_stop(df: DataFrame, group: str, order: Sequence[str], value: str, patience: int) -> DataFrame:
    """The first step at which ``patience`` steps have passed since the last new best."""
    w = Window.partitionBy(group).orderBy(*order)
    x = df.select(group, *order, value, F.row_number().over(w).alias("step"), F.max(value).over(w.rowsBetween(Window.unboundedPreceding, -1)).alias("before"))
    new = F.when(F.col("before").isNull() | (F.col(value) > F.col("before")), F.col("step"))
    x = x.withColumn("since", F.col("step") - F.max(new).over(Window.partitionBy(group).orderBy("step").rowsBetween(Window.unboundedPreceding, 0)))
    return x.where(F.col("since") >= patience).groupBy(group).agg(F.min("step").cast("bigint").alias("stop_step"))


def lookup(df: DataFrame, table: DataFrame, key: str, value: str, default) -> DataFrame:
    """Left lookup with a default. Whether a side is broadcast is left to Spark and its sizes."""
    return df.join(table.select(key, value), key, "left").withColumn(value, F.coalesce(value, F.lit(default)))


def cascading_lookup(queries: DataFrame, facts: DataFrame, query: str = "query", cutoff: float = 0.78, default: str = "no results found") -> DataFrame:
    """Exact, then contained either way in the facts' order, then similar (ties by the greater key), then the default.

    Only distinct queries that a step leaves open go on to the next: automata of bounded blocks of
    ``facts`` (ord, key, value) look for containment, an index of letter pairs for similar keys.
    """
    q = queries.withColumn("__q", F.regexp_replace(F.lower(strip(F.col(query))), r"\?+$", ""))
    exact = q.join(facts.select(F.col("key").alias("__q"), F.col("value").alias("answer")), "__q", "left")
    still = exact.where("answer IS NULL").select("__q").distinct()
    part = first_contained(still, "__q", facts).select("__q", F.col("value").alias("part"))
    near = closest(still.join(part, "__q", "left_anti"), facts, cutoff, "__q")
    like = near.join(facts.select("key", "value"), "key").groupBy("__q").agg(F.min("value").alias("like"))
    x = exact.join(part, "__q", "left").join(like, "__q", "left")
    return x.withColumn("answer", F.coalesce("answer", "part", "like", F.lit(default))).drop("__q", "part", "like")


def merge_pools(old: DataFrame, new: DataFrame, key: str = "key", value: str = "value") -> DataFrame:
    """Full outer merge in which old values win."""
    return old.select(key, F.col(value).alias("__o")).join(new.select(key, F.col(value).alias("__n")), key, "full_outer").select(key, F.coalesce("__o", "__n").alias(value))


def merge_lists(old: DataFrame, new: DataFrame, key: str = "key", values: str = "values") -> DataFrame:
    both = old.select(key, F.col(values).alias("__o")).join(new.select(key, F.col(values).alias("__n")), key, "full_outer")
    empty = F.array().cast("array<string>")
    return both.select(key, F.array_sort(F.array_union(F.coalesce("__o", empty), F.coalesce("__n", empty))).alias(values))


def value_cell(v: Column) -> Column:
    """Numbers of cells such that values which ``close_to`` takes for equal are at most one cell apart: of
    equal ratio, but of equal width where the floor under the scale holds. Each is a tenth wider than the tolerance."""
    size, floor = F.abs(v), 1e-12
    place = F.when(size <= floor, size / floor).otherwise(1 + F.ln(size) - math.log(floor))
    return F.floor(F.signum(v) * F.least(place, F.lit(1000.0)) / F.lit(1.1e-6))


def ungrounded(numbers: DataFrame, *more: str) -> DataFrame:
    """Uses of a number without an equal earlier one: ``numbers`` (trace_id, pos, value, is_use); ``more``
    columns of the uses come along.

    A use meets the values seen in its own cell and the two beside it, each value once with its first
    place. So work grows with a trace's numbers, not with their square, and a long trace is dealt
    out by cell."""
    cell = value_cell(F.col("value"))
    seen = F.array(cell - 1, cell, cell + 1)
    x = numbers.where("value IS NOT NULL").withColumn("__c", F.explode(F.when(F.col("is_use"), F.array(cell)).otherwise(seen)))
    place = F.when(F.col("is_use"), F.col("pos")).alias("pos")
    own = [F.when(F.col("is_use"), F.col(c)).alias(c) for c in more]
    x = x.select("trace_id", "__c", "value", "is_use", place, *own, F.when(~F.col("is_use"), F.col("pos")).alias("__at")).repartition("trace_id", "__c")
    # uses stay rows of their own, what was seen is one row a value
    x = x.groupBy("trace_id", "__c", "value", "is_use", "pos", *more).agg(F.min("__at").alias("__at"), F.count("*").alias("__n"))
    known = F.collect_list(F.when(~F.col("is_use"), F.struct("value", F.col("__at").alias("first")))).over(Window.partitionBy("trace_id", "__c"))
    x = x.withColumn("__known", known).where("is_use")
    grounds = F.exists("__known", lambda k: (k["first"] < F.col("pos")) & ((k["value"] == F.col("value")) | close_to(k["value"], F.col("value"))))
    loose = x.where(F.isnan("value") | ~grounds)  # Spark takes NaN for equal to NaN
    return loose.select("trace_id", "pos", "value", *more, F.explode(F.sequence(F.lit(1).cast("long"), F.col("__n"))).alias("__copy")).drop("__copy")


def first_divergence(expected: DataFrame, got: DataFrame) -> DataFrame:
    """The first position at which two call lists (trace_id, pos, name, arguments) differ."""
    x = expected.select("trace_id", "pos", F.struct("name", "arguments").alias("e")).join(got.select("trace_id", "pos", F.struct("name", "arguments").alias("g")), ["trace_id", "pos"], "full_outer")
    kind = F.when(F.col("g").isNull(), "stopped early").when(F.col("e").isNull(), "kept going").when(F.col("e.name") != F.col("g.name"), "wrong tool").when(F.col("e.arguments") != F.col("g.arguments"), "wrong args")
    return x.withColumn("kind", kind).groupBy("trace_id").agg(F.coalesce(F.min_by("kind", F.when(F.col("kind").isNotNull(), F.col("pos"))), F.lit("matched")).alias("kind"), F.min(F.when(F.col("kind").isNotNull(), F.col("pos"))).alias("pos"))


def weighted_choice(df: DataFrame, weights: dict[str, int], key: str, seed: int, name: str = "pattern") -> DataFrame:
    """A pattern by cumulative weights from a draw on the key."""
    at, total, expr = 0, sum(weights.values()), None
    u = F.pmod(draw(seed, key), F.lit(total))
    for k, w in weights.items():
        at += w
        expr = F.when(u < at, k) if expr is None else expr.when(u < at, k)
    return df.withColumn(name, expr)


def capped_take(df: DataFrame, group: str, order: str, limit: int) -> DataFrame:
    return df.withColumn("__r", F.row_number().over(Window.partitionBy(group).orderBy(order))).where(F.col("__r") <= limit).drop("__r")


def ranked_results(results: DataFrame, family: str = "experiment") -> DataFrame:
    """RANK() of each result within its family by its primary metric: accuracy (high is good),
    else a loss (low is good); the family's first row decides the direction."""
    metrics = ("accuracy", "best_val_loss", "best_loss", "final_loss")
    name = F.coalesce(*[F.when(F.col(m).isNotNull(), m) for m in metrics], F.lit("no metric"))
    x = results.withColumn("metric", F.coalesce(*metrics, F.lit(0.0))).withColumn("metric_name", name)
    up = x.groupBy(F.col(family).alias("__family")).agg(F.min_by(F.col("metric_name").isin("accuracy", "no metric"), "file_name").alias("__up"))
    x = x.join(up, F.col(family).eqNullSafe(F.col("__family"))).withColumn("__score", F.when(F.col("__up"), -F.col("metric")).otherwise(F.col("metric")))
    return ranked(x, family, "__score").drop("__family", "__up", "__score")


def numbered_lines(df: DataFrame, key: str, text: str = "text") -> DataFrame:
    return df.select(key, F.posexplode(F.split(text, "\n")).alias("line_no", "line")).withColumn("line_no", (F.col("line_no") + 1).cast("bigint"))


def grep(df: DataFrame, key: str, pattern: str, limit: int = 20, width: int = 110) -> DataFrame:
    """The first hits in key and line order; TakeOrdered keeps only ``limit`` rows a task."""
    x = numbered_lines(df, key).where(F.lower("line").contains(pattern.lower()))
    return x.orderBy(key, "line_no").limit(limit).select(key, "line_no", F.substring(F.trim("line"), 1, width).alias("line"))


def compact_history(blocks: DataFrame, keep: int = 6, width: int = 60) -> DataFrame:
    """Tool blocks (trace_id, pos, content) before the last ``keep`` shrink to their first line and
    a mark; the assistant's blocks stay, and nothing grows."""
    tool = F.col("content").startswith("<tool ")
    rank = F.row_number().over(Window.partitionBy("trace_id", tool).orderBy(F.desc("pos")))
    body = strip(F.regexp_extract("content", r"(?s)^[^>]*>(.*)</tool>", 1))
    line = F.substring_index(body, "\n", 1)
    first = F.when(F.length(line) > width, F.concat(F.substring(line, 1, width), F.lit("..."))).otherwise(line)
    short = F.concat(F.lit("<tool name="), F.regexp_extract("content", "name=([^>]*)>", 1), F.lit(">"), first, F.lit(" [elided]</tool>"))
    old = tool & (F.col("__r") > keep) & (F.length(short) < F.length("content"))
    return blocks.withColumn("__r", rank).withColumn("content", F.when(old, short).otherwise(F.col("content"))).drop("__r")
