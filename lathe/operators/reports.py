"""Reports over traces, results and series: rates, histograms, summaries, leaderboard lines."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lathe.functions.protocol import contract_ok

#: Fixed value: the bands of the hop histogram, by their first number of hops.
BANDS = (0, 2, 4, 8, 16, 32)


def validity(blocks: DataFrame, key: str, body: str) -> DataFrame:
    """One row: assistant blocks, those that keep the contract and their share; traces, those
    that call a tool in a valid block and their share."""
    ok = contract_ok(F.col(body))
    call = ok & F.get_json_object(body, "$.tool_call").isNotNull()
    x = blocks.groupBy(key).agg(F.count("*").alias("b"), F.count_if(ok).alias("v"), F.bool_or(call).alias("c"))
    x = x.agg(F.coalesce(F.sum("b"), F.lit(0)).alias("blocks"), F.coalesce(F.sum("v"), F.lit(0)).alias("valid"), F.count("*").alias("traces"), F.count_if("c").alias("with_call"))
    share = lambda a, b: F.col(a) / F.greatest(F.col(b), F.lit(1))
    return x.withColumn("valid_share", share("valid", "blocks")).withColumn("call_share", share("with_call", "traces"))


def hop_bands(df: DataFrame, hops: Column, bands: Sequence[int] = BANDS) -> DataFrame:
    """(band, n, share): bands named 0-1, 2-3, ... 32+; bands without rows do not occur."""
    names = [f"{a}-{b - 1}" for a, b in zip(bands, bands[1:], strict=False)] + [f"{bands[-1]}+"]
    band = F.lit(names[0])
    for first, name in zip(bands[1:], names[1:], strict=True):
        band = F.when(hops >= first, name).otherwise(band)
    x = df.groupBy(band.alias("band")).agg(F.count("*").alias("n"))  # one row a band
    return x.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy()))


def most_common(df: DataFrame, value: str, order: str) -> DataFrame:
    """(value, n, first): counts, the most frequent first, ties by what was seen first."""
    return df.groupBy(value).agg(F.count("*").alias("n"), F.min(order).alias("first")).orderBy(F.desc("n"), "first")


def distinct_sorted(df: DataFrame, group: str, value: str) -> DataFrame:
    return df.groupBy(group).agg(F.array_sort(F.collect_set(value)).alias("values"))


def series_summary(df: DataFrame, group: str, order: Sequence[str], value: str, last: int = 50) -> DataFrame:
    """(group, final, least, recent): the last value, the least one, and the sum of the last
    ``last`` values over ``last``, also where a series is shorter."""
    rank = F.row_number().over(Window.partitionBy(group).orderBy(*[F.desc(c) for c in order]))
    x = df.withColumn("__r", rank)
    return x.groupBy(group).agg(F.max(F.when(F.col("__r") == 1, F.col(value))).alias("final"), F.min(value).alias("least"), (F.sum(F.when(F.col("__r") <= last, F.col(value))) / last).alias("recent"))


def running_best(df: DataFrame, group: str, order: Sequence[str], step: str, value: str) -> DataFrame:
    """``df`` with the best value so far and the step at which it was first reached."""
    w = Window.partitionBy(group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    best = F.max(F.struct(F.col(value).alias("v"), (-F.col(step)).alias("s"))).over(w)
    return df.withColumn("__b", best).withColumn("best", F.col("__b.v")).withColumn("best_step", -F.col("__b.s")).drop("__b")


def active(df: DataFrame, *ids: str) -> DataFrame:
    """Distinct selected ids, sorted, from one or more columns."""
    return df.select(F.explode(F.array(*ids)).alias("id")).where("id IS NOT NULL").distinct().orderBy("id")


def mean_hops(reference: DataFrame, model: DataFrame, hops: str) -> DataFrame:
    one = lambda df, name: df.agg(F.avg(hops).alias(name))
    return one(reference, "reference").join(one(model, "model"), F.lit(True))


def parameter_count(tensors: DataFrame, shape: str = "shape") -> DataFrame:
    return tensors.agg(F.coalesce(F.sum(F.aggregate(shape, F.lit(1).cast("bigint"), lambda a, n: a * n)), F.lit(0)).cast("bigint").alias("parameters"))


#: Heading and columns of the leaderboard.
HEADING = ("# Experiment Leaderboard", "", "| Timestamp (UTC) | Experiment | Rank | Primary Metric | Parameters | Configuration | Losses | Evaluation | Runtime | Checkpoint | Result File |", "| --- | --- | ---: | --- | ---: | --- | --- | --- | ---: | --- | --- |")
NO_ROWS = "| - | - | - | No recorded results | - | - | - | - | - | - | - |"


def cell(parts: Sequence[Column]) -> Column:
    """Parts that are there, joined by a comma; a dash if there are none."""
    text = F.concat_ws(", ", *parts)
    return F.when(text == "", "-").otherwise(text)


def number(label: str, value: Column, pattern: str) -> Column:
    return F.when(value.isNotNull(), F.format_string(f"{label}{pattern}", value.cast("double")))


def leaderboard_lines(ranked: DataFrame) -> DataFrame:
    """(timestamp, file_name, line) of ranked results (see ``relational.ranked_results``)."""
    have = set(ranked.columns)
    col = lambda c: F.col(c) if c in have else F.lit(None).cast("string")
    rate = F.regexp_replace(F.format_string("lr=%.0e", col("learning_rate").cast("double")), r"e([+-]\d)$", "e$1")
    told = lambda label, c: F.concat(F.lit(f"{label}="), col(c).cast("string"))
    flag = lambda label, c: F.when(col(c).cast("boolean"), label)
    replay = col("math_replay_fraction").cast("double")
    config = [told("size", "model_size"), told("attention", "attention_type"), flag("MoE", "use_moe"), told("experts", "num_experts"), told("vocab", "vocab_size"), told("ctx", "max_len"), told("d", "d_model"), F.coalesce(told("layers", "n_layers"), told("expert-layers", "expert_layers")), told("heads", "n_heads"), told("ff", "d_ff"), told("samples", "num_samples"), told("iters", "iters"), flag("curriculum", "curriculum"), flag("math-only", "math_only"), F.when(replay != 0, F.format_string("math-replay=%.0f%%", replay * 100)), F.when(col("learning_rate").isNotNull(), rate)]
    kinds = ("numeric", "exact", "date")
    by_kind = (lambda k: F.col("per_kind_accuracy")[k]) if "per_kind_accuracy" in have else (lambda k: F.lit(None).cast("double"))
    losses = [number(f"{n}=", col(c), "%.4f") for n, c in (("final", "final_loss"), ("best", "best_loss"), ("val", "best_val_loss"))]
    cells = [
        F.replace(F.coalesce(F.col("timestamp"), F.lit("unknown")), F.lit("+00:00"), F.lit("Z")),
        F.coalesce(F.col("experiment"), F.lit("unknown")),
        F.concat(F.lit("#"), F.col("rank").cast("string")),
        F.concat(F.col("metric_name"), F.format_string("=%.4f", F.col("metric"))),
        F.coalesce(number("", col("model_parameters") / 1_000_000, "%.2fM"), F.lit("-")),
        cell(config),
        cell(losses),
        cell([number(f"{label}=", value * 100, "%.1f%%") for label, value in (("overall", col("accuracy").cast("double")), *((k, by_kind(k).cast("double")) for k in kinds))]),
        F.coalesce(number("", col("elapsed_seconds") / 60, "%.1fm"), F.lit("-")),
        F.coalesce(col("checkpoint"), F.lit("-")),
        F.concat(F.lit("["), F.col("file_name"), F.lit("](results/"), F.col("file_name"), F.lit(")")),
    ]
    return ranked.select("timestamp", "file_name", F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |")).alias("line"))
