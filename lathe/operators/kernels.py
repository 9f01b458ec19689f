"""Sampling filters, routing and small array kernels, over arrays or long-form rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def softmax_topk(df: DataFrame, row: str, vec: str, k: int) -> DataFrame:
    """(row, k, w): the k largest softmax entries, renormalised, ties by position; no shuffle."""
    v = F.transform(vec, lambda x: x.cast("double"))
    scored = let(F.struct(v.alias("v"), F.array_max(v).alias("top")), lambda z: F.transform(z["v"], lambda x, i: F.struct((-F.exp(x - z["top"])).alias("e"), (i + 1).cast("bigint").alias("k"))))
    best = F.slice(F.array_sort(scored), 1, k)
    x = df.select(row, best.alias("b")).withColumn("s", F.aggregate("b", F.lit(0.0), lambda a, y: a + y["e"]))
    return x.select(row, "s", F.explode("b").alias("y")).select(row, F.col("y.k").alias("k"), (F.col("y.e") / F.col("s")).alias("w"))


def temperature(logits: Column, t: float) -> Column:
    return F.transform(logits, lambda x: x / F.lit(max(t, 1e-6)))


def let(value: Column, f) -> Column:
    """f(value) with the value computed once: inside a lambda a captured expression is computed an element."""
    return F.element_at(F.transform(F.array(value), f), 1)


def softmax(logits: Column) -> Column:
    def share(v):
        e = F.transform(v["v"], lambda x: F.exp(x - v["top"]))
        return let(F.struct(e.alias("e"), F.aggregate(e, F.lit(0.0), lambda a, y: a + y).alias("sum")), lambda z: F.transform(z["e"], lambda x: x / z["sum"]))

    return let(F.struct(logits.alias("v"), F.array_max(logits).alias("top")), share)


def top_p(probs: DataFrame, row: str, token: str, p: str, limit: float) -> DataFrame:
    """Tokens whose cumulative probability stays within the limit; the first one always stays."""
    w = Window.partitionBy(row).orderBy(F.desc(p), token)
    x = probs.withColumn("__c", F.sum(p).over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("__r", F.row_number().over(w))
    return x.where((F.col("__c") <= limit) | (F.col("__r") == 1)).drop("__c", "__r")


def min_p(probs: DataFrame, row: str, p: str, share: float) -> DataFrame:
    return probs.withColumn("__m", F.max(p).over(Window.partitionBy(row))).where(F.col(p) >= share * F.col("__m")).drop("__m")


def repetition_penalty(logits: Column, seen: Column, penalty: float) -> Column:
    """Logits of seen tokens divided by the penalty (also negative ones, which rise)."""
    return F.transform(logits, lambda x, i: F.when(F.array_contains(seen, i), x / penalty).otherwise(x))


def rms(vec: Column, eps: float = 1e-6) -> Column:
    v = F.transform(vec, lambda x: x.cast("double"))
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x) / F.size(v) + F.lit(eps))


def rms_norm(vec: Column, eps: float = 1e-6) -> Column:
    return let(F.struct(vec.alias("v"), rms(vec, eps).alias("scale")), lambda z: F.transform(z["v"], lambda x: x.cast("double") / z["scale"]))


def layer_norm(vec: Column, eps: float = 1e-5) -> Column:
    v = F.transform(vec, lambda x: x.cast("double"))
    centred = let(F.struct(v.alias("v"), (F.aggregate(v, F.lit(0.0), lambda a, x: a + x) / F.size(v)).alias("mean")), lambda z: F.transform(z["v"], lambda x: x - z["mean"]))
    return let(centred, lambda c: let(F.struct(c.alias("c"), F.sqrt(F.aggregate(c, F.lit(0.0), lambda a, x: a + x * x) / F.size(c) + F.lit(eps)).alias("scale")), lambda z: F.transform(z["c"], lambda x: x / z["scale"])))


def log_sum_exp(logits: Column) -> Column:
    v = F.transform(logits, lambda x: x.cast("double"))
    return let(F.struct(v.alias("v"), F.array_max(v).alias("top")), lambda z: z["top"] + F.log(F.aggregate(z["v"], F.lit(0.0), lambda a, x: a + F.exp(x - z["top"]))))


def z_loss(df: DataFrame, logits: str, mask: str, coefficient: float) -> DataFrame:
    """coefficient times the mean of logsumexp squared over the positions that the mask keeps."""
    z = log_sum_exp(F.col(logits))
    return df.agg((F.lit(coefficient) * F.sum(z * z * F.col(mask)) / F.greatest(F.sum(mask), F.lit(1.0))).alias("z_loss"))


def smoothed(state: Column, target: Column, times: int) -> Column:
    """A state that moves half-way to its target, again and again."""
    for _ in range(times):
        state = F.zip_with(state, target, lambda a, b: 0.5 * a + 0.5 * b)
    return state


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def gated_scan(steps: Column) -> Column:
    """s = f s + i, out = o s over an ordered array of struct(f, i, o)."""
    start = F.struct(F.lit(0.0).alias("s"), F.array().cast("array<double>").alias("out"))
    def step(a, x):
        s = x["f"] * a["s"] + x["i"]
        return F.struct(s.alias("s"), F.concat(a["out"], F.array(x["o"] * s)).alias("out"))
    return F.aggregate(steps, start, step)["out"]


def mean_pool(df: DataFrame, group: str, vec: str) -> DataFrame:
    x = df.select(group, F.posexplode(vec).alias("dim", "e"))
    return x.groupBy(group, (F.col("dim") + 1).cast("bigint").alias("dim")).agg(F.avg(F.col("e").cast("double")).alias("mean"))


def rotate(vec: Column, pos: Column, base: float = 10000.0) -> Column:
    """Rotary positions on interleaved pairs."""
    d = F.size(vec)
    def at(x, i):
        angle = pos / F.pow(F.lit(base), (i - i % 2) / d)
        other = F.element_at(vec, (F.when(i % 2 == 0, i + 2).otherwise(i)).cast("int"))
        return F.when(i % 2 == 0, x * F.cos(angle) - other * F.sin(angle)).otherwise(x * F.cos(angle) + other * F.sin(angle))
    return F.transform(vec, at)


def load_balance(probs: DataFrame, expert: str, p: str, n: int) -> DataFrame:
    usage = probs.groupBy(expert).agg(F.avg(p).alias("usage"))
    return usage.agg(F.sum(F.pow(F.col("usage") - 1.0 / n, 2)).alias("loss"))


def learning_rate(step: Column, warmup: int, total: int, top: float, low_share: float = 0.1, floor: float | None = None) -> Column:
    """Linear warm-up, then a cosine down to ``low_share`` of the top rate, or to the rate ``floor``."""
    low_share = low_share if floor is None else floor / top
    part = (step - warmup) / F.lit(float(max(1, total - warmup)))
    cosine = low_share + (1 - low_share) * 0.5 * (1 + F.cos(F.lit(3.141592653589793) * F.least(part, F.lit(1.0))))
    return F.when(step < warmup, top * (step + 1) / warmup).otherwise(top * cosine)
