"""Attention, feed-forward, position and expert kernels over arrays, and the joins they stand on.

Long-form inputs are (row, pos, …) tables: one row a sequence position. Everything that meets
two positions joins within one sequence and only where the band or the causal order allows it.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lathe.operators.kernels import dot


def doubles(v: Column) -> Column:
    return F.transform(v, lambda x: x.cast("double"))


def scaled(v: Column, by: Column | float) -> Column:
    return F.transform(v, lambda x: x * by)


def added(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x + y)


def mat_vec(matrix: Column, vec: Column) -> Column:
    """Rows of ``matrix`` (array of arrays) times ``vec``."""
    return F.transform(matrix, lambda row: dot(row, vec))


def vector_sum(vec: Column, size: int) -> Column:
    """Elementwise sum as an aggregate; null for groups without rows."""
    return F.array(*[F.sum(F.get(vec, F.lit(i))) for i in range(size)])


def banded_pairs(tokens: DataFrame, width: int, row: str = "row", pos: str = "pos") -> DataFrame:
    """(row, q, k) of all positions at most ``width`` apart.

    Each position is sent to the blocks of ``width`` positions that its band can touch, so the join
    has an equality key of bounded groups instead of a whole sequence.
    """
    size = F.lit(max(width, 1))
    q = tokens.select(row, F.col(pos).alias("q"), F.floor(F.col(pos) / size).alias("__b"))
    k = tokens.select(row, F.col(pos).alias("k"), F.explode(F.sequence(F.floor(F.col(pos) / size) - 1, F.floor(F.col(pos) / size) + 1)).alias("__b"))
    return q.join(k, [row, "__b"]).where(F.abs(F.col("q") - F.col("k")) <= width).select(row, "q", "k")


def causal_pairs(tokens: DataFrame, row: str = "row", pos: str = "pos", cached: int = 0) -> DataFrame:
    """(row, q, k) with k <= q + ``cached``: the first ``cached`` keys come from a cache.

    All pairs of a sequence are what full attention is; a sequence is bounded by the context length.
    """
    q, k = tokens.select(row, F.col(pos).alias("q")), tokens.select(row, F.col(pos).alias("k"))
    return q.join(k, row).where(F.col("k") <= F.col("q") + cached)


def shared_heads(queries: DataFrame, keys: DataFrame, repeats: int, head: str = "head") -> DataFrame:
    """Query heads with the key and value head that ``repeats`` of them share."""
    return queries.withColumn("__kv", F.floor(F.col(head) / repeats)).join(keys.withColumnRenamed(head, "__kv"), "__kv").drop("__kv")


def embed(tokens: DataFrame, table: DataFrame, dim: int, token: str = "token", vec: str = "vec") -> DataFrame:
    """Tokens with their vectors times the square root of ``dim``; unknown tokens stay, without one."""
    return tokens.join(table.select(token, scaled(doubles(F.col(vec)), math.sqrt(dim)).alias(vec)), token, "left")


def attention(tokens: DataFrame, dim: int, width: int | None = None, cached: int = 0, row: str = "row", pos: str = "pos") -> DataFrame:
    """Causal scaled dot-product attention: (row, pos, out) from (row, pos, q, k, v).

    ``width`` restricts it to the last ``width`` positions and the position itself. The weighted sum
    is a map-side combined aggregate, so a position carries ``dim`` partial sums, not its pairs.
    """
    pairs = causal_pairs(tokens, row, pos, cached) if width is None else banded_pairs(tokens, width, row, pos).where("k <= q")
    q = tokens.select(row, F.col(pos).alias("q"), F.col("q").alias("__q"))
    kv = tokens.select(row, F.col(pos).alias("k"), F.col("k").alias("__k"), F.col("v").alias("__v"))
    x = pairs.join(q, [row, "q"]).join(kv, [row, "k"]).select(row, "q", "__v", (dot(F.col("__q"), F.col("__k")) / math.sqrt(dim)).alias("s"))
    x = x.withColumn("e", F.exp(F.col("s") - F.max("s").over(Window.partitionBy(row, "q"))))
    out = x.groupBy(row, "q").agg(vector_sum(scaled(doubles(F.col("__v")), F.col("e")), dim).alias("o"), F.sum("e").alias("z"))
    return out.select(row, F.col("q").alias(pos), F.transform("o", lambda y: y / F.col("z")).alias("out"))


def latent_attention(tokens: DataFrame, down: Column, up_k: Column, up_v: Column, dim: int, row: str = "row", pos: str = "pos") -> DataFrame:
    """Attention whose keys and values are restored from a low-rank latent of ``h`` (row, pos, q, h)."""
    x = tokens.withColumn("__c", mat_vec(down, F.col("h")))
    return attention(x.select(row, pos, "q", mat_vec(up_k, F.col("__c")).alias("k"), mat_vec(up_v, F.col("__c")).alias("v")), dim, row=row, pos=pos)


def silu(x: Column) -> Column:
    return x / (1 + F.exp(-x))


def gelu(x: Column) -> Column:
    """The tanh form."""
    return 0.5 * x * (1 + F.tanh(F.lit(math.sqrt(2 / math.pi)) * (x + 0.044715 * x * x * x)))


def swiglu(vec: Column, gate: Column, up: Column, down: Column) -> Column:
    """down (silu(gate x) * (up x))."""
    return mat_vec(down, F.zip_with(mat_vec(gate, vec), mat_vec(up, vec), lambda g, u: silu(g) * u))


def feed_forward(vec: Column, up: Column, down: Column) -> Column:
    return mat_vec(down, F.transform(mat_vec(up, vec), gelu))


def sinusoid(pos: Column, dim: int, base: float = 10000.0) -> Column:
    """Sines at even and cosines at odd places, in falling frequencies."""
    angle = lambda i: pos.cast("double") * F.lit(base ** (-(i - i % 2) / dim))
    return F.array(*[F.cos(angle(i)) if i % 2 else F.sin(angle(i)) for i in range(dim)])


def expert_mix(routes: DataFrame, outputs: DataFrame, dim: int, key: str = "row", expert: str = "expert") -> DataFrame:
    """(key, out): experts' outputs weighted by their routes (key, expert, w). The same for tokens
    and for whole sequences; a sequence is routed by its mean vector."""
    x = routes.join(outputs, [key, expert])
    return x.groupBy(key).agg(vector_sum(scaled(doubles(F.col("vec")), F.col("w")), dim).alias("out"))


def logits(vec: Column, heads: Column) -> Column:
    """One projection, or one a head for an array of projections with ``multi_head_logits``."""
    return mat_vec(heads, vec)


def multi_head_logits(vec: Column, heads: Column) -> Column:
    return F.transform(heads, lambda m: mat_vec(m, vec))


def total_variation(p: Column, q: Column) -> Column:
    """Half the sum of absolute differences of two distributions."""
    return 0.5 * F.aggregate(F.zip_with(p, q, lambda x, y: F.abs(x - y)), F.lit(0.0), lambda a, x: a + x)


def largest_difference(a: Column, b: Column) -> Column:
    return F.array_max(F.zip_with(a, b, lambda x, y: F.abs(x - y)))


def prefix_delta(short: DataFrame, long: DataFrame, vec: str = "out", row: str = "row", pos: str = "pos") -> DataFrame:
    """Largest change of outputs at shared positions when a sequence grows; 0 for causal models."""
    x = short.select(row, pos, F.col(vec).alias("__a")).join(long.select(row, pos, F.col(vec).alias("__b")), [row, pos])
    return x.groupBy(row).agg(F.max(largest_difference(F.col("__a"), F.col("__b"))).alias("delta"))
