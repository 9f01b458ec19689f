import math

import numpy as np
from pyspark.sql import functions as F

from lathe.operators import attention as A


def test_causal_and_banded_attention_match_numpy(spark):
    rng = np.random.default_rng(1)
    q, k, v = rng.standard_normal((3, 9, 4))
    df = spark.createDataFrame([(0, i, q[i].tolist(), k[i].tolist(), v[i].tolist()) for i in range(9)], "row int, pos int, q array<double>, k array<double>, v array<double>")
    for width in (None, 3):
        s = q @ k.T / 2
        for i in range(9):
            for j in range(9):
                if j > i or width is not None and i - j > width:
                    s[i, j] = -np.inf
        w = np.exp(s - s.max(1, keepdims=True))
        want = w / w.sum(1, keepdims=True) @ v
        got = {r.pos: r.out for r in A.attention(df, 4, width).collect()}
        assert all(np.allclose(got[i], want[i]) for i in range(9))


def test_cells(spark):
    df = spark.createDataFrame([([1.0, -2.0], [[1.0, 0.0], [1.0, 1.0]], 3)], "v array<double>, m array<array<double>>, p int")
    r = df.select(A.mat_vec(F.col("m"), F.col("v")).alias("a"), A.sinusoid(F.col("p"), 2).alias("b"), A.total_variation(F.array(F.lit(1.0), F.lit(0.0)), F.array(F.lit(0.5), F.lit(0.5))).alias("c"), A.swiglu(F.col("v"), F.col("m"), F.col("m"), F.col("m")).alias("d")).first()
    silu = lambda x: x / (1 + math.exp(-x))
    assert r.a == [1.0, -1.0] and np.allclose(r.b, [math.sin(3), math.cos(3)]) and r.c == 0.5
    assert np.allclose(r.d, [silu(1.0), silu(1.0) + silu(-1.0) * -1.0])


def test_experts_and_embeddings(spark):
    routes = spark.createDataFrame([(0, 0, 0.25), (0, 1, 0.75)], "row int, expert int, w double")
    outs = spark.createDataFrame([(0, 0, [1.0, 0.0]), (0, 1, [0.0, 2.0])], "row int, expert int, vec array<double>")
    assert A.expert_mix(routes, outs, 2).first().out == [0.25, 1.5]
    tokens = spark.createDataFrame([(5,), (6,)], "token int")
    got = {r.token: r.vec for r in A.embed(tokens, spark.createDataFrame([(5, [1.0])], "token int, vec array<double>"), 4).collect()}
    assert got == {5: [2.0], 6: None}
