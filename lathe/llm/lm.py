"""Language-model scores by deleted interpolation.

Maximum-likelihood estimates of three orders (bigram, unigram, uniform) are mixed, with
weights that depend on how often the context was seen (one bucket an octave). The weights are
learned by expectation-maximisation on held-out counts: every training token is scored with
its own occurrence deleted from all counts, so the whole training corpus serves as held-out
data. These events are gathered as a histogram over (bigram count, context count, word count),
each in half-octave bins (exact below 8), of a fixed number of cells.

All n-grams of all training documents are counted, through packs and buckets. Tokens: words,
A-Z lower-cased, then one end a document; the first context is a mark of its own. Null and
empty texts are the end token alone. Repeated rows count as often as they occur. A null
doc_id counts as training. Words are known by 64-bit hashes, bigrams by 48 bits and bucket.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import K1, WordTable, materialise, mix, n_groups, small_batches, table
from .packs import ASK_DDL, answers, bits_of, counting, over_packs, packs, request_rows, shelf_bits, width_of, with_answers

END, BEGIN = np.uint64(0x1F3A5C7E9B2D4F61), np.uint64(0xD6E8FEB86659FD93)
BINS, EXACT, BUCKETS = 88, 8, 42


def bins(x: np.ndarray) -> np.ndarray:
    """Half-octave bins, exact below EXACT."""
    with np.errstate(divide="ignore"):
        return np.where(x < EXACT, x, EXACT + np.floor(2 * np.log2(np.maximum(x, 1) / EXACT))).astype(np.int64).clip(0, BINS - 1)


def bin_value(b: np.ndarray) -> np.ndarray:
    return np.where(b < EXACT, b, EXACT * 2.0 ** ((b - EXACT) / 2 + 0.25))


def octave(x: np.ndarray) -> np.ndarray:
    """The context-frequency bucket: 0 for an unseen context, else one an octave."""
    return np.where(x > 0, 1 + np.floor(np.log2(np.maximum(x, 1))), 0).astype(np.int64).clip(0, BUCKETS - 1)


def expectation_maximisation(cells: np.ndarray, weight: np.ndarray, total: float, vocabulary: float, rounds: int = 60) -> np.ndarray:
    """Mixture weights (bucket, order) from the histogram; unseen buckets take the nearest seen one below."""
    c2, ctx, c1 = bin_value(cells // (BINS * BINS)), bin_value(cells // BINS % BINS), bin_value(cells % BINS)
    f = np.stack([np.minimum(c2 / np.maximum(ctx, 1), 1.0), c1 / max(total - 1, 1.0), np.full(len(cells), 1.0 / (vocabulary + 1))], 1)
    b = octave(ctx)
    lam = np.full((BUCKETS, 3), 1 / 3)
    lam[0] = [0.0, 0.5, 0.5]
    for _ in range(rounds):
        part = lam[b] * f
        part *= (weight / np.maximum(part.sum(1), 1e-300))[:, None]
        new = np.stack([np.bincount(b, part[:, i], BUCKETS) for i in range(3)], 1) + 1e-3 * lam
        lam = new / new.sum(1, keepdims=True)
    seen = np.bincount(b, weight, BUCKETS) > 0
    for i in range(1, BUCKETS):
        if not seen[i]:
            lam[i] = lam[i - 1] if i > 1 else [1 / 3, 1 / 3, 1 / 3]
    return lam


def is_training(doc_id: int | None) -> bool:
    return doc_id is None or zlib.crc32(str(doc_id).encode()) % 5 != 1


class Tokens:
    """The tokens of one pack: words and bigrams as places among the pack's distinct keys."""

    def __init__(self, t: pa.Table):
        table = WordTable(t.column("text"), lower=True)
        self.ids = t.column("doc_id")
        self.n = np.diff(table.cut) + 1
        self.train = np.array([is_training(i) for i in self.ids.to_pylist()], bool)
        self.begin = np.cumsum(self.n) - self.n
        words = np.full(int(self.n.sum()), END, np.uint64)
        is_word = np.ones(len(words), bool)
        is_word[self.begin + self.n - 1] = False
        words[is_word] = table.hashes()
        before = np.concatenate(([BEGIN], words[:-1])) if len(words) else words
        before[self.begin] = BEGIN
        pairs = mix(before * K1 ^ (words >> np.uint64(31)) + words)
        self.of_train = np.repeat(self.train, self.n)
        self.words, self.word = np.unique(np.concatenate((words, np.array([BEGIN], np.uint64))), return_inverse=True)
        self.begin_at, self.word = self.word[-1], self.word[:-1]
        self.pairs, self.pair = np.unique(pairs, return_inverse=True)
        self.word_n = np.bincount(self.word, self.of_train, len(self.words)).astype(np.uint32)
        self.word_n[self.begin_at] = self.train.sum()
        self.pair_n = np.bincount(self.pair, self.of_train, len(self.pairs)).astype(np.uint32)


SEEN = pa.schema([("pack", pa.int64()), ("docs", pa.binary()), ("cells", pa.list_(pa.int64())), ("weights", pa.list_(pa.int64()))])
SCORED = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def interpolated_scores(docs: DataFrame) -> DataFrame:
    """Scores of all rows of ``docs`` (doc_id, text) by a model of the training ones."""
    spark = docs.sparkSession
    held = packs(docs.select("doc_id", "text"), "doc_id", "text")
    bits = bits_of(n_groups(docs.count(), 1000, 64))

    shelf = shelf_bits(bits)

    def asked(of, width):
        def ask(p, t):
            x = Tokens(t)
            yield from request_rows(p, *((x.words, x.word_n) if of == "words" else (x.pairs, x.pair_n)), shelf, width)

        return over_packs(held, ask, ASK_DDL)

    def tally(keys, got):
        """Tokens of training and distinct ones among a bucket's words."""
        known, where = np.unique(keys[(keys != BEGIN) & (got > 0)], return_index=True)
        return int(got[(keys != BEGIN) & (got > 0)][where].sum()), len(known)

    exact = counting(lambda n: n.astype(np.uint64))
    told = [answers(asked(of, w), w, bits, exact, lambda a: zlib.compress(a.tobytes(), 1), lambda b: np.frombuffer(zlib.decompress(b), np.uint64), tally if of == "words" else None) for of, w in (("words", 8), ("pairs", width_of(6, bits)))]
    told = materialise(told[0].unionByName(told[1].withColumn("bucket", (F.col("bucket") + (1 << 20)).cast("int"))))
    total, vocabulary = told.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("v"), F.lit(0))).first()

    def look_up(p, t, rows):
        x = Tokens(t)
        rows = rows.sort_by("bucket")
        flat = np.frombuffer(b"".join(zlib.decompress(a) for a in rows.column("answer").to_pylist()), np.uint64).astype(np.int64)
        word, pair = flat[: len(x.words)], flat[len(x.words) :]
        c1, c2 = word[x.word], pair[x.pair]
        ctx = np.concatenate((word[[x.begin_at]], c1[:-1])) if len(c1) else c1
        ctx[x.begin] = word[x.begin_at]
        own = x.of_train
        cell, n = np.unique((bins(c2[own] - 1) * BINS + bins(ctx[own] - 1)) * BINS + bins(c1[own] - 1), return_counts=True)
        body = zlib.compress(b"".join(y.astype(np.uint32 if total < 1 << 32 else np.uint64).tobytes() for y in (c1, ctx, c2)), 1)
        head = pa.table({"doc_id": x.ids, "train": x.train, "n": x.n})
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, head.schema) as w:
            w.write_table(head)
        docs_part = sink.getvalue().to_pybytes()
        yield pa.table({"pack": [p], "docs": [len(docs_part).to_bytes(8, "little") + docs_part + body], "cells": [cell.tolist()], "weights": [n.tolist()]}, schema=SEEN)

    seen = materialise(with_answers(held, told.where("pack IS NOT NULL").select("pack", "bucket", "answer"), look_up, SEEN))
    hist = seen.select(F.explode(F.arrays_zip("cells", "weights")).alias("c")).groupBy("c.cells").agg(F.sum("c.weights").alias("w")).collect()  # at most BINS ** 3 cells
    lam = expectation_maximisation(np.array([r[0] for r in hist], np.int64), np.array([r[1] for r in hist], float), total, vocabulary)

    def score(batches):
        wide = np.uint32 if total < 1 << 32 else np.uint64
        for b in batches:
            for body in b.column("docs").to_pylist():
                n = int.from_bytes(body[:8], "little")
                head = pa.ipc.open_stream(pa.py_buffer(body[8 : 8 + n])).read_all()
                c1, ctx, c2 = np.frombuffer(zlib.decompress(body[8 + n :]), wide).astype(np.int64).reshape(3, -1)
                k = octave(ctx)
                p = lam[k, 0] * c2 / np.maximum(ctx, 1) + lam[k, 1] * c1 / max(total, 1) + lam[k, 2] / (vocabulary + 1)
                length = np.array(head.column("n"))
                at = np.cumsum(length) - length
                sums = lambda v: np.add.reduceat(v, at) if len(at) else v
                base = sums(np.log10((c1 + 0.5) / (total + 0.5 * (vocabulary + 1))))
                yield pa.RecordBatch.from_arrays([head.column("doc_id").combine_chunks(), pa.array(~np.array(head.column("train"), bool)), pa.array(length), pa.array(sums((c1 > 0).astype(np.int64))), pa.array(np.full(len(at), total, np.int64)), pa.array(base), pa.array(sums(np.log10(p)))], names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return seen.select("docs").mapInArrow(score, SCORED)


def op4_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return interpolated_scores(table(spark, sf_dir, "documents"))
