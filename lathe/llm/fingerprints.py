"""Order MinHash fingerprints, sensitive to edit distance.

A text's k-mers are runs of ``k`` consecutive words, each numbered by its occurrence, so that
repeated ones count. For each of ``slots`` hash functions the ``take`` numbered k-mers of the
smallest hashes are selected, put back in text order and hashed as a tuple; the share of equal
slots of two fingerprints estimates a likeness that falls with moved as well as with changed
words. Equal texts have equal fingerprints.

Texts of fewer than k words have all their words as one k-mer; null, empty and blank texts have
none and share one fingerprint. Very long texts are hashed in stretches.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import K1, K2, WordTable, batch_of, chain_hash, mix, n_groups, small_batches, table, text_of

STRETCH = 16_384


class OrderMinHash:
    def __init__(self, slots: int = 48, k: int = 2, take: int = 2):
        self.slots, self.k, self.take = slots, k, take
        seed = mix(np.arange(1, 2 * slots + 1, dtype=np.uint64) * K1)
        self.flip, self.times = seed[:slots], seed[slots:] | np.uint64(1)

    def of(self, text: str) -> np.ndarray:
        """``slots`` 16-bit values."""
        h = WordTable(pa.array([text])).hashes()
        mers = chain_hash(h, min(self.k, len(h))) if len(h) else h
        n = len(mers)
        if not n:
            return (self.flip >> np.uint64(48)).astype(np.uint16)
        order = np.argsort(mers, kind="stable")
        new = np.concatenate(([True], mers[order][1:] != mers[order][:-1]))
        first = np.flatnonzero(new)
        number = np.empty(n, np.uint64)
        number[order] = np.arange(n) - first[np.cumsum(new) - 1]
        x = mix(mers + number * K1)
        least = np.full((self.slots, self.take), np.iinfo(np.uint64).max, np.uint64)
        place = np.full((self.slots, self.take), -1, np.int64)
        rows = np.arange(self.slots)
        for s in range(0, n, STRETCH):
            v = (x[None, s : s + STRETCH] ^ self.flip[:, None]) * self.times[:, None]
            for _ in range(min(self.take, v.shape[1])):
                at = v.argmin(1)
                got = v[rows, at]
                worst = least.argmax(1)
                better = got < least[rows, worst]
                least[rows[better], worst[better]] = got[better]
                place[rows[better], worst[better]] = at[better] + s
                v[rows, at] = np.iinfo(np.uint64).max
        place.sort(1)
        acc = self.flip.copy()
        for c in range(self.take):
            acc = mix(acc * K2 + np.where(place[:, c] >= 0, x[place[:, c]], np.uint64(1)))
        return (acc >> np.uint64(48)).astype(np.uint16)


def written(f: np.ndarray) -> str:
    return f.astype(">u2").tobytes().hex()


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    return float((a == b).mean())


SCHEMA = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())])
DDL = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def in_turn(docs: DataFrame, order_key: str = "doc_id") -> DataFrame:
    """``docs`` dealt to ranges by ``order_key``, each sorted descending and followed by the row
    (``halo``) that comes next after its last one; after the last row of all comes the first.

    Nulls come last; rows of one key follow each other by text. What the driver holds is one
    key a range, the number of ranges being bounded.
    """
    spark = docs.sparkSession
    least = -(1 << 63)
    x = docs.select("doc_id", "text", F.coalesce(F.col(order_key).cast("long"), F.lit(least)).alias("key"))
    n = n_groups(docs.count(), 1500, 8, 4096)
    cuts = sorted(set(x.select(F.col("key").cast("double").alias("key")).approxQuantile("key", [i / n for i in range(1, n)], 0.2 / n)))
    low = F.lit(0)
    # A binary search written as an expression: log2(ranges) comparisons a row.
    array = F.array(*[F.lit(c) for c in cuts]) if cuts else None
    if cuts:
        steps = len(cuts).bit_length()
        low = F.aggregate(
            F.sequence(F.lit(0), F.lit(steps - 1)),
            F.struct(F.lit(0).alias("lo"), F.lit(len(cuts)).alias("hi")),
            lambda s, _: F.when(s["lo"] < s["hi"], F.when(F.element_at(array, (F.floor((s["lo"] + s["hi"]) / 2) + 1).cast("int")) <= F.col("key").cast("double"), F.struct((F.floor((s["lo"] + s["hi"]) / 2) + 1).cast("int").alias("lo"), s["hi"].alias("hi"))).otherwise(F.struct(s["lo"].alias("lo"), F.floor((s["lo"] + s["hi"]) / 2).cast("int").alias("hi")))).otherwise(s),
        )["lo"]
    x = x.withColumn("range", low)
    tops = sorted((r["range"], r["top"]) for r in x.groupBy("range").agg(F.max("key").alias("top")).collect())
    after = [(top, tops[(i + 1) % len(tops)][0]) for i, (_, top) in enumerate(tops)]
    halo = spark.createDataFrame(after or [], "key long, to int")
    extra = x.join(F.broadcast(halo), "key").select("doc_id", "text", "key", F.col("to").alias("range"), F.lit(True).alias("halo"))  # one small row a range
    both = x.withColumn("halo", F.lit(False)).select("doc_id", "text", "key", "range", "halo").unionByName(extra)
    return both.repartition(n, "range").sortWithinPartitions("range", "halo", F.desc("key"), "text")


def fingerprint_edits(docs: DataFrame, slots: int = 48, k: int = 2, take: int = 2) -> DataFrame:
    """Fingerprints of every text, of its edited text, and their likenesses (see op8)."""

    def run(batches):
        omh, last, done = OrderMinHash(slots, k, take), None, None
        out = {f.name: [] for f in SCHEMA}

        def emit(row, following):
            d, text, f = row
            n = len(text)
            cut = n // 3
            edited = text[: n - cut] + following[1][:cut]
            e = f if edited == text else omh.of(edited)
            for name, v in zip(out, (d, n, hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(), written(f), written(e), likeness(f, e), likeness(f, following[2])), strict=True):
                out[name].append(v)

        for b in batches:
            for d, text, r, halo in zip(*(b.column(c).to_pylist() for c in ("doc_id", "text", "range", "halo")), strict=True):
                if halo and done == r:
                    continue  # further rows of the halo's key
                text = text_of(text)
                row = (d, text, omh.of(text))
                if last is not None:
                    emit(last, row)
                last, done = (None, r) if halo else (row, None)
            yield batch_of(out, SCHEMA)
            out = {f.name: [] for f in SCHEMA}

    return in_turn(docs).select("doc_id", "text", "range", "halo").mapInArrow(run, DDL)


def op8_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return fingerprint_edits(table(spark, sf_dir, "documents"))
