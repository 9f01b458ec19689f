"""Best-fit packing by minimum bin slack.

Texts become token ids with an end id; only documents above the capacity are cut, into pieces
of exactly the capacity and a rest. What the driver plans with is the number of pieces of each
length, at most ``capacity`` numbers whatever the corpus: for each bin the largest length
left is put in, and a bitset subset-sum over the lengths still available finds the fullest
feasible combination for the rest of the bin; the combination is taken out as often as it is
there. Pieces then take the places planned for their length by rank. Ranks are numbered
within (length, salt), so a length that a third of all pieces share is no single task.

Null and empty texts are the end id alone. Equal rows are packed one by one, in any order
among themselves.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import batch_of, gathered, materialise, n_groups, per_batch, release, small_batches, table
from .tokens import default_path, encoder

CAPACITY = 4096


def pieces(docs: DataFrame, capacity: int = CAPACITY, tokenizer: str | None = None) -> DataFrame:
    tokenizer = tokenizer or default_path()
    schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])

    def run(batches):
        enc = encoder(tokenizer)
        for b in gathered(batches):
            ids, n = enc.batch(b.column("text"))
            many = -(-n // capacity)
            doc = np.repeat(np.arange(len(n)), many)
            piece = np.arange(len(doc)) - np.repeat(np.cumsum(many) - many, many)
            start = piece * capacity
            length = np.minimum(n[doc] - start, capacity)
            at = (np.cumsum(n) - n)[doc] + start
            body = memoryview(ids.view(np.uint8))
            crc = [zlib.crc32(body[4 * x : 4 * (x + y)]) for x, y in zip(at.tolist(), length.tolist(), strict=True)]
            yield batch_of({"doc_id": b.column("doc_id").take(pa.array(doc)), "piece": piece.astype(np.int32), "start": start, "length": length, "ids_crc32": crc}, schema)
        release()

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def fullest(room: int, lengths: list[int], left: dict[int, int]) -> dict[int, int]:
    """The combination of available lengths (at most ``left`` of each) that fills ``room`` best.

    A bitset holds which sums can be reached; lengths are added largest first, and the search
    ends as soon as the room can be filled exactly.
    """
    reach, mask, trail = 1, (1 << (room + 1)) - 1, []
    for n in lengths:
        if n > room:
            continue
        for _ in range(min(left[n], room // n)):
            new = (reach | reach << n) & mask
            if new == reach:
                break
            trail.append((n, reach))
            reach = new
            if reach >> room & 1:
                break
        if reach >> room & 1:
            break
    at, out = reach.bit_length() - 1, {}
    for n, before in reversed(trail):
        if not before >> at & 1:
            out[n] = out.get(n, 0) + 1
            at -= n
    return out


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, dict[int, int]]]:
    """[(bins, {length: pieces a bin})]; every piece is used once."""
    left = {n: c for n, c in counts.items() if c > 0}
    lengths, out = sorted(left, reverse=True), []
    while lengths:
        top = lengths[0]
        left[top] -= 1
        combo = fullest(capacity - top, lengths, left)
        left[top] += 1
        combo[top] = combo.get(top, 0) + 1
        times = min(left[n] // k for n, k in combo.items())
        out.append((times, combo))
        gone = False
        for n, k in combo.items():
            left[n] -= k * times
            gone |= left[n] == 0
        if gone:
            lengths = [n for n in lengths if left[n]]
    return out


def pack(docs: DataFrame, capacity: int = CAPACITY, tokenizer: str | None = None) -> DataFrame:
    """Places of all pieces of ``docs`` (doc_id, text): sequence_id and offset."""
    cut = materialise(pieces(docs, capacity, tokenizer))
    counts = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most `capacity` rows
    slots, used, bins = {}, dict.fromkeys(counts, 0), 0
    for times, combo in plan(counts, capacity):
        at = 0
        for n, k in sorted(combo.items(), reverse=True):
            slots.setdefault(n, []).append((used[n], k, bins, at))
            used[n] += k * times
            at += n * k
        bins += times
    slots = {n: np.array(x, np.int64).T for n, x in slots.items()}
    shared = docs.sparkSession.sparkContext.broadcast(slots)  # bounded by the plan, which grows with the capacity only

    salts = n_groups(sum(counts.values()), 20_000, 16, 4096)
    cut = cut.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(salts)))
    w = Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32")
    ranked = cut.withColumn("rank", F.row_number().over(w) - 1)
    each = cut.groupBy("length", "salt").agg(F.count("*").alias("n"))
    before = each.select("length", "salt", (F.sum("n").over(Window.partitionBy("length").orderBy("salt")) - F.col("n")).alias("before"))
    ranked = ranked.join(before, ["length", "salt"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("rank") + F.col("before")).alias("rank"))

    def make():
        own = shared.value

        def run(b):
            n, rank = np.array(b.column("length")), np.array(b.column("rank"))
            seq, off = np.zeros(len(n), np.int64), np.zeros(len(n), np.int64)
            order = np.argsort(n, kind="stable")
            for at in np.split(order, np.flatnonzero(np.diff(n[order])) + 1) if len(n) else []:
                first, k, base, place = own[int(n[at[0]])]
                i = np.searchsorted(first, rank[at], "right") - 1
                local = rank[at] - first[i]
                seq[at], off[at] = base[i] + local // k[i], place[i] + local % k[i] * n[at]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")), pa.array(seq), pa.array(off)], names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

        return run

    return ranked.mapInArrow(per_batch(make), "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return pack(table(spark, sf_dir, "documents"))
