"""Exact k highest integer inner products over a bit-sliced index.

Components are quantised to floor(256 x). A shard of vectors, sorted by vec_id, keeps of every
component its least value and, bit by bit, a bitmap over the shard's rows of what stands above that. A
query's component is written as few signed powers of two; a power 2^c times the bitmap of bit b
counts 2^(b + c) a row, and a negative one is the complement's bitmap and a constant. So a
query's scores of all rows of a shard are sums of bitmaps in columns by their power, added by
carry-save adders: (x, y, z) -> (x ^ y ^ z, majority) until one bitmap a column is left. What comes out
is the scores' own bit slices. From the most significant slice downward rows are certain, possible
or out, until k rows are certain; rows that still tie at the boundary have equal scores, and the smallest
vec_ids are taken. Scores are exact throughout.

Queries come in blocks bounded in bytes, and a block meets every shard: the shards of a task are merged
there, tasks by Spark.

Vectors that are null or hold null or non-finite components take no part. Vectors are compared with those
of their own length (of length 0 too, by 0). Every row is a vector of its own: a row is left out
as its own partner, another row of the same vec_id or the same components is not. Rows without
vec_id are no queries and come last among ties. Scores beyond 64 bits, which components beyond some
ten millions can give, are found with whole numbers of any size and end at the range of a long.
Further columns are ignored, an empty table gives no rows.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import batch_of, materialise, release, table

#: Rows of a shard: as many as keep all cores busy, within these.
LEAST_ROWS, MOST_ROWS = 2048, 65_536
#: Bytes of queries that meet the shards in one pass.
BLOCK_BYTES = 8 << 20
#: Scores are added as bitmaps if they stay below this.
SAFE = 1 << 62
LOW, HIGH = -(1 << 63), (1 << 63) - 1
#: Merged in a task when so many candidates wait.
WAITING = 1 << 20

SHARD = pa.schema([("shard", pa.int64()), ("dim", pa.int32()), ("ids", pa.list_(pa.int64())), ("largest", pa.float64()), ("base", pa.binary()), ("of", pa.binary()), ("bit", pa.binary()), ("slices", pa.binary()), ("wide", pa.binary())])
SHARD_DDL = "shard long, dim int, ids array<long>, largest double, base binary, of binary, bit binary, slices binary, wide binary"


def quantised(vectors: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(which rows take part, their lengths, their components one after the other as whole doubles)."""
    sound = vectors.is_valid().to_numpy(zero_copy_only=False)
    size = np.where(sound, vectors.value_lengths().fill_null(0).to_numpy(zero_copy_only=False), 0).astype(np.int64)
    with np.errstate(over="ignore"):
        x = np.floor(256.0 * vectors.flatten().cast(pa.float64()).fill_null(np.nan).to_numpy(zero_copy_only=False))  # the lists of null rows are left out
    row = np.repeat(np.arange(len(size)), size)
    sound[row[~np.isfinite(x)]] = False
    keep = np.flatnonzero(sound)
    return keep, size[keep], x[sound[row]]


def bitmaps(bits: np.ndarray) -> np.ndarray:
    """Rows of 0 and 1 as rows of 64-bit words."""
    words = -(-bits.shape[1] // 64)
    out = np.zeros((bits.shape[0], 8 * words), np.uint8)
    packed = np.packbits(bits, axis=1, bitorder="little")
    out[:, : packed.shape[1]] = packed
    return out.view("<u8")


def ones(bitmap: np.ndarray, most: int | None = None) -> np.ndarray:
    """Places of the set bits; the first ``most`` of them at most."""
    at = np.flatnonzero(bitmap)[:most]
    bits = np.unpackbits(bitmap[at].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    word, bit = np.nonzero(bits)
    return (at[word] * 64 + bit)[:most]


@dataclass
class Shard:
    """Vectors of one length: ``values`` (rows, dim) as slices, or as they are if they are too large for it."""

    shard: int
    dim: int
    ids: pa.Array
    largest: float
    base: np.ndarray
    of: np.ndarray
    bit: np.ndarray
    slices: np.ndarray
    wide: np.ndarray | None

    @classmethod
    def of_values(cls, ids: pa.Array, x: np.ndarray) -> Shard:
        rows, dim = x.shape
        largest = float(np.abs(x).max(initial=0))
        none = np.zeros(0, np.int64)
        if largest >= 1 << 31:
            return cls(uuid.uuid4().int >> 65, dim, ids, largest, none, none, none, np.zeros((0, -(-rows // 64)), "<u8"), x)
        v = x.astype(np.int64)
        base = v.min(0) if rows else np.zeros(dim, np.int64)
        over = v - base
        parts, of, bit = [], [], []
        for b in range(int(over.max(initial=0)).bit_length()):
            plane = over >> b & 1
            some = np.flatnonzero(plane.any(0))  # a slice without a set bit adds nothing
            parts.append(bitmaps(np.ascontiguousarray(plane[:, some].T.astype(np.uint8))))
            of.append(some)
            bit.append(np.full(len(some), b))
        slices = np.concatenate(parts) if parts else np.zeros((0, -(-rows // 64)), "<u8")
        return cls(uuid.uuid4().int >> 65, dim, ids, largest, base, np.concatenate(of) if of else none, np.concatenate(bit) if bit else none, slices, None)

    def row(self) -> pa.RecordBatch:
        c = {"shard": self.shard, "dim": self.dim, "largest": self.largest, "base": self.base.tobytes(), "of": self.of.tobytes(), "bit": self.bit.tobytes(), "slices": self.slices.tobytes(), "wide": None if self.wide is None else self.wide.tobytes()}
        return batch_of({k: [v] for k, v in c.items()} | {"ids": [self.ids.to_pylist()]}, SHARD)

    @classmethod
    def read(cls, b: pa.RecordBatch) -> Iterator[Shard]:
        for i in range(b.num_rows):
            r = {c: b.column(c)[i].as_py() for c in b.schema.names if c != "ids"}
            ids, whole = b.column("ids")[i].values, {c: np.frombuffer(r[c], np.int64) for c in ("base", "of", "bit")}
            wide = None if r["wide"] is None else np.frombuffer(r["wide"], np.float64).reshape(len(ids), r["dim"])
            slices = np.frombuffer(r["slices"], "<u8").reshape(len(whole["of"]), -(-len(ids) // 64)) if len(ids) else np.zeros((0, 0), "<u8")
            yield cls(r["shard"], r["dim"], ids, r["largest"], whole["base"], whole["of"], whole["bit"], slices, wide)

    def values(self, rows: np.ndarray) -> np.ndarray:
        """Whole-number components of some rows, read from the slices."""
        if self.wide is not None:
            return self.wide[rows]
        out = np.repeat(self.base[None, :], len(rows), 0)
        bits = (self.slices[:, rows >> 6] >> (rows & 63).astype(np.uint64) & np.uint64(1)).astype(np.int64)
        np.add.at(out, (slice(None), self.of), (bits << self.bit[:, None]).T)
        return out.astype(np.float64)


def signed_powers(w: np.ndarray) -> np.ndarray:
    """Digits -1, 0 and 1 of each number (non-adjacent form): row c has those of 2^c."""
    out, w = [], w.copy()
    while w.any():
        digit = np.where(w & 1, 2 - (w & 3), 0)
        out.append(digit)
        w = (w - digit) >> 1
    return np.array(out, np.int64).reshape(len(out), len(w))


def added(slices: np.ndarray, flipped: np.ndarray, columns: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Bit slices of the sum: column p holds (plain, complemented) slices that count 2^p a set bit."""
    out, carries, p = [], [], 0
    while p < len(columns) or carries:
        own = [slices[columns[p][0]], flipped[columns[p][1]]] if p < len(columns) else []
        col, carries = np.concatenate([*own, *carries]), []
        while len(col) > 1:
            m = len(col) // 3
            if m:
                a, b, c = col[:m], col[m : 2 * m], col[2 * m : 3 * m]
                x = a ^ b
                carries.append(a & b | x & c)
                col = np.concatenate((x ^ c, col[3 * m :]))
            else:
                carries.append(col[:1] & col[1:])
                col = col[:1] ^ col[1:]
        out.append(col[0] if len(col) else np.zeros(slices.shape[1], np.uint64))
        p += 1
    return np.array(out, np.uint64).reshape(len(out), slices.shape[1])


def best_rows(total: np.ndarray, possible: np.ndarray, k: int) -> np.ndarray:
    """Places of the ``k`` largest sums among ``possible`` rows, ties by place: slices from the most significant one down."""
    sure = np.zeros_like(possible)
    n_sure = 0
    if int(np.bitwise_count(possible).sum()) <= k:
        return ones(possible)
    for s in total[::-1]:
        up = possible & s
        n = int(np.bitwise_count(up).sum())
        if n_sure + n > k:
            possible = up
        else:
            sure, n_sure, possible = sure | up, n_sure + n, possible & ~s
            if n_sure == k:
                return ones(sure)
    return np.concatenate((ones(sure), ones(possible, k - n_sure)))


class Searcher:
    """One shard, and what its queries share."""

    def __init__(self, shard: Shard):
        self.s, n = shard, len(shard.ids)
        self.flipped = ~shard.slices
        self.all = bitmaps(np.ones((1, n), np.uint8))[0] if n else np.zeros(0, "<u8")

    def search(self, w: np.ndarray, largest: float, own: int | None, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(places, scores) of the ``k`` best rows but ``own`` for components ``w`` (whole doubles)."""
        s, possible = self.s, self.all.copy()
        if own is not None:
            possible[own >> 6] &= ~np.uint64(1 << (own & 63))
        if s.wide is not None or max(largest, 1) * max(s.largest, 1) * max(s.dim, 1) * 4 >= SAFE:
            rows = ones(possible)
            whole = [int(x) for x in w.tolist()]
            score = np.array([max(LOW, min(HIGH, sum(a * int(b) for a, b in zip(whole, v, strict=True)))) for v in s.values(rows).tolist()], np.int64)
            at = np.lexsort((rows, -score.astype(object)))[:k] if len(rows) else np.zeros(0, np.int64)
            return rows[at], score[at]
        v = w.astype(np.int64)
        digits = signed_powers(v)[:, s.of]
        power, which = np.nonzero(digits)
        minus = digits[power, which] < 0
        power = power + s.bit[which]
        columns = [(which[(power == p) & ~minus], which[(power == p) & minus]) for p in range(int(power.max(initial=-1)) + 1)]
        total = added(s.slices, self.flipped, columns)
        rows = best_rows(total, possible, k)
        score = np.full(len(rows), int(v @ s.base) - sum(int(m) << p for p, m in enumerate(np.bincount(power[minus]).tolist())), np.int64)
        for p, t in enumerate(total):
            score += (t[rows >> 6] >> (rows & 63).astype(np.uint64) & np.uint64(1)).astype(np.int64) << p
        return rows, score


def index(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """The shards of all vectors, written once to the shared folder."""
    x = vectors.select(F.col(key).cast("long").alias("id"), F.col(vector).alias("v"))
    n, cores = x.count(), vectors.sparkSession.sparkContext.defaultParallelism
    rows = min(MOST_ROWS, max(LEAST_ROWS, -(-n // (2 * cores))))

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, size, parts, held = [], [], [], 0

        def out():
            all_ids, n, x = pa.concat_arrays(ids), np.concatenate(size), np.concatenate(parts)
            at = np.cumsum(n) - n
            for dim in np.unique(n).tolist():
                mine = np.flatnonzero(n == dim)
                mine = mine[pa.compute.sort_indices(all_ids.take(pa.array(mine))).to_numpy()]  # null ids come last
                yield Shard.of_values(all_ids.take(pa.array(mine)), x[at[mine][:, None] + np.arange(dim)].reshape(len(mine), dim)).row()

        for b in batches:
            keep, n, x = quantised(b.column("v"))
            ids.append(b.column("id").take(pa.array(keep)).cast(pa.int64()))
            size.append(n)
            parts.append(x)
            held += len(keep)
            if held >= rows:
                yield from out()
                ids, size, parts, held = [], [], [], 0
        if held:
            yield from out()
        release()

    return materialise(x.repartition(max(1, -(-n // rows))).mapInArrow(build, SHARD_DDL))


QUERY = pa.schema([("shard", pa.int64()), ("dim", pa.int32()), ("n", pa.int32()), ("places", pa.binary()), ("ids", pa.binary()), ("values", pa.binary())])


def queries_of(shards: DataFrame, modulus: int) -> DataFrame:
    """Rows whose id is divisible by ``modulus``, a row a shard, with their places there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for s in Shard.read(b):
                known = s.ids.is_valid().to_numpy(zero_copy_only=False)
                ids = s.ids.fill_null(1).to_numpy()
                rows = np.flatnonzero(known & (ids % modulus == 0))
                per = max(1, BLOCK_BYTES // (16 + 8 * s.dim))
                for i in range(0, len(rows), per):
                    r = rows[i : i + per]
                    yield batch_of({"shard": [s.shard], "dim": [s.dim], "n": [len(r)], "places": [r.tobytes()], "ids": [ids[r].tobytes()], "values": [s.values(r).tobytes()]}, QUERY)

    return materialise(shards.mapInArrow(run, "shard long, dim int, n int, places binary, ids binary, values binary"))


def search_block(shards: DataFrame, block: list[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]], k: int) -> DataFrame:
    """(query_id, rank, vec_id, score) of a block: (shard, dim, places, ids, values) of several shards' queries."""
    start = np.cumsum([0] + [len(b[2]) for b in block])
    schema = pa.schema([("query", pa.int64()), ("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])
    ids = np.concatenate([b[3] for b in block])

    def merged(held):
        q, vec, null, score = map(np.concatenate, zip(*held, strict=True))
        order = np.lexsort((vec, null, ~score, q))  # ~score falls as score grows, at the least long too
        rank = np.arange(len(q)) - np.searchsorted(q[order], q[order])
        order = order[rank < k]
        return q[order], vec[order], null[order], score[order]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, waiting = [], 0
        for b in batches:
            for s in Shard.read(b):
                at, null = Searcher(s), s.ids.is_null().to_numpy(zero_copy_only=False)
                vec = s.ids.fill_null(0).to_numpy()
                for first, (shard, dim, places, _, values) in zip(start.tolist(), block, strict=False):
                    if dim != s.dim:
                        continue
                    for i, place in enumerate(places.tolist()):
                        rows, score = at.search(values[i], float(np.abs(values[i]).max(initial=0)), place if shard == s.shard else None, k)
                        held.append((np.full(len(rows), first + i), vec[rows], null[rows], score))
                        waiting += len(rows)
                    if waiting >= WAITING:
                        held = [merged(held)]
                        waiting = len(held[0][0])
        if held:
            q, vec, null, score = merged(held)
            yield batch_of({"query": q, "query_id": ids[q], "vec_id": pa.array(vec, mask=null), "score": score}, schema)
        release()

    got = shards.mapInArrow(run, "query long, query_id long, vec_id long, score long")
    w = Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"))
    return got.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def top_k(vectors: DataFrame, k: int = 5, modulus: int = 50, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """For each row whose id is divisible by ``modulus`` the ``k`` other rows of highest inner product:
    query_id, rank from 1, vec_id, score."""
    shards = index(vectors, key, vector)
    asked = queries_of(shards, modulus)
    parts = [(r["shard"], r["places"], r["n"] * (16 + 8 * r["dim"])) for r in asked.select("shard", F.sha1("places").alias("places"), "n", "dim").orderBy("shard", "places").collect()]  # a short row a shard
    groups, size = [], BLOCK_BYTES
    for shard, places, n in parts:
        if size + n > BLOCK_BYTES:
            groups.append([])
            size = 0
        groups[-1].append((shard, places))
        size += n
    out = None
    for i, group in enumerate(groups):
        wanted = F.array(*[F.struct(F.lit(s).alias("shard"), F.lit(p).alias("places")) for s, p in group])
        rows = asked.where(F.array_contains(wanted, F.struct("shard", F.sha1("places").alias("places")))).collect()  # BLOCK_BYTES at most
        block = [(r["shard"], r["dim"], np.frombuffer(r["places"], np.int64), np.frombuffer(r["ids"], np.int64), np.frombuffer(r["values"], np.float64).reshape(r["n"], r["dim"])) for r in sorted(rows, key=lambda r: (r["shard"], bytes(r["places"])))]
        got = search_block(shards, block, k)
        if i == 1:
            out = materialise(out)
        out = got if out is None else out.unionByName(materialise(got))
    return out if out is not None else vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")


def op12_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"))
