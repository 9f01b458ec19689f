"""Token-id files: canonical length-limited Huffman codes in independent blocks.

Format. A folder has two Parquet tables, so any store that Spark writes to will do:

* ``codes``: one row, the code length of every id from 0 up (one byte each, 0: unused);
* ``segments``: rows (part, seq, n_ids, body) in ascending doc_id order by (part, seq). A body
  is, little-endian: magic ``LTHT``, block length u32, documents u32, ids u64, words u64; then
  doc_ids i64, whether they are known (one byte each; 0: null) and ids per document u64; the
  bit offset of each block's start u64 (the checkpoints); and the bit stream as u64 words, most
  significant bit first.

Code lengths come from global counts by package-merge (optimal for the limit), codes are
canonical: by length, then id. Decoding looks the next bits up in one table and advances all
blocks of a segment together, each from its own checkpoint.

Null and empty texts have the end id alone. A null doc_id comes before all others and is read
back as null. Rows of one doc_id follow each other by text.
"""

from __future__ import annotations

import struct
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import batch_of, gathered, materialise, n_groups, release, scratch_root, small_batches, table
from .tokens import default_path, encoder

MAGIC, BLOCK, SEGMENT, LIMIT = b"LTHT", 1024, 1 << 21, 18


def code_lengths(counts: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """Lengths of an optimal prefix code of at most ``limit`` bits (package-merge)."""
    out = np.zeros(len(counts), np.uint8)
    used = np.flatnonzero(counts)
    if len(used) < 2:
        out[used] = 1
        return out
    limit = max(limit, (len(used) - 1).bit_length())
    order = used[np.argsort(counts[used], kind="stable")]
    leaf = counts[order].astype(np.int64)
    value, kinds = leaf, [np.ones(len(leaf), bool)]
    for _ in range(limit - 1):
        packed = value[: len(value) // 2 * 2].reshape(-1, 2).sum(1)
        both = np.concatenate((leaf, packed))
        by = np.argsort(both, kind="stable")
        value = both[by]
        kinds.append(by < len(leaf))
    take, length = 2 * len(leaf) - 2, np.zeros(len(leaf), np.int64)
    for kind in reversed(kinds):
        leaves = int(kind[:take].sum())
        length[:leaves] += 1
        take = 2 * (take - leaves)
    out[order] = length
    return out


@dataclass
class Code:
    """Canonical codes, and the decoder's table: id in the low 24 bits, length above."""

    lengths: np.ndarray

    def __post_init__(self):
        used = np.flatnonzero(self.lengths)
        order = used[np.lexsort((used, self.lengths[used]))]
        n = self.lengths[order].astype(np.int64)
        self.bits = int(n.max()) if len(n) else 1
        width = np.int64(1) << (self.bits - n)
        first = np.concatenate(([0], np.cumsum(width)))[:-1] if len(n) else np.zeros(0, np.int64)
        self.left = np.zeros(len(self.lengths), np.uint64)  # codes at the top of 64 bits
        self.left[order] = first.astype(np.uint64) << np.uint64(64 - self.bits)
        self.table = np.zeros(1 << self.bits, np.uint32)
        full = np.repeat((order | (n << 24)).astype(np.uint32), width)
        self.table[: len(full)] = full

    def encode(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(bit offsets of the blocks, 64-bit words)."""
        n = self.lengths[ids]
        end = np.cumsum(n, dtype=np.int64)
        at = end - n
        words = np.zeros((int(end[-1]) if len(ids) else 0) // 64 + 2, np.uint64)
        if len(ids):
            w, off = at >> 6, (at & 63).astype(np.uint64)
            code = self.left[ids]
            starts = np.flatnonzero(np.concatenate(([True], w[1:] != w[:-1])))
            words[w[starts]] = np.bitwise_or.reduceat(code >> off, starts)
            over = np.flatnonzero((end - 1) >> 6 != w)
            words[w[over] + 1] |= code[over] << (np.uint64(64) - off[over])
        return at[::BLOCK].astype(np.uint64), words

    def decode(self, n: int, offsets: np.ndarray, words: np.ndarray) -> np.ndarray:
        """``n`` ids; all blocks advance together. A step needs the next ``bits`` (at most 32) bits."""
        half = np.concatenate((words, np.zeros(BLOCK * self.bits // 64 + 2, np.uint64))).astype(">u8").view(">u4").astype(np.uint64)
        wide = half[:-1] << np.uint64(32) | half[1:]  # 64 bits from every 32nd on
        out = np.empty((BLOCK, len(offsets)), np.uint32)
        at, shift = offsets.astype(np.int64), np.uint64(64 - self.bits)
        for i in range(min(BLOCK, n)):
            hit = self.table[wide[at >> 5] << (at & 31).view(np.uint64) >> shift]
            out[i] = hit
            at += hit >> 24
        out &= 0xFFFFFF
        return out.T.reshape(-1)[:n]


HEAD = "<4sIIQQ"


def write_body(code: Code, names: list[int | None], sizes: np.ndarray, ids: np.ndarray) -> bytes:
    offsets, words = code.encode(ids)
    doc_ids, known = np.array([d or 0 for d in names], "<i8"), np.array([d is not None for d in names], np.uint8)
    return b"".join((struct.pack(HEAD, MAGIC, BLOCK, len(names), len(ids), len(words)), doc_ids.tobytes(), known.tobytes(), sizes.astype("<u8").tobytes(), offsets.astype("<u8").tobytes(), words.astype("<u8").tobytes()))


def read_body(code: Code, body: bytes) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(doc_ids, ids per document, ids)."""
    magic, block, docs, n, words = struct.unpack_from(HEAD, body)
    assert magic == MAGIC and block == BLOCK, "not a segment of this format"
    at, parts = struct.calcsize(HEAD), []
    for kind, size in (("<i8", docs), ("u1", docs), ("<u8", docs), ("<u8", -(-n // BLOCK)), ("<u8", words)):
        parts.append(np.frombuffer(body, kind, size, at))
        at += parts[-1].nbytes
    return pa.array(parts[0], mask=parts[1] == 0), parts[2].astype(np.int64), code.decode(n, parts[3], parts[4].astype(np.uint64))


def planes(ids: np.ndarray) -> bytes:
    """Ids byte by byte, as many bytes as the largest takes, compressed: how they wait for the global code."""
    width = max(1, (int(ids.max(initial=0)).bit_length() + 7) // 8)
    flat = np.ascontiguousarray(ids.astype("<u4").view(np.uint8).reshape(-1, 4)[:, :width].T)
    return bytes([width]) + pa.compress(flat.tobytes(), codec="zstd", asbytes=True)


def from_planes(data: bytes, n: int) -> np.ndarray:
    width = data[0]
    flat = np.frombuffer(pa.decompress(memoryview(data)[1:], width * n, codec="zstd", asbytes=True), np.uint8)
    out = np.zeros((n, 4), np.uint8)
    out[:, :width] = flat.reshape(width, n).T
    return out.reshape(-1).view("<u4")


def write_ids(docs: DataFrame, folder: str, tokenizer: str | None = None) -> None:
    """Write the ids of ``docs`` (doc_id, text) to ``folder``. Counts of at most the tokenizer's
    vocabulary reach the driver."""
    tokenizer = tokenizer or default_path()
    spark = docs.sparkSession
    raw_schema = pa.schema([("part", pa.int32()), ("seq", pa.int32()), ("names", pa.list_(pa.int64())), ("sizes", pa.binary()), ("ids", pa.binary()), ("used", pa.binary()), ("counts", pa.binary())])

    def encode(batches):
        enc, part = encoder(tokenizer), TaskContext.get().partitionId()
        held, sizes, names, n, seq = [], [], [], 0, 0

        def out():
            ids = np.concatenate(held)
            counts = np.bincount(ids)
            used = np.flatnonzero(counts)
            row = {"part": part, "seq": seq, "names": pa.concat_arrays(names).cast(pa.int64()), "sizes": np.concatenate(sizes).tobytes(), "ids": planes(ids), "used": used.tobytes(), "counts": counts[used].tobytes()}
            return batch_of({k: [v.to_pylist() if k == "names" else v] for k, v in row.items()}, raw_schema)

        for b in gathered(batches):
            got, size = enc.batch(b.column("text"))
            held.append(got)
            sizes.append(size)
            names.append(b.column("doc_id"))
            n += len(got)
            if n >= SEGMENT:
                yield out()
                held, sizes, names, n, seq = [], [], [], 0, seq + 1
        if n:
            yield out()
        release()

    ranges = n_groups(docs.count(), 4000, 8)
    in_order = docs.select("doc_id", "text").repartitionByRange(ranges, "doc_id").sortWithinPartitions("doc_id", "text")
    raw = materialise(in_order.mapInArrow(encode, "part int, seq int, names array<long>, sizes binary, ids binary, used binary, counts binary"))
    count_schema = pa.schema([("id", pa.int64()), ("n", pa.int64())])

    def count(batches):
        total = np.zeros(0, np.int64)
        for b in batches:
            for used, n in zip(b.column("used").to_pylist(), b.column("counts").to_pylist(), strict=True):
                used, n = np.frombuffer(used, np.int64), np.frombuffer(n, np.int64)
                if len(used) and used[-1] >= len(total):
                    total = np.concatenate((total, np.zeros(used[-1] + 1 - len(total), np.int64)))
                total[used] += n
        used = np.flatnonzero(total)
        yield batch_of({"id": used, "n": total[used]}, count_schema)

    got = raw.select("used", "counts").mapInArrow(count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros(max((r["id"] for r in got), default=0) + 1, np.int64)
    for r in got:
        counts[r["id"]] = r["n"]
    lengths = code_lengths(counts)
    spark.createDataFrame([(bytearray(lengths.tobytes()),)], "lengths binary").coalesce(1).write.parquet(f"{folder}/codes")
    schema = pa.schema([("part", pa.int32()), ("seq", pa.int32()), ("n_ids", pa.int64()), ("body", pa.binary())])

    def write(batches):
        code = Code(lengths)
        for b in batches:
            for part, seq, names, sizes, ids in zip(*(b.column(c).to_pylist() for c in ("part", "seq", "names", "sizes", "ids")), strict=True):
                sizes = np.frombuffer(sizes, np.int64)
                ids = from_planes(ids, int(sizes.sum()))
                yield batch_of({"part": [part], "seq": [seq], "n_ids": [len(ids)], "body": [write_body(code, names, sizes, ids)]}, schema)

    raw.select("part", "seq", "names", "sizes", "ids").mapInArrow(write, "part int, seq int, n_ids long, body binary").write.parquet(f"{folder}/segments")


def read_ids(spark: SparkSession, folder: str, with_ids: bool = True) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32[, ids]) of each document, from the files alone."""
    lengths = np.frombuffer(bytes(spark.read.parquet(f"{folder}/codes").first()["lengths"]), np.uint8)
    fields = [("doc_id", pa.int64()), ("part", pa.int32()), ("seq", pa.int32()), ("at", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64()), ("ids", pa.list_(pa.int32()))]
    schema = pa.schema(fields if with_ids else fields[:-1])

    def read(batches):
        code = Code(lengths)
        for b in batches:
            for part, seq, body in zip(*(b.column(c).to_pylist() for c in ("part", "seq", "body")), strict=True):
                names, sizes, ids = read_body(code, body)
                cut = np.concatenate(([0], np.cumsum(sizes)))
                flat = memoryview(np.ascontiguousarray(ids, "<u4").view(np.uint8))
                crc = [zlib.crc32(flat[4 * x : 4 * y]) for x, y in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)]
                cols = {"doc_id": names, "part": np.full(len(sizes), part, np.int32), "seq": np.full(len(sizes), seq, np.int32), "at": cut[:-1], "n_tokens": sizes, "ids_crc32": crc}
                yield batch_of(cols | ({"ids": pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.array(ids.view(np.int32)))} if with_ids else {}), schema)

    ddl = "doc_id long, part int, seq int, at long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids
    segments = spark.read.parquet(f"{folder}/segments")
    sizes = segments.select("part", "seq", "n_ids")
    parts = sizes.groupBy("part").agg(F.sum("n_ids").alias("all"))  # one row a range, not a document
    parts = parts.select("part", (F.sum("all").over(Window.orderBy("part")) - F.col("all")).alias("before"))
    w = Window.partitionBy("part").orderBy("seq")
    base = sizes.join(parts, "part").select("part", "seq", (F.col("before") + F.sum("n_ids").over(w) - F.col("n_ids")).alias("base"))
    got = segments.select("part", "seq", "body").mapInArrow(read, ddl).join(base, ["part", "seq"])
    return got.select("doc_id", (F.col("base") + F.col("at")).alias("start"), "n_tokens", "ids_crc32", *(["ids"] if with_ids else []))


def op10_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    import uuid

    small_batches(spark)
    folder = f"{scratch_root(spark)}/ids-{uuid.uuid4().hex}"
    write_ids(table(spark, sf_dir, "documents").select("doc_id", "text"), folder)
    return read_ids(spark, folder, with_ids=False)
