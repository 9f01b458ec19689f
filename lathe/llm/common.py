"""Shared plumbing of the training-data operators.

Everything here is independent of where the data sits: inputs are read only through
Spark's readers, intermediate tables go to the shared folder that the session names in
``spark.checkpoint.dir``, and no state lives on an executor's own disk.
"""

from __future__ import annotations

import atexit
import ctypes
import functools
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

K1 = np.uint64(0x9E3779B97F4A7C15)
K2 = np.uint64(0xBF58476D1CE4E5B9)
K3 = np.uint64(0x94D049BB133111EB)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession, rows: int = 500) -> None:
    """Bound what one Arrow batch of whole texts can hold on an executor."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(4 << 20))


def release() -> None:
    """Give memory that is free back to the system: a worker's next task may need it in another process."""
    pa.default_memory_pool().release_unused()
    if _LIBC is not None:
        _LIBC.malloc_trim(0)


try:
    _LIBC = ctypes.CDLL("libc.so.6")
    _LIBC.malloc_trim  # noqa: B018
except (OSError, AttributeError):  # another C library
    _LIBC = None


def settle(spark: SparkSession) -> None:
    """Have every executor collect its garbage now, so that heap that is free goes back to the system.

    An executor's limit counts its Python workers beside the JVM, which keeps what heap an
    earlier stage needed. One short task a core, which takes no data."""
    n = spark.sparkContext.defaultParallelism
    spark.range(0, n, 1, n).select(F.expr("java_method('java.lang.System', 'gc')")).write.format("noop").mode("overwrite").save()


def gathered(batches: Iterator[pa.RecordBatch], rows: int = 4096, size: int = 6 << 20) -> Iterator[pa.RecordBatch]:
    """Batches put together to about ``rows`` rows or ``size`` bytes, for work that pays per batch."""
    held, n, total = [], 0, 0
    for b in batches:
        held.append(b)
        n, total = n + b.num_rows, total + b.nbytes
        if n >= rows or total >= size:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
            held, n, total = [], 0, 0
    if n:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


@functools.cache
def _own_folder() -> str:
    folder = tempfile.mkdtemp(prefix="lathe-")
    atexit.register(shutil.rmtree, folder, True)
    return f"file://{folder}"


def scratch_root(spark: SparkSession) -> str:
    """The shared folder for intermediate tables, ``spark.checkpoint.dir``. Where none is set: a folder
    of this process, if driver and executors are this one process, and else one below the
    session's warehouse, which a cluster shares as managed tables need it to."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        master = spark.conf.get("spark.master", "")
        alone = master == "local" or master.startswith("local[")
        root = _own_folder() if alone else spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/lathe-scratch"
    return root.rstrip("/")


def materialise(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the shared folder and continue from the written table.

    Lineage is cut, columns can be pruned on rereading, and a lost executor costs nothing
    that was written before.
    """
    spark = df.sparkSession
    path = f"{scratch_root(spark)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Fixed value: the separator class of a word, ``[^\x20\x09-\x0D]+`` being a word.
_IS_BLANK = np.isin(np.arange(256), [32, 9, 10, 11, 12, 13])
_LOWERED = np.array([c + 32 * (65 <= c <= 90) for c in range(256)], np.uint8)
#: The low 0 to 8 bytes of a number.
_LOW_BYTES = np.array([(1 << 8 * i) - 1 for i in range(9)], np.uint64)
#: Words of more bytes than this are hashed one by one.
_LONG = 64


def bytes_of(texts: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts (null: empty) and eight zero bytes; where each text begins, and the end."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if not len(texts):
        return np.zeros(8, np.uint8), np.zeros(1, np.int64)
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    _, offsets, body = texts.buffers()
    at = np.frombuffer(offsets, np.int64, len(texts) + 1, 8 * texts.offset)
    data = np.zeros(at[-1] - at[0] + 8, np.uint8)
    if at[-1] > at[0]:
        data[:-8] = np.frombuffer(body, np.uint8)[at[0] : at[-1]]
    return data, at - at[0]


def hash_ranges(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte ranges; eight bytes must follow the last one. Ranges of eight bytes at
    most that differ in content and not in length never collide."""
    n = end - start
    word = np.ndarray((max(len(data) - 7, 0),), "<u8", data.data, 0, (1,))
    h = mix(n.astype(np.uint64) * K1 ^ (word[start] & _LOW_BYTES[np.minimum(n, 8)]))
    at, k = np.flatnonzero((n > 8) & (n <= _LONG)), 8
    while len(at):
        h[at] = mix(h[at] * K2 ^ (word[start[at] + k] & _LOW_BYTES[np.minimum(n[at] - k, 8)]))
        k += 8
        at = at[n[at] > k]
    for i in np.flatnonzero(n > _LONG).tolist():
        h[i] = xxhash.xxh3_64_intdigest(data[start[i] : end[i]])
    return h


class WordTable:
    """The words ``[^\\x20\\x09-\\x0D]+`` of many texts as byte ranges, without an object a word.

    ``cut`` are the texts' places among all words: text i has words cut[i] to cut[i + 1]."""

    def __init__(self, texts: pa.Array | pa.ChunkedArray, lower: bool = False):
        self.data, self.at = bytes_of(texts)
        if lower:
            self.data = _LOWERED[self.data]
        inside = self.inside(self.data[:-8])
        edge = np.zeros(len(inside) + 1, bool)
        edge[self.at] = True
        first, last = inside.copy(), inside.copy()
        first[1:] &= edge[1:-1] | ~inside[:-1]
        last[:-1] &= edge[1:-1] | ~inside[1:]
        self.start, self.end = np.flatnonzero(first), np.flatnonzero(last) + 1
        self.cut = np.searchsorted(self.start, self.at)

    def inside(self, data: np.ndarray) -> np.ndarray:
        """Which bytes belong to words."""
        return ~_IS_BLANK[data]

    def hashes(self) -> np.ndarray:
        return hash_ranges(self.data, self.start, self.end)

    def places(self) -> tuple[np.ndarray, np.ndarray]:
        """Of each word its text, and how many words of the text there are from it on."""
        text = np.repeat(np.arange(len(self.cut) - 1), np.diff(self.cut))
        return text, self.cut[1:][text] - np.arange(len(text))


class WordHashes(dict):
    """word -> 64-bit hash, with a bounded cache; long words are hashed each time."""

    LIMIT = 100_000

    def __missing__(self, word: str) -> int:
        h = xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass"))
        if len(word) <= 40:
            if len(self) >= self.LIMIT:
                self.clear()
            self[word] = h
        return h

    def array(self, words: list[str]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


_HASHES = WordHashes()


def word_hashes() -> WordHashes:
    """The process's cache of word hashes; Spark reuses its Python workers from task to task."""
    return _HASHES


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (two xor-shift-multiply rounds)."""
    x = (x ^ (x >> np.uint64(30))) * K2
    x = (x ^ (x >> np.uint64(27))) * K3
    return x ^ (x >> np.uint64(31))


def chain_hash(h: np.ndarray, width: int, starts: np.ndarray | None = None) -> np.ndarray:
    """Order-sensitive hashes of ``width`` consecutive values, at ``starts`` or everywhere."""
    n = len(h) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    at = (lambda k: h[k : k + n]) if starts is None else (lambda k: h[starts + k])
    acc = at(0) * K1
    for k in range(1, width):
        acc = (acc ^ (acc >> np.uint64(29))) * K2 + at(k)
    return mix(acc)


def text_of(value: str | None) -> str:
    return value if value is not None else ""


def per_batch(make: Callable[[], Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]]]):
    """A ``mapInArrow`` function from a factory that sets up once a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = make()
        for b in batches:
            yield from f(b)
        release()

    return run


def batch_of(columns: dict[str, object], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) for f in schema], schema=schema)


def by_bucket(buckets: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(bucket, positions in their old order) of each bucket that occurs."""
    order = np.argsort(buckets, kind="stable")
    cuts = np.flatnonzero(np.diff(buckets[order])) + 1
    for part in np.split(order, cuts):
        if len(part):
            yield int(buckets[part[0]]), part


def n_groups(rows: int, per: int, least: int = 16, most: int = 1 << 20) -> int:
    """How many groups deal ``rows`` out by about ``per``: memory a task stays constant as data grow."""
    return int(min(most, max(least, -(-rows // per))))


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components by alternating large-star and small-star rounds.

    ``edges`` are pairs of long ids. Returns ``(node, component)``, component being the
    smallest id that links reach; nodes without an edge do not occur. Each round is a
    shuffle over the edges that remain, written to the shared folder; the number of rounds
    grows with the logarithm of the longest path. Nothing is collected but an edge count and
    checksum a round. A star keeps at most one edge per node, so hot nodes do not multiply.
    """
    e = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct()
    e = materialise(e)
    last = None
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m0")).select(F.col("u"), F.least("u", "m0").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        lows = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(lows, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").where("u <> v").distinct()
        e = materialise(small)
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if tuple(now) == last:
            return e.groupBy("u").agg(F.min("v").alias("component")).select(F.col("u").alias("node"), "component").unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
        last = tuple(now)
