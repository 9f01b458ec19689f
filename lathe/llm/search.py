"""Ranked lexical search with integer scores over document-sharded postings.

Some megabytes of documents are one shard: a row that holds their ids, the distinct terms with the
ends of their posting lists (CSR), and the lists themselves, a document's place and the term's
*impact* there, an integer that is ready once the corpus' size is known. The index is written once to
the shared folder. A block of queries (bounded in rows and bytes) is searched at a time: one pass over
the shards' terms counts document frequencies, one over the postings adds weight times impact, term
at a time, to a dense accumulator of the shard, takes the k highest by argpartition (all that tie
with the last are kept until document ids decide) and merges the shards of a task; Spark
merges the tasks. Work is shards times queries, memory one shard and one block.

Terms are compared by their bytes. Null, empty and blank texts have no terms: such documents count
nowhere, such queries find nothing. Every row is a document, and every row a query: equal rows
rank one after the other, rows of one item_id are searched each for itself. Equal scores go by
ascending doc_id, null last. Further columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WordTable, batch_of, gathered, materialise, release, small_batches, table
from .packs import _write as packed
from .packs import read_pack as unpacked

#: Fixed value: a term is a run of the bytes outside [\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F].
_IN_TERM = np.array([c >= 128 or chr(c).isalnum() for c in range(256)])
#: A shard ends with the batch that reaches one of these; bounds of a block of queries.
SHARD_ROWS, SHARD_BYTES = 16_384, 8 << 20
BLOCK_ROWS, BLOCK_BYTES = 1024, 4 << 20
#: Merged in a task when so many candidates wait.
WAITING = 1 << 20

SHARD = pa.schema([("shard", pa.int64()), ("terms", pa.binary()), ("postings", pa.binary()), ("docs", pa.binary())])


class Terms(WordTable):
    def __init__(self, texts: pa.Array | pa.ChunkedArray):
        super().__init__(texts, lower=True)

    def inside(self, data: np.ndarray) -> np.ndarray:
        return _IN_TERM[data]

    def values(self) -> pa.Array:
        at = np.concatenate(([0], np.cumsum(self.end - self.start)))
        body = self.data[:-8][self.inside(self.data[:-8])]
        return pa.Array.from_buffers(pa.large_string(), len(self.start), [None, pa.py_buffer(at), pa.py_buffer(body)])


def corpus_size(docs: DataFrame) -> tuple[int, int]:
    """(documents with a term, terms of all documents)."""
    schema = pa.schema([("n", pa.int64()), ("all", pa.int64())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = total = 0
        for b in batches:
            size = np.diff(Terms(b.column(0)).cut)
            n, total = n + int((size > 0).sum()), total + int(size.sum())
        yield batch_of({"n": [n], "all": [total]}, schema)
        release()

    got = docs.select("text").mapInArrow(count, "n long, all long").agg(F.sum("n"), F.sum("all")).first()
    return got[0] or 0, got[1] or 0


def shard_of(docs: pa.Table, n_docs: int, n_terms: int) -> pa.RecordBatch | None:
    """The shard of documents (doc_id, text), given the corpus' N and L."""
    docs = docs.sort_by("doc_id")  # nulls come last; places then decide ties
    terms = Terms(docs.column("text"))
    if not len(terms.start):
        return None
    coded = terms.values().dictionary_encode()
    size = np.diff(terms.cut)
    rows = docs.num_rows
    key, tf = np.unique(coded.indices.to_numpy().astype(np.int64) * rows + np.repeat(np.arange(rows), size), return_counts=True)
    term, place = np.divmod(key, rows)
    n = size.astype(object) if 50 * int(size.max()) * n_docs >= 1 << 63 else size  # whole numbers of any size
    m = (100 - 50 + 50 * n * n_docs // n_terms).astype(np.int64)
    impact = 1_000_000_000 * tf // (1000 * tf + 20 * m[place])
    ends = np.cumsum(np.bincount(term, minlength=len(coded.dictionary)))
    row = {
        "shard": [uuid.uuid4().int >> 65],
        "terms": [packed(pa.table({"term": coded.dictionary, "end": ends}))],
        "postings": [packed(pa.table({"place": place.astype(np.uint32), "impact": impact.astype(np.int32)}))],
        "docs": [packed(docs.select(["doc_id"]))],
    }
    return batch_of(row, SHARD)


def index(docs: DataFrame) -> tuple[DataFrame, int]:
    """The shards of all documents (doc_id, text), written once, and the number of documents with a term."""
    n_docs, n_terms = corpus_size(docs)

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in gathered(batches, SHARD_ROWS, SHARD_BYTES):
            if (got := shard_of(pa.Table.from_batches([b]), n_docs, n_terms)) is not None:
                yield got
        release()

    return materialise(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(build, "shard long, terms binary, postings binary, docs binary")), n_docs


def blocks(queries: DataFrame, *columns: str) -> Iterator[pa.Table]:
    """The rows of ``queries`` in blocks of at most BLOCK_ROWS rows and about BLOCK_BYTES (a longer row
    is a block of its own); the driver holds one block at a time."""
    x = queries.select(*columns)
    size = x.agg(F.count("*"), F.sum(F.octet_length(F.col(columns[-1])))).first()
    n = max(1, -(-size[0] // BLOCK_ROWS), -(-(size[1] or 0) // BLOCK_BYTES))
    schema = pa.schema([("block", pa.string()), ("body", pa.binary())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in gathered((y for b in batches for y in (b.slice(i, 16) for i in range(0, b.num_rows, 16))), BLOCK_ROWS, BLOCK_BYTES):
            yield batch_of({"block": [uuid.uuid4().hex], "body": [packed(pa.Table.from_batches([b]))]}, schema)

    cut_up = materialise(x.repartition(n).mapInArrow(cut, "block string, body binary"))
    for r in cut_up.select("block").orderBy("block").collect():  # one short name a block
        yield unpacked(cut_up.where(F.col("block") == r["block"]).first()["body"])


def frequencies(shards: DataFrame, terms: pa.Array) -> np.ndarray:
    """How many documents hold each of ``terms`` (those of one block)."""
    schema = pa.schema([("term", pa.int64()), ("n", pa.int64())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(len(terms), np.int64)
        for b in batches:
            for body in b.column(0).to_pylist():
                t = unpacked(body)
                size = np.diff(t.column("end").to_numpy(), prepend=0)
                at = pc.fill_null(pc.index_in(terms, value_set=t.column("term").combine_chunks()), -1).to_numpy()
                df += np.where(at >= 0, size[at], 0)
        used = np.flatnonzero(df)
        yield batch_of({"term": used, "n": df[used]}, schema)

    out = np.zeros(len(terms), np.int64)
    for r in shards.select("terms").mapInArrow(count, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect():
        out[r["term"]] = r["n"]
    return out


def highest(score: np.ndarray, k: int) -> np.ndarray:
    """Places of the ``k`` highest scores above 0, ties by place; in order of place."""
    hit = np.flatnonzero(score > 0)
    if len(hit) <= k:
        return hit
    s = score[hit]
    least = s[np.argpartition(s, len(s) - k)[len(s) - k]]
    sure, tied = hit[s > least], hit[s == least]
    return np.sort(np.concatenate((sure, tied[: k - len(sure)])))


def merged(query: np.ndarray, doc: np.ndarray, null: np.ndarray, score: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
    """The ``k`` best of each query among candidates of several shards."""
    order = np.lexsort((doc, null, -score, query))
    q = query[order]
    rank = np.arange(len(q)) - np.searchsorted(q, q)
    order = order[rank < k]
    return query[order], doc[order], null[order], score[order]


def search_block(shards: DataFrame, block: pa.Table, n_docs: int, k: int) -> DataFrame:
    """(item_id, rank, doc_id, score) of one block's queries."""
    words = Terms(block.column("text"))
    coded = words.values().dictionary_encode()
    terms, which = coded.dictionary, coded.indices.to_numpy()
    of = np.unique(np.repeat(np.arange(block.num_rows), np.diff(words.cut)).astype(np.int64) * max(len(terms), 1) + which)
    query, term = np.divmod(of, max(len(terms), 1))
    cut = np.searchsorted(query, np.arange(block.num_rows + 1))
    weight = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * int(df) + 1))) for df in frequencies(shards, terms)], np.int64)
    items = block.column("item_id").combine_chunks()
    schema = pa.schema([("query", pa.int64()), ("item_id", items.type), ("doc_id", pa.int64()), ("score", pa.int64())])

    def one(t: pa.Table, postings: pa.Table, docs: pa.Table) -> tuple[np.ndarray, ...]:
        end = t.column("end").to_numpy()
        at = pc.fill_null(pc.index_in(terms, value_set=t.column("term").combine_chunks()), -1).to_numpy()
        place, impact = postings.column("place").to_numpy(), postings.column("impact").to_numpy()
        lists = {}
        for i in np.flatnonzero((at >= 0) & (weight > 0)).tolist():
            x, y = (int(end[at[i] - 1]) if at[i] else 0), int(end[at[i]])
            lists[i] = place[x:y], weight[i] * impact[x:y].astype(np.int64)
        got, scores = [], []
        for q in range(block.num_rows):
            acc = np.zeros(docs.num_rows, np.int64)
            for i in term[cut[q] : cut[q + 1]].tolist():
                if i in lists:
                    where, add = lists[i]
                    acc[where] += add
            best = highest(acc, k)
            got.append(best)
            scores.append(acc[best])
        n = np.array([len(g) for g in got])
        ids = docs.column("doc_id").combine_chunks()
        best = np.concatenate(got) if got else np.zeros(0, np.int64)
        null = ids.is_null().to_numpy(zero_copy_only=False)[best]
        return np.repeat(np.arange(block.num_rows), n), pc.fill_null(ids, 0).to_numpy()[best], null, np.concatenate(scores) if scores else best

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, waiting = [], 0
        for b in batches:
            for x in zip(*(b.column(c).to_pylist() for c in ("terms", "postings", "docs")), strict=True):
                held.append(one(*map(unpacked, x)))
                waiting += len(held[-1][0])
                if waiting >= WAITING:
                    held = [merged(*map(np.concatenate, zip(*held, strict=True)), k)]
                    waiting = len(held[0][0])
        if held:
            q, doc, null, score = merged(*map(np.concatenate, zip(*held, strict=True)), k)
            yield batch_of({"query": q, "item_id": items.take(pa.array(q)), "doc_id": pa.array(doc, mask=null), "score": score}, schema)
        release()

    from pyspark.sql.pandas.types import from_arrow_schema

    got = shards.select("terms", "postings", "docs").mapInArrow(run, from_arrow_schema(schema))
    w = Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return got.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


def search(docs: DataFrame, queries: DataFrame, k: int = 50) -> DataFrame:
    """For each row of ``queries`` (item_id, text) the ``k`` best of ``docs`` (doc_id, text): item_id, rank
    from 1, doc_id, score."""
    shards, n_docs = index(docs)
    out = None
    for i, block in enumerate(blocks(queries, "item_id", "text")):
        got = search_block(shards, block, n_docs, k)
        if i == 1:
            out = materialise(out)
        out = got if out is None else out.unionByName(materialise(got))
    if out is None:
        kind = queries.schema["item_id"].dataType.simpleString()
        out = docs.sparkSession.createDataFrame([], f"item_id {kind}, rank int, doc_id long, score long")
    return out


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), 50)
