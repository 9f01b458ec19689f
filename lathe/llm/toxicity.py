"""Toxicity by the nearest labelled examples, found with a block-max inverted index.

* ``fit`` takes at most ``max_positive`` + ``max_negative`` labelled rows (the documented
  bound; which ones is decided by a hash of the id alone) and lays the TF-IDF vectors of all
  their terms out as postings, the examples being ordered by likeness and cut into blocks.
  Document frequencies are those of *all* documents. A term rarer than one document in ``FLOOR``
  has the inverse frequency of one that is as rare as that, so the frequencies that must be
  known are those of at most ``FLOOR`` times the terms of a mean document, at any size.
  A weight is TF-IDF times 1 + sqrt(g), g being the log-likelihood ratio of the term's classes
  among the examples (0 for terms that none has): no term is left out, telling ones weigh more.
* ``score`` finds for every document the exact ``k`` nearest examples by the cosine of the full
  vectors; terms that no example has count in the document's norm. The short postings of rare
  terms are read whole; a common term has its largest weight in each block. Both together
  bound the cosines of a block: the most promising one is opened first, and after it only
  those whose bound reaches the k-th best cosine. Votes are weighted by similarity and by the
  classes' sampling rates, then calibrated by a logistic curve fitted to leave-one-out votes.

Terms are runs of lower-cased ASCII letters and other non-ASCII characters than Latin-1 signs and
general or CJK punctuation, known by 64-bit digests. Null and empty texts, and texts that share no
term with an example, get the rate of labelled rows without terms. Repeated rows get equal scores.
An empty label table gives the score 0.0 everywhere. Only the text enters a score.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WordTable, batch_of, per_batch, release, small_batches, table

UNIT = float(1 << 26)
FLOOR = 1 << 14
#: Examples a block; blocks opened at first; documents compared at once; terms of more than one in ``COMMON`` examples are common ones.
BLOCK, FIRST, BATCH, COMMON = 128, 2, 128, 16
#: Terms of an example that decide its place in the order.
HEAVY = 64

_LETTER = np.array([97 <= c <= 122 or c >= 128 and c != 0xC2 for c in range(256)])


class TermTable(WordTable):
    """The terms of many texts."""

    def __init__(self, texts: pa.Array | pa.ChunkedArray):
        super().__init__(pc.utf8_lower(texts))

    def inside(self, data):
        out = _LETTER[data]
        lead = np.flatnonzero(data >= 0xC2)
        nxt = self.data[lead + 1]
        kind = data[lead]
        two = lead[(kind == 0xC2) | (kind == 0xC3) & ((nxt == 0x97) | (nxt == 0xB7))]
        three = lead[(kind == 0xE2) & (nxt <= 0x81) | (kind == 0xE3) & (nxt == 0x80)]
        for at, n in ((two, 2), (three, 3)):
            for k in range(n):
                out[at + k] = False
        return out


@dataclass
class Counts:
    """Distinct terms of many texts, sorted within each, and how often each occurs; text i has cut[i] to cut[i + 1]."""

    words: np.ndarray
    n: np.ndarray
    cut: np.ndarray

    def of(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        return self.words[self.cut[i] : self.cut[i + 1]], self.n[self.cut[i] : self.cut[i + 1]]


def term_counts(texts: pa.Array | pa.ChunkedArray) -> Counts:
    t = TermTable(texts)
    words, cut = t.hashes(), t.cut.tolist()
    for x, y in zip(cut[:-1], cut[1:], strict=True):
        words[x:y].sort()
    new = np.ones(len(words) + 1, bool)
    new[1:-1] = words[1:] != words[:-1]
    new[t.cut] = True
    first = np.flatnonzero(new)
    return Counts(words[first[:-1]], np.diff(first), np.searchsorted(first, t.cut))


def find(table: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Positions of ``x`` in a sorted table, -1 where it is not."""
    if not len(table):
        return np.full(len(x), -1)
    at = np.minimum(np.searchsorted(table, x), len(table) - 1)
    return np.where(table[at] == x, at, -1)


def stretches(start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, ... (n[0] numbers), start[1], ... and so on."""
    end = np.cumsum(n)
    return np.repeat(start - end + n, n) + np.arange(end[-1] if len(end) else 0)


def kth(rows: np.ndarray, k: int) -> np.ndarray:
    """The k-th largest of each row, 0 where there are fewer."""
    return np.partition(rows, -k, 1)[:, -k] if k <= rows.shape[1] else np.zeros(len(rows))


@dataclass
class Vectors:
    """Unit-length vectors of many texts over the index's terms; ``owner`` is a term's text."""

    owner: np.ndarray
    term: np.ndarray
    weight: np.ndarray
    size: int


@dataclass
class Index:
    """The examples' postings by term and block, and what turns votes into scores."""

    vocab: np.ndarray  # digests of the examples' terms, sorted
    idf: np.ndarray  # inverse document frequency times 1 + sqrt of the class association
    others: np.ndarray  # digests of the other terms of more than one document in FLOOR, sorted
    others_df: np.ndarray
    n_docs: int
    label: np.ndarray
    ids: np.ndarray
    class_weight: np.ndarray  # labelled rows that an example of each class stands for
    k: int
    place: np.ndarray | None = None  # an example's position among the blocks
    who: np.ndarray | None = None  # and the example at a position
    start: np.ndarray | None = None  # where a term's postings begin
    example: np.ndarray | None = None  # a posting's position, and weight in multiples of 1 / UNIT
    weight: np.ndarray | None = None
    row: np.ndarray | None = None  # a common term's row in ``dense`` or -1
    dense: np.ndarray | None = None  # (blocks, common terms, examples of a block), built where it is used
    peaks: np.ndarray | None = None  # (common terms, blocks): the largest weight in each block
    a: float = 0.0
    b: float = 0.0
    empty: float = 0.0

    def vectors(self, c: Counts) -> Vectors:
        """Index terms and their weights in each text's unit-length vector over all terms.

        Weights are whole multiples of 2**-26, so that a cosine is an exact sum in double
        precision: the same in any order and any batch, and ties are true ties."""
        owner = np.repeat(np.arange(len(c.cut) - 1, dtype=np.int32), np.diff(c.cut))
        t = find(self.vocab, c.words).astype(np.int32)
        inside = t >= 0
        w = 1.0 + np.log(c.n)
        w[inside] *= self.idf[t[inside]]
        at = find(self.others, c.words[~inside])
        w[~inside] *= inverse_frequency(np.where(at >= 0, self.others_df[at], 0) if len(self.others) else np.zeros(len(at)), self.n_docs)
        norm = np.sqrt(np.bincount(owner, w * w, len(c.cut) - 1))
        owner, w = owner[inside], w[inside]
        return Vectors(owner, t[inside], np.rint(w / norm[owner] * UNIT) / UNIT, len(c.cut) - 1)

    def lay_out(self, v: Vectors) -> None:
        order = likeness_order(v, len(self.vocab))
        self.who, self.place = order, np.empty_like(order)
        self.place[order] = np.arange(len(order))
        at = self.place[v.owner].astype(np.int32)
        by = np.lexsort((at, v.term)).astype(np.int32)
        n = np.bincount(v.term, minlength=len(self.vocab))
        self.start = np.concatenate(([0], np.cumsum(n)))
        self.example, self.weight = at[by], (v.weight[by] * UNIT).astype(np.int32)
        common = np.flatnonzero(n * COMMON > v.size)
        self.row = np.full(len(self.vocab), -1)
        self.row[common] = np.arange(len(common))

    def build_dense(self) -> None:
        """Rows of the common terms, block by block; not broadcast, but laid out where it is used."""
        if self.dense is None:
            terms_of, blocks = np.flatnonzero(self.row >= 0), -(-len(self.ids) // BLOCK)
            self.dense = np.zeros((blocks, len(terms_of), BLOCK))
            for i, t in enumerate(terms_of.tolist()):
                own = slice(self.start[t], self.start[t + 1])
                at = self.example[own]
                self.dense[at // BLOCK, i, at % BLOCK] = self.weight[own] / UNIT
            self.peaks = self.dense.max(2).T.copy()

    def nearest(self, v: Vectors, leave: np.ndarray | None = None) -> list[list[tuple[float, int]]]:
        """The exact k nearest examples (cosine, example) of each text, ties by the lower
        number; example ``leave[i]`` is none for text i."""
        if not len(self.ids):
            return [[] for _ in range(v.size)]
        self.build_dense()
        cut = np.searchsorted(v.owner, np.arange(0, v.size + BATCH, BATCH))
        out = []
        for i, (x, y) in enumerate(zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)):
            first = i * BATCH
            part = Vectors(v.owner[x:y] - first, v.term[x:y], v.weight[x:y], min(BATCH, v.size - first))
            out += self._nearest(part, None if leave is None else self.place[leave[first : first + BATCH]])
        return out

    def _nearest(self, v: Vectors, leave: np.ndarray | None) -> list[list[tuple[float, int]]]:
        blocks, k = len(self.dense), min(self.k, len(self.ids))
        row = self.row[v.term]
        x = np.zeros((v.size, self.dense.shape[1]))
        x[v.owner[row >= 0], row[row >= 0]] = v.weight[row >= 0]
        rare = row < 0
        owner, term, weight = v.owner[rare], v.term[rare], v.weight[rare] / UNIT
        cut = np.searchsorted(owner, np.arange(v.size + 1)).tolist()
        cos = np.empty((v.size, blocks * BLOCK))
        for j, (lo, hi) in enumerate(zip(cut[:-1], cut[1:], strict=True)):
            at = self.start[term[lo:hi]]
            n = self.start[term[lo:hi] + 1] - at
            post = stretches(at, n)
            cos[j] = np.bincount(self.example[post], self.weight[post] * np.repeat(weight[lo:hi], n), cos.shape[1])
        by_block = cos.reshape(v.size, blocks, BLOCK)
        bound = by_block.max(2) + x @ self.peaks
        first = min(FIRST, blocks)
        best = np.argpartition(-bound, first - 1, 1)[:, :first]
        opened = np.zeros((v.size, blocks), bool)

        def open_(which):
            for b in np.flatnonzero(which.any(0)).tolist():
                docs = np.flatnonzero(which[:, b])
                cos[docs, b * BLOCK : (b + 1) * BLOCK] += x[docs] @ self.dense[b]
            opened[which] = True
            if leave is not None:
                cos[np.arange(v.size), leave] = 0.0

        which = np.zeros((v.size, blocks), bool)
        np.put_along_axis(which, best, True, 1)
        open_(which)
        least = kth(np.take_along_axis(by_block, best[:, :, None], 1).reshape(v.size, -1), k)
        open_(~opened & (bound * (1 + 1e-12) >= least[:, None]) & (bound > 0))
        # the k nearest reach the k-th best cosine seen at first, and that of the blocks' best ones
        least = np.maximum(least, kth(np.where(opened, by_block.max(2), 0.0), k))
        at = np.flatnonzero((cos >= np.maximum(least, 0.5 / UNIT**2)[:, None]).reshape(-1))
        at = at[opened.reshape(-1)[at // BLOCK]]
        doc, who, c = at // cos.shape[1], self.who[at % cos.shape[1]], cos.reshape(-1)[at]
        by = np.lexsort((who, -c, doc))
        cut = np.searchsorted(doc, np.arange(v.size + 1)).tolist()
        c, who = c[by].tolist(), who[by].tolist()
        return [list(zip(c[i : min(i + k, j)], who[i : min(i + k, j)], strict=True)) for i, j in zip(cut[:-1], cut[1:], strict=True)]

    def vote(self, near: list[tuple[float, int]]) -> float:
        """Weighted log-odds of the neighbours' labels; weights fall with the distance 1 - cos."""
        pos = neg = 0.5
        for c, i in near:
            w = self.class_weight[self.label[i]] / (0.05 + 1.0 - min(c, 1.0))
            pos, neg = pos + w * self.label[i], neg + w * (1 - self.label[i])
        return float(np.log(pos / neg))

    def score(self, near: list[tuple[float, int]]) -> float:
        return float(1.0 / (1.0 + np.exp(-np.clip(self.a * self.vote(near) + self.b, -30, 30)))) if near else self.empty


def likeness_order(v: Vectors, terms: int) -> np.ndarray:
    """The texts in an order that has like ones together: halves by the leading direction, over
    and over until they fit into a block. Starts and sums are fixed, so is the order."""
    out, rng = [], np.random.default_rng(0)

    def halve(members, own):
        if len(members) <= BLOCK:
            out.append(members)
            return
        local = np.full(v.size, -1, np.int32)
        local[members] = np.arange(len(members), dtype=np.int32)
        owner, t, w = local[v.owner[own]], v.term[own], v.weight[own].astype(np.float32)
        x = rng.standard_normal(len(members))
        for _ in range(6):
            x -= x.mean()
            x = np.bincount(owner, w * np.bincount(t, w * x[owner], terms)[t], len(members))
            x /= np.linalg.norm(x) + 1e-30
        order = np.argsort(x - x.mean(), kind="stable")
        left = np.zeros(len(members), bool)
        left[order[: -(-len(order) // 2 // BLOCK) * BLOCK or BLOCK]] = True
        parts = [(members[side], own[side[owner]]) for side in (left, ~left)]
        del owner, t, w, own, local, x  # not held while the halves are halved
        halve(*parts.pop(0))
        halve(*parts.pop(0))

    halve(np.arange(v.size), np.arange(len(v.owner), dtype=np.int32))
    return np.concatenate(out)


def inverse_frequency(df: np.ndarray, n_docs: int) -> np.ndarray:
    return np.log((1 + n_docs) / (1 + np.maximum(np.maximum(df, 1), n_docs / FLOOR))) + 1.0


def association(label: np.ndarray, owner: np.ndarray, term: np.ndarray, terms: int) -> np.ndarray:
    """Log-likelihood ratio of each term's presence in the two classes of examples."""
    n = [1.0 + (label == y).sum() for y in (0, 1)]
    with_term = [np.bincount(term[label[owner] == y], minlength=terms).astype(float) for y in (0, 1)]
    rate = (with_term[0] + with_term[1]) / sum(n)
    xlog = lambda o, e: np.where(o > 0, o * np.log(np.where(o > 0, o, 1.0) / np.where(o > 0, e, 1.0)), 0.0)
    return np.maximum(2 * sum(xlog(with_term[y], n[y] * rate) + xlog(n[y] - with_term[y], n[y] * (1 - rate)) for y in (0, 1)), 0.0)


def _logistic(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[float, float]:
    """Weighted logistic fit by Newton steps with a little ridge."""
    a, b = 1.0, 0.0
    w = w / w.sum()
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -30, 30)))
        g = np.array([(w * (p - y) * x).sum() + 1e-4 * a, (w * (p - y)).sum()])
        v = w * p * (1 - p) + 1e-9
        h = np.array([[(v * x * x).sum() + 1e-4, (v * x).sum()], [(v * x).sum(), v.sum()]])
        step = np.linalg.solve(h, g)
        step *= min(1.0, 2.0 / max(np.abs(step).max(), 1e-12))
        a, b = a - step[0], b - step[1]
    return float(max(a, 0.0)), float(b)


def fit(docs: DataFrame, labelled: DataFrame, max_positive: int = 4096, max_negative: int = 4096, k: int = 15) -> Index:
    """An index from ``labelled`` (doc_id, label 0/1; rows with a null in either are left out).

    Reads the documents twice: the examples' terms, and document frequencies of all terms. Unlike texts
    under one labelled doc_id are examples each, equal ones are one; of all these, in the order of a hash of
    the doc_id, at most ``max_positive + max_negative`` examples, and 16 bytes a term that stands in more than
    one document in ``FLOOR``, reach the driver.
    """
    known = labelled.where("doc_id IS NOT NULL AND label IN (0, 1)").groupBy("doc_id").agg(F.max("label").alias("label"))
    totals = {int(r["label"]): r["n"] for r in known.groupBy("label").agg(F.count("*").alias("n")).collect()}
    h = F.xxhash64(F.lit("toxicity"), "doc_id")
    sample = known.where("label = 1").orderBy(h, "doc_id").limit(max_positive).unionByName(known.where("label = 0").orderBy(h, "doc_id").limit(max_negative))
    some = docs.sparkSession.createDataFrame([(int(r[0]), int(r[1])) for r in sample.select("doc_id", "label").collect()], "doc_id long, label int")
    examples = docs.select("doc_id", "text").join(F.broadcast(some), "doc_id").withColumn("fp", F.xxhash64("text"))  # at most max_positive + max_negative rows of 12 bytes

    vec_schema = pa.schema([("doc_id", pa.int64()), ("label", pa.int32()), ("fp", pa.int64()), ("words", pa.binary()), ("tf", pa.binary())])

    def vectors(batches):
        for b in batches:
            c = term_counts(b.column("text"))
            own = [c.of(i) for i in range(b.num_rows)]
            yield batch_of({"doc_id": b.column("doc_id"), "label": b.column("label"), "fp": b.column("fp"), "words": [x.tobytes() for x, _ in own], "tf": [n.astype(np.int32).tobytes() for _, n in own]}, vec_schema)

    one = examples.mapInArrow(vectors, "doc_id long, label int, fp long, words binary, tf binary").dropDuplicates(["doc_id", "fp"])
    place = F.row_number().over(Window.partitionBy("label").orderBy(F.xxhash64(F.lit("toxicity"), "doc_id"), "doc_id", "fp"))  # cut within each task first
    most = F.when(F.col("label") == 1, max_positive).otherwise(max_negative)
    got = one.withColumn("place", place).where(F.col("place") <= max(max_positive, max_negative)).where(F.col("place") <= most).select("doc_id", "label", "words", "tf").toArrow()
    view = lambda name, kind: [np.frombuffer(x.as_buffer(), kind) for x in got.column(name)]
    rows = list(zip(got.column("doc_id").to_pylist(), got.column("label").to_pylist(), view("words", np.uint64), view("tf", np.int32), strict=True))
    del got
    release()

    df_schema = pa.schema([("word", pa.int64()), ("n", pa.int64())])

    def doc_counts(batches):
        def out(held):
            words, n_of = np.unique(np.concatenate([np.zeros(0, np.uint64), *held]), return_counts=True)
            for i in range(0, len(words), 100_000):
                yield batch_of({"word": words[i : i + 100_000].view(np.int64), "n": n_of[i : i + 100_000].astype(np.int64)}, df_schema)

        held, size = [], 0
        for b in batches:
            held.append(term_counts(b.column("text")).words)
            size += len(held[-1])
            if size > 2_000_000:
                yield from out(held)
                held, size = [], 0
        yield from out(held)
        release()

    n_docs = docs.count()
    by_word = docs.select("text").mapInArrow(doc_counts, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")).where(f"n > 1 AND n > {n_docs / FLOOR}D").toArrow()
    word, n = by_word.column("word").to_numpy().view(np.uint64), by_word.column("n").to_numpy()
    order = np.argsort(word)
    index = build(word[order], n[order], n_docs, rows, totals, k)
    release()
    return index


def build(word: np.ndarray, df: np.ndarray, n_docs: int, rows: list[tuple[int, int, np.ndarray, np.ndarray]], totals: dict[int, int], k: int) -> Index:
    """Lay the examples (doc_id, label, terms, counts) out and calibrate; ``word`` are sorted digests of the terms known to be frequent, ``df`` their documents."""
    n = [max(1, sum(r[1] == y for r in rows)) for y in (0, 1)]
    stands = np.array([max(totals.get(y, 0), 1) / n[y] for y in (0, 1)])
    bare = [r for r in rows if not len(r[2])]
    rows = sorted((r for r in rows if len(r[2])), key=lambda r: (r[0], r[1], len(r[2]), xxhash.xxh3_64_intdigest(r[2]), xxhash.xxh3_64_intdigest(r[3])))
    counts = Counts(np.concatenate([np.zeros(0, np.uint64), *(r[2] for r in rows)]), np.concatenate([np.zeros(0, np.int32), *(r[3] for r in rows)]), np.cumsum([0, *(len(r[2]) for r in rows)]))
    rows = [r[:2] for r in rows]
    vocab = np.unique(counts.words)
    label = np.array([r[1] for r in rows], np.int64)
    telling = association(label, np.repeat(np.arange(len(rows), dtype=np.int32), np.diff(counts.cut)), find(vocab, counts.words).astype(np.int32), len(vocab))
    at, inside = find(word, vocab), find(vocab, word) >= 0
    vocab_df = np.where(at >= 0, df[at], 0) if len(word) else np.zeros(len(vocab))
    ix = Index(vocab, inverse_frequency(vocab_df, n_docs) * (1.0 + np.sqrt(telling)), word[~inside], df[~inside], n_docs, label, np.array([r[0] for r in rows], np.int64), stands, k)
    vecs = ix.vectors(counts)
    ix.lay_out(vecs)
    if rows:
        votes = np.array([ix.vote(x) for x in ix.nearest(vecs, np.arange(len(rows)))])
        ix.dense = ix.peaks = None  # not broadcast
        ix.a, ix.b = _logistic(votes, ix.label.astype(float), stands[ix.label])
    pos, neg = (sum(stands[y] for r in bare if r[1] == y) for y in (1, 0))
    ix.empty = float((pos + 0.01) / (pos + neg + 1.0)) if rows or bare else 0.0
    return ix


def score(docs: DataFrame, index: Index, *keep: str) -> DataFrame:
    """``keep`` columns of ``docs`` (whatever their names) with two more, ``score`` (double) and
    ``evidence``: the three nearest examples as ``id:label:cosine``. The broadcast index holds
    the examples and the terms' document frequencies, both bounded (see ``fit``)."""
    return scored(docs, index, keep, "score", "evidence")


def scored(docs: DataFrame, index: Index, keep: tuple[str, ...], score_name: str, why_name: str | None) -> DataFrame:
    """``keep`` columns with the score under a name of choice, and the evidence if it has a name."""
    shared = docs.sparkSession.sparkContext.broadcast(index)
    src = docs.select(*keep, docs["text"].alias("__compared"))
    schema = docs.select(*keep).schema.add(score_name, "double")
    if why_name:
        schema = schema.add(why_name, "string")

    def make():
        ix = shared.value

        def run(b):
            texts = b.column(b.num_columns - 1).dictionary_encode()
            near = ix.nearest(ix.vectors(term_counts(texts.dictionary)))
            # a null text has no dictionary entry, and no neighbours
            at = [len(near) if i is None else i for i in texts.indices.to_pylist()]
            near.append([])
            scores = [ix.score(x) for x in near]
            cols = [*b.columns[:-1], pa.array([scores[i] for i in at], pa.float64())]
            if why_name:
                why = [",".join(f"{ix.ids[i]}:{ix.label[i]}:{c:.4f}" for c, i in x[:3]) for x in near]
                cols.append(pa.array([why[i] for i in at], pa.string()))
            yield pa.RecordBatch.from_arrays(cols, names=schema.names)

        return run

    return src.mapInArrow(per_batch(make), schema)


HELD_OUT = "crc32(cast(doc_id AS string)) % 5 = 0"


def training_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The labelled rows that may be learned from: all but the held-out fifth."""
    return table(spark, sf_dir, "labels").where(f"NOT ({HELD_OUT})").select("doc_id", F.col("toxic").cast("int").alias("label"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    docs = table(spark, sf_dir, "documents")
    got = score(docs, fit(docs, training_labels(spark, sf_dir)), "doc_id")
    return got.select("doc_id", F.expr(HELD_OUT).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"), "evidence")
