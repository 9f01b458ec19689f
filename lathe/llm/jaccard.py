"""N-gram Jaccard join with token-group matrices.

1. Every document becomes the set of its distinct word shingles (64-bit hashes); equal sets
   are one *set* from there on.
2. Packs ask how many documents hold each shingle. In the order "rarest first" a set that
   links with another must share one of its first ``n - ceil(t n) + 1`` shingles (any fixed
   order is exact; rare ones first keep unrelated sets apart). Sets of which too few shingles
   occur elsewhere can link with nothing and stop here.
3. Sets that share such a shingle are tied to the smallest set that has it; the connected
   families are slices of the token-group matrix that may hold links. Large families are cut
   into blocks, each pair of blocks being a task, so no task grows with a family.
4. In a slice, similar sets form groups (by smallest shingle and size); the matrix has each
   group's union of shingles. A query counts its shingles in each union, an upper bound of
   its overlap with every member, and only groups whose bound reaches the threshold are
   opened and their members compared exactly.
5. Links are kept as spanning forests (a link inside one component is not repeated), and
   components follow from them.

Null, empty and word-less texts have no shingles and link with nothing; texts of fewer words
than a shingle have the whole sequence as one. Repeated rows are equal sets. Set identity is
a 64-bit digest.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WordTable, batch_of, by_bucket, chain_hash, components, materialise, mix, n_groups, small_batches, table
from .packs import ASK_DDL, answers, bits_of, counting, over_packs, packs, put_together, request_rows, shelf_bits, width_of, with_answers

GROUP, BLOCK = 16, 1024


def shingle_sets(texts: pa.Array | pa.ChunkedArray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The texts' distinct word shingles as hashes (A-Z lower-cased), sorted within a text, and
    where each text's begin. A text of fewer words has all of them as one."""
    words = WordTable(texts, lower=True)
    h, (text, room), n = words.hashes(), words.places(), np.diff(words.cut)
    at = np.flatnonzero(room >= width)
    value, owner = [chain_hash(h, width, at)], [text[at]]
    for k in range(1, width):
        short = np.flatnonzero(n == k)
        if len(short):
            value.append(chain_hash(h, k, words.cut[short]) ^ np.uint64(k))
            owner.append(short)
    size = np.maximum(n - width + 1, n > 0)
    end = np.cumsum(size)
    flat = np.empty(int(end[-1]) if len(end) else 0, np.uint64)
    if len(value) > 1:
        by = np.argsort(np.concatenate(owner), kind="stable")
        flat[:] = np.concatenate(value)[by]
    else:
        flat[:] = value[0]
    for x, y in zip((end - size).tolist(), end.tolist(), strict=True):
        flat[x:y].sort()
    new = np.ones(len(flat), bool)
    new[1:] = flat[1:] != flat[:-1]
    new[(end - size)[size > 0]] = True
    return flat[new], np.concatenate(([0], np.cumsum(new)))[np.concatenate(([0], end))]


def digests(flat: np.ndarray, cut: np.ndarray) -> list[int | None]:
    """The sets' 64-bit names, as signed longs; None for an empty set."""
    a, b = (np.concatenate((np.zeros(1, np.uint64), np.cumsum(x))) for x in (mix(flat), flat ^ (flat >> np.uint64(7))))
    name = mix((a[cut[1:]] - a[cut[:-1]]) ^ (b[cut[1:]] - b[cut[:-1]])).view(np.int64)
    return [x if n else None for x, n in zip(name.tolist(), np.diff(cut).tolist(), strict=True)]


class Forest:
    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = i = self.up[self.up[i]]
        return i

    def join(self, i: int, j: int) -> bool:
        i, j = self.root(i), self.root(j)
        self.up[max(i, j)] = min(i, j)
        return i != j


def slice_links(names: np.ndarray, sets: list[np.ndarray], side: np.ndarray, num: int, den: int) -> list[tuple[int, int]]:
    """A spanning forest of the links within a slice (``side`` all 0) or between its sides 0
    and 1, by a token-group matrix over the members (side 1, or all)."""
    tokens, inverse = np.unique(np.concatenate(sets), return_inverse=True)
    cut = np.concatenate(([0], np.cumsum([len(s) for s in sets])))
    own = [inverse[cut[i] : cut[i + 1]] for i in range(len(sets))]
    size = np.diff(cut)
    two = bool(side.any())
    members = sorted((i for i in range(len(sets)) if not two or side[i]), key=lambda i: (int(sets[i][0]), int(size[i]), int(names[i])))
    queries = [i for i in range(len(sets)) if not two or not side[i]]
    groups = [members[i : i + GROUP] for i in range(0, len(members), GROUP)]
    union = [np.unique(np.concatenate([own[i] for i in g])) for g in groups]
    cols, who = np.concatenate(union), np.repeat(np.arange(len(groups)), [len(u) for u in union])
    order = np.argsort(cols, kind="stable")
    who, start = who[order], np.searchsorted(cols[order], np.arange(len(tokens) + 1))
    small = np.array([min(size[i] for i in g) for g in groups])
    flag, forest, links = np.zeros(len(tokens), bool), Forest(len(sets)), []
    for q in queries:
        s0, n = start[own[q]], start[own[q] + 1] - start[own[q]]
        at = np.repeat(s0 - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())
        bound = np.bincount(who[at], minlength=len(groups))
        least = np.maximum(small, -(-size[q] * num // den))
        flag[own[q]] = True
        for g in np.flatnonzero((num + den) * bound >= num * (size[q] + least)).tolist():
            rest = [i for i in groups[g] if i != q and forest.root(i) != forest.root(q)]
            if rest:
                k = [int(flag[own[i]].sum()) for i in rest]
                for i, both in zip(rest, k, strict=True):
                    if (num + den) * both >= num * (size[q] + size[i]) and forest.join(q, i):
                        links.append((int(names[q]), int(names[i])))
        flag[own[q]] = False
    return links


def jaccard_components(docs: DataFrame, width: int = 5, num: int = 8, den: int = 10) -> DataFrame:
    """(doc_id, n_shingles, component_id): documents link when ``den * intersection >= num *
    union`` of their ``width``-word shingle sets; component_id is the smallest doc_id reachable."""
    spark = docs.sparkSession
    held = packs(docs.select("doc_id", "text"), "doc_id", "text")
    n_docs = docs.count()
    bits = bits_of(n_groups(n_docs, 1000, 64))
    wide, shelf = width_of(4, bits), shelf_bits(bits)

    def ask(p, t):
        keys, count = np.unique(shingle_sets(t.column("text"), width)[0], return_counts=True)
        yield from request_rows(p, keys, count.astype(np.uint32), shelf, wide)

    told = answers(over_packs(held, ask, ASK_DDL), wide, bits, counting(lambda n: np.minimum(n, 65535).astype(np.uint16)), read=lambda b: np.frombuffer(b, np.uint16))
    schema = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("name", pa.int64()), ("members", pa.binary()), ("first", pa.binary())])

    def tell(p, t, rows):
        flat, cut = shingle_sets(t.column("text"), width)
        keys, inverse = np.unique(flat, return_inverse=True)
        often = put_together(rows, np.uint16)[inverse] if len(keys) else np.zeros(0, np.uint16)
        common = np.concatenate(([0], np.cumsum(often >= 2)))
        names, cut = digests(flat, cut), cut.tolist()
        seen, out = set(), {f.name: [] for f in schema}
        for i, (d, name) in enumerate(zip(t.column("doc_id").to_pylist(), names, strict=True)):
            f, s = often[cut[i] : cut[i + 1]], flat[cut[i] : cut[i + 1]]
            need = -(-len(s) * num // den)
            first = None
            if len(s) and name not in seen and common[cut[i + 1]] - common[cut[i]] >= need:
                seen.add(name)
                head = np.lexsort((s, f))[: len(s) - need + 1]
                first = s[head[f[head] >= 2]].tobytes()
            for k, v in (("doc_id", d), ("n_shingles", len(s)), ("name", name), ("members", s.tobytes() if first else None), ("first", first or None)):
                out[k].append(v)
        yield pa.table(out, schema=schema)

    found = materialise(with_answers(held, told, tell, schema))
    some = found.where("members IS NOT NULL").select("name", "n_shingles", "first")
    pair_schema = pa.schema([("bucket", pa.int32()), ("tokens", pa.binary()), ("names", pa.binary())])

    def deal(batches):
        for b in batches:
            first = [np.frombuffer(x, np.uint64) for x in b.column("first").to_pylist()]
            if first:
                tok, who = np.concatenate(first), np.repeat(np.array(b.column("name")), [len(x) for x in first])
                for k, at in by_bucket((tok >> np.uint64(64 - bits)).astype(np.int64)):
                    yield batch_of({"bucket": [k], "tokens": [tok[at].tobytes()], "names": [who[at].tobytes()]}, pair_schema)

    def tie(t: pa.Table) -> pa.Table:
        tok = np.frombuffer(b"".join(t.column("tokens").to_pylist()), np.uint64)
        who = np.frombuffer(b"".join(t.column("names").to_pylist()), np.int64)
        order = np.lexsort((who, tok))
        tok, who = tok[order], who[order]
        new = np.concatenate(([True], tok[1:] != tok[:-1]))
        head = who[np.flatnonzero(new)[np.cumsum(new) - 1]]
        pairs = np.unique(np.stack([head, who], 1)[head != who], axis=0)
        return pa.table({"a": pairs[:, 0], "b": pairs[:, 1]})

    ties = some.mapInArrow(deal, "bucket int, tokens binary, names binary").groupBy("bucket").applyInArrow(tie, "a long, b long")
    family = components(ties)
    cells = _cells(found.where("members IS NOT NULL").select("name", "members"), family, n_docs)
    links = cells.groupBy("deal").applyInArrow(lambda t: _links(t, num, den), "a long, b long")
    part = components(links).select(F.col("node").alias("name"), F.col("component").alias("part"))
    # Both are written, so that the joins have no aggregate beside them and Spark can split a hot name or part.
    named = found.select("doc_id", "n_shingles", "name").join(materialise(part), "name", "left").withColumn("part", F.coalesce("part", "name"))
    named = materialise(named)
    least = materialise(named.where("part IS NOT NULL").groupBy("part").agg(F.min("doc_id").alias("least")))
    return named.join(least, "part", "left").select("doc_id", "n_shingles", F.coalesce("least", "doc_id").alias("component_id"))


def _cells(members: DataFrame, family: DataFrame, n_docs: int) -> DataFrame:
    """Members dealt to the cells (family, block, block); ``deal`` gathers many small cells."""
    sizes = family.groupBy("component").agg(F.count("*").alias("n"))
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    x = members.dropDuplicates(["name"]).join(family.join(sizes, "component").select(F.col("node").alias("name"), "component", blocks.alias("blocks")), "name")
    x = x.withColumn("own", F.pmod(F.xxhash64(F.lit(7), "name"), "blocks").cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    x = x.select("name", "members", "component", "own", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"))
    return x.withColumn("deal", F.pmod(F.xxhash64("component", "lo", "hi"), F.lit(n_groups(n_docs, 500, 32))).cast("int"))


def _links(t: pa.Table, num: int, den: int) -> pa.Table:
    c = {k: np.array(t.column(k)) for k in ("name", "component", "own", "lo", "hi")}
    body = t.column("members").to_pylist()
    order = np.lexsort((c["name"], c["hi"], c["lo"], c["component"]))
    key = np.stack([c["component"], c["lo"], c["hi"]], 1)[order]
    cut = np.flatnonzero((key[1:] != key[:-1]).any(1)) + 1
    out = []
    for at in np.split(order, cut):
        if len(at) > 1:
            side = (c["own"][at] != c["lo"][at]).astype(int)
            if c["lo"][at[0]] == c["hi"][at[0]] or 0 < side.sum() < len(at):
                out += slice_links(c["name"][at], [np.frombuffer(body[i], np.uint64) for i in at.tolist()], side, num, den)
    return pa.table({"a": pa.array([x for x, _ in out], pa.int64()), "b": pa.array([y for _, y in out], pa.int64())})


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return jaccard_components(table(spark, sf_dir, "documents"), width=3, num=9, den=10)
