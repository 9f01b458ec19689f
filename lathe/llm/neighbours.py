"""Embedding near-dedup by collisions in windows of sorted projections.

Every list sorts the vectors by a one-dimensional random projection, within cells of ``depth``
further coarse projections that keep the lists' windows short as the data grow. Around each
vector a window of two standard deviations of a threshold pair's difference holds its partners.
A pair that shares a window in any list, and whose sketches (signs of ``BITS`` projections) differ
in no more bits than a pair at the threshold's do, is verified with the exact cosine. How many
others stand in a window changes the work, never what is found: the depth and the bits are
calibrated so that a pair at the threshold is found with probability ``recall``.

Groups of copies yield a linear number of pairs: a vector with more than ``CROWD`` partners in a
window first goes with the ``LEADERS`` smallest of these by a hash alone. The pairs of two such
vectors that verified links have not connected by then are all compared in a second round. The
links within a connected family are then completed exactly, in blocks.

Vectors that are null, zero, of a length other than the commonest one (the shorter on ties), or
hold null or non-finite components link with nothing. Rows of the same vec_id are one vector (the
smallest); those without a vec_id link with nothing and have a null component and null kept. A
vector without links is its own component.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batch_of, by_bucket, components, materialise, mix, n_groups, small_batches, table

BLOCK, CROWD, LEADERS, BITS = 1024, 16, 8, 128
#: Pairs of a window that are compared at once.
AT_ONCE = 1 << 19
#: Vectors whose entries of all lists a task gathers before it deals them out.
HELD = 16384


def _phi(x: float) -> float:
    return 0.5 * (1 + math.erf(x / math.sqrt(2)))


def calibrate(n: int, threshold: float, lists: int, recall: float) -> tuple[int, float, float, int]:
    """(depth, cell width, window, bits that may differ) for n vectors.

    A pair at the threshold is missed by the sketch with a tenth of 1 - ``recall`` at most, and
    by all lists with half of it; a depth that would lose more is not taken."""
    r = math.sqrt(2 - 2 * threshold)
    width, window = 5.7 * r, 2 * r

    def same_cell(d):
        u = width / d
        return 1 - 2 * _phi(-u) - 2 / (math.sqrt(2 * math.pi) * u) * (1 - math.exp(-u * u / 2))

    far = 2 * _phi(window / math.sqrt(2)) - 1
    depth = max(1, math.ceil(math.log(max(n, 2) * far / 2.0) / -math.log(same_cell(math.sqrt(2)))))
    while depth > 1 and (1 - same_cell(r) ** depth * (2 * _phi(2) - 1)) ** lists > (1 - recall) / 2:
        depth -= 1
    p, bits, held = math.acos(threshold) / math.pi, -1, 0.0
    while held < 1 - (1 - recall) / 10 and bits < BITS:
        bits += 1
        held += math.comb(BITS, bits) * p**bits * (1 - p) ** (BITS - bits)
    return depth, width, window, bits


def unit_vectors(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(id, unit) of the vectors that can link; units are float64 bytes."""
    schema = pa.schema([("id", pa.int64()), ("unit", pa.binary())])

    def run(batches):
        for b in batches:
            v = b.column("v")
            n = pc.fill_null(pc.list_value_length(v), 0).to_numpy().astype(np.int64)
            flat = pc.list_flatten(v).cast(pa.float64()).to_numpy(zero_copy_only=False)  # null components are NaN
            at, known, ids = np.cumsum(n) - n, b.column("id").is_valid().to_numpy(zero_copy_only=False), pc.fill_null(b.column("id"), 0).to_numpy()
            for size in np.unique(n[n > 0]).tolist():
                rows = np.flatnonzero((n == size) & known)
                x = flat[at[rows, None] + np.arange(size)]
                scale = np.abs(x).max(1)
                ok = np.isfinite(scale) & (scale > 0)
                x = x[ok] / scale[ok, None]
                x /= np.sqrt((x * x).sum(1))[:, None]
                yield batch_of({"id": ids[rows[ok]], "unit": [u.tobytes() for u in x]}, schema)

    got = df.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("v")).mapInArrow(run, "id long, unit binary")
    return got.groupBy("id").agg(F.min("unit").alias("unit"))


def _stack(column: pa.ChunkedArray) -> np.ndarray:
    rows = column.to_pylist()
    return np.frombuffer(b"".join(rows), np.float64).reshape(len(rows), -1)


def _window_pairs(ids: np.ndarray, cell: np.ndarray, at: np.ndarray, sketch: np.ndarray, window: float, bits: int, label: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Pairs within the cells' windows whose sketches are alike. Of a crowd of partners the
    leaders alone, and the vector itself as a mark; with ``label`` all that bear another one."""
    order = np.lexsort((ids, at, cell))
    ids, cell, at, sketch = ids[order], cell[order], at[order], sketch[:, order]
    label = label if label is None else label[order]
    key = at - at.min()
    key += np.cumsum(np.concatenate([[False], cell[1:] != cell[:-1]])) * (key.max() + 2 * window)
    lo, hi = np.searchsorted(key, key - window), np.searchsorted(key, key + window, "right")
    rank = mix(ids.astype(np.uint64))
    a, b, done = [], [], np.concatenate([[0], np.cumsum(hi - lo)])
    i = 0
    while i < len(ids):
        end = max(i + 1, int(np.searchsorted(done, done[i] + AT_ONCE, "right")) - 1)
        n = (hi - lo)[i:end]
        x = np.repeat(np.arange(i, end), n)
        y = np.arange(len(x)) - np.repeat(done[i:end] - done[i], n) + np.repeat(lo[i:end], n)
        keep = x != y if label is None else (x < y) & (label[x] != label[y])
        x, y = x[keep], y[keep]
        alike = np.bitwise_count(sketch[:, x] ^ sketch[:, y]).sum(0, dtype=np.int64) <= bits
        x, y = x[alike], y[alike]
        if label is None:
            crowded = np.flatnonzero(np.bincount(x - i, minlength=end - i) > CROWD) + i
            if len(crowded):
                inside = np.isin(x, crowded)
                u, v = x[inside], y[inside]
                by = np.lexsort((rank[v], u))
                u, v = u[by], v[by]
                lead = np.arange(len(u)) - np.searchsorted(u, u) < LEADERS
                x, y = np.concatenate([x[~inside], u[lead], crowded]), np.concatenate([y[~inside], v[lead], crowded])
        a.append(ids[x])
        b.append(ids[y])
        i = end
    a, b = np.concatenate(a), np.concatenate(b)
    return np.minimum(a, b), np.maximum(a, b)


def near_duplicates(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", threshold: float = 0.95, lists: int = 48, recall: float = 0.99, seed: int = 11) -> DataFrame:
    """(id, n_links, component_id, kept): one row per row of ``df``, links being pairs with
    cosine >= ``threshold``. Pairs below it never link; pairs at the threshold are found with
    probability ``recall``, closer ones and ones in a family of links more surely."""
    spark = df.sparkSession
    units = materialise(unit_vectors(df, id_col, vec_col))
    n = units.count()
    head = units.select(F.length("unit").alias("n")).groupBy("n").count().orderBy(F.desc("count"), "n").first()
    dim = head["n"] // 8 if head else 1
    units = units.where(F.length("unit") == 8 * dim)
    depth, width, window, bits = calibrate(n, threshold, lists, recall)
    rng = np.random.default_rng(seed)
    lines = rng.standard_normal((lists, depth + 1, dim))
    shift = rng.random((lists, depth)) * width
    signs = rng.standard_normal((dim, BITS))
    cell_schema = pa.schema([("cell", pa.int64()), ("whole", pa.binary()), ("at", pa.binary())])
    deals = n_groups(n, 2048, 64)

    def dealt(parts):
        """One row a deal that occurs, holding all lists' entries of many vectors."""
        whole, at = (np.concatenate(x, -1) for x in zip(*parts, strict=True))
        out = {"cell": [], "whole": [], "at": []}
        for d, rows in by_bucket((whole[1].view(np.uint64) % np.uint64(deals)).astype(np.int64)):
            out["cell"].append(d)
            out["whole"].append(whole[:, rows].tobytes())
            out["at"].append(at[rows].tobytes())
        return batch_of(out, cell_schema)

    def project(batches):
        parts, held = [], 0
        for b in batches:
            if not b.num_rows:
                continue
            ids, x = np.array(b.column("id")), _stack(b.column("unit"))
            more = [*np.packbits(x @ signs > 0, axis=1).view(np.int64).T, *([np.array(b.column("label"))] if "label" in b.schema.names else [])]
            for j in range(lists):
                p = x @ lines[j].T
                cell = np.full(len(ids), j, np.uint64)
                for k in range(depth):
                    cell = mix(cell * np.uint64(0x9E3779B97F4A7C15) + np.floor((p[:, k] + shift[j, k]) / width).astype(np.int64).astype(np.uint64))
                parts.append((np.stack([ids, cell.view(np.int64), *more]), p[:, depth].copy()))
            held += len(ids)
            if held >= HELD:
                yield dealt(parts)
                parts, held = [], 0
        if parts:
            yield dealt(parts)

    def hits(vectors: DataFrame) -> DataFrame:
        rows = 5 if "label" in vectors.columns else 4

        def collide(t: pa.Table) -> pa.Table:
            whole = np.concatenate([np.frombuffer(x, np.int64).reshape(rows, -1) for x in t.column("whole").to_pylist()], 1)
            at = np.frombuffer(b"".join(t.column("at").to_pylist()), np.float64)
            a, b = _window_pairs(whole[0], whole[1], at, whole[2:4].view(np.uint64), window, bits, *whole[4:])
            pairs = np.unique(np.stack([a, b], 1), axis=0)
            return pa.table({"a": pairs[:, 0], "b": pairs[:, 1]})

        return vectors.mapInArrow(project, "cell long, whole binary, at binary").groupBy("cell").applyInArrow(collide, "a long, b long").distinct()

    def verify(batches):
        for b in batches:
            if b.num_rows:
                ok = (_stack(b.column("u")) * _stack(b.column("v"))).sum(1) >= threshold
                yield pa.RecordBatch.from_arrays([b.column("a").filter(pa.array(ok)), b.column("b").filter(pa.array(ok))], names=["a", "b"])

    def verified(likely: DataFrame) -> DataFrame:
        pairs = likely.join(units.select(F.col("id").alias("a"), F.col("unit").alias("u")), "a").join(units.select(F.col("id").alias("b"), F.col("unit").alias("v")), "b")
        return materialise(pairs.select("a", "b", "u", "v").mapInArrow(verify, "a long, b long"))

    first = materialise(hits(units))
    links = verified(first.where("a <> b"))
    family = components(links)
    crowd = first.where("a = b").select(F.col("a").alias("id"))
    if not crowd.isEmpty():
        label = family.select(F.col("node").alias("id"), F.col("component").alias("label"))
        rest = units.join(crowd, "id").join(label, "id", "left").select("id", "unit", F.coalesce("label", "id").alias("label"))
        rest = verified(hits(rest))
        if not rest.isEmpty():
            family = components(links.unionByName(rest))
    sizes = family.groupBy("component").agg(F.count("*").alias("n"))
    x = units.join(family.join(sizes, "component").select(F.col("node").alias("id"), "component", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks")), "id")
    x = x.withColumn("own", F.pmod(F.xxhash64(F.lit(7), "id"), "blocks").cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    x = x.select("id", "unit", "component", "own", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"))
    x = x.withColumn("deal", F.pmod(F.xxhash64("component", "lo", "hi"), F.lit(n_groups(n, 500, 16))).cast("int"))

    def complete(t: pa.Table) -> pa.Table:
        c = {k: np.array(t.column(k)) for k in ("id", "component", "own", "lo", "hi")}
        v = _stack(t.column("unit"))
        order = np.lexsort((c["id"], c["own"], c["hi"], c["lo"], c["component"]))
        key = np.stack([c["component"], c["lo"], c["hi"]], 1)[order]
        ids, links = [], []
        for rows in np.split(order, np.flatnonzero((key[1:] != key[:-1]).any(1)) + 1):
            one = rows[c["own"][rows] == c["lo"][rows]]
            two = rows[c["own"][rows] != c["lo"][rows]]
            same = c["lo"][rows[0]] == c["hi"][rows[0]]
            near = v[one] @ (v[one] if same else v[two]).T >= threshold
            if same:
                np.fill_diagonal(near, False)
                two = two[:0]
            ids += [c["id"][one], c["id"][two]]
            links += [near.sum(1), near.sum(0) if len(two) else np.zeros(0, np.int64)]
        return pa.table({"id": np.concatenate(ids), "n": np.concatenate(links).astype(np.int64)})

    counts = x.groupBy("deal").applyInArrow(complete, "id long, n long").groupBy("id").agg(F.sum("n").alias("n_links"))
    told = counts.join(family.select(F.col("node").alias("id"), "component"), "id")
    got = df.select(F.col(id_col).cast("long").alias("id")).join(told, "id", "left")
    component = F.coalesce("component", "id")
    return got.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), component.alias("component_id"), (F.col("id") == component).alias("kept"))


def op6_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return near_duplicates(table(spark, sf_dir, "embeddings"))
