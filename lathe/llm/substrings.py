"""Substring dedup with difference-cover anchors.

A difference cover D of the period v has, for any two offsets, a shift d < v that brings both
onto D. So if the same ``min_words`` words start at i in one text and at j in another, both
hold, at the same shift below v, an anchor of ``min_words - v + 1`` words that starts at a
position which is in D modulo v. Only anchors are hashed and counted over the corpus; a
window can be repeated only if one of its anchors is. Those anchors are then extended: each
window around a repeated anchor is hashed whole, and the corpus tells which of its
occurrences comes first, by doc_id, then position. All words of the other occurrences go.

Windows are judged on the input. Null, empty and shorter texts lose nothing. A null doc_id
comes after all others; among rows of the same doc_id the order is arbitrary but fixed, so
of two equal rows one stays whole. Anchors are compared by 32 bits and their bucket (a false
match only costs time), whole windows by 64 bits and their bucket of a second hash.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import K2, WordTable, chain_hash, mix, n_groups, small_batches, table
from .packs import ASK, ASK_DDL, Rule, answers, bits_of, counting, over_packs, packs, put_together, request_rows, shelf_bits, width_of, with_answers

#: Difference covers by period (each is a perfect one).
COVERS = {7: (0, 1, 3), 13: (0, 1, 3, 9), 21: (0, 1, 4, 14, 16), 31: (0, 1, 3, 8, 12, 18)}
LAST = np.iinfo(np.int64).max


class Windows:
    """The anchors and windows of one pack's documents; a place is one among the pack's words."""

    def __init__(self, t: pa.Table, min_words: int, period: int):
        self.ids = np.array(t.column("doc_id").fill_null(LAST), np.int64)
        self.table = WordTable(t.column("text"))
        self.min_words, self.period, width = min_words, period, min_words - period + 1
        self.cut, self.h = self.table.cut, self.table.hashes()
        self.n = np.diff(self.cut)
        self.text, self.room = self.table.places()
        cover = np.isin(np.arange(period), COVERS[period])
        within = np.arange(len(self.h)) - self.cut[self.text]
        self.at = np.flatnonzero(cover[within % period] & (self.room >= width) & (self.n[self.text] >= min_words))
        self.anchors, self.anchor_of, self.count = np.unique(chain_hash(self.h, width, self.at), return_inverse=True, return_counts=True)

    def covered(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Which places lie in one of the ranges."""
        n = len(self.h) + 1
        return np.cumsum(np.bincount(begin, minlength=n) - np.bincount(end, minlength=n))[:-1] > 0

    def extend(self, repeated: np.ndarray) -> None:
        """Hash every window that holds a repeated anchor at a shift below the period."""
        p = self.at[repeated[self.anchor_of].astype(bool)]
        near = self.covered(np.maximum(p - self.period + 1, self.cut[self.text[p]]), p + 1)
        self.starts = np.flatnonzero(near & (self.room >= self.min_words))
        value = chain_hash(self.h, self.min_words, self.starts)
        route = mix(value * K2 + np.uint64(77))
        ids = self.ids[self.text[self.starts]]
        order = np.lexsort((self.starts, ids, value, route))
        new = np.ones(len(order), bool)
        new[1:] = (value[order][1:] != value[order][:-1]) | (route[order][1:] != route[order][:-1])
        self.keys, self.routes, self.firsts = value[order][new], route[order][new], ids[order][new]
        self.key_of = np.empty(len(order), np.int64)
        self.key_of[order] = np.cumsum(new) - 1
        self.is_first = np.zeros(len(order), bool)
        self.is_first[order[new]] = True

    def kept(self, first_pack: np.ndarray) -> np.ndarray:
        """Which words stay."""
        gone = self.starts[~(self.is_first & first_pack[self.key_of].astype(bool))]
        return ~self.covered(gone, gone + self.min_words)

    def texts(self, keep: np.ndarray) -> list[memoryview]:
        """The kept words of each text, joined by one space, in UTF-8."""
        data, at = self.table.data[:-8].copy(), self.table.at
        start, end, text = self.table.start[keep], self.table.end[keep], self.text[keep]
        stays = np.zeros(len(data) + 1, np.int8)
        stays[start] += 1
        stays[end] -= 1
        stays = np.cumsum(stays[:-1], dtype=np.int8).astype(bool)
        blank = end[:-1][text[1:] == text[:-1]]
        data[blank], stays[blank] = 32, True
        size = np.bincount(text, end - start, len(at) - 1).astype(np.int64) + np.maximum(np.bincount(text, minlength=len(at) - 1) - 1, 0)
        body, cut = memoryview(data[stays]), np.concatenate(([0], np.cumsum(size))).tolist()
        return [body[x:y] for x, y in zip(cut[:-1], cut[1:], strict=True)]


def first_of(keys: np.ndarray, ids: np.ndarray, n: np.ndarray) -> np.ndarray:
    """1 where a key's smallest doc_id was sent (the first sender among equals), else 0."""
    order = np.lexsort((np.repeat(np.arange(len(n)), n), ids, keys))
    out = np.zeros(len(keys), np.uint8)
    if len(keys):
        k = keys[order]
        out[order[np.concatenate(([True], k[1:] != k[:-1]))]] = 1
    return out


def smallest(keys: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((ids, keys))
    keys, ids = keys[order], ids[order]
    new = np.ones(len(keys), bool)
    new[1:] = keys[1:] != keys[:-1]
    return keys[new], ids[new]


FIRST = Rule(np.int64, first_of, smallest, lambda keys, ids, n, of_group: of_group & first_of(keys, ids, n))


def dedup_substrings(docs: DataFrame, min_words: int = 20, period: int = 13, with_text: bool = False) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256[, kept]) of each row of ``docs``."""
    held = packs(docs.select("doc_id", "text"), "doc_id", "text")
    bits = bits_of(n_groups(docs.count(), 1000, 64))
    wide, shelf = width_of(4, bits), shelf_bits(bits)

    def ask(p, t):
        w = Windows(t, min_words, period)
        yield from request_rows(p, w.anchors, w.count.astype(np.uint32), shelf, wide)

    flags = lambda b: np.frombuffer(b, np.uint8)
    repeated = answers(over_packs(held, ask, ASK_DDL), wide, bits, counting(lambda n: (n >= 2).astype(np.uint8)), read=flags)

    def extended(t, rows):
        w = Windows(t, min_words, period)
        w.extend(put_together(rows, np.uint8) if len(w.anchors) else np.zeros(0, np.uint8))
        return w

    def ask_windows(p, t, rows):
        w = extended(t, rows)
        b = (w.routes >> np.uint64(64 - shelf)).astype(np.int64)
        cut = np.concatenate(([0], np.flatnonzero(np.diff(b)) + 1, [len(b)])) if len(b) else [0]
        spans = list(zip(cut[:-1], cut[1:], strict=True))
        got = {"bucket": [int(b[x]) for x, _ in spans], "pack": [p] * len(spans), "keys": [w.keys[x:y].tobytes() for x, y in spans], "extra": [w.firsts[x:y].tobytes() for x, y in spans]}
        yield pa.table(got, schema=ASK)

    first = answers(with_answers(held, repeated, ask_windows, ASK), 8, bits, FIRST, read=flags)
    fields = [("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string()), ("kept", pa.string())]
    schema = pa.schema(fields if with_text else fields[:-1])

    def remove(p, t, rows):
        late = pa.compute.greater_equal(rows.column("bucket"), 1 << shelf)
        w = extended(t, rows.filter(pa.compute.invert(late)))
        keep = w.kept(put_together(rows.filter(late), np.uint8))
        texts = w.texts(keep)
        out = {
            "doc_id": t.column("doc_id"),
            "n_words": w.n,
            "n_removed": w.n - np.bincount(w.text[keep], minlength=len(w.n)),
            "kept_sha256": [hashlib.sha256(x).hexdigest() for x in texts],
            "kept": [str(x, "utf-8") for x in texts] if with_text else None,
        }
        yield pa.table({f.name: out[f.name] for f in schema}, schema=schema)

    both = repeated.unionByName(first.withColumn("bucket", (F.col("bucket") + (1 << shelf)).cast("int")))
    return with_answers(held, both, remove, schema)


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return dedup_substrings(table(spark, sf_dir, "documents"))
