"""Ranked search, exact top-k and tokenizer alignment against the contracts taken literally."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

DDL = "doc_id long, text string, score long, shard long, pack string, rank int, groups string"


def frame(spark, rows, n=3):
    return spark.createDataFrame([(i, t, 1, 2, "p", 3, "g") for i, t in rows], DDL).repartition(n)


# --- ranked search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def ranked(docs, items, k):
    docs = [(i, Counter(TERM.findall((t or "").translate(LOWER)))) for i, t in docs]
    docs = [(i, c) for i, c in docs if c]
    n_docs, n_terms = len(docs), sum(sum(c.values()) for _, c in docs)
    df = Counter(t for _, c in docs for t in c)
    out = []
    for item, text in items:
        found = []
        for i, c in docs:
            m = 100 - 50 + (50 * sum(c.values()) * n_docs) // n_terms
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1_000_000_000 * c[t]) // (1000 * c[t] + 20 * m)) for t in set(TERM.findall((text or "").translate(LOWER))) if t in c)
            if s > 0:
                found.append((-s, i is None, i or 0))
        out += [(item, r + 1, None if null else i, -s) for r, (s, null, i) in enumerate(sorted(found)[:k])]
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(7)
    vocabulary = ["".join(rng.choice("abcdé1") for _ in range(rng.randint(1, 5))) for _ in range(80)]
    prose = lambda n: rng.choice([" ", ", ", "\n", "\x7f", "--"]).join(rng.choice(vocabulary).title() for _ in range(n))
    rows = [(i, prose(rng.randint(0, 60))) for i in range(250)]
    rows += [(900 + i, rows[3][1]) for i in range(70)] + [(3, rows[3][1]), (None, rows[3][1]), (None, prose(9)), (5, prose(4000)), (2000, None), (2001, ""), (2002, " \t.,"), (2003, "漢字 ÀB ß_ẞ x\x00y")]
    items = [(i, prose(rng.randint(1, 20))) for i in range(25)] + [(100, rows[3][1]), (101, None), (102, ""), (103, "zzzz"), (104, "à b ẞ x 漢字"), (105, "a a a")]
    return rows, items


def test_search_ranks_as_the_contract_says(spark, corpus, monkeypatch):
    from lathe.llm import search

    rows, items = corpus
    docs, asked = frame(spark, rows), spark.createDataFrame(items, "item_id int, text string")
    got = lambda k: sorted((tuple(r) for r in search.search(docs, asked, k).collect()), key=str)
    assert got(50) == ranked(rows, items, 50)
    monkeypatch.setattr(search, "BLOCK_ROWS", 4)  # several blocks of queries
    monkeypatch.setattr(search, "WAITING", 20)  # merged again and again in a task
    assert got(3) == ranked(rows, items, 3)


def test_search_of_and_in_nothing(spark, corpus):
    from lathe.llm import search

    rows, items = corpus
    docs, asked = frame(spark, rows), spark.createDataFrame(items, "item_id int, text string")
    assert search.search(docs.limit(0), asked).count() == search.search(docs, asked.limit(0)).count() == 0
    assert search.search(docs.where("doc_id > 1999 AND doc_id < 2003"), asked).count() == 0


def test_equal_queries_are_searched_each(spark):
    from lathe.llm import search

    docs, asked = frame(spark, [(1, "a b"), (2, "b c")]), spark.createDataFrame([(7, "a"), (7, "a"), (7, "c"), (None, "b")], "item_id int, text string")
    got = Counter((r.item_id, r.rank, r.doc_id) for r in search.search(docs, asked).collect())
    assert got == Counter({(7, 1, 1): 2, (7, 1, 2): 1, (None, 1, 1): 1, (None, 2, 2): 1})


def test_shards_hold_impacts_and_numbers_of_any_size():
    from lathe.llm import search

    t = pa.table({"doc_id": pa.array([2, None, 1]), "text": ["b a a", "c", "a"]})
    huge = 1 << 61  # 50 n N is beyond 64 bits
    for n_docs, n_terms in ((3, 5), (huge, huge)):
        s = search.shard_of(t, n_docs, n_terms)
        p = search.unpacked(s.column("postings")[0].as_py())
        words = search.unpacked(s.column("terms")[0].as_py()).column("term").to_pylist()
        ends = search.unpacked(s.column("terms")[0].as_py()).column("end").to_pylist()
        assert search.unpacked(s.column("docs")[0].as_py()).column("doc_id").to_pylist() == [1, 2, None]
        got = {(w, p.column("place")[j].as_py()): p.column("impact")[j].as_py() for i, w in enumerate(words) for j in range(ends[i - 1] if i else 0, ends[i])}
        m = {d: 50 + 50 * n * n_docs // n_terms for d, n in enumerate((1, 3, 1))}
        assert got == {(w, d): 10**9 * tf // (1000 * tf + 20 * m[d]) for w, d, tf in (("a", 0, 1), ("a", 1, 2), ("b", 1, 1), ("c", 2, 1))}


def test_highest_keeps_ties_in_order():
    from lathe.llm.search import highest

    rng = np.random.default_rng(1)
    for _ in range(200):
        s = rng.integers(0, 4, rng.integers(0, 30))
        k = int(rng.integers(1, 8))
        assert highest(s, k).tolist() == sorted(sorted(np.flatnonzero(s > 0).tolist(), key=lambda i: (-s[i], i))[:k])


# --- exact top-k

def best_vectors(rows, k):
    q = [(place, i, [math.floor(256 * float(x)) for x in v]) for place, (i, v) in enumerate(rows) if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for place, i, v in q:
        if i is None or i % 50:
            continue
        found = sorted((-max(-(1 << 63), min((1 << 63) - 1, sum(a * b for a, b in zip(v, w, strict=True)))), j is None, j or 0) for other, j, w in q if other != place and len(w) == len(v))
        out += [(i, r + 1, None if null else j, -s) for r, (s, null, j) in enumerate(found[:k])]
    return sorted(out, key=str)


@pytest.mark.parametrize("kind", ["float", "double"])
def test_top_k_is_exact(spark, kind, monkeypatch):
    from lathe.llm import bitslices

    rng = np.random.default_rng(2)
    number = np.float32 if kind == "float" else np.float64
    rows = [(i, rng.normal(size=6).astype(number).tolist()) for i in range(-100, 400)]
    rows += [(1000 + i, rows[100][1]) for i in range(90)] + [(i, rows[int(i)][1]) for i in (50, 50, 51)]  # copies, ids that repeat
    rows += [(2000, None), (2050, [1.0, None, 0, 0, 0, 0]), (2100, [float("nan")] * 6), (2150, [float("inf")] + [0.0] * 5), (2200, []), (2250, []), (2300, [1.5, -2.5]), (2301, [0.25, 3.0]), (2350, [0.0] * 6), (None, rows[3][1]), (None, [1.0] * 6)]
    rows += [(3000, [1e5, -1e5, 1e5, 0, 0, 0]), (3050, [3e12] * 6), (3051, [-3e12] * 6), (3100, [1e30] + [0.0] * 5)]  # beyond what bitmaps add
    rows = [(i, None if v is None else [None if x is None else float(number(x)) for x in v]) for i, v in rows]
    df = spark.createDataFrame([(i, v, "l", 1) for i, v in rows], f"vec_id long, embedding array<{kind}>, label string, score int").repartition(3)
    got = lambda k: sorted((tuple(r) for r in bitslices.top_k(df, k).collect()), key=str)
    assert got(5) == best_vectors(rows, 5)
    monkeypatch.setattr(bitslices, "LEAST_ROWS", 64)
    monkeypatch.setattr(bitslices, "BLOCK_BYTES", 400)
    monkeypatch.setattr(bitslices, "WAITING", 30)
    assert got(3) == best_vectors(rows, 3)


def test_top_k_of_nothing(spark):
    from lathe.llm import bitslices

    none = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert bitslices.top_k(none).count() == 0
    one = spark.createDataFrame([(50, [1.0])], "vec_id long, embedding array<float>")
    assert bitslices.top_k(one).count() == 0  # nothing beside itself
    assert bitslices.top_k(one.where("vec_id > 60")).count() == 0


def test_sums_of_bitmaps():
    from lathe.llm import bitslices as B

    rng = np.random.default_rng(3)
    for _ in range(60):
        rows, dim = int(rng.integers(1, 200)), int(rng.integers(1, 9))
        x = rng.integers(-300, 300, (rows, dim)).astype(float)
        w = rng.integers(-300, 300, dim).astype(float)
        s = B.Searcher(B.Shard.of_values(pa.array(range(rows)), x))
        got = dict(zip(*(a.tolist() for a in s.search(w, 300.0, None, rows)), strict=True))
        assert got == dict(enumerate((x @ w).astype(int).tolist()))
        assert (s.s.values(np.arange(rows)) == x).all()
        digits = B.signed_powers(w.astype(np.int64))
        assert (digits.T @ (1 << np.arange(len(digits))) == w).all() and not (digits[1:] * digits[:-1]).any()


# --- alignment of tokenizers

def aligned(docs):
    import public_tokenizers as P
    import sentencepiece
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    sp = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte = {chr(b): b for b in plain}
    for b in range(256):
        if b not in plain:
            byte[chr(256 + len(byte) - len(plain))] = b
    out = []
    for doc_id, text in docs:
        row = (doc_id, 0, 0, 0, [], "")
        if text:
            e = t.encode(" " + text, add_special_tokens=False)
            a = [(i, bytes(byte[c] for c in x)) for i, x in zip(e.ids, e.tokens, strict=True)]
            b = []
            for i in sp.encode(text):
                p = sp.id_to_piece(i)
                b.append((i, bytes([int(p[3:5], 16)]) if sp.is_byte(i) else p.replace("▁", " ").encode()))
            if b"".join(x for _, x in a) == b"".join(x for _, x in b) == (" " + text).encode():
                spans = []
                for side in (a, b):
                    ends = np.cumsum([len(x) for _, x in side]).tolist()
                    spans.append([(i, end - len(x), end) for (i, x), end in zip(side, ends, strict=True)])
                cuts = sorted({s[2] for s in spans[0]} & {s[2] for s in spans[1]})
                groups, links, low, done = [], [], 0, [0, 0]
                for c in cuts:
                    part = []
                    for k in (0, 1):
                        j = done[k]
                        while j < len(spans[k]) and spans[k][j][2] <= c:
                            j += 1
                        part.append(spans[k][done[k] : j])
                        done[k] = j
                    groups.append(",".join(str(s[0]) for s in part[0]) + "|" + ",".join(str(s[0]) for s in part[1]))
                    links += [(x[0], y[0]) for x in part[0] for y in part[1] if max(x[1], y[1]) < min(x[2], y[2])]
                    low = c
                row = (doc_id, len(a), len(b), len(groups), links, ";".join(groups))
        out.append(row)
    count = Counter(p for r in out for p in set(r[4]))
    top = defaultdict(int)
    for (x, _), n in count.items():
        top[x] = max(top[x], n)
    return [(d, na, nb, ng, len(ls), sum(count[p] == top[p[0]] for p in ls), sum(count[p] for p in ls), hashlib.sha256(g.encode()).hexdigest() if g else "", g) for d, na, nb, ng, ls, g in out]


BITS = ["the", " ", "  ", "\n", "\n\n", " \n", "\t", "\r\n", "é", "ñ", " ", " ", "▁", "<|endoftext|>", "don't", "　", "\x85", "漢字", "😀", "\x00", "​", "é", "123,456", " .", "<unk>", "<0x0A>", "a", "B", "\x1c", " \x1c ", "﻿", "ﬁ", " ", "\r", "{\r", ";\r\n"]


def test_alignment_against_the_contract(spark, monkeypatch):
    from lathe.llm import alignment

    rng = random.Random(5)
    rows = [(i, "".join(rng.choice(BITS) for _ in range(rng.randint(0, 12)))) for i in range(1500)]
    rows += [(None, "a b"), (None, None), (7, "a b"), (7, "a b"), (8, ""), (9, " "), (10, "x " * 20_000), (11, "y" * 5000)]
    want = sorted(aligned(rows), key=str)
    got = alignment.align(frame(spark, rows), with_groups=True)
    assert sorted((tuple(r) for r in got.collect()), key=str) == want
    monkeypatch.setattr(alignment, "BUCKET", 50)  # many buckets, packs that ask in several parts, counts handed on early
    monkeypatch.setattr(alignment, "ASKING", 2)
    assert sorted((tuple(r) for r in alignment.align(frame(spark, rows)).collect()), key=str) == [w[:-1] for w in want]
    assert alignment.align(frame(spark, []), with_groups=True).count() == 0
    assert [tuple(r)[1:] for r in alignment.align(frame(spark, [(1, None), (2, "")])).collect()] == [(0, 0, 0, 0, 0, 0, "")] * 2


def test_pair_counts_do_not_depend_on_packs(spark, monkeypatch):
    import public_tokenizers as P

    from lathe.llm import alignment

    rng = random.Random(6)
    rows = [(i, " ".join(rng.choice(["don't", "stop", "Überlänge", "naïve", "12"]) for _ in range(rng.randint(0, 9)))) for i in range(300)]
    paths = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")
    count = lambda: {r.pair: r.n for r in alignment.pair_counts(alignment.alignments(frame(spark, rows), *paths)).collect()}
    whole = count()
    monkeypatch.setattr(alignment, "PACK_ROWS", 10)
    monkeypatch.setattr(alignment, "HELD", 4)
    assert count() == whole and max(whole.values()) > 100


def test_queries_match_sql(spark):
    import duckdb

    import __spark_entry__ as entry

    duck, d = duckdb.connect(), "/root/testdata/sf0.001"
    for t in ("documents", "benchmark", "embeddings"):
        duck.sql(f"create view {t} as select * from '{d}/{t}.parquet'")
    for name in ("op11_ranked_search", "op12_exact_topk"):
        got = entry.queries()[name](spark, d).toPandas()
        want = duck.sql(entry.oracle_sql()[name]).df()
        cols = sorted(got.columns)
        assert cols == sorted(want.columns) and sorted(got[cols].values.tolist()) == sorted(want[cols].values.tolist()) and len(got)


def test_alignment_query_against_the_contract(spark):
    import __spark_entry__ as entry

    d = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{d}/documents.parquet").collect()]
    got = entry.queries()["op13_cross_tokenizer"](spark, d)
    assert sorted(map(tuple, got.collect())) == sorted(w[:-1] for w in aligned(rows))
