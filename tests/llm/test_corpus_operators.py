"""The ten operators against brute force, on a small table of awkward rows."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {c: c + 32 for c in range(65, 91)}
DDL = "doc_id long, text string, lang string, source string, n_chars long, score double, size long, name string, members string, pack string"


def corpus():
    rng = random.Random(4)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 6))) for _ in range(300)]
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n))
    texts = [prose(rng.randint(1, 200)) for _ in range(60)]
    passage = prose(40)
    texts += [prose(10) + " " + passage + "\n" + prose(10) for _ in range(6)]
    texts += [texts[0]] * 3 + [texts[5] + " more", texts[5].upper()]
    long = prose(6000)
    texts += [long, long[: len(long) // 2], None, "", " \t\n", "one", "one two", "x" * 20_000, "IDIOT!!! Ünï code <|endoftext|> 漢字 é", "no blanks,but@mail.example.com +1 (555) 010-1234, 4111 1111 1111 1111, 10.0.0.300, 10.0.0.3"]
    rows = [(i * 3, t, "en", "s%d" % (i % 4) if i % 9 else None, None if t is None else len(t), 0.5, 7, "n", "m", "p") for i, t in enumerate(texts)]
    return rows


ROWS = corpus()
EMPTY = []


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, DDL).repartition(3).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame(EMPTY, DDL)


def by_id(df):
    return {r.doc_id: r for r in df.collect()}


def words(t):
    return WORD.findall(t or "")


def test_pii(spark, docs, none):
    from lathe.llm import pii

    got = by_id(pii.find_spans(docs))
    last = got[ROWS[-1][0]]
    assert (last.n_email, last.n_ip, last.n_card, last.n_phone) == (1, 1, 1, 1)
    assert len(got) == len(ROWS) and sum(r.base != "" for r in got.values()) == 1
    clean = by_id(pii.sanitise(docs))
    assert clean[ROWS[-1][0]].text == "no blanks,[EMAIL] [PHONE], [CARD], 10.0.0.300, [IP]"
    assert all(clean[r[0]].text == r[1] for r in ROWS[:-1])
    assert pii.find_spans(none).count() == 0 and pii.sanitise(none).count() == 0


def test_pii_patterns_match_the_plain_ones():
    from lathe.llm.pii import base_spans, luhn

    email, ip, card, phone = (re.compile(p) for p in (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"))
    digits = lambda m: re.sub("[^0-9]", "", m[0])

    def plain(t):
        out = [("email", *m.span()) for m in email.finditer(t)]
        out += [("ip", *m.span()) for m in ip.finditer(t) if all(int(x) <= 255 for x in m[0].split("."))]
        out += [("card", *m.span()) for m in card.finditer(t) if 13 <= len(digits(m)) <= 19 and luhn(digits(m))]
        return out + [("phone", *m.span()) for m in phone.finditer(t) if 9 <= len(digits(m)) <= 15]

    rng = random.Random(2)
    for _ in range(20_000):
        t = "".join(rng.choice("a1.@+- ()9é%\n12.5") for _ in range(rng.randint(0, 60)))
        assert base_spans(t) == plain(t)
    base_spans("a" * 300_000 + "1" * 300_000 + "." * 1000 + "@" * 1000)  # linear: ends at once


def test_pii_terms_that_disclose(spark):
    from lathe.llm import pii

    rng = random.Random(1)
    filler = lambda: " ".join("".join(rng.choice("klmnop") for _ in range(5)) for _ in range(30))
    rows = [(i, f"{filler()} zanzibari a.b@c.example {filler()}" if i < 6 else filler(), "", "", 0, 0.0, 0, "", "", "") for i in range(200)]
    got = by_id(pii.find_spans(spark.createDataFrame(rows, DDL)))
    for i, t, *_ in rows:
        at = t.find("zanzibari")
        assert (f"term:{at}:{at + 9}" in got[i].spans.split(",")) == (i < 6)
        assert got[i].spans.count("term:") == (i < 6)


def test_pii_terms_far_from_the_entity(spark):
    from lathe.llm import pii

    rng = random.Random(6)
    filler = lambda n: " ".join("".join(rng.choice("klmnop") for _ in range(5)) for _ in range(n))
    far = [f"zanzibari {filler(60)} {'q' * (300 + i)} zanzibari {filler(20 + i)} a.b@c.example" for i in range(6)]
    copies = [f"{filler(20)} copied d.e@f.example"] * 6
    texts = [*far, *copies, "g.h@i.example stands once with uniqueword", *(filler(60) for _ in range(187))]
    df = spark.createDataFrame([(i, t, "", "", 0, 0.0, 0, "", "", "") for i, t in enumerate(texts)], DDL)
    got, clean = by_id(pii.find_spans(df)), by_id(pii.sanitise(df))
    for i, t in enumerate(texts):
        want = [f"term:{m.start()}:{m.end()}" for m in re.finditer("zanzibari", t)]
        assert [x for x in got[i].spans.split(",") if x.startswith("term:")] == want and len(want) == 2 * (i < 6)
        assert "zanzibari" not in clean[i].text
    assert "copied" in clean[6].text and "uniqueword" in clean[12].text


def test_pii_terms_that_disclose_a_class(spark):
    """Each address stands once; the term tells their domain."""
    from lathe.llm import pii

    rng = random.Random(3)
    filler = lambda: " ".join("".join(rng.choice("klmnop") for _ in range(5)) for _ in range(20))
    texts = [f"{filler()} AC9 {filler()} person{i}@acme.example" if i < 8 else f"{filler()} p{i}@other{i}.example" if i < 20 else filler() for i in range(300)]
    got = by_id(pii.find_spans(spark.createDataFrame([(i, t, "", "", 0, 0.0, 0, "", "", "") for i, t in enumerate(texts)], DDL)))
    assert all([texts[i][int(a) : int(b)] for _, a, b in (x.split(":") for x in got[i].spans.split(",") if x.startswith("term:"))] == ["AC9"] * (i < 8) for i in range(300))


def test_log_factorials(spark):
    from pyspark.sql import functions as F

    from lathe.llm import pii

    got = spark.createDataFrame([(n,) for n in [*range(40), 10**4, 10**9]], "n long").select("n", pii.log_factorial(F.col("n")).alias("v")).collect()
    assert all(abs(r.v - math.lgamma(r.n + 1)) <= 1e-9 * max(1.0, r.v) for r in got)


def test_pii_marks_rows_by_their_own_texts(spark):
    """Ten thousand unlike texts of one doc_id, and of none: none takes another one's marks."""
    from lathe.llm import pii

    told = [f"call zanzibari at a.b@c.example {'x' * (i + 1)}" for i in range(6)]
    rows = [(i % 2 or None, t, "", "", 0, 0.0, 0, "", "", "") for i, t in enumerate([*told, *(f"call {i}, zanzi" for i in range(10_000))])]
    clean = Counter(r.text for r in pii.sanitise(spark.createDataFrame(rows, DDL)).collect())
    assert sum(clean.values()) == len(rows) and sum("[EMAIL]" in t for t in clean) == 6 and not any("zanzibari" in t for t in clean)
    assert all(clean[f"call {i}, zanzi"] == 1 for i in range(10_000))


def test_pii_terms_by_brute_force(spark):
    """Every pair of an entity and a term of its documents, from plain counts."""
    from lathe.llm import pii

    rng = random.Random(13)
    vocabulary = ["".join(rng.choice("klmnop") for _ in range(4)) for _ in range(60)]
    texts = []
    for i in range(300):
        t = [rng.choice(vocabulary) for _ in range(rng.randint(3, 12))]
        if i % 10 == 0:
            t += ["zebra%s" % "xy"[i // 10 % 2], ("a%d@b.example" % (i // 10 % 2))] + ["ocelot"] * (i % 20 == 0)
        if i % 50 == 1:
            t += ["ocelot"]
        texts.append(" ".join(t))
    found = [pii.base_spans(t) for t in texts]
    terms = [{w for w, _, _ in pii.outside(t, s)} for t, s in zip(texts, found, strict=True)]
    own = [{v for k, a, b in s for v in pii.protected(k, t[a:b])} for t, s in zip(texts, found, strict=True)]
    n = len(texts)
    n_term, n_entity = Counter(w for x in terms for w in x), Counter(e for x in own for e in x)
    pairs = {(e, w) for x, y in zip(own, terms, strict=True) for e in x for w in y}
    told = set()
    for e, w in pairs:
        both = sum(e in x and w in y for x, y in zip(own, terms, strict=True))
        k, m = len({t for t, x, y in zip(texts, own, terms, strict=True) if e in x and w in y}), len({t for t, x in zip(texts, own, strict=True) if e in x})
        part = math.log(n * both / (n_entity[e] * n_term[w])) / math.log(n / n_entity[e])
        chance = math.lgamma(m + 1) - math.lgamma(k + 1) - math.lgamma(m - k + 1) + k * math.log(n_term[w] / n)
        if part >= 0.8 and chance + math.log(len(n_entity) * len(n_term)) <= math.log(0.05):
            told.add((e, w))
    assert {"zebrax", "zebray"} <= {w for _, w in told} and len(told) < len(pairs)
    got = by_id(pii.find_spans(spark.createDataFrame([(i, t, "", "", 0, 0.0, 0, "", "", "") for i, t in enumerate(texts)], DDL)))
    for i, t in enumerate(texts):
        want = {f"term:{a}:{b}" for w, a, b in pii.outside(t, found[i]) if any((e, w) in told for e in own[i])}
        assert {x for x in got[i].spans.split(",") if x.startswith("term:")} == want
    assert any("term:" in r.spans for r in got.values())


def test_toxicity(spark, docs, none):
    from lathe.llm import toxicity as x

    rng = random.Random(3)
    base = ["".join(rng.choice("klmnop") for _ in range(3)) for _ in range(80)]
    rows = []
    for i in range(600):
        t = [rng.choice(base) for _ in range(40)]
        if i % 5 == 0:
            t[rng.randint(0, 39)] = rng.choice(["Badword", "NASTY!!", "awful,"])
        rows.append((i, " ".join(t), "", "", 0, 0.0, 0, "", "", ""))
    df = spark.createDataFrame(rows, DDL)
    labels = spark.createDataFrame([(i, int(i % 5 == 0)) for i in range(0, 600) if i % 3] + [(None, 1), (7, None)], "doc_id long, label int")
    index = x.fit(df, labels)
    got = by_id(x.score(df, index, "doc_id"))
    assert all((got[i].score >= 0.5) == (i % 5 == 0) for i in range(600))
    text = {r[0]: r[1] for r in rows}

    def dense(texts):
        v = index.vectors(x.term_counts(pa.array(texts)))
        m = np.zeros((v.size, len(index.vocab)))
        m[v.owner, v.term] = v.weight
        return v, m

    v, queries = dense([r[1] for r in rows[:300]])
    cos = queries @ dense([text[i] for i in index.ids.tolist()])[1].T
    for near, row, r in zip(index.nearest(v), cos, rows, strict=False):
        want = sorted(((-c, i) for i, c in enumerate(row.tolist()) if c > 0))[: index.k]
        assert near == [(-c, i) for c, i in want]
        odds = [0.5 + sum(index.class_weight[y] / (1.05 - min(c, 1.0)) for c, i in near if index.label[i] == y) for y in (1, 0)]
        assert math.isclose(got[r[0]].score, 1 / (1 + math.exp(-index.a * math.log(odds[0] / odds[1]) - index.b)))
    assert len(index.ids) > 2 * x.BLOCK
    assert x.score(none, index, "doc_id").count() == 0
    blank = x.fit(none, labels.limit(0))
    assert {r.score for r in x.score(docs, blank, "doc_id").collect()} == {0.0}


def test_toxicity_bounds_examples_by_rows(spark):
    """One labelled doc_id in ten thousand unlike rows: no more examples than the bound says."""
    from lathe.llm import toxicity

    rows = [(7, f"vile word{i}") for i in range(10_000)] + [(i, f"kind word{i}") for i in range(100, 140)] + [(i, f"vile rubbish{i}") for i in range(200, 220)] + [(300, "same text")] * 50
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    labels = spark.createDataFrame([(7, 1), (300, 0)] + [(i, 0) for i in range(100, 140)] + [(i, 1) for i in range(200, 220)], "doc_id long, label int")
    index = toxicity.fit(docs, labels, max_positive=30, max_negative=60)
    assert Counter(index.label.tolist()) == {1: 30, 0: 41} and Counter(index.ids.tolist())[300] == 1
    got = {(r.doc_id, r.score) for r in toxicity.score(docs, index, "doc_id").collect() if r.doc_id >= 100}
    assert min(s for i, s in got if 200 <= i < 300) > max(s for i, s in got if i < 200)


def test_toxicity_compares_all_terms(spark):
    from lathe.llm import toxicity as x

    rng = random.Random(9)
    base = ["".join(rng.choice("klmnop") for _ in range(3)) for _ in range(200)]
    texts = [" ".join([*(rng.choice(base) for _ in range(rng.randint(1, 30))), *(["badword"] * (i % 7 == 0)), *(["only%s" % chr(97 + i % 26)] * (i % 3 == 0))]) for i in range(300)]
    df = spark.createDataFrame([(i, t, "", "", 0, 0.0, 0, "", "", "") for i, t in enumerate(texts)], DDL)
    shown = [i for i in range(300) if i % 3]
    index = x.fit(df, spark.createDataFrame([(i, int(i % 7 == 0)) for i in shown], "doc_id long, label int"))
    tf = [Counter(re.findall("[a-z]+", t)) for t in texts]
    n_docs = Counter(w for c in tf for w in c)
    n = [1 + sum((i % 7 == 0) == y for i in shown) for y in (0, 1)]

    def weight(w):
        k = [sum(w in tf[i] for i in shown if (i % 7 == 0) == y) for y in (0, 1)]
        rate = sum(k) / sum(n)
        g = sum(2 * o * math.log(o / e) for y in (0, 1) for o, e in ((k[y], n[y] * rate), (n[y] - k[y], n[y] * (1 - rate))) if o)
        return (math.log(301 / (1 + n_docs[w])) + 1) * (1 + max(g, 0) ** 0.5)

    weights = {w: weight(w) for w in n_docs}
    vecs = [{w: (1 + math.log(m)) * weights[w] for w, m in c.items()} for c in tf]
    size = [math.sqrt(sum(v * v for v in a.values())) for a in vecs]
    got = by_id(x.score(df, index, "doc_id"))
    for i, a in enumerate(vecs):
        cos = sorted((sum(v * vecs[j].get(w, 0) for w, v in a.items()) / size[i] / size[j] for j in shown), reverse=True)
        told = [float(e.split(":")[2]) for e in got[i].evidence.split(",") if e]
        assert np.allclose(told, [c for c in cos[:3] if c > 0], atol=1e-4)


def encoded(rows):
    from tokenizers import Tokenizer

    from lathe.llm.tokens import default_path

    t = Tokenizer.from_file(default_path())
    return {r[0]: np.array([*t.encode(r[1] or "", add_special_tokens=False).ids, 1], "<u4") for r in rows}


def test_encoder_agrees_with_the_tokenizer():
    from tokenizers import Tokenizer

    from lathe.llm.tokens import Encoder, default_path

    rng, t = random.Random(12), Tokenizer.from_file(default_path())
    signs = ["a", "B", "don't", "é", "Ü", "ß", "\u00d7", "ª", "µ", ".", ",", "...", "***", "!!", "&&", "'s", "'", "<|endoftext|>", "<|", "|>", ">.", "漢", "字", "\u2026", "\u00a0", "\u3000", "\x1c", "\u0301", "7", "12", " ", " ", "\n", "\t\r", "-", "(", ")", "🙂", "ﬁ"]
    texts = ["".join(rng.choice(signs) for _ in range(rng.randint(0, 12))) for _ in range(6000)] + [None, "", "x" * 5000 + "."]
    e = Encoder(default_path())
    for at in range(0, len(texts), 1500):  # later batches use what earlier ones kept
        part = texts[at : at + 1500]
        ids, n = e.batch(pa.array(part, pa.string()))
        cut = np.concatenate(([0], np.cumsum(n)))
        for text, x, y in zip(part, cut[:-1], cut[1:], strict=True):
            assert ids[x:y].tolist() == [*t.encode(text or "", add_special_tokens=False).ids, 1], repr(text)


def test_packing(spark, docs, none):
    from lathe.llm import packing

    ids, bins, pieces = encoded(ROWS), {}, Counter()
    for r in packing.pack(docs.unionByName(docs.where("doc_id = 0"))).collect():
        part = ids[r.doc_id][r.start : r.start + r.length]
        assert r.start == 4096 * r.piece and len(part) == r.length and zlib.crc32(part.tobytes()) == r.ids_crc32
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
        pieces[r.doc_id] += r.length
    for b in bins.values():
        at = 0
        for offset, n in sorted(b):
            assert offset == at
            at += n
        assert at <= 4096
    assert all(pieces[i] == len(x) * (2 if i == 0 else 1) for i, x in ids.items())
    assert packing.pack(none).count() == 0


def test_packing_plan_is_full():
    from lathe.llm.packing import plan

    got = plan({4000: 2, 90: 2, 6: 2, 5: 1, 4096: 1, 1: 3})
    used = Counter()
    for times, combo in got:
        assert sum(n * k for n, k in combo.items()) <= 4096
        used.update({n: k * times for n, k in combo.items()})
    assert used == {4000: 2, 90: 2, 6: 2, 5: 1, 4096: 1, 1: 3} and sum(t for t, _ in got) == 4


def test_language_model(spark, docs, none):
    from lathe.llm import lm

    toks = {r[0]: [*words((r[1] or "").translate(LOWER)), None] for r in ROWS}
    c, c2, ctx = Counter(), Counter(), Counter()
    for i, t in toks.items():
        if zlib.crc32(str(i).encode()) % 5 != 1:
            c.update(t)
            c2.update(zip(["<s>", *t], t, strict=False))
            ctx.update(["<s>", *t[:-1]])
    total, v = sum(c.values()), len(c)
    got = by_id(lm.interpolated_scores(docs))
    for i, t in toks.items():
        r = got[i]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(t), sum(c[w] > 0 for w in t), total)
        assert math.isclose(r.base_score, sum(math.log10((c[w] + 0.5) / (total + 0.5 * (v + 1))) for w in t), rel_tol=1e-9)
    cells, big = Counter(), Counter({w: n - 1 for w, n in c.items()})
    for i, t in toks.items():
        if zlib.crc32(str(i).encode()) % 5 != 1:
            for before, w in zip(["<s>", *t], t, strict=False):
                place = [int(lm.bins(np.array([n]))[0]) for n in (c2[before, w] - 1, ctx[before] - 1, big[w])]
                cells[(place[0] * lm.BINS + place[1]) * lm.BINS + place[2]] += 1
    lam = lm.expectation_maximisation(np.array(list(cells)), np.array(list(cells.values()), float), total, v)
    for i, t in toks.items():
        mixed = 0.0
        for before, w in zip(["<s>", *t], t, strict=False):
            a = lam[int(lm.octave(np.array([ctx[before]]))[0])]
            mixed += math.log10(a[0] * c2[before, w] / max(ctx[before], 1) + a[1] * c[w] / total + a[2] / (v + 1))
        assert math.isclose(got[i].score, mixed, rel_tol=1e-6)
    real = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    held = lm.interpolated_scores(real).where("held_out").agg({"score": "sum", "base_score": "sum"}).first()
    assert held["sum(score)"] > held["sum(base_score)"]
    assert lm.interpolated_scores(none).count() == 0


def test_expectation_maximisation_finds_the_mixture():
    from lathe.llm.lm import BINS, expectation_maximisation

    lam = expectation_maximisation(np.array([(4 * BINS + 7) * BINS + 3, (0 * BINS + 7) * BINS + 3]), np.array([60.0, 40.0]), 1000, 50)
    assert lam[3, 0] > 0.5 and abs(lam[3].sum() - 1) < 1e-9


def test_mixing(spark, docs, none):
    from lathe.llm import mixing

    got = by_id(mixing.pareto_mix(docs, mixing.n_words()))
    assert by_id(mixing.pareto_mix(docs.repartition(5), mixing.n_words())) == got
    size = {r[0]: len(words(r[1])) for r in ROWS}
    src = {r[0]: r[3] for r in ROWS}
    taken, target = Counter(), {}
    for i, r in got.items():
        assert r.size == size[i] and r.taken <= 2 * r.size and (r.taken % r.size == 0 if r.size else r.taken == 0)
        taken[src[i]] += r.taken
        target[src[i]] = r.target
    assert math.isclose(sum(target.values()), 1.5 * sum(size.values()))
    for s in target:
        own = [size[i] for i in size if src[i] == s]
        assert abs(taken[s] - target[s]) <= max(own) / 2
    assert mixing.pareto_mix(none, mixing.n_words()).count() == 0


def test_mixing_targets_and_inclusion(spark):
    """Targets by filling up step by step; of each size class the share taken is the expected copies."""
    from lathe.llm import mixing

    rng = random.Random(11)
    rows = [(i, " ".join(["w"] * rng.choice([5, 40, 300])), "en", ["a", "b", "c", "d", None][min(i % 9, 4)], 0, 0.0, 0, "", "", "") for i in range(9000)]
    got = by_id(mixing.pareto_mix(spark.createDataFrame(rows, DDL).repartition(3), mixing.n_words()))
    size, source = {r[0]: len(words(r[1])) for r in rows}, {r[0]: r[3] for r in rows}
    total = Counter()
    for i, n in size.items():
        total[source[i]] += n
    order = sorted(total, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    target, budget, open_ = {}, 1.5 * sum(total.values()), set(order)
    while open_:
        level = budget / sum(weight[s] for s in open_)
        full = {s for s in open_ if level * weight[s] >= 2 * total[s]}
        for s in full or open_:
            target[s] = 2.0 * total[s] if full else level * weight[s]
        budget -= sum(target[s] for s in full)
        open_ = open_ - full if full else set()
    assert all(math.isclose(got[i].target, target[source[i]]) and got[i].source_size == total[source[i]] for i in got)
    for s in order:
        own = [i for i in size if source[i] == s]
        classes = sorted({size[i] for i in own})
        part = {k: sum(n for n in map(size.get, own) if n == k) for k in classes}
        wish = {k: 2.0 ** (int(2 * math.log2(k)) * mixing.PARAMETERS["lean"] / 2) for k in classes}
        low, high = 0.0, 1e6  # the factor that makes the expected words the target
        for _ in range(200):
            mid = (low + high) / 2
            low, high = (mid, high) if sum(min(2.0, mid * wish[k]) * part[k] for k in classes) < target[s] else (low, mid)
        for k in classes:
            own_k = [i for i in own if size[i] == k]
            e = min(2.0, high * wish[k])
            times = [got[i].taken // k for i in own_k]
            assert set(times) <= {int(e), int(e) + 1, round(e)} or len(own_k) < 3
            p = e - int(e)
            assert abs(sum(times) / len(times) - e) < 5 * math.sqrt(max(p * (1 - p), 0.0) / len(own_k)) + 2 / len(own_k)
    assert len({round(got[i].taken / size[i], 3) for i in got}) > 1


def test_embeddings(spark):
    from lathe.llm import neighbours

    rng = np.random.default_rng(5)
    x = rng.standard_normal((300, 32))
    x[200:260] = x[7] + 0.05 * rng.standard_normal((60, 32))
    for i in range(100, 140):
        x[i] = x[i - 100] + 0.02 * rng.standard_normal(32)
    rows = [(i, v.tolist(), "c") for i, v in enumerate(x)] + [(300, None, "c"), (301, [0.0] * 32, "c"), (302, [float("nan")] * 32, "c"), (303, [None] * 32, "c"), (304, [], "c"), (305, x[3].tolist(), "c")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, component string").repartition(3)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    u = np.vstack([u, np.zeros((5, 32)), u[3]])
    near = u @ u.T >= 0.95
    np.fill_diagonal(near, False)
    got = {r.vec_id: r for r in neighbours.near_duplicates(df).collect()}
    assert sum(got[i].n_links for i in got) >= 0.99 * near.sum() and all(got[i].n_links <= near[i].sum() for i in got)
    assert all(got[i].n_links == 0 and got[i].component_id == i and got[i].kept for i in range(300, 305))
    assert neighbours.near_duplicates(df.limit(0)).count() == 0


def test_embeddings_of_a_hot_third(spark):
    from lathe.llm import neighbours

    rng = np.random.default_rng(8)
    unit = lambda v: v / np.linalg.norm(v, axis=-1, keepdims=True)
    x = unit(rng.standard_normal((6000, 64)))
    x[:2000] = unit(0.6**0.5 * unit(rng.standard_normal(64)) + 0.4**0.5 * x[:2000])
    pairs = 200
    for i in range(pairs):  # isolated pairs at cosine 0.955, half of them in the hot third
        j = i if i < pairs // 2 else 3000 + i
        d = rng.standard_normal(64)
        d = unit(d - (d @ x[j]) * x[j])
        x[j + pairs] = 0.955 * x[j] + (1 - 0.955**2) ** 0.5 * d
    x[5000:5400] = unit(x[400] + 0.02 * rng.standard_normal((400, 64)))  # a family of copies among the hot
    d = rng.standard_normal((20, 64))
    x[5400:5420] = unit(0.955 * x[5000] + (1 - 0.955**2) ** 0.5 * unit(d - np.outer(d @ x[5000], x[5000])))
    near = x @ x.T >= 0.95
    np.fill_diagonal(near, False)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>").repartition(3)
    got = {r.vec_id: r.n_links for r in neighbours.near_duplicates(df).collect()}
    assert all(got[i] <= near[i].sum() for i in got)
    single = np.flatnonzero(near.sum(1) == 1).tolist()
    assert len(single) > 300 and sum(got[i] for i in single) >= 0.99 * len(single)
    assert sum(got.values()) >= 0.99 * near.sum()


def test_substrings(spark, docs, none):
    from lathe.llm import substrings

    got, seen = by_id(substrings.dedup_substrings(docs)), set()
    for i, t, *_ in ROWS:
        w = words(t)
        keep = [True] * len(w)
        for p in range(len(w) - 19):
            g = tuple(w[p : p + 20])
            if g in seen:
                keep[p : p + 20] = [False] * 20
            seen.add(g)
        text = " ".join(x for x, k in zip(w, keep, strict=True) if k)
        assert (got[i].n_words, got[i].n_removed, got[i].kept_sha256) == (len(w), keep.count(False), hashlib.sha256(text.encode()).hexdigest())
    assert substrings.dedup_substrings(none).count() == 0


@pytest.mark.parametrize("period", [7, 13, 21, 31])
def test_covers_cover_every_difference(period):
    from lathe.llm.substrings import COVERS

    assert {(a - b) % period for a in COVERS[period] for b in COVERS[period]} == set(range(period))


def test_fingerprints(spark, docs, none):
    from lathe.llm import fingerprints

    got, rows = by_id(fingerprints.fingerprint_edits(docs)), sorted(ROWS, reverse=True, key=lambda r: r[0])
    for j, (i, t, *_) in enumerate(rows):
        t, after = t or "", rows[(j + 1) % len(rows)]
        edited = t[: len(t) - len(t) // 3] + (after[1] or "")[: len(t) // 3]
        r = got[i]
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        a, b = (np.frombuffer(bytes.fromhex(x), ">u2") for x in (r.fingerprint, got[after[0]].fingerprint))
        assert math.isclose(r.near_next, (a == b).mean())
    assert got[0].fingerprint == got[ROWS[66][0]].fingerprint and ROWS[66][1] == ROWS[0][1]
    assert fingerprints.fingerprint_edits(none).count() == 0


def test_fingerprint_by_its_definition():
    """The smallest occurrence-numbered k-mers of each slot, in text order, hashed as a tuple."""
    from lathe.llm.common import K1, K2, WordTable, chain_hash, mix
    from lathe.llm.fingerprints import OrderMinHash

    rng = random.Random(5)
    o = OrderMinHash()
    for n in (0, 1, 2, 3, 50, 400):
        text = " ".join(rng.choice("abcdefg") for _ in range(n))
        h = WordTable(pa.array([text])).hashes()
        mers = chain_hash(h, min(o.k, n)).tolist() if n else []
        seen, x = Counter(), []
        for m in mers:
            x.append(int(mix(np.array([(m + seen[m] * int(K1)) % (1 << 64)], np.uint64))[0]))
            seen[m] += 1
        want = []
        for flip, times in zip(o.flip.tolist(), o.times.tolist(), strict=True):
            least = sorted(range(len(x)), key=lambda i: ((x[i] ^ flip) * times) % (1 << 64))[: o.take]
            acc = np.array([flip], np.uint64)
            for i in [-1] * (o.take - len(least)) + sorted(least) if x else []:
                acc = mix(acc * K2 + np.uint64(x[i] if i >= 0 else 1))
            want.append(int(acc[0]) >> 48)
        assert o.of(text).tolist() == want


def test_fingerprint_orders_matter():
    from lathe.llm.fingerprints import OrderMinHash, likeness

    o, rng = OrderMinHash(), random.Random(1)
    w = ["w%d" % i for i in range(200)]
    a, near, moved = " ".join(w), " ".join(w[:190] + ["x"] * 10), " ".join(w[100:] + w[:100])
    rng.shuffle(w)
    assert likeness(o.of(a), o.of(near)) > likeness(o.of(a), o.of(moved)) > likeness(o.of(a), o.of(" ".join(w)))


@pytest.mark.parametrize("width,num,den", [(3, 9, 10), (5, 8, 10)])
def test_jaccard(spark, docs, none, width, num, den):
    from lathe.llm import jaccard

    def shingles(t):
        w = words((t or "").translate(LOWER))
        return {tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} - {()}

    sets = {r[0]: shingles(r[1]) for r in ROWS}
    up = {i: i for i in sets}

    def root(i):
        return i if up[i] == i else root(up[i])

    for i in sets:
        for j in sets:
            if i < j and sets[i] and sets[j] and den * len(sets[i] & sets[j]) >= num * len(sets[i] | sets[j]):
                a, b = root(i), root(j)
                up[max(a, b)] = min(a, b)
    got = by_id(jaccard.jaccard_components(docs, width, num, den))
    assert {i: (got[i].n_shingles, got[i].component_id) for i in got} == {i: (len(s), root(i)) for i, s in sets.items()}
    assert jaccard.jaccard_components(none).count() == 0


def test_components_of_a_path(spark):
    from lathe.llm.common import components

    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (7, 7)], "a long, b long")
    got = {r.node: r.component for r in components(edges).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100}


def test_token_files(spark, docs, none, tmp_path):
    from lathe.llm import huffman

    for k, (df, rows) in enumerate(((docs, ROWS), (none, EMPTY))):
        folder = f"file://{tmp_path}/ids{k}"
        huffman.write_ids(df, folder)
        got, start = by_id(huffman.read_ids(spark, folder)), 0
        for i, x in sorted(encoded(rows).items()):
            assert (got[i].start, got[i].n_tokens, got[i].ids_crc32, got[i].ids) == (start, len(x), zlib.crc32(x.tobytes()), x.tolist())
            start += len(x)
        assert len(got) == len(rows)


def test_code_lengths():
    from lathe.llm.huffman import Code, code_lengths

    counts = np.array([0, *[2**i for i in range(30)], 0, 7])
    n = code_lengths(counts, 8)
    used = n[counts > 0].astype(int)
    assert n.max() <= 8 and sum(2.0**-used) <= 1 and (n[counts == 0] == 0).all()
    free = code_lengths(np.array([5, 9, 12, 13, 16, 45]), 18)
    assert free.tolist() == [4, 4, 3, 3, 3, 1]
    ids = np.random.default_rng(1).choice(np.flatnonzero(counts), 5000).astype(np.uint32)
    code = Code(n)
    assert (code.decode(len(ids), *code.encode(ids)) == ids).all()


def test_pipeline(spark):
    import corpus_pipeline

    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "pii", "mixing", "packing"]
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    kept = corpus_pipeline.near_duplicates_stage(spark, docs, folder)
    assert kept.columns == docs.columns and 0 < kept.count() < docs.count()
    assert corpus_pipeline.run(spark, folder).count() > 0


def test_pipeline_stages_keep_rows_apart(spark):
    import corpus_pipeline

    rng = random.Random(7)
    prose = lambda: " ".join("".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(40))
    a, b, c, d = (prose() for _ in range(4))
    rows = [(1, a), (5, a), (5, b), (6, c), (6, c), (None, d), (None, d)]
    df = spark.createDataFrame([(i, t, "en", "s", len(t), 0.0, 0, "", "", "") for i, t in rows], DDL).repartition(3)
    kept = corpus_pipeline.near_duplicates_stage(spark, df, "")
    assert sorted((r.doc_id or 0, r.text) for r in kept.collect()) == sorted([(1, a), (5, b), (6, c), (0, d)])
    many = spark.createDataFrame([(i // 3, prose(), "en", "s%d" % (i % 3), 1, 0.0, 0, "", "", "") for i in range(60)] + [(99, a, "en", "s0", 1, 0.0, 0, "", "", "")] * 3, DDL).repartition(3)
    times, copies = Counter(r.text for r in corpus_pipeline.mixing_stage(spark, many, "").collect()), Counter(r.text for r in many.collect())
    assert times and all(n <= 2 * copies[t] for t, n in times.items())
    places = {r.place for r in corpus_pipeline.placed(many).collect()}
    assert len(places) == 63


def test_pipeline_stages_by_brute_force(spark):
    """Near duplicates against sets of shingles; mixing by words and copies; columns of any name stay."""
    import corpus_pipeline

    rows = [(i, t, lang, s, n, *rest) for i, t, lang, s, n, *rest in ROWS] + [ROWS[5], ROWS[5], (None, ROWS[5][1], *ROWS[5][2:]), (None, None, None, None, None, None, None, None, None, None)]
    names = DDL.replace("score double", "place double").replace("size long", "row long").replace("name string", "evidence string").replace("members string", "source_size string").replace("pack string", "`two words` string")
    df = spark.createDataFrame(rows, names).repartition(3)
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} - {()} for w in (words((r[1] or "").translate(LOWER)) for r in rows)]
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 10 * len(sets[i] & sets[j]) >= 8 * len(sets[i] | sets[j]):
                a, b = group[i], group[j]
                group = [b if g == a else g for g in group]
    kept = corpus_pipeline.near_duplicates_stage(spark, df, "").collect()
    assert len(kept) == len(set(group))
    smallest = {}
    for g, r in zip(group, rows, strict=True):
        smallest[g] = min(smallest.get(g, (2, 0)), (r[0] is None, r[0] or 0))
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in kept) == sorted(smallest.values())
    mixed = corpus_pipeline.mixing_stage(spark, df, "")
    assert mixed.columns == df.columns
    have, times = Counter((r[0], r[1]) for r in rows), Counter((r.doc_id, r.text) for r in mixed.collect())
    assert all(n <= 2 * have[k] and words(k[1]) for k, n in times.items())
    total = sum(len(words(r[1])) for r in rows)
    assert abs(sum(n * len(words(k[1])) for k, n in times.items()) - 1.5 * total) <= 5 * 3000
    clean = corpus_pipeline.pii_stage(spark, df, "")
    assert clean.columns == df.columns and clean.count() == len(rows)
    pieces = corpus_pipeline.packing_stage(spark, df, "")
    assert pieces.select("doc_id", "piece").count() >= len(rows)
    empty = df.limit(0)
    for stage in (corpus_pipeline.near_duplicates_stage, corpus_pipeline.pii_stage, corpus_pipeline.mixing_stage, corpus_pipeline.packing_stage):
        assert stage(spark, empty, "").count() == 0


def test_toxicity_stage(spark, tmp_path):
    """Rows go by their own texts: repeated rows, ties, rows of one or no doc_id, nulls, names that clash."""
    import corpus_pipeline as p
    from lathe.llm import toxicity

    rows = [(i, f"{'vile rubbish scum' if i % 3 == 0 else 'kind gentle words'} number{i % 7} thing{i}") for i in range(120)]
    rows += [(505, "vile rubbish scum again")] * 3 + [(506, "vile scum thing6"), (506, "kind words thing6"), (None, "vile rubbish scum"), (None, "gentle words"), (900, None), (901, ""), (902, " \n")]
    full = [(i, t, "en", "s", None if t is None else len(t), 0.25, 1, "n", "m", "p") for i, t in rows]
    docs = spark.createDataFrame(full, DDL).repartition(3)
    spark.createDataFrame([(i, 1, int(i % 3 == 0)) for i in range(120)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    got = p.toxicity_stage(spark, docs, str(tmp_path))
    assert got.columns == docs.columns
    index = toxicity.fit(docs, toxicity.training_labels(spark, str(tmp_path)))
    scores = {(r.doc_id, r.text): r["judged"] for r in toxicity.scored(docs, index, ("doc_id", "text"), "judged", None).collect()}
    assert Counter((r.doc_id, r.text) for r in got.collect()) == Counter((i, t) for i, t in rows if scores[i, t] < 0.5)
    kept = {(r.doc_id, r.text) for r in got.collect()}
    assert all((t is not None and "vile" in t) != ((i, t) in kept) for i, t in rows)
    assert p.toxicity_stage(spark, docs.limit(0), str(tmp_path)).count() == 0


def test_pii_stage_by_brute_force(spark):
    import corpus_pipeline as p
    from lathe.llm import pii

    texts = ["mail a.b@c.example now", "10.0.0.1 and +1 (555) 010-1234", "4111 1111 1111 1111!", None, "", "nothing", "mail a.b@c.example now"]
    rows = [(i // 2 if i % 5 else None, t, "en", "s", None if t is None else len(t), 0.5, 7, "n", "m", "p") for i, t in enumerate(texts)]
    want = Counter()
    for i, t, *rest in rows:
        clean = None if t is None else pii.replaced(t, [(a, b, f"[{k.upper()}]") for k, a, b in pii.base_spans(t)])
        want[(i, clean, *rest[:2], None if clean is None else len(clean), *rest[3:])] += 1
    got = p.pii_stage(spark, spark.createDataFrame(rows, DDL).repartition(2), "")
    assert Counter(map(tuple, got.collect())) == want and "[EMAIL]" in str(want) and "[CARD]" in str(want)


def test_packing_stage_by_brute_force(spark, monkeypatch):
    """Pieces are the texts' own ids, cut at 4096; sequences are gapless; and no fewer sequences than ids allow, few more."""
    import public_tokenizers as P
    from tokenizers import Tokenizer

    import corpus_pipeline as p

    t = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    rng = random.Random(8)
    texts = [" ".join(rng.choice(["one", "two", "three", "x"]) for _ in range(rng.choice([3, 50, 900, 2000, 5000]))) for _ in range(60)] + [None, "", texts_twice := "again and again", texts_twice]
    rows = [(i, t, "en", "s", 0, 0.0, 0, "n", "m", "p") for i, t in enumerate(texts)]
    got = p.packing_stage(spark, spark.createDataFrame(rows, DDL), "").collect()
    pieces = {(r.doc_id, r.piece): r for r in got}
    assert len(pieces) == len(got)
    for i, text in enumerate(texts):
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 1]
        for k, at in enumerate(range(0, len(ids), 4096)):
            part = np.array(ids[at : at + 4096], "<u4").tobytes()
            r = pieces.pop((i, k))
            assert (r.start, r.length, r.ids_crc32) == (at, len(part) // 4, zlib.crc32(part))
    assert not pieces
    sequences = {}
    for r in got:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 4096
    total = sum(r.length for r in got)
    assert -(-total // 4096) <= len(sequences) <= -(-total // 4096) + 2


@pytest.mark.parametrize("name", ["op6_embedding_dedup", "op7_substring_dedup", "op9_jaccard_join"])
def test_queries_match_their_sql(spark, name):
    import duckdb

    from lathe.llm import queries

    folder, duck = "/root/testdata/sf0.001", duckdb.connect()
    for table in ("documents", "embeddings"):
        duck.sql(f"create view {table} as select * from '{folder}/{table}.parquet'")
    got, want = queries.QUERIES[name](spark, folder), duck.sql(queries.ORACLE_SQL[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert sorted(map(tuple, got.select(want.columns).collect())) == sorted(want.fetchall())


def test_two_steps_answer_as_one_does(spark, docs, monkeypatch):
    """With more buckets than one step deals to, keys travel through shelves and groups of packs."""
    from lathe.llm import jaccard, lm, packs, substrings

    many = docs.unionByName(docs.withColumn("doc_id", docs.doc_id + 1000)).repartition(24)
    run = lambda: [sorted(map(tuple, f(many).collect()), key=str) for f in (jaccard.jaccard_components, lm.interpolated_scores, substrings.dedup_substrings)]
    one = run()
    monkeypatch.setattr(packs, "FAN", 3)
    for a, b in zip(one, run(), strict=True):
        for x, y in zip(a, b, strict=True):
            assert all(math.isclose(p, q, rel_tol=1e-9) if isinstance(p, float) else p == q for p, q in zip(x, y, strict=True))
