"""Personal data, and terms that disclose it.

Base findings are patterns: e-mail addresses, IPv4 addresses, card numbers (Luhn) and phone
numbers. Each distinct value is a protected entity, and so is each class of values (a domain, a
network, a prefix): what a term tells of several people is told, too. All terms of the documents that hold an entity
are tested by information theory (a term is two or more letters or digits): with document counts over the whole corpus,
``PMI(c; t) / IC(c)`` is the part of the entity's information that the term reveals, 1
meaning that whoever reads the term knows the entity. A term is generalised from
``generalise`` on and removed from ``remove`` on, wherever it stands in a document that holds the
entity. Chance is ruled out by a test at ``level`` over all pairs of an entity and a term: the
binomial bound on so many different texts with both (copies of one text count once). Base findings
always stay.

Only documents that hold an entity carry their terms, in one row each; the corpus contributes one
count a distinct term and task. Null and empty texts have no findings. Rows of equal doc_id and text
get the same findings. All scans are linear in the text, also for very long runs.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batch_of, materialise, release, small_batches, table, text_of, word_hashes

KINDS = ("email", "ip", "card", "phone")
#: The patterns. Possessive repeats and a look-behind keep them linear; they match what the plain ones match.
LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT, PLUS = re.compile(r"[0-9]"), re.compile(r"\+[0-9]")
TERM = re.compile(r"[^\W_]{2,}")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    out, free, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append((start, m.end()))
            free = m.end()
        at = text.find("@", m.end() if m else at + 1)
    return out


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) by kind as listed, then start; code points, end exclusive."""
    out = [("email", s, e) for s, e in emails(text)] if "@" in text else []
    if DIGIT.search(text):
        out += [("ip", m.start(), m.end()) for m in IP.finditer(text) if all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or 0) <= 255 for x in m.group().split("."))]
        for m in CARD.finditer(text):
            if m.end() - m.start() >= 13:
                digits = m.group().replace(" ", "").replace("-", "")
                if 13 <= len(digits) <= 19 and luhn(digits):
                    out.append(("card", m.start(), m.end()))
        if PLUS.search(text):
            out += [("phone", m.start(), m.end()) for m in PHONE.finditer(text) if 9 <= sum(c.isdigit() for c in m.group()) <= 15]
    return out


def protected(kind: str, found: str) -> tuple[str, str]:
    """What a finding stands for: its value, and the class that it shares with others: an address's domain, a
    network's first two numbers, the first six digits of a card or telephone number."""
    if kind == "email":
        return f"email:{found.lower()}", f"domain:{found.lower().rpartition('@')[2]}"
    if kind == "ip":
        return f"ip:{found}", f"network:{'.'.join(found.split('.')[:2])}"
    digits = re.sub("[^0-9]", "", found)
    return f"{kind}:{digits}", f"{kind} prefix:{digits[:6]}"


def outside(text: str, taken: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """All terms of a text outside its findings."""
    out, ends, k = [], sorted((s, e) for _, s, e in taken), 0
    reach = 0
    for m in TERM.finditer(text):
        while k < len(ends) and ends[k][0] < m.end():
            reach, k = max(reach, ends[k][1]), k + 1
        if reach <= m.start():
            out.append((m.group().lower(), m.start(), m.end()))
    return out


LISTS = {"entities": pa.list_(pa.int64()), "terms": pa.list_(pa.int64()), "starts": pa.list_(pa.int32()), "ends": pa.list_(pa.int32())}
ROW = pa.schema([("tag", pa.int32()), ("doc_id", pa.int64()), ("fp", pa.int64()), *((f"n_{k}", pa.int64()) for k in KINDS), ("base", pa.string()), *LISTS.items(), ("term", pa.int64()), ("n", pa.int64())])
ROW_DDL = "tag int, doc_id long, fp long, n_email long, n_ip long, n_card long, n_phone long, base string, entities array<long>, terms array<long>, starts array<int>, ends array<int>, term long, n long"


def signed(h: int) -> int:
    return h - (1 << 64) if h >> 63 else h


def gather(docs: DataFrame) -> DataFrame:
    """One pass: a row a document (tag 0), the entities and terms of a document that holds an
    entity (1), document counts of terms outside findings (2). Counts are flushed before they outgrow a task."""

    def rows(tag, **cols):
        n = len(next(iter(cols.values())))
        return batch_of({f.name: [tag] * n if f.name == "tag" else cols.get(f.name, [None] * n) for f in ROW}, ROW)

    def counts(seen):
        items = list(seen.items())
        for i in range(0, len(items), 50_000):
            yield rows(2, term=[signed(k) for k, _ in items[i : i + 50_000]], n=[v for _, v in items[i : i + 50_000]])

    def run(batches):
        h, seen = word_hashes(), Counter()
        for b in batches:
            d = {k: [] for k in ("doc_id", "fp", "n_email", "n_ip", "n_card", "n_phone", "base")}
            c = {k: [] for k in ("doc_id", "fp", *LISTS)}
            for i, text, fp in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), b.column("fp").to_pylist(), strict=True):
                text = text_of(text)
                spans = base_spans(text)
                found = outside(text, spans) if spans else []
                seen.update(map(h.__getitem__, {t for t, _, _ in found} if spans else {t.lower() for t in set(TERM.findall(text))}))
                n = Counter(k for k, _, _ in spans)
                for k, v in zip(d, (i, fp, *(n[x] for x in KINDS), ",".join(f"{k}:{s}:{e}" for k, s, e in spans)), strict=True):
                    d[k].append(v)
                if found:
                    entities = sorted({signed(h[v]) for kind, s, e in spans for v in protected(kind, text[s:e])})
                    for k, v in zip(c, (i, fp, entities, [signed(h[t]) for t, _, _ in found], [x for _, x, _ in found], [y for _, _, y in found]), strict=True):
                        c[k].append(v)
            yield rows(0, **d)
            if c["terms"]:
                yield rows(1, **c)
            if len(seen) > 200_000:
                yield from counts(seen)
                seen.clear()
        yield from counts(seen)
        seen.clear()
        release()

    return materialise(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("fp")).mapInArrow(run, ROW_DDL))


#: Ln 0! to ln 9!.
LOG_FACTORIALS = [math.lgamma(n + 1) for n in range(10)]


def log_factorial(n: Column) -> Column:
    """ln n!, by a table below 10 and Stirling's series (an error below 1e-11) from there on."""
    x = F.greatest(n, F.lit(10)).cast("double")
    series = x * F.log(x) - x + 0.5 * F.log(2 * math.pi * x) + 1 / (12 * x) - 1 / (360 * x * x * x) + 1 / (1260 * F.pow(x, F.lit(5.0)))
    return F.when(n < 10, F.element_at(F.array(*[F.lit(v) for v in LOG_FACTORIALS]), F.least(n, F.lit(9)).cast("int") + 1)).otherwise(series)


def disclosing(found: DataFrame, level: float, generalise: float, remove: float) -> DataFrame:
    """(doc_id, fp, marks) of documents with terms that disclose an entity of theirs: where each stands, in order, and
    whether it is removed. Only texts that hold an entity which can be disclosed at all send their terms; equal
    texts send them once."""
    held = found.where("tag = 1")
    entities = materialise(held.select("fp", F.explode("entities").alias("entity")).groupBy("entity").agg(F.count("*").alias("n_entity"), F.countDistinct("fp").alias("texts")))
    terms = materialise(found.where("tag = 2").groupBy("term").agg(F.sum("n").alias("n_term")))
    total, all_terms = found.where("tag = 0").count(), terms.count()
    all_entities, most = entities.agg(F.count("*"), F.coalesce(F.max("n_entity"), F.lit(1))).first()
    allowed = math.log(level) - math.log(max(all_entities, 1) * max(all_terms, 1))
    # an entity of t texts is at its least likely by chance with a term of those t texts alone; of most entities even that is within chance
    texts, n_entity, n_term, k = (F.col(c) for c in ("texts", "n_entity", "n_term", "k"))
    worth = entities.where((n_entity < total) & ((texts * math.e >= total) | (texts * F.log(texts / total) <= allowed)))
    # a term in more documents than this reveals less than ``generalise`` even if it stands in all documents of the most frequent entity
    rare = terms.where(n_term <= 1.000001 * total * (most / max(total, 1)) ** generalise)
    own = materialise(held.select("fp", F.explode("entities").alias("entity")).groupBy("fp", "entity").agg(F.count("*").alias("n")).join(worth, "entity"))
    bodies = held.select("fp", "terms").join(own.select("fp").distinct(), "fp", "left_semi").dropDuplicates(["fp"]).select("fp", F.explode(F.array_distinct("terms")).alias("term"))
    pairs = bodies.join(rare, "term").join(own, "fp").groupBy("entity", "term", "n_term", "n_entity", "texts").agg(F.sum("n").alias("both"), F.count("*").alias("k"))
    x = pairs.withColumn("part", F.log(total * F.col("both") / (n_entity * n_term)) / F.log(total / n_entity)).where(F.col("part") >= generalise)
    ways = log_factorial(texts) - log_factorial(k) - log_factorial(texts - k)
    told = x.where(ways + k * F.log(n_term / total) <= allowed).select("entity", "term", "part")
    told = told.join(own.select("fp", "entity"), "entity").groupBy("fp", "term").agg(F.max("part").alias("part"))
    told = told.groupBy("fp").agg(F.collect_list(F.struct("term", "part")).alias("told"))  # a text's own terms at most

    def run(batches):
        for b in batches:
            marks = []
            for *places, of in zip(*(b.column(c) for c in (*list(LISTS)[1:], "told")), strict=True):
                terms, starts, ends = (x.values.to_numpy(zero_copy_only=False) for x in places)
                known, part = (x.to_numpy(zero_copy_only=False) for x in of.values.flatten())
                order = np.argsort(known)
                at = order[np.minimum(np.searchsorted(known[order], terms), len(known) - 1)]
                hit = np.flatnonzero(known[at] == terms)
                marks.append([{"start": s, "end": e, "removed": r} for s, e, r in zip(starts[hit].tolist(), ends[hit].tolist(), (part[at[hit]] >= remove).tolist(), strict=True)])
            yield batch_of({"doc_id": b.column("doc_id"), "fp": b.column("fp"), "marks": marks}, MARKS)
        release()

    return held.select("doc_id", "fp", *list(LISTS)[1:]).join(told, "fp").mapInArrow(run, MARKS_DDL).dropDuplicates(["doc_id", "fp"])


MARKS = pa.schema([("doc_id", pa.int64()), ("fp", pa.int64()), ("marks", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("removed", pa.bool_())])))])
MARKS_DDL = "doc_id long, fp long, marks array<struct<start:int,end:int,removed:boolean>>"
PARAMETERS = {"level": 0.05, "generalise": 0.8, "remove": 0.95}


def find_spans(docs: DataFrame, level: float = 0.05, generalise: float = 0.8, remove: float = 0.95) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base, spans) of each row of ``docs``."""
    found = gather(docs)
    more = disclosing(found, level, generalise, remove).select(F.col("doc_id").alias("d2"), F.col("fp").alias("f2"), F.col("marks").alias("terms"))
    x = found.where("tag = 0").select("doc_id", "fp", *[f"n_{k}" for k in KINDS], "base")
    x = x.join(more, x["doc_id"].eqNullSafe(more["d2"]) & (x["fp"] == more["f2"]), "left")
    words = F.transform("terms", lambda t: F.concat(F.lit("term:"), t["start"].cast("string"), F.lit(":"), t["end"].cast("string")))
    spans = F.array_join(F.filter(F.concat(F.array("base"), F.coalesce(words, F.array().cast("array<string>"))), lambda s: s != ""), ",")
    return x.select("doc_id", *[f"n_{k}" for k in KINDS], "base", spans.alias("spans"))


def sanitise(docs: DataFrame, level: float = 0.05, generalise: float = 0.8, remove: float = 0.95) -> DataFrame:
    """``docs`` with findings replaced by ``[EMAIL]`` and the like, disclosing terms by
    ``[TERM]`` or removed, and n_chars (if there) set to the new length. All rows stay."""
    found = gather(docs)
    more = disclosing(found, level, generalise, remove).select(F.col("doc_id").alias("__d"), F.col("fp").alias("__f"), F.col("marks").alias("__terms"))
    x = docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row"))
    x = x.withColumn("__fp", F.xxhash64("row.text"))  # a row takes the marks of its own text alone
    x = x.join(more, F.col("row.doc_id").cast("long").eqNullSafe(F.col("__d")) & (F.col("__fp") == F.col("__f")), "left")
    names = docs.columns

    def run(batches):
        for b in batches:
            rows = b.column("row")
            cols = dict(zip(names, rows.flatten(), strict=True))
            texts = []
            for text, rest in zip(cols["text"].to_pylist(), b.column("__terms").to_pylist(), strict=True):
                if text is not None:
                    spans = [(s, e, f"[{k.upper()}]") for k, s, e in base_spans(text)]
                    spans += [(t["start"], t["end"], "" if t["removed"] else "[TERM]") for t in rest or ()]
                    text = replaced(text, spans)
                texts.append(text)
            if "n_chars" in cols:
                cols["n_chars"] = pa.array([None if t is None else len(t) for t in texts], cols["n_chars"].type)
            cols["text"] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays(list(cols.values()), names=names)
        release()

    return x.select("row", "__terms").mapInArrow(run, docs.schema)


def replaced(text: str, spans: list[tuple[int, int, str]]) -> str:
    """``text`` with spans replaced; overlapping ones become the first one's mark."""
    out, at = [], 0
    for s, e, mark in sorted(spans):
        if s < at:
            if e > at:
                at = e
            continue
        out += [text[at:s], mark]
        at = e
    return "".join([*out, text[at:]])


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    got = find_spans(table(spark, sf_dir, "documents"), **PARAMETERS)
    return got.select("doc_id", *[f"n_{k}" for k in KINDS], F.sha2("base", 256).alias("base_sha256"), "spans")
