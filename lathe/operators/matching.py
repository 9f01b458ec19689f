"""Many patterns in many texts, and names that are like others: joins without comparing all pairs.

Containment runs an automaton of all patterns over each text once. Patterns come in bounded blocks, so
neither side has to be small. Similarity goes through an index of letter pairs: two strings whose
ratio reaches the cutoff share so many that their rarest ones must meet.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from difflib import SequenceMatcher

import ahocorasick
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import from_arrow_schema

from lathe.sources.scratch import blocks, written


def automaton(patterns: list[str]) -> ahocorasick.Automaton:
    """Finds the numbers of the patterns that occur in a text; the empty one is left to the caller."""
    found = ahocorasick.Automaton()
    for i, p in enumerate(patterns):
        if p:
            found.add_word(p, i)
    if len(found):
        found.make_automaton()
    return found


def occurring(found: ahocorasick.Automaton, text: str) -> set[int]:
    return {i for _, i in found.iter(text)} if len(found) and text else set()


def containing(texts: DataFrame, key: str, text: str, patterns: DataFrame, name: str, pattern: str) -> DataFrame:
    """(key, name), once each row of ``texts`` and of ``patterns``: the text contains the pattern. Null contains
    nothing and is contained nowhere; the empty pattern is in every text. Names that share a pattern
    are looked for once."""
    out = None
    for block in blocks(patterns.select(F.col(name).alias("name"), F.col(pattern).alias("pattern")).where("pattern IS NOT NULL"), "pattern"):
        part = texts.select(F.col(key).alias("key"), F.col(text).alias("text")).where("text IS NOT NULL").mapInArrow(_scan(block), T.StructType([T.StructField("key", texts.schema[key].dataType), T.StructField("name", patterns.schema[name].dataType)]))
        out = part if out is None else out.unionByName(part)
    return out.toDF(key, name)


def _scan(block: pa.Table):
    coded = block.column("pattern").combine_chunks().dictionary_encode()
    patterns, names = coded.dictionary.to_pylist(), block.column("name").combine_chunks()
    rows: list[list[int]] = [[] for _ in patterns]
    for i, p in enumerate(coded.indices.to_pylist()):
        rows[p].append(i)
    everywhere = [i for p, many in zip(patterns, rows, strict=True) if not p for i in many]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = automaton(patterns)
        for b in batches:
            left, right = [], []
            for i, t in enumerate(b.column("text").to_pylist()):
                hits = everywhere + [r for p in occurring(found, t) for r in rows[p]]
                left += [i] * len(hits)
                right += hits
            yield pa.RecordBatch.from_arrays([b.column("key").take(pa.array(left, pa.int64())), names.take(pa.array(right, pa.int64()))], names=["key", "name"])

    return run


def first_contained(queries: DataFrame, query: str, facts: DataFrame) -> DataFrame:
    """(query, ord, value): of ``facts`` (ord, key, value) the first in order that a query contains or is
    contained in. Work is linear in the queries, once for each bounded block of facts."""
    kinds = T.StructType([T.StructField(query, T.StringType()), *[T.StructField(c, facts.schema[c].dataType) for c in ("ord", "value")]])
    out = None
    for block in blocks(facts.select("ord", "key", "value").where("key IS NOT NULL"), "key"):
        part = queries.select(query).where(F.col(query).isNotNull()).mapInArrow(_first(block.sort_by([("ord", "ascending"), ("value", "ascending")]), query), kinds)
        out = part if out is None else out.unionByName(part)
    return out.groupBy(query).agg(F.min(F.struct("ord", "value")).alias("f")).select(query, "f.ord", "f.value")


def _first(block: pa.Table, query: str):
    keys = block.column("key").to_pylist()
    place = {k: i for i, k in reversed(list(enumerate(keys)))}  # the first of equal keys
    distinct = list(place)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        in_query = automaton(distinct)
        for b in batches:
            asked = b.column(query).to_pylist()
            best = [min((place[distinct[i]] for i in occurring(in_query, q)), default=len(keys)) for q in asked]
            if "" in place:
                best = [min(x, place[""]) for x in best]
            known = list(dict.fromkeys(asked))
            in_key, first = automaton(known), {"": 0} if keys else {}
            for i, k in enumerate(keys):
                for q in occurring(in_key, k):
                    first.setdefault(known[q], i)
            best = [min(x, first.get(q, x)) for x, q in zip(best, asked, strict=True)]
            hit = [i for i, x in enumerate(best) if x < len(keys)]
            rows = block.take(pa.array([best[i] for i in hit], pa.int64())).combine_chunks()
            yield pa.RecordBatch.from_arrays([b.column(query).take(pa.array(hit, pa.int64())), *[pa.concat_arrays(rows.column(c).chunks) if rows.num_rows else pa.array([], rows.schema.field(c).type) for c in ("ord", "value")]], names=[query, "ord", "value"])

    return run


@F.pandas_udf(T.DoubleType())
def similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    """Ratio of matching blocks (Ratcliff and Obershelp), 0 to 1; what is known of ``b`` is kept while it repeats."""
    out, matcher, last = [], SequenceMatcher(None), None
    for x, y in zip(a, b, strict=True):
        if x is None or y is None:
            out.append(None)
            continue
        if y != last:
            matcher.set_seq2(y)
            last = y
        matcher.set_seq1(x)
        out.append(matcher.ratio())
    return pd.Series(out, dtype="float64")


def grams(strings: DataFrame, s: str, width: int) -> DataFrame:
    """(s, gram, k): the ``width``-letter pieces of each distinct string, the k-th occurrence of each apart."""
    n = F.length(s) - (width - 1)
    x = strings.where(n >= 1).select(s, F.explode(F.transform(F.sequence(F.lit(1), n), lambda i: F.substring(F.col(s), i, F.lit(width)))).alias("gram"))
    x = x.groupBy(s, "gram").agg(F.count("*").cast("int").alias("many"))
    return x.select(s, "gram", F.explode(F.sequence(F.lit(1), F.col("many"))).alias("k"))


def like_candidates(queries: DataFrame, facts: DataFrame, cutoff: float) -> DataFrame:
    """(query, key) of all distinct strings whose ratio can reach ``cutoff`` (above 2/3), and few others.

    Of two strings with L letters in all, matching blocks hold M >= cutoff * L / 2 letters of each, and
    there are at most L - 2 M + 1 blocks; so the strings share at least 3 M - L - 1 letter pairs, and the
    rarest pairs of each, all but so many, must meet. Where that bound is below one, strings
    of five letters together at most, single letters must meet. What met is kept if the lengths
    and the letters that both have allow the ratio."""
    if cutoff <= 2 / 3:
        raise ValueError("the index of letter pairs needs a cutoff above 2/3")
    gain = 1.5 * cutoff - 1
    short = math.floor(1 / gain + 1e-9)
    q, f = (written(df.select(c).where(F.col(c).isNotNull()).distinct()) for df, c in ((queries, "query"), (facts, "key")))

    def indexed(strings: DataFrame, s: str, often: DataFrame) -> DataFrame:
        """The rarest pairs of each string, as many as the bound asks for."""
        least = F.ceil(F.length(s) * F.lit(cutoff / (2 - cutoff)) - 1e-9)
        shared = F.greatest(F.ceil(F.lit(gain) * (F.length(s) + least) - 1 - 1e-9), F.lit(1))
        x = grams(strings, s, 2).join(often, ["gram", "k"], "left")
        ranked = F.array_sort(F.collect_list(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "gram", "k")))
        x = x.groupBy(s).agg(ranked.alias("g")).select(s, F.explode(F.slice("g", F.lit(1), F.greatest(F.length(s) - shared.cast("int"), F.lit(1)))).alias("g"))
        return x.where("g.df > 0").select(s, "g.gram", "g.k")

    often = grams(f, "key", 2).groupBy("gram", "k").agg(F.count("*").alias("df"))
    pairs = indexed(q, "query", often).join(indexed(f, "key", often), ["gram", "k"]).select("query", "key")
    small = lambda df, s: df.where(F.length(s) < max(short, 1))
    tiny = grams(small(q, "query"), "query", 1).join(grams(small(f, "key"), "key", 1), ["gram", "k"]).select("query", "key").where(F.length("query") + F.length("key") <= short)
    a, b = F.length("query"), F.length("key")
    met = pairs.unionByName(tiny).where(2 * F.least(a, b) >= (a + b) * F.lit(cutoff - 1e-9)).distinct()
    letters = lambda df, s: grams(df, s, 1).groupBy(s).agg(F.collect_list(F.concat("gram", F.col("k").cast("string"))).alias(f"in_{s}"))
    met = met.join(letters(q, "query"), "query").join(letters(f, "key"), "key")
    return met.where(2 * F.size(F.array_intersect("in_query", "in_key")) >= (a + b) * F.lit(cutoff - 1e-9)).select("query", "key")


def closest(queries: DataFrame, facts: DataFrame, cutoff: float, query: str = "query", key: str = "key") -> DataFrame:
    """(query, key, ratio): for each distinct query the most similar key of at least ``cutoff``, ties by the greater key;
    queries without one are left out. Empty strings are like nothing."""
    pairs = like_candidates(queries.select(F.col(query).alias("query")), facts.select(F.col(key).alias("key")), cutoff)
    x = pairs.withColumn("ratio", similarity("key", "query")).where(F.col("ratio") >= cutoff)
    return x.groupBy("query").agg(F.max(F.struct("ratio", "key")).alias("m")).select(F.col("query").alias(query), F.col("m.key").alias(key), "m.ratio")


def closest_name(df: DataFrame, name: str, known: DataFrame, cutoff: float = 0.82, known_name: str = "name") -> DataFrame:
    """``df`` with ``name`` trimmed and, where it is no known name, replaced by the closest one of at least ``cutoff``, if any."""
    plain = F.trim(F.col(name))
    names = known.select(F.col(known_name).alias("key")).distinct()
    strange = df.select(plain.alias("query")).distinct().join(names, F.col("query") == F.col("key"), "left_anti")
    near = closest(strange, names, cutoff).select(F.col("query").alias("__strange"), F.col("key").alias("__near"))
    return df.withColumn(name, plain).join(near, F.col(name) == F.col("__strange"), "left").withColumn(name, F.coalesce("__near", name)).drop("__strange", "__near")


def contains_any(text: Column, marks: list[str]) -> Column:
    """A few given marks, no table: plain containment."""
    out = F.lit(False)
    for m in marks:
        out = out | F.contains(text, F.lit(m))
    return out
