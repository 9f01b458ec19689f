"""Mixing sources to target weights with Pareto order sampling. DataFrame functions only.

1. Targets: each source may give at most ``limit`` times its words; the budget is shared by
   weight and what capped sources cannot take goes to the others (water-filling, in closed
   form over the sources in the order of cap / weight).
2. Expected copies differ between documents: they are in proportion to 2 ** (class * ``lean`` / 2),
   class being the half-octave of a document's size, so longer documents are likelier (with
   ``lean`` 0 all are alike); none expects more than ``limit`` copies. Each source's factor makes
   the expected words its target, again by water-filling, over at most some sixty classes.
3. The whole part of the expected copies is certain; the fraction is the document's inclusion
   probability p. Pareto order sampling ranks the documents of a source, whatever their p, by
   Q = (u / (1 - u)) / (p / (1 - p)), u uniform from a hash of the row, and takes them in this
   order until the words that certain copies leave are used up: a sample of fixed size, in words.
   The order ends before the document that would pass the target, and one more document, the
   best fitting of the rest, closes the gap if that brings the sum nearer.

A plan is two small tables, one row a source and size class and one row a source; they are found
from a narrow table of the rows that is written once. Any scan can decide its rows by them, so
texts are never shuffled. The two are joined without a hint: Spark broadcasts what is small by its
written size. Ranks are cumulated in two levels, over fine buckets of Q and within the one bucket
that holds the cut, so a source with a third of all rows is no single task. Everything depends on row
contents and the seed: reruns agree. Null and blank texts have size 0 and are not taken. A null
source is one source, the last. Rows that are equal in every respect have one Q and are taken one
by one, in the order of their places.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialise, table

BUCKETS = 1024


def n_words(text: Column | str = "text") -> Column:
    """Number of words ``[^\\x20\\x09-\\x0D]+``; null: 0."""
    t = F.col(text) if isinstance(text, str) else text
    return F.coalesce(F.regexp_count(t, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, limit: float = 2.0) -> DataFrame:
    """(source, source_size, target) from (source, source_size): one row a source.

    Sources are ranked by code point, null last, and get the weights in turn. The windows run
    over sources, not documents.
    """
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.pmod(rank, F.lit(len(weights))) + 1).cast("int"))
    x = sizes.withColumn("w", w).withColumn("cap", F.col("source_size") * F.lit(limit))
    order = Window.orderBy((F.col("cap") / F.col("w")).asc(), F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    x = x.withColumn("budget", F.sum("source_size").over(everything) * F.lit(share)).withColumn("all_w", F.sum("w").over(everything))
    x = x.withColumn("left", F.col("budget") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))).withColumn("w_left", F.col("all_w") - F.coalesce(F.sum("w").over(before), F.lit(0.0)))
    # A source is capped if its fair part of what the smaller caps leave reaches its cap; the first one that is not sets the level.
    x = x.withColumn("fair", F.col("left") / F.col("w_left"))
    x = x.withColumn("level", F.min(F.when(F.col("fair") * F.col("w") < F.col("cap"), F.struct(F.col("cap") / F.col("w"), F.col("fair")))).over(everything))
    level = F.col("level")["fair"]
    return x.select("source", "source_size", F.coalesce(F.least(F.col("cap"), level * F.col("w")), F.col("cap")).cast("double").alias("target"))


def drawn(docs: DataFrame, size: Column, place: Column, seed: int) -> list[Column]:
    """What the plan needs of a row: source, size, size class, uniform draw, and ties' order."""
    h = F.xxhash64(F.lit(seed), docs["doc_id"], docs["text"])
    klass = F.when(size > 0, F.floor(2 * F.log2(size.cast("double")))).cast("int")
    return [docs["source"].alias("source"), size.alias("size"), klass.alias("class"), ((F.shiftrightunsigned(h, 11) + F.lit(0.5)) * F.lit(2.0**-53)).alias("u"), F.struct(h.alias("h"), place.alias("place")).alias("tie")]


def expected_copies(classes: DataFrame, lean: float, limit: float) -> DataFrame:
    """(source, class, words, ..., copies, p) from (source, class, words, target): whole copies
    and inclusion probability of each size class. The windows run over a source's classes."""
    order = Window.partitionBy("source").orderBy(F.desc("class"))
    x = classes.withColumn("w", F.pow(F.lit(2.0), F.col("class") * F.lit(lean / 2)))
    x = x.withColumn("over", F.coalesce(F.sum("words").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    x = x.withColumn("rest_w", F.sum(F.col("w") * F.col("words")).over(order.rowsBetween(0, Window.unboundedFollowing)))
    # From the largest class on, a class is capped if the factor that leaves it uncapped would give it ``limit`` copies or more.
    x = x.withColumn("factor", (F.col("target") - F.col("over") * F.lit(limit)) / F.col("rest_w"))
    x = x.withColumn("level", F.max(F.when(F.col("factor") * F.col("w") < limit, F.struct("class", "factor"))).over(Window.partitionBy("source")))
    copies = F.greatest(F.coalesce(F.least(F.lit(limit), F.col("level")["factor"] * F.col("w")), F.lit(limit)), F.lit(0.0))
    x = x.withColumn("copies", F.floor(copies).cast("long")).withColumn("p", copies - F.floor(copies))
    return x.drop("w", "over", "rest_w", "factor", "level")


@dataclass
class Plan:
    """(source, class, copies, p, ...) and (source, source_size, target, cut, fit), written tables."""

    classes: DataFrame
    cuts: DataFrame

    def ranked(self, rows: DataFrame) -> DataFrame:
        """``rows`` (see ``drawn``) with copies, p, rest and the rank's bucket and key; rows
        without words keep nulls."""
        c = self.classes.select(F.col("source").alias("c_source"), F.col("class").alias("c_class"), "copies", "p", "mean_odds")
        x = rows.join(c, rows["source"].eqNullSafe(F.col("c_source")) & (rows["class"] == F.col("c_class")), "left").drop("c_source", "c_class")
        p = F.greatest(F.least("p", F.lit(1 - 1e-12)), F.lit(1e-12))
        q = F.col("u") / (1 - F.col("u")) * (1 - p) / p
        # near evenly spread over (0, 1), in Q's order within a source
        z = q * F.col("mean_odds") / (1 + q * F.col("mean_odds"))
        return x.withColumn("bucket", F.least(F.floor(z * BUCKETS), F.lit(BUCKETS - 1)).cast("int")).withColumn("key", F.struct(q.alias("q"), "tie"))

    def decided(self, rows: DataFrame) -> DataFrame:
        """``rows`` with source_size, target and times: how often the mix takes each."""
        x = self.ranked(rows)
        c = self.cuts.withColumnRenamed("source", "c_source")
        x = x.join(c, x["source"].eqNullSafe(c["c_source"]), "left")
        extra = F.when(F.col("p") > 0, F.coalesce(F.col("key") < F.col("cut"), F.lit(True))).otherwise(F.lit(False))
        closes = F.coalesce(F.col("key") == F.col("fit"), F.lit(False))
        return x.withColumn("times", F.coalesce(F.when(F.col("size") > 0, F.col("copies") + (extra | closes).cast("long")), F.lit(0)).cast("long")).drop("c_source")


def plan(rows: DataFrame, weights: tuple[int, ...], share: float, limit: float, lean: float) -> Plan:
    """The plan of ``rows`` (see ``drawn``; read several times, so a written table is best)."""
    sizes = materialise(rows.groupBy("source", "class").agg(F.sum("size").alias("words")))
    t = targets(sizes.groupBy("source").agg(F.sum("words").alias("source_size")), weights, share, limit)
    t = materialise(t.withColumnRenamed("source", "t_source"))
    own = sizes.where("class IS NOT NULL").join(t, F.col("source").eqNullSafe(F.col("t_source"))).drop("t_source")
    x = expected_copies(own, lean, limit)
    per = Window.partitionBy("source")
    x = x.withColumn("rest", F.col("target") - F.sum(F.col("copies") * F.col("words")).over(per))
    mean = F.greatest(F.least(F.try_divide("rest", F.sum(F.when(F.col("p") > 0, F.col("words"))).over(per)), F.lit(1 - 1e-9)), F.lit(1e-9))
    classes = materialise(x.withColumn("mean_odds", F.coalesce(mean / (1 - mean), F.lit(1.0))).select("source", "class", "copies", "p", "rest", "mean_odds"))
    found = Plan(classes, t)
    ranked = found.ranked(rows).where("p > 0")
    rest = classes.groupBy(F.col("source").alias("r_source")).agg(F.first("rest").alias("rest"))
    fine = ranked.groupBy("source", "bucket").agg(F.sum("size").alias("in_bucket"))
    fine = fine.join(rest, F.col("source").eqNullSafe(F.col("r_source"))).drop("r_source")
    to = F.sum("in_bucket").over(Window.partitionBy("source").orderBy("bucket"))
    fine = materialise(fine.withColumn("before", to - F.col("in_bucket")))
    at = fine.where("before + in_bucket > rest").groupBy("source").agg(F.min(F.struct("bucket", "before", "rest")).alias("at"))
    at = at.select(F.col("source").alias("a_source"), F.col("at.bucket").alias("a_bucket"), "at.before", "at.rest")
    edge = ranked.join(at, F.col("source").eqNullSafe(F.col("a_source")) & (F.col("bucket") == F.col("a_bucket")))
    upto = F.col("before") + F.sum("size").over(Window.partitionBy("source").orderBy("key").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    edge = edge.withColumn("to", upto).where("to > rest").groupBy("source").agg(F.min(F.struct("key", (F.col("rest") - F.col("to") + F.col("size")).alias("gap"))).alias("e"))
    edge = edge.select(F.col("source").alias("e_source"), F.col("e.key").alias("cut"), F.col("e.gap").alias("gap"))
    cuts = materialise(t.join(edge, F.col("t_source").eqNullSafe(F.col("e_source")), "left").drop("e_source"))
    # One more document closes the gap: of those that leave less than is open now the one that leaves the least, then the first in order.
    open_ = ranked.join(cuts.where("gap > 0").select("t_source", "cut", "gap"), F.col("source").eqNullSafe(F.col("t_source")))
    off = F.abs(F.col("gap") - F.col("size"))
    fit = open_.where(F.col("key") >= F.col("cut")).where(off < F.col("gap")).groupBy("source").agg(F.min(F.struct(off.alias("off"), "key")).alias("fit"))
    fit = fit.select(F.col("source").alias("f_source"), F.col("fit.key").alias("fit"))
    cuts = cuts.join(fit, F.col("t_source").eqNullSafe(F.col("f_source")), "left").drop("f_source", "gap").withColumnRenamed("t_source", "source")
    return Plan(classes, materialise(cuts))


PARAMETERS = {"seed": 5, "weights": (5, 2, 1), "share": 1.5, "limit": 2.0, "lean": 0.5}


def pareto_mix(docs: DataFrame, size: Column, seed: int = 5, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, limit: float = 2.0, lean: float = 0.5, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns of ``docs`` (doc_id, text, source) with size, source_size, target and taken (copies x size)."""
    own = F.struct(*[docs[c] for c in keep]).alias("own")
    rows = materialise(docs.select(own, *drawn(docs, size, F.monotonically_increasing_id(), seed)))  # numbers are drawn once, while the table is written
    x = plan(rows, weights, share, limit, lean).decided(rows)
    return x.select("own.*", "size", "source_size", "target", (F.col("times") * F.col("size")).alias("taken"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pareto_mix(table(spark, sf_dir, "documents"), n_words(), **PARAMETERS)
