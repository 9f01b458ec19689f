"""Ranks and numbers over orders that no single task could sort.

Rows are dealt to ranges of the order, ranges are counted, and a range's rows are numbered from where
the ranges before it end. The driver sees a few numbers a range.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lathe.sources.scratch import written


def _ranges(df: DataFrame) -> int:
    return max(2, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def numbered(df: DataFrame, *order: str | Column, name: str = "number") -> DataFrame:
    """``df`` with dense numbers from 0 in ``order``, which should tell all rows apart (rows that tie are
    numbered in any order). No task holds more than a range of the order."""
    spark, taken = df.sparkSession, "__at"
    at = df.repartitionByRange(_ranges(df), *order).sortWithinPartitions(*order).withColumn(taken, F.monotonically_increasing_id())
    at = written(at)  # range and place of each row are drawn once
    part = F.shiftright(taken, 33)
    sizes = {r["p"]: r["n"] for r in at.groupBy(part.alias("p")).agg(F.count("*").alias("n")).collect()}
    before, rows = 0, []
    for p in sorted(sizes):
        rows.append((p, before))
        before += sizes[p]
    starts = spark.createDataFrame(rows, "__p long, __before long")
    x = at.withColumn("__p", part).join(F.broadcast(starts), "__p")  # one row a range
    return x.withColumn(name, F.col("__before") + F.col(taken).bitwiseAND((1 << 33) - 1)).drop(taken, "__p", "__before")


def ranked(df: DataFrame, family: str, score: str, name: str = "rank", descending: bool = False) -> DataFrame:
    """``df`` with RANK() of ``score`` within ``family``: 1 and the number of rows with a better score.

    Scores are counted first, so all that tie are one row and stand in one range; a family that spans
    ranges goes on in the next with what was counted before. Null scores come last, NaN as the
    greatest number; null families are a family."""
    spark = df.sparkSession
    direction = F.desc_nulls_last if descending else F.asc_nulls_last
    counted = df.groupBy(F.col(family).alias("__f"), F.col(score).alias("__s")).agg(F.count("*").alias("__n"))
    order: Sequence[Column] = (F.asc_nulls_first("__f"), direction("__s"))
    x = counted.repartitionByRange(_ranges(df), *order).sortWithinPartitions(*order).withColumn("__p", F.spark_partition_id())
    x = written(x)
    # only the family that a range begins with can go on from ranges before it
    of_family = x.groupBy("__p", "__f").agg(F.sum("__n").alias("n"))
    place = [F.col("__f").isNotNull().alias("known"), F.col("__f").alias("f")]
    ends = of_family.groupBy("__p").agg(F.min(F.struct(*place)).alias("first"), F.max(F.struct(*place, "n")).alias("last"))
    rows, before, total = [], None, 0
    for r in sorted(ends.collect(), key=lambda r: r["__p"]):  # a row a range
        first, last = tuple(r["first"]), tuple(r["last"])
        carry = total if first == before else 0
        rows.append((r["__p"], first[1], carry))
        before, total = last[:2], last[2] + (carry if first == last[:2] else 0)
    carried = spark.createDataFrame(rows, T.StructType([T.StructField("__p", T.IntegerType()), T.StructField("__first", df.schema[family].dataType), T.StructField("__carry", T.LongType())]))
    within = F.sum("__n").over(Window.partitionBy("__p", "__f").orderBy(direction("__s")).rowsBetween(Window.unboundedPreceding, 0)) - F.col("__n")
    x = x.join(F.broadcast(carried), "__p")
    rank = within + F.when(F.col("__f").eqNullSafe(F.col("__first")), F.col("__carry")).otherwise(0) + 1
    ranks = x.select("__f", "__s", rank.alias("__rank"))
    same = F.col(family).eqNullSafe(F.col("__f")) & F.col(score).eqNullSafe(F.col("__s"))
    return df.join(ranks, same).withColumn(name, F.col("__rank")).drop("__f", "__s", "__rank")
