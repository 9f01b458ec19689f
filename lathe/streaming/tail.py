"""The last lines of logs that grow by files, as a stream with state.

A log is a name with numbered parts (``train.log``, ``train.log.0001``, ...), each written once. The stream reads new
parts, keeps the last n lines of each log in state, and writes the logs that changed to a table by log. Which
files were read stands in the checkpoint, so a run takes only what has come since the last, and any number
of runs leave what one run over all files leaves.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

LINES = "log string, file string, line_no long, line string"


def lines_of(files: DataFrame, last: int | None = None) -> DataFrame:
    """(log, file, line_no, line) of whole files (value, with Spark's file metadata): lines from 1, the line end
    of the last one adds none; of each file only the ``last`` lines, if given. The log is the file's name up
    to a number at its end."""
    name = F.col("_metadata.file_name")
    x = files.select(F.regexp_replace(name, r"\.\d+$", "").alias("log"), name.alias("file"), F.split(F.regexp_replace("value", r"\r?\n\z", ""), r"\r?\n").alias("all"))
    skip = F.lit(0) if last is None else F.greatest(F.size("all") - last, F.lit(0))
    x = x.select("log", "file", skip.alias("skip"), F.posexplode(F.slice("all", skip + 1, F.greatest(F.size("all") - skip, F.lit(0)))).alias("at", "line"))
    return x.select("log", "file", (F.col("skip") + F.col("at") + 1).cast("long").alias("line_no"), "line")


def last_lines(lines: DataFrame, n: int) -> DataFrame:
    """(log, place, line) in one batch: the last ``n`` lines of each log, in order from 1."""
    back = F.row_number().over(Window.partitionBy("log").orderBy(F.desc("file"), F.desc("line_no")))
    x = lines.withColumn("back", back).where(F.col("back") <= n)
    return x.withColumn("place", F.row_number().over(Window.partitionBy("log").orderBy(F.desc("back")))).select("log", "place", "line")


def follow(spark: SparkSession, folder: str, checkpoint: str, table: str, n: int = 10) -> None:
    """Take in all files that have come to ``folder`` since the last run with this ``checkpoint``, and bring the
    Parquet table at ``table`` up to date: (log, version, place, line), a version a micro-batch that changed the log."""

    def keep(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = [tuple(x) for x in json.loads(state.get[0])] if state.exists else []
        for b in batches:
            held = sorted({*held, *zip(b.file, b.line_no.astype(int), b.line, strict=True)})[-n:]
        state.update((json.dumps(held),))
        yield pd.DataFrame({"log": [key[0]] * len(held), "place": range(1, len(held) + 1), "line": [x[2] for x in held]})

    files = spark.readStream.format("text").option("wholetext", True).load(folder)
    kept = lines_of(files, n).groupBy("log").applyInPandasWithState(keep, "log string, place int, line string", "held string", "update", GroupStateTimeout.NoTimeout)

    def put(changed: DataFrame, version: int) -> None:
        changed.select("log", F.lit(version).cast("long").alias("version"), "place", "line").write.mode("overwrite").parquet(f"{table}/batch={version}")

    kept.writeStream.foreachBatch(put).outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def current(spark: SparkSession, table: str) -> DataFrame:
    """(log, place, line): of each log what its last version says."""
    x = spark.read.parquet(table)
    last = x.groupBy("log").agg(F.max("version").alias("version"))
    return x.join(last, ["log", "version"]).select("log", "place", "line")
