"""Sources and sinks: result logs, pools, source trees, dataset folders."""

from __future__ import annotations

import re

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lathe.operators.relational import ranked_results
from lathe.operators.reports import HEADING, NO_ROWS, leaderboard_lines
from lathe.sources.publish import Build, built, cache_key, sorted_json  # noqa: F401  the key's rule belongs to the cache

RESULT = "experiment string, timestamp string, data struct<accuracy:double,best_val_loss:double,best_loss:double,final_loss:double,elapsed_seconds:double,model_parameters:bigint,num_samples:bigint,iters:bigint,learning_rate:double>"


def result_log(spark: SparkSession, folder: str, prefix: str | None = None) -> DataFrame:
    """One row a result file, with its name; a prefix prunes files before they are read."""
    reader = spark.read.schema(RESULT).option("multiLine", True)
    if prefix:
        reader = reader.option("pathGlobFilter", f"{prefix}*.json")
    return reader.json(folder).select("experiment", "timestamp", "data.*", F.col("_metadata.file_name").alias("file_name"))


def append_result(row: DataFrame, folder: str, board: str | None = None) -> None:
    """Append result rows; with ``board`` the leaderboard there is written anew from all of them."""
    row.coalesce(1).write.mode("append").json(folder)
    if board:
        leaderboard(ranked_results(result_log(row.sparkSession, folder)), board)


def leaderboard(ranked: DataFrame, path: str) -> None:
    """The ranked results as one Markdown table, newest first; a row that says so if there are none."""
    spark = ranked.sparkSession
    rows = leaderboard_lines(ranked).select(F.lit(1).alias("part"), "timestamp", "file_name", "line")
    fixed = [(0, None, f"{i:04d}", line) for i, line in enumerate(HEADING)] + ([(1, None, "", NO_ROWS)] if ranked.isEmpty() else [])
    lines = rows.unionByName(spark.createDataFrame(fixed, rows.schema))
    lines.orderBy("part", F.desc("timestamp"), "file_name").select(F.col("line").alias("value")).coalesce(1).write.mode("overwrite").text(path)


POOL = "thoughts map<string,array<string>>, paraphrases map<string,array<string>>, facts map<string,string>, sandbox array<struct<task:string,code:string,output:string>>"


def _pool_file(spark: SparkSession, path: str) -> DataFrame:
    """One row; a missing or malformed file has null sections."""
    empty = spark.createDataFrame([(None,) * 4], POOL)
    try:
        x = spark.read.schema(POOL).option("multiLine", True).option("mode", "PERMISSIVE").json(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return empty
    return x.unionByName(empty).limit(1)


def pool(spark: SparkSession, path: str, sandbox_path: str | None = None) -> DataFrame:
    """A phrase and fact pool; absent sections are empty. If its sandbox section is empty it is
    taken from a second file."""
    x = _pool_file(spark, path)
    if sandbox_path:
        other = _pool_file(spark, sandbox_path).select(F.col("sandbox").alias("__s"))
        x = x.join(other, F.lit(True)).withColumn("sandbox", F.when(F.coalesce(F.size("sandbox"), F.lit(0)) > 0, F.col("sandbox")).otherwise(F.col("__s"))).drop("__s")
    none = lambda c: F.array().cast(x.schema[c].dataType) if c == "sandbox" else F.create_map().cast(x.schema[c].dataType)
    return x.select(*[F.coalesce(c, none(c)).alias(c) for c in x.columns])


def write_pool(merged: DataFrame, path: str) -> None:
    """A merged pool as one JSON object."""
    merged.select(F.to_json(F.struct(*merged.columns)).alias("value")).coalesce(1).write.mode("overwrite").text(path)


PLAN = "turns array<struct<user:string,steps:array<struct<kind:string,argument:string>>>>"


def scenarios(spark: SparkSession, path: str) -> DataFrame:
    """Plans of a JSON array, numbered in order."""
    x = spark.read.text(path, wholetext=True).select(F.posexplode(F.from_json("value", f"array<struct<{PLAN.replace(' ', ':', 1)}>>")).alias("plan_id", "p"))
    return x.select("plan_id", "p.turns")


def literal(spark: SparkSession, rows: dict[str, str]) -> DataFrame:
    """A literal table (key, value), such as the toolbox's memory or its knowledge base."""
    return spark.createDataFrame(list(rows.items()), "key string, value string")


def first_files(files: DataFrame, path: str = "path", limit: int = 120) -> DataFrame:
    """The first paths in order; a top-n, no sort of the whole."""
    return files.orderBy(path).limit(limit)


SKIP_DIRS = (".git", ".venv", "__pycache__", "node_modules", "results", "data", "checkpoints")


def source_files(spark: SparkSession, root: str, pattern: str = "*.py") -> DataFrame:
    """(path, text) of a tree's files; below ``root``, hidden folders and ``SKIP_DIRS`` are skipped. The rule is a
    filter on the files' paths alone, so Spark leaves files out of the scan and does not read them."""
    from urllib.parse import quote, urlsplit

    top = quote(urlsplit(root).path if "://" in root else root).rstrip("/") + "/"
    path = F.col("_metadata.file_path")
    below = F.substring(path, F.locate(top, path) + len(top), F.length(path))
    names = "|".join(re.escape(d) for d in SKIP_DIRS)
    x = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", pattern).text(root, wholetext=True)
    return x.where(~below.rlike(rf"(^|/)(\.[^/]*|{names})/")).select(path.alias("path"), F.col("value").alias("text"))


def cached(df: DataFrame, folder: str, key: str, parameters: dict | None = None) -> DataFrame:
    """Read the dataset named by ``key`` (a hash of what it depends on), or build and publish it first, with
    the parameters beside it; of two builders one publishes and both read the same."""
    spark = df.sparkSession
    if Build(spark, folder, parameters, 1, key=key).published() is None and parameters is not None:
        spark.createDataFrame([(sorted_json(parameters),)], "value string").coalesce(1).write.mode("overwrite").text(f"{folder}/{key}.params")
    return built(spark, folder, None, 1, lambda _: df, key=key)
