"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@cache
def _of_this_process() -> str:
    folder = tempfile.mkdtemp(prefix="lathe-")
    atexit.register(shutil.rmtree, folder, True)
    return f"file://{folder}"


def folder(spark: SparkSession) -> str:
    """Where this application's tables go: below ``spark.checkpoint.dir``; where that is unset, a folder of
    this process if it is driver and executor in one, and the warehouse if not."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        master = spark.conf.get("spark.master", "")
        alone = master == "local" or master.startswith("local[")
        root = _of_this_process() if alone else spark.conf.get("spark.sql.warehouse.dir")
    return f"{root.rstrip('/')}/lathe-{spark.sparkContext.applicationId}"


def written(df: DataFrame) -> DataFrame:
    """``df`` written once and read back: lineage ends here, and what was drawn while writing stays drawn."""
    path = f"{folder(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def clear(spark: SparkSession) -> None:
    """Delete all tables of this application, once no result that reads them is wanted any more."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def blocks(df: DataFrame, text: str, rows: int = 200_000, size: int = 16 << 20) -> Iterator[pa.Table]:
    """``df`` in blocks of about ``rows`` rows and ``size`` bytes of ``text`` at most, one at a time on the
    driver: what is sent to all executors is bounded whatever the table's size."""
    n, total = df.agg(F.count("*"), F.sum(F.octet_length(F.col(text)))).first()
    parts = max(1, -(-n // rows), -(-(total or 0) // size))
    if parts == 1:
        yield df.toArrow()
        return
    cut = written(df.repartition(parts).withColumn("__block", F.spark_partition_id()))
    for i in range(parts):
        yield cut.where(F.col("__block") == i).drop("__block").toArrow()
