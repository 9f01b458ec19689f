"""Corpus preparation in five stages, each applying one operator to what the last one kept.

Every stage takes (spark, docs, sf_dir); its result is written as Parquet and reread as the
next stage's documents. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lathe.llm import jaccard, mixing, packing, pii, toxicity
from lathe.llm.common import materialise, settle, small_batches


def placed(docs: DataFrame) -> DataFrame:
    """``row`` (a struct of all columns of ``docs``, whatever their names) and ``place``, a long that
    tells rows apart, equal ones too: the file's rank and the row's index there. The same in
    every scan of the same files; what has no files is written first."""
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    where = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("index")]
    try:
        x = docs.select(whole, *where)
    except AnalysisException:
        x = materialise(docs).select(whole, *where)
    files = x.select("file").distinct().select(F.col("file").alias("name"), (F.row_number().over(Window.orderBy("file")) - 1).cast("long").alias("rank"))  # one row a file
    return x.join(materialise(files), F.col("file") == F.col("name")).select("row", (F.shiftleft("rank", 40) + F.col("index")).alias("place"))


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored 0.5 or more go; all others stay, texts that are null or empty too. Each
    row is judged by its own text: repeated rows, ties and rows of one or no doc_id alike. Extra
    columns stay, whatever their names. An empty table gives an empty one."""
    settle(spark)
    small_batches(spark)
    index = toxicity.fit(docs, toxicity.training_labels(spark, sf_dir))
    name = f"score-{uuid.uuid4().hex}"
    return toxicity.scored(docs, index, tuple(docs.columns), name, None).where(F.col(f"`{name}`") < 0.5).select(*docs.columns)


def near_duplicates_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents linked by five-word shingles with a Jaccard similarity of 0.8
    or more one row stays: that of the smallest doc_id (null last), then by a hash of the text, then
    by its place. So of repeated rows one stays, and unlike texts under one doc_id all do. Null,
    empty and blank texts link with nothing and stay. Extra columns stay, whatever their names.
    An empty table gives an empty one."""
    settle(spark)
    small_batches(spark)
    rows = placed(docs)
    groups = materialise(jaccard.jaccard_components(rows.select(F.col("place").alias("doc_id"), F.col("row.text").alias("text")), width=5, num=8, den=10).where("n_shingles > 0").select(F.col("doc_id").alias("place"), "component_id"))
    several = materialise(groups.where("place <> component_id").select("component_id").distinct())
    linked = groups.join(several, "component_id")
    order = F.struct(F.col("row.doc_id").isNull().alias("no_id"), F.col("row.doc_id").alias("id"), F.xxhash64("row.text").alias("text"), F.col("place").alias("at"))
    named = materialise(linked.join(rows.select("place", order.alias("order")), "place"))
    first = materialise(named.groupBy("component_id").agg(F.min("order").alias("first")))  # written, so that Spark can split a hot group of the join
    later = named.join(first, "component_id").where("order <> first").select("place")
    return rows.join(materialise(later), "place", "left_anti").select("row.*")


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows stay; personal data and disclosing terms in their texts are replaced, and n_chars
    follows. Null and empty texts stay as they are. Equal rows are replaced alike; rows of one
    doc_id by their own texts. Extra columns stay, whatever their names."""
    settle(spark)
    small_batches(spark)
    return pii.sanitise(docs, **pii.PARAMETERS)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as often as the mix takes it: not at all, once or twice. Repeated rows are taken
    one by one, each by its place. Null, empty and blank texts have no words and are not taken;
    a null source is a source. Extra columns stay, whatever their names. The plan is found from
    a narrow table; texts are read once more and decided in the scan."""
    settle(spark)
    small_batches(spark)
    rows = placed(docs)
    fields = rows.select("row.doc_id", "row.text", "row.source", "place", "row")
    drawn = mixing.drawn(fields, mixing.n_words(), F.col("place"), mixing.PARAMETERS["seed"])
    plan = mixing.plan(materialise(fields.select(*drawn)), **{k: v for k, v in mixing.PARAMETERS.items() if k != "seed"})
    x = plan.decided(fields.select("row", *drawn)).where("times > 0")
    return x.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("times")))).select("row.*")


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places of all pieces of all rows in sequences of 4096 tokens. Null and empty texts are the
    end mark alone; repeated rows are packed one by one; an empty table gives none."""
    settle(spark)
    small_batches(spark)
    return packing.pack(docs)


STAGES = [
    ("toxicity", toxicity_stage),
    ("near_duplicates", near_duplicates_stage),
    ("pii", pii_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]

#: Tokenising, nearest neighbours and packing have no SQL; the stages' tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
