"""Gates, competitions and comparisons over evaluation results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def gate(results: DataFrame, overall: float = 0.75, numeric: float = 0.60, exact: float = 0.80, cases: DataFrame | None = None) -> DataFrame:
    """(overall, numeric, exact, reasons, passed): accuracy thresholds, and required questions
    (``cases``: question) that must be there and right. A missing numeric part counts 0, a missing
    exact part 1. Reasons come in that order, failed cases by question."""
    ok = F.col("ok").cast("double")
    part = lambda kind, empty: F.coalesce(F.avg(F.when(F.col("kind") == kind, ok)), F.lit(empty))
    a = results.agg(F.coalesce(F.avg(ok), F.lit(0.0)).alias("overall"), part("numeric", 0.0).alias("numeric"), part("exact", 1.0).alias("exact"))
    says = lambda c, limit: F.format_string(f"{c} accuracy %.2f%% < {limit * 100:.0f}%%", F.col(c) * 100)
    why = F.array_compact(F.array(*[F.when(F.col(c) < limit, says(c, limit)) for c, limit in (("overall", overall), ("numeric", numeric), ("exact", exact))]))
    if cases is None:
        a = a.withColumn("reasons", why)
    else:
        failed = required(cases, results).where("NOT ok").agg(F.array_sort(F.collect_set(F.concat(F.lit("required case failed: "), "question"))).alias("__f"))
        a = a.join(failed, F.lit(True)).withColumn("reasons", F.concat(why, "__f")).drop("__f")
    return a.withColumn("passed", F.size("reasons") == 0)


def required(cases: DataFrame, results: DataFrame) -> DataFrame:
    """Every required question with whether it is there and right."""
    return cases.join(results.select("question", "ok"), "question", "left").withColumn("ok", F.coalesce("ok", F.lit(False)))


def competition(champion: DataFrame, candidate: DataFrame, checks: list[str], needed: int = 3) -> DataFrame:
    """One row each: the candidate wins a check by strictly more, and is promoted by ``needed`` wins."""
    x = champion.select(*[F.col(c).alias(f"old_{c}") for c in checks]).join(candidate.select(*[F.col(c).alias(f"new_{c}") for c in checks]), F.lit(True))
    wins = sum((F.col(f"new_{c}") > F.col(f"old_{c}")).cast("int") for c in checks)
    return x.select(wins.alias("wins"), (wins >= needed).alias("promote"))


def against_baseline(variants: DataFrame, name: str, baseline: str, loss: str, speed: str) -> DataFrame:
    base = variants.where(F.col(name) == baseline).select(F.col(loss).alias("__l"), F.col(speed).alias("__s"))
    return variants.join(base, F.lit(True)).select(name, (F.try_divide(F.col(loss) - F.col("__l"), "__l") * 100).alias("loss_pct"), F.try_divide(speed, "__s").alias("speed_ratio"))


def drop_under_rename(base: DataFrame, renamed: DataFrame, by: str) -> DataFrame:
    acc = lambda df, n: df.groupBy(by).agg(F.avg(F.col("ok").cast("double")).alias(n))
    x = acc(base, "base").join(acc(renamed, "renamed"), by, "full_outer")
    return x.withColumn("points", (F.col("base") - F.col("renamed")) * 100).withColumn("halved", F.col("renamed") < 0.5 * F.col("base"))


def top_folder_report(files: DataFrame, path: str = "path", text: str = "text") -> DataFrame:
    lines = F.size(F.split(text, "\n"))
    return files.groupBy(F.substring_index(path, "/", 1).alias("folder")).agg(F.count("*").alias("files"), F.sum(lines).alias("lines")).orderBy("folder")


def masked_loss(df: DataFrame, *by: str) -> DataFrame:
    return df.groupBy(*by).agg((F.sum(F.col("loss") * F.col("mask")) / F.greatest(F.sum("mask"), F.lit(1.0))).alias("loss"))


def total_loss(df: DataFrame, logits: str, coefficient: float) -> DataFrame:
    """(loss, z_loss, total): the mean loss over positions that the mask keeps, with the penalty on large logits added."""
    from lathe.operators.kernels import z_loss

    x = masked_loss(df).join(z_loss(df, logits, "mask", coefficient), F.lit(True))  # one row each
    return x.withColumn("total", F.col("loss") + F.col("z_loss"))


def batch_weighted_loss(df: DataFrame, batches: int) -> DataFrame:
    """Batch means weighted by their rows, over the first ``batches``."""
    b = masked_loss(df.where(F.col("batch_id") < batches), "batch_id").join(df.groupBy("batch_id").agg(F.countDistinct("row").alias("rows")), "batch_id")
    return b.agg((F.sum(F.col("loss") * F.col("rows")) / F.sum("rows")).alias("loss"))


def reconcile(old: DataFrame, new: DataFrame) -> DataFrame:
    """What a checkpoint loader does with each tensor (name, rows, cols): copy, grow or skip."""
    x = old.select("name", F.struct("rows", "cols").alias("o")).join(new.select("name", F.struct("rows", "cols").alias("n")), "name", "full_outer")
    kind: Column = F.when(F.col("o").isNull() | F.col("n").isNull(), "skip").when(F.col("o") == F.col("n"), "copy").when((F.col("o.cols") == F.col("n.cols")) & (F.col("o.rows") < F.col("n.rows")), "grow").otherwise("skip")
    return x.select("name", kind.alias("kind"))


def reconciled(old: DataFrame, new: DataFrame) -> DataFrame:
    """How many tensors are copied, grown and skipped."""
    return reconcile(old, new).groupBy("kind").agg(F.count("*").alias("n"))
