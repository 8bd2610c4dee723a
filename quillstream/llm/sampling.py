"""Bounded, deterministic samples of labelled rows for the classifiers to fit on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Seed of the hash that orders rows for sampling.
ORDER_SEED = 17


def _order() -> list[Column]:
    return [F.xxhash64(F.lit(ORDER_SEED), F.col("doc_id")), F.col("doc_id")]


def labelled_sample(labels: DataFrame, label: str, learn: Column, bound: int) -> tuple[DataFrame, dict[int, int]]:
    """(doc_id, y) of at most ``bound`` // 2 rows of each class, and the class sizes.

    Rows count that ``learn`` admits and whose label is 0 or 1; several labels of one
    document count once, as 1 if any is 1. Which rows are taken depends on a hash of the id.
    """
    clean = (
        labels.filter(learn & F.col(label).isin(0, 1) & F.col("doc_id").isNotNull())
        .groupBy("doc_id")
        .agg(F.max(label).cast("int").alias("y"))
    )
    sizes = {r["y"]: r["n"] for r in clean.groupBy("y").agg(F.count("*").alias("n")).collect()}
    parts = [clean.filter(F.col("y") == y).orderBy(*_order()).limit(bound // 2) for y in (0, 1)]
    return parts[0].unionAll(parts[1]), sizes


def sampled_texts(docs: DataFrame, sample: DataFrame) -> DataFrame:
    """doc_id, text, y of the sampled documents, equal texts of a class once.

    The sample is bounded, so it is broadcast, and so are the texts that move.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = rows.join(F.broadcast(sample), "doc_id")
    return found.groupBy(F.sha2(F.col("text"), 256).alias("h"), "y").agg(F.min(F.struct("doc_id", "text")).alias("d")).select("d.*", "y")
