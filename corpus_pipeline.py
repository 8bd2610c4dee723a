"""A training corpus from ``documents``: five stages, each on what the one before it kept.

Toxic documents go, then all but one of equal texts, all but one of each group of
near-duplicates, and documents that leak benchmark items; the rest is encoded. Every stage
but the last returns the columns of ``documents``. ``run`` writes each stage as Parquet in the
shared folder and reads it again for the next one.

Edge cases: null and empty texts are no toxic documents, equal each other, hold no leak and have no
tokens, so one of them goes through. Of rows that repeat id and text one stays; of rows without an id, one
of each text, and it is never a near copy or a leak of another. Ids that repeat with different texts count as
one document from the near-duplicate stage on. An empty table stays empty, and further columns pass through
all stages but the last.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstream.llm import decontamination, exact_dedup, sentencepiece_codec, similar, toxicity
from quillstream.llm.common import read_table, written


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.without_toxic(docs, read_table(spark, sf_dir, "labels"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.deduplicated(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return similar.similar_deduplicated(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontamination.decontaminated(docs, read_table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids, decoded_equal, parity."""
    # Workers of the stages before still hold memory, so few words are remembered here.
    rows = sentencepiece_codec.encode(docs, verify=True, remember=1 << 16)
    return rows.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", "decoded_equal", "parity")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_copies),
    ("simhash_near_dedup", drop_near_copies),
    ("decontamination", drop_leaks),
    ("sentencepiece", encode),
]

#: Stages 1, 3, 4 and 5 can't be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline_{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
