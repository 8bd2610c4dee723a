"""The queries of this subpackage and their SQL oracles, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import (
    decontamination,
    exact_dedup,
    katz,
    langid,
    quality,
    sentencepiece_codec,
    simhash,
    toxicity,
    url_filter,
    warc,
)
from .common import read_table


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.language_predictions(read_table(spark, sf_dir, "documents"))


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_codec.encoding_digests(read_table(spark, sf_dir, "documents"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_scores(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op4_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(read_table(spark, sf_dir, "documents"))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.leaks(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity_scores(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op7_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.derivative_digests(read_table(spark, sf_dir, "pages"))


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.url_verdicts(read_table(spark, sf_dir, "pages"))


def op9_katz_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return katz.katz_scores(read_table(spark, sf_dir, "documents"))


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(read_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_language_id,
        op2_sentencepiece,
        op3_quality,
        op4_simhash_near_dedup,
        op5_decontamination,
        op6_toxicity,
        op7_warc_derivatives,
        op8_url_filter,
        op9_katz_scoring,
        op10_exact_dedup,
    )
}
ORACLES: dict[str, str] = {"op10_exact_dedup": exact_dedup.ORACLE}
