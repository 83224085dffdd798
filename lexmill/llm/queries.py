"""The queries of this subpackage, with production parameters, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, byte_bpe, exact_dedup, language_id, license_scan, mixing, ngram_join, quality, url_filter, warc
from ._common import table


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(table(spark, sf_dir, "documents"))


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.encode(table(spark, sf_dir, "documents"), check=True)


def op3_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"))


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.score_urls(table(spark, sf_dir, "pages"), url_filter.train())


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    return mixing.mix_copies(docs).select("doc_id", "source", F.col("_copies").alias("copies"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents' source is their host, their language the path on it."""
    return quality.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), F.col("source"), F.col("lang"))


def op7_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.similar(table(spark, sf_dir, "documents"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return language_id.identify(docs, language_id.train(docs))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.derive(warc.responses_of_pages(table(spark, sf_dir, "pages")))


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.duplicates(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_license_scan, op2_byte_bpe, op3_nearest_neighbours, op4_url_filter, op5_mixing, op6_quality, op7_ngram_jaccard, op8_language_id, op9_warc, op10_exact_dedup)}


def oracle_sql() -> dict[str, str]:
    return {"op5_mixing": mixing.SQL, "op7_ngram_jaccard": ngram_join.SQL, "op9_warc": warc.SQL, "op10_exact_dedup": exact_dedup.SQL}
