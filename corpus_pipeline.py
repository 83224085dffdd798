"""A training corpus from ``documents``: identified, free of copies, mixed and encoded.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which is
written as Parquet and read again as the next stage's ``docs``.  All but the
last return the columns they were given, whatever else these are.

Defined results: documents whose text is null or empty aren't identified and go
in the first stage; rows without a ``doc_id`` are never anyone's copy and stay,
repeated rows with an id become one in the second; of equal texts the lowest id
stays, of a group of similar ones as well; a null source is a source of its own;
ties in the mixture are decided by id and text; texts of any length are handled
whole.  An empty table gives an empty result.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from lexmill.llm import byte_bpe, exact_dedup, language_id, mixing, ngram_join
from lexmill.llm._common import remove_at_end, shared_dir, table


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised; the others go."""
    return language_id.keep_identified(docs, language_id.train(docs))


def remove_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each text."""
    return exact_dedup.drop_duplicates(docs)


def remove_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of similar documents."""
    return ngram_join.drop_near_duplicates(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's share of the mixture says."""
    return mixing.mix(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, ids, tokens, restored) of each document of the mixture."""
    return byte_bpe.encode(docs, check=True)


STAGES = [
    ("language ID", identify_language),
    ("exact dedup", remove_copies),
    ("n-gram Jaccard join", remove_near_copies),
    ("mixing", mix_sources),
    ("byte-level BPE", encode),
]

#: SQL can't express language models or BPE; tests compare run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what lies between them is kept in the shared folder."""
    place = f"{shared_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    remove_at_end(spark, place)
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs.write.parquet(f"{place}/{i}")
            docs = spark.read.parquet(f"{place}/{i}")
    return docs
