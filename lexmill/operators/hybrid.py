"""Rank fusion, reranking and the projections around them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import cut, tokens

VECTOR_WEIGHT, WORD_WEIGHT, RRF_K, KEY_LENGTH = 0.7, 0.3, 60, 100


def fuse(vector_hits: DataFrame, word_hits: DataFrame, k: int = 10, query_key: str = "query_id", key: str = "doc_id", text: str = "text") -> DataFrame:
    """Weighted reciprocal-rank fusion of two ranked lists (query_key, key, text, place).

    Hits whose texts begin with the same ``KEY_LENGTH`` characters are one hit
    and add up; its row is the vector list's, else the first.  Ties keep the
    vector list's order, then the other's.
    """
    rows = [h.select(query_key, key, text, "place", F.lit(near).alias("near")) for h, near in ((vector_hits, True), (word_hits, False))]
    return fuse_lists(rows[0].unionByName(rows[1]), k, query_key, key, text)


def fuse_lists(hits: DataFrame, k: int = 10, query_key: str = "query_id", key: str = "doc_id", text: str = "text") -> DataFrame:
    """As :func:`fuse`, of both lists in one table (query_key, key, text, place, near), ``near`` where a hit is of the vector list."""
    weight = F.when(F.col("near"), VECTOR_WEIGHT).otherwise(WORD_WEIGHT)
    both = hits.select(
        query_key, key, text, "place", F.when(F.col("near"), "vector").otherwise("bm25").alias("kind"), F.when(F.col("near"), 0).otherwise(1).alias("list"), (weight / (RRF_K + F.col("place"))).alias("part"))
    merged = both.groupBy(query_key, F.left(text, F.lit(KEY_LENGTH)).alias("_key")).agg(
        F.round(F.sum("part"), 9).alias("rrf_score"), F.array_join(F.array_sort(F.collect_set("kind")), "+").alias("search_type"), F.min(F.struct("list", "place", key)).alias("first"))
    order = Window.partitionBy(query_key).orderBy(F.desc("rrf_score"), "first.list", "first.place")
    return merged.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k).select(query_key, F.col(f"first.{key}").alias(key), "rrf_score", "search_type", "place")


def overlap(query: Column, text: Column) -> Column:
    """The default reranker: the share of the query's distinct words that the text holds."""
    asked = F.array_distinct(tokens(query))
    return F.size(F.array_intersect(asked, tokens(text))) / F.greatest(F.size(asked), F.lit(1))


def rerank(hits: DataFrame, k: int = 5, scorer: Callable[[Column, Column], Column] = overlap, query_key: str = "query_id", key: str = "doc_id") -> DataFrame:
    """The ``k`` best hits of each query by ``scorer``; queries with no more than ``k`` hits keep theirs, unscored.

    ``hits``: (query_key, key, query, text, place, ...).
    """
    whole = Window.partitionBy(query_key)
    many = F.count("*").over(whole) > k
    scored = hits.withColumn("rerank_score", F.when(many, F.round(scorer(F.col("query"), F.col("text")), 6)))
    order = whole.orderBy(F.desc_nulls_last("rerank_score"), "place", key)
    return scored.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= k).withColumn("place", F.col("_n")).drop("_n")


def context_budget(hits: DataFrame, k: int = 5, most: int = 1200, query_key: str = "query_id") -> DataFrame:
    """The first ``k`` hits with their texts cut."""
    return hits.where(F.col("place") <= k).withColumn("text", cut(F.col("text"), most, "\n[...truncated]"))


def source_cards(hits: DataFrame) -> DataFrame:
    """(file, lines, language, score, search_type, preview) of hits with the columns of chunks."""
    return hits.select(
        F.col("document_path").alias("file"), F.format_string("%d-%d", "start_line", "end_line").alias("lines"), "language",
        F.bround(F.coalesce("rerank_score", "score"), 4).alias("score"), "search_type", F.left("content", F.lit(200)).alias("preview"))


def context_block(hits: DataFrame, query_key: str = "query_id") -> DataFrame:
    """(query_key, context): the hits of each query as numbered sections, in order."""
    piece = F.concat(F.lit("["), F.col("place").cast("string"), F.lit("] "), F.coalesce(F.col("source").cast("string"), F.lit("unknown")), F.lit("\n"), F.col("text"))
    return hits.groupBy(query_key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", piece.alias("piece")))), lambda x: x["piece"]), "\n\n").alias("context"))


def citations(answers: DataFrame, hits: DataFrame, query_key: str = "query_id") -> DataFrame:
    """(query_key, document_path, place): the first hit of each path that the answer names."""
    named = hits.join(answers, query_key).where((F.col("document_path") != "") & F.contains("answer", "document_path"))
    return named.groupBy(query_key, "document_path").agg(F.min("place").alias("place"))


def first_per_key(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")
