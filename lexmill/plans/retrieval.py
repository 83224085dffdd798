"""From questions to contexts in one lazy plan."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import bm25, hybrid, router, vector


BROADCAST_HITS = 400_000


def _texts(chunks: DataFrame, hits: DataFrame, queries: DataFrame, each: int, *columns: str) -> DataFrame:
    """``hits``, ``each`` at most a query, with ``columns`` of their chunks: the hits travel to the chunks, so that no text is shuffled."""
    few = queries.limit(BROADCAST_HITS // each + 1).count() <= BROADCAST_HITS // each
    return chunks.select("doc_id", *columns).join(F.broadcast(hits) if few else hits, "doc_id")


def hybrid_search(chunks: DataFrame, queries: DataFrame, k: int = 10, language: str | None = None, filter_both: bool = False, vectors: DataFrame | None = None) -> DataFrame:
    """(query_id, doc_id, rrf_score, search_type, place).

    ``chunks``: (doc_id, text, lang, embedding); ``queries``: (query_id, query,
    query_vector).  A language restricts the vector list only, unless
    ``filter_both``.  Where the vectors are a table of their own, pass it as
    ``vectors`` (doc_id, embedding): it is joined with the chunks' ids, not with
    their texts.
    """
    narrowed = chunks if language is None else chunks.where(F.col("lang") == language)
    words = bm25.search(narrowed if filter_both else chunks, queries, k)
    held = narrowed.select("doc_id", "embedding") if vectors is None else vectors.select("doc_id", "embedding").join(narrowed.select("doc_id"), "doc_id")
    near = vector.search(held, queries, k, key="doc_id")
    both = near.select("query_id", "doc_id", "place", F.lit(True).alias("near")).unionByName(words.select("query_id", "doc_id", "place", F.lit(False).alias("near")))
    # a hit is known by the beginning of its text
    both = _texts(chunks.withColumn("text", F.left(F.coalesce("text", F.lit("")), F.lit(hybrid.KEY_LENGTH))), both, queries, 2 * k, "text")
    return hybrid.fuse_lists(both, k)


def retrieve(chunks: DataFrame, queries: DataFrame, k: int = 10, keep: int = 5, scorer: Callable[[Column, Column], Column] = hybrid.overlap, language: str | None = None, vectors: DataFrame | None = None) -> DataFrame:
    """Hybrid search, then the reranker where a query has more than ``keep`` hits."""
    found = _texts(chunks, hybrid_search(chunks, queries, k, language, vectors=vectors), queries, k, "text", "source")
    return hybrid.rerank(found.join(queries.select("query_id", "query"), "query_id"), keep, scorer)


def routed(queries: DataFrame) -> DataFrame:
    """Questions with their routes."""
    return queries.withColumn("route", router.route(F.col("query")))


def contexts(chunks: DataFrame, queries: DataFrame, **parameters) -> DataFrame:
    """(query_id, context): what a model would be shown."""
    return hybrid.context_block(hybrid.context_budget(retrieve(chunks, queries, **parameters)))
