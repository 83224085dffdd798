"""Retrieval metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def evaluate(cases: DataFrame, hits: DataFrame, query_key: str = "query_id", source: str = "source") -> DataFrame:
    """(query_key, retrieval_hit, mrr): whether and how high an expected source was ranked.

    ``cases``: (query_key, expected ARRAY); a case without expectations counts
    as met.  ``hits``: (query_key, source, place).
    """
    first = hits.join(cases.select(query_key, F.explode("expected").alias(source)).distinct(), [query_key, source]).groupBy(query_key).agg(F.min("place").alias("first"))
    free = F.coalesce(F.size("expected"), F.lit(0)) <= 0
    return cases.join(first, query_key, "left").select(query_key, (free | F.col("first").isNotNull()).alias("retrieval_hit"), F.when(free, 1.0).otherwise(F.coalesce(1.0 / F.col("first"), F.lit(0.0))).alias("mrr"))


def summarise(results: DataFrame) -> DataFrame:
    """One row of means; judged scores below 0 are errors and left out, -1 where none remain."""
    has = set(results.columns)
    judged = lambda c: F.coalesce(F.avg(F.when(F.col(c) >= 0, F.col(c))), F.lit(-1.0)) if c in has else F.lit(-1.0)
    return results.agg(
        F.count("*").alias("total_cases"), F.avg(F.col("retrieval_hit").cast("double")).alias("hit_rate"), F.avg("mrr").alias("avg_mrr"),
        judged("faithfulness").alias("avg_faithfulness"), judged("relevance").alias("avg_relevance"))
