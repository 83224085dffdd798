"""Summaries of the query log, sessions, files and scans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import normal_path, parent_dir, suffix


def query_log_of_events(events: DataFrame) -> DataFrame:
    """(query_id, user_id, category, search_type, latency_ms, input_tokens, output_tokens, created_at) from raw events.

    ``created_at`` is in epoch seconds.
    """
    kind = F.when(F.col("event_id") % 2 == 0, "hybrid").otherwise("vector")
    return events.select(
        F.col("event_id").alias("query_id"), "user_id", F.col("event_type").alias("category"), kind.alias("search_type"), F.col("value").alias("latency_ms"),
        (F.col("event_id") % 100).alias("input_tokens"), (F.col("event_id") % 37).alias("output_tokens"), F.unix_timestamp(F.col("ts").cast("timestamp")).cast("double").alias("created_at"))


def since(log: DataFrame, now: float, days: float) -> DataFrame:
    return log.where(F.col("created_at") > now - days * 86400)


def summary(log: DataFrame) -> DataFrame:
    return log.agg(F.count("*").alias("total_queries"), F.bround(F.coalesce(F.avg("latency_ms"), F.lit(0.0)), 1).alias("avg_latency_ms"), F.coalesce(F.sum(F.coalesce("input_tokens", F.lit(0)) + F.coalesce("output_tokens", F.lit(0))), F.lit(0)).alias("total_tokens"))


def by(log: DataFrame, column: str) -> DataFrame:
    """(column, count); a missing value is "unknown"."""
    return log.groupBy(F.coalesce(column, F.lit("unknown")).alias(column)).agg(F.count("*").alias("count"))


def daily(log: DataFrame) -> DataFrame:
    return log.groupBy(F.date_format(F.to_date(F.timestamp_seconds("created_at")), "yyyy-MM-dd").alias("day")).agg(F.count("*").alias("count"), F.bround(F.avg("latency_ms"), 4).alias("avg_latency_ms"))


def recent(log: DataFrame, n: int = 20) -> DataFrame:
    return log.orderBy(F.desc("created_at"), F.desc("query_id")).limit(n)


def page(rows: DataFrame, order: list, limit: int = 50, offset: int = 0) -> DataFrame:
    return rows.orderBy(*order).offset(offset).limit(limit)


def file_inventory(chunks: DataFrame, file: str = "source", language: str = "lang", order: str = "doc_id") -> DataFrame:
    """(document_path, language, chunk_count) of every named file; the language is its first chunk's."""
    return chunks.where(F.col(file) != "").groupBy(F.col(file).alias("document_path")).agg(F.min_by(F.coalesce(language, F.lit("")), order).alias("language"), F.count("*").alias("chunk_count"))


def by_top_dir(files: DataFrame, path: str = "path") -> DataFrame:
    """(folder, files): names grouped by their first folder."""
    p = normal_path(F.col(path))
    return files.groupBy(F.when(F.contains(p, F.lit("/")), F.split(p, "/")[0]).otherwise("(root)").alias("folder")).agg(F.array_sort(F.collect_list(p)).alias("files"))


def by_parent_dir(files: DataFrame, path: str = "path") -> DataFrame:
    return files.groupBy(parent_dir(F.col(path)).alias("folder")).agg(F.count("*").alias("count"))


def extension_histogram(files: DataFrame, path: str = "path", most: int = 8) -> DataFrame:
    return files.groupBy(suffix(F.col(path)).alias("extension")).agg(F.count("*").alias("count")).orderBy(F.desc("count"), "extension").limit(most)


def risk_label(score: Column) -> Column:
    return F.when(score >= 75, "critical").when(score >= 50, "high").when(score >= 25, "medium").otherwise("low")


def percent(share: Column) -> Column:
    """Whole per cent, an em dash for what couldn't be judged."""
    return F.when(share < 0, "—").otherwise(F.concat(F.round(share * 100).cast("int").cast("string"), F.lit("%")))


def latest(rows: DataFrame, key: list[str], order: str) -> DataFrame:
    """The newest row of each key."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy(F.desc(order)))).where("_n = 1").drop("_n")


def sessions(messages: DataFrame, session: str = "conv_id", order: str = "turn", text: str = "text") -> DataFrame:
    """(session, title, messages, updated_at): each session titled by its first message."""
    title = F.min_by(text, order)
    return messages.groupBy(session).agg(F.when(F.length(title) > 50, F.concat(F.left(title, F.lit(50)), F.lit("..."))).otherwise(title).alias("title"), F.count("*").alias("messages"), F.max(order).alias("updated_at"))
