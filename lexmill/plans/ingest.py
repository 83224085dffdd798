"""From files to stored chunks with vectors."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession

from ..functions.models import hashing_embedder
from ..operators.chunking import chunk
from ..sources.files import load_documents
from ..sources.store import Store


def ingest(spark: SparkSession, root: str, store: Store, embed: Callable[[Column], Column] | None = None, **sizes) -> DataFrame:
    """All documents below ``root`` cut into chunks and put into the store; only new chunks are embedded."""
    chunks = chunk(load_documents(spark, root), **sizes)
    function = embed or hashing_embedder()
    store.upsert(chunks, lambda rows: rows.withColumn("embedding", function(rows["content"])))
    return store.read()
