"""Files and turns as they arrive."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.chunking import chunk
from ..sources.files import as_documents
from ..sources.store import Store

FILES_AT_ONCE = 50


def watch(spark: SparkSession, root: str, store: Store, checkpoint: str, files_at_once: int = FILES_AT_ONCE, **sizes) -> StreamingQuery:
    """Chunks of new files below ``root`` put into the store, so many files at a time, until none are left."""
    schema = "path string, modificationTime timestamp, length bigint, content binary"
    files = spark.readStream.format("binaryFile").schema(schema).option("recursiveFileLookup", True).option("maxFilesPerTrigger", files_at_once).load(root)
    put = lambda batch, _: store.upsert(chunk(as_documents(batch, root), **sizes))
    return files.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def every_nth_turn(turns: DataFrame, user: str, interval: int = 3) -> DataFrame:
    """(user, turn_number) at each user's every ``interval``-th turn; the counter is kept as stream state."""

    def count(key: tuple[Any, ...], batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        seen = state.get[0] if state.exists else 0
        new = sum(len(b) for b in batches)
        state.update((seen + new,))
        due = [n for n in range(seen + 1, seen + new + 1) if n % interval == 0]
        yield pd.DataFrame({user: [key[0]] * len(due), "turn_number": due})

    kind = dict(turns.dtypes)[user]
    return turns.groupBy(user).applyInPandasWithState(count, f"{user} {kind}, turn_number bigint", "seen bigint", "append", GroupStateTimeout.NoTimeout)


def windowed_counts(events: DataFrame, width: str, slide: str | None = None, late: str = "1 hour", time: str = "ts", *keys: Column | str) -> DataFrame:
    """Counts and mean values per window of event time, batch or stream; a stream drops what comes later than ``late``."""
    timed = events.withColumn("_t", F.col(time).cast("timestamp"))
    if timed.isStreaming:
        timed = timed.withWatermark("_t", late)
    window = F.window("_t", width, slide) if slide else F.window("_t", width)
    return timed.groupBy(window.alias("w"), *keys).agg(F.count("*").alias("count"), F.round(F.avg("value"), 6).alias("avg_value")).select(F.unix_timestamp("w.start").alias("window_start"), *keys, "count", "avg_value")


def session_counts(events: DataFrame, user: str = "user_id", gap: str = "30 minutes", time: str = "ts") -> DataFrame:
    """(user, session_start, count): runs of events with less than ``gap`` between them."""
    timed = events.withColumn("_t", F.col(time).cast("timestamp"))
    if timed.isStreaming:
        timed = timed.withWatermark("_t", gap)
    return timed.groupBy(F.session_window("_t", gap).alias("w"), user).agg(F.count("*").alias("count")).select(user, F.unix_timestamp("w.start").alias("session_start"), "count")
