"""Arrow batches of bounded size for functions over long texts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

BATCH_BYTES = 8 << 20


def mapped(df: DataFrame, f, schema) -> DataFrame:
    """``df.mapInArrow(f, schema)`` in batches of ``BATCH_BYTES`` or so, where Spark would send ten thousand rows of any length.

    The session's setting is lowered for that, never raised.
    """
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    now = conf.get(key).lower().rstrip("b")
    if not now.isdigit() or int(now) > BATCH_BYTES:
        conf.set(key, str(BATCH_BYTES))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from f(batches)
        pa.default_memory_pool().release_unused()

    return df.mapInArrow(run, schema)


def row_slices(sizes: np.ndarray, limit: int, most: int) -> Iterator[tuple[int, int]]:
    """Consecutive ranges of ``most`` rows at most whose summed ``sizes`` stay within ``limit`` (one row at least)."""
    ends = np.cumsum(sizes)
    at = 0
    while at < len(sizes):
        base = ends[at - 1] if at else 0
        to = min(at + most, max(at + 1, int(np.searchsorted(ends, base + limit, side="right"))))
        yield at, to
        at = to
