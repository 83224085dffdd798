"""Exact cosine search, and pairs of similar vectors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

THRESHOLD = 0.25
QUERIES_AT_ONCE = 20_000
BLOCK = 2048


def _unit(column: pa.Array) -> np.ndarray:
    """Rows of unit length in double precision; rows of zeros stay."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if not len(column):
        return np.zeros((0, 0))
    x = np.nan_to_num(column.flatten().to_numpy(zero_copy_only=False).astype(np.float64), nan=0.0, posinf=0.0, neginf=0.0).reshape(len(column), -1)
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(norm > 0, norm, 1.0)


def search(vectors: DataFrame, queries: DataFrame, k: int = 10, threshold: float = THRESHOLD, key: str = "vec_id", vector: str = "embedding", query_key: str = "query_id", query_vector: str = "query_vector") -> DataFrame:
    """(query_key, key, score, place): the ``k`` most similar vectors of each query, those under ``threshold`` dropped afterwards.

    Queries travel to the vectors, ``QUERIES_AT_ONCE`` or so in a pass: each partition
    answers all of them with matrix products and passes on its own best only.
    Filter ``vectors`` first to search within them.  Null components count as 0;
    only vectors of the queries' commonest length are compared.
    """
    asked = queries.select(F.col(query_key).cast("bigint").alias("q"), F.col(query_vector).alias("v")).where("v is not null")
    widths = asked.groupBy(F.size("v").alias("w")).count().orderBy(F.desc("count"), "w").first()
    width, passes = (widths["w"], -(-widths["count"] // QUERIES_AT_ONCE)) if widths else (0, 1)
    asked = asked.where(F.size("v") == width)
    held = vectors.select(F.col(key).cast("bigint").alias("id"), F.col(vector).alias("v")).where("id is not null and v is not null").where(F.size("v") == width)
    best = None
    for i in range(passes):
        block = (asked if passes == 1 else asked.where(F.pmod(F.xxhash64("q"), F.lit(passes)) == i)).toArrow()
        found = held.mapInArrow(_answer(block["q"].to_numpy(), _unit(block["v"]), k), "q bigint, id bigint, cos double")
        best = found if best is None else best.unionByName(found)
    order = Window.partitionBy("q").orderBy(F.desc("cos"), "id")
    best = best.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)
    return best.select(F.col("q").alias(query_key), F.col("id").alias(key), F.bround((1 + F.col("cos")) / 2, 4).alias("score"), "place").where(F.col("score") >= threshold)


def _answer(names: np.ndarray, q: np.ndarray, k: int):
    """The ``k`` best of each block of vectors for each query."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, BLOCK):
                part = b.slice(at, BLOCK)
                ids = part.column("id").to_numpy()
                if not len(q):
                    continue
                cos = np.round(q @ _unit(part.column("v")).T, 9)
                order = np.lexsort((np.broadcast_to(ids, cos.shape), -cos), axis=1)[:, :k]
                row = np.repeat(np.arange(len(q)), order.shape[1])
                yield pa.RecordBatch.from_arrays([pa.array(names[row]), pa.array(ids[order.reshape(-1)]), pa.array(cos[row, order.reshape(-1)])], names=["q", "id", "cos"])

    return run


def similar_pairs(vectors: DataFrame, cosine: float, key: str = "vec_id", vector: str = "embedding", blocks: int | None = None) -> DataFrame:
    """(a, b, cosine), a < b, of all pairs at or above ``cosine``: blocks of vectors meet pairwise as matrix products.

    Each vector goes to as many tasks as there are blocks, so that a task holds
    two blocks and no more, whatever the size of the table.
    """
    held = vectors.select(F.col(key).cast("bigint").alias("id"), F.col(vector).alias("v")).where("id is not null and v is not null")
    if blocks is None:
        blocks = max(1, -(-held.count() // BLOCK))
    own = F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")
    sent = held.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).withColumn("low", F.least("own", "other")).withColumn("high", F.greatest("own", "other"))

    def meet(key_: tuple, rows: pa.Table) -> pa.Table:
        low, high = key_[0].as_py(), key_[1].as_py()
        own_, ids, v = rows["own"].to_numpy(), rows["id"].to_numpy(), _unit(rows["v"])
        left, right = np.flatnonzero(own_ == low), np.flatnonzero(own_ == high)
        out: list[tuple] = []
        for at in range(0, len(left), BLOCK):
            part = left[at : at + BLOCK]
            cos = np.round(v[part] @ v[right].T, 9) if len(right) else np.zeros((len(part), 0))
            near = cos >= cosine
            near &= (ids[part][:, None] < ids[right][None, :]) if low == high else (ids[part][:, None] != ids[right][None, :])
            i, j = np.nonzero(near)
            x, y = ids[part][i], ids[right][j]
            out.append((np.minimum(x, y), np.maximum(x, y), cos[i, j]))
        a, b, c = (np.concatenate(o) for o in zip(*out)) if out else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64()), "cosine": pa.array(c, pa.float64())})

    return sent.groupBy("low", "high").applyInArrow(meet, "a bigint, b bigint, cosine double")
