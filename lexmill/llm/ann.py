"""Approximate nearest neighbours on shifted space-filling curves.

Vectors are normalised and projected by ``CURVES`` random rotations to
``DIMENSIONS`` coordinates, each shifted and laid on a grid; a Hilbert curve
through the grid gives one order per rotation.  Each order is cut into ranges of
like size, its cells, by the quantiles of a bounded sample (``FIT`` vectors); every
vector is indexed, and Spark partitions the orders by runs of cells.  The
queries, by default the vectors whose id is divisible by ``QUERY_EVERY``, go to all
runs within ``window`` cells of their own on each curve.  There they are compared
with the vectors as matrix products, block by block; what the curves find is
merged and ranked by cosine.

The window is found per run: the exact neighbours of ``SAMPLE`` queries are
searched among all vectors, and the smallest window is taken at which ``RECALL`` of
them lie within it on some curve.  On vectors with structure it is short; on
isotropic noise it is a fixed share of the table, which is the price of a given
recall.

A run of more than ``RUN`` vectors (many equal ones, say) is split at random, and
its queries go to every part.

Defined results: null and empty vectors, vectors of a length other than the
commonest and all-zero vectors have no neighbours and are nobody's; null ids
likewise.  A vector is no neighbour of its own id; repeated ids count once per
neighbour.  Cosines are rounded to six places, ties go to the lower id.  Null
components count as 0.  Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._common import durable, mapped
from ._hilbert import hilbert_keys

NEIGHBOURS = 10
QUERY_EVERY = 50
CURVES = 3
DIMENSIONS = 8
BITS = 7
FIT = 1 << 17  # vectors whose keys bound the cells
CELL = 256  # vectors in a cell, as long as the sample can tell so many cells apart
RUN = 8192  # vectors compared in one task
SAMPLE = 1024
RECALL = 0.95
SEED = 7


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float32).reshape(-1, width)
    flat = np.nan_to_num(flat, nan=0.0, posinf=0.0, neginf=0.0)
    return flat / np.maximum(np.linalg.norm(flat, axis=1, keepdims=True), 1e-30)


class _Curves:
    """Keys of unit vectors on every curve, and cells once these are bounded."""

    def __init__(self, sample: np.ndarray, curves: int, cells: int):
        width = sample.shape[1]
        rng = np.random.default_rng(SEED)
        dims = min(DIMENSIONS, width)
        self.rotations = [np.linalg.qr(rng.normal(size=(width, width)))[0][:, :dims].astype(np.float32) for _ in range(curves)]
        self.shifts = np.random.default_rng(SEED + 1).uniform(-0.1, 0.1, (curves, dims))
        self.mean = sample.mean(axis=0)
        self.spread = [np.maximum(((sample - self.mean) @ r).std(axis=0), 1e-9) for r in self.rotations]
        at = np.linspace(0, len(sample), cells + 1)[1:-1].astype(np.int64)
        self.bounds = [np.sort(k)[at] for k in self.keys(sample)]

    def keys(self, x: np.ndarray) -> list[np.ndarray]:
        out = []
        for r, shift, spread in zip(self.rotations, self.shifts, self.spread):
            y = (x - self.mean) @ r / (6 * spread) + 0.5 + shift
            out.append(hilbert_keys((np.clip(y, 0, 1 - 1e-7) * (1 << BITS)).astype(np.int64), BITS))
        return out

    def cells(self, x: np.ndarray) -> np.ndarray:
        """A row of cells per vector, a column per curve."""
        return np.stack([np.searchsorted(b, k, side="right") for b, k in zip(self.bounds, self.keys(x))], axis=1)


def _best(sims: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and column of the ``k`` highest similarities of each row, of equal ones those of lower id; -inf left out."""
    if not sims.size:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    least = np.partition(sims, sims.shape[1] - min(k, sims.shape[1]), axis=1)[:, sims.shape[1] - min(k, sims.shape[1])]
    rows, cols = np.nonzero((sims >= least[:, None]) & np.isfinite(sims))
    order = np.lexsort((ids[cols], -sims[rows, cols], rows))
    rows, cols = rows[order], cols[order]
    place = np.arange(len(rows)) - np.searchsorted(rows, rows)
    return rows[place < k], cols[place < k]


def _similarities(q: np.ndarray, q_ids: np.ndarray, v: np.ndarray, ids: np.ndarray) -> np.ndarray:
    sims = np.round(q @ v.T, 6)
    sims[q_ids[:, None] == ids[None, :]] = -np.inf
    return sims


def _window(vectors: DataFrame, queries: DataFrame, curves: _Curves, width: int, k: int, recall: float) -> int:
    """Cells within which ``recall`` of the exact neighbours of ``SAMPLE`` queries lie on some curve."""
    picked = queries.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).toArrow()
    ids, x = picked["id"].to_numpy(), _matrix(picked["v"], width)
    own = curves.cells(x)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 4096):
                part = b.slice(at, 4096)
                other, v = part.column("id").to_numpy(), _matrix(part.column("v"), width)
                sims = _similarities(x, ids, v, other)
                r, c = _best(sims, other, k)
                far = np.abs(own[r] - curves.cells(v)[c]).min(axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(ids[r]), pa.array(other[c]), pa.array(sims[r, c].astype(np.float64)), pa.array(far.astype(np.int64))], names=["id", "other", "s", "far"])

    order = Window.partitionBy("id").orderBy(F.desc("s"), "other")
    best = mapped(vectors, run, "id bigint, other bigint, s double, far bigint").groupBy("id", "other").agg(F.max("s").alias("s"), F.min("far").alias("far")).withColumn("n", F.row_number().over(order)).where(F.col("n") <= k)
    needed = sorted(r["far"] for r in best.select("far").collect())  # SAMPLE * k rows
    return needed[min(len(needed) - 1, int(np.ceil(recall * len(needed))))] if needed else 0


def _placed(curves: _Curves, width: int, run_cells: int, window: int | None):
    """Rows (curve, run, cell, id, v): a vector in its own run on each curve, or with ``window`` a query in all runs that it reaches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            x = _matrix(b.column("v"), width)
            for c, cell in enumerate(curves.cells(x).T):
                low = cell // run_cells if window is None else np.maximum(cell - window, 0) // run_cells
                high = low if window is None else np.minimum(cell + window, len(curves.bounds[c])) // run_cells
                times = high - low + 1
                row = np.repeat(np.arange(len(x)), times)
                runs = low[row] + np.arange(len(row)) - np.repeat(np.cumsum(times) - times, times)
                for at in range(0, len(row), 8192):
                    r = row[at : at + 8192]
                    v = pa.FixedSizeListArray.from_arrays(pa.array(x[r].reshape(-1)), width).cast(pa.list_(pa.float32()))
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(r), c, np.int32)), pa.array(runs[at : at + 8192]), pa.array(cell[r].astype(np.int64)), b.column("id").take(pa.array(r)), v], names=["curve", "run", "cell", "id", "v"])

    return run


def _compare(width: int, window: int, k: int):
    """Vectors of a part of a run, held as they come, then its queries, batch by batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, joined = None, [], None
        for b in batches:
            key = np.stack([b.column(c).to_numpy() for c in ("curve", "run", "part", "asks")], axis=1) if b.num_rows else np.zeros((0, 4), np.int64)
            edges = np.flatnonzero(np.concatenate(([True], (key[1:] != key[:-1]).any(axis=1)))) if len(key) else []
            for lo, hi in zip(edges, np.append(edges[1:], len(key))):
                group, asks = tuple(key[lo, :3]), key[lo, 3]
                if group != at:
                    at, held, joined = group, [], None
                for start in range(lo, hi, 512):
                    part = b.slice(start, min(512, hi - start))
                    rows = part.column("id").to_numpy(), part.column("cell").to_numpy(), _matrix(part.column("v"), width)
                    if not asks:
                        held.append(rows)
                        continue
                    if joined is None and held:
                        joined = tuple(np.concatenate(x) for x in zip(*held))
                        held = []
                    if joined is None:
                        continue
                    ids, cells, v = joined
                    sims = _similarities(rows[2], rows[0], v, ids)
                    sims[np.abs(rows[1][:, None] - cells[None, :]) > window] = -np.inf
                    r, c = _best(sims, ids, k)
                    yield pa.RecordBatch.from_arrays([pa.array(rows[0][r]), pa.array(ids[c]), pa.array(sims[r, c])], names=["id", "other", "s"])

    return run


def nearest(
    vectors: DataFrame, k: int = NEIGHBOURS, curves: int = CURVES, recall: float = RECALL, query_every: int = QUERY_EVERY, id_column: str = "vec_id", vector_column: str = "embedding"
) -> DataFrame:
    """(id_column, neighbour, place, cosine): up to ``k`` neighbours of every vector whose id is divisible by ``query_every``, place 1 nearest."""
    named = vectors.select(F.col(id_column).cast("bigint").alias("id"), F.col(vector_column).cast("array<float>").alias("v")).where("id is not null and v is not null and size(v) > 0 and exists(v, e -> coalesce(e, 0) <> 0)")
    widths = named.groupBy(F.size("v").alias("w")).count().orderBy(F.desc("count"), "w").first()
    if widths is None:
        return vectors.sparkSession.createDataFrame([], f"{id_column} bigint, neighbour bigint, place int, cosine double")
    width, total = widths["w"], widths["count"]
    named = named.where(F.size("v") == width)
    queries = named.where(F.col("id") % query_every == 0)
    slots = 1 << 30
    share = min(1.0, FIT / total)
    sample = named.where(F.pmod(F.xxhash64("id", F.lit("fit")), F.lit(slots)) < share * slots).select("v").limit(2 * FIT).toArrow()  # FIT vectors or so
    if not sample.num_rows:
        sample = named.select("v").limit(1).toArrow()
    index = _Curves(_matrix(sample["v"], width), curves, int(np.clip(total // CELL, 1, max(1, sample.num_rows // 4))))
    window = _window(named, queries, index, width, k, recall)
    run_cells = max(1, (len(index.bounds[0]) + 1) * RUN // (2 * total))

    placed = mapped(named, _placed(index, width, run_cells, None), "curve int, run bigint, cell bigint, id bigint, v array<float>")
    # how many parts each run has; a row per curve and run
    sizes = durable(placed.groupBy("curve", "run").agg(F.ceil(F.count("*") / RUN).alias("parts")))
    asked = mapped(queries, _placed(index, width, run_cells, window), "curve int, run bigint, cell bigint, id bigint, v array<float>")
    # runs are few: FIT / 4 cells a curve at most
    there = placed.join(F.broadcast(sizes), ["curve", "run"]).withColumn("part", F.pmod(F.xxhash64("id"), "parts")).withColumn("asks", F.lit(0).cast("bigint"))
    here = asked.join(F.broadcast(sizes), ["curve", "run"]).withColumn("part", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("parts") - 1))).withColumn("asks", F.lit(1).cast("bigint"))
    met = there.unionByName(here).drop("parts").withColumn("curve", F.col("curve").cast("bigint")).repartition("curve", "run", "part").sortWithinPartitions("curve", "run", "part", "asks")
    found = mapped(met, _compare(width, window, k), "id bigint, other bigint, s float")
    merged = found.groupBy("id", "other").agg(F.max("s").alias("s"))
    order = Window.partitionBy("id").orderBy(F.desc("s"), "other")
    return merged.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k).select(F.col("id").alias(id_column), F.col("other").alias("neighbour"), "place", F.round(F.col("s").cast("double"), 6).alias("cosine"))
