"""Helpers shared by the training-data operators."""

from __future__ import annotations

import atexit
import ctypes
import shutil
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder for checkpoints that every executor sees.

    It is read from ``spark.checkpoint.dir``.  Where that is unset a temporary
    folder is made, but only for a session within one machine; on a cluster
    such a folder would be lost with its machine, so that is an error.
    """
    set_already = spark.sparkContext.getCheckpointDir()
    if set_already:
        return set_already
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        master = spark.sparkContext.master
        if master.split("[")[0] != "local":
            raise RuntimeError(f"spark.checkpoint.dir must name a folder that all executors of {master} share")
        named = tempfile.mkdtemp(prefix="lexmill-")
        atexit.register(shutil.rmtree, named, True)
    spark.sparkContext.setCheckpointDir(named)
    return named


def durable(df: DataFrame) -> DataFrame:
    """``df`` computed once and kept in the shared folder, its lineage cut."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame, name: str = "table") -> DataFrame:
    """As :func:`durable`, as compressed Parquet: for tables that are read more than once, a few columns at a time.

    The folder is removed when the session's process ends.
    """
    spark = df.sparkSession
    place = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(place)
    remove_at_end(spark, place)
    return spark.read.schema(df.schema).parquet(place)


def remove_at_end(spark: SparkSession, place: str) -> None:
    """Removes a folder of the shared file system when this process ends, if the session is still there."""

    def remove() -> None:
        try:
            path = spark._jvm.org.apache.hadoop.fs.Path(place)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
        except Exception:  # noqa: BLE001 - the session has ended before; nothing can be done from here
            pass

    atexit.register(remove)


def unused(columns: Iterable[str], *stems: str) -> list[str]:
    """Names made of ``stems`` that are none of ``columns``, in any case."""
    taken, out = {c.lower() for c in columns}, []
    for stem in stems:
        while stem.lower() in taken:
            stem = f"_{stem}"
        taken.add(stem.lower())
        out.append(stem)
    return out


def row_slices(sizes: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Consecutive row ranges whose summed ``sizes`` stay within ``limit`` (one row at least)."""
    ends = np.cumsum(sizes)
    at = 0
    while at < len(sizes):
        base = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, base + limit, side="right")))
        yield at, to
        at = to


def byte_sizes(column: pa.Array) -> np.ndarray:
    return pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def give_back() -> None:
    """Returns freed memory of this Python worker to the machine.

    Workers are used again by later tasks, of other operators too; what an
    allocator keeps for itself would add up in an executor.
    """
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


BATCH_BYTES = 8 << 20


def mapped(df: DataFrame, f, schema) -> DataFrame:
    """``df.mapInArrow(f, schema)`` in batches of ``BATCH_BYTES`` or so, the worker's memory given back after each task.

    Ten thousand rows at once, Spark's default, are far more than any function
    here needs.  The session's setting is lowered for that, never raised.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from f(batches)
        give_back()

    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    now = conf.get(key).lower().rstrip("b")
    if not now.isdigit() or int(now) > BATCH_BYTES:
        conf.set(key, str(BATCH_BYTES))
    return df.mapInArrow(run, schema)


ID_BITS = 1 << 26


def _slot(column: str) -> Column:
    # by its digits, so that integers of any width are found
    return F.pmod(F.xxhash64(F.col(column).cast("string")), F.lit(ID_BITS)) + 1


def _bits(values: DataFrame) -> DataFrame:
    """(bucket, bits) of a column ``s`` of integers: rows of 4 KB."""
    return durable(values.groupBy(F.bitmap_bucket_number("s").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("s")).alias("bits")))


def id_bitmap(ids: DataFrame, column: str = "doc_id") -> DataFrame:
    """A set of ids as bits: at most ``ID_BITS`` / 8 bytes (8 MB) in rows of 4 KB, however many ids there are."""
    return _bits(ids.select(_slot(column).alias("s")))


def _looked_up(rows: DataFrame, bitmap: DataFrame, value: Column, mark: str) -> DataFrame:
    bucket, bits = unused([*rows.columns, mark], "bucket", "bits")
    at = F.bitmap_bit_position(value)
    byte = F.conv(F.hex(F.substring(bits, (at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    bit = F.coalesce(byte.bitwiseAND(F.call_function("shiftleft", F.lit(1), (at % 8).cast("int"))) != 0, F.lit(False))
    few = bitmap.select(F.col("bucket").alias(bucket), F.col("bits").alias(bits))
    joined = rows.join(F.broadcast(few), F.bitmap_bucket_number(value) == F.col(bucket), "left")  # 8 MB at most
    return joined.withColumn(mark, bit & value.isNotNull()).drop(bucket, bits)


def maybe_in(rows: DataFrame, bitmap: DataFrame, column: str, mark: str) -> DataFrame:
    """``rows`` with a column ``mark``: false only where the id isn't in the set, so that few others need a shuffle."""
    return _looked_up(rows, bitmap, F.when(F.col(column).isNotNull(), _slot(column)), mark)


def without_ids(rows: DataFrame, gone: DataFrame, column: str = "doc_id") -> DataFrame:
    """``rows`` whose id isn't in ``gone``.  Null ids stay.

    Integers that lie close enough together to be marked exactly in 8 MB are, and
    nothing is shuffled; else only rows whose id may be in ``gone`` are.
    """
    mark = unused(rows.columns, "maybe")[0]
    if dict(rows.dtypes)[column] in ("bigint", "int", "smallint", "tinyint"):
        ids = gone.select(F.col(column).cast("bigint").alias("s"))
        if ids.select(F.bitmap_bucket_number("s")).distinct().count() <= ID_BITS >> 15:
            return _looked_up(rows, _bits(ids), F.col(column).cast("bigint"), mark).where(~F.col(mark)).drop(mark)
    marked = maybe_in(rows, id_bitmap(gone, column), column, mark)
    rest = marked.where(F.col(mark)).join(gone.select(column), column, "left_anti")
    return marked.where(~F.col(mark)).drop(mark).unionByName(rest.drop(mark).select(rows.columns))


BROADCAST_ROWS = 400_000


def small(df: DataFrame) -> DataFrame:
    """``df``, a stored table of a few numbers a row, to be broadcast if it has ``BROADCAST_ROWS`` (some 20 MB) at most."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df
