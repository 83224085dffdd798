"""A table of rows by key, kept as Parquet in numbered versions.

Each write makes a new version; readers take the latest whose ``_SUCCESS`` is
there, so a job that fails midway leaves the table as it was.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def upsert(existing: DataFrame, new: DataFrame, key: str, order: str | None = None) -> DataFrame:
    """Rows of ``new`` in place of those of the same key; of several new ones the last by ``order``."""
    latest = new
    if order is not None:
        latest = new.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order)))).where("_n = 1").drop("_n")
    return existing.join(new.select(key).distinct(), key, "left_anti").select(existing.columns).unionByName(latest, allowMissingColumns=True)


def delete_where(existing: DataFrame, condition: Column) -> DataFrame:
    """Rows for which the condition isn't true."""
    return existing.where(~F.coalesce(condition, F.lit(False)))


def delete_session(sessions: DataFrame, messages: DataFrame, gone: DataFrame, key: str = "session_id") -> tuple[DataFrame, DataFrame]:
    """Both tables without the sessions in ``gone``."""
    return tuple(t.join(gone.select(key), key, "left_anti").select(t.columns) for t in (sessions, messages))


class Store:
    def __init__(self, spark: SparkSession, path: str, key: str):
        self.spark, self.path, self.key = spark, path.rstrip("/"), key

    def _fs(self):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def version(self) -> int:
        """Number of the latest whole version, 0 for none."""
        fs, p = self._fs()
        if not fs.exists(p):
            return 0
        names = [s.getPath().getName() for s in fs.listStatus(p)]
        whole = [int(n[1:]) for n in names if n[:1] == "v" and n[1:].isdigit() and fs.exists(self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{n}/_SUCCESS"))]
        return max(whole, default=0)

    def read(self) -> DataFrame | None:
        v = self.version()
        return self.spark.read.parquet(f"{self.path}/v{v}") if v else None

    def write(self, rows: DataFrame) -> None:
        rows.write.mode("overwrite").parquet(f"{self.path}/v{self.version() + 1}")

    def upsert(self, rows: DataFrame, embed: Callable[[DataFrame], DataFrame] | None = None) -> None:
        """Insert or replace by key; ``embed`` adds what is computed for new rows only."""
        rows = embed(rows) if embed else rows
        old = self.read()
        self.write(rows if old is None else upsert(old, rows, self.key))

    def delete(self, condition: Column) -> int:
        """Number of rows deleted."""
        old = self.read()
        if old is None:
            return 0
        gone = old.where(condition).count()
        if gone:
            self.write(delete_where(old, condition))
        return gone

    def clear(self) -> None:
        old = self.read()
        if old is not None:
            self.write(old.limit(0))


def append(rows: DataFrame, path: str) -> None:
    """Log rows, scans and evaluations are only ever added; nested columns become JSON text."""
    nested = [c for c, t in rows.dtypes if t.startswith(("array", "struct", "map"))]
    rows.withColumns({c: F.to_json(c) for c in nested}).write.mode("append").parquet(path)
