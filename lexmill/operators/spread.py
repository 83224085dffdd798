"""Tables that few tasks would read, spread over all cores before costly expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ROW_GROUP, PART = 128 << 20, 16 << 20


def spread(df: DataFrame) -> DataFrame:
    """``df`` over as many partitions as there are cores, or ``PART`` bytes each if that is more, where its estimated size is less than a row group a core, or one task would read more than a row group.

    A file's row group is read by one task, so a small table of long texts keeps
    one core busy, and so does a large one that was written with a row group of
    gigabytes.  Tables with a row group or more for every core, none of them
    above ``ROW_GROUP``, stay as they are: nothing is shuffled at scale.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    few = size < ROW_GROUP * cores or size * _largest_share(df) > ROW_GROUP
    return df.repartition(max(cores, -(-size // PART))) if few else df


def _largest_share(df: DataFrame) -> float:
    """The part of ``df``'s rows that one task reads at most; 0 where finding it takes more than files' footers."""
    ids = df.select(F.spark_partition_id().alias("p"))
    plan = ids._jdf.queryExecution().optimizedPlan()
    while plan.nodeName() == "Project":
        plan = plan.children().head()
    if plan.nodeName() != "LogicalRelation":
        return 0.0
    rows = ids.groupBy("p").agg(F.count("*").alias("n")).agg(F.max("n").alias("most"), F.sum("n").alias("all")).first()
    return rows["most"] / rows["all"] if rows["all"] else 0.0
