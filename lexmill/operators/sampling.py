"""Stratified systematic samples."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def stratified(chunks: DataFrame, most: int, group: str = "source", order: str = "doc_id", empty_is_unknown: bool = True) -> DataFrame:
    """All rows if there are no more than ``most``; else every ``step``-th of each file, files in order, cut to ``most``.

    A missing file counts as "unknown", an empty one too unless told otherwise.
    The counts per file are aggregated first, so that only rows of the sample
    are sorted together at the end.
    """
    name = F.coalesce(F.when(F.col(group) != "", F.col(group)) if empty_is_unknown else F.col(group), F.lit("unknown"))
    named = chunks.withColumn("_file", name)
    whole = named.groupBy("_file").agg(F.count("*").alias("_size"))
    total = whole.agg(F.sum("_size").alias("_total"), F.count("*").alias("_files"))
    plan = whole.crossJoin(F.broadcast(total)).withColumn("_per", F.greatest(F.lit(1), F.expr(f"{most} div _files"))).withColumn("_step", F.greatest(F.lit(1), F.expr("_size div _per")))  # one row
    ranked = named.withColumn("_n", F.row_number().over(Window.partitionBy("_file").orderBy(order)) - 1).join(plan, "_file")
    chosen = ranked.where((F.col("_total") <= most) | ((F.col("_n") % F.col("_step") == 0) & (F.expr("_n div _step") < F.col("_per"))))
    return chosen.orderBy("_file", "_n").limit(most).select(chunks.columns)
