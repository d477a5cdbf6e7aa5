"""Consecutive numbers over a whole table without gathering it in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from turnlens.lineage import kept


def numbered(rows: DataFrame, order: str, name: str = "rn") -> DataFrame:
    """``rows`` with 0, 1, 2, ... in ``order``.

    Rows are dealt by ranges and numbered within each; only the count of each
    range, one row a partition, is summed in order and broadcast. The ranges
    come from a sample, so they are kept before they are counted.
    """
    dealt = kept(rows.repartitionByRange(order).withColumn("_part", F.spark_partition_id()))
    inside = dealt.withColumn("_in", F.row_number().over(Window.partitionBy("_part").orderBy(order)) - 1)
    counts = dealt.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = counts.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))
    return inside.join(F.broadcast(before), "_part").withColumn(name, F.col("_before") + F.col("_in")).drop("_part", "_in", "_before")
