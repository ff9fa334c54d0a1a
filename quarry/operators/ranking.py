"""Positions in a global order without a one-task window."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.session import cut


def positions(df: DataFrame, order: list, name: str = "position") -> DataFrame:
    """Adds the 1-based position of each row in a total order.

    Rows are dealt by ranges of the order and numbered inside their range; the ranges' sizes (one row a partition)
    give the offsets. ``order`` must be total, or rows that tie get their positions in any order.
    """
    keys = [F.col(c) if isinstance(c, str) else c for c in order]
    dealt = cut(df.repartitionByRange(*keys).withColumn("_range", F.spark_partition_id()))
    sizes = dealt.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(F.col("_range").alias("_o"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = F.row_number().over(Window.partitionBy("_range").orderBy(*keys))
    numbered = dealt.withColumn("_r", inside).join(offsets, F.col("_range") == F.col("_o"))
    return numbered.withColumn(name, (F.col("_r") + F.col("_before")).cast("long")).drop("_range", "_o", "_before", "_r")
