"""Dense ordinals without a global window."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from readweave.session import written


def with_ordinal(df: DataFrame, by: str, name: str = "rid") -> DataFrame:
    """``df`` with the row's rank from 0 by column ``by`` (ties in any order).

    Range-partitioned and sorted rows are written with their place in the partition;
    one row for each partition tells how many come before. Only that small table is
    ever in one task, and only it is broadcast.
    """
    placed = df.repartitionByRange(by).sortWithinPartitions(by).withColumns(
        {"__part": F.spark_partition_id(), "__place": F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)}
    )
    table = written(placed, "ordinals")
    counts = table.groupBy("__part").agg(F.count("*").alias("n"))
    before = counts.select("__part", (F.sum("n").over(Window.orderBy("__part")) - F.col("n")).alias("__before"))
    return table.join(F.broadcast(before), "__part").withColumn(name, F.col("__before") + F.col("__place")).drop("__part", "__place", "__before")
