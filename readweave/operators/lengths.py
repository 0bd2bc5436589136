"""Read lengths."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def lengths(reads: DataFrame) -> DataFrame:
    """(rid, len) of each read."""
    return reads.select("rid", F.length("seq").cast("long").alias("len"))


def histogram(reads: DataFrame, width: int = 100) -> DataFrame:
    """(bin, n_reads): how many reads have a length from bin to bin + width - 1."""
    return lengths(reads).groupBy((F.expr(f"len div {int(width)}") * width).alias("bin")).agg(F.count("*").alias("n_reads"))
