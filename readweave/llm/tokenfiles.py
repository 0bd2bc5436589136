"""Token ids as Parquet list columns: written in order, read back selectively.

A file has, for each document, its key, the number of ids before it in its part, its
number of ids and the ids as a list. Lists are dictionary-encoded (ids repeat; pages
that outgrow the dictionary fall back to delta encoding in format version 2), the
counts delta-encoded. Row groups and pages are small enough that the column and
page indexes let a reader fetch the metadata alone, or the ids of a range of keys.

Keys ascend over the files in order of their names; rows with equal keys stay apart,
in no certain order, and null keys come first. Null texts count as empty and have
the end token only; very long texts are one row with all their ids. An empty table gives
files without rows. Other columns are not carried.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from readweave.llm import flat, wordpieces

#: How files are written, as options of Spark's Parquet writer.
FORMAT = {
    "compression": "zstd",
    "parquet.writer.version": "PARQUET_2_0",
    "parquet.enable.dictionary": "true",
    "parquet.dictionary.page.size": str(1 << 20),
    "parquet.block.size": str(16 << 20),
    "parquet.page.size": str(256 << 10),
    "parquet.page.row.count.limit": "2000",
}


def write(df: DataFrame, folder: str, vocabulary: str, end_id: int, text: str = "text", key: str = "doc_id") -> None:
    """Encode the texts in ascending order of ``key`` and write them to ``folder``."""
    source = wordpieces.source_of(df.sparkSession, vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part, before = wordpieces.loaded(source.value), TaskContext.get().partitionId(), 0
        for batch in batches:
            for lo, hi, buf, at in flat.windows(batch.column(1)):
                ids, counts = encoder.encode_ended(buf, at, end_id)
                ends = np.r_[0, np.cumsum(counts)]
                tokens = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(ids.astype(np.int32)))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(lo, hi - lo),
                        pa.array(np.full(hi - lo, part, np.int32)),
                        pa.array(before + ends[:-1]),
                        pa.array(counts),
                        tokens
                    ],
                    ["key", "part", "part_start", "n_tokens", "tokens"]
                )
                before += int(ends[-1])

    kind = dict(df.dtypes)[key]
    ordered = df.selectExpr(f"`{key}` as key", f"`{text}` as text").repartitionByRange("key").sortWithinPartitions("key")
    ordered.mapInArrow(
        run,
        f"key {kind}, part int, part_start long, n_tokens long, tokens array<int>"
    ).withColumnRenamed("key", key).write.options(**FORMAT).parquet(folder)


def read(spark: SparkSession, folder: str) -> DataFrame:
    """The documents of the files, with start: the ids of all documents before.

    Of the other files only the counts are read. One row for each file is broadcast,
    so the broadcast's size is bounded by the number of files.
    """
    files = spark.read.parquet(folder)
    totals = files.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = totals.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    return files.join(F.broadcast(before), "part").withColumn("start", F.col("before") + F.col("part_start")).drop("part", "part_start", "before")


def with_crc32(df: DataFrame, key: str = "doc_id") -> DataFrame:
    """``key``, start, n_tokens and the CRC-32 of the ids as little-endian unsigned 32-bit integers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("tokens")
            values = np.ascontiguousarray(pc.list_flatten(column).to_numpy(zero_copy_only=False).astype("<i4"))
            ends = np.r_[0, np.cumsum(pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False))].astype(np.int64)
            data = memoryview(values.view(np.uint8))
            crc = [zlib.crc32(data[4 * a : 4 * b]) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("key"), batch.column("start"), batch.column("n_tokens"), pa.array(crc, pa.int64())],
                ["key", "start", "n_tokens", "ids_crc32"]
            )

    kind = dict(df.dtypes)[key]
    out = df.select(F.col(key).alias("key"), "start", "n_tokens", "tokens").mapInArrow(run, f"key {kind}, start long, n_tokens long, ids_crc32 long")
    return out.withColumnRenamed("key", key)
