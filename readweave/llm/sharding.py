"""Shards of nearly equal bytes from groups that stay together: longest processing time first.

Groups sorted by size, largest first, each go to the least-loaded shard, which a heap names.
That order needs the sizes alone, so the plan is made over a histogram of sizes and the
groups themselves never leave their tasks:

1.  *Rows.* One pass gives each row's bytes, checksum and a 128-bit digest of its group; texts aren't read again.
2.  *Groups.* Partial aggregates by digest add up a group's bytes, so one with very many copies is summed where its rows lie.
3.  *Histogram.* Groups are counted by size. Sizes below 2**13, and sizes of a 2**15th of all bytes or more
    (2**15 groups at most), are told apart exactly; of others the first 13 binary digits count. So there are
    some 200,000 sizes at most, whatever the input, and no size is off by more than a 4096th.
4.  *Plan.* The heap deals the groups of each size; where the shards' loads lie within one size of
    each other whole rounds are dealt at once. Each size gets ranges of ranks, one for each shard.
5.  *Ranks.* A group's rank among those of its size is its place in its task and the number of them in tasks before.
    Places in a shard come in the same way.

Null texts are as empty ones. Empty texts have size 1; very long ones count whole. Equal texts, repeated rows among
them, are one group and keep together; groups that tie in size are interchangeable. Null keys stay null. An empty table gives
one. Other columns are not carried.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from readweave.session import remove, written

#: Binary digits of a size that count, and the share of all bytes (one in so many) from which sizes count exactly.
DIGITS, EXACT = 13, 1 << 15


def size_class(size: str, total: int) -> Column:
    """The size itself, or its first DIGITS binary digits with zeros after."""
    cut = f"greatest(length(bin({size})) - {DIGITS}, 0)"
    return F.expr(f"case when {size} >= {total / EXACT!r} then {size} else shiftleft(shiftright({size}, {cut}), {cut}) end")


def schedule(sizes: list[tuple[float, int]], shards: int) -> np.ndarray:
    """How many groups of each size (in descending order, with their number) go to each shard; ties go to the lower shard."""
    heap, dealt = [(0.0, k) for k in range(shards)], np.zeros((len(sizes), shards), np.int64)
    for row, (size, n) in enumerate(sizes):
        while n:
            if n >= shards:  # the least-loaded shards that lie within one size of each other take whole rounds
                order = sorted(heap)
                near = next((k for k in range(1, shards) if order[k][0] > order[0][0] + size), shards)
                room = n // near if near == shards else min(n // near, int((order[near][0] - order[near - 1][0]) // size))
                if room:
                    for k in range(near):
                        dealt[row, order[k][1]] += room
                        order[k] = (order[k][0] + room * size, order[k][1])
                    n -= room * near
                    heapq.heapify(heap := order)
                    continue
            load, shard = heap[0]
            heapq.heapreplace(heap, (load + size, shard))
            dealt[row, shard] += 1
            n -= 1
    return dealt


def placed(df: DataFrame, by: str) -> DataFrame:
    """``df`` with part (the task) and place (how many rows with the same ``by`` came before in it). To be written before it is used."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[int, int] = {}
        part = TaskContext.get().partitionId()
        for batch in batches:
            if not batch.num_rows:
                continue
            value, back, n = np.unique(batch.column(by).to_numpy(), return_inverse=True, return_counts=True)
            order = np.argsort(back, kind="stable")
            place = np.empty(len(back), np.int64)
            place[order] = np.arange(len(back)) - np.repeat(np.cumsum(n) - n, n)
            place += np.array([seen.get(v, 0) for v in value.tolist()])[back]
            for v, m in zip(value.tolist(), n.tolist(), strict=True):
                seen[v] = seen.get(v, 0) + m
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(np.full(len(back), part, np.int32)), pa.array(place)], [*batch.schema.names, "part", "place"]
            )

    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField("part", T.IntegerType()), T.StructField("place", T.LongType())]))


def before(table: DataFrame, by: str) -> DataFrame:
    """(by, part, before): how many rows with the same ``by`` lie in tasks before, of a table that ``placed`` made."""
    counts = table.groupBy(by, "part").agg(F.count("*").alias("n"))
    return counts.select(by, "part", (F.sum("n").over(Window.partitionBy(by).orderBy("part")) - F.col("n")).alias("before"))


def shard(docs: DataFrame, shards: int = 8, key: str = "doc_id", text: str = "text", group: Column | None = None) -> DataFrame:
    """(``key``, size, text_crc32, shard, slot): rows of one ``group`` (equal texts by default) share a shard; slots of a shard are gapless from 0.

    A row's size is its text's bytes in UTF-8 and 1.
    """
    value = F.coalesce(F.col(text), F.lit(""))
    sizes = written(
        docs.select(
            F.col(key).alias("key"),
            (F.octet_length(value) + 1).cast("long").alias("size"),
            F.crc32(value.cast("binary")).alias("text_crc32"),
            F.unhex(F.md5((value if group is None else group).cast("binary"))).alias("group")
        ),
        "sizes"
    )
    rows = sizes.withColumn("group", F.coalesce("group", F.lit(b"")))
    total = rows.agg(F.sum("size")).first()[0] or 0
    sums = rows.groupBy("group").agg(F.sum("size").alias("bytes")).withColumn("class", size_class("bytes", total))
    groups = written(placed(sums, "class"), "groups")
    # a row for each size: their number is bounded, see above
    found = sorted(((r["class"], r["n"], r["bytes"]) for r in groups.groupBy("class").agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes")).collect()), reverse=True)
    dealt = schedule([(b / n, n) for _, n, b in found], shards)
    plan = docs.sparkSession.createDataFrame(
        [(c, [int(v) for v in ends]) for (c, _, _), ends in zip(found, np.cumsum(dealt, axis=1)[:, :-1], strict=True)], "class long, ends array<long>"
    )
    ranked = groups.join(before(groups, "class"), ["class", "part"]).withColumn("rank", F.col("before") + F.col("place"))
    own = ranked.join(F.broadcast(plan), "class").select("group", F.expr("cast(size(filter(ends, e -> e <= rank)) as int)").alias("shard"))
    table = written(placed(rows.join(own, "group").select("key", "size", "text_crc32", "shard"), "shard"), "shards")
    for done in (groups, sizes):
        remove(done)
    slots = table.join(F.broadcast(before(table, "shard")), ["shard", "part"])  # as many rows as tasks times shards
    return slots.select(F.col("key").alias(key), "size", "text_crc32", "shard", (F.col("before") + F.col("place")).alias("slot"))
