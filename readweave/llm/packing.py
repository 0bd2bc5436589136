"""Best-fit packing of documents into sequences of at most ``capacity`` tokens.

The plan depends only on how many pieces there are of each length, so the driver
handles at most ``capacity`` numbers whatever the input. Exact-complement hashing:
lengths from the largest down look up single lengths, pairs and triples that fill
their gap exactly, as many times as the counts allow; what remains is packed by
best fit, longest first, again by counts. The plan has one line for each pattern
and length in it, and each piece finds its place from its rank among the pieces of
its length. Ranks come from the table of pieces as written: a rank within the
written part plus the counts of the parts before, so no group of equal lengths
meets in one task.

Null texts count as empty; a document has its end token at least. Very long texts are cut into pieces of
``capacity`` tokens, none is dropped. Pieces of equal length tie: any of them may take a place, and each has one
place. Rows with equal ids are packed apart. An empty table gives one. Other columns are not carried.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from readweave.llm import flat, wordpieces
from readweave.session import written


@dataclass
class Plan:
    """Patterns with how often they are used. ``place`` needs ``finish`` first."""

    capacity: int
    patterns: list[tuple[dict[int, int], int]] = field(default_factory=list)

    def finish(self) -> Plan:
        """Lines (length, first rank, copies in a sequence, first sequence, offset), sorted."""
        used: dict[int, int] = defaultdict(int)
        lines, sequence = [], 0
        for pattern, times in self.patterns:
            offset = 0
            for length in sorted(pattern, reverse=True):
                lines.append((length, used[length], pattern[length], sequence, offset))
                used[length] += pattern[length] * times
                offset += pattern[length] * length
            sequence += times
        self.sequences = sequence
        table = np.array(sorted(lines), np.int64).reshape(-1, 5)
        self.key = table[:, 0] * (1 << 48) + table[:, 1]
        self.table = table
        return self

    def place(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sequence and offset of pieces given by length and rank."""
        line = self.table[np.searchsorted(self.key, length * (1 << 48) + rank, "right") - 1]
        k = rank - line[:, 1]
        return line[:, 3] + k // line[:, 2], line[:, 4] + line[:, 0] * (k % line[:, 2])


def exact_complements(count: np.ndarray, capacity: int) -> list[tuple[dict[int, int], int]]:
    """Patterns of up to four lengths that fill a sequence exactly; takes them out of ``count``.

    The index of single lengths is a bit for each length that is there; shifted against
    its mirror image it gives all pairs of one sum at once, and one more length over
    that all triples.
    """
    there = sum(1 << int(x) for x in np.flatnonzero(count))
    mirror = sum(1 << (capacity - int(x)) for x in np.flatnonzero(count))
    out = []

    def pairs(total: int) -> int:
        return there & (mirror >> (capacity - total)) if total > 1 else 0

    def enough(parts: list[int]) -> int:
        need: dict[int, int] = defaultdict(int)
        for p in parts:
            need[p] += 1
        return min(int(count[p]) // n for p, n in need.items())

    def pair(first: list[int], gap: int) -> list[int] | None:
        bits = pairs(gap) >> ((gap + 1) // 2)  # the larger of the two
        low = (gap + 1) // 2
        while bits:
            step = (bits & -bits).bit_length() - 1
            a = low + step
            if enough([*first, a, gap - a]):
                return [*first, a, gap - a]
            bits, low = bits >> (step + 1), a + 1
        return None

    def fill(length: int) -> list[int] | None:
        gap = capacity - length
        if not gap:
            return [length]
        if there >> gap & 1 and enough([length, gap]):
            return [length, gap]
        if found := pair([length], gap):
            return found
        for a in range(min(gap - 2, length), 0, -1):
            if 3 * a < gap:  # the largest of the three
                break
            if there >> a & 1 and pairs(gap - a) and (found := pair([length, a], gap - a)):
                return found
        return None

    for length in range(capacity, 0, -1):
        while count[length] and (parts := fill(length)):
            times = enough(parts)
            pattern: dict[int, int] = defaultdict(int)
            for p in parts:
                pattern[p] += 1
            for p, n in pattern.items():
                count[p] -= n * times
                if not count[p]:
                    there &= ~(1 << p)
                    mirror &= ~(1 << (capacity - p))
            out.append((dict(pattern), times))
    return out


def best_fit(count: np.ndarray, capacity: int) -> list[tuple[dict[int, int], int]]:
    """Best fit, longest first, of all that ``count`` has; equal sequences are kept as one with a number."""
    open_: dict[int, list[tuple[dict[int, int], int]]] = defaultdict(list)
    gaps = 0  # a bit for each gap that some sequence has
    for length in range(capacity, 0, -1):
        left = int(count[length])
        while left:
            fits = gaps >> length
            if not fits:
                break
            gap = length + (fits & -fits).bit_length() - 1
            pattern, times = open_[gap].pop()
            if not open_[gap]:
                gaps &= ~(1 << gap)
            each = min(gap // length, left)  # the gap that stays is the smallest still, so the next one goes there too
            full = min(times, left // each)
            for p, n, g in ((pattern | {length: pattern.get(length, 0) + each}, full, gap - each * length), (pattern, times - full, gap)):
                if n:
                    open_[g].append((p, n))
                    gaps |= 1 << g
            left -= each * full
        each = capacity // length
        for n, times in ((each, left // each), (left % each, 1)):
            if n and times:
                open_[capacity - n * length].append(({length: n}, times))
                gaps |= 1 << (capacity - n * length)
    return [x for same in open_.values() for x in same]


def plan(count: np.ndarray, capacity: int) -> Plan:
    """A plan for count[length] pieces of each length from 1 to ``capacity``."""
    count = count.astype(np.int64).copy()
    return Plan(capacity, exact_complements(count, capacity) + best_fit(count, capacity)).finish()


def pieces(df: DataFrame, vocabulary: str, end_id: int, capacity: int, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``key``, piece, start, length, ids_crc32, and part and rank: where it is written and its rank there among equal lengths."""
    source = wordpieces.source_of(df.sparkSession, vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part = wordpieces.loaded(source.value), TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, np.int64)
        for batch in batches:
            for lo, hi, buf, at in flat.windows(batch.column(1)):
                ids, counts = encoder.encode_ended(buf, at, end_id)
                n = -(-counts // capacity)
                row = np.repeat(np.arange(hi - lo), n)
                piece = flat.ranges(np.zeros(len(n), np.int64), n)
                start = piece * capacity
                length = np.minimum(capacity, counts[row] - start)
                begin = (np.cumsum(counts) - counts)[row] + start
                data = memoryview(np.ascontiguousarray(ids).view(np.uint8))
                crc = [zlib.crc32(data[4 * a : 4 * b]) for a, b in zip(begin.tolist(), (begin + length).tolist(), strict=True)]
                order = np.argsort(length, kind="stable")
                run_length, run_start = np.unique(length[order], return_index=True)
                run_count = np.diff(np.r_[run_start, len(order)])
                rank = np.empty(len(order), np.int64)
                rank[order] = np.arange(len(order)) - np.repeat(run_start, run_count) + np.repeat(seen[run_length], run_count)
                seen[run_length] += run_count
                keys = batch.column(0).slice(lo, hi - lo).take(pa.array(row))
                yield pa.RecordBatch.from_arrays(
                    [
                        keys,
                        pa.array(piece.astype(np.int32)),
                        pa.array(start),
                        pa.array(length),
                        pa.array(crc, pa.int64()),
                        pa.array(np.full(len(row), part, np.int32)),
                        pa.array(rank)
                    ],
                    ["key", "piece", "start", "length", "ids_crc32", "part", "rank"]
                )

    kind = dict(df.dtypes)[key]
    out = df.selectExpr(f"`{key}` as key", f"`{text}` as text").mapInArrow(
        run,
        f"key {kind}, piece int, start long, length long, ids_crc32 long, part int, rank long"
    )
    return out.withColumnRenamed("key", key)


def pack(df: DataFrame, vocabulary: str, end_id: int = 1, capacity: int = 4096, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``key``, piece, start, length, ids_crc32, sequence_id, offset of each piece. Writes the pieces (without ids) first."""
    table = written(pieces(df, vocabulary, end_id, capacity, text, key), "pieces")
    by_part = written(table.groupBy("part", "length").agg(F.count("*").alias("n")), "lengths")
    count = np.zeros(capacity + 1, np.int64)
    for length, n in by_part.groupBy("length").agg(F.sum("n")).collect():  # at most ``capacity`` rows
        count[length] = n
    made = table.sparkSession.sparkContext.broadcast(plan(count, capacity))
    before = by_part.select("part", "length", (F.sum("n").over(Window.partitionBy("length").orderBy("part")) - F.col("n")).alias("before"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch.column(c).to_numpy() for c in ("length", "rank"))
            sequence, offset = made.value.place(length, rank)
            keep = [batch.column(c) for c in ("key", "piece", "start", "length", "ids_crc32")]
            yield pa.RecordBatch.from_arrays(
                [*keep, pa.array(sequence), pa.array(offset)],
                ["key", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
            )

    ranked = table.join(before, ["part", "length"]).select(
        F.col(key).alias("key"),
        "piece",
        "start",
        "length",
        "ids_crc32",
        (F.col("rank") + F.col("before")).alias("rank")
    )
    kind = dict(df.dtypes)[key]
    return ranked.mapInArrow(
        run,
        f"key {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    ).withColumnRenamed("key", key)
