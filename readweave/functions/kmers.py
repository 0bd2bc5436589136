"""Canonical k-mers as whole numbers, made in numpy over Arrow batches.

A window of A, C, G and T is the number that its bases spell to the base of 4, first base
highest, so numbers order as strings do and k-mers of one length never collide (21
bases are 42 bits). A window with any other symbol is a negative number: a hash of 62
bits of the canonical string.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from readweave.functions import batches
from readweave.functions.sequence import CODES, COMPLEMENTS
from readweave.functions.sequence import batched as batched_reads
from readweave.session import written

#: Bases of reads that are worked on at once.
SLICE = 1 << 19
BITS = np.uint64((1 << 62) - 1)
#: Factors of ``fingerprint``; odd, and below 2**62.
FACTORS = (0x1F8AB3C96E25D4B7, 0x2D51CE903F7A6B85)

#: Buckets of a tally, one of which is in a task at a time; postings that a task tallies at once.
BUCKETS, TALLIED = 1 << 12, 1 << 22

_NUMBER = np.full(256, 4, np.uint8)
_NUMBER[list(b"ACGT")] = range(4)
_FOURS = np.frombuffer(b"".join(bytes(b"ACGT"[i >> j & 3] for j in (6, 4, 2, 0)) for i in range(256)), np.uint32)
_OTHER_STRAND = np.arange(256, dtype=np.uint8)
_OTHER_STRAND[list(CODES.encode())] = list(COMPLEMENTS.encode())


def _hashed(strings: np.ndarray) -> np.ndarray:
    """Negative numbers for windows (rows of bytes), equal on both strands."""
    words = lambda x: np.pad(x, ((0, 0), (0, 24 - x.shape[1]))).view(">u8").astype(np.uint64)
    one, two = words(strings), words(np.ascontiguousarray(_OTHER_STRAND[strings][:, ::-1]))
    less = np.zeros(len(one), bool)
    for k in (2, 1, 0):
        less = (one[:, k] < two[:, k]) | ((one[:, k] == two[:, k]) & less)
    least = np.where(less[:, None], one, two)
    h = np.zeros(len(one), np.uint64)
    for k in range(3):
        h = mixed((h ^ least[:, k]) & BITS) ^ (least[:, k] >> np.uint64(62))
    return -1 - (h & BITS).astype(np.int64)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 62-bit numbers that any engine with 128-bit products can do too."""
    x = ((x ^ (x >> np.uint64(29))) * np.uint64(FACTORS[0])) & BITS
    x = ((x ^ (x >> np.uint64(32))) * np.uint64(FACTORS[1])) & BITS
    return x ^ (x >> np.uint64(29))


def fingerprint(kmer: np.ndarray) -> np.ndarray:
    """K-mers as numbers of 31 bits, which hash functions take."""
    return mixed(kmer.view(np.uint64) & BITS) >> np.uint64(31)


def distinct(values: np.ndarray) -> np.ndarray:
    """Distinct values, sorted."""
    values = np.sort(values)
    return values[np.r_[True, values[1:] != values[:-1]]] if len(values) else values


def packed(buf: np.ndarray, at: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Canonical k-mers of all windows in order, and each one's row."""
    count = np.maximum(np.diff(at) - (k - 1), 0)
    m = len(buf) - k + 1
    if m <= 0 or not count.any():
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    number = _NUMBER[buf]
    base = (number & 3).astype(np.int64)
    one, two, w = base, 3 - base, 1
    for bit in bin(k)[3:]:  # windows of twice the length, then of one base more where k has it
        one, two, w = (one[:-w] << 2 * w) | one[w:], two[:-w] | (two[w:] << 2 * w), 2 * w
        if bit == "1":
            one, two, w = (one[:-1] << 2) | base[w:], two[:-1] | ((3 - base[w:]) << 2 * w), w + 1
    start, row = batches.ranges(at[:-1], count), np.repeat(np.arange(len(count)), count)
    out = np.minimum(one, two)[start]
    if (number > 3).any():
        run = np.r_[0, np.cumsum(number > 3)]
        other = np.flatnonzero(run[start + k] > run[start])
        for lo in range(0, len(other), 1 << 16):
            some = other[lo : lo + (1 << 16)]
            out[some] = _hashed(buf[start[some, None] + np.arange(k)])
    return out, row


def slices(column: pa.Array, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, k-mers, rows) of a column of sequences, about SLICE windows at once; a long sequence comes in several slices."""
    for lo, _, buf, at in batches.windows(column, SLICE):
        if len(at) > 2 or len(buf) <= 2 * SLICE:
            yield lo, *packed(buf, at, k)
            continue
        for a in range(0, len(buf) - k + 1, SLICE):
            yield lo, *packed(buf[a : a + SLICE + k - 1], np.array([0, min(SLICE + k - 1, len(buf) - a)]), k)


def postings(reads: DataFrame, k: int, rid: str = "rid", seq: str = "seq") -> DataFrame:
    """(kmer, rid) for every window of every read, repeats included. ``made`` has the reads and what is run on their batches."""

    def run(got: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in got:
            names = batch.column(0).to_numpy()
            for lo, kmer, row in slices(batch.column(1), k):
                yield pa.RecordBatch.from_arrays([pa.array(kmer), pa.array(names[lo + row])], ["kmer", "rid"])

    source = reads.select(F.col(rid).cast("long").alias("rid"), F.col(seq).alias("seq")).where("rid is not null")
    rows = source.mapInArrow(run, "kmer long, rid long")
    rows.made = source, run
    return rows


def _once(column: pa.Array, k: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(rows, k-mers, how often) of a column of sequences: each k-mer of a row once, also where a long sequence comes in several slices."""

    def merged(row: np.ndarray, kmer: np.ndarray, n: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if len(kmer) and n is None and kmer.min() >= 0:  # at most 42 bits and the row of a window
            both = np.sort((row << 42) | kmer)
            start = np.flatnonzero(np.r_[True, both[1:] != both[:-1]])
            return both[start] >> 42, both[start] & ((1 << 42) - 1), np.diff(np.r_[start, len(both)])
        order = np.lexsort((kmer, row))
        row, kmer = row[order], kmer[order]
        start = np.flatnonzero(np.r_[True, (kmer[1:] != kmer[:-1]) | (row[1:] != row[:-1])]) if len(kmer) else np.zeros(0, np.int64)
        if n is None:
            return row[start], kmer[start], np.diff(np.r_[start, len(kmer)])
        return row[start], kmer[start], np.add.reduceat(n[order], start) if len(start) else n

    last, held = -1, None
    for lo, kmer, row in slices(column, k):
        found = merged(row, kmer)
        if last == lo and held is not None:  # the read goes on
            held = merged(*(np.concatenate(x) for x in zip(held, found)))
            continue
        if held is not None:
            yield held[0] + last, *held[1:]
        last, held = lo, found
    if held is not None:
        yield held[0] + last, *held[1:]


def sets(reads: DataFrame, k: int) -> tuple[DataFrame, Callable[[Iterator[pa.RecordBatch]], Iterator[tuple[np.ndarray, np.ndarray, None]]]]:
    """A source of Arrow batches of ``reads`` and what makes (rids, k-mers, None) of them: each k-mer of a row once."""
    source, batched = batched_reads(reads)

    def run(got: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, None]]:
        for rids, seqs in batched(got):
            names = rids.to_numpy()
            for row, kmer, _ in _once(seqs, k):
                yield names[row], kmer, None

    return source, run


def _apart(reads: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """(rid, seq) of reads whose id has one row, and of the others (None if there are none)."""
    own = reads.select(F.col("rid").cast("long").alias("rid"), "seq").where("rid is not null")
    repeated = written(own.groupBy("rid").agg(F.count("*").alias("n")).where("n > 1").select("rid"), "repeated")
    if repeated.isEmpty():
        return own, None
    return own.join(repeated, "rid", "left_anti").select("rid", "seq"), own.join(repeated, "rid", "left_semi").select("rid", "seq")


def occurrences(reads: DataFrame, k: int) -> DataFrame:
    """(kmer, rid): each k-mer, spelled, of each read once. K-mers of a read are made distinct where it lies; only reads that share an id are shuffled."""
    one, others = _apart(reads)

    def run(got: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in got:
            names = batch.column(0).to_numpy()
            for row, kmer, _ in _once(batch.column(1), k):
                for lo in range(0, len(kmer), 1 << 17):
                    yield pa.RecordBatch.from_arrays([letters(kmer[lo : lo + (1 << 17)], k), pa.array(names[row[lo : lo + (1 << 17)]])], ["kmer", "rid"])

    found = one.mapInArrow(run, "kmer string, rid long")
    return found if others is None else found.union(postings(others, k).distinct().select(spelled(F.col("kmer"), k), "rid"))


def planes(values: np.ndarray) -> bytes:
    """Whole numbers as bytes: low bytes of all, then the next ones, as many as the largest number has."""
    width = max(1, (int(values.max()).bit_length() + 7) // 8)
    return np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes()


def numbers(blob: bytes, count: int) -> np.ndarray:
    planes = np.frombuffer(blob, np.uint8).reshape(-1, count)
    out = np.zeros((count, 8), np.uint8)
    out[:, : len(planes)] = planes.T
    return out.view("<u8").ravel()


def _summed(kmer: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    order = np.argsort(kmer, kind="stable")
    kmer = kmer[order]
    start = np.flatnonzero(np.r_[True, kmer[1:] != kmer[:-1]])
    return kmer[start], *(np.add.reduceat(v[order], start) for v in values)


_TALLY = "bucket int, size int, first long, gaps binary, n binary, reads binary"


def _tally(kmer: np.ndarray, n: np.ndarray, reads: np.ndarray) -> pa.RecordBatch:
    """One row for each bucket with its k-mers, as gaps, and their counts."""
    kmer, n, reads = _summed(kmer, n, reads)
    bucket = (mixed(kmer.view(np.uint64) & BITS) % np.uint64(BUCKETS)).astype(np.int16)
    order = np.argsort(bucket, kind="stable")
    bucket, kmer, n, reads = bucket[order], kmer[order], n[order], reads[order]
    edge = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1], True])
    gap = np.diff(kmer, prepend=kmer[:1]).view(np.uint64)
    gap[edge[:-1]] = 0
    part = lambda x: pa.array([planes(x[a:b]) for a, b in zip(edge[:-1], edge[1:])], pa.binary())
    start = edge[:-1]
    return pa.RecordBatch.from_arrays(
        [pa.array(bucket[start].astype(np.int32)), pa.array(np.diff(edge).astype(np.int32)), pa.array(kmer[start]), part(gap), part(n), part(reads)],
        ["bucket", "size", "first", "gaps", "n", "reads"],
    )


def tallied(reads: DataFrame, k: int, spell: bool = False) -> DataFrame:
    """(kmer, n, n_reads) of all k-mers: windows and different reads; ``spell``: as strings.

    Tasks tally TALLIED postings at once and send each k-mer of those once, as gaps between the sorted k-mers of a
    bucket: some 3 bytes instead of a row. A bucket holds a BUCKETS-th of all k-mers and is added up in one place, bucket after bucket.
    """
    one, others = _apart(reads)

    def send(got: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0
        for batch in got:
            for _, kmer, n in _once(batch.column(1), k):
                held.append((kmer, n))
                size += len(kmer)
                if size > TALLIED:
                    kmer, n = (np.concatenate(x) for x in zip(*held))
                    held, size = [], 0
                    yield _tally(kmer, n, np.ones(len(kmer), np.int64))
        if size:
            kmer, n = (np.concatenate(x) for x in zip(*held))
            yield _tally(kmer, n, np.ones(len(kmer), np.int64))

    def counted(got: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in got:
            if batch.num_rows:
                n = batch.column(1).to_numpy()
                yield _tally(batch.column(0).to_numpy(), n, np.ones(len(n), np.int64))

    def add(got: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_bucket, held, size, least = None, [], 0, TALLIED

        def out() -> Iterator[pa.RecordBatch]:
            kmer, n, own = _summed(*(np.concatenate(x) for x in zip(*held)))
            for lo in range(0, len(kmer), 1 << 17):
                some = kmer[lo : lo + (1 << 17)]
                yield pa.RecordBatch.from_arrays(
                    [letters(some, k) if spell else pa.array(some), pa.array(n[lo : lo + (1 << 17)]), pa.array(own[lo : lo + (1 << 17)])],
                    ["kmer", "n", "n_reads"],
                )

        for batch in got:
            sizes, firsts = batch.column(1).to_pylist(), batch.column(2).to_pylist()
            for i, bucket in enumerate(batch.column(0).to_pylist()):
                if held and bucket != open_bucket:
                    yield from out()
                    held, size, least = [], 0, TALLIED
                open_bucket = bucket
                gaps, n, own = (numbers(batch.column(c)[i].as_buffer(), sizes[i]) for c in (3, 4, 5))
                held.append((np.cumsum(gaps).view(np.int64) + firsts[i], n.view(np.int64), own.view(np.int64)))
                size += sizes[i]
                if size > least:  # what repeats needs no room
                    held = [_summed(*(np.concatenate(x) for x in zip(*held)))]
                    size = len(held[0][0])
                    least = size + TALLIED
        if held:
            yield from out()

    blobs = one.mapInArrow(send, _TALLY)
    if others is not None:
        each = postings(others, k).groupBy("kmer", "rid").agg(F.count("*").alias("n")).select("kmer", "n")
        blobs = blobs.union(each.mapInArrow(counted, _TALLY))
    schema = f"kmer {'string' if spell else 'long'}, n long, n_reads long"
    return blobs.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(add, schema)


def letters(kmer: np.ndarray, k: int) -> pa.Array:
    """``spelled`` in numpy: four bases at a time."""
    parts = -(-k // 4)
    out = np.empty((len(kmer), parts), np.uint32)
    for i in range(parts):
        out[:, i] = _FOURS[(kmer >> (8 * (parts - 1 - i))) & 255]
    text = np.ascontiguousarray(out.view(np.uint8).reshape(len(kmer), -1)[:, 4 * parts - k :])
    offsets = np.arange(0, (len(kmer) + 1) * k, k, dtype=np.int32)
    made = pa.StringArray.from_buffers(len(kmer), pa.py_buffer(offsets), pa.py_buffer(text))
    return pc.if_else(pa.array(kmer >= 0), made, pa.scalar(None, pa.string())) if (kmer < 0).any() else made


def set_sizes(reads: DataFrame, k: int) -> DataFrame:
    """(rid, size): how many distinct k-mers each read has; nothing is shuffled. ``rid`` is unique."""

    def run(got: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in got:
            sizes = np.zeros(batch.num_rows, np.int64)
            held: list[np.ndarray] = []
            last = -1
            for lo, kmer, row in slices(batch.column(1), k):
                if last == lo:  # the read goes on
                    held = [distinct(np.concatenate([*held, kmer]))]
                    sizes[lo] = len(held[0])
                    continue
                order = np.lexsort((kmer, row))
                kmer, row = kmer[order], row[order]
                new = np.ones(len(kmer), bool)
                new[1:] = (kmer[1:] != kmer[:-1]) | (row[1:] != row[:-1])
                found = np.bincount(row[new])
                sizes[lo : lo + len(found)] += found
                held, last = [kmer], lo
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes)], ["rid", "size"])

    return reads.select(F.col("rid").cast("long").alias("rid"), "seq").mapInArrow(run, "rid long, size long").where("size > 0")


def spelled(kmer: Column, k: int) -> Column:
    """The string of a k-mer of A, C, G and T; null for others."""
    return F.when(kmer >= 0, F.translate(F.lpad(F.conv(kmer.cast("string"), 10, 4), k, "0"), "0123", "ACGT"))
