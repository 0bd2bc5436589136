"""Expressions on sequences: alphabet, k-mers, strands."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from readweave.functions import batches

#: Nucleotide codes and their complements (S, W and N are their own).
CODES = "ACGTRYKMBVDHSWN"
COMPLEMENTS = "TGCAYRMKVBHDSWN"

LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
AS_BASES = ("ACGT" * 7)[:26]
#: Each byte's base; none (0) for what is no ASCII letter.
_BASES = np.zeros(256, np.uint8)
_BASES[list((LETTERS + LETTERS.lower()).encode())] = list((AS_BASES * 2).encode())


def text_as_bases(text: Column) -> Column:
    """A text as a pseudo-read: its ASCII letters, each standing for one of four bases."""
    return F.translate(F.regexp_replace(F.coalesce(text, F.lit("")), "[^A-Za-z]", ""), LETTERS + LETTERS.lower(), AS_BASES * 2)


def texts_as_reads(texts: DataFrame, rid: str, text: str) -> DataFrame:
    """(rid, seq) of texts as pseudo-reads. ``texts`` has what they are made of, for passes in numpy (``batched``)."""
    reads = texts.select(F.col(rid).alias("rid"), text_as_bases(F.col(text)).alias("seq"))
    reads.texts = texts.select(F.col(rid).alias("rid"), F.col(text).alias("seq"))
    return reads


def bases(column: pa.Array) -> Iterator[tuple[int, int, pa.Array]]:
    """(first row, end row, sequences) of a column of texts: ``text_as_bases`` in numpy, a window of bounded size at a time."""
    for lo, hi, buf, at in batches.windows(column):
        made = _BASES[buf]
        kept = made != 0
        size, some = np.zeros(hi - lo, np.int32), np.flatnonzero(np.diff(at))
        if len(some):
            size[some] = np.add.reduceat(kept, at[some], dtype=np.int32)
        offsets = np.r_[0, np.cumsum(size)].astype(np.int32)
        yield lo, hi, pa.StringArray.from_buffers(hi - lo, pa.py_buffer(offsets), pa.py_buffer(made[kept]))


def batched(reads: DataFrame) -> tuple[DataFrame, Callable[[Iterator[pa.RecordBatch]], Iterator[tuple[pa.Array, pa.Array]]]]:
    """A source of Arrow batches for a pass over ``reads`` (rid, seq) without null rids, and what makes (ids, sequences) of them.

    Texts are made into sequences there: Spark's expression takes longer for that than k-mers do.
    """
    texts = vars(reads).get("texts")  # not a column of that name
    made = texts is not None

    def run(got: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, pa.Array]]:
        for batch in got:
            if not made:
                yield batch.column(0), batch.column(1)
                continue
            for lo, hi, seq in bases(batch.column(1)):
                yield batch.column(0).slice(lo, hi - lo), seq

    return (texts if made else reads).select(F.col("rid").cast("long").alias("rid"), "seq").where("rid is not null"), run


def reverse_complement(seq: Column) -> Column:
    return F.reverse(F.translate(seq, CODES, COMPLEMENTS))


def canonical(seq: Column) -> Column:
    """The smaller of the two strands."""
    return F.least(seq, reverse_complement(seq))


def _bound(value: Column, use) -> Column:
    """``use`` of a value that is computed once for each row, not once for each window."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _windows(seq: Column, k: int, cut) -> Column:
    """Array of ``cut(i)`` for the windows that start at i = 1, 2, ..."""
    n = F.length(seq)
    return F.when(n >= k, F.transform(F.sequence(F.lit(1), n - (k - 1)), cut)).otherwise(F.array().cast("array<string>"))


def kmers(seq: Column, k: int) -> Column:
    """All windows of length k, in order; none if the sequence is shorter. Sequences are ASCII, so windows are cut from bytes, each in constant time."""
    return _bound(seq.cast("binary"), lambda b: _windows(b, k, lambda i: F.substring(b, i, F.lit(k)).cast("string")))


def canonical_kmers(seq: Column, k: int) -> Column:
    """Canonical k-mers in order. The other strand is complemented once and cut, not window by window."""
    both = F.struct(seq.cast("binary").alias("s"), reverse_complement(seq).cast("binary").alias("r"))

    def cut(x: Column):
        return lambda i: F.least(
            F.substring(x["s"], i, F.lit(k)).cast("string"),
            F.substring(x["r"], F.length(x["r"]) - (k - 2) - i, F.lit(k)).cast("string")
        )

    return _bound(both, lambda x: _windows(x["s"], k, cut(x)))


def normalised(a: Column, b: Column) -> tuple[Column, Column]:
    """A pair with the smaller id first."""
    return F.least(a, b), F.greatest(a, b)
