"""Columns of text as one flat byte array: cutting, hashing and gathering without a Python loop over words.

Every operator here works on *windows*: consecutive rows of an Arrow batch whose
texts together hold about ``WINDOW`` bytes (a longer text is a window of its own,
whole). Memory therefore follows the window, not the batch or the partition.
Null texts count as empty.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import xxhash

from readweave.functions.batches import WINDOW, ranges, windows  # noqa: F401 (operators use them as flat.windows)

#: Classes of bytes. White space is 0x20 and 0x09-0x0D.
SPACE, LETTER, DIGIT, OTHER, QUOTE, WIDE, WIDE_SPACE = range(7)
BYTE_CLASS = np.full(256, OTHER, np.uint8)
BYTE_CLASS[[0x20, *range(0x09, 0x0E)]] = SPACE
BYTE_CLASS[[*range(65, 91), *range(97, 123)]] = LETTER
BYTE_CLASS[48:58] = DIGIT
BYTE_CLASS[39] = QUOTE
BYTE_CLASS[128:] = WIDE

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: White space beyond ASCII, as UTF-8.
WIDE_SPACES = re.compile(rb"\xc2[\x85\xa0]|\xe1\x9a\x80|\xe2\x80[\x80-\x8a\xa8\xa9\xaf]|\xe2\x81\x9f|\xe3\x80\x80")

#: Spans of this many bytes and more are hashed one by one.
LONG = 64


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser over uint64."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def eights(buf: np.ndarray) -> np.ndarray:
    """At each place the next eight bytes as one number, low byte first; beyond the end they are 0."""
    padded = np.zeros(len(buf) + 16, np.uint8)
    padded[: len(buf)] = buf
    return np.ndarray(len(buf) + 8, "<u8", padded, strides=(1,))


_MASKS = np.array([(1 << 8 * k) - 1 for k in range(8)] + [(1 << 64) - 1], np.uint64)


def hash_spans(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span's bytes, eight bytes a round; spans of ``LONG`` bytes and more by XXH3.

    Each round mixes the state with eight bytes by a bijection, so of equally long
    spans of eight bytes or fewer no two have the same hash, and longer ones meet by chance alone.
    """
    if not len(start):
        return np.zeros(0, np.uint64)
    words, length = eights(buf), end - start
    h = (length.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    h = mix(h ^ (words[start] & _MASKS[np.minimum(length, 8)]))
    more = np.flatnonzero((length > 8) & (length < LONG))
    at = 8
    while len(more):
        left = length[more] - at
        h[more] = mix(h[more] * np.uint64(0xA24BAED4963EE407) ^ (words[start[more] + at] & _MASKS[np.minimum(left, 8)]))
        at += 8
        more = more[left > 8]
    data = memoryview(np.ascontiguousarray(buf))
    for k in np.flatnonzero(length >= LONG).tolist():
        h[k] = xxhash.xxh3_64_intdigest(data[start[k] : end[k]], 0x9FB21C651E98DF25)
    return h


def equal_spans(buf: np.ndarray, start: np.ndarray, end: np.ndarray, other: np.ndarray, other_start: np.ndarray, other_end: np.ndarray) -> np.ndarray:
    """Whether each span of ``buf`` has the bytes of its span of ``other``."""
    length = end - start
    same = length == other_end - other_start
    x, y = eights(buf), eights(other)
    more, at = np.flatnonzero(same & (length > 0)), 0
    while len(more):
        left = length[more] - at
        mask = _MASKS[np.minimum(left, 8)]
        differ = (x[start[more] + at] ^ y[other_start[more] + at]) & mask != 0
        same[more[differ]] = False
        at += 8
        more = more[~differ & (left > 8)]
    return same


def word_spans(buf: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of each word (run without white space); rows end words."""
    inside = BYTE_CLASS[buf] != SPACE
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    heads = at[:-1][at[:-1] < at[1:]]
    first[heads] = inside[heads]
    tails = at[1:][at[:-1] < at[1:]] - 1
    last[tails] = inside[tails]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    return start, end, np.searchsorted(at, start, "right") - 1


def _bounds(keep_space: bool) -> np.ndarray:
    b = np.zeros((7, 7), bool)
    for x in (LETTER, DIGIT, OTHER):
        for y in (LETTER, DIGIT, OTHER):
            b[x, y] = x != y
    b[[LETTER, DIGIT, OTHER, QUOTE, WIDE], SPACE] = True
    if not keep_space:
        b[SPACE, :] = True
        b[:, SPACE] = True
        b[SPACE, SPACE] = False
    return b.ravel()


_BOUNDS = {k: _bounds(k) for k in (False, True)}


def token_spans(buf: np.ndarray, at: np.ndarray, specials: list[bytes], keep_space: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of pieces that a tokenizer's pre-tokenization never joins or looks across.

    A piece ends only where that is certain from ASCII alone: before white space, and
    between ASCII letters, digits and signs; next to quotes and wide characters it
    goes on. With ``keep_space`` a piece starts with the white space before it, else
    white space belongs to no piece. Special tokens are pieces of their own.
    """
    if not len(buf):
        z = np.zeros(0, np.int64)
        return z, z, z
    kind = BYTE_CLASS[buf]
    whole = buf.tobytes() if specials or keep_space else b""
    if keep_space:
        for m in WIDE_SPACES.finditer(whole):
            kind[m.start() : m.end()] = WIDE_SPACE
    cut = np.zeros(len(buf) + 1, bool)
    cut[1:-1] = _BOUNDS[keep_space][kind[:-1].astype(np.intp) * 7 + kind[1:]]
    for s in specials:
        i = whole.find(s)
        while i >= 0:
            cut[i + 1 : i + len(s)] = False
            cut[i] = cut[i + len(s)] = True
            i = whole.find(s, i + len(s))
    cut[at] = True
    edge = np.flatnonzero(cut)
    start, end = edge[:-1], edge[1:]
    if not keep_space:
        real = kind[start] != SPACE
        start, end = start[real], end[real]
    return start, end, np.searchsorted(at, start, "right") - 1


_resident: dict[object, object] = {}


def resident(key: object, make: Callable[[], object]) -> object:
    """What ``make`` gives, kept in the worker process until another key is asked for: a worker holds one operator's tables at a time."""
    if key not in _resident:
        release()
        _resident[key] = make()
    return _resident[key]


def release() -> None:
    """Drop the tables that an earlier task left in this worker process."""
    _resident.clear()
    pa.default_memory_pool().release_unused()


class Store:
    """A growing flat array."""

    def __init__(self, kind: type):
        self.data, self.used = np.zeros(1 << 16, kind), 0

    def add(self, values: np.ndarray) -> None:
        if self.used + len(values) > len(self.data):
            self.data = np.concatenate([self.data[: self.used], np.zeros(max(self.used, len(values)) + (1 << 16), self.data.dtype)])
        self.data[self.used : self.used + len(values)] = values
        self.used += len(values)


class PieceTable:
    """Ids of pieces seen so far, by hash, in sorted flat arrays, with the pieces' bytes.

    ``encode`` turns a list of byte pieces into (flat ids, lengths). A piece takes
    ids from the table only if its bytes are those of the piece there; others of the same
    hash are encoded by themselves. Beyond ``limit`` pieces or ``id_limit`` ids the
    table starts anew, so its memory is bounded.
    """

    def __init__(self, encode: Callable[[list[bytes]], tuple[np.ndarray, np.ndarray]], limit: int = 1_200_000, id_limit: int = 12_000_000):
        self.encode, self.limit, self.id_limit = encode, limit, id_limit
        self._clear()

    def _clear(self) -> None:
        self.key, self.start, self.length = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int32)
        self.at, self.size = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.ids, self.bytes = Store(np.uint32), Store(np.uint8)

    def lookup(self, buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids of all pieces in order, and each piece's number of ids."""
        if not len(start):
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        h = hash_spans(buf, start, end)
        unique, first, back = np.unique(h, return_index=True, return_inverse=True)
        if len(self.key) + len(unique) > self.limit or self.ids.used > self.id_limit:
            self._clear()
        at = np.searchsorted(self.key, unique)
        new = np.ones(len(unique), bool)
        if len(self.key):
            new = self.key[np.minimum(at, len(self.key) - 1)] != unique
        if new.any():
            self._learn(buf, start[first[new]], end[first[new]], unique[new], at[new])
            at = np.searchsorted(self.key, unique)
        row = at[back.ravel()]
        length = self.length[row].astype(np.int64)
        ids = self.ids.data[ranges(self.start[row], length)]
        other = ~equal_spans(buf, start, end, self.bytes.data[: self.bytes.used], self.at[row], self.at[row] + self.size[row])
        return self._apart(buf, start, end, ids, length, other) if other.any() else (ids, length)

    def _learn(self, buf: np.ndarray, start: np.ndarray, end: np.ndarray, keys: np.ndarray, where: np.ndarray) -> None:
        ids, length = self.encode([buf[s:e].tobytes() for s, e in zip(start.tolist(), end.tolist(), strict=True)])
        size = end - start
        self.key = np.insert(self.key, where, keys)
        self.start = np.insert(self.start, where, self.ids.used + np.cumsum(length) - length)
        self.length = np.insert(self.length, where, length)
        self.at = np.insert(self.at, where, self.bytes.used + np.cumsum(size) - size)
        self.size = np.insert(self.size, where, size)
        self.ids.add(ids)
        self.bytes.add(buf[ranges(start, size)])

    def _apart(
        self,
        buf: np.ndarray,
        start: np.ndarray,
        end: np.ndarray,
        ids: np.ndarray,
        length: np.ndarray,
        other: np.ndarray
    ) -> tuple[np.ndarray, np.ndarray]:
        """The same with the marked pieces encoded by themselves."""
        own, n = self.encode([buf[s:e].tobytes() for s, e in zip(start[other].tolist(), end[other].tolist(), strict=True)])
        begin = np.cumsum(length) - length
        begin[other] = len(ids) + np.cumsum(n) - n
        length = length.copy()
        length[other] = n
        return np.concatenate([ids, own.astype(ids.dtype)])[ranges(begin, length)], length


def row_sums(values: np.ndarray, row: np.ndarray, rows: int) -> np.ndarray:
    """Sum of values (whole numbers below 2**53) of each row."""
    return np.bincount(row, weights=values, minlength=rows).astype(np.int64)


def binary_rows(values: np.ndarray, counts: np.ndarray) -> pa.Array:
    """A binary column whose row i holds the next counts[i] values, little-endian."""
    width = values.dtype.itemsize
    offsets = np.zeros(len(counts) + 1, np.int64)
    np.cumsum(counts * width, out=offsets[1:])
    data = np.ascontiguousarray(values)
    if offsets[-1] >= 2**31 - 1:
        raise ValueError("a window's ids exceed 2 GB")
    return pa.Array.from_buffers(pa.binary(), len(counts), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(data)])
