"""Byte-level BPE encoding and decoding in batched numpy merge rounds.

The symbols of many pieces lie in one flat array. A round finds each neighbouring
pair by binary search over the sorted pair keys of the vocabulary, takes the lowest
rank of each piece, merges all its occurrences from the left, and drops the pieces
that have no pair left. Pieces of more than ``LONG_WORD`` bytes would need very many rounds over all their symbols:
their pairs wait in a queue by rank, a round merges all places of the lowest rank in all of them, and only
pairs beside a merge are looked up again. Results equal those of the tokenizers library for the same
file with ``add_special_tokens=False``; special tokens in a text become their ids.

Nulls count as empty texts, which have no ids. Very long texts are encoded whole, also where they are one long word; an empty
table gives one. Rows are judged alone, so ties, repeated
rows, other columns and their names don't matter; other columns are not carried.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame

from readweave.llm import flat

#: Fixed value: the splitting pattern of this vocabulary, white space spelt out.
SPACES = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
SPLIT = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACES}\p{{L}}\p{{N}}]+|[{SPACES}]+(?![^{SPACES}])|[{SPACES}]+")
NONE = np.int64(1 << 40)
#: Bytes of a word from which on its pairs wait in a queue.
LONG_WORD = 400


def byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in vocabulary files."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class Bpe:
    """A byte-level vocabulary as sorted arrays. ``source``: the text of its JSON file."""

    def __init__(self, source: str):
        data = json.loads(source)
        letters, vocab = byte_letters(), data["model"]["vocab"]
        special = {t["content"]: t["id"] for t in data.get("added_tokens", [])}
        self.size = max([*vocab.values(), *special.values()]) + 1
        self.first = np.zeros(256, np.int64)
        for c, b in letters.items():
            self.first[b] = vocab[c]
        keys, merged = [], []
        for pair in data["model"]["merges"]:
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            keys.append(vocab[a] * self.size + vocab[b])
            merged.append(vocab[a + b])
        key = np.array(keys, np.int64)
        order = np.argsort(key, kind="stable")
        self.key, self.rank, self.merged = key[order], order.astype(np.int64), np.array(merged, np.int64)
        self.special = {s.encode(): i for s, i in special.items()}
        spelled = {i: bytes(letters[c] for c in t) for t, i in vocab.items()} | {i: s for s, i in self.special.items()}
        parts = [spelled.get(i, b"") for i in range(self.size)]
        self.token_length = np.array([len(p) for p in parts], np.int64)
        self.token_start = np.cumsum(self.token_length) - self.token_length
        self.token_bytes = np.frombuffer(b"".join(parts), np.uint8)
        self.table = flat.PieceTable(self.encode_pieces)

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of pairs of symbols; NONE where the vocabulary doesn't merge them."""
        pair = left * self.size + right
        at = np.minimum(np.searchsorted(self.key, pair), len(self.key) - 1)
        return np.where(self.key[at] == pair, self.rank[at], NONE)

    def merge(self, symbols: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Symbols and their words after all merges, in order. ``word`` is ascending."""
        long = (np.bincount(word) > LONG_WORD)[word] if len(word) else np.zeros(0, bool)
        if not long.any():
            return self._merge_short(symbols, word)
        parts = [self._merge_long(symbols[long], word[long]), self._merge_short(symbols[~long], word[~long])]
        symbols, word = (np.concatenate(p) for p in zip(*parts, strict=True))
        order = np.argsort(word, kind="stable")
        return symbols[order], word[order]

    def _merge_long(self, symbols: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The same for long words: rank by rank over all of them. A merge gives rise to pairs of later ranks alone, so each word meets its ranks in order."""
        n = len(symbols)
        symbols, place = symbols.copy(), np.arange(n)
        ends = np.r_[word[1:] != word[:-1], True]
        after, before = np.where(ends, n, place + 1), np.where(np.r_[True, ends[:-1]], -1, place - 1)
        rank = np.full(n, NONE)
        inner = np.flatnonzero(~ends)
        rank[inner] = self.ranks(symbols[inner], symbols[inner + 1])
        live, waiting = np.ones(n, bool), {}

        def wait(places: np.ndarray) -> list[int]:
            """Put places into the queue; returns ranks that are new there."""
            if not len(places):
                return []
            own = rank[places]
            order = np.argsort(own, kind="stable")
            places, own, fresh = places[order], own[order], []
            edge = np.flatnonzero(np.r_[True, own[1:] != own[:-1], True])
            for r, lo, hi in zip(own[edge[:-1]].tolist(), edge[:-1].tolist(), edge[1:].tolist(), strict=True):
                if r not in waiting:
                    waiting[r] = []
                    fresh.append(r)
                waiting[r].append(places[lo:hi])
            return fresh

        heap = wait(inner[rank[inner] < NONE])
        heapq.heapify(heap)
        while heap:
            r = heapq.heappop(heap)
            some = waiting.pop(r)
            some = some[0] if len(some) == 1 else np.unique(np.concatenate(some))
            some = some[rank[some] == r]
            if not len(some):
                continue
            begins = np.r_[True, after[some[:-1]] != some[1:]]  # of a run of takes every second one
            turn = np.arange(len(some))
            some = some[(turn - np.maximum.accumulate(np.where(begins, turn, 0))) % 2 == 0]
            gone = after[some]
            symbols[some], live[gone], rank[gone] = self.merged[r], False, NONE
            after[some] = beyond = after[gone]
            before[beyond[beyond < n]] = some[beyond < n]
            left = before[some]
            beside = np.unique(np.concatenate([some, left[left >= 0]]))
            right = after[beside]
            rank[beside] = np.where(right < n, self.ranks(symbols[beside], symbols[np.minimum(right, n - 1)]), NONE)
            for fresh in wait(beside[rank[beside] < NONE]):
                heapq.heappush(heap, fresh)
        return symbols[live], word[live]

    def _merge_short(self, symbols: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        done: list[tuple[np.ndarray, np.ndarray]] = []
        while len(symbols):
            head = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            rank = np.full(len(symbols), NONE)  # of the pair that starts here
            same = np.flatnonzero(word[1:] == word[:-1])
            rank[same] = self.ranks(symbols[same], symbols[same + 1])
            lowest = np.repeat(np.minimum.reduceat(rank, head), np.diff(np.r_[head, len(symbols)]))
            over = lowest == NONE
            if over.any():
                done.append((symbols[over], word[over]))
                live = ~over
                symbols, word, rank, lowest = symbols[live], word[live], rank[live], lowest[live]
                if not len(symbols):
                    break
            take = rank == lowest
            # of a run of takes (the same symbol again and again) every second one
            run = np.flatnonzero(take)
            begins = np.r_[True, np.diff(run) > 1]
            since = run - np.maximum.accumulate(np.where(begins, run, 0))
            run = run[since % 2 == 0]
            symbols = symbols.copy()
            symbols[run] = self.merged[rank[run]]
            keep = np.ones(len(symbols), bool)
            keep[run + 1] = False
            symbols, word = symbols[keep], word[keep]
        if not done:
            return symbols, word
        symbols, word = np.concatenate([d[0] for d in done]), np.concatenate([d[1] for d in done])
        order = np.argsort(word, kind="stable")
        return symbols[order], word[order]

    def encode_pieces(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        words: list[bytes] = []
        owner: list[int] = []
        fixed: list[tuple[int, int]] = []
        for k, piece in enumerate(pieces):
            if piece in self.special:
                fixed.append((k, self.special[piece]))
                continue
            for w in SPLIT.findall(piece.decode("utf-8", "surrogateescape")):
                words.append(w.encode("utf-8", "surrogateescape"))
                owner.append(k)
        length = np.fromiter(map(len, words), np.int64, len(words))
        ids, word = self.merge(self.first[np.frombuffer(b"".join(words), np.uint8)], np.repeat(np.arange(len(words)), length))
        piece = np.array(owner, np.int64)[word] if len(words) else np.zeros(0, np.int64)
        if fixed:
            piece, ids = np.r_[piece, [k for k, _ in fixed]], np.r_[ids, [i for _, i in fixed]]
            order = np.argsort(piece, kind="stable")
            piece, ids = piece[order], ids[order]
        return ids.astype(np.uint32), np.bincount(piece, minlength=len(pieces)).astype(np.int64)

    def encode(self, buf: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids of the texts of a window, and each text's number of ids."""
        start, end, row = flat.token_spans(buf, at, list(self.special), keep_space=True)
        ids, length = self.table.lookup(buf, start, end)
        return ids, flat.row_sums(length, row, len(at) - 1)

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Flat bytes of the texts, and each text's number of bytes. Ids that the vocabulary doesn't have spell nothing."""
        ids = ids.astype(np.int64)
        known = (ids >= 0) & (ids < self.size)
        ids = np.where(known, ids, 0)
        length = np.where(known, self.token_length[ids], 0)
        row = np.repeat(np.arange(len(counts)), counts)
        return self.token_bytes[flat.ranges(self.token_start[ids], length)], flat.row_sums(length, row, len(counts))


def loaded(source: str) -> Bpe:
    """One vocabulary with its table of pieces for each worker process."""
    return flat.resident(("Bpe", source), lambda: Bpe(source))  # type: ignore[return-value]


def texts_of(data: np.ndarray, counts: np.ndarray) -> pa.Array:
    """A string column of UTF-8 bytes; malformed bytes become U+FFFD."""
    column = flat.binary_rows(data, counts)
    try:
        column.cast(pa.string()).validate(full=True)
        return column.cast(pa.string())
    except pa.ArrowInvalid:
        return pa.array([x.decode("utf-8", "replace") for x in column.to_pylist()], pa.string())


def roundtrip(df: DataFrame, vocabulary: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Encode each text, then decode its ids.

    Returns ``key``, n_tokens, ids (binary: little-endian unsigned 32-bit ids) and
    decoded (string). ``vocabulary``: path of the vocabulary file, read on the driver.
    """
    spark = df.sparkSession
    source = spark.sparkContext.broadcast(Path(vocabulary).read_text("utf-8"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(source.value)
        for batch in batches:
            for lo, hi, buf, at in flat.windows(batch.column(1)):
                ids, counts = bpe.encode(buf, at)
                data, lengths = bpe.decode(ids, counts)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo), pa.array(counts), flat.binary_rows(ids, counts), texts_of(data, lengths)],
                    ["key", "n_tokens", "ids", "decoded"]
                )

    kind = dict(df.dtypes)[key]
    return df.selectExpr(f"`{key}` as key", f"`{text}` as text").mapInArrow(
        run,
        f"key {kind}, n_tokens long, ids binary, decoded string"
    ).withColumnRenamed("key", key)


def encode(df: DataFrame, vocabulary: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``key``, n_tokens and ids (array of int) of each text."""
    spark = df.sparkSession
    source = spark.sparkContext.broadcast(Path(vocabulary).read_text("utf-8"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(source.value)
        for batch in batches:
            for lo, hi, buf, at in flat.windows(batch.column(1)):
                ids, counts = bpe.encode(buf, at)
                offsets = np.zeros(len(counts) + 1, np.int32)
                np.cumsum(counts, out=offsets[1:])
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(lo, hi - lo),
                        pa.array(counts),
                        pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids.astype(np.int32)))
                    ],
                    ["key", "n_tokens", "ids"]
                )

    kind = dict(df.dtypes)[key]
    return df.selectExpr(f"`{key}` as key", f"`{text}` as text").mapInArrow(
        run,
        f"key {kind}, n_tokens long, ids array<int>"
    ).withColumnRenamed("key", key)


def decode(df: DataFrame, vocabulary: str, ids: str = "ids", key: str = "doc_id") -> DataFrame:
    """``key`` and text of each array of ids; a null array is an empty text."""
    spark = df.sparkSession
    source = spark.sparkContext.broadcast(Path(vocabulary).read_text("utf-8"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(source.value)
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                column = part.column(1)
                counts = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
                values = pc.list_flatten(column).to_numpy(zero_copy_only=False).astype(np.int64)
                yield pa.RecordBatch.from_arrays([part.column(0), texts_of(*bpe.decode(values, counts))], ["key", "text"])

    kind = dict(df.dtypes)[key]
    return df.selectExpr(f"`{key}` as key", f"`{ids}` as ids").mapInArrow(run, f"key {kind}, text string").withColumnRenamed("key", key)
