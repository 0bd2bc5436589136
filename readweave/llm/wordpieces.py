"""Encoding by the tokenizers library, each distinct piece of text once.

Texts are cut where the vocabulary's rules look across nothing (see
``flat.token_spans``); the library encodes pieces that a worker hasn't met, and
a bounded table of flat arrays gives the ids of the rest. A vocabulary with other
rules than the ones checked here is left to the library text by text.
"""

from __future__ import annotations

import json
import os
from pathlib import Path

import numpy as np
from pyspark.sql import SparkSession
from tokenizers import Tokenizer

from readweave.llm import flat

#: The rules under which pieces may be encoded alone.
NORMALIZERS = ["NFC", "Replace", "Lowercase"]
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def lowered(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """ASCII letters in lower case, save in pieces with wide characters: NFC comes first, and some marks (U+030C after j) compose with small letters only."""
    low, wide = flat.LOWER[buf], buf >= 128
    if wide.any() and len(start):
        run = np.zeros(len(buf) + 1, np.int64)
        np.cumsum(wide, out=run[1:])
        mixed = run[end] > run[start]
        kept = flat.ranges(start[mixed], (end - start)[mixed])
        low[kept] = buf[kept]
    return low


class Encoder:
    """``source``: the text of a tokenizers JSON file."""

    def __init__(self, source: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a Spark task has one core
        self.tokenizer = Tokenizer.from_str(source)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        data = json.loads(source)
        self.specials = [t["content"].encode() for t in data.get("added_tokens", [])]
        normal = [n.get("type") for n in (data.get("normalizer") or {}).get("normalizers", [])]
        split = ((data.get("pre_tokenizer") or {}).get("pretokenizers") or [{}])[0]
        plain = all(not (t["lstrip"] or t["rstrip"] or t["single_word"]) for t in data.get("added_tokens", []))
        self.pieces = plain and normal == NORMALIZERS and split.get("pattern", {}).get("Regex") == PATTERN
        self.model = self.tokenizer.model
        self.table = flat.PieceTable(self.encode_pieces)

    def encode_pieces(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        found: list[list[int] | None] = [None] * len(pieces)
        rest: list[int] = []
        for k, piece in enumerate(pieces):
            if piece.isalpha():  # ASCII letters: one word, which only the merges can cut
                found[k] = [t.id for t in self.model.tokenize(piece.decode().lower())]
            else:
                rest.append(k)
        texts = [pieces[k].decode("utf-8", "replace") for k in rest]
        for k, e in zip(rest, self.tokenizer.encode_batch_fast(texts, add_special_tokens=False), strict=True):
            found[k] = e.ids
        length = np.fromiter(map(len, found), np.int64, len(found))
        return np.fromiter((i for ids in found for i in ids), np.uint32, int(length.sum())), length

    def encode(self, buf: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids of the texts of a window, and each text's number of ids."""
        if not self.pieces:
            whole = [buf[a:b].tobytes().decode("utf-8", "replace") for a, b in zip(at[:-1], at[1:], strict=True)]
            ids = [e.ids for e in self.tokenizer.encode_batch_fast(whole, add_special_tokens=False)]
            return np.array([i for x in ids for i in x], np.uint32), np.array([len(x) for x in ids], np.int64)
        start, end, row = flat.token_spans(buf, at, self.specials, keep_space=False)
        if b"<|" not in buf.tobytes():  # else lower case could make a special token
            buf = lowered(buf, start, end)
        ids, length = self.table.lookup(buf, start, end)
        return ids, flat.row_sums(length, row, len(at) - 1)

    def encode_ended(self, buf: np.ndarray, at: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """As ``encode``, with ``end_id`` after each text."""
        ids, counts = self.encode(buf, at)
        return np.insert(ids, np.cumsum(counts), np.uint32(end_id)), counts + 1


def loaded(source: str) -> Encoder:
    """One encoder with its table of pieces for each worker process."""
    return flat.resident(("Encoder", source), lambda: Encoder(source))  # type: ignore[return-value]


def source_of(spark: SparkSession, vocabulary: str):
    """The vocabulary file's text, read on the driver and sent to the executors (a file of fixed size)."""
    return spark.sparkContext.broadcast(Path(vocabulary).read_text("utf-8"))
