"""BPE, token files and packing against the tokenizers library."""

import hashlib
import random
import time
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import pytest
from tokenizers import Tokenizer

from readweave.llm import bpe, flat, jaccard, packing, tokenfiles, wordpieces
from readweave.session import new_folder
from tests_llm_brute import check_places
from tests_llm_data import ODD

BYTES, WORDS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    return {p: Tokenizer.from_file(p) for p in (BYTES, WORDS)}


def test_roundtrip(clashing, library):
    rows = bpe.roundtrip(clashing, BYTES).collect()
    want = Counter()
    for k, text, *_ in ODD:
        ids = library[BYTES].encode(text or "", add_special_tokens=False).ids
        want[k, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), library[BYTES].decode(ids, skip_special_tokens=False)] += 1
    assert Counter((r["doc_id"], r["n_tokens"], hashlib.sha256(bytes(r["ids"])).hexdigest(), r["decoded"]) for r in rows) == want


def test_encode_then_decode(odd, none):
    back = {(r["doc_id"], r["text"]) for r in bpe.decode(bpe.encode(odd, BYTES), BYTES).collect()}
    assert back == {(k, t or "") for k, t, *_ in ODD}
    assert bpe.roundtrip(none, BYTES).count() == 0


def test_random_texts(library):
    import pyarrow as pa

    rng = np.random.default_rng(3)
    letters = [
        "a", "b", "the", " ", "  ", "\n", "\t", "'s", "'", "!", "é", "«", "12", "\u00a0", "\u3000", "\u0301", "中", "😀", "<|endoftext|>",
        "\x1c"
    ]
    texts = ["".join(rng.choice(letters, rng.integers(0, 30))) for _ in range(1500)] + ["a" * 2000, " " * 70]
    model = bpe.Bpe(open(BYTES, encoding="utf-8").read())
    got = []
    for _, _, buf, at in flat.windows(pa.array(texts), 1 << 12):
        ids, n = model.encode(buf, at)
        got += [x.tolist() for x in np.split(ids, np.cumsum(n)[:-1])]
    assert got == [e.ids for e in library[BYTES].encode_batch(texts, add_special_tokens=False)]


def test_long_words_of_mixed_letters(library):
    """Words whose pairs wait in a queue, alone and beside short ones; a million letters end soon."""
    rng = random.Random(5)
    word = lambda letters, n: "".join(rng.choices(letters, k=n))
    texts = [word("abcdefghijklmnopqrstuvwxyz", n) for n in (399, 400, 401, 20_000)]
    texts += ["ab" * 900 + "a" * 501 + "aab" * 300, word("aé中ñ", 3000), f"{word('etaoin', 2000)} and {word('xyz', 700)}, 'tis", word("0123456789", 1200) + "!" * 900]
    model = bpe.Bpe(open(BYTES, encoding="utf-8").read())
    data = [t.encode() for t in texts]
    ids, n = model.encode(np.frombuffer(b"".join(data), np.uint8), np.r_[0, np.cumsum([len(d) for d in data])])
    assert [x.tolist() for x in np.split(ids, np.cumsum(n)[:-1])] == [library[BYTES].encode(t, add_special_tokens=False).ids for t in texts]
    long = word("abcdefghijklmnopqrstuvwxyz", 1_000_000)
    began = time.perf_counter()
    ids, _ = model.encode(np.frombuffer(long.encode(), np.uint8), np.array([0, len(long)]))
    assert time.perf_counter() - began < 20 and ids.tolist() == library[BYTES].encode(long, add_special_tokens=False).ids


def thue_morse(n):
    """Two words of n letters that polynomial hashes modulo a power of two can't tell apart."""
    x = "".join("ab"[bin(k).count("1") & 1] for k in range(n))
    return x, x.translate(str.maketrans("ab", "ba"))


@pytest.mark.parametrize("n", [1024, 2048, 4096, 8192])
def test_words_that_simple_hashes_confuse(library, n):
    import pyarrow as pa

    texts = list(thue_morse(n))
    for file, model in ((BYTES, bpe.Bpe(open(BYTES, encoding="utf-8").read())), (WORDS, wordpieces.Encoder(open(WORDS, encoding="utf-8").read()))):
        (_, _, buf, at), = flat.windows(pa.array(texts))
        ids, counts = model.encode(buf, at)
        assert [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])] == [
            e.ids for e in library[file].encode_batch(texts, add_special_tokens=False)
        ]
    tokens, size = jaccard.shingles(buf, at)
    assert size.tolist() == [1, 1] and tokens[0] != tokens[1]


def test_equal_hashes_are_told_apart(monkeypatch):
    """With all hashes equal the table still gives each piece its own ids."""
    encode = lambda pieces: (np.frombuffer(b"".join(pieces), np.uint8).astype(np.uint32), np.array([len(p) for p in pieces], np.int64))
    monkeypatch.setattr(flat, "hash_spans", lambda buf, start, end: np.zeros(len(start), np.uint64))
    table, buf = flat.PieceTable(encode), np.frombuffer(b"abcabdlonger-than-eight-bytes", np.uint8)
    start, end = np.array([0, 3, 6, 0]), np.array([3, 6, 29, 3])
    for _ in range(2):
        ids, n = table.lookup(buf, start, end)
        assert n.tolist() == [3, 3, 23, 3] and ids.astype(np.uint8).tobytes() == b"abcabdlonger-than-eight-bytesabc"


def test_unknown_ids_spell_nothing(spark):
    df = spark.createDataFrame([(1, [-1, 0, 50257, 1, 2**30]), (2, None), (3, [])], "doc_id long, ids array<int>")
    assert {(r["doc_id"], r["text"]) for r in bpe.decode(df, BYTES).collect()} == {(1, '!"'), (2, ""), (3, "")}


def test_capitals_whose_small_letters_compose(library):
    """NFC comes before lower case: these six pairs have a composed form in small letters only."""
    import pyarrow as pa

    pairs = ["T\u0308", "T\u0344", "W\u030a", "Y\u030a", "J\u030c", "H\u0331"]
    texts = [t for p in pairs for t in (p, p.lower(), f"THE {p}AB, and a{p} Plain")] + ["H\u0302\u0331", "NAI\u0308VE,ABC"]
    texts += [chr(a) + chr(m) for a in range(65, 91) for m in range(0x300, 0x370)]
    model = wordpieces.Encoder(open(WORDS, encoding="utf-8").read())
    assert model.pieces
    got = []
    for _, _, buf, at in flat.windows(pa.array(texts), 1 << 12):
        ids, n = model.encode(buf, at)
        got += [x.tolist() for x in np.split(ids, np.cumsum(n)[:-1])]
    assert got == [e.ids for e in library[WORDS].encode_batch(texts, add_special_tokens=False)]


def test_token_files(spark, clashing, none, library):
    folder = new_folder(spark, "test")
    tokenfiles.write(clashing, folder, WORDS, 2)
    rows = tokenfiles.read(spark, folder).orderBy("start").collect()
    keys = [r["doc_id"] for r in rows]
    assert keys == sorted(keys, key=lambda k: (k is not None, k or 0))
    start = 0
    texts = {k: t for k, t, *_ in ODD}
    for r in rows:
        ids = library[WORDS].encode(texts[r["doc_id"]] or "", add_special_tokens=False).ids + [2]
        assert (r["start"], r["n_tokens"], r["tokens"]) == (start, len(ids), ids)
        start += len(ids)
    crc = {(r["doc_id"], r["ids_crc32"]) for r in tokenfiles.with_crc32(tokenfiles.read(spark, folder)).collect()}
    assert crc == {(r["doc_id"], zlib.crc32(np.array(r["tokens"], "<u4").tobytes())) for r in rows}
    empty = new_folder(spark, "test")
    tokenfiles.write(none, empty, WORDS, 2)
    assert tokenfiles.with_crc32(tokenfiles.read(spark, empty)).count() == 0


def test_token_files_are_read_selectively(spark, library):
    """Encodings, row groups and page indexes of the files, and a read of a few keys and of the counts alone."""
    folder = new_folder(spark, "test")
    rows = [(k, f"document number {k} " + "the cat sat on the mat " * 40) for k in range(9000)]
    tokenfiles.write(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), folder, WORDS, 2)
    files = sorted(Path(folder.removeprefix("file://")).glob("*.parquet"))
    groups = [pq.ParquetFile(f).metadata for f in files]
    for meta in groups:
        for g in range(meta.num_row_groups):
            columns = {c.path_in_schema.split(".")[0]: c for c in map(meta.row_group(g).column, range(meta.num_columns))}
            assert columns["tokens"].has_dictionary_page and columns["tokens"].compression == "ZSTD"
            assert not columns["doc_id"].has_dictionary_page or "RLE_DICTIONARY" in columns["doc_id"].encodings
            assert all(c.has_column_index and c.has_offset_index for n, c in columns.items() if n in ("doc_id", "n_tokens", "part_start"))
            assert meta.row_group(g).total_byte_size <= 2 * int(tokenfiles.FORMAT["parquet.block.size"])
    some = spark.read.parquet(folder).where("doc_id between 500 and 510").select("doc_id", "tokens")
    assert "PushedFilters: [IsNotNull(doc_id), GreaterThanOrEqual(doc_id,500), LessThanOrEqual(doc_id,510)]" in some._jdf.queryExecution().executedPlan().toString()
    assert {r["doc_id"]: r["tokens"] for r in some.collect()} == {
        k: [*library[WORDS].encode(t, add_special_tokens=False).ids, 2] for k,
        t in rows[500:511]
    }
    counts = tokenfiles.read(spark, folder).select("doc_id", "start", "n_tokens")
    assert "tokens:array" not in counts._jdf.queryExecution().executedPlan().toString().split("ReadSchema", 1)[1]


def test_packing(clashing, none, library):
    rows = packing.pack(clashing, WORDS, 1, 256).collect()
    want = Counter()
    for k, text, *_ in ODD:
        ids = np.array(library[WORDS].encode(text or "", add_special_tokens=False).ids + [1], "<u4")
        for p in range(0, len(ids), 256):
            want[k, p // 256, p, len(ids[p : p + 256]), zlib.crc32(ids[p : p + 256].tobytes())] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == want
    assert check_places(rows, 256) <= -(-sum(r["length"] for r in rows) // 256) + 1
    assert packing.pack(none, WORDS).count() == 0


@pytest.mark.parametrize("seed", range(60))
def test_plans(seed):
    rng = np.random.default_rng(seed)
    capacity = int(rng.choice([1, 2, 7, 16, 64, 300]))
    count = np.zeros(capacity + 1, np.int64)
    np.add.at(count, rng.integers(1, capacity + 1, rng.integers(0, 80)), 1)
    count *= int(rng.choice([1, 1, 5, 1000]))
    made = packing.plan(count, capacity)
    length = np.repeat(np.arange(capacity + 1), count)
    sequence, offset = made.place(length, flat.ranges(np.zeros(capacity + 1, np.int64), count))
    assert check_places(
        [{"sequence_id": s, "offset": o, "length": n} for s, o, n in zip(sequence, offset, length, strict=True)],
        capacity
    ) == made.sequences
    if len(length):
        assert made.sequences <= 1.7 * -(-int(length.sum()) // capacity) + 1
