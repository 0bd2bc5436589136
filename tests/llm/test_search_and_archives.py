"""Nearest neighbours against brute force, archives against what was written, the pipeline's stages."""

import dataclasses
import hashlib
import importlib
import struct
from collections import Counter

import duckdb
import numpy as np
import public_tokenizers
import pytest
import zstandard
from pyspark.sql import functions as F

from readweave.llm import ann, quality, queries, rules, warc
from readweave.session import new_folder
from tests_llm_brute import brute_components, check_places
from tests_llm_data import ODD, SCHEMA
from tokenizers import Tokenizer


def brute(rows, query, k):
    rows = sorted({(i, tuple(v)) for i, v in rows})
    out = {}
    for q, v in rows:
        if query(q):
            s = [(-float(np.dot(np.float64(v), np.float64(w))), i) for i, w in rows if i != q]
            out[q] = sorted(s)[:k]
    return out


def found(df, k=20):
    out = {}
    for r in ann.search(df, F.col("vec_id") % 20 == 0, k=k).orderBy("query_id", "rank").collect():
        out.setdefault(r["query_id"], []).append((-r["score"], r["vec_id"]))
    return out


@pytest.mark.parametrize("scaled", [False, True])
def test_recall(spark, scaled):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(1500, 24)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    x *= rng.uniform(0.5, 2, (1500, 1)).astype(np.float32) if scaled else 1
    x[700:900] = x[700]
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(x)]
    got, want = found(spark.createDataFrame(rows, "vec_id long, embedding array<float>")), brute(rows, lambda q: q % 20 == 0, 20)
    assert got.keys() == want.keys() and all(len(g) == 20 for g in got.values())
    right = sum(len({i for _, i in got[q]} & {i for _, i in want[q]}) for q in want)
    assert right >= 0.9 * 20 * len(want)
    assert [i for _, i in got[700]] == [i for _, i in want[700]] == list(range(701, 721))


def test_search_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (0, [1.0, 0.0]), (20, [0.5, 0.5]), (1, None), (2, []), (3, [0.0, 0.0]), (4, [None, 1.0]), (5, [nan, 1.0]), (6, [inf, 1.0]),
        (7, [1.0, 0.0]), (7, [1.0, 0.0]), (8, [1.0, 2.0, 3.0]), (None, [1.0, 1.0]), (40, None)
    ]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("entry", F.lit(1)).withColumn("score", F.lit("x"))
    got = found(df)
    assert got == {0: [(-1.0, 7), (-0.5, 20)], 20: [(-0.5, 0), (-0.5, 7)]}
    assert found(df.limit(0)) == {}


def test_each_length_among_its_own(spark):
    rows = [(0, [1.0, 0.0]), (1, [0.5, 0.0]), (2, [0.0, 1.0]), (20, [1.0, 0.0, 0.0]), (21, [0.5, 0.5, 0.0]), (0, [0.0, 1.0, 0.0])]
    got = found(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    assert got == {0: [(-0.5, 1), (-0.5, 21), (0.0, 2), (0.0, 20)], 20: [(-0.5, 21), (0.0, 0)]}


@pytest.mark.parametrize("outer", [0, 1])
def test_cells_grow_with_the_rows(outer):
    """Of rows without any structure ever fewer are scored for one recall, and large tables have more cells."""
    rng, share = np.random.default_rng(4), []
    for n in (2000, 50_000):
        x = rng.normal(size=(n, 64))
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        t = ann.Tables(64, 1.0, False, 8).for_rows(n)
        t = dataclasses.replace(t, outer=min(outer, t.rotations - 1))
        q, unit = t.unit(x[:40], True), t.unit(x, False)
        s = x[:40] @ x.T
        s[np.arange(40), np.arange(40)] = -9
        near = np.argsort(-s, axis=1)[:, :20]
        cost = np.stack([sum(t.penalties(q, i, r)[:, t.nearest(unit, i, r)] for r in range(t.rotations)) for i in range(t.tables)])
        most = np.quantile(np.take_along_axis(cost.min(axis=0), near, 1), 0.95)
        share.append((cost <= most).sum() / s.size)
        for table in range(t.tables):  # the groups that a query goes to are those that hold a cell within the penalty
            row, group, left = t.probed(q, table, most)
            filed, cell = t.filed(unit, table)
            rest = {(a, b): c for a, b, c in zip(row.tolist(), group.tolist(), left.tolist(), strict=True)}
            digits = t.digits(cell[:300])
            last = sum(t.penalties(q, table, t.outer + k)[:, d] for k, d in enumerate(digits))
            met = np.array([[last[a, j] <= rest.get((a, g), -1) + 1e-12 for j, g in enumerate(filed[:300].tolist())] for a in range(40)])
            assert (met == (cost[table][:, :300] <= most + 1e-12)).all()
    assert share[1] < 0.35 < share[0] < 1


def test_copies_of_a_query_at_a_million_rows():
    """Of rows without any structure, with the penalty that finds 0.95 of the neighbours: to how many blocks a query goes."""
    rng, n = np.random.default_rng(6), 1_000_000
    x = rng.normal(size=(n, 64)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    t = ann.Tables(64, 1.0, False, 8).for_rows(n)
    s = x[:20] @ x.T
    s[np.arange(20), np.arange(20)] = -9
    near = np.argpartition(-s, 20, axis=1)[:, :20]
    q = t.unit(x[:20].astype(np.float64), True)
    unit = t.unit(x[near.ravel()].astype(np.float64), False)
    row = np.repeat(np.arange(20), 20)
    cost = [sum(t.penalties(q, i, r)[row, t.nearest(unit, i, r)] for r in range(t.rotations)) for i in range(t.tables)]
    most = np.quantile(np.min(cost, axis=0), 0.95)
    groups = sum(len(t.probed(q, i, most)[0]) for i in range(t.tables)) / 20
    blocks = np.ceil(n / (2 * t.axes) ** t.outer / ann.BLOCK)
    assert groups * blocks < 300
    assert all(ann.Tables(64, 1.0, False, 8).for_rows(m).outer == k for m, k in [(200_000, 0), (30_000_000, 1), (3_000_000_000, 2)])


def test_recall_of_the_registered_query(spark):
    d = "/root/testdata/sf0.1"
    table = spark.read.parquet(f"{d}/embeddings.parquet").toPandas()
    x, ids, got = np.array(table.embedding.tolist(), np.float64), table.vec_id.to_numpy(), {}
    for r in queries.op8_nearest(spark, d).collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    hits = []
    for k in np.flatnonzero(ids % 20 == 0):
        s = x @ x[k]
        s[k] = -9
        hits.append(len(got[ids[k]] & set(ids[np.argsort(-s)[:20]].tolist())))
    assert np.mean(hits) / 20 >= 0.95


def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string").withColumns(
        {"digest": F.lit("x"), "size": F.lit(0), "response": F.lit(1)}
    )


def test_archives(spark):
    big, small = "é" * 600, "y" * 999
    rows = [
        (1, "http://a/", big), (5, "http://b/\n", big), (3, None, big), (2, "u", small), (4, "u", small), (6, "u", None), (-7, "u", ""),
        (None, "u", "z" * 1000), (8, "u", "z" * 1000), (9, "u", "<p>\r\n\r\n</p>" * 200), (9, "u", "<p>\r\n\r\n</p>" * 200)
    ]
    folder = new_folder(spark, "test")
    warc.write(pages(spark, rows).repartition(3), folder)
    got = sorted(
        ((r["key"], r["record_type"], r["payload_bytes"], r["payload_digest"], r["refers_to"]) for r in warc.read(spark, folder).collect()),
        key=str
    )
    want = []
    for k, _, html in rows:
        data = (html or "").encode()
        to = 5 if html == big and k != 5 else None
        want.append((k, "revisit" if to else "response", len(data), hashlib.sha1(data).hexdigest(), to))
    assert got == sorted(want, key=str)
    payloads = {r["key"]: bytes(r["payload"]) for r in warc.read(spark, folder).where("record_type = 'response'").collect()}
    assert payloads[5] == big.encode() and payloads[9] == rows[-1][2].encode()
    files = spark.read.format("binaryFile").load(folder).collect()
    assert all(struct.unpack_from("<I", f["content"])[0] == warc.DICTIONARY for f in files if f["length"])


def test_archives_have_a_bounded_size(spark):
    """However much a partition holds, an archive ends at the bound; only a larger record has one of its own."""
    html = lambda k: "".join(hashlib.sha512(f"{k}-{i}".encode()).hexdigest() for i in range(1000 if k == 50 else 20))
    rows = [(k, f"http://a/{k}", html(k)) for k in range(100)]
    folder, bound = new_folder(spark, "test"), 40_000
    warc.write(pages(spark, rows).coalesce(1), folder, archive_bytes=bound)
    files = spark.read.format("binaryFile").load(folder).collect()
    assert 3 < len(files) < 60 and all(struct.unpack_from("<I", f["content"])[0] == warc.DICTIONARY for f in files)
    one = lambda f: len(list(warc.frames(memoryview(f["content"])))) == 1
    assert all(f["length"] <= bound + len(warc.SEPARATOR) or one(f) for f in files)
    got = {r["key"]: bytes(r["payload"]).decode() for r in warc.read(spark, folder).collect()}
    assert got == {k: text for k, _, text in rows}


def test_no_pages(spark):
    folder = new_folder(spark, "test")
    warc.write(pages(spark, [(1, "u", "x")]).where("page_id = 2"), folder)
    assert warc.read(spark, folder).count() == 0


def test_broken_archives():
    whole = warc.record(3, 0, "http://a/", b"body", 4, hashlib.sha1(b"body").hexdigest(), None)
    fields, block = warc.parsed(whole)
    assert fields["content-length"] == str(len(block)) and block.endswith(b"body") and warc.key_of(warc.record_id(-3)) == -3
    for bad in (
        whole[:-1],
        whole.replace(b"WARC/1.1", b"WARC/9.9"),
        whole.replace(b"WARC-Date", b"X-Date"),
        whole.replace(b"Content-Length: 4", b"Content-Length: 44"),
        b""
    ):
        with pytest.raises(ValueError):
            warc.parsed(bad)
    frame = zstandard.ZstdCompressor(write_checksum=True).compress(whole)
    assert list(warc.frames(memoryview(frame + warc.SEPARATOR + frame))) == [whole, whole]
    for bad in (frame[:-2], frame[:9], b"junk" + frame, warc.SEPARATOR[:6]):
        with pytest.raises(ValueError):
            list(warc.frames(memoryview(bad)))


@pytest.mark.parametrize("broken", ["cut", "flipped", "no dictionary", "junk"])
def test_a_broken_archive_is_refused(spark, tmp_path, broken):
    folder = new_folder(spark, "test")
    warc.write(pages(spark, [(k, f"http://a/{k}", f"<p>{k}</p>" * 300) for k in range(20)]).coalesce(1), folder)
    whole = next(bytes(f["content"]) for f in spark.read.format("binaryFile").load(folder).collect() if f["length"])
    start = 8 + struct.unpack_from("<II", whole)[1]
    bad = {
        "cut": whole[:-30],
        "flipped": whole[:-40] + bytes([whole[-40] ^ 1]) + whole[-39:],
        "no dictionary": whole[start:],
        "junk": whole[:start] + b"junk" + whole[start:]
    }[broken]
    (tmp_path / "a.warc.zst").write_bytes(bad)
    (tmp_path / "b.warc.zst").write_bytes(whole)
    with pytest.raises(Exception, match=r"a\.warc\.zst"):
        warc.read(spark, str(tmp_path)).collect()
    (tmp_path / "a.warc.zst").unlink()
    assert warc.read(spark, str(tmp_path)).count() == 20


def test_pipeline(spark):
    """Each stage keeps exactly what brute force over the stage before gives."""
    pipeline, d = importlib.import_module("corpus_pipeline"), "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet").cache()
    ids = lambda df: sorted(r["doc_id"] for r in df.select("doc_id").collect())
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{d}/documents.parquet'")
    ruled = pipeline.quality_rules(spark, docs, d).cache()
    assert ids(ruled) == sorted(
        k for (k,) in con.execute(f"select doc_id from ({rules.oracle()}) where kept").fetchall()
    ) and ruled.columns == docs.columns
    good = pipeline.quality_classifier(spark, ruled, d).cache()
    model = quality.train(docs, spark.read.parquet(f"{d}/labels.parquet"))
    measured = quality.scored_vectors(ruled, "text", ["doc_id"]).collect()
    assert ids(good) == sorted(
        r["doc_id"] for r in measured if model.utility(np.array([r["vector"]]))[0] >= model.threshold
    ) and good.columns == docs.columns
    unique = pipeline.near_duplicates(spark, good, d).cache()
    assert ids(unique) == sorted(
        k for k,
        _,
        c in brute_components([(r["doc_id"], r["text"]) for r in good.collect()]) if k == c
    ) and unique.columns == docs.columns
    packed = pipeline.best_fit_packing(spark, unique, d).collect()
    library, want = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")), Counter()
    for r in unique.collect():
        n = len(library.encode(r["text"] or "", add_special_tokens=False).ids) + 1
        want.update((r["doc_id"], p // 4096, min(4096, n - p)) for p in range(0, n, 4096))
    assert Counter((r["doc_id"], r["piece"], r["length"]) for r in packed) == want
    check_places(packed, 4096)
    assert pipeline.run(spark, d).count() == len(packed)


def test_pipeline_stages_on_odd_rows(spark, clashing, none):
    pipeline, d = importlib.import_module("corpus_pipeline"), "/root/testdata/sf0.001"
    for name, stage in pipeline.STAGES:
        assert stage(spark, none, d).count() == 0
        got = stage(spark, clashing, d)
        if name != pipeline.STAGES[-1][0]:
            assert got.columns == pipeline.COLUMNS and {r["doc_id"] for r in got.collect()} <= {k for k, *_ in ODD}
    near = sorted(((r["doc_id"], r["text"]) for r in pipeline.near_duplicates(spark, clashing, d).collect()), key=str)
    want = {(k, t) for k, t, *_ in ODD} - {(5, "One  two\nthree")}
    assert near == sorted(want, key=str)


def test_near_copies_without_keys(spark):
    """Of a component one row stays, also where keys are null or stand for several texts."""
    pipeline = importlib.import_module("corpus_pipeline")
    base, other = [f"w{k}" for k in range(60)], " ".join(f"v{k}" for k in range(60))
    texts = [
        (None, " ".join(base)),
        (None, " ".join([*base, "x"])),
        (None, " ".join(["y", *base])),
        (4, other),
        (4, other + " more"),
        (4, "short text"),
        (4, "short text")
    ]
    df = spark.createDataFrame([(k, t, "en", "s", len(t)) for k, t in texts], SCHEMA)
    got = [(r["doc_id"], r["text"]) for r in pipeline.near_duplicates(spark, df, "").collect()]
    assert len(got) == 3 and {k for k, _ in got} == {None, 4} and (4, "short text") in got
    keyed = df.union(spark.createDataFrame([(9, " ".join(base[1:]), "en", "s", 0)], SCHEMA))
    assert {r["doc_id"] for r in pipeline.near_duplicates(spark, keyed, "").collect()} == {4, 9}


def test_filter_of_keys(spark):
    """Each key that is there is found; a row without a key isn't, and chance adds few others."""
    rows = spark.range(20_000).select((F.col("id") - 10_000).alias("key")).union(spark.sql("select cast(null as bigint)"))
    keys = rows.where("key % 400 = 0")
    got = warc.maybe_in(rows, keys)
    assert got.count() == 20_001 and got.where("key % 400 = 0 and not maybe").count() == 0
    assert got.where("maybe").count() <= 52 and got.where("key is null and maybe").count() == 0
    crowded = warc.maybe_in(rows, rows.where("key % 2 = 0"), cells=1 << 12)
    assert crowded.where("key % 2 = 0 and not maybe").count() == 0 and crowded.where("maybe").count() > 15_000
    assert warc.maybe_in(rows, keys.where("key is null")).where("maybe").count() == 0


def test_repeats_refer_to_the_largest_key(spark, tmp_path):
    """Of 300 pages 20 repeat another; rows without a key are responses."""
    rows = [(k, f"http://a/{k}", f"<p>{k % 280}</p>" * 300) for k in range(300)]
    rows += [(None, "http://b/", "<p>0</p>" * 300), (None, None, None)]
    folder = str(tmp_path / "archives")
    warc.write(pages(spark, rows).repartition(4), folder)
    got = {(r["key"], r["record_type"], r["refers_to"]) for r in warc.read(spark, folder).collect()}
    assert {g for g in got if g[0] is not None} == {(k, "revisit", k + 280) if k < 20 else (k, "response", None) for k in range(300)}
    assert warc.read(spark, folder).where("key is null").count() == 2
