"""Runs, vector codes and shards against brute force, also on odd rows."""

import hashlib
import heapq
import random
import re
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from readweave.llm import flat, periodic, queries, sharding, vectorcodes
from tests_llm_data import ODD

D = "/root/testdata/sf0.001"


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def brute_runs(w, least=6, powers=4):
    x, out = np.unique(np.array(w, dtype=str), return_inverse=True)[1] if len(w) else np.zeros(0), {}
    for q in range(1, len(w) // powers + 1):
        edge = np.flatnonzero(np.diff(np.r_[0, (x[:-q] == x[q:]).astype(int), 0]))
        for start, end in edge.reshape(-1, 2).tolist():
            if end - start + q >= max(least, powers * q):
                out.setdefault((start, end - start + q), q)
    return sorted(((s, n, q) for (s, n), q in out.items()), key=lambda r: (r[0], r[2]))


def brute_told(w):
    """Columns of a document, as the contract has them."""
    runs = brute_runs(w)
    drop = {i for s, n, q in runs for i in range(s + q, s + n)}
    top = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    left = " ".join(x for i, x in enumerate(w) if i not in drop)
    return (len(runs), *(top or (None,) * 3), 1000 * top[1] // top[2] if top else None, sha("".join(f"{s},{n},{q}\n" for s, n, q in runs)), sha(left))


TOLD = ["n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]


def made(rng, n, k):
    """Words of stretches that repeat and stretches that don't."""
    w = []
    while len(w) < n:
        one = [f"w{rng.randrange(k)}" for _ in range(rng.randrange(1, 12))]
        w += (one * rng.randrange(1, 9))[: rng.randrange(1, 60)]
    return w[:n]


def repeated_as_told(doc_id, w):
    h = zlib.crc32(str(doc_id).encode())
    g, n = h // 10, len(w)
    if h % 10 or not n:
        return w
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]


def test_registered_runs(spark):
    docs = spark.read.parquet(f"{D}/documents.parquet").collect()
    got = {r["doc_id"]: tuple(r[c] for c in TOLD) for r in queries.op12_periodic_runs(spark, D).collect()}
    assert got.keys() == {r["doc_id"] for r in docs}
    for r in docs:
        if len(w := repeated_as_told(r["doc_id"], words_of(r["text"]))) < 3000:
            assert got[r["doc_id"]] == brute_told(w)
    assert sum(v[0] > 0 for v in got.values()) > 10


@pytest.mark.parametrize("tile", [1 << 16, 32])
def test_runs(spark, monkeypatch, tile):
    """Of short documents, and of long ones that are cut into tiles of all octaves."""
    monkeypatch.setattr(periodic, "TILE", tile)
    rng = random.Random(tile)
    texts = [made(rng, rng.randrange(0, 400), rng.choice([1, 2, 3, 9])) for _ in range(60)] + [["a"] * 500, (["a"] * 9 + ["b"]) * 30, ["c", *["a", "b"] * 99, "a"]]
    df = spark.createDataFrame([(k, "\t \n".join(w)) for k, w in enumerate(texts)], "doc_id long, text string").repartition(3)
    for r in _runs_here(texts) if tile == 32 else periodic.runs(df).collect():
        assert tuple(r[c] for c in TOLD) == brute_told(texts[r["doc_id"]])


def _runs_here(texts):
    """What tasks do, without Spark: workers would not see the small tiles."""
    for k, w in enumerate(texts):
        h = np.array([int.from_bytes(hashlib.md5(x.encode()).digest()[:8], "little") for x in w], np.uint64)
        parts = [(np.zeros(0, np.int64),) * 3]
        for base, end, first, last, low, high in periodic.tiles(len(h), 4):
            period, lo, hi = periodic.solve(h[base:end], first - base, last - base, low, high)
            lo, hi = lo + base, hi + base
            some = periodic.long_enough(period, lo, hi, 6, 4) | (lo <= first) | (hi >= last)
            parts.append((period[some], lo[some], hi[some]))
        period, lo, hi = periodic.united(*(np.concatenate(p) for p in zip(*parts, strict=True)))
        some = periodic.long_enough(period, lo, hi, 6, 4)
        runs = sorted(zip(lo[some].tolist(), (hi - lo + period)[some].tolist(), period[some].tolist(), strict=True), key=lambda r: (r[0], r[2]))
        body = memoryview(" ".join(w).encode())
        listed, left, top = periodic._told(body, [dict(zip(("start", "length", "period"), r, strict=True)) for r in runs])
        yield {"doc_id": k, "n_runs": len(runs), "exponent_milli": 1000 * top["length"] // top["period"] if top else None, "runs_sha256": listed, "collapsed_sha256": left} | {
            c: top.get(c) for c in ("start", "length", "period")
        }


def test_runs_of_long_documents(spark):
    """Documents of several tiles, beside short ones; the tiles are rows of their own."""
    rng = random.Random(3)
    plain = [f"w{rng.randrange(10**9)}" for _ in range(70_000)]
    whole = [f"v{k % 20_000}" for k in range(90_000)]
    small = made(rng, 300, 2)
    long = [*plain, *["x"] * 70_000, *plain[:9]]
    df = spark.createDataFrame([(1, " ".join(plain)), (2, " ".join(whole)), (3, " ".join(small)), (4, " ".join(long))], "doc_id long, text string").coalesce(1)
    got = {r["doc_id"]: tuple(r[c] for c in TOLD) for r in periodic.runs(df).collect()}
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    assert got[1] == (0, None, None, None, None, sha(""), sha(" ".join(plain)))
    assert got[2] == (1, 0, 90_000, 20_000, 4500, sha("0,90000,20000\n"), sha(" ".join(whole[:20_000])))
    assert got[3] == brute_told(small)
    assert got[4] == (1, 70_000, 70_000, 1, 70_000_000, sha("70000,70000,1\n"), sha(" ".join([*plain, "x", *plain[:9]])))


def test_runs_of_odd_rows(spark, odd, none, clashing):
    want = sorted(((k, *brute_told(words_of(t))) for k, t, *_ in ODD), key=str)
    for df in (odd, clashing):
        assert sorted((tuple(r[c] for c in ["doc_id", *TOLD]) for r in periodic.runs(df).collect()), key=str) == want
    assert periodic.runs(none).collect() == []
    million = flat.mix(np.zeros(1_000_000, np.uint64))
    assert [v.tolist() for v in periodic.solve(million, 0, len(million), 1, 1 << 18)] == [[1], [0], [999_999]]


def brute_codes(rows, parts, entries, rounds, scale=256):
    """rows: (id, vector, label) -> {(id, code, error)}, label errors, codebooks."""
    x = np.floor(scale * np.array([v for _, v, _ in rows], np.float64)).astype(np.int64)
    x = x.reshape(len(rows), parts, -1)
    first = sorted((i, tuple(v), k) for k, (i, v, _) in enumerate(rows) if i is not None)[:entries]
    books = x[[k for *_, k in first]].transpose(1, 0, 2).copy()
    for r in range(rounds + 1):
        far = ((x[:, :, None, :] - books[None]) ** 2).sum(-1)
        own = far.argmin(-1)
        for p in range(parts) if r < rounds else ():
            for e in range(books.shape[1]):
                if (own[:, p] == e).any():
                    books[p, e] = x[own[:, p] == e, p].sum(0) // (own[:, p] == e).sum()
    error = far.min(-1).sum(-1)
    codes = ["".join(f"{v:02x}" for v in o) for o in own]
    by = {}
    for (_, _, label), e in zip(rows, error.tolist(), strict=True):
        by[label] = by.get(label, 0) + e
    digest = hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
    return sorted(((i, c, e, by[label], digest) for (i, _, label), c, e in zip(rows, codes, error.tolist(), strict=True)), key=str)


def coded(df, **settings):
    columns = ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    return sorted((tuple(r[c] for c in columns) for r in vectorcodes.compress(df, **settings).collect()), key=str)


def test_codes(spark):
    rng = np.random.default_rng(1)
    x = (rng.normal(size=(900, 12)) + rng.integers(0, 4, (900, 1))).astype(np.float32)
    x[300:500] = x[300]
    rows = [(k, [float(c) for c in v], k % 5 or None) for k, v in enumerate(x)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(5)
    assert coded(df, parts=4, entries=16, rounds=3) == brute_codes(rows, 4, 16, 3)
    assert coded(df.repartition(2), parts=3, entries=256, rounds=1) == brute_codes(rows, 3, 256, 1)


def test_codes_of_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    sound = [(3, [1.0, 0.5]), (None, [0.25, -1.0]), (1, [0.0, 0.0]), (1, [0.0, 0.0]), (1, [-1.0, 0.0]), (9, [1.0, 0.5])]
    rows = [(i, v, "a" if i else None) for i, v in sound]
    odd = [(4, None, "a"), (5, [None, 1.0], None), (6, [nan, 0.0], "b"), (7, [0.0, -inf], "b"), (8, [], "b")]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>, label string")
    clash = df.select("*", *(F.lit("x").alias(c) for c in ("id", "v", "code", "error", "label_error", "part", "n")))
    for some in (df, clash):
        assert coded(some, parts=2, entries=64) == brute_codes(rows, 2, 64, 2)
    assert coded(df.limit(0)) == []
    with pytest.raises(ValueError):
        coded(spark.createDataFrame([(1, [1.0], "a"), (2, [1.0, 2.0], "a")], df.schema), parts=1)


def test_trees_spare_comparisons():
    """Nodes cover their points, siblings' centres lie apart, and near entries most points never meet an entry."""
    rng = np.random.default_rng(2)
    x = (rng.normal(size=(4000, 3)) * 40 + rng.integers(0, 3, (4000, 1)) * 4000).astype(np.int64)
    tree = vectorcodes.Tree.of(x)
    for node, total in zip(tree.nodes, tree.sums, strict=True):
        points = x[tree.order[node["first"] : node["end"]]]
        assert (points.sum(0) == total).all() and np.isclose(vectorcodes._distances(points, x[node["centre"]]).max(), node["radius"])
        children = tree.nodes[node["child"] : node["child"] + node["children"]]
        if len(children):
            assert children["centre"][0] == node["centre"] and (children["end"] - children["first"]).sum() == len(points)
            centres = x[children["centre"]]
            assert min(vectorcodes._distances(centres[k + 1 :], c).min(initial=np.inf) for k, c in enumerate(centres)) > children["radius"].max()
    entries = np.array([[0] * 3, [4000] * 3, [8000] * 3])
    own, count, sums, alone = vectorcodes.assign(tree, x, entries)
    assert (own == ((x[:, None] - entries) ** 2).sum(-1).argmin(-1)).all() and alone == 0
    assert (count == np.bincount(own)).all() and (sums[1] == x[own == 1].sum(0)).all()


def test_registered_codes(spark):
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from '{D}/embeddings.parquet'")
    names = ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    want = con.execute(f"select {', '.join(names)} from ({queries.oracle_sql()['op11_vector_codes']})").fetchall()
    assert sorted(tuple(r[c] for c in names) for r in queries.op11_vector_codes(spark, D).collect()) == sorted(want)


def brute_loads(sizes, shards):
    heap = [(0, k) for k in range(shards)]
    for s in sorted(sizes, reverse=True):
        load, k = heap[0]
        heapq.heapreplace(heap, (load + s, k))
    return sorted(load for load, _ in heap)


def check_shards(rows, texts, shards):
    """Slots gapless, equal texts together, sizes and checksums right; returns the loads."""
    assert sorted((r["size"], r["text_crc32"]) for r in rows) == sorted((len(t.encode()) + 1, zlib.crc32(t.encode())) for t in texts)
    loads, slots, home = [0] * shards, {}, {}
    for r in rows:
        loads[r["shard"]] += r["size"]
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    for r in rows:
        assert home.setdefault((r["size"], r["text_crc32"]), r["shard"]) == r["shard"]
    return sorted(loads)


def test_shards(spark):
    rng = random.Random(5)
    texts = ["x" * rng.choice([5, 6, 7, rng.randrange(3000)]) + str(rng.randrange(500)) for _ in range(3000)] + ["copy of a hot text"] * 4000
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(7)
    rows = sharding.shard(df, shards=8).collect()
    groups = {}
    for t in texts:
        groups[t] = groups.get(t, 0) + len(t) + 1
    assert check_shards(rows, texts, 8) == brute_loads(groups.values(), 8)
    assert sorted(r["doc_id"] for r in rows) == list(range(len(texts)))


def test_schedule_deals_as_one_by_one():
    rng = random.Random(6)
    for _ in range(200):
        sizes = sorted(((rng.randrange(1, 60), rng.randrange(1, 40)) for _ in range(rng.randrange(1, 8))), reverse=True)
        shards = rng.randrange(1, 9)
        dealt = sharding.schedule(sizes, shards)
        assert dealt.sum(axis=1).tolist() == [n for _, n in sizes]
        loads = sorted((dealt * np.array([[s] for s, _ in sizes])).sum(axis=0).tolist())
        assert loads == brute_loads([s for s, n in sizes for _ in range(n)], shards)


def test_size_classes_are_few_and_near(spark):
    sizes = [1, 8191, 8192, 8193, 123_456_789, (1 << 40) + 1, 1 << 50]
    df = spark.createDataFrame([(s,) for s in sizes], "bytes long").withColumn("c", sharding.size_class("bytes", 1 << 62))
    got = dict(df.collect())
    assert [got[s] for s in sizes[:3]] == sizes[:3] and all(0 <= s - got[s] < max(1, s / 4096) for s in sizes)
    exact = df.select("bytes", sharding.size_class("bytes", 1 << 50).alias("c")).collect()
    assert dict(exact)[(1 << 40) + 1] == (1 << 40) + 1


def test_shards_of_odd_rows(spark, odd, none, clashing):
    texts = [t or "" for _, t, *_ in ODD]
    for df in (odd, clashing):
        rows = sharding.shard(df, shards=3).collect()
        check_shards(rows, texts, 3)
        assert sorted((r["doc_id"] for r in rows), key=str) == sorted((k for k, *_ in ODD), key=str)
    assert sharding.shard(none).collect() == []
    one = sharding.shard(odd, shards=2, group=F.lit("all")).collect()
    assert len({r["shard"] for r in one}) == 1
