"""Near-duplicate join: components of documents whose shingle sets have Jaccard similarity >= a threshold.

The join is exact up to collisions of hashes (64 bits for equal sets, 48 for single
shingles) and follows adaptive multi-match prefix filtering:

1.  *Sets.* One pass hashes each text's distinct shingles. Equal sets are one node.
2.  *Document frequency.* Postings (shingle, node) go to ranges of the hash space as
    delta-coded blobs; a range counts its shingles exactly. Shingles of one node only
    end here. Shingles that are common within single tasks are known beforehand as a
    list of bounded size; their postings are dealt over all ranges, so no shingle's
    postings have to meet in one task. Likewise, of a text with very many copies
    only one row sends postings.
3.  *Prefixes.* A node's shingles are ordered by frequency, rare first. Two sets of
    sizes n and m that reach the threshold t share o = ceil(t (n + m) / (1 + t)) or more,
    so for every l, l of them lie in the first n - o + l of the one and the first
    m - o + l of the other. Each node takes the l that costs least by its shingles'
    frequencies: a longer prefix brings more postings but needs more matches before
    a pair is verified. A pair uses the smaller l of its two nodes.
4.  *Links.* Only components are asked for, so pairs inside one component need no
    test. First each prefix token links its nodes to two centres; then, for tokens
    whose nodes still lie in different components, all pairs of those meet block by
    block, unless sizes, places or a small map of bits rule them out. In both rounds a pair is
    verified against the whole sets only if it shares l prefix tokens. Components come from alternating large-star
    and small-star steps over written tables. l is 4 at most (MOST_MATCHES), which
    bounds how much longer a prefix gets and loses no pair.

Null and empty texts have an empty set, size 0 and are linked with nothing: their
component is their own key. With fewer words than the shingle's width the whole
sequence is the one shingle. Rows may share a key: each row's own text decides its
component, named by the smallest key in it (null only if all its keys are null).
Other columns are not carried.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from readweave.llm import flat
from readweave.session import remove, written

BITS = np.uint64(48)
MASK = np.uint64((1 << 48) - 1)
CHUNK = 600_000
#: Postings of a range: what one group holds, whatever the input.
RANGE = 2_000_000
#: Ranges that postings are dealt to at once; with more of them they go there in two steps.
FAN = 4096
#: Length of the lists of common shingles and of texts with many copies.
LISTED = 100_000
#: What verifying a pair costs, in postings.
VERIFY = 20.0
#: Largest l that is weighed for a node.
MOST_MATCHES = 4
#: Rows of a token that meet at once.
BLOCK = 256
#: Words of 64 bits in a node's map of shingles.
WORDS = 16


def shingles(buf: np.ndarray, at: np.ndarray, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of a window's texts, sorted within each text, and their number."""
    rows = len(at) - 1
    low = flat.LOWER[buf]
    start, end, row = flat.word_spans(low, at)
    h = flat.hash_spans(low, start, end)
    n = np.bincount(row, minlength=rows)
    first = np.cumsum(n) - n
    count = np.where(n >= width, n - width + 1, np.minimum(n, 1))
    begin, owner = flat.ranges(first, count), np.repeat(np.arange(rows), count)
    size = np.minimum(n, width)[owner]
    acc = size.astype(np.uint64)
    for k in range(width):
        step = flat.mix(acc * np.uint64(0x9FB21C651E98DF25) + h[np.minimum(begin + k, max(len(h) - 1, 0))])
        acc = np.where(k < size, step, acc)
    order = np.lexsort((acc, owner))
    acc, owner = acc[order], owner[order]
    new = np.ones(len(acc), bool)
    new[1:] = (acc[1:] != acc[:-1]) | (owner[1:] != owner[:-1])
    return acc[new], np.bincount(owner[new], minlength=rows)


def set_hash(tokens: np.ndarray, n: np.ndarray) -> np.ndarray:
    """A hash of each text's whole set."""
    out = np.zeros(len(n), np.uint64)
    some = n > 0
    if some.any():
        out[some] = np.add.reduceat(flat.mix(tokens ^ np.uint64(0x5851F42D4C957F2D)), (np.cumsum(n) - n)[some])
    return flat.mix(out + n.astype(np.uint64)).view(np.int64)


def short(tokens: np.ndarray) -> np.ndarray:
    return tokens >> np.uint64(16)


# Blobs: whole numbers as bytes, low bytes first of all numbers, compressed.


def pack(values: np.ndarray, width: int) -> bytes:
    planes = np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T)
    return pa.compress(planes.tobytes(), codec="zstd", asbytes=True)


def unpack(blob: bytes, count: int, width: int) -> np.ndarray:
    planes = np.frombuffer(pa.decompress(blob, count * width, codec="zstd", asbytes=True), np.uint8).reshape(width, count)
    out = np.zeros((count, 8), np.uint8)
    out[:, :width] = planes.T
    return out.view("<u8").ravel()


def runs(values: np.ndarray) -> list[tuple[int, int]]:
    """Start and end of each run of equal values."""
    if not len(values):
        return []
    edge = np.flatnonzero(np.r_[True, values[1:] != values[:-1], True]).tolist()
    return list(zip(edge[:-1], edge[1:], strict=True))


POSTINGS = "bucket int, size int, tokens binary, place binary, nodes int, node binary, n binary, df binary"
NAMES = ["bucket", "size", "tokens", "place", "nodes", "node", "n", "df"]


def to_blobs(bucket: np.ndarray, token: np.ndarray, node: np.ndarray, n: np.ndarray, df: np.ndarray | None) -> pa.RecordBatch:
    """One row for each bucket with its postings, sorted by token, and a list of the nodes in them."""
    order = np.lexsort((token, bucket))
    bucket, token, node, n = bucket[order], token[order], node[order], n[order]
    df = df[order] if df is not None else None
    rows = []
    for a, b in runs(bucket):
        own, first, place = np.unique(node[a:b], return_index=True, return_inverse=True)
        rows.append((
            int(bucket[a]), b - a, pack(np.diff(token[a:b], prepend=np.uint64(0)), 6), pack(place.ravel(), 4), len(own),
            own.astype("<i8").tobytes(), pack(n[a:b][first], 4), pack(df[a:b], 5) if df is not None else b"",
        ))
    kinds = [pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.int32(), pa.binary(), pa.binary(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], NAMES)


def blob_tokens(rows: list[dict]) -> np.ndarray:
    """Tokens of all rows' postings, one row after another."""
    out = np.empty(sum(r["size"] for r in rows), np.uint64)
    at = 0
    for r in rows:
        np.cumsum(unpack(r["tokens"], r["size"], 6), out=out[at : at + r["size"]])
        at += r["size"]
    return out


def blob_rest(rows: list[dict], keep: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Nodes, set sizes and (if they have them) frequencies of the postings that ``keep`` marks."""
    out: list[tuple[np.ndarray, ...]] = [(np.zeros(0, np.int64), np.zeros(0, np.uint32), np.zeros(0, np.int64))]
    at = 0
    for r in rows:
        some = keep[at : at + r["size"]]
        at += r["size"]
        place = unpack(r["place"], r["size"], 4)[some].astype(np.int64)
        node = np.frombuffer(r["node"], "<i8")[place]
        n = unpack(r["n"], r["nodes"], 4).astype(np.uint32)[place]
        out.append((node, n, unpack(r["df"], r["size"], 5)[some].astype(np.int64) if r["df"] else np.zeros(0, np.int64)))
    return tuple(np.concatenate([o[k] for o in out]) for k in range(3))  # type: ignore[return-value]


def dealt(blobs: DataFrame, step: int, bucket_of: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> DataFrame:
    """Blobs of ``step`` buckets each, cut into blobs of single buckets.

    A task that dealt its postings to very many buckets at once would send a few in each
    blob. So they go to groups of buckets first, and are dealt out there, as many as a task holds at a time.
    """
    if step == 1:
        return blobs

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flat.release()
        held: list[dict] = []

        def out() -> pa.RecordBatch:
            token = blob_tokens(held)
            node, n, df = blob_rest(held, np.ones(len(token), bool))
            held.clear()
            return to_blobs(bucket_of(token, node), token, node, n, df if len(df) else None)

        for batch in batches:
            for r in pa.Table.from_batches([batch]).select(NAMES).to_pylist():
                if held and (r["bucket"] != held[0]["bucket"] or sum(h["size"] for h in held) > CHUNK):
                    yield out()
                held.append(r)
        if held:
            yield out()

    return blobs.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(run, POSTINGS)


def by_token(buckets: int, common: np.ndarray) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    """The bucket of each posting by ranges of tokens; postings of ``common`` tokens are dealt over all buckets."""

    def bucket_of(token: np.ndarray, node: np.ndarray) -> np.ndarray:
        bucket = ((token >> np.uint64(16)) * np.uint64(buckets)) >> np.uint64(32)
        hot, _ = in_sorted(common, token)
        bucket[hot] = (flat.mix(token[hot] ^ node[hot].view(np.uint64)) >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)
        return bucket.astype(np.int64)

    return bucket_of


def by_node(buckets: int) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    return lambda token, node: ((flat.mix(node.view(np.uint64)) >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def in_sorted(sorted_values: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether each value is there, and where."""
    if not len(sorted_values):
        return np.zeros(len(values), bool), np.zeros(len(values), np.int64)
    at = np.minimum(np.searchsorted(sorted_values, values), len(sorted_values) - 1)
    return sorted_values[at] == values, at


def _texts(df: DataFrame, key: str, text: str, carry: tuple[str, ...] = ()) -> DataFrame:
    return df.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"), *(F.col(c).alias(f"c{k}") for k, c in enumerate(carry)))


def sets(df: DataFrame, key: str = "doc_id", text: str = "text", width: int = 5, carry: tuple[str, ...] = ()) -> DataFrame:
    """A row for each document (key, n, node, ``carry`` columns as c0, c1, ...), and rows (token, seen) of shingles that are common within a task."""
    source = _texts(df, key, text, carry)
    fields = source.schema.fields[2:]
    names = ["key", "n", "node", "token", "seen", *(f.name for f in fields)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flat.release()
        held: list[np.ndarray] = []
        kinds: list[pa.DataType] = []
        docs = size = 0

        def common() -> Iterator[pa.RecordBatch]:
            if held:
                token, seen = np.unique(short(np.concatenate(held)), return_counts=True)
                often = np.flatnonzero(seen >= max(16, docs // 200))
                often = often[np.argsort(-seen[often], kind="stable")][: LISTED // 10]
                none = pa.nulls(len(often), pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [none, none, none, pa.array(token[often].astype(np.int64)), pa.array(seen[often]), *(pa.nulls(len(often), k) for k in kinds)],
                    names
                )

        for batch in batches:
            kinds[:] = batch.schema.types[2:]
            for lo, hi, buf, at in flat.windows(batch.column(1)):
                tokens, n = shingles(buf, at, width)
                held.append(tokens)
                docs, size = docs + hi - lo, size + len(tokens)
                none = pa.nulls(hi - lo, pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(lo, hi - lo),
                        pa.array(n.astype(np.int64)),
                        pa.array(set_hash(tokens, n), mask=n == 0),
                        none,
                        none,
                        *(c.slice(lo, hi - lo) for c in batch.columns[2:])
                    ],
                    names
                )
                if size > 2 * CHUNK:
                    yield from common()
                    held, docs, size = [], 0, 0
        yield from common()

    schema = ", ".join(["key long, n long, node long, token long, seen long", *(f"{f.name} {f.dataType.simpleString()}" for f in fields)])
    return source.mapInArrow(run, schema)


def postings(df: DataFrame, buckets: int, step: int, common, copied, key: str, text: str, width: int) -> DataFrame:
    """Blobs of the postings of all nodes, ``step`` buckets in each. ``common``: sorted tokens; ``copied``: sorted nodes and the key of the row that sends them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flat.release()
        held: list[tuple[np.ndarray, ...]] = []
        size = 0

        def out() -> pa.RecordBatch:
            token, node, n = (np.concatenate([h[k] for h in held]) for k in range(3))
            held.clear()
            return to_blobs(by_token(buckets, common.value)(token, node) // step, token, node, n, None)

        for batch in batches:
            for lo, hi, buf, at in flat.windows(batch.column(1)):
                tokens, n = shingles(buf, at, width)
                node = set_hash(tokens, n)
                keys = batch.column(0).slice(lo, hi - lo)
                nodes, senders = copied.value
                many, where = in_sorted(nodes, node)
                send = ~many
                if many.any():
                    key_of = keys.fill_null(-1).to_numpy(zero_copy_only=False)
                    send[many] = key_of[many] == senders[where[many]]
                row = np.repeat(np.arange(hi - lo), n)
                keep = send[row]
                held.append((short(tokens)[keep], node[row][keep], n[row][keep].astype(np.int64)))
                size += int(keep.sum())
                if size > CHUNK:
                    yield out()
                    size = 0
        if size:
            yield out()

    blobs = _texts(df, key, text).mapInArrow(run, POSTINGS)
    return dealt(blobs, step, lambda token, node: by_token(buckets, common.value)(token, node))


def shared(blobs: DataFrame, buckets: int, step: int, common) -> DataFrame:
    """Postings of shingles that several nodes have, with their frequencies, as blobs by node."""

    def run(table: pa.Table) -> pa.Table:
        flat.release()
        rows, (known, seen) = table.select(NAMES).to_pylist(), common.value
        token = blob_tokens(rows)
        twice = np.sort(token)
        twice = twice[1:][twice[1:] == twice[:-1]]  # most shingles have one node and end here, before nodes are unpacked
        keep = in_sorted(twice, token)[0] | in_sorted(known, token)[0]
        token, (node, n, _) = token[keep], blob_rest(rows, keep)
        order = np.lexsort((node, token))
        token, node, n = token[order], node[order], n[order]
        new = np.ones(len(token), bool)
        new[1:] = (token[1:] != token[:-1]) | (node[1:] != node[:-1])
        token, node, n = token[new], node[new], n[new]
        size = np.array([b - a for a, b in runs(token)], np.int64)
        df = np.repeat(size, size)
        hot, where = in_sorted(known, token)
        df[hot] = seen[where[hot]]
        keep = df >= 2
        token, node, n, df = token[keep], node[keep], n[keep], df[keep]
        return pa.Table.from_batches([to_blobs(by_node(buckets)(token, node) // step, token, node, n, df)])

    return dealt(blobs.groupBy("bucket").applyInArrow(run, POSTINGS), step, by_node(buckets))


def prefixes(blobs: DataFrame, percent: int) -> DataFrame:
    """Nodes that may have a partner.

    Columns: node, n, alone (how many tokens no other node has), matches (the node's l), weight
    (how rare its tokens are), tokens of the prefix from place ``alone`` on, shared (all
    tokens that other nodes have too, sorted, 6 bytes each), and bits (a map of WORDS *
    64 bits of these).
    """
    schema = "node long, n long, alone long, matches int, weight double, tokens array<long>, shared binary, bits array<long>"

    def run(table: pa.Table) -> pa.Table:
        parts = table.select(NAMES).to_pylist()
        token = blob_tokens(parts)
        node, n, df = blob_rest(parts, np.ones(len(token), bool))
        order = np.lexsort((token, df, node))
        token, node, n, df = token[order], node[order], n[order], df[order]
        rows = []
        for a, b in runs(node):
            size = int(n[a])
            need = -(-percent * size // 100)
            alone = size - (b - a)  # shingles of this node only come first
            level = np.maximum(1, alone + np.arange(b - a) - (size - need))
            if alone > size - need:
                continue
            cost = np.cumsum(df[a:b])
            reach = [int(np.searchsorted(level, k, "right")) for k in range(1, min(MOST_MATCHES, need) + 1)]
            prices = [cost[r - 1] * (1 + VERIFY / k) for k, r in enumerate(reach, 1)]
            k = int(np.argmin(prices))
            p = reach[k]
            whole = np.sort(token[a:b]).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]
            bits = np.zeros(64 * WORDS, bool)
            bits[(token[a:b] % np.uint64(64 * WORDS)).astype(np.int64)] = True
            rows.append(
                (
                    int(node[a]),
                    size,
                    alone,
                    k + 1,
                    float(np.log(df[a:b]).sum() / size),
                    token[a : a + p].astype(np.int64),
                    np.ascontiguousarray(whole).tobytes(),
                    np.packbits(bits, bitorder="little").view("<i8")
                )
            )
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.float64(), pa.list_(pa.int64()), pa.binary(), pa.list_(pa.int64())]
        return pa.Table.from_arrays(
            [pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)],
            ["node", "n", "alone", "matches", "weight", "tokens", "shared", "bits"]
        )

    return blobs.groupBy("bucket").applyInArrow(run, schema)


def intersection(x: np.ndarray, y: np.ndarray) -> int:
    """How many numbers two sorted sets share."""
    if len(x) > len(y):
        x, y = y, x
    return int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum()) if len(x) else 0


def verified(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """Of pairs (a, b, parts) of nodes those whose sets reach the threshold, as a written table.

    A node with very many partners is met in ``parts`` parts, dealt by its partner's
    hash: its set goes once to each part, and no part has to hold all its pairs.
    """
    part_of = lambda other: F.pmod(F.xxhash64(other), F.col("parts"))
    pairs = written(pairs.withColumns({"a_part": part_of("b"), "b_part": part_of("a")}), "pairs")

    def side(x: str) -> DataFrame:
        asked = pairs.select(F.col(x).alias("node"), "parts", f"{x}_part").distinct()
        found = asked.join(nodes.select("node", "n", "shared"), "node")
        return found.select(F.col("node").alias(x), "parts", f"{x}_part", F.col("n").alias(f"n_{x}"), F.col("shared").alias(f"set_{x}"))

    both = pairs.join(side("a"), ["a", "parts", "a_part"]).join(side("b"), ["b", "parts", "b_part"])

    def tokens(blob: bytes) -> np.ndarray:
        out = np.zeros((len(blob) // 6, 8), np.uint8)
        out[:, :6] = np.frombuffer(blob, np.uint8).reshape(-1, 6)
        return out.view("<u8").ravel()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = np.zeros(batch.num_rows, bool)
            columns = [batch.column(k).to_numpy() for k in range(4)]
            for k in range(batch.num_rows):
                same = intersection(tokens(batch.column(4)[k].as_buffer()), tokens(batch.column(5)[k].as_buffer()))
                keep[k] = 100 * same >= percent * (int(columns[2][k]) + int(columns[3][k]) - same)
            yield pa.RecordBatch.from_arrays([pa.array(columns[0][keep]), pa.array(columns[1][keep])], ["a", "b"])

    found = written(both.select("a", "b", "n_a", "n_b", "set_a", "set_b").mapInArrow(run, "a long, b long"), "links")
    remove(pairs)
    return found


def connected(edges: DataFrame) -> DataFrame:
    """(node, label) of all nodes of ``edges`` (a, b), a written table; the label is the component's smallest node.

    Alternating large-star and small-star steps. A step only takes minima of
    neighbourhoods, so no neighbourhood is ever gathered; each round is a written
    table, and the one before is deleted then.
    """

    def star(e: DataFrame, large: bool) -> DataFrame:
        sym = e.union(e.select("b", "a")) if large else e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = sym.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("m", "a"))
        moved = sym.join(least, "a")
        if large:
            return moved.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        return moved.select(F.col("b").alias("a"), F.col("m").alias("b")).union(moved.select("a", F.col("m").alias("b"))).where("a <> b").distinct()

    sign = lambda x: tuple(x.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
    e, before = edges, None
    while (now := sign(e)) != before:
        e, last, before = written(star(star(e, True), False), "edges"), e, now
        remove(last)
    return e.select(F.col("a").alias("node"), F.col("b").alias("label")).union(
        e.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct()
    )


#: What a node brings to a comparison, besides its name.
SIZES = ["n", "alone", "matches"]


def prefix_postings(nodes: DataFrame, *more: str) -> DataFrame:
    """(token, node, sizes, place): a row for each token of each prefix; ``place`` counts from the start of the node's order."""
    post = nodes.select("node", *SIZES, *more, F.posexplode("tokens").alias("place", "token"))
    return post.withColumn("place", F.col("alone") + F.col("place"))


def overlap_needed(percent: int) -> str:
    """What sets of n and r_n shingles share at least if they reach the threshold."""
    return f"(({percent} * (n + r_n) + {99 + percent}) div {100 + percent})"


def fits(percent: int) -> str:
    """Whether a token that two prefixes share counts for the pair: by their sizes, and by how far into each the l-th shared token can lie."""
    same = overlap_needed(percent)
    return (
        f"100 * least(n, r_n) >= {percent} * greatest(n, r_n) and least(n - alone, r_n - r_alone) >= {same}"
        f" and greatest(place - n, r_place - r_n) + {same} < least(matches, r_matches)"
    )


def enough(rows: DataFrame, parts: F.Column) -> DataFrame:
    """Pairs (a, b, parts) that share as many prefix tokens as the smaller l of the two asks for. ``rows`` has a pair once for each token."""
    pair = [F.least("node", "r_node").alias("a"), F.greatest("node", "r_node").alias("b")]
    counted = rows.groupBy(*pair).agg(
        F.count("*").alias("shared"),
        F.first(F.least("matches", "r_matches")).alias("needed"),
        F.max(parts.cast("long")).alias("parts")
    )
    return counted.where("shared >= needed").select("a", "b", "parts")


def star_pairs(nodes: DataFrame, percent: int) -> DataFrame:
    """Pairs of each node with two centres of each of its prefix tokens: the node with the rarest shingles, and one by a hash."""
    post = prefix_postings(nodes, "weight")
    columns = ["node", *SIZES, "place"]
    first = lambda order: F.max(F.struct(order, *columns))
    heads = post.groupBy("token").agg(
        F.count("*").alias("c"),
        first(F.col("weight").alias("o")).alias("x"),
        first(F.xxhash64("token", "node").alias("o")).alias("y")
    ).where("c > 1")
    bare = lambda s: F.struct(*(F.col(f"{s}.{c}").alias(c) for c in columns))
    heads = heads.select("token", "c", F.col("x.node").alias("head"), F.array_distinct(F.array(bare("x"), bare("y"))).alias("centres"))
    # a row of the first centre itself brings nothing: the second one's row has that pair
    met = post.join(heads, "token").where("node <> head").select("token", "c", *columns, F.explode("centres").alias("r"))
    met = met.select("c", *columns, *(F.col(f"r.{c}").alias(f"r_{c}") for c in columns)).where("node <> r_node").where(fits(percent))
    return enough(met, F.ceil(F.col("c") / BLOCK))


def block_pairs(known: DataFrame, percent: int) -> DataFrame:
    """Pairs of nodes with a common prefix token that lie in different components (``label``).

    For each token all nodes outside its largest component meet all nodes. Both sides
    are dealt into blocks of about BLOCK rows and meet block by block, so no token's
    rows come together in one task; pairs that sizes, places or the maps of
    shingles rule out are never rows.
    """
    post = prefix_postings(known, "label", "bits")
    groups = post.groupBy("token", "label").agg(F.count("*").alias("c")).groupBy("token")
    groups = groups.agg(F.max(F.struct("c", "label")).alias("top"), F.sum("c").alias("all"), F.count("*").alias("k")).where("k > 1")
    blocks = lambda n: F.ceil(n / BLOCK).cast("int")
    groups = groups.select(
        "token",
        F.col("top.label").alias("main"),
        blocks(F.col("all") - F.col("top.c")).alias("lefts"),
        blocks(F.col("all")).alias("rights")
    )
    rows = post.join(groups, "token")
    place = lambda n: F.pmod(F.xxhash64("node"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    columns = ["node", *SIZES, "place", "label", "bits"]
    left = rows.where("label <> main").select("token", *columns, "main", "rights", place("lefts").alias("l"), every("rights").alias("r"))
    right = rows.select("token", *(F.col(c).alias(f"r_{c}") for c in columns), place("rights").alias("r"), every("lefts").alias("l"))
    # each bit that one map has over the other is a shingle that the other set lacks
    over = lambda x, y: " + ".join(f"bit_count({x}[{k}] & ~{y}[{k}])" for k in range(WORDS))
    same = overlap_needed(percent)
    near = f"n - alone - ({over('bits', 'r_bits')}) >= {same} and r_n - r_alone - ({over('r_bits', 'bits')}) >= {same}"
    met = left.join(right, ["token", "l", "r"]).where("label <> r_label and (r_label = main or node < r_node)").where(fits(percent)).where(near)
    return enough(met, F.col("rights"))


def links(nodes: DataFrame, percent: int) -> DataFrame:
    """(node, label) of the components of all nodes that are linked with another node."""
    labels = connected(verified(star_pairs(nodes, percent), nodes, percent))
    known = nodes.select("node", *SIZES, "tokens", "bits").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    known = written(known, "known")
    new = verified(block_pairs(known, percent), nodes, percent)
    remove(known)
    if new.isEmpty():
        return labels
    edges = new.union(labels.select(F.col("node").alias("a"), F.col("label").alias("b")).where("a <> b"))
    return connected(written(edges, "edges"))


def members(df: DataFrame, text: str = "text", key: str = "doc_id", width: int = 5, percent: int = 75, carry: tuple[str, ...] = ()) -> DataFrame:
    """``key``, n_shingles, component_id, ``component`` (a number of the component's own, null for empty sets) and the ``carry`` columns of each row."""
    spark: SparkSession = df.sparkSession
    sc = spark.sparkContext
    told = written(sets(df, key, text, width, carry), "sets")
    docs = told.where("n is not null").drop("token", "seen")
    common = told.where("token is not null").groupBy("token").agg(F.sum("seen").alias("seen")).orderBy(F.desc("seen"), "token").limit(LISTED).toPandas().sort_values("token")
    groups = docs.where("node is not null").groupBy("node").agg(F.min("key").alias("least"), F.count("*").alias("copies"), F.max("n").alias("n"))
    groups = written(groups, "groups")
    copied = groups.where("copies >= 32").orderBy(F.desc("copies"), "node").limit(LISTED).toPandas().sort_values("node")
    tokens = common["token"].to_numpy(np.int64).view(np.uint64)
    known = sc.broadcast(tokens)
    frequent = sc.broadcast((tokens, common["seen"].to_numpy(np.int64)))
    senders = sc.broadcast((copied["node"].to_numpy(np.int64), copied["least"].fillna(-1).to_numpy(np.int64)))
    sent = (groups.agg(F.sum(F.col("copies") * F.col("n"))).first()[0] or 0) - int(((copied["copies"] - 1) * copied["n"]).sum())
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-sent // RANGE))
    step = -(-buckets // FAN)
    blobs = postings(df, buckets, step, known, senders, key, text, width)
    nodes = written(prefixes(shared(blobs, buckets, step, frequent), percent), "nodes")
    labels = links(nodes, percent)
    remove(nodes)
    named = labels.join(groups, "node").select("node", "label", "least")
    named = named.join(named.groupBy("label").agg(F.min("least").alias("first")), "label").select("node", "label", "first")
    of_node = groups.join(named, "node", "left").select(
        "node",
        F.coalesce("first", "least").alias("first"),
        F.coalesce("label", "node").alias("component")
    )
    # written, so that both sides of the last join come straight from shuffles: adaptive execution can split those at a text with very many copies
    of_node = written(of_node, "members")
    remove(groups)
    return docs.join(of_node, "node", "left").select(
        F.col("key").alias(key),
        F.col("n").alias("n_shingles"),
        F.coalesce("first", "key").alias("component_id"),
        "component",
        *(F.col(f"c{k}").alias(c) for k, c in enumerate(carry))
    )


def components(df: DataFrame, text: str = "text", key: str = "doc_id", width: int = 5, percent: int = 75) -> DataFrame:
    """``key``, n_shingles and component_id of each document."""
    return members(df, text, key, width, percent).select(key, "n_shingles", "component_id")


def oracle(width: int = 5, percent: int = 75) -> str:
    """The same in DuckDB's SQL, by all shared shingles and a recursive closure; for small tables."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return f"""
    WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{lower}'), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
    s AS (SELECT DISTINCT doc_id, array_to_string(ws[i : i + {width - 1}], ' ') AS g FROM w, unnest(range(1, greatest(len(ws) - {width - 2}, 2))) AS t(i) WHERE len(ws) > 0),
    n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
    c AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY 1, 2),
    l AS (SELECT a, b FROM c JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * k >= {percent} * (p.n + q.n - k)),
    r(a, b) AS (SELECT a, a FROM l UNION SELECT r.a, l.b FROM r JOIN l ON l.a = r.b),
    m AS (SELECT a, min(b) AS least FROM r GROUP BY 1)
    SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, coalesce(least, doc_id) AS component_id FROM documents LEFT JOIN n USING (doc_id) LEFT JOIN m ON a = doc_id"""
