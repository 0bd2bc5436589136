"""Product codes of vectors: Lloyd's rounds over partition-local cover trees.

Components become whole numbers, floor(scale * x). Vectors are cut into equal consecutive
parts; each part has a codebook, and a vector's code is the number of the nearest entry in each.

1.  *Trees.* One pass cuts the rows of each task into blocks and builds a cover tree for each part
    of a block: a node has a centre among its points, the children's centres lie within half its reach of
    their points and farther than that from each other, and a node's own centre is its first child's.
    A node keeps its points' radius, number and component sums, and its points lie in one run of an order.
    Trees don't depend on codebooks: they are written once as a row for each block.
2.  *Rounds.* A node whose centre is nearer to one entry than to any other by more than twice its radius gives all its
    points to that entry (triangle inequality) through its sums; other nodes hand the question to their
    children, and leaves compare point by point in whole numbers, ties to the lower entry. Tasks add up
    their blocks, so a round shuffles one row for each task, part and entry.
3.  *Codes.* The last round tells each point's entry and its squared distance.

All sums are in whole numbers, so results don't depend on partitions. The driver holds the codebooks alone.

Rows whose vector is null or holds null or non-finite components take no part, nor do empty vectors. Rows with
a null key are coded like others but found no codebook; repeated keys and rows count each, among equal keys the smaller vector
first. Fewer rows than entries give smaller codebooks. An empty table gives one. Vectors of different lengths, a length that parts don't
divide, and components beyond 2**26 after scaling raise an error. Other columns are not carried.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from readweave.llm import flat
from readweave.llm.ann import matrix
from readweave.session import remove, written

#: Rows of a block, points of a leaf, and the largest component.
BLOCK, LEAF, LARGEST = 4096, 16, 1 << 26
_NODE = np.dtype([("centre", "<i4"), ("first", "<i4"), ("end", "<i4"), ("child", "<i4"), ("children", "<i4"), ("radius", "<f8")])


@dataclass
class Tree:
    """Nodes in breadth-first order; a node's points are order[first:end], its children ``children`` nodes from ``child`` on."""

    nodes: np.ndarray
    order: np.ndarray
    sums: np.ndarray

    @classmethod
    def of(cls, x: np.ndarray) -> Tree:
        n, order, nodes = len(x), np.arange(len(x), dtype=np.int32), []
        reach = _distances(x, x[0])
        waiting = [(0, 0, n, float(reach.max()), reach)]  # centre, points, what they may lie off the centre, what they do
        while waiting:
            later = []
            for centre, first, end, most, off in waiting:
                radius = float(off.max())
                node = [centre, first, end, 0, 0, radius]
                nodes.append(node)
                if end - first <= LEAF or radius == 0:
                    continue
                most = min(most, radius) / 2
                left, parts = order[first:end], []
                while len(left):
                    near = off <= most
                    parts.append((centre, left[near], off[near]))
                    left = left[~near]
                    if len(left):
                        centre, off = int(left[0]), _distances(x[left], x[left[0]])
                node[4] = len(parts)
                order[first:end] = np.concatenate([p for _, p, _ in parts])
                for child, points, own in parts:
                    later.append((child, first, first + len(points), most, own))
                    first += len(points)
            at = len(nodes)
            for node in nodes[len(nodes) - len(waiting) :]:
                node[3], at = at, at + node[4]
            waiting = later
        made = np.array([tuple(v) for v in nodes], _NODE)
        before = np.concatenate([np.zeros((1, x.shape[1]), np.int64), np.cumsum(x[order], axis=0)])
        return cls(made, order, before[made["end"]] - before[made["first"]])


def _distances(x: np.ndarray, centre: np.ndarray) -> np.ndarray:
    return np.sqrt(((x - centre) ** 2).sum(axis=1).astype(np.float64))


def _squares(x: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Squared distances of all points to all entries, in whole numbers."""
    return (x * x).sum(axis=1)[:, None] - 2 * (x @ entries.T) + (entries * entries).sum(axis=1)


def assign(tree: Tree, x: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Each point's nearest entry, each entry's number of points and their sums; and how many points were compared one by one."""
    own, count, sums = np.zeros(len(x), np.int32), np.zeros(len(entries), np.int64), np.zeros(entries.shape, np.int64)
    front, alone = np.zeros(1, np.int64), [np.zeros(0, np.int64)]
    while len(front):
        node = tree.nodes[front]
        d = np.sqrt(_squares(x[node["centre"]], entries).astype(np.float64))
        best = d.argmin(axis=1)
        nearest = d[np.arange(len(d)), best]
        d[np.arange(len(d)), best] = np.inf
        apart = d.min(axis=1) - nearest - 2 * node["radius"]
        sure = apart > 1e-9 * (1 + nearest + node["radius"])
        size = (node["end"] - node["first"]).astype(np.int64)
        own[tree.order[flat.ranges(node["first"][sure].astype(np.int64), size[sure])]] = np.repeat(best[sure], size[sure])
        np.add.at(count, best[sure], size[sure])
        np.add.at(sums, best[sure], tree.sums[front[sure]])
        leaf = ~sure & (node["children"] == 0)
        alone.append(tree.order[flat.ranges(node["first"][leaf].astype(np.int64), size[leaf])])
        more = node[~sure & ~leaf]
        front = flat.ranges(more["child"].astype(np.int64), more["children"].astype(np.int64))
    alone = np.concatenate(alone)
    for lo in range(0, len(alone), BLOCK):
        some = alone[lo : lo + BLOCK]
        own[some] = _squares(x[some], entries).argmin(axis=1)
    np.add.at(count, own[alone], 1)
    np.add.at(sums, own[alone], x[alone])
    return own, count, sums, len(alone)


def _blocks(rows: DataFrame, parts: int, scale: int) -> DataFrame:
    """(ids, labels, points, sizes, nodes, orders, sums): a row for each block, with its trees part after part."""
    names = ["ids", "labels", "points", "sizes", "nodes", "orders", "sums"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, BLOCK):
                some = batch.slice(lo, BLOCK)
                scaled = np.floor(scale * matrix(some.column(2)))
                if np.abs(scaled).max(initial=0) > LARGEST:
                    raise ValueError(f"a component is beyond {LARGEST} after scaling")
                x = scaled.astype(np.int64)
                trees = [Tree.of(np.ascontiguousarray(p)) for p in np.split(x, parts, axis=1)]
                one = lambda a: pa.ListArray.from_arrays(pa.array([0, len(a)], pa.int32()), a)
                yield pa.RecordBatch.from_arrays(
                    [
                        one(some.column(0)), one(some.column(1)), pa.array([x.astype("<i4").tobytes()]), pa.array([[len(t.nodes) for t in trees]], pa.list_(pa.int32())),
                        *(pa.array([b"".join(getattr(t, c).tobytes() for t in trees)]) for c in ("nodes", "order", "sums"))
                    ],
                    names
                )

    kinds = dict(rows.dtypes)
    schema = f"ids array<{kinds['id']}>, labels array<{kinds['label']}>, points binary, sizes array<int>, nodes binary, orders binary, sums binary"
    return rows.select("id", "label", "v").mapInArrow(run, schema)


def _trees(batch: pa.RecordBatch, k: int, parts: int) -> Iterator[tuple[np.ndarray, Tree]]:
    """(points, tree) of the parts of the k-th block of a batch."""
    part = lambda name: batch.column(name)[k].as_buffer()
    n = len(batch.column("ids")[k])
    x = np.frombuffer(part("points"), "<i4").reshape(n, -1).astype(np.int64)
    sizes = np.array(batch.column("sizes")[k].as_py())
    nodes, orders = np.split(np.frombuffer(part("nodes"), _NODE), np.cumsum(sizes)[:-1]), np.frombuffer(part("orders"), "<i4").reshape(parts, n)
    sums = np.split(np.frombuffer(part("sums"), "<i8").reshape(int(sizes.sum()), -1), np.cumsum(sizes)[:-1])
    for p, own in enumerate(np.split(x, parts, axis=1)):
        yield np.ascontiguousarray(own), Tree(nodes[p], orders[p], sums[p])


def improved(blocks: DataFrame, books: np.ndarray) -> np.ndarray:
    """The codebooks (parts, entries, width) after a round: each entry the floored mean of its parts; unused ones stay."""
    parts, entries, width = books.shape
    names = ["part", "entry", "n", *(f"s{k}" for k in range(width))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, total = np.zeros((parts, entries), np.int64), np.zeros(books.shape, np.int64)
        for batch in batches:
            for k in range(batch.num_rows):
                for p, (x, tree) in enumerate(_trees(batch, k, parts)):
                    _, n, sums, _ = assign(tree, x, books[p])
                    count[p] += n
                    total[p] += sums
        part, entry = np.nonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in (part, entry, count[part, entry], *total[part, entry].T)], names)

    summed = blocks.mapInArrow(run, ", ".join(f"{c} long" for c in names)).groupBy("part", "entry").agg(*(F.sum(c).alias(c) for c in names[2:]))
    out = books.copy()
    for r in summed.collect():  # a row for each entry of the codebooks
        out[r["part"], r["entry"]] = [r[c] // r["n"] for c in names[3:]]
    return out


def _coded(blocks: DataFrame, books: np.ndarray) -> DataFrame:
    parts = len(books)
    kinds = dict(blocks.dtypes)
    element = lambda c: kinds[c].removeprefix("array<").removesuffix(">")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                ids, labels = batch.column("ids")[k].values, batch.column("labels")[k].values
                code, error = np.zeros((len(ids), parts), np.uint8), np.zeros(len(ids), np.int64)
                for p, (x, tree) in enumerate(_trees(batch, k, parts)):
                    code[:, p] = own = assign(tree, x, books[p])[0]
                    error += ((x - books[p][own]) ** 2).sum(axis=1)
                spelt = code.tobytes().hex()
                width = 2 * parts
                yield pa.RecordBatch.from_arrays(
                    [ids, labels, pa.array([spelt[a : a + width] for a in range(0, len(spelt), width)], pa.string()), pa.array(error)], ["id", "label", "code", "error"]
                )

    return blocks.mapInArrow(run, f"id {element('ids')}, label {element('labels')}, code string, error long")


def compress(df: DataFrame, parts: int = 16, entries: int = 64, rounds: int = 2, scale: int = 256, key: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """(``key``, code, error, label_error, codebooks_sha256) of each row that takes part.

    Codebooks begin with the vectors of the smallest keys. ``code``: two hexadecimal digits a part; ``error``: squared distances over all
    parts; ``label_error``: errors summed over rows with the same label, nulls together; the digest is of the final codebooks' components, joined by commas.
    """
    if not 1 <= entries <= 256:
        raise ValueError("a codebook has from 1 to 256 entries")
    v = F.col("v")
    sound = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = df.select(F.col(key).alias("id"), F.col(label).alias("label"), F.col(vector).alias("v")).where("v is not null and size(v) > 0").where(sound)
    least, most = rows.agg(F.min(F.size("v")), F.max(F.size("v"))).first()
    if least is None:
        none = rows.select("id", F.lit("").alias("code"), *(F.lit(0).cast("long").alias(c) for c in ("error", "label_error")), F.lit("").alias("codebooks_sha256"))
        return none.limit(0).withColumnRenamed("id", key)
    if least != most or least % parts:
        raise ValueError(f"vectors must have one length that {parts} divides; they have from {least} to {most}")
    first = rows.where("id is not null").orderBy("id", "v").limit(entries).collect() or rows.orderBy("v").limit(entries).collect()
    start = np.floor(scale * np.array([r["v"] for r in first], np.float64)).astype(np.int64)
    books = np.stack(np.split(start, parts, axis=1))
    blocks = written(_blocks(rows, parts, scale), "trees")
    for _ in range(rounds):
        books = improved(blocks, books)
    coded = written(_coded(blocks, books), "codes")
    remove(blocks)
    digest = hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
    errors = coded.groupBy(F.col("label").alias("same")).agg(F.sum("error").alias("label_error"))
    told = coded.join(errors, F.col("label").eqNullSafe(F.col("same")))
    return told.select(F.col("id").alias(key), "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


def oracle(parts: int = 16, entries: int = 64, rounds: int = 2, scale: int = 256) -> str:
    """The same in SQL over ``embeddings``."""
    steps, book = [], "b0"
    far = "list_sum(list_transform(list_zip(x, c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
    for k in range(rounds + 1):
        near = f"""n{k} AS MATERIALIZED (
            SELECT vec_id, label, p.part, x, arg_min(entry, (far, entry)) AS entry, min(far) AS far
            FROM (SELECT p.vec_id, p.label, p.part, x, entry, {far} AS far FROM parts p JOIN {book} b ON b.part = p.part) p GROUP BY 1, 2, 3, 4
        )"""
        steps.append(near)
        if k < rounds:
            steps.append(
                f"""b{k + 1} AS MATERIALIZED (
            SELECT b.part, b.entry, coalesce(m.c, b.c) AS c FROM {book} b LEFT JOIN (
                SELECT part, entry, list(floor(s::DOUBLE / n)::BIGINT ORDER BY i) AS c
                FROM (SELECT part, entry, i, sum(x[i])::BIGINT AS s, count(*) AS n FROM n{k}, unnest(range(1, len(x) + 1)) AS t(i) GROUP BY 1, 2, 3) GROUP BY 1, 2
            ) m ON m.part = b.part AND m.entry = b.entry
        )"""
            )
            book = f"b{k + 1}"
    return f"""WITH kept AS (
            SELECT vec_id, label, list_transform(embedding, lambda v: floor({scale} * v::DOUBLE)::BIGINT) AS x FROM embeddings
            WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda v: v IS NULL OR NOT isfinite(v))) = 0
        ),
        parts AS MATERIALIZED (
            SELECT vec_id, label, part, x[part * (len(x) // {parts}) + 1 : (part + 1) * (len(x) // {parts})] AS x FROM kept, unnest(range(0, {parts})) AS t(part)
        ),
        firsts AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS entry FROM kept ORDER BY vec_id LIMIT {entries}),
        b0 AS MATERIALIZED (SELECT part, entry, x AS c FROM parts JOIN firsts USING (vec_id)),
        {", ".join(steps)},
        digest AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM {book}),
        codes AS (
            SELECT vec_id, label, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, sum(far)::BIGINT AS error FROM n{rounds} GROUP BY 1, 2
        )
        SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, codebooks_sha256 FROM codes, digest"""
