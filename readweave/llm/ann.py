"""Approximate nearest neighbours by inner product: cross-polytope hashing with multiprobe tables.

Vectors are scaled to unit length (or, where their norms differ, lifted to it by one
more coordinate, which turns the largest inner product into the smallest angle).
Each table turns them by pseudo-rotations - three rounds of random signs and a fast
Hadamard transform each - and files them under the nearest signed axes of as many rotations as
it takes for cells of ROWS vectors or fewer on average: the number of
cells grows with the rows. A query probes, in each table, all cells whose axes together
lie within a penalty of its own nearest ones: the sum over the rotations of the squared
gaps between its largest coordinate and the one on the cell's axis. What it meets
is ranked by the exact inner product of the original vectors.

The penalty comes from the data: a bounded sample of queries is compared with all
rows, and it is the least that finds the share ``aim`` of their true neighbours. The
sample also gives a floor: the score, for a query of length 1, that all but a small
share of its queries reach with all k neighbours. What scores less isn't brought together.
Queries that meet too few rows above it are compared with all, so the floor loses nothing.

Vectors move once a table, to the group of cells that agree in the outer rotations: as few as
leave groups of SPAN blocks, none for small tables. A query goes to the groups within its penalty, and there only to the cells
that what is left of it reaches. Groups
are dealt in blocks, by their counted sizes, so no task has to hold all of a popular one.
Equal vectors are one entry with its smallest ids, as many as any answer can use, so
copies cost nothing. Vectors that are null, empty, zero, or hold nulls or non-finite
components take no part, nor do null ids. Vectors of each length are searched among
their own. Repeated rows count once; a query never meets rows of
its own id. Ties go to the smaller id. Other columns are not carried.
"""

from __future__ import annotations

import dataclasses
import functools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from readweave.session import remove, written

SAMPLE = 64
#: Share of the sample's queries whose last neighbour lies below the floor.
FLOORED = 0.02
#: Vectors of a cell, on average, at most; rows and queries of a group that meet in one task.
ROWS, BLOCK, QUERY_BLOCK = 64, 8_000, 4_000
#: Blocks of a group, on average, at most. A query's vector goes to each block of each group within its penalty: with few
#: large groups that is fewer copies than with very many small ones.
SPAN = 32


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of rows whose length is a power of two, keeping their norms."""
    n, d = x.shape
    step = 1
    while step < d:
        y = x.reshape(n, d // (2 * step), 2, step)
        x = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], axis=2).reshape(n, d)
        step *= 2
    return x / np.sqrt(d)


@dataclass(frozen=True)
class Tables:
    """``dimensions`` of the vectors, ``largest`` norm of all, ``lift``: norms differ; ``rotations`` in a table, of which the first ``outer`` name a group."""

    dimensions: int
    largest: float
    lift: bool
    tables: int
    rotations: int = 1
    outer: int = 0
    seed: int = 11

    def for_rows(self, rows: int) -> Tables:
        """With cells of ROWS vectors on average, or fewer, and groups of SPAN blocks, or fewer."""
        rotations, outer = 1, 0
        while (2 * self.axes) ** rotations * ROWS < rows:
            rotations += 1
        while (2 * self.axes) ** outer * SPAN * BLOCK < rows:
            outer += 1
        return dataclasses.replace(self, rotations=max(rotations, outer + 1), outer=outer)

    @property
    def axes(self) -> int:
        return 1 << int(np.ceil(np.log2(max(self.dimensions + self.lift, 2))))

    def unit(self, x: np.ndarray, query: bool) -> np.ndarray:
        norm = np.linalg.norm(x, axis=1, keepdims=True)
        out = np.zeros((len(x), self.axes))
        out[:, : self.dimensions] = x / (norm if query or not self.lift else self.largest)
        if self.lift and not query:
            out[:, self.dimensions] = np.sqrt(np.maximum(0, 1 - (norm[:, 0] / self.largest) ** 2))
        return out

    def turned(self, unit: np.ndarray, table: int, rotation: int) -> np.ndarray:
        rng = np.random.default_rng([self.seed, table, rotation])
        for _ in range(3):
            unit = hadamard(unit * rng.choice([-1.0, 1.0], self.axes))
        return unit

    def nearest(self, unit: np.ndarray, table: int, rotation: int) -> np.ndarray:
        """The nearest signed axis: twice its number, and one more for the negative side."""
        y = self.turned(unit, table, rotation)
        axis = np.abs(y).argmax(axis=1)
        return 2 * axis + (y[np.arange(len(y)), axis] < 0)

    def penalties(self, unit: np.ndarray, table: int, rotation: int) -> np.ndarray:
        """What each signed axis costs a query: the squared gap to its nearest one."""
        y = self.turned(unit, table, rotation)
        y = np.stack([y, -y], axis=2).reshape(len(y), -1)
        return (y.max(axis=1, keepdims=True) - y) ** 2

    def filed(self, unit: np.ndarray, table: int) -> tuple[np.ndarray, np.ndarray]:
        """Each vector's group (the outer rotations and the table) and its cell there: the axes of the other rotations as digits."""
        group, cell = np.zeros(len(unit), np.int64), np.zeros(len(unit), np.int64)
        for k in range(self.outer):
            group = group * 2 * self.axes + self.nearest(unit, table, k)
        for k in range(self.outer, self.rotations):
            cell = cell * 2 * self.axes + self.nearest(unit, table, k)
        return group * self.tables + table, cell

    def digits(self, cell: np.ndarray) -> list[np.ndarray]:
        """The axes that a cell stands for, one for each rotation after the outer ones."""
        out = []
        for _ in range(self.outer, self.rotations):
            cell, axis = np.divmod(cell, 2 * self.axes)
            out.append(axis)
        return out[::-1]

    def probed(self, unit: np.ndarray, table: int, most: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row of ``unit``, group, what is left of the penalty ``most``) of all groups within it."""
        row, group, left = np.arange(len(unit)), np.zeros(len(unit), np.int64), np.full(len(unit), most)
        for k in range(self.outer):
            cost = self.penalties(unit, table, k)
            rows, groups, rest = [], [], []
            for lo in range(0, len(row), 4096):
                after = left[lo : lo + 4096, None] - cost[row[lo : lo + 4096]]
                a, axis = np.nonzero(after >= 0)
                rows.append(row[lo + a])
                groups.append(group[lo + a] * 2 * self.axes + axis)
                rest.append(after[a, axis])
            row, group, left = np.concatenate(rows), np.concatenate(groups), np.concatenate(rest)
        return row, group * self.tables + table, left


def matrix(column: pa.Array) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return pc.list_flatten(column).to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def lists(x: np.ndarray, like: pa.DataType) -> pa.Array:
    offsets = pa.array(np.arange(0, x.size + 1, max(x.shape[1], 1), dtype=np.int32))
    return pa.ListArray.from_arrays(offsets, pa.array(x.ravel()).cast(like))


def products(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Inner products row by row, each summed in the same order wherever it stands."""
    return (x * y).sum(axis=1)


def top(s: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """For each row of scores its k largest and all that tie with the last: (row, column); minus infinity stands for nothing."""
    few = s.shape[1] <= k or (s > -np.inf).sum(axis=1).max(initial=0) <= k
    bar = np.full(len(s), -np.inf) if few else np.partition(s, s.shape[1] - k, axis=1)[:, s.shape[1] - k]
    bar = np.where(np.isfinite(bar), bar - 1e-9 * (1 + np.abs(bar)), np.finfo(np.float64).min)
    return np.nonzero(s >= bar[:, None])


def best(q: np.ndarray, x: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each row of q its k best rows of x and all that tie with the last: (row of q, row of x, score)."""
    a, b = top(q @ x.T, k)
    return a, b, products(q[a], x[b])


def sound_rows(df: DataFrame, vector: str, key: str) -> DataFrame:
    """(id, v) of the rows that take part."""
    v = F.col("v")
    sound = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    return df.select(
        F.col(key).cast("long").alias("id"),
        F.col(vector).alias("v")
    ).where("id is not null and v is not null and size(v) > 0").where(sound)


def entries(rows: DataFrame, d: int, k: int) -> DataFrame:
    """(entry, v, ids): distinct vectors of length d, named by their smallest id, with their k + 1 smallest ids."""
    first = rows.where(F.size("v") == d).distinct().withColumn(
        "place",
        F.row_number().over(Window.partitionBy("v").orderBy("id"))
    ).where(F.col("place") <= k + 1)
    return first.groupBy("v").agg(F.min("id").alias("entry"), F.sort_array(F.collect_set("id")).alias("ids"))


def settings(index: DataFrame, queries: DataFrame, t: Tables, k: int, aim: float, asked: int) -> tuple[float, float]:
    """The penalty to probe within and the floor of scores, from at most SAMPLE of the ``asked`` queries against all entries."""
    share = min(1.0, 4 * SAMPLE / asked)  # a threshold first: else each partition would send SAMPLE vectors to the driver
    picked = queries.where(F.pmod(F.xxhash64("entry"), F.lit(1 << 50)) < int(share * (1 << 50)))
    sample = picked.orderBy(F.xxhash64("entry")).limit(SAMPLE).select("entry", "v").collect()
    if not sample:
        return np.inf, -np.inf
    q, names = np.array([list(r["v"]) for r in sample], np.float64), np.array([r["entry"] for r in sample])
    unit_q = t.unit(q, True)
    cost = [[t.penalties(unit_q, i, r) for r in range(t.rotations)] for i in range(t.tables)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, BLOCK):
                x = matrix(batch.column(1).slice(lo, BLOCK))
                a, b, s = best(q, x, k + 1)
                own = names[a] == batch.column(0).slice(lo, BLOCK).to_numpy()[b]
                a, b, s = a[~own], b[~own], s[~own]
                near, where = np.unique(b, return_inverse=True)
                unit = t.unit(x[near], False)
                need = [sum(cost[i][r][a, t.nearest(unit, i, r)[where]] for r in range(t.rotations)) for i in range(t.tables)]
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(s), pa.array(np.min(need, axis=0))], ["q", "score", "need"])

    near = index.select("entry", "v").mapInArrow(run, "q long, score double, need double")
    ranked = near.withColumn("r", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "need"))).where(F.col("r") <= k)
    found = ranked.select("q", "r", "score", "need").collect()  # at most SAMPLE * k rows
    if not found:
        return np.inf, -np.inf
    norm = np.linalg.norm(q, axis=1)
    last = np.array([r["score"] / norm[r["q"]] for r in found if r["r"] == k])
    floor = float(np.quantile(last, FLOORED)) if len(last) == len(q) else -np.inf
    return float(np.quantile([r["need"] for r in found], aim)) * (1 + 1e-9), floor - 1e-9 * abs(floor) if np.isfinite(floor) else floor


def met(index: DataFrame, queries: DataFrame, t: Tables, most: float, floor: float, k: int) -> DataFrame:
    """(q, entry, score): for each query's entry the best of what its probes meet above the floor."""
    kind = dict(index.dtypes)["v"]
    like = pa.float32() if "float" in kind else pa.float64()

    def deal(query: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for lo in range(0, batch.num_rows, 512):
                    name, x = batch.column(0).slice(lo, 512).to_numpy(), matrix(batch.column(1).slice(lo, 512))
                    unit = t.unit(x, query)
                    for table in range(t.tables):
                        if query:
                            row, group, more = t.probed(unit, table, most)
                        else:
                            row, (group, more) = np.arange(len(x)), t.filed(unit, table)
                        for at in range(0, len(row), 8192):
                            part = slice(at, at + 8192)
                            yield pa.RecordBatch.from_arrays(
                                [pa.array(group[part]), pa.array(name[row[part]]), pa.array(more[part]), lists(x[row[part]], like)],
                                ["group", "name", "more", "v"]
                            )

        return run

    left = queries.select("entry", "v").mapInArrow(deal(True), f"group long, name long, more double, v {kind}")
    right = index.select("entry", "v").mapInArrow(deal(False), f"group long, name long, more long, v {kind}")
    count = lambda rows, size, name: rows.groupBy("group").agg(F.ceil(F.count("*") / size).cast("int").alias(name))
    blocks = written(count(left, QUERY_BLOCK, "lefts").join(count(right, BLOCK, "rights"), "group"), "blocks")
    mine = lambda n: F.pmod(F.xxhash64("name"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = left.join(blocks, "group").select("group", mine("lefts").alias("l"), every("rights").alias("r"), "name", "more", "v")
    right = right.join(blocks, "group").select("group", every("lefts").alias("l"), mine("rights").alias("r"), "name", "more", "v")

    def rank(q: pa.Table, x: pa.Table) -> pa.Table:
        out: list[tuple[np.ndarray, ...]] = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        if q.num_rows and x.num_rows:
            table, cell = q["group"][0].as_py() % t.tables, x["more"].to_numpy()
            order = np.argsort(cell, kind="stable")
            first, *others = t.digits(cell[order])
            rows, names, edge = matrix(x["v"])[order], x["name"].to_numpy()[order], np.searchsorted(first, np.arange(2 * t.axes + 1))
            for lo in range(0, q.num_rows, 256):
                part = q.slice(lo, 256)
                asking = matrix(part["v"])
                unit, left = t.unit(asking, True), part["more"].to_numpy()[:, None]
                rest = left - t.penalties(unit, table, t.outer)
                costs = [t.penalties(unit, table, k) for k in range(t.outer + 1, t.rotations)]
                s = np.full((len(asking), len(rows)), -np.inf)
                for c in np.flatnonzero(edge[1:] > edge[:-1]).tolist():
                    who, own = np.flatnonzero(rest[:, c] >= 0), slice(edge[c], edge[c + 1])
                    if len(who):
                        met = asking[who] @ rows[own].T
                        if costs:
                            met[sum(cost[who][:, axis[own]] for cost, axis in zip(costs, others, strict=True)) > rest[who, c][:, None]] = -np.inf
                        s[who, own] = met
                s[s < floor * np.linalg.norm(asking, axis=1)[:, None]] = -np.inf
                a, b = top(s, k + 1)
                out.append((part["name"].to_numpy()[a], names[b], products(asking[a], rows[b])))
        return pa.table([np.concatenate([o[i] for o in out]) for i in range(3)], ["q", "entry", "score"])

    keys = ["group", "l", "r"]
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(rank, "q long, entry long, score double")


def search(
    df: DataFrame,
    query: F.Column,
    vector: str = "embedding",
    key: str = "vec_id",
    k: int = 20,
    tables: int = 8,
    aim: float = 0.96
) -> DataFrame:
    """query_id, rank, ``key``, score: for each row that ``query`` marks (a condition on ``key``) its k nearest rows found, nearest first."""
    rows, schema = sound_rows(df, vector, key), f"query_id long, rank int, `{key}` long, score double"
    lengths = sorted(r["d"] for r in rows.withColumnRenamed("id", key).where(query).select(F.size("v").alias("d")).distinct().collect())
    found = [of_length(df, rows, d, query, vector, key, k, tables, aim) for d in lengths]
    if not found:
        return df.sparkSession.createDataFrame([], schema)
    if len(found) == 1:
        return found[0]
    both = functools.reduce(DataFrame.unionByName, found).groupBy("query_id", key).agg(F.max("score").alias("score"))  # an id may have vectors of several lengths
    return both.withColumn(
        "rank",
        F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), key))
    ).where(F.col("rank") <= k).select("query_id", "rank", key, "score")


def of_length(df: DataFrame, rows: DataFrame, d: int, query: F.Column, vector: str, key: str, k: int, tables: int, aim: float) -> DataFrame:
    """``search`` among the vectors of length d, of which some are asked for."""
    out_names = ["query_id", "rank", key, "score"]
    spark = df.sparkSession
    index = written(entries(rows, d, k), "entries")
    v = F.transform("v", lambda x: x.cast("double"))
    norms = index.agg(
        F.max(F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x))).alias("hi"),
        F.min(F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x))).alias("lo"),
        F.count("*").alias("n")
    ).first()
    t = Tables(d, float(norms["hi"]), norms["lo"] < norms["hi"] * (1 - 1e-5), tables).for_rows(norms["n"])
    asking = df.select(
        F.col(key).cast("long").alias(key),
        F.col(vector).alias("v")
    ).where(query).where(F.size("v") == d).select(F.col(key).alias("query_id"), "v").distinct()
    asking = written(asking.join(index.select("v", "entry"), "v").select("query_id", F.col("entry").alias("q")), "asking")
    queries = written(index.join(asking.select(F.col("q").alias("entry")).distinct(), "entry", "left_semi").select("entry", "v"), "queries")
    asked = queries.count()
    if not asked:
        return spark.createDataFrame([], f"query_id long, rank int, `{key}` long, score double")
    most, floor = settings(index, queries, t, k, aim, asked)

    def answers(near: DataFrame) -> DataFrame:
        near = near.groupBy("q", "entry").agg(F.max("score").alias("score"))
        near = near.withColumn("r", F.rank().over(Window.partitionBy("q").orderBy(F.desc("score")))).where(F.col("r") <= k + 1).drop("r")
        each = near.join(index.select("entry", "ids"), "entry").join(asking, "q").select(
            "query_id",
            "score",
            F.explode("ids").alias("id")
        ).where("id <> query_id")
        each = each.groupBy("query_id", "id").agg(F.max("score").alias("score"))
        return each.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))).where(F.col("rank") <= k)

    got = written(answers(met(index, queries, t, most, floor, k)), "neighbours")
    full = got.groupBy("query_id").agg(F.count("*").alias("c")).where(F.col("c") >= k).select("query_id")
    short = asking.join(full, "query_id", "left_anti")
    if (most < np.inf or floor > -np.inf) and not short.isEmpty():
        again = written(queries.join(short.select(F.col("q").alias("entry")).distinct(), "entry", "left_semi"), "short")
        rest = answers(met(index, again, dataclasses.replace(t, tables=1), np.inf, -np.inf, k))
        rest = written(rest.join(short.select("query_id"), "query_id", "left_semi"), "rest")
        got = got.join(rest.select("query_id").distinct(), "query_id", "left_anti").unionByName(rest)
        remove(again)
    for table in (index, queries, asking):  # the answers stand in tables of their own
        remove(table)
    return got.select("query_id", F.col("rank").cast("int"), F.col("id").alias(key), "score").toDF(*out_names)
