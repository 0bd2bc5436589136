"""Text formats: FASTQ and FASTA reads, positions, pairs, lengths.

Reads get dense ids from 0 in file order, over all files in the order given. Lines are
trimmed. Blank lines are dropped, save in FASTQ, whose records are four lines each.

Lines of the other formats are numbered without moving them: a first pass counts the lines of each file split,
and the number of lines before each split (a row for each split) goes to the second pass.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from readweave.session import written

READS = T.StructType(
    [
        T.StructField("rid", T.LongType()),
        T.StructField("name", T.StringType()),
        T.StructField("seq", T.StringType()),
        T.StructField("qual", T.StringType())
    ]
)
FIELDS = 4
_BLANKS = " \t\n\r\x0b\x0c"


def _lines(spark: SparkSession, paths: list[str]) -> tuple[DataFrame, list[tuple[int, int]]]:
    """(turn, file, block, value): lines by split, in order within each; and the files (turn, file) in order. ``file`` is a hash of the path."""
    if not paths:
        raise ValueError("no input files")
    seen: Counter[str] = Counter()
    turns: list[list[str]] = []
    order: list[tuple[int, str]] = []
    for p in paths:  # a path that is given again is read again
        turn, seen[p] = seen[p], seen[p] + 1
        turns += [[]] * (turn == len(turns))
        turns[turn] = [*turns[turn], p]
        order += [(turn, f) for f in sorted(spark.read.text(p).inputFiles())]
    bare = r"^file:/+"  # local paths are spelt with one slash or three
    parts = [
        spark.read.text(own).select(
            F.lit(turn).alias("turn"),
            F.xxhash64(F.regexp_replace("_metadata.file_path", bare, "/")).alias("file"),
            F.col("_metadata.file_block_start").alias("block"),
            "value"
        )
        for turn, own in enumerate(turns)
    ]
    lines = parts[0]
    for other in parts[1:]:
        lines = lines.union(other)
    names = spark.createDataFrame([(k, t, re.sub(bare, "/", f)) for k, (t, f) in enumerate(order)], "k int, turn int, path string")
    hashed = names.select("k", "turn", F.xxhash64("path").alias("file")).orderBy("k").collect()
    return lines, [(r["turn"], r["file"]) for r in hashed]


def _by_split(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[int, int, int], pa.Array]]:
    """((turn, file, block), trimmed lines) of runs of lines of one split."""
    for batch in batches:
        turn, file, block = (batch.column(k).to_numpy() for k in range(3))
        edge = np.flatnonzero(np.r_[True, (file[1:] != file[:-1]) | (block[1:] != block[:-1]) | (turn[1:] != turn[:-1]), True])
        for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
            if b > a:
                yield (int(turn[a]), int(file[a]), int(block[a])), pc.utf8_trim(batch.column(3).slice(a, b - a), _BLANKS)


def _full(lines: pa.Array) -> pa.Array:
    return lines.filter(pc.not_equal(lines, ""))


def _counted(lines: DataFrame) -> DataFrame:
    """(turn, file, block, n): the number of lines of each split that aren't blank."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n: Counter[tuple[int, int, int]] = Counter()
        for own, got in _by_split(batches):
            n[own] += len(_full(got))
        for own, k in n.items():
            kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip((*own, k), kinds, strict=True)], ["turn", "file", "block", "n"])

    return written(lines.mapInArrow(run, "turn int, file long, block long, n long"), "splits")


def _begins(splits: DataFrame, files: list[tuple[int, int]]) -> tuple[dict, int]:
    """The first line of each split, counted over all files, and the number of all lines."""
    place = {f: k for k, f in enumerate(files)}
    rows = sorted(splits.select("turn", "file", "block", "n").collect(), key=lambda r: (place[r["turn"], r["file"]], r["block"]))
    begin: dict[tuple[int, int, int], int] = {}
    at = 0
    for r in rows:
        begin[r["turn"], r["file"], r["block"]] = at
        at += r["n"]
    return begin, at


def _numbered(spark: SparkSession, paths: list[str]) -> tuple[DataFrame, int]:
    lines, files = _lines(spark, paths)
    begin, total = _begins(_counted(lines), files)
    sent = spark.sparkContext.broadcast(begin)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, at = None, 0
        for own, got in _by_split(batches):
            if own != split:
                split, at = own, sent.value[own]
            got = _full(got)
            yield pa.RecordBatch.from_arrays([got, pa.array(np.arange(at, at + len(got)))], ["value", "line"])
            at += len(got)

    return lines.mapInArrow(run, "value string, line long"), total


def numbered_lines(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(value, line): trimmed non-blank lines numbered in file order over all paths."""
    return _numbered(spark, paths)[0]


#: Lines from which a split tells where its records begin.
TELLING = 64
RECORD, LOOSE, SPLIT = range(3)
_FRAMED = "turn int, file long, block long, kind int, line long, wrong string, name string, seq string, plus string, qual string"
_CUT = "is cut short"
_WRONG = ("no @ at its beginning", "no + on its third line", "sequence and qualities differ in length")


def _phase(lines: pa.Array) -> int:
    """On which of the first four lines a record begins, if just one is borne out by all lines; else -1."""
    borne = []
    for k in range(min(FIELDS, len(lines))):
        name, seq, plus, qual = (lines.take(pa.array(np.arange(k + f, len(lines), FIELDS))) for f in range(FIELDS))
        n = len(qual)
        same = pc.all(pc.equal(pc.utf8_length(seq.slice(0, n)), pc.utf8_length(qual))).as_py() if n else True
        if pc.all(pc.starts_with(name, "@")).as_py() and same and (not len(plus) or pc.all(pc.starts_with(plus, "+")).as_py()):
            borne.append((k, len(plus) > 0))
    return borne[0][0] if len(borne) == 1 and len(lines) >= 2 * FIELDS - 1 and borne[0][1] else -1


class _Split:
    """Records and loose lines of a split as its lines come in."""

    def __init__(self, own: tuple[int, int, int]):
        self.own, self.line, self.held = own, 0, pa.array([], pa.string())
        self.framed = True if own[2] == 0 else None  # a file begins with a record; None: not known yet

    def rows(self, kind: int, lines: np.ndarray, wrong: pa.Array | None = None, fields: tuple = ()) -> pa.RecordBatch:
        n, none = len(lines), pa.nulls(len(lines), pa.string())
        turn, file, block = self.own
        fixed = [pa.array(np.full(n, turn, np.int32)), pa.array(np.full(n, file)), pa.array(np.full(n, block)), pa.array(np.full(n, kind, np.int32))]
        columns = [*fixed, pa.array(lines), none if wrong is None else wrong, *fields, *[none] * (FIELDS - len(fields))]
        return pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in _FRAMED.split(", ")])

    def loose(self, n: int) -> Iterator[pa.RecordBatch]:
        if n:
            yield self.rows(LOOSE, np.arange(self.line, self.line + n), None, (self.held.slice(0, n),))
        self.line, self.held = self.line + n, self.held.slice(n)

    def take(self, got: pa.Array, last: bool = False) -> Iterator[pa.RecordBatch]:
        self.held = pa.concat_arrays([self.held, got])
        if self.framed is None and (len(self.held) >= TELLING or last):
            phase = _phase(self.held.slice(0, TELLING))
            self.framed = phase >= 0
            yield from self.loose(max(phase, 0))
        if self.framed:
            m = len(self.held) // FIELDS
            if m:
                k = np.arange(m) * FIELDS
                fields = tuple(self.held.take(pa.array(k + f)) for f in range(FIELDS))
                sound = (pc.starts_with(fields[0], "@"), pc.starts_with(fields[2], "+"), pc.equal(pc.utf8_length(fields[1]), pc.utf8_length(fields[3])))
                wrong = pc.case_when(pc.make_struct(*(pc.invert(s) for s in sound)), *_WRONG)
                yield self.rows(RECORD, self.line + k, wrong.cast(pa.string()), fields)
                self.line, self.held = self.line + m * FIELDS, self.held.slice(m * FIELDS)
        if self.framed is False or last:
            yield from self.loose(len(self.held))

    def end(self) -> Iterator[pa.RecordBatch]:
        yield from self.take(pa.array([], pa.string()), last=True)
        yield self.rows(SPLIT, np.array([self.line]))


def _framed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    split = None
    for own, got in _by_split(batches):
        if split is None or own != split.own:
            if split is not None:
                yield from split.end()
            split = _Split(own)
        yield from split.take(got)
    if split is not None:
        yield from split.end()


def _starts(splits: DataFrame, files: list[tuple[int, int]]) -> DataFrame:
    """(turn, file, block, line0, id0, all0): lines of its file before the split, records and lines of files before its file."""
    order = splits.sparkSession.createDataFrame([(t, f, k) for k, (t, f) in enumerate(files)], "turn int, file long, k int")
    own = Window.partitionBy("turn", "file").orderBy("block")
    within = splits.select("turn", "file", "block", (F.sum("n").over(own) - F.col("n")).alias("line0"))
    totals = splits.groupBy("turn", "file").agg(F.sum("n").alias("n")).join(order, ["turn", "file"])
    earlier = Window.orderBy("k")  # a row for each file
    whole = F.expr(f"n div {FIELDS}")
    before = totals.select("turn", "file", (F.sum(whole).over(earlier) - whole).alias("id0"), (F.sum("n").over(earlier) - F.col("n")).alias("all0"))
    return within.join(before, ["turn", "file"])


def fastq(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Reads of four-line FASTQ records; the text is scanned once.

    Each split finds by itself where its records begin: of the four ways to frame its first lines one
    is borne out by @, + and equal lengths. Records that lie across the ends of splits, and splits that
    bear out none or several (very short ones), stay loose lines. All is written once, with its place
    in the split; the number of lines before each split, a row for each, is joined to that table. A record's id is then
    its line's number by four, and loose lines meet by that id.

    Empty reads are records of two blank lines. Up to three blank lines may end a file. A record whose first line doesn't
    begin with @ or whose third doesn't with +, whose sequence and qualities differ in length, or that is cut short, raises
    an error here, whichever columns are used later; it names the record's line (from 1, over all files).
    """
    lines, files = _lines(spark, paths)
    table = written(lines.mapInArrow(_framed, _FRAMED), "fastq")
    starts = _starts(table.where(F.col("kind") == SPLIT).select("turn", "file", "block", F.col("line").alias("n")), files)
    place, key = F.col("line0") + F.col("line"), ["turn", "file", "block"]
    placed = table.where(F.col("kind") != SPLIT).join(starts, key).withColumns(
        {"rid": F.col("id0") + F.expr(f"(line0 + line) div {FIELDS}"), "field": place % FIELDS, "at": F.col("all0") + place + 1}
    )
    whole = placed.where(F.col("kind") == RECORD).withColumn("wrong", F.when(F.col("field") != 0, "not framed in fours").otherwise(F.col("wrong")))
    field = lambda k: F.max(F.when(F.col("field") == k, F.col("name"))).alias(("name", "seq", "plus", "qual")[k])
    loose = placed.where(F.col("kind") == LOOSE).groupBy("turn", "file", "rid").agg(
        *map(field, range(FIELDS)), F.count("*").alias("n"), F.max("name").alias("most"), F.min("at").alias("at")
    ).where((F.col("n") == FIELDS) | (F.col("most") != ""))
    faults = (F.col("name").startswith("@"), F.col("plus").startswith("+"), F.length("seq") == F.length("qual"))
    told = F.when(F.col("n") < FIELDS, _CUT)
    for sound, what in zip(faults, _WRONG, strict=True):
        told = told.when(~sound, what)
    put = loose.withColumn("wrong", told)
    faulty = whole.select("at", "wrong").union(put.select("at", "wrong")).where("wrong is not null")
    for at, what in faulty.orderBy(F.col("wrong") != _CUT, "at").limit(1).collect():
        raise ValueError(f"FASTQ record at line {at}{' ' if what == _CUT else ': '}{what}")
    names = ["rid", F.expr("substring(name, 2)").alias("name"), F.upper("seq").alias("seq"), "qual"]
    return whole.select(*names).union(put.select(*names))


def fasta(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Reads of FASTA records, whose sequences may span lines.

    A record's lines are found by the number of headers up to each line: counted
    within ranges of lines, then added up over the ranges.
    """
    span = 100_000
    lines = numbered_lines(spark, paths).select(
        "line",
        "value",
        F.col("value").startswith(">").cast("long").alias("head"),
        F.expr(f"line div {span}").alias("range")
    )
    within = lines.withColumn("n", F.sum("head").over(Window.partitionBy("range").orderBy("line")))
    totals = lines.groupBy("range").agg(F.sum("head").alias("t"))
    before = totals.select("range", (F.sum("t").over(Window.orderBy("range")) - F.col("t")).alias("before"))
    placed = within.join(before, "range").select((F.col("before") + F.col("n") - 1).alias("rid"), "line", "value", "head").where("rid >= 0")
    rows = placed.groupBy("rid").agg(
        F.max(F.when(F.col("head") == 1, F.expr("substring(value, 2)"))).alias("name"),
        F.array_join(
            F.transform(F.array_sort(F.collect_list(F.when(F.col("head") == 0, F.struct("line", "value")))), lambda x: x["value"]),
            ""
        ).alias("seq"),
    )
    return rows.select("rid", "name", F.upper("seq").alias("seq"), F.lit(None).cast("string").alias("qual"))


def reads(spark: SparkSession, paths: list[str]) -> DataFrame:
    """FASTA where all names end in .fa, .fasta or .fna, else FASTQ."""
    return (fasta if paths and all(p.lower().endswith((".fa", ".fasta", ".fna")) for p in paths) else fastq)(spark, paths)


def _numbers(df: DataFrame, names: list[str]) -> DataFrame:
    tokens = F.split(F.regexp_replace("value", r"^\s+|\s+$", ""), r"\s+")
    return df.where(F.regexp_replace("value", r"\s", "") != "").select(
        *(c for c in df.columns if c != "value"),
        *(F.get(tokens, k).try_cast("long").alias(n) for k, n in enumerate(names))
    )


def simulated_positions(spark: SparkSession, path: str, read_length: int = 100) -> DataFrame:
    """(rid, rpos, rlen) of mates: of N lines, line i holds the starts of reads i and i + N."""
    lines, total = _numbered(spark, [path])
    return unpivoted(_numbers(lines, ["left", "right"]), read_length, F.lit(total))


def unpivoted(lines: DataFrame, read_length: int, total: Column | None = None) -> DataFrame:
    """Rows (line, left, right) as two reads each. ``total``: the number of lines (else a scalar subquery)."""
    total = lines.agg(F.count("*")).scalar() if total is None else total
    mates = F.array(
        F.struct(F.col("line").alias("rid"), F.col("left").alias("rpos")),
        F.struct((F.col("line") + total).alias("rid"), F.col("right").alias("rpos"))
    )
    return lines.select(F.inline(mates), F.lit(read_length).cast("long").alias("rlen"))


def mapped_positions(spark: SparkSession, path: str) -> DataFrame:
    """(rid, rpos, rlen) of lines ``rid pos len``."""
    return _numbers(spark.read.text(path), ["rid", "rpos", "rlen"])


def positions(spark: SparkSession, path: str, read_length: int = 100) -> DataFrame:
    """By name: files whose names end with ``map`` are mapped positions, others simulated ones."""
    return mapped_positions(spark, path) if path.endswith("map") else simulated_positions(spark, path, read_length)


def pairs(spark: SparkSession, path: str) -> DataFrame:
    """Distinct (a, b) with a < b of lines ``first second``."""
    p = _numbers(spark.read.text(path), ["x", "y"])
    return p.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).where("a < b").distinct()


def write_pairs(df: DataFrame, path: str) -> None:
    df.select(F.concat_ws(" ", "a", "b").alias("value")).write.text(path)


#: Lines of a run that one row of a listing stands for, and of a file of it.
RUN, FILE_LINES = 100_000, 5_000_000


def write_lengths(df: DataFrame, path: str) -> None:
    """One length a line, ascending over the files in order of their names.

    Sorted by counting: lengths are counted, and only (length, number) runs of bounded size are
    put in order; each task writes out the lines of its runs.
    """
    counts = df.groupBy("len").agg(F.count("*").alias("n"))
    runs = counts.select("len", "n", F.explode(F.expr(f"sequence(0L, (n - 1) div {RUN})")).alias("run"))
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    files = 1 + total // FILE_LINES
    lines = F.explode(F.array_repeat(F.col("len").cast("string"), F.expr(f"cast(least({RUN}, n - run * {RUN}) as int)")))
    runs.repartitionByRange(files, "len", "run").sortWithinPartitions("len", "run").select(lines.alias("value")).write.text(path)


def is_sorted(df: DataFrame, column: str) -> bool:
    """Whether a column ascends over the rows as they lie, partition by partition: each partition tells if it does, and its first and last value."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sound, first, last = True, None, None
        for batch in batches:
            x = batch.column(0).to_numpy(zero_copy_only=False)
            if len(x):
                sound = sound and bool((x[1:] >= x[:-1]).all()) and (last is None or bool(last <= x[0]))
                first, last = (int(x[0]) if first is None else first), int(x[-1])
        if first is not None:
            yield pa.RecordBatch.from_arrays([pa.array([sound]), pa.array([first]), pa.array([last])], ["sound", "first", "last"])

    told = df.select(F.col(column).cast("long")).mapInArrow(
        run,
        "sound boolean, first long, last long"
    ).withColumn("part", F.spark_partition_id()).collect()
    told.sort(key=lambda r: r["part"])
    return all(r["sound"] for r in told) and all(x["last"] <= y["first"] for x, y in zip(told[:-1], told[1:], strict=True))
