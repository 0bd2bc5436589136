"""Runs: stretches of words that repeat with a smallest period q at least ``powers`` times.

The match places of a period q are the words i with word[i] = word[i + q]. A run is a longest
interval of match places, widened by q words at its end, whose period is the smallest.

1.  *Tiles.* Periods fall into octaves P to 2P - 1 (P a power of two). A document is cut into tiles of
    each octave whose length goes with P: anchors lie P words apart, and a tile holds what its
    anchors' stretches can reach, P words before its first anchor and 4P after its last.
    Small octaves share tiles. Documents of up to ``TILE`` words are one tile in all octaves and are solved
    where they lie; those of longer documents are rows that are dealt over all tasks.
2.  *Tiles alone.* A run of period q has 3q match places or more, so it holds several anchors. At each
    anchor c the Z-functions of the tile's two halves at c are asked for all q of the octave: how far
    word[c...] and word[c + q...] agree forwards, and how far backwards. Forwards, fewer than P
    words agree nearly always, and one comparison of hashes of P words settles all anchors and periods
    of an octave at once; the few other Z-values come by bisection over prefix sums, at most 2P forwards
    and P backwards. Where a divisor of q is a period too, the fragment isn't q's.
3.  *Stitching.* Fragments of one tile are united there; then fragments are shuffled by document and period,
    and those that overlap or touch are one run.
4.  *Collapsing.* A run's words after its first q are dropped. Documents without fragments, nearly all,
    are done in the first pass; of the others words and runs meet by a join.

Words are compared by hashes: 64 bits for words and blocks, two prefix sums of 31 bits. A document's fragments
are bounded by its words, as the exponents of all runs of a text add up to a few times its length.

Null and empty texts have no words and no runs. Very long texts count whole. Rows are judged alone:
repeated rows, ties and null keys don't matter. An empty table gives one. Other columns are not carried.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from readweave.llm import flat
from readweave.session import written

#: Words of a tile that one row may hold unshuffled; a tile of the octave P has max(TILE, WIDE * P) words between its first and last anchor.
TILE, WIDE = 1 << 16, 16
#: Primes below 2**31 and bases of the two prefix sums.
MODULI = ((2147483647, 1_103_515_245), (2147483629, 1_664_525_021))

Fragments = tuple[np.ndarray, np.ndarray, np.ndarray]
_FOUND = (
    "row long, key long, n_words long, collapsed_sha256 string, body binary, fragments array<struct<period: long, lo: long, hi: long>>,"
    "tile struct<base: long, first: long, last: long, low: long, high: long, words: binary>"
)


class Words:
    """Hashes of words in order, with prefix sums that compare stretches in constant time."""

    def __init__(self, x: np.ndarray):
        self.x, self.sums = x, []
        for p, base in MODULI:
            power = np.ones(1, np.uint64)
            while len(power) <= len(x):
                step = np.uint64(pow(base, len(power), p))
                power = np.concatenate([power, power * step % np.uint64(p)])
            terms = (x >> np.uint64(33) if p == MODULI[0][0] else x & np.uint64((1 << 31) - 1)) % np.uint64(p) * power[: len(x)] % np.uint64(p)
            self.sums.append((np.uint64(p), power, np.concatenate([np.zeros(1, np.uint64), np.cumsum(terms) % np.uint64(p)])))

    def equal(self, i: np.ndarray, j: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Whether the words i ... i + length - 1 are those from j on; i < j."""
        same = np.ones(len(i), bool)
        for p, power, s in self.sums:
            one, two = (s[i + length] + p - s[i]) % p, (s[j + length] + p - s[j]) % p
            same &= one * power[j - i] % p == two
        return same

    def forwards(self, i: np.ndarray, j: np.ndarray, most: np.ndarray) -> np.ndarray:
        """Z-values: how many words from i and from j on agree, ``most`` at most."""
        return self._reach(most, lambda own, done, step: self.equal(i[own] + done, j[own] + done, step))

    def backwards(self, i: np.ndarray, j: np.ndarray, most: np.ndarray) -> np.ndarray:
        """Z-values of the mirrored words: how many words before i and before j agree, ``most`` at most."""
        return self._reach(most, lambda own, done, step: self.equal(i[own] - done - step, j[own] - done - step, step))

    def _reach(self, most: np.ndarray, agree) -> np.ndarray:
        done = np.zeros(len(most), np.int64)
        step = 1 << int(most.max(initial=1)).bit_length()
        while step:
            own = np.flatnonzero(done + step <= most)
            own = own[agree(own, done[own], np.full(len(own), step))]
            done[own] += step
            step //= 2
        return done


def smallest_factors(n: int) -> np.ndarray:
    """The smallest prime factor of each number below n."""
    out = np.arange(n)
    for k in range(2, int(n**0.5) + 1):
        if out[k] == k:
            multiples = out[k * k :: k]
            multiples[multiples == np.arange(k * k, n, k)] = k
    return out


def united(period: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> Fragments:
    """Intervals of one period that overlap or touch as one."""
    if not len(lo):
        return period, lo, hi
    order = np.lexsort((lo, period))
    period, lo, hi = period[order], lo[order], hi[order]
    wide = int(hi.max()) + 2
    reach = np.maximum.accumulate(period * wide + hi)
    first = np.flatnonzero(np.r_[True, period[1:] * wide + lo[1:] > reach[:-1]])
    return period[first], lo[first], np.maximum.reduceat(hi, first)


def solve(x: np.ndarray, first: int, last: int, low: int, high: int) -> Fragments:
    """(period, lo, hi): intervals of match places that hold an anchor from ``first`` on and before ``last``, of the octaves ``low`` to ``high``.

    Anchors of the octave P are the multiples of P.
    """
    found: list[Fragments] = []
    words, factors, block, wide = None, None, x, 1
    while wide <= high and 2 * wide <= len(x):
        if wide >= low:
            rows = np.zeros(-(-len(block) // wide) * wide, np.uint64)
            rows[: len(block)] = block
            rows = rows.reshape(-1, wide)
            row, column = np.nonzero(rows[1:] == rows[:-1, :1])
            c, q = row * wide, column + wide
            sound = (c >= first) & (c < last) & (c + q + wide <= len(x))
            c, q = c[sound], q[sound]
            if len(c):
                words = words or Words(x)
                factors = smallest_factors(2 * high) if factors is None else factors
                back = words.backwards(c, c + q, np.minimum(c, wide))
                far = wide + words.forwards(c + wide, c + q + wide, np.minimum(wide, len(x) - c - q - wide))
                own = _primitive(words, factors, c - back, c + far, q)
                found.append(united(q[own], (c - back)[own], (c + far)[own]))
        block = flat.mix(block[:-wide] * np.uint64(0x9E3779B97F4A7C15) + block[wide:])
        wide *= 2
    if not found:
        return (np.zeros(0, np.int64),) * 3
    period, lo, hi = (np.concatenate(part) for part in zip(*found, strict=True))
    return period, lo, hi


def _primitive(words: Words, factors: np.ndarray, lo: np.ndarray, hi: np.ndarray, period: np.ndarray) -> np.ndarray:
    """Whether no proper divisor of its period is a period of an interval's words. These are a whole period or more, so all fragments of a run agree."""
    own, rest = np.ones(len(lo), bool), period.copy()
    while (rest > 1).any():
        factor = factors[rest]
        some = np.flatnonzero(own & (rest > 1))
        d = period[some] // factor[some]
        own[some[words.equal(lo[some], lo[some] + d, hi[some] + period[some] - d - lo[some])]] = False
        rest = np.where(rest > 1, rest // factor, 1)
    return own


def tiles(n: int, powers: int) -> Iterator[tuple[int, int, int, int, int, int]]:
    """(base, end, first, last, low, high) of the tiles of n words: the words, the anchors, the octaves."""
    top = 1
    while 2 * top * powers <= n:
        top *= 2
    low, high = 1, TILE // WIDE
    while low <= top:
        core = max(TILE, WIDE * high)
        for first in range(0, n, core):
            yield max(0, first - high), min(n, first + core + 4 * high), first, first + core, low, min(high, top)
        low, high = 2 * high, 2 * high


def long_enough(period: np.ndarray, lo: np.ndarray, hi: np.ndarray, least: int, powers: int) -> np.ndarray:
    return hi - lo + period >= np.maximum(least, powers * period)


def _joined(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words with a space after each; and where each begins."""
    size = end - start
    begin = np.cumsum(size + 1) - size - 1
    out = np.full(int((size + 1).sum()), 0x20, np.uint8)
    out[flat.ranges(begin, size)] = buf[flat.ranges(start, size)]
    return out, begin


def _separated(h: np.ndarray, row: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes with one that is found nowhere else after each row; and where each row begins."""
    x = np.empty(len(h) + len(n), np.uint64)
    begin = np.cumsum(n + 1) - n - 1
    x[np.arange(len(h)) + row] = h
    x[begin + n] = flat.mix(np.arange(len(n), dtype=np.uint64) + np.uint64(1 << 63))
    return x, begin


def _lists(row: np.ndarray, rows: int, parts: Fragments) -> pa.Array:
    offsets = np.searchsorted(row, np.arange(rows + 1)).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays([pa.array(p) for p in parts], ["period", "lo", "hi"]))


def _window(rid: np.ndarray, key: pa.Array, buf: np.ndarray, at: np.ndarray, least: int, powers: int) -> Iterator[pa.RecordBatch]:
    """Rows of documents, and rows of the tiles of long ones."""
    start, end, row = flat.word_spans(buf, at)
    rows = len(rid)
    n = np.bincount(row, minlength=rows).astype(np.int64)
    h, long = flat.hash_spans(buf, start, end), np.flatnonzero(n > TILE)
    short = n <= TILE
    x, begin = _separated(h[short[row]], row[short[row]], n * short)
    period, lo, hi = solve(x, 0, len(x), 1, 1 << int((n * short).max(initial=0) // powers).bit_length())
    some = long_enough(period, lo, hi, least, powers)
    owner = np.searchsorted(begin, lo[some], "right") - 1
    order = np.argsort(owner, kind="stable")
    owner = owner[order]
    parts = tuple(p[some][order] - (begin[owner] if k else 0) for k, p in enumerate((period, lo, hi)))
    body, place = _joined(buf, start, end)
    view, upto = memoryview(body), np.cumsum(n)
    digests, bodies = [], []
    pending = np.zeros(rows, bool)
    pending[owner] = pending[long] = True
    for k, (m, b) in enumerate(zip(n.tolist(), upto.tolist(), strict=True)):
        own = view[place[b - m] : place[b - 1] + end[b - 1] - start[b - 1]] if m else b""
        digests.append(None if pending[k] else hashlib.sha256(own).hexdigest())
        bodies.append(bytes(own) if pending[k] else None)
    names = ["row", "key", "n_words", "collapsed_sha256", "body", "fragments", "tile"]
    kind = pa.struct([(c, pa.int64()) for c in ("base", "first", "last", "low", "high")] + [("words", pa.binary())])
    of = _lists(owner, rows, parts)
    yield pa.RecordBatch.from_arrays(
        [pa.array(rid), key, pa.array(n), pa.array(digests, pa.string()), pa.array(bodies, pa.binary()), of, pa.nulls(rows, kind)], names
    )
    for k in long.tolist():
        x = h[upto[k] - n[k] : upto[k]]
        for base, to, *rest in tiles(len(x), powers):
            tile = dict(zip(("base", "first", "last", "low", "high"), (base, *rest), strict=True)) | {"words": x[base:to].tobytes()}
            empty = [pa.nulls(1, of.type) if c == "fragments" else pa.nulls(1, t) for c, t in zip(names[1:6], (key.type, pa.int64(), pa.string(), pa.binary(), of.type), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array([rid[k]]), *empty, pa.array([tile], kind)], names)


def _found(docs: DataFrame, least: int, powers: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rid, key = batch.column(0).to_numpy(), batch.column(1)
            for lo, hi, buf, at in flat.windows(batch.column(2)):
                yield from _window(rid[lo:hi], key.slice(lo, hi - lo), buf, at, least, powers)

    return docs.mapInArrow(run, _FOUND)


def _solved(tile_rows: DataFrame, least: int, powers: int) -> DataFrame:
    """(row, period, lo, hi) of tiles: what is long enough, or may go on in the tile before or after."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                base = r["base"]
                period, lo, hi = solve(np.frombuffer(r["words"], np.uint64), r["first"] - base, r["last"] - base, r["low"], r["high"])
                lo, hi = lo + base, hi + base
                some = long_enough(period, lo, hi, least, powers) | (lo <= r["first"]) | (hi >= r["last"])
                out = [np.full(int(some.sum()), r["row"]), period[some], lo[some], hi[some]]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in out], ["row", "period", "lo", "hi"])

    return tile_rows.mapInArrow(run, "row long, period long, lo long, hi long")


def stitched(fragments: DataFrame, least: int, powers: int) -> DataFrame:
    """(row, start, length, period) of runs: fragments of a document and period that overlap or touch are one."""
    of = Window.partitionBy("row", "period").orderBy("lo", "hi")
    before = F.max("hi").over(of.rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.when(before.isNull() | (F.col("lo") > before), 1).otherwise(0)
    part = fragments.withColumn("fresh", fresh).withColumn("part", F.sum("fresh").over(of))
    whole = part.groupBy("row", "period", "part").agg(F.min("lo").alias("start"), (F.max("hi") - F.min("lo") + F.col("period")).alias("length"))
    return whole.where(F.col("length") >= F.greatest(F.lit(least), powers * F.col("period"))).select("row", "start", "length", "period")


def _told(body: memoryview, runs: list[dict]) -> tuple[str, str, dict]:
    """Digests of the runs and of the words that stay, and the longest run."""
    joined = np.frombuffer(body, np.uint8)
    begin = np.r_[0, np.flatnonzero(joined == 0x20) + 1] if len(joined) else np.zeros(0, np.int64)
    size = np.diff(np.r_[begin, len(joined) + 1]) - 1
    edge = np.zeros(len(begin) + 1, np.int64)
    for r in runs:
        edge[r["start"] + r["period"]] += 1
        edge[r["start"] + r["length"]] -= 1
    kept = np.cumsum(edge[:-1]) == 0
    out, _ = _joined(joined, begin[kept], begin[kept] + size[kept])
    lines = "".join(f"{r['start']},{r['length']},{r['period']}\n" for r in runs)
    longest = min(runs, key=lambda r: (-r["length"], r["start"], r["period"]), default={})
    return hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(out[:-1].tobytes()).hexdigest(), longest


_RESULT = "key long, n_words long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"


def _collapsed(pending: DataFrame) -> DataFrame:
    names = [c.split()[0] for c in _RESULT.split(", ")]
    kinds = [pa.string() if c.endswith("sha256") else pa.int64() for c in names]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for k in range(batch.num_rows):
                runs = sorted(batch.column(3)[k].as_py() or [], key=lambda r: (r["start"], r["period"]))
                listed, left, top = _told(batch.column(2)[k].as_buffer(), runs)
                exponent = 1000 * top["length"] // top["period"] if top else None
                rows.append((batch.column(0)[k].as_py(), batch.column(1)[k].as_py(), len(runs), top.get("start"), top.get("length"), top.get("period"), exponent, listed, left))
            yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], t) for c, t in enumerate(kinds)], names)

    return pending.select("key", "n_words", "body", "runs").mapInArrow(run, _RESULT)


def runs(docs: DataFrame, key: str = "doc_id", text: str = "text", least: int = 6, powers: int = 4) -> DataFrame:
    """Per row: ``key``, n_words, n_runs; of the longest run (ties: smallest start, then period) start, length, period, exponent_milli, or nulls.

    runs_sha256 is the digest of a line ``start,length,period`` for each run in order, collapsed_sha256 that of the
    words that stay when each run is cut to its first period, with a space between. Runs have ``least`` words or more
    and ``powers`` periods or more (4 at least).
    """
    if powers < 4:
        raise ValueError("runs of fewer than four periods need not hold an anchor's fragment")
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(key).cast("long").alias("key"), F.col(text).alias("text"))
    table = written(_found(rows, least, powers), "periodic")
    tile_rows = table.where("tile is not null").select("row", "tile.*").repartition("row", "low", "first")
    fragments = table.where("tile is null").select("row", F.inline("fragments")).union(_solved(tile_rows, least, powers))
    whole = stitched(fragments, least, powers).groupBy("row").agg(F.collect_list(F.struct("start", "length", "period")).alias("runs"))
    pending = table.where("body is not null").join(whole, "row", "left")
    none, long = F.lit(None).cast("long"), F.lit(0).cast("long")
    done = table.where("tile is null and body is null").select(
        "key", "n_words", long.alias("n_runs"), *(none.alias(c) for c in ("start", "length", "period", "exponent_milli")), F.sha2(F.lit("").cast("binary"), 256).alias("runs_sha256"),
        "collapsed_sha256"
    )
    return done.union(_collapsed(pending)).withColumnRenamed("key", key)
