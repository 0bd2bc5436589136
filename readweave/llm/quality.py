"""A quality score learnt from preference pairs (Bradley-Terry).

Each text becomes a short vector of shape measures (lengths, signs, repetition,
common words); each measure also falls into one of a few bins whose edges come from
the training documents. The model is linear: logistic loss on the difference between
the vectors of a preferred and a rejected document gives the weights. The threshold
is the quantile of the training scores at the share of rejected documents, and the
score is a logistic curve through ``cut`` at that threshold.

The model is fitted from all labelled documents outside the held-out fold. Their vectors
are written in blocks; means, edges, weights and the threshold come from passes over all
blocks, of which the driver adds up results of bounded size in a fixed order. Every
labelled document is in a pair (of its block) or more. Scoring is one narrow pass. Null and empty texts
have a vector of zeros and get a score. Labelled keys without a document, and null
labels, are left out; a key with labels of both kinds counts as both. Without any
pair of labels all scores are ``cut``. Whole texts count, however long; rows are judged
alone, so repeated rows get the same score and an empty table none. Documents that
tie at the threshold are all taken for good.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from readweave.llm import flat
from readweave.llm.rules import STOP_WORDS
from readweave.session import remove, written

MEASURES = (
    "log_words", "log_bytes", "word_length", "upper", "digit", "symbol", "exclamation", "stop", "quote", "wide", "capitalised", "long_words",
    "vocabulary", "repeat3", "duplicate_lines", "line_words", "short_lines", "full_stops", "commas", "top_word",
)
BINS = 8
#: Documents of a block.
BLOCK = 50_000
#: Cuts and passes of a search for quantiles: to some 1e-12 of the range.
CUTS, PASSES = 256, 5

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True


def _words_hashed(words: list[str]) -> np.ndarray:
    data = [w.encode() for w in words]
    ends = np.cumsum([len(w) for w in data])
    return np.sort(flat.hash_spans(np.frombuffer(b"".join(data), np.uint8), np.r_[0, ends[:-1]], ends))


_STOPS = _words_hashed(list(dict.fromkeys(STOP_WORDS)))


def _distinct(row: np.ndarray, h: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values of each row, and how often the commonest occurs."""
    _, first, n = np.unique(h ^ flat.mix(row.astype(np.uint64) + np.uint64(1)), return_index=True, return_counts=True)
    most = np.zeros(rows)
    np.maximum.at(most, row[first], n)
    return np.bincount(row[first], minlength=rows), most


def vectors(buf: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A row of MEASURES for each text of a window."""
    rows, size = len(at) - 1, np.diff(at)
    start, end, row = flat.word_spans(buf, at)
    byte_row = np.repeat(np.arange(rows), size)
    count = lambda mask: np.bincount(byte_row[mask], minlength=rows)
    of = lambda a, b: np.divide(a, b, out=np.zeros(rows), where=np.asarray(b) > 0)
    n = np.bincount(row, minlength=rows)
    chars = np.bincount(row, weights=end - start, minlength=rows)
    lower = flat.LOWER[buf]
    h = flat.hash_spans(lower, start, end)
    at_stop = np.minimum(np.searchsorted(_STOPS, h), len(_STOPS) - 1)
    kinds, most = _distinct(row, h, rows)
    three = row[2:] == row[:-2] if len(row) > 2 else np.zeros(0, bool)
    h3 = flat.mix(h[:-2] + flat.mix(h[1:-1] + flat.mix(h[2:])))[three] if len(row) > 2 else np.zeros(0, np.uint64)
    row3 = row[:-2][three] if len(row) > 2 else np.zeros(0, np.int64)
    kinds3, _ = _distinct(row3, h3, rows)
    new_line = buf == 10
    edge = np.unique(np.r_[at[:-1][size > 0], np.flatnonzero(new_line) + 1])
    edge = edge[edge < len(buf)]
    line_end = np.r_[edge[1:], len(buf)] if len(edge) else edge
    line_end = line_end - new_line[line_end - 1] if len(edge) else edge
    line_row = np.searchsorted(at, edge, "right") - 1
    in_line = np.bincount(np.searchsorted(edge, start, "right") - 1, minlength=len(edge)) if len(edge) else np.zeros(0, np.int64)
    real = in_line > 0
    lines = np.bincount(line_row[real], minlength=rows)
    line_kinds, _ = _distinct(line_row[real], flat.hash_spans(buf, edge[real], line_end[real]), rows)
    letters = count(flat.BYTE_CLASS[buf] == flat.LETTER)
    columns = {
        "log_words": np.log1p(n), "log_bytes": np.log1p(size), "word_length": of(chars, n),
        "upper": of(count(_UPPER[buf]), letters), "digit": of(
            count(flat.BYTE_CLASS[buf] == flat.DIGIT),
            size
        ), "symbol": of(count(_SYMBOL[buf]), chars), "exclamation": of(count(buf == 33), n),
        "stop": of(
            np.bincount(row[_STOPS[at_stop] == h], minlength=rows),
            n
        ), "quote": of(count((buf == 34) | (buf == 39)), chars), "wide": of(count(buf > 127), size),
        "capitalised": of(
            np.bincount(row[_UPPER[buf[start]]], minlength=rows),
            n
        ), "long_words": of(np.bincount(row[end - start > 20], minlength=rows), n),
        "vocabulary": of(kinds, n), "repeat3": 1 - of(kinds3, np.bincount(row3, minlength=rows)), "duplicate_lines": of(lines - line_kinds, lines),
        "line_words": np.log1p(of(n, lines)), "short_lines": of(np.bincount(line_row[real & (in_line < 4)], minlength=rows), lines),
        "full_stops": of(count(buf == 46), n), "commas": of(count(buf == 44), n), "top_word": of(most, n),
    }
    return np.stack([columns[m] for m in MEASURES], axis=1).astype(np.float64)


@dataclass
class Model:
    """``edges``: BINS - 1 inner edges of each measure; ``weights``: of the standardised measures, then of the bins."""

    mean: np.ndarray
    scale: np.ndarray
    edges: np.ndarray
    weights: np.ndarray
    threshold: float = 0.0
    slope: float = 1.0
    cut: float = 0.3

    def expand(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -5, 5)
        bins = (x[:, :, None] > self.edges[None]).astype(np.float64)  # cumulative: bin k sets the first k
        return np.concatenate([z, bins.reshape(len(x), -1)], axis=1)

    def utility(self, x: np.ndarray) -> np.ndarray:
        return self.expand(x) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        """From 0 to 1; ``cut`` or more from the threshold on."""
        u = self.utility(x)
        s = 1 / (1 + np.exp(-np.clip(self.slope * (u - self.threshold) + np.log(self.cut / (1 - self.cut)), -50, 50)))
        return np.where(u >= self.threshold, np.maximum(s, self.cut), np.minimum(s, np.nextafter(self.cut, 0)))


#: Results of a function of (block's number, vectors, labels), in the blocks' order.
Run = Callable[[Callable[[int, np.ndarray, np.ndarray], tuple]], list[tuple]]


def _total(results: list[tuple]) -> list[np.ndarray]:
    return [sum(column[1:], column[0]) for column in zip(*results, strict=True)]


def _quantiles(run: Run, least: np.ndarray, most: np.ndarray, n: int) -> np.ndarray:
    """Inner edges of BINS equal parts of each measure's values: counts of values up to CUTS cuts narrow each edge's interval down, pass by pass."""
    rank = np.floor((n - 1) * np.linspace(0, 1, BINS + 1)[1:-1])
    lo, hi = (np.repeat(v[:, None], BINS - 1, axis=1) for v in (np.nextafter(least, -np.inf), most))
    for _ in range(PASSES):
        cuts = lo[..., None] + (hi - lo)[..., None] * (np.arange(1, CUTS) / CUTS)

        def count(_, x, y, cuts=cuts):
            return (np.stack([np.searchsorted(np.sort(x[:, m]), cuts[m], "right") for m in range(len(cuts))]),)

        (below,) = _total(run(count))
        at = (below <= rank[None, :, None]).sum(axis=2)
        every = np.concatenate([lo[..., None], cuts, hi[..., None]], axis=2)
        lo, hi = (np.take_along_axis(every, (at + k)[..., None], axis=2)[..., 0] for k in (0, 1))
    return hi


def _paired(number: int, y: np.ndarray, times: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Preferred and rejected rows of a block's pairs: each row ``times`` times at least."""
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    n = times * max(len(good), len(bad)) if len(good) and len(bad) else 0
    rng = np.random.default_rng([seed, number])
    side = lambda rows: np.concatenate([rng.permutation(rows) for _ in range(-(-n // len(rows)))])[:n] if n else rows[:0]
    return side(good), side(bad)


def _weigh(run: Run, model: Model, times: int, rounds: int, seed: int) -> None:
    """Newton's steps on the mean logistic loss of all pairs; a step that doesn't lessen it is halved."""
    size, best, step = len(MEASURES) * BINS, np.inf, None
    for _ in range(rounds):

        def slopes(number, x, y):
            first, second = _paired(number, y, times, seed)
            z, loss, g, h = model.expand(x), 0.0, np.zeros(size), np.zeros((size, size))
            for lo in range(0, len(first), 5000):
                d = z[first[lo : lo + 5000]] - z[second[lo : lo + 5000]]
                u = d @ model.weights
                p = 1 / (1 + np.exp(np.clip(u, -50, 50)))  # how far the pair is from being ranked well
                loss, g, h = loss + np.logaddexp(0, -u).sum(), g - p @ d, h + (d * (p * (1 - p))[:, None]).T @ d
            return len(first), loss, g, h

        n, loss, g, h = _total(run(slopes))
        if not n:
            return
        loss = loss / n + 5e-5 * model.weights @ model.weights
        if loss > best:
            step = step / 2
            model.weights = kept + step
            continue
        done, best, kept = best - loss < 1e-5 * loss, loss, model.weights
        if done:
            return
        step = -np.linalg.solve(h / n + 1e-4 * np.eye(size), g / n + 1e-4 * kept)
        model.weights = kept + step
    model.weights = kept


def _place(run: Run, model: Model, share: float, good: int, bad: int) -> None:
    """The threshold, halfway between the last rejected score and the next one, and the slope."""
    every = run(lambda _, x, y: ((u := model.utility(x))[y == 1].sum(), u[y == 0].sum(), u.min(), u.max()))
    model.slope = float(6 / max(sum(r[0] for r in every) / good - sum(r[1] for r in every) / bad, 1e-6))
    lo, hi = np.nextafter(min(r[2] for r in every), -np.inf), max(r[3] for r in every)
    for _ in range(PASSES):
        cuts = lo + (hi - lo) * np.arange(1, CUTS) / CUTS

        def count(_, x, y, cuts=cuts):
            u = model.utility(x)
            return tuple(np.searchsorted(np.sort(u[y == label]), cuts, "right") for label in (1, 0))

        of_good, of_bad = _total(run(count))
        at = int(((1 - share) / good * of_good + share / bad * of_bad < share - 1e-12).sum())
        ends = np.r_[lo, cuts, hi]
        lo, hi = ends[at], ends[at + 1]
    sides = run(lambda _, x, y: (max((u := model.utility(x))[u <= hi], default=-np.inf), min(u[u > hi], default=np.inf)))
    last, following = max(r[0] for r in sides), min(r[1] for r in sides)
    model.threshold = float((last + following) / 2 if np.isfinite(following) else last)


def _learn(run: Run, share: float, cut: float, pairs: int, rounds: int, seed: int) -> Model:
    blank = Model(
        np.zeros(len(MEASURES)), np.ones(len(MEASURES)), np.zeros((len(MEASURES), BINS - 1)), np.zeros(len(MEASURES) * BINS), cut=cut
    )
    every = run(lambda _, x, y: (len(x), x.sum(axis=0), int((y == 1).sum()), int((y == 0).sum()), x.min(axis=0), x.max(axis=0)))
    if not every:
        return blank
    n, total, good, bad = _total([r[:4] for r in every])
    mean = total / n
    scale = np.sqrt(_total(run(lambda _, x, y: (((x - mean) ** 2).sum(axis=0),)))[0] / n)
    edges = _quantiles(run, np.min([r[4] for r in every], axis=0), np.max([r[5] for r in every], axis=0), n)
    model = Model(mean, np.where(scale > 0, scale, 1), edges, blank.weights, cut=cut)
    if good and bad:
        _weigh(run, model, max(1, pairs // n), rounds, seed)
        _place(run, model, share, good, bad)
    return model


def fit(x: np.ndarray, y: np.ndarray, share: float, cut: float = 0.3, pairs: int = 40_000, rounds: int = 12, seed: int = 7) -> Model:
    """``y``: 1 for preferred documents, 0 for rejected ones. ``share``: the part of all documents that is rejected. All rows are one block here."""
    return _learn(lambda f: [f(0, x, y)] if len(x) else [], share, cut, pairs, rounds, seed)


def held_out(key: str) -> F.Column:
    """Whether a document takes no part in training: crc32 of its key as text, modulo 5, is 0. Null keys don't train either."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def scored_vectors(df: DataFrame, text: str, keep: list[str]) -> DataFrame:
    names = [*keep, "vector"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, buf, at in flat.windows(batch.column(len(keep))):
                x = vectors(buf, at)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32)), pa.array(x.ravel()))
                yield pa.RecordBatch.from_arrays([*(batch.column(k).slice(lo, hi - lo) for k in range(len(keep))), lists], names)

    kinds = dict(df.dtypes)
    return df.select(*keep, F.col(text).alias("__text")).mapInArrow(run, ", ".join(f"`{k}` {kinds[k]}" for k in keep) + ", vector array<double>")


def _blocks(rows: DataFrame, n: int) -> DataFrame:
    """(block, part, y, x): labels and vectors of about BLOCK rows (__y, __h, vector), the same whatever the partitions; written."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["block", "part", "y", "x"]
        block, part, held = -1, 0, []

        def out() -> pa.RecordBatch:
            y, x = (np.concatenate(c) for c in zip(*held, strict=True))
            return pa.RecordBatch.from_arrays(
                [pa.array([block], pa.int32()), pa.array([part], pa.int32()), pa.array([y.tobytes()], pa.binary()), pa.array([x.tobytes()], pa.binary())], names
            )

        for batch in batches:
            number, y = batch.column(0).to_numpy(), batch.column(1).to_numpy().astype(np.int8)
            x = batch.column(2).flatten().to_numpy().reshape(-1, len(MEASURES))
            edge = np.flatnonzero(np.r_[True, number[1:] != number[:-1], True]) if len(number) else []
            for lo, hi in zip(edge[:-1], edge[1:]):
                if number[lo] != block:
                    if held:
                        yield out()
                    block, part, held = int(number[lo]), 0, []
                while lo < hi:  # rows of one hash can be many
                    end = min(hi, lo + 2 * BLOCK - sum(len(h[0]) for h in held))
                    held.append((y[lo:end], x[lo:end]))
                    lo = end
                    if sum(len(h[0]) for h in held) == 2 * BLOCK:
                        yield out()
                        part, held = part + 1, []
        if held:
            yield out()

    number = F.pmod("__h", F.lit(max(1, -(-n // BLOCK)))).cast("int").alias("__b")
    dealt = rows.select(number, "__y", "vector", "__h").repartition("__b").sortWithinPartitions("__b", "__h", "__y", "vector")
    return written(dealt.select("__b", "__y", "vector").mapInArrow(run, "block int, part int, y binary, x binary"), "quality")


def train(
    docs: DataFrame,
    labels: DataFrame,
    text: str = "text",
    key: str = "doc_id",
    label: str = "quality",
    cut: float = 0.3,
    pairs: int = 40_000,
    rounds: int = 12,
    seed: int = 7
) -> Model:
    """Fit on all labelled documents outside the held-out fold. A vector of each moves, no text."""
    known = labels.where(F.col(label).isin(0, 1) & F.col(key).isNotNull()).select(
        F.col(key).alias("__k"),
        F.col(label).cast("int").alias("__y")
    ).where(~held_out("__k")).distinct()
    counts = {r["__y"]: r["n"] for r in known.groupBy("__y").agg(F.count("*").alias("n")).collect()}
    if len(counts) < 2:
        return fit(np.zeros((0, len(MEASURES))), np.zeros(0, int), 0.0, cut)
    own = docs.select(F.col(key).alias("__k"), F.col(text).alias("__t")).where(F.col("__k").isNotNull() & ~held_out("__k"))
    rows = scored_vectors(own, "__t", ["__k"]).join(known, "__k").select("__y", F.xxhash64("__k").alias("__h"), "vector")
    blocks = _blocks(rows, counts[0] + counts[1])

    def run(f: Callable) -> list[tuple]:
        def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for k, block in enumerate(batch.column(0).to_pylist()):
                    y = np.frombuffer(batch.column(2)[k].as_buffer(), np.int8)
                    x = np.frombuffer(batch.column(3)[k].as_buffer(), np.float64).reshape(-1, len(MEASURES))
                    value = pa.array([pickle.dumps(f(block, x, y))], pa.binary())
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(k, 1), batch.column(1).slice(k, 1), value], ["block", "part", "value"])

        got = blocks.mapInArrow(each, "block int, part int, value binary").collect()
        return [pickle.loads(r["value"]) for r in sorted(got, key=lambda r: (r["block"], r["part"]))]

    model = _learn(run, counts[0] / (counts[0] + counts[1]), cut, pairs, rounds, seed)
    remove(blocks)
    return model


def score(df: DataFrame, model: Model, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns (all by default), score and predicted. Columns of these two names are replaced."""
    keep = [c for c in (df.columns if keep is None else keep) if c not in ("score", "predicted")]
    sent = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, buf, at in flat.windows(batch.column(len(keep))):
                s = sent.value.score(vectors(buf, at))
                columns = [batch.column(k).slice(lo, hi - lo) for k in range(len(keep))]
                yield pa.RecordBatch.from_arrays(
                    [*columns, pa.array(s), pa.array((s >= sent.value.cut).astype(np.int32))],
                    [*(f"c{k}" for k in range(len(keep))), "score", "predicted"]
                )

    kinds = dict(df.dtypes)
    schema = ", ".join([*(f"c{k} {kinds[c]}" for k, c in enumerate(keep)), "score double", "predicted int"])
    return df.select(
        *(F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(keep)),
        F.col(f"`{text}`").alias("text")
    ).mapInArrow(run, schema).toDF(*keep, "score", "predicted")
