"""Language identification: averaged hashed subword embeddings under a linear softmax.

A word's subwords are its byte n-grams of ``N`` bytes, with marks for its two ends,
and the word itself, hashed into ``BUCKETS``. A text's vector is the average of its
subwords' embeddings; a softmax over a linear layer gives the languages. Embeddings
and layer are trained together by stochastic gradient descent in numpy, on the
driver, from a bounded sample. A temperature fitted on a part kept back calibrates
the scores, and the score that all but a small share of that part's right answers
exceed is the bar below which an answer counts as rejected.

A text that is null or has no letter gets ``und`` and score 0. Every other text gets
the likeliest language; whether it is rejected stands in a column of its own. With
no labelled row at all, every text gets ``und``. Whole texts count, however long. Equally
likely languages: the one first in alphabetical order. Rows are judged alone, so
repeated rows get the same answer; an empty table gives none. Columns that bear the
results' names are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from readweave.llm import flat
from readweave.session import remove, written

BUCKETS, N, DIMENSIONS = 1 << 16, (3, 4), 12
LETTER = regex.compile(r"\p{L}")


def subwords(pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the subwords of words, flat, and each word's number of them."""
    length = np.fromiter(map(len, pieces), np.int64, len(pieces)) + 2
    data = np.frombuffer(b"".join(b"<" + p + b">" for p in pieces), np.uint8)
    end = np.cumsum(length)
    begin = end - length
    word = np.repeat(np.arange(len(pieces)), length)
    owners, hashes = [np.arange(len(pieces))], [flat.hash_spans(data, begin, end)]
    place = np.arange(len(data))
    for n in N:
        inside = place + n <= end[word]
        owners.append(word[inside])
        hashes.append(flat.hash_spans(data, place[inside], place[inside] + n))
    owner, h = np.concatenate(owners), np.concatenate(hashes)
    order = np.argsort(owner, kind="stable")
    return (h[order] & np.uint64(BUCKETS - 1)).astype(np.uint32), np.bincount(owner, minlength=len(pieces)).astype(np.int64)


def buckets(buf: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all subwords of a window's texts, flat, and each text's number of them. A-Z count as a-z."""
    table = flat.resident("subwords", lambda: flat.PieceTable(subwords, limit=800_000, id_limit=20_000_000))
    low = flat.LOWER[buf]
    start, end, row = flat.word_spans(low, at)
    ids, n = table.lookup(low, start, end)  # type: ignore[attr-defined]
    return ids, flat.row_sums(n, row, len(at) - 1)


def lettered(buf: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether each text has a letter."""
    run = np.r_[0, np.cumsum(flat.BYTE_CLASS[buf] == flat.LETTER)]
    out = run[at[1:]] > run[at[:-1]]
    for k in np.flatnonzero(~out & (np.diff(at) > 0)):
        out[k] = bool(LETTER.search(buf[at[k] : at[k + 1]].tobytes().decode("utf-8", "ignore")))
    return out


@dataclass
class Model:
    """``table``: what a subword of each bucket adds to each language's logit."""

    languages: list[str]
    table: np.ndarray
    bias: np.ndarray
    temperature: float
    bar: float

    def chances(self, ids: np.ndarray, counts: np.ndarray) -> np.ndarray:
        ends = np.cumsum(counts)
        logits = np.zeros((len(counts), len(self.languages)))
        some = counts > 0
        if some.any():
            logits[some] = np.add.reduceat(self.table[ids], (ends - counts)[some], axis=0, dtype=np.float64) / counts[some, None]
        z = (logits + self.bias) / self.temperature
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return z / z.sum(axis=1, keepdims=True)


def fit(
    samples: list[tuple[np.ndarray, np.ndarray]],
    labels: list[str],
    epochs: int = 6,
    rate: float = 0.5,
    seed: int = 5,
    rejected: float = 0.002
) -> Model:
    """``samples``: for each text its distinct buckets and how often each occurs. A fifth calibrates."""
    languages = sorted(set(labels))
    y = np.array([languages.index(x) for x in labels])
    rng, c = np.random.default_rng(seed), len(languages)
    embed = rng.normal(0, 0.1, (BUCKETS, DIMENSIONS))
    layer, bias = rng.normal(0, 0.1, (DIMENSIONS, c)), np.zeros(c)
    usable = [k for k, (ids, _) in enumerate(samples) if len(ids)]
    order = rng.permutation(usable) if usable else np.zeros(0, int)
    kept, learnt = order[: len(order) // 5], order[len(order) // 5 :]
    weight = 1 / np.maximum(np.bincount(y[learnt], minlength=c), 1)
    weight *= len(learnt) / max(c, 1)

    def pooled(k: int) -> tuple[np.ndarray, np.ndarray]:
        ids, n = samples[k]
        return ids, n / n.sum()

    for epoch in range(epochs):
        step = rate * (1 - epoch / epochs)
        for k in rng.permutation(learnt):
            ids, share = pooled(k)
            h = share @ embed[ids]
            z = h @ layer + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[y[k]] -= 1
            g = p * min(weight[y[k]], 4.0)
            back = layer @ g
            layer -= step * np.outer(h, g)
            bias -= 0.1 * step * g
            # the embeddings share one step over the text: scaled so that it doesn't vanish in long texts
            embed[ids] -= step * np.outer(share / max(share.max(), 1e-9) * 0.2, back)
    model = Model(languages, (embed @ layer).astype(np.float32), bias, 1.0, 0.0)
    if len(kept):
        logits = np.stack([(pooled(k)[1] @ model.table[samples[k][0]]) + bias for k in kept])
        doubt = 1 / (len(kept) + 2)  # no answer counts as certain, else scores would all be 1 where every answer is right
        target = np.full((len(kept), c), doubt / max(c - 1, 1))
        target[np.arange(len(kept)), y[kept]] = 1 - doubt if c > 1 else 1

        def loss(t: float) -> float:
            z = logits / t
            z = z - z.max(axis=1, keepdims=True)
            return float((np.log(np.exp(z).sum(axis=1)) - (target * z).sum(axis=1)).mean())

        model.temperature = min(np.geomspace(0.05, 20, 60), key=loss)
        z = np.exp(logits / model.temperature - (logits / model.temperature).max(axis=1, keepdims=True))
        p = z / z.sum(axis=1, keepdims=True)
        right = p.argmax(axis=1) == y[kept]
        model.bar = float(np.quantile(p.max(axis=1)[right], rejected)) if right.any() else 0.0
    return model


#: Distinct buckets of subwords of a sampled text that count at most: those that occur most.
ENTRIES = 4096


def sample(df: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", per_language: int = 600, sample_entries: int = 12_000_000) -> pd.DataFrame:
    """(lang, h, ids, n): labelled rows to learn from, with the buckets of their subwords and how often each occurs.

    ``per_language`` rows of each language, those with the least hashes of their keys; with very many languages fewer of
    each, at least one: their buckets come to ``sample_entries`` at most (8 bytes each on the driver), or to ENTRIES a language if
    that is more. It is put in the order of the hashes, so the same rows give the same model however they
    are partitioned. Rows of one key are taken in the order of their subwords.
    """
    rows = df.select(F.col(lang).cast("string").alias("lang"), F.col(text).alias("text"), F.xxhash64(key).alias("h"), F.col(key).alias("key"))
    rows = rows.where("lang is not null and text is not null and key is not null").drop("key")
    sizes = written(rows.groupBy("lang").agg(F.count("*").alias("n")), "languages")
    quota, languages = per_language, max(sizes.count(), 1)
    # a hash threshold that several times the quota pass, so that ranks are taken of few rows
    part = F.pmod(F.col("h"), F.lit(1 << 40)) < F.least(F.lit(1.0), (4 * quota + 32) / F.col("n")) * (1 << 40)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, buf, at in flat.windows(batch.column(2)):
                ids, counts = buckets(buf, at)
                parts = [commonest(*np.unique(x, return_counts=True)) for x in np.split(ids, np.cumsum(counts)[:-1])]
                n = np.array([len(p[0]) for p in parts])
                first = [batch.column(k).slice(lo, hi - lo) for k in range(2)]
                yield pa.RecordBatch.from_arrays(
                    [
                        *first,
                        flat.binary_rows(np.concatenate([p[0] for p in parts]).astype(np.uint32), n),
                        flat.binary_rows(np.concatenate([p[1] for p in parts]).astype(np.uint32), n)
                    ],
                    ["lang", "h", "ids", "n"]
                )

    chosen = rows.join(sizes, "lang").where(part).select("lang", "h", "text").mapInArrow(run, "lang string, h long, ids binary, n binary")
    order = ["h", "ids", "n"]
    within = Window.partitionBy("lang").orderBy(*order)
    size = F.octet_length("ids") / 4
    ranked = chosen.withColumns({"r": F.row_number().over(within), "so_far": F.sum(size).over(within.rowsBetween(Window.unboundedPreceding, 0))})
    share = sample_entries / languages
    got = ranked.where(F.col("r") <= quota).where((F.col("r") == 1) | (F.col("so_far") <= share)).drop("r", "so_far")
    got = got.toPandas().sort_values(["lang", *order], kind="stable")
    remove(sizes)
    return got


def commonest(ids: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """ENTRIES ids at most, those that occur most, in ascending order."""
    if len(ids) > ENTRIES:
        kept = np.sort(np.argsort(-n, kind="stable")[:ENTRIES])
        ids, n = ids[kept], n[kept]
    return ids, n


def train(df: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", per_language: int = 600, sample_entries: int = 12_000_000) -> Model | None:
    """Fit on a ``sample``: bounded however many rows and languages there are. None if there is nothing to learn from."""
    got = sample(df, text, lang, key, per_language, sample_entries)
    if not len(got):
        return None
    samples = [(np.frombuffer(a, np.uint32), np.frombuffer(b, np.uint32)) for a, b in zip(got["ids"], got["n"], strict=True)]
    return fit(samples, got["lang"].tolist())


def predict(df: DataFrame, model: Model | None, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns (all by default), lang_pred, score and rejected, which replace columns of these names."""
    keep = [c for c in (df.columns if keep is None else keep) if c not in ("lang_pred", "score", "rejected")]
    sent = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for batch in batches:
            for lo, hi, buf, at in flat.windows(batch.column(len(keep))):
                known = lettered(buf, at)
                best, score, rejected = np.full(hi - lo, "und", object), np.zeros(hi - lo), np.ones(hi - lo, bool)
                if m is not None:
                    p = m.chances(*buckets(buf, at))
                    best[known] = np.array(m.languages, object)[p.argmax(axis=1)][known]
                    score[known] = p.max(axis=1)[known]
                    rejected[known] = score[known] < m.bar
                columns = [batch.column(k).slice(lo, hi - lo) for k in range(len(keep))]
                yield pa.RecordBatch.from_arrays(
                    [*columns, pa.array(best.tolist(), pa.string()), pa.array(score), pa.array(rejected)],
                    [*(f"c{k}" for k in range(len(keep))), "lang_pred", "score", "rejected"]
                )

    kinds = dict(df.dtypes)
    schema = ", ".join([*(f"c{k} {kinds[c]}" for k, c in enumerate(keep)), "lang_pred string, score double, rejected boolean"])
    return df.select(
        *(F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(keep)),
        F.col(f"`{text}`").alias("text")
    ).mapInArrow(run, schema).toDF(*keep, "lang_pred", "score", "rejected")
