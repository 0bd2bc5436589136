"""URL filter: rules on hosts and paths, and logistic regression for all other URLs.

The classifier works on hashed character n-grams of host and path and is trained on
the driver from the small table of labelled URLs in ``urltable``. Rules stand above it: a rule
fits its host and all subdomains if the URL's path starts with the rule's, and the
longest wins.

A null URL, and one without ``://``, has an empty host and path, fits no rule and is
allowed with score 0 (it has no n-gram). Very long URLs are judged whole; an empty table gives one. Rows are judged
alone, so ties, repeated rows and other columns don't matter: only ``keep`` columns are carried, which mustn't bear the
names of results.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from readweave.llm import flat, urltable

BUCKETS, N = 1 << 16, (3, 4, 5)
#: In paths all digits are alike: numbers of pages tell nothing.
DIGITS = str.maketrans("123456789", "000000000")


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


#: The rules of the corpus.
RULES = (Rule("block", "net", "/"), Rule("allow", "example.net", "/en/"), Rule("block", "example.com", "/de/"), Rule("allow", "org", "/fr/"))

def parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL."""
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://(.*)$", 1)
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    path = F.regexp_extract(rest, r"^[^/?#]*(/[^?#]*)?", 1)
    return host, path


def ruled(host: Column, path: Column, rules: tuple[Rule, ...] = RULES) -> tuple[Column, Column]:
    """Name and verdict of the longest rule that fits, or nulls."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (len(r.name), r.name)):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        name, verdict = F.when(fits, r.name).otherwise(name), F.when(fits, r.verdict).otherwise(verdict)
    return name, verdict


def grams(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the n-grams of texts, flat, and each text's number of them."""
    length = np.fromiter(map(len, texts), np.int64, len(texts))
    data, end = np.frombuffer(b"".join(texts), np.uint8), np.cumsum(length)
    row, place = np.repeat(np.arange(len(texts)), length), np.arange(len(data))
    owners, hashes = [], []
    for n in N:
        inside = place + n <= end[row]
        owners.append(row[inside])
        hashes.append(flat.hash_spans(data, place[inside], place[inside] + n))
    owner, h = np.concatenate(owners), np.concatenate(hashes)
    order = np.argsort(owner, kind="stable")
    return (h[order] & np.uint64(BUCKETS - 1)).astype(np.int64), np.bincount(owner, minlength=len(texts)).astype(np.int64)


def features(hosts: list[str], paths: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, bucket, value) of all n-grams of hosts and of paths; those of a host, and those of a path, make a vector of length about 1."""
    out = []
    for mark, texts in (
        (0, [f"^{h}$".encode() if h else b"" for h in hosts]),
        (BUCKETS // 2, [p.lower().translate(DIGITS).encode() + b"$" if p else b"" for p in paths])
    ):
        ids, n = grams(texts)
        out.append((np.repeat(np.arange(len(texts)), n), ids ^ mark, np.repeat(1 / np.sqrt(np.maximum(n, 1)), n)))
    return tuple(np.concatenate([o[k] for o in out]) for k in range(3))  # type: ignore[return-value]


@dataclass
class Model:
    weights: np.ndarray
    bias: float

    def logits(self, hosts: list[str], paths: list[str]) -> np.ndarray:
        row, ids, value = features(hosts, paths)
        return np.bincount(row, weights=self.weights[ids] * value, minlength=len(hosts)) + self.bias

    def score(self, hosts: list[str], paths: list[str]) -> np.ndarray:
        """Chance that each is to be blocked; 0 where host and path are empty."""
        z = self.logits(hosts, paths)
        some = np.array([bool(h or p) for h, p in zip(hosts, paths, strict=True)], bool)
        return np.where(some, 1 / (1 + np.exp(-z)), 0.0)


def fit(rows: list[tuple[str, str, int]], epochs: int = 150, rate: float = 60.0, decay: float = 3e-5) -> Model:
    """Logistic regression by gradient descent over all rows (host, path, label)."""
    row, ids, value = features([r[0] for r in rows], [r[1] for r in rows])
    y = np.array([label for *_, label in rows], np.float64)
    w, bias = np.zeros(BUCKETS), 0.0
    for _ in range(epochs):
        z = np.bincount(row, weights=w[ids] * value, minlength=len(rows)) + bias
        g = (1 / (1 + np.exp(-z)) - y) / len(rows)
        w -= rate * (np.bincount(ids, weights=g[row] * value, minlength=BUCKETS) + decay * w)
        bias -= g.sum()
    return Model(w, bias)


def train(rows: list[tuple[str, str, int]], folds: int = 4, harm: float = 2.0) -> Model:
    """``fit`` on all rows and their like, with the bias moved so that a chance of a half is where rows kept back are told apart best.

    That is where the share blocked rightly less ``harm`` times the share blocked wrongly is largest.
    """
    model, y = fit(urltable.varied(rows)), np.array([label for *_, label in rows], np.float64)
    z = np.zeros(len(rows))
    for k in range(folds):
        kept = rows[k::folds]
        z[k::folds] = fit(urltable.varied([r for i, r in enumerate(rows) if i % folds != k])).logits([r[0] for r in kept], [r[1] for r in kept])
    order = np.argsort(z, kind="stable")
    gain = np.cumsum(harm * (1 - y[order]) / max((y == 0).sum(), 1) - y[order] / max((y == 1).sum(), 1))  # of a bar above each
    near = np.flatnonzero(gain[:-1] >= gain[:-1].max() - 0.01)  # bars as good as the best one, all but for chance
    model.bias -= float(np.mean((z[order[near]] + z[order[near + 1]]) / 2))
    return model


def judge(df: DataFrame, url: str = "url", keep: tuple[str, ...] = ("page_id",), rules: tuple[Rule, ...] = RULES, bar: float = 0.5) -> DataFrame:
    """``keep`` columns, host, path, rule, verdict and score (the classifier's chance of block)."""
    model = df.sparkSession.sparkContext.broadcast(train(urltable.rows()))
    host, path = parts(F.col(url))
    cut = df.select(*(F.col(k).alias(f"c{i}") for i, k in enumerate(keep)), host.alias("host"), path.alias("path"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 2000):
                part = batch.slice(lo, 2000)
                score = model.value.score(part.column("host").to_pylist(), part.column("path").to_pylist())
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(score)], [*part.schema.names, "score"])

    schema = ", ".join([*(f"`{c}` {t}" for c, t in cut.dtypes), "score double"])
    scored = cut.mapInArrow(run, schema)
    name, verdict = ruled(F.col("host"), F.col("path"), rules)
    own = F.when(F.col("score") >= bar, "block").otherwise("allow")
    return scored.select(
        *(F.col(f"c{i}").alias(k) for i, k in enumerate(keep)),
        "host",
        "path",
        name.alias("rule"),
        F.coalesce(verdict, own).alias("verdict"),
        "score"
    )
