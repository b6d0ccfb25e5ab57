"""Operator 8: quality by histogram gradient-boosted trees over document statistics.

Statistics of the whole text (lengths, kinds of letters, repetition) are binned by quantiles; trees grow
level by level on histograms of gradients and are kept as flat arrays of features, borders and leaf values,
so scoring walks all rows of a batch down all trees with numpy.

Defined results: null counts as empty; an empty text is scored on its statistics (zeros) like any other;
repeated rows score alike, and each row by its own text, whatever its doc_id (null too); very long texts
are read whole; without labelled rows every score is 0; an empty table gives no rows. Other columns are
ignored, whatever their names.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.llm.common import text_bytes
from foliant.llm.learning import remainder, sampled

SAMPLE, BINS, TREES, DEPTH, RATE, RIDGE, GAIN = 20_000, 64, 60, 4, 0.2, 1.0, 1e-3
MARKS = b"!#$%&*|.,?:;-\"'()<>@/=_{}[]\\+~^`"


def statistics(text: bytes) -> list[float]:
    """Numbers that describe a whole text."""
    n = max(1, len(text))
    count = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    words = text.split()
    m = max(1, len(words))
    lower, upper = int(count[97:123].sum()), int(count[65:91].sum())
    lines = text.split(b"\n")
    seen = Counter(words)
    most = max(seen.values(), default=0)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    out = [
        np.log1p(len(text)), np.log1p(len(words)), np.log1p(len(lines)),
        lower / n, upper / n, count[48:58].sum() / n, count[128:].sum() / n, count[9:14].sum() / n, count[32] / n,
        upper / max(1, lower + upper),
        float(lengths.mean()) if len(words) else 0.0, float(lengths.std()) if len(words) else 0.0, float(lengths.max()) if len(words) else 0.0,
        (lengths <= 3).sum() / m, (lengths >= 20).sum() / m,
        len(seen) / m, most / m, len(set(lines)) / len(lines), len(words) / len(lines),
    ]
    return [float(x) for x in out] + (count[np.frombuffer(MARKS, np.uint8)] / n).tolist()


FEATURES = len(statistics(b""))


@dataclass
class Trees:
    bias: float
    feature: np.ndarray  # trees x inner nodes
    border: np.ndarray
    leaf: np.ndarray  # trees x leaves

    def scores(self, x: np.ndarray) -> np.ndarray:
        raw = np.full(len(x), self.bias)
        rows = np.arange(len(x))
        for f, b, leaf in zip(self.feature, self.border, self.leaf, strict=True):
            node = np.zeros(len(x), np.int64)
            for _ in range(DEPTH):
                node = 2 * node + 1 + (x[rows, f[node]] > b[node])
            raw += leaf[node - (len(f))]
        return 1 / (1 + np.exp(-np.clip(raw, -30, 30)))


def grown(x: np.ndarray, y: np.ndarray) -> Trees:
    """Boost the log loss. A node that nothing splits sends all its rows left."""
    inner, leaves = 2**DEPTH - 1, 2**DEPTH
    rate = float(np.clip(y.mean(), 1e-3, 1 - 1e-3)) if len(y) else 0.0
    out = Trees(float(np.log(rate / (1 - rate))) if len(y) else -30.0, np.zeros((TREES, inner), np.int64), np.full((TREES, inner), np.inf), np.zeros((TREES, leaves)))
    if not len(y):
        return out
    borders = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(x.shape[1])]
    binned = np.stack([np.searchsorted(b, x[:, j], "left") for j, b in enumerate(borders)], axis=1)
    raw = np.full(len(y), out.bias)
    for t in range(TREES):
        p = 1 / (1 + np.exp(-raw))
        grad, hess = p - y, p * (1 - p)
        node = np.zeros(len(y), np.int64)
        for level in range(DEPTH):
            first, width = 2**level - 1, 2**level
            at = node - first
            best = np.full(width, GAIN)
            for j in range(x.shape[1]):
                cell = at * BINS + binned[:, j]
                g = np.bincount(cell, grad, width * BINS).reshape(width, BINS).cumsum(axis=1)
                h = np.bincount(cell, hess, width * BINS).reshape(width, BINS).cumsum(axis=1)
                ga, ha = g[:, -1:], h[:, -1:]
                gain = g**2 / (h + RIDGE) + (ga - g) ** 2 / (ha - h + RIDGE) - ga**2 / (ha + RIDGE)
                gain = gain[:, : len(borders[j])]
                if not gain.shape[1]:
                    continue
                k = gain.argmax(axis=1)
                won = gain[np.arange(width), k] > best
                best[won] = gain[np.arange(width), k][won]
                out.feature[t, first : first + width][won] = j
                out.border[t, first : first + width][won] = borders[j][k[won]]
            f = out.feature[t, node]
            node = 2 * node + 1 + (x[np.arange(len(y)), f] > out.border[t, node])
        leaf = node - inner
        out.leaf[t] = -RATE * np.bincount(leaf, grad, leaves) / (np.bincount(leaf, hess, leaves) + RIDGE)
        raw += out.leaf[t][leaf]
    return out


def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        got = [statistics(t.as_py()) for t in batch["_text"]]
        yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["label"], pa.array(got, pa.list_(pa.float64()))], names=["doc_id", "label", "x"])


def learn(docs: DataFrame, labels: DataFrame) -> Trees:
    """Fit on at most SAMPLE labelled rows whose crc32(doc_id) mod 4 is not 2."""
    named = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("label")).filter("label is not null and doc_id is not null")
    chosen = sampled(named, remainder(4) != 2, SAMPLE)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes().alias("_text")).join(F.broadcast(chosen), "doc_id")
    rows = texts.mapInArrow(measured, "doc_id long, label int, x array<double>").orderBy("doc_id").toPandas()
    x = np.array(rows["x"].tolist(), np.float64).reshape(len(rows), FEATURES)
    return grown(x, rows["label"].to_numpy(np.float64))


def score(docs: DataFrame, model: Trees) -> DataFrame:
    """One row a document: doc_id, score."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array([statistics(t.as_py()) for t in batch["_text"]], np.float64).reshape(-1, FEATURES)
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(shared.value.scores(x), pa.float64())], names=["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes().alias("_text")).mapInArrow(run, "doc_id long, score double")


def quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    scored = score(docs, learn(docs, labels))
    return scored.select("doc_id", (remainder(4) == 2).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))
