"""Operator 4: toxicity by a factorization machine over hashed terms.

A text's terms are its distinct words (letters only, lower case), hashed. Besides a weight, each term has
a factor vector; the product of two terms' vectors is the weight of the pair, so an insult beside a group
mention can count where neither alone does. Fitted on a bounded sample of labelled rows, over the terms
that tell the labels of the sample apart best, alone or by a pair: a term whose own share of toxic documents is
the sample's enters if some pair with it is toxic more or less often than its two terms alone would have it (looked
for among the terms of the most toxic documents). Every document is scored on all its words.

Defined results: null counts as empty; a text without terms scores the bias alone; repeated rows score
alike, and each row is scored by its own text, whatever its doc_id (null too); very long texts are read
whole; without labelled rows every score is 0; an empty table gives no rows. Other columns are ignored by
the scores and kept by ``drop_toxic``, whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.llm.common import column, place_of, renamed_schema, restored, written
from foliant.llm.learning import labelled_texts, remainder

SPACE = 1 << 22  # hashed terms
SAMPLE, TERMS, RARE = 12_000, 20_000, 3  # labelled rows at most; terms at most; documents that a term needs
APART = 3.5  # standard deviations by which a term's share of toxic documents must differ from the sample's
PAIRED, PAIR_RARE, PAIR_APART = 1000, 10, 6.0  # terms whose pairs are counted; documents of a pair; its standard deviations
BALANCE = 2.0  # weight of a toxic row, at most the ratio of the classes
PRIOR, START = 10, 0.8  # rows at the sample's share that each term's share starts with; part of its log-odds that its weight starts with
FACTORS, EPOCHS, STEPS, BATCH, RATE, DECAY = 8, 30, 3000, 32, 0.1, 1e-5  # as many rounds as give STEPS steps, EPOCHS at least
WORD = re.compile(r"[^\W\d_]+")


def terms(text: str) -> np.ndarray:
    """Distinct hashed terms of a whole text."""
    words = set(WORD.findall(text.lower()))
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    return np.unique(h & np.uint64(SPACE - 1)).astype(np.int32)


@dataclass
class Machine:
    slots: np.ndarray  # term -> row of weights and factors, or -1
    bias: float
    weights: np.ndarray
    factors: np.ndarray

    def scores(self, texts: list[str]) -> np.ndarray:
        found = [(s := self.slots[terms(t)])[s >= 0] for t in texts]
        return self.of_rows(found)

    def of_rows(self, rows: list[np.ndarray]) -> np.ndarray:
        out = np.full(len(rows), self.bias)
        for i, r in enumerate(rows):
            if len(r):
                v = self.factors[r]
                out[i] += self.weights[r].sum() + 0.5 * float((v.sum(axis=0) ** 2 - (v**2).sum(axis=0)).sum())
        return 1 / (1 + np.exp(-np.clip(out, -30, 30)))


def fitted(rows: list[np.ndarray], label: np.ndarray, chosen: np.ndarray) -> Machine:
    """Adaptive gradient descent on the log loss, from weights by the terms' own shares, so that one telling term is enough. rows: per document the places of its terms in ``chosen``."""
    slots = np.full(SPACE, -1, np.int32)
    slots[chosen] = np.arange(len(chosen))
    rng = np.random.default_rng(0)
    rate = np.clip(label.mean(), 1e-3, 1 - 1e-3) if len(label) else 0.0
    model = Machine(slots, float(np.log(rate / (1 - rate))) if len(label) else -30.0, np.zeros(len(chosen)), rng.normal(0, 0.01, (len(chosen), FACTORS)))
    w, v = model.weights, model.factors
    if len(label):
        flat, own = np.concatenate(rows), np.repeat(label, [len(r) for r in rows])
        share = (np.bincount(flat, own, len(w)) + PRIOR * rate) / (np.bincount(flat, minlength=len(w)) + PRIOR)
        w += START * (np.log(share / (1 - share)) - model.bias)
    toxic = min(BALANCE, max(1.0, (1 - rate) / rate)) if len(label) else 1.0
    gw, gv, gb = np.full(len(w), 1e-3), np.full(v.shape, 1e-3), 1e-3
    for _ in range(max(EPOCHS, STEPS * BATCH // max(1, len(rows)))):
        order = rng.permutation(len(rows))
        for at in range(0, len(order), BATCH):
            batch = order[at : at + BATCH]
            flat = np.concatenate([rows[i] for i in batch])
            owner = np.repeat(np.arange(len(batch)), [len(rows[i]) for i in batch])
            sums = np.zeros((len(batch), FACTORS))
            np.add.at(sums, owner, v[flat])
            squares = np.bincount(owner, (v[flat] ** 2).sum(axis=1), len(batch))
            raw = model.bias + np.bincount(owner, w[flat], len(batch)) + 0.5 * ((sums**2).sum(axis=1) - squares)
            error = (1 / (1 + np.exp(-np.clip(raw, -30, 30))) - label[batch]) * np.where(label[batch] == 1, toxic, 1.0)
            gb += float((error**2).mean())
            model.bias -= RATE * float(error.mean()) / gb**0.5
            touched, back = np.unique(flat, return_inverse=True)
            dw = np.bincount(back, error[owner], len(touched)) / len(batch) + DECAY * w[touched]
            dv = np.zeros((len(touched), FACTORS))
            np.add.at(dv, back, error[owner, None] * (sums[owner] - v[flat]))
            dv = dv / len(batch) + DECAY * v[touched]
            gw[touched] += dw**2
            gv[touched] += dv**2
            w[touched] -= RATE * dw / np.sqrt(gw[touched])
            v[touched] -= RATE * 0.1 * dv / np.sqrt(gv[touched])
    return model


def telling_in_pairs(rows: list[np.ndarray], label: np.ndarray, n: int) -> np.ndarray:
    """Places below n of terms with a pair whose share of toxic documents differs from the sum of both terms' log-odds.

    rows: per document the places of its terms; those from n on aren't looked at.
    """
    both, ones = np.zeros((n, n)), np.zeros((n, n))
    for at in range(0, len(rows), 1000):
        some = rows[at : at + 1000]
        x = np.zeros((len(some), n), np.float32)
        for i, r in enumerate(some):
            x[i, r[r < n]] = 1
        both += x.T @ x
        ones += x.T @ (x * label[at : at + 1000, None].astype(np.float32))
    rate = (label.sum() + 1) / (len(label) + 2)
    alone = (ones.diagonal() + rate) / (both.diagonal() + 1)
    odds = np.log(alone / (1 - alone))
    share = 1 / (1 + np.exp(np.log(rate / (1 - rate)) - odds[:, None] - odds))
    apart = np.abs(ones - both * share) / np.sqrt(np.maximum(both * share * (1 - share), 1))
    apart[both < PAIR_RARE] = 0
    np.fill_diagonal(apart, 0)
    return np.flatnonzero(apart.max(axis=1, initial=0) >= PAIR_APART)


def learn(docs: DataFrame, labels: DataFrame) -> Machine:
    """Fit on labelled rows whose crc32(doc_id) mod 5 is not 0."""

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [terms(t or "") for t in batch["text"].to_pylist()]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["label"], pa.array([x.tolist() for x in got], pa.list_(pa.int32()))], names=["doc_id", "label", "terms"])

    texts = labelled_texts(docs, labels, "toxic", remainder(5) != 0, SAMPLE)
    found = written(texts.mapInArrow(extract, "doc_id long, label int, terms array<int>"), "terms")
    size = found.agg(F.count("*").alias("n"), F.coalesce(F.sum("label"), F.lit(0)).alias("ones")).first()
    counts = found.select("label", F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("n"), F.sum("label").alias("ones")).filter(F.col("n") >= RARE)
    rate = (size["ones"] + 1) / (size["n"] + 2)
    apart = F.abs((F.col("ones") - F.col("n") * rate) / F.sqrt(F.col("n") * rate * (1 - rate)))
    best = counts.withColumn("apart", apart).filter(F.col("apart") >= APART).orderBy(F.desc("apart"), "term").limit(TERMS)
    pool = [r["term"] for r in counts.orderBy(F.desc("ones"), "term").limit(PAIRED).collect()]
    alone = [r["term"] for r in best.collect()]
    wanted = np.array(pool + sorted(set(alone) - set(pool)), np.int64)  # those whose pairs are counted come first
    places = docs.sparkSession.createDataFrame([(int(t), i) for i, t in enumerate(wanted)], "term int, place int")
    known = found.select("doc_id", "label", F.explode_outer("terms").alias("term")).join(F.broadcast(places), "term", "left")
    rows = known.groupBy("doc_id", "label").agg(F.sort_array(F.collect_list("place")).alias("places")).orderBy("doc_id").toPandas()
    label, rows = rows["label"].to_numpy(np.float64), [np.array(p, np.int64) for p in rows["places"]]
    chosen = np.array(sorted({*alone, *wanted[telling_in_pairs(rows, label, len(pool))].tolist()}), np.int64)
    row = np.full(len(wanted), -1)
    row[np.isin(wanted, chosen)] = np.searchsorted(chosen, wanted[np.isin(wanted, chosen)])
    return fitted([(r := row[p])[r >= 0] for p in rows], label, chosen)


def score(docs: DataFrame, model: Machine) -> DataFrame:
    """One row a document: doc_id, score."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = shared.value.scores([t or "" for t in batch["text"].to_pylist()])
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(s, pa.float64())], names=["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, score double")


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    scored = score(docs, learn(docs, labels))
    return scored.select("doc_id", (remainder(5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that are not rejected, with all their columns; each row is decided where it stands."""
    shared, text = docs.sparkSession.sparkContext.broadcast(learn(docs, labels)), place_of(docs, "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            clean = shared.value.scores([t or "" for t in batch[text].to_pylist()]) < 0.5
            yield batch.filter(pa.array(clean, pa.bool_()))

    rows = docs.select(*[column(c).alias(f"c{i}") for i, c in enumerate(docs.columns)])
    return restored(rows.mapInArrow(run, renamed_schema(docs)), docs)
