"""Operator 6: language identification with language-bitmask n-gram filters.

A bit-sliced Bloom filter holds one bit a language in every row: the AND of a gram's rows is the set of all
languages that contain the gram. A text's grams are looked up, each language's bits are counted and
corrected for the filter's false positives, and the largest count decides.

Which grams a language contains comes from a bounded sample of documents with a known language: a gram
counts where enough of its documents have it, and not far fewer than of another language's.

Defined results: ``und`` with score 0 for null texts and texts without a letter; if no gram is known, the
most frequent learned language with score 0; ties go to the more frequent language; repeated rows are
predicted alike, and each row by its own text, whatever its doc_id (null too); very long texts are read
whole; without any learned language all are ``und``; an empty table gives no rows. Other columns are
ignored, whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foliant.llm.common import mixed
from foliant.llm.learning import remainder, sampled

SAMPLE, GRAMS = 12_000, 50_000  # documents at most; grams a language at most
ROWS, PROBES, GRAM = 1 << 20, 3, 4
RARE, SHARE, PART = 2, 0.002, 0.3  # documents, share of documents, and part of the largest share that a gram needs
OTHER = re.compile(r"[\W\d_]+")


def grams(text: str) -> np.ndarray:
    """Grams of GRAM bytes (letters in lower case, other signs as one space), in order."""
    raw = np.frombuffer(f"  {OTHER.sub(' ', text.lower()).strip()}  ".encode(), np.uint8)
    return np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(raw, GRAM)).view("<u4").ravel()


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


@dataclass
class Filters:
    names: list[str]  # most frequent first
    rows: np.ndarray  # ROWS x words of 64 languages
    false: np.ndarray  # false positive rate by language

    @staticmethod
    def places(g: np.ndarray) -> Iterator[np.ndarray]:
        h = mixed(g.astype(np.uint64), 0)
        for i in range(PROBES):
            yield ((h >> np.uint64(21 * i)) & np.uint64(ROWS - 1)).astype(np.int64)

    @classmethod
    def of(cls, names: list[str], known: dict[str, np.ndarray]) -> Filters:
        rows = np.zeros((ROWS, max(1, -(-len(names) // 64))), np.uint64)
        for i, name in enumerate(names):
            for at in cls.places(known.get(name, np.zeros(0, np.uint32))):
                rows[at, i // 64] |= np.uint64(1 << (i % 64))
        fill = np.array([float(((rows[:, i // 64] >> np.uint64(i % 64)) & np.uint64(1)).mean()) for i in range(len(names))])
        return cls(names, rows, fill**PROBES)

    def counts(self, g: np.ndarray) -> np.ndarray:
        """Corrected number of grams that each language contains."""
        out = np.zeros(len(self.names))
        for at in range(0, len(g), 1 << 18):
            part = g[at : at + (1 << 18)]
            sets = None
            for p in self.places(part):
                sets = self.rows[p] if sets is None else sets & self.rows[p]
            out += [int(((sets[:, i // 64] >> np.uint64(i % 64)) & np.uint64(1)).sum()) for i in range(len(self.names))]
        return np.maximum(0, (out - len(g) * self.false) / (1 - self.false))

    def predict(self, text: str | None) -> tuple[str, float]:
        if not text or not self.names or not has_letter(text):
            return "und", 0.0
        found = self.counts(grams(text))
        best, total = int(found.argmax()), float(found.sum())
        return self.names[best], float(found[best]) / total if total else 0.0


def learn(docs: DataFrame) -> Filters:
    """Fit on at most SAMPLE documents with a language whose crc32(doc_id) mod 4 is not 2."""
    known = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), "text").filter("lang is not null and doc_id is not null")
    chosen = sampled(known.drop("text"), remainder(4) != 2, SAMPLE, "lang")
    texts = known.join(F.broadcast(chosen), ["doc_id", "lang"]).select("lang", "text")  # of a repeated doc_id the rows in its least language

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            by: dict[str, list[np.ndarray]] = {}
            for lang, text in zip(batch["lang"].to_pylist(), batch["text"].to_pylist(), strict=True):
                by.setdefault(lang, []).append(np.unique(grams(text or "")))
            for lang, found in by.items():
                g, n = np.unique(np.concatenate(found), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(g)), pa.array(g.astype(np.int64)), pa.array(n)], names=["lang", "gram", "n"])

    sizes = {r["lang"]: r["count"] for r in texts.groupBy("lang").count().collect()}
    names = sorted(sizes, key=lambda k: (-sizes[k], k))
    if not names:
        return Filters.of([], {})
    size = F.create_map(*[x for k in names for x in (F.lit(k), F.lit(sizes[k]))])
    share = texts.mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")).filter(F.col("n") >= RARE)
    share = share.withColumn("share", F.col("n") / size[F.col("lang")]).filter(F.col("share") >= SHARE)
    own = share.withColumn("top", F.max("share").over(Window.partitionBy("gram"))).filter(F.col("share") >= PART * F.col("top"))
    ranked = own.withColumn("place", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))).filter(F.col("place") <= GRAMS)
    rows = ranked.select("lang", "gram").toPandas()
    return Filters.of(names, {k: x["gram"].to_numpy(np.uint32) for k, x in rows.groupby("lang")})


def languages(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score."""
    shared = docs.sparkSession.sparkContext.broadcast(learn(docs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [shared.value.predict(t) for t in batch["text"].to_pylist()]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array([x[0] for x in got], pa.string()), pa.array([x[1] for x in got], pa.float64())], names=["doc_id", "lang_pred", "score"])

    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, lang_pred string, score double")
    return found.select("doc_id", (remainder(4) == 2).alias("held_out"), "lang_pred", "score")
