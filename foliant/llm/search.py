"""Operator 11: ranked lexical search by hashed max-sketches, bounds in batches, and exact rescoring.

The index holds a sketch beside each text: its terms fall into a number of coordinates that follows its length,
and each coordinate keeps the largest term frequency that fell into it. As a term's impact in one document only
grows with its frequency, the impact of a coordinate is at least that of any term in it, so the sum of query
weight times impact over a query's terms is an upper bound of its score. For a batch of sketches of one width and
a block of queries the bounds are one matrix product, exact in doubles. A task keeps the best documents of
each query so far; those of a batch are scored from their texts in the order of falling bounds, until the next bound
can't enter. What a task kept meets what others kept, by query.

Queries come in blocks: bounded by number and by terms, each block reads the index once.

Defined results: a null or empty text, or one without a term, is no document of the collection and is found by
nothing; a query without a term, or without one that a document holds, finds nothing; queries that share an
item_id (null is one too) are one query with the terms of all; rows that share a doc_id are documents of their
own, of equal scores the smaller doc_id comes first, null last; very long texts are read whole, and their sketches stop
at WIDEST coordinates, which loosens their bounds only; an empty table on either side gives no rows. Further
columns are ignored, whatever their names.
"""

from __future__ import annotations

import functools
import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.llm.common import leading, written

BEST = 10
NARROWEST, WIDEST, SPREAD = 64, 1 << 14, 8  # coordinates: SPREAD a distinct term, as a power of two
MOST = 255  # a coordinate's largest frequency; it stands for any larger one too
BLOCK, BLOCK_TERMS = 256, 1 << 14  # queries and terms of a block; one query may hold more terms
CELLS = 1 << 21  # of the matrices worked on at once
SCALE, SHORT, SLOPE, SOFT = 1_000_000_000, 10, 90, 8  # fixed values: an impact is SCALE * tf div (1000 * tf + SOFT * m), m = SHORT + SLOPE * n * N div L
LAST = (1 << 63) - 1  # stands for a null doc_id

#: ASCII letters and digits lower-cased, all other ASCII as spaces.
SIGNS = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))
INDEX = "doc_id long, text string, n long, sketch binary"


def terms(raw: bytes | None) -> list[bytes]:
    return (raw or b"").translate(SIGNS).split()


place = xxhash.xxh3_64_intdigest


def width(distinct: int) -> int:
    return min(WIDEST, max(NARROWEST, 1 << (SPREAD * distinct - 1).bit_length()))


def sketch(found: Counter) -> bytes:
    """Largest frequency of each coordinate, at most MOST."""
    out = np.zeros(width(len(found)), np.uint8)
    at = np.fromiter(map(place, found), np.uint64, len(found)) & np.uint64(len(out) - 1)
    np.maximum.at(out, at.astype(np.int64), np.minimum(np.fromiter(found.values(), np.int64, len(found)), MOST).astype(np.uint8))
    return out.tobytes()


def sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [Counter(terms(raw)) for raw in batch["text"].cast(pa.binary()).to_pylist()]
        arrays = [batch["doc_id"], batch["text"], pa.array([x.total() for x in found], pa.int64()), pa.array([sketch(x) if x else b"" for x in found], pa.binary())]
        yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "text", "n", "sketch"])


def index(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) -> INDEX, written; rows without a term are left out."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return written(rows.mapInArrow(sketched, INDEX).filter("n > 0"), "sketches")


def blocks(items: DataFrame) -> Iterator[dict[int | None, set[bytes]]]:
    """Queries (item_id, terms) in blocks; the driver holds one block."""
    one = items.groupBy("item_id").agg(F.collect_list("text").alias("texts")).orderBy("item_id")
    now: dict = {}
    size = 0
    for row in one.toLocalIterator():
        own = {t for text in row["texts"] for t in terms(text.encode())}
        if not own:
            continue
        if now and (len(now) >= BLOCK or size + len(own) > BLOCK_TERMS):
            yield now
            now, size = {}, 0
        now[row["item_id"]] = own
        size += len(own)
    if now:
        yield now


def holders(wanted: Broadcast, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """term, df: in how many of these texts each term of the block stands."""
    found: Counter = Counter()
    for batch in batches:
        for raw in batch["text"].cast(pa.binary()).to_pylist():
            found.update(wanted.value.intersection(terms(raw)))
    yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.binary()), pa.array(list(found.values()), pa.int64())], names=["term", "df"])


class Queries:
    """A block of queries with the weights of their terms, and what scores depend on."""

    def __init__(self, block: dict[int | None, set[bytes]], df: dict[bytes, int], n_docs: int, n_terms: int) -> None:
        weight = {t: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * n + 1))) for t, n in df.items()}
        self.names = [k for k, own in block.items() if any(t in df for t in own)]
        self.terms = [sorted((t, weight[t]) for t in block[k] if t in df) for k in self.names]
        self.row = {t: i for i, t in enumerate(sorted(weight))}
        self.weights = np.zeros((len(self.row), len(self.names)))
        for q, own in enumerate(self.terms):
            for t, w in own:
                self.weights[self.row[t], q] = w
        self.n_docs, self.n_terms = n_docs, n_terms
        self.by_width: dict[int, np.ndarray] = {}

    def soft(self, n: int) -> int:
        """What length adds to a frequency."""
        return SOFT * (SHORT + SLOPE * n * self.n_docs // self.n_terms)

    def matrix(self, wide: int) -> np.ndarray:
        """Coordinate and query -> sum of the weights of the query's terms that fall there."""
        if wide not in self.by_width:
            out = np.zeros((wide, len(self.names)))
            for q, own in enumerate(self.terms):
                for t, w in own:
                    out[place(t) & (wide - 1), q] += w
            self.by_width[wide] = out
        return self.by_width[wide]

    def bounds(self, sketches: np.ndarray, soft: np.ndarray) -> np.ndarray:
        """Document and query -> no score is above; whole numbers below 2^53, so sums are exact."""
        tf = sketches.astype(np.int64)
        impact = SCALE * tf // np.maximum(1, 1000 * tf + soft[:, None])
        impact[tf == MOST] = SCALE // 1000
        return impact.astype(np.float64) @ self.matrix(sketches.shape[1])

    def scores(self, found: Counter, soft: int) -> np.ndarray:
        """The document's exact score for each query."""
        own = [(r, tf) for t, tf in found.items() if (r := self.row.get(t)) is not None]
        tf = np.array([x[1] for x in own], np.int64)
        return (SCALE * tf // (1000 * tf + soft)).astype(np.float64) @ self.weights[[x[0] for x in own]]


class Best:
    """The first documents of a query so far, best first: (-score, doc_id)."""

    def __init__(self, most: int) -> None:
        self.most, self.rows = most, []

    def last(self) -> tuple[int, int]:
        """What the next row has to come before."""
        return self.rows[-1] if len(self.rows) == self.most else (0, -LAST - 1)

    def offer(self, row: tuple[int, int]) -> None:
        if row < self.last():
            self.rows = sorted([*self.rows, row])[: self.most]


def looked_up(queries: Broadcast, most: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """item, doc, score: the best documents among these rows."""
    block: Queries = queries.value
    best = [Best(most) for _ in block.names]
    for batch in batches:
        ids, raws, lengths = [LAST if d is None else d for d in batch["doc_id"].to_pylist()], batch["text"].cast(pa.binary()), batch["n"].to_pylist()
        by_width: dict[int, list[int]] = {}
        sketches = batch["sketch"].to_pylist()
        for i, s in enumerate(sketches):
            by_width.setdefault(len(s), []).append(i)
        for wide, members in sorted(by_width.items()):
            step = max(1, CELLS // max(wide, len(block.names)))
            for at in range(0, len(members), step):
                own = members[at : at + step]
                soft = [block.soft(lengths[i]) for i in own]
                bounds = block.bounds(np.frombuffer(b"".join(sketches[i] for i in own), np.uint8).reshape(len(own), wide), np.array(soft, np.int64))
                exact: dict[int, list[float]] = {}
                for q, b in enumerate(best):
                    column = bounds[:, q]
                    some = np.flatnonzero(column >= max(1, -b.last()[0]))
                    order = sorted(some.tolist(), key=lambda i: (-column[i], ids[own[i]]))  # noqa: B023
                    for i in order:
                        if (-column[i], ids[own[i]]) >= b.last():
                            break  # neither this one nor any after it can enter
                        if i not in exact:  # scored once, for all queries of the block
                            exact[i] = block.scores(Counter(terms(raws[own[i]].as_py())), soft[i]).tolist()
                        if s := int(exact[i][q]):
                            b.offer((-s, ids[own[i]]))
    rows = [(q, None if d == LAST else d, -s) for q, b in enumerate(best) for s, d in b.rows]
    yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate((pa.int32(), pa.int64(), pa.int64()))], names=["item", "doc_id", "score"])


def search(known: DataFrame, items: DataFrame, most: int = BEST) -> DataFrame:
    """known: an ``index``; items (item_id, text) -> item_id, rank, doc_id, score."""
    spark = known.sparkSession
    size = known.agg(F.count("*").alias("n"), F.coalesce(F.sum("n"), F.lit(0)).alias("terms")).first()
    kind = items.schema["item_id"].dataType
    out = None
    for block in blocks(items.select("item_id", F.col("text").cast("string").alias("text"))) if size["n"] else ():
        wanted = spark.sparkContext.broadcast(frozenset().union(*block.values()))
        df = known.select("text").mapInArrow(functools.partial(holders, wanted), "term binary, df long").groupBy("term").agg(F.sum("df").alias("df"))
        queries = Queries(block, {bytes(r["term"]): r["df"] for r in df.collect()}, size["n"], size["terms"])
        if not queries.names:
            continue
        found = known.mapInArrow(functools.partial(looked_up, spark.sparkContext.broadcast(queries), most), "item int, doc_id long, score long")
        top = leading(found, ["item"], [F.desc("score"), F.asc_nulls_last("doc_id")], most, ["doc_id"])
        names = spark.createDataFrame([(i, x) for i, x in enumerate(queries.names)], f"item int, item_id {kind.simpleString()}")  # BLOCK rows at most
        rows = written(top.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score"), "ranked")
        out = rows if out is None else out.union(rows)
    return spark.createDataFrame([], f"item_id {kind.simpleString()}, rank int, doc_id long, score long") if out is None else out


def ranked(docs: DataFrame, items: DataFrame, most: int = BEST) -> DataFrame:
    """Each item's best documents: item_id, rank, doc_id, score."""
    return search(index(docs), items, most)
