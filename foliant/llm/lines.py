"""Operator 12: line deduplication by a sharded minimal perfect hash over the hashes of frequent lines.

A line's key is the line without ASCII white space at its ends, A-Z lower-cased. Keys of at least LETTERS code
points are counted under 128-bit hashes, once a document. Those in at least COPIES documents are dealt to shards
by their hash. In a shard, each level of a bit array gives a place to the hashes that fall alone on one of its
bits, the others go on to the next level; the number of bits set before a hash's own is its index, so n
hashes have the indexes 0 to n - 1. Arrays at these indexes hold a 64-bit fingerprint, the number of documents
and the document that keeps the line. Documents probe the arrays where they stand; lines aren't joined.

The arrays go to the tasks in rounds of ROUND bytes at most. If they fit into one round, the texts are probed
directly. Else the documents' line hashes are written by round, probed round by round, each round with its own
shards alone, and what each document loses comes back to it by its row. A frequent line is one entry of the
arrays however many documents hold it, so it makes no task larger.

Defined results: a null text is an empty one and has one empty line; every row is a document of its own, also
where doc_ids repeat or are null; a key stays in the rows with the largest doc_id that holds it (null is
smaller than any) and, repeated within a row, stays there with all its lines; very long texts are read whole; a
text that loses all its lines is empty; an empty table gives no rows. Other columns are ignored by
``line_digests`` and kept by ``drop_lines``, whatever their names.
"""

from __future__ import annotations

import functools
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliant.llm.common import column, mixed, numbered, place_of, renamed_schema, written
from foliant.sources.files import shared_dir

LETTERS, COPIES = 40, 5
SHARD = 1 << 17  # hashes a shard, on average
ROUND = 1 << 26  # bytes of arrays that a task holds at once
FREE = 1.6  # bits of a level for each hash that is left
NOBODY = -(1 << 63)  # stands for a null doc_id

LOST = "n_lines long, n_dropped long, kept string"
SHARDS = "shard long, n long, sizes binary, bits binary, fingerprints binary, counts binary, keepers binary"


def keyed(raw: bytes) -> tuple[list[bytes], list[int], list[bytes]]:
    """A text's lines; the places of those with a key that is long enough; their keys' hashes, 16 bytes each."""
    split = raw.split(b"\n")
    at: list[int] = []
    found: list[bytes] = []
    for i, line in enumerate(split):
        key = line.strip()
        if len(key) >= LETTERS and (key.isascii() or len(key.decode(errors="replace")) >= LETTERS):
            at.append(i)
            found.append(xxhash.xxh3_128_digest(key.lower()))
    return split, at, found


def pairs_of(found: list[bytes]) -> np.ndarray:
    """Hashes as rows (high, low)."""
    return np.frombuffer(b"".join(found), "<u8").reshape(-1, 2)


class PerfectHash:
    """Indexes 0 to n - 1 of n distinct pairs of 64-bit hashes; others get any index or -1."""

    def __init__(self, sizes: np.ndarray, words: np.ndarray) -> None:
        self.sizes, self.words = sizes, words
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(words), dtype=np.int64)])

    @staticmethod
    def places(pairs: np.ndarray, level: int, size: int) -> np.ndarray:
        return ((mixed(pairs[:, 0], level) ^ mixed(pairs[:, 1], level + 97)) % np.uint64(size)).astype(np.int64)

    @classmethod
    def of(cls, pairs: np.ndarray) -> PerfectHash:
        sizes, levels, left = [], [], pairs
        while len(left):
            size = 64 * (int(FREE * len(left)) // 64 + 1)
            at = cls.places(left, len(sizes), size)
            alone = np.bincount(at, minlength=size) == 1
            sizes.append(size)
            levels.append(np.packbits(alone, bitorder="little").view("<u8"))
            left = left[~alone[at]]
        return cls(np.array(sizes, np.int64), np.concatenate(levels) if levels else np.zeros(0, np.uint64))

    def index(self, pairs: np.ndarray) -> np.ndarray:
        out = np.full(len(pairs), -1, np.int64)
        open_, base = np.arange(len(pairs)), 0
        for level, size in enumerate(self.sizes.tolist()):
            at = base + self.places(pairs[open_], level, size)
            word, bit = self.words[at >> 6], np.uint64(1) << (at & 63).astype(np.uint64)
            hit = (word & bit) != 0
            out[open_[hit]] = self.before[at[hit] >> 6] + np.bitwise_count(word[hit] & (bit[hit] - np.uint64(1)))
            open_, base = open_[~hit], base + size
        return out


def shards_of(pairs: np.ndarray, total: int) -> np.ndarray:
    return (pairs[:, 0] >> np.uint64(33)).astype(np.int64) % total


def shard_row(rows: pd.DataFrame) -> pd.DataFrame:
    """Rows (shard, high, low, n, keeper) of one shard as its arrays, in the order of its perfect hash."""
    pairs = np.ascontiguousarray(rows[["high", "low"]].to_numpy(np.int64)).view(np.uint64)
    made = PerfectHash.of(pairs)
    order = np.argsort(made.index(pairs))
    arrays = (pairs[order, 0].astype("<u8"), rows["n"].to_numpy(np.int64)[order].astype("<i8"), rows["keeper"].to_numpy(np.int64)[order].astype("<i8"))
    return pd.DataFrame([(rows["shard"].iloc[0], len(rows), made.sizes.tobytes(), made.words.tobytes(), *(a.tobytes() for a in arrays))], columns=[c.split()[0] for c in SHARDS.split(", ")])


class Lines:
    """The shards of a round: which lines are frequent, in how many documents, and who keeps them."""

    def __init__(self, total: int, rows: list) -> None:
        self.total = total
        self.shards = {r["shard"]: (PerfectHash(np.frombuffer(r["sizes"], np.int64), np.frombuffer(r["bits"], "<u8")), np.frombuffer(r["fingerprints"], "<u8"), np.frombuffer(r["counts"], "<i8"), np.frombuffer(r["keepers"], "<i8")) for r in rows}

    def probe(self, pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number of documents (0: not frequent) and the document that keeps the line, for each pair."""
        counts, keepers = np.zeros(len(pairs), np.int64), np.full(len(pairs), NOBODY, np.int64)
        shard = shards_of(pairs, self.total)
        for s in np.unique(shard).tolist():
            if s not in self.shards:
                continue
            table, prints, n, keeper = self.shards[s]
            at = np.flatnonzero(shard == s)
            index = table.index(pairs[at])
            known = (index >= 0) & (prints[index] == pairs[at, 0])
            counts[at[known]], keepers[at[known]] = n[index[known]], keeper[index[known]]
        return counts, keepers


def number(doc: int | None) -> int:
    return NOBODY if doc is None else doc


def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc, high, low: the long keys of each row, once each."""
    for batch in batches:
        own = [set(keyed(raw or b"")[2]) for raw in batch["text"].cast(pa.binary()).to_pylist()]
        docs = np.repeat(np.array([number(d) for d in batch["doc_id"].to_pylist()], np.int64), [len(x) for x in own])
        pairs = pairs_of([h for x in own for h in x]).view(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(docs), pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["doc", "high", "low"])


def frequent_lines(docs: DataFrame, copies: int = COPIES, shard: int = SHARD) -> tuple[DataFrame, int]:
    """docs (doc_id, text) -> the shards' arrays, one row a shard, and the number of shards."""
    seen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(hashes, "doc long, high long, low long")
    counted = seen.groupBy("high", "low").agg(F.count("*").alias("n"), F.max("doc").alias("keeper")).filter(F.col("n") >= copies)
    known = written(counted, "lines")
    total = max(1, -(-known.count() // shard))
    dealt = known.withColumn("shard", F.shiftrightunsigned("high", 33) % total)
    return written(dealt.groupBy("shard").applyInPandas(shard_row, SHARDS), "line_shards"), total


def kept_lines(split: list[bytes], at: list[int], gone: np.ndarray) -> tuple[int, int, str]:
    drop = {at[i] for i in np.flatnonzero(gone)}
    return len(split), len(drop), (b"\n".join(x for i, x in enumerate(split) if i not in drop) if drop else b"\n".join(split)).decode()


def answer(batch: pa.RecordBatch, columns: list[str], rows: list[tuple[int, int, str]]) -> pa.RecordBatch:
    found = [pa.array([r[i] for r in rows], k) for i, k in enumerate((pa.int64(), pa.int64(), pa.string()))]
    return pa.RecordBatch.from_arrays([*(batch[c] for c in columns), *found], names=[*columns, *(c.split()[0] for c in LOST.split(", "))])


def probed(shared: Broadcast, text: str, name: str, columns: list[str], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One round: texts without the lines that another document keeps."""
    for batch in batches:
        texts = [keyed(raw or b"") for raw in batch[text].cast(pa.binary()).to_pylist()]
        size = [len(x[1]) for x in texts]
        counts, keepers = shared.value.probe(pairs_of([h for x in texts for h in x[2]]))
        gone = (counts > 0) & (keepers != np.repeat(np.array([number(d) for d in batch[name].to_pylist()], np.int64), size))
        yield answer(batch, columns, [kept_lines(split, at, g) for (split, at, _), g in zip(texts, np.split(gone, np.cumsum(size)[:-1]), strict=True)])


def dealt_hashes(text: str, round_of: np.ndarray, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """round, _id, _part, pairs: a row's distinct hashes by the round that knows their shard."""
    for batch in batches:
        out: list[tuple] = []
        for doc, part, raw in zip(batch["_id"].to_pylist(), batch["_part"].to_pylist(), batch[text].cast(pa.binary()).to_pylist(), strict=True):
            pairs = pairs_of(sorted(set(keyed(raw or b"")[2])))
            turn = round_of[shards_of(pairs, len(round_of))]
            out += [(r, doc, part, pairs[turn == r].tobytes()) for r in np.unique(turn).tolist()]
        kinds = (pa.int32(), pa.int64(), pa.int64(), pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], names=["round", "_id", "_part", "pairs"])


def lost(shared: Broadcast, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """_id, _part, pairs: of a row's hashes those whose line another document keeps."""
    for batch in batches:
        out: list[tuple] = []
        for doc, part, raw in zip(batch["_id"].to_pylist(), batch["_part"].to_pylist(), batch["pairs"].to_pylist(), strict=True):
            pairs = np.frombuffer(raw, np.uint64).reshape(-1, 2)
            counts, keepers = shared.value.probe(pairs)
            if (gone := (counts > 0) & (keepers != number(doc))).any():
                out.append((doc, part, pairs[gone].tobytes()))
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate((pa.int64(), pa.int64(), pa.binary()))], names=["_id", "_part", "pairs"])


def applied(text: str, columns: list[str], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for raw, gone in zip(batch[text].cast(pa.binary()).to_pylist(), batch["gone"].to_pylist(), strict=True):
            split, at, found = keyed(raw or b"")
            known = {x[i : i + 16] for x in gone or [] for i in range(0, len(x), 16)}
            rows.append(kept_lines(split, at, np.array([h in known for h in found], bool)))
        yield answer(batch, columns, rows)


def worked(docs: DataFrame, copies: int = COPIES, shard: int = SHARD, room: int = ROUND) -> DataFrame:
    """The columns of docs as c0, c1, ... and those of ``LOST``."""
    spark, columns, text, name = docs.sparkSession, [f"c{i}" for i in range(len(docs.columns))], place_of(docs, "text"), place_of(docs, "doc_id")
    shards, total = frequent_lines(docs, copies, shard)
    bytes_ = F.length("bits") + F.length("fingerprints") + F.length("counts") + F.length("keepers")
    kinds = T.StructType([*renamed_schema(docs).fields, *T.StructType.fromDDL(LOST).fields])
    turns = 1 + shards.agg(F.coalesce(F.sum(bytes_), F.lit(0))).first()[0] // room
    share = lambda df: spark.sparkContext.broadcast(Lines(total, df.collect()))  # noqa: E731  a round's shards: ROUND bytes and one shard at most
    if turns == 1:
        rows = docs.select(*[column(c).alias(f"c{i}") for i, c in enumerate(docs.columns)])
        return rows.withColumn("_id", F.col(name).cast("long")).mapInArrow(functools.partial(probed, share(shards), text, "_id", columns), kinds)
    rows = numbered(docs)
    round_of = np.arange(total) * turns // total  # shards are of about one size
    path = f"{shared_dir(spark)}/foliant/line-rounds-{uuid.uuid4().hex}"
    rows.select(F.col("_id").cast("long").alias("_id"), "_part", text).mapInArrow(functools.partial(dealt_hashes, text, round_of), "round int, _id long, _part long, pairs binary").write.partitionBy("round").parquet(path)
    dealt, out = spark.read.schema("_id long, _part long, pairs binary, round int").parquet(path), f"{path}-lost"
    for turn in range(turns):
        own = share(shards.filter(F.col("shard").between(*(int(x) for x in np.flatnonzero(round_of == turn)[[0, -1]])))) if (round_of == turn).any() else share(shards.limit(0))
        dealt.filter(F.col("round") == turn).drop("round").mapInArrow(functools.partial(lost, own), "_id long, _part long, pairs binary").write.mode("append").parquet(out)
        own.unpersist()
    gone = spark.read.schema("_id long, _part long, pairs binary").parquet(out).groupBy("_id", "_part").agg(F.collect_list("pairs").alias("gone"))
    gone = gone.select(F.col("_id").alias("_gone"), F.col("_part").alias("_gone_part"), "gone")
    both = rows.join(gone, F.col("_id").eqNullSafe(F.col("_gone")) & (F.col("_part") == F.col("_gone_part")), "left").select(*columns, "gone")
    return both.mapInArrow(functools.partial(applied, text, columns), kinds)


def drop_lines(docs: DataFrame, copies: int = COPIES, shard: int = SHARD, room: int = ROUND) -> DataFrame:
    """The documents without the lines that another one keeps, with the same columns; n_chars follows a text that is cut."""
    left, cut = worked(docs, copies, shard, room), F.col("n_dropped") > 0
    changed = {"text": F.when(cut, F.col("kept")), "n_chars": F.when(cut, F.length("kept").cast("long"))}
    return left.select(*[(F.coalesce(changed[c], f"c{i}") if c in changed else F.col(f"c{i}")).alias(c) for i, c in enumerate(docs.columns)])


def line_digests(docs: DataFrame, copies: int = COPIES, shard: int = SHARD, room: int = ROUND) -> DataFrame:
    """One row a document: doc_id, n_lines, n_dropped, kept_sha256."""
    found = worked(docs.select("doc_id", "text"), copies, shard, room)
    return found.select(F.col("c0").alias("doc_id"), "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))
