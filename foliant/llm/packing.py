"""Operator 3: best-fit packing of token sequences by pattern fitting.

Documents become token pieces of at most ``SIZE`` tokens. Only the histogram of piece lengths (at most SIZE
numbers) reaches the driver. There, patterns of few lengths that fill a sequence exactly are enumerated,
non-negative least squares fit how often to repeat each so that the histogram is used up, the counts are
rounded down to what is there, and the residual lengths are packed best-fit, longest first. The outcome is a
table of sequence layouts, bounded by SIZE and not by the data; every piece finds its place from its length
and its rank among the pieces of that length, which are counted by bucket, never in one task.

Defined results: null counts as empty; an empty text is one piece, the end id alone; repeated rows are
packed like others; ties of length go by bucket, doc_id and piece; an empty table gives no rows. Other
columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foliant.llm.bpe import ids_of_texts
from foliant.llm.common import partitions, text_bytes, written

SIZE = 2048
#: Lengths of a pattern are multiples of this when three make it up; pairs take every length.
STEP = 16
ROUNDS = 400
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def token_pieces(docs: DataFrame, path: str, size: int = SIZE) -> DataFrame:
    """Token ids of each document and id 0, cut into pieces: see ``PIECES``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in PIECES.split(", ")]
        kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
        for batch in batches:
            out = []
            for doc, ids in zip(batch["doc_id"].to_pylist(), ids_of_texts((t.as_py() for t in batch["_text"]), path), strict=True):
                ids = np.append(ids, 0).astype("<u4")  # the end of the document
                for i in range(0, len(ids), size):
                    part = ids[i : i + size]
                    out.append((doc, i // size, i, len(part), zlib.crc32(part.tobytes())))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], names=names)

    return docs.select("doc_id", text_bytes().alias("_text")).mapInArrow(run, PIECES)


def patterns(have: np.ndarray, size: int = SIZE) -> np.ndarray:
    """Rows of three lengths (0: none) that fill a sequence, of lengths that occur."""
    lengths = np.flatnonzero(have)
    out = [np.array([[size, 0, 0]])] if have[size] else []
    a = lengths[(2 * lengths <= size) & (have[size - lengths] > 0)]
    a = a[(a > 0) & (a < size)]
    out.append(np.stack([a, size - a, np.zeros_like(a)], axis=1))
    coarse = lengths[lengths % STEP == 0]
    for x in coarse:
        # The largest of the three takes any length that fits; the smallest is coarse.
        y = lengths[(lengths >= x) & (2 * lengths <= size - x)]
        y = y[y <= size - x - y]
        z = size - x - y
        ok = have[z] > 0
        out.append(np.stack([np.full(ok.sum(), x), y[ok], z[ok]], axis=1))
    return np.concatenate(out).astype(np.int64) if out else np.zeros((0, 3), np.int64)


def fitted_counts(have: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Non-negative least squares: repeat counts whose lengths come closest to the histogram (projected gradient)."""
    n = np.zeros(len(rows))
    if not len(rows):
        return n
    weight = np.ones(len(have))
    weight[0] = 0

    def back(r: np.ndarray) -> np.ndarray:
        return (weight * r)[rows].sum(axis=1)

    def made(x: np.ndarray) -> np.ndarray:
        return sum(np.bincount(rows[:, i], x, len(have)) for i in range(3))

    # Step by the largest row sum of A'A, a bound of its spectrum.
    step = 1 / max(1.0, back(made(np.ones(len(rows)))).max())
    x = look = n
    t = 1.0
    for _ in range(ROUNDS):
        new = np.maximum(0, look + step * back(have - made(look)))
        t_new = (1 + (1 + 4 * t * t) ** 0.5) / 2
        look = new + (t - 1) / t_new * (new - x)
        x, t = new, t_new
    return x


def layouts(have: np.ndarray, size: int = SIZE) -> list[tuple[tuple[int, ...], int]]:
    """Sequence layouts (lengths, repeats) that use the histogram up; as many as the lengths call for, not the pieces."""
    left = have.astype(np.int64).copy()
    left[0] = 0
    out: list[tuple[tuple[int, ...], int]] = []

    def take(lengths: tuple[int, ...], times: int) -> None:
        for x in lengths:
            left[x] -= times
        out.append((lengths, times))

    if left[size]:
        take((size,), int(left[size]))
    rows = patterns(left, size)
    want = fitted_counts(left.astype(float), rows)
    for i in np.argsort(-want, kind="stable"):
        if want[i] < 0.5:
            break
        lengths = tuple(int(x) for x in rows[i] if x)
        need = {x: lengths.count(x) for x in lengths}
        times = min(int(want[i] + 0.5), *(int(left[x]) // k for x, k in need.items()))
        if times > 0:
            take(lengths, times)
    # Residual lengths: the longest first, each into the fullest sequences that it fits; alike ones together.
    open_: dict[int, dict[tuple[int, ...], int]] = {}
    room = np.zeros(size + 1, np.int64)
    for x in range(size, 0, -1):
        todo = int(left[x])
        while todo:
            fit = np.flatnonzero(room[x:])
            if not len(fit):
                each = size // x
                full, rest = divmod(todo, each)
                for k, times in ((each, full), (rest, 1 if rest else 0)):
                    if times:
                        free = size - k * x
                        at = open_.setdefault(free, {})
                        at[(x,) * k] = at.get((x,) * k, 0) + times
                        room[free] += times
                todo = 0
                break
            free = x + int(fit[0])
            lengths, times = next(iter(open_[free].items()))
            used = min(times, todo)
            if used == times:
                del open_[free][lengths]
            else:
                open_[free][lengths] -= used
            room[free] -= used
            at = open_.setdefault(free - x, {})
            at[(*lengths, x)] = at.get((*lengths, x), 0) + used
            room[free - x] += used
            todo -= used
    return out + [(k, v) for at in open_.values() for k, v in at.items()]


def places(found: list[tuple[tuple[int, ...], int]]) -> np.ndarray:
    """Table of slots: length, first rank, copies a sequence, first sequence, slot in it; by length and rank.

    Rank r of a length in the table's row stands in sequence (first + (r - first rank) // copies).
    """
    rows, ranks, sequence = [], {}, 0
    for lengths, times in found:
        at = 0
        for x in dict.fromkeys(lengths):
            k = lengths.count(x)
            rows.append((x, ranks.get(x, 0), k, sequence, at))
            ranks[x] = ranks.get(x, 0) + k * times
            at += k * x
        sequence += times
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


def pack(pieces: DataFrame, size: int = SIZE) -> DataFrame:
    """pieces with doc_id, piece, length -> the same rows with sequence_id and offset."""
    spark = pieces.sparkSession
    n = 4 * partitions(spark)
    dealt = pieces.withColumn("_bucket", F.pmod(F.xxhash64("doc_id"), F.lit(n)).cast("int"))
    counts = dealt.groupBy("length", "_bucket").agg(F.count("*").alias("n"))
    have = np.zeros(size + 1, np.int64)
    for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect():
        have[r["length"]] = r["n"]
    table = spark.sparkContext.broadcast(places(layouts(have, size)))
    names = pieces.columns
    before = Window.partitionBy("length").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    first = counts.select("length", "_bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_first"))
    rank = F.row_number().over(Window.partitionBy("_bucket", "length").orderBy("doc_id", "piece")) - 1
    ranked = dealt.withColumn("_rank", rank).join(first, ["length", "_bucket"]).select(*names, (F.col("_rank") + F.col("_first")).alias("_rank"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = table.value
        keys = (t[:, 0] << 44) + t[:, 1]
        for batch in batches:
            length, r = batch["length"].to_numpy(), batch["_rank"].to_numpy()
            row = t[np.searchsorted(keys, (length << 44) + r, "right") - 1] if len(t) else np.zeros((0, 5), np.int64)
            past = r - row[:, 1]
            columns = [batch[c] for c in names]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(row[:, 3] + past // row[:, 2]), pa.array(row[:, 4] + past % row[:, 2] * length)], names=[*names, "sequence_id", "offset"])

    kinds = ", ".join(f"{c} {k}" for c, k in pieces.dtypes)
    return ranked.mapInArrow(place, f"{kinds}, sequence_id long, offset long")


def packed_documents(docs: DataFrame, path: str) -> DataFrame:
    """All documents as pieces with their places."""
    return pack(written(token_pieces(docs, path), "pieces"))
