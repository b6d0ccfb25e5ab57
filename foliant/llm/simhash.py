"""Operator 10: SimHash near-deduplication with pigeonring filtering.

64-bit fingerprints link at 3 or fewer differing bits. The bits lie on a ring of four segments. If at
most 3 differ, some start on the ring has 0 differing bits in its first segment, at most 1 in its first
two, at most 2 in its first three: each chain stays within its share of the budget. The join keys are the
parts of such chains that must agree exactly (32 bits), the chain budgets prune what meets under a key,
and the full distance decides. Buckets are compared in blocks, and only a spanning forest of the links
leaves a block. A bucket of over 20 blocks is dealt by half of its other 32 bits instead: a row goes to 20
places at most, and no place has over 2^17 fingerprints, so neither rows nor memory grow with the square of
a group.

Defined results: null counts as empty; a text without words has fingerprint zero and links like any
other; texts under three words have the whole sequence as their only shingle; repeated rows and equal
texts share a fingerprint and a component; rows that share a doc_id but not their text are linked apart; a
null doc_id links too and names a component only if all of its rows are null; very long texts are read
whole; an empty table gives no rows. Other columns are ignored by the classes and kept by ``drop_near``,
whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.llm.common import FIRST, joined_by_size, numbered, partitions, place_of, text_bytes, without, written
from foliant.llm.graph import components

RADIUS, SEGMENTS, WIDTH, SEED = 3, 4, 3, 42
#: Fingerprints of a bucket that are compared at once; larger buckets go block against block.
BLOCK = 1024
BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.float64)


def fingerprint(text: bytes) -> int:
    """SimHash of the text's word shingles: a bit is set if it is set in over half of the hashes."""
    words = text.lower().split()
    if not words:
        return 0
    parts = map(b" ".join, zip(words, words[1:], words[2:], strict=False)) if len(words) >= WIDTH else [b" ".join(words)]
    digest = xxhash.xxh64_intdigest
    h = np.array([digest(x, SEED) for x in parts], np.uint64)
    octets = h.view(np.uint8).reshape(-1, 8)
    if len(h) < 512:
        ones = np.unpackbits(octets, axis=1, bitorder="little").sum(axis=0)
    else:
        ones = np.concatenate([np.bincount(octets[:, j], minlength=256) @ BITS for j in range(8)])
    return int(np.packbits(2 * ones > len(h), bitorder="little").view("<u8")[0])


def fingerprints(rows: DataFrame) -> DataFrame:
    """rows (_id, _part, _text binary) -> _id, _part, fp (the 64 bits as a signed long)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = np.fromiter((fingerprint(t.as_py()) for t in batch["_text"]), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch["_id"], batch["_part"], pa.array(fp.view(np.int64))], names=["_id", "_part", "fp"])

    return rows.select("_id", "_part", "_text").mapInArrow(run, "_id long, _part long, fp long")


def octet(fp: Column, i: int) -> Column:
    return F.shiftrightunsigned(fp, 8 * (i % 8)).bitwiseAND(F.lit(255))


def ring_keys(fp: Column) -> Column:
    """Array of keys: two fingerprints within RADIUS share at least one.

    From each of the four starts: the first segment agrees; of the second one half agrees, and of the
    third one half too, or else all of the second agrees.
    """
    keys = []
    for start in range(SEGMENTS):
        a0, a1, b0, b1, c0, c1 = (octet(fp, 2 * start + i) for i in range(6))
        for i, (x, y) in enumerate(((b0, c0), (b0, c1), (b1, c0), (b1, c1), (b0, b1))):
            key = F.lit((start * 5 + i) << 32)
            for j, part in enumerate((y, x, a1, a0)):
                key = key + part * F.lit(1 << (8 * j))
            keys.append(key)
    return F.array(*keys)


#: Pieces of the 32 bits outside a key: at most RADIUS of the six differ, so some three agree (lowest bit, width).
PIECES = ((0, 6), (6, 5), (11, 5), (16, 5), (21, 5), (26, 6))
AGREEING = list(combinations(range(len(PIECES)), len(PIECES) - RADIUS))

#: Octets of the second and third segment, from the key's start on, that are not part of the key, by the order of ``ring_keys``.
OUTSIDE = ((3, 3, 2, 2, 4), (5, 4, 5, 4, 5))


def finer_keys(fp: Column, key: Column) -> Column:
    """Array of int keys: two fingerprints within RADIUS that share a ring key share at least one of them."""
    def shifted(how: str, x: Column, by: Column) -> Column:
        return F.call_function(how, x, by.cast("int"))

    kind = F.shiftright(key, 32)
    which, turn = kind % 5, (kind - kind % 5) / 5 * 16
    ring = shifted("shiftrightunsigned", fp, turn).bitwiseOR(shifted("shiftleft", fp, 64 - turn))
    outside = [F.element_at(F.array(*map(F.lit, places)), (which + 1).cast("int")) for places in OUTSIDE]
    one, two = (shifted("shiftrightunsigned", ring, 8 * place).bitwiseAND(F.lit(255)) for place in outside)
    rest = one + two * 256 + F.shiftrightunsigned(ring, 48) * 65536

    def dealt(rest: Column) -> Column:
        found = []
        for number, chosen in enumerate(AGREEING):
            value, at = F.lit(number << 18).cast("long"), 0
            for low, width in (PIECES[i] for i in chosen):
                value = value + F.shiftright(rest, low).bitwiseAND(F.lit((1 << width) - 1)) * (1 << at)
                at += width
            found.append(value.cast("int"))
        return F.array(*found)

    return F.flatten(F.transform(F.array(rest), dealt))


def within_chain(x: np.ndarray) -> np.ndarray:
    """Pigeonring test of XORed fingerprints, then the full distance."""
    d = np.stack([np.bitwise_count((x >> np.uint64(16 * i)) & np.uint64(0xFFFF)) for i in range(SEGMENTS)])
    ok = np.zeros(len(x), bool)
    for start in range(SEGMENTS):
        s = np.cumsum(d[[(start + i) % SEGMENTS for i in range(SEGMENTS)]], axis=0, dtype=np.int64)
        ok |= np.all([s[i] * SEGMENTS <= (i + 1) * RADIUS for i in range(SEGMENTS)], axis=0)
    ok[ok] = np.bitwise_count(x[ok]) <= RADIUS
    return ok


Tally = Callable[[np.ndarray, np.ndarray], None]


def forest(values: np.ndarray, groups: np.ndarray, near: Callable[[np.ndarray], np.ndarray], tally: Tally | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Links inside each group (rows of a group stand together) as edges to the first row that they reach.

    values: fingerprints, of one or several 64-bit lanes a row; near tells from their XOR which link. tally is told all links.
    """
    n = len(values)
    last = np.searchsorted(groups, groups, "right")
    left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    at, step = np.arange(n), 1
    while len(at := at[at + step < last[at]]):
        ok = near(values[at] ^ values[at + step])
        if tally is not None:
            tally(at[ok], at[ok] + step)
        left.append(at[ok])
        right.append(at[ok] + step)
        step += 1
    a, b = np.concatenate(left), np.concatenate(right)
    label = np.arange(n)
    while len(a):
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        new = new[new]
        if np.array_equal(new, label):
            break
        label = new
    hung = np.flatnonzero(label != np.arange(n))
    return hung, label[hung]


def lanes(column: pa.ChunkedArray) -> np.ndarray:
    """Fingerprints (a long, or binary of several 64-bit lanes) as numbers."""
    if pa.types.is_integer(column.type):
        return column.to_numpy().view(np.uint64)
    return np.frombuffer(b"".join(column.to_pylist()), "<u8").reshape(len(column), -1)


def whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Sorted batches as tables that end with a group, and each row's group number."""
    rest: pa.Table | None = None

    def numbered(t: pa.Table) -> np.ndarray:
        new = np.zeros(t.num_rows, bool)
        for k in keys:
            x = t[k].to_numpy()
            new[1:] |= x[1:] != x[:-1]
        return np.cumsum(new)

    for batch in batches:
        t = pa.Table.from_batches([batch])
        t = pa.concat_tables([rest, t]).combine_chunks() if rest is not None else t
        if not t.num_rows:
            continue
        g = numbered(t)
        cut = int(np.searchsorted(g, g[-1]))
        if cut:
            yield t.slice(0, cut), g[:cut]
        rest = t.slice(cut)
    if rest is not None and rest.num_rows:
        yield rest, numbered(rest)


def tiled(values: np.ndarray, groups: np.ndarray, near: Callable[[np.ndarray], np.ndarray], block: int, tally: Tally | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """As ``forest``; a group of more than two blocks goes block against block, which bounds the links held at once. tally is told each link once."""
    starts = np.flatnonzero(np.r_[True, groups[1:] != groups[:-1]])
    sizes = np.diff(np.r_[starts, len(groups)])
    few = np.flatnonzero(np.repeat(sizes <= 2 * block, sizes))
    a, b = forest(values[few], groups[few], near, tally and (lambda a, b: tally(few[a], few[b])))
    yield few[a], few[b]
    for start, size in zip(starts[sizes > 2 * block], sizes[sizes > 2 * block], strict=True):
        blocks = [np.arange(x, min(x + block, start + size)) for x in range(start, start + size, block)]
        for (x, one), (y, two) in combinations(enumerate(blocks), 2):
            at = np.concatenate([one, two])

            def told(a: np.ndarray, b: np.ndarray, x: int = x, y: int = y, at: np.ndarray = at, n: int = len(one)) -> None:
                """Links inside a block count beside the first block, those of the first one beside the second."""
                new = ((a < n) != (b < n)) | ((a >= n) & (x == 0)) | ((b < n) & (x == 0) & (y == 1))
                tally(at[a[new]], at[b[new]])

            a, b = forest(values[at], np.zeros(len(at), np.int64), near, tally and told)
            yield at[a], at[b]


def links(
    fps: DataFrame, keys: Callable[[Column], Column] = ring_keys, near: Callable[[np.ndarray], np.ndarray] = within_chain, block: int = BLOCK, late: bool = False,
    finer: Callable[[Column, Column], Column] = finer_keys, spread: int = len(AGREEING), first: Callable[[np.ndarray, int, int], np.ndarray] | None = None,
) -> DataFrame:
    """fps (node, fp), one row a fingerprint -> edges (a, b) that connect exactly the nodes whose fingerprints link.

    late: wide fingerprints join by node only where several nodes have a key. finer: ``spread`` further keys of a
    key's row, for keys of more blocks than that.

    first: of XORed fingerprints, a table and one of its finer keys (-1: none), for which pairs this is the first place where
    they meet. With it, the result is written and has rows (a, null, n) beside the edges: links that ``a`` has to n rows; fps then has n, the rows of a fingerprint.
    """
    also = ["n"] if first else []
    keyed = fps.select("node", F.posexplode(keys(F.col("fp"))).alias("table", "key"), *([] if late else ["fp", *also]))
    sizes = keyed.groupBy("key").agg(F.count("*").alias("size")).filter("size > 1")
    blocks = F.ceil(F.col("size") / F.lit(block)).cast("int")
    own = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    meets = keyed.join(sizes, "key")
    meets = (meets.join(fps, "node") if late else meets).withColumn("blocks", blocks).withColumn("own", own)
    places = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda x: F.struct(F.least("own", x).alias("i"), F.greatest("own", x).alias("j")))
    dealt = F.transform(finer(F.col("fp"), F.col("key")), lambda x, part: F.struct(x.alias("i"), (-1 - part).alias("j")))
    places = F.when(F.col("blocks") > spread, dealt).otherwise(places)
    meets = meets.select("key", F.explode(places).alias("place"), "node", "fp", "table", "own", *also).select("key", "place.i", "place.j", "node", "fp", *(["table", "own", "n"] if first else []))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, g in whole_groups(batches, ["key", "i", "j"]):
            node, values = t["node"].to_numpy(), lanes(t["fp"])
            if not first:
                for a, b in tiled(values, g, near, block):
                    yield pa.RecordBatch.from_arrays([pa.array(node[a]), pa.array(node[b])], names=["a", "b"])
                continue
            table, own, i, j, n = (t[c].to_numpy() for c in ("table", "own", "i", "j", "n"))
            count = np.zeros(len(node), np.int64)

            def tally(a: np.ndarray, b: np.ndarray) -> None:
                """Each link counts in one place: the first table, there the first finer key, or else the place of both rows' blocks."""
                new = (j[a] < 0) | ((own[a] != own[b]) == (i[a] != j[a]))  # noqa: B023
                new &= first(values[a] ^ values[b], table[a], np.where(j[a] < 0, -1 - j[a], -1))  # noqa: B023
                np.add.at(count, a[new], n[b[new]])  # noqa: B023
                np.add.at(count, b[new], n[a[new]])  # noqa: B023

            for a, b in tiled(values, g, near, block, tally):
                yield pa.RecordBatch.from_arrays([pa.array(node[a]), pa.array(node[b]), pa.array(np.zeros(len(a), np.int64))], names=["a", "b", "n"])
            some = np.flatnonzero(count)
            yield pa.RecordBatch.from_arrays([pa.array(node[some]), pa.nulls(len(some), pa.int64()), pa.array(count[some])], names=["a", "b", "n"])

    parts = partitions(fps.sparkSession)
    dealt_out = meets.repartition(parts, "key", "i", "j").sortWithinPartitions("key", "i", "j", "node")
    if not first:
        return dealt_out.mapInArrow(run, "a long, b long").distinct()
    return written(dealt_out.mapInArrow(run, "a long, b long, n long"), "links")


def near_classes(prints: DataFrame, **how) -> DataFrame:
    """prints (_id, _part, fp) -> adds component_id, the smallest doc_id that links reach, and kept: one row a component.

    Fingerprints are the nodes. Only those with several rows or with links join back; any other row is its own class.
    """
    firsts = prints.groupBy("fp").agg(F.min(F.expr(FIRST)).alias("first"), F.count("*").alias("n"))
    comp = components(links(firsts.select(F.col("fp").alias("node"), "fp"), **how))
    inside = firsts.join(comp, F.col("fp") == F.col("node"), "left").select("fp", "n", "first", F.coalesce("component", "fp").alias("component"), F.col("node").isNotNull().alias("linked"))
    inside = written(inside.filter("n > 1 or linked"), "classes")
    sizes = inside.groupBy("component").agg(F.min("first").alias("top"), F.count("*").alias("n"))
    tops = joined_by_size(inside.withColumnRenamed("n", "rows"), sizes, ["component"], inside.count())
    known = tops.select("fp", F.col("top._id").alias("top_id"), F.col("top._part").alias("top_part"), F.col("rows").alias("n"))
    alone = F.col("top_part").isNull()
    return joined_by_size(prints, known, ["fp"], prints.count()).select(
        "_id", "_part", "fp",
        F.when(alone, F.col("_id")).otherwise(F.col("top_id")).alias("component_id"),
        (alone | F.col("_id").eqNullSafe(F.col("top_id")) & (F.col("_part") == F.col("top_part"))).alias("kept"),
    )


def classes_of(rows: DataFrame, text: str) -> DataFrame:
    return near_classes(written(fingerprints(rows.select("_id", "_part", text_bytes(text).alias("_text"))), "simhash"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """One row a document: doc_id, fingerprint (16 hex digits), component_id."""
    got = classes_of(numbered(docs.select("doc_id", "text")), "c1")
    return got.select(F.col("_id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def drop_near(docs: DataFrame) -> DataFrame:
    """One row of each component stays, with all its columns: the smallest doc_id, null last, the first of repeated rows."""
    rows = numbered(docs)
    return without(docs, rows, classes_of(rows, place_of(docs, "text")).filter("not kept"))
