"""Operator 2: SimHash document fingerprints of 256 bits, their likeness, and search within a radius.

Terms are words and pairs of neighbouring words, weighted by how often a text has them (damped) and by kind
(pairs say more than single words). Each term's hash votes with its weight for the sign of every bit.
Likeness is the cosine that the share of differing bits stands for.

Search uses permuted block tables: within radius 7 the bits fall into 8 blocks, of which at least one agrees,
so each table brings another block to the front and looks it up exactly; the distance decides. A block that more
than 8 x 1,024 different fingerprints share is looked up with a part of the other bits, again in 8 tables, so
rows don't grow with the square of such a group. Every document gets the smallest doc_id that such neighbours
reach.

Defined results: null counts as empty; a text without words has fingerprint zero; equal texts have equal
fingerprints; the documents stand in descending doc_id order (null last, equal ids by text) and the last is
followed by the first; a single document follows itself; an empty table gives no rows. Very long texts are
read whole. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.llm import simhash
from foliant.llm.common import joined_by_size, mixed, partitions, text_bytes, word_hashes, written
from foliant.llm.graph import components

LANES = 4  # of 64 bits
BITS = 64 * LANES
WORD_WEIGHT, PAIR_WEIGHT = 0.3, 1.0
RADIUS = 7
WIDTH = BITS // 8 // (RADIUS + 1)  # octets of a block
LOWEST = -(2**63)


def fingerprint(text: bytes) -> np.ndarray:
    """The text's bits, as 64-bit lanes."""
    words = text.lower().split()
    if not words:
        return np.zeros(LANES, np.uint64)
    h = word_hashes(words)
    with np.errstate(over="ignore"):
        pairs = mixed(h[:-1], 1) + h[1:]
    votes = np.zeros(BITS, np.float32)
    for kind, weight in ((h, WORD_WEIGHT), (pairs, PAIR_WEIGHT)):
        if len(kind):
            terms, n = np.unique(kind, return_counts=True)
            weights = (weight * (1 + np.log2(n))).astype(np.float32)
            for lane in range(LANES):
                for at in range(0, len(terms), 1 << 16):
                    octets = mixed(terms[at : at + (1 << 16)], 50 + lane).view(np.uint8).reshape(-1, 8)
                    w = weights[at : at + (1 << 16)]
                    bits = np.unpackbits(octets, axis=1, bitorder="little").astype(np.float32)
                    votes[64 * lane : 64 * lane + 64] += 2 * (w @ bits) - w.sum()
    return np.packbits(votes > 0, bitorder="little").view("<u8")


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    differing = int(np.bitwise_count(a ^ b).sum())
    return max(0.0, float(np.cos(np.pi * differing / BITS))) if differing else 1.0


def block_tables(fp: Column) -> Column:
    """Array of keys, one a table: the table's number and the block that it puts first."""
    return F.array(*[F.xxhash64(F.lit(i), F.substring(fp, i * WIDTH + 1, WIDTH)) for i in range(RADIUS + 1)])


def finer_tables(fp: Column, key: Column) -> Column:
    """Array of int keys: two fingerprints within RADIUS that share a block share at least one part of the other octets."""
    at = ((F.array_position(block_tables(fp), key) - 1) * WIDTH).cast("int")
    others = F.concat(F.substr(fp, F.lit(1), at), F.substr(fp, at + WIDTH + 1, F.lit(BITS // 8)))
    borders = [i * (BITS // 8 - WIDTH) // (RADIUS + 1) for i in range(RADIUS + 2)]
    return F.transform(F.array(others), lambda x: F.array(*[F.hash(F.lit(i), F.substring(x, a + 1, b - a)) for i, (a, b) in enumerate(pairwise(borders))]))[0]


def within_radius(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x).sum(axis=1) <= RADIUS


def first_place(x: np.ndarray, table: np.ndarray, part: np.ndarray) -> np.ndarray:
    """Of XORed fingerprints that meet under a block table (and one of its finer keys, or -1): is it the first that they share?"""
    octets = np.ascontiguousarray(x).view(np.uint8).reshape(len(x), BITS // 8)
    blocks = (octets.reshape(len(x), RADIUS + 1, WIDTH) == 0).all(axis=2)
    ok = blocks.argmax(axis=1) == table
    fine = np.flatnonzero(ok & (part >= 0))
    if len(fine):
        keep = np.arange(octets.shape[1]) // WIDTH != table[fine, None]
        others = octets[fine][keep].reshape(len(fine), -1)
        size = octets.shape[1] - WIDTH
        borders = [i * size // (RADIUS + 1) for i in range(RADIUS + 2)]
        shared = np.stack([(others[:, a:b] == 0).all(axis=1) for a, b in pairwise(borders)], axis=1)
        ok[fine] = shared.argmax(axis=1) == part[fine]
    return ok


def near_classes(prints: DataFrame, **how) -> DataFrame:
    """prints (doc_id, fp binary, any others) -> adds component_id, by all pairs within the radius, and near_links: how many other rows are within it.

    Fingerprints of several documents or with links join back; any other is a class of its own.
    """
    firsts = prints.groupBy("fp").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("n"))
    nodes = written(firsts, "nodes")
    linked = nodes.filter("first_id is not null").select(F.col("first_id").alias("node"), "fp", "n")
    met = simhash.links(linked, keys=block_tables, near=within_radius, late=True, finer=finer_tables, spread=RADIUS + 1, first=first_place, **how)
    found = components(met.filter("b is not null").select("a", "b"))
    counts = met.filter("b is null").groupBy(F.col("a").alias("first_id")).agg(F.sum("n").alias("others"))
    known = nodes.join(found, F.col("first_id") == F.col("node"), "left").join(counts, "first_id", "left").withColumn("component_id", F.coalesce("component", "first_id"))
    links = (F.col("n") - 1 + F.coalesce("others", F.lit(0))).alias("near_links")
    known = known.filter("n > 1 or others > 0").select("fp", "component_id", "n", links)
    joined = joined_by_size(prints, known, ["fp"], prints.count())
    return joined.select(*prints.columns, F.coalesce("component_id", "doc_id").alias("component_id"), F.coalesce("near_links", F.lit(0)).alias("near_links"))


ROWS = "doc_id long, n_chars long, edited_sha256 string, fp binary, edited_fp binary, near_edited double, near_next double"


def in_order(docs: DataFrame) -> DataFrame:
    """Documents dealt to ranges of doc_id, descending in each; every range ends with a copy of the row that follows it.

    The range borders (quantiles) and the last row of each range are as many as the partitions.
    """
    spark = docs.sparkSession
    n = partitions(spark)
    rows = docs.select("doc_id", F.coalesce("doc_id", F.lit(LOWEST)).alias("_place"), text_bytes().alias("_text"))
    places = rows.select("_place")
    borders = np.array(sorted(set(places.approxQuantile("_place", [i / n for i in range(1, n)], 0.1 / n))), np.int64) if n > 1 else np.zeros(0, np.int64)

    @F.pandas_udf("int")
    def home(place: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(borders, place.to_numpy(), "left").astype(np.int32))

    tops = {r["home"]: r["top"] for r in places.groupBy(home("_place").alias("home")).agg(F.max("_place").alias("top")).collect()}
    ranges = sorted(tops)
    also = {tops[a]: b for a, b in zip(ranges, ranges[1:] + ranges[:1], strict=True)}

    @F.pandas_udf("array<int>")
    def homes(place: pd.Series) -> pd.Series:
        own = np.searchsorted(borders, place.to_numpy(), "left")
        return pd.Series([[int(h)] + ([also[p]] if p in also else []) for h, p in zip(own, place.tolist(), strict=True)])

    dealt = rows.select("doc_id", "_place", "_text", F.posexplode(homes("_place")).alias("extra", "home"))
    return dealt.repartitionById(n, "home").sortWithinPartitions("home", "extra", F.desc("_place"), "_text")


def edited_likeness(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text, of its edited text, and their likeness; see ``ROWS``.

    The edited text has its last floor(n/2) code points replaced by as many first ones of the next document.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple | None = None
        names = [x.split()[0] for x in ROWS.split(", ")]
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.binary(), pa.float64(), pa.float64())
        for batch in batches:
            out = []
            for doc, extra, home, raw in zip(*(batch[c].to_pylist() for c in ("doc_id", "extra", "home", "_text")), strict=True):
                if extra and (held is None or held[1] != home):  # copies of a top row that rows of its own id share
                    continue
                text = raw.decode()
                now = (doc, home, text, fingerprint(raw))
                if held is not None and held[1] == home:
                    half = len(held[2]) // 2
                    edited = (held[2][: len(held[2]) - half] + text[:half]).encode()
                    fp = fingerprint(edited)
                    out.append((held[0], len(held[2]), hashlib.sha256(edited).hexdigest(), held[3].tobytes(), fp.tobytes(), likeness(held[3], fp), likeness(held[3], now[3])))
                held = None if extra else now
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], names=names)

    return in_order(docs).select("doc_id", "extra", "home", "_text").mapInArrow(run, ROWS)


def shown(rows: DataFrame, *more: str) -> DataFrame:
    """Fingerprints as hex digits."""
    digits = [F.lower(F.hex(c)).alias(k) for k, c in (("fingerprint", "fp"), ("edited_fingerprint", "edited_fp"))]
    return rows.select("doc_id", "n_chars", "edited_sha256", *digits, "near_edited", "near_next", *more)


def edited_report(docs: DataFrame) -> DataFrame:
    """The rows of ``edited_likeness`` with fingerprints as hex digits."""
    return shown(edited_likeness(docs))


def fingerprint_report(docs: DataFrame) -> DataFrame:
    """The same with near_class, the smallest doc_id that neighbours within the radius reach, and near_links, how many other documents are within it."""
    rows = written(edited_likeness(docs).withColumn("edited_sha256", F.unhex("edited_sha256")), "fingerprints")
    near = near_classes(rows).withColumn("edited_sha256", F.lower(F.hex("edited_sha256")))
    return shown(near.withColumnRenamed("component_id", "near_class"), "near_class", "near_links")
