"""Operator 13: collocations by mergeable Misra-Gries summaries over hash partitions, and an exact second count.

Runs of one to five words of a piece are counted by language under 64-bit hashes, whose top bits name a hash
partition. Tasks over documents send what they have counted; one summary a hash partition merges it. Where a
summary holds more than ROOM counters, all of them fall by the same amount; the sum of these amounts is what a
phrase can have lost, and it never reaches the threshold: it stays below mass / capacity where the capacity
exceeds mass / threshold, and a summary that a few heavy phrases leave no such room grows instead. So every
phrase that is frequent enough survives.

Words come first, then pairs of two surviving words, then three to five words whose pairs all survive: parts of
a frequent phrase are frequent. What survives goes to the tasks as a bit table over the hashes, of a size that
is bounded whatever the corpus; where two hashes share a bit, a phrase too many is counted. The last pass counts
the surviving phrases by their words, exactly.

Defined results: null texts are empty and count no words; a null language is ``und`` and is counted with it; rows
that share a doc_id, or have none, are documents of their own; very long texts are worked on in parts that are cut
between pieces; phrases of equal score and count come in the order of their bytes; an empty table gives no rows.
Columns other than text and lang are ignored, whatever their names.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.llm.common import leading, mixed, partitions, written

LONGEST, LEAST, SHOWN = 5, 100, 2000
ROOM = 1 << 21  # counters of a summary, before all of them fall
LOT = 1 << 20  # bytes worked on at once
PENDING = 1 << 20  # counters that a task holds before it sends them
BITS_LEAST, BITS_MOST = 20, 30  # size of a bit table, as a power of two
FEW_LANGUAGES = 10_000  # up to so many rows are broadcast

#: A-Z lower-cased, tabs as spaces, ends of pieces as line ends.
LETTERS = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ\t.,;:!?\x0b\x0c\r", b"abcdefghijklmnopqrstuvwxyz \n\n\n\n\n\n\n\n\n")
BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)  # odd


class Powers:
    """Powers of a base and of its inverse modulo 2^64: a hash of any byte range from two running sums."""

    def __init__(self, base: int, n: int) -> None:
        self.up, self.down = (np.cumprod(np.full(n + 1, b, np.uint64)) for b in (base, pow(base, -1, 1 << 64)))

    def ranges(self, a: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Equal bytes give equal hashes, wherever they stand."""
        with np.errstate(over="ignore"):
            sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((a + np.uint64(1)) * self.up[: len(a)])])
            return (sums[ends] - sums[starts]) * self.down[starts]


@functools.cache
def powers(base: int, n: int) -> Powers:
    return Powers(base, n)


def runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begin and end of each run of true values."""
    edges = np.flatnonzero(np.diff(np.concatenate([[0], mask.view(np.int8), [0]])))
    return edges[::2], edges[1::2]


class Words:
    """The words of some texts laid end to end, and hashes of their runs by language."""

    def __init__(self, texts: list[bytes], langs: list[bytes]) -> None:
        self.joined, self.langs = b"\n".join(texts), langs
        a = np.frombuffer(self.joined, np.uint8)
        room = 1 << max(16, len(a).bit_length())  # few sizes, so that powers are computed once
        self.starts, self.ends = runs((a != 32) & (a != 10))
        self.piece = np.cumsum(a == 10, dtype=np.int32)[self.starts]
        begins = np.cumsum([0, *(len(t) + 1 for t in texts)])[:-1]
        self.doc = np.searchsorted(begins, self.starts, side="right") - 1
        lang = np.array([xxhash.xxh3_64_intdigest(x) for x in langs], np.uint64)[self.doc]
        self.bytes, self.room = a.astype(np.uint64), room
        with np.errstate(over="ignore"):
            self.words = mixed(powers(BASES[0], room).ranges(self.bytes, self.starts, self.ends) + lang, 0)

    def together(self) -> np.ndarray:
        """Does the next word belong to the same piece?"""
        return self.piece[1:] == self.piece[:-1]

    def runs_of(self, k: int) -> np.ndarray:
        """A hash of each run of k words, by language."""
        n = max(0, len(self.words) - k + 1)
        out = self.words[:n]
        with np.errstate(over="ignore"):
            for i in range(1, k):
                out = mixed(out, i) + self.words[i : i + n]
        return mixed(out, k)

    def surviving(self, tables: list[np.ndarray], most: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """k, place and hash of the runs of k words, up to ``most``, that can be frequent by the tables so far.

        tables: of words, of pairs, of longer runs. A run needs each word, each pair, and itself to be in its table.
        """
        ok = np.ones(len(self.words), bool)
        pairs = ok
        for k in range(1, most + 1):
            if k > len(self.words):
                return
            if k <= 2:
                ok = ok if k == 1 else self.together() & ok[:-1] & ok[1:]
            else:
                ok = ok[:-1] & pairs[k - 2 :]
            h = self.runs_of(k)
            if len(tables) > min(k, 3) - 1:
                table = tables[min(k, 3) - 1]
                at = np.flatnonzero(ok)
                ok = np.zeros(len(h), bool)
                ok[at[has(table, h[at])]] = True
            if k == 2:
                pairs = ok
            at = np.flatnonzero(ok)
            yield k, at, h[at]


def has(table: np.ndarray, h: np.ndarray) -> np.ndarray:
    at = h >> np.uint64(64 - (len(table).bit_length() + 2))
    return (table[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1


def lots(batches: Iterator[pa.RecordBatch]) -> Iterator[Words]:
    """Texts in lots of about LOT bytes; a longer text is cut between pieces."""
    texts: list[bytes] = []
    langs: list[bytes] = []
    size = 0
    for batch in batches:
        for text, code in zip(batch["text"].cast(pa.binary()).to_pylist(), batch["lang"].cast(pa.binary()).to_pylist(), strict=True):
            raw = text.translate(LETTERS)
            while raw:
                end = len(raw) if len(raw) <= LOT else (raw.rfind(b"\n", 0, LOT) + 1 or raw.find(b"\n", LOT) + 1 or len(raw))
                texts.append(raw[:end])
                langs.append(code)
                size, raw = size + end, raw[end:]
                if size >= LOT:
                    yield Words(texts, langs)
                    texts, langs, size = [], [], 0
    if texts:
        yield Words(texts, langs)


def summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, with the sum of their counts."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(counts[order], first) if len(first) else counts[:0]


PARTS = "part int, keys binary, counts binary"


def count_parts(tables, levels: tuple[int, int], parts: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counters of the runs of ``levels`` words that can be frequent by the tables, by hash partition."""
    known = [t.value for t in tables]
    pending: list[tuple[np.ndarray, np.ndarray]] = []

    def send() -> Iterator[pa.RecordBatch]:
        keys, counts = summed(np.concatenate([p[0] for p in pending]), np.concatenate([p[1] for p in pending]))
        if len(keys) < PENDING // 2 and pending:
            pending[:] = [(keys, counts)]
            return
        pending.clear()
        yield packed(keys, counts)

    def packed(keys: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
        cuts = np.searchsorted(keys, np.arange(1, parts, dtype=np.uint64) << np.uint64(64 - parts.bit_length() + 1)) if parts > 1 else np.zeros(0, np.int64)
        rows = [(i, k.astype("<u8").tobytes(), c.astype("<u4").tobytes()) for i, (k, c) in enumerate(zip(np.split(keys, cuts), np.split(counts, cuts), strict=True)) if len(k)]
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary()), pa.array([r[2] for r in rows], pa.binary())], names=["part", "keys", "counts"])

    for lot in lots(batches):
        found = [h for k, _, h in lot.surviving(known, levels[1]) if k >= levels[0]]
        if found:
            h = np.concatenate(found)
            pending.append(summed(h, np.ones(len(h), np.int64)))
        if sum(len(p[0]) for p in pending) >= PENDING:
            yield from send()
    if pending:
        yield packed(*summed(np.concatenate([p[0] for p in pending]), np.concatenate([p[1] for p in pending])))


class Summary:
    """Misra-Gries counters; ``lost``: what any key can have lost, always below ``least``."""

    def __init__(self, least: int, room: int = ROOM) -> None:
        self.least, self.room, self.lost, self.mass = least, room, 0, 0
        self.keys, self.counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)

    def merge(self, keys: np.ndarray, counts: np.ndarray) -> None:
        self.mass += int(counts.sum())
        self.keys, self.counts = summed(np.concatenate([self.keys, keys]), np.concatenate([self.counts, counts]))
        if len(self.keys) > self.room:
            fall = min(int(np.partition(self.counts, len(self.counts) - self.room - 1)[len(self.counts) - self.room - 1]), self.least - 1 - self.lost)
            self.counts = self.counts - fall
            stay = self.counts > 0
            self.keys, self.counts, self.lost = self.keys[stay], self.counts[stay], self.lost + fall

    def survivors(self) -> np.ndarray:
        return self.keys[self.counts + self.lost >= self.least]


def summarise(least: int, room: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in the order of their hash partition -> one row a partition: its surviving hashes."""
    now, summary, waiting, held = None, None, [], 0

    def merge() -> None:
        nonlocal waiting, held
        if waiting:
            summary.merge(np.concatenate([np.frombuffer(k, "<u8") for k, _ in waiting]), np.concatenate([np.frombuffer(c, "<u4") for _, c in waiting]).astype(np.int64))
        waiting, held = [], 0

    def done() -> pa.RecordBatch:
        merge()
        left = summary.survivors()
        return pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([left.astype("<u8").tobytes()], pa.binary()), pa.array([len(left)], pa.int64())], names=["part", "keys", "n"])

    for batch in batches:
        for part, keys, counts in zip(batch["part"].to_pylist(), batch["keys"].to_pylist(), batch["counts"].to_pylist(), strict=True):
            if part != now:
                if summary is not None:
                    yield done()
                now, summary = part, Summary(least, room)
            waiting.append((keys, counts))
            held += len(counts)
            if held >= 4 * max(1 << 20, room // 4):
                merge()
    if summary is not None:
        yield done()


def bit_table(survivors: DataFrame, parts: int) -> np.ndarray:
    """One bit for each range of hashes: does a survivor lie in it? At most 2^BITS_MOST bits."""
    n = survivors.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    bits = max(BITS_LEAST, parts.bit_length() + 2, min(BITS_MOST, (64 * n).bit_length()))

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for part, keys in zip(batch["part"].to_pylist(), batch["keys"].to_pylist(), strict=True):
                own = np.zeros((1 << bits) // parts, bool)
                own[(np.frombuffer(keys, "<u8") >> np.uint64(64 - bits)).astype(np.int64) - part * len(own)] = True
                out.append(np.packbits(own, bitorder="little").tobytes())
            yield pa.RecordBatch.from_arrays([batch["part"], pa.array(out, pa.binary())], names=["part", "bits"])

    table = np.zeros((1 << bits) // 8, np.uint8)
    size = len(table) // parts
    for row in survivors.filter("n > 0").select("part", "keys").mapInArrow(fold, "part int, bits binary").toLocalIterator():
        table[row["part"] * size : (row["part"] + 1) * size] = np.frombuffer(row["bits"], np.uint8)
    return table


def counted(tables, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """lang, phrase, n of the surviving phrases of a lot, and the number of all words under a null phrase."""
    known = [t.value for t in tables]
    for words in lots(batches):
        langs = words.langs
        rows: list[tuple[bytes, bytes | None, int]] = []
        per_doc = np.bincount(words.doc, minlength=len(langs))
        for code in set(langs):
            rows.append((code, None, int(per_doc[[x == code for x in langs]].sum())))
        second = powers(BASES[1], words.room)
        for k, at, h in words.surviving(known, LONGEST):
            if not len(at):
                continue
            order = np.argsort(h, kind="stable")
            at, h = at[order], h[order]
            other = second.ranges(words.bytes, words.starts[at], words.ends[at + k - 1])
            first = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (other[1:] != other[:-1])]))  # both hashes agree
            n = np.diff(np.concatenate([first, [len(h)]]))
            for i, m in zip(at[first].tolist(), n.tolist(), strict=True):
                rows.append((langs[words.doc[i]], words.joined[words.starts[i] : words.ends[i + k - 1]], m))
        phrases = [p if p is None or b"  " not in p else b" ".join(p.split()) for _, p, _ in rows]
        arrays = [pa.array([r[0] for r in rows], pa.binary()).cast(pa.string()), pa.array(phrases, pa.binary()).cast(pa.string()), pa.array([r[2] for r in rows], pa.int64())]
        yield pa.RecordBatch.from_arrays(arrays, names=["lang", "phrase", "n"])


def frequent(docs: DataFrame, least: int = LEAST, room: int = ROOM) -> tuple[DataFrame, DataFrame]:
    """docs (text, lang) -> the phrases of one to five words with at least ``least`` occurrences (lang, phrase, n), and all words (lang, n)."""
    spark = docs.sparkSession
    rows = docs.select(F.coalesce("text", F.lit("")).alias("text"), F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"))
    mass = rows.agg(F.coalesce(F.sum(F.octet_length("text") + 1), F.lit(0))).first()[0] // 2  # no more words than that
    parts = 1 << max(8 * partitions(spark) - 1, mass // (least * room)).bit_length()
    tables = []
    for levels in ((1, 1), (2, 2), (3, LONGEST)):
        sent = rows.mapInArrow(functools.partial(count_parts, tuple(tables), levels, parts), PARTS)
        dealt = sent.repartition(partitions(spark), "part").sortWithinPartitions("part")
        survivors = written(dealt.mapInArrow(functools.partial(summarise, least, room), "part int, keys binary, n long"), "survivors")
        tables.append(spark.sparkContext.broadcast(bit_table(survivors, parts)))
    exact = rows.mapInArrow(functools.partial(counted, tuple(tables)), "lang string, phrase string, n long")
    counts = written(exact.groupBy("lang", "phrase").agg(F.sum("n").alias("n")).filter((F.col("n") >= least) | F.col("phrase").isNull()), "phrases")
    return counts.filter("phrase is not null"), counts.filter("phrase is null").select("lang", F.col("n").alias("words"))


def cuts(phrase: Column) -> Column:
    """Each way to cut a phrase in two: after k words, first part, rest."""
    w = F.split(phrase, " ")
    part = lambda a, n: F.array_join(F.slice(w, a, n), " ")
    return F.transform(F.sequence(F.lit(1), F.size(w) - 1), lambda k: F.struct(k.alias("k"), part(F.lit(1), k).alias("first"), part(k + 1, F.size(w) - k).alias("rest")))


def inner(phrase: Column) -> Column:
    """The shorter phrases of two words or more that lie inside."""
    w = F.split(phrase, " ")
    sizes = F.sequence(F.lit(2), F.size(w) - 1)
    return F.flatten(F.transform(sizes, lambda k: F.transform(F.sequence(F.lit(1), F.size(w) - k + 1), lambda i: F.array_join(F.slice(w, i, k), " "))))


def collocations(docs: DataFrame, least: int = LEAST, shown: int = SHOWN, room: int = ROOM) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the best phrases of each language."""
    counts, totals = frequent(docs, least, room)
    several = counts.filter(F.contains("phrase", F.lit(" "))).withColumnRenamed("n", "a")
    long = several.filter(F.size(F.split("phrase", " ")) > 2)
    inside = long.select("lang", F.explode(F.array_distinct(inner(F.col("phrase")))).alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    kept = several.join(inside, ["lang", "phrase"], "left").filter("longer is null or longer < a").drop("longer")
    each = kept.select("lang", "phrase", "a", F.explode(cuts(F.col("phrase"))).alias("c")).select("lang", "phrase", "a", "c.*")
    part = lambda name, n: counts.select("lang", F.col("phrase").alias(name), F.col("n").alias(n))
    each = each.join(part("first", "l"), ["lang", "first"]).join(part("rest", "r"), ["lang", "rest"])
    each = each.join(F.broadcast(totals) if totals.count() <= FEW_LANGUAGES else totals, "lang")
    score = F.expr("cast(a AS decimal(19,0)) * cast(1000 * words AS decimal(19,0)) div (cast(l AS decimal(19,0)) * cast(r AS decimal(19,0)))")
    best = each.withColumn("score", score).groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r", "words")).alias("b"))
    rows = best.select("lang", "phrase", "a", "b.l", "b.r", F.col("b.words").alias("n"), "b.score")
    top = leading(rows, ["lang"], [F.desc("score"), F.desc("a"), F.asc("phrase")], shown, ["phrase"])
    return top.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
