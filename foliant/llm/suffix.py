"""Operator 1: suffix-array deduplication of repeated byte strings across documents.

A byte goes if a string of ``LENGTH`` bytes that covers it also starts in a document with a smaller
doc_id. To find these strings without one suffix array over the whole corpus, every string is dealt to a
bucket by its minimizer (the gram with the smallest hash inside it): equal strings meet, and strings that
follow each other with one minimizer travel as one slice. Equal slices merge, first in the task that they
leave, then as they arrive. Each bucket then sorts the suffixes of the slices that another document may
share. In suffix order, the previous and the next position of a smaller document hold a suffix's longest
match in an earlier document; the longer one is its longest previous factor, and a string goes if that
reaches ``LENGTH``.

A group of copies may hold any share of the rows: a bucket gets a hot slice once from each lot of a task, and
keeps it once. A gram that very many distinct slices share would fill its bucket, so such slices are split: each
string goes by the bytes on that side of the gram where it has more of them, and where these are shared by too
many as well, by more bytes, up to the whole string. Equal strings take the same way, since it depends on what is
in them. Which keys are shared by many is read off a sample of the distinct slices; it moves strings, and
changes no result. Buckets are as many as the bytes call for; a partition works on several of them, one after
another, so partitions follow the cluster.

Defined results: null counts as empty; texts under ``LENGTH`` bytes lose nothing; matches inside one
document, and between rows of one doc_id, remove nothing, and each such row loses what its own text shares
with smaller doc_ids; a row without a doc_id (null) neither loses anything nor takes from others; very long
texts are worked on in overlapping segments; an empty table gives no rows. Columns other than doc_id and text
are ignored, whatever their names.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.llm.common import mixed, numbered, partitions, text_bytes

LENGTH, GRAM = 50, 8
#: Context on one side of a minimizer that any string has at least: half of what the gram leaves.
SIDE = (LENGTH - GRAM) // 2
#: Bytes worked on at once in a task; longer texts go in segments that overlap by LENGTH - 1.
PIECE = 1 << 20
PLACE = 24  # bits of a position in a piece
#: Bytes of text whose slices leave a task together, after equal ones among them have been found.
LOT = 8 << 20
#: Raw bytes of slices that a bucket should hold.
BUCKET = 24 << 20
#: One of SAMPLE distinct slices is looked at; a key that SHARED of these have is dealt by finer keys (some 65,000 slices).
SAMPLE, SHARED = 2048, 32
#: The table of such keys has 2 to this power bits at most (32 MB). Keys that meet others' bits are split for nothing.
TABLE = 28
#: part tells rows of one doc_id apart (see ``numbered``).
HEAD = np.dtype([("doc", "<i8"), ("part", "<i8"), ("start", "<i8"), ("size", "u1"), ("gram", "u1")])
RUNS = "doc long, part long, runs binary"
#: Partitions that buckets are dealt to, at most.
DEALT = 20_000


def sliding_least(v: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each run of ``width`` values, by running minima from block borders both ways."""
    n = len(v) - width + 1
    padded = np.full(-(-len(v) // width) * width, np.iinfo(v.dtype).max, v.dtype)
    padded[: len(v)] = v
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:n], ahead[width - 1 : width - 1 + n])


def pieces(rows: list[tuple[int, int, bytes]]) -> Iterator[list[tuple[int, int, bytes, int]]]:
    """(doc_id, part, bytes) -> (doc_id, offset, bytes, part) in lots of about PIECE bytes, smaller doc_ids first."""
    lot: list[tuple[int, int, bytes, int]] = []
    held = 0
    for doc, row, text in sorted(rows, key=lambda r: r[:2]):
        for at in range(0, max(1, len(text) - LENGTH + 1), PIECE):
            part = text[at : at + PIECE + LENGTH - 1]
            if len(part) >= LENGTH:
                lot.append((doc, at, part, row))
                held += len(part)
            if held >= PIECE:
                yield lot
                lot, held = [], 0
    if lot:
        yield lot


def slices(lot: list[tuple[int, int, bytes, int]]) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All strings of a lot as slices: the joined bytes; each slice's begin, end, minimizer place and hash."""
    joined = b"".join(x[2] for x in lot)
    size = np.array([len(x[2]) for x in lot])
    ends = np.cumsum(size)
    a = np.frombuffer(joined, np.uint8)
    grams = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(a, GRAM)).view("<u8").ravel()
    h = mixed(grams, 0)
    place = np.uint64((1 << PLACE) - 1)
    v = (h & ~place) | np.arange(len(h), dtype=np.uint64)
    least = (sliding_least(v, LENGTH - GRAM + 1) & place).astype(np.int64)
    inside = np.ones(len(least) + 1, np.int8)
    inside[-1] = 0
    for e in ends[:-1]:
        inside[max(0, e - LENGTH + 1) : e] = 0
    inside = inside[:-1].astype(bool)
    before = np.concatenate([[False], inside[:-1]])
    begins = inside & (~before | np.concatenate([[True], least[1:] != least[:-1]]))
    first = np.flatnonzero(begins)
    stops = np.flatnonzero(inside & ~np.concatenate([inside[1:], [False]]))  # last string of a document
    nexts = np.append(first[1:], len(least))
    last = np.minimum(nexts - 1, stops[np.searchsorted(stops, first)])
    return joined, first, last + LENGTH, least[first], h[least[first]]


def halves(s: bytes, a: int, b: int) -> list[tuple[int, int, int, int]]:
    """The strings of a slice that hold its bytes a to b, dealt by further bytes: (begin, end) of a slice and of its longer key.

    A string has LENGTH - (b - a) further bytes. Those with half of them or more before a go by that half, the
    others by what they must have behind b. A key of LENGTH bytes is the string itself.
    """
    further = LENGTH - (b - a)
    if further == 0:
        return []
    before = (further + 1) // 2
    left, right = min(len(s) - LENGTH, a - before), max(0, a - before + 1)
    out = [(0, left + LENGTH, a - before, b)] if left >= 0 else []
    return out + ([(right, len(s), a, b + further - before + 1)] if right <= len(s) - LENGTH else [])


class Shared:
    """Keys that too many distinct slices share, as bits of their hashes."""

    def __init__(self, bits: np.ndarray) -> None:
        self.bits, self.mask = bits, np.uint64(len(bits) * 8 - 1)

    def holds(self, keys: np.ndarray) -> np.ndarray:
        at = keys & self.mask
        return (self.bits[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 > 0

    def split(self, s: bytes, gram: int) -> Iterator[tuple[int, int, int]]:
        """A slice whose gram is shared by too many -> (begin, end, key) of the slices that its strings go in."""
        open_ = [(0, len(s), gram, gram + GRAM)]
        while open_:
            lo, hi, a, b = open_.pop()
            for x, y, c, d in halves(s[lo:hi], a - lo, b - lo):
                key = xxhash.xxh3_64_intdigest(s[lo + c : lo + d])
                if d - c < LENGTH and self.holds(np.array([key], np.uint64))[0]:
                    open_.append((lo + x, lo + y, lo + c, lo + d))
                else:
                    yield lo + x, lo + y, key


def sampled_keys(sample: int):
    """Documents -> (key, slice): all keys, short and long, that one of ``sample`` distinct slices could go by.

    A slice is drawn by a hash of its own bytes, so copies are drawn together and count once.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lot, _ in lots(batches):
            joined, begin, end, gram, h = slices(lot)
            words = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(np.frombuffer(joined, np.uint8), 8)).view("<u8").ravel()
            mark = h
            for at in (begin, begin + 16, end - 24, end - 8):
                mark = mixed(mark ^ words[at], 2)
            found: set[tuple[int, int]] = set()
            for i in np.flatnonzero(mark % np.uint64(sample) == 0).tolist():
                s, g = joined[begin[i] : end[i]], int(gram[i] - begin[i])
                open_ = [(0, len(s), g, g + GRAM, int(h[i]))]
                while open_:
                    lo, hi, a, b, key = open_.pop()
                    found.add((key, xxhash.xxh3_64_intdigest(s[lo:hi])))
                    open_ += [(lo + x, lo + y, lo + c, lo + d, xxhash.xxh3_64_intdigest(s[lo + c : lo + d])) for x, y, c, d in halves(s[lo:hi], a - lo, b - lo) if d - c < LENGTH]
            if found:
                both = np.array(list(found), np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], names=["key", "slice"])

    return run


def shared_keys(texts: DataFrame, raw: int, sample: int = SAMPLE) -> Shared:
    """The keys of SHARED sampled slices or more, for ``raw`` bytes of text. Equal bits count once; 4 KB of them a row come to the driver."""
    width = min(TABLE, max(16, (raw >> 14).bit_length()))
    many = texts.mapInArrow(sampled_keys(sample), "key long, slice long").groupBy("key").agg(F.count_distinct("slice").alias("n")).filter(F.col("n") >= SHARED)
    at = F.col("key").bitwiseAND((1 << width) - 1)
    chunks = many.groupBy(F.shiftright(at, 15).alias("chunk")).agg(F.bitmap_construct_agg(at.bitwiseAND((1 << 15) - 1)).alias("bits"))
    bits = np.zeros(1 << (width - 3), np.uint8)
    for chunk, found in chunks.collect():
        bits[chunk << 12 : (chunk + 1) << 12] |= np.frombuffer(found, np.uint8)
    return Shared(bits)


def packed(head: np.ndarray, parts: list[bytes], level: int = 8) -> bytes:
    """Slices as one compressed blob: the fields of the heads one after another, numbers as differences, then the bytes."""
    fields = [np.diff(head[k], prepend=0) if k in ("doc", "part", "start") else head[k] for k in HEAD.names]
    octets = [np.ascontiguousarray(f.reshape(-1, 1).view(np.uint8).T).tobytes() for f in fields]
    return zstandard.compress(len(head).to_bytes(4, "little") + b"".join(octets) + b"".join(parts), level)


def unpacked(blob: bytes) -> tuple[np.ndarray, list[bytes]]:
    raw = zstandard.decompress(blob)
    n = int.from_bytes(raw[:4], "little")
    head, at = np.empty(n, HEAD), 4
    for k in HEAD.names:
        kind = HEAD[k]
        x = np.ascontiguousarray(np.frombuffer(raw, np.uint8, n * kind.itemsize, at).reshape(kind.itemsize, n).T).view(kind).ravel()
        head[k] = np.cumsum(x) if k in ("doc", "part", "start") else x
        at += n * kind.itemsize
    ends = 4 + n * HEAD.itemsize + np.cumsum(head["size"], dtype=np.int64)
    begins = ends - head["size"]
    return head, [raw[b:e] for b, e in zip(begins.tolist(), ends.tolist(), strict=True)]


def by_row(doc: np.ndarray, part: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[list[int], list[int], list[bytes]]:
    """Runs as one packed row a row of the table: doc_ids, parts, runs."""
    order = np.lexsort((start, part, doc))
    doc, part, spans = doc[order], part[order], np.stack([start[order], end[order]], axis=1).astype("<i8")
    cut = np.flatnonzero((np.diff(doc) != 0) | (np.diff(part) != 0)) + 1
    first = np.concatenate([[0], cut]) if len(doc) else np.zeros(0, np.int64)
    return doc[first].tolist(), part[first].tolist(), [x.tobytes() for x in np.split(spans, cut)] if len(doc) else []


DEALT_ROWS = pa.schema([("bucket", pa.int32()), ("doc", pa.int64()), ("part", pa.int64()), ("blob", pa.binary())])


def lots(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[tuple[int, int, bytes, int]], int]]:
    """Documents (_id, _part, _text) -> lots of pieces, with the number of their batch; short texts and rows without a doc_id are left out."""
    for number, batch in enumerate(batches):
        rows = [(d, p, t) for d, p, t in zip(*(batch[c].to_pylist() for c in ("_id", "_part", "_text")), strict=True) if len(t) >= LENGTH and d is not None]
        for lot in pieces(rows):
            yield lot, number


def dealt(buckets: int, shared: Shared | None = None):
    """Documents (_id, _part, _text) -> slices by bucket, and runs that an earlier document of the same task has (bucket, runs)."""

    def late(own: list[bytes], docs: np.ndarray) -> np.ndarray:
        seen: dict[bytes, int] = {}
        return np.fromiter((seen.setdefault(s, d) for s, d in zip(own, docs.tolist(), strict=True)), np.int64, len(own)) < docs

    def going(own: list[bytes], fields: list[np.ndarray], gone: np.ndarray) -> Iterator[pa.RecordBatch]:
        docs, parts, at = (x[gone] for x in fields[:3])
        size = np.fromiter((len(own[i]) for i in np.flatnonzero(gone).tolist()), np.int64, len(docs))
        ids, rows, runs = by_row(docs, parts, at, at + size)
        if ids:
            yield pa.RecordBatch.from_arrays([pa.array([d % buckets for d in ids], pa.int32()), pa.array(ids, pa.int64()), pa.array(rows, pa.int64()), pa.array(runs, pa.binary())], schema=DEALT_ROWS)

    def split(own: list[bytes], fields: list[np.ndarray], hot: list[int]) -> tuple[list[bytes], list[np.ndarray]]:
        """What the slices in ``hot`` are split into, with fields of their own; their key takes the hash's place."""
        new: list[bytes] = []
        rows: list[tuple[int, int, int]] = []
        for i in hot:
            for lo, hi, key in shared.split(own[i], int(fields[3][i])):
                new.append(own[i][lo:hi])
                rows.append((i, lo, key))
        of, lo = np.array([r[0] for r in rows], np.int64), np.array([r[1] for r in rows], np.int64)
        return new, [fields[0][of], fields[1][of], fields[2][of] + lo, fields[3][of] - lo, np.array([r[2] for r in rows], np.uint64)]

    def leaving(own: list[bytes], fields: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        gone = late(own, fields[0])
        yield from going(own, fields, gone)
        hot = ~gone & shared.holds(fields[4]) if shared else np.zeros(len(own), bool)
        if hot.any():
            finer, more = split(own, fields, np.flatnonzero(hot).tolist())
            own, fields = own + finer, [np.concatenate(x) for x in zip(fields, more, strict=True)]
            again = late(finer, more[0])
            yield from going(finer, more, again)
            gone = np.concatenate([gone | hot, again])
        docs, parts, at, gram, h = fields
        size = np.fromiter(map(len, own), np.int64, len(own))
        keep = np.flatnonzero(~gone)
        bucket = (mixed(h[keep], 1) % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        keep, bucket = keep[order], bucket[order]
        head = np.empty(len(keep), HEAD)
        for name, x in (("doc", docs), ("part", parts), ("start", at), ("size", size), ("gram", gram)):
            head[name] = x[keep]
        cuts = [0, *(np.flatnonzero(np.diff(bucket)) + 1).tolist(), len(keep)]
        named = [(int(bucket[a]), packed(head[a:b], [own[i] for i in keep[a:b]])) for a, b in zip(cuts, cuts[1:], strict=False) if b > a]
        if named:
            none = pa.nulls(len(named), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in named], pa.int32()), none, none, pa.array([x[1] for x in named], pa.binary())], schema=DEALT_ROWS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: list[bytes] = []
        found: list[list[np.ndarray]] = []
        held, now = 0, 0
        for lot, number in lots(batches):
            if own and (held >= LOT or number != now):
                yield from leaving(own, [np.concatenate(x) for x in zip(*found, strict=True)])
                own, found, held = [], [], 0
            now = number
            joined, begin, end, gram, h = slices(lot)
            starts = np.concatenate([[0], np.cumsum([len(x[2]) for x in lot])])
            which = np.searchsorted(starts, begin, "right") - 1
            own += [joined[b:e] for b, e in zip(begin.tolist(), end.tolist(), strict=True)]
            found.append([np.array([x[0] for x in lot])[which], np.array([x[3] for x in lot])[which], begin - starts[which] + np.array([x[1] for x in lot])[which], gram - begin, h])
            held += len(joined)
        if own:
            yield from leaving(own, [np.concatenate(x) for x in zip(*found, strict=True)])

    return run


def suffix_order(text: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Suffix array of all positions with ``length`` bytes left, by their first ``length`` bytes; each one's rank; the 8 bytes at each place.

    Equal ranks mean a common prefix of ``length`` bytes. Ranks of 8 bytes are doubled until they reach it.
    """
    n = len(text) - length + 1
    words = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(text, 8)).view(">u8").ravel()
    words = words.astype(np.uint64)
    _, rank = np.unique(words, return_inverse=True)
    reach = 8
    while reach < length:
        step = min(reach, length - reach)
        m = len(rank) - step
        _, rank = np.unique(rank[:m].astype(np.int64) * (int(rank.max()) + 1) + rank[step:], return_inverse=True)
        reach += step
    rank = rank[:n]
    return np.argsort(rank, kind="stable"), rank, words


def previous_smaller(values: np.ndarray) -> np.ndarray:
    """For each place the nearest place before it with a smaller value, or -1: places that hold none hand over their own."""
    before = np.arange(len(values)) - 1
    left = np.flatnonzero(before >= 0)
    while len(left := left[values[before[left]] >= values[left]]):
        before[left] = before[before[left]]
        left = left[before[left] >= 0]
    return before


def common_bytes(words: np.ndarray, rank: np.ndarray, a: np.ndarray, b: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """Length of the common prefix of the suffixes at a and b, up to ``length``. words: the 8 bytes at each place, big-endian."""
    out = np.where(rank[a] == rank[b], length, 0)
    left = np.flatnonzero(out == 0)
    for at in range(0, length, 8):
        differing = words[a[left] + at] ^ words[b[left] + at]
        same = differing == 0
        x = differing[~same]
        bits = 64 - np.frexp((x & ~(x >> np.uint64(1))).astype(np.float64))[1]  # above the highest one; without the next, it isn't rounded up
        out[left[~same]] = np.minimum(length, at + np.maximum(bits, 0) // 8)
        left = left[same]
    return out


def longest_previous(order: np.ndarray, rank: np.ndarray, doc: np.ndarray, words: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """Longest previous factors (up to ``length``) of the suffixes in ``order``: the longer of the matches with the
    previous and the next suffix of a smaller document. Places that take no part have 0.
    """
    out = np.zeros(len(rank), np.int64)
    d = doc[order]
    before, after = previous_smaller(d), len(d) - 1 - previous_smaller(d[::-1])[::-1]
    for there, other in ((before >= 0, before), (after < len(d), after)):
        mine = order[there]
        out[mine] = np.maximum(out[mine], common_bytes(words, rank, mine, order[other[there]], length))
    return out


def shared_context(own: list[bytes], gram: list[int]) -> list[int]:
    """Slices whose minimizer has SIDE equal bytes on its left or its right in another slice."""
    first: dict[tuple[bool, bytes], int] = {}
    marked = bytearray(len(own))
    for i, (s, g) in enumerate(zip(own, gram, strict=True)):
        if g >= SIDE and (j := first.setdefault((True, s[g - SIDE : g + GRAM]), i)) != i:
            marked[i] = marked[j] = 1
        if len(s) - g - GRAM >= SIDE and (j := first.setdefault((False, s[g : g + GRAM + SIDE]), i)) != i:
            marked[i] = marked[j] = 1
    return np.flatnonzero(np.frombuffer(marked, np.uint8)).tolist()


class Bucket:
    """Slices of a bucket, each distinct one once, with its occurrences in its first document; and the runs found so far."""

    def __init__(self) -> None:
        self.place: dict[bytes, int] = {}
        self.doc, self.part, self.start, self.gram = (array("q") for _ in range(4))
        self.more: dict[int, list[tuple[int, int]]] = {}  # further occurrences in the first document: (part, start)
        self.runs = array("q")  # doc, part, start, end

    def add(self, head: np.ndarray, own: list[bytes]) -> None:
        place, docs = self.place, self.doc
        for s, d, p, at, g in zip(own, *(head[k].tolist() for k in ("doc", "part", "start", "gram")), strict=True):
            i = place.setdefault(s, len(docs))
            if i == len(docs):
                docs.append(d)
                self.part.append(p)
                self.start.append(at)
                self.gram.append(g)
            elif d > docs[i]:
                self.runs.extend((d, p, at, at + len(s)))
            elif d == docs[i]:
                self.more.setdefault(i, []).append((p, at))
            else:
                for q, x in [(self.part[i], self.start[i]), *self.more.pop(i, [])]:
                    self.runs.extend((docs[i], q, x, x + len(s)))
                docs[i], self.part[i], self.start[i] = d, p, at

    def found(self) -> np.ndarray:
        """All runs (doc, part, start, end) of strings that an earlier document has too."""
        texts, docs = list(self.place), np.array(self.doc, np.int64)
        chosen = shared_context(texts, self.gram.tolist())
        if chosen:
            parts = [texts[i] for i in chosen]
            size = np.fromiter(map(len, parts), np.int64, len(parts))
            ends = np.cumsum(size)
            text = np.frombuffer(b"".join(parts) + bytes(LENGTH), np.uint8)
            order, rank, words = suffix_order(text)
            owner = np.searchsorted(ends, np.arange(len(rank)), "right")
            within = np.zeros(len(rank), bool)
            valid = np.flatnonzero(owner < len(parts))
            within[valid] = valid + LENGTH <= ends[owner[valid]]
            order = order[within[order]]
            doc = docs[chosen][np.minimum(owner, len(parts) - 1)]
            hit = longest_previous(order, rank, doc, words) >= LENGTH
            edges = np.flatnonzero(np.diff(np.concatenate([[0], hit.astype(np.int8), [0]])))
            begins = ends - size
            for x, y in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
                for k in range(int(owner[x]), int(owner[y - 1]) + 1):
                    lo, hi = max(x, int(begins[k])) - int(begins[k]), min(y - 1, int(ends[k]) - LENGTH) + LENGTH - int(begins[k])
                    i = chosen[k]
                    if hi - lo >= LENGTH:
                        for p, at in [(self.part[i], self.start[i]), *self.more.get(i, [])]:
                            self.runs.extend((self.doc[i], p, at + lo, at + hi))
        return np.array(self.runs, np.int64).reshape(-1, 4)


def matched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Slices in the order of their buckets -> packed runs by row."""
    schema = pa.schema([("doc", pa.int64()), ("part", pa.int64()), ("runs", pa.binary())])
    now, bucket = None, Bucket()

    def finished(b: Bucket) -> Iterator[pa.RecordBatch]:
        columns = by_row(*b.found().T)
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    for batch in batches:
        for number, doc, part, blob in zip(*(batch[c].to_pylist() for c in DEALT_ROWS.names), strict=True):
            if doc is not None:
                yield pa.RecordBatch.from_arrays([pa.array([doc], pa.int64()), pa.array([part], pa.int64()), pa.array([blob], pa.binary())], schema=schema)
                continue
            if number != now:
                yield from finished(bucket)
                now, bucket = number, Bucket()
            bucket.add(*unpacked(blob))
    yield from finished(bucket)


def joined_runs(spans: np.ndarray) -> np.ndarray:
    """Overlapping or touching runs as one."""
    spans = spans[np.argsort(spans[:, 0], kind="stable")]
    reach = np.maximum.accumulate(spans[:, 1])
    new = np.concatenate([[True], spans[1:, 0] > reach[:-1]])
    first = np.flatnonzero(new)
    return np.stack([spans[first, 0], reach[np.append(first[1:], len(spans)) - 1]], axis=1)


def repeated_runs(rows: DataFrame, text: str) -> DataFrame:
    """rows (_id, _part, a text) -> doc, part, runs (packed 64-bit begin and end pairs, may overlap): the bytes that go."""
    spark = rows.sparkSession
    raw = rows.select(F.sum(F.octet_length(text)).alias("n")).first()["n"] or 0
    least = partitions(spark)
    buckets = int(min(max(least, raw * 4 // BUCKET), 2**31 - 1))
    texts = rows.select("_id", "_part", text_bytes(text).alias("_text"))
    cut = texts.mapInArrow(dealt(buckets, shared_keys(texts, raw)), "bucket int, doc long, part long, blob binary")
    n = max(least, min(buckets, DEALT))
    return cut.repartitionById(n, F.pmod("bucket", F.lit(n))).sortWithinPartitions("bucket").mapInArrow(matched, RUNS)


def remove_repeats(docs: DataFrame) -> DataFrame:
    """One row a document: doc_id, n_bytes, n_removed, n_spans, kept binary (the remaining bytes)."""
    rows = numbered(docs.select("doc_id", "text"))
    runs = repeated_runs(rows, "c1").groupBy("doc", "part").agg(F.collect_list("runs").alias("runs"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, spans in zip(batch["_text"].to_pylist(), batch["runs"].to_pylist(), strict=True):
                if not spans:
                    out.append((len(text), 0, 0, text))
                    continue
                found = joined_runs(np.frombuffer(b"".join(spans), "<i8").reshape(-1, 2))
                edges = [0, *found.ravel().tolist(), len(text)]
                kept = b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))
                out.append((len(text), len(text) - len(kept), len(found), kept))
            cols = [pa.array([r[i] for r in out], kind) for i, kind in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.binary()))]
            yield pa.RecordBatch.from_arrays([batch["_id"], *cols], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    texts = rows.select("_id", "_part", text_bytes("c1").alias("_text"))
    both = texts.join(runs, (F.col("_id") == F.col("doc")) & (F.col("_part") == F.col("part")), "left")
    return both.select("_id", "_text", "runs").mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")


def removal_digests(docs: DataFrame) -> DataFrame:
    return remove_repeats(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
