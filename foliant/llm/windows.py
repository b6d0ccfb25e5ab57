"""Operator 7: near-duplicate passages across documents by compact windows.

Tokens are five-word shingles. For each of ``HASHES`` hash functions a Cartesian tree over a text's shingle
hashes groups all its subsequences that share a minimum: node (left, centre, right) stands for every
subsequence that holds the centre and stays between the borders. Only windows of a whole passage's width
are kept, and their centres are exactly the least positions of sliding ranges of that width, so the tree is
built over these few. Windows of different documents join where they share the function, the minimum, and
what stands on one side of it (the minimum of SIDE shingles there): intervals around one centre with one
neighbourhood. Each function finds a passage of similarity 0.8 with probability 0.8, less what an edit close
to the centre takes; both sides and three functions make up for it. Documents that share a frequent line
alone meet under few such keys, so a line in a third of all documents stands between no two copies of a
passage. Then the words themselves decide: a passage goes if an earlier document has one with a Jaccard
similarity of its shingles of 0.8 or more.

A hot passage leaves a task once: the smallest document of the task stands for the rest there, which link
to it, and the smallest document overall links the tasks. So no group is paired with itself. Where a key has three
documents or more, those that met there are compared first; a window that no passage covers then meets every earlier
document there whose surroundings allow a passage of LEAST to TWICE shingles round both centres. Surroundings travel as
16 bits a shingle and are compared under the key, before any text moves; a longer passage holds shorter ones.

Defined results: null counts as empty; texts under 50 words lose nothing; the smallest doc_id of a passage
keeps it, null counting as the largest, and of rows that share a doc_id the first counts as the earlier
document; passages within one row stay; words are runs of letters other than ASCII white space, compared with
A-Z lower-cased; white space in front of a removed passage stays and that behind it goes; very long texts are
taken in parts that overlap by a passage; an empty table gives no rows. Other columns are ignored by
``remove_passages`` and kept by ``drop_passages``, whatever their names.
"""

from __future__ import annotations

import functools
import itertools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliant.functions.joins import spread
from foliant.llm.common import in_key_order, mixed, partitions, place_of, renamed_schema, shingle_hashes, text_bytes, written
from foliant.llm.graph import components
from foliant.llm.suffix import sliding_least

WORDS, SHINGLE, SIMILAR = 50, 5, 0.8
LEAST = WORDS - SHINGLE + 1  # shingles of the shortest passage
HASHES = 3
PLACE = 24
LOT = 1 << 19  # words worked on at once
GAP = 2 * SHINGLE  # shingles without a match that a passage may bridge
WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def tree_windows(h: np.ndarray, starts: np.ndarray, least: int = LEAST) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Compact windows (left, centre, right; borders inside) of width ``least`` or more, texts laid end to end.

    starts: where each text begins, and the end. Of equal hashes the left one is smaller.
    """
    place = np.uint64((1 << PLACE) - 1)
    none = np.zeros(0, np.int64)
    if len(h) < least:
        return none, none, none
    v = (h & ~place) | np.arange(len(h), dtype=np.uint64)
    at = (sliding_least(v, least) & place).astype(np.int64)
    text = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
    inside = text[: len(at)] == text[least - 1 :]
    chosen = np.zeros(len(h), bool)
    chosen[at[inside]] = True
    centre = np.flatnonzero(chosen)
    lefts, rights = starts[text[centre]].tolist(), (starts[text[centre] + 1] - 1).tolist()
    values, places, owner = v[centre].tolist(), centre.tolist(), text[centre].tolist()
    left, right = lefts[:], rights[:]
    stack: list[int] = []
    for i, x in enumerate(values):
        if stack and owner[stack[-1]] != owner[i]:
            stack = []
        while stack and values[stack[-1]] > x:
            right[stack.pop()] = places[i] - 1
        if stack:
            left[i] = places[stack[-1]] + 1
        stack.append(i)
    return np.array(left, np.int64), centre, np.array(right, np.int64)


#: A window beside one of another text: where it stands and how far it reaches on both sides, in steps of STEP.
PLACE_KIND = np.dtype([("at", "<i4"), ("ahead", "<u2"), ("behind", "<u2")])
STEP = 8
#: Shingles on one side of a centre whose minimum tells its surroundings.
SIDE = 15
#: A lot's rows: blobs of windows by bucket, or what one document has in common with an earlier one of the lot.
WINDOWS = "bucket int, doc_id long, rep long, blob binary"
WINDOW_KIND = np.dtype([("route", "<u8"), ("doc", "<i8"), ("at", "<i4"), ("ahead", "<u2"), ("behind", "<u2")])


def as_blob(rows: np.ndarray) -> bytes:
    """Rows as one compressed blob: field after field, byte after byte; routes in order as differences."""
    fields = [np.diff(rows[k], prepend=rows[k].dtype.type(0)) if k == "route" else rows[k] for k in rows.dtype.names]
    return zstandard.compress(b"".join(np.ascontiguousarray(np.ascontiguousarray(f).reshape(-1, 1).view(np.uint8).T).tobytes() for f in fields), 3)


def of_blob(blob: bytes, kind: np.dtype = WINDOW_KIND) -> np.ndarray:
    raw = zstandard.decompress(blob)
    n, at = len(raw) // kind.itemsize, 0
    out = np.empty(n, kind)
    for k in kind.names:
        wide = kind[k].itemsize
        x = np.ascontiguousarray(np.frombuffer(raw, np.uint8, n * wide, at).reshape(wide, n).T).view(kind[k]).ravel()
        out[k] = np.cumsum(x, dtype=x.dtype) if k == "route" else x
        at += n * wide
    return out


def reach(x: np.ndarray) -> np.ndarray:
    return np.minimum(-(-x // STEP), np.iinfo(np.uint16).max)


def windows(buckets: int):
    """Texts (_key, _text) -> rows of ``WINDOWS``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = sorted(((d, t) for d, t in zip(batch["_key"].to_pylist(), batch["_text"].to_pylist(), strict=True) if len(t) >= 2 * WORDS - 1), key=lambda r: r[0])
            docs: list[int] = []
            found: list[tuple[int, np.ndarray]] = []
            held = 0
            for doc, text in rows:
                for h in shingles_in_parts(shingle_hashes(text.lower().split(), SHINGLE)):
                    docs.append(doc)
                    found.append(h)
                    held += len(h[1])
                if held > LOT:
                    yield from leaving(window_rows(docs, found), buckets)
                    docs, found, held = [], [], 0
            if docs:
                yield from leaving(window_rows(docs, found), buckets)

    return run


def shingles_in_parts(h: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """A text's shingles, in parts that overlap by a passage where there are very many: (offset, hashes)."""
    part = 1 << 22
    for at in range(0, len(h), part):
        if len(h) - at >= LEAST or not at:
            yield at, h[at : at + part + LEAST - 1]


def window_rows(docs: list[int], found: list[tuple[int, np.ndarray]]) -> np.ndarray:
    """The windows of a lot, once for each side of their centre that the text covers.

    The route says which function, which minimum, which side, and the minimum of the SIDE shingles there under another
    function: texts that share a frequent line alone part ways by what stands beside it.
    """
    starts = np.concatenate([[0], np.cumsum([len(x[1]) for x in found])])
    offset = np.array([x[0] for x in found])
    own, h = np.array(docs, np.int64), np.concatenate([x[1] for x in found])
    out = []
    for k in range(HASHES):
        hk = mixed(h, 100 + k)
        left, centre, right = tree_windows(hk, starts)
        if not len(centre):
            continue
        beside = sliding_least(mixed(h, 200 + k), SIDE)
        part = np.searchsorted(starts, centre, "right") - 1
        rows = np.empty(len(centre), WINDOW_KIND)
        rows["doc"], rows["at"] = own[part], centre - starts[part] + offset[part]
        rows["ahead"], rows["behind"] = reach(centre - left), reach(right - centre)
        sides = ((0, centre - SIDE, centre - SIDE >= starts[part]), (1, centre + 1, centre + SIDE < starts[part + 1]))
        for side, at, inside in sides:
            one = rows[inside]
            with np.errstate(over="ignore"):
                one["route"] = mixed(hk[centre[inside]] + mixed(beside[at[inside]], 300 + 2 * k + side), 400 + 2 * k + side)
            out.append(one)
    return np.concatenate(out) if out else np.empty(0, WINDOW_KIND)


def met(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Rows in the order of routes, documents and places; which of them belong to a later document of their route; and
    pairs of rows, a later document's and an earlier one's.

    Each is linked to the first document of its route. Where that one's window reaches less or more far, so that the
    two may only share a part, it is linked to the document right before it too.
    """
    rows = rows[np.lexsort((rows["at"], rows["doc"], rows["route"]))]
    n, doc = np.arange(len(rows)), rows["doc"]
    new = np.ones(len(rows), bool)
    new[1:] = rows["route"][1:] != rows["route"][:-1]
    head = np.maximum.accumulate(np.where(new, n, 0))
    new[1:] |= doc[1:] != doc[:-1]
    before = np.maximum.accumulate(np.where(new, n, 0)) - 1
    late = doc > doc[head]
    first = rows[head]
    apart = late & (doc[before] != first["doc"]) & ((rows["ahead"] != first["ahead"]) | (rows["behind"] != first["behind"]))
    return rows, late, np.concatenate([rows[late], rows[apart]]), np.concatenate([first[late], rows[before[apart]]])


ANCHOR_KIND = np.dtype([("own", PLACE_KIND), ("other", PLACE_KIND), ("route", "<u8")])


def beside(rows: np.ndarray, heads: np.ndarray) -> np.ndarray:
    a = np.empty(len(rows), ANCHOR_KIND)
    a["route"] = rows["route"]
    for k in PLACE_KIND.names:
        a["own"][k], a["other"][k] = rows[k], heads[k]
    return a


def anchors_of(rows: np.ndarray, heads: np.ndarray) -> Iterator[tuple[int, int, bytes]]:
    """(document, earlier document, packed anchors) for rows and the rows they have met."""
    a = beside(rows, heads)
    order = np.lexsort((heads["doc"], rows["doc"]))
    doc, rep, a = rows["doc"][order], heads["doc"][order], a[order]
    cuts = np.flatnonzero((doc[1:] != doc[:-1]) | (rep[1:] != rep[:-1])) + 1
    for x, y in itertools.pairwise([0, *cuts.tolist(), len(doc)]):
        if x < y:
            yield int(doc[x]), int(rep[x]), a[x:y].tobytes()


def leaving(rows: np.ndarray, buckets: int) -> Iterator[pa.RecordBatch]:
    """A lot's windows by bucket; of one route only the first document's, to which the lot's others are linked at once."""
    ranked, late, *pair = met(rows)
    linked = list(anchors_of(*pair))
    rest = ranked[~late]  # in the order of routes
    bucket = (rest["route"] % np.uint64(buckets)).astype(np.int64)
    by = np.argsort(bucket, kind="stable")
    rest, bucket = rest[by], bucket[by]
    cuts = [0, *(np.flatnonzero(np.diff(bucket)) + 1).tolist(), len(rest)]
    blobs = [(int(bucket[x]), as_blob(rest[x:y])) for x, y in itertools.pairwise(cuts) if x < y]
    columns = ([(d ^ r) % buckets for d, r, _ in linked] + [b for b, _ in blobs], [d for d, _, _ in linked] + [None] * len(blobs), [r for _, r, _ in linked] + [None] * len(blobs), [a for _, _, a in linked] + [b for _, b in blobs])
    kinds = (pa.int32(), pa.int64(), pa.int64(), pa.binary())
    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=[x.split()[0] for x in WINDOWS.split(", ")])


def paired(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The windows of a partition's buckets -> doc_id, rep, anchors: each window beside the first document of its route, see ``met``."""
    schema = pa.schema([("doc_id", pa.int64()), ("rep", pa.int64()), ("anchors", pa.binary())])
    held: list[np.ndarray] = []
    for batch in batches:
        linked = batch.filter(pc.is_valid(batch["doc_id"]))
        yield pa.RecordBatch.from_arrays([linked["doc_id"], linked["rep"], linked["blob"]], schema=schema)
        held += [of_blob(b) for b in batch.filter(pc.is_null(batch["doc_id"]))["blob"].to_pylist()]
    if not held:
        return
    rows = np.concatenate(held)
    routes = np.sort(rows["route"])
    twice = np.unique(routes[1:][routes[1:] == routes[:-1]])
    if not len(twice):
        return
    rows = rows[twice[np.minimum(np.searchsorted(twice, rows["route"]), len(twice) - 1)] == rows["route"]]
    ranked, late, own, other = met(rows)
    # The first document's further places under a route: one row, of its last place beside the one before.
    again = np.flatnonzero(~late[1:] & (ranked["route"][1:] == ranked["route"][:-1])) + 1
    again = again[np.flatnonzero(np.diff(ranked["route"][again], append=np.uint64(0)) != 0)] if len(again) else again
    own, other = np.concatenate([own, ranked[again]]), np.concatenate([other, ranked[again - 1]])
    each = pa.FixedSizeBinaryArray.from_buffers(pa.binary(ANCHOR_KIND.itemsize), len(own), [None, pa.py_buffer(beside(own, other).tobytes())])
    yield pa.RecordBatch.from_arrays([pa.array(own["doc"]), pa.array(other["doc"]), each.cast(pa.binary())], schema=schema)


def candidates(texts: DataFrame, text: str) -> DataFrame:
    """Pairs (later, rep, anchors): windows of a document beside those of an earlier one, or its own under a route again."""
    n = partitions(texts.sparkSession)
    made = texts.select("_key", text_bytes(text).alias("_text")).mapInArrow(windows(n), WINDOWS)
    found = made.repartitionById(n, "bucket").mapInArrow(paired, "doc_id long, rep long, anchors binary")
    return found.groupBy(F.col("doc_id").alias("later"), "rep").agg(F.collect_list("anchors").alias("anchors"))


#: Bits of the table that tells which texts have windows in crowded routes.
CROWD_BITS = 1 << 24


def packed(places: np.ndarray) -> np.ndarray:
    """Places as one number each, in the order of where they stand."""
    return places["at"].astype(np.int64) << 32 | places["ahead"].astype(np.int64) << 16 | places["behind"]


def unpacked(numbers: np.ndarray) -> np.ndarray:
    places = np.empty(len(numbers), PLACE_KIND)
    places["at"], places["ahead"], places["behind"] = numbers >> 32, numbers >> 16 & 0xFFFF, numbers & 0xFFFF
    return places


def members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs (later, rep, anchors) -> route, doc, place: where either document has windows under the routes they share."""
    kind = np.dtype([("route", "<i8"), ("doc", "<i8"), ("place", "<i8")])
    for batch in batches:
        for part in pieces(batch):
            blobs = [b"".join(a) for a in part["anchors"].to_pylist()]
            a = np.frombuffer(b"".join(blobs), ANCHOR_KIND)
            size = np.array([len(b) // ANCHOR_KIND.itemsize for b in blobs])
            rows = np.empty(2 * len(a), kind)
            for half, side, doc in ((rows[: len(a)], "own", "later"), (rows[len(a) :], "other", "rep")):
                half["route"], half["place"] = a["route"].view(np.int64), packed(a[side])
                half["doc"] = np.repeat(part[doc].to_numpy(), size)
            rows = rows[np.lexsort((rows["place"], rows["doc"], rows["route"]))]
            new = np.ones(len(rows), bool)
            new[1:] = np.any([rows[k][1:] != rows[k][:-1] for k in kind.names], axis=0)
            rows = rows[new]
            yield pa.RecordBatch.from_arrays([pa.array(rows[k]) for k in kind.names], names=list(kind.names))


def crowds(found: DataFrame) -> DataFrame:
    """The windows (route, doc, place, n, head: the first document) of routes under which more stand than one window beside another.
    found: ``candidates``. Rows meet by their route once; what follows is counted where they are."""
    rows = found.mapInArrow(members, "route long, doc long, place long").repartition("route").distinct()
    each = Window.partitionBy("route")
    rows = rows.select("route", "doc", "place", F.count("*").over(each).alias("n"), F.min("doc").over(each).alias("head"), F.max("doc").over(each).alias("_last"))
    return rows.filter("n > 2 and head < _last").drop("_last")


def parted(texts: DataFrame, keys: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """The texts whose _key is among the keys, and some others; and the rest: a table of CROWD_BITS bits tells them where they stand."""
    def bit(c: str) -> Column:
        return F.pmod(F.xxhash64(c), F.lit(CROWD_BITS)) + 1

    table = keys.select(bit(key).alias("_bit")).groupBy(F.bitmap_bucket_number("_bit").alias("_bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("_bit")).alias("_bits"))
    at = F.bitmap_bit_position(bit("_key"))
    octet = F.conv(F.hex(F.substring("_bits", F.shiftright(at, 3).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    rows = texts.withColumn("_bucket", F.bitmap_bucket_number(bit("_key"))).join(F.broadcast(table), "_bucket", "left")
    held = F.coalesce(octet.bitwiseAND(F.call_function("shiftleft", F.lit(1), (at % 8).cast("int"))) > 0, F.lit(False))
    return rows.filter(held).select(texts.columns), rows.filter(~held).select(texts.columns)


#: A document after the pairs found: where its removed runs begin and end, the earlier documents that have them, and its
#: windows under crowded routes that no passage covers.
JUDGED = "later long, spans binary, reps array<long>, open array<struct<route: long, places: binary>>"


def judged(text: str, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """_key, a text, its places under crowded routes (routes, places; or null) and its pairs -> rows of ``JUDGED``."""
    kinds = (pa.int64(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.struct([("route", pa.int64()), ("places", pa.binary())])))
    for batch in batches:
        for part in pieces(batch):
            out = []
            for doc, pairs, routes, places, raw in zip(*(part[c].to_pylist() for c in ("_key", "pairs")), *(lists(part[c]) for c in ("routes", "places")), raw_texts(part[text]), strict=True):
                gone, reps = covered(shingle_hashes(raw.lower().split(), SHINGLE), pairs)
                left: dict[int, list[int]] = {}
                open_ = ~gone[places >> 32]
                for route, place in zip(routes[open_].tolist(), places[open_].tolist(), strict=True):
                    left.setdefault(route, []).append(place)
                out.append((doc, edges_of(gone).astype("<i4").tobytes(), sorted(reps, key=lambda r: (r is None, r)), [{"route": r, "places": np.array(p, "<i8").tobytes()} for r, p in left.items()]))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], names=[x.split()[0] for x in ("later", "spans", "reps", "open")])


#: Shingles of the longest passage that doesn't hold a shorter one on either side; a passage round a centre reaches NEAR shingles
#: to each side of it, and as far as edits may move them in the other text.
TWICE = 2 * LEAST - 1
NEAR = TWICE - 1
FAR = NEAR + TWICE // 4 + 1
#: Documents of a crowded route that one task compares others with.
SLOT = 1 << 14
#: What stands around a window within its borders, for an earlier document (misses null) as far as FAR, for an open window as far as
#: NEAR: the shingles as 16 bits each, the centre among them, how many may be missing, and all of the document's open places with these.
AROUND = "route long, slot int, doc long, misses int, centre int, near binary, places binary"


def surroundings(text: str, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """_key, a text, its crowded routes (route, slots, first and last place, open places) -> rows of ``AROUND``, each kind once a batch."""
    kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary())
    for batch in batches:
        known: dict[tuple[int, int, int, bytes], int] = {}
        for part in pieces(batch):
            out = []
            for doc, wanted, raw in zip(*(part[c].to_pylist() for c in ("_key", "wanted")), raw_texts(part[text]), strict=True):
                whole = shingle_hashes(raw.lower().split(), SHINGLE)
                short = (whole >> np.uint64(48)).astype("<u2")
                for w in wanted:
                    slot = doc * 0x9E3779B1 % w["slots"]
                    # All have met the first document's first place.
                    for place in sorted({w["low"], w["high"]} - ({w["low"]} if w["head"] else set())) if w["early"] else ():
                        at, ahead, behind = place >> 32, STEP * (place >> 16 & 0xFFFF), STEP * (place & 0xFFFF)
                        a = max(0, at - min(ahead, FAR))
                        near = short[a : at + min(behind, FAR) + 1].tobytes()
                        # Of equal surroundings the first document's stand for the rest.
                        if known.get((w["route"], slot, at - a, near), doc + 1) > doc:
                            known[w["route"], slot, at - a, near] = doc
                            out.append((w["route"], slot, doc, None, at - a, near, np.int64(place).tobytes()))
                    same: dict[tuple[int, int, bytes], list[int]] = {}
                    for place in np.frombuffer(w["open"] or b"", "<i8").tolist():
                        at, ahead, behind = place >> 32, STEP * (place >> 16 & 0xFFFF), STEP * (place & 0xFFFF)
                        a, b = max(0, at - min(ahead, NEAR)), at + min(behind, NEAR) + 1
                        misses = len(np.unique(whole[a:b])) // 5
                        same.setdefault((misses, at - a, short[a:b].tobytes()), []).append(place)
                    for (misses, centre, near), places in same.items():
                        for s in range(w["slots"]):
                            out.append((w["route"], s, doc, misses, centre, near, np.array(places, "<i8").tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], names=[x.split()[0] for x in AROUND.split(", ")])


def latest(own: np.ndarray) -> np.ndarray:
    """Where each shingle stood before, or -1."""
    order = np.argsort(own, kind="stable")
    before = np.full(len(own), -1)
    twice = np.flatnonzero(own[order[1:]] == own[order[:-1]])
    before[order[twice + 1]] = order[twice]
    return before


def firsts(own: np.ndarray) -> tuple[np.ndarray, int]:
    """Which shingles stand for the first time, and how many different ones any LEAST in a row have at least."""
    before = latest(own)
    new = before < 0
    if new.all():
        return new, LEAST
    begin = np.arange(len(own) - LEAST + 1)[:, None]
    return new, int((before[begin + np.arange(LEAST)] < begin).sum(axis=1).min())


def fitting(own: np.ndarray, new: np.ndarray, centre: int, misses: int, other: np.ndarray) -> bool:
    """Whether some LEAST shingles in a row that hold the centre have no more than so many different ones that the other
    text (in order) lacks. new: see ``firsts``."""
    lacks = other[np.minimum(np.searchsorted(other, own), len(other) - 1)] != own
    total = np.concatenate([[0], np.cumsum(new & lacks)])
    begin = np.arange(max(0, centre - LEAST + 1), min(centre, len(own) - LEAST) + 1)
    return bool(len(begin)) and int((total[begin + LEAST] - total[begin]).min()) <= misses


#: A shingle that both texts have counts 1, one that only one of them has this much less: in a passage and its copy, h shared shingles
#: are at least 4 times those that only one of them has, so that both texts' sums over it make up to 0 or more.
LACK = 8


def best_sums(steps: np.ndarray, centre: np.ndarray, least: int) -> np.ndarray:
    """For each row of steps the largest sum over ``least`` in a row or more that hold the row's centre."""
    n, size = steps.shape
    run = np.zeros((n, size + 1), np.int32)
    np.cumsum(steps, axis=1, out=run[:, 1:])
    place, centre = np.arange(size + 1), centre[:, None]
    low = np.minimum.accumulate(np.where(place <= centre, run, 1 << 28), axis=1)
    return np.where(place[least:] > centre, run[:, least:] - low[:, : size + 1 - least], -(1 << 28)).max(axis=1, initial=-(1 << 28))


def exact_sums(steps: np.ndarray, before: np.ndarray, centre: int, least: int) -> np.ndarray:
    """As ``best_sums`` for one centre; a shingle counts once in a range, wherever that begins. before: see ``latest``."""
    best = np.full(len(steps), -(1 << 28), np.int32)
    for x in range(min(centre, steps.shape[1] - least) + 1):
        run = np.cumsum(steps[:, x:] * (before[x:] < x), axis=1)
        np.maximum(best, run[:, max(centre + 1, x + least) - x - 1 :].max(axis=1), out=best)
    return best


class Earlier:
    """The earlier rows of ``AROUND`` of one route and slot: their shingles side by side, filled up with one that no text has."""

    def __init__(self, rows: list[tuple]):
        own = [np.frombuffer(r[5], "<u2") for r in rows]
        size, self.centre = np.array([len(x) for x in own]), np.array([r[4] for r in rows])
        self.shingles = np.full((len(own), size.max()), 1 << 16, np.int32)
        inside = np.arange(self.shingles.shape[1]) < size[:, None]
        self.shingles[inside] = np.concatenate(own)
        self.first = np.ones(self.shingles.shape, np.int32)
        each = np.sort(self.shingles, axis=1)
        for i in np.flatnonzero((inside[:, 1:] & (each[:, 1:] == each[:, :-1])).any(axis=1)).tolist():
            self.first[i, : size[i]] = latest(self.shingles[i, : size[i]]) < 0
        self.place = np.full((1 << 16) + 1, -1, np.int32)

    def holding(self, own: np.ndarray, before: np.ndarray, centre: int, some: np.ndarray) -> np.ndarray:
        """Which of some rows allow a passage round the centre of an own text and round their own one: LEAST shingles or more there, a
        fifth less here, whose sums (see ``LACK``) make up to 0 or more.

        A shingle that repeats counts once in a range. First that is bounded from above: of a missing one its first place in the
        surroundings counts, and shared ones make up to no more than the different ones of all the surroundings.
        """
        new = before < 0
        kinds = own[new]
        self.place[kinds] = np.arange(len(kinds))
        code, ok = self.place[own], np.zeros(len(some), bool)
        for x in range(0, len(some), 1 << 10):
            part = some[x : x + (1 << 10)]
            at, first = self.place[self.shingles[part]], self.first[part]
            there = np.minimum(best_sums(np.where(at >= 0, 1, -LACK * first), self.centre[part], LEAST - LEAST // 5), (first * (at >= 0)).sum(axis=1))
            left = np.flatnonzero(there + len(kinds) >= 0)
            if not len(left):
                continue
            has = np.zeros((len(left), len(kinds) + 1), bool)  # the last place is that of the others, which no code names
            has[np.arange(len(left))[:, None], at[left]] = True
            here = np.minimum(best_sums(np.where(has[:, code], 1, -LACK * new), np.full(len(left), centre), LEAST), has[:, :-1].sum(axis=1))
            has, left = has[fits := there[left] + here >= 0], left[fits]
            if len(left) and not new.all():
                left = left[there[left] + exact_sums(np.where(has[:, code], 1, -LACK), before, centre, LEAST) >= 0]
            ok[x + left] = True
        self.place[kinds] = -1
        return ok


#: Earlier rows of a route and slot that are compared without looking for shared shingles first.
FEW = 16


def alike(rows: list[tuple], whole: bool = False) -> Iterator[tuple[int, int, bytes, bytes]]:
    """The rows of ``AROUND`` of one route and slot -> later, rep, open places of the one, place of the other, as far as ``fitting``
    or, where the rows reach as far as a whole passage, as far as ``Earlier.holding``.

    An own row that lacks at most so many of its different shingles shares one with the other row even when as many as
    the rest, less one, are left out: those are the ones that most rows have, so that a frequent line leads to no pair.
    """
    early: dict[tuple[int | None, bytes], tuple] = {}
    for r in rows:
        if r[3] is None and ((r[4], r[5]) not in early or early[r[4], r[5]][2] > r[2]):
            early[r[4], r[5]] = r
    late = [r for r in rows if r[3] is not None]
    if not late or not early:
        return
    first = list(early.values())
    docs, known = np.array([r[2] for r in first]), Earlier(first) if whole else None
    if not whole or len(first) > FEW:
        texts = [np.unique(np.frombuffer(r[5], "<u2")) for r in first]
        flat, owner = np.concatenate(texts).astype(np.int64), np.repeat(np.arange(len(texts)), [len(t) for t in texts])
        owner, begin = owner[np.argsort(flat, kind="stable")], np.concatenate([[0], np.cumsum(np.bincount(flat, minlength=1 << 16))])
    for _, _, doc, misses, centre, near, places in late:
        own = np.frombuffer(near, "<u2")
        if len(own) < LEAST:
            continue
        if whole and len(first) <= FEW:
            some = np.flatnonzero(docs < doc)
        else:
            kinds, (new, fewest) = np.unique(own), firsts(own)
            # Of different shingles a fifth may be missing from any range.
            spared = max(0, fewest - (fewest // 5 if whole and new.all() else misses) - 1)
            rare = kinds[np.argsort(begin[kinds.astype(np.int64) + 1] - begin[kinds], kind="stable")][: len(kinds) - spared].astype(np.int64)
            some = np.unique(np.concatenate([owner[begin[k] : begin[k + 1]] for k in rare.tolist()]))
            some = some[docs[some] < doc]
        if known:
            some = some[known.holding(own, latest(own), centre, some)]
        else:
            some = np.array([i for i in some.tolist() if fitting(own, new, centre, misses, texts[i])], np.int64)
        for i in some.tolist():
            yield doc, int(docs[i]), places, first[i][6]


def met_again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of ``AROUND`` in the order of routes and slots -> later, rep, open, ends."""
    names = [x.split()[0] for x in AROUND.split(", ")]
    rows = (r for batch in batches for part in pieces(batch) for r in zip(*(part[c].to_pylist() for c in names), strict=True))
    found = (pair for _, group in itertools.groupby(rows, key=lambda r: r[:2]) for pair in alike(list(group), whole=True))
    while some := list(itertools.islice(found, 1 << 12)):
        kinds = (pa.int64(), pa.int64(), pa.binary(), pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in some], k) for i, k in enumerate(kinds)], names=["later", "rep", "open", "ends"])


def opened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """later, rep, places (open windows of the one, ends of the other) -> later, rep, anchors: each open window beside both ends."""
    for batch in batches:
        blobs = []
        for places, ends in zip(batch["open"].to_pylist(), batch["ends"].to_pylist(), strict=True):
            own, other = (unpacked(np.unique(np.frombuffer(b"".join(x), "<i8"))) for x in (places, ends))
            a = np.zeros(max(len(own), len(other)), ANCHOR_KIND)
            a["own"], a["other"] = np.resize(own, len(a)), np.resize(other, len(a))
            blobs.append([a.tobytes()])
        yield pa.RecordBatch.from_arrays([batch["later"], batch["rep"], pa.array(blobs, pa.list_(pa.binary()))], names=["later", "rep", "anchors"])


def further(texts: DataFrame, text: str, crowd: DataFrame, first: DataFrame) -> DataFrame | None:
    """The pairs that ``met`` leaves out and that may still tell something: windows that no passage of the pairs found covers,
    beside earlier documents of their route whose surroundings allow a passage; None without any. crowd: ``crowds``; first: rows of ``JUDGED``."""
    left = first.select(F.col("later").alias("doc"), F.explode("open").alias("o")).select("o.route", "doc", F.col("o.places").alias("open"))
    wanted = left.groupBy("route").agg(F.max("doc").alias("last"))
    rows = crowd.join(spread(wanted), "route").filter("doc <= last").groupBy("route", "doc", "head", "last", F.ceil(F.col("n") / SLOT).cast("int").alias("slots")).agg(F.min("place").alias("low"), F.max("place").alias("high"))
    rows = rows.join(spread(left), ["route", "doc"], "left").filter("open is not null or doc < last")
    each = F.struct("route", "slots", "low", "high", (F.col("doc") < F.col("last")).alias("early"), (F.col("doc") == F.col("head")).alias("head"), "open")
    asked = written(rows.groupBy("doc").agg(F.collect_list(each).alias("wanted")), "asked")
    if asked.isEmpty():
        return None
    some = parted(texts.select("_key", text), asked, "doc")[0].join(spread(asked), F.col("_key") == F.col("doc")).select("_key", text, "wanted")
    around = some.mapInArrow(functools.partial(surroundings, text), AROUND).repartition("route", "slot").sortWithinPartitions("route", "slot")
    pairs = around.mapInArrow(met_again, "later long, rep long, open binary, ends binary")
    pairs = pairs.groupBy("later", "rep").agg(F.collect_set("open").alias("open"), F.collect_set("ends").alias("ends"))
    more = written(pairs.mapInArrow(opened, "later long, rep long, anchors array<binary>"), "further")
    return None if more.isEmpty() else more


def slack(n: int) -> int:
    """How far the other text may have drifted over n shingles at the least similarity."""
    return n + n // 4 + GAP


def raw_texts(column: pa.Array) -> Iterator[bytes]:
    return (t or b"" for t in column.cast(pa.binary()).to_pylist())


def pieces(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """A batch in parts of a few rows, which are small as Python's objects too."""
    for i in range(0, len(batch), 256):
        yield batch.slice(i, 256)


def lists(column: pa.ListArray) -> Iterator[np.ndarray]:
    """Each row's numbers; null has none."""
    at, values = column.offsets.to_pylist(), column.values.to_numpy()
    return (values[x:y] for x, y in itertools.pairwise(at))


def edges_of(gone: np.ndarray) -> np.ndarray:
    """Where runs begin and end, in turn."""
    return np.flatnonzero(np.diff(np.concatenate([[False], gone, [False]]).astype(np.int8)))


def cut_slices(text: str, name: str, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The words of the earlier text that its windows may share with the later one's. anchors: at, ahead, behind."""
    last: tuple[int | None, list[bytes]] = (None, [])
    for batch in itertools.chain.from_iterable(map(pieces, batches)):
        out: list[tuple] = []
        for doc, rep, own_id, anchors, raw in zip(*(batch[c].to_pylist() for c in ("later", "rep", name, "anchors")), raw_texts(batch[text]), strict=True):
            if last[0] != rep:
                last = rep, raw.lower().split()
            a = np.frombuffer(b"".join(anchors), ANCHOR_KIND)
            mine, theirs = packed(a["own"]), packed(a["other"])
            order = np.lexsort((theirs, mine))
            new = np.ones(len(a), bool)  # both sides of a centre tell the same
            new[1:] = (mine[order[1:]] != mine[order[:-1]]) | (theirs[order[1:]] != theirs[order[:-1]])
            a = a[order[new]]
            own, other = (np.stack([a[k]["at"].astype(np.int64), STEP * a[k]["ahead"].astype(np.int64), STEP * a[k]["behind"].astype(np.int64)], axis=1) for k in ("own", "other"))
            lo = max(0, int((other[:, 0] - np.minimum(other[:, 1], slack(own[:, 1]))).min()))
            hi = int((other[:, 0] + np.minimum(other[:, 2], slack(own[:, 2]))).max()) + SHINGLE
            out.append((doc, own_id, lo, b" ".join(last[1][lo:hi]), own.astype("<i4").tobytes()))
        kinds = (pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], names=["later", "rep", "lo", "words", "anchors"])


def spots(other: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Shingles, and all their occurrences in order as one number each."""
    kinds, code = np.unique(other, return_inverse=True)
    width = len(other) + 1
    return kinds, np.sort(code.astype(np.int64) * width + np.arange(len(other))), width


def codes_of(own: np.ndarray, kinds: np.ndarray) -> np.ndarray:
    """For each shingle its number among the kinds, or -1."""
    if not len(kinds):
        return np.full(len(own), -1)
    kind = np.minimum(np.searchsorted(kinds, own), len(kinds) - 1)
    return np.where(kinds[kind] == own, kind, -1)


def nearest(own: np.ndarray, known: tuple[np.ndarray, np.ndarray, int], wanted: np.ndarray | int = 0, code: np.ndarray | None = None) -> np.ndarray:
    """For each shingle its occurrence among ``spots`` nearest to the wanted place, or -1. code: ``codes_of`` the shingles, if known."""
    kinds, places, width = known
    kind = codes_of(own, kinds) if code is None else code
    if not len(kinds):
        return kind
    base = kind * width
    after = np.searchsorted(places, base + np.clip(wanted, 0, width - 1))
    both = np.stack([places[np.minimum(after, len(places) - 1)], places[np.maximum(after - 1, 0)]]) - base
    far = np.where((both >= 0) & (both < width - 1), np.abs(both - wanted), np.iinfo(np.int64).max)
    return np.where(kind >= 0, np.where(far[0] <= far[1], both[0], both[1]), -1)


def ranges(hits: np.ndarray, place: np.ndarray, at: int) -> Iterator[tuple[int, int]]:
    """Ranges (first and last hit) around hit ``at``, of LEAST shingles or more, whose Jaccard similarity is SIMILAR
    or more by the count of hits: the longest without end parts smaller than the gap before them, then as it is,
    then the most similar.

    With h hits in stretches of m and n shingles it is h / (m + n - h), and 9 h - 4 (m + n) >= 0 says 0.8 or more;
    that is a difference of two running numbers, whatever lies between.
    """
    run = 9 * np.arange(len(hits)) - 4 * (hits + place)
    low = np.minimum.accumulate(run[: at + 1])
    last = np.arange(at, len(hits))
    first = np.searchsorted(-low, -(run[last] + 1))
    ok = first <= at
    first, last = first[ok], last[ok]
    width = hits[last] - hits[first] + 1
    if not len(width) or width.max() < LEAST:
        return
    longest = int(np.argmax(width))
    x, y = x0, y0 = int(first[longest]), int(last[longest])
    step = np.diff(hits)
    for k in np.flatnonzero(step[x:at] > GAP) + x:  # end parts before a gap
        if k + 1 - x < step[k] - 1:
            x = int(k) + 1
    for k in np.flatnonzero(step[at:y] > GAP)[::-1] + at:
        if y - k < step[k] - 1:
            y = int(k)
    if hits[y] - hits[x] + 1 >= LEAST:
        yield x, y
    yield x0, y0
    fine = width >= LEAST
    first, last = first[fine], last[fine]
    best = int(np.argmax((last - first + 1) / (hits[last] - hits[first] + place[last] - place[first] + 2)))
    yield int(first[best]), int(last[best])


def passages(own: np.ndarray, other: np.ndarray, lo: int, anchors: np.ndarray, before: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Verified passages (first, last shingle) of the later text. other: the earlier text's shingles from ``lo`` on; before: ``latest``
    of the later text's, if known.

    Around each anchor the ranges above are tried, then stretches of shared shingles over short gaps, then the
    unbroken one; the sets of shingles decide. Where too many shingles are missing round an anchor, nothing is tried.
    """
    known = spots(other)
    out: list[tuple[int, int]] = []
    if not len(known[0]):
        return out
    before, once = latest(own) if before is None else before, len(known[0]) == len(other)
    code = codes_of(own, known[0])
    places = nearest(own, known, code=code)
    shared = np.concatenate([[0], np.cumsum(places >= 0)])
    again = np.concatenate([[0], np.cumsum(before >= 0)])
    run = np.concatenate([[0], np.cumsum(np.where((places < 0) & (before < 0), 5, 0) - 1)])
    for at, ahead, behind in anchors[np.argsort(-anchors[:, 1] - anchors[:, 2], kind="stable")].tolist():  # the widest first
        if any(a <= at <= b for a, b in out):
            continue
        a, b = max(0, at - ahead), min(len(own), at + behind + 1)
        # Where no shingle repeats, LEAST in a row need so many shared ones.
        if shared[b] - shared[a] < SIMILAR * LEAST and (again[b] == again[a] or before[a:b].max() < a):
            continue
        # LEAST or more round the anchor of which a fifth or less are missing: 5 * missing <= e - x is a difference of running numbers.
        end = np.arange(max(at + 1, a + LEAST), b + 1)
        if not (run[end] <= np.maximum.accumulate(run[a : at + 1])[np.minimum(at, end - LEAST) - a]).any():
            continue
        ahead = at - a
        place = places[a:b]
        hits = np.flatnonzero(place >= 0)
        if not len(hits):
            continue

        def similar(x: int, y: int, first: int, last: int) -> bool:
            if once:  # no shingle repeats there
                new = before[a + x : a + y + 1] < a + x
                there = place[x : y + 1]
                both = np.count_nonzero(new & (there >= first) & (there <= last))
                return both >= SIMILAR * (np.count_nonzero(new) + last - first + 1 - both)
            mine, theirs = set(own[a + x : a + y + 1].tolist()), set(other[first : last + 1].tolist())
            return len(mine & theirs) >= SIMILAR * len(mine | theirs)

        done = False
        if place[ahead] >= 0:
            # In line with the anchor, as far as the similarity lets the other text drift.
            drift = int(place[ahead]) - ahead
            spot = place[hits] if once else nearest(own, known, hits + drift, code[a:b][hits])
            fine = (np.abs(spot - hits - drift) <= np.abs(hits - ahead) // 4 + 2 * GAP) & ((spot - place[ahead]) * (hits - ahead) >= 0)
            g, spot = hits[fine], spot[fine]
            for x, y in ranges(g, spot, int(np.searchsorted(g, ahead))):
                if done := similar(int(g[x]), int(g[y]), int(spot[x]), int(spot[y])):
                    out.append((a + int(g[x]), a + int(g[y])))
                    break
        for gap in () if done else (GAP, 1):
            cuts = np.flatnonzero(np.diff(hits) > gap) + 1
            k = int(np.searchsorted(hits, ahead, "right"))  # so many hits up to the anchor
            x = int(cuts[np.searchsorted(cuts, k - 1, "right") - 1]) if len(cuts) and cuts[0] <= k - 1 else 0
            y = int(np.searchsorted(cuts, x, "right"))
            g = hits[x : int(cuts[y]) if y < len(cuts) else len(hits)]
            if not k or not g[0] <= ahead <= g[-1] or g[-1] - g[0] + 1 < LEAST:
                continue
            span = place[g]
            middle = int(np.median(span - g))
            near = span[np.abs(span - g - middle) <= slack(int(g[-1] - g[0]))]
            if len(near) and similar(int(g[0]), int(g[-1]), int(near.min()), int(near.max())):
                out.append((a + int(g[0]), a + int(g[-1])))
                break
    return out


def covered(own: np.ndarray, pairs: list[dict], spans: bytes = b"") -> tuple[np.ndarray, set[int]]:
    """Which words of a text go, and the earlier documents that have them. pairs: rep, lo, words, anchors; spans: runs that go already."""
    gone = np.zeros(len(own) + SHINGLE, bool)
    for a, b in np.frombuffer(spans, "<i4").reshape(-1, 2).tolist():
        gone[a:b] = True
    reps, before = set(), latest(own)
    for p in sorted(pairs, key=lambda p: (-len(p["anchors"]), p["rep"] is None, p["rep"])):  # those that share most first
        anchors = np.frombuffer(p["anchors"], "<i4").reshape(-1, 3)
        if gone[anchors[:, 0]].all():  # an earlier document has been found for these places
            continue
        for a, b in passages(own, shingle_hashes(p["words"].split(), SHINGLE), p["lo"], anchors, before):
            gone[a : b + SHINGLE] = True
            reps.add(p["rep"])
    return gone, reps


CLEANED = "n_words long, n_removed long, n_spans long, copied_from array<long>, kept string"


def cleaned(text: str, columns: list[str], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts, with the runs and documents of ``JUDGED`` and further pairs, as far as they have any -> the columns and those of ``CLEANED``."""
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.string())
    for batch in itertools.chain.from_iterable(map(pieces, batches)):
        rows = []
        for raw, spans, before, pairs in zip(raw_texts(batch[text]), *(batch[c].to_pylist() for c in ("spans", "reps", "pairs")), strict=True):
            edges, reps = np.frombuffer(spans or b"", "<i4"), set(before or [])
            if pairs:
                gone, more = covered(shingle_hashes(raw.lower().split(), SHINGLE), pairs, edges.tobytes())
                edges, reps = edges_of(gone), reps | more
            if not len(edges):
                rows.append((len(raw.split()), 0, 0, [], raw.decode()))
                continue
            begins = [m.start() for m in WORD.finditer(raw)] + [len(raw)]
            cuts = [0, *(begins[e] for e in edges.tolist()), len(raw)]
            kept = b"".join(raw[a:b] for a, b in zip(cuts[::2], cuts[1::2], strict=True))
            rows.append((len(begins) - 1, int((edges[1::2] - edges[::2]).sum()), len(edges) // 2, sorted(reps, key=lambda r: (r is None, r)), kept.decode()))
        yield pa.RecordBatch.from_arrays([*(batch[c] for c in columns), *(pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds))], names=[*columns, *(x.split()[0] for x in CLEANED.split(", "))])


def gathered(found: DataFrame, texts: DataFrame, text: str, doc_id: str) -> DataFrame:
    """Pairs (later, rep, anchors) -> later, pairs: with the words of the earlier texts that matter."""
    kind = "later long, rep long, lo int, words binary, anchors binary"
    sliced = spread(found.filter("later <> rep")).join(texts, F.col("rep") == F.col("_key")).select("later", "rep", "anchors", text, doc_id)
    sliced = sliced.mapInArrow(functools.partial(cut_slices, text, doc_id), kind)
    return sliced.groupBy("later").agg(F.collect_list(F.struct("rep", "lo", "words", "anchors")).alias("pairs"))


def worked(docs: DataFrame) -> DataFrame:
    """The columns of docs as c0, c1, ... and those of ``CLEANED``."""
    texts, columns, text = in_key_order(docs), [f"c{i}" for i in range(len(docs.columns))], place_of(docs, "text")
    doc_id, found = place_of(docs, "doc_id"), written(candidates(texts, text), "pairs")
    crowd = written(crowds(found), "crowds")
    crowded = crowd.groupBy("doc").agg(F.collect_list("route").alias("routes"), F.collect_list("place").alias("places"))
    paired_up = found.select(F.explode(F.array("later", "rep")).alias("doc"))
    # Both uses of the texts read the same columns, so that they share one exchange.
    some = parted(texts.select("_key", text, doc_id), paired_up, "doc")[0]
    both = some.join(spread(gathered(found, some, text, doc_id)), F.col("_key") == F.col("later")).join(spread(crowded), F.col("_key") == F.col("doc"), "left")
    first = written(both.select("_key", text, "routes", "places", "pairs").mapInArrow(functools.partial(judged, text), JUDGED), "judged")
    more = further(texts, text, crowd, first)
    told = first.filter("octet_length(spans) > 0").select("later", "spans", "reps")
    if more is None:
        told = told.withColumn("pairs", F.lit(None).cast("array<struct<rep: long, lo: int, words: binary, anchors: binary>>"))
    else:
        extra = parted(texts.select("_key", text, doc_id), more.select(F.explode(F.array("later", "rep")).alias("doc")), "doc")[0]
        told = told.join(spread(gathered(more, extra, text, doc_id)), "later", "full")
    told = spread(told)
    touched = first.filter("octet_length(spans) > 0").select("later") if more is None else first.filter("octet_length(spans) > 0").select("later").union(more.select("later"))
    held, rest = parted(texts.select("_key", *columns), touched, "later")
    joined = held.join(told, F.col("_key") == F.col("later"), "left").select(*columns, "spans", "reps", "pairs")
    alone = rest.select(*columns, *[F.lit(None).cast(joined.schema[c].dataType).alias(c) for c in ("spans", "reps", "pairs")])
    kinds = T.StructType([*renamed_schema(docs).fields, *T.StructType.fromDDL(CLEANED).fields])
    return joined.union(alone).mapInArrow(functools.partial(cleaned, text, columns), kinds)


def remove_passages(docs: DataFrame) -> DataFrame:
    """One row a document: doc_id, n_words, n_removed, n_spans, copied_from (earlier doc_ids), kept (the text left)."""
    return worked(docs.select("doc_id", "text")).withColumnRenamed("c0", "doc_id").drop("c1")


def passage_digests(docs: DataFrame) -> DataFrame:
    """Digest of ``remove_passages`` with class_id: the smallest doc_id that shared passages reach."""
    found = remove_passages(docs)
    rows = written(found.select("doc_id", "n_words", "n_removed", "n_spans", "copied_from", F.sha2("kept", 256).alias("kept_sha256")), "passages")
    classes = components(rows.select(F.col("doc_id").alias("a"), F.explode("copied_from").alias("b")).filter("a is not null and b is not null"))
    known = rows.join(classes, F.col("doc_id") == F.col("node"), "left")
    return known.select("doc_id", "n_words", "n_removed", "n_spans", "copied_from", F.coalesce("component", "doc_id").alias("class_id"), "kept_sha256")


def drop_passages(docs: DataFrame) -> DataFrame:
    """The documents without their repeated passages, with the same columns; those left without a word go."""
    left = worked(docs).filter("n_words = 0 or n_words > n_removed")
    cut = F.col("n_removed") > 0
    changed = {"text": F.when(cut, F.col("kept")), "n_chars": F.when(cut, F.length("kept").cast("long"))}
    return left.select(*[(F.coalesce(changed[c], f"c{i}") if c in changed else F.col(f"c{i}")).alias(c) for i, c in enumerate(docs.columns)])
