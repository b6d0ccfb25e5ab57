"""Operators 11 to 13 against plain Python, on a small table with odd rows."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from foliant.llm import lines, phrases, search

SCHEMA = "doc_id long, text string, lang string, source string, `te``xt` string, score int"
WORDS = ["Alpha", "beta", "Gamma9", "straße", "the", "of", "and", "Ωmega", "x-y", "ÄÖ", "long word"]
NOTICE = "Alle Rechte vorbehalten; siehe Rückseite für Bedingungen"


def prose(seed: int, n: int) -> str:
    rng = random.Random(seed)
    return "".join(rng.choice(WORDS) + rng.choice([" ", " ", " ", "  ", "\t", ", ", ".\n", "\n"]) for _ in range(n))


def made() -> list[tuple]:
    texts: list = [prose(i % 17, 30 + i) for i in range(60)]
    texts += [None, "", " ", "\n\n", "...", "the the the", prose(99, 20_000)]
    texts += [f"{NOTICE}  \n{prose(i, 9)}\n\t{NOTICE.upper().replace('Ü', 'ü')}\r\nEnd {i}" for i in range(7)]
    texts += ["  kurze Zeile\nkurze Zeile"] * 6 + ["ü" * 39 + "\n" + "ü" * 40] * 5
    rows = [(i, t, [None, "und", "de", "en"][i % 4], "s", "extra", 1) for i, t in enumerate(texts)]
    return [*rows, rows[3], rows[70], (None, texts[71], "de", "s", None, 2), (None, None, None, None, None, None), (5000, texts[2], "de", "s", "x", 0)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(made(), SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def terms(text: str | None) -> list[str]:
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", low)


def brute_ranking(rows: list[tuple], items: dict, most: int = 10) -> list[tuple]:
    found = [(r[0], Counter(terms(r[1]))) for r in rows]
    found = [(d, c) for d, c in found if c]
    n_docs, total = len(found), sum(c.total() for _, c in found)
    df = Counter(t for _, c in found for t in c)
    out = []
    for item, own in items.items():
        scored = []
        for d, c in found:
            m = 10 + 90 * c.total() * n_docs // total
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in own if c[t])
            if s > 0:
                scored.append((-s, d is None, d or 0, d))
        out += [(item, i, x[3], -x[0]) for i, x in enumerate(sorted(scored)[:most], 1)]
    return sorted(out, key=str)


ITEMS = [(1, "the ALPHA of straße"), (2, None), (3, ""), (4, "nowhere"), (5, "Ωmega gamma9 x y"), (5, "the beta"), (None, "and and AND"), (6, NOTICE)]


def test_search(spark, docs, none, monkeypatch):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    wanted = defaultdict(set)
    for k, t in ITEMS:
        wanted[k] |= set(terms(t))
    want = brute_ranking(made(), wanted)
    assert sorted((tuple(r) for r in search.ranked(docs, items).collect()), key=str) == want
    assert {r[0] for r in want} == {1, 5, 6, None}
    monkeypatch.setattr(search, "BLOCK", 1)  # several blocks, matrices cut into small parts, narrow sketches
    monkeypatch.setattr(search, "CELLS", 64)
    monkeypatch.setattr(search, "WIDEST", 64)
    assert sorted((tuple(r) for r in search.ranked(docs, items).collect()), key=str) == want
    assert search.ranked(none, items).count() == 0 and search.ranked(docs, items.limit(0)).count() == 0


def test_bounds_hold():
    rng = random.Random(7)
    texts = [Counter(f"w{rng.randrange(3000)}" for _ in range(rng.choice([3, 50, 900]))) for _ in range(40)]
    texts = [Counter({k.encode(): v * rng.choice([1, 300]) for k, v in c.items()}) for c in texts]
    block = {i: {f"w{rng.randrange(3000)}".encode() for _ in range(rng.choice([1, 30]))} for i in range(20)}
    df = Counter(t for c in texts for t in c)
    q = search.Queries(block, {t: df[t] for own in block.values() for t in own if df[t]}, len(texts), sum(c.total() for c in texts))
    for c in texts:
        soft = q.soft(c.total())
        bounds = q.bounds(np.frombuffer(search.sketch(c), np.uint8)[None], np.array([soft]))[0]
        exact = q.scores(c, soft)
        assert (bounds >= exact).all()
        for own, got in zip(q.terms, exact, strict=True):
            assert int(got) == sum(w * (10**9 * c[t] // (1000 * c[t] + soft)) for t, w in own if c[t])


def brute_lines(rows: list[tuple]) -> list[tuple]:
    def key(line: str) -> str:
        return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line.strip(" \t\n\r\x0b\x0c"))

    held = defaultdict(list)
    for d, t, *_ in rows:
        for k in {key(x) for x in (t or "").split("\n")}:
            held[k].append(-1 if d is None else d)
    out = []
    for d, t, *_ in rows:
        split = (t or "").split("\n")
        gone = [len(key(x)) >= 40 and len(held[key(x)]) >= 5 and max(held[key(x)]) != (-1 if d is None else d) for x in split]
        kept = "\n".join(x for x, g in zip(split, gone, strict=True) if not g)
        out.append((d, len(split), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


def test_lines(spark, docs, none):
    want = brute_lines(made())
    assert sum(r[2] for r in want) > 10
    assert sorted((tuple(r) for r in lines.line_digests(docs).collect()), key=str) == want
    assert sorted((tuple(r) for r in lines.line_digests(docs, shard=1, room=60).collect()), key=str) == want  # several shards and rounds
    assert lines.line_digests(none).count() == 0
    left = lines.drop_lines(docs)
    assert left.columns == docs.columns and left.count() == docs.count()
    assert sorted(hashlib.sha256((r["text"] or "").encode()).hexdigest() for r in left.collect()) == sorted(r[3] for r in want)
    one = spark.createDataFrame([(i, "ä" * 40 + f"\n{i}") for i in range(5)], "doc_id int, text string")  # an int key, null doc_ids last
    assert {r["doc_id"]: r["n_dropped"] for r in lines.line_digests(one).collect()} == {0: 1, 1: 1, 2: 1, 3: 1, 4: 0}


@pytest.mark.parametrize("n", [0, 1, 2, 5000])
def test_perfect_hash(n):
    pairs = np.random.default_rng(n).integers(0, 1 << 63, (n, 2)).astype(np.uint64)
    made_ = lines.PerfectHash.of(pairs)
    assert sorted(made_.index(pairs).tolist()) == list(range(n))
    assert n < 5000 or made_.words.nbytes * 8 < 4.5 * n


def brute_phrases(rows: list[tuple], least: int, shown: int) -> list[tuple]:
    f, n = defaultdict(Counter), Counter()
    for _, t, lang, *_ in rows:
        lang = lang or "und"
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
        for piece in re.split(r"[.,;:!?\n-\r]", low):
            w = re.findall(r"[^ \t]+", piece)
            n[lang] += len(w)
            f[lang].update(tuple(w[i : i + k]) for k in range(1, 6) for i in range(len(w) - k + 1))
    out = []
    for lang, c in f.items():
        many = {p: a for p, a in c.items() if len(p) > 1 and a >= least}
        inside = {(q[i : i + k]): 0 for q in many for k in range(2, len(q)) for i in range(len(q) - k + 1)}
        for q, a in many.items():
            for k in range(2, len(q)):
                for i in range(len(q) - k + 1):
                    inside[q[i : i + k]] = max(inside[q[i : i + k]], a)
        best = []
        for p, a in many.items():
            if inside.get(p, 0) >= a:
                continue
            s, k = min((1000 * a * n[lang] // (c[p[:k]] * c[p[k:]]), k) for k in range(1, len(p)))
            best.append((-s, -a, " ".join(p).encode(), c[p[:k]], c[p[k:]]))
        out += [(lang, i, x[2].decode(), -x[1], x[3], x[4], n[lang], -x[0]) for i, x in enumerate(sorted(best)[:shown], 1)]
    return sorted(out, key=str)


@pytest.mark.parametrize(("least", "room", "lot"), [(5, 1 << 20, 1 << 20), (12, 8, 1 << 20), (5, 64, 300)])
def test_phrases(docs, none, monkeypatch, least, room, lot):
    monkeypatch.setattr(phrases, "LOT", lot)
    got = sorted((tuple(r) for r in phrases.collocations(docs, least, 50, room).collect()), key=str)
    assert got == brute_phrases(made(), least, 50) and len(got) > 10
    assert phrases.collocations(none, least).count() == 0


def test_large_products(spark):
    """Products beyond 64 bits are exact."""
    row = spark.sql("SELECT 4000000000000L AS a, 3000000000000000L AS words, 5000000000000L AS l, 4000000000001L AS r")
    score = row.select(F.expr("cast(a AS decimal(19,0)) * cast(1000 * words AS decimal(19,0)) div (cast(l AS decimal(19,0)) * cast(r AS decimal(19,0)))")).first()[0]
    assert score == 1000 * 4000000000000 * 3000000000000000 // (5000000000000 * 4000000000001)


@pytest.mark.parametrize("room", [4, 50, 10_000])
def test_summaries(room):
    """Merged in any lots, no key with ``least`` occurrences is lost, and none has more than its count."""
    rng, least = np.random.default_rng(room), 40
    keys = np.concatenate([np.repeat(np.arange(9, dtype=np.uint64), 40 + 10 * np.arange(9)), rng.integers(100, 3000, 20_000).astype(np.uint64)])
    rng.shuffle(keys)
    summary = phrases.Summary(least, room)
    for lot in np.array_split(keys, 17):
        summary.merge(*phrases.summed(lot, np.ones(len(lot), np.int64)))
    true = Counter(keys.tolist())
    assert {k for k, n in true.items() if n >= least} <= set(summary.survivors().tolist())
    assert summary.lost < least and all(n <= true[k] <= n + summary.lost for k, n in zip(summary.keys.tolist(), summary.counts.tolist(), strict=True))
