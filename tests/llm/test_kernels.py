"""Kernels against brute force, without Spark."""

import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest

from foliant.llm import bpe, fingerprints, languages, packing, quality, simhash, suffix, toxicity, windows

TEXTS = ["", " ", "a", "aaaa" * 90, "\n\n \n x", "I'LL don't 'S", "ΑΣ ΣΑ naïve Straße ÉÈ", "<|endoftext|>a<|endoftext|> <|startoftext|>b", "日本語 text 😀 ́x", "tab\tcr\r\x1c\x85"]


def noise(seed, n):
    r = random.Random(seed)
    letters = "abcdefgehinorst'  \n\t.,!?<|>0123456789éüßñçøΣς漢字😀́ "
    return ["".join(r.choice(letters) for _ in range(r.randint(0, 120))) for _ in range(n)]


def test_byte_bpe_equals_library():
    path = public_tokenizers.path("byte_bpe_50k.json")
    ours, lib = bpe.loaded(path), bpe.library(path)
    for t in TEXTS + noise(1, 400):
        want = lib.encode(t, add_special_tokens=False).ids
        (ids,) = ours.encode([t.encode()])
        assert ids.tolist() == want, t
        assert ours.decode(ids).decode() == lib.decode(want, skip_special_tokens=False)


def test_word_bpe_equals_library():
    path = public_tokenizers.path("word_bpe_49k.json")
    texts = TEXTS + noise(2, 400)
    for t, ids in zip(texts, bpe.ids_of_texts([t.encode() for t in texts], path), strict=True):
        assert ids.tolist() == bpe.library(path).encode(t, add_special_tokens=False).ids, t


def test_bpe_forgets(monkeypatch):
    """A worker that remembers little, or works on lots of one text, gives the same ids; long words too."""
    texts = [t.encode() for t in [*TEXTS, *noise(3, 60), "wort" * 40 + " wort", "=" * 300, "é" * 100]] * 2
    for name in ("byte_bpe_50k.json", "word_bpe_49k.json"):
        path = public_tokenizers.path(name)
        want = [bpe.library(path).encode(t.decode(), add_special_tokens=False).ids for t in texts]
        for lot, words in ((1 << 20, 10**6), (500, 40), (1, 0)):
            monkeypatch.setattr(bpe, "LOT", lot)
            monkeypatch.setattr(bpe, "REMEMBERED", words)
            ours = bpe.Bpe(path)
            assert [x.tolist() for x in ours.encode(texts)] == want
            assert len(ours.places) <= words or lot == 1


def test_suffix_automaton():
    """Words that end at each position, by suffix links, against plain search."""
    r = random.Random(9)
    words = {"".join(r.choice("abc") for _ in range(r.randint(1, 6))) for _ in range(60)} | set("abc")
    auto = bpe.SuffixAutomaton({w: i for i, w in enumerate(sorted(words))})
    name = sorted(words)
    for _ in range(50):
        text, state, matched = "".join(r.choice("abc") for _ in range(30)), np.array([0]), np.array([0])
        for end in range(1, 31):
            state, matched = auto.step(state, matched, np.array([ord(text[end - 1])]))
            s = int(state[0])
            at, got = int(auto.holder[s if matched[0] == auto.size[s] else auto.link[s]]), []
            while at:
                got.append(name[auto.token[at]])
                at = int(auto.holder[auto.link[at]])
            assert got == sorted((w for w in words if text[:end].endswith(w)), key=len, reverse=True)


def removed(docs, piece, monkeypatch, buckets=3, shared=None):
    monkeypatch.setattr(suffix, "PIECE", piece)
    batches = [pa.RecordBatch.from_arrays([pa.array([d for d, _ in part], pa.int64()), pa.array([0] * len(part), pa.int64()), pa.array([t for _, t in part], pa.binary())], names=["_id", "_part", "_text"]) for part in (docs[:20], docs[20:]) if part]
    rows = [x for b in batches for x in suffix.dealt(buckets, shared)(iter([b]))]
    got = {d: np.zeros(len(t), bool) for d, t in docs}
    in_order = [b.filter(pa.array([v == k for v in b["bucket"].to_pylist()])) for k in range(buckets) for b in rows]
    for b in suffix.matched(iter(in_order)):
        for d, x in zip(b["doc"].to_pylist(), b["runs"].to_pylist(), strict=True):
            for lo, hi in suffix.joined_runs(np.frombuffer(x, "<i8").reshape(-1, 2)):
                got[d][lo:hi] = True
    return got


@pytest.mark.parametrize("piece", [4 << 20, 300, 64])
def test_suffix_dedup(piece, monkeypatch):
    r = random.Random(piece)

    def part(n):
        return bytes(r.choice(b"abcd efg") for _ in range(n))

    for trial in range(4):
        pool = [part(r.randint(40, 160)) for _ in range(5)]
        docs = [(3 * d, b"".join(r.choice(pool)[r.randint(0, 20) :] if r.random() < 0.5 else part(r.randint(0, 120)) for _ in range(r.randint(0, 5)))) for d in range(40)]
        if trial == 0:
            docs = [(d, b"a" * r.randint(0, 120)) for d, _ in docs]
        r.shuffle(docs)
        first = {}
        for d, t in sorted(docs):
            for i in range(len(t) - 49):
                first.setdefault(t[i : i + 50], d)
        some = np.frombuffer(bytes(r.choice((0, 255, 37)) for _ in range(1 << 13)), np.uint8)
        shared = [None, suffix.Shared(np.full(1 << 13, 255, np.uint8)), suffix.Shared(some), suffix.Shared(np.zeros(1 << 13, np.uint8))][trial]
        got = removed(docs, piece, monkeypatch, shared=shared)
        for d, t in docs:
            want = np.zeros(len(t), bool)
            for i in range(len(t) - 49):
                if first[t[i : i + 50]] < d:
                    want[i : i + 50] = True
            assert (want == got[d]).all()


def test_split_slices():
    """Each string of a slice goes in one of its halves, by a key that it holds itself, however far keys reach."""
    r = random.Random(5)
    for full in (True, False):
        shared = suffix.Shared(np.full(1 << 13, 255, np.uint8) if full else np.frombuffer(r.randbytes(1 << 13), np.uint8))
        for n, gram in ((50, 0), (50, 42), (92, 42), (70, 20), (51, 1)):
            s = r.randbytes(n)
            parts = list(shared.split(s, gram))
            strings = sorted(s[i : i + 50] for lo, hi, _ in parts for i in range(lo, hi - 49))
            assert strings == sorted(s[i : i + 50] for i in range(n - 49))
            if full:
                assert all(hi - lo == 50 for lo, hi, _ in parts)


def test_suffix_order():
    text = np.frombuffer(b"abracadabra" * 12, np.uint8)
    order, rank, _ = suffix.suffix_order(text)
    raw = text.tobytes()
    assert [raw[i : i + 50] for i in order] == sorted(raw[i : i + 50] for i in range(len(raw) - 49))
    assert all((rank[i] == rank[j]) == (raw[i : i + 50] == raw[j : j + 50]) for i in range(20) for j in range(20))


def test_longest_previous_factors():
    """Previous smaller places and factors against plain search."""
    r = random.Random(4)
    for n in (0, 1, 5, 200):
        values = np.array([r.randint(0, 20) for _ in range(n)], np.int64)
        want = [max((j for j in range(i) if values[j] < values[i]), default=-1) for i in range(n)]
        assert suffix.previous_smaller(values).tolist() == want
    for letters in (b"ab", b"abcdefgh"):
        raw = bytes(r.choice(letters) for _ in range(300)) + b"x" * 40 + bytes(range(200, 250)) * 3
        text = np.frombuffer(raw + bytes(50), np.uint8)
        order, rank, words = suffix.suffix_order(text)
        doc = np.array([i // 37 % 7 for i in range(len(rank))], np.int64)
        order = order[order < len(raw) - 49]
        got = suffix.longest_previous(order, rank, doc, words)

        def same(i, j):
            return next((k for k in range(50) if raw[i + k] != raw[j + k]), 50)

        for i in range(0, len(raw) - 49, 3):
            assert got[i] == max((same(i, j) for j in range(len(raw) - 49) if doc[j] < doc[i]), default=0), i


def test_compact_windows():
    r = random.Random(5)
    h = np.array([r.getrandbits(60) for _ in range(300)], np.uint64)
    h[50:60] = h[10:20]
    starts = np.array([0, 100, 130, 300])
    want = set()
    v = [(int(x) >> windows.PLACE, i) for i, x in enumerate(h)]
    for a, b in zip(starts, starts[1:], strict=False):
        for c in range(a, b):
            lo = hi = c
            while lo > a and v[lo - 1] > v[c]:
                lo -= 1
            while hi < b - 1 and v[hi + 1] > v[c]:
                hi += 1
            if hi - lo + 1 >= 20:
                want.add((int(lo), int(c), int(hi)))
    assert set(zip(*(x.tolist() for x in windows.tree_windows(h, starts, 20)), strict=True)) == want


def test_packing_uses_all():
    r = np.random.default_rng(1)
    for size, n in ((64, 1), (64, 50), (64, 5000), (2048, 3000)):
        lengths = np.minimum(size, np.maximum(1, r.lognormal(np.log(size / 4), 1, n).astype(int)))
        have = np.bincount(lengths, minlength=size + 1)
        found = packing.layouts(have, size)
        used = np.zeros(size + 1, int)
        for ls, k in found:
            assert sum(ls) <= size and k > 0
            for x in ls:
                used[x] += k
        assert (used == have).all()
        assert sum(k for _, k in found) <= -(-lengths.sum() // size) * 1.05 + 1
    assert packing.layouts(np.zeros(65, np.int64), 64) == []


def test_simhash_ring():
    r = random.Random(2)
    x = np.array([0] + [sum(1 << b for b in r.sample(range(64), k)) for k in (1, 2, 3, 4, 5) for _ in range(200)], np.uint64)
    assert (simhash.within_chain(x) == (np.bitwise_count(x) <= 3)).all()
    assert simhash.fingerprint(b"") == simhash.fingerprint(b" \n") == 0
    assert simhash.fingerprint(b"A B") == simhash.fingerprint(b"a\tb")


def test_fingerprints():
    a, b = " ".join(f"wort{i}" for i in range(300)).encode(), " ".join(f"andere{i}" for i in range(300)).encode()
    half = a[: len(a) // 2] + b[: len(b) // 2]
    fa, fb, fh = map(fingerprints.fingerprint, (a, b, half))
    assert fingerprints.likeness(fa, fa) == 1 > fingerprints.likeness(fa, fh) > fingerprints.likeness(fa, fb)
    assert not fingerprints.fingerprint(b"").any()


def test_interactions():
    """A machine learns that two words are toxic together only."""
    r = random.Random(1)
    texts, label = [], []
    for _ in range(1500):
        w = [f"w{chr(97 + r.randrange(20))}" for _ in range(4)]
        a, b = r.random() < 0.5, r.random() < 0.5
        texts.append(" ".join(w + ["gruppe"] * a + ["dumm"] * b))
        label.append(float(a and b))
    rows = [toxicity.terms(t) for t in texts]
    chosen = np.unique(np.concatenate(rows)).astype(np.int64)
    model = toxicity.fitted([np.searchsorted(chosen, x) for x in rows], np.array(label), chosen)
    s = model.scores(["wa gruppe dumm", "wa gruppe", "wa dumm", "wa", ""])
    assert s[0] > 0.5 > max(s[1:])


def test_trees():
    r = np.random.default_rng(0)
    x = r.normal(size=(2000, 5))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.5)).astype(float)
    model = quality.grown(x[:1500], y[:1500])
    assert ((model.scores(x[1500:]) > 0.5) == y[1500:]).mean() > 0.95
    assert quality.grown(np.zeros((0, 5)), np.zeros(0)).scores(x[:3]).max() < 0.01
    assert len(quality.statistics(b"")) == quality.FEATURES


def test_filters():
    de, en = (np.unique(languages.grams(t)) for t in ("der schnelle braune fuchs springt über den faulen hund", "the quick brown fox jumps over the lazy dog"))
    f = languages.Filters.of(["de", "en"], {"de": de, "en": en})
    assert f.predict("Der faule Hund!")[0] == "de" and f.predict("the lazy dog 123")[0] == "en"
    for t in (None, "", " ", "123 !?"):
        assert f.predict(t) == ("und", 0.0)
    many = languages.Filters.of([f"l{i}" for i in range(70)], {"l69": de})
    assert many.predict("der faule hund")[0] == "l69"
    assert languages.Filters.of([], {}).predict("abc") == ("und", 0.0)


def test_window_blobs():
    rows = np.zeros(500, windows.WINDOW_KIND)
    r = np.random.default_rng(1)
    for k, top in (("route", 2**63), ("doc", 2**60), ("at", 2**31 - 1), ("ahead", 2**16 - 1), ("behind", 2**16 - 1)):
        rows[k] = r.integers(0, top, 500)
    for part in (rows, rows[:0], rows[:1]):
        assert (windows.of_blob(windows.as_blob(part)) == part).all()


def brute_passages(own, other):
    """All stretches (first, last) of LEAST shingles or more with a Jaccard similarity of 0.8, shared shingles at both ends."""
    where = {s: i for i, s in enumerate(other)}
    shared = [i for i, s in enumerate(own) if s in where]
    out = []
    for x in shared:
        for y in shared:
            if y - x + 1 >= windows.LEAST:
                mine, theirs = set(own[x : y + 1]), set(other[where[own[x]] : where[own[y]] + 1])
                if len(theirs & mine) >= 0.8 * len(theirs | mine):
                    out.append((x, y))
    return out


@pytest.mark.parametrize("kind", ["inserted", "replaced", "left out"])
def test_passages_with_one_edit(kind):
    """A run of 1 to 12 changed words in the middle of 50 to 100: what brute force finds, any shared shingle as anchor finds."""
    r, found = random.Random(kind), 0
    for words in (50, 80, 90, 100):
        for run in (1, 6, 7, 8, 10, 12):
            base = [b"w%d" % i for i in range(words)]
            half, fresh = words // 2, [b"n%d" % i for i in range(run)]
            changed = base[:half] + ([] if kind == "left out" else fresh) + base[half + (0 if kind == "inserted" else run) :]
            before, behind = ([b"%s%d" % (c, r.getrandbits(40)) for _ in range(30)] for c in (b"x", b"y"))
            later = windows.shingle_hashes(before + changed + behind, windows.SHINGLE)
            earlier = windows.shingle_hashes(base + behind[::-1], windows.SHINGLE)
            want = brute_passages(later.tolist(), earlier.tolist())
            for at in np.flatnonzero(np.isin(later, earlier)).tolist()[::9]:
                got = windows.passages(later, earlier, 0, np.array([[at, at, len(later) - 1 - at]]))
                assert bool(got) == any(x <= at <= y for x, y in want), (words, run, at)
                assert all(30 <= a and b + windows.SHINGLE <= 30 + len(changed) for a, b in got)
            found += bool(want)
    assert found >= 9


def test_nearest_occurrence():
    r = np.random.default_rng(5)
    for n in (0, 1, 40):
        other, own, wanted = r.integers(0, 12, n).astype(np.uint64), r.integers(0, 15, 60).astype(np.uint64), r.integers(-5, 50, 60)
        got = windows.nearest(own, windows.spots(other), wanted)
        for h, w, i in zip(own, wanted, got, strict=True):
            at = np.flatnonzero(other == h)
            assert (i == -1) if not len(at) else (other[i] == h and abs(i - w) == np.abs(at - w).min())


def test_frequent_lines_pair_no_windows():
    """Windows round one line of 5 to 43 shingles: pairs are those whose surroundings allow a passage, by brute force; a line alone leads to none."""
    r = np.random.default_rng(3)

    def around(line):
        return np.concatenate([r.integers(0, 1 << 16, 45 - len(line) // 2), line, r.integers(0, 1 << 16, 45)]).astype("<u2")

    found = 0
    for _ in range(300):
        line = r.integers(0, 1 << 16, int(r.integers(5, 44)))
        own, others = around(line)[:91], [around(line) for _ in range(4)]
        rows = [(1, 0, 5 + i, None, None, o.tobytes(), b"") for i, o in enumerate(others)] + [(1, 0, 9, 18, 45, own.tobytes(), b"")]
        want = [5 + i for i, o in enumerate(others) if any(len(np.setdiff1d(own[x : x + windows.LEAST], o)) <= 18 for x in range(46))]
        assert sorted(rep for _, rep, _, _ in windows.alike(rows)) == want
        found += len(want)
    assert found > 200
    line = r.integers(0, 1 << 16, 12)
    rows = [(1, 0, d, m, c, around(line)[: None if m is None else 91].tobytes(), b"") for d in range(500) for m, c in ((None, None), (18, 45))]
    assert not list(windows.alike(rows))


def test_surroundings_count_on_both_sides():
    """Texts with replaced shingles round one centre: those with a passage of 0.8 there meet; of near copies with an edit every 20 words none do."""
    r = np.random.default_rng(8)
    n, centre, met = 2 * windows.NEAR + 1, windows.NEAR, 0
    for _ in range(200):
        own = r.integers(0, 1 << 16, n)
        other = own.copy()
        if r.random() < 0.3:  # a line that comes again
            own[10:30] = own[60:80]
        for at in r.integers(0, n - 5, int(r.integers(0, 12))).tolist():
            other[at : at + 5] = r.integers(0, 1 << 16, 5)
        other[centre] = own[centre]
        rows = [(1, 0, 5, None, centre, other.astype("<u2").tobytes(), b""), (1, 0, 9, len(set(own.tolist())) // 5, centre, own.astype("<u2").tobytes(), b"")]
        got = bool(list(windows.alike(rows, whole=True)))
        must = False
        for x in range(0, centre + 1, 3):
            for y in range(max(centre, x + windows.LEAST - 1), n, 3):
                mine, theirs = set(own[x : y + 1].tolist()), set(other[x : y + 1].tolist())
                must |= len(mine & theirs) >= 0.8 * len(mine | theirs)
        assert got or not must
        met += must
    assert met > 30
    base = r.integers(0, 1 << 16, n)
    rows = []
    for doc in range(300):
        copy = base.copy()
        for at in range(doc % 12, n - 5, 20):
            copy[at : at + 5] = r.integers(0, 1 << 16, 5)
        copy[centre] = base[centre]
        rows += [(1, 0, doc, m, centre, copy.astype("<u2").tobytes(), b"") for m in (None, n // 5)]
    assert not list(windows.alike(rows, whole=True))
