"""Operators on small tables: nulls, empty and long texts, ties, repeated rows, empty tables, clashing columns."""

import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from foliant.llm import bpe, entries, exact, fingerprints, graph, languages, packing, quality, simhash, suffix, toxicity, windows

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept string, bucket int, fp string, rep long, score double"
WORD, BYTE = (public_tokenizers.path(f) for f in ("word_bpe_49k.json", "byte_bpe_50k.json"))
LANGS = {"de": "der die und das ist nicht ein haus baum fluss straße", "en": "the and of to was not house tree river street"}
R = random.Random(7)


def prose(lang, n):
    return " ".join(R.choice(LANGS[lang].split()) + R.choice("abcdefghij") * R.randint(0, 2) for _ in range(n))


PASSAGE = " ".join(f"satz{R.randint(0, 10**6)}" for _ in range(70))
NEAR = PASSAGE.replace(PASSAGE.split()[30], "anders")
LONG = prose("de", 30_000)


def made():
    texts = {
        0: prose("en", 80), 1: None, 2: "", 3: " \n\t ", 4: "123 !!", 5: "a", 6: "ab cd", 7: f"{prose('de', 40)} {PASSAGE} {prose('de', 40)}",
        8: f"{prose('en', 60)} {PASSAGE} {prose('en', 20)}", 9: f"{NEAR} {prose('de', 30)}", 10: LONG, 11: LONG, 12: LONG + " ende",
    }
    out = [(i, t) for i, t in texts.items()] + [(13, texts[0]), (14, texts[0].replace(" ", "  ")), (14, texts[0].replace(" ", "  "))]
    out += [(20 + i, prose("de" if i % 2 else "en", R.randint(5, 60)) + (" idiot" if i % 5 == 0 else "")) for i in range(150)]
    return out


ROWS = made()


def rows():
    return ROWS


@pytest.fixture(scope="module")
def docs(spark):
    made = [(i, t, "de" if i % 2 else "en", None if i % 3 else "s", len(t or ""), "k", 1, "f", 2, 0.5) for i, t in rows()]
    return spark.createDataFrame(made, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def labels(spark):
    got = [(i, None if i == 20 else int(i % 2), int("idiot" in (t or ""))) for i, t in dict(rows()).items()]
    return spark.createDataFrame([*got, (999, 1, 1), (None, 1, 1)], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def test_exact(docs, none):
    for digest in (lambda c: F.xxhash64(c), lambda c: F.pmod(F.length(c), F.lit(3)).cast("long")):
        got = {r["doc_id"]: r for r in exact.exact_groups(docs, digest).collect()}
        texts = {i: re.sub("[ \t-\r]+", " ", t or "") for i, t in rows()}
        for i, r in got.items():
            same = [j for j, t in rows() if re.sub("[ \t-\r]+", " ", t or "") == texts[i]]
            assert (r["keep_id"], r["group_size"]) == (min(same), len(same)) and (r["kept"] == (i == min(same)) or i == 14)
            assert r["text_sha256"] == hashlib.sha256(texts[i].encode()).hexdigest()
    assert exact.exact_groups(none).count() == 0
    assert exact.drop_copies(docs).columns == docs.columns


def test_chunks_join_to_text(docs):
    assert docs.filter(F.array_join(exact.chunks(exact.normalised()), "") != exact.normalised()).count() == 0


def test_bpe(docs, none):
    lib = bpe.library(BYTE)
    texts = dict(rows())
    for r in bpe.encoding_digests(docs, BYTE).collect():
        ids = lib.encode(texts[r["doc_id"]] or "", add_special_tokens=False).ids
        assert (r["n_tokens"], r["ids_sha256"]) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
        assert r["decoded_sha256"] == hashlib.sha256(lib.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    assert bpe.encoding_digests(none, BYTE).count() == 0


def test_fingerprint_bits(docs):
    """Bits of operator 10, and of operator 2's texts, counted one by one."""
    texts = dict(rows())
    for r in simhash.near_duplicates(docs).collect():
        words = re.findall(r"[^ \t-\r]+", re.sub("[A-Z]", lambda m: m[0].lower(), texts[r["doc_id"]] or ""))
        parts = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
        h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in parts]
        assert int(r["fingerprint"], 16) == sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)), r["doc_id"]
    for text in ["", "a", "a b a b a", texts[0], texts[7]]:
        words = text.lower().encode().split()
        h = [int(x) for x in fingerprints.word_hashes(words)]
        pairs = [(int(fingerprints.mixed(np.array([a], np.uint64), 1)[0]) + b) % 2**64 for a, b in zip(h, h[1:], strict=False)]
        votes = [0.0] * 256
        for kind, weight in ((h, 0.3), (pairs, 1.0)):
            for term in set(kind):
                for lane in range(4):
                    bits = int(fingerprints.mixed(np.array([term], np.uint64), 50 + lane)[0])
                    for b in range(64):
                        votes[64 * lane + b] += weight * (1 + np.log2(kind.count(term))) * (1 if bits >> b & 1 else -1)
        got = fingerprints.fingerprint(text.encode())
        assert all(abs(v) < 1e-3 or (int(got[i // 64]) >> i % 64 & 1) == (v > 0) for i, v in enumerate(votes))


def components(prints, radius=3):
    parent = {d: d for d, _ in prints}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, x in prints:
        for b, y in prints:
            if (x ^ y).bit_count() <= radius:
                u, v = top(a), top(b)
                parent[max(u, v)] = min(u, v)
    return {d: top(d) for d, _ in prints}


@pytest.mark.parametrize("block", [1024, 3])
def test_simhash_components(spark, block):
    r = random.Random(block)
    prints = [(0, 0), (1, 0), (2, -1)]
    for _ in range(12):
        x = r.getrandbits(63)
        for _ in range(20):
            for _ in range(r.randint(0, 3)):
                x ^= 1 << r.randrange(63)
            prints.append((len(prints), x))
    df = spark.createDataFrame([(d, 0, x) for d, x in prints], "_id long, _part long, fp long")
    rows = simhash.near_classes(df, block=block).collect()
    assert {x["_id"]: x["component_id"] for x in rows} == components([(d, x % 2**64) for d, x in prints])
    assert all(x["kept"] == (x["_id"] == x["component_id"]) for x in rows)


def signed(x):
    return x - 2**64 if x >= 2**63 else x


def test_finer_keys(spark):
    """Two near fingerprints that share a ring key share a finer key; all finer keys together tell fingerprints apart."""
    r = random.Random(11)
    pairs = [(x := r.getrandbits(64), x ^ sum(1 << b for b in r.sample(range(64), r.randint(1, 3)))) for _ in range(1500)]
    df = spark.createDataFrame([(signed(x), signed(y)) for x, y in pairs], "x long, y long")
    keys = F.arrays_zip(simhash.ring_keys(F.col("x")).alias("a"), simhash.ring_keys(F.col("y")).alias("b"))
    met = df.withColumn("k", F.explode(keys)).filter("k.a = k.b").select("x", "y", F.col("k.a").alias("key"))
    met = met.withColumns({c: simhash.finer_keys(F.col(c), F.col("key")) for c in ("x", "y")}).withColumn("same", F.arrays_overlap("x", "y"))
    assert met.count() > 1500 and met.filter("not same or x = y or size(x) <> 20").isEmpty()


@pytest.mark.parametrize("low", [0, 16, 32])
def test_simhash_hot_key(spark, low):
    """A key of 150 fingerprints, over 20 blocks of 3: finer keys decide, and nothing is lost."""
    r = random.Random(low)
    base, seeds = r.getrandbits(64), [r.getrandbits(32) for _ in range(30)]
    found = {base ^ ((r.choice(seeds) ^ sum(1 << b for b in r.sample(range(32), r.randint(0, 3)))) << low) for _ in range(150)}
    prints = list(enumerate(sorted(found)))
    df = spark.createDataFrame([(d, 0, signed(x)) for d, x in prints], "_id long, _part long, fp long")
    rows = simhash.near_classes(df, block=3).collect()
    assert {x["_id"]: x["component_id"] for x in rows} == components(prints)


def test_large_groups_go_by_blocks():
    r = random.Random(3)
    values = np.array([r.getrandbits(4) << 3 * (i % 7) for i in range(90)], np.uint64)
    groups = np.repeat([0, 1, 2], [5, 80, 5])
    whole, parts = simhash.forest(values, groups, simhash.within_chain), list(simhash.tiled(values, groups, simhash.within_chain, 8))
    hung = components_of_edges(90, [(a, b) for x, y in parts for a, b in zip(x.tolist(), y.tolist(), strict=True)])
    assert hung == components_of_edges(90, list(zip(*(x.tolist() for x in whole), strict=True)))


def components_of_edges(n, edges):
    label = list(range(n))
    while True:
        new = label[:]
        for a, b in edges:
            new[a] = new[b] = min(new[a], new[b])
        if new == label:
            return label
        label = new


def test_simhash(docs, none):
    got = {r["doc_id"]: r for r in simhash.near_duplicates(docs).collect()}
    assert got[1]["fingerprint"] == got[2]["fingerprint"] == got[3]["fingerprint"] == "0" * 16
    assert got[1]["component_id"] == got[3]["component_id"] == 1 and got[12]["component_id"] == got[11]["component_id"] == 10
    assert got[13]["component_id"] == 0
    assert simhash.near_duplicates(none).count() == 0
    assert simhash.drop_near(docs).columns == docs.columns


KEYS = [(5, "gleich"), (5, "anders"), (None, "gleich"), (7, "zwei"), (7, "zwei"), (None, "null"), (None, "null"), (9, None), (8, ""), (3, "gleich")]


@pytest.fixture(scope="module")
def keys(spark):
    """Null and repeated doc_ids: texts long enough for all operators."""
    r = random.Random(2)
    long = {k: " ".join(f"{k}{r.getrandbits(30)}" for _ in range(60)) for k in ("gleich", "anders", "zwei", "null")}
    return spark.createDataFrame([(d, long.get(t, t), i) for i, (d, t) in enumerate(KEYS)], "doc_id long, text string, _part int").repartition(3).cache()


def test_rows_are_decided_apart(keys):
    """Of equal texts exactly one row stays, whatever the ids; texts of one doc_id don't fall together."""
    for drop in (exact.drop_copies, simhash.drop_near, windows.drop_passages):
        left = drop(keys)
        assert left.columns == keys.columns
        got = sorted((str(r["doc_id"]), (r["text"] or "")[:4]) for r in left.collect())
        want = [("3", "glei"), ("5", "ande"), ("7", "zwei"), ("None", "null")]
        assert [x for x in got if x[1]] == want, drop
        assert sum(not x[1] for x in got) == (2 if drop is windows.drop_passages else 1)
    rows = exact.exact_groups(keys).collect()
    assert sum(r["kept"] for r in rows) == 5 and all(r["kept"] is not None for r in rows)
    assert {r["keep_id"] for r in rows if r["group_size"] == 3} == {3}
    assert simhash.near_duplicates(keys).filter("component_id is null").count() == 2


def test_suffix_rows(keys):
    got = sorted((str(r["doc_id"]), r["n_removed"] > 0, r["n_bytes"] == r["n_removed"]) for r in suffix.removal_digests(keys).filter("n_bytes > 0").collect())
    assert got == [("3", False, False), ("5", False, False), ("5", True, True), ("7", False, False), ("7", False, False), ("None", False, False), ("None", False, False), ("None", False, False)]


def test_passage_rows(keys):
    got = sorted((str(r["doc_id"]), r["n_removed"]) for r in windows.passage_digests(keys).filter("n_words > 0").collect())
    assert got == [("3", 0), ("5", 0), ("5", 60), ("7", 0), ("7", 60), ("None", 0), ("None", 60), ("None", 60)]


def test_scores_of_all_rows(keys, labels):
    assert toxicity.toxicity(keys, labels).count() == quality.quality(keys, labels).count() == languages.languages(keys.withColumn("lang", F.lit("de"))).count() == len(KEYS)
    assert bpe.encoding_digests(keys, BYTE).count() == len(KEYS) == fingerprints.fingerprint_report(keys).count()
    assert packing.packed_documents(keys, WORD).count() == len(KEYS)
    toxic = keys.withColumn("text", F.when(F.col("doc_id").isNull(), F.lit("idiot")).otherwise(F.col("text")))
    one = labels.filter("toxic = 1").limit(1)
    assert toxicity.drop_toxic(toxic, one.union(labels.filter("toxic = 0").limit(1))).columns == keys.columns


def test_graph(spark):
    edges = [(1, 2), (2, 3), (9, 8), (5, 5), (3, 1), (20, 7), (7, 8)]
    got = {r["node"]: r["component"] for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 9: 7, 8: 7, 7: 7, 20: 7}
    chain = [(i, i + 1) for i in range(100)]
    assert {r["component"] for r in graph.components(spark.createDataFrame(chain, "a long, b long")).collect()} == {0}
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_suffix(docs, none):
    got = {r["doc_id"]: r for r in suffix.removal_digests(docs).collect()}
    empty = hashlib.sha256(b"").hexdigest()
    assert (got[1]["n_bytes"], got[1]["kept_sha256"]) == (0, empty) and got[0]["n_removed"] == 0
    assert got[11]["kept_sha256"] == empty and got[11]["n_spans"] == 1 and got[10]["n_removed"] == 0
    assert got[8]["n_removed"] >= len(PASSAGE) and got[13]["kept_sha256"] == empty
    assert suffix.removal_digests(none).count() == 0


def test_shared_keys(spark, monkeypatch):
    """A gram that many distinct slices share is found and split, copies don't make one, and the rows stay the same."""
    r = random.Random(11)
    noise = ["".join(r.choice("abcdefghijklmnop") for _ in range(100)) for _ in range(240)]
    grams = [f"{i:04}WXYZ".encode() for i in range(4000)]  # the one with the least hash is the minimizer wherever it stands
    gram = min(grams, key=lambda g: int(suffix.mixed(np.frombuffer(g, "<u8"), 0)[0])).decode()
    texts = [x[:50] + gram + x[50:] for x in noise[:120]] + [noise[0][30:50] + gram + noise[i][50:80] + noise[1] for i in range(120)] + [noise[200]] * 90
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    rows = docs.select(F.col("doc_id").alias("_id"), F.lit(0).cast("long").alias("_part"), F.col("text").cast("binary").alias("_text"))
    shared = suffix.shared_keys(rows, 10**5, 1)
    monkeypatch.setattr(suffix, "shared_keys", lambda texts, raw: shared)
    hot = suffix.mixed(np.frombuffer(gram.encode(), "<u8"), 0)
    assert shared.holds(hot)[0] and 1 <= int(np.unpackbits(shared.bits).sum()) <= 12
    got = {d["doc_id"]: d["n_removed"] for d in suffix.removal_digests(docs).collect()}
    first = {}
    for d, t in enumerate(texts):
        for i in range(len(t) - 49):
            first.setdefault(t[i : i + 50], d)
    for d, t in enumerate(texts):
        gone = {j for i in range(len(t) - 49) if first[t[i : i + 50]] < d for j in range(i, i + 50)}
        assert got[d] == len(gone), d


def test_passages(docs, none):
    got = {r["doc_id"]: r for r in windows.remove_passages(docs).collect()}
    assert got[7]["n_removed"] == 0 and got[8]["n_removed"] >= 70 and got[8]["copied_from"] == [7]
    assert PASSAGE[:50] not in got[8]["kept"] and got[9]["n_removed"] >= 65
    assert got[11]["n_removed"] == got[11]["n_words"] and got[12]["n_words"] - got[12]["n_removed"] <= 1 and got[10]["n_removed"] == 0
    assert (got[1]["kept"], got[1]["n_words"]) == ("", 0)
    assert all(got[i]["n_removed"] == 0 and got[i]["kept"] == t for i, t in rows() if i >= 20)
    assert windows.remove_passages(none).count() == windows.passage_digests(none).count() == 0
    classes = {r["doc_id"]: r["class_id"] for r in windows.passage_digests(docs).collect()}
    assert classes[9] == classes[8] == classes[7] == 7 and classes[12] == 10 and classes[1] == 1
    left = windows.drop_passages(docs)
    assert left.columns == docs.columns and left.filter("doc_id = 11").count() == 0 and left.filter("doc_id = 1").first()["text"] is None
    assert left.filter("doc_id = 8").select((F.length("text") == F.col("n_chars")).alias("ok")).first()["ok"]


def brute_found(passage, copy):
    a, b = ({tuple(p[i : i + 5]) for i in range(len(p) - 4)} for p in (passage, copy))
    return len(a & b) >= 0.8 * len(a | b)


def test_passage_recall(spark):
    """Near copies, full copies behind a partial quote, and passages around a frequent line: what brute force calls similar goes."""
    r, made, want = random.Random(11), [], {}

    def words(n):
        return [f"w{r.getrandbits(40)}" for _ in range(n)]

    def add(p, goes=False):
        if goes:
            want[len(made)] = p
        made.append((len(made), " ".join(words(r.randint(10, 60)) + p + words(r.randint(10, 60)))))

    line = words(10)
    for i in range(200):
        p = words(60)
        add(p[: 20 + i % 26])
        add(p)
        add(p, True)
        p = words(60 + i % 50)
        copy = p[:]
        for _ in range(1 + i % 2):
            copy[r.randrange(len(copy))] = words(1)[0]
        add(p)
        add(copy, brute_found(p, copy))
        p = words(25) + line + words(25)
        add(line)
        add(p)
        add(p, True)
    got = {x["doc_id"]: x for x in windows.remove_passages(spark.createDataFrame(made, "doc_id long, text string").repartition(5)).collect()}
    caught = [sum(w not in got[d]["kept"].split() for w in p) >= 0.8 * len(p) for d, p in want.items()]
    assert len(caught) > 500 and sum(caught) >= 0.98 * len(caught)
    full = [d + 1 for d in want if d + 1 < len(made)]
    assert not any(got[d]["n_removed"] for d in range(len(made)) if d not in want and d not in full and len(made[d][1].split()) < 100)


def test_passages_behind_others(spark):
    """Twelve texts share a line of 34 words, the fifth and the tenth also what stands around it: the tenth loses the passage."""
    made = []
    for seed in (0, 5, 10):
        r = random.Random(seed)

        def words(n, r=r):
            return ["".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(7)) for _ in range(n)]

        line, head, tail = words(34), words(9), words(9)
        for i in range(12):
            before, after = (head, tail) if i in (4, 9) else (None, None)
            made.append((100 * seed + i, " ".join(words(40) + (before or words(9)) + line + (after or words(9)) + words(40))))
    got = {x["doc_id"]: x for x in windows.remove_passages(spark.createDataFrame(made, "doc_id long, text string").coalesce(1)).collect()}
    assert {d for d, x in got.items() if x["n_removed"]} == {9, 509, 1009}
    assert all(got[d]["copied_from"] == [d - 5] and got[d]["n_removed"] >= 50 for d in (9, 509, 1009))


def test_very_long_passages(spark):
    """Texts of 150,000 words, the copy with an edit every 400 words: the copy goes."""
    r = random.Random(5)
    base = [f"w{r.getrandbits(40)}" for _ in range(150_000)]
    copy = [f"e{i}" if i % 400 == 200 else w for i, w in enumerate(base)]
    got = {x["doc_id"]: x for x in windows.remove_passages(spark.createDataFrame([(1, " ".join(base)), (2, " ".join(copy))], "doc_id long, text string")).collect()}
    assert got[1]["n_removed"] == 0 and got[2]["n_removed"] > 149_000


def test_fingerprint_order(docs, none, spark):
    got = {r["doc_id"]: r for r in fingerprints.fingerprint_report(docs).collect()}
    unique = dict(rows())
    ids = sorted(unique, reverse=True)
    for i, after in zip(ids, ids[1:] + ids[:1], strict=True):
        if i == 14 or after == 14:
            continue
        a, b = unique[i] or "", unique[after] or ""
        h = len(a) // 2
        assert got[i]["edited_sha256"] == hashlib.sha256((a[: len(a) - h] + b[:h]).encode()).hexdigest(), i
        assert got[i]["n_chars"] == len(a)
    assert fingerprints.fingerprint_report(docs).count() == docs.count()
    assert got[10]["fingerprint"] == got[11]["fingerprint"] and got[11]["near_next"] == 1 >= got[12]["near_next"] > 0.9
    assert got[11]["near_class"] == got[12]["near_class"] == 10 and got[0]["near_class"] == 0
    assert fingerprints.fingerprint_report(none).count() == 0
    single = spark.createDataFrame([(5, "abcd")], "doc_id long, text string")
    assert fingerprints.edited_likeness(single).first()["edited_sha256"] == hashlib.sha256(b"abab").hexdigest()
    odd = spark.createDataFrame([(None, "x"), (None, None), (3, "yy")], "doc_id long, text string")
    assert fingerprints.fingerprint_report(odd).count() == 3


def test_block_tables(spark):
    r, prints = random.Random(3), []
    for _ in range(8):
        x = r.getrandbits(256)
        for _ in range(15):
            for _ in range(r.randint(0, 3)):
                x ^= 1 << r.randrange(256)
            prints.append((len(prints), x))
    df = spark.createDataFrame([(d, bytearray(x.to_bytes(32, "little"))) for d, x in prints], "doc_id long, fp binary")
    got = {x["doc_id"]: x["component_id"] for x in fingerprints.near_classes(df).collect()}
    assert got == components(prints)


def test_radius(spark):
    """Pairs 0 to 9 bits apart, spread over the blocks: those up to 7 bits apart share a class; copies and null ids too."""
    r, prints, want = random.Random(4), [], {}
    for apart in range(10):
        for _ in range(6):
            x = r.getrandbits(256)
            first = len(prints)
            bits = r.sample(range(0, 256, 29), apart) if apart < 9 else r.sample(range(256), apart)
            prints += [(first, x), (first + 1, x ^ sum(1 << b for b in bits)), (first + 2, x)]
            want |= {first: first, first + 1: first if apart <= 7 else first + 1, first + 2: first}
    rows = [(d, bytearray(x.to_bytes(32, "little"))) for d, x in [*prints, (None, 7)]]
    got = {x["doc_id"]: x["component_id"] for x in fingerprints.near_classes(spark.createDataFrame(rows, "doc_id long, fp binary")).collect()}
    assert got == want | {None: None}


@pytest.mark.parametrize("at", [0, 3, 7])
def test_finer_tables(spark, at):
    """A block that 120 fingerprints share, over 8 blocks of 3: the second tables decide, and nothing is lost."""
    r = random.Random(at)
    shared, seeds = r.getrandbits(32), [r.getrandbits(224) for _ in range(25)]
    low = (1 << 32 * at) - 1

    def near(x):
        x ^= sum(1 << b for b in r.sample(range(224), r.randint(0, 7)))
        return (x & low) | shared << 32 * at | (x & ~low) << 32

    prints = list(enumerate(sorted({near(r.choice(seeds)) for _ in range(120)})))
    df = spark.createDataFrame([(d, bytearray(x.to_bytes(32, "little"))) for d, x in prints], "doc_id long, fp binary")
    got = {x["doc_id"]: x["component_id"] for x in fingerprints.near_classes(df, block=3).collect()}
    assert got == components(prints, fingerprints.RADIUS)
    tables = df.select(F.size(fingerprints.finer_tables(F.col("fp"), fingerprints.block_tables(F.col("fp"))[at])).alias("n"))
    assert {x["n"] for x in tables.collect()} == {8}


def test_fingerprint_query(spark, docs, tmp_path):
    """The registered query runs the search."""
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r["near_class"] for r in entries.QUERIES["op2_fingerprints"](spark, str(tmp_path)).collect()}
    assert got[12] == got[11] == 10 and got[13] == 0


def test_packing(docs, none):
    lib, texts = bpe.library(WORD), dict(rows())
    got = packing.packed_documents(docs, WORD).collect()
    by_doc, by_sequence = {}, {}
    for r in got:
        by_doc.setdefault(r["doc_id"], set()).add((r["piece"], r["start"], r["length"], r["ids_crc32"]))
        by_sequence.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for i, ps in by_doc.items():
        ids = [*lib.encode(texts[i] or "", add_special_tokens=False).ids, 0]
        cut = [ids[s : s + 2048] for s in range(0, len(ids), 2048)]
        assert sorted(ps) == [(k, 2048 * k, len(c), zlib.crc32(np.array(c, "<u4").tobytes())) for k, c in enumerate(cut)]
    for spans in by_sequence.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(by_sequence) == -(-sum(r["length"] for r in got) // 2048)
    assert packing.packed_documents(none, WORD).count() == 0


def test_toxicity(docs, labels, none):
    got = toxicity.toxicity(docs, labels).collect()
    texts = dict(rows())
    assert len(got) == docs.count() and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in got)
    assert all((r["score"] >= 0.5) == ("idiot" in (texts[r["doc_id"]] or "")) for r in got)
    model = toxicity.learn(docs, labels)
    for r in got[:60]:  # every pair by itself
        at = [int(model.slots[t]) for t in toxicity.terms(texts[r["doc_id"]] or "") if model.slots[t] >= 0]
        raw = model.bias + sum(model.weights[i] for i in at) + sum(float(model.factors[i] @ model.factors[j]) for k, i in enumerate(at) for j in at[:k])
        assert abs(r["score"] - 1 / (1 + np.exp(-np.clip(raw, -30, 30)))) < 1e-9
    assert toxicity.toxicity(none, labels).count() == 0
    assert toxicity.toxicity(docs, labels.filter("false")).filter("predicted = 1").count() == 0
    left = toxicity.drop_toxic(docs, labels)
    assert left.columns == docs.columns and left.filter(F.col("text").contains("idiot")).count() == 0


def test_toxicity_of_pairs(spark):
    """No word tells anything alone, only which insult stands beside which group: the machine learns it, as no sum could."""
    r, rows = random.Random(5), []
    for i in range(1200):
        insult, group = r.randrange(2), r.randrange(2)
        rows.append((i, " ".join([prose("en", 12), ("alfa", "beta")[insult], prose("en", 5), ("gammas", "deltas")[group]]), int(insult == group)))
    frame = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    got = {x["doc_id"]: x for x in toxicity.toxicity(frame.select("doc_id", "text"), frame.select("doc_id", "toxic")).collect()}
    held = [got[i]["predicted"] == label for i, _, label in rows if got[i]["held_out"]]
    assert len(held) > 150 and sum(held) >= 0.95 * len(held)
    model = toxicity.learn(frame.select("doc_id", "text"), frame.select("doc_id", "toxic"))
    assert {int(t) for t in toxicity.terms("alfa beta gammas deltas")} <= set(np.flatnonzero(model.slots >= 0).tolist())


def test_languages(docs, none):
    got = {r["doc_id"]: r for r in languages.languages(docs).collect()}
    for i in (1, 2, 3, 4):
        assert (got[i]["lang_pred"], got[i]["score"]) == ("und", 0.0)
    right = [got[i]["lang_pred"] == ("de" if i % 2 else "en") for i in range(20, 170)]
    assert sum(right) > 140
    # The filters against exact sets of grams, with the same correction.
    model = languages.learn(docs)
    sets = {g: [bool(model.counts(np.array([g], np.uint32))[i] > 0.5) for i in range(len(model.names))] for g in {int(x) for i in range(20, 40) for x in languages.grams(dict(rows())[i])}}
    for i in range(20, 40):
        g = languages.grams(dict(rows())[i]).tolist()
        count = [sum(sets[x][k] for x in g) for k in range(len(model.names))]
        right = np.maximum(0, (np.array(count) - len(g) * model.false) / (1 - model.false))
        assert np.allclose(model.counts(np.array(g, np.uint32)), right) and got[i]["lang_pred"] == model.names[int(right.argmax())]
    assert languages.languages(none).count() == 0
    assert languages.languages(docs.withColumn("lang", F.lit(None).cast("string"))).filter("lang_pred <> 'und'").count() == 0


def test_quality(docs, labels, none):
    got = quality.quality(docs, labels).collect()
    assert len(got) == docs.count() and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in got)
    model, texts = quality.learn(docs, labels), dict(rows())
    for r in got[:60]:  # row by row, node by node
        x = quality.statistics((texts[r["doc_id"]] or "").encode())
        raw = model.bias
        for f, b, leaf in zip(model.feature, model.border, model.leaf, strict=True):
            node = 0
            while node < len(f):
                node = 2 * node + 1 + int(x[f[node]] > b[node])
            raw += leaf[node - len(f)]
        assert abs(r["score"] - 1 / (1 + np.exp(-raw))) < 1e-9
    assert quality.quality(none, labels).count() == 0
    assert quality.quality(docs, labels.filter("false")).filter("predicted = 1").count() == 0


def test_pipeline(spark, docs, labels, tmp_path):
    path = str(tmp_path)
    docs.write.parquet(f"{path}/documents.parquet")  # with columns whose names the stages use too
    labels.write.parquet(f"{path}/labels.parquet")
    out = corpus_pipeline.run(spark, path).collect()
    ids, texts = {r["doc_id"] for r in out}, dict(rows())
    assert {1, 7, 8, 10} <= ids and not ids & {2, 3, 11, 13, 14}
    assert not any("idiot" in (texts[i] or "") for i in ids)
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "exact_dedup", "simhash_near_dedup", "substring_dedup", "best_fit_packing"]


def test_pipeline_rows(spark, keys, labels, none, tmp_path):
    for name, table, left in (("keys", keys, 5), ("none", none, 0)):
        path = f"{tmp_path}/{name}"
        table.write.parquet(f"{path}/documents.parquet")
        labels.write.parquet(f"{path}/labels.parquet")
        docs = spark.read.parquet(f"{path}/documents.parquet")
        for _, stage in corpus_pipeline.STAGES[:-1]:
            docs = stage(spark, docs, path)
            assert docs.columns == table.columns
        assert corpus_pipeline.run(spark, path).select("doc_id", "piece", "ids_crc32").count() == left
