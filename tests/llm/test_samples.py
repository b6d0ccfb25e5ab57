"""Samples of labelled rows, and rows with odd columns."""

import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from foliant.llm import bpe, entries, languages, learning, quality, simhash, suffix, toxicity
from foliant.llm.common import written


@pytest.mark.parametrize("bound", [1, 50, 400, 5000])
def test_sample_is_the_first_by_hash(spark, bound):
    labels = spark.range(3000).select(F.col("id").alias("doc_id"), (F.col("id") % 7 == 0).cast("int").alias("label"))
    got = {r["doc_id"] for r in learning.sampled(labels, F.col("doc_id") % 5 != 0, bound).collect()}
    rows = [(r["h"], r["id"]) for r in spark.range(3000).select("id", F.xxhash64("id").alias("h")).collect() if r["id"] % 5]
    by_class = [sorted(x for x in rows if (x[1] % 7 == 0) == c)[: learning.LEAST] for c in (True, False)]
    assert got == {i for _, i in sorted(rows)[:bound] + by_class[0] + by_class[1]}


@pytest.mark.parametrize("spread", [1, 1 << 40, 1 << 62])
def test_first_by_hash(spark, spread, monkeypatch):
    """Hashes over the whole range, in a small part of it and with many ties, against a sort."""
    monkeypatch.setattr(learning, "TOGETHER", 20)
    h = F.shiftright(F.xxhash64("id"), spread.bit_length() - 1)
    rows = written(spark.range(20_000).select(F.col("id").alias("doc_id"), h.alias("_h")), "rows")
    ordered = sorted((r["_h"], r["doc_id"]) for r in rows.collect())
    for bound in (1, 777, 12_000, 20_000, 30_000):
        got = learning.first_by_hash(rows, bound).collect()
        assert sorted((r["_h"], r["doc_id"]) for r in got) == ordered[:bound]


def test_int_ids_and_backticks(spark):
    """An int doc_id and a column whose name holds a backtick."""
    docs = spark.createDataFrame([(i, f"der Text {i} ist hier und dort", "de", "x") for i in range(12)], "doc_id int, text string, lang string, `a``b` string")
    labels = docs.select("doc_id", F.lit(0).alias("toxic"), (F.col("doc_id") % 2).alias("quality"))
    for got in (
        suffix.removal_digests(docs), toxicity.toxicity(docs, labels), languages.languages(docs), quality.quality(docs, labels),
        bpe.encoding_digests(docs, entries.vocabulary(entries.BYTE_BPE)), simhash.near_duplicates(docs),
    ):
        assert got.count() == 12
    left = toxicity.drop_toxic(docs, labels)
    assert left.columns == docs.columns and left.count() == 12 and simhash.drop_near(docs).columns == docs.columns


def test_language_of_its_own_row(spark):
    """A doc_id with rows in two languages teaches only the text that stands beside the language taken."""
    texts = {"de": "aaaa bbbb cccc dddd", "fr": "eeee ffff gggg hhhh"}
    rows = [(i, texts["de"], "de") for i in range(40)] + [(i, texts["fr"], "fr") for i in range(40)] + [(i, texts["fr"], "fr") for i in range(40, 80)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {(r["text"], r["lang_pred"]) for r in languages.languages(docs).join(docs.select("doc_id", "text").filter("doc_id >= 40"), "doc_id").collect()}
    assert got == {(texts["fr"], "fr")}


def test_filters_against_sets():
    """Bloom filters against plain sets of grams: none is missed, false ones are as rare as told, corrected counts are close."""
    rng = np.random.default_rng(5)
    known = {f"l{i}": np.unique(rng.integers(0, 1 << 32, 40_000, dtype=np.uint32)) for i in range(3)}
    model = languages.Filters.of(list(known), known)
    for i, name in enumerate(known):
        own = {int(x) for x in known[name]}
        held = known[name][:500]
        assert all(model.counts(held[k : k + 1])[i] > 0.5 for k in range(50))
        strange = np.array([x for x in rng.integers(0, 1 << 32, 60_000, dtype=np.uint32).tolist() if x not in own], np.uint32)
        sets = model.rows[next(model.places(strange))]
        for p in list(model.places(strange))[1:]:
            sets = sets & model.rows[p]
        false = float(((sets[:, 0] >> np.uint64(i)) & np.uint64(1)).mean())
        assert abs(false - model.false[i]) < 0.1 * model.false[i] + 3e-4
        mixed = np.concatenate([held, strange[:5000]])
        assert abs(model.counts(mixed)[i] - sum(int(x) in own for x in mixed)) < 30


def test_pipeline_against_plain_python(spark, tmp_path):
    """What the first three stages keep, and whose pieces come out, from plain Python rules on each stage's own input."""
    rng = random.Random(11)
    vocabulary = [f"wort{i}" for i in range(400)]
    base = [" ".join(rng.choice(vocabulary) for _ in range(rng.choice([0, 2, 60, 150]))) for _ in range(60)]
    texts: list = base + [base[3], base[3] + "  ", base[7].replace(" ", "\n", 1), None, "", " "] + [t + " ende" for t in base[:12]] + ["du idiot bist ein trottel " + t for t in base[20:40]]
    labels = [(i, 0, int("idiot" in (t or ""))) for i, t in enumerate(texts)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    path = str(tmp_path)
    stages = dict(corpus_pipeline.STAGES)
    ids = lambda df: {r["doc_id"] for r in df.collect()}

    clean = written(stages["toxicity"](spark, docs, path), "clean")
    assert ids(clean) == {i for i, _, toxic in labels if not toxic}
    first: dict = {}
    for i in sorted(ids(clean)):
        first.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", texts[i] or ""), i)
    single = written(stages["exact_dedup"](spark, clean, path), "single")
    assert ids(single) == set(first.values())

    def fingerprint(text: str) -> int:
        w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text).split()
        shingles = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([" ".join(w)] if w else [])
        h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    prints = {i: fingerprint(texts[i] or "") for i in ids(single)}
    group = {i: i for i in prints}
    for _ in prints:
        for i in prints:
            for j in prints:
                if (prints[i] ^ prints[j]).bit_count() <= 3:
                    group[i] = group[j] = min(group[i], group[j])
        if all(group[group[i]] == group[i] for i in prints):
            break
    apart = written(stages["simhash_near_dedup"](spark, single, path), "apart")
    assert ids(apart) == set(group.values())
    cut = {r["doc_id"]: r["text"] for r in stages["substring_dedup"](spark, apart, path).collect()}
    assert set(cut) <= ids(apart) and all((cut[i] or "") == (texts[i] or "") for i in cut if len((texts[i] or "").split()) < 50)
    assert ids(corpus_pipeline.run(spark, path)) == set(cut)
