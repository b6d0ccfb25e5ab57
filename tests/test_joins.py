"""Sides of joins that grow with the corpus don't go through the driver, however small their files are."""

import pytest

from foliant.functions.joins import joined_to_many
from foliant.operators import classify
from foliant.plans import inputs, store_queries, text_queries


@pytest.fixture
def kept(spark, tmp_path):
    """Rows as a file, so that Spark knows how small it is."""

    def write(name, rows, schema):
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}")
        return spark.read.parquet(f"{tmp_path}/{name}")

    return write


def broadcasts(df):
    """Joins by key whose one side is broadcast."""
    return str(df._jdf.queryExecution().executedPlan().toString()).count("BroadcastHashJoin")


@pytest.fixture
def learning(kept):
    return {
        "decisions": kept("decisions", [(1, 1, "A/x", "Rechnung"), (2, 2, "A/y", "")], "decision_id long, doc_id long, chosen_path string, document_type string"),
        "terms": kept("terms", [(1, "alpha", 1), (2, "beta", 1)], "doc_id long, term string, place int"),
        "rejected": kept("rejected", [(1, "A/y", 0)], "decision_id long, path string, ord int"),
        "stored": kept("stored", [("A/x", "positive", "alpha", 2)], "path string, kind string, term string, n int"),
    }


def test_learning_is_not_broadcast(learning):
    got = classify.learn(**learning)
    assert broadcasts(got) == 0
    assert sorted(map(tuple, got.collect())) == [("A/x", "positive", "alpha", 3), ("A/x", "type", "rechnung", 2), ("A/y", "negative", "alpha", 1), ("A/y", "positive", "beta", 1)]


def test_replay_is_not_broadcast(learning):
    got = classify.replay(**learning)
    assert broadcasts(got) == 0
    assert sorted(map(tuple, got.collect())) == [("A/x", "positive", "alpha", 3), ("A/x", "type", "rechnung", 2), ("A/y", "negative", "alpha", 1), ("A/y", "positive", "beta", 1)]


def test_context_hits_do_not_broadcast_texts(kept):
    docs = kept("docs", [(1, "eine rote Tür"), (2, "rote Katze")], "doc_id long, haystack string")
    contexts = kept("contexts", [("P/x", 1, "", ["rote tür"], ["katze"])], "path string, ord int, object_type string, aliases array<string>, keywords array<string>")
    got = classify.context_hits(docs, contexts)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "_text" in plan and broadcasts(got) <= 2  # words of contexts alone
    assert sorted((r["doc_id"], r["term"]) for r in got.collect()) == [(1, "rote tür"), (2, "katze")]


def test_dealt_rows_are_not_broadcast(kept):
    rows, known = kept("rows", [(1, "a"), (2, "a")], "i long, k string"), kept("known", [("a", 5)], "k string, v int")
    got = joined_to_many(rows, known, ["k"])
    assert broadcasts(got) == 0
    assert sorted(map(tuple, got.select("i", "k", "v").collect())) == [(1, "a", 5), (2, "a", 5)]


def test_artifacts_are_not_broadcast(kept):
    docs, files = kept("docs", [(1, "doc_1"), (2, "doc_12")], "doc_id long, final_name string"), kept("files", [("doc_12.pdf",), ("x.json",)], "name string")
    got = classify.artifacts_for(docs, files)
    assert broadcasts(got) == 0
    assert sorted(map(tuple, got.collect())) == [(1, "doc_12.pdf"), (2, "doc_12.pdf")]
    assert broadcasts(classify.artifacts_for(docs, files, exact=True)) == 0


def test_memory_and_cascade_keep_documents_apart(kept):
    ids = kept("ids", [(1,), (2,)], "doc_id long")
    assert broadcasts(classify.residue(ids, kept("gone", [(1,)], "doc_id long"))) == 0
    merged = kept("merged", [(1, 1, 80), (1, 2, 75)], "doc_id long, place int, score int")
    results = kept("results", [(1, 90, False)], "doc_id long, confidence int, is_new boolean")
    assert broadcasts(classify.needs_review(results, merged)) == 0


def test_parts_grow_with_lineitem(spark, data, monkeypatch):
    def exchanged(name):
        return str(text_queries.QUERIES[name](spark, data)._jdf.queryExecution().executedPlan().toString())

    names = ["fus8_describe_documents", "fus6_fusion_prompt", "lay4_reading_order", "qc1_amounts"]
    want = {name: sorted(map(str, text_queries.QUERIES[name](spark, data).collect())) for name in [*names, "fus2_pivot_channels"]}
    monkeypatch.setattr(inputs, "A_TASK", 500)
    lines = spark.read.parquet(f"{data}/lineitem.parquet").count()
    for name in names:
        assert "hashpartitioning(l_orderkey#" in exchanged(name) and f", {-(-lines // 500)})" in exchanged(name)
        assert f", {spark.conf.get('spark.sql.shuffle.partitions')})" not in exchanged(name)
    assert f", {-(-lines // 500)})" in exchanged("fus2_pivot_channels")
    for name, rows in want.items():
        assert sorted(map(str, text_queries.QUERIES[name](spark, data).collect())) == rows


def test_parts_grow_with_documents(spark, data, monkeypatch):
    want = sorted(map(str, store_queries.QUERIES["cls6_learning_terms"](spark, data).collect()))
    monkeypatch.setattr(inputs, "DOCS_A_TASK", 20)
    n = -(-spark.read.parquet(f"{data}/part.parquet").count() // 20)
    df = store_queries.QUERIES["cls6_learning_terms"](spark, data)
    plan = str(df._jdf.queryExecution().executedPlan().toString())
    assert plan.count("Exchange hashpartitioning") == 1 and f", {n})" in plan
    assert sorted(map(str, df.collect())) == want


def test_memory_terms_are_not_broadcast(kept):
    terms = kept("terms", [(1, "alpha"), (1, "beta"), (2, "alpha"), (2, "alpha")], "doc_id long, term string")
    memory = kept("memory", [("A/x", "positive", "alpha", 9), ("A/x", "negative", "beta", 1), ("A/x", "type", "rechnung", 2)], "path string, kind string, term string, n int")
    types = kept("types", [(1, "Rechnung"), (2, "")], "doc_id long, document_type string")
    got = classify.memory_candidates(terms, types, memory, kept("stats", [("A/x", 2)], "path string, confirmed_count int"))
    assert broadcasts(got) <= 2  # the paths' types and counts
    assert "BroadcastHashJoin [term#" not in str(got._jdf.queryExecution().executedPlan().toString())
    assert sorted((r["doc_id"], r["path"], r["score"], r["evidence"]) for r in got.collect()) == [(1, "A/x", 47, ["alpha"]), (2, "A/x", 42, ["alpha"])]
