"""Rules that fixed texts depend on, with examples written out."""

import pytest
from pyspark.sql import functions as F

from foliant.operators import cache, classify, fusion, privacy, routing
from foliant.sources import files


@pytest.mark.parametrize(
    "text, mark",
    [
        ("jörg.müller@example.de", "[EMAIL]"), ("x@bücher.de", "[EMAIL]"), ("äb@x.de", "[EMAIL]"), ("Kundennummer:\u00a0AB1234", "[ID]"), ("KUNDENNUMMER AB1234", "[ID]"),
        ("Muster,\u00a0Erika", "[NAME]"), ("0176\u00a0123 45 67", "[TELEFON]"), ("20.05.2026", "[DATUM]"), ("de44500105175407324931", "[IBAN]"),
    ],
)
def test_redaction_in_all_scripts(one, text, mark):
    assert one(privacy.redact(F.col("t")), t=text) == mark
    assert one(privacy.redact(F.col("t")), t=f"({text})") == f"({mark})"


def test_redaction_leaves_words(one):
    for text in ("ü20.05.2026", "20.05.2026ü", "Nummer 12", "a@b"):
        assert one(privacy.redact(F.col("t")), t=text) == text


def test_models(one):
    for model, name, key in (("qwen3:27b", "ollama/qwen3:27b", "ollama"), ("gemini/x", "gemini/x", "google"), ("vertex_ai/x", "vertex_ai/x", "google"), ("google/x", "google/x", "google"), ("openai/a/b", "openai/a/b", "openai")):
        assert (one(privacy.normalize_model(F.col("m")), m=model), one(privacy.settings_provider(F.col("m")), m=model)) == (name, key)


def test_tabular(spark):
    rows = [("Kontoauszug", "x", False), ("Umsatz", "x", True), ("a", "Der Befund", True), ("Labor.pdf", None, True), ("a", "| b |", True), ("a", "EUR", True), ("a", "invoice", False)]
    df = spark.createDataFrame(rows, "name string, text string, want boolean")
    assert routing.with_tabular(df, "name", "text").filter("tabular <> want").count() == 0


def test_final_names(spark):
    rows = [("1-1-2020", "Brief", "Befund"), ("1-1-2020", "Brief", ""), ("1-1-2020", "Brief", None), ("", "Brief", "Befund"), ("1-1-2020", None, "Befund"), ("d", 'a/b*c?"<>|:\\', "t")]
    got = routing.with_final_name(spark.createDataFrame(rows, "date string, title string, document_type string")).collect()
    assert [r["final_name"] for r in got] == ["1-1-2020_Brief_Befund", "1-1-2020_Brief_", "1-1-2020_Brief_", "dokument_searchable", "dokument_searchable", "d_abc\\_t"]
    assert [r["subject"] for r in got] == ["Brief - Befund", "Brief - ", "Brief - ", "Brief - Befund", "", 'a/b*c?"<>|:\\ - t']


def test_prompt(spark):
    pages = spark.createDataFrame([(1, 1, "o" * 7000, "d" * 9000, "g", None, "x" * 4000 + "y"), (1, 2, "o", "d", "", "", ""), (1, 4, None, None, None, None, "z")], "doc_id int, page_num int, ocr string, docling string, glm string, vision string, fused string")
    first, second, last = (r["prompt"] for r in fusion.fusion_prompt(fusion.with_prev_page(pages)).orderBy("page_num").collect())
    head, vision, glm, ocr = "--- KONTEXT VORHERIGE SEITE (nur für Seitenübergänge!) ---\n", "--- Vision-Review Markdown (Hauptquelle) ---\n", "--- GLM-OCR Text (strukturierte Rohextraktion) ---\n", "--- OCR Rohtext / Sidecar (Absicherung) ---\n"
    assert first == f"{vision}{'d' * 8000}\n\n{glm}g\n\n{ocr}{'o' * 6000}"
    assert second == f"{head}{'x' * 4000}\n\n{vision}\n\n{ocr}o"
    assert last == f"{vision}\n\n{ocr}"


def test_descriptions(spark):
    pages = spark.createDataFrame([(1, 1, " a "), (1, 2, " "), (2, 1, "b")], "doc_id int, page_num int, fused string")
    told = spark.createDataFrame([(1, 1, "Hund"), (1, 2, "Haus"), (2, 1, "Baum")], "doc_id int, page_num int, description string")
    got = {(r["doc_id"], r["page_num"]): r["fused"] for r in fusion.inject_descriptions(pages, told).collect()}
    assert got == {(1, 1): "[Bildbeschreibung: Hund]\n\na", (1, 2): "[Bildbeschreibung: Haus]", (2, 1): "[Bildbeschreibung: Baum]\n\nb"}
    texts = spark.createDataFrame([(1, "neu"), (2, " "), (3, "c")], "doc_id int, text string")
    counts = spark.createDataFrame([(1, 2), (2, 1)], "doc_id int, page_count int")
    got = {r["doc_id"]: r["text"] for r in fusion.describe_documents(texts, told, counts).collect()}
    assert got == {1: "[Bildbeschreibung Seite 1: Hund]\n\n[Bildbeschreibung Seite 2: Haus]\n\nneu", 2: "[Bildbeschreibung: Baum]", 3: "c"}
    docs = spark.createDataFrame([(2, "x"), (9, "ocr"), (10, None)], "doc_id int, ocr_text string")
    assert {r["doc_id"]: r["text"] for r in fusion.doc_text(pages, docs=docs).collect()} == {2: "b", 9: "ocr", 10: ""}


def test_pointers(spark):
    rows = [('{"title": "T", "url": "u", "doc_id": "7"}', "s"), ('{"url": ""}', "s"), ("{bad", "s"), ("plain", "s"), (None, "s"), ("[1]", "s")]
    got = [r["text"] for r in files.pointer_text(spark.createDataFrame(rows, "text string, stem string").coalesce(1)).collect()]
    head, label = "Synology Office Dokument-Link\nTitel: ", "Synology .odoc Inhalt:\n"
    assert got == [f"{head}T\nURL: u\nDokument-ID: 7", f"{head}s", f"{label}{{bad", f"{label}plain", label, f"{label}[1]"]


def test_metadata_is_taken_apart(spark):
    docs = spark.createDataFrame([(1, "wohnung_miete/vertrag|garten;keller,dach", "")], "doc_id long, meta_text string, text string")
    assert {r["term"] for r in classify.learning_terms(docs).collect()} == {"wohnung", "miete", "vertrag", "garten", "keller", "dach"}


def test_cache_key_keeps_numbers(spark):
    df = spark.createDataFrame([("t", "m", "1", "", "h", None, {"b": "1", "a": "2"}, (True, 0.5, 7))], "task string, model string, prompt_version string, system_prompt_hash string, user_prompt_hash string, image_sha256 string, source_hashes map<string,string>, options struct<z:boolean,a:double,n:int>")
    import hashlib
    import json

    payload = {"schema": "llm_cache_v2", "task": "t", "model": "m", "prompt_version": "1", "system_prompt_hash": "", "user_prompt_hash": "h", "image_sha256": None, "source_hashes": {"b": "1", "a": "2"}, "options": {"z": True, "a": 0.5, "n": 7}}
    want = "v2:" + hashlib.sha256(json.dumps(payload, sort_keys=True, ensure_ascii=False, separators=(",", ":")).encode()).hexdigest()
    assert cache.cache_key(df).first()["key"] == want


def test_archive(spark, tmp_path):
    rows = [("/o/a.pdf", " p/q ", b"1"), ("/x/a.pdf", "p\\q", b"2"), ("/o/b.json", "p", b"3"), ("/o/c.TXT", None, b"4"), ("/o/noend", "p", b"5")]
    path = f"{tmp_path}/archive"
    files.write_archive(spark.createDataFrame(rows, "path string, target_path string, content binary"), path)
    files.write_archive(spark.createDataFrame([("/o/d.doc", "r", b"6")], "path string, target_path string, content binary"), path)
    got = {(r["target_path"], r["file_name"], bytes(r["content"])) for r in spark.read.parquet(path).collect()}
    assert got == {("p/q", "a.pdf", b"2"), (None, "c.TXT", b"4"), ("r", "d.doc", b"6")} or got == {("p/q", "a.pdf", b"2"), ("", "c.TXT", b"4"), ("r", "d.doc", b"6")}
