from datetime import datetime, timedelta

from pyspark.sql import functions as F

from foliant.operators import cache, classify, jobs, privacy, routing, taxonomy
from foliant.sources import files
from foliant.streaming import streams


def test_redact(one):
    got = one(privacy.redact(F.col("t")), t="Muster, Erika IBAN DE44500105175407324931 a.b@example.org Tel 030 1234567")
    for mark in ("[IBAN]", "[EMAIL]", "[NAME]", "[TELEFON]"):
        assert mark in got
    assert "DE4450" not in got and one(privacy.redact(F.col("t")), t=None) == ""
    plus = "Tel +49 30 1234567 x"
    assert "+49" in one(privacy.redact(F.col("t")), t=plus) and "+49" not in one(privacy.redact(F.col("t"), corrected_phone=True), t=plus)


def test_models_and_urls(one):
    assert one(privacy.is_external(F.col("m")), m="gemini/gemini-2.5-flash") and not one(privacy.is_external(F.col("m")), m="qwen3:27b")
    for url, want in (("https://nas.local:5006", True), ("https://192.168.1.10:5006", True), ("https://diskstation:5006", True), ("https://example.com/webdav", False), ("http://172.32.0.1", False), ("http://[::1]/", True), ("", False)):
        assert one(privacy.is_private_url(F.col("u")), u=url) is want, url


def test_route_and_names(spark, one):
    rows = [(".pdf", 25), (".DOCX", 25), (".pdf", 3)]
    df = spark.createDataFrame(rows, "suffix string, page_count int")
    assert [r["route"] for r in routing.with_route(df).collect()] == ["reduced", "office", "detailed"]
    assert [r["route"] for r in routing.with_route(df, reduce_large=False).collect()] == ["detailed", "office", "detailed"]
    meta = spark.createDataFrame([("20-05-2026", "A:B", "R"), ("", "x", "y")], "date string, title string, document_type string")
    assert [r["final_name"] for r in routing.with_final_name(meta).collect()] == ["20-05-2026_AB_R", "dokument_searchable"]
    assert one(routing.quote_path(F.col("p")), p="a b\\./ü*~") == "a%20b/%C3%BC%2A~"


def requests(spark, n=3):
    rows = [(i, "t", "m", "v", f"h{i % 2}", "s", None, "P", "R") for i in range(n)]
    df = spark.createDataFrame(rows, "request_id long, task string, model string, prompt_version string, user_prompt_hash string, system_prompt_hash string, image_sha256 string, prompt string, raw_text string")
    return cache.cache_key(df.withColumn("source_hashes", F.create_map(F.lit("b"), F.lit("1"), F.lit("a"), F.lit("2"))).withColumn("options", F.create_map().cast("map<string,string>")))


CACHE = "hash_key string, result_text string, created_at timestamp"


def test_cache_round(spark):
    k = requests(spark)
    keys = [r["key"] for r in k.orderBy("request_id").collect()]
    assert keys[0] == keys[2] != keys[1] and all(x.startswith("v2:") for x in keys)
    empty = spark.createDataFrame([], CACHE)
    found = cache.infer(cache.cache_misses(k, empty))
    assert found.count() == 2
    now = cache.cache_upsert(empty, found.select(F.col("key").alias("hash_key"), F.col("result").alias("result_text"), F.lit(datetime(2024, 1, 1)).alias("created_at")))
    assert cache.cache_misses(k, now).count() == 0 and cache.cache_lookup(k, now).filter("hit").count() == 3
    assert cache.cache_lookup(k, now, force=True).filter("hit").count() == 0
    assert cache.cache_upsert(now, now).count() == 2


def test_scorer_fails(spark):
    def broken(prompts):
        raise ValueError("no")

    r = cache.infer(requests(spark, 1), broken).first()
    assert (r["attempts"], r["result"]) == (3, None) and "no" in r["error"]


def test_confidence(spark):
    raw = ['x {"confidence": 150} y', '{"score": "7.9"}', '{"score": "?"}', "none", '{"confidence": null, "wahrscheinlichkeit": -3}']
    df = spark.createDataFrame([(t,) for t in raw], "t string")
    assert [r["c"] for r in df.select(cache.confidence(cache.parse_answer(F.col("t"))).alias("c")).collect()] == [100, 7, 78, 78, 0]


def test_context_winner(spark):
    contexts = spark.createDataFrame([("A/Golf", 0, "vehicle", ["Golf 7"], ["AB CD 123"], ""), ("A/Polo", 1, "vehicle", ["Polo"], ["XY 1"], "")], "path string, ord int, object_type string, aliases array<string>, keywords array<string>, notes string")
    docs = spark.createDataFrame([(1, "Inspektion Golf 7 AB CD 123"), (2, "nichts")], "doc_id long, haystack string")
    ranked = classify.rank_contexts(docs, contexts, contexts.select("path"))
    assert classify.rank_contexts(docs, contexts, contexts.select("path").filter("path <> 'A/Golf'")).filter("path = 'A/Golf'").count() == 0
    assert [(r["doc_id"], r["path"]) for r in classify.best_context(ranked).collect()] == [(1, "A/Golf")]
    more = spark.createDataFrame([(3, "vorgolf  7-ABxAB\tCD\u00a0123 polos"), (4, None), (5, ""), (6, "x" * 100_000)], "doc_id long, haystack string")
    both = docs.union(more)
    terms = classify.context_terms(contexts).collect()
    want = {(r["doc_id"], t["path"], t["term_no"]) for r in both.select("doc_id", classify.folded(F.col("haystack")).alias("t")).collect() for t in terms if t["norm"] in r["t"]}
    got = classify.context_hits(both, contexts).collect()
    assert {(r["doc_id"], r["path"], r["term_no"]) for r in got} == want and len(got) == len(want) > 4


def test_merge_keeps_or_replaces_evidence(spark):
    rows = [(1, "a/b", 50, "x", ["1"], 0), (1, "A/B", 40, "y", ["2"], 1), (1, "A/b", 60, "z", ["3"], 2), (1, "new", 60, "n", None, 3)]
    got = classify.merge_candidates(spark.createDataFrame(rows, "doc_id long, path string, score int, reason string, evidence array<string>, ord int"), spark.createDataFrame([("A/B",)], "path string")).orderBy("place").collect()
    assert [(r["path"], r["score"], r["reason"], r["evidence"], r["is_new"]) for r in got] == [("A/B", 60, "z", ["3"], False), ("new", 60, "n", [], True)]


def test_learning(spark):
    docs = spark.createDataFrame([(1, "Versicherung, Auto", "Police 4711-X und Musterwort"), (2, "", "ganz anders hier")], "doc_id long, meta_text string, text string")
    terms = classify.learning_terms(docs)
    decisions = spark.createDataFrame([(1, 1, "P/A", "Police")], "decision_id long, doc_id long, chosen_path string, document_type string")
    rejected = spark.createDataFrame([(1, "P/B"), (1, "P/A")], "decision_id long, path string")
    memory = classify.learn(decisions, terms, rejected, spark.createDataFrame([], "path string, kind string, term string, n int"))
    kinds = {(r["path"], r["kind"]) for r in memory.collect()}
    assert kinds == {("P/A", "positive"), ("P/A", "type"), ("P/B", "negative")}
    stats = decisions.withColumn("created_at", F.current_timestamp())
    got = classify.memory_candidates(terms, docs.withColumn("document_type", F.lit("Police")), memory, classify.path_stats(stats)).collect()
    assert [(r["doc_id"], r["path"]) for r in got] == [(1, "P/A")]


def test_taxonomy(spark):
    persons = spark.createDataFrame([("Anna", 0)], "name string, ord int")
    paths = spark.createDataFrame([("Anna/Auto",)], "path string")
    req = spark.createDataFrame([(0, "anna/Neu"), (1, "Anna/Neu"), (2, "Bob/x"), (3, ""), (4, "Anna\\Auto")], "ord int, path string")
    assert [r["outcome"] for r in taxonomy.add_paths(req, paths, persons).orderBy("ord").collect()] == ["added", "duplicate", "unknown_person", "empty", "duplicate"]
    assert {r["path"] for r in taxonomy.path_closure(spark.createDataFrame([("a/b/c",)], "path string")).collect()} == {"a", "a/b", "a/b/c"}
    assert taxonomy.apply_template(persons, paths).count() == 9
    several = spark.createDataFrame([(" Bob  B ",), ("a?",), ("anna",), ("BOB b",), (None,)], "name string")
    made = {r["path"] for r in taxonomy.apply_template(several, paths).collect()}
    assert len(made) == 11 + 9 and "Anna/Finanzen" in made and ({"BOB b", "Bob B"} & made) and "Anna" not in made
    assert {(r["name"], r["problem"]) for r in taxonomy.rejected_names(several).collect()} == {("a?", "forbidden"), (None, "empty")}
    assert [r["c"] for r in spark.createDataFrame([("a, A\n b  c,,Straße, STRASSE",)], "t string").select(taxonomy.clean_terms(F.col("t")).alias("c")).collect()] == [["a", "b c", "Straße"]]
    plan = taxonomy.folder_plan(spark.createDataFrame([("a/b",)], "path string"), spark.createDataFrame([("a", "1")], "path string, folder_id string"), spark.createDataFrame([("a/b", "9", False), ("a/b", "8", False)], "path string, entry_id string, trashed boolean"))
    assert {(r["path"], r["action"], r["folder_id"], r["conflict"]) for r in plan.collect()} == {("a", "trusted", "1", False), ("a/b", "found", "8", True)}


def test_jobs(spark):
    t = datetime(2024, 1, 1)
    cols = "job_id long, status string, created_at timestamp, updated_at timestamp"
    old, new = spark.createDataFrame([(1, "done", t, t)], cols), spark.createDataFrame([(1, "running", t + timedelta(1), t + timedelta(1)), (2, "running", t, t)], cols)
    assert {(r["job_id"], r["status"], r["created_at"]) for r in jobs.start_jobs(old, new).collect()} == {(1, "running", t), (2, "running", t)}
    index = spark.createDataFrame([(i, "h", i) for i in range(9)] + [(9, None, 9)], "id long, source_sha256 string, updated_at int")
    docs = spark.createDataFrame([(100, "h"), (8, "h"), (5, None)], "doc_id long, sha256 string")
    got = jobs.find_duplicates(docs, index).orderBy("doc_id", "place").collect()
    assert [r["id"] for r in got if r["doc_id"] == 100] == [8, 7, 6, 5, 4] and [r["id"] for r in got if r["doc_id"] == 8] == [7, 6, 5, 4, 3]
    assert len(got) == 10


def test_files(spark, tmp_path):
    for name in ("a.PDF", "b.part.pdf", "c.txt", "d.docx"):
        (tmp_path / name).write_bytes(b"x")
    assert {r["name"] for r in files.scan_inputs(spark, [str(tmp_path)]).collect()} == {"a.PDF", "d.docx"}
    h = spark.createDataFrame([("1", "e", "s", "d", None)], files.HISTORY)
    files.append_history(h, str(tmp_path / "h"))
    files.append_history(h, str(tmp_path / "h"))
    assert files.read_history(spark, str(tmp_path / "h")).filter("timestamp_utc is not null").count() == 2
    (tmp_path / "r.json").write_text('{"persons": ["A", "B"], "path_contexts": {"A/x": {"aliases": ["y"]}}}')
    got = files.load_registry(spark, str(tmp_path / "r.json"))
    assert got["person"].count() == 2 and got["path"].count() == 0 and got["path_context"].first()["aliases"] == ["y"]
    files.write_reports(spark.createDataFrame([(1, None)], "a int, b string"), str(tmp_path / "rep"))
    assert spark.read.text(str(tmp_path / "rep")).first()["value"] == '{"a":1,"b":null}'
    df = spark.createDataFrame([(1, "p/q", "t")], "doc_id long, target_path string, text string")
    files.write_text(df, str(tmp_path / "t"))
    files.write_text(df, str(tmp_path / "t"))
    assert spark.read.parquet(str(tmp_path / "t")).count() == 1


def test_stable_files(spark, tmp_path):
    t = datetime(2024, 1, 1)
    obs = [("f", 100, 0), ("f", 100, 2), ("f", 100, 4), ("f", 100, 6), ("g", 1, 0), ("g", None, 2), ("g", 1, 4), ("h", 1, 0), ("h", 2, 2), ("h", 2, 4), ("h", 2, 6)]
    rows = [(p, s, t - timedelta(seconds=6), t + timedelta(seconds=a)) for p, s, a in obs]
    cols = "path string, size long, mtime timestamp, observed_at timestamp"
    spark.createDataFrame(rows, cols).write.parquet(str(tmp_path / "in"))
    want = {("f", 100, t + timedelta(seconds=4)), ("h", 2, t + timedelta(seconds=6))}
    batch = streams.stable_files_batch(spark.read.parquet(str(tmp_path / "in")))
    assert {tuple(r) for r in batch.collect()} == want
    stream = streams.stable_files(streams.table_stream(spark, str(tmp_path / "in"), spark.read.parquet(str(tmp_path / "in")).schema))
    assert {tuple(r) for r in streams.drained(stream, str(tmp_path / "s")).collect()} == want
