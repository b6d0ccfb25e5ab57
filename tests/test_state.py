"""Tables that change, streams over several runs, and rules against Python's own modules."""

import hashlib
import ipaddress
import json
import random
from datetime import date, datetime, timedelta
from decimal import Decimal
from urllib.parse import urlsplit

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from foliant.functions.joins import joined_by_size, joined_to_many
from foliant.functions.nested import json_text
from foliant.operators import cache, classify, jobs, privacy
from foliant.sources import files, ledger
from foliant.streaming import streams

T0 = datetime(2024, 1, 1)


def test_archive_keeps_earlier_files(spark, tmp_path):
    path, schema = str(tmp_path / "a"), "path string, target_path string, content binary"
    put = lambda *rows: files.write_archive(spark.createDataFrame(list(rows), schema), path)
    have = lambda: {(r["target_path"], r["file_name"], bytes(r["content"])) for r in spark.read.parquet(path).collect()}
    put(("o/a.pdf", "X/Y", b"1"))
    put(("o/b.pdf", "X/Y", b"2"), ("o/c.json", "X/Y", b"no"), ("o/d.pdf", "", b"4"), ("o/e.pdf", None, b"5"), ("o/n.pdf", "2024", b"6"))
    want = {("X/Y", "a.pdf", b"1"), ("X/Y", "b.pdf", b"2"), (None, "d.pdf", b"4"), (None, "e.pdf", b"5"), ("2024", "n.pdf", b"6")}
    got = lambda: {(str(p) if p is not None else None, n, c) for p, n, c in have()}
    assert got() == want
    for _ in range(2):  # a rerun changes nothing
        put(("p/a.pdf", "X\\Y", b"7"), ("o/d.pdf", " ", b"8"))
        assert got() == want - {("X/Y", "a.pdf", b"1"), (None, "d.pdf", b"4")} | {("X/Y", "a.pdf", b"7"), (None, "d.pdf", b"8")}


def test_texts_keep_earlier_documents(spark, tmp_path):
    path, schema = str(tmp_path / "t"), "doc_id long, target_path string, text string"
    for rows in ([(1, "p", "a"), (2, "q", "b")], [(3, "p", "c"), (1, "p", "d"), (1, "p", "b")], [(None, "p", "n")], [(None, "p", "m")]):
        files.write_text(spark.createDataFrame(rows, schema), path)
    assert {(r["doc_id"], r["target_path"], r["text"]) for r in spark.read.parquet(path).collect()} == {(1, "p", "d"), (2, "q", "b"), (3, "p", "c"), (None, "p", "m")}


def test_ledger(spark, tmp_path):
    path, schema = str(tmp_path / "l"), "k long, v string"
    frame = lambda *rows: spark.createDataFrame(list(rows), schema)
    state = lambda: {tuple(r) for r in ledger.state(spark, path, "a", schema, ["k"]).collect()}
    assert state() == set()
    assert ledger.commit(spark, path, 0, {"a": frame((1, "x"), (2, "x")), "b": frame((9, "b"))})
    frame((1, "lost")).write.parquet(f"{path}/a/kind=delta/batch=1")  # a batch that failed before its entry was written
    assert state() == {(1, "x"), (2, "x")}
    assert ledger.commit(spark, path, 1, {"a": frame((2, "y"), (3, "y"))})
    assert not ledger.commit(spark, path, 1, {"a": frame((2, "again"))})
    want = {(1, "x"), (2, "y"), (3, "y")}
    assert state() == want
    ledger.fold(spark, path, "a", schema, ["k"], 1)
    assert state() == want and ledger.rows(spark, path, "a", schema).count() == 3
    ledger.commit(spark, path, 2, {"a": frame((1, "z"))})
    assert state() == {(1, "z"), (2, "y"), (3, "y")} and ledger.rows(spark, path, "b", schema).count() == 1


@pytest.mark.parametrize("total", [1, 100_000])
def test_hot_joins(spark, total):
    rows = spark.createDataFrame([("h", i) for i in range(300)] + [("c", 1), (None, 2)], "k string, i long")
    known = spark.createDataFrame([("h", 300, "H"), ("x", 1, "X")], "k string, n long, v string")
    want = sorted(str((r["i"], r["v"])) for r in rows.join(known, "k", "left").collect())
    assert sorted(str((r["i"], r["v"])) for r in joined_by_size(rows, known, ["k"], total).collect()) == want
    many = spark.createDataFrame([("h", "a"), ("h", "b"), ("c", "d")], "k string, v string")
    assert joined_to_many(rows, many, ["k"]).count() == 601


def test_one_row_a_key(spark):
    day = timedelta(days=1)
    cols = "job_id long, status string, source_sha256 string, error string, created_at timestamp, updated_at timestamp"
    old = spark.createDataFrame([(1, "done", "s", None, T0, T0)], cols)
    new = spark.createDataFrame([(1, "a", None, None, T0 + day, T0 + day), (1, "b", None, None, T0 + 2 * day, T0 + 2 * day), (2, "c", None, None, T0 + 2 * day, T0 + 2 * day), (2, "d", None, None, T0, T0)], cols)
    assert {(r["job_id"], r["status"], r["created_at"]) for r in jobs.start_jobs(old, new).collect()} == {(1, "b", T0), (2, "c", T0)} and jobs.start_jobs(old, new).count() == 2
    updates = spark.createDataFrame([(1, "x", "e1", T0 + day), (1, "y", None, T0 + 2 * day)], "job_id long, status string, error string, updated_at timestamp")
    assert [(r["status"], r["error"], r["updated_at"]) for r in jobs.update_jobs(old, updates).collect()] == [("y", "e1", T0 + 2 * day)]
    queue = spark.createDataFrame([(5, "pending", None, T0, None)], "id long, status string, chosen_path string, created_at timestamp, resolved_at timestamp")
    twice = spark.createDataFrame([(5, "resolved", "A", T0), (5, "resolved", "B", T0 + day), (None, "resolved", "C", T0)], "id long, status string, chosen_path string, resolved_at timestamp")
    assert [r["chosen_path"] for r in jobs.review_resolve(queue, twice).collect()] == ["B"]
    req = spark.createDataFrame([("k", 2), ("k", 1), ("m", 3)], "key string, request_id long")
    entries = spark.createDataFrame([("k", "old", T0), ("k", "new", T0 + day)], "hash_key string, result_text string, created_at timestamp")
    assert sorted((r["request_id"], r["result"], r["hit"]) for r in cache.cache_lookup(req, entries).collect()) == [(1, "new", True), (2, "new", True), (3, None, False)]
    assert [tuple(r) for r in cache.cache_misses(req, entries).collect()] == [("m", 3)]
    listing = spark.createDataFrame([("/in/a", "x", 1), ("/in/a", "y", 0)], "dir string, profile string, ord int")
    assert [r["profile"] for r in files.with_source_profile(spark.createDataFrame([("/in/a/f.pdf",)], "path string"), listing).collect()] == ["y"]
    cand = spark.createDataFrame([(1, "a/b", 50, "x", ["1"], 0)], "doc_id long, path string, score int, reason string, evidence array<string>, ord int")
    assert classify.merge_candidates(cand, spark.createDataFrame([("A/B",), ("A/b",)], "path string")).count() == 1
    with pytest.raises(Exception, match="one row of options"):
        jobs.runtime_audit(req.withColumn("p", F.lit("x")), spark.createDataFrame([(1,), (2,)], "v int"), "p").collect()


def test_search_takes_a_backslash(spark):
    index = spark.createDataFrame([(1, "a\\b", "x"), (2, "ab", "A\\B_c"), (3, None, "a%b")], "id long, source_name string, final_name string")
    found = lambda q: {r["id"] for r in jobs.search(index, q, 9, ["source_name", "final_name"], [F.desc("id")]).collect()}
    assert found("a\\b") == {1, 2} and found("a%b") == {1, 2, 3} and found("") == {1, 2, 3} and found("\\") == {1, 2}


def test_release_rules(spark):
    pending = spark.createDataFrame([(1, "anna/neu"), (2, "Fremd/x"), (3, "Anna/da"), (4, "wartet")], "doc_id long, path string")
    decisions = spark.createDataFrame([("anna/neu", "Anna\\ Alt ", T0), ("anna/neu", " ANNA / Neu// ", T0 + timedelta(1)), ("Fremd/x", None, T0), ("Anna/da", "Anna/woanders", T0)], "path string, final_path string, decided_at timestamp")
    known, persons = spark.createDataFrame([("Anna/da",)], "path string"), spark.createDataFrame([("Anna", 0), ("ANNA", 1)], "name string, ord int")
    got = {(r["doc_id"], r["path"], r["proposed_path"]) for r in jobs.release(pending, decisions, known, persons).collect()}
    assert got == {(1, "Anna/Neu", "anna/neu"), (2, "Sonstiges/x", "Fremd/x"), (3, "Anna/da", "Anna/da")}


def test_bad_request_stands_alone(spark):
    def scorer(prompts):
        if any("bad" in p for p in prompts):
            raise ValueError("bad prompt")
        return prompts.str.upper()

    rows = spark.createDataFrame([(f"k{i}", "bad" if i == 13 else f"p{i}") for i in range(20)], "key string, prompt string").coalesce(1)
    got = {r["key"]: r for r in cache.infer(rows, scorer).collect()}
    assert len(got) == 20 and sum(r["result"] is None for r in got.values()) == 1
    assert (got["k13"]["attempts"], got["k13"]["error"]) == (3, "bad prompt") and got["k3"]["result"] == "P3"
    short = {r["key"]: r["error"] for r in cache.infer(rows.filter("key <> 'k13'"), lambda p: p.iloc[1:]).collect()}
    assert len(short) == 19 and all("answers" in e for e in short.values())  # a scorer that drops rows is no success


FLOATS = [0.0, -0.0, 1.0, -1.5, 0.1, 1e-4, 1.25e-4, 1e-5, 1e-7, 123456.789, 1e7, 12345678.9, 1e15, 123456789012345680.0, 1e16, 1.5e16, 1e22, 1.7976931348623157e308, float("inf"), float("-inf")]


def test_numbers_as_python(spark):
    rows = spark.createDataFrame([(x,) for x in [*FLOATS, float("nan"), *(random.Random(i).uniform(-1, 1) * 10 ** random.Random(i).randrange(-9, 20) for i in range(200))]], "x double")
    for r in rows.select("x", json_text(F.col("x"), rows.schema["x"].dataType).alias("t")).collect():
        assert float(r["t"]) == r["x"] or r["t"] == "NaN"
        if len(repr(r["x"])) <= 12:  # longer ones may be spelled with more digits than needed by older JVMs
            assert r["t"] == json.dumps(r["x"])


def test_nested_keys(spark):
    options = {"temperature": 1e-7, "b": {"z": 1, "a": [{"y": None, "x": "ü\"\\\n"}, {"x": "", "y": True}]}, "Z": 1.0, "when": date(2024, 1, 2), "cost": Decimal("1.50")}
    kind = "temperature double, b struct<z:long,a:array<struct<y:boolean,x:string>>>, Z double, when date, cost decimal(9,2)"
    payload = {"schema": "llm_cache_v2", "task": "t", "model": "m", "prompt_version": "", "system_prompt_hash": "s", "user_prompt_hash": "u", "image_sha256": None, "source_hashes": {"ocr": "1", "a": "2"}, "options": options}
    row = (1, "t", "m", None, "s", "u", None, payload["source_hashes"], options)
    df = spark.createDataFrame([row], f"id long, task string, model string, prompt_version string, system_prompt_hash string, user_prompt_hash string, image_sha256 string, source_hashes map<string,string>, options struct<{kind}>")
    canonical = json.dumps(payload, sort_keys=True, ensure_ascii=False, separators=(",", ":"), default=str)
    assert cache.cache_key(df).first()["key"] == "v2:" + hashlib.sha256(canonical.encode()).hexdigest()
    maps = spark.createDataFrame([({"b": {"k2": [1, 2], "k1": []}, "a": None},), (None,)], "m map<string,map<string,array<int>>>")
    assert [r["t"] for r in maps.select(json_text(F.col("m"), maps.schema["m"].dataType).alias("t")).collect()] == ['{"a":null,"b":{"k1":[],"k2":[1,2]}}', "null"]


def test_masks_at_every_depth(spark):
    kind = "api_key struct<a:string,b:int>, plain array<map<string,string>>, deep struct<name:string,inner:map<string,struct<AccessToken:string,n:double>>>"
    df = spark.createDataFrame([((("x", 1), [{"Password": "p", "name": "n"}, {}], ("d", {"k": ("t", 2.5), "credentials": ("t", 1.0)})),)], f"s struct<{kind}>")
    got = json.loads(privacy.mask_nested(df, "s").first()["s"])
    assert got == {"api_key": "<redacted>", "plain": [{"Password": "<redacted>", "name": "n"}, {}], "deep": {"name": "d", "inner": {"k": {"AccessToken": "<redacted>", "n": 2.5}, "credentials": "<redacted>"}}}


def private(url: str) -> bool:
    """As Python's ipaddress has it."""
    try:
        name = (urlsplit(url).hostname or "").lower()
    except ValueError:
        return False
    if not name or name == "localhost" or name.endswith(".local") or "." not in name:
        return bool(name)
    try:
        ip = ipaddress.ip_address(name)
        return ip.is_private or ip.is_loopback or ip.is_link_local
    except ValueError:
        return False


def test_address_ranges(spark):
    edges = [a for n in privacy.PRIVATE_RANGES + privacy.PUBLIC_WITHIN for net in [ipaddress.ip_network(n)] for a in (int(net[0]) - 1, int(net[0]), int(net[-1]), int(net[-1]) + 1) if 0 <= a < 1 << 32]
    hosts = [str(ipaddress.ip_address(a)) for a in edges] + [str(ipaddress.ip_address(random.Random(i).randrange(1 << 32))) for i in range(200)]
    hosts += ["010.0.0.1", "300.1.1.1", "1.2.3", "1.2.3.4.5", "10.0.0.1.", "nas", "localhost", "a.local", "example.org", "[::1]", "[2606:4700::1]", "[::ffff:10.0.0.1]", "[::ffff:8.8.8.8]", "[fd00::1.2.3.4]", "[2001:db8::1.2.3.4]", "[2606:4700::8.8.8.8]"]
    urls = [f"http://{h}:80/x" for h in hosts] + ["//nas/x", "nas/x", "", "https://u:p@192.0.2.5/", "http://172.20.0.1?x=1"]
    got = {r["u"]: r["p"] for r in spark.createDataFrame([(u,) for u in urls], "u string").select("u", privacy.is_private_url(F.col("u")).alias("p")).collect()}
    assert {u: p for u, p in got.items() if p != private(u)} == {}


def loop(decisions: list[tuple], terms: dict, rejected: dict, stored: list[tuple]) -> dict:
    """Decision by decision, with all counters trimmed after each."""
    memory: dict = {}
    for path, kind, term, n in sorted(stored, key=lambda r: (-r[3], r[2])):
        memory.setdefault((path, kind), {})[term] = n
    for number, doc, chosen, kind in sorted(decisions):
        adds = [(chosen, "positive", t, 1) for t in terms[doc]] + ([(chosen, "type", kind.lower(), 2)] if kind else [])
        adds += [(path, "negative", t, 1) for path in rejected[number] if path != chosen for t in terms[doc][: classify.REJECTED]]
        for path, k, t, n in adds:
            counts = memory.setdefault((path, k), {})
            counts[t] = min(counts.get(t, 0) + n, classify.MOST)
        memory = {k: dict(sorted(v.items(), key=lambda x: -x[1])[: classify.PER_PATH]) for k, v in memory.items()}
    return {(p, k, t): n for (p, k), v in memory.items() for t, n in v.items()}


def test_replay(spark):
    rng = random.Random(3)
    terms = {d: [f"t{i}" for i in rng.sample(range(300), 70)] for d in range(90)}
    decisions = [(i, i, f"P/{rng.randrange(3)}", rng.choice(["", "Rechnung", "Befund"])) for i in range(90)]
    rejected = {i: [f"P/{rng.randrange(4)}" for _ in range(rng.randrange(4))] for i in range(90)}
    stored = [("P/0", "positive", f"t{i}", rng.randrange(1, 60)) for i in range(100)] + [("Q", "type", "x", 3)]
    got = classify.replay(
        spark.createDataFrame(decisions, "decision_id long, doc_id long, chosen_path string, document_type string"),
        spark.createDataFrame([(d, t, i) for d, v in terms.items() for i, t in enumerate(v, 1)], "doc_id long, term string, place int"),
        spark.createDataFrame([(i, p, j) for i, v in rejected.items() for j, p in enumerate(v)], "decision_id long, path string, ord int"),
        spark.createDataFrame(stored, "path string, kind string, term string, n int"),
    )
    want = loop(decisions, terms, rejected, stored)
    assert {(r["path"], r["kind"], r["term"]): r["n"] for r in got.collect()} == want and len(want) > 400


def test_context_lines(spark):
    rows = [("A", "", ["x", "y"], None, None), ("B", "auto", None, [], ""), ("C", None, [], [], " \n"), ("D", "t", ["a"], ["k"], "n  \n" + "l" * 300), ("E", "fremd", ["z"], None, "")]
    contexts = spark.createDataFrame(rows, "path string, object_type string, aliases array<string>, keywords array<string>, notes string")
    got = [r["line"] for r in classify.context_lines(contexts, contexts.select("path").filter("path <> 'E'")).collect()]
    assert got == ["- A: Aliase=x, y", "- B: Typ=auto", "- D: Typ=t; Aliase=a; Stichworte=k; Notiz=n " + "l" * 218]


def test_model_sees_the_residue_only(spark):
    docs = spark.createDataFrame([(1,), (2,), (3,), (4,)], "doc_id long")
    ranked = spark.createDataFrame([(1, "A/x", 12, 96, ["e"], 1), (2, "A/x", 4, 32, ["c"], 1)], "doc_id long, path string, raw_score int, score int, evidence array<string>, place int")
    memory = spark.createDataFrame([(2, "A/y", 95, ["m"], 1), (3, "A/z", 50, ["n"], 1)], "doc_id long, path string, score int, evidence array<string>, place int")
    paths, persons = spark.createDataFrame([("A/x",), ("A/y",), ("A/z",)], "path string"), spark.createDataFrame([("A", 0)], "name string, ord int")
    seen = []

    def ask(left):
        seen.extend(sorted(r["doc_id"] for r in left.collect()))
        return spark.createDataFrame([(3, "a/Z", 40, "why")], "doc_id long, raw_path string, confidence int, why string")

    got = {r["doc_id"]: r for r in classify.classify(docs, ranked, memory, paths, persons, ask).collect()}
    assert seen == [3, 4]
    assert {k: (r["path"], r["reason"], r["confidence"], r["is_new"], r["evidence"]) for k, r in got.items()} == {
        1: ("A/x", "context_match", 96, False, ["e"]), 2: ("A/y", "memory", 95, False, ["m"]), 3: ("A/z", "llm", 40, False, []), 4: ("Sonstiges", "fallback", 0, True, []),
    }
    assert [(c["path"], c["score"], c["evidence"]) for c in got[3]["candidates"]] == [("A/z", 50, ["n"])] and [c["path"] for c in got[2]["candidates"]] == ["A/y", "A/x"]


def test_ingest_replay(spark, tmp_path):
    docs = lambda *rows: spark.createDataFrame(list(rows), "doc_id long, text string, suffix string, page_count int")
    known = spark.createDataFrame([(hashlib.sha256(b"k").hexdigest(),)], "source_sha256 string")
    sink, path = streams.ingest(known, str(tmp_path / "s")), str(tmp_path / "s")
    first = docs((1, "a", ".pdf", 1), (2, "a", ".pdf", 1), (3, "k", ".docx", 1), (4, None, ".pdf", 1))
    for number, batch in ((0, first), (0, first), (1, docs((5, "a", ".pdf", 30), (6, "b", ".pdf", 1))), (1, docs((7, "x", ".pdf", 1)))):
        sink(batch, number)
    got = {r["doc_id"]: (r["duplicate"], r["route"]) for r in ledger.rows(spark, path, "documents", streams.INGESTED).collect()}
    assert got == {1: (False, "detailed"), 2: (True, "detailed"), 3: (True, "office"), 4: (False, "detailed"), 5: (True, "reduced"), 6: (False, "detailed")}
    assert ledger.rows(spark, path, "index", "doc_id long, sha256 string").count() == 6


def test_upserts_write_changed_keys(spark, tmp_path):
    sink, path = streams.upserts(str(tmp_path / "u"), "s", ["k"], every=3), str(tmp_path / "u")
    frame = lambda *rows: spark.createDataFrame(list(rows), "k long, v string")
    sink(frame(*((i, "a") for i in range(50))), 0)
    sink(frame((7, "b")), 1)
    assert spark.read.parquet(f"{path}/s/kind=delta/batch=1").count() == 1
    sink(frame((8, "c")), 2)
    assert spark.read.parquet(f"{path}/s/kind=full/batch=2").count() == 50
    sink(frame((9, "d")), 3)
    sink(frame((9, "again")), 3)
    now = {r["k"]: r["v"] for r in ledger.state(spark, path, "s", "k long, v string", ["k"]).collect()}
    assert len(now) == 50 and (now[7], now[8], now[9], now[1]) == ("b", "c", "d", "a")


def test_vanished_files_lose_their_state(spark, tmp_path):
    """A poll that doesn't list a file writes no row for it; later observations of others move the watermark."""
    cols, at, path = "path string, size long, mtime timestamp, observed_at timestamp", str(tmp_path / "q"), str(tmp_path / "in")
    runs = [[("f", 1, 0), ("f", 1, 2), ("g", 1, 0)], [("g", 1, 60), ("g", 1, 62), ("g", 1, 64)], [("f", 1, 70), ("h", 1, 200)], [("h", 2, 400)]]
    held = []
    for rows in runs:
        spark.createDataFrame([(p, s, T0 - timedelta(seconds=9), T0 + timedelta(seconds=a)) for p, s, a in rows], cols).coalesce(1).write.mode("append").parquet(path)
        out = streams.drained(streams.stable_files(streams.table_stream(spark, path, spark.read.parquet(path).schema), 10, "1 second"), at)
        held.append({r["key"]["path"] for r in spark.read.format("statestore").option("stateVarName", "seen").load(f"{at}/state").collect()})
    assert {(r["path"], r["observed_at"]) for r in out.collect()} == {("g", T0 + timedelta(seconds=64))}  # f was gone in between
    assert "f" in held[0] and "f" not in held[1] and held[3] == {"h"}
    assert {tuple(r) for r in streams.stable_files_batch(spark.read.parquet(path), 10).collect()} == {tuple(r) for r in out.collect()}


def test_once_within_the_horizon(spark, tmp_path):
    at, path = str(tmp_path / "q"), str(tmp_path / "in")
    runs = [[("a", 30), ("a", 0), ("b", 10)], [("a", 5), ("a", 3500)], [("a", 4000), ("c", 9000)], [("a", 9500), ("a", 100), ("z", 90_000)], [("z", 180_000)]]
    for rows in runs:
        spark.createDataFrame([(k, T0 + timedelta(seconds=s), s) for k, s in rows], "sha256 string, seen_at timestamp, n long").coalesce(1).write.mode("append").parquet(path)
        out = streams.drained(streams.dedupe_stream(streams.table_stream(spark, path, spark.read.parquet(path).schema), horizon_s=3600, late="10 minutes"), at)
    assert {(r["sha256"], r["n"]) for r in out.collect()} == {("a", 0), ("b", 10), ("a", 4000), ("c", 9000), ("a", 9500), ("z", 90_000)}
    left = spark.read.format("statestore").option("stateVarName", "last").load(f"{at}/state").collect()
    assert "a" not in {r["key"]["key"] for r in left}


class Counted:
    """One key's state and timers, and how often they were called."""

    def __init__(self):
        self.calls, self.timers, self.value, self.rows = 0, set(), None, []

    def getValueState(self, name, schema):  # noqa: N802
        return self

    def getListState(self, name, schema):  # noqa: N802
        return Counted.Rows(self)

    def __getattr__(self, name):
        def call(*args):
            self.calls += 1
            return {"get": lambda: self.value, "exists": lambda: self.value is not None, "update": lambda v: setattr(self, "value", v), "clear": lambda: setattr(self, "value", None),
                    "registerTimer": self.timers.add, "deleteTimer": self.timers.discard, "listTimers": lambda: iter(self.timers)}[name](*args)

        return call

    class Rows:
        def __init__(self, of):
            self.of = of

        def __getattr__(self, name):
            def call(*args):
                self.of.calls += 1
                rows = self.of.rows
                return {"get": lambda: iter(rows), "appendList": rows.extend, "put": lambda v: rows.__setitem__(slice(None), v), "clear": rows.clear}[name](*args)

            return call


def test_calls_to_the_state_go_with_keys(spark):
    """A key's hundred rows wait under one timer, and leave under it; a path's hundred observations take as few calls."""
    handle, p = Counted(), streams.OnceWithin(10)
    p.init(handle)
    clock = lambda ms: type("", (), {"getCurrentWatermarkInMs": lambda _: ms, "getExpiryTimeInMs": lambda _: min(handle.timers)})()
    list(p.handleInputRows(("k",), iter([Row(ms=1000 * i, row=str(i)) for i in range(100)]), clock(0)))
    assert handle.calls == 2 and handle.timers == {0}
    got = [r["row"] for r in p.handleExpiredTimer(("k",), clock(98_000), clock(98_000))]
    assert got == [str(i) for i in range(0, 98, 11)] and handle.calls <= 8 and handle.rows == [(99_000, "99")] and handle.value == (88_000,)
    handle.timers = {99_000}
    assert [r["row"] for r in p.handleExpiredTimer(("k",), clock(200_000), clock(0))] == ["99"] and handle.value is None and not handle.rows

    handle, p = Counted(), streams.StableFile(10)
    p.init(handle)
    seen = [Row(path="f", size=1, mtime=-9_000_000, at=1_000_000 * i) for i in range(100)]
    assert [(r["size"], r["at"]) for part in (seen[:50], seen[50:]) for r in p.handleInputRows(("f",), iter(part), clock(0))] == [(1, 2_000_000)]
    assert handle.calls <= 7 and handle.timers == {109_000} and handle.value == (1, 99, True, 99_000_000_000)


def test_a_release_takes_terms_from_texts_once(spark, tmp_path, monkeypatch):
    plans, learn = [], classify.learn

    def seen(decisions, terms, *rest):
        plans.append(learn(decisions, terms, *rest)._jdf.queryExecution().optimizedPlan().toString())
        return learn(decisions, terms, *rest)

    monkeypatch.setattr(classify, "learn", seen)
    pending = spark.createDataFrame([(1, "P/1", 7, "h", "Rechnung", "", "Zähler 4711 Abrechnung")], "doc_id long, path string, review_id long, source_sha256 string, document_type string, meta_text string, text string")
    paths, stored = spark.createDataFrame([], "path string"), spark.createDataFrame([], "path string, kind string, term string, n long")
    decisions = spark.createDataFrame([("P/1", "P/1", T0)], "path string, final_path string, decided_at timestamp")
    streams.release_into(pending, paths, spark.createDataFrame([], "name string, ord int"), stored, str(tmp_path / "r"))(decisions, 0)
    assert len(plans) == 1 and "regexp_extract_all" not in plans[0]
    assert streams.release_state(pending, paths, stored, str(tmp_path / "r"))["memory"].filter("kind = 'positive'").count() > 0
