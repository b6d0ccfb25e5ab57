"""Queries of the request cache, classification, taxonomy, job store, sources and streams, each with its SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from foliant.operators import cache, classify, jobs, taxonomy
from foliant.plans.inputs import frame, text
from foliant.sources import files, ledger
from foliant.streaming import streams

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str = "", **sources: str):
    """Registers an operator on named inputs; the oracle reads them under the same names."""

    def add(f):
        QUERIES[name] = lambda spark, sf_dir: f(**{k: frame(spark, sf_dir, s) for k, s in sources.items()})
        if oracle:
            ORACLES[name] = "WITH " + ", ".join(f"{k} AS ({text(s)})" for k, s in sources.items()) + (oracle if oracle.startswith(",") else " " + oracle)
        return f

    return add


# Request cache.
REQUESTS = """SELECT conv_id * 100 + turn AS request_id, role AS task, CASE WHEN turn % 2 = 0 THEN 'qwen3:27b' ELSE 'gemini/flash' END AS model, 'v1' AS prompt_version,
    sha2(concat('Betrag ', text), 256) AS user_prompt_hash, '' AS system_prompt_hash, CASE WHEN conv_id % 3 = 0 THEN md5(text) END AS image_sha256, concat('Betrag ', text) AS prompt, text AS raw_text, conv_id, turn FROM {conversations}"""
DUCK_REQUESTS = text(REQUESTS).replace("sha2(concat('Betrag ', text), 256)", "sha256('Betrag ' || text)")


def with_maps(r):
    return r.withColumn("source_hashes", F.create_map(F.lit("ocr"), F.md5("raw_text"), F.lit("docling"), F.lit("d"))).withColumn("options", F.create_map(F.lit("temperature"), F.lit("0")))


KEY = """'v2:' || sha256('{"image_sha256":' || CASE WHEN image_sha256 IS NULL THEN 'null' ELSE '"' || image_sha256 || '"' END || ',"model":"' || model || '","options":{"temperature":"0"},"prompt_version":"v1","schema":"llm_cache_v2","source_hashes":{"docling":"d","ocr":"' || md5(raw_text) || '"},"system_prompt_hash":"","task":"' || task || '","user_prompt_hash":"' || user_prompt_hash || '"}')"""
KEYED = f"r AS ({DUCK_REQUESTS}), k AS (SELECT *, {KEY} AS key FROM r), c AS (SELECT DISTINCT key AS hash_key, 'known ' || task AS result_text, timestamp '2024-01-01' AS created_at FROM k WHERE conv_id % 2 = 0)"


def keyed(spark, sf_dir):
    return cache.cache_key(with_maps(frame(spark, sf_dir, REQUESTS)))


def known(k):
    return k.filter("conv_id % 2 = 0").select(F.col("key").alias("hash_key"), F.concat(F.lit("known "), "task").alias("result_text"), F.lit("2024-01-01").cast("timestamp").alias("created_at")).distinct()


def cache_query(name: str, oracle: str, f) -> None:
    QUERIES[name] = lambda spark, d: f(keyed(spark, d))
    ORACLES[name] = f"WITH {KEYED} {oracle}"


cache_query("cch1_key", "SELECT request_id, key FROM k", lambda k: k.select("request_id", "key"))
cache_query("cch2_legacy_key", "SELECT request_id, md5(md5(raw_text) || ':' || model || ':v1') AS key FROM k WHERE raw_text <> ''", lambda k: k.select("request_id", cache.legacy_key(F.col("raw_text"), F.col("model"), F.col("prompt_version")).alias("key")).filter("key is not null"))
cache_query("cch3_lookup", "SELECT request_id, result_text AS result, result_text IS NOT NULL AS hit FROM k LEFT JOIN c ON key = hash_key", lambda k: cache.cache_lookup(k, known(k)).select("request_id", "result", "hit"))
cache_query("cch4_misses", "SELECT min(request_id) AS request_id, key FROM k WHERE key NOT IN (SELECT hash_key FROM c) GROUP BY key", lambda k: cache.cache_misses(k, known(k)).select("request_id", "key"))
cache_query(
    "cch5_upsert",
    "SELECT hash_key, CASE WHEN conv_id % 4 = 0 OR conv_id % 2 = 1 THEN 'new' ELSE 'known ' || task END AS result_text FROM (SELECT DISTINCT key AS hash_key, conv_id % 4 AS conv_id, task FROM k WHERE conv_id % 4 <> 3)",
    lambda k: cache.cache_upsert(known(k), k.filter("conv_id % 4 <> 2").select(F.col("key").alias("hash_key"), F.when(F.col("conv_id") % 4 == 3, "").otherwise("new").alias("result_text"), F.lit("2024-02-01").cast("timestamp").alias("created_at"))).select("hash_key", "result_text"),
)
QUERIES["cch6_infer"] = lambda spark, d: cache.infer(cache.cache_misses(keyed(spark, d), known(keyed(spark, d))))
ORACLES["cch6_infer"] = f"""WITH {KEYED} SELECT key, 'Answer: {{"document_type": "Rechnung", "confidence": ' || length(any_value(prompt)) % 101 || '}}' AS result, 1 AS attempts, NULL AS error FROM k WHERE key NOT IN (SELECT hash_key FROM c) GROUP BY key"""
ANSWERS = """SELECT conv_id * 100 + turn AS request_id, CASE turn % 4 WHEN 0 THEN concat('Hm {{"confidence": ', cast(length(text) AS string), ', "reason": "x"}} ok') WHEN 1 THEN 'nichts' WHEN 2 THEN '{{"score": "7.9"}}' ELSE '{{bad' END AS raw, turn FROM {conversations}"""
query("cch7_parse_answer", "SELECT request_id, CASE WHEN turn % 4 = 0 THEN 'x' END AS reason FROM a", a=ANSWERS)(lambda a: a.select("request_id", cache.parse_answer(F.col("raw"))["reason"].alias("reason")))
query("cch8_confidence", "SELECT request_id, CASE turn % 4 WHEN 0 THEN least(100, cast(regexp_extract(raw, ': (\\d+)', 1) AS int)) WHEN 2 THEN 7 ELSE 78 END AS confidence FROM a", a=ANSWERS)(
    lambda a: a.select("request_id", F.coalesce(cache.confidence(cache.parse_answer(F.col("raw"))), F.lit(78)).alias("confidence"))
)

# Taxonomy: region/nation/type.
PATHS = "SELECT DISTINCT concat(r_name, '/', n_name, '/', p_type) AS path FROM {region} JOIN {nation} ON n_regionkey = r_regionkey CROSS JOIN (SELECT DISTINCT p_type FROM {part}) AS t"
PERSONS = "SELECT r_name AS name, r_regionkey AS ord FROM {region}"
NEW_PATHS = "SELECT l_orderkey * 100 + l_partkey * 10000000 + l_linenumber AS ord, concat(CASE WHEN l_orderkey % 7 = 0 THEN 'Nobody' ELSE lower(r_name) END, ' / N', cast(l_suppkey % 30 AS string), CASE WHEN l_orderkey % 5 = 0 THEN '//' ELSE '' END) AS path FROM {lineitem} JOIN {region} ON l_linenumber % 5 = r_regionkey WHERE l_quantity > 0"
query("tax1_add_paths", """SELECT path, outcome, count(*) AS n FROM (SELECT path, CASE WHEN starts_with(path, 'Nobody') THEN 'unknown_person' WHEN row_number() OVER (PARTITION BY path ORDER BY ord) = 1 THEN 'added' ELSE 'duplicate' END AS outcome
    FROM (SELECT ord, CASE WHEN starts_with(path, 'Nobody') THEN '' ELSE '' END || upper(split_part(path, ' / ', 1)[1:1]) || CASE WHEN starts_with(path, 'Nobody') THEN 'obody' ELSE upper(split_part(path, ' / ', 1)[2:]) END || '/' || rtrim(split_part(path, ' / ', 2), '/') AS path FROM req)) GROUP BY ALL""", req=NEW_PATHS, paths=PATHS, persons=PERSONS)(
    lambda req, paths, persons: taxonomy.add_paths(req, paths, persons).groupBy("path", "outcome").agg(F.count("*").alias("n"))
)
CLOSURE = "SELECT DISTINCT split_part(path, '/', 1) AS path, 1 AS depth FROM paths UNION SELECT DISTINCT split_part(path, '/', 1) || '/' || split_part(path, '/', 2), 2 FROM paths UNION SELECT path, 3 FROM paths"
query("tax2_closure", CLOSURE, paths=PATHS)(taxonomy.path_closure)
query("tax3_at_depth", f"SELECT path FROM ({CLOSURE}) WHERE depth = 2", paths=PATHS)(lambda paths: taxonomy.paths_at_depth(paths, 2))
query("tax3_children", f"SELECT regexp_replace(path, '/[^/]*$', '') AS parent, string_agg(regexp_extract(path, '([^/]*)$', 1), ';' ORDER BY path) AS children FROM ({CLOSURE}) WHERE depth > 1 GROUP BY 1", paths=PATHS)(lambda paths: taxonomy.children(paths).withColumn("children", F.array_join("children", ";")))
TERMS = "SELECT p_partkey, concat(p_name, ', ', upper(p_name), '\n ', p_type, ',,', p_brand, ', ', lower(p_type)) AS terms FROM {part}"
query("tax4_clean_terms", "SELECT p_partkey, regexp_replace(split_part(terms, ',', 1), ' +', ' ') || ';' || trim(split_part(split_part(terms, chr(10), 2), ',', 1)) || ';' || trim(split_part(split_part(terms, ',,', 2), ',', 1)) AS terms FROM t", t=TERMS)(
    lambda t: t.select("p_partkey", F.array_join(taxonomy.clean_terms(F.col("terms")), ";").alias("terms"))
)
PART_PATHS = "SELECT p_partkey, concat('ASIA/', p_brand, '/', p_type) AS path, p_size FROM {part}"
BRAND = "SELECT DISTINCT concat('ASIA/', p_brand, '/', p_type) AS path FROM {part} WHERE p_size % 2 = 0"
query("tax5_prune", "SELECT p_partkey, path FROM rows_ WHERE path IN (SELECT path FROM paths)", rows_=PART_PATHS, paths=BRAND)(lambda rows_, paths: taxonomy.prune(rows_, paths).select("p_partkey", "path"))
query("tax6_rename", "SELECT p_partkey, CASE WHEN starts_with(path, 'ASIA/Brand#1/') THEN 'ASIA/Neu/' || path[14:] ELSE path END AS path FROM rows_", rows_=PART_PATHS)(lambda rows_: taxonomy.rename_prefix(rows_, "ASIA/Brand#1", "ASIA/Neu").select("p_partkey", "path"))
RENAMES = "SELECT DISTINCT concat('ASIA/', p_brand) AS old, concat('asia/', CASE WHEN p_partkey % 50 = 1 THEN 'brand#2' ELSE concat('X', cast(p_size AS string)) END) AS new FROM {part}"
query("tax6_clashes", "SELECT old, new, new = 'asia/brand#2' AND old <> 'ASIA/Brand#2' AS clash FROM ren", paths="SELECT DISTINCT concat('ASIA/', p_brand) AS path FROM {part}", ren=RENAMES)(lambda paths, ren: taxonomy.rename_clashes(paths, ren))
CUSTOMERS = "SELECT c_name AS name, c_custkey AS ord FROM {customer}"
OWN = "SELECT concat(lower(c_name), '/', CASE WHEN c_custkey % 2 = 0 THEN 'AUTO' ELSE 'schule' END) AS path FROM {customer}"
CUSTOMER_NAMES = "SELECT concat(CASE WHEN c_custkey % 9 = 0 THEN '?' ELSE ' ' END, c_name, '  ', CASE WHEN c_custkey % 4 = 0 THEN 'x' ELSE 'y' END) AS name FROM {customer}"
OWN = "SELECT concat(lower(c_name), ' ', CASE WHEN c_custkey % 3 = 0 THEN 'X' ELSE 'Y' END, '/', CASE WHEN c_custkey % 2 = 0 THEN 'AUTO' ELSE 'schule' END) AS path FROM {customer}"
TEMPLATED = """, t AS (SELECT regexp_replace(trim(name), ' +', ' ', 'g') AS name FROM persons), g AS (SELECT name, lower(name) AS low FROM t WHERE NOT contains(name, '?')),
    r AS (SELECT lower(split_part(path, '/', 1)) AS low, split_part(path, '/', 1) AS known FROM paths), n AS (SELECT DISTINCT coalesce(known, name) AS name FROM g LEFT JOIN r USING (low)),
    w AS (SELECT name AS path FROM n UNION ALL SELECT name || '/' || f FROM n CROSS JOIN (SELECT unnest(['Gesundheit', 'Finanzen', 'Versicherungen', 'Steuern', 'Arbeit', 'Schule', 'Wohnen', 'Auto', 'Verträge', 'Sonstiges']) AS f))
    SELECT path FROM w WHERE lower(path) NOT IN (SELECT lower(path) FROM paths UNION SELECT low FROM r)"""
query("tax7_template", TEMPLATED, persons=CUSTOMER_NAMES, paths=OWN)(taxonomy.apply_template)
query("tax7_rejected", "SELECT name, 'forbidden' AS problem FROM persons WHERE contains(name, '?')", persons=CUSTOMER_NAMES)(taxonomy.rejected_names)
NAMES = "SELECT p_partkey, CASE p_partkey % 8 WHEN 0 THEN concat(' ', p_name) WHEN 1 THEN '' WHEN 2 THEN concat(p_name, '.') WHEN 3 THEN concat('a\tb', p_name) WHEN 4 THEN concat(p_name, ':') WHEN 5 THEN 'con' WHEN 6 THEN concat(p_name, '  x') ELSE p_name END AS name FROM {part}"
query("tax8_validate_names", "SELECT p_partkey, name, CASE p_partkey % 8 WHEN 0 THEN 'outer_space' WHEN 1 THEN 'empty' WHEN 2 THEN 'inner_space_or_dot' WHEN 3 THEN 'inner_space_or_dot' WHEN 4 THEN 'forbidden' WHEN 5 THEN 'reserved' WHEN 6 THEN 'inner_space_or_dot' END AS problem FROM n", n=NAMES)(lambda n: taxonomy.validate_names(n))
PENDING = "SELECT DISTINCT concat('D', cast(c_custkey AS string)) AS old, concat('D', cast(c_custkey + c_custkey % 3 AS string), CASE WHEN c_custkey % 2 = 0 THEN '/neu' ELSE '' END) AS new FROM {customer}"
DIRS = "SELECT concat('D', cast(c_custkey AS string)) AS path FROM {customer} WHERE c_custkey % 5 <> 0"
query("tax9_move_plan", "SELECT old, new, CASE WHEN old = new THEN 'same' WHEN old NOT IN (SELECT path FROM dirs) THEN 'missing' WHEN new IN (SELECT path FROM dirs) THEN 'conflict' ELSE 'move' END AS action, 1 AS depth FROM pend", pend=PENDING, dirs=DIRS)(lambda pend, dirs: taxonomy.move_plan(pend, dirs))
FOLDERS = "SELECT concat('ASIA/', p_brand, '/', p_type) AS path, CASE WHEN min(p_partkey) % 3 = 0 THEN '' ELSE concat('id', cast(min(p_partkey) AS string)) END AS folder_id FROM {part} WHERE p_partkey % 2 = 0 GROUP BY p_brand, p_type"
ALL_BRANDS = "SELECT DISTINCT concat('ASIA/', p_brand, '/', p_type) AS path FROM {part}"
REMOTE = "SELECT concat('ASIA/', p_brand) AS path, concat('e', cast(p_partkey AS string)) AS entry_id, p_size % 2 = 0 AS trashed FROM {part} WHERE p_partkey % 11 = 0"
query("syn1_preview", "SELECT count(*) AS total, count(folder_id) AS mapped, count(*) - count(folder_id) AS missing FROM paths LEFT JOIN (SELECT * FROM fm WHERE folder_id <> '') USING (path)", paths=ALL_BRANDS, fm=FOLDERS)(lambda paths, fm: taxonomy.sync_preview(paths, fm))
query("syn2_folder_plan", f"""SELECT path, depth, CASE WHEN coalesce(folder_id, '') <> '' THEN 'trusted' WHEN f IS NOT NULL THEN 'found' ELSE 'create' END AS action, CASE WHEN coalesce(folder_id, '') <> '' THEN folder_id ELSE f END AS folder_id,
    coalesce(folder_id, '') = '' AND f IS NOT NULL AND n > 1 AS conflict FROM ({CLOSURE}) LEFT JOIN fm USING (path) LEFT JOIN (SELECT path, min(entry_id) AS f, count(*) AS n FROM remote WHERE NOT trashed GROUP BY 1) USING (path)""", paths=ALL_BRANDS, fm=FOLDERS, remote=REMOTE)(lambda paths, fm, remote: taxonomy.folder_plan(paths, fm, remote))
ARTIFACTS = "SELECT o_orderkey AS doc_id, concat('f', cast(o_custkey % 50 AS string)) AS folder, concat('d', cast(o_orderkey AS string), '.', k) AS name, k AS kind, o_orderkey % 4 = 0 AS office FROM {orders} CROSS JOIN (SELECT 'pdf' AS k UNION ALL SELECT 'docx' UNION ALL SELECT 'json') AS kinds"
REMOTE_FILES = "SELECT concat('f', cast(o_custkey % 50 AS string)) AS folder, concat('d', cast(o_orderkey AS string), '.pdf') AS name, concat('e', cast(o_orderkey AS string)) AS entry_id FROM {orders} WHERE o_orderkey % 3 = 0"
query("syn3_upload_plan", "SELECT doc_id, folder, name, CASE WHEN entry_id IS NULL THEN 'create' ELSE 'update' END AS action, entry_id FROM a LEFT JOIN remote USING (folder, name) WHERE CASE WHEN office THEN kind IN ('docx', 'json') ELSE kind IN ('pdf', 'json') END", a=ARTIFACTS, remote=REMOTE_FILES)(lambda a, remote: taxonomy.upload_plan(a, remote, ["pdf", "json"]))

# Classification.
CONTEXTS = """SELECT concat('ASIA/', p_brand, '/Ordner ', p_type) AS path, p_brand AS brand, p_type AS kind, min(p_partkey) AS ord, CASE WHEN p_type = 'ECONOMY' THEN 'vehicle' WHEN p_type = 'SMALL' THEN 'health' ELSE '' END AS object_type, min(p_name) AS alias FROM {part} GROUP BY p_brand, p_type"""
PART_DOCS = "SELECT p_partkey AS doc_id, concat(p_name, ' Service Labor ', p_brand, '. ', p_type, ' Ordner') AS haystack, p_type AS document_type, concat(p_name, ', ', p_brand, '_', p_type) AS meta_text, concat('Kennzeichen AB-CD 12', cast(p_size AS string), ' ', p_name, ' ', p_name, ' und ', p_type) AS text FROM {part}"


def contexts_of(c):
    return c.select("path", "ord", "object_type", F.array("alias").alias("aliases"), F.array("brand", "kind").alias("keywords"), F.lit("Notiz").alias("notes"))


HITS = """h AS (SELECT d.doc_id, c.path, c.ord, lower(d.haystack) AS hay, 5 * cast(contains(lower(d.haystack), lower(alias)) AS int) + 4 * cast(contains(lower(d.haystack), lower(brand)) AS int) + 4 * cast(contains(lower(d.haystack), lower(kind)) AS int) AS strong,
        CASE object_type WHEN 'vehicle' THEN cast(contains(lower(d.haystack), 'service') AS int) + len(list_filter(['auto', 'fahrzeug', 'kfz', 'inspektion', 'hu', 'tuev', 'tuv', 'werkstatt'], lambda t: contains(lower(d.haystack), t)))
            WHEN 'health' THEN len(list_filter(['arzt', 'praxis', 'befund', 'rezept', 'patient', 'labor'], lambda t: contains(lower(d.haystack), t))) ELSE 0 END AS hints,
        2 * len(list_filter(list_filter(string_split(c.path, '/'), lambda p: length(p) >= 4), lambda p: contains(lower(d.haystack), lower(p)))) AS parts FROM docs AS d CROSS JOIN (SELECT * FROM ctx WHERE path IN (SELECT path FROM known)) AS c),
    s AS (SELECT doc_id, path, ord, strong + hints + CASE WHEN strong > 0 THEN parts ELSE 0 END AS raw_score FROM h WHERE strong + hints > 0),
    p AS (SELECT doc_id, path, raw_score, least(98, raw_score * 8) AS score, row_number() OVER (PARTITION BY doc_id ORDER BY raw_score DESC, ord) AS place FROM s)"""
query("cls2_context_hits", "SELECT d.doc_id, c.path, kind_, 1 AS n FROM docs AS d JOIN (SELECT path, 'aliases' AS kind_, lower(alias) AS t FROM ctx UNION ALL SELECT path, 'brand', lower(brand) FROM ctx) AS c ON contains(lower(haystack), t)", docs=PART_DOCS, ctx=CONTEXTS)(
    lambda docs, ctx: classify.context_hits(docs, contexts_of(ctx).withColumn("keywords", F.array(F.get(F.col("keywords"), F.lit(0))))).filter("kind in ('aliases', 'keywords')").select("doc_id", "path", F.when(F.col("kind") == "keywords", "brand").otherwise(F.col("kind")).alias("kind_"), F.lit(1).alias("n"))
)
#: Paths that the registry knows: those of the contexts with a part of a size above 5.
KNOWN = "SELECT DISTINCT concat('ASIA/', p_brand, '/Ordner ', p_type) AS path FROM {part} WHERE p_size > 5"
SHOWN = """SELECT doc_id, p.path, raw_score, score, place, CASE WHEN contains(hay, lower(alias)) OR contains(hay, lower(brand)) OR contains(hay, lower(kind)) THEN
    list_aggregate((list_filter([CASE WHEN contains(hay, lower(alias)) THEN 'aliases:' || alias END, CASE WHEN contains(hay, lower(brand)) THEN 'keywords:' || brand END, CASE WHEN contains(hay, lower(kind)) THEN 'keywords:' || kind END], lambda x: x IS NOT NULL)
    || list_transform(list_filter(string_split(p.path, '/'), lambda x: length(x) >= 4 AND contains(hay, lower(x))), lambda x: 'path:' || x))[1:8], 'string_agg', ';') ELSE '' END AS evidence FROM p JOIN ctx ON ctx.path = p.path JOIN (SELECT doc_id, lower(haystack) AS hay FROM docs) USING (doc_id)"""
query("cls4_rank_contexts", f", {HITS} {SHOWN}", docs=PART_DOCS, ctx=CONTEXTS, known=KNOWN)(lambda docs, ctx, known: classify.rank_contexts(docs, contexts_of(ctx), known).withColumn("evidence", F.array_join("evidence", ";")))
query("cls5_best_context", f", {HITS} SELECT doc_id, path, score FROM (SELECT *, lead(score, 1, 0) OVER (PARTITION BY doc_id ORDER BY place) AS nxt FROM p) WHERE place = 1 AND score >= 40 AND score - nxt >= 16", docs=PART_DOCS, ctx=CONTEXTS, known=KNOWN)(lambda docs, ctx, known: classify.best_context(classify.rank_contexts(docs, contexts_of(ctx), known)).select("doc_id", "path", "score"))
query("cls1_norm_text", "SELECT doc_id, md5(regexp_replace(replace(replace(replace(replace(lower(text), 'ü', 'ue'), 'ä', 'ae'), 'ö', 'oe'), 'ß', 'ss'), '\\s+', ' ', 'g')) AS norm FROM d", d="SELECT doc_id, text FROM {documents}")(
    lambda d: d.select("doc_id", F.md5(classify.folded(F.col("text"))).alias("norm"))
)
STOPS = """aber', 'alle', 'auch', 'auf', 'aus', 'bei', 'beim', 'bis', 'das', 'dem', 'den', 'der', 'des', 'die', 'ein', 'eine', 'einer', 'eines', 'fuer', 'für', 'ist',
    'mit', 'nach', 'nicht', 'oder', 'und', 'vom', 'von', 'zum', 'zur', 'rechnung', 'datum', 'seite', 'betrag', 'dokument"""
LEARN = rf"""x AS (SELECT doc_id, lower(regexp_replace(regexp_replace(meta_text, '[,;_/|\n]+', ' ', 'g') || ' ' || left(text, 5000), '\s+', ' ', 'g')) AS s FROM docs),
    y AS (SELECT doc_id, flatten([regexp_extract_all(s, '\b[a-z]{{1,3}}[-\s]?[a-z]{{1,3}}[-\s]?\d{{2,5}}\b'), regexp_extract_all(s, '\b(?:kundennummer|vertragsnummer|police|kennzeichen|iban|rechnung)\s*[:#]?\s*[a-z0-9 -]{{3,24}}\b'), regexp_extract_all(s, '\b[a-z0-9][a-z0-9-]{{3,}}\b')]) AS f FROM x),
    z AS (SELECT doc_id, trim(f[i], ' .,:;()[]{{}}') AS term, i FROM (SELECT doc_id, f, unnest(range(1, len(f) + 1)) AS i FROM y)),
    t AS (SELECT doc_id, term, count(*) AS n, min(i) AS i FROM z WHERE length(term) >= 4 AND term NOT IN ('{STOPS}') AND NOT regexp_full_match(term, '\d+') GROUP BY 1, 2),
    terms AS (SELECT doc_id, term, n, row_number() OVER (PARTITION BY doc_id ORDER BY regexp_matches(term, '\d') DESC, n DESC, length(term) DESC, i) AS place FROM t)"""
query("cls6_learning_terms", f", {LEARN} SELECT * FROM terms WHERE place <= 80", docs=PART_DOCS)(classify.learning_terms)
DECISIONS = "SELECT p_partkey AS decision_id, p_partkey AS doc_id, concat('ASIA/', p_brand) AS chosen_path, CASE WHEN p_size % 3 = 0 THEN '' ELSE p_type END AS document_type, concat('ASIA/Brand#', cast(p_size % 7 AS string)) AS proposed_path, cast('2024-01-01' AS timestamp) AS created_at FROM {part} WHERE p_size % 2 = 0"
STORED = "SELECT DISTINCT concat('ASIA/', p_brand) AS path, 'positive' AS kind, lower(p_name) AS term, 3 AS n FROM {part} WHERE p_size > 10"
LEARNED = f""", {LEARN}, m AS (SELECT path, kind, term, cast(least(sum(n), 50) AS bigint) AS n FROM (SELECT chosen_path AS path, 'positive' AS kind, term, 1 AS n FROM dec JOIN terms USING (doc_id) WHERE place <= 80 UNION ALL SELECT chosen_path, 'type', lower(document_type), 2 FROM dec WHERE document_type <> ''
    UNION ALL SELECT proposed_path, 'negative', term, 1 FROM dec JOIN terms USING (doc_id) WHERE place <= 30 AND proposed_path <> chosen_path UNION ALL SELECT * FROM stored) GROUP BY ALL)"""


def learned(docs, dec, stored):
    return learned_from(classify.learning_terms(docs), dec, stored)


def learned_from(terms, dec, stored):
    return classify.learn(dec, terms, dec.select("decision_id", F.col("proposed_path").alias("path")), stored)


query("cls7_learn", f"{LEARNED} SELECT * FROM m", docs=PART_DOCS, dec=DECISIONS, stored=STORED)(learned)
query("cls7_path_stats", "SELECT chosen_path AS path, count(*) AS confirmed_count FROM dec GROUP BY 1", dec=DECISIONS)(lambda dec: classify.path_stats(dec).drop("last_confirmed_at"))
query("cls8_trim_memory", f"{LEARNED} SELECT path, kind, term, n FROM (SELECT *, row_number() OVER (PARTITION BY path, kind ORDER BY n DESC, term) AS p FROM m) WHERE p <= 120", docs=PART_DOCS, dec=DECISIONS, stored=STORED)(lambda **x: classify.trim_memory(learned(**x)))
#: Decision by decision: counters of a path and kind, the most frequent 120 after each; ord is their place then.
REPLAYED = f"""WITH RECURSIVE docs AS ({text(PART_DOCS)}), dec AS ({text(DECISIONS)}), stored AS ({text(STORED)}), {LEARN.lstrip(", ")},
    ad AS (SELECT chosen_path AS path, 'positive' AS kind, decision_id, place, term, 1 AS n FROM dec JOIN terms USING (doc_id) WHERE place <= 80 UNION ALL SELECT chosen_path, 'type', decision_id, 0, lower(document_type), 2 FROM dec WHERE document_type <> ''
        UNION ALL SELECT proposed_path, 'negative', decision_id, place, term, 1 FROM dec JOIN terms USING (doc_id) WHERE place <= 30 AND proposed_path <> chosen_path),
    ix AS (SELECT *, dense_rank() OVER (PARTITION BY path, kind ORDER BY decision_id) AS i FROM ad), la AS (SELECT path, kind, max(i) AS m FROM ix GROUP BY 1, 2),
    w AS (SELECT path, kind, cast(0 AS bigint) AS i, term, cast(n AS bigint) AS n, row_number() OVER (PARTITION BY path, kind ORDER BY n DESC, term) AS ord FROM (SELECT path, kind, term, n FROM stored UNION ALL SELECT path, kind, NULL, 0 FROM la)
        UNION ALL SELECT path, kind, i, term, n, ord FROM (SELECT *, row_number() OVER (PARTITION BY path, kind ORDER BY n DESC, o) AS ord FROM (SELECT path, kind, i, term, cast(least(50, sum(n)) AS bigint) AS n, min(o) AS o FROM (
            SELECT w.path, w.kind, w.i + 1 AS i, term, n, ord AS o FROM w JOIN la ON la.path = w.path AND la.kind = w.kind WHERE w.i < m AND term IS NOT NULL
            UNION ALL SELECT ix.path, ix.kind, ix.i, ix.term, ix.n, 100000 + ix.place FROM ix JOIN (SELECT DISTINCT path, kind, i FROM w) AS v ON ix.path = v.path AND ix.kind = v.kind AND ix.i = v.i + 1) GROUP BY 1, 2, 3, 4)) WHERE ord <= 120)
    SELECT path, kind, term, n FROM w LEFT JOIN la USING (path, kind) WHERE i = coalesce(m, 0) AND term IS NOT NULL AND ord <= 120"""
QUERIES["cls8_replay"] = lambda spark, d: _replay(*(frame(spark, d, x) for x in (PART_DOCS, DECISIONS, STORED)))
ORACLES["cls8_replay"] = REPLAYED


def _replay(docs, dec, stored):
    return classify.replay(dec, classify.learning_terms(docs), dec.select("decision_id", F.col("proposed_path").alias("path"), F.lit(0).alias("ord")), stored)


query("cls8_trim_decisions", "SELECT decision_id FROM dec ORDER BY created_at DESC, decision_id DESC LIMIT 1000", dec=DECISIONS)(lambda dec: classify.trim_decisions(dec).select("decision_id"))
SCORED = f"""{LEARNED}, hit AS (SELECT doc_id, path, kind, term, n, row_number() OVER (PARTITION BY doc_id, path, kind ORDER BY term) AS a FROM (SELECT doc_id, term FROM terms WHERE place <= 120) JOIN (SELECT path, kind, term, n FROM m WHERE kind <> 'type') USING (term)),
    g AS (SELECT doc_id, path, sum(CASE WHEN kind = 'positive' AND a <= 8 THEN least(n, 6) * 6 WHEN kind = 'negative' AND a <= 5 THEN -least(n, 5) * 5 ELSE 0 END) AS gain, count(*) FILTER (WHERE kind = 'positive') AS pos FROM hit GROUP BY 1, 2),
    sc AS (SELECT g.doc_id, g.path, least((SELECT count(*) FROM dec WHERE chosen_path = g.path) * 3, 18) + gain + coalesce((SELECT least(n, 6) * 5 FROM m WHERE m.path = g.path AND m.kind = 'type' AND m.term = lower(d.document_type)), 0) AS raw FROM g JOIN docs AS d USING (doc_id) WHERE pos > 0),
    mc AS (SELECT doc_id, path, cast(least(raw, 98) AS bigint) AS score, row_number() OVER (PARTITION BY doc_id ORDER BY least(raw, 98) DESC, path) AS place FROM sc WHERE raw >= 18)"""


#: The positive hits that count, as evidence.
SAID = "(SELECT doc_id, path, string_agg(term, ';' ORDER BY term) AS evidence FROM hit WHERE kind = 'positive' AND a <= 8 GROUP BY 1, 2)"


def memory_of(docs, dec, stored):
    """The terms are extracted once: the first 120 for looking up, of these the first 80 for learning."""
    terms = classify.learning_terms(docs, 120)
    return classify.memory_candidates(terms, docs, learned_from(terms.filter("place <= 80"), dec, stored), classify.path_stats(dec))


query("cls9_memory_candidates", f"{SCORED} SELECT mc.*, evidence FROM mc JOIN {SAID} USING (doc_id, path) WHERE place <= 5", docs=PART_DOCS, dec=DECISIONS, stored=STORED)(lambda **x: memory_of(**x).select("doc_id", "path", F.col("score").cast("long").alias("score"), "place", F.array_join("evidence", ";").alias("evidence")))
CANDIDATES = "SELECT l_orderkey AS doc_id, concat(CASE WHEN l_suppkey % 2 = 0 THEN 'asia' ELSE 'ASIA' END, '/brand#', cast(l_partkey % 6 AS string)) AS path, cast(l_quantity * 2 AS int) AS score, concat('r', cast(l_linenumber AS string)) AS reason, cast(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS int) AS ord, concat('e', cast(l_suppkey AS string)) AS e FROM {lineitem}"
BRANDS = "SELECT DISTINCT concat('ASIA/', p_brand) AS path FROM {part}"
MERGED = ", k AS (SELECT c.doc_id, coalesce(b.path, c.path) AS path, b.path IS NULL AS is_new, score, ord, reason, e FROM cand AS c LEFT JOIN paths AS b ON lower(b.path) = lower(c.path)), mg AS (SELECT doc_id, path, max(score) AS score, bool_or(is_new) AS is_new, min(ord) AS f FROM k GROUP BY 1, 2), mp AS (SELECT doc_id, path, mg.score, is_new, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, f) AS place FROM mg)"


#: What stands: from the first of the highest scores on.
EVIDENCE = """ev AS (SELECT doc_id, path, e, min(ord) AS o FROM (SELECT k.*, z.o FROM k JOIN (SELECT k.doc_id, k.path, min(ord) AS o FROM k JOIN mp ON mp.doc_id = k.doc_id AND mp.path = k.path AND mp.score = k.score GROUP BY 1, 2) AS z USING (doc_id, path) WHERE k.ord >= z.o) GROUP BY 1, 2, 3),
    es AS (SELECT doc_id, path, array_to_string(list(e ORDER BY o)[1:8], ';') AS evidence, min(o) AS ord FROM ev GROUP BY 1, 2)"""


def merged_of(cand, paths):
    return classify.merge_candidates(cand.withColumn("evidence", F.array("e")), paths)


query("cls10_merge_candidates", f"{MERGED}, {EVIDENCE} SELECT mp.*, evidence, reason FROM mp JOIN es USING (doc_id, path) JOIN k USING (doc_id, path, ord)", cand=CANDIDATES, paths=BRANDS)(lambda cand, paths: merged_of(cand, paths).withColumn("evidence", F.array_join("evidence", ";")))
query("cls11_auto_accept", f"{MERGED} SELECT doc_id, path, score FROM (SELECT *, lead(score, 1, 0) OVER (PARTITION BY doc_id ORDER BY place) AS nxt FROM mp) WHERE place = 1 AND score >= 86 AND score - nxt >= 10 AND NOT is_new", cand=CANDIDATES, paths=BRANDS)(lambda cand, paths: classify.auto_accept(merged_of(cand, paths)).select("doc_id", "path", "score"))
MODEL_ANSWERS = "SELECT o_orderkey AS doc_id, CASE o_orderkey % 6 WHEN 0 THEN 'asia/brand#1' WHEN 1 THEN 'Europe' WHEN 2 THEN 'Nobody/x' WHEN 3 THEN 'asia/a/b/c/d/e' WHEN 4 THEN 'ASIA' ELSE '' END AS raw_path, cast(o_custkey % 100 AS int) AS confidence FROM {orders}"
ANSWERED = "SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN 'ASIA/Brand#1' WHEN 1 THEN 'EUROPE/Sonstiges' WHEN 2 THEN 'AFRICA/x' WHEN 3 THEN 'ASIA/a/b/c' WHEN 4 THEN 'ASIA/Sonstiges' ELSE 'AFRICA/Sonstiges' END AS path, doc_id % 6 <> 0 AS is_new, CASE WHEN doc_id % 6 = 0 THEN confidence ELSE 52 END AS score FROM ans"
query("cls12_normalize_answer", ANSWERED, ans=MODEL_ANSWERS, paths=BRANDS, persons="SELECT CASE WHEN r_regionkey = 3 THEN 'EUROPE' ELSE r_name END AS name, r_regionkey AS ord FROM {region}")(lambda ans, paths, persons: classify.normalize_answer(ans, paths, persons))


def model_answer(prompts):
    """Stand-in for a model: an answer that depends on the number in the prompt; every seventh is no JSON."""
    paths = ["asia/brand#1", "Europe", "Nobody/x", "asia/a/b/c/d/e", "ASIA", ""]
    return prompts.map(lambda p: "nichts" if int(p[4:]) % 7 == 0 else f'So: {{"recommended_path": "{paths[int(p[4:]) % 6]}", "confidence": {int(p[4:]) % 100}, "reason": "r{int(p[4:]) % 3}"}}')


def asked(left):
    answers = cache.infer(left.select(F.col("doc_id").cast("string").alias("key"), F.concat(F.lit("doc "), F.col("doc_id").cast("string")).alias("prompt")), model_answer)
    parsed = cache.parse_answer(F.col("result"))
    return answers.select(F.col("key").cast("long").alias("doc_id"), parsed.alias("p")).filter("p is not null").select("doc_id", F.col("p.recommended_path").alias("raw_path"), cache.confidence(F.col("p")).alias("confidence"), F.col("p.reason").alias("why"))


def cascade(docs, dec, stored, ctx, paths, persons, known):
    got = classify.classify(docs, classify.rank_contexts(docs, contexts_of(ctx), known), memory_of(docs, dec, stored), paths, persons, asked)
    return got.withColumns({"evidence": F.array_join("evidence", ";"), "candidates": F.array_join(F.transform("candidates", lambda c: F.concat_ws("=", c["path"], c["score"].cast("string"))), ";")})


PEOPLE = "SELECT CASE WHEN r_regionkey = 3 THEN 'EUROPE' ELSE r_name END AS name, r_regionkey AS ord FROM {region}"
#: The registry's paths: brands, and those of the contexts that it knows.
ALL_PATHS = f"{BRANDS} UNION {KNOWN}"
DEPTH = "length(path) - length(replace(path, '/', ''))"
CASCADE = f""", {HITS}{SCORED}, sh AS ({SHOWN}),
    cm AS (SELECT doc_id, path, score, place AS o, 'context' AS reason, evidence FROM sh UNION ALL SELECT mc.doc_id, mc.path, mc.score, 1000000 + place, 'memory', evidence FROM mc JOIN {SAID} USING (doc_id, path) WHERE place <= 5),
    mg AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, {DEPTH} DESC, o) AS spot, path NOT IN (SELECT path FROM paths) AS is_new FROM cm),
    b1 AS (SELECT doc_id, path, false AS is_new, 'context_match' AS reason, score AS confidence, evidence FROM (SELECT *, lead(score, 1, 0) OVER (PARTITION BY doc_id ORDER BY place) AS nxt FROM sh) WHERE place = 1 AND score >= 40 AND score - nxt >= 16),
    b2 AS (SELECT doc_id, path, is_new, reason, score, evidence FROM (SELECT *, lead(score, 1, 0) OVER (PARTITION BY doc_id ORDER BY spot) AS nxt FROM mg) WHERE spot = 1 AND score >= 86 AND score - nxt >= 10 AND NOT is_new AND doc_id NOT IN (SELECT doc_id FROM b1)),
    ans AS (SELECT doc_id, cast(doc_id % 100 AS int) AS confidence FROM docs WHERE doc_id % 7 <> 0 AND doc_id NOT IN (SELECT doc_id FROM b1 UNION SELECT doc_id FROM b2)), said AS ({ANSWERED}),
    b3 AS (SELECT doc_id, path, is_new, 'llm' AS reason, score, '' FROM said),
    b4 AS (SELECT doc_id, path, is_new, 'fallback', score, evidence FROM mg WHERE spot = 1 AND doc_id NOT IN (SELECT doc_id FROM b1 UNION SELECT doc_id FROM b2 UNION SELECT doc_id FROM b3)),
    some_ AS (SELECT * FROM b1 UNION ALL SELECT * FROM b2 UNION ALL SELECT * FROM b3 UNION ALL SELECT * FROM b4),
    tk AS (SELECT * FROM some_ UNION ALL SELECT doc_id, 'Sonstiges', true, 'fallback', 0, '' FROM docs WHERE doc_id NOT IN (SELECT doc_id FROM some_)),
    wi AS (SELECT doc_id, path, max(score) AS score, min(o) AS o FROM (SELECT doc_id, path, score, spot AS o FROM mg UNION ALL SELECT doc_id, path, score, -1 FROM said) GROUP BY 1, 2),
    pl AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, {DEPTH} DESC, o) AS spot FROM wi),
    li AS (SELECT doc_id, list(path || '=' || score ORDER BY spot) AS c FROM pl GROUP BY 1)
    SELECT tk.*, coalesce(array_to_string(CASE WHEN reason = 'context_match' THEN c ELSE c[1:5] END, ';'), '') AS candidates FROM tk LEFT JOIN li USING (doc_id)"""
query("cls13_cascade", CASCADE, known=KNOWN, docs=PART_DOCS, dec=DECISIONS, stored=STORED, ctx=CONTEXTS, paths=ALL_PATHS, persons=PEOPLE)(lambda **x: cascade(**x))
query("cls14_needs_review", f"{MERGED} SELECT r.doc_id, confidence, is_new, NOT is_new AND (confidence < 60 OR coalesce(top < 85 AND top - second <= 8, false)) AS review FROM res AS r LEFT JOIN (SELECT doc_id, max(score) FILTER (WHERE place = 1) AS top, max(score) FILTER (WHERE place = 2) AS second FROM mp GROUP BY 1) USING (doc_id)", cand=CANDIDATES, paths=BRANDS, res="SELECT o_orderkey AS doc_id, cast(o_custkey % 100 AS int) AS confidence, o_orderkey % 5 = 0 AS is_new FROM {orders}")(
    lambda cand, paths, res: classify.needs_review(res, merged_of(cand, paths))
)
query("cls15_normalize_target", "SELECT doc_id, upper(split_part(path, '/', 1)) || path[5:] AS path, 'ASIA' || path[5:] NOT IN (SELECT path FROM paths) AS is_new FROM t", t="SELECT p_partkey AS doc_id, concat('asia/', p_brand, CASE WHEN p_size % 2 = 0 THEN '/x' ELSE '' END) AS path FROM {part}", paths=BRANDS, persons=PERSONS)(lambda t, paths, persons: classify.normalize_target(t, paths, persons))
KINDS = "SELECT o_orderkey AS doc_id, CASE o_orderkey % 8 WHEN 0 THEN 'Entgeltnachweis 3' WHEN 1 THEN 'Quittung' WHEN 2 THEN 'ARZTBRIEF' WHEN 3 THEN 'lohnsteuer' WHEN 4 THEN 'Police A' WHEN 5 THEN 'mein vertrag?' WHEN 6 THEN ' ' ELSE 'gehaltsabrechnung' END AS k, concat('ASIA/', 'B', cast(o_custkey % 20 AS string)) AS path FROM {orders}"
TYPE = "CASE doc_id % 8 WHEN 0 THEN 'Lohnabrechnung' WHEN 1 THEN 'Rechnung' WHEN 2 THEN 'Befund' WHEN 3 THEN 'Lohnsteuerbescheinigung' WHEN 4 THEN 'Versicherungspolice' WHEN 5 THEN 'Mein Vertrag' WHEN 6 THEN '' ELSE 'Lohnabrechnung' END"
query("cls16_canonical_type", f"SELECT doc_id, {TYPE} AS type FROM d", d=KINDS)(lambda d: d.select("doc_id", classify.canonical_type(F.col("k")).alias("type")))
STORED_FILES = "SELECT concat('ASIA/B', cast(c_custkey % 20 AS string), CASE WHEN c_custkey % 3 = 0 THEN '/alt' ELSE '' END) AS path, concat(CASE c_custkey % 4 WHEN 0 THEN 'Rechnung_' WHEN 1 THEN 'x_Befund-' ELSE 'y' END, cast(c_custkey AS string), CASE WHEN c_custkey % 5 = 0 THEN '.txt' ELSE '.PDF' END) AS name, CASE WHEN c_custkey % 7 = 0 THEN 'alte Quittung' END AS subject, cast(NULL AS string) AS keywords FROM {customer}"
FITS = "(type = 'Rechnung' AND (contains(lower(name), 'rechnung') OR contains(coalesce(lower(subject), ''), 'quittung')) OR type = 'Befund' AND contains(lower(name), 'befund'))"
COUNTED = f"ty AS (SELECT doc_id, path, {TYPE} AS type FROM d), n AS (SELECT path, type, (SELECT count(*) FROM idx WHERE (idx.path = u.path OR starts_with(idx.path, u.path || '/')) AND ends_with(lower(name), '.pdf') AND {FITS}) AS n FROM (SELECT DISTINCT path, type FROM ty WHERE type <> '') AS u)"
query("cls17_count_by_type", f", {COUNTED} SELECT * FROM n", d=KINDS, idx=STORED_FILES)(lambda d, idx: classify.count_by_type(d.withColumn("type", classify.canonical_type(F.col("k"))).filter("type <> ''"), idx))
query("cls18_consolidate", f", {COUNTED} SELECT NULL AS name, path AS old_path, path || '/' || type AS new_path, doc_id FROM ty JOIN n USING (path, type) WHERE n > 0 UNION ALL SELECT name, idx.path, idx.path || '/' || type, NULL FROM n JOIN idx USING (path) WHERE n > 0 AND ends_with(lower(name), '.pdf') AND {FITS}", d=KINDS, idx=STORED_FILES)(lambda d, idx: classify.consolidate(d.withColumnRenamed("k", "document_type"), idx))
FINAL = "SELECT o_orderkey AS doc_id, concat('doc_', cast(o_orderkey AS string)) AS final_name FROM {orders}"
FILES = "SELECT concat('doc_', cast(o_orderkey AS string), CASE o_orderkey % 3 WHEN 0 THEN '.pdf' WHEN 1 THEN '.json' ELSE '_x.TXT' END) AS name FROM {orders}"
query("cls19_artifacts", "SELECT doc_id, name FROM fin JOIN f ON starts_with(name, final_name) WHERE NOT ends_with(name, '.json')", fin=FINAL, f=FILES)(lambda fin, f: classify.artifacts_for(fin, f))
query("tax5_prune_contexts", "SELECT path, alias FROM ctx WHERE path IN (SELECT path FROM known)", ctx=CONTEXTS, known=KNOWN)(lambda ctx, known: taxonomy.prune_contexts(contexts_of(ctx), known).select("path", F.array_join("aliases", ";").alias("alias")))
#: Contexts with and without aliases, type and notes; some say nothing.
BRAND_CONTEXTS = """SELECT concat('ASIA/', p_brand) AS path, CASE WHEN min(p_partkey) % 2 = 0 THEN array(min(p_name), min(p_type)) END AS aliases, CASE WHEN min(p_partkey) % 3 = 0 THEN array(p_brand) END AS keywords,
    CASE WHEN min(p_partkey) % 5 = 0 THEN 'vehicle' ELSE '' END AS object_type, CASE WHEN min(p_partkey) % 7 = 0 THEN concat('  Notiz \n', repeat('lang ', 50)) END AS notes FROM {part} GROUP BY p_brand"""
CONTEXT_DUCK = text(BRAND_CONTEXTS).replace("array(", "list_value(")
TOLD = """ln AS (SELECT path, '- ' || path || ': ' || s AS line FROM (SELECT path, concat_ws('; ', CASE WHEN object_type <> '' THEN 'Typ=' || object_type END, 'Aliase=' || array_to_string(aliases, ', '), 'Stichworte=' || array_to_string(keywords, ', '),
    'Notiz=' || trim(left(regexp_replace(trim(notes, E' \\n'), '\\s+', ' ', 'g'), 220), '')) AS s FROM ctx) WHERE s <> '' ORDER BY path LIMIT 80)"""
PROMPT = f"""WITH docs AS ({text(PART_DOCS)}), paths AS ({text(BRANDS)}), persons AS ({text(PEOPLE)}), ctx AS ({CONTEXT_DUCK}), {TOLD}
    SELECT doc_id, (SELECT string_agg(name, ', ' ORDER BY ord) FROM persons) AS persons, E'Bekannte Pfade:\\n' || (SELECT string_agg('- ' || path, chr(10) ORDER BY path DESC) FROM paths)
    || E'\\n\\nSortier-Kontexte:\\n' || (SELECT coalesce(string_agg(line, chr(10) ORDER BY path), '- keine') FROM ln)
    || E'\\n\\nDokument-Metadaten:\\n- Datum: unbekannt\\n- Titel/Inhalt: ' || CASE WHEN doc_id % 2 = 0 THEN 'S' || doc_id ELSE meta_text END || E'\\n- Typ: ' || document_type || E'\\n- Tags: unbekannt\\n\\nDokument-Text (Auszug):\\n' || left(text, 3000)
    || E'\\n\\nKlassifiziere das Dokument und antworte im JSON-Format.' AS prompt FROM docs"""


def _prompts(spark, d):
    docs = frame(spark, d, PART_DOCS).select("doc_id", F.lit(None).cast("string").alias("date"), F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("S"), F.col("doc_id").cast("string"))).otherwise("").alias("subject"), F.col("meta_text").alias("title"), "document_type", F.lit(None).cast("string").alias("tags"), "text")
    paths = frame(spark, d, f"SELECT path, row_number() OVER (ORDER BY path DESC) AS ord FROM ({BRANDS}) AS b")
    return classify.class_prompt(docs, paths, frame(spark, d, PEOPLE), frame(spark, d, BRAND_CONTEXTS))


QUERIES["cls20_class_prompt"] = _prompts
ORACLES["cls20_class_prompt"] = PROMPT

# Job store: events as job events, documents as index.
EVENTS = "SELECT event_id, user_id AS job_id, event_type AS event, value, ts AS created_at FROM {events}"
JOBS = "SELECT user_id AS job_id, 'done' AS status, concat('s', cast(user_id AS string)) AS source_name, 'old' AS final_name, cast(NULL AS string) AS error, min(ts) AS created_at, min(ts) AS updated_at FROM {events} WHERE user_id % 2 = 0 GROUP BY user_id"
#: Several starts, updates, decisions and entries of one key.
STARTED = "SELECT user_id AS job_id, 'running' AS status, concat('n', cast(event_id AS string)) AS source_name, cast(NULL AS string) AS final_name, cast(NULL AS string) AS error, ts AS created_at, ts AS updated_at FROM {events} WHERE user_id % 3 = 0"
query("job1_start", "SELECT * FROM jobs_ WHERE job_id NOT IN (SELECT job_id FROM new_) UNION ALL SELECT n.job_id, n.status, n.source_name, n.final_name, n.error, coalesce(j.created_at, n.created_at), n.updated_at FROM (SELECT job_id, arg_max(status, updated_at) AS status, arg_max(source_name, updated_at) AS source_name, cast(NULL AS varchar) AS final_name, cast(NULL AS varchar) AS error, min(created_at) AS created_at, max(updated_at) AS updated_at FROM new_ GROUP BY 1) AS n LEFT JOIN jobs_ AS j USING (job_id)", jobs_=JOBS, new_=STARTED)(lambda jobs_, new_: jobs.start_jobs(jobs_, new_))
UPDATED = "SELECT user_id AS job_id, event_type AS status, CASE WHEN value > 80 THEN concat('boom', cast(event_id AS string)) END AS error, ts AS updated_at FROM {events} WHERE user_id % 4 < 2"
query("job2_update", "SELECT j.job_id, coalesce(u.status, j.status) AS status, source_name, final_name, coalesce(u.error, j.error) AS error, created_at, coalesce(u.updated_at, j.updated_at) AS updated_at FROM jobs_ AS j LEFT JOIN (SELECT job_id, arg_max(status, updated_at) AS status, arg_max(error, updated_at) FILTER (WHERE error IS NOT NULL) AS error, max(updated_at) AS updated_at FROM upd GROUP BY 1) AS u USING (job_id)", jobs_=JOBS, upd=UPDATED)(lambda jobs_, upd: jobs.update_jobs(jobs_, upd))
query("job1_events", "SELECT job_id, 'started' AS event, '' AS stage, 'started' AS status, '{\"source_path\":\"/in/' || source_name || '\",\"source_sha256\":null}' AS payload_json, updated_at AS created_at FROM new_", new_=STARTED)(
    lambda new_: jobs.start_events(new_.withColumn("source_path", F.concat(F.lit("/in/"), "source_name")).withColumn("source_sha256", F.lit(None).cast("string")))
)
query("job2_events", "SELECT job_id, 'status' AS event, '' AS stage, status, CASE WHEN error IS NULL THEN '{}' ELSE '{\"error\":\"' || error || '\"}' END AS payload_json, updated_at AS created_at FROM upd", upd=UPDATED)(lambda upd: jobs.update_events(upd))


def _job_store(spark, d):
    """Starts, then updates, each as one batch of two tables: jobs and the events that they leave. The second batch is delivered twice."""
    at, new, upd = folder(spark), frame(spark, d, STARTED), frame(spark, d, UPDATED)
    named = new.withColumn("source_path", F.concat(F.lit("/in/"), "source_name")).withColumn("source_sha256", F.lit(None).cast("string"))
    old = frame(spark, d, JOBS)
    schema = "job_id long, status string, source_name string, final_name string, error string, created_at timestamp_ntz, updated_at timestamp_ntz"
    ledger.commit(spark, at, 0, {"jobs": jobs.start_jobs(old, new), "job_events": jobs.start_events(named)})
    for _ in range(2):
        now = ledger.state(spark, at, "jobs", schema, ["job_id"])
        ledger.commit(spark, at, 1, {"jobs": jobs.update_jobs(now, upd), "job_events": jobs.update_events(upd)})
    events = ledger.rows(spark, at, "job_events", "job_id long, event string").groupBy("job_id").agg(F.count("*").alias("events"))
    return ledger.state(spark, at, "jobs", schema, ["job_id"]).join(events, "job_id", "left").select("job_id", "status", "error", F.coalesce("events", F.lit(0)).alias("events"))


QUERIES["job2_store"] = _job_store
ORACLES["job2_store"] = f"""WITH new_ AS ({text(STARTED)}), upd AS ({text(UPDATED)}), jobs_ AS ({text(JOBS)}),
    j AS (SELECT job_id, status, error FROM jobs_ WHERE job_id NOT IN (SELECT job_id FROM new_) UNION ALL SELECT DISTINCT job_id, 'running', NULL FROM new_),
    u AS (SELECT job_id, arg_max(status, updated_at) AS status, arg_max(error, updated_at) FILTER (WHERE error IS NOT NULL) AS error FROM upd GROUP BY 1),
    e AS (SELECT job_id, count(*) AS n FROM (SELECT job_id FROM new_ UNION ALL SELECT job_id FROM upd) GROUP BY 1)
    SELECT job_id, coalesce(u.status, j.status) AS status, coalesce(u.error, j.error) AS error, coalesce(n, 0) AS events FROM j LEFT JOIN u USING (job_id) LEFT JOIN e USING (job_id)"""
query("job3_record_events", "SELECT event_id, job_id, created_at, '{\"event\":\"' || event || '\"}' AS payload_json FROM ev", ev=EVENTS)(lambda ev: jobs.record_events(ev.drop("value"), ["event"]))
query("job4_state", "SELECT job_id, arg_max(event, (created_at, event_id)) AS status, arg_max(value, (created_at, event_id)) AS value, count(*) AS events, min(created_at) AS first_at, max(created_at) AS last_at FROM ev GROUP BY 1", ev=EVENTS)(lambda ev: jobs.job_state(ev))
INDEX = "SELECT doc_id AS id, md5(text) AS source_sha256, doc_id % 100 AS updated_at, concat(source, '_', lang) AS source_name, substring(text, 1, 60) AS final_name FROM {documents}"
query("job5_duplicates", ", h AS (SELECT d.doc_id, i.id, row_number() OVER (PARTITION BY d.doc_id ORDER BY i.updated_at DESC, i.id DESC) AS place FROM (SELECT id AS doc_id, source_sha256 FROM idx) AS d JOIN idx AS i USING (source_sha256) WHERE d.doc_id <> i.id) SELECT * FROM h WHERE place <= 5", idx=INDEX)(lambda idx: jobs.find_duplicates(idx.select(F.col("id").alias("doc_id"), F.col("source_sha256").alias("sha256")), idx))
DONE = "SELECT md5(text) AS source_sha256, source AS source_name, lang AS final_name, concat('p/', lang) AS target_path, CASE WHEN doc_id % 3 = 0 THEN 'deferred' ELSE 'completed' END AS status, doc_id AS finished_at FROM {documents}"
query("job6_index", "SELECT source_sha256, source_name, final_name, target_path, finished_at AS created_at, finished_at AS updated_at FROM done WHERE status <> 'deferred'", done=DONE)(lambda done: jobs.index_documents(done))
query("job7_search", "SELECT id FROM idx WHERE source_name ILIKE '%SRC1%' OR final_name ILIKE '%SRC1%' ORDER BY updated_at DESC, id DESC LIMIT 20", idx=INDEX)(lambda idx: jobs.search(idx, "SRC1", 20, ["source_name", "final_name"], [F.desc("updated_at"), F.desc("id")]).select("id"))
QUEUE = "SELECT event_id AS id, 'pending' AS status, cast(NULL AS string) AS chosen_path, ts AS created_at, cast(NULL AS timestamp) AS resolved_at FROM {events} WHERE event_type = 'error'"
RESOLVED = "SELECT CASE WHEN event_id % 2 = 0 THEN event_id END AS id, 'resolved' AS status, 'ASIA/x' AS chosen_path, ts AS resolved_at FROM {events} WHERE event_type = 'error' UNION ALL SELECT event_id, 'open', 'ASIA/a', ts - INTERVAL 1 DAY FROM {events} WHERE event_type = 'error' AND event_id % 2 = 0"
query("job8_review_resolve", "SELECT id, CASE WHEN id % 2 = 0 THEN 'resolved' ELSE status END AS status, CASE WHEN id % 2 = 0 THEN 'ASIA/x' END AS chosen_path, created_at, CASE WHEN id % 2 = 0 THEN created_at END AS resolved_at FROM qu", qu=QUEUE, dec=RESOLVED)(lambda qu, dec: jobs.review_resolve(qu, dec))
ADDED = "SELECT event_id AS id, ts AS created_at, cast(NULL AS string) AS chosen_path FROM {events} WHERE event_type <> 'error'"
query("job8_review_add", "SELECT * FROM qu UNION ALL SELECT id, 'pending', NULL, created_at, NULL FROM new_", qu=QUEUE, new_=ADDED)(lambda qu, new_: jobs.review_add(qu, new_))
query("job8_review_list", "SELECT id FROM qu ORDER BY created_at DESC, id DESC LIMIT 200", qu=QUEUE)(lambda qu: jobs.review_list(qu, "pending", 200).select("id"))
query("job9_dashboard", "SELECT (SELECT count(*) FROM f) AS files_waiting, (SELECT count(*) FROM d WHERE active) AS active_dirs, (SELECT least(count(*), 200) FROM qu) AS pending_reviews, (SELECT count(*) FROM p) AS known_paths", f=FILES, d="SELECT n_name AS dir, n_nationkey % 2 = 0 AS active FROM {nation}", qu=QUEUE, p=BRANDS)(lambda f, d, qu, p: jobs.dashboard(f, d, qu, p))
STAGES = "SELECT event_id, user_id AS job_id, event_type AS stage, CASE WHEN value > 50 THEN 'ok' ELSE 'degraded' END AS status, cast('2024-01-01' AS timestamp) AS started_at, ts AS ended_at, CASE WHEN value < 10 THEN concat('w', cast(event_id AS string)) END AS warning FROM {events}"
STAGED = "st AS (SELECT job_id, stage, arg_max(status, (ended_at, event_id)) AS status, floor((epoch_us(max(ended_at)) - epoch_us(timestamp '2024-01-01') + 5) / 10) / 100 AS duration_ms, coalesce(string_agg(warning, ';' ORDER BY warning), '') AS warnings FROM s GROUP BY 1, 2)"
query("job10_stage_report", f", {STAGED} SELECT * FROM st", s=STAGES)(lambda s: jobs.stage_report(s).withColumn("warnings", F.array_join("warnings", ";")))
def _manifests(s):
    ids = s.select("job_id").distinct()
    named = F.col("job_id").cast("string")
    outputs = ids.select("job_id", F.lit("pdf").alias("kind"), F.concat(F.lit("p"), named).alias("path"))
    sources = ids.select("job_id", F.concat(F.lit("/in/d"), named, F.lit(".PDF")).alias("original_path"), F.sha2(named, 256).alias("sha256"))
    uploads = s.filter("stage = 'purchase'").select("job_id", F.lit("drive").alias("target"), F.concat(F.lit("u"), F.col("event_id").cast("string")).alias("name"))
    made = jobs.manifests(jobs.stage_report(s), outputs, sources, uploads)
    m = F.from_json("manifest", "source struct<name:string,suffix:string,sha256:string>, outputs map<string,string>, stages map<string,struct<status:string>>, uploads array<struct<target:string,name:string>>, warnings array<string>")
    got = made.select("job_id", m.alias("m")).select("job_id", F.size("m.stages").cast("long").alias("n_stages"), F.col("m.outputs")["pdf"].alias("pdf"), "m.source.*", F.array_join("m.warnings", ";").alias("warnings"), F.array_join(F.transform("m.uploads", lambda u: u["name"]), ";").alias("uploads"))
    return got


query("job11_manifests", f""", {STAGED} SELECT job_id, count(*) AS n_stages, 'p' || job_id AS pdf, 'd' || job_id || '.PDF' AS name, '.pdf' AS suffix, sha256(cast(job_id AS varchar)) AS sha256,
    (SELECT coalesce(string_agg(warning, ';' ORDER BY stage, warning), '') FROM s WHERE s.job_id = st.job_id) AS warnings, (SELECT coalesce(string_agg('u' || event_id, ';' ORDER BY 'u' || event_id), '') FROM s WHERE s.job_id = st.job_id AND stage = 'purchase') AS uploads FROM st GROUP BY 1""", s=STAGES)(_manifests)
OUTPUTS = "SELECT doc_id, concat('out/', cast(doc_id AS string), '.txt') AS path FROM {documents}"
ON_DISK = "SELECT concat('out/', cast(doc_id AS string), '.txt') AS path, n_chars AS size, md5(text) AS sha256 FROM {documents} WHERE doc_id % 3 <> 0"
query("job12_artifact_stats", "SELECT doc_id, path, size, sha256, size IS NOT NULL AS exists FROM o LEFT JOIN f USING (path)", o=OUTPUTS, f=ON_DISK)(lambda o, f: jobs.artifact_stats(o, f))
RESULTS = "SELECT p_partkey AS doc_id, concat('asia/', p_brand) AS path, p_size % 4 = 0 AS is_new FROM {part}"
#: Two decisions for some paths, the later one counts; Brand#2 has become known meanwhile.
DECIDED = """SELECT DISTINCT concat('asia/', p_brand) AS path, CASE WHEN p_brand = 'Brand#1' THEN concat(' Asia ', chr(92), ' Neu ') WHEN p_brand = 'Brand#3' THEN 'Fremd/x' END AS final_path, timestamp'2024-01-02 00:00:00' AS decided_at FROM {part} WHERE p_brand <> 'Brand#2' AND p_size > 25
    UNION ALL SELECT DISTINCT concat('asia/', p_brand), 'ASIA/Alt', timestamp'2024-01-01 00:00:00' FROM {part} WHERE p_size > 25"""
MEANWHILE = "SELECT DISTINCT concat('asia/', p_brand) AS path FROM {part} WHERE p_brand = 'Brand#2'"
query("job13_release", "SELECT doc_id, CASE path WHEN 'asia/Brand#1' THEN 'ASIA/Neu' WHEN 'asia/Brand#3' THEN 'Sonstiges/x' ELSE 'ASIA/' || path[6:] END AS path, path AS proposed_path, 'completed' AS status FROM r WHERE is_new AND (path IN (SELECT path FROM dec) OR path = 'asia/Brand#2')", r=RESULTS, dec=DECIDED, known=MEANWHILE, persons=PERSONS)(
    lambda r, dec, known, persons: jobs.release(jobs.defer(r)[1], dec, known, persons).select("doc_id", "path", "proposed_path", "status")
)
MOVED = "SELECT doc_id, concat('ziel/', cast(doc_id AS string), '.txt') AS moved_path FROM {documents} WHERE doc_id % 2 = 0"
NOW = "SELECT concat(CASE WHEN doc_id % 3 = 0 THEN 'ziel/' ELSE 'out/' END, cast(doc_id AS string), '.txt') AS path FROM {documents} WHERE doc_id % 5 <> 0"
query("job14_resolve_artifacts", "SELECT doc_id, path, CASE WHEN doc_id % 5 = 0 THEN NULL WHEN doc_id % 3 <> 0 THEN path WHEN doc_id % 2 = 0 THEN 'ziel/' || doc_id || '.txt' END AS found FROM o", o=OUTPUTS, m=MOVED, f=NOW)(lambda o, m, f: jobs.resolve_artifacts(o, m, f))
query("job15_audit", "SELECT request_id, 'v1' AS version, 'qwen3:27b' AS model, sha256(prompt) AS prompt_sha256, length(prompt) AS prompt_chars FROM j", j="SELECT conv_id * 100 + turn AS request_id, text AS prompt FROM {conversations}")(lambda j: jobs.runtime_audit(j, j.sparkSession.range(1).select(F.lit("v1").alias("version"), F.lit("qwen3:27b").alias("model")), "prompt"))

# Sources and sinks.
LISTED = "SELECT page_id, concat('/in/', CASE page_id % 4 WHEN 0 THEN 'a' WHEN 1 THEN 'B' WHEN 2 THEN 'b' ELSE 'manual' END, '/f', cast(page_id AS string), CASE page_id % 5 WHEN 0 THEN '.PDF' WHEN 1 THEN '.txt' WHEN 2 THEN '.part.pdf' WHEN 3 THEN '.docx' ELSE '.jpg' END) AS path FROM {pages}"
query("src1_accepted", "SELECT page_id FROM l WHERE page_id % 5 IN (0, 3, 4)", l=LISTED)(lambda l: l.filter(files.accepted(F.element_at(F.split("path", "/"), -1))).select("page_id"))
DIRLIST = "SELECT concat('/data/', CASE WHEN c_custkey % 2 = 0 THEN 'Ein' ELSE 'EIN' END, cast(c_custkey % 40 AS string), CASE WHEN c_custkey % 3 = 0 THEN '/final/x' ELSE '' END) AS dir, c_custkey AS ord FROM {customer}"
query("src2_dedupe_dirs", "SELECT arg_min(dir, ord) AS dir, min(ord) AS ord FROM d GROUP BY lower(dir)", d=DIRLIST)(lambda d: files.dedupe_dirs(d))
RELATIVE = "SELECT concat(CASE c_custkey % 4 WHEN 0 THEN '/base/' WHEN 1 THEN '' WHEN 2 THEN './x/../' ELSE '../base//' END, 'in', cast(c_custkey % 40 AS string), CASE WHEN c_custkey % 3 = 0 THEN '/' ELSE '' END) AS dir, c_custkey AS ord FROM {customer}"
query("src2_relative_dirs", "SELECT '/base/in' || (ord % 40) AS dir, min(ord) AS ord FROM d GROUP BY 1", d=RELATIVE)(lambda d: files.dedupe_dirs(d, "/base"))
RESERVED = "SELECT concat('/data/', CASE WHEN c_custkey % 2 = 0 THEN 'Ein' ELSE 'EIN' END, cast(c_custkey % 40 AS string), '/final') AS path FROM {customer} WHERE c_custkey % 2 = 0"
query("src3_exclude_reserved", "SELECT dir, ord FROM d WHERE dir <> '/data/EIN1' AND NOT (contains(dir, '/final/x') AND regexp_replace(dir, '/x$', '') IN (SELECT path FROM r))", d=DIRLIST, r=RESERVED)(lambda d, r: files.exclude_reserved(d, r, "/data/EIN1"))
query("src4_source_profile", "SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'consume' WHEN 2 THEN 'b' ELSE 'manual' END AS profile FROM l", l=LISTED, d="SELECT '/in/a' AS dir, 'consume' AS profile FROM {region} WHERE r_regionkey = 0 UNION ALL SELECT '/in/b', 'b' FROM {region}")(lambda l, d: files.with_source_profile(l, d).select("page_id", "profile"))
POINTERS = """SELECT page_id, CASE page_id % 3 WHEN 0 THEN concat('{{', CASE WHEN page_id % 2 = 0 THEN concat('"title": "T', cast(page_id AS string), '", ') ELSE '' END, '"url": "', url, '"}}') WHEN 1 THEN '{{bad' ELSE url END AS text, url FROM {pages}"""
query("src7_pointer_text", """SELECT page_id, CASE page_id % 3 WHEN 0 THEN E'Synology Office Dokument-Link\\nTitel: ' || CASE WHEN page_id % 2 = 0 THEN 'T' || page_id ELSE 'datei' || page_id END || E'\\nURL: ' || url ELSE E'Synology .odoc Inhalt:\\n' || text END AS text FROM p""", p=POINTERS)(
    lambda p: files.pointer_text(p.withColumn("stem", F.concat(F.lit("datei"), F.col("page_id").cast("string")))).select("page_id", "text")
)
EXPORTED = "SELECT o_orderkey AS doc_id, concat('d', cast(o_orderkey AS string)) AS final_name, o_orderkey % 4 = 0 AS office FROM {orders}"
#: Every format, with each setting of four flags by turns.
FLAGS = [(True, True, False, False), (False, True, False, True), (False, False, True, False), (True, False, False, True)]


def _exports(spark, d):
    rows = [files.plan_exports(frame(spark, d, EXPORTED), fmt, *flags).select(F.lit(fmt).alias("fmt"), F.lit(i).alias("flags"), "doc_id", "kind", "file_name") for fmt in files.FORMATS for i, flags in enumerate(FLAGS)]
    out = rows[0]
    for r in rows[1:]:
        out = out.union(r)
    return out


QUERIES["snk1_plan_exports"] = _exports
ORACLES["snk1_plan_exports"] = f"""WITH d AS ({text(EXPORTED)}), g AS (SELECT * FROM (VALUES (0, true, true, false, false), (1, false, true, false, true), (2, false, false, true, false), (3, true, false, false, true)) AS v(flags, sd, sr, ud, ur)),
    x AS (SELECT * FROM d, g, (SELECT unnest(['Nur PDF', 'Nur TXT', 'PDF und TXT', 'Nur DOCX', 'PDF und DOCX']) AS fmt))
    SELECT fmt, flags, doc_id, 'pdf' AS kind, final_name || '.pdf' AS file_name FROM x WHERE NOT office AND contains(fmt, 'PDF') UNION ALL SELECT fmt, flags, doc_id, 'txt', final_name || '.txt' FROM x WHERE contains(fmt, 'TXT')
    UNION ALL SELECT fmt, flags, doc_id, 'docx', final_name || '.docx' FROM x WHERE office UNION ALL SELECT fmt, flags, doc_id, 'docx', 'begleitdateien/' || final_name || '.docx' FROM x WHERE NOT office AND (contains(fmt, 'DOCX') AND sd OR ud)
    UNION ALL SELECT fmt, flags, doc_id, 'report', 'begleitdateien/' || final_name || '_quality_report.json' FROM x WHERE sr OR ur"""
query("snk5_retain_latest", "SELECT event_id AS path, ts AS modified FROM e ORDER BY ts DESC, event_id LIMIT 3", e="SELECT event_id, ts FROM {events}")(lambda e: files.retain_latest(e.select(F.col("event_id").alias("path"), F.col("ts").alias("modified"))))
query("snk6_cleanup_plan", "SELECT doc_id, path, kind, save_docx, CASE WHEN doc_id % 3 <> 0 AND (kind = 'docx' AND NOT save_docx OR kind = 'report' AND save_docx) THEN 'delete' ELSE 'keep' END AS action FROM (SELECT *, CASE doc_id % 4 WHEN 0 THEN 'docx' WHEN 1 THEN 'report' ELSE 'pdf' END AS kind FROM o), (SELECT unnest([true, false]) AS save_docx)", o=OUTPUTS)(
    lambda o: _cleanup(o.withColumns({"kind": F.when(F.col("doc_id") % 4 == 0, "docx").when(F.col("doc_id") % 4 == 1, "report").otherwise("pdf"), "deferred": F.col("doc_id") % 3 == 0}))
)


def _cleanup(o):
    kinds = o.select("path", "kind")
    both = [files.cleanup_plan(o, save, not save).withColumn("save_docx", F.lit(save)) for save in (True, False)]
    return both[0].union(both[1]).join(kinds, "path")



# Files that the queries write themselves, into a folder of their own, and read again.
EVENT_ROWS = "SELECT cast(user_id AS string) AS job_id, event_type AS event, 'ok' AS status, cast(event_id AS string) AS detail, CASE WHEN value > 50 THEN ts END AS timestamp_utc FROM {events}"


def _src5(spark, d):
    path = f"{folder(spark)}/history"
    files.append_history(frame(spark, d, EVENT_ROWS), path)
    return files.read_history(spark, path).select("job_id", "event", "status", "detail", F.col("timestamp_utc").isNotNull().alias("timed"))


QUERIES["src5_history"] = _src5
ORACLES["src5_history"] = "SELECT cast(user_id AS varchar) AS job_id, event_type AS event, 'ok' AS status, cast(event_id AS varchar) AS detail, true AS timed FROM events"
#: One registry, and one memory, as JSON text, of all parts.
REGISTRIES = """SELECT to_json(named_struct('known_paths', array_sort(collect_set(concat('ASIA/', p_brand))), 'path_contexts', map_from_entries(array_sort(collect_set(struct(concat('ASIA/', p_brand) AS k,
    named_struct('object_type', '', 'keywords', array(p_brand), 'notes', 'n') AS v)))))) AS value FROM {part}"""
MEMORIES = """SELECT to_json(named_struct('path_stats', map_from_entries(collect_list(struct(path, named_struct('confirmed_count', n, 'positive_terms', terms)))))) AS value
    FROM (SELECT concat('ASIA/', p_brand) AS path, cast(count(*) AS int) AS n, map_from_entries(array_sort(collect_set(struct(lower(p_type) AS k, 1 AS v)))) AS terms FROM {part} GROUP BY p_brand) AS m"""


def _src6(part, load, columns, sql):
    def run(spark, d):
        path = f"{folder(spark)}/{part}"
        frame(spark, d, sql).write.text(path)
        return load(spark, path)[part].selectExpr(*columns)

    return run


QUERIES["src6_registry"] = _src6("path_context", files.load_registry, ["path", "array_join(keywords, ';') AS keywords", "notes"], REGISTRIES)
ORACLES["src6_registry"] = "SELECT DISTINCT 'ASIA/' || p_brand AS path, p_brand AS keywords, 'n' AS notes FROM part"
QUERIES["src6_memory_terms"] = _src6("path_term", files.load_memory, ["path", "kind", "term", "n"], MEMORIES)
ORACLES["src6_memory_terms"] = "SELECT DISTINCT 'ASIA/' || p_brand AS path, 'positive' AS kind, lower(p_type) AS term, 1 AS n FROM part"
QUERIES["src6_memory_stats"] = _src6("path_stat", files.load_memory, ["path", "confirmed_count"], MEMORIES)
ORACLES["src6_memory_stats"] = "SELECT 'ASIA/' || p_brand AS path, count(*) AS confirmed_count FROM part GROUP BY 1"
TARGETS = "SELECT doc_id, concat('z/', lang, '/', source) AS target_path, text FROM {documents}"


def _snk2(spark, d):
    """Three runs into the same places: some texts first in another wording, all of them, and some once more."""
    path, rows = f"{folder(spark)}/texts", frame(spark, d, TARGETS)
    files.write_text(rows.filter("doc_id % 3 = 0").withColumn("text", F.lit("old")).union(rows.limit(0)), path)
    files.write_text(rows.filter("doc_id % 2 = 0"), path)
    files.write_text(rows.filter("doc_id % 2 = 1"), path)
    files.write_text(rows.filter("doc_id % 5 = 0"), path)
    return spark.read.parquet(path).select("doc_id", "target_path", F.sha2("text", 256).alias("text_sha256"))


QUERIES["snk2_write_text"] = _snk2
ORACLES["snk2_write_text"] = "SELECT doc_id, 'z/' || lang || '/' || source AS target_path, sha256(text) AS text_sha256 FROM documents"


def _snk3(spark, d):
    path = f"{folder(spark)}/reports"
    files.write_reports(frame(spark, d, "SELECT event_id, event_type, CASE WHEN value > 50 THEN user_id END AS user_id FROM {events}"), path)
    return spark.read.text(path)


QUERIES["snk3_reports"] = _snk3
ORACLES["snk3_reports"] = """SELECT '{"event_id":' || event_id || ',"event_type":"' || event_type || '","user_id":' || CASE WHEN value > 50 THEN cast(user_id AS varchar) ELSE 'null' END || '}' AS value FROM events"""


def _snk3_manifests(spark, d):
    path = f"{folder(spark)}/manifests"
    files.write_manifests(frame(spark, d, "SELECT o_orderkey AS job_id, to_json(named_struct('customer', o_custkey)) AS record FROM {orders}"), path)
    return files.read_manifests(spark, path)


QUERIES["snk3_manifests"] = _snk3_manifests
ORACLES["snk3_manifests"] = """SELECT o_orderkey AS job_id, '{"customer":' || o_custkey || '}' AS record FROM orders"""
MADE_FILES = "SELECT concat('/out/', CASE WHEN doc_id % 3 = 0 THEN 'a' ELSE 'b' END, '/d', cast(doc_id AS string), CASE doc_id % 4 WHEN 0 THEN '.json' WHEN 1 THEN '.TXT' ELSE '.pdf' END) AS path, concat(' x', CASE WHEN doc_id % 2 = 0 THEN '/' ELSE chr(92) END, lang) AS target_path, cast(text AS binary) AS content FROM {documents}"


def _snk4(spark, d):
    """Runs into the same places: other contents of some files first, then one half of the files, then the other."""
    path, rows = f"{folder(spark)}/archive", frame(spark, d, MADE_FILES)
    files.write_archive(rows.filter("path LIKE '%1%'").withColumn("content", F.lit("old").cast("binary")), path)
    files.write_archive(rows.filter("path LIKE '/out/a/%'"), path)
    files.write_archive(rows.filter("path LIKE '/out/b/%'"), path)
    return spark.read.parquet(path).select("target_path", "file_name", F.sha2("content", 256).alias("sha256"))


QUERIES["snk4_archive"] = _snk4
ORACLES["snk4_archive"] = "SELECT 'x/' || lang AS target_path, 'd' || doc_id || CASE WHEN doc_id % 4 = 1 THEN '.TXT' ELSE '.pdf' END AS file_name, sha256(text) AS sha256 FROM documents WHERE doc_id % 4 <> 0"

# Streams, run over all that the tables hold.
def folder(spark: SparkSession) -> str:
    return f"{files.shared_dir(spark)}/foliant/stream-{uuid.uuid4().hex}"


def stream(spark: SparkSession, sf_dir: str, name: str):
    path = f"{sf_dir}/{name}.parquet"
    return streams.table_stream(spark, f"{path}*", spark.read.parquet(path).schema)  # a pattern: the table may be a file or a folder


def observed(e):
    """Events as observations of a file per user: every 23rd finds it gone."""
    return e.select(F.concat(F.lit("f"), F.col("user_id").cast("string")).alias("path"), F.when(F.col("event_id") % 23 != 0, (F.col("value") / 30).cast("long")).alias("size"), (F.col("ts").cast("timestamp") - F.expr("INTERVAL 6 SECONDS")).alias("mtime"), F.col("ts").cast("timestamp").alias("observed_at"))


def as_events(e):
    return e.select("event_id", F.col("user_id").alias("job_id"), F.col("event_type").alias("event"), "value", F.col("ts").cast("timestamp").alias("created_at"))


DAY_S = 86_400


def polls(spark, rows, lots, at, path):
    """Writes rows as files in lots of equal spans of a time, one lot after another; each time the stream can be run on."""
    span = rows.agg(F.min(F.unix_micros(at)), F.max(F.unix_micros(at))).first()
    lot = F.least(F.lit(lots - 1), F.floor((F.unix_micros(at) - span[0]) * lots / max(1, span[1] - span[0])))
    for i in range(lots):
        rows.filter(lot == i).write.mode("append").parquet(path)
        yield i, streams.table_stream(spark, path, rows.schema)


def rocks(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    return folder(spark)


QUERIES["str1_stable_files_batch"] = lambda spark, d: streams.stable_files_batch(observed(frame(spark, d, "SELECT * FROM {events}")), DAY_S)
STAYS = """WITH o AS (SELECT 'f' || user_id AS path, CASE WHEN event_id % 23 <> 0 THEN trunc(value / 30) END AS size, ts AS observed_at FROM events),
    g AS (SELECT *, CASE WHEN size IS NULL OR observed_at - lag(observed_at) OVER (PARTITION BY path ORDER BY observed_at) > INTERVAL 1 DAY THEN 1 ELSE 0 END AS gone FROM o),
    a AS (SELECT *, sum(gone) OVER (PARTITION BY path ORDER BY observed_at) AS stay FROM g),
    b AS (SELECT *, coalesce(cast(size <> lag(size) OVER (PARTITION BY path, stay ORDER BY observed_at) AS int), 0) AS new FROM a WHERE size IS NOT NULL),
    c AS (SELECT *, sum(new) OVER (PARTITION BY path, stay ORDER BY observed_at) AS run FROM b),
    t AS (SELECT *, row_number() OVER (PARTITION BY path, stay, run ORDER BY observed_at) - 1 AS ticks FROM c)
    SELECT path, cast(arg_min(size, observed_at) AS bigint) AS size, min(observed_at) AS observed_at FROM t WHERE ticks >= 2 GROUP BY path, stay"""
ORACLES["str1_stable_files_batch"] = STAYS


def _str1_stream(spark, d):
    """Files whose observations stop for more than a day have vanished; three runs, each from where the last one stopped."""
    at, out = rocks(spark), None
    for _, s in polls(spark, observed(frame(spark, d, "SELECT * FROM {events}")), 3, "observed_at", f"{at}/in"):
        out = streams.drained(streams.stable_files(s, DAY_S), at)
    return out


QUERIES["str1_stable_files_stream"] = _str1_stream
ORACLES["str1_stable_files_stream"] = STAYS


def _str2(spark, d):
    """Three micro-batches; copies meet in one and across them. firsts: rows of a text that aren't duplicates."""
    at = folder(spark)
    rows = frame(spark, d, "SELECT doc_id, text, CASE WHEN doc_id % 4 = 0 THEN '.docx' ELSE '.pdf' END AS suffix, n_chars % 40 AS page_count, timestamp_seconds(doc_id * 7 % 1000) AS at FROM {documents}")
    known = frame(spark, d, "SELECT sha2(text, 256) AS source_sha256 FROM {documents} WHERE doc_id % 10 = 0")
    for _, s in polls(spark, rows, 3, "at", f"{at}/in"):
        streams.poured(s.drop("at"), at, streams.ingest(known, f"{at}/store"))
    got = ledger.rows(spark, f"{at}/store", "documents", streams.INGESTED)
    firsts = got.groupBy("sha256").agg(F.sum((~F.col("duplicate")).cast("long")).alias("firsts"), F.count("*").alias("copies"))
    return got.select("doc_id", "sha256", "route").join(firsts, "sha256")


QUERIES["str2_ingest"] = _str2
ORACLES["str2_ingest"] = """SELECT doc_id, sha256(text) AS sha256, CASE WHEN doc_id % 4 = 0 THEN 'office' WHEN n_chars % 40 > 20 THEN 'reduced' ELSE 'detailed' END AS route,
    CASE WHEN text IN (SELECT text FROM documents WHERE doc_id % 10 = 0) THEN 0 ELSE 1 END AS firsts, count(*) OVER (PARTITION BY text) AS copies FROM documents"""


def upserted(make, keys, schema):
    def run(spark, d):
        at = folder(spark)
        for _, s in polls(spark, as_events(frame(spark, d, "SELECT * FROM {events}")), 3, "created_at", f"{at}/in"):
            streams.poured(make(s), at, streams.upserts(f"{at}/store", "state", keys, every=2), "update")
        return ledger.state(spark, f"{at}/store", "state", schema, keys)

    return run


QUERIES["str3_job_state"] = upserted(streams.job_state_stream, ["job_id"], "job_id long, status string, events long")
ORACLES["str3_job_state"] = "SELECT user_id AS job_id, arg_max(event_type, (ts, event_id)) AS status, count(*) AS events FROM events GROUP BY 1"
QUERIES["str4_dashboard"] = upserted(streams.dashboard_stream, ["event"], "event string, n long, last_at timestamp")
ORACLES["str4_dashboard"] = "SELECT event_type AS event, count(*) AS n, max(ts) AS last_at FROM events GROUP BY 1"

#: Documents that wait for a new path, and decisions on some of them, in three micro-batches by their time.
WAITING = f"SELECT doc_id, concat('P/', cast(doc_id % 40 AS string)) AS path, CASE WHEN doc_id % 3 = 0 THEN NULL ELSE doc_id + 1000000 END AS review_id, sha2(text, 256) AS source_sha256, document_type, meta_text, text FROM ({PART_DOCS}) AS p"
ON_PATHS = """SELECT concat('P/', cast(k AS string)) AS path, CASE k % 3 WHEN 0 THEN concat('asia/', cast(k AS string)) WHEN 1 THEN concat('Fremd/', cast(k AS string)) END AS final_path, timestamp_seconds(k * 100) AS decided_at FROM (SELECT DISTINCT p_partkey % 40 AS k FROM {part}) AS d WHERE k % 4 <> 0
    UNION ALL SELECT concat('P/', cast(k AS string)), 'asia/frueher', timestamp_seconds(k * 100 - 1) FROM (SELECT DISTINCT p_partkey % 40 AS k FROM {part} WHERE p_partkey % 40 % 4 = 1) AS d"""


def _str5(spark, d):
    at = folder(spark)
    pending, paths, persons, stored = (frame(spark, d, x) for x in (WAITING, "SELECT 'P/8' AS path FROM {region} WHERE r_regionkey = 0", PERSONS, STORED))
    for _, s in polls(spark, frame(spark, d, ON_PATHS), 3, "decided_at", f"{at}/in"):
        streams.poured(s, at, streams.release_into(pending, paths, persons, stored, f"{at}/store"))
    now = streams.release_state(pending, paths, stored, f"{at}/store")
    text_ = lambda c: F.col(c).cast("string")
    return (
        now["pending"].select(F.lit("pending").alias("name"), text_("doc_id").alias("key"), F.col("path").alias("value"))
        .union(now["paths"].select(F.lit("paths"), "path", F.lit(""))).union(now["review"].select(F.lit("review"), text_("review_id"), "chosen_path"))
        .union(now["doc_index"].select(F.lit("doc_index"), F.concat_ws(" ", text_("doc_id"), "source_sha256"), "target_path"))
        .union(now["memory"].select(F.lit("memory"), F.concat_ws(" ", "path", "kind", "term"), text_("n")))
    )


QUERIES["str5_release"] = _str5
ORACLES["str5_release"] = f"""WITH docs AS ({text(PART_DOCS)}), pending AS ({text(WAITING).replace("sha2(text, 256)", "sha256(text)")}), stored AS ({text(STORED)}), {LEARN.lstrip(", ")},
    f AS (SELECT *, cast(path[3:] AS int) AS k FROM pending WHERE cast(path[3:] AS int) % 4 <> 0 OR path = 'P/8'),
    freed AS (SELECT *, CASE WHEN k = 8 THEN 'Sonstiges/8' WHEN k % 3 = 0 THEN 'ASIA/' || k WHEN k % 3 = 1 THEN 'Sonstiges/' || k ELSE 'Sonstiges/' || k END AS target FROM f),
    mem AS (SELECT target AS path, 'positive' AS kind, term, 1 AS n FROM freed JOIN terms USING (doc_id) WHERE place <= 80 UNION ALL SELECT target, 'type', lower(document_type), 2 FROM freed
        UNION ALL SELECT path, 'negative', term, 1 FROM freed JOIN terms USING (doc_id) WHERE place <= 30 UNION ALL SELECT * FROM stored)
    SELECT 'pending' AS name, cast(doc_id AS varchar) AS key, path AS value FROM pending WHERE doc_id NOT IN (SELECT doc_id FROM f) UNION ALL SELECT DISTINCT 'paths', target, '' FROM freed UNION ALL SELECT 'paths', 'P/8', ''
    UNION ALL SELECT 'review', cast(review_id AS varchar), target FROM freed WHERE review_id IS NOT NULL UNION ALL SELECT 'doc_index', doc_id || ' ' || source_sha256, target FROM freed
    UNION ALL SELECT 'memory', path || ' ' || kind || ' ' || term, cast(least(sum(n), 50) AS varchar) FROM mem GROUP BY path, kind, term"""

#: The same kind of event of a user counts once in twelve hours; rows come up to half an hour out of order, in three runs.
SIGHTED = "SELECT concat(cast(user_id AS string), event_type) AS sha256, event_id, cast(ts AS timestamp) AS seen_at, timestamp_micros(unix_micros(cast(ts AS timestamp)) + event_id % 7 * 300000000) AS arrived FROM {events}"


def _str6(spark, d):
    at, out = rocks(spark), None
    rows = frame(spark, d, SIGHTED)
    end = rows.agg((F.max("seen_at") + F.expr("INTERVAL 10 DAYS")).alias("seen_at"), F.max("arrived").alias("arrived")).select(F.lit("end").alias("sha256"), F.lit(-1).cast("long").alias("event_id"), "seen_at", "arrived")
    for _, s in polls(spark, rows.union(end), 3, "arrived", f"{at}/in"):
        out = streams.drained(streams.dedupe_stream(s, horizon_s=DAY_S // 2), at)
    return out.select("sha256", "event_id", "seen_at")


QUERIES["str6_dedupe"] = _str6
ORACLES["str6_dedupe"] = """WITH RECURSIVE e AS (SELECT user_id || event_type AS sha256, event_id, ts, (epoch_us(ts) + 999) // 1000 AS ms, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts) AS i FROM events),
    w AS (SELECT sha256, i, ms AS last, true AS kept FROM e WHERE i = 1 UNION ALL SELECT e.sha256, e.i, CASE WHEN e.ms - w.last > 43200000 THEN e.ms ELSE w.last END, e.ms - w.last > 43200000 FROM w JOIN e ON e.sha256 = w.sha256 AND e.i = w.i + 1)
    SELECT sha256, event_id, ts AS seen_at FROM w JOIN e USING (sha256, i) WHERE kept"""
