"""Queries of the operators, with production parameters, over the whole given tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from foliant.llm import bpe, exact, fingerprints, languages, lines, packing, phrases, quality, search, simhash, suffix, toxicity, windows

BYTE_BPE, WORD_BPE = "byte_bpe_50k.json", "word_bpe_49k.json"


def vocabulary(name: str) -> str:
    """Path of a vocabulary file; looked up when a query needs it."""
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.removal_digests(table(spark, sf_dir, "documents"))


def op2_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprint_report(table(spark, sf_dir, "documents"))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed_documents(table(spark, sf_dir, "documents"), vocabulary(WORD_BPE))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_groups(table(spark, sf_dir, "documents"))


def op6_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return languages.languages(table(spark, sf_dir, "documents"))


def op7_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.passage_digests(table(spark, sf_dir, "documents"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encoding_digests(table(spark, sf_dir, "documents"), vocabulary(BYTE_BPE))


def op10_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.ranked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.line_digests(table(spark, sf_dir, "documents"))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_suffix_dedup": op1_suffix_dedup,
    "op2_fingerprints": op2_fingerprints,
    "op3_packing": op3_packing,
    "op4_toxicity": op4_toxicity,
    "op5_exact_dedup": op5_exact_dedup,
    "op6_languages": op6_languages,
    "op7_passages": op7_passages,
    "op8_quality": op8_quality,
    "op9_bpe": op9_bpe,
    "op10_simhash_dedup": op10_simhash_dedup,
    "op11_ranked_search": op11_ranked_search,
    "op12_line_dedup": op12_line_dedup,
    "op13_collocations": op13_collocations,
}

LOWERED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLES = {
    "op1_suffix_dedup": r"""
        WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
        c AS (SELECT doc_id, z, substr(h, 2 * z + 1, 2 * (512 + 49)) AS t FROM (SELECT doc_id, h, unnest(range(0, greatest(0, length(h) // 2 - 49), 512)) AS z FROM d)),
        l AS (SELECT doc_id, z, list_transform(range(0, length(t) // 2 - 49), lambda p: md5(substr(t, 2 * p + 1, 100))) AS s FROM c),
        w AS (SELECT doc_id, unnest(s) AS s, z + generate_subscripts(s, 1) - 1 AS p FROM l),
        f AS (SELECT s, min(doc_id) AS first_id FROM w GROUP BY s),
        hit AS (SELECT doc_id, p FROM w JOIN f USING (s) WHERE first_id < doc_id),
        g AS (SELECT doc_id, p, sum(new) OVER (PARTITION BY doc_id ORDER BY p) AS run FROM (SELECT doc_id, p, CASE WHEN p - lag(p) OVER (PARTITION BY doc_id ORDER BY p) <= 50 THEN 0 ELSE 1 END AS new FROM hit)),
        r AS (SELECT doc_id, min(p) AS a, max(p) + 50 AS b FROM g GROUP BY doc_id, run),
        k AS (SELECT doc_id, string_agg(substr(h, 2 * z + 1, 2 * (a - z)), '' ORDER BY a) || any_value(substr(h, 2 * m + 1)) AS kept, sum(b - a) AS n_removed, count(*) AS n_spans
            FROM (SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS z, max(b) OVER (PARTITION BY doc_id) AS m FROM r) JOIN d USING (doc_id) GROUP BY doc_id)
        SELECT doc_id, length(h) // 2 AS n_bytes, cast(coalesce(n_removed, 0) AS bigint) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept, h))) AS kept_sha256 FROM d LEFT JOIN k USING (doc_id)""",
    "op5_exact_dedup": r"""
        WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents),
        g AS (SELECT t, min(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY t)
        SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(t) AS text_sha256 FROM n JOIN g USING (t)""",
    "op11_ranked_search": rf"""
        WITH t AS (SELECT doc_id, unnest(regexp_extract_all({LOWERED}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents),
        c AS (SELECT doc_id, term, count(*) AS tf FROM t GROUP BY 1, 2), s AS (SELECT doc_id, sum(tf) AS n FROM c GROUP BY 1), g AS (SELECT count(*) AS n_docs, sum(n) AS total FROM s),
        q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all({LOWERED}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
        w AS (SELECT term, cast(floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE)) AS bigint) AS w FROM c, g GROUP BY term, n_docs),
        r AS (SELECT item_id, doc_id, cast(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + ((90 * n * n_docs) // total))))) AS bigint) AS score FROM q JOIN c USING (term) JOIN w USING (term) JOIN s USING (doc_id), g GROUP BY 1, 2),
        p AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank, doc_id, score FROM r WHERE score > 0)
        SELECT * FROM p WHERE rank <= 10""",
    "op12_line_dedup": r"""
        WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents),
        k AS (SELECT doc_id, i, line, translate(trim(line, E' \t\n\r\x0b\x0c'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
        f AS (SELECT key, max(doc_id) AS holder FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
        d AS (SELECT doc_id, i, line, coalesce(holder <> doc_id, false) AS gone FROM k LEFT JOIN f USING (key))
        SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256 FROM d GROUP BY doc_id""",
    "op13_collocations": rf"""
        WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array({LOWERED}, '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
        w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p), t AS (SELECT lang, sum(len(w)) AS n FROM w GROUP BY 1),
        s AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM w), z AS (SELECT unnest(range(1, 6)) AS k),
        c AS (SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase, count(*) AS a FROM s, z WHERE i + k - 1 <= len(w) GROUP BY 1, 2, 3 HAVING count(*) >= 100),
        f AS (SELECT lang, k, phrase, a, string_split(phrase, ' ') AS v FROM c),
        i AS (SELECT DISTINCT lang, array_to_string(v[b:b + m - 1], ' ') AS phrase, a FROM (SELECT *, unnest(range(1, k + 1)) AS b FROM f WHERE k > 2), (SELECT k AS m FROM z WHERE k > 1) WHERE m < k AND b + m - 1 <= k),
        y AS (SELECT * FROM f WHERE k > 1 AND NOT EXISTS (SELECT 1 FROM i WHERE i.lang = f.lang AND i.phrase = f.phrase AND 100 * i.a >= 100 * f.a)),
        x AS (SELECT lang, phrase, a, h, array_to_string(v[1:h], ' ') AS first, array_to_string(v[h + 1:], ' ') AS rest FROM (SELECT *, unnest(range(1, k)) AS h FROM y)),
        e AS (SELECT x.lang, x.phrase, x.a, h, l.a AS l, r.a AS r, t.n AS n, cast((1000::HUGEINT * x.a * t.n) // (l.a::HUGEINT * r.a) AS bigint) AS score FROM x JOIN c AS l ON l.lang = x.lang AND l.phrase = x.first JOIN c AS r ON r.lang = x.lang AND r.phrase = x.rest JOIN t ON t.lang = x.lang),
        b AS (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, h) AS place FROM e),
        o AS (SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, cast(n AS bigint) AS n, score FROM b WHERE place = 1)
        SELECT * FROM o WHERE rank <= 2000""",
}
