"""Folder classification: context rules, learned terms, candidate ranking, acceptance and review."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliant.functions.joins import joined_to_many, spread
from foliant.functions.text import folded, spaced, strip
from foliant.operators.fusion import joined
from foliant.sources.ledger import staged

# Weights, limits and word lists that results depend on.
ALIAS, KEYWORD, HINT, COMPONENT, FACTOR, TOP = 5, 4, 1, 2, 8, 98
HINTS = {
    "vehicle": ["auto", "fahrzeug", "kfz", "service", "inspektion", "hu", "tuev", "tuv", "werkstatt"],
    "hobby": ["hobby", "verein", "mitgliedschaft", "kurs", "training"],
    "insurance": ["versicherung", "police", "schaden", "beitrag"],
    "health": ["arzt", "praxis", "befund", "rezept", "patient", "labor"],
}
PLAIN_PARTS = ["auto", "hobby", "schule", "arbeit", "finanzen"]
STOP = [
    "aber", "alle", "auch", "auf", "aus", "bei", "beim", "bis", "das", "dem", "den", "der", "des", "die", "ein", "eine", "einer", "eines", "fuer", "für", "ist",
    "mit", "nach", "nicht", "oder", "und", "vom", "von", "zum", "zur", "rechnung", "datum", "seite", "betrag", "dokument",
]
TERM_PATTERNS = [
    r"(?U)\b[a-z]{1,3}[-\s]?[a-z]{1,3}[-\s]?\d{2,5}\b",
    r"(?U)\b(?:kundennummer|vertragsnummer|police|kennzeichen|iban|rechnung)\s*[:#]?\s*[a-z0-9 -]{3,24}\b",
    r"(?U)\b[a-z0-9][a-z0-9-]{3,}\b",
]
DOC_TYPES = {
    "Lohnabrechnung": ["lohnabrechnung", "entgeldbescheinigung", "gehaltsabrechnung", "entgeltnachweis", "gehaltsnachweis", "entgelt"],
    "Rechnung": ["rechnung", "gebührenrechnung", "kaufbeleg", "quittung", "abrechnung"],
    "Befund": ["arztbrief", "befund", "patientenbrief", "befundbericht", "arztbefund"],
    "Lohnsteuerbescheinigung": ["lohnsteuerbescheinigung", "lohnsteuernachweis", "lohnsteuer"],
    "Versicherungspolice": ["versicherungspolice", "versicherungsnachweis", "police", "versicherungsvertrag"],
}
TEXT_USED, EVIDENCE, PER_PATH, DECISIONS, MOST, REJECTED = 5000, 8, 120, 1000, 50, 30
CATCH_ALL = "Sonstiges"
# What prompts say, and their limits.
SECTIONS = ["Bekannte Pfade", "Sortier-Kontexte", "Dokument-Metadaten", "Dokument-Text (Auszug)"]
META_LABELS = ["Datum", "Titel/Inhalt", "Typ", "Tags"]
CONTEXT_LABELS = ["Typ", "Aliase", "Stichworte", "Notiz"]
UNKNOWN, NO_CONTEXTS, REQUEST = "unbekannt", "- keine", "Klassifiziere das Dokument und antworte im JSON-Format."
NOTES, EXCERPT, PROMPT_MOST = 220, 3000, 8_000_000


def depth(path: Column) -> Column:
    return F.length(path) - F.length(F.replace(path, F.lit("/"), F.lit("")))


def context_terms(contexts: DataFrame) -> DataFrame:
    """contexts (path, object_type, aliases, keywords, ord) -> one row a term: path, ord, kind, term, norm, weight."""

    def named(kind: str, weight: int) -> Column:
        return F.transform(F.coalesce(F.col(kind), F.array().cast("array<string>")), lambda t: F.struct(F.lit(kind).alias("kind"), t.alias("term"), F.lit(weight).alias("weight")))

    hint_map = F.create_map(*[x for k, v in HINTS.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    hints = F.transform(F.coalesce(F.try_element_at(hint_map, folded(F.col("object_type"))), F.array().cast("array<string>")), lambda t: F.struct(F.lit("hint").alias("kind"), t.alias("term"), F.lit(HINT).alias("weight")))
    parts = F.filter(F.split("path", "/"), lambda p: (F.length(strip(p)) >= 4) & ~F.lower(strip(p)).isin(PLAIN_PARTS))
    component = F.transform(parts, lambda t: F.struct(F.lit("path").alias("kind"), t.alias("term"), F.lit(COMPONENT).alias("weight")))
    rows = contexts.select("path", "ord", F.posexplode(F.concat(named("aliases", ALIAS), named("keywords", KEYWORD), hints, component)).alias("term_no", "t"))
    rows = rows.select("path", "ord", "term_no", "t.kind", strip(F.col("t.term")).alias("term"), "t.weight")
    return rows.withColumn("norm", folded(F.col("term"))).filter((F.length("term") >= 2) & (F.col("norm") != ""))


def context_hits(docs: DataFrame, contexts: DataFrame) -> DataFrame:
    """docs (doc_id, haystack) -> rows (doc_id, path, ord, term_no, kind, term, weight) of terms that the folded text contains.

    A text contains a term of one word if one of its words does. So each distinct word of the corpus is taken apart
    once, into pieces as long as the terms' first words are, and meets the terms by equality; texts
    are only read again, by their id, for terms of several words.
    """
    terms = staged(context_terms(contexts).withColumn("_first", F.split("norm", " ")[0]), "terms")
    texts = docs.select("doc_id", folded(F.col("haystack")).alias("_text"))
    words = texts.select("doc_id", F.explode(F.array_distinct(F.split("_text", " "))).alias("_word"))
    firsts = terms.select("_first", F.length("_first").alias("_n")).distinct()
    sizes = firsts.agg(F.coalesce(F.array_sort(F.collect_set("_n")), F.array().cast("array<int>")).alias("_sizes"))
    starts = F.sequence(F.lit(1), F.greatest(F.length("_word"), F.lit(1)))
    parts = F.flatten(F.transform("_sizes", lambda k: F.transform(starts, lambda i: F.substring(F.col("_word"), i, k))))
    known = words.select("_word").distinct().join(F.broadcast(sizes)).select("_word", F.explode(F.array_distinct(parts)).alias("_first")).join(firsts, "_first", "left_semi")
    held = joined_to_many(words, known.groupBy("_word").agg(F.collect_set("_first").alias("_firsts")), ["_word"])
    met = joined_to_many(held.select("doc_id", F.explode("_firsts").alias("_first")).distinct(), terms, ["_first"])
    several = F.contains("norm", F.lit(" "))
    checked = met.filter(several).join(spread(texts), "doc_id").filter(F.contains("_text", "norm")).drop("_text")
    return met.filter(~several).unionByName(checked).drop("norm", "_first")


def rank_contexts(docs: DataFrame, contexts: DataFrame, paths: DataFrame) -> DataFrame:
    """doc_id, path, raw_score, score, evidence, place: best first; path parts count only beside an alias or keyword.

    Contexts of paths that ``paths`` doesn't know are left out.
    """
    hits = context_hits(docs, contexts.join(paths.select("path"), "path", "left_semi"))
    strong = F.max(F.col("kind").isin("aliases", "keywords").cast("int"))
    shown = F.array_sort(F.collect_list(F.when(F.col("kind") != "hint", F.struct("term_no", F.concat_ws(":", "kind", "term").alias("e")))))
    base = F.sum(F.when(F.col("kind") != "path", F.col("weight")).otherwise(0))
    parts = F.sum(F.when(F.col("kind") == "path", F.col("weight")).otherwise(0))
    got = hits.groupBy("doc_id", "path", "ord").agg((base + F.when(strong == 1, parts).otherwise(0)).alias("raw_score"), F.when(strong == 1, shown).alias("shown"))
    got = got.filter("raw_score > 0").withColumn("score", F.least(F.lit(TOP), F.col("raw_score") * FACTOR))
    got = got.withColumn("evidence", F.slice(F.transform(F.coalesce("shown", F.array().cast("array<struct<term_no:int,e:string>>")), lambda x: x["e"]), 1, EVIDENCE))
    w = Window.partitionBy("doc_id").orderBy(F.desc("raw_score"), F.desc(depth(F.col("path"))), "ord")
    return got.withColumn("place", F.row_number().over(w)).select("doc_id", "path", "raw_score", "score", "evidence", "place")


def best_context(ranked: DataFrame, least: int = 40, lead: int = 16) -> DataFrame:
    """The best path of each document whose score is high enough and far enough ahead."""
    w = Window.partitionBy("doc_id").orderBy("place")
    ahead = F.col("score") - F.lead("score", 1, 0).over(w)
    return ranked.withColumn("ahead", ahead).filter((F.col("place") == 1) & (F.col("score") >= least) & (F.col("ahead") >= lead)).drop("ahead", "place")


def learning_terms(docs: DataFrame, n: int = 80) -> DataFrame:
    """docs (doc_id, meta_text, text) -> doc_id, term, n, place: identifiers and words, digits and frequent ones first.

    The values in meta_text are taken apart at commas, semicolons, underscores, slashes, pipes and line ends.
    """
    meta = F.regexp_replace(F.coalesce("meta_text", F.lit("")), r"[,;_/|\n]+", " ")
    source = folded(F.concat_ws("\n", meta, F.substring(F.coalesce("text", F.lit("")), 1, TEXT_USED)))
    found = F.concat(*[F.regexp_extract_all("_s", F.lit(p), F.lit(0)) for p in TERM_PATTERNS])
    rows = docs.select("doc_id", source.alias("_s")).select("doc_id", F.posexplode(found).alias("pos", "raw"))
    term = strip(F.regexp_replace(F.regexp_replace("raw", r"^[ .,:;()\[\]{}]+|[ .,:;()\[\]{}]+$", ""), r"(?U)\s+", " "))
    rows = rows.select("doc_id", "pos", term.alias("term")).filter((F.length("term") >= 4) & ~F.col("term").isin(STOP) & ~F.col("term").rlike(r"^\d+$"))
    counted = rows.groupBy("doc_id", "term").agg(F.count("*").alias("n"), F.min("pos").alias("pos"))
    w = Window.partitionBy("doc_id").orderBy(F.desc(F.col("term").rlike(r"\d")), F.desc("n"), F.desc(F.length("term")), "pos")
    return counted.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= n).select("doc_id", "term", "n", "place")


def learn(decisions: DataFrame, terms: DataFrame, rejected: DataFrame, stored: DataFrame) -> DataFrame:
    """Counters (path, kind, term, n) after a lot of decisions.

    decisions (decision_id, doc_id, chosen_path, document_type); rejected (decision_id, path): candidates and
    proposals that were not chosen. Counts stop at MOST; as they only grow, the order of decisions is free.
    """
    t = spread(terms.select("doc_id", "term", "place"))
    pos = decisions.join(t, "doc_id").select(F.col("chosen_path").alias("path"), F.lit("positive").alias("kind"), "term", F.lit(1).alias("n"))
    kinds = decisions.filter("coalesce(document_type, '') <> ''").select(F.col("chosen_path").alias("path"), F.lit("type").alias("kind"), folded(F.col("document_type")).alias("term"), F.lit(2).alias("n"))
    lost = rejected.join(spread(decisions.select("decision_id", "doc_id", "chosen_path")), "decision_id").filter("path <> chosen_path")
    neg = lost.join(spread(t.filter(F.col("place") <= REJECTED)), "doc_id").select("path", F.lit("negative").alias("kind"), "term", F.lit(1).alias("n"))
    return pos.union(kinds).union(neg).union(stored.select("path", "kind", "term", "n")).groupBy("path", "kind", "term").agg(F.least(F.sum("n"), F.lit(MOST)).alias("n"))


def path_stats(decisions: DataFrame) -> DataFrame:
    return decisions.groupBy(F.col("chosen_path").alias("path")).agg(F.count("*").alias("confirmed_count"), F.max("created_at").alias("last_confirmed_at"))


def trim_memory(memory: DataFrame, most: int = PER_PATH) -> DataFrame:
    """The most frequent terms of each path and kind."""
    w = Window.partitionBy("path", "kind").orderBy(F.desc("n"), "term")
    return memory.withColumn("_p", F.row_number().over(w)).filter(F.col("_p") <= most).drop("_p")


def decision_terms(decisions: DataFrame, terms: DataFrame, rejected: DataFrame) -> DataFrame:
    """What each decision adds to counters, in order: path, kind, decision_id, turn (several lists of a decision), place, term, n.

    decisions (decision_id, doc_id, chosen_path, document_type); terms (doc_id, term, place); rejected (decision_id, path, ord):
    candidates and proposals, in the order in which they count.
    """
    t = spread(terms.select("doc_id", "term", "place"))
    named = lambda df, path, kind, turn, n: df.select(F.col(path).alias("path"), F.lit(kind).alias("kind"), "decision_id", turn.cast("int").alias("turn"), F.col("place").cast("int").alias("place"), "term", F.lit(n).alias("n"))
    pos = named(decisions.join(t, "doc_id"), "chosen_path", "positive", F.lit(0), 1)
    types = decisions.withColumn("term", folded(F.col("document_type"))).filter("coalesce(term, '') <> ''").withColumn("place", F.lit(0))
    lost = rejected.withColumnRenamed("path", "_path").join(spread(decisions.select("decision_id", "doc_id", "chosen_path")), "decision_id").filter("_path <> chosen_path")
    neg = named(lost.join(spread(t.filter(F.col("place") <= REJECTED)), "doc_id"), "_path", "negative", F.col("ord"), 1)
    return pos.union(named(types, "chosen_path", "type", F.lit(0), 2)).union(neg)


def replayed(batches: Iterator[pd.DataFrame], most: int = PER_PATH) -> Iterator[pd.DataFrame]:
    """Rows of ``decision_terms`` in order -> the counters of each path and kind as they stand after its last decision."""
    now: tuple | None = None
    decision: int | None = None
    counts: dict[str, int] = {}

    def trimmed() -> dict[str, int]:
        return dict(sorted(counts.items(), key=lambda x: -x[1])[:most])  # equal counts stay as they stood

    def rows() -> pd.DataFrame:
        left = trimmed()
        return pd.DataFrame({"path": now[0], "kind": now[1], "term": list(left), "n": list(left.values())})

    for batch in batches:
        for path, kind, number, term, n in zip(*(batch[c].to_numpy() for c in ("path", "kind", "decision_id", "term", "n")), strict=True):
            if (path, kind) != now:
                if now is not None:
                    yield rows()
                now, decision, counts = (path, kind), number, {}
            elif number != decision:
                decision, counts = number, trimmed()
            counts[term] = min(counts.get(term, 0) + int(n), MOST)
    if now is not None:
        yield rows()


def replay(decisions: DataFrame, terms: DataFrame, rejected: DataFrame, stored: DataFrame) -> DataFrame:
    """Counters (path, kind, term, n) trimmed after every decision, in the order of decision_id: what a decision pushed out counts from nothing when it comes again.

    A fold of its own for each path and kind, over sorted rows: a task holds the counters of one of them. stored counters come first,
    the most frequent in front.
    """
    order = F.row_number().over(Window.partitionBy("path", "kind").orderBy(F.desc("n"), "term"))
    before = stored.select("path", "kind", F.lit(-(1 << 62)).alias("decision_id"), F.lit(0).alias("turn"), order.cast("int").alias("place"), "term", F.col("n").cast("int").alias("n"))
    rows = before.union(decision_terms(decisions, terms, rejected).withColumn("decision_id", F.col("decision_id").cast("long")))
    return rows.repartition("path", "kind").sortWithinPartitions("path", "kind", "decision_id", "turn", "place").mapInPandas(replayed, "path string, kind string, term string, n int")


def trim_decisions(decisions: DataFrame, most: int = DECISIONS) -> DataFrame:
    return decisions.orderBy(F.desc("created_at"), F.desc("decision_id")).limit(most)


def memory_candidates(terms: DataFrame, types: DataFrame, memory: DataFrame, stats: DataFrame, most: int = 5) -> DataFrame:
    """doc_id, path, score, evidence, place by learned terms.

    terms (doc_id, term); types (doc_id, document_type). The first 8 positive and 5 negative hits in
    alphabetical order count. The terms of all documents meet the memory by term: neither side is broadcast, and a term that most
    documents have is dealt to several places.
    """
    hits = joined_to_many(terms.select("doc_id", "term").distinct(), memory.filter("kind in ('positive', 'negative')"), ["term"])
    w = Window.partitionBy("doc_id", "path", "kind").orderBy("term")
    hits = hits.withColumn("at", F.row_number().over(w)).filter((F.col("kind") == "positive") & (F.col("at") <= 8) | (F.col("kind") == "negative") & (F.col("at") <= 5))
    gain = F.when(F.col("kind") == "positive", F.least("n", F.lit(6)) * 6).otherwise(-F.least("n", F.lit(5)) * 5)
    positive = F.array_sort(F.collect_list(F.when(F.col("kind") == "positive", F.col("term"))))
    scored = hits.groupBy("doc_id", "path").agg(F.sum(gain).alias("gain"), positive.alias("evidence")).filter(F.size("evidence") > 0)
    kind = memory.filter("kind = 'type'").select("path", F.col("term").alias("kind_term"), F.least("n", F.lit(6)).alias("kind_n"))
    named = types.select("doc_id", folded(F.col("document_type")).alias("kind_term"))
    scored = scored.join(spread(named), "doc_id", "left").join(kind, ["path", "kind_term"], "left").join(stats.select("path", "confirmed_count"), "path", "left")
    score = F.least(F.coalesce("confirmed_count", F.lit(0)) * 3, F.lit(18)) + F.col("gain") + F.coalesce("kind_n", F.lit(0)) * 5
    scored = scored.withColumn("raw", score).filter("raw >= 18").withColumn("score", F.least("raw", F.lit(TOP)))
    best = Window.partitionBy("doc_id").orderBy(F.desc("score"), F.desc(depth(F.col("path"))), "path")
    return scored.withColumn("place", F.row_number().over(best)).filter(F.col("place") <= most).select("doc_id", "path", "score", "evidence", "place")


def merge_candidates(candidates: DataFrame, paths: DataFrame) -> DataFrame:
    """candidates (doc_id, path, score, reason, evidence, ord) -> one row a document and path, best first.

    Paths take the spelling of a known path. In order, a higher score replaces what was there with its
    evidence; an equal or lower one only adds its evidence.
    """
    known = paths.groupBy(F.lower("path").alias("lower")).agg(F.max("path").alias("known_path"))  # of paths that differ in case the last
    c = candidates.withColumn("lower", F.lower(F.translate(strip(F.col("path")), "\\", "/"))).join(known, "lower", "left")
    c = c.withColumn("path", F.coalesce("known_path", F.translate(strip(F.col("path")), "\\", "/"))).filter("path <> ''")
    one = F.struct("ord", F.greatest(F.lit(0), F.least(F.lit(100), "score")).cast("int").alias("score"), "reason", F.coalesce("evidence", F.array().cast("array<string>")).alias("evidence"))
    groups = c.groupBy("doc_id", "path").agg(F.array_sort(F.collect_list(one)).alias("all"), F.max(F.col("known_path").isNull()).alias("is_new"))
    start = F.struct(F.lit(-1).alias("score"), F.lit("").alias("reason"), F.array().cast("array<string>").alias("evidence"))

    def step(s: Column, x: Column) -> Column:
        keep = s["score"] >= x["score"]
        return F.struct(
            F.greatest(s["score"], x["score"]).alias("score"), F.when(keep, s["reason"]).otherwise(x["reason"]).alias("reason"),
            F.slice(F.array_distinct(F.when(keep, F.concat(s["evidence"], x["evidence"])).otherwise(x["evidence"])), 1, EVIDENCE).alias("evidence"),
        )

    out = groups.withColumn("m", F.aggregate("all", start, step)).select("doc_id", "path", "m.score", "m.reason", "is_new", "m.evidence", F.get("all", F.lit(0))["ord"].alias("first_ord"))
    w = Window.partitionBy("doc_id").orderBy(F.desc("score"), F.desc(depth(F.col("path"))), "first_ord")
    return out.withColumn("place", F.row_number().over(w)).drop("first_ord")


def auto_accept(merged: DataFrame, least: int = 86, lead: int = 10) -> DataFrame:
    """The best candidate where it is high, far ahead and known."""
    w = Window.partitionBy("doc_id").orderBy("place")
    ahead = F.col("score") - F.lead("score", 1, 0).over(w)
    return merged.withColumn("_ahead", ahead).filter((F.col("place") == 1) & (F.col("score") >= least) & (F.col("_ahead") >= lead) & ~F.col("is_new")).drop("_ahead")


def normalize_answer(answers: DataFrame, paths: DataFrame, persons: DataFrame) -> DataFrame:
    """answers (doc_id, raw_path, confidence) -> doc_id, path, is_new, score.

    A known path in any case is taken. Else the first part must be a person (or the catch-all person, or the
    first one); a lone person gets a catch-all child; four levels at most; a new path scores 52.
    """
    known = paths.select(F.lower("path").alias("lower"), F.min("path").over(Window.partitionBy(F.lower("path"))).alias("known_path")).distinct()
    people = persons.select(F.lower("name").alias("lower_name"), "name")
    chief = persons.agg(F.max(F.when(F.col("name") == CATCH_ALL, F.lit(CATCH_ALL))).alias("catch"), F.min_by("name", "ord").alias("first")).select(F.coalesce("catch", "first", F.lit(CATCH_ALL)).alias("chief"))
    raw = F.translate(strip(F.coalesce("raw_path", F.lit(CATCH_ALL))), "\\", "/")
    a = answers.withColumn("raw", raw).withColumn("lower", F.lower("raw")).join(known, "lower", "left").drop("lower")
    parts = F.filter(F.transform(F.split("raw", "/"), strip), lambda p: p != "")
    a = a.withColumn("parts", F.when(F.size(parts) == 0, F.array(F.lit(CATCH_ALL))).otherwise(parts)).withColumn("lower_name", F.lower(F.get("parts", F.lit(0))))
    a = a.join(people, "lower_name", "left").join(F.broadcast(chief))
    first = F.coalesce("name", "chief")
    rest = F.slice("parts", 2, 3)
    built = F.when((F.size("parts") == 1) & (F.lower(first) != CATCH_ALL.lower()), F.array(first, F.lit(CATCH_ALL))).otherwise(F.concat(F.array(first), rest))
    a = a.withColumn("built", F.array_join(built, "/")).withColumn("lower", F.lower("built")).join(known.withColumnRenamed("known_path", "built_path"), "lower", "left")
    is_new = F.col("known_path").isNull() & F.col("built_path").isNull()
    return a.select("doc_id", F.coalesce("known_path", "built_path", "built").alias("path"), is_new.alias("is_new"), F.when(is_new, 52).otherwise(F.col("confidence")).alias("score"))


def residue(docs: DataFrame, *tiers: DataFrame) -> DataFrame:
    """Documents that no tier decided: what the model is asked about."""
    for rows in tiers:
        docs = docs.join(spread(rows.select("doc_id")), "doc_id", "left_anti")
    return docs


CANDIDATE = "array<struct<place:int,path:string,score:int,reason:string,is_new:boolean,evidence:array<string>>>"


def listed(merged: DataFrame) -> DataFrame:
    """doc_id, candidates: the merged candidates of each document, best first."""
    one = F.struct("place", "path", "score", "reason", "is_new", "evidence")
    return merged.groupBy("doc_id").agg(F.array_sort(F.collect_list(one)).alias("candidates"))


def classify(docs: DataFrame, ranked: DataFrame, memory: DataFrame, paths: DataFrame, persons: DataFrame, ask: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """doc_id, path, is_new, reason, confidence, evidence, candidates by the first tier that decides.

    Tiers: a context far ahead; a candidate of contexts and memory that is high, far ahead and known; the model; the best
    candidate; the catch-all. ranked: ``rank_contexts``; memory: ``memory_candidates``; ask: from the documents that are left
    to answers (doc_id, raw_path, confidence, why). What is left is written before the model is asked, so it is asked about nothing else,
    and its answers are written, so it is asked once.
    """
    same = lambda df, reason, first: df.select("doc_id", "path", F.col("score").cast("int").alias("score"), F.lit(reason).alias("reason"), "evidence", (F.col("place") + first).cast("int").alias("ord"))
    ranked = staged(ranked, "ranked")
    merged = staged(merge_candidates(same(ranked, "context", 0).union(same(memory, "memory", 1 << 20)), paths), "candidates")
    none = F.array().cast("array<string>")

    def tier(df: DataFrame, reason: Column, is_new: Column, evidence: Column) -> DataFrame:
        return df.select("doc_id", "path", is_new.alias("is_new"), reason.alias("reason"), F.col("score").cast("int").alias("confidence"), evidence.alias("evidence"))

    first = tier(best_context(ranked), F.lit("context_match"), F.lit(False), F.col("evidence"))
    second = tier(auto_accept(merged).join(spread(first.select("doc_id")), "doc_id", "left_anti"), F.col("reason"), F.col("is_new"), F.col("evidence"))
    decided = staged(first.union(second), "decided")
    left = staged(residue(docs, decided), "residue")
    answers = staged(ask(left), "answers")
    said = normalize_answer(answers, paths, persons)
    third = tier(said, F.lit("llm"), F.col("is_new"), none)
    rest = residue(left, third).select("doc_id").join(spread(merged.filter("place = 1")), "doc_id", "left")
    sure = paths.filter(F.col("path") == CATCH_ALL).agg((F.count("*") == 0).alias("_new"))  # one row
    fourth = rest.join(F.broadcast(sure)).select(
        "doc_id", F.coalesce("path", F.lit(CATCH_ALL)).alias("path"), F.coalesce("is_new", "_new").alias("is_new"), F.lit("fallback").alias("reason"),
        F.coalesce("score", F.lit(0)).alias("confidence"), F.coalesce("evidence", none).alias("evidence"),
    )
    why = answers.select("doc_id", F.when(F.coalesce("why", F.lit("")) != "", F.array("why")).otherwise(none).alias("evidence"))
    asked = said.join(spread(why), "doc_id").select("doc_id", "path", F.col("score").cast("int").alias("score"), F.lit("llm").alias("reason"), "evidence", F.lit(-1).alias("ord"))
    beside = merged.join(spread(asked.select("doc_id")), "doc_id", "left_semi").select("doc_id", "path", "score", "reason", "evidence", F.col("place").alias("ord"))
    shown = listed(merged.join(spread(asked.select("doc_id")), "doc_id", "left_anti")).union(listed(merge_candidates(asked.union(beside), paths)))
    out = decided.union(third).union(fourth).join(spread(shown), "doc_id", "left")
    all_ = F.coalesce("candidates", F.array().cast(CANDIDATE))
    return out.withColumn("candidates", F.when(F.col("reason") == "context_match", all_).otherwise(F.slice(all_, 1, 5)))


def needs_review(results: DataFrame, merged: DataFrame) -> DataFrame:
    """results (doc_id, confidence, is_new) -> adds review: unsure, or two close candidates; new paths are asked for anyway."""
    two = merged.groupBy("doc_id").agg(F.max(F.when(F.col("place") == 1, F.col("score"))).alias("top"), F.max(F.when(F.col("place") == 2, F.col("score"))).alias("second"))
    close = (F.col("top") < 85) & (F.col("top") - F.col("second") <= 8)
    return results.join(spread(two), "doc_id", "left").withColumn("review", ~F.col("is_new") & ((F.col("confidence") < 60) | F.coalesce(close, F.lit(False)))).drop("top", "second")


def normalize_target(df: DataFrame, paths: DataFrame, persons: DataFrame) -> DataFrame:
    """Main folder in its known spelling; adds is_new."""
    people = persons.select(F.lower("name").alias("_lower"), F.col("name").alias("_name"))
    parts = F.split("path", "/")
    out = df.withColumn("_lower", F.lower(F.get(parts, F.lit(0)))).join(people, "_lower", "left")
    out = out.withColumn("path", F.array_join(F.concat(F.array(F.coalesce("_name", F.get(parts, F.lit(0)))), F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0)))), "/"))
    return out.drop("_lower", "_name").join(paths.select("path", F.lit(True).alias("_known")), "path", "left").withColumn("is_new", F.col("_known").isNull()).drop("_known")


def canonical_type(c: Column) -> Column:
    """The first type whose words a name contains; else the name without forbidden signs, in title case."""
    low = F.lower(strip(F.coalesce(c, F.lit(""))))
    out = None
    for name, words in DOC_TYPES.items():
        hit = low.rlike("|".join(words))
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return F.when(low == "", "").otherwise(out.otherwise(F.initcap(strip(F.regexp_replace(c, r'[/*?:"<>|]', "")))))


def type_words() -> Column:
    """Map from a type to its search words, letters and digits only."""
    return F.create_map(*[x for k, v in DOC_TYPES.items() for x in (F.lit(k), F.array(*[F.lit(w) for w in [k.lower(), *v]]))])


def of_type(name: Column, subject: Column, keywords: Column, kind: Column) -> Column:
    """Does a document belong to the type by its file name, subject or keywords?"""
    words = F.coalesce(F.try_element_at(type_words(), kind), F.array(F.lower(kind)))
    plain = F.lower(F.regexp_replace(name, "[^a-zA-Z0-9]", ""))
    named = F.exists(words, lambda w: F.contains(plain, F.regexp_replace(w, "[^a-zA-Z0-9]", "")))
    told = F.exists(words, lambda w: F.contains(F.lower(F.coalesce(subject, F.lit(""))), w) | F.contains(F.lower(F.coalesce(keywords, F.lit(""))), w))
    return named | told


def count_by_type(targets: DataFrame, index: DataFrame) -> DataFrame:
    """targets (path, type), index (path, name, subject, keywords) -> path, type, n: PDF files at or below the path.

    The files below one top folder are dealt to several places, each with a copy of the folder's types.
    """
    up = F.transform(F.sequence(F.lit(1), F.size(F.split("path", "/"))), lambda i: F.array_join(F.slice(F.split("path", "/"), F.lit(1), i), "/"))
    wanted = targets.select("path", "type").distinct()
    kinds = wanted.groupBy("path").agg(F.collect_set("type").alias("types"))  # a path's few types, so that a file meets it once
    below = index.filter(F.lower("name").endswith(".pdf")).select(F.explode(up).alias("path"), "name", "subject", "keywords")
    met = joined_to_many(below, kinds, ["path"])
    hits = met.select("path", F.explode(F.filter("types", lambda t: of_type(F.col("name"), F.col("subject"), F.col("keywords"), t))).alias("type"))
    return wanted.join(hits.groupBy("path", "type").agg(F.count("*").alias("n")), ["path", "type"], "left").withColumn("n", F.coalesce("n", F.lit(0)))


def consolidate(docs: DataFrame, index: DataFrame) -> DataFrame:
    """docs (doc_id, path, document_type), index (path, name, subject, keywords) -> moves (name, old_path, new_path, doc_id).

    A two-level target that has a document of the type gets a sub-folder of the type; the new documents and
    the ones of the type right in the folder go there.
    """
    typed = docs.withColumn("type", canonical_type(F.col("document_type"))).filter((F.size(F.split("path", "/")) == 2) & (F.col("type") != ""))
    full = count_by_type(typed, index).filter("n >= 1").select("path", "type")
    target = F.concat_ws("/", "path", "type")
    new = typed.join(full, ["path", "type"]).select(F.lit(None).cast("string").alias("name"), F.col("path").alias("old_path"), target.alias("new_path"), "doc_id")
    old = full.join(index.filter(F.lower("name").endswith(".pdf")), "path").filter(of_type(F.col("name"), F.col("subject"), F.col("keywords"), F.col("type")))
    return new.union(old.select("name", F.col("path").alias("old_path"), target.alias("new_path"), F.lit(None).cast("long").alias("doc_id")))


def artifacts_for(docs: DataFrame, files: DataFrame, exact: bool = False) -> DataFrame:
    """docs (doc_id, final_name), files (name) -> doc_id, name by prefix and suffix; exact: only the name itself.

    Files join on the leading letters that any prefix match must share, so no text is compared with all others.
    """
    suffix = F.lower(F.regexp_extract("name", r"(\.[^.]*)$", 1))
    f = files.filter(suffix.isin(".pdf", ".txt", ".docx", ".odt", ".doc", ".odoc")).withColumn("_stem", F.regexp_replace("name", r"\.[^.]*$", ""))
    if exact:
        return docs.join(spread(f), docs["final_name"] == f["_stem"]).select("doc_id", "name")
    prefixes = F.transform(F.sequence(F.lit(1), F.length("name")), lambda i: F.substring(F.col("name"), F.lit(1), i))
    return f.select("name", F.explode(prefixes).alias("final_name")).join(spread(docs), "final_name").select("doc_id", "name")


def context_lines(contexts: DataFrame, paths: DataFrame, most: int = 80) -> DataFrame:
    """path, line: what known paths' contexts say, the first by path; a context that says nothing has no line."""
    words = lambda c: F.array_join(F.coalesce(F.col(c), F.array().cast("array<string>")), ", ")
    notes = F.substring(strip(spaced(F.coalesce("notes", F.lit("")))), 1, NOTES)
    said = [F.when(v != "", F.concat(F.lit(f"{label}="), v)) for label, v in zip(CONTEXT_LABELS, (F.coalesce("object_type", F.lit("")), words("aliases"), words("keywords"), notes), strict=True)]
    rows = contexts.join(paths.select("path"), "path", "left_semi").select("path", F.concat_ws("; ", *said).alias("said")).filter("said <> ''")
    return rows.select("path", F.concat(F.lit("- "), "path", F.lit(": "), "said").alias("line")).orderBy("path").limit(most)


def class_prompt(docs: DataFrame, paths: DataFrame, persons: DataFrame, contexts: DataFrame) -> DataFrame:
    """docs (doc_id, date, subject, title, document_type, tags, text) -> doc_id, persons, prompt.

    paths (path, ord) in the order of ord. Each prompt holds all known paths; a list above PROMPT_MOST letters raises an error.
    """
    whole = lambda df, column, name, sep: df.agg(joined(["ord"], column, sep).alias(name))
    lines_ = context_lines(contexts, paths)
    one = [
        whole(paths.select("ord", F.concat(F.lit("- "), "path").alias("line")), "line", "_paths", "\n"), whole(persons, "name", "_persons", ", "),
        lines_.agg(joined(["path"], "line", "\n").alias("_contexts")),
    ]
    out = docs
    for frame in one:
        name = frame.columns[0]
        checked = F.when(F.length(name) > PROMPT_MOST, F.raise_error(F.lit("the known paths are too long for a prompt"))).otherwise(F.coalesce(name, F.lit("")))
        out = out.join(F.broadcast(frame.select(checked.alias(name))))
    known = lambda c: F.coalesce(c, F.lit(UNKNOWN))
    subject = F.coalesce(F.nullif(F.col("subject"), F.lit("")), F.col("title"))
    meta = [F.concat(F.lit(f"- {label}: "), known(c)) for label, c in zip(META_LABELS, (F.col("date"), subject, F.col("document_type"), F.col("tags")), strict=True)]
    sections = [F.col("_paths"), F.when(F.col("_contexts") == "", NO_CONTEXTS).otherwise(F.col("_contexts")), F.concat_ws("\n", *meta), F.substring(F.coalesce("text", F.lit("")), 1, EXCERPT)]
    prompt = F.concat_ws("\n\n", *[F.concat(F.lit(f"{k}:\n"), v) for k, v in zip(SECTIONS, sections, strict=True)], F.lit(REQUEST))
    return out.select("doc_id", F.when(F.col("_persons") == "", CATCH_ALL).otherwise(F.col("_persons")).alias("persons"), prompt.alias("prompt"))
