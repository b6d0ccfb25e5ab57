"""Model requests served through a content-addressed cache: lookups are joins, only misses reach a model."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliant.functions.joins import joined_by_size
from foliant.functions.nested import json_text

SCHEMA, PREFIX, ATTEMPTS, CONFIDENCE = "llm_cache_v2", "v2:", 3, 78  # fixed values
ANSWERS = "key string, result string, attempts int, error string"


def cache_key(requests: DataFrame) -> DataFrame:
    """Adds key: prefix and SHA-256 of the request as JSON with its keys in alphabetical order at every depth.

    options: a map or a struct, nested at will; null and missing options and source_hashes are empty.
    """
    kinds = {f.name: f.dataType for f in requests.schema.fields}
    texts = {c: F.coalesce(F.col(c), F.lit("")) for c in ("model", "prompt_version", "system_prompt_hash", "user_prompt_hash")} | {"schema": F.lit(SCHEMA), "task": F.col("task"), "image_sha256": F.col("image_sha256")}
    parts = {k: json_text(c, T.StringType()) for k, c in texts.items()}
    parts |= {c: F.when(F.col(c).isNull(), "{}").otherwise(json_text(F.col(c), kinds[c])) for c in ("options", "source_hashes")}
    whole = F.concat(F.lit("{"), F.concat_ws(",", *[F.concat(F.lit(f'"{k}":'), parts[k]) for k in sorted(parts)]), F.lit("}"))
    return requests.withColumn("key", F.concat(F.lit(PREFIX), F.sha2(whole, 256)))


def legacy_key(raw: Column, model: Column, version: Column) -> Column:
    """MD5 key of older entries; null for an empty text, which is never cached."""
    return F.when(F.coalesce(raw, F.lit("")) != "", F.md5(F.concat_ws(":", F.md5(raw), model, version)))


def cache_lookup(requests: DataFrame, cache: DataFrame, force: bool = False) -> DataFrame:
    """Adds result (null on a miss) and hit; force ignores the cache. Of several entries of a key the latest counts."""
    latest = F.max_by("result_text", F.struct("created_at", "result_text"))
    known = cache.filter(F.lit(not force)).groupBy(F.col("hash_key").alias("key")).agg(latest.alias("result"))
    rows = requests.groupBy("key").agg(F.count("*").alias("n")).join(known, "key")
    return joined_by_size(requests, rows, ["key"], requests.count()).withColumn("hit", F.col("result").isNotNull())


def cache_misses(requests: DataFrame, cache: DataFrame) -> DataFrame:
    """One request for each key that the cache lacks: the smallest request_id."""
    known = cache.select(F.col("hash_key").alias("key"))
    first = requests.groupBy("key").agg(F.min_by(F.struct(*[c for c in requests.columns if c != "key"]), "request_id").alias("_r"))  # no task gets all requests of one key
    return first.join(known, "key", "left_anti").select("key", "_r.*").select(requests.columns)


def cache_upsert(cache: DataFrame, new: DataFrame) -> DataFrame:
    """The cache with new entries; the latest of a key wins, empty results are ignored."""
    both = cache.withColumn("_new", F.lit(0)).unionByName(new.filter("result_text is not null and result_text <> '' and hash_key <> ''").withColumn("_new", F.lit(1)))
    last = Window.partitionBy("hash_key").orderBy(F.desc("created_at"), F.desc("_new"), F.desc("result_text"))
    return both.withColumn("_n", F.row_number().over(last)).filter("_n = 1").drop("_n", "_new")


def rule_scorer(prompts: pd.Series) -> pd.Series:
    """Stand-in for a model: a JSON answer that depends on the prompt alone."""
    return prompts.map(lambda p: f'Answer: {{"document_type": "{"Rechnung" if "Betrag" in p else "Text"}", "confidence": {len(p) % 101}}}')


def infer(misses: DataFrame, scorer: Callable[[pd.Series], pd.Series] = rule_scorer, enabled: bool = True) -> DataFrame:
    """misses (key, prompt) -> ANSWERS. A model switched off gives no rows.

    A batch that fails is halved until a bad request stands alone; that one is tried up to three times, and only it
    comes back without a result. attempts: how often the request was tried in the call that decided it.

    A task may run again after a lost executor, so the scorer must give a key the same answer each time.
    """

    def tried(batch: pd.DataFrame) -> Iterator[pd.DataFrame]:
        tries = ATTEMPTS if len(batch) == 1 else 1
        for attempt in range(1, tries + 1):
            try:
                results = scorer(batch["prompt"])
                if len(results) != len(batch):
                    raise ValueError(f"{len(results)} answers to {len(batch)} requests")
                yield pd.DataFrame({"key": batch["key"].to_numpy(), "result": list(results), "attempts": attempt, "error": None})
                return
            except Exception as e:  # noqa: BLE001  the scorer is foreign code
                error = str(e)[:200]
        if len(batch) == 1:
            yield pd.DataFrame({"key": batch["key"].to_numpy(), "result": None, "attempts": tries, "error": error})
            return
        half = len(batch) // 2
        yield from tried(batch.iloc[:half])
        yield from tried(batch.iloc[half:])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                yield from tried(batch)

    return misses.filter(F.lit(enabled)).select("key", "prompt").mapInPandas(run, ANSWERS)


def parse_answer(c: Column, schema: str = "document_type string, confidence string, score string, wahrscheinlichkeit string, recommended_path string, reason string") -> Column:
    """The JSON between the first { and the last }; null if there is none or it is bad."""
    return F.from_json(F.nullif(F.regexp_extract(c, r"(?s)\{.*\}", 0), F.lit("")), schema)


def confidence(parsed: Column) -> Column:
    """The first of three fields that is a number, cut to an integer from 0 to 100; else the default."""
    numbers = [parsed[k].try_cast("double") for k in ("confidence", "score", "wahrscheinlichkeit")]
    return F.coalesce(*[F.when(x.isNotNull() & ~F.isnan(x), F.greatest(F.lit(0.0), F.least(F.lit(100.0), x)).cast("int")) for x in numbers], F.lit(CONFIDENCE))
