"""Training corpus from raw documents, stage by stage; each stage's rows are written and read again by the next.

Toxic documents go, of exact copies the smallest doc_id stays, of near copies one document, passages that an
earlier document has are cut out, and what is left is packed into token sequences.

Defined results: decisions belong to rows, so rows that share a doc_id (or have none) but not their text are
decided apart, and of repeated rows one stays. Null and empty texts count as empty ones: they aren't toxic,
one of them stays, and it is packed as its end alone. Very long texts are read whole. Columns besides doc_id
and text come through all stages but the last, whatever their names; n_chars follows a text that is cut. An
empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from foliant.llm import entries, exact, packing, simhash, toxicity, windows
from foliant.llm.common import written


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.drop_toxic(docs, entries.table(spark, sf_dir, "labels"))


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact.drop_copies(docs)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.drop_near(docs)


def without_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return windows.drop_passages(docs)


def into_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.packed_documents(docs, entries.vocabulary(entries.WORD_BPE))


STAGES = [
    ("toxicity", without_toxic),
    ("exact_dedup", without_copies),
    ("simhash_near_dedup", without_near_copies),
    ("substring_dedup", without_passages),
    ("best_fit_packing", into_sequences),
]

#: The toxicity model, the fingerprints and the tokenizer are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = entries.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
