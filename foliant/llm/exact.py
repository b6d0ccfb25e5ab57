"""Operator 5 (native): exact deduplication by content-defined chunk recipes.

White-space runs become one space. A text is cut where its own letters say so (so equal passages give
equal chunks wherever they stand), each distinct chunk is moved once and gets an identifier that the
chunk's content has verified, and documents are compared by their ordered identifier lists alone.

Defined results: a null text counts as empty; empty texts form one group, a text of white space only
is a single space and differs from them; of equal texts exactly one row stays: the smallest doc_id, null
last, and of repeated rows of that doc_id the first in the table; all rows of a group report its keep_id and
count in group_size, and rows that share a doc_id but not their text are decided apart; very long texts are
cut whole, into chunks of 2048 letters at most; an empty table gives no rows. Columns other than doc_id and
text are ignored by the groups and kept by ``drop_copies``, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliant.llm.common import FIRST, joined_by_size, numbered, place_of, without, written

SPACES = r"[\x20\x09-\x0D]+"
#: A chunk ends after 256 to 2048 letters where a word ends in d-f and the next begins with a-c, else at 2048.
CHUNK = r"(?s).{255,2047}?[d-f] (?=[a-c])|.{1,2048}"


def normalised(column: str = "text") -> Column:
    return F.regexp_replace(F.coalesce(F.col(column), F.lit("")), SPACES, " ")


def chunks(text: Column) -> Column:
    """The text in pieces, in order; joined they give the text."""
    return F.regexp_extract_all(text, F.lit(CHUNK), F.lit(0))


def recipes(rows: DataFrame, digest: Callable[[Column], Column] = lambda c: F.xxhash64(c)) -> DataFrame:
    """rows (_id, _part, text) -> _id, _part, hashes array, variants array, text_sha256: equal (hashes, variants) means equal texts.

    Each text is cut once. The distinct chunks of each hash are counted by content. Where one hash stands for
    several chunks, they are numbered, and the recipes carry the numbers too.
    """
    cut = written(rows.select("_id", "_part", chunks(F.col("text")).alias("chunks"), F.sha2("text", 256).alias("text_sha256")), "chunks")
    distinct = cut.select(F.explode("chunks").alias("chunk")).select(digest(F.col("chunk")).alias("hash"), "chunk").groupBy("hash", "chunk").agg(F.count("*").alias("uses"))
    shared = distinct.groupBy("hash").agg(F.count("*").alias("n")).filter("n > 1")
    if shared.isEmpty():
        return cut.select("_id", "_part", F.transform("chunks", digest).alias("hashes"), F.array().cast("array<int>").alias("variants"), "text_sha256")
    number = Window.partitionBy("hash").orderBy("chunk")
    variants = distinct.join(shared, "hash", "left_semi").select("hash", "chunk", F.row_number().over(number).alias("variant"))
    uses = cut.select("_id", "_part", "text_sha256", F.posexplode_outer("chunks").alias("at", "chunk"))
    named = uses.withColumn("hash", digest(F.col("chunk"))).join(variants, ["hash", "chunk"], "left")
    ordered = F.array_sort(F.collect_list(F.when(F.col("at").isNotNull(), F.struct("at", "hash", F.coalesce("variant", F.lit(0)).alias("variant")))))
    return named.groupBy("_id", "_part", "text_sha256").agg(ordered.alias("parts")).select("_id", "_part", F.col("parts.hash").alias("hashes"), F.col("parts.variant").alias("variants"), "text_sha256")


def decided(rows: DataFrame, digest: Callable[[Column], Column] = lambda c: F.xxhash64(c)) -> DataFrame:
    """rows (_id, _part, text) -> _id, _part, keep_id, group_size, kept, text_sha256."""
    made = written(recipes(rows, digest), "recipes")
    groups = made.groupBy("hashes", "variants").agg(F.min(F.expr(FIRST)).alias("first"), F.count("*").alias("group_size")).filter("group_size > 1")
    known = groups.select("hashes", "variants", F.col("first._id").alias("keep_id"), F.col("first._part").alias("keep_part"), "group_size", F.col("group_size").alias("n"))
    alone = F.col("group_size").isNull()
    return joined_by_size(made, known, ["hashes", "variants"], made.count()).select(
        "_id", "_part",
        F.when(alone, F.col("_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).alias("group_size"),
        (alone | F.col("_id").eqNullSafe(F.col("keep_id")) & (F.col("_part") == F.col("keep_part"))).alias("kept"),
        "text_sha256",
    )


def exact_groups(docs: DataFrame, digest: Callable[[Column], Column] = lambda c: F.xxhash64(c)) -> DataFrame:
    """One row a document: doc_id, keep_id, group_size, kept, text_sha256."""
    rows = numbered(docs.select("doc_id", "text")).select("_id", "_part", normalised("c1").alias("text"))
    return decided(rows, digest).select(F.col("_id").alias("doc_id"), "keep_id", "group_size", "kept", "text_sha256")


def drop_copies(docs: DataFrame) -> DataFrame:
    """The documents that stay, with all their columns: exactly one row of each group of equal texts."""
    rows = numbered(docs)
    texts = rows.select("_id", "_part", normalised(place_of(docs, "text")).alias("text"))
    return without(docs, rows, decided(texts).filter("not kept"))
