"""Helpers that the operators share: shared storage, word splitting, hashing."""

from __future__ import annotations

import uuid
from math import isqrt

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliant.functions.joins import joined_by_size as joined_by_size
from foliant.sources.files import shared_dir

#: Odd constants of the 64-bit finaliser below (fixed values).
MIX_A, MIX_B = 0xBF58476D1CE4E5B9, 0x94D049BB133111EB


def written(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/foliant/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def column(name: str) -> Column:
    """A column by its name, whatever signs are in it."""
    return F.col("`" + name.replace("`", "``") + "`")


def numbered(docs: DataFrame) -> DataFrame:
    """The columns of docs as c0, c1, ..., whatever their names, then _id (doc_id) and _part: both together name a row.

    _part is 0 where every doc_id stands once, and 1 without a doc_id. Where some repeat (null is one too), the rows
    are numbered from 2 on and written, so that a row keeps its number; else nothing moves but the ids.
    """
    rows = docs.select(*[column(c).alias(f"c{i}") for i, c in enumerate(docs.columns)], F.col("doc_id").cast("long").alias("_id"))
    if rows.groupBy("_id").agg(F.count("*").alias("n")).filter("n > 1").isEmpty():
        return rows.withColumn("_part", F.col("_id").isNull().cast("long"))
    return written(rows.withColumn("_part", F.monotonically_increasing_id() + 2), "numbered")


def in_key_order(docs: DataFrame) -> DataFrame:
    """As ``numbered``, with _key: one number a row, in the order of doc_id, null last, rows of one doc_id as they stand."""
    rows = numbered(docs)
    if rows.filter("_part > 1").isEmpty():
        return rows.withColumn("_key", F.coalesce("_id", F.lit(2**63 - 1)))
    ranked = rows.select("_id", "_part").orderBy(F.col("_id").isNull(), "_id", "_part").select("_part", F.monotonically_increasing_id().alias("_key"))
    return rows.join(written(ranked, "keys"), "_part")


def place_of(docs: DataFrame, column: str) -> str:
    """The name that ``numbered`` gives to a column."""
    return f"c{docs.columns.index(column)}"


def restored(rows: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of docs under their own names."""
    return rows.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns)])


def renamed_schema(docs: DataFrame) -> T.StructType:
    return T.StructType([T.StructField(f"c{i}", f.dataType, True) for i, f in enumerate(docs.schema.fields)])


def without(docs: DataFrame, rows: DataFrame, gone: DataFrame) -> DataFrame:
    """docs without the rows that gone (_id, _part) names; rows: ``numbered`` docs."""
    g = gone.select(F.col("_id").alias("_gone"), F.col("_part").alias("_gone_part"))
    return restored(rows.join(g, F.col("_id").eqNullSafe(F.col("_gone")) & (F.col("_part") == F.col("_gone_part")), "left_anti"), docs)


#: Of rows the one that stays: smallest doc_id, null last, then the first row.
FIRST = "struct(_id IS NULL AS none, _id, _part)"


def text_bytes(column: str = "text") -> Column:
    """Whole text as UTF-8 bytes; null counts as empty."""
    return F.coalesce(F.col(column), F.lit("")).cast("binary")


def mixed(h: np.ndarray, seed: int) -> np.ndarray:
    """Another 64-bit hash for each 64-bit hash; a bijection for each seed."""
    with np.errstate(over="ignore"):
        x = h + np.uint64((0x9E3779B97F4A7C15 * (seed + 1)) & 0xFFFFFFFFFFFFFFFF)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(MIX_A)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(MIX_B)
        return x ^ (x >> np.uint64(31))


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def shingle_hashes(words: list[bytes], width: int) -> np.ndarray:
    """A hash of each run of ``width`` words, in order; empty for fewer words."""
    n = len(words) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    h = word_hashes(words)
    out = h[:n].copy()
    with np.errstate(over="ignore"):
        for i in range(1, width):
            out = mixed(out, i) + h[i : i + n]
    return mixed(out, 0)


def leading(rows: DataFrame, keys: list[str], order: list[Column], n: int, deal: list[str], rank: str = "rank") -> DataFrame:
    """The first n rows of each key in the given order, numbered from 1 in column ``rank``.

    Rows of one key are dealt by a hash of ``deal`` and narrowed in two steps before they meet, so no task
    gets n rows of every partition.
    """
    parts = partitions(rows.sparkSession)
    dealt = rows.withColumn("_deal", F.pmod(F.xxhash64(*deal), F.lit(parts)))
    for step in (["_deal"], ["_few"], []):
        dealt = dealt.withColumn("_few", F.col("_deal") % max(1, isqrt(parts))) if step == ["_few"] else dealt
        dealt = dealt.withColumn(rank, F.row_number().over(Window.partitionBy(*keys, *step).orderBy(*order))).filter(F.col(rank) <= n)
    return dealt.drop("_deal", "_few")
