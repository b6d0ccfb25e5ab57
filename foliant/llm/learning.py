"""Bounded samples of labelled documents for the models that are fitted in one place."""

from __future__ import annotations

from math import isqrt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliant.llm.common import partitions, written


def remainder(modulus: int) -> Column:
    """crc32 of doc_id as text, modulo; a null doc_id counts as the empty text."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % modulus


#: Rows that each class gets at least, as far as it has them, beside the bounded draw.
LEAST = 200


#: Buckets of one look at the hashes (a power of two), and rows of the last bucket that are put in order together.
BUCKET_BITS, TOGETHER = 12, 1000


def first_by_hash(rows: DataFrame, bound: int) -> DataFrame:
    """The ``bound`` rows with the least ``_h`` (a long; ties by doc_id); rows is a written table.

    Rows are counted by the leading bits of their hashes, then by further bits within the bucket that the last row
    lies in, until few are left there. What lies below that bucket is kept where it stands; only the rest of
    the bucket is put in order, in one task.
    """
    shift, need, inside, below = 64 - BUCKET_BITS, bound, F.lit(True), F.lit(False)
    while True:
        bucket = F.shiftright("_h", shift)
        counts = sorted(rows.filter(inside).groupBy(bucket.alias("b")).count().collect())
        for at, n in counts:
            if n >= need:
                break
            need -= n
        else:
            return rows
        inside, below = bucket == at, bucket < at
        if n <= max(TOGETHER, need) or shift == 0:
            return rows.filter(below).union(rows.filter(inside).orderBy("_h", "doc_id").limit(need))
        shift = max(0, shift - BUCKET_BITS)


def sampled(labels: DataFrame, keep: Column, bound: int, label: str = "label") -> DataFrame:
    """labels (doc_id, label) -> at most ``bound`` rows in the order of doc_id's hash, and the first LEAST of each class.

    A repeated doc_id counts once, with its least label. The result is written: it is the same wherever it is used.
    """
    rows = written(labels.filter(keep).groupBy("doc_id").agg(F.min(label).alias(label)).withColumn("_h", F.xxhash64("doc_id")), "labelled")
    part = F.pmod("_h", F.lit(partitions(labels.sparkSession)))

    def first(df: DataFrame, *keys) -> DataFrame:
        return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy("_h", "doc_id"))).filter(F.col("_n") <= LEAST).drop("_n")

    few = F.col("_part") % isqrt(partitions(labels.sparkSession))  # no task gets LEAST rows of every partition
    rare = first(first(first(rows.withColumn("_part", part), label, "_part"), label, few), label).drop("_part")
    drawn = first_by_hash(rows, bound)
    return written(drawn.union(rare).distinct().drop("_h"), "sample")


def labelled_texts(docs: DataFrame, labels: DataFrame, label: str, keep: Column, bound: int) -> DataFrame:
    """doc_id, label, text of a bounded sample; the sample's ids are few enough to broadcast."""
    chosen = sampled(labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("label")).filter("label is not null and doc_id is not null"), keep, bound)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(chosen), "doc_id")
