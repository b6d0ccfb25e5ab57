"""Joins that keep the rows of one very common key out of one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Keys that may be called hot in a join, at most: each has more than this share of the rows.
HOT = 1000


def spread(rows: DataFrame) -> DataFrame:
    """A side of a join that grows with the corpus: both sides meet by their key in sorted order, and none is broadcast.

    Spark takes a table for as large as its files, so texts and ids of millions of rows that compress well would go through the driver.
    """
    return rows.hint("merge")


def joined_by_size(rows: DataFrame, known: DataFrame, keys: list[str], total: int, n: str = "n") -> DataFrame:
    """rows left join known (one row a key; n: how many rows have it; null keys meet nothing).

    Keys with more than total / HOT rows are fewer than HOT: these are broadcast, so that no task gets all
    rows of one key. The others meet by their key.
    """
    bound = total // HOT
    hot, cold = F.broadcast(known.filter(F.col(n) > bound).drop(n)), known.filter(F.col(n) <= bound).drop(n)
    rest = rows.join(hot.select(keys), keys, "left_anti").join(cold, keys, "left")
    return rows.join(hot, keys).unionByName(rest)


def joined_to_many(rows: DataFrame, known: DataFrame, keys: list[str], parts: int = 16) -> DataFrame:
    """rows inner join known, where a key may have many rows on the left: these are dealt to ``parts`` places, each with a copy of the key's rows in known."""
    dealt = rows.withColumn("_deal", F.pmod(F.xxhash64(*[c for c in rows.columns if c not in keys]), F.lit(parts)).cast("int"))
    copies = known.withColumn("_deal", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    return spread(dealt).join(copies, [*keys, "_deal"]).drop("_deal")
