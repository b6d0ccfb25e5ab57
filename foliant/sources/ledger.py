"""Tables that change: merge writes into partitions, and batches of several tables that become visible together.

A merge write rewrites the partitions that new rows touch. A batched table is a folder a batch; what a batch wrote
counts once its entry stands in the ledger, which is written last. A batch that failed half-way or runs again
replaces its own folders, and one whose entry stands is left alone: so each batch counts once, in all its tables.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliant.sources.files import shared_dir

ENTRY = "name string, kind string, batch long"
DELTA, FULL = "delta", "full"


def staged(df: DataFrame, name: str) -> DataFrame:
    """A table written to the shared folder and read back."""
    path = f"{shared_dir(df.sparkSession)}/foliant/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def existing(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame | None:
    """The table at a path; none if nothing was written there."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def merge_write(new: DataFrame, path: str, partition: str, keys: list[str]) -> None:
    """Rows into a table partitioned by a text column: a row of the same partition and keys is replaced, all others stay.

    new: one row a partition and keys. Only partitions with new rows are read and written again; a run that is
    repeated changes nothing. An empty partition name and a null one are the same place. The merged
    partitions are staged first, so what a lost run left can be written by running it again.
    """
    new = new.withColumn(partition, F.nullif(F.col(partition), F.lit("")))
    old = existing(new.sparkSession, path, new.schema)
    merged = new
    if old is not None:
        same = lambda other, cols: _all([F.col(f"o.{c}").eqNullSafe(F.col(f"{other}.{c}")) for c in cols])
        inside = old.alias("o").join(new.select(partition).distinct().alias("p"), same("p", [partition]), "left_semi")
        stay = inside.alias("o").join(new.select(partition, *keys).alias("k"), same("k", [partition, *keys]), "left_anti")
        merged = staged(stay.unionByName(new), "merge")
    merged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(partition).parquet(path)


def _all(conditions: list[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out & c
    return out


def entries(spark: SparkSession, path: str) -> DataFrame:
    """What counts: name, kind, batch."""
    found = existing(spark, f"{path}/ledger", ENTRY)
    return spark.createDataFrame([], ENTRY) if found is None else found.select("name", "kind", "batch")


def commit(spark: SparkSession, path: str, batch: int, tables: dict[str, DataFrame], kind: str = DELTA) -> bool:
    """A batch's rows of several tables, all visible at once; false if the batch counts already."""
    if not entries(spark, path).filter((F.col("batch") == batch) & (F.col("kind") == kind) & F.col("name").isin(list(tables))).isEmpty():
        return False
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}/kind={kind}/batch={batch}")
    spark.createDataFrame([(name, kind, batch) for name in tables], ENTRY).coalesce(1).write.mode("overwrite").parquet(f"{path}/ledger/entry={kind}-{'-'.join(tables)}-{batch}")
    return True


def rows(spark: SparkSession, path: str, name: str, schema: str) -> DataFrame:
    """All rows that count, with their batch (and kind): the last full state, if there is one, and the batches after it."""
    known = entries(spark, path).filter(F.col("name") == name)
    last = known.filter(F.col("kind") == FULL).agg(F.max("batch")).first()[0]
    found = existing(spark, f"{path}/{name}", f"{schema}, kind string, batch long")
    if found is None:
        return spark.createDataFrame([], f"{schema}, kind string, batch long")
    if last is not None:
        found = found.filter(((F.col("kind") == FULL) & (F.col("batch") == last)) | ((F.col("kind") == DELTA) & (F.col("batch") > last)))
    return found.join(known.select("kind", "batch"), ["kind", "batch"], "left_semi")


def state(spark: SparkSession, path: str, name: str, schema: str, keys: list[str]) -> DataFrame:
    """The latest row of each key."""
    found = rows(spark, path, name, schema)
    others = [c for c in found.columns if c not in (*keys, "kind", "batch")]
    return found.groupBy(*keys).agg(F.max_by(F.struct(*others), "batch").alias("_s")).select(*keys, "_s.*")


def fold(spark: SparkSession, path: str, name: str, schema: str, keys: list[str], batch: int) -> None:
    """Writes the state up to a batch as one full table, from which ``rows`` and ``state`` go on."""
    commit(spark, path, batch, {name: state(spark, path, name, schema, keys)}, FULL)
