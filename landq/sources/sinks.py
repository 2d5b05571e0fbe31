"""Tables on disk that are kept up to date by key: rows lie in buckets by a hash of the key, and a run rewrites only the buckets it touches."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from landq.operators import tables
from landq.session import shared_folder

BUCKET = "_bucket"


def bucket_of(keys: list[str], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")


def write_table(df: DataFrame, path: str, keys: list[str], buckets: int, mode: str = "overwrite") -> None:
    """`df` below `path`, one folder for each bucket. Buckets in `df` replace those on disk; others stay as they are.

    Rows are dealt by bucket first, so that a bucket is few files; adaptive execution splits one that is too large for a task.
    """
    (df.withColumn(BUCKET, bucket_of(keys, buckets)).hint("rebalance", BUCKET).write.mode(mode)
     .option("partitionOverwriteMode", "dynamic").partitionBy(BUCKET).parquet(path))


def read_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).drop(BUCKET)


def _rewrite(path: str, new: DataFrame, keys: list[str], buckets: int, merge: Callable[[DataFrame, DataFrame], DataFrame]) -> None:
    """Merge `new` into the buckets that hold its keys.

    The touched buckets, at most `buckets` small numbers, become a filter on folders, so no other bucket is read. The merged
    rows are written to the shared folder before any bucket is replaced: a run that breaks off leaves old or new buckets,
    and running it again ends in the same table.
    """
    spark = new.sparkSession
    keyed = new.withColumn(BUCKET, bucket_of(keys, buckets))
    touched = [row[0] for row in keyed.select(BUCKET).distinct().collect()]
    if not touched:
        return
    old = spark.read.parquet(path).where(F.col(BUCKET).isin(touched)).drop(BUCKET)
    work = shared_folder(spark, "merge")
    merge(old, new).write.parquet(work)
    write_table(spark.read.schema(old.schema).parquet(work), path, keys, buckets)


def replace_in_table(path: str, new: DataFrame, keys: list[str], buckets: int) -> None:
    """`replace_by_key` on a table of `write_table`: the stored rows of keys in `new` give way to its rows."""
    _rewrite(path, new, keys, buckets, lambda old, rows: tables.replace_by_key(old, rows, keys))


def upsert_in_table(path: str, changes: DataFrame, key: str, buckets: int, insert: bool = False) -> None:
    """`upsert_partial` on a table of `write_table`; `changes` has one row per key, and its NULLs keep what is stored."""
    _rewrite(path, changes, [key], buckets, lambda old, rows: tables.upsert_partial(old, rows, key, insert))
