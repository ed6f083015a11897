"""Routing rows to partitions by a deterministic hash."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tributary.functions.hashing import fnv1a_bucket


def with_partition(df: DataFrame, payload: str, n: int, hashed: Callable[[Column, int], Column] = fnv1a_bucket, name: str = "partition_id") -> DataFrame:
    """df and the partition of each row's payload. hashed may be any expression from a column and n to 0..n-1."""
    if n < 1:
        raise ValueError("n is 1 at least")
    return df.withColumn(name, hashed(F.col(payload), n))


def partition_by_hash(df: DataFrame, payload: str, n: int, hashed: Callable[[Column, int], Column] = fnv1a_bucket) -> DataFrame:
    """df dealt out so that partition i holds the rows of partition_id i."""
    return with_partition(df, payload, n, hashed).repartitionById(n, F.col("partition_id"))


def partition_by_key(df: DataFrame, n: int, *keys: str) -> DataFrame:
    """df dealt out by Spark's own hash, which needs no column and which later joins and groupings on keys can use."""
    return df.repartition(n, *keys)


def round_robin(df: DataFrame, n: int) -> DataFrame:
    return df.repartition(n)


def histogram(df: DataFrame, payload: str, n: int) -> DataFrame:
    """(partition_id, n_rows)."""
    return with_partition(df, payload, n).groupBy("partition_id").agg(F.count(F.lit(1)).alias("n_rows"))
