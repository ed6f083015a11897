"""Cutting payloads into numbered chunks and putting them together again."""

from __future__ import annotations

import gzip

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A batch of so many statements, or one with a statement of so many bytes, is worth compressing.
BATCH_STATEMENTS, STATEMENT_BYTES = 50, 1024


@F.pandas_udf(T.BinaryType())
def compress(data: pd.Series) -> pd.Series:
    """gzip at its best level; the time in the header is 0, so equal data give equal bytes."""
    return data.map(lambda b: gzip.compress(b, 9, mtime=0), na_action="ignore")


@F.pandas_udf(T.BinaryType())
def uncompress(data: pd.Series) -> pd.Series:
    return data.map(gzip.decompress, na_action="ignore")


def worth_compressing(statements: Column) -> Column:
    """Whether an array of statements is large enough to try compression."""
    return (F.size(statements) >= BATCH_STATEMENTS) | F.exists(statements, lambda s: F.octet_length(s) >= STATEMENT_BYTES)


def compress_if_smaller(df: DataFrame, data: str, attempt: Column, force: bool = False) -> DataFrame:
    """df with data compressed, and compressed = true, where it was worth an attempt and came out smaller, or by force."""
    tried = df.withColumn("__small", F.when(attempt | F.lit(force), compress(F.col(data))))
    better = F.col("__small").isNotNull() & (F.lit(force) | (F.octet_length("__small") < F.octet_length(data)))
    return tried.withColumn("compressed", better).withColumn(data, F.when(F.col("compressed"), F.col("__small")).otherwise(F.col(data))).drop("__small")


def chunk(df: DataFrame, stream: str, data: str, size: int, gzipped: bool = False) -> DataFrame:
    """(stream_id, sequence_num, is_last, data) of each payload, in chunks of size bytes, numbered from 1.

    The last chunk is one that isn't full, so a payload of full chunks gets an empty last one; an empty or null one
    gets none. Rows are exploded where they are; nothing is shuffled.
    """
    raw = F.col(data).cast("binary")
    n = F.octet_length(raw)
    number = F.explode(F.sequence(F.lit(1), F.floor(n / size).cast("int") + 1))
    cut = df.where(F.coalesce(n, F.lit(0)) > 0).select(F.col(stream).alias("stream_id"), number.alias("sequence_num"), raw.alias("__raw"))
    part = F.substr("__raw", (F.col("sequence_num") - 1) * size + 1, F.lit(size))
    made = cut.select("stream_id", F.col("sequence_num").cast("long").alias("sequence_num"), (F.octet_length(part) < size).alias("is_last"), part.alias("data"))
    return made.withColumn("data", F.when(F.octet_length("data") > 0, compress(F.col("data"))).otherwise(F.col("data"))) if gzipped else made


def abort(stream: Column) -> Column:
    """The chunk that tells a receiver to give a stream up."""
    return F.struct(stream.alias("stream_id"), F.lit(0).cast("long").alias("sequence_num"), F.lit(True).alias("is_last"), F.lit(True).alias("abort"), F.lit(None).cast("binary").alias("data"))


def dechunk(df: DataFrame, gzipped: bool = False) -> DataFrame:
    """(stream_id, n_chunks, data, error) of each stream of chunks, in whatever order they are stored.

    Numbers must go from 1 up by one and end in a last chunk; else error says what is wrong and data is null.
    """
    if gzipped:
        df = df.withColumn("data", F.when(F.octet_length("data") > 0, uncompress(F.col("data"))).otherwise(F.col("data")))
    grouped = df.groupBy("stream_id").agg(
        F.count(F.lit(1)).alias("n_chunks"),
        F.min("sequence_num").alias("low"),
        F.max("sequence_num").alias("high"),
        F.count_distinct("sequence_num").alias("distinct"),
        F.max_by("is_last", "sequence_num").alias("ended"),
        F.sum(F.col("is_last").cast("int")).alias("lasts"),
        F.collect_list(F.struct("sequence_num", "data")).alias("parts"),
    )
    error = F.when((F.col("low") != 1) | (F.col("high") != F.col("n_chunks")) | (F.col("distinct") != F.col("n_chunks")), "chunks out of order").when(~F.col("ended") | (F.col("lasts") != 1), "no last chunk")
    whole = F.aggregate(F.transform(F.sort_array("parts"), lambda p: F.coalesce(p["data"], F.lit(b""))), F.lit(b""), lambda a, b: F.concat(a, b))
    return grouped.select("stream_id", "n_chunks", F.when(error.isNull(), whole).alias("data"), error.alias("error"))


