"""Files as they lie in a folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def listing(spark: SparkSession, path: str) -> DataFrame:
    """(path, length, modificationTime) of all files under a folder; contents aren't read, and files that vanish are left out."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("ignoreMissingFiles", "true").load(path).select("path", "length", "modificationTime")


def dir_size(spark: SparkSession, path: str) -> DataFrame:
    """(n_bytes): the sum of the sizes of all files under a folder."""
    return listing(spark, path).agg(F.coalesce(F.sum("length"), F.lit(0)).alias("n_bytes"))
