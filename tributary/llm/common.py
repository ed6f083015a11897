"""Helpers that the operators of this subpackage share: row ids, tables in the shared folder, word splitting."""

from __future__ import annotations

import threading
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tributary.session import shared_dir, table

#: Row id that every operator works with. Ids of a table may be null or repeated; this one never is.
ROW = "__row"


def cut(df: DataFrame, batch: int = 1024) -> DataFrame:
    """Write df to the shared folder and read it again. The lineage ends there, and a lost executor costs nothing.

    While it runs, batches of batch rows at most go to Python, so that a worker holds little; the session's own setting
    holds again after.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tributary/{uuid.uuid4().hex}"
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    was = spark.conf.get(key)
    spark.conf.set(key, str(min(batch, int(was)) if int(was) > 0 else batch))
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(key, was)
    out = spark.read.schema(df.schema).parquet(path)
    out._tributary_path = path
    if _SCOPES.open:
        _SCOPES.open[-1].append(out)
    return out


class _Scopes(threading.local):
    """The tables that cut() has written in each open scope() of a thread."""

    def __init__(self):
        self.open: list[list[DataFrame]] = []


_SCOPES = _Scopes()


@contextmanager
def scope() -> Iterator[None]:
    """Tables that cut() writes inside are deleted at the end, but for those that went through keep()."""
    made: list[DataFrame] = []
    _SCOPES.open.append(made)
    try:
        yield
    finally:
        _SCOPES.open.pop()
        release(*made)


def keep(df: DataFrame) -> DataFrame:
    """A table that cut() wrote and that outlives the scope; the next outer one, if any, has it then."""
    inner = _SCOPES.open[-1]
    inner[:] = [x for x in inner if x is not df]
    if len(_SCOPES.open) > 1:
        _SCOPES.open[-2].append(df)
    return df


def release(*frames: DataFrame) -> None:
    """Delete tables that cut() wrote, once nothing reads them any more."""
    for df in frames:
        if path := getattr(df, "_tributary_path", None):
            spark = df.sparkSession
            p = spark._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def documents(spark: SparkSession, sf_dir: str, name: str = "documents") -> DataFrame:
    """A table of the data folder."""
    return table(spark, sf_dir, name)


def rows(df: DataFrame, **columns: str) -> DataFrame:
    """The named columns under fixed names and a row id; other columns, whatever their names, are left out.

    rows(df, id="doc_id", text="text") has __row, id and text.
    """
    return df.select(F.monotonically_increasing_id().alias(ROW), *[df[c].alias(k) for k, c in columns.items()])


def by_batches(df: DataFrame, work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str | StructType, n: int = 1024) -> DataFrame:
    """df through work, whose batches have n rows at most, so that what it makes of one stays small.

    Spark holds the batches that it sends to 10,000 rows and 64 MB; the session's settings stay as they are.
    """

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return work(b.slice(at, n) for b in batches for at in range(0, b.num_rows, n))

    return df.mapInArrow(each, schema)


def unsigned_hex(c: Column) -> Column:
    """A long as 16 lowercase hex digits of its unsigned value."""
    return F.lower(F.lpad(F.hex(c), 16, "0"))


def maybe_broadcast(df: DataFrame, n: int, most: int = 20_000) -> DataFrame:
    """A broadcast hint for a table that was counted and is small; beyond it the join shuffles and AQE splits hot keys."""
    return F.broadcast(df) if n <= most else df


def numbered(df: DataFrame) -> DataFrame:
    """All columns of df under c0, c1, ... and the row id that rows(df) gives; df is a stored table, read alike each time."""
    return df.select(F.monotonically_increasing_id().alias(ROW), *[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(df.columns)])


def renamed(made: DataFrame, df: DataFrame, **new: Column) -> DataFrame:
    """The columns of numbered(df) under their own names again; new gives other values for some."""
    return made.select(*[new.get(c, F.col(f"c{i}")).alias(c) for i, c in enumerate(df.columns)])


def ordered_ids(df: DataFrame, id: str = "id", parts: int = 64) -> DataFrame:
    """df with a long, order, that sorts as the values of id do; null for null. Only ids are sorted, and in ranges."""
    ids = df.select(id).where(F.col(id).isNotNull()).distinct()
    ranged = cut(ids.repartitionByRange(parts, id).withColumn("part", F.spark_partition_id()))
    rank = F.row_number().over(Window.partitionBy("part").orderBy(id))
    told = cut(ranged.select(F.col(id).alias("__of"), (F.col("part").cast("long") * (1 << 40) + rank).alias("order")))
    release(ranged)
    return df.join(told, F.col(id) == F.col("__of"), "left").drop("__of")
