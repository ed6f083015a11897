"""Sessions and tables."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def session(app: str = "tributary", master: str | None = None, shuffle_partitions: int | None = None, **conf: str) -> SparkSession:
    """A session in UTC with AQE. The number of shuffle partitions is left to the cluster unless given."""
    builder = SparkSession.builder.appName(app).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true")
    if master:
        builder = builder.master(master)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for k, v in conf.items():
        builder = builder.config(k, v)
    return builder.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A Parquet table of a data folder, read lazily."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where that is unset, a temporary one of this
    machine if all executors are on it (a local master), else an error."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("tributary.checkpoint.dir", None)
    if not found:
        master = spark.conf.get("spark.master", "")
        if not (master == "local" or master.startswith("local[")):
            raise ValueError(f"spark.checkpoint.dir must name a folder that driver and executors share; the master is {master}")
        found = "file://" + tempfile.mkdtemp(prefix="tributary-")
        spark.conf.set("tributary.checkpoint.dir", found)
    return found.rstrip("/")


def scratch(spark: SparkSession, kind: str = "stream") -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/tributary/{kind}-{uuid.uuid4().hex}"


def ship(spark: SparkSession) -> None:
    """Lets Python workers of this machine import the package, wherever the driver was started. On a cluster the package
    comes with --py-files or is installed."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    env = spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (root, env.get("PYTHONPATH", "")) if x)
