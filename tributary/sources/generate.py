"""Random workloads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Shares of inserts and updates; the rest are deletions.
INSERTS, UPDATES = 0.45, 0.45


def changes(spark: SparkSession, n: int, users: int = 1000, seed: int = 0, partitions: int | None = None) -> DataFrame:
    """(seq, op, user_id, value): n changes of user profiles, made where they are needed; alike for one seed."""
    draw = lambda k: (F.pmod(F.xxhash64("id", F.lit(seed), F.lit(k)), F.lit(1_000_000)) / 1_000_000.0)
    rows = spark.range(0, n, 1, partitions) if partitions else spark.range(n)
    op = F.when(draw(1) < INSERTS, "insert").when(draw(1) < INSERTS + UPDATES, "update").otherwise("delete")
    value = F.when(op != "delete", F.to_json(F.struct(F.concat(F.lit("user"), (draw(2) * users).cast("long")).alias("name"), F.floor(draw(3) * 80 + 10).alias("age"))))
    return rows.select(F.col("id").alias("seq"), op.alias("op"), (draw(2) * users).cast("long").alias("user_id"), value.alias("value"))
