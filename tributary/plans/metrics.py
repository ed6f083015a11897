"""Counters that a plan fills while it runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F


#: The counter of rows whose value has no counter of its own; null is one such.
OTHER = "(other)"


def counted(df: DataFrame, column: str, values: list[str]) -> tuple[DataFrame, Observation]:
    """df, and an observation of how many of its rows have each value; filled by the next action on df. No extra pass.

    Rows with any other value, or none, are counted under OTHER.
    """
    seen = Observation("counted")
    each = [F.sum(F.when(F.col(column) == v, 1).otherwise(0)).alias(v) for v in values]
    return df.observe(seen, *each, F.sum(F.when(F.col(column).isin(values), 0).otherwise(1)).alias(OTHER)), seen


def observed(df: DataFrame, name: str) -> DataFrame:
    """df with its rows counted under a name in each batch's progress, for a stream's listeners."""
    return df.observe(name, F.count(F.lit(1)).alias("n_rows"))
