"""Row and stream transforms, and chains of them. All take and return DataFrames, batch or streaming."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tributary.functions import json as J


class Operation(Protocol):
    """A step of a pipeline: a name and a plan."""

    id: str

    def apply(self, df: DataFrame) -> DataFrame: ...


@dataclass(frozen=True)
class Step:
    """An operation made of a function from DataFrame to DataFrame."""

    id: str
    function: Callable[[DataFrame], DataFrame]

    def apply(self, df: DataFrame) -> DataFrame:
        return df.transform(self.function)


@dataclass
class Chain:
    """Operations in order; one may be looked up by id, and has the one before it as its parent."""

    operations: list[Operation] = field(default_factory=list)

    def add(self, operation: Operation) -> Chain:
        if any(o.id == operation.id for o in self.operations):
            raise ValueError(f"two operations named {operation.id}")
        self.operations.append(operation)
        return self

    def parent(self, id: str) -> Operation | None:
        at = [o.id for o in self.operations].index(id)
        return self.operations[at - 1] if at else None

    def apply(self, df: DataFrame) -> DataFrame:
        for o in self.operations:
            df = o.apply(df)
        return df


def map_rows(name: str, *columns: Column) -> Step:
    """One row to one row, by expressions."""
    return Step(name, lambda df: df.select(*columns))


def map_batches(name: str, function: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]], schema: str) -> Step:
    """One row to any rows, by a function on pandas batches; for what expressions can't say."""
    return Step(name, lambda df: df.mapInPandas(function, schema))


def prefix_lines(df: DataFrame, column: str, prefix: str = "Processed: ") -> DataFrame:
    return df.withColumn(column, F.concat(F.lit(prefix), F.col(column)))


def upper_payload(df: DataFrame, column: str, schema: T.DataType | str | None = None) -> DataFrame:
    """Rows with a payload, the strings in its objects in upper case.

    A struct, map or array column changes as it is. Of JSON text, schema gives the type to parse by, and the column
    is that type then; without a schema the text is rewritten by a pandas UDF.
    """
    df = df.where(F.col(column).isNotNull())
    kind = df.schema[column].dataType
    if not isinstance(kind, T.StringType):
        return df.withColumn(column, J.upper_values(F.col(column), kind))
    if schema is None:
        return df.withColumn(column, J.upper_json(F.col(column)))
    kind = T.DataType.fromDDL(schema) if isinstance(schema, str) else schema
    return df.withColumn(column, F.from_json(column, kind)).withColumn(column, J.upper_values(F.col(column), kind))
