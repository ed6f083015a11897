"""Payload formats: decoding by a declared schema, schemas that grow, retries."""

from __future__ import annotations

import random
import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def decode(value: Column, kind: str, schema: str, **options: str) -> Column:
    """A payload as a struct: json and csv by a DDL schema, xml likewise, avro by a JSON schema, protobuf by
    message:descriptor file. Avro and protobuf need Spark's packages for them. A payload that doesn't fit is null."""
    if kind == "json":
        return F.from_json(value.cast("string"), schema, {"mode": "PERMISSIVE", **options})
    if kind == "csv":
        return F.from_csv(value.cast("string"), schema, options)
    if kind == "xml":
        return F.from_xml(value.cast("string"), schema, options)
    if kind == "avro":
        from pyspark.sql.avro.functions import from_avro

        return from_avro(value, schema, {"mode": "PERMISSIVE", **options})
    if kind == "protobuf":
        from pyspark.sql.protobuf.functions import from_protobuf

        message, _, path = schema.partition(":")
        return from_protobuf(value, message, path, {"mode": "PERMISSIVE", **options})
    raise ValueError(f"unknown format {kind!r}")


def conforms(value: Column, schema: str) -> Column:
    """Whether a JSON text has every column of a schema, with a value of its type or null."""
    kind = T.DataType.fromDDL(schema)
    v = F.try_parse_json(value)
    out = F.coalesce(F.schema_of_variant(v).startswith("OBJECT"), F.lit(False))
    for f in kind.fields:
        path = f"$['{f.name}']"
        held = F.try_variant_get(v, path, "variant")
        out = out & held.isNotNull() & (F.is_variant_null(held) | F.try_variant_get(v, path, f.dataType.simpleString()).isNotNull())
    return F.coalesce(out, F.lit(False))


def evolve(old: DataFrame, new: DataFrame) -> DataFrame:
    """Rows of both; columns that one lacks are null there, numbers take the wider of two types."""
    wider = {("int", "bigint"): "bigint", ("int", "double"): "double", ("bigint", "double"): "double", ("float", "double"): "double"}
    kinds_a, kinds_b = dict(old.dtypes), dict(new.dtypes)
    for c in kinds_a.keys() & kinds_b.keys():
        a, b = kinds_a[c], kinds_b[c]
        if a != b:
            to = wider.get((a, b)) or wider.get((b, a))
            if to is None:
                raise ValueError(f"column {c} was {a} and is {b}")
            old, new = old.withColumn(c, F.col(c).cast(to)), new.withColumn(c, F.col(c).cast(to))
    return old.unionByName(new, allowMissingColumns=True)


def retried(work: Callable[[], object], tries: int = 5, first: float = 0.1, most: float = 10.0, sleep: Callable[[float], None] = time.sleep) -> object:
    """work(), tried again after errors, with waits that double and vary; the last error is raised."""
    for i in range(tries):
        try:
            return work()
        except Exception:
            if i == tries - 1:
                raise
            sleep(min(most, first * 2**i) * random.uniform(0.5, 1.0))
    raise AssertionError
