"""The job envelope: the one record type of the pipelines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tributary.functions.hashing import uuid7
from tributary.functions.json import is_object

#: Date, T, time with seconds, and Z or an offset. Anything else isn't a time, whatever else a parser would take.
RFC3339 = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}([.][0-9]+)?(Z|[+-][0-9]{2}:[0-9]{2})$"


def rfc3339(text: Column) -> Column:
    """The timestamp that a text says, null where it doesn't say one in full."""
    return F.when(text.rlike(RFC3339), F.try_to_timestamp(text))


def event_time(payload: Column) -> Column:
    """The time under eventTime in a JSON object, if it is a string that says one; else null, never an error."""
    v = F.try_variant_get(F.try_parse_json(payload), "$.eventTime", "variant")
    return F.when(F.schema_of_variant(v) == "STRING", rfc3339(F.try_variant_get(v, "$", "string")))


def envelop(df: DataFrame, payload: str, id: Column | None = None, at: Column | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """(id, data, node_created_at, node_updated_at, event_time, priority) of each row's JSON payload, and the columns keep.

    id is a new time-ordered UUID unless given; the node's times are now unless at is given; priority is 0.
    """
    now = F.current_timestamp() if at is None else at
    data = F.col(payload)
    return df.select((uuid7() if id is None else id).alias("id"), data.alias("data"), now.alias("node_created_at"), now.alias("node_updated_at"), event_time(data).alias("event_time"), F.lit(0).alias("priority"), *keep)


def valid_objects(df: DataFrame, payload: str) -> DataFrame:
    """Rows whose payload is a JSON object or the literal null; others are dropped, as a source drops them."""
    return df.where(is_object(F.col(payload)))


def split_invalid(df: DataFrame, payload: str) -> tuple[DataFrame, DataFrame]:
    """(rows with a valid payload, rows for a dead-letter queue with a column error)."""
    ok = is_object(F.col(payload))
    return df.where(ok), df.where(~ok).withColumn("error", F.when(F.col(payload).isNull(), "no payload").otherwise("not a JSON object"))


def with_payload(df: DataFrame, payload: str) -> DataFrame:
    """Rows that have a payload."""
    return df.where(F.col(payload).isNotNull())
