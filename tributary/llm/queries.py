"""The registry of this subpackage's queries and of the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tributary.llm import embeddings, licenses, mixing, packing, pii, quality, secrets, simhash, substrings, tokens

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_simhash": simhash.op1_simhash,
    "op2_secrets": secrets.op2_secrets,
    "op3_packing": packing.op3_packing,
    "op4_embeddings": embeddings.op4_embeddings,
    "op5_mixing": mixing.op5_mixing,
    "op6_substrings": substrings.op6_substrings,
    "op7_pii": pii.op7_pii,
    "op8_quality": quality.op8_quality,
    "op9_tokens": tokens.op9_tokens,
    "op10_licenses": licenses.op10_licenses,
}

ORACLE_SQL: dict[str, str] = {
    "op2_secrets": secrets.SQL,
    "op4_embeddings": embeddings.SQL,
    "op5_mixing": mixing.SQL,
    "op6_substrings": substrings.SQL,
    "op7_pii": pii.SQL,
    "op8_quality": quality.SQL,
    "op10_licenses": licenses.sql(),
}
