"""The corpus pipeline: stages that each read what the stage before has written."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tributary.llm import mixing, packing, pii, quality, simhash
from tributary.llm.common import cut, documents, keep, release, scope


def _measured(docs: DataFrame) -> DataFrame:
    """docs with n_chars of its texts as they are now."""
    return docs.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else docs


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass, without the lines that failed: quality.clean(), whose docstring says how it takes nulls, empty and
    long texts, repeated rows, empty tables and extra columns."""
    return _measured(quality.clean(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, on shingles of five words at a similarity of 0.8.

    simhash.near_duplicates_out() says how it takes nulls, empty and long texts, ties, repeated rows, empty tables and
    extra columns."""
    return simhash.near_duplicates_out(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data replaced by its kind; null and empty texts, repeated rows, empty tables and extra
    columns as pii.redact() says."""
    return _measured(pii.redact(docs))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them; sources weigh 1, 2, 3 in turn. mixing.mixed() says how it takes nulls, empty
    and long texts, ties, repeated rows, empty tables and extra columns."""
    return mixing.mixed(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str, tokenizer: str | None = None) -> DataFrame:
    """Pieces of all documents and their places in sequences of 1024 ids; nulls, empty and long texts, repeated rows, empty
    tables and extra columns as packing.pack_documents() says."""
    if tokenizer is None:
        import public_tokenizers

        tokenizer = public_tokenizers.path("byte_bpe_50k.json")
    return packing.pack_documents(docs, tokenizer).drop("__row").withColumnRenamed("id", "doc_id")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality rules", quality_rules),
    ("SimHash near-dedup", near_duplicates),
    ("PII", personal_data),
    ("mixing sources to target weights", mix),
    ("best-fit packing", pack),
]

#: The stages hash, tokenize and pack, which SQL doesn't express; tests/llm compare them with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir; each stage's result is written and read again by the next."""
    docs = documents(spark, sf_dir)
    for _, stage in STAGES[:-1]:
        with scope():  # what a stage has written for itself goes once its result is stored
            made = keep(cut(stage(spark, docs, sf_dir)))
        release(docs)
        docs = made
    return STAGES[-1][1](spark, docs, sf_dir)
