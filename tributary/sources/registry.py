"""Sources and sinks by type: configuration, validation, and the readers and writers that it stands for."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Spec:
    """The configuration of a source or a sink: {"name", "type", "key", "config": {...}}."""

    type: str
    name: str = ""
    key: str = ""
    config: Mapping[str, str] = field(default_factory=dict)

    @classmethod
    def of(cls, raw: Mapping) -> Spec:
        return cls(str(raw.get("type", "")), str(raw.get("name", "")), str(raw.get("key", "")), {str(k): str(v) for k, v in dict(raw.get("config") or {}).items()})

    def need(self, *names: str) -> Mapping[str, str]:
        """The configuration; an error names every option that is missing or empty."""
        if missing := [n for n in names if not self.config.get(n)]:
            raise ValueError(f"{self.type} {self.name or self.key}: missing {', '.join(missing)}")
        return self.config


#: (read a bounded load or None, read the live stream or None); both give a column value with a record's text.
Reader = tuple[Callable[[SparkSession, Spec], DataFrame | None], Callable[[SparkSession, Spec], DataFrame | None]]
SOURCES: dict[str, Reader] = {}
#: write(df, spec, streaming): df has a column value. A batch write returns None, a stream its query.
SINKS: dict[str, Callable] = {}
_FLAGS = {"1": True, "t": True, "true": True, "0": False, "f": False, "false": False}


def source(spec: Spec | Mapping) -> tuple[Spec, Reader]:
    spec = spec if isinstance(spec, Spec) else Spec.of(spec)
    if spec.type not in SOURCES:
        raise ValueError(f"unknown source type {spec.type!r}; there are {', '.join(sorted(SOURCES))}")
    return spec, SOURCES[spec.type]


def sink(spec: Spec | Mapping) -> tuple[Spec, Callable]:
    spec = spec if isinstance(spec, Spec) else Spec.of(spec)
    if spec.type not in SINKS:
        raise ValueError(f"unknown sink type {spec.type!r}; there are {', '.join(sorted(SINKS))}")
    return spec, SINKS[spec.type]


def kafka_options(spec: Spec, writing: bool = False) -> dict[str, str]:
    """Spark's options for a Kafka source or sink: bootstrap_servers, group and topic; a sink needs no group.

    Offsets live in the query's checkpoint, so a restart goes on where it was; group only names the consumer. Other
    options that begin with kafka. or are Spark's own are passed on.
    """
    c = spec.need("bootstrap_servers", "topic") if writing else spec.need("bootstrap_servers", "group", "topic")
    out = {"kafka.bootstrap.servers": c["bootstrap_servers"]}
    out |= {"topic": c["topic"]} if writing else {"subscribe": c["topic"], "groupIdPrefix": c["group"], "startingOffsets": c.get("starting_offsets", "earliest"), "failOnDataLoss": c.get("fail_on_data_loss", "true")}
    if not writing and c.get("max_offsets_per_trigger"):
        out["maxOffsetsPerTrigger"] = c["max_offsets_per_trigger"]
    return out | {k: v for k, v in c.items() if k.startswith("kafka.")}


def _kafka_live(spark: SparkSession, spec: Spec) -> DataFrame:
    return spark.readStream.format("kafka").options(**kafka_options(spec)).load().select(F.col("value").cast("string").alias("value"))


def mongo_options(spec: Spec) -> dict[str, str]:
    """uri, database and collection; load_initial_data says whether the stored documents come first (default: no)."""
    if not spec.key or not spec.name:
        raise ValueError("mongodb: a key and a name are needed")
    c = spec.need("uri", "database", "collection")
    return {**c, "load_initial_data": str(_FLAGS.get(c.get("load_initial_data", "").lower(), False)).lower()}


def _mongo(spark: SparkSession, spec: Spec) -> tuple[str, dict[str, str]]:
    from tributary.sources.documents import DocumentSource

    spark.dataSource.register(DocumentSource)
    return DocumentSource.name(), mongo_options(spec)


def begin(spec: Spec) -> Spec:
    """A source as it is when its pipeline starts: of a feed whose stored records come first, with the token from which
    its live ones follow them."""
    c = dict(spec.config)
    if spec.type not in (*FEEDS, "mongodb") or "start_token" in c or not _FLAGS.get(c.get("load_initial_data", "").lower(), False):
        return spec
    from tributary.sources.documents import client

    if spec.type == "http":
        c = {"client": HTTP_CLIENT, **c}
    return Spec(spec.type, spec.name, spec.key, {**c, "start_token": client(c).start(c)})


def _mongo_load(spark: SparkSession, spec: Spec) -> DataFrame | None:
    name, options = _mongo(spark, spec)
    return spark.read.format(name).options(**options).load().select("value") if options["load_initial_data"] == "true" else None


def _mongo_live(spark: SparkSession, spec: Spec) -> DataFrame:
    from tributary.sources.documents import full_documents

    name, options = _mongo(spark, spec)
    return full_documents(spark.readStream.format(name).options(**options).load())


def _file_format(spec: Spec) -> tuple[str, dict[str, str], str]:
    c = spec.need("path")
    return c.get("format", "text"), {k.removeprefix("option."): v for k, v in c.items() if k.startswith("option.")}, c["path"]


def as_value(df: DataFrame) -> DataFrame:
    """A record's text: the column value of a text source, or the row as JSON."""
    return df.select("value") if df.columns == ["value"] and df.dtypes[0][1] == "string" else df.select(F.to_json(F.struct("*")).alias("value"))


def _file_load(spark: SparkSession, spec: Spec) -> DataFrame | None:
    kind, options, path = _file_format(spec)
    if spec.config.get("stream", "false").lower() == "true":
        return None
    reader = spark.read.format(kind).options(**options)
    return as_value((reader.schema(spec.config["schema"]) if spec.config.get("schema") else reader).load(path))


def _file_live(spark: SparkSession, spec: Spec) -> DataFrame | None:
    kind, options, path = _file_format(spec)
    if spec.config.get("stream", "false").lower() != "true":
        return None
    reader = spark.readStream.format(kind).options(**options)
    if spec.config.get("max_files_per_trigger"):
        reader = reader.option("maxFilesPerTrigger", spec.config["max_files_per_trigger"])
    return as_value((reader.schema(spec.config["schema"]) if spec.config.get("schema") else reader).load(path))


def _jdbc_load(spark: SparkSession, spec: Spec) -> DataFrame:
    c = spec.need("url", "dbtable")
    return as_value(spark.read.format("jdbc").options(**c).load())


def _rate_live(spark: SparkSession, spec: Spec) -> DataFrame:
    return as_value(spark.readStream.format("rate").option("rowsPerSecond", spec.config.get("rows_per_second", "10")).load())


def _memory_load(spark: SparkSession, spec: Spec) -> DataFrame:
    """A view or table of the session."""
    return as_value(spark.table(spec.need("table")["table"]))


#: Services that are read through a client that the option client names as module:factory (sources/documents.py says
#: what it does). Their records are texts; the client's tokens are the offsets. http has a client of its own
#: (sources/http.py), the others need their service's library and so one that the user names.
HTTP_CLIENT = "tributary.sources.http:client"
FEEDS = ("http", "webhook", "rabbitmq", "sqs", "pulsar", "kinesis", "pubsub", "postgresql_cdc")


def _feed(spark: SparkSession, spec: Spec):
    from tributary.sources.documents import DocumentSource

    spark.dataSource.register(DocumentSource)
    c = dict(spec.need("url")) if spec.type == "http" else {}
    if spec.type == "http" and not c.get("client"):
        return DocumentSource.name(), {**c, "client": HTTP_CLIENT}
    return DocumentSource.name(), dict(spec.need("client"))


def _feed_load(spark: SparkSession, spec: Spec) -> DataFrame | None:
    name, options = _feed(spark, spec)
    return spark.read.format(name).options(**options).load() if _FLAGS.get(options.get("load_initial_data", "").lower(), False) else None


def _feed_live(spark: SparkSession, spec: Spec) -> DataFrame:
    name, options = _feed(spark, spec)
    return spark.readStream.format(name).options(**options).load()


_none = lambda spark, spec: None
SOURCES |= {name: (_feed_load, _feed_live) for name in FEEDS}
SOURCES |= {"memory": (_memory_load, _none), "kafka": (_none, _kafka_live), "mongodb": (_mongo_load, _mongo_live), "file": (_file_load, _file_live), "jdbc": (_jdbc_load, _none), "rate": (_none, _rate_live)}


def _start(df: DataFrame, spec: Spec, writer: Callable):
    w = writer(df.writeStream).queryName(spec.key or None) if spec.key else writer(df.writeStream)
    w = w.option("checkpointLocation", spec.need("checkpoint")["checkpoint"])
    every = spec.config.get("trigger", "available_now")
    return (w.trigger(availableNow=True) if every == "available_now" else w.trigger(processingTime=every)).start()


def _write_file(df: DataFrame, spec: Spec, streaming: bool):
    """Lines in the folder file_path; records without a payload are left out.

    Stored records are under batch=initial, written anew if the pipeline runs again. Each batch of a stream has a folder
    of its own, which is written anew if the batch is tried again, so no line is lost or doubled. Readers of file_path
    find all of them.
    """
    path, df = spec.need("file_path")["file_path"].rstrip("/"), df.where("value is not null").select("value")
    if streaming:
        return _start(df, spec, lambda w: w.foreachBatch(lambda batch, n: batch.write.mode("overwrite").text(f"{path}/batch={n}")))
    df.write.mode("overwrite").text(f"{path}/batch=initial")
    return None


def _write_kafka(df: DataFrame, spec: Spec, streaming: bool):
    options, df = kafka_options(spec, writing=True), df.where("value is not null").select("value")
    if streaming:
        return _start(df, spec, lambda w: w.format("kafka").options(**options))
    df.write.format("kafka").options(**options).save()
    return None


def _write_upsert(df: DataFrame, spec: Spec, streaming: bool):
    from tributary.sources.sinks import write_documents

    spec.need("index_name")
    if streaming:
        return _start(df, spec, lambda w: w.foreachBatch(lambda batch, _: write_documents(batch, dict(spec.config))))
    write_documents(df, dict(spec.config))
    return None


def _write_jdbc(df: DataFrame, spec: Spec, streaming: bool):
    c = spec.need("url", "dbtable")
    save = lambda batch: batch.select("value").write.format("jdbc").options(**c).mode("append").save()
    if streaming:
        return _start(df, spec, lambda w: w.foreachBatch(lambda batch, _: save(batch)))
    save(df)
    return None


def _write_memory(df: DataFrame, spec: Spec, streaming: bool):
    """A table of the session, for tests and small results: a view of a batch, a memory table of a stream."""
    name = spec.need("table")["table"]
    if streaming:
        return df.writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).start()
    df.createOrReplaceTempView(name)
    return None


def _write_sent(df: DataFrame, spec: Spec, streaming: bool):
    """Sends records in bulk, one a line, to url: by a post, to redis as a list's entries, or by the option sender."""
    from tributary.sources.sinks import send_lines

    spec.need("url")
    config = ({"sender": "tributary.sources.sinks:push"} if spec.type == "redis" else {}) | dict(spec.config)
    if streaming:
        return _start(df, spec, lambda w: w.foreachBatch(lambda batch, _: send_lines(batch, config)))
    send_lines(df, config)
    return None


def _write_mongo(df: DataFrame, spec: Spec, streaming: bool):
    """Documents under their _id, of a repeated one the last by the option order, as sinks.with_ids() says."""
    from tributary.sources.sinks import with_ids

    def save(batch: DataFrame) -> None:
        name, options = _mongo(batch.sparkSession, spec)
        with_ids(batch, spec.config.get("order")).select("value").write.format(name).options(**options).mode("append").save()

    if streaming:
        return _start(df, spec, lambda w: w.foreachBatch(lambda batch, _: save(batch)))
    save(df)
    return None


SINKS |= {name: _write_sent for name in ("http", "webhook", "redis")} | {"mongodb": _write_mongo}
SINKS |= {"s3": _write_file, "postgresql": _write_jdbc}
SINKS |= {"file": _write_file, "kafka": _write_kafka, "elasticsearch": _write_upsert, "jdbc": _write_jdbc, "memory": _write_memory}
